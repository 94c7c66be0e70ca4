"""Chat formatting by a finite-state machine over roles and a declarative template, in column functions alone.

A template names for each role what opens and closes its turns and whether the loss is taken over its text; which
role may follow which is a transition table. A turn gives three segments, (text, loss): opening, escaped text,
closing; only the texts of loss roles carry the flag. Roles that the template does not know are written in a general
form with the role inside, so nothing is lost, and make the conversation invalid.

A control string inside a text gets a backslash after its first character, one more where there are some already;
taking one away restores the text. Escaped texts hold no control string, so the output is read back by cutting it at
control strings (`turns_of`, `loss_text`).

Conversations are cut by turn number into parts of PART turns. A part's effect on the machine is a table from state
to state; tables compose, first within groups of parts, then over groups, and give each part its start state. So a
conversation with any share of all rows is formatted in many tasks, and only tables of a few integers meet.

Defined cases: NULL text and NULL role are empty strings; a row without conversation id is a conversation of its own; NULL
turns come first, equal turn numbers are ordered by role and text, repeated rows stay repeated (rows of one
conversation and turn number meet in one part); an empty conversation table gives an empty result; only the four columns
are read, so other columns and their names do not matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

PART, GROUP = 32, 1024
START, ERROR = "start", "error"


@dataclass(frozen=True)
class Turn:
    """What opens and closes a turn, and whether its text is learned."""

    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Roles, the general form of other roles (before the role, before the text, after it), and the turn order.

    `order` maps a state to the roles that may come and the state they lead to; what it does not name leads to an
    error, which lasts. A conversation is complete in one of the states `ends`.
    """

    begin: str = "<s>"
    roles: dict[str, Turn] = field(default_factory=lambda: {
        "system": Turn("[SYS] ", " [/SYS]"), "user": Turn("[INST] ", " [/INST]"), "assistant": Turn("[ANS] ", " </s>", True)})
    other: tuple[str, str, str] = ("[ROLE] ", " [TEXT] ", " [/TEXT]")
    order: dict[str, dict[str, str]] = field(default_factory=lambda: {
        START: {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    ends: tuple[str, ...] = ("assistant",)

    @property
    def states(self) -> list[str]:
        return list(dict.fromkeys([START, *self.order, *(to for row in self.order.values() for to in row.values()), ERROR]))

    @property
    def controls(self) -> list[str]:
        """Control strings: names in angle or square brackets, as they stand in the template."""
        marks = [self.begin, *self.other, *(x for t in self.roles.values() for x in (t.open, t.close))]
        return sorted({c for mark in marks for c in re.findall(r"<[^<>\[\]\s]+>|\[[^<>\[\]\s]+\]", mark)})


def _inside(template: Template, lead: str) -> str:
    """Pattern of a control string's first character before `lead` and the rest of the string."""
    kinds = {}
    for c in template.controls:
        kinds.setdefault(c[0], []).append(re.escape(c[1:]))
    return "|".join(rf"{re.escape(first)}(?={lead}(?:{'|'.join(rest)}))" for first, rest in kinds.items())


def escaped(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, F.lit(rf"(?:{_inside(template, r'\\*')})"), F.lit(r"$0\\"))


def unescaped(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, F.lit(rf"({_inside(template, r'\\+')})\\"), F.lit("$1"))


def chosen(role: Column, template: Template, of, other: Column) -> Column:
    """A value by role: `of` the role's turn, or `other`."""
    return reduce(lambda found, name: F.when(role == name, of(template.roles[name])).otherwise(found), template.roles, other)


def segments(turn: Column, template: Template) -> Column:
    """The three segments of a turn (role, text)."""
    before, between, after = template.other
    opening = chosen(turn["role"], template, lambda t: F.lit(t.open), F.concat(F.lit(before), escaped(turn["role"], template), F.lit(between)))
    closing = chosen(turn["role"], template, lambda t: F.lit(t.close), F.lit(after))
    loss = chosen(turn["role"], template, lambda t: F.lit(t.loss), F.lit(False))
    return F.array(*[F.struct(text.alias("text"), flag.alias("loss")) for text, flag in ((opening, F.lit(False)), (escaped(turn["text"], template), loss), (closing, F.lit(False)))])


def following(state: Column, role: Column, template: Template) -> Column:
    """The state that a role leads to, as a position in `template.states`."""
    number = {name: i for i, name in enumerate(template.states)}
    out = F.lit(number[ERROR])
    for name, row in template.order.items():
        for at, to in row.items():
            out = F.when((state == number[name]) & (role == at), number[to]).otherwise(out)
    return out


def _composed(tables: Column, states: int) -> Column:
    """One table of what the tables (`ends`) do one after the other."""
    return F.array(*[F.aggregate(tables, F.lit(s), lambda at, t: F.element_at(t["ends"], at + 1)) for s in range(states)])


def _replayed(frame: DataFrame, keys: list[str], place: str, tables: str, start: Column) -> DataFrame:
    """A row (keys, place, start) for each table of the sorted array, with the state in which it starts."""
    seen = F.aggregate(tables, F.array(start), lambda at, t: F.concat(at, F.array(F.element_at(t["ends"], F.element_at(at, -1) + 1))))
    each = F.arrays_zip(F.col(tables)[place].alias("place"), F.slice(seen, 1, F.size(tables)).alias("start"))
    return frame.select(*keys, F.explode(each).alias("x")).select(*keys, F.col("x.place").alias(place), F.col("x.start").alias("start"))


def start_states(parts: DataFrame, states: int) -> DataFrame:
    """(conv_id, part, start) from the parts' tables: composed in groups, then over a conversation's groups."""
    listed = lambda place: F.sort_array(F.collect_list(F.struct(place, "ends"))).alias("tables")
    groups = materialize(parts.groupBy("conv_id", F.floor(F.col("part") / GROUP).alias("bunch")).agg(listed("part")))
    whole = groups.withColumn("ends", _composed(F.col("tables"), states)).groupBy("conv_id").agg(listed("bunch"))
    entries = _replayed(whole, ["conv_id"], "bunch", "tables", F.lit(0)).withColumnRenamed("start", "entry")
    return _replayed(groups.join(entries, ["conv_id", "bunch"]), ["conv_id"], "part", "tables", F.col("entry"))


def _run(turns: str, start: Column, template: Template) -> Column:
    """(state, bad): where the machine ends from a start state, and how many turns led to or found it in error."""
    error = template.states.index(ERROR)

    def step(at, t):
        to = following(at["state"], t["role"], template)
        return F.struct(to.alias("state"), (at["bad"] + (to == error).cast("int")).alias("bad"))

    return F.aggregate(turns, F.struct(start.alias("state"), F.lit(0).alias("bad")), step)


def judged(roles: DataFrame, template: Template) -> DataFrame:
    """(conv_id, part, parts, opens, bad_turns, complete) of each part, from (conv_id, part, role struct) rows; no text is read."""
    states = range(len(template.states))
    runs = materialize(roles.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("said")).alias("turns")).select("conv_id", "part", F.array(*[_run("turns", F.lit(s), template) for s in states]).alias("runs")))
    starts = start_states(runs.select("conv_id", "part", F.col("runs.state").alias("ends")), len(states))
    extent = runs.groupBy("conv_id").agg(F.min("part").alias("first"), F.count("*").alias("parts"))
    run = F.element_at("runs", F.col("start") + 1)
    return runs.join(starts, ["conv_id", "part"]).join(extent, "conv_id").select(
        "conv_id", "part", "parts", (F.col("part") == F.col("first")).alias("opens"), run["bad"].cast("bigint").alias("bad_turns"), run["state"].isin([template.states.index(e) for e in template.ends]).alias("complete"))


def formatted(turns: DataFrame, template: Template = Template(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every conversation as parts in order: (conv_id, part, parts, n_turns, segments, text, bad_turns, complete).

    The texts of a conversation's `parts` parts, one after the other, are its output; a row without id is a
    conversation of one part. `bad_turns` counts the part's turns from the first that the order does not allow,
    `complete` says whether the machine is in an end state after the part. The texts are shuffled once; what the
    machine needs is joined to them.
    """
    number = F.col(turn).cast("bigint")
    named = turns.select(
        F.col(conv_id).cast("bigint").alias("conv_id"), F.coalesce(F.floor(number / PART), F.lit(-(1 << 60))).alias("part"), number.alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    known, alone = named.where("conv_id IS NOT NULL"), named.where("conv_id IS NULL")
    flags = judged(known.select("conv_id", "part", F.struct("turn", "role").alias("said")), template)
    body = F.struct("turn", "role", "text").alias("said")
    parts = known.select("conv_id", "part", body).groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("said")).alias("turns")).join(flags, ["conv_id", "part"])
    run = _run("turns", F.lit(0), template)
    single = alone.select("conv_id", "part", F.array(body).alias("turns"), F.lit(1).cast("bigint").alias("parts"), F.lit(True).alias("opens")).withColumn("bad_turns", run["bad"].cast("bigint"))
    single = single.withColumn("complete", run["state"].isin([template.states.index(e) for e in template.ends]))
    made = F.flatten(F.transform("turns", lambda t: segments(t, template)))
    opening = F.when(F.col("opens"), F.array(F.struct(F.lit(template.begin).alias("text"), F.lit(False).alias("loss")))).otherwise(F.slice(made, 1, 0))
    out = parts.unionByName(single).select("conv_id", "part", "parts", F.size("turns").cast("bigint").alias("n_turns"), F.concat(opening, made).alias("segments"), "bad_turns", "complete")
    return out.select("conv_id", "part", "parts", "n_turns", "segments", F.array_join("segments.text", "").alias("text"), "bad_turns", "complete")


def turns_of(output: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>> read back from an output."""
    before, between, after = template.other
    forms = [(re.escape(t.open), re.escape(t.close)) for t in template.roles.values()] + [(re.escape(before) + ".*?" + re.escape(between), re.escape(after))]
    found = F.regexp_extract_all(output, F.lit("(?s)" + "|".join(f"(?:{a}.*?{b})" for a, b in forms)), F.lit(0))

    def parsed(whole):
        role = F.regexp_extract(whole, f"(?s)^{re.escape(before)}(.*?){re.escape(between)}", 1)
        skip, drop = F.length(role) + len(before) + len(between), F.lit(len(after))
        name = unescaped(role, template)
        for known, t in template.roles.items():
            mine = whole.startswith(t.open)
            name, skip, drop = F.when(mine, known).otherwise(name), F.when(mine, len(t.open)).otherwise(skip), F.when(mine, len(t.close)).otherwise(drop)
        return F.struct(name.alias("role"), unescaped(F.substring(whole, skip + 1, F.length(whole) - skip - drop), template).alias("text"))

    return F.transform(found, parsed)


def loss_text(parts: Column, template: Template = Template()) -> Column:
    """What the loss is taken over, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(parts, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")


def digests(output: DataFrame, template: Template = Template()) -> DataFrame:
    """A row per conversation, read back from the formatted parts; only conversations of several parts are shuffled."""
    back = output.select("conv_id", "part", "parts", turns_of(F.col("text"), template).alias("back"), F.length("text").cast("bigint").alias("formatted_chars"), (F.col("bad_turns") == 0).alias("good"), "complete", loss_text(F.col("segments"), template).alias("loss"))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = back.select("conv_id", "part", "parts", F.size("back").cast("bigint").alias("n_turns"), "formatted_chars", "good", "complete", said.alias("said"), "loss")
    names = ["conv_id", "n_turns", "said", "loss", "formatted_chars", (F.col("good") & F.col("complete")).alias("valid")]
    several = read.where("parts > 1").groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"), F.bool_and("good").alias("good"), F.max_by("complete", "part").alias("complete"), F.sort_array(F.collect_list(F.struct("part", "said", "loss"))).alias("all"))
    several = several.withColumn("said", F.array_join("all.said", "")).withColumn("loss", F.array_join("all.loss", "")).select(*names)
    return read.where("parts = 1").select(*names).unionByName(several).select(
        "conv_id", "n_turns", F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "valid")
