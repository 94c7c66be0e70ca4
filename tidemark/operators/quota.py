"""Monthly quota gate over change requests, split so that no account is one task's work.

Per account and posting month the first two accepted changes are free; afterwards only moves that
add to the safe component pass. The rule is a small state machine: (current holding, changes used).
With K target mixes it has 3K states, and a run of requests is a map from states to states. Maps
compose, so the work has three levels: requests are cut into short chunks (a minute, say) whose maps
are computed in parallel; the chunks of a day compose to one map per account and day; the days of an
account are chained. Going back down, each day and then each chunk learns the state it starts in, and
the chunks are replayed in parallel. A group is a chunk's requests, a day's chunks or an account's
days, never an account's requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

LIMIT = 2
# Outcome codes.
POSTED, POSTED_SAFE, NO_CHANGE, OVER_LIMIT, INVALID, LATE = "posted", "posted safe-only", "no change", "monthly limit", "invalid target", "late request"


def safe_moves(mixes: list[list[float]]) -> list[list[bool]]:
    """[current][target]: the move differs, does not cut component 0 and raises no other."""
    def ok(a, b):
        differs = any(abs(x - y) > 1e-8 for x, y in zip(a, b))
        return differs and b[0] >= a[0] - 1e-8 and all(y <= x + 1e-8 for x, y in zip(a[1:], b[1:]))

    return [[ok(a, b) for b in mixes] for a in mixes]


def one_hot_mixes(k: int) -> list[list[float]]:
    return [[1.0 if i == j else 0.0 for j in range(k)] for i in range(k)]


def transition(mixes: list[list[float]]) -> list[int]:
    """Flat table: state after requesting target x in state (holding * 3 + used); target K stands for any invalid one."""
    safe, k = safe_moves(mixes), len(mixes)
    table = []
    for x in range(k):
        for state in range(3 * k):
            held, used = divmod(state, 3)
            same = max(abs(a - b) for a, b in zip(mixes[held], mixes[x])) <= 1e-8
            accept = not same and (used < LIMIT or safe[held][x])
            table.append(x * 3 + min(used + 1, LIMIT) if accept else state)
    return table + list(range(3 * k))


def known_target(target_no: Column, k: int) -> Column:
    """The target's number, or k where it is NULL or names no mix."""
    return F.when(target_no.between(0, k - 1), target_no).otherwise(k).cast("int")


def chunked(requests: DataFrame, coarse: Column, fine: Column, mixes: list[list[float]]) -> DataFrame:
    """(account, month, day, chunk, ids, xs, map, gains): each chunk's requests in order, its state map, and how
    many of its requests are accepted from each state it may start in."""
    k = len(mixes)
    size = 3 * k
    ordered = F.sort_array(F.collect_list(F.struct("ts", "req_id", known_target(F.col("target_no"), k).alias("x"))))
    chunks = requests.groupBy("account", "month", coarse.alias("day"), fine.alias("chunk")).agg(ordered.alias("q"))
    chunks = chunks.select("account", "month", "day", "chunk", F.transform("q", lambda r: r["req_id"]).alias("ids"), F.transform("q", lambda r: r["x"]).alias("xs"))
    start = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda s: F.struct(s.alias("s"), F.lit(0).alias("n")))

    def step(acc: Column, x: Column) -> Column:
        after = lambda a: F.get(F.col("__t"), x * size + a["s"])
        return F.transform(acc, lambda a: F.struct(after(a).alias("s"), (a["n"] + (after(a) != a["s"]).cast("int")).alias("n")))

    folded = chunks.withColumn("__t", _table(mixes)).withColumn("f", F.aggregate("xs", start, step))
    return folded.select("account", "month", "day", "chunk", "ids", "xs", F.transform("f", lambda a: a["s"]).alias("map"), F.transform("f", lambda a: a["n"]).alias("gains"))


def _table(mixes: list[list[float]]) -> Column:
    return F.array(*[F.lit(v) for v in transition(mixes)])


def account_runs(chunks: DataFrame, initial: int, size: int, entry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(days with their chunk maps, accounts with `d` and `run`): the fold over each account's days.

    `run` has the month and state after the last day and the state that each day starts in. `entry(account, month,
    state)` is what accounts bring along; others begin in `initial` with nothing used.
    """
    days = chunks.groupBy("account", "month", "day").agg(F.sort_array(F.collect_list(F.struct("chunk", "map"))).alias("c"))
    whole = F.aggregate("c", F.sequence(F.lit(0), F.lit(size - 1)), lambda acc, c: F.transform(acc, lambda s: F.get(c["map"], s)))
    days = days.withColumn("map", whole)
    accounts = days.groupBy("account").agg(F.sort_array(F.collect_list(F.struct("month", "day", "map"))).alias("d"))
    month, state = F.lit(None).cast("date"), F.lit(initial * 3)
    if entry is not None:
        accounts = accounts.join(entry.select("account", F.col("month").alias("__m"), F.col("state").alias("__s")), "account", "left")
        month, state = F.col("__m"), F.coalesce("__s", state)
    zero = F.struct(month.alias("month"), state.alias("state"), F.array().cast("array<int>").alias("starts"))

    def next_day(acc, d):
        # A new posting month starts with nothing used.
        begin = F.when(acc["month"].eqNullSafe(d["month"]), acc["state"]).otherwise(acc["state"] - acc["state"] % 3)
        return F.struct(d["month"].alias("month"), F.get(d["map"], begin).alias("state"), F.array_append(acc["starts"], begin).alias("starts"))

    return days, accounts.select("account", "d", F.aggregate("d", zero, next_day).alias("run"))


def chunk_starts(chunks: DataFrame, initial: int, size: int, runs: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(account, month, day, chunk, start): the state each chunk starts in."""
    days, accounts = runs or account_runs(chunks, initial, size)
    begun = accounts.select("account", F.explode(F.arrays_zip("d", F.col("run")["starts"].alias("s"))).alias("z")).select(
        "account", F.col("z.d.month").alias("month"), F.col("z.d.day").alias("day"), F.col("z.s").alias("start"))

    def next_chunk(acc, c):
        return F.struct(F.get(c["map"], acc["state"]).alias("state"), F.array_append(acc["starts"], acc["state"]).alias("starts"))

    inside = days.join(begun, ["account", "month", "day"])
    first = F.struct(F.col("start").alias("state"), F.array().cast("array<int>").alias("starts"))
    path = F.aggregate("c", first, next_chunk)["starts"].alias("s")
    return inside.select("account", "month", "day", F.explode(F.arrays_zip("c", path)).alias("z")).select(
        "account", "month", "day", F.col("z.c.chunk").alias("chunk"), F.col("z.s").alias("start"))


def replay(chunks: DataFrame, mixes: list[list[float]]) -> DataFrame:
    """One row per request from chunks with a known start state: outcome, used count, holding after."""
    k = len(mixes)
    size = 3 * k
    first = F.array(F.col("start"))
    path = F.aggregate("xs", first, lambda acc, x: F.array_append(acc, F.get(F.col("__t"), x * size + F.element_at(acc, -1))))
    walked = chunks.withColumn("__t", _table(mixes)).withColumn("path", path)
    steps = F.arrays_zip("ids", "xs", F.slice("path", 1, F.size("ids")).alias("was"), F.slice("path", 2, F.size("ids")).alias("now"))
    rows = walked.select("account", "month", F.explode(steps).alias("z")).select("account", "month", F.col("z.ids").alias("req_id"), F.col("z.xs").alias("x"), F.col("z.was").alias("was"), F.col("z.now").alias("now"))
    accepted = F.col("was") != F.col("now")
    reason = (F.when(accepted & (F.col("was") % 3 < LIMIT), POSTED).when(accepted, POSTED_SAFE).when(F.col("x") == k, INVALID)
              .when(F.expr("was div 3 = x"), NO_CHANGE).otherwise(OVER_LIMIT))
    return rows.select("account", "month", "req_id", F.when(F.col("x") < k, F.col("x")).alias("target_no"), accepted.cast("int").alias("accepted"), reason.alias("reason"),
                       (F.col("now") % 3).alias("used"), F.expr("cast(now div 3 AS int)").alias("held_no"))


def meter(requests: DataFrame, mixes: list[list[float]], coarse: Column, fine: Column, initial: int = 0) -> DataFrame:
    """(account, month, used, accepted) of each account's last posting month, from the chunk maps alone."""
    chunks = materialize(chunked(requests, coarse, fine, mixes).drop("ids", "xs"))
    starts = chunk_starts(chunks.select("account", "month", "day", "chunk", "map"), initial, 3 * len(mixes))
    met = chunks.join(starts, ["account", "month", "day", "chunk"])
    months = met.groupBy("account", "month").agg(F.max_by(F.get("map", F.col("start")), "chunk").alias("state"), F.sum(F.get("gains", F.col("start"))).alias("accepted"))
    last = months.groupBy("account").agg(F.max_by(F.struct("month", "state", "accepted"), "month").alias("m"))
    return last.select("account", "m.month", (F.col("m.state") % 3).alias("used"), "m.accepted")


def gate(requests: DataFrame, mixes: list[list[float]], coarse: Column, fine: Column, initial: int = 0) -> DataFrame:
    """Decisions for every request: `requests(account, month, ts, req_id, target_no)`.

    `coarse` and `fine` are time buckets of the request, the fine one inside the coarse one; choose
    the fine one so that one bucket of the busiest account fits a task. Mixes must be distinct. A target
    that names no mix is answered with its own reason and changes nothing.
    """
    if len({tuple(m) for m in mixes}) != len(mixes):
        raise ValueError("target mixes must be distinct")
    chunks = materialize(chunked(requests, coarse, fine, mixes).drop("gains"))
    starts = chunk_starts(chunks.select("account", "month", "day", "chunk", "map"), initial, 3 * len(mixes))
    return replay(chunks.join(starts, ["account", "month", "day", "chunk"]).select("account", "month", "ids", "xs", "start"), mixes)


STATES = "account bigint, month date, state int, ts timestamp"


def gate_onward(requests: DataFrame, entry: DataFrame, mixes: list[list[float]], coarse: Column, fine: Column, initial: int = 0) -> tuple[DataFrame, DataFrame]:
    """(decisions, states) of requests that come after what `entry(account, month, state, ts)` has seen.

    The same composed maps as `gate`, begun in each account's state. A request before its account's last time, or without
    time or posting month, comes too late to be judged in order: it is answered as late and changes nothing. The
    states are those of the accounts that had requests in order.
    """
    k = len(mixes)
    seen = requests.join(entry.select("account", F.col("ts").alias("__seen"), F.col("state").alias("__state")), "account", "left")
    late = F.col("ts").isNull() | F.col("month").isNull() | F.coalesce(F.col("ts") < F.col("__seen"), F.lit(False))
    seen = materialize(seen.withColumn("__late", late))
    in_order = seen.where("NOT __late").drop("__seen", "__state", "__late")
    chunks = materialize(chunked(in_order, coarse, fine, mixes).drop("gains"))
    days, accounts = account_runs(chunks.select("account", "month", "day", "chunk", "map"), initial, 3 * k, entry)
    accounts = materialize(accounts)
    starts = chunk_starts(chunks, initial, 3 * k, (days, accounts))
    decided = replay(chunks.join(starts, ["account", "month", "day", "chunk"]).select("account", "month", "ids", "xs", "start"), mixes)
    state = F.coalesce("__state", F.lit(initial * 3))
    answered = seen.where("__late").select(
        "account", "month", "req_id", F.when(known_target(F.col("target_no"), k) < k, F.col("target_no")).cast("int").alias("target_no"), F.lit(0).alias("accepted"), F.lit(LATE).alias("reason"),
        (state % 3).cast("int").alias("used"), F.floor(state / 3).cast("int").alias("held_no"))
    last = in_order.groupBy("account").agg(F.max("ts").alias("ts"))
    states = accounts.join(last, "account").select("account", F.col("run")["month"].alias("month"), F.col("run")["state"].alias("state"), "ts")
    return decided.unionByName(answered), states
