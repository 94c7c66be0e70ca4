"""N-gram Jaccard join with prefix trees.

A document is the set of its distinct five-word shingles (A-Z folded). Shingles are put into one global order,
rare first; two sets with a Jaccard similarity of at least `percent` share a shingle among their first
n - ceil(percent n) + 1. Shingles found in one document only cannot match, so a document with too few others is
settled without any comparison.

The sets that are left are stored in global order. Candidates are met through the shingles of their prefixes: one
representative of each shingle's documents is compared with the others; what it links becomes one component, and
a shingle whose documents lie in one component is done. Elsewhere the documents outside the largest component are
the next representatives, each compared with every document of another component, until none is left. So a group
of copies costs its size, not its square, and no link between different sets is lost. A representative's partners
form a prefix tree in global order: overlaps counted for a shared path are reused, and a subtree is left as soon
as its remaining length cannot reach the needed overlap. Equal sets are one class and are compared once.

Defined cases: a text of one to four words is one shingle; without words the set is empty and linked with nothing;
rows with one id are one document; a row without id is linked with nothing and has no component; an empty table
gives an empty result. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.exchange import NO_ID, answers, chunked, first_of_runs, low32, opened, packed, plan, reply, unpack
from tidemark.llm.graph import components, light
from tidemark.llm.text import U, constants, mix, row_starts, windows, words
from tidemark.session import materialize

SHINGLE = 5
PERCENT = 75
BIN = 256
SETS = "doc_id bigint, n_shingles bigint, fp_a bigint, fp_b bigint, linkable boolean, live array<bigint>"


def distinct_shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, sorted by row and hash."""
    n_rows = len(offsets) - 1
    w = words(data, offsets, lower=True)
    at, h = windows(w.hash, w.row, size, seed=31)
    first = row_starts(w.row, n_rows)
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < size))
    whole = np.zeros(len(short), dtype=U)
    for j in range(size - 1):
        has = first[short] + j < first[short + 1]
        whole[has] = mix(whole[has] + w.hash[first[short[has]] + j]) * constants(1, seed=40 + j)[0]
    row, h = np.concatenate([w.row[at], short]), np.concatenate([h, whole])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])]) if len(row) else np.zeros(0, bool)
    return row[keep], h[keep]


def shingle_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: set size, set fingerprint, and for documents that can link the live shingles in global order."""
    sizes = plan(docs, text)
    bits = sizes.bits
    shift = U(32 - bits)

    def counted(key, table):
        ids, data, offsets = opened(table)
        row, h = distinct_shingles(data, offsets, size)
        code = np.sort(h[ids[row] != NO_ID] >> shift)
        run = first_of_runs(code)
        count = np.minimum(np.diff(np.append(run, len(code))), 255).astype(np.uint8)
        keys = code[run] << shift
        return packed(key[0].as_py(), keys, bits, keys=low32(keys, bits), count=count)

    def frequent(key, table):
        chunk = np.asarray(table.column("chunk"))
        keys, row = unpack(table, "keys", np.uint32)
        count, _ = unpack(table, "count", np.uint8)
        order = np.argsort(keys, kind="stable")
        keys, row, count = keys[order], row[order], count[order]
        run = first_of_runs(keys)
        total = np.add.reduceat(count.astype(np.int64), run)
        weight = np.minimum(np.ceil(8 * np.log2(np.maximum(total, 2))), 255).astype(np.uint8)
        length = np.diff(np.append(run, len(keys)))
        shared = np.repeat(total > 1, length)
        return reply(chunk, row[shared], key[0].as_py(), keys=keys[shared], weight=np.repeat(weight, length)[shared])

    def ordered(key, docs_table, found):
        ids, data, offsets = opened(docs_table)
        n_rows = len(ids)
        row, h = distinct_shingles(data, offsets, size)
        n = np.bincount(row, minlength=n_rows)
        first = row_starts(row, n_rows)
        fp = [_sums(mix(h ^ c), first) for c in constants(2, seed=50)]
        bucket, low, weight = answers(found, "keys", np.uint32, weight=np.uint8)
        code = (bucket.astype(U) << U(32)) | low.astype(U)
        order = np.argsort(code, kind="stable")
        code, weight = code[order], weight[order]
        place = np.minimum(np.searchsorted(code, h >> shift), max(len(code) - 1, 0))
        live = (code[place] == h >> shift) if len(code) else np.zeros(len(h), bool)
        n_live = np.bincount(row[live], minlength=n_rows)
        linkable = (n > 0) & (ids != NO_ID) & (100 * n_live >= percent * n)
        seen, stored = set(), linkable.copy()
        for i in np.flatnonzero(linkable).tolist():
            same = (int(ids[i]), int(fp[0][i]), int(fp[1][i]))
            stored[i] = same not in seen
            seen.add(same)
        pick = np.flatnonzero(live & stored[row])
        pick = pick[np.lexsort((h[pick], weight[place[pick]], row[pick]))]
        lengths = np.where(stored, n_live, 0)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(h[pick].view(np.int64)), mask=pa.array(~stored))
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=ids == NO_ID), "n_shingles": pa.array(n, pa.int64()), "fp_a": pa.array(fp[0].view(np.int64)),
            "fp_b": pa.array(fp[1].view(np.int64)), "linkable": pa.array(linkable), "live": lists})

    rows = chunked(docs, sizes, doc_id, text)
    counts = rows.groupBy("chunk").applyInArrow(counted, "bucket int, chunk int, keys binary, count binary")
    found = counts.groupBy("bucket").applyInArrow(frequent, "chunk int, bucket int, keys binary, weight binary")
    return rows.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(ordered, SETS)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each row's values modulo 2^64."""
    total = np.concatenate([np.zeros(1, U), np.cumsum(values, dtype=U)])
    return total[first[1:]] - total[first[:-1]]


def tree_overlaps(reference: np.ndarray, needs: list[int], paths: list[np.ndarray]) -> list[tuple[int, int]]:
    """Bounds (low, high) of the overlap of each path (a set in global order) with the reference set.

    The paths are visited in depth-first order of their prefix tree. `seen[d]` is the overlap of the current path's
    first d shingles; a path starts where it leaves the one before it. It ends early when the overlap so far and what
    is left of it cannot reach its need; otherwise the bounds are equal.
    """
    reference = np.sort(reference)
    out: list[tuple[int, int]] = [(0, 0)] * len(paths)
    before, seen, known = np.zeros(0, U), np.zeros(1, np.int64), 0
    for i in sorted(range(len(paths)), key=lambda i: paths[i].byteswap().tobytes()):
        path = paths[i]
        m = min(len(path), len(before))
        differ = np.flatnonzero(path[:m] != before[:m])
        depth = min(int(differ[0]) if len(differ) else m, known)
        grown = np.empty(len(path) + 1, np.int64)
        grown[:depth + 1] = seen[:depth + 1]
        while depth < len(path) and grown[depth] + min(len(path) - depth, len(reference)) >= needs[i]:
            step = path[depth:depth + 256]
            place = np.minimum(np.searchsorted(reference, step), len(reference) - 1)
            grown[depth + 1:depth + 1 + len(step)] = grown[depth] + np.cumsum(reference[place] == step)
            depth += len(step)
        low = int(grown[depth])
        out[i] = low, low + min(len(path) - depth, len(reference) - low)
        before, seen, known = path, grown, depth
    return out


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT, depth: float = 1.0) -> DataFrame:
    """(a, b, low, high, linked) of the pairs (node, ref): bounds of the overlap, and whether it reaches the similarity.

    Partners of one ref share its prefix tree, whose subtrees end where `depth` times the needed overlap is out of
    reach. Pairs are dealt to bins of about BIN partners; a ref with more is spread over several bins, each of which
    gets the ref's set once.
    """
    pairs = light(pairs)
    bins = max(1, -(-pairs.count() // BIN))
    shares = pairs.groupBy("ref").agg(F.ceil(F.count("*") / BIN).cast("int").alias("parts"))
    place = F.pmod(F.xxhash64("ref", "part"), F.lit(bins)).cast("int").alias("bin")
    mine = sets.select("node", "n", F.col("live").alias("path"))
    partners = pairs.join(shares, "ref").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).join(mine, "node")
    partners = partners.select(place, "ref", "node", "n", "path")
    refs = shares.join(mine.withColumnRenamed("node", "ref"), "ref").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    refs = refs.select(place, F.col("ref").alias("whose"), F.col("n").alias("whose_n"), F.col("path").alias("whose_path"))

    def judge(partners, refs):
        ref, node = partners.column("ref").to_pylist(), partners.column("node").to_pylist()
        n, paths = partners.column("n").to_pylist(), _lists(partners.column("path"))
        groups: dict[int, list[int]] = {}
        for i, r in enumerate(ref):
            groups.setdefault(r, []).append(i)
        rows = []
        for r, size, path in zip(refs.column("whose").to_pylist(), refs.column("whose_n").to_pylist(), _lists(refs.column("whose_path"))):
            group = groups.get(r, [])
            needs = [-(-percent * (n[i] + size) // (100 + percent)) for i in group]
            for i, need, (low, high) in zip(group, needs, tree_overlaps(path, [int(depth * x) for x in needs], [paths[i] for i in group])):
                rows.append((node[i], r, low, high, low >= need))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.table([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], names=["a", "b", "low", "high", "linked"])

    return partners.groupBy("bin").cogroup(refs.groupBy("bin")).applyInArrow(judge, "a bigint, b bigint, low bigint, high bigint, linked boolean")


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for part in column.chunks:
        bounds, values = np.asarray(part.offsets), np.asarray(part.values).view(U)
        out += [values[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    return out


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id): component_id is the smallest id reachable over links."""
    rows = materialize(shingle_sets(docs, doc_id, text, size, percent))
    classes = rows.where("linkable").groupBy("fp_a", "fp_b", "n_shingles").agg(F.min("doc_id").alias("node"))
    stored = rows.where("live IS NOT NULL")
    sets = materialize(stored.join(classes, ["fp_a", "fp_b", "n_shingles"]).where("doc_id = node").select("node", F.col("n_shingles").alias("n"), "live"))
    labels = _labels(sets, percent)
    named = classes.join(labels.withColumnRenamed("comp", "component"), "node", "left").select("fp_a", "fp_b", "n_shingles", "node", F.coalesce("component", "node").alias("component"), F.lit(True).alias("linkable"))
    light = rows.select("doc_id", "n_shingles", "fp_a", "fp_b", "linkable")
    return light.join(named, ["fp_a", "fp_b", "n_shingles", "linkable"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("node", "doc_id").alias("class_id"))


def _labels(sets: DataFrame, percent: int) -> DataFrame:
    """(node, comp) over all links between classes; `sets` has node, n and live.

    Round one compares the documents of a shingle with its hub, the one with the smallest share of dead shingles,
    and keeps the overlaps. Round two compares the documents outside a shingle's largest component with its most
    intact documents, later rounds take those outside as representatives. For two documents x and y of a shingle with
    hub h, the overlap is at most min(|x h|, |y h|) + min(|x - h|, |y - h|) over live shingles, and the first shingle
    that they share lies before place n - need + 1 of both; only pairs for which both hold are compared.
    """
    dead = "(n - size(live))"
    prefix = f"n - (({percent} * n + 99) div 100) + 1 - {dead}"
    postings = sets.where(f"{prefix} > 0").select("node", "n", F.size("live").alias("alive"), F.posexplode(F.expr(f"slice(live, 1, cast({prefix} AS int))")).alias("k", "token"))
    postings = postings.withColumn("place", F.col("n") - F.col("alive") + F.col("k")).drop("k")
    hubs = postings.groupBy("token").agg(F.min(F.struct((1 - F.col("alive") / F.col("n")).alias("share"), F.col("node"))).alias("hub"), F.min("node").alias("low"), F.max("node").alias("high"))
    hubs = light(hubs.where("low < high").select("token", F.col("hub.node").alias("ref")))
    met = postings.join(hubs, "token").where("node <> ref")
    tested = materialize(verified(met.groupBy("node", "ref").agg(F.lit(1)).select("node", "ref"), sets, percent, depth=0.5))
    labels = _merged(sets.select("node", F.col("node").alias("comp")), tested.where("linked"))

    def open_tokens(rest: DataFrame) -> DataFrame:
        """Postings of tokens whose documents still lie in several components."""
        known = rest.join(labels, "node")
        several = known.groupBy("token").agg(F.min("comp").alias("first"), F.max("comp").alias("last")).where("first < last").select("token")
        return light(known.join(several, "token", "left_semi"))

    bounds = tested.select(F.col("a").alias("node"), F.col("b").alias("ref"), "high", "low")
    rest = met.join(bounds, ["node", "ref"]).select("token", "node", "n", "place", "high", (F.col("alive") - F.col("low")).alias("own"), (F.col("n") - F.col("alive")).alias("dead"))
    rest, inside, salts = open_tokens(rest), True, 16
    need = f"({percent} * (n + r_n) + {99 + percent}) div {100 + percent}"
    reach = f"""comp <> r_comp AND 100 * least(n, r_n) >= {percent} * greatest(n, r_n) AND least(high, r_high) + least(own, r_own) >= {need}
                AND place <= n - {need} AND r_place <= r_n - {need}"""
    while not rest.isEmpty():
        share = rest.groupBy("token", "comp").agg(F.count("*").alias("m"))
        largest = share.groupBy("token").agg(F.max(F.struct("m", "comp")).alias("top")).select("token", F.col("top.comp").alias("main"))
        known = rest.join(largest, "token")
        outside = known.where("comp <> main").drop("main")
        salt = F.pmod(F.xxhash64("node"), F.lit(salts)).alias("salt")
        refs = (known.where("comp = main") if inside else outside).groupBy("token", salt).agg(F.min(F.struct("dead", "node", "comp", "n", "place", "high", "own")).alias("r"))
        refs = light(refs.select("token", F.col("r.node").alias("ref"), *[F.col(f"r.{c}").alias(f"r_{c}") for c in ("comp", "n", "place", "high", "own")]))
        pairs = (outside if inside else rest).join(refs, "token").where(reach).groupBy("node", "ref").agg(F.lit(1)).select("node", "ref")
        more = materialize(verified(pairs, sets, percent).where("linked"))
        if not more.isEmpty():
            labels = _merged(labels, more)
        rest = open_tokens(rest.drop("comp").join(refs.select("token", F.col("ref").alias("node")), ["token", "node"], "left_anti"))
        inside, salts = False, 256 if inside else min(16 * salts, 1 << 16)
    return labels


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after links between nodes: components of the labels that the links join."""
    a, b = labels.select(F.col("node").alias("a"), F.col("comp").alias("a_comp")), labels.select(F.col("node").alias("b"), F.col("comp").alias("b_comp"))
    edges = links.select("a", "b").join(a, "a").join(b, "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
    moved = components(edges).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return light(labels.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))
