"""Mixing and the archive on messy rows."""

import hashlib
import re

from pyspark.sql import functions as F

from tidemark.llm.mixing import mixed, targets
from tidemark.llm.warc import archive_folder, member, members, read_archive, write_archive


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        goal = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if goal[s] > 2 * sizes[s]}
        if not over:
            return {**{s: 2.0 * sizes[s] for s in capped}, **goal}
        capped |= over


def test_targets_are_what_repeated_resharing_ends_at(spark):
    for sizes in ({"a": 100, "b": 10, "c": 1000, None: 5}, {"b": 1}, {f"s{i:02d}": (i * 37) % 101 for i in range(25)}, {"é": 5, "z": 9, "A": 0}):
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r["source"]: r["target"] for r in targets(frame).collect()}
        assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in brute_targets(sizes).items()}


def test_mix_comes_near_its_targets(messy, nothing):
    rows = mixed(messy).collect()
    assert len(rows) == messy.count() and mixed(nothing).count() == 0
    assert sorted((r["doc_id"] is not None, r["doc_id"], r["size"]) for r in rows) == sorted((r["doc_id"] is not None, r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in messy.collect())
    assert all(0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"] for r in rows)
    for source in {r["source"] for r in rows}:
        mine = [r for r in rows if r["source"] == source]
        steps = {}
        for r in mine:
            steps[r["doc_id"]] = steps.get(r["doc_id"], 0) + r["size"]
        assert sum(r["size"] for r in mine) == mine[0]["source_size"]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(steps.values()) / 2 + 1
    assert sorted(map(str, rows)) == sorted(map(str, mixed(messy).collect()))


def test_thresholds_are_nested(messy):
    small = {(r["doc_id"], r["size"]): r["copies"] for r in mixed(messy, share=0.5).collect()}
    large = {(r["doc_id"], r["size"]): r["copies"] for r in mixed(messy, share=0.8).collect()}
    assert all(small[k] <= large[k] for k in small)


def pages_of(spark):
    long, other = "<p>" + "é" * 600 + "</p>", "<b>" + "x" * 2000 + "</b>"
    rows = [(1, "http://a/1", long), (2, "http://a/2", long), (9, None, long), (3, "u\r\nX: y", "short"), (4, "u", "short"), (5, "u", None), (6, None, ""), (7, "u", other), (None, "u", other), (None, "u", None),
            (8, "u", "z" * 999), (10, "u", "z" * 999), (11, "u", "q" * 1000), (12, "u", "q" * 1000), (12, "u", "q" * 1000), (13, "u", "\r\n\r\n" + "w" * 5_000_000)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, payload string, shard int")


def test_archive_round_trip(spark):
    pages = pages_of(spark)
    folder = archive_folder(pages)
    manifest = write_archive(pages, folder, file_bytes=300, shards=3)
    got = read_archive(manifest, folder).collect()
    owner = {}
    for r in pages.collect():
        body = (r["html"] or "").encode()
        if len(body) >= 1000:
            owner[body] = max(owner.get(body, -1), -1 if r["page_id"] is None else r["page_id"])
    expected = []
    for r in pages.collect():
        body = (r["html"] or "").encode()
        kept = owner.get(body, r["page_id"]) == r["page_id"]
        expected.append((r["page_id"], len(body), hashlib.sha1(body).hexdigest(), "response" if kept else "revisit", None if kept else owner[body], body if kept else b""))
    order = lambda x: tuple((y is not None, y) for y in x)
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"])) for r in got], key=order) == sorted(expected, key=order)
    assert manifest.count() > 3 and manifest.agg(F.sum("records")).first()[0] == pages.count()


def test_reruns_write_the_same_bytes(spark):
    pages = pages_of(spark)
    seen = []
    for _ in range(2):
        folder = archive_folder(pages)
        seen.append(sorted((r["final"], r["records"], r["bytes"], r["sha1"]) for r in write_archive(pages, folder, file_bytes=300, shards=3).collect()))
    assert seen[0] == seen[1]


def test_reruns_of_many_rows_write_the_same_bytes(spark):
    pages = spark.range(0, 40_000, 1, 4).select(F.expr("id * 7919 % 100003").alias("page_id"), F.concat(F.lit("u"), F.col("id")).alias("url"), F.concat(F.lit("p"), F.col("id")).alias("html"))
    seen = []
    for again in range(2):
        rows = pages.repartition(4 + again, "page_id")
        seen.append(sorted((r["final"], r["records"], r["bytes"], r["sha1"]) for r in write_archive(rows, archive_folder(rows), shards=5).collect()))
    assert seen[0] == seen[1]
    records = [r[1] for r in seen[0]]
    assert len(records) == 5 and sum(records) == 40_000 and max(records) < 2 * min(records)


def test_no_pages(spark):
    pages = pages_of(spark).where("1 = 0")
    folder = archive_folder(pages)
    assert read_archive(write_archive(pages, folder), folder).count() == 0


def test_members_are_found_across_blocks():
    import io

    parts = [b"a" * 10, b"", bytes(range(256)) * 900]
    assert list(members(io.BytesIO(b"".join(member(p) for p in parts)), block=7)) == parts
