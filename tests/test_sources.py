"""Manifest audit on real files, staged publish, optional sources, cleaning."""

import hashlib

from pyspark.sql import functions as F

from tidemark.functions.columns import suspect_rule
from tidemark.plans.scalars import SUSPECT_TOKENS
from tidemark.sources import cleaning as cl
from tidemark.sources import documents as dc
from tidemark.sources import manifest as mf
from tidemark.sources import publish as pb


def test_manifest_classification(spark, tmp_path, rows):
    for name, text in (("a.csv", "1"), ("b.csv", "2"), ("needed.csv", "3")):
        (tmp_path / name).write_text(text)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()[:16]
    manifest = spark.createDataFrame([("a.csv", digest("1")), ("b.csv", "0" * 16), ("old.csv", "x")], "path string, digest string")
    required = spark.createDataFrame([("needed.csv",), ("gone.csv",)], "path string")
    audit = mf.audit(manifest, mf.file_digests(spark, str(tmp_path), "*.csv"), required)
    got = {r["path"]: r["status"] for r in rows(audit)}
    assert got == {"a.csv": "present", "b.csv": "mismatched", "old.csv": "optional missing", "needed.csv": "unlisted", "gone.csv": "required missing"}
    assert mf.passes(audit).first()["ok"] is False
    fine = audit.filter("status NOT IN ('mismatched', 'required missing')")
    assert mf.passes(fine).first()["ok"] is True


def test_failed_publish_keeps_the_old_version(spark, tmp_path):
    good = spark.createDataFrame([(1, 2.0)], "k int, v double")
    checks = {"positive": F.col("v") > 0}
    path, failed = pb.publish(good, str(tmp_path), checks)
    again, failed2 = pb.publish(good.withColumn("v", F.lit(None).cast("double")), str(tmp_path), checks)
    assert failed == [] and failed2 == ["positive"] and again == path
    assert pb.read_version(spark, again, good.schema).count() == 1
    empty, failed3 = pb.publish(good.limit(0), str(tmp_path), checks)
    assert failed3 == ["empty"] and empty == path


def test_pointer_outlives_the_session_object_and_has_one_winner(spark, tmp_path):
    """Two publishers that read the same pointer: the second does not move it. Another session resolves the same version."""
    root, checks = str(tmp_path / "p"), {"k": F.col("k").isNotNull()}
    assert pb.served(spark, root) == (0, None)
    first, second, late = (spark.createDataFrame([(i,)], "k int") for i in (1, 2, 3))
    pb.publish(first, root, checks)
    assert pb.publish(second, root, checks, after=1)[1] == []
    path, failed = pb.publish(late, root, checks, after=1)
    assert failed == ["superseded"]
    other = spark.newSession()
    number, again = pb.served(other, root)
    assert (number, again) == (2, path) and other.read.parquet(again).first()["k"] == 2
    assert len([p for p in (tmp_path / "p").iterdir() if p.name.startswith("v-")]) == 2


def test_many_publishers_at_once_have_one_winner_a_number(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "race")
    with ThreadPoolExecutor(4) as pool:
        outcomes = list(pool.map(lambda i: pb.publish(spark.createDataFrame([(i,)], "k int"), root, {"k": F.col("k") >= 0}, after=0)[1], range(4)))
    assert sorted(map(str, outcomes)) == ["['superseded']"] * 3 + ["[]"]
    assert pb.pointers(spark, root).count() == 1 and pb.served(spark, root)[0] == 1


def test_versions_nobody_serves_are_removed(spark, tmp_path):
    root, checks = str(tmp_path), {"k": F.col("k").isNotNull()}
    for i in range(4):
        pb.publish(spark.createDataFrame([(i,)], "k int"), root, checks)
    spark.createDataFrame([(9,)], "k int").write.parquet(f"{root}/v-orphan")
    assert pb.remove_unserved(spark, root) == []
    gone = pb.remove_unserved(spark, root, keep=2, idle_seconds=0)
    assert len(gone) == 3 and "v-orphan" in gone
    assert spark.read.parquet(pb.served(spark, root)[1]).first()["k"] == 3


PARTS = {("board", "rows"): "name string, value double", ("board", "dates"): "d date", ("alert", "rows"): "text string"}


def board(spark, value):
    rows = spark.createDataFrame([("a", value), ("b", None)], "name string, value double")
    dates = spark.createDataFrame([("2024-01-02",)], "d string")
    return rows, dates


def test_documents_become_visible_together(spark, tmp_path, rows):
    root = str(tmp_path)
    table, dates = board(spark, 1.5)
    whole = dc.part_rows(table, "board", "rows", PARTS["board", "rows"]).unionByName(dc.part_rows(dates, "board", "dates", "d date"))
    assert dc.publish_documents(whole, root, PARTS) == (None, ["missing alert/rows"])
    path, failed = dc.publish_documents(whole, root, PARTS, {("alert", "rows")})
    assert failed == []
    assert rows(dc.read_part(spark, path, "board", "rows", PARTS["board", "rows"]), "name") == [{"name": "a", "value": 1.5}, {"name": "b", "value": None}]
    assert rows(dc.read_part(spark, path, "board", "dates", "d date"))[0]["d"].isoformat() == "2024-01-02"
    table, dates = board(spark, 2.5)
    broken = dc.part_rows(table, "board", "rows", "name string").unionByName(dc.part_rows(dates, "board", "dates", "d date"))
    again, failed = dc.publish_documents(broken, root, PARTS, {("alert", "rows")})
    assert failed == ["unreadable board/rows"] and again == path


def test_file_digests_do_not_depend_on_how_ranges_are_dealt(spark, tmp_path):
    """Against a plain tree hash, over files of less than a leaf, exact leaves and several ranges; an empty file is missing."""
    (tmp_path / "empty.bin").touch()
    sizes = {"small.bin": 5, "leaf.bin": 64, "range.bin": 256, "long.bin": 1000}
    for name, n in sizes.items():
        (tmp_path / name).write_bytes(bytes(i * 7 % 251 for i in range(n)))

    def plain(data, leaf=64, leaves=4):
        size, parts = leaf * leaves, ""
        for at in range(0, len(data), size):
            block = data[at:at + size]
            digests = [hashlib.sha256(block[i:i + leaf]).digest() for i in range(0, len(block), leaf)]
            parts += hashlib.sha256(b"".join(digests)).hexdigest().upper()
        return hashlib.sha256(f"{len(data)} {parts}".encode()).hexdigest()

    for partitions in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = {r["path"]: r for r in mf.tree_digests(spark, str(tmp_path), "*.bin", leaf=64, leaves=4).collect()}
        assert {k: r["bytes"] for k, r in got.items()} == sizes and got["long.bin"]["ranges"] == 4
        assert {k: r["digest"] for k, r in got.items()} == {k: plain((tmp_path / k).read_bytes()) for k in sizes}
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_absent_optional_source_is_empty(spark, tmp_path):
    assert cl.read_optional(spark, str(tmp_path / "none.csv"), "d date, v double").count() == 0
    assert cl.read_optional(spark, None, "d date, v double").columns == ["d", "v"]
    (tmp_path / "some.csv").write_text("d,v\n2024-01-02,1.5\n")
    assert cl.read_optional(spark, str(tmp_path / "some.csv"), "d date, v double").first()["v"] == 1.5


def test_split_periods(spark, rows):
    raw = spark.createDataFrame([("m", " 202401.0"), ("y", "2023 12".replace(" ", "")), ("y", "202409"), ("z", "202401")], "type string, p string")
    monthly, annual = cl.split_periods(raw, "type", "p")
    assert [r["month"] for r in rows(monthly)] == ["2024-01"]
    assert [(r["year"], r["is_partial"]) for r in rows(annual, "year")] == [(2023, 0), (2024, 1)]


def test_suspect_rule(spark):
    df = spark.createDataFrame([("i", "buy I after a BIG C up day", 1, True), ("i", "buy I after a big C up day", 5, False), ("c", "big c", 1, False)], "a string, t string, h int, want boolean")
    for r in df.select("want", suspect_rule(F.col("a"), "I", F.col("h"), F.col("t"), SUSPECT_TOKENS).alias("got")).collect():
        assert r["want"] == r["got"]
