"""Quota gate: literal sequence, independent accounts, hot accounts, general mixes, batch equals stream."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import quota as qt

SCHEMA = "account bigint, req_id bigint, ts timestamp, target_no int, month date"


def gate(spark, data, mixes, initial=0):
    df = spark.createDataFrame(data, SCHEMA)
    out = qt.gate(df, mixes, F.to_date("ts"), F.date_trunc("minute", "ts"), initial)
    return {r["req_id"]: r.asDict() for r in out.collect()}


def brute(data, mixes, initial=0):
    safe, state, out = qt.safe_moves(mixes), {}, {}
    for account, req, _ts, x, month in sorted(data, key=lambda r: (r[0], r[2], r[1])):
        held, used, m = state.get(account, (initial, 0, None))
        used = used if m == month else 0
        ok = x != held and (used < 2 or safe[held][x])
        if ok:
            held, used = x, min(used + 1, 2)
        state[account] = (held, used, month)
        out[req] = (int(ok), used, held)
    return out


def at(month, day, hour=9):
    return dt.datetime(2026, month, day, hour)


def test_literal_sequence(spark):
    safe, core, small, world = 0, 1, 2, 3
    sep, octo = dt.date(2026, 9, 1), dt.date(2026, 10, 1)
    steps = [(small, at(9, 1), sep), (world, at(9, 2), sep), (core, at(9, 3), sep), (safe, at(9, 4), sep), (core, at(9, 8), sep), (core, at(10, 1), octo)]
    out = gate(spark, [(1, i, ts, x, m) for i, (x, ts, m) in enumerate(steps)], qt.one_hot_mixes(4), initial=core)
    assert [out[i]["accepted"] for i in range(6)] == [1, 1, 0, 1, 0, 1]
    assert [out[i]["reason"] for i in range(6)] == [qt.POSTED, qt.POSTED, qt.OVER_LIMIT, qt.POSTED_SAFE, qt.OVER_LIMIT, qt.POSTED]
    assert [out[i]["used"] for i in range(6)] == [1, 2, 2, 2, 2, 1]


def test_accounts_are_independent(spark):
    m = dt.date(2026, 9, 1)
    data = [(1, 0, at(9, 1), 1, m), (1, 1, at(9, 2), 2, m), (1, 2, at(9, 3), 1, m), (2, 3, at(9, 3), 1, m)]
    out = gate(spark, data, qt.one_hot_mixes(3))
    assert [out[i]["accepted"] for i in range(4)] == [1, 1, 0, 1] and out[3]["used"] == 1


def test_repeated_target_is_no_change(spark):
    out = gate(spark, [(1, 0, at(9, 1), 0, dt.date(2026, 9, 1))], qt.one_hot_mixes(2))
    assert out[0]["reason"] == qt.NO_CHANGE and out[0]["used"] == 0


def random_requests(seed, n=600, k=4):
    rnd, start, data = random.Random(seed), dt.datetime(2026, 1, 1), []
    for i in range(n):
        ts = start + dt.timedelta(minutes=rnd.randrange(60 * 24 * 90))
        data.append((0 if rnd.random() < 0.4 else rnd.randrange(1, 9), i, ts, rnd.randrange(k), ts.date().replace(day=1)))
    return data


def test_hot_account_against_brute_force(spark):
    data, mixes = random_requests(3), qt.one_hot_mixes(4)
    out, want = gate(spark, data, mixes), brute(data, mixes)
    assert {i: (r["accepted"], r["used"], r["held_no"]) for i, r in out.items()} == want


def test_partial_mixes_allow_partial_safe_moves(spark):
    mixes = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.4, 0.6, 0.0], [0.2, 0.4, 0.4]]
    assert qt.safe_moves(mixes)[1][2] and not qt.safe_moves(mixes)[2][1] and not qt.safe_moves(mixes)[1][3]
    data = random_requests(9)
    out, want = gate(spark, data, mixes), brute(data, mixes)
    assert {i: (r["accepted"], r["used"], r["held_no"]) for i, r in out.items()} == want


def streamed(spark, tmp_path, parts, mixes, prepare=lambda b: b):
    """Decisions after each of the parts has come as a file of its own; the stream stops and starts again between them."""
    from tidemark.streaming.quota_stream import gate_batches

    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i % 2:
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            out = gate_batches(stream, prepare, mixes, str(tmp_path / "run"))
    return {r["req_id"]: r.asDict() for r in out.collect()}


def test_stream_equals_batch_over_micro_batches_and_restarts(spark, tmp_path, monkeypatch):
    from tidemark.streaming import quota_stream

    monkeypatch.setattr(quota_stream, "COMPACT", 3)
    data, mixes = sorted(random_requests(11, 240), key=lambda r: (r[2], r[1])), qt.one_hot_mixes(4)
    data = [(r[0], r[1], r[2] + dt.timedelta(microseconds=i), *r[3:]) for i, r in enumerate(data)]
    got = streamed(spark, tmp_path, [data[i:i + 40] for i in range(0, 240, 40)], mixes)
    assert {i: (r["accepted"], r["used"], r["held_no"]) for i, r in got.items()} == brute(data, mixes)


def test_late_requests_change_nothing_in_a_stream(spark, tmp_path):
    m = dt.date(2026, 9, 1)
    first = [(1, 0, at(9, 5), 1, m), (2, 1, at(9, 5), 2, m)]
    second = [(1, 2, at(9, 4), 2, m), (1, 3, at(9, 6), 2, m), (1, 4, None, 2, m), (1, 5, at(9, 7), 1, None), (3, 6, at(9, 1), 1, m), (1, 7, at(9, 7), 0, m)]
    got = streamed(spark, tmp_path, [first, second], qt.one_hot_mixes(3))
    assert [got[i]["reason"] for i in range(8)] == [qt.POSTED, qt.POSTED, qt.LATE, qt.POSTED, qt.LATE, qt.LATE, qt.POSTED, qt.POSTED_SAFE]
    assert (got[2]["used"], got[2]["held_no"], got[2]["target_no"]) == (1, 1, 2) and got[7]["held_no"] == 0


def test_a_repeated_batch_gives_the_same_state(spark, tmp_path):
    from tidemark.streaming.quota_stream import StateTable

    mixes, m = qt.one_hot_mixes(3), dt.date(2026, 9, 1)
    table = StateTable(spark, str(tmp_path / "states"))
    one = spark.createDataFrame([(1, 0, at(9, 5), 1, m)], SCHEMA)
    two = spark.createDataFrame([(1, 1, at(9, 6), 2, m)], SCHEMA)
    for number, rows in ((0, one), (1, two), (1, two)):
        before = table.before(number)
        decisions, moved = qt.gate_onward(rows, before, mixes, F.to_date("ts"), F.date_trunc("minute", "ts"))
        assert [r["used"] for r in decisions.collect()] == [number + 1]
        table.write(number, moved, before)
    assert [(r["account"], r["state"]) for r in table.before(9).collect()] == [(1, 2 * 3 + 2)]


def test_stream_has_no_last_year(spark, tmp_path):
    from tidemark.plans import quota as plans

    rows = [(1, 0, dt.datetime(2071, 3, 31, 15, 0), "click"), (1, 1, dt.datetime(2071, 3, 31, 20, 0), "signup")]
    frame = spark.createDataFrame(rows, "account bigint, req_id bigint, ts timestamp, target string")
    got = {r["req_id"]: r for r in plans.numbered(frame).collect()}
    assert got[0]["month"] == dt.date(2071, 3, 1) and got[1]["month"] == dt.date(2071, 4, 1)
    decisions, _ = qt.gate_onward(plans.numbered(frame), spark.createDataFrame([], qt.STATES), plans.MIXES, F.to_date("ts"), F.date_trunc("minute", "ts"))
    assert {r["reason"] for r in decisions.collect()} == {qt.POSTED}


def test_unknown_and_missing_targets_change_nothing(spark):
    m = dt.date(2026, 9, 1)
    data = [(1, 0, at(9, 1), 1, m), (1, 1, at(9, 2), -1, m), (1, 2, at(9, 3), None, m), (1, 3, at(9, 4), 7, m), (1, 4, at(9, 5), 2, m)]
    out = gate(spark, data, qt.one_hot_mixes(3))
    assert [out[i]["reason"] for i in range(5)] == [qt.POSTED, qt.INVALID, qt.INVALID, qt.INVALID, qt.POSTED]
    assert [out[i]["held_no"] for i in range(5)] == [1, 1, 1, 1, 2] and out[1]["target_no"] is None


def test_meter_equals_the_replay(spark):
    data = random_requests(3)
    df = spark.createDataFrame(data, SCHEMA)
    mixes = qt.one_hot_mixes(4)
    rows = [r.asDict() for r in qt.gate(df, mixes, F.to_date("ts"), F.date_trunc("minute", "ts")).collect()]
    for r in qt.meter(df, mixes, F.to_date("ts"), F.date_trunc("minute", "ts")).collect():
        mine = [x for x in rows if x["account"] == r["account"] and x["month"] == r["month"]]
        assert r["month"] == max(x["month"] for x in rows if x["account"] == r["account"])
        assert r["accepted"] == sum(x["accepted"] for x in mine) and r["used"] == max(x["used"] for x in mine)
