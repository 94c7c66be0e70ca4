"""Purge arithmetic, planted signal against noise, probability invariants, relabelling."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import weights as fw
from tidemark.operators import learning as lr
from tidemark.operators import walkforward as wf


@pytest.mark.parametrize("start", [400, 800, 1200])
@pytest.mark.parametrize("h", [21, 63, 1])
@pytest.mark.parametrize("lag", [1, 2])
def test_purge_and_embargo(spark, start, h, lag):
    s_max = spark.range(1).select(lr.last_train_position(F.lit(start), h, lag).alias("s")).first()["s"]
    assert s_max + lag + h < start and start - s_max > h + lag


def planted_rows(spark, noise, n=900):
    rng = np.random.default_rng(7)
    x = rng.normal(size=n)
    y = rng.integers(0, 2, n) if noise else (x + rng.normal(scale=0.4, size=n) > 0).astype(int)
    other = rng.normal(size=n)
    other[::17] = np.nan
    d0 = dt.date(2018, 1, 1)
    data = [(0, d0 + dt.timedelta(days=i), i, True, int(y[i]), [float(x[i]), float(other[i])]) for i in range(n)]
    rows = wf.ranked(spark.createDataFrame(data, "block int, d date, pos int, usable boolean, label_no int, x array<double>"))
    specs = spark.createDataFrame([(0, 300, 100, False, ["logistic", "boosting"])], "block int, min_rows int, cal_len int, search_all boolean, families array<string>")
    folds = spark.createDataFrame([(0, dt.date(2020, 1, 1), 740, n, 700)], "block int, fold_start date, start_pos int, stop_pos int, s_max int")
    return rows, specs, wf.eligible(rows, folds, specs)


def skills(spark, noise):
    rows, specs, folds = planted_rows(spark, noise)
    losses = wf.search(rows, folds, specs, 2)
    assert sorted((r["family"], r["number"]) for r in losses.collect()) == [("boosting", 0), ("boosting", 1), ("logistic", 0), ("logistic", 1), ("logistic", 2)]
    fits = wf.fit(rows, wf.choices(folds, losses, specs), 2).cache()
    assert wf.snapshots(fits).count() == 1 and wf.trial_rows(losses).where("configuration = '(10.0,)'").count() == 1
    out = {}
    for family in ("logistic", "boosting"):
        scored = wf.probabilities(fits).where(F.col("family") == family).join(rows.select("d", "label_no"), "d").select("p", "label_no").collect()
        assert len(scored) == 160 and all(abs(sum(r["p"]) - 1) < 1e-9 for r in scored)
        p, yy = np.array([r["p"][1] for r in scored]), np.array([r["label_no"] for r in scored])
        out[family] = 1 - np.mean((p - yy) ** 2) / np.mean((yy.mean() - yy) ** 2)
    return out


def test_planted_signal_has_skill_and_noise_has_none(spark):
    assert min(skills(spark, noise=False).values()) > 0.3
    assert max(skills(spark, noise=True).values()) <= 0.05


def test_logistic_is_a_stationary_point():
    rng = np.random.default_rng(3)
    z, y = rng.normal(size=(200, 3)), rng.choice([0, 2, 3], 200)
    coef, intercept = wf.fit_logistic(z, y, 0.7)
    assert coef.shape == (4, 3) and np.isneginf(intercept[1]) and not coef[1].any()

    def loss(w):
        s = z @ w[:, :3].T + w[:, 3]
        return -0.7 * np.log(wf.softmax(s)[np.arange(200), np.searchsorted([0, 2, 3], y)]).sum() + 0.5 * (w[:, :3] ** 2).sum()

    at = np.column_stack([coef, intercept])[[0, 2, 3]]
    for i in range(3):
        for j in range(4):
            step = np.zeros_like(at)
            step[i, j] = 1e-5
            assert abs(loss(at + step) - loss(at - step)) / 2e-5 < 1e-3


def test_trees_split_where_the_classes_part():
    x = np.column_stack([np.arange(400) % 7, np.arange(400)]).astype(float)
    y = (x[:, 1] >= 250).astype(int)
    margins = wf.fit_boosting(x, y, 2, 20)(x, 3)
    assert ((margins[:, 1] > 0) == (y == 1)).mean() > 0.97 and np.isneginf(margins[:, 2]).all()


def test_later_rows_change_no_earlier_fold(spark):
    rows, specs, folds = planted_rows(spark, noise=False)
    poisoned = wf.ranked(rows.drop("ok", "rank").withColumn("label_no", F.when(F.col("pos") > 700, 1 - F.col("label_no")).otherwise(F.col("label_no"))))
    a, b = (wf.fit(r, wf.choices(folds, wf.search(r, folds, specs, 2), specs), 2).orderBy("family").collect() for r in (rows, poisoned))
    assert len(a) == 2 and a == b


def test_no_eligible_fold_gives_empty_tables(spark):
    rows, specs, folds = planted_rows(spark, noise=True)
    none = folds.where("1 = 0")
    losses = wf.search(rows, none, specs, 2)
    fits = wf.fit(rows, wf.choices(none, losses, specs), 2)
    assert losses.count() == wf.probabilities(fits).count() == wf.snapshots(fits).count() == 0
    one_class = wf.ranked(rows.drop("ok", "rank").withColumn("label_no", F.lit(1)))
    losses = wf.search(one_class, folds, specs, 2)
    assert losses.count() == wf.fit(one_class, wf.choices(folds, losses, specs), 2).count() == 0


def test_a_choice_lasts_until_the_next_search(spark):
    day = lambda y, m: dt.date(y, m, 1)
    folds = spark.createDataFrame([(0, day(2019, 11), 10), (0, day(2019, 12), 20), (0, day(2020, 1), 30), (0, day(2020, 2), 40), (1, day(2020, 2), 40)], "block int, fold_start date, start_pos int")
    losses = spark.createDataFrame([(0, day(2019, 12), "logistic", 2, 0.5), (0, day(2019, 12), "logistic", 0, 0.5), (0, day(2020, 1), "logistic", 1, 0.9), (0, day(2020, 1), "logistic", 2, 0.1)], wf.LOSSES)
    specs = spark.createDataFrame([(0, ["logistic"]), (1, ["logistic", "boosting"])], "block int, families array<string>")
    got = {(r["block"], r["fold_start"], r["family"]): r["configuration"] for r in wf.choices(folds, losses, specs).collect()}
    assert got == {(0, day(2019, 11), "logistic"): [1.0], (0, day(2019, 12), "logistic"): [0.1], (0, day(2020, 1), "logistic"): [10.0], (0, day(2020, 2), "logistic"): [10.0], (1, day(2020, 2), "logistic"): [1.0], (1, day(2020, 2), "boosting"): [3.0, 30.0]}


def test_labels_of_all_blocks_are_those_of_each(spark, sf_dir):
    from tidemark.operators import windows as op
    from tidemark.plans import experiments as ex
    from tidemark.sources import tables as src

    dense = src.dense_panel(spark, sf_dir)
    got = {(r["block"], r["pos"]): r["label_no"] for r in ex.block_labels(ex.positions(dense), ex.specs(spark)).collect()}
    for block, (cadence, h, lag) in enumerate(ex.BLOCKS):
        table = dense if cadence == "daily" else ex.positions(dense).where("cadence = 'monthly'")
        want = op.forward_labels(table, h, lag).groupBy("pos").agg(F.max(F.when(F.col("entity") == F.col("label"), F.col("ord"))).alias("n")).collect()
        assert want and all(got[block, r["pos"]] == r["n"] for r in want)


def test_drivers_are_those_of_the_fitted_model(spark):
    """The planted feature speaks for the winner; contributions and flips follow from the fold's own coefficients."""
    from tidemark.plans.learning import trained_drivers

    rows, specs, folds = planted_rows(spark, noise=False)
    fits = wf.fit(rows, wf.choices(folds, wf.search(rows, folds, specs, 2), specs), 2, calibrate=False).cache()
    model = wf.snapshots(fits).first()
    x = {r["pos"]: r["x"] for r in rows.collect()}
    got = trained_drivers(rows, ["signal", "other"], fits, 2).collect()
    assert len(got) == 320
    leading = 0
    for r in got:
        i = ["signal", "other"].index(r["feature"])
        raw = np.where(np.isnan(x[r["pos"]]), model["median"], x[r["pos"]])
        z = (raw - np.array(model["mean"])) / np.array(model["scale"])
        delta = np.array(model["coef"][r["winner"]]) - np.array(model["coef"][0])
        assert r["contribution"] == pytest.approx(delta[i] * z[i], abs=1e-9)
        if r["winner"]:
            gap = model["intercept"][1] - model["intercept"][0] + float(delta @ z)
            assert gap > 0 and r["flip"] == pytest.approx(-gap / delta[i] * model["scale"][i])
            leading += i == 0 and abs(delta[0] * z[0]) > abs(delta[1] * z[1])
    assert leading > 50


def test_ensemble_averages_what_each_session_has(spark):
    rows, specs, folds = planted_rows(spark, noise=False)
    fits = wf.fit(rows, wf.choices(folds, wf.search(rows, folds, specs, 2), specs), 2).cache()
    trained = {(r["family"], r["pos"]): r["p"] for r in wf.probabilities(fits).collect()}
    rule = rows.where("pos >= 730 AND pos < 800").select("d", "pos", F.array(F.lit(0.25), F.lit(0.75)).alias("p"))
    parts = [wf.probabilities(fits).where(F.col("family") == f) for f in ("logistic", "boosting")]
    got = {r["pos"]: r["p"] for r in lr.average_probabilities(*parts, rule).collect()}
    assert sorted(got) == list(range(730, 900)) and got[735] == [0.25, 0.75]
    for pos, extra in ((750, [[0.25, 0.75]]), (850, [])):
        assert got[pos] == pytest.approx(np.mean([trained["logistic", pos], trained["boosting", pos], *extra], axis=0).tolist())


def test_trial_log_shows_whole_runs_once(spark, tmp_path):
    from tidemark.sources.triallog import TrialLog, data_version

    log = TrialLog(spark, str(tmp_path / "log"))
    rows = spark.createDataFrame([(0, "logistic", dt.date(2020, 1, 1), "(1.0,)", 0.5), (0, "rule", None, "sma", None)], wf_trials())
    assert log.read("a") is None and log.history().count() == 0
    log.append("a", rows)
    log.append("a", rows)
    log.append("b", rows.limit(1))
    rows.write.parquet(str(tmp_path / "log" / "rows-half"))  # written, never committed
    assert log.read("a").count() == 2 and log.read("b").count() == 1 and log.read("c") is None
    assert log.history().groupBy("run").count().orderBy("run").collect() == [("a", 2), ("b", 1)]
    (tmp_path / "t.parquet").write_bytes(b"1")
    before = data_version(spark, [str(tmp_path / "t.parquet")])
    assert before == data_version(spark, [str(tmp_path / "t.parquet")])
    (tmp_path / "t.parquet").write_bytes(b"12")
    assert before != data_version(spark, [str(tmp_path / "t.parquet")])


def wf_trials():
    from tidemark.sources.triallog import TRIALS

    return TRIALS


def test_another_configuration_is_another_run(spark, sf_dir):
    from tidemark.plans import experiments as ex

    one = ex.logged_trials(spark, sf_dir)
    more = ex.logged_trials(spark, sf_dir, {**wf.GRIDS, "logistic": [*wf.GRIDS["logistic"], (100.0,)]})
    searches = one.where("family = 'logistic'").count() // 3
    assert more.count() == one.count() + searches


def test_explanations_use_the_models_of_their_fold_only(spark, sf_dir):
    """What later sessions bring changes no earlier snapshot."""
    from tidemark.plans import learning as plans
    from tidemark.session import materialize
    from tidemark.sources import tables as src

    dense = materialize(src.dense_panel(spark, sf_dir))
    last = dense.agg(F.max("pos")).first()[0]
    poisoned = dense.withColumn("px", F.when(F.col("pos") > last - 300, F.col("px") * (1 + F.col("ord"))).otherwise(F.col("px")))

    def snapshots(panel):
        folds = lr.fold_dimension(panel.select("d", "pos").distinct(), plans.H, plans.LAG, "year", 252, 0)
        early = folds.where(F.col("start_pos") <= last - 300)
        return {r["fold_start"]: str(r) for r in lr.moment_snapshots(plans.labelled(spark, sf_dir, panel), plans.momentum_wide(panel), early, plans.XS).collect()}

    a, b = snapshots(dense), snapshots(poisoned)
    assert a and a == b


def test_relabel_orders_by_volatility(spark, rows):
    data = [(s, {0: 0.4, 1: 0.1, 2: 0.2}[s]) for s in range(3) for _ in range(100)]
    out = rows(lr.relabel_by_volatility(spark.createDataFrame(data, "raw int, vol double"), "raw", "vol"), "ordered")
    assert [r["raw"] for r in out] == [1, 2, 0]


def test_policy_needs_probability_and_excess(spark):
    data = [([0.2, 0.5, 0.3], [0.0, 0.01, 0.001], 1), ([0.4, 0.3, 0.3], [0.0, 0.01, 0.01], 0), ([0.2, 0.5, 0.3], [0.0, -0.01, 0.0], 0), (None, [0.0, 0.1, 0.1], None)]
    df = spark.createDataFrame(data, "p array<double>, mu array<double>, want int")
    for r in df.select("want", fw.policy_position(F.col("p"), F.col("mu")).alias("got")).collect():
        assert r["want"] == r["got"]
