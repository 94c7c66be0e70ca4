"""Point-in-time contract: cutting or poisoning the future never changes an earlier row."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import frames
from tidemark.plans.features import daily_features
from tidemark.sources import tables as src

CUT = "2000-03-15"


@pytest.fixture(scope="module")
def panel(spark):
    return src.panel_table(spark, "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def full(spark, panel):
    return {r["d"]: r.asDict() for r in daily_features(spark, "/root/testdata/sf0.01", panel).filter(F.col("d") <= CUT).collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for d in sorted(a)[-400:]:
        for k, v in a[d].items():
            w = b[d][k]
            if isinstance(v, float) and isinstance(w, float):
                assert math.isclose(v, w, rel_tol=1e-8, abs_tol=1e-10), (d, k, v, w)
            else:
                assert v == w, (d, k, v, w)


def test_truncation_invariance(spark, panel, full):
    cut = daily_features(spark, "/root/testdata/sf0.01", panel.filter(F.col("d") <= CUT))
    same(full, {r["d"]: r.asDict() for r in cut.collect()})


def test_poisoned_future(spark, panel, full):
    poisoned = panel.withColumn("px", F.when(F.col("d") > CUT, F.col("px") * 3 + F.col("ord")).otherwise(F.col("px")))
    out = daily_features(spark, "/root/testdata/sf0.01", poisoned).filter(F.col("d") <= CUT)
    same(full, {r["d"]: r.asDict() for r in out.collect()})


def test_guard_and_registry(spark):
    with pytest.raises(ValueError):
        frames.guard(spark.createDataFrame([(1,)], "nber_flag int"))
    assert len(frames.REGISTRY) == 84 and sum(s.model for s in frames.REGISTRY) == 37
    assert len({s.name for s in frames.REGISTRY}) == 84
