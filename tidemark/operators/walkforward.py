"""Walk-forward fits of all experiment blocks in one plan.

A block is a cadence, a horizon and a lag; every table here carries its number as a key. Fold bounds, training counts
and searches are DataFrame work over (block, position). A fit is one group: its training rows are a prefix of the block's
calendar, so a group is bounded by the calendar whatever the size of the facts, and all fits of all blocks, families and
configurations run side by side in one shuffle for the search and one for the models.

Inside a group numpy solves two small problems: the multinomial logistic regression by Newton's method, and boosted trees,
one class against the rest, on binned features. Missing values take the development rows' median; features are
scaled by their mean and deviation; probabilities are calibrated by one sigmoid a class on the held-out slice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.learning import last_train_position

# Configurations tried by each family, and the ones in use before the first search.
GRIDS = {"logistic": [(0.1,), (1.0,), (10.0,)], "boosting": [(2.0, 20.0), (3.0, 30.0)]}
DEFAULTS = {"logistic": (1.0,), "boosting": (3.0, 30.0)}
RATE, LEAST_LEAF, LEAF_PENALTY, BINS = 0.08, 30, 0.1, 32
ENOUGH_CALIBRATION = 30
LOSSES = "block int, fold_start date, family string, number int, loss double"
FITS = ("block int, fold_start date, family string, n_train bigint, configuration array<double>, coef array<array<double>>, intercept array<double>, "
        "median array<double>, mean array<double>, scale array<double>, scored array<struct<d:date,pos:int,p:array<double>>>")


# numpy side: one fit

def scaler(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Median, and mean and deviation after filling with it; an unknown or constant feature has scale 1."""
    known = ~np.isnan(x)
    median = np.array([np.median(x[k, i]) if k.any() else 0.0 for i, k in enumerate(known.T)])
    full = np.where(known, x, median)
    scale = full.std(axis=0)
    return median, full.mean(axis=0), np.where(np.abs(scale) > 1e-12, scale, 1.0)


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_logistic(z: np.ndarray, y: np.ndarray, c: float, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of the classes 0..max: c times the summed log-loss plus half the squared weights."""
    x = np.hstack([z, np.ones((len(z), 1))])
    classes = np.unique(y)
    m, f = len(classes), x.shape[1]
    hot = (y[:, None] == classes).astype(float)
    penalty = np.tile(np.append(np.full(f - 1, 1.0 / c), 1e-8), m)
    w = np.zeros(m * f)

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        p = softmax(x @ w.reshape(m, f).T)
        return -np.log(np.maximum((p * hot).sum(axis=1), 1e-300)).sum() + 0.5 * (penalty * w * w).sum(), p

    now, p = value(w)
    for _ in range(steps):
        g = ((p - hot).T @ x).ravel() + penalty * w
        if np.abs(g).max() < 1e-8 * len(x):
            break
        h = np.diag(penalty)
        for a in range(m):
            for b in range(a, m):
                block = x.T @ (x * (p[:, a] * ((a == b) - p[:, b]))[:, None])
                h[a * f:(a + 1) * f, b * f:(b + 1) * f] += block
                if a != b:
                    h[b * f:(b + 1) * f, a * f:(a + 1) * f] += block.T
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-6:
            new, q = value(w - size * step)
            if new <= now:
                break
            size /= 2
        if now - new <= 1e-12 * abs(now):
            break
        w, now, p = w - size * step, new, q
    found = w.reshape(m, f)
    k = int(classes.max()) + 1
    coef, intercept = np.zeros((k, f - 1)), np.full(k, -np.inf)
    coef[classes], intercept[classes] = found[:, :-1], found[:, -1]
    return coef, intercept


def fit_sigmoid(m: np.ndarray, t: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and intercept of t on the margin m; a hair of penalty keeps separated slices finite."""
    x, w = np.column_stack([m, np.ones(len(m))]), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        g = x.T @ (p - t) + 1e-4 * w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-4 * np.eye(2), g)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0]), float(w[1])


def grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> tuple[list, np.ndarray, np.ndarray]:
    """A tree of `depth` levels on binned features: (feature, cut) of each level's nodes, leaf values, and each row's leaf."""
    n, f = bins.shape
    node, levels = np.zeros(n, np.int64), []
    for level in range(depth):
        m = 1 << level
        key = ((node[:, None] * f + np.arange(f)) * BINS + bins).ravel()
        left = [np.bincount(key, np.repeat(v, f), m * f * BINS).reshape(m, f, BINS).cumsum(axis=2) for v in (g, h, np.ones(n))]
        gain = -np.inf * np.ones((m, f, BINS))
        whole = [v[:, :, -1:] for v in left]
        enough = (left[2] >= LEAST_LEAF) & (whole[2] - left[2] >= LEAST_LEAF)
        score = lambda a, b: a * a / (b + LEAF_PENALTY)
        gain[enough] = (score(left[0], left[1]) + score(whole[0] - left[0], whole[1] - left[1]) - score(whole[0], whole[1]))[enough]
        best = gain.reshape(m, -1).argmax(axis=1)
        feature, cut = best // BINS, np.where(gain.reshape(m, -1).max(axis=1) > 1e-12, best % BINS, BINS)
        levels.append((feature, cut))
        node = 2 * node + (bins[np.arange(n), feature[node]] > cut[node])
    sums = [np.bincount(node, v, 1 << depth) for v in (g, h)]
    return levels, -RATE * sums[0] / (sums[1] + LEAF_PENALTY), node


def fit_boosting(x: np.ndarray, y: np.ndarray, depth: int, rounds: int):
    """Margins of each class against the rest, as a function of filled features."""
    edges = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T]
    binned = lambda v: np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, v.T)])
    bins, classes, models = binned(x), np.unique(y), {}
    for cls in classes.tolist():
        t = (y == cls).astype(float)
        share = np.clip(t.mean(), 1e-6, 1 - 1e-6)
        base = float(np.log(share / (1 - share)))
        score, trees = np.full(len(y), base), []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            levels, leaves, node = grow(bins, p - t, p * (1 - p), depth)
            trees.append((levels, leaves))
            score = score + leaves[node]
        models[cls] = base, trees

    def margins(v: np.ndarray, k: int) -> np.ndarray:
        b, out = binned(v), np.full((len(v), k), -np.inf)
        for cls, (base, trees) in models.items():
            out[:, cls] = base
            for levels, leaves in trees:
                node = np.zeros(len(v), np.int64)
                for feature, cut in levels:
                    node = 2 * node + (b[np.arange(len(v)), feature[node]] > cut[node])
                out[:, cls] += leaves[node]
        return out

    return margins


def share_of(margins: np.ndarray, family: str) -> np.ndarray:
    """Uncalibrated probabilities of margins."""
    if family == "logistic":
        return softmax(margins)
    p = 1 / (1 + np.exp(-margins))
    return p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)


def fitted(family: str, configuration: tuple, x: np.ndarray, y: np.ndarray, k: int):
    """(margins of raw rows, coefficients or None, intercepts or None, scaler) of one fit."""
    median, mean, scale = scaler(x)
    fill = lambda v: np.where(np.isnan(v), median, v)
    if family == "boosting":
        inner = fit_boosting(fill(x), y, int(configuration[0]), int(configuration[1]))
        return lambda v: inner(fill(v), k), None, None, (median, mean, scale)
    coef, intercept = fit_logistic((fill(x) - mean) / scale, y, configuration[0])
    coef, intercept = np.vstack([coef, np.zeros((k - len(coef), x.shape[1]))]), np.append(intercept, np.full(k - len(intercept), -np.inf))
    return lambda v: ((fill(v) - mean) / scale) @ coef.T + intercept, coef, intercept, (median, mean, scale)


def calibrated(margins: np.ndarray, held: np.ndarray, labels: np.ndarray, family: str) -> np.ndarray:
    """Probabilities by one sigmoid a class that the held-out slice knows; the plain shares where it is too small."""
    seen = np.unique(labels)
    if len(labels) < ENOUGH_CALIBRATION or len(seen) < 2:
        return share_of(margins, family)
    out = np.zeros_like(margins)
    for cls in seen.tolist():
        if np.isfinite(held[0, cls]):
            a, b = fit_sigmoid(held[:, cls], (labels == cls).astype(float))
            out[:, cls] = 1 / (1 + np.exp(-np.clip(a * margins[:, cls] + b, -35, 35)))
    total = out.sum(axis=1, keepdims=True)
    return np.where(total > 0, out / np.where(total > 0, total, 1), share_of(margins, family))


def loss_of(p: np.ndarray, y: np.ndarray) -> float:
    return float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-15)).mean())


def later_slice(n_dev: int) -> int:
    """Rank where the later eighth (at least 80 rows) of the development rows starts."""
    return n_dev - max(80, n_dev // 8)


# Spark side: folds, searches, groups

def block_folds(calendar: DataFrame, min_span_days: int) -> DataFrame:
    """(block, fold_start, start_pos, stop_pos, s_max): every month or year of a block that has enough history.

    `calendar(block, h, lag, unit, min_rows, d, pos)` has a row for each block and position.
    """
    by = W.partitionBy("block")
    days = calendar.withColumn("first", F.min("d").over(by)).withColumn("size", F.count(F.lit(1)).over(by))
    keys = ["block", "h", "lag", "unit", "min_rows", "first", "size"]
    unit = F.when(F.col("unit") == "month", F.date_trunc("month", "d")).otherwise(F.date_trunc("year", "d"))
    starts = days.groupBy(*keys, unit.alias("seg")).agg(F.min("d").alias("fold_start"), F.min("pos").alias("start_pos"))
    starts = starts.withColumn("s_max", last_train_position(F.col("start_pos"), F.col("h"), F.col("lag")))
    reach = calendar.select("block", F.col("pos").alias("s_max"), F.col("d").alias("reached"))
    kept = starts.join(reach, ["block", "s_max"]).where((F.col("s_max") >= F.col("min_rows")) & (F.datediff("reached", "first") >= min_span_days))
    stop = F.coalesce(F.lead("start_pos").over(by.orderBy("start_pos")), F.col("size"))
    return kept.select("block", "fold_start", "start_pos", stop.cast("int").alias("stop_pos"), "s_max")


def ranked(rows: DataFrame) -> DataFrame:
    """Adds `ok` (usable and labelled) and `rank`, its running count in the block."""
    ok = F.coalesce(F.col("usable"), F.lit(False)) & F.col("label_no").isNotNull()
    return rows.withColumn("ok", ok).withColumn("rank", F.sum(ok.cast("int")).over(W.partitionBy("block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))


def eligible(rows: DataFrame, folds: DataFrame, specs: DataFrame, margin: int = 40) -> DataFrame:
    """Folds with enough usable rows, and which of them search: a block's first, every January, or all of a block.

    `specs(block, min_rows, cal_len, search_all)`; rows are `ranked`.
    """
    counts = rows.select("block", F.col("pos").alias("s_max"), F.col("rank").alias("n_train"))
    known = folds.join(counts, ["block", "s_max"]).join(specs.select("block", "min_rows", "cal_len", "search_all"), "block")
    known = known.where((F.col("n_train") >= F.col("min_rows")) & (F.col("n_train") > F.col("cal_len") + margin)).withColumn("n_dev", F.col("n_train") - F.col("cal_len"))
    first = F.col("start_pos") == F.min("start_pos").over(W.partitionBy("block"))
    return known.withColumn("searches", (first | F.col("search_all") | (F.month("fold_start") == 1)) & (F.col("n_dev") > 200))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of a group's rows; a missing label is -1."""
    column = table.column("x").combine_chunks()
    x = np.asarray(column.flatten(), float).reshape(len(column), -1)
    return x, np.asarray(table.column("label_no").combine_chunks().fill_null(-1), np.int64)


def _configurations(families: dict) -> Column:
    return F.array(*[F.struct(F.lit(f).alias("family"), F.lit(i).alias("number"), F.array(*[F.lit(v) for v in c]).alias("configuration")) for f, grid in families.items() for i, c in enumerate(grid)])


def search(rows: DataFrame, folds: DataFrame, specs: DataFrame, k: int, grids: dict = GRIDS) -> DataFrame:
    """(block, fold_start, family, number, loss): each searching fold scores the whole grid of its block's families on
    the later slice of its development rows. A fold whose development rows know fewer than two classes tries nothing."""
    asked = folds.where("searches").join(specs.select("block", "families"), "block").withColumn("c", F.explode(_configurations(grids))).where(F.array_contains("families", F.col("c.family")))
    tried = asked.select("block", "fold_start", "n_dev", "c.family", "c.number", "c.configuration")
    sets = rows.where("ok").select("block", "rank", "x", "label_no").join(F.broadcast(tried), "block").where(F.col("rank") <= F.col("n_dev"))

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        x, y = _matrix(table)
        first = {name: table.column(name)[0].as_py() for name in ("block", "fold_start", "family", "number", "configuration")}
        out = []
        if len(np.unique(y)) >= 2:
            cut = later_slice(len(y))
            margins = fitted(first["family"], tuple(first["configuration"]), x[:cut], y[:cut], k)[0] if len(np.unique(y[:cut])) >= 2 else None
            out = [float("inf") if margins is None else loss_of(share_of(margins(x[cut:]), first["family"]), y[cut:])]
        kinds = [pa.int32(), pa.date32(), pa.string(), pa.int32()]
        return pa.table([*(pa.array([first[n]] * len(out), kind) for n, kind in zip(("block", "fold_start", "family", "number"), kinds)), pa.array(out, pa.float64())], names=["block", "fold_start", "family", "number", "loss"])

    return sets.groupBy("block", "fold_start", "family", "number").applyInArrow(one, LOSSES)


def trial_rows(losses: DataFrame, grids: dict = GRIDS) -> DataFrame:
    """The searches as rows of the trial log."""
    named = F.create_map(*[F.lit(v) for f, grid in grids.items() for i, c in enumerate(grid) for v in (f"{f} {i}", str(c))])
    return losses.select("block", "family", "fold_start", named[F.concat_ws(" ", "family", F.col("number").cast("string"))].alias("configuration"), "loss")


def choices(folds: DataFrame, losses: DataFrame, specs: DataFrame, grids: dict = GRIDS, defaults: dict = DEFAULTS) -> DataFrame:
    """The configuration of each fold and family: the best of the last search at or before it, else the default."""
    best = losses.groupBy("block", "fold_start", "family").agg(F.min_by("number", F.struct("loss", "number")).alias("number"))
    named = folds.join(specs.select("block", "families"), "block").withColumn("family", F.explode("families")).join(best, ["block", "fold_start", "family"], "left")
    last = F.last("number", ignorenulls=True).over(W.partitionBy("block", "family").orderBy("start_pos").rowsBetween(W.unboundedPreceding, 0))
    table = F.create_map(*[v for f, grid in grids.items() for v in (F.lit(f), F.array(*[F.array(*[F.lit(x) for x in c]) for c in grid]))])
    start = F.create_map(*[v for f, c in defaults.items() for v in (F.lit(f), F.array(*[F.lit(x) for x in c]))])
    return named.withColumn("configuration", F.coalesce(F.get(table[F.col("family")], last), start[F.col("family")])).drop("number", "families")


def fit(rows: DataFrame, chosen: DataFrame, k: int, calibrate: bool = True) -> DataFrame:
    """One row for each fold and family: the model and the probabilities of the fold's segment.

    Training rows are the usable ones up to the purge; the last `cal_len` of them calibrate. A fold whose
    development rows know fewer than two classes gives no row.
    """
    bounds = chosen.select("block", "fold_start", "family", "start_pos", "stop_pos", "n_train", "n_dev", "configuration")
    inside = (F.col("ok") & (F.col("rank") <= F.col("n_train"))) | ((F.col("pos") >= F.col("start_pos")) & (F.col("pos") < F.col("stop_pos")))
    sets = rows.select("block", "d", "pos", "ok", "rank", "x", "label_no").join(F.broadcast(bounds), "block").where(inside)
    scored_kind = pa.list_(pa.struct([("d", pa.date32()), ("pos", pa.int32()), ("p", pa.list_(pa.float64()))]))

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        x, y = _matrix(table)
        first = {name: table.column(name)[0].as_py() for name in ("block", "fold_start", "family", "start_pos", "n_train", "n_dev", "configuration")}
        pos, rank, ok = (np.asarray(table.column(c).combine_chunks()) for c in ("pos", "rank", "ok"))
        train = ok & (rank <= first["n_train"]) & (pos < first["start_pos"])
        dev, cal, segment = train & (rank <= first["n_dev"]), train & (rank > first["n_dev"]), pos >= first["start_pos"]
        names = [c.split()[0] for c in FITS.split(", ")]
        if len(np.unique(y[dev])) < 2:
            made: list = [[] for _ in names]
        else:
            margins, coef, intercept, (median, mean, scale) = fitted(first["family"], tuple(first["configuration"]), x[dev], y[dev], k)
            seg = margins(x[segment])
            p = calibrated(seg, margins(x[cal]), y[cal], first["family"]) if calibrate else share_of(seg, first["family"])
            scored = [{"d": d, "pos": int(q), "p": r.tolist()} for d, q, r in zip(table.column("d").filter(pa.array(segment)).to_pylist(), pos[segment], p)]
            finite = None if intercept is None else [float(v) if np.isfinite(v) else None for v in intercept]
            made = [[v] for v in (first["block"], first["fold_start"], first["family"], first["n_train"], first["configuration"], None if coef is None else coef.tolist(), finite, median.tolist(), mean.tolist(), scale.tolist(), scored)]
        vector = pa.list_(pa.float64())
        kinds = [pa.int32(), pa.date32(), pa.string(), pa.int64(), vector, pa.list_(vector), vector, vector, vector, vector, scored_kind]
        return pa.table([pa.array(v, kind) for v, kind in zip(made, kinds)], names=names)

    return sets.groupBy("block", "fold_start", "family").applyInArrow(one, FITS)


def probabilities(fits: DataFrame) -> DataFrame:
    """(block, family, d, pos, fold_start, n_train, p) of all scored rows."""
    return fits.select("block", "family", "fold_start", "n_train", F.explode("scored").alias("s")).select("block", "family", "s.d", "s.pos", "fold_start", "n_train", "s.p")


def snapshots(fits: DataFrame) -> DataFrame:
    """(block, fold_start, c, coef, intercept, mean, scale, median) of the linear models."""
    return fits.where("family = 'logistic'").select("block", "fold_start", F.get("configuration", F.lit(0)).alias("c"), "coef", F.transform("intercept", lambda v: F.coalesce(v, F.lit(-1e9))).alias("intercept"), "mean", "scale", "median")
