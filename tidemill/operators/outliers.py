"""Outlier estimators: flags per row from centres, densities, clusters, deviations and spectra.

Statistics that fit in a few numbers are aggregated and folded back as constants; per-series methods that need a whole
series (spectra, Gaussian processes, kernel densities) run one series a task and say so.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.common import bounded_rows, checkpointed, require, written
from tidemill.operators.timeseries import absolute_deviation

#: Clusters at most: their centres and scores are constants of the plan.
MAX_CLUSTERS = 1000
#: Ranges of sorted values at most, as many as shuffle partitions: a row of sums of each reaches the driver.
MAX_RANGES = 100_000


def _median(c) -> Column:
    return F.percentile(c, F.lit(0.5))


def share_above_mean(df: DataFrame, raw: Column, threshold: float | None = None, to: str = "outlier") -> DataFrame:
    """``probability``: a raw distance as its share of all; ``to``: whether it exceeds the threshold, the mean share by default. A total of zero leaves raw distances."""
    d = df.withColumn("__raw", raw)
    s = d.agg(F.sum("__raw").alias("s"), F.count("__raw").alias("n")).first()
    total = s["s"] or 1.0
    bar = threshold if threshold is not None else ((s["s"] or 0.0) / total / s["n"] if s["n"] else 0.0)
    return d.withColumn("probability", F.col("__raw") / total).withColumn(to, F.col("probability") > bar).drop("__raw")


def centroid_outliers(df: DataFrame, cols: Sequence[str], threshold: float | None = None) -> DataFrame:
    """Distance to the centre of all rows."""
    require(df, *cols)
    centre = df.agg(*(F.avg(c).alias(c) for c in cols)).first()
    square = sum((F.pow(F.col(c) - F.lit(centre[c]), F.lit(2.0)) for c in cols), F.lit(0.0))
    return share_above_mean(df, F.sqrt(square), threshold)


def iterative_centroid_outliers(df: DataFrame, cols: Sequence[str], iterations: int = 5) -> DataFrame:
    """Centre outliers peeled off again and again; ``tag`` is the iteration that took a row, -1 for the rest. The first iteration's threshold holds for all."""
    require(df, *cols)
    rest, done, bar = df, None, None
    for k in range(iterations):
        centre = rest.agg(*(F.avg(c).alias(c) for c in cols), F.count(F.lit(1)).alias("__n")).first()
        if not centre["__n"]:
            break
        square = sum((F.pow(F.col(c) - F.lit(centre[c]), F.lit(2.0)) for c in cols), F.lit(0.0))
        raw = rest.withColumn("__d", F.sqrt(square))
        total = raw.agg(F.sum("__d")).first()[0] or 1.0
        bar = 1.0 / centre["__n"] if bar is None else bar
        marked = checkpointed(raw.withColumn("__o", F.col("__d") / total > bar))
        out = marked.where("__o").drop("__o", "__d").withColumn("tag", F.lit(k))
        done = out if done is None else done.unionByName(out)
        rest = marked.where("not __o").drop("__o", "__d")
    rest = rest.withColumn("tag", F.lit(-1))
    return rest if done is None else done.unionByName(rest)


def mahalanobis_outliers(df: DataFrame, cols: Sequence[str], threshold: float | None = None, robust: bool = False) -> DataFrame:
    """Squared Mahalanobis distance from mean and covariance, which are d + d² sums of one pass. ``robust`` (one column only) takes the half of the rows with least variance instead."""
    require(df, *cols)
    if robust:
        if len(cols) != 1:
            raise ValueError("the exact robust form takes one column")
        mean, var = _least_variance_half(df, cols[0])
        raw = F.pow(F.col(cols[0]) - mean, F.lit(2.0)) / (var or 1.0)
        return share_above_mean(df, raw, threshold)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    s = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)), *(F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    cov = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = s[f"c{i}_{j}"] or 0.0
    inverse = np.linalg.pinv(cov)
    diff = [F.col(c) - F.lit(s[f"m{i}"]) for i, c in enumerate(cols)]
    raw = sum((diff[i] * diff[j] * float(inverse[i, j]) for i in range(len(cols)) for j in range(len(cols))), F.lit(0.0))
    return share_above_mean(df, raw, threshold)


def _least_variance_half(df: DataFrame, col: str) -> tuple[float, float]:
    """Mean and variance of the window of sorted values, just over half of them, whose variance is least: running sums over positions, joined half a table apart."""
    from tidemill.operators.relational import positions

    v = positions(df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("x")), ["x"])
    n = v.count()
    h = (n + 2) // 2
    if n < 2:
        one = v.agg(F.avg("x")).first()[0]
        return one or 0.0, 0.0
    # running sums by blocks of positions: a block's offset is the sum of the blocks before it
    size = 100_000
    shift = v.agg(_median("x")).first()[0]
    b = v.select("position", (F.col("x") - shift).alias("x"), F.floor(F.col("position") / size).cast("long").alias("block"))
    sums = b.groupBy("block").agg(F.sum("x").alias("a"), F.sum(F.col("x") * F.col("x")).alias("b"))
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("block", F.coalesce(F.sum("a").over(ahead), F.lit(0.0)).alias("a0"), F.coalesce(F.sum("b").over(ahead), F.lit(0.0)).alias("b0"))
    within = Window.partitionBy("block").orderBy("position")
    run = checkpointed(b.join(F.broadcast(before), "block").select("position", (F.col("a0") + F.sum("x").over(within)).alias("a"), (F.col("b0") + F.sum(F.col("x") * F.col("x")).over(within)).alias("b")))
    upper = run.select((F.col("position") - h).alias("position"), F.col("a").alias("ua"), F.col("b").alias("ub"))
    lower = run.unionByName(df.sparkSession.createDataFrame([(-1, 0.0, 0.0)], "position long, a double, b double"))
    mean = (F.col("ua") - F.col("a")) / h
    best = upper.join(lower, "position").select(mean.alias("m"), ((F.col("ub") - F.col("b")) / h - mean * mean).alias("v")).agg(F.min(F.struct("v", "m")).alias("best")).first()["best"]
    return best["m"] + shift, best["v"]


def gaussian_density_outliers(df: DataFrame, cols: Sequence[str], order_by: Sequence[str], threshold: float | None = None) -> DataFrame:
    """One less the density of a Gaussian over all rows times a cell's size, the cell's edge being the columns' summed median step between successive rows."""
    require(df, *cols, *order_by)
    from tidemill.operators.relational import positions

    ordered = positions(df.select(*dict.fromkeys([*order_by, *cols])), order_by)
    following = ordered.select((F.col("position") + 1).alias("position"), *(F.col(c).alias(f"__{c}") for c in cols))
    steps = ordered.join(following, "position").agg(*(_median(F.abs(F.col(c) - F.col(f"__{c}"))).alias(c) for c in cols)).first()
    d, dx = len(cols), sum(steps[c] or 0.0 for c in cols)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    s = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)), *(F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    cov = np.zeros((d, d))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = s[f"c{i}_{j}"] or 0.0
    cov += np.eye(d) * 1e-12
    inverse, norm = np.linalg.inv(cov), float(1 / np.sqrt((2 * np.pi) ** d * np.linalg.det(cov)))
    diff = [F.col(c) - F.lit(s[f"m{i}"]) for i, c in enumerate(cols)]
    form = sum((diff[i] * diff[j] * float(inverse[i, j]) for i in range(d) for j in range(d)), F.lit(0.0))
    probability = 1 - F.lit(norm * dx**d) * F.exp(-form / 2)
    out = df.withColumn("probability", probability)
    bar = threshold if threshold is not None else out.agg(F.avg("probability")).first()[0]
    return out.withColumn("outlier", F.col("probability") > F.lit(bar))


def mad_outliers(df: DataFrame, col: str, cutoff: float = 2.0, coefficient: float = 0.6745, by: Sequence[str] = ()) -> DataFrame:
    """Coefficient times distance from the median through the median absolute deviation, beyond ``cutoff``; null where that deviation is zero. Both medians are aggregates of a group, joined back."""
    require(df, col, *by)
    x = F.col(col).cast("double")
    first = df.groupBy(*by).agg(_median(x).alias("__med"))
    held = df.join(F.broadcast(first), list(by)) if by and first.limit(100_001).count() <= 100_000 else df.join(first, list(by)) if by else df.withColumn("__med", F.lit(first.first()["__med"]))
    second = held.groupBy(*by).agg(_median(F.abs(x - F.col("__med"))).alias("__mad"))
    held = held.join(second, list(by)) if by else held.withColumn("__mad", F.lit(second.first()["__mad"]))
    score = F.try_divide(coefficient * F.abs(x - F.col("__med")), F.col("__mad"))
    return held.withColumn("outlier", score > cutoff).drop("__med", "__mad")


def rolling_mad_outliers(df: DataFrame, cols: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = (), window: int | None = None, cutoff: float = 2.0, scale: float = 1.4826, threshold: float | None = None) -> DataFrame:
    """Distance from the trailing median in trailing deviations beyond ``cutoff``, averaged over columns and held against the mean of all. Without ``window`` it expands from the first row."""
    require(df, *cols, *order_by, *partition_by)
    base = Window.partitionBy(*partition_by).orderBy(*order_by)
    frame = base.rowsBetween(Window.unboundedPreceding if window is None else -(window - 1), 0)
    d = df.select("*", *(F.collect_list(F.col(c).cast("double")).over(frame).alias(f"__l_{c}") for c in cols), *(_median(c).over(frame).alias(f"__m_{c}") for c in cols))
    far = [F.coalesce((F.try_divide(F.abs(F.col(c) - F.col(f"__m_{c}")), absolute_deviation(F.col(f"__l_{c}"), "median") * scale) > cutoff).cast("double"), F.when(F.col(c) != F.col(f"__m_{c}"), 1.0).otherwise(0.0)) for c in cols]
    d = d.withColumn("probability", sum(far, F.lit(0.0)) / len(cols)).drop(*(f"__{k}_{c}" for k in "lm" for c in cols))
    bar = threshold if threshold is not None else d.agg(F.avg("probability")).first()[0]
    return d.withColumn("outlier", F.col("probability") > F.lit(bar))


def fft_residual_flags(x: np.ndarray, cut: int | None = None, share: float = 0.1) -> np.ndarray:
    """Flags of the ``int(n * share)`` values farthest from a series without its frequencies from ``cut`` on, the first of equals."""
    n = len(x)
    spectrum = np.fft.fft(x)
    keep = n // 2 if cut is None else cut
    spectrum[keep:] = 0
    away = np.abs(np.fft.ifft(spectrum) - x)
    flags = np.zeros(n, bool)
    flags[np.argsort(-away, kind="stable")[: int(n * share)]] = True
    return flags


def fft_outliers(df: DataFrame, cols: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str], cut: int | None = None, share: float = 0.1, threshold: float | None = None) -> DataFrame:
    """Spectral flags averaged over columns, held against the mean of the series or ``threshold``. A spectrum needs a whole series: one task each."""
    require(df, *cols, *order_by, *partition_by)
    schema = df.schema.simpleString()[7:-1] + ",probability:double,outlier:boolean"

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(order_by))
        p = np.mean([fft_residual_flags(group[c].to_numpy(dtype=float), cut, share) for c in cols], axis=0)
        return group.assign(probability=p, outlier=p > (p.mean() if threshold is None else threshold))

    return df.groupBy(*partition_by).applyInPandas(one, ", ".join(s.replace(":", " ", 1) for s in _top_level(schema)))


def _top_level(schema: str) -> list[str]:
    """Fields of a struct in simple notation, parted at commas outside brackets."""
    out, depth, last = [], 0, 0
    for i, ch in enumerate(schema):
        depth += ch in "<("
        depth -= ch in ">)"
        if ch == "," and not depth:
            out.append(schema[last:i])
            last = i + 1
    return [*out, schema[last:]]


def gaussian_process_outliers(df: DataFrame, col: str, order_by: Sequence[str], partition_by: Sequence[str], z: float = 3.8906, noise: float = 0.9, length: float = 10.0, most: int = 4000) -> DataFrame:
    """Values outside mean ± z deviations of a Gaussian-process regression on position (squared-exponential kernel). Work is cubic in a series; longer ones than ``most`` raise instead of being cut."""
    require(df, col, *order_by, *partition_by)
    schema = df.schema.simpleString()[7:-1] + ",outlier:boolean"

    def one(group: pd.DataFrame) -> pd.DataFrame:
        if len(group) > most:
            raise ValueError(f"a series of {len(group)} rows is longer than {most}")
        group = group.sort_values(list(order_by))
        y = group[col].to_numpy(dtype=float)
        mean, spread = y.mean(), y.std() or 1.0
        t = np.arange(len(y), dtype=float)
        k = np.exp(-((t[:, None] - t[None]) ** 2) / (2 * length**2))
        low = np.linalg.cholesky(k + noise * np.eye(len(y)))
        solved = np.linalg.solve(low, k)
        fit = solved.T @ np.linalg.solve(low, (y - mean) / spread)
        deviation = np.sqrt(np.maximum(1 + noise - (solved**2).sum(axis=0), 1e-12))
        return group.assign(outlier=np.abs((y - mean) / spread - fit) > z * deviation)

    return df.groupBy(*partition_by).applyInPandas(one, ", ".join(s.replace(":", " ", 1) for s in _top_level(schema)))


# -- clusters -------------------------------------------------------------------------------------------------------------


def _ranged(df: DataFrame, *order_by: str) -> DataFrame:
    """``df`` written in ranges of an order, ``part`` their number: ranges of lower numbers come first."""
    return written(df.repartitionByRange(*order_by).withColumn("part", F.spark_partition_id()))


def dbscan_1d(df: DataFrame, col: str, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """Density clusters of one column: ``cluster`` from 0, -1 for noise. Equal values are folded first, then ranges of values run side by side, with sums and neighbouring cores carried from range to range: no task orders all values, and none looks at a value more than a fixed number of times, however wide ``eps`` is."""
    require(df, col)
    eps = float(eps)
    values = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    # neighbours: rows up to x + eps less rows below x - eps; both bounds are sorted in among the values, below (0) or above (2) equal ones (1)
    bound = lambda at, kind, n: F.struct(at.alias("at"), F.lit(kind).alias("kind"), n.alias("n"))
    none = F.lit(0).cast("long")
    ends = F.array(bound(F.col("x") - eps, 0, none), bound(F.col("x"), 1, F.col("n")), bound(F.col("x") + eps, 2, none))
    sorted_in = _ranged(values.select("x", F.explode(ends).alias("e")).select("x", "e.*"), "at", "kind")
    offsets, total = [], 0
    for r in sorted(bounded_rows(sorted_in.groupBy("part").agg(F.sum("n").alias("n")), MAX_RANGES, "ranges")):
        offsets.append((r["part"], total))
        total += r["n"]
    carried = df.sparkSession.createDataFrame(offsets, "part int, before long")
    up = F.sum("n").over(Window.partitionBy("part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    summed = sorted_in.withColumn("up", up).join(F.broadcast(carried), "part").where("kind <> 1").withColumn("up", F.col("up") + F.col("before"))
    near = summed.groupBy("x").agg(F.sum(F.when(F.col("kind") == 2, F.col("up")).otherwise(-F.col("up"))).alias("near"))
    core = _ranged(near.select("x", (F.col("near") >= min_samples).alias("core")), "x")

    w = Window.partitionBy("part").orderBy("x")
    last = F.last(F.when(F.col("core"), F.col("x")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    begun = core.withColumn("starts", F.coalesce((F.col("core") & (F.col("x") - last > eps)).cast("int"), F.lit(0)))
    ranges = begun.groupBy("part").agg(*(f(F.when(F.col("core"), F.col("x"))).alias(n) for f, n in ((F.min, "first"), (F.max, "last"))), F.sum("starts").alias("starts"))
    around, bx, bc = {}, None, None  # by range: cluster of its first core; nearest core before and after it, with their clusters
    found = sorted(bounded_rows(ranges, MAX_RANGES, "ranges"))
    for r in found:
        c = None if r["first"] is None else 0 if bx is None else bc if r["first"] - bx <= eps else bc + 1
        around[r["part"]] = (r["part"], c, bx, bc)
        if c is not None:
            bx, bc = r["last"], c + r["starts"]
    ax = ac = None
    for r in reversed(found):
        around[r["part"]] += (ax, ac)
        if r["first"] is not None:
            ax, ac = r["first"], around[r["part"]][1]
    carried = df.sparkSession.createDataFrame(list(around.values()), "part int, c0 int, bx double, bc int, ax double, ac int")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    joined = begun.join(F.broadcast(carried), "part").withColumn("c", F.when(F.col("core"), F.col("c0") + F.sum("starts").over(so_far)))
    at = F.when(F.col("core"), F.struct("x", "c"))
    back = Window.partitionBy("part").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)
    joined = joined.withColumn("b", F.coalesce(F.last(at, ignorenulls=True).over(so_far), F.struct(F.col("bx").alias("x"), F.col("bc").alias("c"))))
    joined = joined.withColumn("a", F.coalesce(F.last(at, ignorenulls=True).over(back), F.struct(F.col("ax").alias("x"), F.col("ac").alias("c"))))
    label = F.when(F.col("core"), F.col("c")).when(F.col("x") - F.col("b.x") <= eps, F.col("b.c")).when(F.col("a.x") - F.col("x") <= eps, F.col("a.c")).otherwise(-1)
    labels = joined.select(F.col("x").alias("__x"), label.cast("int").alias("cluster"))
    return df.join(labels, F.col(col).cast("double") == F.col("__x"), "left").drop("__x")


def kmeans_clusters(df: DataFrame, cols: Sequence[str], k: int = 2, seed: int = 1) -> DataFrame:
    """``cluster`` by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    require(df, *cols)
    vectors = VectorAssembler(inputCols=list(cols), outputCol="__v", handleInvalid="skip").transform(df)
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(vectors).transform(vectors).drop("__v")


def _log_densities(df: DataFrame, cols: Sequence[str], cluster: str, bandwidth: float, most: int) -> DataFrame:
    """(label, score): total log density of each cluster's rows under a parabolic kernel of their own columns and their label."""

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        if len(group) > most:
            raise ValueError(f"a cluster of {len(group)} rows is larger than {most}")
        x = group[list(cols)].to_numpy(dtype=float) / bandwidth
        n, d = len(x), x.shape[1] + 1  # the label is one more, constant column
        unit = np.pi ** (d / 2) / math.gamma(d / 2 + 1)
        total = 0.0
        for lo in range(0, n, 512):
            square = ((x[lo : lo + 512, None] - x[None]) ** 2).sum(axis=2)
            total += float(np.log((d + 2) / (2 * unit) * np.maximum(1 - square, 0).sum(axis=1) / (n * bandwidth**d)).sum())
        return pd.DataFrame({"label": [int(key[0])], "score": [total]})

    return df.where(F.col(cluster) >= 0).select(cluster, *cols).groupBy(cluster).applyInPandas(one, "label int, score double")


def cluster_outliers(df: DataFrame, cols: Sequence[str], strategy: str = "size", threshold: float | None = None, cluster: str = "cluster", bandwidth: float = 0.2, most: int = 20_000) -> DataFrame:
    """Outliers of clustered rows. ``unclustered``: noise (label -1). ``size``: the smaller a cluster's share of rows, noise being one more cluster. ``frontier``: the farther from the own cluster's centre, as a share of the distances of all rows from it. ``density``: the less a cluster's total log density under a kernel estimate of its own rows weighs among all clusters, noise weighing nothing; its work is square in a cluster, and larger ones than ``most`` raise. Anything above the mean, or ``threshold``, is flagged."""
    require(df, *cols, cluster)
    if strategy == "unclustered":
        return df.withColumn("probability", F.when(F.col(cluster) == -1, 1.0).otherwise(0.0)).withColumn("outlier", F.col("probability") == 1)
    if strategy == "size":
        sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("__n"))
        total = sizes.agg(F.sum("__n")).first()[0] or 1
        out = df.join(F.broadcast(sizes), cluster).withColumn("probability", 1 - F.col("__n") / total).drop("__n")
    elif strategy == "frontier":
        centres = bounded_rows(df.groupBy(cluster).agg(*(F.avg(c).alias(c) for c in cols)), MAX_CLUSTERS, "clusters")
        gap = lambda r: F.sqrt(sum((F.pow(F.col(c) - F.lit(r[c]), F.lit(2.0)) for c in cols), F.lit(0.0)))
        totals = df.agg(*(F.sum(gap(r)).alias(f"t{i}") for i, r in enumerate(centres))).first()
        share = F.lit(None).cast("double")
        for i, r in enumerate(centres):
            share = F.when(F.col(cluster) == F.lit(r[cluster]), gap(r) / (totals[f"t{i}"] or 1.0)).otherwise(share)
        out = df.withColumn("probability", share)
    elif strategy == "density":
        scores = {r.label: r.score for r in bounded_rows(_log_densities(df, cols, cluster, bandwidth, most), MAX_CLUSTERS, "clusters")}
        scores[-1] = 0.0
        total = sum(scores.values()) or 1.0
        known = F.create_map(*(F.lit(x) for k, v in scores.items() for x in (int(k), 1 - v / total)))
        out = df.withColumn("probability", known[F.col(cluster).cast("int")])
    else:
        return df.withColumn("probability", F.lit(0.0)).withColumn("outlier", F.lit(False))
    bar = threshold if threshold is not None else out.agg(F.avg("probability")).first()[0]
    return out.withColumn("outlier", F.col("probability") > F.lit(bar))
