"""Density clusters of one column over several ranges of values."""

import random

import pytest

from tidemill.operators import outliers as O


def brute(xs, eps, least):
    """Cores joined by gaps of at most eps; others go to the core before them, else to the one after."""
    v = sorted(set(xs))
    cores = [x for x in v if sum(x - eps <= y <= x + eps for y in xs) >= least]
    number = {x: 0 for x in cores[:1]}
    for a, b in zip(cores, cores[1:]):
        number[b] = number[a] + (b - a > eps)
    out = {}
    for x in v:
        before, after = [c for c in cores if c <= x][-1:], [c for c in cores if c >= x][:1]
        out[x] = number[before[0]] if before and x - before[0] <= eps else number[after[0]] if after and after[0] - x <= eps else -1
    return out


@pytest.mark.parametrize("eps, least", [(0.5, 3), (3.0, 12), (0.01, 2), (1e6, 5), (0.5, 1000)])
def test_clusters_across_ranges(spark, eps, least):
    r = random.Random(7)
    xs = [round(r.choice((0, 20, 21, 60)) + r.gauss(0, 3), 1) for _ in range(300)] + [40.0] * 8 + [-0.0, 200.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*xs, None])], "i int, x double")
    keep = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = O.dbscan_1d(df, "x", eps, least)
        # all values went through one task, and the way to the next core was walked anew from each of them
        assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
        got = {row.i: row.cluster for row in out.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", keep)
    want = brute(xs, eps, least)
    assert [got[i] for i in range(len(xs))] == [want[x] for x in xs] and got[len(xs)] is None
    assert O.dbscan_1d(df.where("x is null"), "x").collect()[0].cluster is None
