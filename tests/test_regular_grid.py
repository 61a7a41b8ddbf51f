from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.operators import regular_grid as G

T0 = datetime(2011, 7, 1)
READ = "reading_id long, source_id string, timestamp timestamp_ntz, value double, ingested_at timestamp_ntz"
FLY = "flight_id long, source_id string, starts_at timestamp_ntz, ends_at timestamp_ntz, step_seconds int"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_missing_periods_and_status(spark):
    readings = [(1, "a", at(0), 1.0, T0), (1, "a", at(0), 1.0, at(9)), (2, "a", at(59.9), 2.0, T0), (3, "a", at(120), None, T0), (4, "a", at(130), float("nan"), T0), (5, "a", at(180), -7.0, at(9e6)), (6, "a", at(250), 3.0, T0), (7, "b", at(10), 1.0, T0), (8, None, at(10), 1.0, T0), (9, "a", None, 1.0, T0)]
    flights = [(1, "a", at(0), at(250), 60), (2, "c", at(0), at(30), 60), (3, "a", at(300), at(300), 60), (4, "a", at(400), at(460), 0)]
    r, f = spark.createDataFrame(readings, READ), spark.createDataFrame(flights, FLY)
    got = {tuple(x) for x in G.missing_periods(r.withColumn("status", F.lit(1)).withColumn("k", F.lit(2)), f).collect()}
    assert got == {("a", "2011-07-01 00:01:00"), ("a", "2011-07-01 00:02:00"), ("a", "2011-07-01 00:04:00"), ("c", "2011-07-01 00:00:00")}
    series = {x.k: x for x in G.regular_series(r, f).where("source_id = 'a'").collect()}
    assert series[0].value == 2.0 and series[3].value == -7.0 and series[0].status == "observed"
    assert series[1].status == "missing" and series[1].value is None  # too few observed cells for support


def test_fill_follows_the_other_sources(spark):
    import math

    readings, n = [], 0
    for s, scale in (("a", 1.0), ("b", 5.0), ("c", 20.0)):
        for hour in range(240):
            if s == "a" and 100 <= hour < 103:
                continue
            n += 1
            readings.append((n, s, at(hour * 3600), scale * math.exp(0.4 * math.sin(hour / 24 * 2 * math.pi)), T0))
    flights = [(i, s, at(0), at(240 * 3600), 3600) for i, s in enumerate("abc")]
    got = G.regular_series(spark.createDataFrame(readings, READ), spark.createDataFrame(flights, FLY), column_seconds=3600).where("status <> 'observed'").collect()
    assert {x.k for x in got} == {100, 101, 102} and {x.status for x in got} == {"filled"}
    for x in got:
        assert x.value == pytest.approx(math.exp(0.4 * math.sin(x.k / 24 * 2 * math.pi)), rel=0.1)


def test_columns_are_as_fine_as_the_periods(spark):
    import math

    course = lambda i: math.exp(0.4 * math.sin(i / 7))
    gaps = {("a", i) for i in range(40, 46)} | {(s, 60) for s in "abc"} | {("c", 62), ("b", 62)}
    readings = [(0, s, at(i * 300), scale * course(i), T0) for s, scale in (("a", 1.0), ("b", 5.0), ("c", 20.0)) for i in range(120) if (s, i) not in gaps]
    readings += [(0, "d", at(i * 3600), 2.0, T0) for i in range(10)]  # another step length supports nothing here
    flights = [(i, s, at(0), at(36_000), 300) for i, s in enumerate("abc")] + [(9, "d", at(0), at(36_000), 3600)]
    got = {(x.source_id, x.k): x for x in G.regular_series(spark.createDataFrame(readings, READ), spark.createDataFrame(flights, FLY)).where("status <> 'observed'").collect()}
    assert set(got) == gaps
    assert all(got[k].status == "missing" and got[k].value is None for k in gaps if k[1] >= 60)  # nobody, or one other source, reported then
    filled = [got["a", i] for i in range(40, 46)]
    assert {x.status for x in filled} == {"filled"} and len({x.value for x in filled}) == 6
    for x in filled:
        assert x.value == pytest.approx(course(x.k), rel=0.1)


def test_factors_are_iterated_to_the_tolerance(spark):
    import random

    r = random.Random(3)
    rows = [(f"s{s}", 60, c, r.gauss(0, 1) * (s % 3) + c % 5) for s in range(8) for c in range(40) if r.random() < 0.8]
    matrix = spark.createDataFrame(rows, "source_id string, width long, col long, y double")

    def left(**k):
        sources, columns = G.factorised(matrix, **k)
        e = matrix.join(sources, ["source_id", "width"]).join(columns, ["width", "col"])
        return e.agg(F.sum((F.col("y") - F.col("mean") - F.col("u1") * F.col("v1") - F.col("u2") * F.col("v2")) ** 2)).first()[0]

    assert left(tolerance=1e-3) < left(tolerance=10.0)
    with pytest.warns(UserWarning, match="still changed"):
        G.factorised(matrix, tolerance=0.0, rounds=2)


def test_empty_tables(spark):
    assert G.missing_periods(spark.createDataFrame([], READ), spark.createDataFrame([], FLY)).count() == 0
    with pytest.raises(ValueError):
        G.missing_periods(spark.createDataFrame([], "x int"), spark.createDataFrame([], FLY))


def test_missing_periods_come_from_the_factorised_series(spark, monkeypatch):
    flights = [(i, s, at(0), at(600), 60) for i, s in enumerate("abc")] + [(8, None, at(0), at(60), 60)]
    readings = [(0, s, at(60 * k), scale * (2.0 + k), T0) for s, scale in (("a", 1.0), ("b", 5.0), ("c", 20.0)) for k in range(10) if (s, k) != ("a", 4) and k != 7]
    r, f = spark.createDataFrame(readings, READ), spark.createDataFrame(flights, FLY)
    statuses, plain = [], G.regular_series

    def kept(*given):
        out = plain(*given)
        statuses.extend((x.source_id, x.k, x.status) for x in out.where("status <> 'observed'").collect())
        return out

    monkeypatch.setattr(G, "regular_series", kept)
    got = sorted((str(x.source_id), x.period_start[-5:]) for x in G.missing_periods(r, f).collect())
    assert got == [("None", "00:00"), ("a", "04:00"), ("a", "07:00"), ("b", "07:00"), ("c", "07:00")]
    assert sorted(map(str, statuses)) == sorted(map(str, [(None, 0, "missing"), ("a", 4, "filled"), *((s, 7, "missing") for s in "abc")]))


def test_fills_do_not_depend_on_blocks_or_on_how_factors_travel(spark, monkeypatch):
    import random

    x = random.Random(4)
    readings = [(0, s, at(60 * k), 10 ** (i % 3) * (2 + k % 7) * x.uniform(0.9, 1.1), T0) for i, s in enumerate("abcdef") for k in range(90) if x.random() < 0.85]
    readings += [(0, "a", at(5401), -1.0, T0), (0, "b", at(5401), float("inf"), T0)]
    # the flights of a and of b meet within one column
    flights = [(i, s, at(0), at(5430 if s in "ab" else 5400), 60) for i, s in enumerate("abcdef")] + [(10, "a", at(5430), at(5500), 60), (11, "b", at(5430), at(5500), 60), (12, "f", datetime(2090, 1, 1), datetime(2090, 1, 1, 0, 5), 60)]
    r, f = spark.createDataFrame(readings, READ), spark.createDataFrame(flights, FLY)

    def series():
        return {(y.flight_id, y.k): (y.value, y.status) for y in G.regular_series(r, f).collect()}

    want = series()
    assert len(want) == 6 * 90 + 2 + 4 + 5 and {s for _, s in want.values()} == {"observed", "filled", "missing"}
    for name, size in (("BLOCK", 1), ("FACTORS_BROADCAST", 2), ("COLUMNS", 16)):
        monkeypatch.setattr(G, name, size)
        got = series()
        assert {k: s for k, (_, s) in got.items()} == {k: s for k, (_, s) in want.items()}
        assert all(v == pytest.approx(want[k][0], rel=1e-9) for k, (v, _) in got.items() if v is not None)


def test_factors_are_those_of_plain_least_squares(spark):
    import numpy as np

    x = np.random.default_rng(6)
    y = x.normal(0, 1, (7, 30)) + np.arange(7)[:, None]
    rows = [(f"s{i}", 3600, j, float(y[i, j])) for i in range(7) for j in range(30)]
    with pytest.warns(UserWarning, match="still changed"):
        sources, columns = G.factorised(spark.createDataFrame(rows, "source_id string, width long, col long, y double"), tolerance=0.0, rounds=4)
    e = y - y.mean(axis=1, keepdims=True)
    turn = np.arange(30) % 24 / 24 * 2 * np.pi
    v, ridge = np.column_stack([np.cos(turn), np.sin(turn)]), 0.1 * np.eye(2)
    for _ in range(4):
        u = np.linalg.solve(v.T @ v + ridge, v.T @ e.T).T
        v = np.linalg.solve(u.T @ u + ridge, u.T @ e).T
    for g in sources.collect():
        assert (g.u1, g.u2, g.mean, g.cells) == pytest.approx((*u[int(g.source_id[1:])], y[int(g.source_id[1:])].mean(), 30))
    assert {c.col: c.sources for c in columns.collect()} == dict.fromkeys(range(30), 7)
    for c in columns.collect():
        assert (c.v1, c.v2) == pytest.approx(tuple(v[c.col]))
