from datetime import datetime, timedelta

import numpy as np

from tidemill.operators import anomalies as A

T0 = datetime(2011, 7, 1)
READ = "reading_id long, source_id string, timestamp timestamp_ntz, value double"


def frame(spark, values, source="a", first=0):
    return spark.createDataFrame([(first + i, source, T0 + timedelta(seconds=60 * i), None if v is None else float(v)) for i, v in enumerate(values)], READ)


def usual(n, seed=1):
    return list(np.round(10 + np.random.default_rng(seed).normal(0, 0.2, n), 4))


def flagged(df):
    return sorted(r.reading_id for r in A.implausible(df).collect())


def test_spikes_limits_and_stuck_values(spark):
    v = usual(300)
    v[40] = 20.0
    v[80:83] = [3.0, 2.5, 3.1]
    v[120] = -1.0
    v[150] = float("inf")
    v[160:170] = [10.05] * 10
    v[200:209] = [10.15] * 9
    v[220:240] = [25 + x - 10 for x in v[220:240]]  # a lasting change
    v[250] = 0.0
    assert flagged(frame(spark, v)) == [40, 80, 81, 82, 120, 150, *range(160, 170), 250]


def test_deliveries_missing_values_and_ties(spark):
    v = usual(60)
    v[10], v[20] = None, float("nan")
    v[30] = 50.0
    df = frame(spark, v)
    twice = df.unionByName(df).unionByName(spark.createDataFrame([(999, None, T0, 1.0), (998, "a", None, -1.0)], READ))
    assert flagged(twice) == [30]
    assert A.scored_readings(twice).count() == 58
    assert flagged(frame(spark, [])) == []
    assert flagged(frame(spark, [5.0])) == []


def test_stretches_join_without_seams(spark, monkeypatch):
    v = usual(500, 3)
    v[99:102] = [30.0, 31.0, 29.0]
    v[295:307] = [9.99] * 12
    v[400] = 1.0
    whole = flagged(frame(spark, v))
    monkeypatch.setattr(A, "STRETCH", 100)
    assert flagged(frame(spark, v)) == whole == [99, 100, 101, *range(295, 307), 400]


def test_isolation_scores_rank_outliers_first():
    x = np.random.default_rng(0).normal(size=(500, 3))
    x[7] = 12
    s = A.isolation_scores(x)
    assert s.argmax() == 7 and 0 < s.min() and s.max() < 1


def test_the_forest_decides_what_is_usual():
    random = np.random.default_rng(5)
    ts = np.arange(2000) * 60_000_000
    wild = 10 * (1 + random.normal(0, 0.25, 2000)).clip(0.2)
    _, _, spike, _ = A.judged(ts, wild)
    away = np.abs(A.measures(ts, wild)["away"])
    assert (away >= A.SHARE).sum() > 300 and spike.sum() < 0.1 * (away >= A.SHARE).sum()  # far from the level, yet usual here
    calm = 10 * (1 + random.normal(0, 0.01, 2000))
    calm[700] *= 1.4
    assert np.flatnonzero(A.judged(ts, calm)[2]).tolist() == [700]


def test_scores_do_not_depend_on_the_stretches(spark, monkeypatch):
    v = usual(700, 4)
    v[333:336] = [20.0, 21.0, 22.0]
    df = frame(spark, v).unionByName(frame(spark, usual(50, 6), "b", 5000))
    whole = {r.reading_id: r for r in A.scored_readings(df).collect()}
    for size in (100, 300):
        monkeypatch.setattr(A, "STRETCH", size)
        assert {r.reading_id: r for r in A.scored_readings(df).collect()} == whole
    assert len(whole) == 750


def test_profiles_come_from_all_readings_of_a_source(spark, monkeypatch):
    v = usual(3000, 8)
    v[1000:1600] = list(np.round(np.array(v[1000:1600]) * (1 + np.random.default_rng(9).normal(0, 0.2, 600)), 2))
    v[50], v[60], v[2000], v[2500:2512] = -3.0, float("inf"), 0.0, [10.5] * 12
    others = {"b": [float("inf")] * 250, "c": [5.0, 5.0, -2.0] * 70, "d": [7.0]}
    df, known = frame(spark, v), {"a": v} | others
    for i, (source, values) in enumerate(others.items()):
        df = df.unionByName(frame(spark, values, source, 10_000 * (i + 1)))
    first = [0, 10_000, 20_000, 30_000]
    start = int(np.datetime64(T0, "us").astype(np.int64))
    want = {}
    for base, values in zip(first, known.values()):
        columns = A.judged(start + np.arange(len(values)) * 60_000_000, np.array(values))
        want |= {base + i: row for i, row in enumerate(zip(*(c.tolist() for c in columns)))}
    for size in (20_000, 100, 701):
        monkeypatch.setattr(A, "STRETCH", size)
        got = {r.reading_id: (r.score, r.impossible, r.spike, r.stuck) for r in A.scored_readings(df).collect()}
        assert got == want


def test_middle_values_are_exact():
    random = np.random.default_rng(2)
    values = np.r_[random.normal(0, 1, 500), -0.0, 0.0, 1e300, -1e-300]
    assert (A._value(A._key(values)) == values).all()
    assert (np.argsort(A._key(values), kind="stable") == np.argsort(values, kind="stable")).all()
    drawn = A.draws(50_000)
    assert {len(set(d)) for d in drawn} == {A.SAMPLE} and max(map(max, drawn)) > 49_000 and len(set(np.concatenate(drawn))) > 2_000
