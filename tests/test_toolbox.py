"""Fixed examples of published behaviour, retyped as data."""

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import metrics as M
from tidemill.functions import scalars as S
from tidemill.operators import categorical as C
from tidemill.operators import hmm as H
from tidemill.operators import outliers as O
from tidemill.operators import relational as R
from tidemill.operators import sequences as Q
from tidemill.operators import similarity as X
from tidemill.operators import timeseries as T

V = [1, 0, 0, 1, 10, 2, 115, 110, 32, 16, 2, 0, 15, 1]


def series(spark, values, name="x"):
    return spark.createDataFrame([(i, None if v is None else float(v), "a") for i, v in enumerate(values)], f"i int, {name} double, g string")


def column(df, name, by="i"):
    return [r[name] for r in df.orderBy(by).collect()]


def near(a, b):
    assert [None if x is None else round(x, 6) for x in a] == [None if x is None else round(x, 6) for x in b]


def test_shift(spark):
    df = series(spark, range(5), "data")
    out = T.shift(df, ["data"], [1, 2], ["i"], prefix="t-")
    assert column(out, "t-1_data") == [None, 0, 1, 2, 3] and column(out, "t-2_data") == [None, None, 0, 1, 2]


def test_rolling(spark):
    df = series(spark, range(5), "data")
    near(column(T.rolling(df, ["data"], [3], ["i"], min_periods=1), "mean_3_data"), [0, 0.5, 1, 2, 3])
    near(column(T.strided(df, ["data"], 3, ["i"]), "mean_3_data"), [None, None, 1, 2, 3])
    near(column(T.rolling_deviation(series(spark, [0, 1, 2, 3, 0]), ["x"], 3, ["i"]), "mean_ad_3_x"), [None, None, 2 / 3, 2 / 3, 10 / 9])


def test_time_range(spark):
    rows = [(f"2013-01-01 09:00:0{s}", float(v)) for v, s in enumerate((0, 2, 3, 5, 6))]
    df = spark.createDataFrame(rows, "t string, data double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    near(column(T.rolling_time(df, ["data"], [2], "t"), "mean_2s_data", "t"), [0, 1, 1.5, 3, 3.5])
    near(column(T.rolling_time(df, ["data"], [5], "t"), "mean_5s_data", "t"), [0, 0.5, 1, 2, 2.5])


def test_distribution(spark):
    df = series(spark, [3, 10, 12, 23, 48, 19, 21], "sales")
    h = T.distribution(df, ["sales"], 3, ["i"])
    assert [column(h, f"sales_bin_{i}") for i in range(1, 5)] == [[0, 1, 1, 2, 1, 2, 2], [0, 0, 0, 0, 1, 0, 0], [1, 0, 0, 0, 0, 0, 0], [0, 1, 2, 1, 1, 1, 1]]
    q = T.distribution(df, ["sales"], 3, ["i"], quantiles=[0, 0.25, 0.5, 0.75, 1])
    near(column(q, "sales_quantile_2"), [3, 4.75, 6.5, 11, 17.5, 21, 20])


def test_projector_and_encoder(spark):
    df = spark.createDataFrame([(0, "A", "Paris", 0.0, 3), (1, "A", "London", 1.0, 4), (2, "B", "Paris", 2.0, 1), (3, "B", "Paris", 2.0, 2), (4, "B", "Roma", 1.0, 1), (5, None, "Roma", 9.0, 1)], "i int, item string, town string, price double, quantity int")
    out = C.project(df, ["item", "town"], ["price", "quantity"])
    near(column(out, "mean_price_per_item")[:5], [0.5, 0.5, 5 / 3, 5 / 3, 5 / 3])
    assert column(out, "mean_price_per_item")[5] is None
    coder = C.TagEncoder().fit(df.where("i < 5"), "item", ["i"])
    other = spark.createDataFrame([(i, x) for i, x in enumerate("AABCBD")], "i int, item string")
    assert column(coder.transform(other, "item"), "id") == [0, 0, 1, -1, 1, -1]
    assert column(coder.inverse(coder.transform(other, "item"), "id"), "tag") == ["A", "A", "B", None, "B", None]


def test_outlier_flags(spark):
    df = series(spark, V)
    flags = lambda out: {i for i, f in enumerate(column(out, "outlier")) if f}
    assert flags(O.centroid_outliers(df, ["x"])) == {6, 7}
    assert flags(O.mahalanobis_outliers(df, ["x"])) == {6, 7}
    assert flags(O.mahalanobis_outliers(df, ["x"], robust=True)) == {6, 7}
    assert flags(O.gaussian_density_outliers(df, ["x"], ["i"])) == {6, 7}
    assert flags(O.mad_outliers(df, "x", coefficient=1.0)) == {4, 6, 7, 8, 9, 12}
    assert flags(O.rolling_mad_outliers(df, ["x"], ["i"])) == {4, 6, 7, 8, 12}
    assert {i for i, f in enumerate(O.fft_residual_flags(np.array(V, float), 12, 0.2)) if f} == {6, 7}
    assert column(O.iterative_centroid_outliers(df, ["x"]), "tag") == [2, 1, 1, 2, 2, -1, 0, 0, 1, 1, -1, 1, 1, 2]
    clustered = O.dbscan_1d(df, "x", 0.5, 2)
    assert flags(O.cluster_outliers(clustered, ["x"], "unclustered")) == {4, 6, 7, 8, 9, 12}
    assert flags(O.cluster_outliers(clustered, ["x"], "size", 0.8)) == {5, 10}
    split = df.withColumn("cluster", (F.col("x") > 60).cast("int"))
    assert flags(O.cluster_outliers(split, ["x"], "size")) == {6, 7}
    frontier = O.cluster_outliers(split, ["x"], "frontier")
    assert flags(frontier) == {8, 9, 12}
    near([round(p, 8) for p in column(frontier, "probability")[:3]], [0.01861993, 0.02190581, 0.02190581])
    density = column(O.cluster_outliers(split, ["x"], "density"), "probability")
    assert {round(p, 8) for p in density} == {0.26737475, 0.73262525}
    assert flags(O.cluster_outliers(clustered, ["x"], "density", 0.8)) == {4, 6, 7, 8, 9, 12}
    assert column(O.mad_outliers(series(spark, [1, 1, 1]), "x"), "outlier") == [None] * 3


def test_double_deviation(spark):
    d = S.deviations(series(spark, [1, 4, 4, 4, 5, 5, 5, 5, 7, 7, 8, 10, 16, 30]), "x").first()
    assert (d.mad_left, d.mad_right) == (1, 11)


def test_markov(spark):
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate("aabcda")], "q int, i int, s string")
    chain = Q.MarkovChain.fit(df, "s", "q", ["i"])
    p, last = chain.chained(list("abcdea"))
    assert p == [1, 0.5, 0.5, 0.5, 0, 0]
    probe = spark.createDataFrame([(0, i, s) for i, s in enumerate("abcdea")], "q int, i int, s string")
    assert column(Q.transition_probabilities(probe, Q.transitions(df, "s", "q", ["i"]), "s", "q", ["i"]), "transition_p") == [1, 0.5, 1, 1, 0, 0]
    assert column(Q.chained_probabilities(probe, chain, "s", "q", ["i"]), "chained_p") == p
    _, v = chain.chained(list("abcde"))
    near([round(x, 3) for x in chain.chained(list("ea"), v)[1][:3]], [0.531, 0.281, 0.062])
    other = Q.MarkovChain.fit(spark.createDataFrame([(0, i, s) for i, s in enumerate("aabcaddda")], "q int, i int, s string"), "s", "q", ["i"])
    assert other.likely(list("cbdda"), "a") == [False, False, True, True, True]
    assert other.predict_next(other.chained(list("cbdda"))[1]) == ["a"]


def test_durations(spark):
    rows = lambda states, times: spark.createDataFrame([(0, i, s, t) for i, (s, t) in enumerate(zip(states, times))], "q int, i int, s string, t long")
    model = Q.duration_model(rows("aabbaaab", [0, 12, 14, 29, 40, 42, 44, 48]), "s", "t", "q", ["i"], 3)
    out = Q.duration_probabilities(rows("abbaba", [0, 2, 20, 24, 27, 38]), model, "s", "t", "q", ["i"])
    near(column(out, "duration_p"), [1, 0.5, 0, 0, 0, 1])


def test_labelled_sequences(spark):
    xs = [[1, 0, 0], [1, 1, 0], [0, 1, 0], [0, 0, 1], [1, 0, 1]] * 2
    ys = ["n", "n", "v", "p", "n"] * 2
    df = spark.createDataFrame([(i // 5, i, [float(v) for v in x], y) for i, (x, y) in enumerate(zip(xs, ys))], "q int, i int, f array<double>, y string")
    for decoder in ("viterbi", "bestfirst"):
        model = Q.supervised_hmm(df, "f", "y", "q", ["i"], decoder=decoder)
        assert np.allclose(np.exp(model.weights).sum(axis=0), 1) and np.allclose(np.exp(model.steps).sum(axis=0), 1)
        assert model.transform(df, "f", "q", ["i"]).count() == 10
    tagger = Q.structured_perceptron([(np.array(xs[:5], float), ys[:5])], iterations=20, seed=0)
    assert tagger.tag(np.array(xs[:5], float)) == ys[:5]
    with pytest.raises(ValueError):
        Q.supervised_hmm(df, "f", "y", "q", ["i"], alpha=0)


def test_hidden_markov_lattices():
    model = H.DiscreteHmm(2, 3, np.array([[0.1, 0.4, 0.5], [0.6, 0.3, 0.1]]))
    model.start, model.steps = np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.4, 0.6]])
    score, path = model.decode(np.array([[0], [1], [2]]))
    assert math.exp(score) == pytest.approx(0.01344) and list(path) == [1, 0, 0]
    assert model.posteriors(np.array([[0], [1], [2]])).sum(axis=1) == pytest.approx([1, 1, 1])
    frames = np.log([[0.9, 0.2], [0.9, 0.2], [0.1, 0.8], [0.9, 0.2], [0.9, 0.2]])
    first, steps = np.log([0.5, 0.5]), np.log([[0.7, 0.3], [0.3, 0.7]])
    assert H.log_sum(H.forward(first, steps, frames)[-1]) == pytest.approx(-3.3725, abs=1e-4)
    best, path = H.best_path(first, steps, frames)
    assert best == pytest.approx(-4.4590, abs=1e-4) and list(path) == [0, 0, 1, 0, 0]


@pytest.mark.parametrize("make", [lambda: H.DiscreteHmm(2, 3, iterations=5, tolerance=-1e9), lambda: H.GaussianHmm(2, "full", iterations=4, tolerance=-1e9), lambda: H.MixtureHmm(2, 2, iterations=4, tolerance=-1e9)])
def test_likelihood_grows(spark, make):
    random = np.random.default_rng(0)
    discrete = isinstance(make(), H.DiscreteHmm)
    rows = [(q, i, [float(random.integers(3))] if discrete else [float(v) for v in random.normal(3 * (i // 5 % 2), 1, 2)]) for q in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "q int, i int, x array<double>")
    model = make().fit(df, "x", "q", ["i"])
    assert all(b >= a - (1e-6 if discrete else 1.0) for a, b in zip(model.history, model.history[1:]))
    assert model.transform(df, "x", "q", ["i"]).count() == 60


def test_texts(spark):
    df = spark.createDataFrame([(0, "abcd"), (1, "ab"), (2, ""), (3, None)], "i int, t string")
    assert column(df.withColumn("s", S.shingles(F.col("t"))), "s") == [["abc", "bcd"], [], [], None]
    assert [S.text_hash("toto", s) for s in (1, 2, 3)] == [10143814839887274982, 8018333638267422442, 9635205340518008203]
    score = spark.range(1).select(M.multiset_jaccard(F.array(F.lit("a"), F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("c"))).alias("s")).first().s
    assert score == pytest.approx(1 / 4)
    texts = spark.createDataFrame([(0, "There is a better way."), (1, "There is a better day."), (2, "nothing of the kind")], "i int, t string")
    got = X.NearestText(40, 3, 10, 20).fit(texts, "t").nearest(texts, "i", "t")
    assert {r.i: r.match for r in got.collect()} == {0: "There is a better way.", 1: "There is a better day.", 2: "nothing of the kind"}
    with pytest.raises(ValueError):
        X.NearestText(10, 3, 10, 3)


def test_text_queries_over_whole_tables(spark, tmp_path):
    import random
    from collections import Counter

    from tidemill.plans.reference_queries import QUERIES

    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdeé👍") for _ in range(r.randint(2, 6)))
    items = [(i, "s", " ".join(word() for _ in range(30))) for i in range(25)]
    texts = [None, "", "ab", "abc", "x" * 5000, items[3][2]] + [items[0][2]] * 3
    for _ in range(40):  # parts of an item between other words
        w = r.choice(items)[2].split()
        texts.append(" ".join([word() for _ in range(r.randint(0, 9))] + w[: r.randint(10, 30)] + ["boiler plate"] * r.randint(0, 20)))
    docs = list(enumerate(texts))
    spark.createDataFrame(items, "item_id long, suite string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t and t[:120]) for i, t in docs], "id long, text string").write.parquet(f"{tmp_path}/task2_train.parquet")
    rows = lambda name: [tuple(x) for x in QUERIES[name](spark, str(tmp_path)).collect()]
    grams = lambda t: [t[i : i + 3] for i in range(len(t) - 2)]

    def signed(t):
        m = [float(min(2**63 - 1, min(S.text_hash(g, s) for g in set(grams(t))))) for s in range(50)]
        return [(b, m[2 * b] + m[2 * b + 1]) for b in range(25)]

    def alike(a, b):
        p, q = Counter(a), Counter(b)
        return sum((p & q).values()) / sum((p | q).values())

    index = {t: set(signed(t)) for _, _, t in items}
    want = {}
    for i, t in docs:
        if t and grams(t):
            met = sorted(((-n, c) for c, e in index.items() if (n := len(e & set(signed(t))))))[:10]
            if met:
                score, _, match = max((alike(t, c), -n, c) for n, c in met)
                want[i, t] = (match, pytest.approx(score))
    got = {(i, q): (m, s) for i, q, m, s in rows("lsh_nearest")}
    assert got == want and len(want) > 30 and any(q != m for (_, q), (m, _) in got.items())

    assert sorted(rows("document_shingles")) == [(i, None if t is None else grams(t)) for i, t in docs]
    clean = lambda t: t if t is None else " ".join(t.lower().split())
    assert sorted(rows("document_cleaned_text")) == [(i, clean(t)) for i, t in docs]

    sets = {}
    for i, t in docs:
        if t and (g := frozenset(grams(t[:120]))):
            sets.setdefault(g, i)
    every = [(*sorted((i, j)), round(len(a & b) / len(a | b), 4)) for (a, i), (b, j) in itertools.combinations(sets.items(), 2) if len(a & b) / len(a | b) >= 0.6]
    assert sorted(rows("post_jaccard_pairs")) == sorted(every) and every

    split = {i: re.findall(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]", t or "") for i, t in docs}
    known = {}
    for i in sorted(split):
        for token in sorted(set(split[i])):
            known.setdefault(token, len(known) + 1)
    ids = {i: [known[x] for x in w] for i, w in split.items()}
    assert dict(rows("token_ids")) == ids
    sizes = [len(x) for x in ids.values()]
    mean = sum(sizes) / len(sizes)
    n = round(mean + 2 * (sum((x - mean) ** 2 for x in sizes) / len(sizes)) ** 0.5)
    assert dict(rows("padded_sequences")) == {i: ([0] * n + x)[-n:] for i, x in ids.items()}


def test_missing_values_and_sampling(spark):
    df = spark.createDataFrame([(0, "a", None), (1, "a", 2.0), (2, "a", 2.0), (3, "b", None), (4, None, None)], "i int, g string, x double")
    assert column(R.fill_statistic(df, ["x"], "median", ["g"]), "x") == [2.0, 2.0, 2.0, None, None]
    assert column(R.fill_neighbours(df, ["x"], ["i"]), "x") == [2.0] * 5
    kept, beta = R.undersampled(spark.createDataFrame([(i, int(i < 2)) for i in range(100)], "k int, y int"), "y", "k")
    assert kept.count() == 4 and beta == pytest.approx(2 / 98)
    assert sorted(r.position for r in R.positions(df, ["i"]).collect()) == list(range(5))


def test_histogram_buckets(spark):
    pick = lambda v, **k: spark.range(1).select(C.histogram_bucket(F.lit(float(v)), [0, 5, 10, 15], [55, 28, 37], **k).alias("n")).first().n
    assert [pick(v) for v in (6, 11, 1, -1, 15)] == [28, 37, 55, 0, 0]
    assert pick(6, normalized=True) == pytest.approx(28 / 120) and pick(6, cumulative="asc") == 83
