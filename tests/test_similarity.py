"""Pairs of alike shingle sets: blocks of sets against all pairs, and what is sent."""

import itertools
import random

import pytest

from tidemill.operators import similarity as X


def test_pairs_over_blocks_and_without_shuffled_pairs(spark, monkeypatch):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé👍") for _ in range(r.randint(2, 6)))
    base = [" ".join(word() for _ in range(12)) for _ in range(20)]
    texts = [None, "", "ab", "abc", "abcabc", base[0], base[0], "x" * 4000]
    for _ in range(150):  # a common frame around parts of a few texts
        w = r.choice(base).split()
        texts.append("it is known that " + " ".join(w[: r.randint(3, 12)] + [word() for _ in range(r.randint(0, 4))]))
    rows = list(enumerate(texts)) + [(None, "no key at all")]
    df = spark.createDataFrame(rows, "k int, t string").repartition(3)
    for size, least in ((3, 0.6), (2, 0.8), (5, 0.3)):
        sets = {}
        for k, t in rows:
            if k is not None and t and len(t) >= size:
                g = frozenset(t[i : i + size] for i in range(len(t) - size + 1))
                sets[g] = min(k, sets.get(g, k))
        want = {tuple(sorted((i, j))): pytest.approx(len(a & b) / len(a | b)) for (a, i), (b, j) in itertools.combinations(sets.items(), 2) if len(a & b) / len(a | b) >= least}
        for most in (100_000, 30):
            monkeypatch.setattr(X, "BLOCK_SETS", most)
            got = X.jaccard_pairs(df, "k", "t", size, least)
            found = got.collect()
            assert {(a, b): s for a, b, s in found} == want and len(found) == len(want) > 20
    # candidates of shared shingles grew with the square of the rows and went through joins and a distinct
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        X.jaccard_pairs(df, "k", "t", 3, 0.0)
