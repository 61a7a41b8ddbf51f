"""Scalar functions on columns: shingles, cleaning, tokens, scaling, probabilities, coordinates, seeded hashes."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Punctuation that text cleaning turns to blanks.
PUNCTUATION = "!\"$%&()*+,-./:;<=>?[\\]^_`{|}~'"


def shingles(text: Column, size: int = 3) -> Column:
    """Character n-grams in order; none for a text shorter than ``size``, null for null. The text is parted once, so that long texts take time in proportion."""
    n = F.length(text)
    joined = lambda chars: F.transform(F.sequence(F.lit(0), n - size), lambda i: F.concat(*(F.get(chars, i + j) for j in range(size))))
    made = F.get(F.transform(F.array(F.split(text, "")), joined), F.lit(0))
    return F.when(text.isNull(), None).when(n >= size, made).otherwise(F.array().cast("array<string>"))


def tweet_cleaned(text: Column) -> Column:
    """Without @, # and line breaks, addresses as the word url."""
    return F.regexp_replace(F.translate(F.regexp_replace(text, r"[\r\n]+", " "), "@#", ""), r"https?://\S+", "url")


def words_only(text: Column) -> Column:
    """Lower case, punctuation as blanks, runs of blanks as one."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, PUNCTUATION, " " * len(PUNCTUATION))), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Words, numbers, contractions and single marks, in order."""
    return F.regexp_extract_all(text, F.lit(r"\w+(?='\w)|'\w+|\w+|[^\w\s]"), F.lit(0))


class _Minhash:
    """Minhashes of sets of texts; the hashes of texts seen before are kept, at most ENTRIES numbers."""

    ENTRIES = 4_000_000

    def __init__(self, seeds: Sequence[int]):
        self.seeds, self.most = list(seeds), max(1, self.ENTRIES // max(1, len(seeds)))
        self.rows, self.places = np.empty((1024, len(self.seeds))), {}

    def __call__(self, items: set[str]) -> list[float]:
        cap = (1 << 63) - 1
        if len(self.places) + len(items) > self.most:
            self.places.clear()
        for x in items - self.places.keys():
            if (at := len(self.places)) == len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            coded = x.encode()
            self.rows[at] = [min(cap, xxhash.xxh64_intdigest(coded, seed=s)) for s in self.seeds]
            self.places[x] = at
        return self.rows[[self.places[x] for x in items]].min(axis=0).tolist()


def seeded_hashes(texts: Column, seeds: Sequence[int]) -> Column:
    """Minhashes of an array of texts: for each seed the least 64-bit xxHash, capped at 2^63 - 1, as a double; null for an empty array. One call a document, vectorised over Arrow batches."""
    seeds = list(seeds)

    @F.pandas_udf("array<double>")
    def minhash(arrays: pd.Series) -> pd.Series:
        hashes = _Minhash(seeds)
        return arrays.map(lambda items: hashes(set(items)) if items is not None and len(items) else None, na_action="ignore")

    return minhash(texts)


def shingle_hashes(text: Column, size: int, seeds: Sequence[int]) -> Column:
    """``seeded_hashes`` of ``shingles``; the n-grams are made where they are hashed, so a batch holds the texts only. Null for texts shorter than ``size``."""
    seeds = list(seeds)

    @F.pandas_udf("array<double>")
    def minhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = _Minhash(seeds)
        for texts in batches:
            yield texts.map(lambda t: hashes({t[i : i + size] for i in range(len(t) - size + 1)}) if len(t) >= size else None, na_action="ignore")

    return minhash(text)


def text_hash(text: str, seed: int) -> int:
    """The seeded 64-bit hash itself."""
    return xxhash.xxh64_intdigest(text, seed=seed)


def mean_absolute_deviation(values: Column) -> Column:
    """Of an array without nulls; see ``timeseries.absolute_deviation``."""
    from tidemill.operators.timeseries import absolute_deviation

    return absolute_deviation(values, "mean")


def deviations(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., mean_ad, median_ad, mad_left, mad_right): deviation measures of a column in two pre-aggregated passes. The double deviation parts rows at absolute deviation <= and >= the median of the values, as its definition in use has it."""
    base = df.where(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("x"))
    middle = lambda c: F.percentile(c, F.lit(0.5))
    centre = base.groupBy(*by).agg(F.avg("x").alias("mean"), middle(F.col("x")).alias("med"))
    if by:
        joined = base.join(centre, list(by))
    else:
        one = centre.first()
        joined = base.select("x", F.lit(one["mean"]).alias("mean"), F.lit(one["med"]).alias("med"))
    away = F.abs(F.col("x") - F.col("med"))
    low = away <= F.col("med")
    return joined.groupBy(*by).agg(F.avg(F.abs(F.col("x") - F.col("mean"))).alias("mean_ad"), middle(away).alias("median_ad"), middle(F.when(low, away)).alias("mad_left"), middle(F.when(away >= F.col("med"), away)).alias("mad_right"))


def tail_scaled(value: Column, q5: float, q95: float) -> Column:
    """[q5, q95] as [0, 1], tails beyond it pressed to a hundredth of a double logarithm."""
    width = (q95 - q5) or 1.0
    inside = (value - q5) / width
    tail = lambda d: 0.01 * F.log(1 + F.log(1 + d))
    return F.when(value < q5, -tail((q5 - value) / width)).when(value > q95, 1 + tail((value - q95) / width)).otherwise(inside)


def plotting_quantiles(df: DataFrame, col: str, probabilities: Sequence[float]) -> list[float]:
    """Sample quantiles with plotting positions of alpha = beta = 0.4, from order statistics of exact linear percentiles."""
    n = df.where(F.col(col).isNotNull()).count()
    if not n:
        return [math.nan] * len(probabilities)
    ranks = []
    for p in probabilities:
        aleph = n * p + 0.4 + p * (1 - 0.8)
        ranks.append(min(max(aleph, 1.0), float(n)))
    at = [0.0 if n == 1 else (r - 1) / (n - 1) for r in ranks]
    return [float(x) for x in df.agg(F.percentile(col, F.array(*map(F.lit, at))).alias("q")).first()["q"]]


def bias_corrected(p: Column, beta: Column | float) -> Column:
    """The probability before the majority class was cut by ``beta``."""
    return beta * p / (beta * p - p + 1)


def lambert_to_degrees(df: DataFrame, x: str, y: str) -> DataFrame:
    """Longitude and latitude of conic conformal coordinates (zone CC45), as closed column arithmetic with a fixed number of latitude steps."""
    # GRS80 and the zone's parallels and origin.
    a, f = 6378137.0, 1 / 298.257222101
    e = math.sqrt(2 * f - f * f)
    phi0, phi1, phi2, lam0, x0, y0 = (math.radians(v) for v in (45.0, 44.25, 45.75, 3.0, 0, 0))
    x0, y0 = 1_700_000.0, 4_200_000.0
    m = lambda t: math.cos(t) / math.sqrt(1 - (e * math.sin(t)) ** 2)
    iso = lambda t: math.tan(math.pi / 4 - t / 2) / ((1 - e * math.sin(t)) / (1 + e * math.sin(t))) ** (e / 2)
    n = (math.log(m(phi1)) - math.log(m(phi2))) / (math.log(iso(phi1)) - math.log(iso(phi2)))
    scale = m(phi1) / (n * iso(phi1) ** n)
    r0 = a * scale * iso(phi0) ** n
    dx, dy = F.col(x) - x0, F.lit(r0) - (F.col(y) - y0)
    r = F.sqrt(dx * dx + dy * dy)
    t = F.pow(r / (a * scale), F.lit(1 / n))
    lat = math.pi / 2 - 2 * F.atan(t)
    for _ in range(6):
        s = e * F.sin(lat)
        lat = math.pi / 2 - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(e / 2)))
    return df.withColumns({"longitude": F.degrees(F.atan2(dx, dy) / n + lam0), "latitude": F.degrees(lat)})


def random_rotation(n: int, seed: int = 0) -> np.ndarray:
    """A random orthogonal matrix of determinant +1."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))
    q = q * np.sign(np.diag(r))
    if np.linalg.det(q) < 0:
        q[:, 0] = -q[:, 0]
    return q
