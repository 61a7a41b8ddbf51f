"""Implausible readings (problem 3): an isolation forest per source and explicit rules.

Readings are numbered within their source without sorting a source in one task: they are ranked in buckets of time, and the
buckets' counts give each bucket's offset. Each source has one profile: usual noise and daily course, which are exact medians
over all its readings, and a forest of random splits on level, difference, seasonal and run-length features, each tree of
which draws its readings anew from all of the source's, as an isolation forest does. A source of at most STRETCH readings is
one group. A longer one is cut into stretches of bounded size with some readings of overlap, so that a source with a third of
all rows is as many tasks as it needs: its medians are found by counting values in bins, then the values of the middle bins,
and its profile goes to all its stretches. Both ways give the same profile, so no result depends on where the stretches are
cut. Physical limits and stuck runs are rules of their own; a spike must be isolated by the forest and then pass an exact
check against the level around it.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.common import checkpointed, require, small_or_plain, written
from tidemill.functions.times import micros

#: Readings of a stretch, and of the overlap on either side.
STRETCH, OVERLAP = 20_000, 32
#: Seconds of a bucket in which readings are ranked by one sort.
BUCKET_SECONDS = 21_600
#: Trees of a source's forest and readings that each draws from all of the source's.
TREES, SAMPLE = 20, 128
#: Of what medians are taken: the levels of each hour, then the distances from the level. Low bits of a value that its bin leaves out.
HOURS, KINDS, BIN = 24, 25, 45
#: Readings on either side that make the level, least run of a stuck value, longest spike.
SIDE, STUCK, SPIKE = 4, 10, 3
#: A spike leaves the level by at least this share of it and this many times the usual noise.
SHARE, NOISE = 0.3, 3.0
#: Least isolation score of a spike, by which the forest decides whether that is far more than usual; one half is the score of an average reading.
ISOLATED = 0.5
BUCKETS_BROADCAST = 200_000


def numbered(readings: DataFrame) -> DataFrame:
    """(reading_id, source_id, ts, value, pos, total): each distinct reading with a value, numbered within its source by timestamp, and how many its source has; deliveries of one reading are collapsed."""
    r = readings.select("source_id", F.col("reading_id").cast("long").alias("reading_id"), "timestamp", F.col("value").cast("double").alias("value")).where("value is not null and not isnan(value) and timestamp is not null and source_id is not null")
    r = r.select("source_id", "reading_id", micros(F.col("timestamp")).alias("ts"), "value").withColumn("bucket", F.floor(F.col("ts") / (BUCKET_SECONDS * 1_000_000)).cast("long"))
    w = Window.partitionBy("source_id", "bucket").orderBy("ts", "reading_id", "value")
    first = r.withColumn("again", F.lag("reading_id").over(w).eqNullSafe(F.col("reading_id"))).where("not again").drop("again")
    ranked = written(first.withColumn("rank", F.row_number().over(w)))
    counts = ranked.groupBy("source_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("source_id", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy("source_id")).alias("total"))
    return ranked.join(small_or_plain(offsets, BUCKETS_BROADCAST), ["source_id", "bucket"]).select("reading_id", "source_id", "ts", "value", (F.col("offset") + F.col("rank") - 1).alias("pos"), "total")


def _runs(values: np.ndarray) -> np.ndarray:
    """Length of the run of equal successive values that each is part of."""
    edge = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True])
    return np.repeat(np.diff(edge), np.diff(edge))


def measures(ts: np.ndarray, values: np.ndarray) -> dict[str, np.ndarray]:
    """What is measured of each reading of a stretch in order: the level around it, its relative distance from it (signed), its relative steps to both neighbours, its hour and the length of its run as far as OVERLAP."""
    finite = np.where(np.isfinite(values), values, np.nan)
    level = pd.Series(finite).rolling(2 * SIDE + 1, center=True, min_periods=1).median().to_numpy()
    with np.errstate(divide="ignore", invalid="ignore"):
        away = np.where(level != 0, (finite - level) / np.abs(level), np.where(finite == 0, 0.0, np.inf))
    away = np.where(np.isfinite(values), away, np.inf)
    step = np.abs(np.diff(finite, prepend=finite[:1]))
    both = np.minimum(step, np.r_[step[1:], 0.0]) / np.maximum(np.abs(level), 1e-300)
    return {"level": level, "away": away, "both": both, "hour": (ts // 3_600_000_000 % 24).astype(np.int64), "run": np.minimum(_runs(values), OVERLAP)}


def draws(n: int, seed: int = 11) -> list[np.ndarray]:
    """For each tree, the positions of the readings it is grown from, drawn without repeats from all ``n``."""
    return [np.random.default_rng([seed, tree]).choice(n, min(SAMPLE, n), replace=False) for tree in range(TREES)]


def _ranked(of: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Kind and value of all that medians are taken of."""
    away = np.abs(of["away"])
    known, usual = np.isfinite(of["level"]), np.isfinite(away)
    return np.r_[of["hour"][known], np.full(usual.sum(), HOURS)], np.r_[of["level"][known], away[usual]]


def _key(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of ``values``."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def _value(keys: np.ndarray) -> np.ndarray:
    return np.where(keys < 0, keys ^ np.int64(2**63 - 1), keys).view(np.float64)


def medians(of: dict[str, np.ndarray]) -> np.ndarray:
    """Median of each kind, NaN where nothing is of it."""
    kind, value = _ranked(of)
    return pd.Series(value).groupby(kind).median().reindex(range(KINDS)).to_numpy()


class Profile:
    """Usual noise, daily course and isolation forest of one source, from its ``medians`` and those of its readings that ``drawn`` picks from ``sample`` for each tree."""

    def __init__(self, middle: np.ndarray, sample: dict[str, np.ndarray], drawn: list[np.ndarray]):
        self.noise = max(1.4826 * float(np.nan_to_num(middle[HOURS])), 1e-9)
        self.course = middle[:HOURS]
        self.forest = Forest(self.features(sample), drawn)

    def features(self, of: dict[str, np.ndarray]) -> np.ndarray:
        """Level, difference, seasonal and run-length feature of each reading, by this source's usual noise and course."""
        course = self.course[of["hour"]]
        with np.errstate(divide="ignore", invalid="ignore"):
            seasonal = np.abs(of["level"] * (1 + of["away"]) - course) / np.abs(course)
        table = np.column_stack([np.abs(of["away"]) / self.noise, of["both"] / self.noise, seasonal, of["run"].astype(float)])
        return np.log1p(np.nan_to_num(table, nan=0.0, posinf=1e9, neginf=0.0).clip(0, 1e9))

    def scores(self, of: dict[str, np.ndarray]) -> np.ndarray:
        return self.forest.scores(self.features(of))


def _path(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` points."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class Forest:
    """Trees of random splits, each grown from the rows of ``table`` that ``drawn`` has for it, as many for every tree. All trees grow together, one level at a time; node n of a tree has its children at 2n + 1 and 2n + 2."""

    def __init__(self, table: np.ndarray, drawn: list[np.ndarray], seed: int = 11):
        random = np.random.default_rng(seed)
        trees, self.size = len(drawn), len(drawn[0])
        deepest = max(1, int(np.ceil(np.log2(max(2, self.size)))))
        nodes = 2 ** (deepest + 1) - 1
        self.feature, self.cut = np.full((trees, nodes), -1), np.zeros((trees, nodes))
        self.path = np.repeat(np.floor(np.log2(np.arange(nodes) + 1))[None, :], trees, axis=0)
        if self.size < 2:
            return
        points, paths = table[np.concatenate(drawn)], np.array([_path(n) for n in range(self.size + 1)])
        tree, node = np.repeat(np.arange(trees), self.size), np.zeros(trees * self.size, dtype=np.int64)
        for depth in range(deepest + 1):
            order = np.argsort(tree * nodes + node, kind="stable")
            points, tree, node = points[order], tree[order], node[order]
            edge = np.flatnonzero(np.r_[True, np.diff(tree * nodes + node) != 0])
            count = np.diff(np.r_[edge, len(node)])
            least, most = np.minimum.reduceat(points, edge), np.maximum.reduceat(points, edge)
            wide = most > least
            parted = wide.any(axis=1) & (depth < deepest)
            at = tree[edge], node[edge]
            self.path[at] = depth + paths[count]
            pick = np.where(wide, random.random(wide.shape), -1.0).argmax(axis=1)
            each = np.arange(len(edge))
            cut = least[each, pick] + random.random(len(edge)) * (most[each, pick] - least[each, pick])
            self.feature[at], self.cut[at] = np.where(parted, pick, -1), cut
            of = np.repeat(each, count)
            node = 2 * node + 1 + (points[np.arange(len(points)), pick[of]] >= cut[of])
            on = parted[of]
            points, tree, node = points[on], tree[on], node[on]
            if not len(points):
                break

    def scores(self, table: np.ndarray) -> np.ndarray:
        """Isolation score of each row: 2 ** -(mean path / usual path). The rows are passed down each tree in index arrays."""
        if self.size < 2:
            return np.full(len(table), 0.5)
        total = np.zeros(len(table))
        for feature, cut, path in zip(self.feature, self.cut, self.path):
            at, rows = np.zeros(len(table), dtype=np.int64), np.arange(len(table))
            while len(rows):
                here = at[rows]
                leaf = feature[here] < 0
                total[rows[leaf]] += path[here[leaf]]
                rows, here = rows[~leaf], here[~leaf]
                at[rows] = 2 * here + 1 + (table[rows, feature[here]] >= cut[here])
        return 2.0 ** -(total / len(self.path) / _path(self.size))


def isolation_scores(table: np.ndarray, seed: int = 11) -> np.ndarray:
    """Isolation score of each row in a forest grown from the rows themselves."""
    return Forest(table, draws(len(table), seed), seed).scores(table)


def judged(ts: np.ndarray, values: np.ndarray, profile: Profile | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Score, impossible, spike and stuck of each reading of one stretch in order, by its source's ``profile`` (its own if none is given)."""
    of = measures(ts, values)
    profile = Profile(medians(of), of, draws(len(values))) if profile is None else profile
    scores = profile.scores(of)
    impossible = (values < 0) | np.isinf(values)
    stuck = _runs(values) >= STUCK
    far = (np.abs(of["away"]) >= np.maximum(SHARE, NOISE * profile.noise)) & (scores >= ISOLATED)
    spike = np.zeros(len(values), bool)
    edge = np.flatnonzero(np.diff(np.r_[False, far, False].astype(np.int8)))
    for a, b in zip(edge[::2], edge[1::2]):
        # gone for at most SPIKE readings, with readings before, and back after
        if b - a <= SPIKE and a > 0 and b < len(values):
            spike[a:b] = True
    return scores, impossible, spike, stuck


_OUT = "reading_id long, source_id string, score double, impossible boolean, spike boolean, stuck boolean"


def scored_readings(readings: DataFrame) -> DataFrame:
    """(reading_id, source_id, score, impossible, spike, stuck) of each distinct reading with a value.

    impossible: below zero or infinite. spike: one to three successive readings that leave the level around them by at least SHARE of it and NOISE times
    the usual noise and are isolated in their source's forest (score of at least ISOLATED), after which the source is back. stuck: part of STUCK or more successive readings of exactly one value.
    Readings without value, timestamp or source get no row; ties in time are ordered by reading_id; an empty table gives none.
    """
    require(readings, "reading_id", "source_id", "timestamp", "value")
    placed = numbered(readings)
    at, stretch = F.pmod(F.col("pos"), F.lit(STRETCH)), F.floor(F.col("pos") / STRETCH).cast("long")
    near = F.filter(F.array(stretch, F.when((at < OVERLAP) & (stretch > 0), stretch - 1), F.when(at >= STRETCH - OVERLAP, stretch + 1)), lambda s: s.isNotNull())
    spread = placed.where(F.col("total") > STRETCH).select("*", F.explode(near).alias("stretch")).where(F.col("stretch") * STRETCH < F.col("total")).groupBy("source_id", "stretch")

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        score, impossible, spike, stuck = judged(group["ts"].to_numpy(), group["value"].to_numpy())
        return pd.DataFrame({"reading_id": group["reading_id"].to_numpy(), "source_id": key[0], "score": score, "impossible": impossible, "spike": spike, "stuck": stuck})

    def owned(key: tuple, group: pd.DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        group = group.sort_values("pos")
        pos = group["pos"].to_numpy()
        own = pos // STRETCH == key[1]
        return pos[own], {c: x[own] for c, x in measures(group["ts"].to_numpy(), group["value"].to_numpy()).items()}

    def counted(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        pos, of = owned(key, group)
        kind, value = _ranked(of)
        total = int(group["total"].iloc[0])
        drawn = np.isin(pos, np.concatenate(draws(total)))
        bins = pd.DataFrame({"kind": kind, "bin": _key(value) >> BIN}).value_counts().rename("n").reset_index().assign(sample=None)
        bins.loc[len(bins)] = [-1, 0, total, pickle.dumps((pos[drawn], {c: x[drawn] for c, x in of.items()}))]
        return bins.assign(source_id=key[0], stretch=key[1])[["source_id", "stretch", "kind", "bin", "n", "sample"]]

    def middles(key: tuple, group: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        kind, value = _ranked(owned(key, group)[1])
        keys = pd.DataFrame({"kind": kind, "bin": _key(value) >> BIN, "key": _key(value)}).merge(wanted[["kind", "bin"]], on=["kind", "bin"])
        return keys[["kind", "key"]].value_counts().rename("n").reset_index().assign(source_id=key[0])[["source_id", "kind", "key", "n"]]

    def profiled(key: tuple, samples: pd.DataFrame, middle: pd.DataFrame) -> pd.DataFrame:
        parts = [pickle.loads(x) for x in samples.sort_values("stretch")["sample"]]
        pos, of = np.concatenate([p for p, _ in parts]), {c: np.concatenate([x[c] for _, x in parts]) for c in parts[0][1]}
        found = pd.Series((_value(middle["low"].to_numpy()) + _value(middle["high"].to_numpy())) / 2, middle["kind"]).reindex(range(KINDS)).to_numpy()
        drawn = [np.searchsorted(pos, d) for d in draws(int(samples["n"].iloc[0]))]
        return pd.DataFrame({"source_id": [key[0]], "profile": [pickle.dumps(Profile(found, of, drawn))]})

    # counts of bins tell in which the two middle values of each kind lie, counts of those bins' values tell which they are
    first = written(spread.applyInPandas(counted, "source_id string, stretch long, kind long, bin long, n long, sample binary"))
    samples, kinds = first.where("kind < 0"), Window.partitionBy("source_id", "kind")
    parts = samples.select(F.col("source_id").alias("of"), F.col("stretch").alias("part"))
    bins = first.where("kind >= 0").groupBy("source_id", "kind", "bin").agg(F.sum("n").alias("n"))
    bins = bins.select("*", (F.sum("n").over(kinds.orderBy("bin")) - F.col("n")).alias("before"), F.sum("n").over(kinds).alias("all"))
    middle = checkpointed(bins.withColumns({"low": F.floor((F.col("all") - 1) / 2), "high": F.floor(F.col("all") / 2)}).where("before <= high and before + n > low"))
    wanted = parts.join(middle.select(F.col("source_id").alias("of"), "kind", "bin"), "of")
    keys = spread.cogroup(wanted.groupBy("of", "part")).applyInPandas(middles, "source_id string, kind long, key long, n long").groupBy("source_id", "kind", "key").agg(F.sum("n").alias("n"))
    ranks = middle.groupBy("source_id", "kind").agg(F.min("before").alias("before"), F.min("low").alias("low"), F.min("high").alias("high"))
    upto = keys.join(ranks, ["source_id", "kind"]).withColumn("upto", F.col("before") + F.sum("n").over(kinds.orderBy("key")))
    both = upto.groupBy("source_id", "kind").agg(F.min(F.expr("if(upto > low, key, null)")).alias("low"), F.min(F.expr("if(upto > high, key, null)")).alias("high"))
    profiles = written(samples.groupBy("source_id").cogroup(both.groupBy("source_id")).applyInPandas(profiled, "source_id string, profile binary"))
    stretches = parts.join(profiles.withColumnRenamed("source_id", "of"), "of")

    def judge(key: tuple, group: pd.DataFrame, profile: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        score, impossible, spike, stuck = judged(group["ts"].to_numpy(), group["value"].to_numpy(), pickle.loads(profile["profile"].iloc[0]))
        own = (group["pos"] // STRETCH == key[1]).to_numpy()
        out = pd.DataFrame({"reading_id": group["reading_id"].to_numpy(), "source_id": key[0], "score": score, "impossible": impossible, "spike": spike, "stuck": stuck})
        return out[own]

    whole = placed.where(F.col("total") <= STRETCH).groupBy("source_id").applyInPandas(one, _OUT)
    return whole.unionByName(spread.cogroup(stretches.groupBy("of", "part")).applyInPandas(judge, _OUT))


def implausible(readings: DataFrame) -> DataFrame:
    """(reading_id): readings that are impossible, part of a spike or stuck."""
    return scored_readings(readings).where("impossible or spike or stuck").select("reading_id")
