"""Projections, casts, missing values, joins, top-k, set operations and sampling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.common import bounded_rows, require, small_or_plain

#: Rows of a look-up table sent to every executor at most.
LOOKUP_BROADCAST = 100_000


# -- projections and casts ------------------------------------------------------------------------------------------------


def exclude(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All columns but ``cols``."""
    return df.drop(*cols)


def ratio(a: Column, b: Column) -> Column:
    """``a`` through ``b``, null where ``b`` is zero."""
    return F.try_divide(a, b)


def prefixed(df: DataFrame, prefix: str = "", suffix: str = "", keep: Sequence[str] = ()) -> DataFrame:
    """Columns renamed by prefix and suffix but for those in ``keep``."""
    return df.select(*(F.col(c) if c in keep else F.col(c).alias(f"{prefix}{c}{suffix}") for c in df.columns))


def downcast(df: DataFrame, double_to: str = "float", long_to: str = "int") -> DataFrame:
    """Doubles as floats and longs as ints; a long that doesn't fit gives null."""
    to = {"double": double_to, "bigint": long_to}
    return df.select(*(F.col(c).try_cast(to[t]).alias(c) if t in to else F.col(c) for c, t in df.dtypes))


def rounded_int(value: Column) -> Column:
    """A number as int, halves to the even neighbour."""
    return F.bround(value).cast("int")


def clip_below(value: Column, low: float = 0.0) -> Column:
    """Values below ``low`` raised to it; null stays null."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(low)))


def temporal_split(df: DataFrame, time: str, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Rows before ``cutoff`` and rows from it on; rows without a time are in neither."""
    at = F.lit(cutoff).cast(df.schema[time].dataType)
    return df.where(F.col(time) < at), df.where(F.col(time) >= at)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN as null in every floating column."""
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


# -- missing values -------------------------------------------------------------------------------------------------------


def fill_statistic(df: DataFrame, cols: Sequence[str], how: str = "median", by: Sequence[str] = ()) -> DataFrame:
    """Nulls filled with the median, mean, min or max of the column, or of its group in ``by`` (rows of a null group stay as they are). The statistic is pre-aggregated and joined, so no group becomes one task's rows."""
    require(df, *cols, *by)
    agg = {"median": lambda c: F.percentile(c, F.lit(0.5)), "mean": F.avg, "min": F.min, "max": F.max}[how]
    stats = df.groupBy(*by).agg(*(agg(F.col(c)).alias(f"__{c}") for c in cols))
    if by:
        joined = df.join(small_or_plain(stats, LOOKUP_BROADCAST), list(by), "left")
        return joined.select(*(F.coalesce(c, f"__{c}").alias(c) if c in cols else F.col(c) for c in df.columns))
    values = stats.first()  # one row of one number a column
    return df.select(*(F.coalesce(F.col(c), F.lit(values[f"__{c}"])).alias(c) if c in cols else F.col(c) for c in df.columns))


def group_mode(df: DataFrame, col: str, by: str) -> DataFrame:
    """(by, mode): the most frequent value of each group that isn't null, ties to the largest."""
    require(df, col, by)
    counts = df.where(F.col(col).isNotNull() & F.col(by).isNotNull()).groupBy(by, col).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(by).agg(F.max(F.struct("n", col)).alias("m")).select(by, F.col(f"m.{col}").alias("mode"))


def fill_group_mode(df: DataFrame, col: str, by: str, unseen: str = "unknown") -> DataFrame:
    """Nulls of ``col`` filled with its group's mode; groups without one get ``unseen``."""
    modes = group_mode(df, col, by).withColumnRenamed("mode", "__mode")
    joined = df.join(small_or_plain(modes, LOOKUP_BROADCAST), by, "left")
    return joined.select(*(F.coalesce(F.col(col), F.col("__mode"), F.lit(unseen)).alias(col) if c == col else F.col(c) for c in df.columns))


def fill_neighbours(df: DataFrame, cols: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Nulls filled with the next value of the series, and those at its end with the last one."""
    require(df, *cols, *order_by, *partition_by)
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    ahead, back = w.rowsBetween(0, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, 0)
    fill = lambda c: F.coalesce(F.first(c, ignorenulls=True).over(ahead), F.last(c, ignorenulls=True).over(back)).alias(c)
    return df.select(*(fill(c) if c in cols else F.col(c) for c in df.columns))


# -- joins and look-ups ---------------------------------------------------------------------------------------------------


def left_join_all(frames: Sequence[DataFrame], on: Sequence[str], suffixes: Sequence[str] | None = None) -> DataFrame:
    """The first frame left-joined with each further one on its keys; ``suffixes`` (one a frame) tell equal columns apart."""
    if suffixes:
        frames = [prefixed(f, suffix=s, keep=on) for f, s in zip(frames, suffixes)]
    return reduce(lambda a, b: a.join(b, list(on), "left"), frames)


def mapped(df: DataFrame, col: str, mapping: dict, default=None, to: str | None = None) -> DataFrame:
    """A column through a dictionary; values that aren't in it give ``default``."""
    require(df, col)
    spark = df.sparkSession
    value_type = next((type(v) for v in mapping.values()), str)
    kind = {int: "bigint", float: "double", bool: "boolean"}.get(value_type, "string")
    rows = spark.createDataFrame([(k, v) for k, v in mapping.items()], f"__k {df.schema[col].dataType.simpleString()}, __v {kind}")
    out = df.join(small_or_plain(rows, LOOKUP_BROADCAST), F.col(col) == F.col("__k"), "left").withColumn(to or col, F.coalesce("__v", F.lit(default)))
    return out.drop("__k", "__v")


def concat_flagged(frames: Sequence[DataFrame], flag: str = "part", names: Sequence[str] | None = None) -> DataFrame:
    """Frames under each other with a column that tells them apart; columns a frame lacks are null."""
    tagged = [f.withColumn(flag, F.lit(names[i] if names else i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


# -- order, top-k, sampling -----------------------------------------------------------------------------------------------


def top_k(df: DataFrame, k: int, order_by: Sequence[Column], partition_by: Sequence[str], ties: bool = False) -> DataFrame:
    """The first ``k`` rows of each group by an order (all tied ones too if ``ties``). Spark keeps only k rows a group before it shuffles."""
    rank = F.rank() if ties else F.row_number()
    return df.withColumn("__rank", rank.over(Window.partitionBy(*partition_by).orderBy(*order_by))).where(F.col("__rank") <= k).drop("__rank")


def positions(df: DataFrame, order_by: Sequence[str], to: str = "position") -> DataFrame:
    """Rows numbered from zero by a total order, without one task that sorts them all: ranges are sorted apart, and the counts of those before give each its offset."""
    require(df, *order_by)
    ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by).withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id())
    from tidemill.common import written

    kept = written(ranged)
    counts = kept.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = counts.select("__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return kept.join(F.broadcast(offsets), "__part").withColumn(to, F.col("__offset") + F.col("__id") - F.col("__first")).drop("__part", "__id", "__first", "__offset")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in an order drawn by hashing a key with a seed: the same for every partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)


#: Classes of hashes by which the cut of ``undersampled`` is found.
HASH_CLASSES = 1 << 16


def undersampled(df: DataFrame, label: str, key: str, share: float = 1.0, seed: int = 42) -> tuple[DataFrame, float]:
    """The majority class of a binary label cut to ``share`` times the minority's size, by hash order of ``key``; and the ratio beta by which it was cut.

    Rows are counted by class of their hash; classes below the cut are kept whole, and only the one class the cut falls into is sorted.
    """
    counts = {r[0]: r[1] for r in bounded_rows(df.where(F.col(label).isNotNull()).groupBy(label).count(), 2, "values of a binary label")}
    if len(counts) != 2:
        raise ValueError("a binary label is needed")
    (minor, n_minor), (major, n_major) = sorted(counts.items(), key=lambda x: (x[1], str(x[0])))
    keep = min(n_major, int(n_minor * share))
    h, part = (f"__{c}_{label}" for c in ("h", "part"))
    hashed = df.where(F.col(label) == major).withColumn(h, F.xxhash64(F.lit(seed), key)).withColumn(part, F.shiftright(F.col(h), 48))
    left, cut = keep, None
    for r in sorted(bounded_rows(hashed.groupBy(part).count(), HASH_CLASSES, "classes of hashes")):
        cut = r[0]
        if r[1] >= left:
            break
        left -= r[1]
    below = hashed.where(F.col(part) < F.lit(cut))
    at = hashed.where(F.col(part) == F.lit(cut)).orderBy(h, key).limit(left)
    return df.where(F.col(label) == minor).unionByName(below.unionByName(at).drop(h, part)), keep / n_major
