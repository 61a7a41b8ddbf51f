"""Categorical features: aggregates carried to rows, projections, encoders."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.common import require, small_or_plain
from tidemill.operators.relational import positions
from tidemill.operators.timeseries import Aggregate, _aggregate, _label

#: Rows of statistics sent to every executor at most.
STATISTICS_BROADCAST = 200_000


def project(df: DataFrame, categories: Sequence[str], values: Sequence[str], operation: Aggregate = "mean", only: bool = False) -> DataFrame:
    """For each pair a column ``<operation>_<value>_per_<category>``: the aggregate of the category's rows, null for a null category. Statistics are pre-aggregated once a category and joined, so a category with a third of all rows is one row of a small table. ``only`` leaves categories and projections."""
    require(df, *categories, *values)
    agg, out = _aggregate(operation), df
    for c in categories:
        names = {v: f"{_label(operation)}_{v}_per_{c}" for v in values}
        stats = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("__key")).agg(*(agg(F.col(v)).alias(n) for v, n in names.items()))
        out = out.join(small_or_plain(stats, STATISTICS_BROADCAST), F.col(c) == F.col("__key"), "left").drop("__key")
    made = [f"{_label(operation)}_{v}_per_{c}" for c in categories for v in values]
    return out.select(*(categories if only else df.columns), *made)


class TagEncoder:
    """Ids of tags in the order they are first seen; unknown tags give ``missing``, unknown ids decode to null."""

    def __init__(self, missing: int = -1):
        self.missing = missing
        self.tags: DataFrame | None = None

    def fit(self, df: DataFrame, col: str, order_by: Sequence[str]) -> TagEncoder:
        """Learns (tag, id) from the rows in the given order; nulls are no tags."""
        require(df, col, *order_by)
        first = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("tag")).agg(F.min(F.struct(*order_by)).alias("first"))
        self.tags = positions(first, ["first", "tag"], "id").select("tag", F.col("id").cast("int").alias("id"))
        return self

    def _fitted(self) -> DataFrame:
        if self.tags is None:
            raise ValueError("fit comes first")
        return small_or_plain(self.tags, STATISTICS_BROADCAST)

    def transform(self, df: DataFrame, col: str, to: str = "id") -> DataFrame:
        require(df, col)
        tags = self._fitted().select(F.col("tag").alias("__tag"), F.col("id").alias("__id"))
        return df.join(tags, F.col(col) == F.col("__tag"), "left").withColumn(to, F.coalesce("__id", F.lit(self.missing))).drop("__tag", "__id")

    def inverse(self, df: DataFrame, col: str, to: str = "tag") -> DataFrame:
        require(df, col)
        tags = self._fitted().select(F.col("tag").alias("__tag"), F.col("id").alias("__id"))
        return df.join(tags, F.col(col) == F.col("__id"), "left").withColumn(to, F.col("__tag")).drop("__tag", "__id")


def coded(value: Column, cases: Sequence[tuple[str, int]], default: int = 0, whole: bool = False) -> Column:
    """A code of the first case that the text contains (or equals, if ``whole``)."""
    out: Column | None = None
    for text, code in cases:
        hit = value == text if whole else value.contains(text)
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return F.lit(default) if out is None else out.otherwise(default)


def first_number(value: Column) -> Column:
    """The first blank-separated part of a text as an int, null where it is none."""
    return F.split(value, " ")[0].try_cast("int")


def calendar(df: DataFrame, date: str) -> DataFrame:
    """Year, month, ISO week and day of the week (Monday 0) of a date."""
    require(df, date)
    d = F.col(date)
    return df.withColumns({"year": F.year(d), "month": F.month(d), "week": F.weekofyear(d), "weekday": F.weekday(d)})


def pad_left(ids: Column, length: int, pad: int = 0) -> Column:
    """An array brought to ``length``: its last elements, padded in front."""
    n = F.size(ids)
    padding = F.array_repeat(F.lit(pad).cast("bigint"), F.greatest(F.lit(0), F.lit(length) - n).cast("int"))
    return F.concat(padding, F.slice(ids, F.greatest(F.lit(1), n - length + 1), F.lit(length)).cast("array<bigint>"))


def histogram_bucket(value: Column, edges: Sequence[float], counts: Sequence[float], normalized: bool = False, cumulative: str | None = None) -> Column:
    """The amount of the bucket [edge, next edge) that holds ``value``: 0 outside, and 0 from the last edge on. ``normalized`` divides by all; ``cumulative`` (asc, desc) sums the buckets up to it or from it."""
    amounts = list(counts)
    if cumulative == "asc":
        amounts = [sum(counts[: i + 1]) for i in range(len(counts))]
    elif cumulative == "desc":
        amounts = [sum(counts[i:]) for i in range(len(counts))]
    total = sum(counts) if normalized else 1
    out = F.lit(0.0)
    for lo, hi, n in zip(edges, edges[1:], amounts):
        out = F.when((value >= lo) & (value < hi), F.lit(n / total)).otherwise(out)
    return out


def transform_with(df: DataFrame, functions: dict[str, Callable[[DataFrame], Column]]) -> DataFrame:
    """Columns from functions of the frame, all at once."""
    return df.withColumns({k: f(df) for k, f in functions.items()})
