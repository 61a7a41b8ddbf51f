"""Ordered window features: lags, rolling aggregates, histograms and quantiles of trailing windows, deviations.

Every operator takes an explicit order with a unique last key and, where series are many, the columns that part them; all
features of one call share one exchange and one sort. Without ``partition_by`` a frame is one series and one task, as order demands.
Column names follow the rule ``<what>_<window>_<column>``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemill.common import require

#: Aggregates that a window takes by name.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp, "var": F.var_samp,
    "median": lambda c: F.percentile(c, F.lit(0.5)),
}
Aggregate = str | Callable[[Column], Column]


def _series(partition_by: Sequence[str], order_by: Sequence[str]) -> WindowSpec:
    if not order_by:
        raise ValueError("order_by is needed: a table has no order of its own")
    return Window.partitionBy(*partition_by).orderBy(*order_by)


def _label(operation: Aggregate) -> str:
    return operation if isinstance(operation, str) else getattr(operation, "__name__", "agg")


def _aggregate(operation: Aggregate) -> Callable[[Column], Column]:
    if not isinstance(operation, str):
        return operation
    if operation not in AGGREGATES:
        raise ValueError(f"no aggregate {operation!r}")
    return AGGREGATES[operation]


def shift(df: DataFrame, cols: Sequence[str], shifts: Sequence[int], order_by: Sequence[str], partition_by: Sequence[str] = (), prefix: str = "", suffix: str = "", fill=None, keep: bool = True) -> DataFrame:
    """Lags of columns (leads where negative): ``prefix<n>_<col>``, ``<col>suffix<n>``, else ``<col>_<n>``. Without a row at that distance the value is ``fill``, null by default."""
    require(df, *cols, *order_by, *partition_by)
    w = _series(partition_by, order_by)
    name = lambda c, n: f"{prefix}{n}_{c}" if prefix else f"{c}{suffix}{n}" if suffix else f"{c}_{n}"
    made = [F.lag(c, n, fill).over(w).alias(name(c, n)) for n in shifts for c in cols]
    return df.select("*" if keep else [*partition_by, *order_by], *made)


def rolling(df: DataFrame, cols: Sequence[str], windows: Sequence[int], order_by: Sequence[str], partition_by: Sequence[str] = (), operation: Aggregate = "mean", min_periods: int | None = None, shifted: int = 0) -> DataFrame:
    """Aggregates of the last ``w`` rows, ``<operation>_<w>_<col>``; null until ``min_periods`` values that aren't null (``w`` by default). ``shifted`` rolls and then lags, as one shifted frame in a single pass. ``operation``: a name or a function of a column, a grouped pandas function included."""
    require(df, *cols, *order_by, *partition_by)
    base, agg, made = _series(partition_by, order_by), _aggregate(operation), []
    for w in windows:
        frame = base.rowsBetween(-(w - 1) - shifted, -shifted)
        for c in cols:
            enough = F.count(c).over(frame) >= (w if min_periods is None else min_periods)
            made.append(F.when(enough, agg(F.col(c)).over(frame)).alias(f"{_label(operation)}_{w}_{c}"))
    return df.select("*", *made)


def rolling_time(df: DataFrame, cols: Sequence[str], seconds: Sequence[float], time: str, partition_by: Sequence[str] = (), operation: Aggregate = "mean", min_periods: int = 1) -> DataFrame:
    """Aggregates over the time interval (t - s, t], ``<operation>_<s>s_<col>``. ``time`` should be unique within a series: rows of one instant see each other."""
    require(df, *cols, time, *partition_by)
    agg, made = _aggregate(operation), []
    for s in seconds:
        span = F.expr(f"INTERVAL '{s - 1e-6:.6f}' SECOND")
        label = f"{s:g}s"
        for c in cols:
            over = f"OVER ({'PARTITION BY ' + ', '.join(f'`{p}`' for p in partition_by) if partition_by else ''} ORDER BY `{time}` RANGE BETWEEN INTERVAL '{s - 1e-6:.6f}' SECOND PRECEDING AND CURRENT ROW)"
            if isinstance(operation, str):
                sql = {"mean": "avg", "std": "stddev_samp", "var": "var_samp"}.get(operation, operation)
                value = F.expr(f"{'percentile(`' + c + '`, 0.5)' if operation == 'median' else f'{sql}(`{c}`)'} {over}")
            else:
                raise ValueError("a time range takes aggregates by name")
            made.append(F.when(F.expr(f"count(`{c}`) {over}") >= min_periods, value).alias(f"{operation}_{label}_{c}"))
        del span
    return df.select("*", *made)


def _trailing(c: str, window: int, base: WindowSpec) -> Column:
    return F.collect_list(c).over(base.rowsBetween(-(window - 1), 0))


def histogram(values: Column, bins: int) -> Column:
    """Counts of an array's values in ``bins`` equal parts of its own range, the last part closed; a range of one value is widened by a half on either side; an empty array gives nulls."""
    low, high = F.array_min(values), F.array_max(values)
    lo = F.when(low == high, low - 0.5).otherwise(low)
    width = F.when(low == high, F.lit(1.0)).otherwise(high - low) / bins
    place = lambda x: F.least(F.lit(bins - 1), F.floor((x - lo) / width).cast("int"))
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(values, lambda x: place(x) == b))))


def distribution(df: DataFrame, cols: Sequence[str], window: int, order_by: Sequence[str], partition_by: Sequence[str] = (), bins: int = 4, quantiles: Sequence[float] | None = None) -> DataFrame:
    """Of each row's trailing window: a histogram over the window's own range, ``<col>_bin_<i>``, or, where ``quantiles`` are given, its linear quantiles, ``<col>_quantile_<i>``, zero for a window without values."""
    require(df, *cols, *order_by, *partition_by)
    base = _series(partition_by, order_by)
    if quantiles is not None:
        at = F.array(*(F.lit(float(q)) for q in quantiles))
        made = [(c, F.percentile(c, at).over(base.rowsBetween(-(window - 1), 0))) for c in cols]
        df = df.select("*", *(v.alias(f"__{c}") for c, v in made))
        parts = [F.coalesce(F.col(f"__{c}")[i], F.lit(0.0)).alias(f"{c}_quantile_{i + 1}") for c in cols for i in range(len(quantiles))]
    else:
        df = df.select("*", *(_trailing(c, window, base).alias(f"__{c}") for c in cols)).select("*", *(histogram(F.col(f"__{c}"), bins).alias(f"__h_{c}") for c in cols))
        parts = [F.col(f"__h_{c}")[i].alias(f"{c}_bin_{i + 1}") for c in cols for i in range(bins)]
    return df.select("*", *parts).drop(*(f"__{c}" for c in cols), *(f"__h_{c}" for c in cols))


def strided(df: DataFrame, cols: Sequence[str], window: int, order_by: Sequence[str], partition_by: Sequence[str] = (), operation: Aggregate = "mean") -> DataFrame:
    """Aggregates of full windows of rows, nulls skipped; the first ``window - 1`` rows are null."""
    require(df, *cols, *order_by, *partition_by)
    base, agg = _series(partition_by, order_by), _aggregate(operation)
    full = F.row_number().over(base) >= window
    return df.select("*", *(F.when(full, agg(F.col(c)).over(base.rowsBetween(-(window - 1), 0))).alias(f"{_label(operation)}_{window}_{c}") for c in cols))


def _middle(values: Column, centre: str) -> Column:
    """Mean or median of an array without nulls."""
    n = F.size(values)
    if centre == "mean":
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    ordered = F.array_sort(values)
    half = F.floor((n + 1) / 2).cast("int")
    return (F.element_at(ordered, half) + F.element_at(ordered, F.floor(n / 2).cast("int") + 1)) / 2


def absolute_deviation(values: Column, centre: str = "mean") -> Column:
    """Mean (or median) of the distances from the mean (or median) of an array; null for an empty one."""
    held = F.transform(F.array(_middle(values, centre)), lambda m: _middle(F.transform(values, lambda x: F.abs(x - m)), centre))
    return F.when(F.size(values) > 0, F.element_at(held, 1))


def rolling_deviation(df: DataFrame, cols: Sequence[str], window: int | None, order_by: Sequence[str], partition_by: Sequence[str] = (), centre: str = "mean", full: bool = True, scale: float = 1.0) -> DataFrame:
    """Absolute deviation of trailing windows, ``<centre>_ad_<window>_<col>``; of full windows only unless ``full`` is off. A ``window`` of None expands from the first row."""
    require(df, *cols, *order_by, *partition_by)
    base = _series(partition_by, order_by)
    frame = base.rowsBetween(Window.unboundedPreceding if window is None else -(window - 1), 0)
    tag = "all" if window is None else str(window)
    df = df.select("*", *(F.collect_list(F.col(c).cast("double")).over(frame).alias(f"__{c}") for c in cols), F.row_number().over(base).alias("__row"))
    enough = F.lit(True) if not full or window is None else F.col("__row") >= window
    made = [F.when(enough, absolute_deviation(F.col(f"__{c}"), centre) * scale).alias(f"{centre}_ad_{tag}_{c}") for c in cols]
    return df.select("*", *made).drop("__row", *(f"__{c}" for c in cols))


def differences(df: DataFrame, cols: Sequence[str], prefix: str = "diff_") -> DataFrame:
    """Each column less the one before it in ``cols``: ``<prefix><later>_<earlier>``."""
    require(df, *cols)
    return df.select("*", *((F.col(a) - F.col(b)).alias(f"{prefix}{b}_{a}") for a, b in zip(cols, cols[1:])))


def successive_difference(df: DataFrame, col: str, order_by: Sequence[str], partition_by: Sequence[str] = (), to: str = "diff") -> DataFrame:
    """A column less its value in the row before."""
    require(df, col, *order_by, *partition_by)
    return df.withColumn(to, F.col(col) - F.lag(col).over(_series(partition_by, order_by)))


def date_to_int(date: Column) -> Column:
    """A date as the number yyyymmdd."""
    return F.year(date) * 10000 + F.month(date) * 100 + F.dayofmonth(date)


# Strftime directives and their letters in Spark's patterns.
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%j": "DDD", "%b": "MMM", "%B": "MMMM"}


def text_date_to_int(df: DataFrame, col: str, pattern: str = "%Y-%m-%d") -> DataFrame:
    """A column of dates in text replaced by yyyymmdd numbers; what doesn't parse gives null."""
    require(df, col)
    for a, b in STRFTIME.items():
        pattern = pattern.replace(a, b)
    return df.withColumn(col, date_to_int(F.to_date(F.try_to_timestamp(F.col(col), F.lit(pattern)))))


def daily_resample(df: DataFrame, time: str, cols: Sequence[str], partition_by: Sequence[str] = (), operation: str = "sum") -> DataFrame:
    """One row per series and day from its first to its last; days without rows are null. Days are rolled up before any shuffle, and gaps come from a sequence, so a long series is no group of rows."""
    require(df, time, *cols, *partition_by)
    day = F.to_date(time).alias("day")
    rolled = df.where(F.col(time).isNotNull()).groupBy(*partition_by, day).agg(*(_aggregate(operation)(F.col(c)).alias(c) for c in cols))
    span = rolled.groupBy(*partition_by).agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null")
    days = span.select(*partition_by, F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(rolled, [*partition_by, "day"], "left")
