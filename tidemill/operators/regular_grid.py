"""Irregular readings onto a regular grid (problem 2), gaps filled by low-rank factorisation.

Every due period of every flight becomes a cell. A cell with readings keeps the last one's value exactly. For the others,
the source-by-time matrix of mean log values is factorised by alternating least squares until the fit stands: one matrix for
each step length, its columns as fine as the due periods. Columns lie whole in blocks of bounded size, written once; a round
is one pass over them that solves each column by its sources' factors and adds up five sums a source, which are all that is
shuffled, so a source with a third of all rows is no larger a group than any other. A gap is filled where its source was
observed well enough and enough other sources were in its own column, else it stays marked as missing.
"""

from __future__ import annotations

import pickle
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.common import require, small_or_plain, written
from tidemill.functions.times import clock, micros

#: Rows of flights, of blocks' spans and of sources' factors sent to every executor at most; more are joined by shuffle.
FLIGHTS_BROADCAST, SPANS_BROADCAST, FACTORS_BROADCAST = 20_000, 100_000, 1_000_000
#: Cells of a block at most, unless a single column has more, and columns of a block at most.
BLOCK, COLUMNS = 32_768, 4096
#: Periods of one stretch of a flight that one row of a task unfolds to.
STRETCH = 4096


def due_periods(flights: DataFrame) -> DataFrame:
    """(flight_id, source_id, step, k, at): each due period of each flight, ``at`` its start in microseconds. Flights without a positive step or duration have none."""
    step, first, last = F.col("step_seconds").cast("long") * 1_000_000, micros(F.col("starts_at")), micros(F.col("ends_at"))
    f = flights.where("step_seconds > 0 and ends_at > starts_at").select("flight_id", "source_id", step.alias("step"), first.alias("first"), F.ceil((last - first) / step).cast("long").alias("n"))
    parts = f.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(STRETCH).cast("long"))).alias("from")).repartition("flight_id", "from")
    cells = parts.select("*", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + STRETCH, F.col("n")) - 1)).alias("k"))
    return cells.select("flight_id", "source_id", "step", "k", (F.col("first") + F.col("k") * F.col("step")).alias("at"))


def observed_cells(readings: DataFrame, flights: DataFrame) -> DataFrame:
    """(flight_id, source_id, step, k, at, ts, value) of each reading with a value (neither null nor NaN) that lies in a flight of its source; two-sided bounds join on source, flights broadcast while few."""
    f = flights.where("step_seconds > 0 and ends_at > starts_at").select("flight_id", "source_id", (F.col("step_seconds").cast("long") * 1_000_000).alias("step"), micros(F.col("starts_at")).alias("first"), micros(F.col("ends_at")).alias("last"))
    r = readings.select("source_id", F.col("timestamp"), F.col("value").cast("double").alias("value")).where("value is not null and not isnan(value) and timestamp is not null").select("source_id", micros(F.col("timestamp")).alias("ts"), "value")
    met = r.join(small_or_plain(f, FLIGHTS_BROADCAST), "source_id").where("ts >= first and ts < last")
    k = F.floor((F.col("ts") - F.col("first")) / F.col("step")).cast("long")
    return met.select("flight_id", "source_id", "step", k.alias("k"), (F.col("first") + k * F.col("step")).alias("at"), "ts", "value")


def cells(readings: DataFrame, flights: DataFrame) -> DataFrame:
    """(flight_id, source_id, step, k, at, value): every due period with its last value or null; due periods and readings meet in one pre-aggregated grouping instead of a join."""
    due = due_periods(flights).select("*", F.lit(None).cast("long").alias("ts"), F.lit(None).cast("double").alias("value"))
    both = due.unionByName(observed_cells(readings, flights))
    last = F.max(F.when(F.col("ts").isNotNull(), F.struct("ts", "value")))
    return both.groupBy("flight_id", "source_id", "step", "k", "at").agg(last.alias("last")).select("flight_id", "source_id", "step", "k", "at", F.col("last.value").alias("value"))


def _blocks(matrix: DataFrame) -> DataFrame:
    """(width, chunk, part, names, pack): ``matrix`` (source_id, width, col, y) in blocks of successive whole columns. ``pack`` has the columns, then source, column and mean of each cell with a value, then source and column of each cell that is only to be filled (y null)."""
    chunk = F.floor(F.col("col") / COLUMNS).cast("long")
    fullest = matrix.groupBy("width", "col").agg(F.count(F.lit(1)).alias("n")).groupBy("width", chunk.alias("chunk")).agg(F.max("n").alias("n"))
    spans = fullest.select("width", "chunk", F.greatest(F.lit(1).cast("long"), F.floor(F.lit(BLOCK) / F.col("n")).cast("long")).alias("span"))
    placed = matrix.withColumn("chunk", chunk).join(small_or_plain(spans, SPANS_BROADCAST), ["width", "chunk"])
    placed = placed.select("width", "chunk", F.floor(F.pmod(F.col("col"), F.lit(COLUMNS)) / F.col("span")).cast("long").alias("part"), "source_id", "col", "y")

    def packed(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group[group["source_id"].notna()]
        source, names = pd.factorize(group["source_id"])
        order = np.argsort(names)
        source, names = np.argsort(order)[source] if len(names) else source, names[order]
        cols, column = np.unique(group["col"].to_numpy(), return_inverse=True)
        y, place = group["y"].to_numpy(dtype=float), column * max(1, len(names)) + source
        seen = ~np.isnan(y)
        order = np.lexsort((y[seen], place[seen]))
        y, at = y[seen][order], place[seen][order]
        edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, dtype=np.int64)
        mean = np.add.reduceat(y, edge) / np.diff(np.r_[edge, len(y)]) if len(at) else y
        split = lambda x: ((x % max(1, len(names))).astype(np.int32), (x // max(1, len(names))).astype(np.int32))
        return pd.DataFrame({"width": [key[0]], "chunk": [key[1]], "part": [key[2]], "names": [list(names)], "pack": [pickle.dumps((cols, *split(at[edge]), mean, *split(np.unique(place[~seen]))))]})

    name = matrix.schema["source_id"].dataType.simpleString()
    return written(placed.groupBy("width", "chunk", "part").applyInPandas(packed, f"width long, chunk long, part long, names array<{name}>, pack binary"))


_MODEL = ["mean", "lo", "hi", "cells", "u1", "u2"]


def _over(blocks: DataFrame, model: DataFrame, of: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """Rows that ``of`` (width, names, pack, factors) makes of each block; factors has a row of ``_MODEL`` for each of the block's sources, NaN where ``model`` (source_id, width, ...) has none. Up to FACTORS_BROADCAST rows of the model go to all executors, else it is joined to the blocks."""
    few = model.select("source_id", "width", *_MODEL).limit(FACTORS_BROADCAST + 1).toArrow().to_pandas()
    if len(few) <= FACTORS_BROADCAST:
        by_width = {w: (pd.Index(g["source_id"]), g[_MODEL].to_numpy(dtype=float)) for w, g in few.groupby("width")}
        sent = model.sparkSession.sparkContext.broadcast(by_width)
        given = blocks.select("width", "names", "pack")
    else:
        block = ["width", "chunk", "part"]
        link = blocks.select(*block, F.explode("names").alias("source_id")).join(model, ["source_id", "width"])
        given = blocks.join(link.groupBy(*block).agg(F.collect_list(F.struct("source_id", *_MODEL)).alias("model")), block, "left").select("width", "names", "pack", "model")
        sent = None

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                if sent is not None:
                    index, table = sent.value.get(row.width, (pd.Index([]), np.zeros((0, len(_MODEL)))))
                else:
                    own = [] if row.model is None else list(row.model)
                    index, table = pd.Index([m["source_id"] for m in own]), np.array([[m[c] for c in _MODEL] for m in own], dtype=float).reshape(-1, len(_MODEL))
                at = index.get_indexer(pd.Index(list(row.names))) if len(index) and len(row.names) else np.full(len(row.names), -1)
                factors = np.vstack([table, np.full(len(_MODEL), np.nan)])[at]
                yield of(row.width, list(row.names), pickle.loads(row.pack), factors)

    return given.mapInPandas(each, schema)


def _solved(of: np.ndarray, n: int, e: np.ndarray, x: np.ndarray, y: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Two coefficients for each of ``n`` columns that explain residual ``e`` by the sources' factors ``x`` and ``y``: ridge regression from five sums. Last, what the columns' penalised squares fall by."""
    a, b, c = np.bincount(of, x * x, n) + ridge, np.bincount(of, x * y, n), np.bincount(of, y * y, n) + ridge
    p, q = np.bincount(of, e * x, n), np.bincount(of, e * y, n)
    det = a * c - b * b
    one, two = (c * p - b * q) / det, (a * q - b * p) / det
    return one, two, float((p * one + q * two).sum())


def _fitted(blocks: DataFrame, name: str, tolerance: float = 1e-3, rounds: int = 30, ridge: float = 0.1) -> DataFrame:
    """(source_id, width, mean, lo, hi, cells, u1, u2): the sources' side of the factorisation of ``blocks``, from which each column's side follows.

    Columns start from the daily course, which each round then corrects. Rounds end when one lowers the penalised squares,
    which never rise, by at most ``tolerance`` of the sum of squares; a warning says if ``rounds`` were not enough.
    """
    key = f"source_id {name}, width long"

    def ranged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                _, source, _, y, _, _ = pickle.loads(row.pack)
                yield pd.DataFrame({"source_id": list(row.names), "width": row.width}).join(pd.DataFrame({"y": y}).groupby(source)["y"].agg(sum="sum", lo="min", hi="max", cells="count"), how="inner")

    ranges = blocks.select("width", "names", "pack").mapInPandas(ranged, f"{key}, sum double, lo double, hi double, cells long")
    ranges = ranges.groupBy("source_id", "width").agg((F.sum("sum") / F.sum("cells")).alias("mean"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("cells").alias("cells"))
    model = written(ranges.withColumns({"u1": F.lit(0.0), "u2": F.lit(0.0)}))

    def stepped(first: bool) -> Callable[..., pd.DataFrame]:
        def of(width: int, names: list, pack: tuple, factors: np.ndarray) -> pd.DataFrame:
            cols, source, column, y, _, _ = pack
            e = y - factors[source, 0]
            if first:
                turn = cols * width % 86400 / 86400.0 * 6.283185307179586
                v1, v2, gain = np.cos(turn), np.sin(turn), float((e * e).sum())
            else:
                v1, v2, gain = _solved(column, len(cols), e, factors[source, 4], factors[source, 5], ridge)
            x, y, n = v1[column], v2[column], len(names)
            sums = {k: np.bincount(source, w, n) for k, w in (("a", x * x), ("b", x * y), ("c", y * y), ("p", e * x), ("q", e * y))}
            out = pd.DataFrame({"source_id": names, "width": width} | dict(zip(_MODEL[:4], factors.T)) | sums)[~np.isnan(factors[:, 0])]
            return out.assign(gain=np.r_[gain, np.zeros(len(out) - 1)] if len(out) else 0.0)

        return of

    def improved(model: DataFrame, first: bool) -> DataFrame:
        met = _over(blocks, model, stepped(first), f"{key}, mean double, lo double, hi double, cells double, a double, b double, c double, p double, q double, gain double")
        met = met.groupBy("source_id", "width").agg(*(F.max(c).alias(c) for c in _MODEL[:4]), *(F.sum(c).alias(c) for c in ("b", "p", "q", "gain")), *((F.sum(c) + ridge).alias(c) for c in ("a", "c")))
        return written(met.withColumn("det", F.expr("a * c - b * b")).selectExpr("source_id", "width", "mean", "lo", "hi", "cast(cells as long) as cells", "(c * p - b * q) / det as u1", "(a * q - b * p) / det as u2", "gain"))

    model = improved(model, True)
    total, before = model.agg(F.sum("gain")).first()[0] or 0.0, None
    for _ in range(rounds):
        fitted, model = model, improved(model, False)
        now = total - (model.agg(F.sum("gain")).first()[0] or 0.0) + ridge * (fitted.agg(F.sum(F.col("u1") ** 2 + F.col("u2") ** 2)).first()[0] or 0.0)
        if before is not None and before - now <= tolerance * total:
            break
        before = now
    else:
        warnings.warn(f"the factorisation still changed after {rounds} rounds", stacklevel=3)
    return fitted.drop("gain")


def factorised(matrix: DataFrame, tolerance: float = 1e-3, rounds: int = 30, ridge: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Factors of ``matrix`` (source_id, width, col, y), one matrix for each width: per source (source_id, width, mean, lo, hi, cells, u1, u2) and per column (width, col, v1, v2, sources), iterated as in ``_fitted``."""
    blocks = _blocks(matrix)
    fitted = _fitted(blocks, matrix.schema["source_id"].dataType.simpleString(), tolerance, rounds, ridge)

    def columns(width: int, names: list, pack: tuple, factors: np.ndarray) -> pd.DataFrame:
        cols, source, column, y, _, _ = pack
        v1, v2, _ = _solved(column, len(cols), y - factors[source, 0], factors[source, 4], factors[source, 5], ridge)
        return pd.DataFrame({"width": width, "col": cols, "v1": v1, "v2": v2, "sources": np.bincount(column, minlength=len(cols))}).query("sources > 0")

    return fitted, _over(blocks, fitted, columns, "width long, col long, v1 double, v2 double, sources long")


def _fills(matrix: DataFrame, least_cells: int, least_sources: int, ridge: float = 0.1) -> DataFrame:
    """(source_id, width, col, guess): a value for each cell of ``matrix`` (source_id, width, col, y) that is to be filled (y null) and has support."""
    name = matrix.schema["source_id"].dataType.simpleString()
    blocks = _blocks(matrix)

    def filled(width: int, names: list, pack: tuple, factors: np.ndarray) -> pd.DataFrame:
        cols, source, column, y, gap_source, gap_column = pack
        v1, v2, _ = _solved(column, len(cols), y - factors[source, 0], factors[source, 4], factors[source, 5], ridge)
        mean, lo, hi, cells, u1, u2 = factors[gap_source].T
        guess = np.exp(np.minimum(hi, np.maximum(lo, mean + u1 * v1[gap_column] + u2 * v2[gap_column])))
        sources = np.bincount(column, minlength=len(cols))
        # whether the source itself is in the column, as the edges of two flights can share one
        own = np.isin(gap_column.astype(np.int64) * len(names) + gap_source, column.astype(np.int64) * len(names) + source)
        fit = (cells >= least_cells) & (sources[gap_column] - own >= least_sources) & (sources[gap_column] > 0)
        return pd.DataFrame({"source_id": np.array(names, dtype=object)[gap_source], "width": width, "col": cols[gap_column], "guess": guess})[fit]

    return _over(blocks, _fitted(blocks, name, ridge=ridge), filled, f"source_id {name}, width long, col long, guess double")


def regular_series(readings: DataFrame, flights: DataFrame, column_seconds: int | None = None, least_cells: int = 4, least_sources: int = 2) -> DataFrame:
    """(flight_id, source_id, k, at, value, status): one row per due period.

    status is ``observed`` (value of the last reading in the period, exact, a wrong value included), ``filled`` (value from
    the factorisation, kept within the source's observed range) or ``missing`` (no support: the source has fewer than ``least_cells``
    observed cells, or fewer than ``least_sources`` other sources were observed in its time column; value null). Columns are as
    wide as the flight's periods, or ``column_seconds`` where given. Readings without value, outside every flight or without
    timestamp don't count; repeated deliveries change nothing; empty tables give no rows.
    """
    require(readings, "source_id", "timestamp", "value")
    require(flights, "flight_id", "source_id", "starts_at", "ends_at", "step_seconds")
    width = F.lit(column_seconds).cast("long") if column_seconds else F.floor(F.col("step") / 1_000_000).cast("long")
    placed = cells(readings, flights).withColumn("width", width).withColumn("col", F.floor(F.col("at") / (F.col("width") * 1_000_000)).cast("long"))
    grid = written(placed.drop("step"))
    usable, gap = (F.col("value") > 0) & (F.col("value") < float("inf")), F.col("value").isNull()
    fills = _fills(grid.where(usable | gap).select("source_id", "width", "col", F.ln("value").alias("y")), least_cells, least_sources)
    cell = ["flight_id", "source_id", "k", "at"]
    observed = grid.where(~gap).select(*cell, "value", F.lit("observed").alias("status"))
    others = grid.where(gap).drop("value").join(fills, ["source_id", "width", "col"], "left")
    return observed.unionByName(others.select(*cell, F.col("guess").alias("value"), F.when(F.col("guess").isNotNull(), "filled").otherwise("missing").alias("status")))


def missing_periods(readings: DataFrame, flights: DataFrame) -> DataFrame:
    """(source_id, period_start): each due period without a reading that has a value: those of ``regular_series`` that are filled or stay missing."""
    return regular_series(readings, flights).where("status <> 'observed'").select("source_id", clock(F.col("at")).alias("period_start"))
