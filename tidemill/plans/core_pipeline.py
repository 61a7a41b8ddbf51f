"""Queries of the core training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.common import table
from tidemill.functions.times import clock
from tidemill.operators import anomalies, regular_grid


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return regular_grid.missing_periods(table(spark, folder, "exchange_3_cpc_results"), table(spark, folder, "exchange_flights"))


def p2_series(spark: SparkSession, folder: str) -> DataFrame:
    out = regular_grid.regular_series(table(spark, folder, "exchange_3_cpc_results"), table(spark, folder, "exchange_flights"))
    return out.select("flight_id", "source_id", clock(out["at"]).alias("period_start"), "value", "status")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return anomalies.implausible(table(spark, folder, "exchange_3_cpc_results"))


def p3_scored(spark: SparkSession, folder: str) -> DataFrame:
    return anomalies.scored_readings(table(spark, folder, "exchange_3_cpc_results"))


QUERIES = {"p2_found": p2_found, "p2_series": p2_series, "p3_found": p3_found, "p3_scored": p3_scored}

SQL = {
    "p2_found": """
WITH due AS (
  SELECT flight_id, source_id, starts_at, step_seconds, unnest(range(CAST(0 AS BIGINT), CAST(ceil((epoch_us(ends_at) - epoch_us(starts_at)) / (step_seconds::BIGINT * 1000000)) AS BIGINT))) AS k
  FROM exchange_flights),
seen AS (
  SELECT DISTINCT f.flight_id, (epoch_us(r.timestamp) - epoch_us(f.starts_at)) // (f.step_seconds::BIGINT * 1000000) AS k
  FROM exchange_3_cpc_results r JOIN exchange_flights f ON r.source_id = f.source_id AND r.timestamp >= f.starts_at AND r.timestamp < f.ends_at
  WHERE r.value IS NOT NULL AND NOT isnan(r.value))
SELECT source_id, strftime(starts_at + to_seconds(k * step_seconds), '%Y-%m-%d %H:%M:%S') AS period_start
FROM due ANTI JOIN seen USING (flight_id, k)""",
}
