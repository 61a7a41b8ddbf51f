"""Queries of the toolbox operators over the star-schema, event and document tables, and their SQL. Floating results are rounded to four places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.common import table
from tidemill.functions import metrics as M
from tidemill.functions import scalars as S
from tidemill.operators import categorical as C
from tidemill.operators import hmm as H
from tidemill.operators import models as D
from tidemill.operators import outliers as O
from tidemill.operators import relational as R
from tidemill.operators import sequences as Q
from tidemill.operators import similarity as X
from tidemill.operators import timeseries as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BY, AT = ["user_id"], ["ts", "event_id"]
#: The window of all series queries in SQL.
W = "PARTITION BY user_id ORDER BY ts, event_id"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")


def _gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Events whose values below 20 are missing."""
    return _events(spark, folder).withColumn("value", F.when(F.col("value") >= 20, F.col("value")))


GAPS = "(SELECT event_id, ts, user_id, event_type, CASE WHEN value >= 20 THEN value END AS value FROM events)"


def _rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


# -- projections, casts, missing values


@query("SELECT event_id, user_id, round(value * 2 + 1, 4) AS scaled, greatest(value - 50, 0) > 0 AS large FROM events WHERE value > 10 AND event_type <> 'click'")
def project_filter_events(spark, d):
    e = _events(spark, d).where((F.col("value") > 10) & (F.col("event_type") != "click"))
    return e.select("event_id", "user_id", F.round(F.col("value") * 2 + 1, 4).alias("scaled"), (R.clip_below(F.col("value") - 50) > 0).alias("large"))


@query(f"SELECT event_id FROM {GAPS} WHERE value IS NOT NULL")
def drop_null_subset(spark, d):
    return _gaps(spark, d).na.drop(subset=["value"]).select("event_id")


@query("SELECT CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM events GROUP BY 1")
def temporal_split(spark, d):
    parts = R.temporal_split(_events(spark, d), "ts", "2024-01-15 00:00:00")
    return R.concat_flagged(parts, "part", ["train", "test"]).groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT CAST(l_orderkey AS INTEGER) AS l_orderkey, CAST(l_partkey AS INTEGER) AS l_partkey, CAST(l_quantity AS FLOAT) AS l_quantity FROM lineitem")
def downcast_numeric(spark, d):
    return R.downcast(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INTEGER) AS day FROM orders")
def date_to_int(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.date_to_int(F.col("o_orderdate")).alias("day"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(weekofyear(o_orderdate) AS INTEGER) AS week, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday FROM orders")
def calendar_features(spark, d):
    return C.calendar(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query(f"SELECT event_id, coalesce(value, -1) AS value FROM {GAPS}")
def fill_constant(spark, d):
    return _gaps(spark, d).select("event_id", "value").na.fill({"value": -1.0})


@query(f"SELECT event_id, round(coalesce(value, (SELECT median(value) FROM {GAPS})), 4) AS value FROM {GAPS}")
def fill_column_median(spark, d):
    return _rounded(R.fill_statistic(_gaps(spark, d).select("event_id", "value"), ["value"], "median"))


@query(f"SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM {GAPS})), 4) AS value FROM {GAPS}")
def fill_column_mean(spark, d):
    return _rounded(R.fill_statistic(_gaps(spark, d).select("event_id", "value"), ["value"], "mean"))


@query(f"SELECT event_id, round(coalesce(value, median(value) OVER (PARTITION BY user_id, event_type)), 4) AS value FROM {GAPS}")
def fill_group_median(spark, d):
    g = R.fill_statistic(_gaps(spark, d), ["value"], "median", ["user_id", "event_type"])
    return _rounded(g.select("event_id", "value"))


@query("""
WITH g AS (SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 100000 THEN o_orderpriority END AS p FROM orders),
m AS (SELECT o_custkey, p AS mode FROM (SELECT o_custkey, p, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, p DESC) AS r FROM g WHERE p IS NOT NULL GROUP BY 1, 2) WHERE r = 1)
SELECT o_orderkey, coalesce(p, mode, 'unknown') AS p FROM g LEFT JOIN m USING (o_custkey)""")
def fill_group_mode(spark, d):
    g = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_totalprice") > 100000, F.col("o_orderpriority")).alias("p"))
    return R.fill_group_mode(g, "p", "o_custkey").select("o_orderkey", "p")


@query(f"SELECT event_id, coalesce(first_value(value IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(value IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS value FROM {GAPS}")
def fill_bfill_ffill(spark, d):
    return R.fill_neighbours(_gaps(spark, d), ["value"], AT, BY).select("event_id", "value")


# -- joins, sets, top-k


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def inner_join_key(spark, d):
    o, c = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT o_orderkey, m.n AS n FROM orders o JOIN (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) m ON o.o_custkey = m.o_custkey AND o.o_orderstatus = m.o_orderstatus")
def multi_key_join(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    n = o.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    return o.join(n, ["o_custkey", "o_orderstatus"]).select("o_orderkey", "n")


@query("""SELECT n_nationkey AS nationkey, n_name AS name_n, c.customers AS customers_c, s.suppliers AS suppliers_s FROM nation
LEFT JOIN (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) c ON n_nationkey = c_nationkey
LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) s ON n_nationkey = s_nationkey""")
def nway_left_join(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("name"))
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("customers"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("suppliers"))
    return R.left_join_all([n, c, s], ["nationkey"], ["_n", "_c", "_s"])


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END::BIGINT AS code FROM orders")
def lookup_map_join(spark, d):
    return R.mapped(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"F": 1, "O": 2}, 0, "code").select("o_orderkey", "code")


@query("SELECT 'customer' AS part, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_name, s_acctbal, NULL FROM supplier")
def union_with_flag(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return R.concat_flagged([c, s], "part", ["customer", "supplier"])


@query(f"SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3")
def top_per_group(spark, d):
    return R.top_k(_events(spark, d), 3, [F.desc("value"), F.asc("event_id")], ["event_type"]).select("event_type", "event_id", "value")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS position FROM events")
def surrogate_position(spark, d):
    return R.positions(_events(spark, d), AT).select("event_id", "position")


@query("SELECT c_mktsegment, median(c_acctbal) AS median_balance, count(*) AS n FROM customer GROUP BY 1")
def group_median(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.percentile("c_acctbal", F.lit(0.5)).alias("median_balance"), F.count("*").alias("n"))


@query("SELECT o_custkey, p AS mode FROM (SELECT o_custkey, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority DESC) AS r FROM orders GROUP BY 1, 2) WHERE r = 1")
def group_mode(spark, d):
    return R.group_mode(table(spark, d, "orders"), "o_orderpriority", "o_custkey")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, d):
    return _events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT quality, count(*) AS n FROM labels GROUP BY 1")
def class_balance(spark, d):
    return table(spark, d, "labels").groupBy("quality").agg(F.count("*").alias("n"))


# -- categorical


@query("SELECT p_partkey, round(avg(p_retailprice) OVER (PARTITION BY p_brand), 4) AS mean_p_retailprice_per_p_brand FROM part")
def group_transform_mean(spark, d):
    return _rounded(C.project(table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice"), ["p_brand"], ["p_retailprice"]).drop("p_brand", "p_retailprice"))


@query("""SELECT p_partkey, round(avg(p_retailprice) OVER (PARTITION BY p_brand), 6) AS mean_p_retailprice_per_p_brand, round(avg(p_size) OVER (PARTITION BY p_brand), 6) AS mean_p_size_per_p_brand,
round(avg(p_retailprice) OVER (PARTITION BY p_type), 6) AS mean_p_retailprice_per_p_type, round(avg(p_size) OVER (PARTITION BY p_type), 6) AS mean_p_size_per_p_type FROM part""")
def categorical_projector(spark, d):
    return _rounded(C.project(table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice", "p_size"), ["p_brand", "p_type"], ["p_retailprice", "p_size"]).drop("p_brand", "p_type", "p_retailprice", "p_size"), 6)


TAGS = "(SELECT event_type, row_number() OVER (ORDER BY min((ts, event_id))) - 1 AS id FROM events GROUP BY 1)"


@query(f"SELECT event_id, t.id AS id FROM events JOIN {TAGS} t USING (event_type)")
def tag_encode(spark, d):
    e = _events(spark, d)
    return C.TagEncoder().fit(e, "event_type", AT).transform(e, "event_type").select("event_id", "id")


@query(f"SELECT event_id, CASE WHEN e.value < 50 THEN t.id ELSE -1 END AS id FROM events e JOIN {TAGS} t USING (event_type)")
def tag_encode_unknown(spark, d):
    e = _events(spark, d)
    other = e.withColumn("event_type", F.when(F.col("value") < 50, F.col("event_type")).otherwise("never seen"))
    return C.TagEncoder().fit(e, "event_type", AT).transform(other, "event_type").select("event_id", "id")


@query("SELECT event_id, event_type AS tag FROM events")
def tag_decode(spark, d):
    e = _events(spark, d)
    coder = C.TagEncoder().fit(e, "event_type", AT)
    return coder.inverse(coder.transform(e, "event_type"), "id").select("event_id", "tag")


# -- deviations


@query("""WITH m AS (SELECT l_returnflag, avg(l_extendedprice) AS mean, median(l_extendedprice) AS med FROM lineitem GROUP BY 1),
x AS (SELECT l_returnflag, abs(l_extendedprice - mean) AS am, abs(l_extendedprice - med) AS ad, med FROM lineitem JOIN m USING (l_returnflag))
SELECT l_returnflag, round(avg(am), 4) AS mean_ad, round(median(ad), 4) AS median_ad, round(median(ad) FILTER (WHERE ad <= med), 4) AS mad_left, round(median(ad) FILTER (WHERE ad >= med), 4) AS mad_right FROM x GROUP BY 1""")
def deviation_measures(spark, d):
    return _rounded(S.deviations(table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice"), "l_extendedprice", ["l_returnflag"]))


# -- time series


@query(f"SELECT event_id, lag(value, 1) OVER ({W}) AS \"t-1_value\", lag(value, 2) OVER ({W}) AS \"t-2_value\", lead(value, 1) OVER ({W}) AS \"t--1_value\" FROM events")
def shift_features(spark, d):
    return T.shift(_events(spark, d), ["value"], [1, 2, -1], AT, BY, prefix="t-").select("event_id", "t-1_value", "t-2_value", "t--1_value")


@query(f"SELECT event_id, round(lag(value, 1) OVER ({W}) - lag(value, 2) OVER ({W}), 4) AS diff_value_2_value_1, round(value - lag(value) OVER ({W}), 4) AS diff FROM events")
def diff_shift(spark, d):
    s = T.shift(_events(spark, d), ["value"], [1, 2], AT, BY)
    s = T.successive_difference(T.differences(s, ["value_1", "value_2"]), "value", AT, BY)
    return _rounded(s.select("event_id", "diff_value_2_value_1", "diff"))


@query(f"""SELECT event_id, round(CASE WHEN count(value) OVER w >= 7 THEN avg(value) OVER w END, 4) AS mean_7_value, round(CASE WHEN count(value) OVER w >= 7 THEN median(value) OVER w END, 4) AS median_7_value,
round(CASE WHEN count(value) OVER w >= 7 THEN stddev_samp(value) OVER w END, 3) AS std_7_value, max(value) OVER v AS max_3_value FROM events
WINDOW w AS ({W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), v AS ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def rolling_rows(spark, d):
    e = _events(spark, d)
    for op in ("mean", "median", "std"):
        e = T.rolling(e, ["value"], [7], AT, BY, op)
    e = T.rolling(e, ["value"], [3], AT, BY, "max", min_periods=1)
    return e.select("event_id", F.round("mean_7_value", 4).alias("mean_7_value"), F.round("median_7_value", 4).alias("median_7_value"), F.round("std_7_value", 3).alias("std_7_value"), "max_3_value")


@query("""SELECT event_id, round(avg(value) OVER w, 6) AS mean_86400s_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '86399.999999 seconds' PRECEDING AND CURRENT ROW)""")
def rolling_time_range(spark, d):
    return _rounded(T.rolling_time(_events(spark, d), ["value"], [86400], "ts", BY).select("event_id", "mean_86400s_value"), 6)


@query(f"SELECT event_id, round(CASE WHEN count(value) OVER w >= 7 THEN avg(value) OVER w END, 4) AS mean_7_value FROM events WINDOW w AS ({W} ROWS BETWEEN 9 PRECEDING AND 3 PRECEDING)")
def rolling_shifted(spark, d):
    return _rounded(T.rolling(_events(spark, d), ["value"], [7], AT, BY, "mean", shifted=3).select("event_id", "mean_7_value"))


@query(f"""WITH l AS (SELECT event_id, list(value) OVER w AS v FROM events WINDOW w AS ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
b AS (SELECT event_id, v, CASE WHEN list_min(v) = list_max(v) THEN list_min(v) - 0.5 ELSE list_min(v) END AS lo, CASE WHEN list_min(v) = list_max(v) THEN 1.0 ELSE list_max(v) - list_min(v) END / 4 AS width FROM l)
SELECT event_id, {', '.join(f"CAST(len(list_filter(v, lambda x: least(3, floor((x - lo) / width)) = {i})) AS INTEGER) AS value_bin_{i + 1}" for i in range(4))} FROM b""")
def rolling_histogram(spark, d):
    return T.distribution(_events(spark, d), ["value"], 5, AT, BY).select("event_id", *(f"value_bin_{i}" for i in range(1, 5)))


@query(f"SELECT event_id, {', '.join(f'round(quantile_cont(value, {q}) OVER w, 4) AS value_quantile_{i + 1}' for i, q in enumerate((0, 0.25, 0.5, 0.75, 1)))} FROM events WINDOW w AS ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def rolling_quantiles(spark, d):
    return _rounded(T.distribution(_events(spark, d), ["value"], 5, AT, BY, quantiles=[0, 0.25, 0.5, 0.75, 1]).select("event_id", *(f"value_quantile_{i}" for i in range(1, 6))))


@query(f"""WITH l AS (SELECT event_id, list(value) OVER w AS v, row_number() OVER ({W}) AS r FROM events WINDOW w AS ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT event_id, CASE WHEN r >= 5 THEN round(list_avg(list_transform(v, lambda x: abs(x - list_avg(v)))), 4) END AS mean_ad_5_value, CASE WHEN r >= 5 THEN round(list_median(list_transform(v, lambda x: abs(x - list_median(v)))), 4) END AS median_ad_5_value FROM l""")
def rolling_abs_deviation(spark, d):
    e = _events(spark, d)
    for centre in ("mean", "median"):
        e = T.rolling_deviation(e, ["value"], 5, AT, BY, centre)
    return _rounded(e.select("event_id", "mean_ad_5_value", "median_ad_5_value"))


@query(f"SELECT event_id, CASE WHEN row_number() OVER ({W}) >= 3 THEN round(avg(value) OVER w, 4) END AS mean_3_value FROM {GAPS} WINDOW w AS ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def strided_mean(spark, d):
    return _rounded(T.strided(_gaps(spark, d), ["value"], 3, AT, BY).select("event_id", "mean_3_value"))


@query("""WITH r AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS value FROM events GROUP BY 1, 2), s AS (SELECT user_id, unnest(range(min(day), max(day) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day FROM r GROUP BY 1)
SELECT s.user_id, strftime(s.day, '%Y-%m-%d') AS day, round(r.value, 4) AS value FROM s LEFT JOIN r ON s.user_id = r.user_id AND s.day = r.day""")
def daily_resample(spark, d):
    return T.daily_resample(_events(spark, d), "ts", ["value"], BY).select("user_id", F.col("day").cast("string").alias("day"), F.round("value", 4).alias("value"))


# -- metrics


@query("""WITH x AS (SELECT l_extendedprice AS y, l_quantity * 1000 AS p FROM lineitem)
SELECT round(sqrt(avg(pow(y - p, 2))), 4) AS rmse, round(avg(pow((y - p) / y, 2)), 4) AS mspe, round(sqrt(avg(pow((y - p) / y, 2))), 4) AS rmspe, round(avg(abs((y - p) / y)), 4) AS mape,
round(avg(abs(y - p) / ((y + p) / 2)), 4) AS smape, round(sqrt(avg(pow((y - p) / ((y + p) / 2), 2))), 4) AS srmspe FROM x""")
def regression_metrics(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("p"))
    return _rounded(M.regression_report(x, "y", "p"))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return table(spark, folder, "labels").select("doc_id", F.col("quality").alias("y")).join(docs, "doc_id").where("score is not null")


CURVE = """WITH s AS (SELECT quality AS y, CAST(n_chars AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL),
g AS (SELECT score AS threshold, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY 1), t AS (SELECT sum(p) AS positives, sum(n) AS negatives FROM g),
c AS (SELECT threshold, p, n, sum(p) OVER (ORDER BY threshold DESC) AS tp, sum(n) OVER (ORDER BY threshold DESC) AS fp, positives, negatives FROM g, t)"""


@query(CURVE + " SELECT round(arg_max(tp / (tp + fp), threshold), 4) AS precision, max(threshold) AS threshold FROM c WHERE tp / positives >= 0.8")
def precision_at_recall(spark, d):
    return _rounded(M.precision_at_recall(_scored(spark, d), "y", "score", 0.8))


@query(CURVE + " SELECT round(arg_min(tp / positives, threshold), 4) AS recall, min(threshold) AS threshold FROM c WHERE tp / (tp + fp) >= 0.85")
def recall_at_precision(spark, d):
    return _rounded(M.recall_at_precision(_scored(spark, d), "y", "score", 0.85))


@query(CURVE + " SELECT threshold, round(fp / negatives, 4) AS fpr, round(tp / positives, 4) AS tpr FROM c")
def roc_points(spark, d):
    return _rounded(M.roc_points(_scored(spark, d), "y", "score"))


@query(CURVE + " SELECT round(sum(n * (tp - p / 2)) / (max(positives) * max(negatives)), 4) AS auc FROM c")
def roc_auc(spark, d):
    return _rounded(M.auc(_scored(spark, d), "y", "score"))


@query("SELECT quality AS truth, CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS predicted, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 4) AS share FROM labels JOIN documents USING (doc_id) WHERE n_chars IS NOT NULL GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return _rounded(M.confusion(_scored(spark, d).withColumn("p", M.binarize(F.col("score"), 1000.0)), "y", "p"))


# -- outliers


@query("""WITH c AS (SELECT avg(c_acctbal) AS m FROM customer), x AS (SELECT c_custkey, abs(c_acctbal - m) AS dist FROM customer, c)
SELECT c_custkey, round(dist / (SELECT sum(dist) FROM x), 6) AS probability, dist / (SELECT sum(dist) FROM x) > 1.0 / (SELECT count(*) FROM x) AS outlier FROM x""")
def centroid_outliers(spark, d):
    return _rounded(O.centroid_outliers(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).drop("c_acctbal"), 6)


@query("""WITH s AS (SELECT avg(c_acctbal) AS m, var_pop(c_acctbal) AS v FROM customer), x AS (SELECT c_custkey, pow(c_acctbal - m, 2) / v AS dist FROM customer, s)
SELECT c_custkey, round(dist / (SELECT sum(dist) FROM x), 6) AS probability, dist / (SELECT sum(dist) FROM x) > 1.0 / (SELECT count(*) FROM x) AS outlier FROM x""")
def mahalanobis_outliers(spark, d):
    return _rounded(O.mahalanobis_outliers(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).drop("c_acctbal"), 6)


@query("""WITH m AS (SELECT l_returnflag, median(l_extendedprice) AS med FROM lineitem GROUP BY 1), a AS (SELECT l_returnflag, median(abs(l_extendedprice - med)) AS mad FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1)
SELECT l_returnflag, count(*) AS n FROM lineitem JOIN m USING (l_returnflag) JOIN a USING (l_returnflag) WHERE 0.6745 * abs(l_extendedprice - med) / mad > 2 GROUP BY 1""")
def mad_outliers_grouped(spark, d):
    o = O.mad_outliers(table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice"), "l_extendedprice", by=["l_returnflag"])
    return o.where("outlier").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query(f"""WITH l AS (SELECT event_id, value, list(value) OVER w AS v, median(value) OVER w AS med FROM events WINDOW w AS ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
m AS (SELECT event_id, abs(value - med) AS away, 1.4826 * list_median(list_transform(v, lambda x: abs(x - list_median(v)))) AS mad FROM l),
p AS (SELECT event_id, CASE WHEN mad = 0 THEN CASE WHEN away <> 0 THEN 1.0 ELSE 0.0 END WHEN away / mad > 2 THEN 1.0 ELSE 0.0 END AS probability FROM m)
SELECT event_id, probability, probability > (SELECT avg(probability) FROM p) AS outlier FROM p""")
def mad_outliers_rolling(spark, d):
    return O.rolling_mad_outliers(_events(spark, d), ["value"], AT, BY, 10).select("event_id", "probability", "outlier")


@query()
def centroid_outliers_iterative(spark, d):
    return O.iterative_centroid_outliers(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], 3).select("c_custkey", "tag")


@query()
def gaussian_density_outliers(spark, d):
    return O.gaussian_density_outliers(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], ["o_orderkey"]).select("o_orderkey", "outlier")


@query()
def dbscan_outliers(spark, d):
    c = O.dbscan_1d(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 1.0, 3)
    return O.cluster_outliers(c, ["c_acctbal"], "unclustered").select("c_custkey", "cluster", "outlier")


@query()
def cluster_size_outliers(spark, d):
    c = O.kmeans_clusters(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], 4)
    return O.cluster_outliers(c, ["c_acctbal"], "size").select("c_custkey", "cluster", "outlier")


@query()
def fft_outliers(spark, d):
    return O.fft_outliers(_events(spark, d), ["value"], AT, BY).select("event_id", "outlier")


@query()
def gp_outliers(spark, d):
    return O.gaussian_process_outliers(_events(spark, d), "value", AT, BY).select("event_id", "outlier")


# -- sequences


STEPS = f"(SELECT event_type AS from_state, lead(event_type) OVER ({W}) AS to_state FROM events)"


@query(f"SELECT from_state, to_state, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY from_state), 4) AS p FROM {STEPS} WHERE to_state IS NOT NULL GROUP BY 1, 2")
def markov_transitions(spark, d):
    return _rounded(Q.transitions(_events(spark, d), "event_type", "user_id", AT))


@query(f"""WITH m AS (SELECT from_state, to_state, count(*) / sum(count(*)) OVER (PARTITION BY from_state) AS p FROM {STEPS} WHERE to_state IS NOT NULL GROUP BY 1, 2),
e AS (SELECT event_id, event_type, lag(event_type) OVER ({W}) AS f FROM events)
SELECT event_id, round(CASE WHEN f IS NULL THEN 1.0 ELSE coalesce(p, 0) END, 4) AS transition_p FROM e LEFT JOIN m ON f = from_state AND event_type = to_state""")
def markov_transition_proba(spark, d):
    e = _events(spark, d)
    return _rounded(Q.transition_probabilities(e, Q.transitions(e, "event_type", "user_id", AT), "event_type", "user_id", AT).select("event_id", "transition_p"))


@query(f"SELECT from_state AS state, to_state AS next_state FROM (SELECT from_state, to_state, rank() OVER (PARTITION BY from_state ORDER BY count(*) DESC) AS r FROM {STEPS} WHERE to_state IS NOT NULL GROUP BY 1, 2) WHERE r = 1")
def markov_next_state(spark, d):
    return Q.next_states(Q.transitions(_events(spark, d), "event_type", "user_id", AT)).drop("p")


DURATIONS = f"""d AS (SELECT event_id, lag(event_type) OVER ({W}) AS f, event_type AS t, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER ({W}) AS s FROM events),
r AS (SELECT f, t, CASE WHEN min(s) = max(s) THEN min(s) - 0.5 ELSE min(s) END AS lo, CASE WHEN min(s) = max(s) THEN min(s) + 0.5 ELSE max(s) END AS hi, count(*) AS total FROM d WHERE f IS NOT NULL GROUP BY 1, 2)"""


@query(f"WITH {DURATIONS} SELECT d.f AS from_state, d.t AS to_state, {', '.join(f'count(*) FILTER (WHERE least(2, floor((s - lo) / ((hi - lo) / 3))) = {i}) AS n{i}' for i in range(3))} FROM d JOIN r ON d.f = r.f AND d.t = r.t GROUP BY 1, 2")
def duration_histogram(spark, d):
    m = Q.duration_model(_events(spark, d), "event_type", "ts", "user_id", AT, 3)
    return m.select("from_state", "to_state", *(F.col("counts")[i].alias(f"n{i}") for i in range(3)))


@query()
def duration_proba(spark, d):
    e = _events(spark, d)
    return Q.duration_probabilities(e, Q.duration_model(e, "event_type", "ts", "user_id", AT, 3), "event_type", "ts", "user_id", AT).select("event_id", "duration_p")


@query()
def markov_chained_proba(spark, d):
    e = _events(spark, d)
    return Q.chained_probabilities(e, Q.MarkovChain.fit(e, "event_type", "user_id", AT), "event_type", "user_id", AT).select("event_id", "chained_p")


@query()
def meta_sequence(spark, d):
    e = _events(spark, d)
    both = Q.duration_probabilities(Q.chained_probabilities(e, Q.MarkovChain.fit(e, "event_type", "user_id", AT), "event_type", "user_id", AT), Q.duration_model(e, "event_type", "ts", "user_id", AT, 10), "event_type", "ts", "user_id", AT)
    return both.select("event_id", Q.merged_probability(F.col("chained_p"), F.col("duration_p")).alias("p"))


@query()
def hmm_decode(spark, d):
    e = C.TagEncoder().fit(_events(spark, d), "event_type", AT).transform(_events(spark, d), "event_type")
    model = H.DiscreteHmm(2, 5, iterations=4).fit(e, "id", "user_id", AT)
    return model.transform(e, "id", "user_id", AT).select("event_id", "state")


TAGGED = """t AS (SELECT user_id, event_id, ts, CASE WHEN value >= 60 THEN CASE WHEN lag(value) OVER w >= 60 THEN 'I-x' ELSE 'B-x' END ELSE 'O' END AS y,
CASE WHEN value >= 50 THEN CASE WHEN lag(value) OVER w >= 50 THEN 'I-x' ELSE 'B-x' END ELSE 'O' END AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


def _tagged(spark, d):
    e = _events(spark, d)
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    tag = lambda bar: F.when(F.col("value") >= bar, F.when(F.lag("value").over(w) >= bar, "I-x").otherwise("B-x")).otherwise("O")
    return e.select("user_id", "event_id", tag(60).alias("y"), tag(50).alias("p"))


@query(f"""WITH {TAGGED}, s AS (SELECT 'y' AS side, user_id, beg, n FROM (SELECT user_id, min(r) AS beg, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, sum((y = 'B-x')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM t) WHERE y <> 'O' GROUP BY user_id, k)
UNION ALL SELECT 'p', user_id, beg, n FROM (SELECT user_id, min(r) AS beg, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, sum((p = 'B-x')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM t) WHERE p <> 'O' GROUP BY user_id, k)),
g AS (SELECT user_id, beg, n, count(*) FILTER (WHERE side = 'y') AS a, count(*) FILTER (WHERE side = 'p') AS b FROM s GROUP BY 1, 2, 3)
SELECT round(2 * sum(least(a, b)) / (sum(a) + sum(b)), 4) AS f_score FROM g""")
def bio_f_score(spark, d):
    return _rounded(M.bio_f_score(_tagged(spark, d), "y", "p", "event_id", "user_id"))


@query(f"WITH {TAGGED} SELECT round(avg(ok::INT), 4) AS accuracy FROM (SELECT user_id, bool_and(y = p) AS ok FROM t GROUP BY 1)")
def whole_sequence_accuracy(spark, d):
    return _rounded(M.whole_sequence_accuracy(_tagged(spark, d), "y", "p", "user_id"))


@query()
def sequence_folds(spark, d):
    return M.sequence_folds(_events(spark, d), "user_id", 3)


# -- texts


@query("SELECT item_id, CASE WHEN len(text) >= 3 THEN list_transform(range(1, len(text) - 1), lambda i: substr(text, i, 3)) ELSE [] END AS shingles FROM benchmark")
def shingles(spark, d):
    return table(spark, d, "benchmark").select("item_id", S.shingles(F.col("text")).alias("shingles"))


@query("SELECT id, trim(regexp_replace(lower(translate(text, '@#', '')), '\\s+', ' ', 'g')) AS text FROM (SELECT item_id AS id, text FROM benchmark)")
def cleaned_text(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.trim(F.regexp_replace(F.lower(F.translate("text", "@#", "")), r"\s+", " ")).alias("text"))


@query("SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN len(text) >= 3 THEN list_transform(range(1, len(text) - 1), lambda i: substr(text, i, 3)) ELSE [] END AS shingles FROM documents")
def document_shingles(spark, d):
    return table(spark, d, "documents").select("doc_id", S.shingles(F.col("text")).alias("shingles"))


@query()
def document_cleaned_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.trim(F.regexp_replace(F.lower(F.translate("text", "@#", "")), r"\s+", " ")).alias("text"))


@query()
def token_ids(spark, d):
    b = table(spark, d, "documents").select("doc_id", "text")
    return X.TokenSequences().fit(b, "text", "doc_id").ids(b, "doc_id", "text")


@query()
def padded_sequences(spark, d):
    b = table(spark, d, "documents").select("doc_id", "text")
    return X.TokenSequences().fit(b, "text", "doc_id").transform(b, "doc_id", "text")


@query()
def lsh_nearest(spark, d):
    """Documents searched in an index of the benchmark's items."""
    index = X.NearestText(50, 3, 10, 25).fit(table(spark, d, "benchmark"), "text")
    return index.nearest(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query()
def post_jaccard_pairs(spark, d):
    return _rounded(X.jaccard_pairs(table(spark, d, "task2_train").select("id", "text"), "id", "text", 3, 0.6))


@query("""WITH g AS (SELECT item_id, list_distinct(list_transform(range(1, len(text) - 1), lambda i: substr(text, i, 3))) AS s FROM benchmark WHERE len(text) >= 3), k AS (SELECT list_sort(s) AS s, min(item_id) AS item_id FROM g GROUP BY 1),
p AS (SELECT a.item_id AS key_a, b.item_id AS key_b, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS score FROM k a JOIN k b ON a.item_id < b.item_id)
SELECT key_a, key_b, round(score, 4) AS score FROM p WHERE score >= 0.6""")
def jaccard_pairs(spark, d):
    return _rounded(X.jaccard_pairs(table(spark, d, "benchmark").select("item_id", "text"), "item_id", "text", 3, 0.6))


# -- scaling and models


@query("SELECT c_custkey, round(CASE WHEN c_acctbal < 0 THEN -0.01 * ln(1 + ln(1 + (0 - c_acctbal) / 8000)) WHEN c_acctbal > 8000 THEN 1 + 0.01 * ln(1 + ln(1 + (c_acctbal - 8000) / 8000)) ELSE c_acctbal / 8000 END, 10) AS scaled FROM customer")
def quantile_scale(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(S.tail_scaled(F.col("c_acctbal"), 0.0, 8000.0), 10).alias("scaled"))


@query("SELECT l_orderkey, l_linenumber, round(0.1 * l_discount / (0.1 * l_discount - l_discount + 1), 6) AS p FROM lineitem")
def bias_correct(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.bias_corrected(F.col("l_discount"), 0.1), 6).alias("p"))


@query()
def undersample_balance(spark, d):
    kept, beta = R.undersampled(table(spark, d, "labels").where("quality is not null"), "quality", "doc_id")
    return kept.groupBy("quality").agg(F.count("*").alias("n")).withColumn("beta", F.lit(beta))


def _forest(spark, d):
    from pyspark.ml.regression import RandomForestRegressor

    x = D.assembled(table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_size"])
    return x, RandomForestRegressor(featuresCol="features", labelCol="p_retailprice", numTrees=5, maxDepth=4, seed=1).fit(x)


@query()
def forest_interval(spark, d):
    x, model = _forest(spark, d)
    return D.prediction_interval(x, model, percentile=90).select("p_partkey", "lower", "upper")


@query()
def forest_contributions(spark, d):
    x, model = _forest(spark, d)
    return D.feature_contributions(model.transform(x), model).select("p_partkey", "prediction", F.col("bias")[0].alias("bias"), F.col("contributions")[0].alias("p_size"))


@query()
def calibrated_proba(spark, d):
    x = D.assembled(_scored(spark, d).where("y is not null"), ["score"])
    return D.BinaryCalibrator().fit(x, "y", "doc_id").transform(x).select("doc_id", "probability_1")


@query("SELECT c_mktsegment, avg(c_acctbal) > 0 AS positive FROM customer GROUP BY 1")
def sql_source(spark, d):
    from tidemill.sources.tables import QuerySource

    table(spark, d, "customer").createOrReplaceTempView("tidemill_customer")
    return QuerySource("SELECT c_mktsegment, avg(c_acctbal) > 0 AS positive FROM tidemill_customer GROUP BY 1").read(spark)
