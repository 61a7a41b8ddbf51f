"""Metrics over columns of truth and prediction: one pre-aggregated pass each, cumulative ones over grouped scores."""

from __future__ import annotations

import functools
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.common import require


# -- regression -----------------------------------------------------------------------------------------------------------


def _share(y: Column, p: Column) -> Column:
    return F.try_divide(y - p, y)


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg(F.pow(y - p, F.lit(2.0))))


def mspe(y: Column, p: Column) -> Column:
    """Mean squared share of the error; rows of truth zero are left out."""
    return F.avg(F.pow(_share(y, p), F.lit(2.0)))


def rmspe(y: Column, p: Column) -> Column:
    return F.sqrt(mspe(y, p))


def mape(y: Column, p: Column) -> Column:
    return F.avg(F.abs(_share(y, p)))


def smape(y: Column, p: Column) -> Column:
    """Mean of the absolute error through the mean of truth and prediction."""
    return F.avg(F.try_divide(F.abs(y - p), (y + p) / 2))


def srmspe(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg(F.pow(F.try_divide(y - p, (y + p) / 2), F.lit(2.0))))


REGRESSION = {f.__name__: f for f in (rmse, mspe, rmspe, mape, smape, srmspe)}


def regression_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """All regression metrics in one pass."""
    require(df, y, p)
    return df.agg(*(f(F.col(y), F.col(p)).alias(n) for n, f in REGRESSION.items()))


# -- classification by score ----------------------------------------------------------------------------------------------


def has_positive(df: DataFrame, y: str) -> bool:
    return (df.agg(F.sum(F.col(y).cast("long"))).first()[0] or 0) > 0


def threshold_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, tp, fp, positives, negatives) for each distinct score, predicting positive from it upwards. Rows are grouped by score before anything is ordered; the running sums then go over ranges of scores, so that no task sees them all."""
    require(df, y, score)
    per = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(y).cast("long")).alias("p"), F.sum(1 - F.col(y).cast("long")).alias("n"))
    ranged = per.repartitionByRange(F.desc("threshold")).withColumn("part", F.spark_partition_id())
    from tidemill.common import written

    kept = written(ranged)
    parts = kept.groupBy("part").agg(F.sum("p").alias("pp"), F.sum("n").alias("nn"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("part", F.coalesce(F.sum("pp").over(ahead), F.lit(0)).alias("p0"), F.coalesce(F.sum("nn").over(ahead), F.lit(0)).alias("n0"))
    totals = parts.agg(F.sum("pp").alias("positives"), F.sum("nn").alias("negatives")).first()
    within = Window.partitionBy("part").orderBy(F.desc("threshold"))
    run = kept.join(F.broadcast(before), "part").select("threshold", (F.col("p0") + F.sum("p").over(within)).alias("tp"), (F.col("n0") + F.sum("n").over(within)).alias("fp"))
    return run.select("threshold", "tp", "fp", F.lit(totals["positives"]).alias("positives"), F.lit(totals["negatives"]).alias("negatives"))


def precision_at_recall(df: DataFrame, y: str, score: str, recall: float) -> DataFrame:
    """(precision, threshold) at the largest threshold whose recall reaches ``recall``; raises without a positive."""
    if not has_positive(df, y):
        raise ValueError("no positive")
    curve = threshold_curve(df, y, score).where(F.col("tp") / F.col("positives") >= recall)
    return curve.agg(F.max_by(F.col("tp") / (F.col("tp") + F.col("fp")), "threshold").alias("precision"), F.max("threshold").alias("threshold"))


def recall_at_precision(df: DataFrame, y: str, score: str, precision: float) -> DataFrame:
    """(recall, threshold) at the smallest threshold whose precision reaches ``precision``."""
    if not has_positive(df, y):
        raise ValueError("no positive")
    curve = threshold_curve(df, y, score).where(F.col("tp") / (F.col("tp") + F.col("fp")) >= precision)
    return curve.agg(F.min_by(F.col("tp") / F.col("positives"), "threshold").alias("recall"), F.min("threshold").alias("threshold"))


def roc_points(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr) for each distinct score."""
    return threshold_curve(df, y, score).select("threshold", F.try_divide("fp", "negatives").alias("fpr"), F.try_divide("tp", "positives").alias("tpr"))


def auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """(auc): area under the ROC curve, from sums over distinct scores: a negative counts the positives above it, and half of those of its own score."""
    curve = threshold_curve(df, y, score)
    per = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(y).cast("long")).alias("p"), F.sum(1 - F.col(y).cast("long")).alias("n"))
    both = curve.join(per, "threshold")
    return both.agg(F.try_divide(F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)), F.max("positives") * F.max("negatives")).alias("auc"))


def binarize(score: Column, threshold: float) -> Column:
    return F.when(score >= threshold, 1).otherwise(0)


def confusion(df: DataFrame, y: str, p: str, normalize: bool = True) -> DataFrame:
    """(truth, predicted, n) or shares of each truth's row, of pairs that occur."""
    require(df, y, p)
    counts = df.groupBy(F.col(y).alias("truth"), F.col(p).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("truth"))) if normalize else counts


def label_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """(accuracy, micro_f1, macro_f1): macro over labels of truth or prediction; a label without hits counts 0."""
    hit = df.groupBy(F.col(y).alias("label")).agg(F.count(F.lit(1)).alias("t"), F.sum((F.col(y) == F.col(p)).cast("long")).alias("tp"), F.lit(0).cast("long").alias("g"))
    guess = df.groupBy(F.col(p).alias("label")).agg(F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("tp"), F.count(F.lit(1)).alias("g"))
    per = hit.unionByName(guess).groupBy("label").agg(*(F.sum(c).alias(c) for c in ("t", "tp", "g")))
    return per.agg((F.sum("tp") / F.sum("t")).alias("accuracy"), (F.sum("tp") / F.sum("t")).alias("micro_f1"), F.avg(F.coalesce(F.try_divide(2 * F.col("tp"), F.col("t") + F.col("g")), F.lit(0.0))).alias("macro_f1"))


# -- texts and sequences --------------------------------------------------------------------------------------------------


def _counts(values: Column) -> Column:
    return F.transform(F.array_distinct(values), lambda x: F.struct(x.alias("x"), F.size(F.filter(values, lambda y: y == x)).alias("n")))


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Shared part of two arrays as multisets: sum of the lesser counts through sum of the greater; 0 for two empty ones."""
    n_in = lambda values, x: F.size(F.filter(values, lambda y: y == x))
    every = F.array_distinct(F.concat(a, b))
    fold = lambda pick: F.aggregate(every, F.lit(0), lambda s, x: s + pick(n_in(a, x), n_in(b, x)))
    return F.coalesce(F.try_divide(fold(F.least), fold(F.greatest)), F.lit(0.0))


def character_jaccard(a: Column, b: Column) -> Column:
    """``multiset_jaccard`` of the characters of two texts, in time in proportion to their length; 0 where one is null."""

    @F.pandas_udf("double")
    def score(left: pd.Series, right: pd.Series) -> pd.Series:
        counts = functools.lru_cache(maxsize=1024)(Counter)

        def one(x: str | None, y: str | None) -> float:
            if not x or not y:
                return 0.0
            p, q = counts(x), counts(y)
            both = sum(min(n, q[c]) for c, n in p.items() if c in q)
            return both / (len(x) + len(y) - both)

        return pd.Series([one(x, y) for x, y in zip(left, right)], dtype="float64")

    return score(a, b)


def segments(df: DataFrame, tag: str, order_by: str, seq: str) -> DataFrame:
    """(seq, start, length, kind): segments of tags B-x followed by I-x; anything else ends one."""
    w = Window.partitionBy(seq).orderBy(order_by)
    kind = F.substring(F.col(tag), 3, 1000)
    begins = F.col(tag).startswith("B")
    inside = F.col(tag).startswith("I")
    marked = df.select(F.col(seq).alias("seq"), F.col(tag).alias("tag"), kind.alias("kind"), F.row_number().over(w).alias("at"), F.sum((begins | ~inside).cast("int")).over(w).alias("part"), begins.alias("b"), inside.alias("i"))
    grouped = marked.groupBy("seq", "part").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("length"), F.min_by("kind", "at").alias("kind"), F.min_by("b", "at").alias("b"))
    return grouped.where("b").select("seq", "start", "length", "kind")


def bio_f_score(df: DataFrame, y: str, p: str, order_by: str, seq: str) -> DataFrame:
    """(f_score) of whole segments; 0 without a shared one."""
    require(df, y, p, order_by, seq)
    t = segments(df, y, order_by, seq).withColumn("t", F.lit(1)).withColumn("g", F.lit(0))
    g = segments(df, p, order_by, seq).withColumn("t", F.lit(0)).withColumn("g", F.lit(1))
    per = t.unionByName(g).groupBy("seq", "start", "length", "kind").agg(F.sum("t").alias("t"), F.sum("g").alias("g"))
    return per.agg(F.coalesce(F.try_divide(2 * F.sum(F.least("t", "g")), F.sum("t") + F.sum("g")), F.lit(0.0)).alias("f_score"))


def whole_sequence_accuracy(df: DataFrame, y: str, p: str, seq: str) -> DataFrame:
    """(accuracy): share of sequences predicted without a fault."""
    require(df, y, p, seq)
    return df.groupBy(seq).agg(F.bool_and(F.col(y).eqNullSafe(F.col(p))).alias("ok")).agg(F.avg(F.col("ok").cast("double")).alias("accuracy"))


def sequence_folds(df: DataFrame, seq: str, folds: int = 3) -> DataFrame:
    """(seq, length, fold): sequences packed greedily, longest first, each into the fold that has fewest rows so far. Lengths alone are packed, in one ordered fold over a table of one row a sequence."""
    require(df, seq)
    lengths = df.groupBy(F.col(seq).alias("seq")).agg(F.count(F.lit(1)).alias("length"))
    order = lengths.agg(F.array_sort(F.collect_list(F.struct((-F.col("length")).alias("key"), F.col("seq").alias("seq")))).alias("all"))

    def pack(groups):
        import pandas as pd

        for b in groups:
            for items in b["all"]:
                load, out = [0] * folds, []
                for x in items:
                    f = min(range(folds), key=lambda i: (load[i], i))
                    load[f] -= x["key"]
                    out.append((x["seq"], -x["key"], f))
                if out:
                    yield pd.DataFrame(out, columns=["seq", "length", "fold"])

    return order.mapInPandas(pack, f"seq {dict(lengths.dtypes)['seq']}, length long, fold int")
