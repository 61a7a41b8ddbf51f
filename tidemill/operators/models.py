"""Model tools: calibration after under-sampling, tree explanations and intervals, rotation forests, backward selection, pipelines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.common import require
from tidemill.functions.scalars import bias_corrected, plotting_quantiles, random_rotation, tail_scaled
from tidemill.operators.relational import undersampled


def assembled(df: DataFrame, cols: Sequence[str], to: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=to, handleInvalid="skip").transform(df)


# -- calibration ----------------------------------------------------------------------------------------------------------


class BinaryCalibrator:
    """Fits a probabilistic classifier on data whose majority class is cut to size, and undoes the cut's effect on its probabilities."""

    def __init__(self, estimator=None, share: float = 1.0, seed: int = 42):
        self.estimator = estimator or LogisticRegression()
        if not hasattr(self.estimator, "getProbabilityCol"):
            raise TypeError("the estimator gives no probabilities")
        self.share, self.seed = share, seed
        self.beta = self.tau = self.model = None

    def fit(self, df: DataFrame, label: str, key: str) -> BinaryCalibrator:
        require(df, label, key)
        kept, self.beta = undersampled(df, label, key, self.share, self.seed)
        counts = {r[0]: r[1] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
        self.tau = counts.get(1, 0) / sum(counts.values())
        self.model = self.estimator.copy({self.estimator.labelCol: label}).fit(kept)
        return self

    def transform(self, df: DataFrame, to: str = "probability_1") -> DataFrame:
        p = vector_to_array(F.col(self.estimator.getProbabilityCol()))[1]
        return self.model.transform(df).withColumn(to, bias_corrected(p, self.beta))

    def threshold(self) -> float:
        """The corrected counterpart of one half: the share of positives before the cut."""
        return self.tau


# -- trees ----------------------------------------------------------------------------------------------------------------


def tree_nodes(model) -> pd.DataFrame:
    """Nodes of one fitted tree: feature (-1 at a leaf), threshold or left categories, children and value (class shares or the prediction)."""
    rows: list[dict] = []
    classes = getattr(model, "numClasses", 0) or 0

    def value(node) -> list[float]:
        if classes:
            stats = np.array(list(node.impurityStats().stats()), dtype=float)
            return list(stats / max(stats.sum(), 1e-300))
        return [float(node.prediction())]

    def walk(node) -> int:
        at = len(rows)
        rows.append({"feature": -1, "threshold": 0.0, "left_set": None, "left": -1, "right": -1, "value": value(node)})
        if node.subtreeDepth() > 0:
            split = node.split()
            rows[at]["feature"] = split.featureIndex()
            if hasattr(split, "threshold"):
                rows[at]["threshold"] = float(split.threshold())
            else:
                rows[at]["left_set"] = [float(x) for x in split.leftCategories()]
            rows[at]["left"], rows[at]["right"] = walk(node.leftChild()), walk(node.rightChild())
        return at

    walk(model._call_java("rootNode"))
    return pd.DataFrame(rows)


def _path_parts(nodes: pd.DataFrame, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bias and contributions (rows, features, outputs) of one tree for a batch."""
    values = np.array(nodes["value"].tolist())
    feature, threshold, left, right, sets = (nodes[c].to_numpy() for c in ("feature", "threshold", "left", "right", "left_set"))
    out, at = np.zeros((len(x), width, values.shape[1])), np.zeros(len(x), int)
    rows = np.arange(len(x))
    while len(rows):
        rows = rows[feature[at[rows]] >= 0]
        if not len(rows):
            break
        f = feature[at[rows]].astype(int)
        v = x[rows, f]
        go = np.array([v[i] in sets[n] if sets[n] is not None else v[i] <= threshold[n] for i, n in enumerate(at[rows])], dtype=bool)
        to = np.where(go, left[at[rows]], right[at[rows]]).astype(int)
        np.add.at(out, (rows, f), values[to] - values[at[rows]])
        at[rows] = to
    return np.tile(values[0], (len(x), 1)), out


def feature_contributions(df: DataFrame, model, features: str = "features") -> DataFrame:
    """``df`` with ``bias`` (per output) and ``contributions`` (features by outputs, row by row): a forest's mean prediction is their sum, tree by tree along each path. Node tables are sent once; rows go through in batches."""
    require(df, features)
    trees = getattr(model, "trees", None) or [model]
    tables, width = [tree_nodes(t) for t in trees], model.numFeatures
    # GBT weighs its trees, a forest averages them
    weights = np.array(list(model.treeWeights)) if hasattr(model, "treeWeights") else np.ones(len(trees))
    weights = weights / weights.sum() if "Forest" in type(model).__name__ or len(trees) == 1 else weights

    @F.pandas_udf("struct<bias:array<double>,contributions:array<double>>")
    def explain(vectors: pd.Series) -> pd.DataFrame:
        x = np.array(vectors.tolist())
        bias, parts = 0.0, 0.0
        for nodes, w in zip(tables, weights):
            b, p = _path_parts(nodes, x, width)
            bias, parts = bias + w * b, parts + w * p
        return pd.DataFrame({"bias": list(bias), "contributions": list(parts.reshape(len(x), -1))})

    return df.withColumn("__e", explain(vector_to_array(F.col(features)))).withColumns({"bias": F.col("__e.bias"), "contributions": F.col("__e.contributions")}).drop("__e")


def interval_of(predictions: Sequence[float], percentile: float = 95) -> tuple[float, float]:
    """Lower and upper linear percentile that hold ``percentile`` per cent of predictions."""
    tail = (100 - percentile) / 2
    return float(np.percentile(predictions, tail)), float(np.percentile(predictions, 100 - tail))


def prediction_interval(df: DataFrame, model, features: str = "features", percentile: float = 95) -> DataFrame:
    """``df`` with ``lower`` and ``upper`` from the predictions of a forest's single trees."""
    require(df, features)
    tables = [tree_nodes(t) for t in model.trees]
    width = model.numFeatures

    @F.pandas_udf("struct<lower:double,upper:double>")
    def bounds(vectors: pd.Series) -> pd.DataFrame:
        x = np.array(vectors.tolist())
        each = np.array([(lambda b, p: (b + p.sum(axis=1))[:, -1])(*_path_parts(t, x, width)) for t in tables])
        tail = (100 - percentile) / 2
        return pd.DataFrame({"lower": np.percentile(each, tail, axis=0), "upper": np.percentile(each, 100 - tail, axis=0)})

    return df.withColumn("__i", bounds(vector_to_array(F.col(features)))).withColumns({"lower": F.col("__i.lower"), "upper": F.col("__i.upper")}).drop("__i")


class RotationForest:
    """Trees on randomly rotated, tail-scaled features, their class probabilities averaged. ``extra`` grows trees on all rows with few, randomly chosen candidate splits, the nearest that MLlib offers to wholly random splits."""

    def __init__(self, trees: int = 10, seed: int = 42, scaling: bool = True, extra: bool = False, depth: int = 8):
        self.trees, self.seed, self.scaling, self.extra, self.depth = trees, seed, scaling, extra, depth

    def fit(self, df: DataFrame, cols: Sequence[str], label: str) -> RotationForest:
        require(df, *cols, label)
        self.cols = list(cols)
        self.tails = {c: plotting_quantiles(df, c, [0.05, 0.95]) for c in cols} if self.scaling else {}
        base, self.parts = self._scaled(df).persist(), []
        try:
            for i in range(self.trees):
                rotation = random_rotation(len(cols), self.seed + i)
                rows = base if self.extra else base.sample(True, 1.0, self.seed + i)
                turned = assembled(self._turned(rows, rotation), [f"__r{j}" for j in range(len(cols))], "__f")
                tree = DecisionTreeClassifier(labelCol=label, featuresCol="__f", maxDepth=self.depth, seed=self.seed + i, maxBins=8 if self.extra else 32)
                self.parts.append((rotation, tree.fit(turned)))
        finally:
            base.unpersist()
        return self

    def _scaled(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"__s{j}": tail_scaled(F.col(c), *self.tails[c]) if self.scaling else F.col(c).cast("double") for j, c in enumerate(self.cols)})

    def _turned(self, df: DataFrame, rotation: np.ndarray) -> DataFrame:
        d = len(self.cols)
        return df.withColumns({f"__r{j}": sum((F.col(f"__s{i}") * float(rotation[i, j]) for i in range(d)), F.lit(0.0)) for j in range(d)})

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probabilities`` (an array) and ``prediction``."""
        out, d = self._scaled(df), len(self.cols)
        names = []
        for i, (rotation, tree) in enumerate(self.parts):
            out = tree.setProbabilityCol(f"__p{i}").setRawPredictionCol(f"__w{i}").setPredictionCol(f"__y{i}").transform(assembled(self._turned(out, rotation), [f"__r{j}" for j in range(d)], "__f"))
            out = out.withColumn(f"__a{i}", vector_to_array(f"__p{i}")).drop("__f", f"__p{i}", f"__w{i}", f"__y{i}", *(f"__r{j}" for j in range(d)))
            names.append(f"__a{i}")
        n = len(names)
        mean = F.transform(F.sequence(F.lit(1), F.size(names[0])), lambda k: sum((F.element_at(a, k) for a in names), F.lit(0.0)) / n)
        out = out.withColumn("probabilities", mean).drop(*names, *(f"__s{j}" for j in range(d)))
        return out.withColumn("prediction", (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("double"))


# -- selection and pipelines ----------------------------------------------------------------------------------------------


def backward_selection(train: DataFrame, test: DataFrame, cols: Sequence[str], estimator, loss: Callable[[DataFrame], float]) -> tuple[list[str], float]:
    """Drops columns one by one as long as the loss on ``test`` doesn't grow; ends after a round without a drop."""
    kept = list(cols)

    def measured(names: list[str]) -> float:
        return loss(estimator.fit(assembled(train, names)).transform(assembled(test, names)))

    best, dropped = measured(kept), True
    while dropped and len(kept) > 1:
        dropped = False
        for c in list(kept):
            rest = [x for x in kept if x != c]
            if rest and (now := measured(rest)) <= best:
                best, kept, dropped = now, rest, True
    return kept, best


def fit_and_save(df: DataFrame, cols: Sequence[str], label: str, path: str, kind: str = "forest", **options) -> PipelineModel:
    """Fits a forest or boosted trees in a pipeline and saves it."""
    make = {"forest": RandomForestClassifier, "forest_regression": RandomForestRegressor, "boosting": GBTRegressor}[kind]
    model = Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="skip"), make(labelCol=label, featuresCol="features", **options)]).fit(df)
    model.write().overwrite().save(path)
    return model


def load_and_predict(df: DataFrame, path: str) -> DataFrame:
    return PipelineModel.load(path).transform(df)


def text_classifier(labels: int = 2, hidden: int = 32) -> Pipeline:
    """A text pipeline in place of recurrent networks: hashed token counts and a linear classifier."""
    from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer

    del labels, hidden
    return Pipeline(stages=[StringIndexer(inputCol="class", outputCol="label", handleInvalid="skip"), RegexTokenizer(inputCol="text", outputCol="tokens", pattern=r"\W+"), HashingTF(inputCol="tokens", outputCol="tf", numFeatures=1 << 16), IDF(inputCol="tf", outputCol="features"), LogisticRegression(maxIter=20)])


def density_grid(df: DataFrame, x: str, y: str, size: int = 100) -> DataFrame:
    """(i, j, n): the data of a two-dimensional density plot, rows counted in a grid over the range of both columns."""
    require(df, x, y)
    s = df.agg(F.min(x).alias("a"), F.max(x).alias("b"), F.min(y).alias("c"), F.max(y).alias("d")).first()
    place = lambda c, lo, hi: F.least(F.lit(size - 1), F.floor((F.col(c) - F.lit(lo)) / F.lit(((hi - lo) or 1.0) / size)).cast("int"))
    if s["a"] is None:
        return df.select(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).cast("long").alias("n")).limit(0)
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(place(x, s["a"], s["b"]).alias("i"), place(y, s["c"], s["d"]).alias("j")).agg(F.count(F.lit(1)).alias("n"))
