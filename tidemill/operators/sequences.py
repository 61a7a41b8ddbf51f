"""Sequence mining: Markov chains, durations between states, and decoders of labelled sequences.

Counting is relational (a lead, a grouping, a ratio); only the recurrences along a sequence run in numpy, one sequence a call, with the small model
sent along.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.common import bounded_rows, require
from tidemill.operators.timeseries import histogram

#: States and transitions a model holds at most: it is sent to every executor.
MAX_STATES, MAX_TRANSITIONS = 5_000, 1_000_000


def _ordered(seq: str, order_by: Sequence[str]):
    return Window.partitionBy(seq).orderBy(*order_by)


def transitions(df: DataFrame, state: str, seq: str, order_by: Sequence[str]) -> DataFrame:
    """(from_state, to_state, n, p): counted steps within sequences and their share among steps from the same state. Null states are no states."""
    require(df, state, seq, *order_by)
    steps = df.where(F.col(state).isNotNull()).select(F.col(state).alias("from_state"), F.lead(state).over(_ordered(seq, order_by)).alias("to_state")).where("to_state is not null")
    counts = steps.groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from_state")))


def transition_probabilities(df: DataFrame, model: DataFrame, state: str, seq: str, order_by: Sequence[str]) -> DataFrame:
    """``df`` with ``transition_p``: the model's probability of the step into each row, 1 for a sequence's first row, 0 for steps the model hasn't seen."""
    w = _ordered(seq, order_by)
    with_last = df.withColumn("__from", F.lag(state).over(w)).withColumn("__first", F.row_number().over(w) == 1)
    m = model.select(F.col("from_state").alias("__f"), F.col("to_state").alias("__t"), F.col("p").alias("__p"))
    joined = with_last.join(F.broadcast(m) if m.limit(100_001).count() <= 100_000 else m, (F.col("__from") == F.col("__f")) & (F.col(state) == F.col("__t")), "left")
    return joined.withColumn("transition_p", F.when(F.col("__first"), 1.0).otherwise(F.coalesce("__p", F.lit(0.0)))).drop("__from", "__first", "__f", "__t", "__p")


def next_states(model: DataFrame) -> DataFrame:
    """(state, next_state, p): the most probable next states, all tied ones."""
    w = Window.partitionBy("from_state").orderBy(F.desc("n"))
    return model.withColumn("r", F.rank().over(w)).where("r = 1").select(F.col("from_state").alias("state"), F.col("to_state").alias("next_state"), "p")


class MarkovChain:
    """A first-order chain with its states in a small matrix."""

    def __init__(self, states: list[str], matrix: np.ndarray):
        self.states, self.matrix = states, matrix
        self.index = {s: i for i, s in enumerate(states)}

    @classmethod
    def fit(cls, df: DataFrame, state: str, seq: str, order_by: Sequence[str]) -> MarkovChain:
        rows = bounded_rows(transitions(df, state, seq, order_by), MAX_TRANSITIONS, "transitions")
        states = sorted({r.from_state for r in rows} | {r.to_state for r in rows})
        if len(states) > MAX_STATES:
            raise ValueError(f"more than {MAX_STATES} states")
        matrix = np.zeros((len(states), len(states)))
        at = {s: i for i, s in enumerate(states)}
        for r in rows:
            matrix[at[r.from_state], at[r.to_state]] = r.p
        return cls(states, matrix)

    def start(self, first: str | None, equal: bool = False) -> np.ndarray:
        v = np.zeros(len(self.states))
        if equal:
            v[:] = 1 / max(1, len(v))
        elif first in self.index:
            v[self.index[first]] = 1.0
        return v

    def chained(self, sequence: Sequence[str], vector: np.ndarray | None = None) -> tuple[list[float], np.ndarray]:
        """Probability of each state by carrying the first state's vector along, 0 for and right after an unknown state; and the last vector, from which a later call, begun with the last state, goes on."""
        v, out = self.start(sequence[0] if len(sequence) else None) if vector is None else vector, [1.0] * min(1, len(sequence))
        for a, b in zip(sequence, sequence[1:]):
            v = v @ self.matrix
            out.append(float(v[self.index[b]]) if a in self.index and b in self.index else 0.0)
        return out, v

    def predict_next(self, vector: np.ndarray) -> list[str]:
        ahead = vector @ self.matrix
        return [s for s, p in zip(self.states, ahead) if len(ahead) and p == ahead.max() and p > 0]

    def likely(self, sequence: Sequence[str], first: str | None = None) -> list[bool]:
        """Whether each state is a most probable one of the carried vector; the first state is held against the state ``first``."""
        out, v = [bool(first is not None and sequence[0] == first)] if len(sequence) else [], self.start(sequence[0] if len(sequence) else None)
        for b in sequence[1:]:
            v = v @ self.matrix
            out.append(bool(v.max() > 0 and b in self.index and np.isclose(v[self.index[b]], v.max())))
        return out


def per_sequence(df: DataFrame, seq: str, order_by: Sequence[str], fields: str, function: Callable[[pd.DataFrame], dict[str, Sequence]]) -> DataFrame:
    """``df`` with columns that a function makes of each whole sequence in order. A recurrence needs its sequence in one place; sequences spread over all tasks."""
    from tidemill.operators.outliers import _top_level

    schema = ", ".join(s.replace(":", " ", 1) for s in _top_level(df.schema.simpleString()[7:-1])) + ", " + fields

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(order_by))
        return group.assign(**{k: list(v) for k, v in function(group).items()})

    return df.groupBy(seq).applyInPandas(one, schema)


def chained_probabilities(df: DataFrame, chain: MarkovChain, state: str, seq: str, order_by: Sequence[str]) -> DataFrame:
    """``df`` with ``chained_p`` of each state of its sequence."""
    return per_sequence(df, seq, order_by, "chained_p double", lambda g: {"chained_p": chain.chained(g[state].tolist())[0]})


def durations(df: DataFrame, state: str, time: str, seq: str, order_by: Sequence[str]) -> DataFrame:
    """(from_state, to_state, duration): seconds, or the difference of a number, of each step within a sequence."""
    require(df, state, time, seq, *order_by)
    w = _ordered(seq, order_by)
    kind = dict(df.dtypes)[time]
    if kind.startswith("timestamp"):
        from tidemill.functions.times import micros

        df = df.withColumn("__t", micros(F.col(time)) / 1e6)
    else:
        df = df.withColumn("__t", F.col(time).cast("double"))
    return df.select(F.lag(state).over(w).alias("from_state"), F.col(state).alias("to_state"), (F.col("__t") - F.lag("__t").over(w)).alias("duration")).where("from_state is not null and duration is not null")


def duration_model(df: DataFrame, state: str, time: str, seq: str, order_by: Sequence[str], bins: int = 3, log_base: bool = False) -> DataFrame:
    """(from_state, to_state, lo, hi, total, counts): a histogram of the durations of each kind of step over its own range. Least, greatest and counts are two pre-aggregated passes, so a frequent step is a few counters a task. ``log_base`` takes logarithms of 1 + duration, which scoring repeats."""
    d = durations(df, state, time, seq, order_by)
    if log_base:
        d = d.withColumn("duration", F.log1p("duration"))
    span = d.groupBy("from_state", "to_state").agg(F.min("duration").alias("a"), F.max("duration").alias("b"))
    lo, width = F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")), F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.col("b") - F.col("a"))
    span = span.select("from_state", "to_state", lo.alias("lo"), (lo + width).alias("hi"))
    placed = d.join(F.broadcast(span) if span.limit(100_001).count() <= 100_000 else span, ["from_state", "to_state"])
    b = F.least(F.lit(bins - 1), F.floor((F.col("duration") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)).cast("int"))
    counts = placed.groupBy("from_state", "to_state", "lo", "hi", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("from_state", "to_state", "lo", "hi").agg(F.sum("n").alias("total"), *(F.sum(F.when(F.col("bin") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(bins)))
    return per.select("from_state", "to_state", "lo", "hi", "total", F.array(*(f"n{i}" for i in range(bins))).alias("counts"))


def duration_probabilities(df: DataFrame, model: DataFrame, state: str, time: str, seq: str, order_by: Sequence[str], log_base: bool = False) -> DataFrame:
    """``df`` with ``duration_p``: the share of its bucket in the histogram of its kind of step; 1 for a sequence's first row, 0 for unseen steps, beyond the range and at its very end."""
    w = _ordered(seq, order_by)
    from tidemill.functions.times import micros

    t = micros(F.col(time)) / 1e6 if dict(df.dtypes)[time].startswith("timestamp") else F.col(time).cast("double")
    d = df.withColumn("__t", t)
    step = F.col("__t") - F.lag("__t").over(w)
    d = d.withColumn("__d", F.log1p(step) if log_base else step).withColumn("__from", F.lag(state).over(w)).withColumn("__first", F.row_number().over(w) == 1)
    m = model.select(F.col("from_state").alias("__f"), F.col("to_state").alias("__to"), "lo", "hi", "total", "counts")
    j = d.join(F.broadcast(m) if m.limit(100_001).count() <= 100_000 else m, (F.col("__from") == F.col("__f")) & (F.col(state) == F.col("__to")), "left")
    place = F.floor((F.col("__d") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.size("counts"))).cast("int")
    inside = (F.col("__d") >= F.col("lo")) & (F.col("__d") < F.col("hi"))
    p = F.when(F.col("__first"), 1.0).when(inside, F.get("counts", F.least(place, F.size("counts") - 1)) / F.col("total")).otherwise(0.0)
    return j.withColumn("duration_p", p).drop("__t", "__d", "__from", "__first", "__f", "__to", "lo", "hi", "total", "counts")


def merged_probability(a: Column, b: Column, operation: Callable[[Column, Column], Column] | None = None) -> Column:
    """Two probabilities as one: their mean, or what ``operation`` makes of them."""
    return (a + b) / 2 if operation is None else operation(a, b)


def window_histogram(values: Column, bins: int) -> Column:
    """See ``timeseries.histogram``."""
    return histogram(values, bins)


# -- labelled sequences ---------------------------------------------------------------------------------------------------


def viterbi(scores: np.ndarray, steps: np.ndarray, first: np.ndarray, last: np.ndarray, per_position: np.ndarray | None = None) -> list[int]:
    """The best path through (n, k) scores with (k, k) step scores, first maximum on ties."""
    n, k = scores.shape
    best, back = scores[0] + first, np.zeros((n, k), int)
    for t in range(1, n):
        ahead = best[:, None] + steps + (0 if per_position is None else per_position[t])
        back[t] = ahead.argmax(axis=0)
        best = ahead.max(axis=0) + scores[t]
    path = [int((best + last).argmax())]
    for t in range(n - 1, 0, -1):
        path.append(int(back[t][path[-1]]))
    return path[::-1]


def best_first(scores: np.ndarray, steps: np.ndarray, first: np.ndarray, last: np.ndarray, per_position: np.ndarray | None = None) -> list[int]:
    """Each position's best label after the one chosen before it; step scores of single positions aren't taken."""
    if per_position is not None:
        raise NotImplementedError("scores of steps at single positions")
    path: list[int] = []
    for t, row in enumerate(scores):
        total = row + (first if t == 0 else steps[path[-1]])
        if t == len(scores) - 1:
            total = total + last
        path.append(int(total.argmax()))
    return path


DECODERS = {"viterbi": viterbi, "bestfirst": best_first}


class Tagger:
    """Decodes sequences of feature vectors with a linear model of labels."""

    def __init__(self, labels: list[str], weights: np.ndarray, steps: np.ndarray, first: np.ndarray, last: np.ndarray, decoder: str = "viterbi"):
        self.labels, self.weights, self.steps, self.first, self.last, self.decoder = labels, weights, steps, first, last, decoder

    def tag(self, features: np.ndarray) -> list[str]:
        if not len(features):
            return []
        return [self.labels[i] for i in DECODERS[self.decoder](features @ self.weights.T, self.steps, self.first, self.last)]

    def transform(self, df: DataFrame, features: str, seq: str, order_by: Sequence[str], to: str = "label") -> DataFrame:
        """``df`` with the decoded label of each row; ``features`` is an array column."""
        return per_sequence(df, seq, order_by, f"{to} string", lambda g: {to: self.tag(np.array(g[features].tolist(), dtype=float))})

    def accuracy(self, df: DataFrame, features: str, label: str, seq: str, order_by: Sequence[str]) -> float:
        out = self.transform(df, features, seq, order_by, "__label")
        return out.agg(F.avg((F.col("__label") == F.col(label)).cast("double"))).first()[0]


def _log_shares(counts: np.ndarray, alpha: float) -> np.ndarray:
    """Smoothed counts as log shares of their columns."""
    smooth = counts + alpha
    return np.log(smooth) - np.log(smooth.sum(axis=0, keepdims=True))


def supervised_hmm(df: DataFrame, features: str, label: str, seq: str, order_by: Sequence[str], alpha: float = 0.01, decoder: str = "viterbi") -> Tagger:
    """A hidden Markov model counted from labelled rows: one grouping each for emissions, steps and beginnings, smoothed by ``alpha``. Steps aren't counted across sequences; endings take the share of beginnings."""
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    require(df, features, label, seq, *order_by)
    w = _ordered(seq, order_by)
    seen = df.where(F.col(label).isNotNull())
    emitted = bounded_rows(seen.select(F.col(label).alias("y"), F.posexplode(features).alias("f", "x")).where("x <> 0").groupBy("y", "f").agg(F.sum(F.col("x").cast("double")).alias("n")), MAX_TRANSITIONS, "features")
    width = seen.agg(F.max(F.size(features))).first()[0] or 0
    marked = seen.select(F.col(label).alias("y"), F.lead(label).over(w).alias("z"), (F.row_number().over(w) == 1).alias("begins"))
    counts = bounded_rows(marked.groupBy("y", "z").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("begins").cast("long")).alias("b")), MAX_TRANSITIONS, "steps")
    labels = sorted({r.y for r in counts})
    at, k = {y: i for i, y in enumerate(labels)}, len(labels)
    e, s, b = np.zeros((k, width)), np.zeros((k, k)), np.zeros(k)
    for r in emitted:
        e[at[r.y], r.f] += r.n
    for r in counts:
        b[at[r.y]] += r.b
        if r.z is not None:
            s[at[r.y], at[r.z]] += r.n
    edge = np.log(b + alpha) - np.log((b + alpha).sum())
    return Tagger(labels, _log_shares(e, alpha), _log_shares(s, alpha), edge, edge, decoder)


def structured_perceptron(sequences: Sequence[tuple[np.ndarray, Sequence[str]]], rate_exponent: float = 0.1, iterations: int = 10, decoder: str = "viterbi", seed: int | None = None) -> Tagger:
    """An averaged perceptron over whole sequences. Each update needs the one before, so it trains in one place; decoding spreads over all tasks."""
    labels = sorted({y for _, ys in sequences for y in ys})
    at, k = {y: i for i, y in enumerate(labels)}, len(labels)
    d = sequences[0][0].shape[1] if sequences else 0
    now = [np.zeros((k, d)), np.zeros((k, k)), np.zeros(k), np.zeros(k)]
    total, steps = [x.copy() for x in now], 0
    random, order = np.random.default_rng(seed), list(range(len(sequences)))
    for turn in range(1, iterations + 1):
        random.shuffle(order)
        rate = 1.0 / turn**rate_exponent
        for i in order:
            x, ys = sequences[i]
            want = [at[y] for y in ys]
            got = DECODERS[decoder](x @ now[0].T, now[1], now[2], now[3])
            for path, sign in ((want, rate), (got, -rate)):
                if want != got:
                    np.add.at(now[0], path, sign * x)
                    np.add.at(now[1], (path[:-1], path[1:]), sign)
                    now[2][path[0]] += sign
                    now[3][path[-1]] += sign
            steps += 1
            for t, x_ in zip(total, now):
                t += x_
    return Tagger(labels, *(t / max(1, steps) for t in total), decoder=decoder)
