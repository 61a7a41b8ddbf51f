"""Abusive, hateful or sexual passages (problem 8): subword-bag embeddings averaged into a linear softmax.

A text is cut into short windows of words in its writer's own voice (markup and quotations taken out, disguises undone). A
window is the mean of its words, a word the mean of the embeddings of its character n-grams, so unseen spellings share
vectors with known ones. Embeddings and softmax are trained jointly in numpy on a bounded sample of labelled documents. As a
label stands for a whole document and isn't always right, training has rounds: the first takes every window of some marked
documents as positive and every one of as many unmarked documents as negative, each document weighing the same; later ones go
through all labelled documents of the sample and take the highest windows of marked ones, if they stand out, against the
highest and some other windows of unmarked ones, of which those that look marked are left out. The last round fits one model
for each fold of the documents, on the other folds; each model's bar is set on the fold it didn't see, at the labels' own
share of marked documents, and the mean of the models is the scorer. A document's score is that of its highest window.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.common import require, small_or_plain, written
from tidemill.llm.leakage import plain
from tidemill.llm.lookalike import shape

#: Labelled documents used for fitting at most: marked and unmarked ones, and of either those whose every window is in round one, taken in order of a hash of their ids.
MARKED, UNMARKED, FIRST = 4000, 16_000, 1000
#: Later rounds, models that are averaged, highest and other windows of a document in later rounds, share of the unmarked documents that a marked one must exceed to stand out.
ROUNDS, FOLDS, HIGHEST, OTHERS, STANDS_OUT = 2, 3, 3, 3, 0.97
#: Buckets of n-grams, width of the embeddings, n-gram sizes, words of a window, step between windows; a window counts as at least LEAST words long, so that a lone name weighs little.
BUCKETS, WIDTH, GRAMS, WINDOW, STEP, LEAST = 1 << 16, 8, (3, 4, 5), 8, 4, 5
#: Steps of training at least.
STEPS = 400

# Characters that stand in for letters.
_LEET = str.maketrans("4301$@57", "aeoisast")
# Laughter, which says nothing about a passage.
LAUGHTER = {"lol", "mdr", "ptdr", "haha", "jaja", "xd"}
# every alternative starts with its own mark, so that the search skips to the next one
_QUOTED = re.compile(r"«[^«»\n]*»|“[^“”\n]*”|„[^„“”\n]*[“”]|\"(?<!\w\")[^\"\n]*\"|\{\{(?i:quote)\|[^{}]*\}\}|<(?i:blockquote)>(?is:.*?</blockquote>)")
_SPACED = re.compile(r"(?<!\w)(?:[^\W_][.\-_*]){3,}[^\W_](?!\w)")
_PARTING = re.compile(r"[.\-_*]")
_WORD = re.compile(r"[^\W_]+(?:[#*$@'’][^\W_]+)*")
_MIXED = re.compile(r"[^\W\d_]")
_STOP = re.compile(r"[.!?]+$|;$|!!|[{|]\||[{|]\{|[|}]\}")
_REPEATED = re.compile(r"(.)\1+")
#: Single letters parted by blanks that make a word, at least.
_LETTERS = 4


def _word(w: str) -> str:
    if w.isdigit():
        return "0"
    if not w.isalpha() and _MIXED.search(w):
        w = w.translate(_LEET)
        w = "".join(ch for ch in w if ch.isalnum())
    return _REPEATED.sub(r"\1", w)


def token_words(token: str) -> list[list[str]]:
    """The words of what stands between blanks, without disguises; a list for each passage of which it holds a part."""
    out = []
    for part in _STOP.split(token):
        part = _SPACED.sub(lambda m: _PARTING.sub("", m.group()), part)
        out.append([_word(w) for w in _WORD.findall(part) if w not in LAUGHTER])
    return out


def _closed_up(tokens: list[str]) -> list[str]:
    """``tokens`` with each run of _LETTERS or more single letters made one."""
    out, run = [], []
    for t in [*tokens, ""]:
        if len(t) == 1 and t.isalnum():
            run.append(t)
            continue
        out += ["".join(run)] if len(run) >= _LETTERS else run
        run = []
        out.append(t)
    return out[:-1]


class Tokens(dict):
    """What ``of`` gives for the words of each token, by passage; kept for a while, as texts share tokens."""

    def __init__(self, of=lambda w: w):
        self.of = of

    def __missing__(self, token: str) -> list[list]:
        if len(self) > 200_000:
            self.clear()
        found = self[token] = [[self.of(w) for w in part] for part in token_words(token)]
        return found


def passages(text: str, tokens: Tokens | None = None) -> list[list]:
    """Words of each passage of a text, in lower case, without markup, quotations and disguises, as ``tokens`` gives them."""
    tokens = Tokens() if tokens is None else tokens
    text = shape(plain(_QUOTED.sub(" ", text))).lower()
    out = []
    for line in text.split("\n"):
        found = line.split()
        if len([t for t in found if len(t) == 1]) >= _LETTERS:
            found = _closed_up(found)
        now: list = []
        for parts in [tokens[t] for t in found]:
            now += parts[0]
            if len(parts) > 1:
                for part in parts[1:]:
                    if now:
                        out.append(now)
                    now = list(part)
        if now:
            out.append(now)
    return out


def starts(size: int) -> list[int]:
    """Where the windows of a passage of ``size`` words begin."""
    return [0, *range(STEP, size - STEP, STEP)]


def windows(found: list[list]) -> list[list]:
    """Overlapping stretches of at most WINDOW words of each passage."""
    return [p[at : at + WINDOW] for p in found for at in starts(len(p))]


def grams(word: str) -> np.ndarray:
    """Buckets of a word's character n-grams and of the word itself."""
    framed = f"<{word}>"
    found = {framed[i : i + n] for n in GRAMS for i in range(len(framed) - n + 1)} | {framed}
    return np.array(sorted(xxhash.xxh32_intdigest(g) % BUCKETS for g in found), dtype=np.int32)


class Vocabulary:
    """Words by number with the buckets of their n-grams, flat; number 0 is no word."""

    def __init__(self):
        self.number: dict[str, int] = {"": 0}
        self.parts: list[np.ndarray] = [np.zeros(1, np.int32)]

    def matrix(self, found: list[list[str]]) -> np.ndarray:
        """One row of WINDOW word numbers for each window."""
        out = np.zeros((len(found), WINDOW), np.int32)
        for i, words in enumerate(found):
            for j, w in enumerate(words):
                n = self.number.get(w)
                if n is None:
                    n = self.number[w] = len(self.parts)
                    self.parts.append(grams(w))
                out[i, j] = n
        return out


class Model:
    """Embeddings (BUCKETS x WIDTH) and softmax weights (WIDTH x 2, bias 2), trained by stochastic gradients with a step size of its own for each row."""

    def __init__(self, seed: int = 7):
        self.random = np.random.default_rng(seed)
        self.embeddings = self.random.uniform(-1, 1, (BUCKETS, WIDTH)).astype(np.float32) / WIDTH
        self.weights, self.bias = self.random.normal(0, 0.5, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)
        self.paid, self.paid_softmax = np.full(BUCKETS, 1e-6, np.float32), np.full((WIDTH + 1, 2), 1e-6, np.float32)

    def fit(self, vocabulary: Vocabulary, found: np.ndarray, labels: np.ndarray, importance: np.ndarray, epochs: int, rate: float, batch: int = 256) -> Model:
        """At least ``epochs`` rounds over the windows, and STEPS steps where these are few. Words that a batch repeats are looked up once."""
        sizes = np.array([len(g) for g in vocabulary.parts])
        flat, starts = np.concatenate(vocabulary.parts), np.r_[0, np.cumsum(sizes)[:-1]]
        words_of = np.maximum((found > 0).sum(axis=1), LEAST).astype(np.float32)
        for _ in range(max(epochs, -(-STEPS * batch // len(found)))):
            order = self.random.permutation(len(found))
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                used, place = np.unique(found[pick], return_inverse=True)
                place = place.reshape(len(pick), WINDOW)
                n = sizes[used]
                ends = np.cumsum(n)
                at = np.arange(ends[-1]) + np.repeat(starts[used] - np.r_[0, ends[:-1]], n)
                ids = flat[at]
                word = np.add.reduceat(self.embeddings[ids], np.r_[0, ends[:-1]], axis=0) / n[:, None]
                if used[0] == 0:
                    word[0] = 0
                mean = word[place].sum(axis=1) / words_of[pick, None]
                logits = mean @ self.weights + self.bias
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(pick)), labels[pick]] -= 1
                p *= importance[pick][:, None] / len(pick)
                back = (p @ self.weights.T) / words_of[pick, None]
                each = np.repeat(back, WINDOW, axis=0)
                to_word = np.stack([np.bincount(place.ravel(), each[:, k], len(used)) for k in range(WIDTH)], axis=1)
                if used[0] == 0:
                    to_word[0] = 0
                to_part = np.repeat(to_word / n[:, None], n, axis=0)
                turn = np.argsort(ids, kind="stable")
                edge = np.flatnonzero(np.r_[True, np.diff(ids[turn]) > 0])
                rows, step = ids[turn[edge]], np.add.reduceat(to_part[turn], edge, axis=0).astype(np.float32)
                self.paid[rows] += (step**2).mean(axis=1)
                self.embeddings[rows] -= rate * step / np.sqrt(self.paid[rows])[:, None]
                softmax = np.vstack([mean.T @ p, p.sum(axis=0)]).astype(np.float32)
                self.paid_softmax += softmax**2
                softmax *= rate / np.sqrt(self.paid_softmax)
                self.weights -= softmax[:-1]
                self.bias -= softmax[-1]
        return self

    def scorer(self) -> Scorer:
        turn = self.weights[:, 1] - self.weights[:, 0]
        return Scorer((self.embeddings @ turn).astype(np.float32), float(self.bias[1] - self.bias[0]))


class Scorer:
    """The trained model folded to one number a bucket: a window's log-odds are the mean of its words' plus the bias."""

    def __init__(self, buckets: np.ndarray, bias: float):
        self.buckets, self.bias = buckets, bias
        self.known: dict[str, float] = {}
        self.tokens = Tokens(self.word)

    def word(self, w: str) -> float:
        found = self.known.get(w)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.known[w] = float(self.buckets[grams(w)].mean())
        return found

    def windows(self, scores: list[float]) -> list[float]:
        """The log-odds of each window of a passage whose words have ``scores``."""
        size, bias = len(scores), self.bias
        return [sum(part) / max(len(part), LEAST) + bias for at in starts(size) if (part := scores[at : at + WINDOW])]

    def text(self, text: str | None) -> float:
        """Log-odds of the highest window; minus infinity for a text without words."""
        best = float("-inf")
        for scores in passages(text, self.tokens) if text else ():
            if (size := len(scores)) <= WINDOW:
                best = max(best, sum(scores) / max(size, LEAST))
            else:
                best = max(best, *(sum(part) / max(len(part), LEAST) for at in starts(size) if (part := scores[at : at + WINDOW])))
        return best + self.bias

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the scorer as a Parquet table of one row, replacing what is there."""
        row = (bytearray(self.buckets.astype("<f4").tobytes()), self.bias)
        spark.createDataFrame([row], "buckets binary, bias double").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Scorer:
        """A scorer written by ``save``."""
        row = spark.read.parquet(path).first()
        return Scorer(np.frombuffer(bytes(row.buckets), "<f4").astype(np.float32), row.bias)


def _best_bar(yes: np.ndarray, no: np.ndarray, share: float) -> float:
    """The bar of highest F1 between the documents' scores, in the middle of its gap; an unmarked document counts ``share`` times, as it stands for that many among the labels for each that a marked one stands for."""
    scores, labels = np.r_[yes, no], np.r_[np.ones(len(yes)), np.zeros(len(no))]
    order = np.argsort(-scores, kind="stable")
    scores, labels = scores[order], labels[order]
    hits = np.cumsum(labels)
    f1 = 2 * hits / (np.cumsum(np.where(labels == 1, 1.0, share)) + len(yes))
    best = int(np.argmax(f1))
    return float(scores[best] if best + 1 == len(scores) else (scores[best] + scores[best + 1]) / 2)


def _balanced(labels: np.ndarray, each: np.ndarray) -> np.ndarray:
    """Weights of mean 1, in proportion to ``each`` within a label, by which both labels are half of all."""
    each = each.astype(float)
    for label in (0, 1):
        each[labels == label] *= 0.5 / max(each[labels == label].sum(), 1e-300)
    return (each * len(labels)).astype(np.float32)


def first_judge(yes: list[list], no: list[list], seed: int = 7) -> Scorer:
    """Round one: every window of every document of the first sample with its document's label."""
    vocabulary = Vocabulary()
    found = vocabulary.matrix([w for d in (*yes, *no) for w in d])
    sizes = np.array([len(d) for d in (*yes, *no)])
    labels = np.repeat(np.r_[np.ones(len(yes), int), np.zeros(len(no), int)], sizes)
    return Model(seed).fit(vocabulary, found, labels, _balanced(labels, 1 / np.repeat(sizes, sizes)), epochs=2, rate=0.1).scorer()


def standing_out(judge: Scorer, found: list[str], key: int) -> tuple[list[str], list[float], list[str]]:
    """The highest windows of a document of passages ``found`` with their scores, highest first, and some of the others, drawn by ``key``."""
    ranked = []
    for p in found:
        words = p.split(" ")
        scores = judge.windows([judge.word(w) for w in words])
        ranked += [(-x, words[at : at + WINDOW]) for x, at in zip(scores, starts(len(words)))]
    ranked.sort()
    rest = ranked[HIGHEST:]
    return [" ".join(w) for _, w in ranked[:HIGHEST]], [-x for x, _ in ranked[:HIGHEST]], [" ".join(w) for _, w in random.Random(key).sample(rest, min(OTHERS, len(rest)))]


def later_judges(mined: list[tuple], models: int, lenient: bool, seed: int) -> list[Scorer]:
    """A judge for each fold: either one model for all or, with FOLDS ``models``, one fitted on the documents of the other folds. ``mined``: (fold, label, highest windows, their scores, other windows) of each document.

    Most unmarked documents are rightly so: a marked one stands out where it exceeds nearly all of their highest windows; unmarked ones that do are left out
    unless ``lenient`` and close to the bar.
    """
    bar = float(np.quantile([scores[0] for _, label, _, scores, _ in mined if label == 0], STANDS_OUT))
    seen: Counter = Counter()
    for fold, label, highest, scores, others in mined:
        if label == 1:
            seen.update((fold, 1, w) for w, s in zip(highest[:2], scores) if s > bar)
        elif scores[0] <= bar + lenient:
            seen.update((fold, 0, w) for w in (*highest, *others))
    # windows that many documents share are fitted once, with their number as weight
    vocabulary, found = Vocabulary(), sorted(seen)
    matrix = vocabulary.matrix([w.split(" ") for _, _, w in found])
    folds, labels, times = (np.array(x) for x in ([f for f, _, _ in found], [v for _, v, _ in found], [seen[x] for x in found]))
    out = []
    for fold in range(models):
        own = folds != fold if models > 1 else np.ones(len(found), bool)
        if not labels[own].any() or labels[own].all():
            return []
        out.append(Model(seed + fold).fit(vocabulary, matrix[own], labels[own], _balanced(labels[own], times[own]), epochs=4, rate=0.1).scorer())
    return out * (FOLDS // models)


def averaged(judges: list[Scorer], bars: list[float]) -> Scorer:
    """The mean of the judges' log-odds, each above its own bar."""
    return Scorer(np.mean([j.buckets for j in judges], axis=0).astype(np.float32), float(np.mean([j.bias - b for j, b in zip(judges, bars)])))


def _silent() -> Scorer:
    """The scorer of tables without labels of both kinds: nothing stands out."""
    return Scorer(np.zeros(BUCKETS, np.float32), -20.0)


def train(mine, first: Iterable[tuple[int, list[list[str]]]], share: float, seed: int = 7) -> Scorer:
    """A scorer from labelled documents, see the module.

    ``first``: (label, windows) of the documents of round one. ``mine(judges)`` gives for every labelled document (fold, label, highest windows, their
    scores, other windows), scored by its fold's judge. ``share``: see _best_bar.
    """
    first = [(label, found) for label, found in first if found]
    yes, no = [w for label, w in first if label == 1], [w for label, w in first if label == 0]
    if not yes or not no:
        return _silent()
    judges = [first_judge(yes, no, seed)] * FOLDS
    for turn in range(ROUNDS):
        judges = later_judges(mine(judges), FOLDS if turn == ROUNDS - 1 else 1, turn == 0, seed + FOLDS * (turn + 1)) or judges
    # each document's score is that of a model that didn't see it
    last = mine(judges)
    bars = []
    for fold in range(FOLDS):
        of = lambda label: np.array([scores[0] for f, v, _, scores, _ in last if v == label and f == fold])  # noqa: B023,E731
        bars.append(_best_bar(of(1), of(0), share) if len(of(1)) and len(of(0)) else 0.0)
    return averaged(judges, bars)


def fitted(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Scorer:
    """A scorer fitted on at most MARKED + UNMARKED labelled documents, of which at most FIRST of either label are in round one.

    Their texts are cut into windows once, on the executors; there each judge also picks the windows that stand out, so that the driver holds the
    documents of round one and at most HIGHEST + OTHERS windows of every other.
    """
    require(documents, key, text)
    require(labels, key, label)
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("label"))
    ordered = lambda v, n: known.where(F.col("label") == v).orderBy(F.xxhash64("k"), "k").limit(n)
    chosen = ordered(1, MARKED).unionByName(ordered(0, UNMARKED))
    texts = documents.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("t <> ''").join(small_or_plain(chosen, MARKED + UNMARKED), "k")
    turn = F.xxhash64(F.col("k").cast("string"))

    def cut(it):
        tokens = Tokens()
        for b in it:
            made = [[" ".join(p) for p in passages(t, tokens)] for t in b["t"]]
            yield pd.DataFrame({"turn": b["turn"], "label": b["label"], "found": made})[[bool(m) for m in made]]

    parsed = written(texts.select(turn.alias("turn"), "label", "t").repartition(documents.sparkSession.sparkContext.defaultParallelism).mapInPandas(cut, "turn long, label int, found array<string>"))
    numbers = {r.label: r.n for r in parsed.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (totals.get(0, 0) / max(1, numbers.get(0, 0))) / max(1e-9, totals.get(1, 0) / max(1, numbers.get(1, 0)))
    sample = parsed.where("label = 1").orderBy("turn").limit(FIRST).unionByName(parsed.where("label = 0").orderBy("turn").limit(FIRST))
    first = [(r.label, windows([p.split(" ") for p in r.found])) for r in sorted(sample.collect(), key=lambda r: (r.label, r.turn))]

    def mine(judges: list[Scorer]) -> list[tuple]:
        shared = documents.sparkSession.sparkContext.broadcast([(j.buckets, j.bias) for j in judges])

        def pick(it):
            own = [Scorer(*x) for x in shared.value]
            for b in it:
                out = [(t, t % FOLDS, label, *standing_out(own[t % FOLDS], found, t)) for t, label, found in zip(b["turn"], b["label"], b["found"])]
                yield pd.DataFrame(out, columns=["turn", "fold", "label", "highest", "scores", "others"])

        rows = parsed.mapInPandas(pick, "turn long, fold int, label int, highest array<string>, scores array<double>, others array<string>").collect()
        return [(r.fold, r.label, r.highest, r.scores, r.others) for r in sorted(rows)]

    return train(mine, first, share)


def scored(documents: DataFrame, labels: DataFrame | Scorer, key: str = "doc_id", text: str = "text", label: str = "toxic", to: str = "score") -> DataFrame:
    """``labels``: labelled documents to fit on, or a scorer fitted before. ``documents`` with column ``to``: the log-odds of the highest window of each whole text. Null, empty and wordless texts get null; an existing column is replaced; without labels of both kinds no text stands out (all scores are low)."""
    require(documents, text)
    shared = documents.sparkSession.sparkContext.broadcast(labels if isinstance(labels, Scorer) else fitted(documents, labels, key, text, label))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        judge = shared.value
        out = texts.map(judge.text, na_action="ignore").astype("float64")
        return out.where(np.isfinite(out), None)

    return documents.withColumn(to, score(F.col(text).cast("string")))


def flagged(documents: DataFrame, labels: DataFrame | Scorer, key: str = "doc_id", text: str = "text", label: str = "toxic", above: float = 0.0) -> DataFrame:
    """(doc_id): documents whose score exceeds ``above`` (log-odds)."""
    return scored(documents, labels, key, text, label).where(F.col("score") > above).select(F.col(key).alias("doc_id"))


def source_rates(documents: DataFrame, labels: DataFrame | Scorer, source: str = "source", above: float = 0.0) -> DataFrame:
    """(source, documents, flagged, rate) over all documents; a null source is a group of its own, texts without a score count as not flagged."""
    hit = F.coalesce((F.col("score") > above).cast("long"), F.lit(0))
    return scored(documents, labels).groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("documents"), F.sum(hit).alias("flagged"), F.avg(hit.cast("double")).alias("rate"))
