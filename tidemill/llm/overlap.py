"""Same or nearly same records across splits (problem 5): a weighted cosine join.

A record is the vector of its words (a repeated word counts as several terms), weighted by rarity; terms are taken by falling
weight. Two records within ``edits`` word edits lose at most ``edits`` terms each, so their dot product is at least the squared
norm less the ``edits`` largest squared weights: the least a record accepts, its maximum-weight bound. Partners must therefore
share two of the first ``edits`` + 2 terms, and inverted lists are kept for pairs of these, which are far shorter than lists of
single words. An entry carries what the dot product can reach when its two terms are the first that are shared: their squared
weights and the squared residual norm of all that follows. Entries whose reach is below the record's own bound aren't kept,
and a join drops pairs of which either reach is below either bound. One more list of each record is that of its letters and
digits as a whole, in which copies meet. Every candidate gets its exact dot product and is then compared word by word.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.common import bounded_rows, require, written
from tidemill.llm.duplicates import core
from tidemill.llm.lookalike import Speller, bigram_counts

#: Counters for term frequencies: a sketch of fixed size over all records; collisions only make a term look more frequent.
BUCKETS = 1 << 16


def words(form: str) -> list[str]:
    """What white space parts, of which only letters and digits are kept without case; words with none don't count."""
    return [w for x in form.split() if (w := core(x))]


def _terms(found: list[str]) -> list[int]:
    """64-bit hashes of the words; the n-th occurrence of a word is a term of its own."""
    seen: dict[str, int] = {}
    out = []
    for w in found:
        n = seen[w] = seen.get(w, 0) + 1
        out.append(xxhash.xxh64_intdigest(w, seed=n) - (1 << 63))
    return out


def within(a: list[str], b: list[str], most: int) -> bool:
    """Whether at most ``most`` words inserted, dropped or replaced make ``a`` into ``b``."""
    if abs(len(a) - len(b)) > most:
        return False
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if max(len(a), len(b)) <= most:
        return True
    far = most + 1
    last = {j: j for j in range(min(most, len(b)) + 1)}
    for i in range(1, len(a) + 1):
        row = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            row[j] = i if j == 0 else min(last.get(j - 1, far) + (a[i - 1] != b[j - 1]), last.get(j, far) + 1, row.get(j - 1, far) + 1)
        if min(row.values()) > most:
            return False
        last = row
    return last.get(len(b), far) <= most


def _weights(buckets: np.ndarray) -> np.ndarray:
    """Weight of the terms of each bucket: the rarer the heavier, always above zero."""
    return np.log1p(max(1.0, float(buckets.sum())) / np.maximum(buckets, 1))


#: Lists over which the records of at most ``edits`` words are spread, as all of them are within reach of each other.
SHORT_LISTS = 16
#: A hair of slack for the order of summation.
_SLACK = 1 - 1e-9


def entries_of(found: list[str], squares: list[float], edits: int) -> tuple[float, list[tuple[int, float]]]:
    """The least dot product that a record of words ``found`` accepts, and its inverted-list entries: (list, reach). ``squares``: squared weight of each term bucket."""
    ranked = sorted((-squares[t % BUCKETS], t) for t in _terms(found))
    norm = -sum(w for w, _ in ranked)
    need = norm + sum(w for w, _ in ranked[:edits])
    residual, out = norm, []
    for j, (w, t) in enumerate(ranked[: edits + 2]):
        residual += w  # squared norm behind this place
        if len(ranked) <= edits + 1:
            out.append((t, residual - w))
        for v, u in ranked[:j]:
            a, b = (t, u) if t < u else (u, t)
            out.append((xxhash.xxh64_intdigest(f"{a},{b}") - (1 << 63), residual - w - v))
    return need, [x for x in out if x[1] >= need * _SLACK]


def _signatures(df: DataFrame, buckets: np.ndarray, edits: int, held: bool) -> DataFrame:
    """(sig, form, reach, need): the entries of each class of equal words in the inverted lists. Classes of at most ``edits`` words are in one of SHORT_LISTS more if ``held``, else in all of these."""
    squares = (_weights(buckets) ** 2).tolist()

    def batches(it):
        for b in it:
            forms, sigs, reaches, needs = [], [], [], []
            for form, core_, text in zip(b["form"], b["core"], b["words"]):
                found = text.split(" ")
                need, made = entries_of(found, squares, edits)
                made.append((xxhash.xxh64_intdigest(core_, seed=1) - (1 << 63), np.inf))
                if len(found) <= edits:
                    made += [(k, np.inf) for k in ([form[0] % SHORT_LISTS] if held else range(SHORT_LISTS))]
                forms += [form] * len(made)
                needs += [need] * len(made)
                for sig, reach in made:
                    sigs.append(sig)
                    reaches.append(reach)
            if forms:
                yield pd.DataFrame({"sig": sigs, "form": forms, "reach": reaches, "need": needs})

    return df.select("form", "core", "words").mapInPandas(batches, "sig long, form binary, reach double, need double")


def _linked(df: DataFrame, key: str, text: str, split: str, held_out: tuple[str, ...], train: str, edits: int, *more: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, side, words, form, core and the columns ``more``) and links (form_e, form_t) between classes of equal words, the first of a held-out row and the second of a training row."""
    require(df, key, text, split, *more)
    speller = Speller(bigram_counts(df, text))
    columns = [F.col(c).cast("string").alias(f"more{k}") for k, c in enumerate(more)]
    chosen = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t"), F.col(split).isin(*held_out).alias("side"), *columns).where(F.col(split).isin(train, *held_out))

    def batches(it):
        for b in it:
            made = [" ".join(words(speller.form(t))) if t is not None else "" for t in b["t"]]
            out = b.drop(columns="t").assign(words=made, form=[xxhash.xxh128_digest(m) for m in made], core=[xxhash.xxh128_digest(m.replace(" ", "")) for m in made])
            yield out[out["words"] != ""]

    rows = written(chosen.mapInPandas(batches, "id long, side boolean, " + "".join(f"more{k} string, " for k in range(len(more))) + "words string, form binary, core binary"))
    # term frequencies over all records, in a sketch of fixed size
    counted = rows.select("words").mapInPandas(_bucket_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    buckets = np.zeros(BUCKETS)
    for r in bounded_rows(counted, BUCKETS, "term buckets"):
        buckets[r.bucket] = r.n
    kinds = written(rows.groupBy("form").agg(F.first("words").alias("words"), F.first("core").alias("core"), F.max("side").alias("held"), F.min("side").alias("only_held")))
    held, base = kinds.where("held"), kinds.where("not only_held")
    e, t = (_signatures(x, buckets, edits, x is held).select("sig", *(F.col(c).alias(f"{c}_{n}") for c in ("form", "reach", "need"))) for x, n in ((held, "e"), (base, "t")))
    reached = F.least("reach_e", "reach_t") >= F.greatest("need_e", "need_t") * _SLACK
    met = e.join(t, "sig").where((F.col("form_e") != F.col("form_t")) & reached).select("form_e", "form_t").distinct()
    side = lambda n: kinds.select(*(F.col(c).alias(f"{c}_{n}") for c in ("form", "words", "core")))
    squares = (_weights(buckets) ** 2).tolist()

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            u, v = x.split(" "), y.split(" ")
            tu, tv = ({t: squares[t % BUCKETS] for t in _terms(w)} for w in (u, v))
            dot = sum(w for t, w in tu.items() if t in tv)
            need = max(sum(sorted(w.values())[:-edits]) if edits else sum(w.values()) for w in (tu, tv))
            out.append(dot >= need * _SLACK and within(u, v, edits))
        return pd.Series(out, dtype=bool)

    both = met.join(side("e"), "form_e").join(side("t"), "form_t")
    copies = F.col("core_e") == F.col("core_t")
    linked = both.where(copies).unionByName(both.where(~copies).where(near("words_e", "words_t"))).select("form_e", "form_t")
    same = kinds.where("held and not only_held").select(F.col("form").alias("form_e"), F.col("form").alias("form_t"))
    return rows, linked.unionByName(same)


def near_pairs(df: DataFrame, key: str = "id", text: str = "text", split: str = "split", held_out: tuple[str, ...] = ("valid", "test"), train: str = "train", edits: int = 2) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows of which one is in split ``train`` and the other in one of ``held_out``, that are copies in letters and digits or within ``edits`` word edits.

    Rows of equal words are folded into one class before any join, so copies meet once. Null texts, texts without a word and rows of a null
    or other split are in no pair; extra columns don't matter; an empty table gives none.
    """
    rows, linked = _linked(df, key, text, split, held_out, train, edits)
    held = rows.where("side").select(F.col("id").alias("i"), F.col("form").alias("form_e"))
    base = rows.where("not side").select(F.col("id").alias("j"), F.col("form").alias("form_t"))
    return linked.join(held, "form_e").join(base, "form_t").select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))


def _bucket_counts(it):
    total = np.zeros(BUCKETS, dtype=np.int64)
    for b in it:
        terms = np.array([t % BUCKETS for text in b["words"] for t in _terms(text.split(" "))], dtype=np.int64)
        total += np.bincount(terms, minlength=BUCKETS)
    used = np.flatnonzero(total)
    if len(used):
        yield pd.DataFrame({"bucket": used.astype(np.int32), "n": total[used]})


def overlap_report(df: DataFrame, key: str = "id", text: str = "text", split: str = "split", source: str = "source", label: str = "class", held_out: tuple[str, ...] = ("valid", "test"), train: str = "train", edits: int = 2) -> DataFrame:
    """Cross-split overlaps counted per held-out split and source: (split, source, pairs, records, other_class), the last being pairs whose classes differ (null and null agree).

    Counted from the links between classes of equal words and the sizes of these classes: pairs of rows are never listed.
    """
    rows, linked = _linked(df, key, text, split, held_out, train, edits, split, source, label)
    named = [F.col("more0").alias("split"), F.col("more1").alias("source"), F.col("more2").alias("label")]
    base = rows.where("not side").select(F.col("form").alias("form_t"), F.col("more2").alias("label")).groupBy("form_t", "label").agg(F.count(F.lit(1)).alias("n"))
    partners = linked.join(base, "form_t").groupBy("form_e", F.col("label").alias("other")).agg(F.sum("n").alias("n"))
    held = rows.where("side").select(F.col("form").alias("form_e"), *named).groupBy("form_e", "split", "source", "label").agg(F.count(F.lit(1)).alias("records"))
    # a class of equal words has a row for each label on either side, of which there are few
    met = held.join(partners, "form_e").withColumn("pairs", F.col("records") * F.col("n"))
    differ = F.when(F.col("label").eqNullSafe(F.col("other")), 0).otherwise(F.col("pairs"))
    each = met.groupBy("form_e", "split", "source", "label").agg(F.sum("pairs").alias("pairs"), F.first("records").alias("records"), F.sum(differ).alias("other_class"))
    return each.groupBy("split", "source").agg(F.sum("pairs").alias("pairs"), F.sum("records").alias("records"), F.sum("other_class").alias("other_class"))
