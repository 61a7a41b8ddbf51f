"""Nearest texts by minhash bands, and texts as sequences of token ids."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.common import require, small_or_plain, written
from tidemill.functions.metrics import character_jaccard
from tidemill.functions.scalars import shingle_hashes, shingles, tokens

#: Tokens of a vocabulary sent to every executor at most.
VOCABULARY_BROADCAST = 200_000
#: Bands of an index, texts of an index, and candidates found, sent to every executor at most; more are joined by shuffle.
INDEX_BROADCAST, TEXTS_BROADCAST = 200_000, 10_000
#: Shingles at most that have a bit of their own when sets are compared; bits of the slots for the others; sets and shingles of a block.
COMMON_SHINGLES, SLOT_BITS, BLOCK_SETS, BLOCK_SHINGLES = 2048, 18, 100_000, 10_000_000
#: More shingles than any set has.
NEVER = 1 << 60


def _digest(text: Column) -> Column:
    """128 bits that stand for a text where it needn't travel."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"))


def bands(signature: Column, hashes: int, count: int) -> Column:
    """(band, key) of each band of a signature; the key is the sum of its minhashes."""
    if hashes % count:
        raise ValueError(f"{hashes} hashes don't part into {count} bands")
    width = hashes // count
    key = lambda b: F.aggregate(F.slice(signature, b * width + 1, F.lit(width)), F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda b: F.struct(b.alias("band"), key(b).alias("key")))


class NearestText:
    """Nearest texts of a corpus: minhash bands find candidates, those of most shared bands are compared."""

    def __init__(self, hashes: int = 100, size: int = 3, most_common: int = 10, n_bands: int = 50, seeds: Sequence[int] | None = None, compare=character_jaccard):
        if hashes % n_bands:
            raise ValueError(f"{hashes} hashes don't part into {n_bands} bands")
        self.hashes, self.size, self.most_common, self.n_bands, self.compare = hashes, size, most_common, n_bands, compare
        self.seeds = list(seeds) if seeds is not None else list(range(hashes))
        self.index: DataFrame | None = None
        self.texts: DataFrame | None = None

    def _entries(self, texts: DataFrame) -> DataFrame:
        """(d, band, key) of each distinct text ``t``, d its digest: the texts themselves aren't shuffled."""
        signed = texts.select(_digest(F.col("t")).alias("d"), shingle_hashes(F.col("t"), self.size, self.seeds).alias("s")).dropDuplicates(["d"])
        # texts without a signature go after the bands are made: a filter on it would have every text signed twice
        return signed.select("d", F.explode(bands(F.col("s"), self.hashes, self.n_bands)).alias("e")).select("d", "e.band", "e.key").where("key is not null")

    def fit(self, corpus: DataFrame, text: str) -> NearestText:
        """Indexes every distinct text."""
        require(corpus, text)
        self.texts = corpus.select(F.col(text).alias("t")).where("t is not null").distinct()
        self.index = written(self._entries(self.texts).withColumnRenamed("d", "c"))
        return self

    def candidates(self, queries: DataFrame, key: str, text: str) -> DataFrame:
        """(key, query, candidate, shared): the ``most_common`` texts of most shared bands of each query. Queries of one text are searched once."""
        if self.index is None:
            raise ValueError("fit comes first")
        asked = queries.select(F.col(text).alias("t")).where("t is not null")
        met = self._entries(asked).join(small_or_plain(self.index, INDEX_BROADCAST), ["band", "key"]).groupBy("d", "c").agg(F.count(F.lit(1)).alias("shared"))
        texts = small_or_plain(self.texts.select(_digest(F.col("t")).alias("c"), F.col("t").alias("candidate")), TEXTS_BROADCAST)
        # the fewest shared bands that can be among the most common: ties beyond are told apart by text
        w = Window.partitionBy("d").orderBy(F.desc("shared"))
        near = met.withColumn("r", F.rank().over(w)).where(F.col("r") <= self.most_common).drop("r").join(texts, "c").select("d", "shared", "candidate")
        top = near.groupBy("d").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("shared")).alias("less"), "candidate"))), 1, self.most_common).alias("found"))
        return queries.select(F.col(key), F.col(text).alias("query"), _digest(F.col(text)).alias("d")).where("query is not null").join(top, "d").select(key, "query", F.explode("found").alias("f")).select(key, "query", F.col("f.candidate").alias("candidate"), (-F.col("f.less")).alias("shared"))

    def nearest(self, queries: DataFrame, key: str, text: str) -> DataFrame:
        """(key, query, match, score): each query's best candidate; queries without one have no row."""
        scored = self.candidates(queries, key, text).withColumn("score", self.compare(F.col("query"), F.col("candidate")))
        best = F.max(F.struct(F.col("score"), F.col("shared"), F.col("candidate"))).alias("b")
        return scored.groupBy(key, "query").agg(best).select(key, "query", F.col("b.candidate").alias("match"), F.col("b.score").alias("score"))


def _shingle_codes(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of the distinct shingles of each text, sorted by row. Up to three characters a code holds them whole; longer shingles stand as 64-bit digests."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), n)
    whole = np.arange(len(chars)) + size <= np.cumsum(n)[row]
    code = np.zeros(len(chars), np.uint64)
    for i in range(size):
        code = (code << np.uint64(21) if size <= 3 else code * np.uint64(0x9E3779B97F4A7C15)) + np.roll(chars, -i) + np.uint64(1)
        if size > 3:
            code ^= code >> np.uint64(29)
    row, code = row[whole], code[whole]
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    return row[first], code[first]


def _mixed(code: np.ndarray, seed: int) -> np.ndarray:
    x = (code ^ np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class _Sets:
    """Shingle sets of texts: sizes ``m``, bits of the common shingles, and codes and slots of the others, by row from ``start``."""

    def __init__(self, texts: list[str], size: int, common: np.ndarray):
        n, words = len(texts), max(1, -(-len(common) // 64))
        self.m, self.rare, self.bits = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, words), np.uint64)
        codes = [np.zeros(0, np.uint64)]
        for lo in range(0, n, 4096):
            row, code = _shingle_codes(texts[lo : lo + 4096], size)
            self.m[lo : lo + 4096] = np.bincount(row, minlength=len(texts[lo : lo + 4096]))
            at = np.minimum(np.searchsorted(common, code), max(len(common) - 1, 0))
            held = common[at] == code if len(common) else np.zeros(len(code), bool)
            np.bitwise_or.at(self.bits, (row[held] + lo, at[held] >> 6), np.uint64(1) << (at[held] & 63).astype(np.uint64))
            self.rare[lo : lo + 4096] = np.bincount(row[~held], minlength=len(texts[lo : lo + 4096]))
            codes.append(code[~held])
        self.codes = np.concatenate(codes)
        self.slots = (_mixed(self.codes, 3) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.start = np.r_[0, np.cumsum(self.rare)]

    def postings(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows by slot, and where each slot's rows begin."""
        rows = np.repeat(np.arange(len(self.m)), self.rare)[np.argsort(self.slots, kind="stable")]
        return rows, np.r_[0, np.cumsum(np.bincount(self.slots, minlength=1 << SLOT_BITS))]


def _shared(a: _Sets, b: _Sets, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact numbers of shared shingles of the pairs (i, j)."""
    out = np.zeros(len(i), np.int64)
    order = np.argsort(-np.maximum(a.rare[i], b.rare[j]), kind="stable")
    lo = 0
    while lo < len(order):
        wide = int(max(a.rare[i[order[lo]]], b.rare[j[order[lo]]], 1))
        some = order[lo : lo + max(1, 2_000_000 // (2 * wide + a.bits.shape[1]))]
        lo += len(some)
        step = np.arange(wide)
        sides = []
        for s, k in ((a, i[some]), (b, j[some])):
            at = np.minimum(s.start[k][:, None] + step, max(len(s.codes) - 1, 0))
            sides.append(np.where(step < s.rare[k][:, None], s.codes[at] if len(s.codes) else np.uint64(0), np.uint64(0)))
        both = np.sort(np.concatenate(sides, axis=1), axis=1)  # no code is 0, and a side has each once
        out[some] = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] > 0)).sum(axis=1) + np.bitwise_count(a.bits[i[some]] & b.bits[j[some]]).sum(axis=1, dtype=np.int64)
    return out


def _block_pairs(a: _Sets, b: _Sets, least: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, score) of all pairs that reach ``least``; each pair once where both are the ``same``.

    Shared rare shingles are counted by slot for all rows of b at once. With the smaller number of common shingles that is the most a pair can share; only pairs
    for which it suffices, and does with the common shingles that both have, are compared. Shingles that fall into one slot make the count larger, never smaller.
    """
    rows, begin = b.postings()
    common_a, common_b, nb = a.m - a.rare, b.m - b.rare, len(b.m)
    ones = np.ones(b.bits.shape[1], np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    near_i, near_j, held, last = [], [], 0, None

    def compare() -> None:
        i, j = np.concatenate(near_i), np.concatenate(near_j)
        shared = _shared(a, b, i, j)
        score = shared / (a.m[i] + b.m[j] - shared)
        ok = score >= least - 1e-12
        found.append((i[ok], j[ok], score[ok]))
        near_i.clear(), near_j.clear()

    for i in np.lexsort((a.m, common_a)):
        if last != (common_a[i], a.m[i]):
            last = (common_a[i], a.m[i])
            needed = np.ceil((a.m[i] + b.m) * (least / (1 + least)) - 1e-6).astype(np.int64)
            # a set can't share more than it has
            bar = np.where(np.minimum(b.m, a.m[i]) < needed, NEVER, needed - np.minimum(common_b, common_a[i]))
        slots = a.slots[a.start[i] : a.start[i + 1]]
        met = np.concatenate([rows[begin[s] : begin[s + 1]] for s in slots.tolist()]) if len(slots) else rows[:0]
        count = np.bincount(met, minlength=nb)
        j = np.flatnonzero(count >= bar)
        if same:
            j = j[j > i]
        if len(j):
            # now with the common shingles that both have
            j = j[count[j] + np.bitwise_count(b.bits[j] & a.bits[i]) @ ones >= needed[j]]
        if len(j):
            near_i.append(np.full(len(j), i))
            near_j.append(j)
            held += len(j)
            if held > 500_000:
                compare()
                held = 0
    if near_i:
        compare()
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (none, none, none.astype(float))


def jaccard_pairs(df: DataFrame, key: str, text: str, size: int = 3, least: float = 0.8) -> DataFrame:
    """(key_a, key_b, score): pairs of distinct shingle sets whose Jaccard similarity reaches ``least``, exactly. Rows of one set are folded into its smallest key.

    Sets are dealt to blocks, and every two blocks meet in one task, so no pair of sets is ever shuffled; what is sent grows with rows times blocks, the work with the square of the sets.
    """
    require(df, key, text)
    if least <= 0:
        raise ValueError("the least similarity must be above 0")
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("k").isNotNull() & (F.length("t") >= size))

    def digests(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            row, code = _shingle_codes(texts, size)
            begin = np.searchsorted(row, np.arange(len(texts)))
            sums = [np.add.reduceat(_mixed(code, seed), begin).view(np.int64) if len(texts) else np.zeros(0, np.int64) for seed in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x) for x in sums), pa.array(np.bincount(row, minlength=len(texts)).astype(np.int64))], names=["k", "t", "d1", "d2", "m"])

    def counts(batches):
        for batch in batches:
            code, n = np.unique(_shingle_codes(batch.column(0).to_pylist(), size)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])

    signed = rows.mapInArrow(digests, f"k {kind}, t string, d1 long, d2 long, m long")
    sets = written(signed.groupBy("d1", "d2", "m").agg(F.min(F.struct("k", "t")).alias("r")).select("r.k", "r.t", "d1", "m"))
    total = sets.agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("m")).first()
    n, entries = total["n"], total["m"] or 0
    # the common shingles are those beyond the share in which two sets may differ, and 15 % more; the choice sets the work, not the result
    most = sets.select("t").mapInArrow(counts, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "code").limit(COMMON_SHINGLES).collect()
    weight = np.cumsum([r["n"] for r in most])
    common = np.sort(np.array([r["code"] for r, w in zip(most, weight) if w <= entries * (1 - (1 - least) / (1 + least) - 0.15)], np.int64).view(np.uint64))
    blocks = max(1, -(-n // BLOCK_SETS), -(-entries // BLOCK_SHINGLES), min(8, -(-n // 4000)))
    tiles = blocks * (blocks + 1) // 2
    block = F.pmod("d1", F.lit(blocks)).cast("int")
    dealt = sets.select("k", "t", block.alias("x"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("y"))
    dealt = dealt.select("k", "t", "x", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")).repartition(2 * tiles, "i", "j")

    def tile(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        sides = [group[group["x"] == x] for x in sorted(set(key))]
        made = [_Sets(s["t"].tolist(), size, common) for s in sides]
        i, j, score = _block_pairs(made[0], made[-1], least, len(made) == 1)
        return pd.DataFrame({"a": sides[0]["k"].to_numpy()[i], "b": sides[-1]["k"].to_numpy()[j], "score": score})

    found = dealt.groupBy("i", "j").applyInPandas(tile, f"a {kind}, b {kind}, score double")
    return found.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"), "score")


class TokenSequences:
    """Texts as arrays of token ids of one length: the pad token is 0, others are numbered as documents bring them, sorted within a document."""

    def __init__(self, tokenize=tokens, length: int | None = None):
        self.tokenize, self.length = tokenize, length
        self.vocabulary: DataFrame | None = None

    def fit(self, df: DataFrame, text: str, order_by: str) -> TokenSequences:
        require(df, text, order_by)
        first = df.select(F.col(order_by).alias("at"), F.explode(F.array_distinct(self.tokenize(F.col(text)))).alias("token")).groupBy("token").agg(F.min("at").alias("at"))
        # one row a distinct token; ranks by ranges, so no task orders the whole vocabulary
        from tidemill.operators.relational import positions

        self.vocabulary = positions(first, ["at", "token"]).select("token", (F.col("position") + 1).alias("id"))
        return self

    def ids(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(key, ids): ids of all tokens in order, unknown ones as the pad id."""
        if self.vocabulary is None:
            raise ValueError("fit comes first")
        exploded = df.select(F.col(key), F.posexplode_outer(self.tokenize(F.col(text))).alias("pos", "token"))
        known = exploded.join(small_or_plain(self.vocabulary, VOCABULARY_BROADCAST), "token", "left")
        item = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(0)).alias("id")))
        lists = known.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("l"))
        return lists.select(key, F.transform("l", lambda x: x["id"]).alias("ids"))

    def transform(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(key, ids) padded in front, or cut in front, to one length: the rounded mean plus two deviations of the first call's lengths."""
        from tidemill.operators.categorical import pad_left

        lists = self.ids(df, key, text)
        if self.length is None:
            s = lists.agg(F.avg(F.size("ids")).alias("m"), F.stddev_pop(F.size("ids")).alias("d")).first()
            self.length = int(round((s["m"] or 0) + 2 * (s["d"] or 0)))
        return lists.select(key, pad_left(F.col("ids"), self.length).alias("ids"))
