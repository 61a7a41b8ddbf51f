"""Encoding with a public byte-level BPE (problem 6).

The distinct words of the whole corpus are counted and every one of them is encoded in Spark: the rank file becomes a literal
hash table from bytes (as Latin-1 characters) to rank, and higher-order functions fold the ranked merges over the bytes of
each word, every step joining the leftmost of the lowest-ranked neighbours. The words of most documents go, with their ids,
into a lexicon of bounded size that is broadcast to put texts together in Arrow batches; where that bound leaves words out,
they come from the same table of encoded words by a shuffle join. Nothing is merged outside Spark.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.common import require, written

# Fixed value: the published pattern that parts a text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same with white space as Unicode has it, which Java takes only when told so.
_UNICODE = "(?U)" + PATTERN
#: Words in the lexicon at most, and characters of each: what is broadcast has a bound whatever the corpus.
LEXICON, LONGEST = 1 << 17, 256
#: Places of a table for each entry.
_ROOM = 2.3
#: A space after white space and before white space or the end: only there do stretches between single spaces not split one by one.
_ENTANGLED = r"\s (?!\S)"
#: Rank of a pair that isn't merged.
_NEVER = 0x7FFFFFFF


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the bytes, blank, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Table:
    """A literal hash table: each key lies in one of two places, so a look-up compares at most two strings."""

    def __init__(self, entries: dict[str, int]):
        self.size = size = int(_ROOM * max(1, len(entries))) + 7
        places: list[tuple | None] = [None] * size
        for entry in entries.items():
            at = self._first(entry[0])
            for _ in range(500):
                entry, places[at] = places[at], entry
                if entry is None:
                    break
                a, b = self._first(entry[0]), self._second(entry[0])
                at = b if at == a else a
            else:
                raise ValueError("no place for a key")
        items = [p and {"k": p[0], "v": p[1]} for p in places]
        self.table = F.from_json(F.lit(json.dumps(items, ensure_ascii=False, separators=(",", ":"))), "array<struct<k:string,v:int>>")

    def _first(self, key: str) -> int:
        return self._hash(key) % self.size

    def _second(self, key: str) -> int:
        return (self._hash(key) >> 20) % self.size

    @staticmethod
    def _hash(key: str) -> int:
        """Spark's xxhash64 of a string, without its sign bit."""
        return xxhash.xxh64_intdigest(key.encode(), seed=42) & (1 << 63) - 1

    def get(self, table: Column, key: Column) -> Column:
        """The value of ``key`` in ``table``, this table's literal or a variable bound to it: a plan should hold the literal once."""
        size = F.lit(self.size).cast("long")
        value = lambda at, k, other: _bound(table[at.cast("int")], lambda e: F.when(e["k"] == k, e["v"]).otherwise(other))
        return _bound(F.struct(key.alias("k"), F.xxhash64(key).bitwiseAND(F.lit((1 << 63) - 1)).alias("h")), lambda x: value(x["h"] % size, x["k"], value(F.shiftright(x["h"], 20) % size, x["k"], F.lit(None).cast("int"))))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


@lru_cache(maxsize=4)
def _rank_table(path: str) -> _Table:
    return _Table({k.decode("latin-1"): v for k, v in load_ranks(path).items()})


def merged(word: Column, ranks: _Table, table: Column) -> Column:
    """ids of one non-empty word: ranked merges folded over its bytes. The state is the pieces and the rank of each with its right neighbour, of which a merge changes two."""
    return _bound(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), lambda raw: _bound(ranks.get(table, raw), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(_folded(raw, ranks, table))))


def _folded(raw: Column, ranks: _Table, table: Column) -> Column:
    n = F.length(raw)
    pieces = F.split(raw, "")
    rank = lambda key: F.coalesce(ranks.get(table, key), F.lit(_NEVER))
    pairs = F.when(n < 2, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda i: rank(F.substring(raw, i, F.lit(2)))))

    def join(p: Column, r: Column, i: Column) -> Column:
        """Pieces and ranks after pieces i and i + 1 became one."""

        def around(one: Column) -> Column:
            left = F.when(i > 1, rank(F.concat(F.element_at(p, F.greatest(i - 1, F.lit(1))), one)))
            right = F.when(i < F.size(r), rank(F.concat(one, F.element_at(p, F.least(i + 2, F.size(p))))))
            return F.struct(
                F.concat(F.slice(p, F.lit(1), i - 1), F.array(one), F.slice(p, i + 2, F.size(p))).alias("p"),
                F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), F.array_compact(F.array(left, right)), F.slice(r, i + 2, F.size(p))).alias("r"),
            )

        return _bound(F.concat(F.element_at(p, i), F.element_at(p, i + 1)), around)

    def step(s: Column, _: Column) -> Column:
        return _bound(F.array_min(s["r"]), lambda m: F.when(m.isNull() | (m == _NEVER), s).otherwise(_bound(F.array_position(s["r"], m).cast("int"), lambda i: join(s["p"], s["r"], i))))

    return F.aggregate(F.sequence(F.lit(1), n), F.struct(pieces.alias("p"), pairs.alias("r")), step, lambda s: F.transform(s["p"], lambda x: ranks.get(table, x)))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_UNICODE), F.lit(0))


def ids_in_spark(text: Column, ranks: _Table) -> Column:
    """ids of a text, every word merged by higher-order functions."""
    return _bound(ranks.table, lambda table: F.flatten(F.transform(words(text), lambda w: merged(w, ranks, table))))


class _Splitter:
    """Words of whole texts by the published pattern. The stretches between single spaces, each with the space before it, are split one by one; what ``of`` makes of their words is kept for a while, as texts share stretches."""

    def __init__(self, of):
        self.of, self.kept = of, {}
        self.word, self.entangled = regex.compile(PATTERN), regex.compile(_ENTANGLED)

    def parts(self, text: str) -> list:
        """``of`` the words of each stretch, in order."""
        if self.entangled.search(text):
            return [self.of(self.word.findall(text))]
        first, *rest = text.split(" ")
        kept, out = self.kept, [self.of(self.word.findall(first))]
        for s in rest:
            found = kept.get(s)
            if found is None:
                if len(kept) > 200_000:
                    kept.clear()
                found = kept[s] = self.of(self.word.findall(" " + s))
            out.append(found)
        return out


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, n): words and in how many stretches of how many texts they were seen, summed up as far as a task remembers."""
    splitter, seen = _Splitter(tuple), Counter()

    def summed() -> pa.RecordBatch:
        words: Counter = Counter()
        for found, n in seen.items():
            for w in found:
                words[w] += n
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["w", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(set(splitter.parts(text)))
        if len(seen) > 500_000:
            yield summed()
    if seen:
        yield summed()


def encoded_words(df: DataFrame, text: str, ranks_path: str) -> DataFrame:
    """(w, n, ids): every distinct word of ``df``, counted over all rows and merged in Spark, written to the shared folder."""
    spark = df.sparkSession
    counted = df.select(text).mapInArrow(_counted_words, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranks = _rank_table(ranks_path)
    return written(counted.repartition(tasks, "w").select("w", "n", _bound(ranks.table, lambda table: merged(F.col("w"), ranks, table)).alias("ids")))


def lexicon(coded: DataFrame, size: int) -> tuple[dict[str, bytes], DataFrame | None]:
    """Ids (32-bit, as bytes) of at most ``size`` words of ``coded``, the more frequent first by classes of a quarter of a power of two, and the table of the others, if there are any."""
    rank = F.floor(F.log2("n") * 4).cast("int")
    short = F.length("w") <= LONGEST
    found = coded.groupBy(F.when(short, rank).otherwise(-1).alias("rank")).agg(F.count(F.lit(1)).alias("words")).collect()  # at most 4 x 64 classes
    least, room = 1 << 30, size
    for r in sorted((r for r in found if r["rank"] >= 0), key=lambda r: -r["rank"]):
        if (room := room - r["words"]) < 0:
            break
        least = r["rank"]
    inside = short & (rank >= least)
    made = coded.where(inside).select("w", "ids").toArrow()
    ids = made["ids"].combine_chunks()
    ends = np.r_[0, np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))].astype(int)
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    known = {w: flat[a:b].tobytes() for w, a, b in zip(made["w"].to_pylist(), ends, ends[1:])}
    return known, coded.where(~inside).select("w", "ids") if any(r["rank"] < least for r in found) else None


class _Assembler:
    """Ids of whole texts from the lexicon. Of a stretch with other words, its pieces: ids, word, ids, ..., ids."""

    def __init__(self, known: dict[str, bytes]):
        self.known = known
        self.splitter = _Splitter(self.stretch)

    def stretch(self, words: list[str]) -> bytes | list:
        found = [self.known.get(w) for w in words]
        if None not in found:
            return b"".join(found)
        out: list = [b""]
        for w, ids in zip(words, found):
            if ids is None:
                out += [w, b""]
            else:
                out[-1] += ids
        return out

    def whole(self, text: str) -> bytes:
        """The ids as 32-bit integers, if the lexicon has every word."""
        return b"".join(self.splitter.parts(text))

    def pieces(self, text: str) -> tuple[list[bytes], list[str]]:
        """The runs of known ids, and the words between them that the lexicon lacks."""
        runs: list[list[bytes]] = [[]]
        late = []
        for found in self.splitter.parts(text):
            if type(found) is bytes:
                runs[-1].append(found)
            else:
                runs[-1].append(found[0])
                for w, ids in zip(found[1::2], found[2::2]):
                    late.append(w)
                    runs.append([ids])
        return [b"".join(r) for r in runs], late


def _lists(parts: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encode(df: DataFrame, ranks_path: str, text: str = "text", to: str = "ids", size: int = LEXICON, keep: list[str] | None = None) -> DataFrame:
    """``df`` with column ``to``: the ids of each whole text, without special tokens (their strings are ordinary text).

    A null or empty text gives an empty list; all rows are kept, repeated ones too; an existing column ``to`` is replaced. ``keep``: the columns of
    ``df`` that are wanted besides (all, unless given).
    """
    require(df, text, *(keep or []))
    columns = df.columns if keep is None else keep
    t = F.col(text).cast("string")
    coded = encoded_words(df.select(t.alias("t")).where("t <> ''"), "t", ranks_path)
    known, others = lexicon(coded, size)
    shared = df.sparkSession.sparkContext.broadcast(known)

    @F.arrow_udf("array<int>")
    def whole(texts: pa.Array) -> pa.Array:
        assembler = _assembler(shared)
        return _lists([assembler.whole(x) if x else b"" for x in texts.to_pylist()])

    if others is None:
        return df.withColumn(to, whole(t)).select(*dict.fromkeys([*columns, to]))

    @F.arrow_udf("struct<runs: array<array<int>>, late: array<string>>")
    def pieces(texts: pa.Array) -> pa.Array:
        assembler = _assembler(shared)
        made = [assembler.pieces(x or "") for x in texts.to_pylist()]
        edges = lambda k: pa.array(np.cumsum([0, *(len(m[k]) for m in made)], dtype=np.int32))
        runs = pa.ListArray.from_arrays(edges(0), _lists([r for m in made for r in m[0]]))
        late = pa.ListArray.from_arrays(edges(1), pa.array([w for m in made for w in m[1]], pa.string()))
        return pa.StructArray.from_arrays([runs, late], ["runs", "late"])

    row, packed = (f"{c}_{uuid.uuid4().hex[:8]}" for c in ("row", "packed"))
    # written once: the row numbers must not change between the two sides of the join
    base = written(df.withColumn(row, F.monotonically_increasing_id()).withColumn(packed, pieces(t)).select(*dict.fromkeys([*columns, row, packed])))
    runs, late = F.col(packed)["runs"], F.col(packed)["late"]
    done = base.where(F.size(late) == 0).withColumn(to, F.flatten(runs))
    waiting = base.where(F.size(late) > 0)  # only rows with a word that the lexicon lacks are joined
    found = waiting.select(row, F.posexplode(late).alias("k", "w")).join(others, "w").groupBy(row).agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("late_ids"))
    ids = F.flatten(F.zip_with(runs, F.concat(F.transform(found["late_ids"], lambda x: x["ids"]), F.array(F.array().cast("array<int>"))), lambda a, b: F.concat(a, b)))
    joined = waiting.join(found, row).withColumn(to, ids)
    return done.select(*dict.fromkeys([*columns, to])).unionByName(joined.select(*dict.fromkeys([*columns, to])))


_ASSEMBLERS: dict[int, _Assembler] = {}


def _assembler(shared) -> _Assembler:
    """One assembler for each worker and broadcast."""
    if id(shared.value) not in _ASSEMBLERS:
        _ASSEMBLERS.clear()
        _ASSEMBLERS[id(shared.value)] = _Assembler(shared.value)
    return _ASSEMBLERS[id(shared.value)]


#: Pieces joined at once in decoding, so that a long text isn't copied for each of its tokens.
_CHUNK = 256


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """``df`` with column ``to``: the text of each list of ids, by concatenating the tokens' bytes as binary pieces and reading them as UTF-8. A null list gives null, an empty one the empty text."""
    require(df, ids)
    by_id = [k for k, _ in sorted(load_ranks(ranks_path).items(), key=lambda x: x[1])]
    table = F.transform(F.from_json(F.lit(json.dumps([x.hex() for x in by_id])), "array<string>"), F.unhex)
    joined = lambda parts: F.aggregate(parts, F.lit(b""), lambda done, x: F.concat(done, x))

    def text(pieces: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(1), F.size(ids), F.lit(_CHUNK)), lambda at: joined(F.transform(F.slice(F.col(ids), at, F.lit(_CHUNK)), lambda i: pieces[i])))
        return F.when(F.size(ids) > 0, joined(chunks)).when(F.col(ids).isNotNull(), F.lit(b""))

    return df.withColumn(to, F.decode(_bound(table, text), "UTF-8"))
