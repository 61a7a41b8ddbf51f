"""Benchmark passages inside documents (problem 7): Wu-Manber search for many patterns over words.

The patterns are all runs of ``run`` words of the items. A shift table over blocks of two words tells how far the search
may skip: a block that ends no pattern skips as far as its nearest place in any pattern allows, an unknown block almost a
whole run. Where a block ends patterns, a bucket by the block's hash gives those patterns, which are compared word by word.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.common import require
from tidemill.llm.duplicates import core
from tidemill.llm.lookalike import shape

RUN, BLOCK = 12, 2
#: Characters of patterns one broadcast search holds at most; more items are searched in further blocks, each over all documents.
PATTERN_CHARS = 4 << 20

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.DOTALL)
_REFERENCE = re.compile(r"<ref\b[^<>]*?/\s*>|<ref\b[^<>]*>.*?</ref\s*>", re.DOTALL | re.IGNORECASE)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_LINK = re.compile(r"\[\[([^\[\]|]*)((?:\|[^\[\]|]*)*)\]\]")
_PIECE = re.compile(r"\S+")
_SPLIT = re.compile(r"[\W_]+")


def _label(m: re.Match) -> str:
    return m.group(2).rpartition("|")[2] if m.group(2) else m.group(1)


def plain(text: str) -> str:
    """A wiki text without comments, references and tags; of a piped link only the label; entities as their characters."""
    if "<" in text:
        if "<!--" in text:
            text = _COMMENT.sub("", text)
        if "<ref" in text or "<REF" in text or "<Ref" in text:
            text = _REFERENCE.sub("", text)
        text = _TAG.sub("", text)
    while "[[" in text:  # inner links first
        text, n = _LINK.subn(_label, text)
        if not n:
            break
    if "&" in text:
        text = html.unescape(html.unescape(text))
    return text


def word_list(text: str, form=shape) -> list[str]:
    """Words in the form of problem 1 without case; everything but letters, digits and accents parts words."""
    folded = form(text).casefold()
    return [w for w in _SPLIT.split(folded) if w] if folded.isascii() else [w for x in _PIECE.findall(_SPLIT_KEEP.sub(" ", folded)) if (w := core(x))]


_SPLIT_KEEP = re.compile("[^\\ẁ-ͯ҃-҇᪰-᫿᷀-᷿]+|_+")


class WuManber:
    """Patterns are word runs of one length; items of fewer words than ``run`` have none."""

    def __init__(self, items: Iterable[tuple[int, list[str]]], run: int = RUN):
        self.run, self.shift, self.bucket = run, {}, defaultdict(list)
        for item, found in items:
            for at in range(len(found) - run + 1):
                pattern = tuple(found[at : at + run])
                for end in range(BLOCK, run + 1):
                    block = pattern[end - BLOCK : end]
                    self.shift[block] = min(self.shift.get(block, run - BLOCK + 1), run - end)
                self.bucket[pattern[-BLOCK:]].append((pattern, item))

    def search(self, words: list[str]) -> set[int]:
        """Items of which a whole run occurs."""
        found: set[int] = set()
        run, far, shift = self.run, self.run - BLOCK + 1, self.shift
        at, size = run, len(words)
        while at <= size:
            skip = shift.get((words[at - 2], words[at - 1]), far)
            if skip:
                at += skip
                continue
            here = tuple(words[at - run : at])
            found.update(item for pattern, item in self.bucket[here[-BLOCK:]] if pattern == here)
            at += 1
        return found


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", run: int = RUN) -> DataFrame:
    """(doc_id, item_id): each document whose text holds at least ``run`` consecutive words of the item.

    Case, punctuation, line breaks and look-alike characters don't matter; markup isn't words (see ``plain``). Null and empty
    texts, and items of fewer than ``run`` words, are in no pair; a repeated document or item id gives one row. The items are the stated
    query set: they are read in blocks of bounded size, each searched in all documents.
    """
    require(documents, key, text)
    require(items, item_key, item_text)
    spark = documents.sparkSession
    docs = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).where("t <> ''")
    found, block, chars = [], [], 0

    def searched(block: list[tuple[int, list[str]]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(WuManber(block, run))

        def batches(it):
            search = shared.value.search
            for b in it:
                hits = [(d, i) for d, t in zip(b["doc_id"], b["t"]) for i in search(word_list(plain(t)))]
                yield pd.DataFrame(hits, columns=["doc_id", "item_id"]).astype("int64")

        return docs.mapInPandas(batches, "doc_id long, item_id long")

    for r in items.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t <> ''").toLocalIterator():
        words = word_list(plain(r.t))
        block.append((r.i, words))
        chars += sum(map(len, words)) * run
        if chars > PATTERN_CHARS * run:
            found.append(searched(block))
            block, chars = [], 0
    if block or not found:
        found.append(searched(block))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def leak_report(documents: DataFrame, items: DataFrame, suite: str = "suite") -> DataFrame:
    """(item_id, suite, documents): of each leaked item, the number of documents that carry it."""
    per_item = leaks(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return per_item.join(items.select("item_id", suite), "item_id").select("item_id", F.col(suite).alias("suite"), "documents")


