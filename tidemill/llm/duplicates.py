"""Records that differ only in formatting (problem 4): progressive partition refinement.

Rows are first parted by invariants that cost little: how many letters and digits they have and a histogram of these, both
blind to case and look-alikes, so that copies always agree in them. Only rows that share a part with another go on to the
costlier key, the letters and digits in order in the form of problem 1, of which a digest is grouped.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.common import require, written
from tidemill.llm.lookalike import LOOKALIKES, PLAIN, Speller, bigram_counts

#: The fields of a raw line, in the order of its key.
FIELDS = ("text", "class", "author", "likes", "shares", "lang")
_PAIR = re.compile(r"""["']?\b(text|class|author|likes|shares|lang)\b["']?\s*[:=]\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|([^\s,;|}]+))""", re.IGNORECASE | re.DOTALL)
_ESCAPE = re.compile(r'\\(["\'\\/])')
_REST = re.compile(r"[\W_]+")
_MARKED = re.compile("[\u0300-\u036f\u0483-\u0487\u1ab0-\u1aff\u1dc0-\u1dff]")


def core(form: str) -> str:
    """Letters (with their accents) and digits of a text in the form of problem 1, in order, without case."""
    folded = form.casefold()
    if _MARKED.search(folded):
        kept = []
        for ch in folded:
            if ch.isalnum() or kept and _MARKED.match(ch):
                kept.append(ch)
        return "".join(kept)
    return _REST.sub("", folded)


def fields(line: str | None) -> tuple[str, ...] | None:
    """The six fields of a raw line in any notation (JSON, or names with quoted values), names in any case and order; None for lines that lack one (headers, footers, blanks)."""
    if not line or not (line := line.strip()):
        return None
    found: dict[str, str] = {}
    if line[0] == "{":
        try:
            record = json.loads(line.rstrip(", \t\r\n"))
            found = {k.strip().lower(): "" if v is None else str(v) for k, v in record.items()}
        except (ValueError, AttributeError):
            found = {}
    if not found:
        for name, double, single, bare in _PAIR.findall(line):
            found.setdefault(name.lower(), _ESCAPE.sub(r"\1", double or single or bare))
    return tuple(found[f] for f in FIELDS) if all(f in found for f in FIELDS) else None


def _closure() -> dict[str, str]:
    """One letter for all that case and look-alikes tie together, from letter to letter."""
    head: dict[str, str] = {}

    def find(x: str) -> str:
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    for letter, others in LOOKALIKES.items():
        for x in others:
            a, b = find(letter.casefold()), find(x.casefold())
            head[max(a, b)] = min(a, b)
    return {x: find(x) for x in head}


_CLOSURE = _closure()


class _Blind(dict):
    """Translation that keeps letters and digits only, without case, accents and what look-alikes differ in; filled as characters occur."""

    def __missing__(self, o: int) -> str:
        plain = PLAIN[o]
        folded = unicodedata.normalize("NFD", "" if plain is None else (chr(plain) if isinstance(plain, int) else plain).casefold())
        found = self[o] = "".join(_CLOSURE.get(x, x) for x in folded if x.isalnum())
        return found


_BLIND = _Blind()


def invariants(parts: list[str]) -> tuple[int, int]:
    """How many letters and digits ``parts`` have, and a 64-bit hash of how many of each, whatever their order: equal for copies, cheaper than their form."""
    blind = [x.translate(_BLIND) for x in parts]
    return sum(map(len, blind)), xxhash.xxh64_intdigest("\x1f".join("".join(sorted(x)) for x in blind)) - (1 << 63)


def _keys_of(df: DataFrame, key: str, column: str, parts) -> DataFrame:
    """(id, size, histogram, parts) of each row; ``parts`` gives what of its string is compared, or None. Rows with nothing to compare have nulls."""

    def batches(it):
        for b in it:
            rows = []
            for i, t in zip(b["id"], b["t"]):
                p = parts(t)
                size, histogram = invariants(p) if p is not None else (0, 0)
                rows.append((i, size, histogram, p) if size else (i, None, None, None))
            yield pd.DataFrame({"id": [r[0] for r in rows], "size": pd.array([r[1] for r in rows], "Int32"), "histogram": pd.array([r[2] for r in rows], "Int64"), "parts": [r[3] for r in rows]})

    return df.select(F.col(key).cast("long").alias("id"), F.col(column).cast("string").alias("t")).mapInPandas(batches, "id long, size int, histogram long, parts array<string>")


def text_keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """Invariants of each text, see _keys_of; texts without a letter or digit have nulls."""
    return _keys_of(df, key, text, lambda t: None if not t else [t])


def line_keys(df: DataFrame, key: str, line: str) -> DataFrame:
    """Invariants of each raw line by its six fields in fixed order, see _keys_of; lines that lack one have nulls."""
    return _keys_of(df, key, line, lambda t: list(f) if (f := fields(t)) else None)


#: What rows of one set of copies share: the table and the invariants of the first stage.
PARTS = ["tbl", "size", "histogram"]


def shared_parts(keys: DataFrame) -> DataFrame:
    """The parts of several rows. Counting is pre-aggregated, so a part with a third of all rows costs one counter a task."""
    return keys.where("size is not null").groupBy(*PARTS).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def refined(keys: DataFrame, speller: Speller) -> DataFrame:
    """(tbl, id, form): rows of ``keys`` that share their part with another row, with a digest of the costlier key, which is made for these rows only."""

    @F.arrow_udf("binary")
    def digest(parts: pa.Array) -> pa.Array:
        return pa.array([xxhash.xxh128_digest("\x1f".join(core(speller.form(x)) for x in p)) for p in parts.to_pylist()], pa.binary())

    return keys.join(shared_parts(keys), PARTS, "left_semi").select("tbl", "id", digest("parts").alias("form"))


def classes(rows: DataFrame, least: int = 2) -> DataFrame:
    """(tbl, form, first_id, copies) of the sets of at least ``least`` copies among refined rows."""
    return rows.groupBy("tbl", "form").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where(F.col("copies") >= least)


def _keys(texts: DataFrame | None, lines: DataFrame | None, key: str, text: str, line_key: str, line: str, names: tuple[str, str]) -> tuple[DataFrame, Speller]:
    """Invariants of the texts and of the lines with their table's name, written once, and the search for their forms."""
    parts, counts = [], {}
    if texts is not None:
        require(texts, key, text)
        counts = bigram_counts(texts, text)
        parts.append(text_keys(texts, key, text).select(F.lit(names[0]).alias("tbl"), "*"))
    if lines is not None:
        require(lines, line_key, line)
        counts = counts or bigram_counts(lines, line)
        parts.append(line_keys(lines, line_key, line).select(F.lit(names[1]).alias("tbl"), "*"))
    return written(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])), Speller(counts)


def formatted_copies(texts: DataFrame | None, lines: DataFrame | None, key: str = "id", text: str = "text", line_key: str = "record_id", line: str = "record", names: tuple[str, str] = ("task2_train", "task2_raw")) -> DataFrame:
    """(tbl, first_id, copy_id): each member of a set of copies but the smallest id, within a table of texts and within a table of raw lines.

    Nulls, blanks, texts without a letter or digit and lines without all six fields are in no set; exact copies count;
    other columns don't matter; an empty table gives no rows. Sets don't cross tables.
    """
    rows = written(refined(*_keys(texts, lines, key, text, line_key, line, names)))
    found = classes(rows).select("tbl", "form", "first_id")
    return rows.join(found, ["tbl", "form"]).where("id <> first_id").select("tbl", "first_id", F.col("id").alias("copy_id"))


def copy_counts(texts: DataFrame | None, lines: DataFrame | None = None, key: str = "id", text: str = "text", line_key: str = "record_id", line: str = "record", names: tuple[str, str] = ("task2_train", "task2_raw")) -> DataFrame:
    """One record for each set of copies, or single text or line, with its number of copies: (tbl, first_id, copies).

    Sets are those of ``formatted_copies``; only rows that share their part with another are grouped by the exact key.
    Nulls, blanks, texts without a letter or digit and lines without all six fields are left as they are, one row each, so
    that the copies of a table add up to its rows.
    """
    keys, speller = _keys(texts, lines, key, text, line_key, line, names)
    alone = keys.join(shared_parts(keys), PARTS, "left_anti").select("tbl", F.col("id").alias("first_id"), F.lit(1).cast("long").alias("copies"))
    return classes(refined(keys, speller), 1).select("tbl", "first_id", "copies").unionByName(alone)
