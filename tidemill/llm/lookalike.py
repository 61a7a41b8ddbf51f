"""One form for texts that look the same (problem 1).

A text is first brought to its *shape*: characters that draw nothing are deleted, special spaces become the ordinary one,
full-width forms and ligatures become the plain characters, and every letter of a look-alike class becomes the class's
first member (over canonical decomposition, so that accents on look-alikes count too). Equal shape is equal look.

The *form* re-spells each token of the shape: every shape character is a column of a lattice whose nodes are the letters
of its class, and a Viterbi search takes the path with the fewest changes of script and, among those, the best
character-bigram score of its script. Bigrams are counted over the whole corpus. As lattice and scores depend on the shape
alone, texts of one look always get one form, and texts of different look never do, while a Cyrillic or Greek post stays
readable (and folds case properly) although some of its letters look Latin.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.common import bounded_rows, require, written

# Letters drawn alike in common fonts, by the letter that stands for the class.
LOOKALIKES = {
    "a": "аɑ", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "оοօ", "p": "р", "q": "ԛ", "s": "ѕ",
    "v": "νѵ", "w": "ԝ", "x": "х", "y": "у", "g": "ɡ", "æ": "ӕ", "ə": "ә",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ", "N": "Ν",
    "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "Ѕ", "T": "ТΤ", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ", "Æ": "Ӕ",
    "Γ": "Г", "Π": "П", "Φ": "Ф",
}
LATIN, CYRILLIC, GREEK, OTHER = range(4)
SCRIPTS = (LATIN, CYRILLIC, GREEK)
#: A change of script outweighs any bigram score of a token.
SWITCH = 1e6
#: Bigrams kept at most: (letters of one script that are told apart + one for the rest)², three scripts.
MAX_BIGRAMS = 3 * 128 * 128

_REP = {x: rep for rep, others in LOOKALIKES.items() for x in others}
_VISIBLE_CF = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x8E2, 0x110BD}
_BLANK = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0000, 0xE1000)}
_PICTO = "[←-⯿〰〽\U0001f000-\U0001faff]"
_LOOSE_JOINER = re.compile(f"(?<!{_PICTO})‍|‍(?!{_PICTO})")


@lru_cache(maxsize=None)
def script(ch: str) -> int:
    """Latin, Cyrillic, Greek or any other, by the character's name."""
    name = unicodedata.name(ch, "")
    return LATIN if name.startswith("LATIN") else CYRILLIC if name.startswith("CYRILLIC") else GREEK if name.startswith("GREEK") else OTHER


class _Plain(dict):
    """Translation of one character before decomposition; filled as characters occur."""

    def __missing__(self, o: int):
        ch = chr(o)
        kind = unicodedata.category(ch)
        tag = unicodedata.decomposition(ch).partition(" ")[0]
        if o == 0x200D:
            to = o
        elif o in _BLANK or kind == "Cf" and o not in _VISIBLE_CF or kind == "Cc" and ch not in "\t\n\v\f\r\x85":
            to = None
        elif kind == "Zs":
            to = " "
        elif tag in ("<wide>", "<narrow>", "<noBreak>") or 0xFB00 <= o <= 0xFB06:
            to = unicodedata.normalize("NFKC", ch)
        else:
            to = o
        self[o] = to
        return to


PLAIN = _Plain()
_SHAPES = {ord(x): rep for x, rep in _REP.items()}
_WESTERN = re.compile("[\t-\r -~\xa1-\xac\xae-ɏ–—‘-„…]*")
_CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f]")


def shape(text: str | None) -> str | None:
    """What a text looks like: equal for texts that can't be told apart on screen, different for any others."""
    if text is None:
        return None
    if text.isascii():
        return _CONTROL.sub("", text) if _CONTROL.search(text) else text
    if _WESTERN.fullmatch(text):  # nothing here is special, blank or stands for another letter
        return unicodedata.normalize("NFC", text)
    text = text.translate(PLAIN)
    if "‍" in text:  # a joiner is seen only where it fuses two pictures
        text = _LOOSE_JOINER.sub("", text)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_SHAPES))


@lru_cache(maxsize=1 << 14)
def _column(ch: str) -> tuple[tuple[int, str], ...]:
    """The lattice column of one shape character: its look-alikes by script, accents kept; one node for anything else."""
    base, *marks = unicodedata.normalize("NFD", ch) or ch
    if base not in LOOKALIKES:
        return ((script(base), ch),)
    nodes = {}
    for x in base + LOOKALIKES[base]:
        nodes.setdefault(script(x), unicodedata.normalize("NFC", x + "".join(marks)))
    nodes.pop(OTHER, None)
    return tuple(nodes.items())


_KNOWN = {unicodedata.normalize("NFD", x)[0].lower() for rep, others in LOOKALIKES.items() for x in rep + others} | {chr(o) for r in (range(0x61, 0x7B), range(0x430, 0x450), range(0x3B1, 0x3CA)) for o in r}


@lru_cache(maxsize=1 << 14)
def _symbol(ch: str) -> str:
    """A letter as the bigram counts know it: lower case without accents; letters outside the look-alike classes count as one, so that the counts are bounded."""
    base = unicodedata.normalize("NFD", ch)[0].lower()
    return base if base in _KNOWN else "*"


class Speller:
    """Viterbi search over look-alike lattices with bigram scores of each script."""

    def __init__(self, counts: dict[tuple[int, str, str], int]):
        left = Counter()
        for (s, a, _), n in counts.items():
            left[s, a] += n
        size = {s: len({b for k, _, b in counts if k == s}) + 1 for s in SCRIPTS}
        self.score = {(s, a, b): math.log((n + 0.5) / (left[s, a] + 0.5 * size[s])) for (s, a, b), n in counts.items()}
        self.unseen = {(s, a): math.log(0.5 / (n + 0.5 * size[s])) for (s, a), n in left.items()}
        self.never = -math.log(64)
        self.spelled: dict[tuple[str, int], str] = {}

    def _bigram(self, s: int, a: str, b: str) -> float:
        return self.score.get((s, a, b), self.unseen.get((s, a), self.never))

    def home(self, shaped: str) -> int:
        """The script that spells most letters of the text; ties by bigram score, then Latin first."""
        missing, any_letter = [0, 0, 0], False
        for ch, n in Counter(shaped).items():
            if ch.isalpha():
                have = [s for s, _ in _column(ch)]
                if have != [OTHER]:
                    any_letter = True
                    for s in SCRIPTS:
                        missing[s] += n * (s not in have)
        if not any_letter:
            return LATIN
        least = min(missing)
        best = [s for s in SCRIPTS if missing[s] == least]
        if len(best) == 1:
            return best[0]
        return max(best, key=lambda s: (sum(self._path_score(t, s) for t in _TOKEN.findall(shaped)), -s))

    def _path_score(self, token: str, s: int) -> float:
        spelled = [dict(_column(ch)).get(s) for ch in token]
        total, last = 0.0, "^"
        for x in spelled:
            if x is not None:
                total += self._bigram(s, last, _symbol(x))
                last = _symbol(x)
        return total

    def token(self, token: str, home: int) -> str:
        """The best path of a token in a text of script ``home``; recent ones are remembered."""
        found = self.spelled.get((token, home))
        if found is None:
            if len(self.spelled) > 1 << 15:
                self.spelled.clear()
            found = self.spelled[token, home] = self._token(token, home)
        return found

    def _token(self, token: str, home: int) -> str:
        """The best path: least changes of script (the text's own before the first letter), then highest score."""
        paths: dict[tuple[int, str], tuple[float, str]] = {(home, "^"): (0.0, "")}
        for ch in token:
            if not ch.isalpha():
                paths = {k: (c, done + ch) for k, (c, done) in paths.items()}
                continue
            ahead: dict[tuple[int, str], tuple[float, str]] = {}
            for s, x in _column(ch):
                for (was, last), (cost, done) in paths.items():
                    sym = _symbol(x)
                    step = cost if s == OTHER else cost - self._bigram(s, last if was == s else "^", sym) + (SWITCH if was not in (s, OTHER) else 0)
                    key = (was if s == OTHER else s, sym)
                    now = (step, done + x)
                    if key not in ahead or now < ahead[key]:
                        ahead[key] = now
            paths = ahead
        return min(paths.values())[1]

    def form(self, text: str | None) -> str | None:
        """The one form of all texts that look like ``text``; null stays null, empty stays empty."""
        shaped = shape(text)
        if not shaped or not _FOREIGN.search(shaped) and _PLAIN_LATIN.search(shaped):
            return shaped  # no letter of another script alone: every token's path without a change of script is Latin
        home = self.home(shaped)
        return _TOKEN.sub(lambda m: self.token(m.group(), home), shaped)


_TOKEN = re.compile(r"[^\W\d_]+")
_FOREIGN = re.compile("[Ͱ-ԯᲀ-᲏ἀ-῿ⷠ-ⷿꙀ-ꚟ]")
_PLAIN_LATIN = re.compile("[bfkmnrtuzDFLRU]")


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tokens: Counter = Counter()
    found: dict[tuple[int, str, str], int] = defaultdict(int)

    def flush() -> None:
        for token, n in tokens.items():
            token = unicodedata.normalize("NFC", token)
            kinds = {script(unicodedata.normalize("NFD", ch)[0]) for ch in token}
            if len(kinds) == 1 and (s := kinds.pop()) != OTHER:
                last = "^"
                for ch in token:
                    sym = _symbol(ch)
                    found[s, last, sym] += n
                    last = sym
        tokens.clear()

    for batch in batches:
        for text in batch.iloc[:, 0].dropna():
            tokens.update(_TOKEN.findall(text))
        if len(tokens) > 200_000:
            flush()
    flush()
    if found:
        yield pd.DataFrame([(s, a, b, n) for (s, a, b), n in found.items()], columns=["script", "a", "b", "n"])


def bigram_counts(df: DataFrame, text: str = "text") -> dict[tuple[int, str, str], int]:
    """Character bigrams of all tokens written in one script, over all rows of ``df``; at most MAX_BIGRAMS reach the driver (a bound of the alphabet, not of the data)."""
    counted = df.select(F.col(text).cast("string")).mapInPandas(_count, "script int, a string, b string, n long")
    summed = counted.groupBy("script", "a", "b").agg(F.sum("n").alias("n"))
    return {(r.script, r.a, r.b): r.n for r in bounded_rows(summed, MAX_BIGRAMS, "bigrams")}


def canonical(df: DataFrame, text: str = "text", to: str = "form", counts: dict | None = None) -> DataFrame:
    """``df`` with column ``to``: the one form of each text. Null gives null, empty gives empty; an existing column ``to`` is replaced. ``counts``: see bigram_counts, which is run over ``df`` if absent."""
    require(df, text)
    speller = Speller(bigram_counts(df, text) if counts is None else counts)

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return texts.map(speller.form, na_action="ignore")

    return df.withColumn(to, form(F.col(text).cast("string")))


def same_look_pairs(df: DataFrame, key: str = "id", text: str = "text", counts: dict | None = None) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows whose texts differ as strings but have one form.

    Work grows with the rows and the pairs that come out: exact copies are folded into one variant, only forms with several
    variants go on, variants are paired first, and each pair of variants is then expanded into its rows. Null and empty texts
    are in no pair; repeated ids are taken as rows of their own; an empty table gives none.
    """
    require(df, key, text)
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t")).where("t <> ''")
    # digests are written once, so that the search runs once however often they are joined
    rows = written(canonical(rows, "t", "form", counts).select("id", F.unhex(F.md5("form")).alias("form"), F.unhex(F.md5("t")).alias("raw")).where("form is not null"))
    # min <> max tells several variants with partial aggregation and constant state
    several = rows.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("form")
    kept = rows.join(several, "form", "left_semi")
    variants = kept.select("form", "raw").distinct()
    twos = variants.alias("a").join(variants.withColumnRenamed("raw", "raw_b").alias("b"), "form").where("raw < raw_b").select("form", F.col("raw").alias("raw_a"), "raw_b")
    left = kept.select("form", F.col("raw").alias("raw_a"), F.col("id").alias("i"))
    right = kept.select("form", F.col("raw").alias("raw_b"), F.col("id").alias("j"))
    pairs = twos.join(left, ["form", "raw_a"]).join(right, ["form", "raw_b"]).where("i <> j")
    return pairs.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))

