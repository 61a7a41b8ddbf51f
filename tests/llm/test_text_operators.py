import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import duplicates as D
from tidemill.llm import leakage as L
from tidemill.llm import lookalike as K
from tidemill.llm import overlap as O
from tidemill.llm import tokenize as T
from tidemill.llm import toxicity as X
from tidemill.llm.queries import tokenizer_path

POST = "id long, text string, class string, split string, source string, form int, t int"


def posts(spark, texts, split="train"):
    rows = [(i, t, None, s, None, 0, 0) for i, (t, s) in enumerate((x if isinstance(x, tuple) else (x, split)) for x in texts)]
    return spark.createDataFrame(rows, POST)


# -- 1


def test_one_look_one_form():
    speller = K.Speller({})
    same = ["Encore une fois", "Еncоrе une fois", "Ｅncore une fois", "En​co­re une fois", "Encore une ﬁ".replace("ﬁ", "fois")]
    assert {speller.form(x) for x in same} == {"Encore une fois"}
    assert speller.form("é") == speller.form("é") == speller.form("е́") == "é"
    assert len({speller.form(x) for x in ("ete", "été", "Ete", "ete.", " ete", "ete ", "e  te", "e te", "e\tte")}) == 9
    assert speller.form("👩‍💻") != speller.form("👩💻") and speller.form(None) is None and speller.form("") == ""
    assert speller.form("вот сон") == "вот сон" and speller.form("ВОТ ГОД СОН") == "ВОТ ГОД СОН" and speller.form("νέο ΝΕΟ θ") == "νέο ΝΕΟ θ"
    assert speller.form("a" * 200_000 + "е") == "a" * 200_000 + "e"


def test_pairs(spark):
    texts = ["mon texte", "mоn texte", "mon texte", "mon texte", "autre", "Autre", None, "", "​", "👍"]
    got = {tuple(r) for r in K.same_look_pairs(posts(spark, texts)).collect()}
    shapes = [K.shape(t) if t else None for t in texts]
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if texts[i] and texts[j] and texts[i] != texts[j] and shapes[i] == shapes[j]}
    assert got == want and (0, 1) in got and (0, 2) not in got
    assert K.same_look_pairs(posts(spark, [])).count() == 0
    twice = posts(spark, texts).unionByName(posts(spark, texts))
    assert {tuple(r) for r in K.same_look_pairs(twice).collect()} == want


# -- 4


def test_raw_fields():
    want = ("a b", "x", "u1", "3", "4", "fr")
    for line in ('{"text": "a b", "class": "x", "author": "u1", "likes": 3, "shares": 4, "lang": "fr"},', 'LANG = "fr" | text="a b" | Class: "x"; author="u1", likes="3" shares="4"'):
        assert D.fields(line) == want
    for line in (None, "", "   ", "id;text;class", "-- end of file --", '{"text": "a"}', "{broken"):
        assert D.fields(line) is None


def test_copies(spark):
    texts = ["Le chat, dort !", "le  CHAT dort", "lechatdort", "le chat dôrt", "...", "!!!", None, "", "Le сhаt dort", "le chat dort", "le chat dort"]
    line = lambda t, n: f'{{"text": "{t}", "class": "c", "author": "u", "likes": {n}, "shares": 1, "lang": "fr"}}'
    raw = spark.createDataFrame([(100, line("Ab c", 1)), (101, 'lang="FR"; shares="1"; likes="1"; author="U"; class="C"; text="a, bc"'), (102, line("Ab c", 2)), (103, None), (104, "")], "record_id long, record string")
    got = {tuple(r) for r in D.formatted_copies(posts(spark, texts), raw).collect()}
    assert got == {("task2_train", 0, i) for i in (1, 2, 8, 9, 10)} | {("task2_raw", 100, 101)}
    counts = {r.first_id: r.copies for r in D.copy_counts(posts(spark, texts)).collect()}
    assert counts[0] == 6 and counts[3] == 1 and sum(counts.values()) == len(texts)
    assert D.formatted_copies(posts(spark, []), raw.limit(0)).count() == 0


def test_copy_counts_of_texts_and_lines(spark):
    from collections import defaultdict

    r = random.Random(4)
    shout = lambda t: r.choice([t, t.upper(), t.replace(" ", ", "), f" {t} !"])
    base = ["un chat", "chat un", "nu chat", "le chien dort", "chien le dort", "seul"]  # several share letters, not order
    texts = [shout(r.choice(base)) for _ in range(60)] + ["tout autre", None, "", "...", "..."]
    raw = []
    for _ in range(60):
        t, n = shout(r.choice(base)), r.randint(1, 3)
        raw.append(r.choice([f'{{"text": "{t}", "class": "c", "author": "u", "likes": {n}, "shares": 1, "lang": "fr"}},', f'LANG="fr"; shares="1"; likes="{n}"; author="U"; class="C"; text="{t}"']))
    raw += [None, "", "text;class;author", "-- end --", "-- end --"]
    lines = spark.createDataFrame([(100 + i, x) for i, x in enumerate(raw)], "record_id long, record string")
    key = lambda t: re.sub(r"[\W_]+", "", t or "").lower()
    sets = defaultdict(list)
    for i, t in enumerate(texts):
        sets["task2_train", key(t) or i].append(i)
    for i, x in enumerate(raw, 100):
        sets["task2_raw", tuple(map(key, f)) if (f := D.fields(x)) else i].append(i)
    want = sorted((tbl, min(ids), len(ids)) for (tbl, _), ids in sets.items())
    got = sorted((x.tbl, x.first_id, x.copies) for x in D.copy_counts(posts(spark, texts), lines).collect())
    assert got == want and sum(n > 1 for t, _, n in want if t == "task2_raw") > 5
    copies = D.formatted_copies(posts(spark, texts), lines).collect()
    assert len(copies) == sum(n - 1 for _, _, n in want)
    only = sorted((x.tbl, x.first_id, x.copies) for x in D.copy_counts(None, lines).collect())
    assert only == [x for x in want if x[0] == "task2_raw"]
    assert D.copy_counts(posts(spark, []), lines.limit(0)).count() == 0


# -- 5


def test_word_edits():
    assert O.within(list("abcdef"), list("abxdef"), 2) and O.within(list("abcdef"), list("bcde"), 2) and not O.within(list("abcdef"), list("bacdfe"), 2)
    assert O.within([], ["a", "b"], 2) and not O.within([], ["a", "b", "c"], 2)
    r = random.Random(3)
    for _ in range(400):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 7))] for _ in range(2))
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
            last = row
        assert O.within(a, b, 2) == (last[-1] <= 2), (a, b)


def test_near_pairs_against_brute_force(spark):
    r = random.Random(5)
    vocabulary = ["mot%d" % i for i in range(12)]
    texts = []
    for _ in range(60):
        base = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 4, 5, 9]))]
        for _ in range(3):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(w) + 1)
                r.choice([lambda: w.insert(k, r.choice(vocabulary)), lambda: w and w.pop(k % len(w)), lambda: w and w.__setitem__(k % len(w), "X")])()
            texts.append((r.choice([" ", ", "]).join(w), r.choice(["train", "valid", "test", None])))
    texts += [(None, "train"), ("", "test"), ("...", "train"), ("!", "valid"), ("ab c d e f", "train"), ("a bc de f", "test")]
    words = [O.words(K.Speller({}).form(t)) if t else [] for t, _ in texts]
    want = set()
    for i, j in itertools.combinations(range(len(texts)), 2):
        kinds = {texts[i][1] == "train", texts[j][1] == "train"}
        if kinds == {True, False} and texts[i][1] and texts[j][1] and words[i] and words[j]:
            if "".join(words[i]) == "".join(words[j]) or O.within(words[i], words[j], 2):
                want.add((i, j))
    rows = [tuple(x) for x in O.near_pairs(posts(spark, texts)).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 100
    report = O.overlap_report(posts(spark, texts)).collect()
    assert sum(x.pairs for x in report) == len(want)
    assert O.near_pairs(posts(spark, [])).count() == 0


# -- 6


def test_encoding_matches_the_library(spark):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = tokenizer_path()
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=T.load_ranks(path), special_tokens={})
    texts = ["Hello  world", "it's the   end\n\n of\ta line  ", "éàü ßœ 日本語 👩‍💻", "<|endoftext|>", "a b   c\x1c d\x85e", " ", "   ", "\n \n x", "don'ts we'll 12345 ½ x²", "z" * 3000, "ab " * 500, "Ẁ̀ ́x", "\r\n\r\n  if", "end  ", "end\n ", "end \n", "  ", None, "", "Hello  world"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    for size in (4, 1 << 10):  # the lexicon's bound doesn't matter
        got = {r.doc_id: r.ids for r in T.encode(df, path, size=size).collect()}
        assert got == {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = T.decode(T.encode(df, path), path, "ids", "back")
    assert all((r.text or "") == r.back for r in back.collect())
    spark_only = df.where("text <> ''").select("doc_id", T.ids_in_spark(F.col("text"), T._rank_table(path)).alias("ids"))
    short = spark_only.where("doc_id not in (9, 10)")
    assert all(r.ids == library.encode_ordinary(texts[r.doc_id]) for r in short.collect())
    assert T.encode(df.limit(0), path).count() == 0


# -- 7


def test_markup_is_no_words():
    text = "A <b>bold</b> [[target page|label]] word<ref name=x>hidden words</ref><!-- gone --> caf&eacute; {{t|arg}} [[File:x|thumb|see [[y|this]]]]<ref name=z /> end"
    assert L.word_list(L.plain(text)) == ["a", "bold", "label", "word", "café", "t", "arg", "see", "this", "end"]


def test_leaks_against_brute_force(spark):
    r = random.Random(9)
    items = [(i, " ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(30))) for i in range(6)]
    docs = []
    for d in range(60):
        words = [r.choice("abcdefgh") + r.choice("xyz") for _ in range(r.randint(0, 40))]
        if d % 2:
            i, n, s = r.randrange(6), r.choice([11, 12, 13, 25]), r.randrange(5)
            part = items[i][1].split()[s : s + n]
            words[len(words) // 2 : len(words) // 2] = [w.upper() if r.random() < 0.3 else w for w in part]
        docs.append((d, r.choice([" ", ", ", "\n"]).join(words) or None))
    runs = {i: {tuple(w[k : k + 12]) for k in range(len(w) - 11)} for i, t in items if (w := t.split())}
    want = set()
    for d, t in docs:
        w = re.findall(r"\w+", (t or "").lower())
        have = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        want |= {(d, i) for i in runs if have & runs[i]}
    documents = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, "s", t) for i, t in items] + [(90, "s", "too short"), (91, None, None)], "item_id long, suite string, text string")
    assert {tuple(x) for x in L.leaks(documents, bench).collect()} == want and want
    assert {tuple(x) for x in L.leaks(documents.unionByName(documents), bench).collect()} == want
    assert L.leaks(documents.limit(0), bench).count() == 0 and L.leaks(documents, bench.limit(0)).count() == 0
    assert sum(x.documents for x in L.leak_report(documents, bench).collect()) == len(want)


# -- 8


def _toy(n, seed):
    r = random.Random(seed)
    nice = ["The church of {} was built in 1874 by {}.", "{} is a village near {} with a fine old bridge.", "The river {} flows into the {} after forty miles."]
    bad = ["{} is a complete wanker and everyone knows it", "shut up you pathetic {} moron", "what a bloody idiot this {} is"]
    name = lambda: "".join(r.choice("bdklmnrt") + r.choice("aeiou") for _ in range(3)).title()
    docs = []
    for _ in range(n):
        mark = r.random() < 0.3
        parts = [r.choice(nice).format(name(), name()) for _ in range(6)]
        if mark:
            parts.insert(r.randrange(6), r.choice(bad).format(name()))
        docs.append((" ".join(p if p.endswith(".") else p + "!" for p in parts), int(mark)))
    return docs


def test_abusive_passages(spark):
    rows = _toy(400, 1)
    r = random.Random(2)
    documents = spark.createDataFrame([(i, t, "s%d" % (i % 2), 0) for i, (t, _) in enumerate(rows)] + [(900, None, None, 0), (901, "", None, 0), (902, "***", None, 0)], "doc_id long, text string, source string, score int")
    marks = spark.createDataFrame([(i, m if r.random() > 0.03 else 1 - m) for i, (_, m) in enumerate(rows[:300])] + [(899, None), (7777, 1)], "doc_id long, toxic int")
    got = {x.doc_id for x in X.flagged(documents, marks).collect()}
    held = range(300, 400)
    right = sum((i in got) == bool(rows[i][1]) for i in held)
    assert right >= 95 and not {900, 901, 902} & got
    rates = {x.source: x for x in X.source_rates(documents, marks).collect()}
    assert sum(x.documents for x in rates.values()) == 403 and sum(x.flagged for x in rates.values()) == len(got) and rates[None].flagged == 0
    assert X.scored(documents.limit(0), marks).count() == 0
    assert X.flagged(documents, marks.limit(0)).count() == 0


def test_first_round_sees_every_window(monkeypatch):
    long, short = ". ".join(f"word{i} of the page" for i in range(50)), "a short page"
    seen, fit = [], X.Model.fit
    monkeypatch.setattr(X.Model, "fit", lambda self, vocabulary, found, labels, importance, **k: (seen.append((vocabulary, found, labels, importance)), fit(self, vocabulary, found, labels, importance, **k))[1])
    cut = lambda t: X.windows(X.passages(t))
    X.first_judge([cut(long), cut(short)], [cut(t) for t in (long, short, short)])
    vocabulary, found, labels, importance = seen[0]
    every = [w for t in (long, short, long, short, short) for w in cut(t)]
    word = {n: w for w, n in vocabulary.number.items()}
    assert [[word[n] for n in row if n] for row in found] == every and len(every) == 103 and list(labels) == [1] * 51 + [0] * 52
    assert importance[:50].sum() == pytest.approx(importance[50]) and importance[51:101].sum() == pytest.approx(importance[102])
    assert importance[:51].sum() == pytest.approx(importance[51:].sum()) and importance.mean() == pytest.approx(1)


def test_bar_at_the_labels_share():
    yes, no = np.array([3.0, 2.0, 1.0]), np.array([2.5, 0.5, 0.0])
    assert 0.5 < X._best_bar(yes, no, 1.0) < 1.0
    assert 2.5 < X._best_bar(yes, no, 10.0) < 3.0  # the one unmarked document above stands for ten


def test_scorer_saved_and_loaded(spark, tmp_path):
    rows = _toy(60, 3)
    documents = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, m) for i, (_, m) in enumerate(rows)] * 2, "doc_id long, toxic int")  # repeated labels
    judge = X.fitted(documents, marks)
    judge.save(spark, str(tmp_path / "scorer"))
    again = X.Scorer.load(spark, str(tmp_path / "scorer"))
    want = {r.doc_id: r.score for r in X.scored(documents, judge).collect()}
    assert {r.doc_id: r.score for r in X.scored(documents, again).collect()} == want and len(want) == 60


def test_disguises_and_quotations():
    assert X.passages('He wrote "you fool" there') == [["he", "wrote", "there"]]
    assert ["naked"] == X.passages("n-a-k-e-d")[0][:1] and X.passages("TEEEETAS")[0] == ["tetas"] and X.passages("PL4G4")[0] == ["plaga"]
    assert X.passages("so n a k e d here! And {{x||n-a-k-e-d}} we") == [["so", "naked", "here"], ["and"], ["x"], ["naked"], ["we"]]
    assert X.passages("a b c") == [["a", "b", "c"]] and X.passages("he «said " + "so " * 500 + "» there") == [["he", "there"]]
