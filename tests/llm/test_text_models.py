"""Quality, language and toxicity: their parts against plain versions, their tables on odd rows, accuracy on held-out rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from meterline.llm import hashing, language, quality, toxicity
from meterline.llm.common import table

ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "12 34 !!"), (5, "word " * 40_000), (6, "same text"), (6, "same text"), (None, "no id")]
STRANGE = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 3 == 1)  # held out, so nothing is learned from it
TAUGHT = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 3 == 2)
ODD += [(STRANGE, "漢字 😀 é"), (TAUGHT, "a word is some text, no id " * 9)]


def odd_docs(spark):
    return spark.createDataFrame([(*r, "en", 1, 2, True) for r in ODD], "doc_id long, text string, lang string, score int, predicted int, held_out boolean")


def test_word_hashes_find_the_same_words(monkeypatch):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("aAbBé漢 \t\n\x0b\xa0") for _ in range(rnd.randint(0, 60))) for _ in range(300)] + [None, ""]
    monkeypatch.setattr(hashing, "WINDOW", 97)
    lower = str.maketrans("AB", "ab")
    words = [[w for w in __import__("re").split("[ \t-\r]+", (t or "").translate(lower)) if w] for t in texts]
    heads: list = []
    values, at = hashing.word_hashes(pa.array(texts), (2,), heads)
    assert np.diff(at).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    by_word = {}
    assert all(by_word.setdefault(w, v) == v for w, v in zip(flat, values.tolist()))
    assert len(set(by_word.values())) == len(by_word)
    first = {}
    for w, h in zip(flat, heads[0].tolist()):
        raw = w.encode()
        assert (h == 0) == (len(raw) < 2) and first.setdefault(raw[:2], h) == h


def test_signs_at_the_ends_of_words_can_be_left_out():
    plain, _ = hashing.word_hashes(pa.array(["scum scum scum ! !!!! é."]))
    trimmed, at = hashing.word_hashes(pa.array(["scum SCUM!! (scum), ! !!!! é."]), trim=3)
    assert (trimmed[:3] == plain[0]).all() and at.tolist() == [0, 6] and len(set(trimmed[3:])) == 2


def test_shingles():
    sets = list(hashing.shingle_sets(pa.array(["a b c a b c", "A  b\nc a B c", "a b", "b a", "a", None, " "]), 3))
    assert [len(s) for s in sets] == [3, 3, 1, 1, 1, 0, 0]
    assert (sets[0] == sets[1]).all() and sets[2] != sets[3] and sets[2] != sets[4]


# quality


def test_quality_separates_and_is_calibrated():
    rnd = random.Random(2)
    good = [" ".join(rnd.choice(["the", "river", "stone", "walks", "under"]) for _ in range(200)) for _ in range(80)]
    bad = [" ".join(rnd.choice(["%%%", "$$x", "###", "|||", "&&"]) for _ in range(200)) for _ in range(80)]
    d = quality.Difference(quality.dictionary(good[:40]), quality.dictionary(bad[:40]))
    x = np.array([d(t) for t in good[40:] + bad[40:]])
    y = np.repeat([1.0, 0.0], 40)
    slope, offset = quality.curve(x, y)
    p = quality.sigmoid(slope * x + offset)
    assert ((p >= 0.5) == y).all() and d("") == d(None) == 0.0


def test_quality_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    got = quality.scored(odd_docs(spark), labels).collect()
    assert sorted((r.doc_id or 0) for r in got) == sorted((i or 0) for i, _ in ODD)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1 and len({r.score for r in got if r.doc_id == 6}) == 1
    none = quality.scored(odd_docs(spark), labels.filter("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.scored(odd_docs(spark).filter("false"), labels).collect() == []


def share(rows, truth, value):
    own = [r.predicted for r in rows if truth.get(r.doc_id) == value]
    return sum(own) / max(len(own), 1)


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in table(spark, folder, "labels").collect()}
    rows = [r for r in quality.query(spark, folder).collect() if r.held_out]
    assert share(rows, truth, 1) >= 0.97 and share(rows, truth, 0) <= 0.5


# language


def greedy(text: str, taught: str) -> int:
    count = at = 0
    while at < len(text):
        n = 0
        while at + n < len(text) and text[at : at + n + 1] in taught:
            n += 1
        at += max(n, 1)
        count += 1
    return count


def test_automaton_has_exactly_the_substrings():
    text = "abracadabra abba"
    automaton = language.SuffixAutomaton(text)

    def accepts(s):
        state = 0
        for c in s:
            if c not in automaton.next[state]:
                return False
            state = automaton.next[state][c]
        return True

    rnd = random.Random(3)
    for _ in range(3000):
        s = "".join(rnd.choice("abrcd ") for _ in range(rnd.randint(1, 6)))
        assert accepts(s) == (s in text)


def test_phrases(monkeypatch):
    monkeypatch.setattr(language, "LANE", 37)
    taught = (("a", "the cat sat on the mat and the dog ran"), ("b", "le chat est sur la table et le chien court"))
    parser = language.Parser(taught)
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("thecasondl rz") for _ in range(rnd.randint(0, 150))) for _ in range(60)]
    want = [[sum(greedy(t[i : i + 37], text) for i in range(0, len(t), 37)) for _, text in taught] for t in texts]
    assert parser.phrases(texts).tolist() == want


def test_language_rows(spark):
    docs = odd_docs(spark)
    got = {r.doc_id: r for r in language.identified(docs).collect()}
    assert {i: got[i].lang_pred for i in (1, 2, 3, 4)} == dict.fromkeys((1, 2, 3, 4), "und")
    assert {got[i].lang_pred for i in (5, 6, STRANGE, None)} == {"en"}
    assert got[STRANGE].mean_match < language.LEAST_MATCH < got[5].mean_match
    assert language.identified(docs.filter("false")).collect() == []
    kept = {r.doc_id for r in language.stage(spark, docs, "").collect()}
    assert kept == {5, 6, TAUGHT, None} and language.stage(spark, docs, "").columns == docs.columns
    untaught = language.identified(docs.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r.lang_pred for r in untaught.collect()} == {"und"}


def test_tables_have_the_moves_of_the_automaton():
    rnd = random.Random(6)
    for text in ["", "a", "abracadabra", "".join(chr(0x4E00 + rnd.randrange(900)) for _ in range(3000)), "".join(rnd.choice("abc é😀") for _ in range(2000))]:
        moves, t = language.SuffixAutomaton(text).next, language.Table.of(text)
        codes = t.symbols.tolist()
        state, symbol = (x.ravel() for x in np.meshgrid(np.arange(len(moves)), np.arange(len(codes) + 1), indexing="ij"))
        chars = [chr(c) for c in codes] + [None]
        assert t.move(state, symbol).tolist() == [moves[s].get(chars[c], -1) for s, c in zip(state, symbol)]


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "SHARD", 16)
    rnd = random.Random(7)
    rows, names = [], [f"l{i:02}" for i in range(70)]
    for i, name in enumerate(names):
        words = ["".join(chr(0x4E00 + 37 * i + rnd.randrange(30)) for _ in range(5)) for _ in range(30)]
        for _ in range(6 if i < 66 else 5):  # the last four have the fewest documents
            rows.append((1000 + len(rows), " ".join(rnd.choice(words) for _ in range(60)), name))
    rows += [(None, rows[-1][1], names[-1]), (None, rows[0][1], names[0]), rows[-1], rows[-1]]
    rows.append((TAUGHT, "x", "stray"))  # a language with one character of text takes no document
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    teaching = {r.lang for r in language.taught(docs).collect()}
    assert set(names) <= teaching
    got = sorted((r.doc_id or 0, r.lang_pred) for r in language.identified(docs.filter("lang <> 'stray'")).collect())
    assert got == sorted((i or 0, name) for i, _, name in rows[:-1])
    found = {(r.doc_id, r.lang_pred) for r in language.identified(docs).collect()}
    assert {(i, name) for i, _, name in rows[:-1]} <= found
    kept = language.stage(spark, docs, "").filter("lang <> 'stray'").collect()
    assert sorted((r.doc_id or 0, r.lang) for r in kept) == got


def test_language_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in table(spark, folder, "documents").select("doc_id", "lang").collect()}
    rows = [r for r in language.query(spark, folder).collect() if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in rows) >= 0.98 * len(rows)


# toxicity


def test_features_are_counted():
    texts = pa.array(["bad bad good", None, "badly bad", ""])
    words, _ = hashing.word_hashes(pa.array(["bad"]))
    row, feature, count, n = toxicity.counted(texts, np.sort(words))
    assert (row.tolist(), feature.tolist(), count.tolist(), n.tolist()) == ([0, 2], [0, 0], [2, 1], [3, 0, 2, 0])


def test_risk_learns_from_unlabelled_text():
    rnd = random.Random(5)
    plain = ["the", "sea", "is", "wide", "and", "blue", "today"]

    def text(toxic):
        return " ".join(rnd.choice(plain + ["scoundrel", "rascal"] * 2 * toxic) for _ in range(40))

    pos, unl = [text(1) for _ in range(150)], [text(i % 5 == 0) for i in range(400)]
    p, u = pa.array(pos), pa.array(unl)
    vocabulary = toxicity.vocabulary_of(p, u)
    model = toxicity.Model(vocabulary, toxicity.minimise(toxicity.matrix(p, vocabulary), toxicity.matrix(u, vocabulary), 0.2))
    assert (model.scores(pa.array([text(1) for _ in range(50)])) >= 0.5).mean() > 0.9
    assert (model.scores(pa.array([text(0) for _ in range(50)])) >= 0.5).mean() < 0.1


@pytest.mark.parametrize("positives", [True, False])
def test_toxicity_rows(spark, positives):
    labels = spark.createDataFrame([(i, 1, int(positives and i == 6)) for i in range(8)], "doc_id long, quality int, toxic int")
    got = toxicity.scored(odd_docs(spark), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id == 6}) == 1
    assert toxicity.scored(odd_docs(spark).filter("false"), labels).collect() == []


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in table(spark, folder, "labels").collect()}
    rows = [r for r in toxicity.query(spark, folder).collect() if r.held_out]
    assert share(rows, truth, 1) >= 0.85 and share(rows, truth, 0) <= 0.02


def test_language_stage_keeps_every_row_when_nothing_is_learned(spark):
    from meterline.llm import language

    rows = [(i, f"ciao mondo numero {i} parole", None, "s") for i in range(5)] + [(5, None, None, "s"), (6, "", None, None)]
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("_l", F.lit(3))
    out = language.stage(spark, docs, "")
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == list(range(7))
