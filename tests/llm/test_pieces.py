"""Encoding, decoding and counting against an exhaustive search and against the public library."""

import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from meterline.llm import pieces, sentence_pieces, token_counts

RND = random.Random(6)
FUZZ = ["".join(RND.choice("abcdeth in\n\t  ▁éü漢字😀\x00#%") for _ in range(RND.randint(0, 40))) for _ in range(800)]


def model_of(items, byte_pieces=True):
    m = proto.ModelProto()
    listed = [("<unk>", 0.0, 2)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] * byte_pieces + [(p, s, 1) for p, s in items]
    for piece, score, kind in listed:
        m.pieces.add(piece=piece, score=score, type=kind)
    return m.SerializeToString()


def best_paths(words, marked):
    """All segmentations of a chunk by score; the last piece that starts first wins ties, from the end on."""

    def of(end):
        if end == 0:
            return 0.0, []
        found = None
        for start in range(end):
            score, ids = of(start)
            piece = marked[start:end]
            if piece in words.matchable:
                option = (score + words.scores[words.matchable[piece]], ids + [words.matchable[piece]])
            elif end - start == 1:
                option = (score + words.unknown_score, ids + words.spell(piece))
            else:
                continue
            if found is None or option[0] > found[0]:
                found = option
        return found

    return of(len(marked))[1]


@pytest.mark.parametrize("byte_pieces", [True, False])
def test_exhaustive(byte_pieces):
    rnd = random.Random(7)
    for _ in range(40):
        items = {"▁": -5.0}
        for _ in range(12):
            items["▁" * rnd.randint(0, 1) + "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4)))] = -float(rnd.randint(1, 6))
        words = pieces.Vocabulary(model_of(items.items(), byte_pieces))
        codec, counter = sentence_pieces.Codec(words), token_counts.Counter(words)
        for _ in range(20):
            chunk = " " * rnd.randint(0, 1) + "".join(rnd.choice("abcx") for _ in range(rnd.randint(1, 7)))
            want = best_paths(words, chunk.replace(" ", "▁"))
            assert list(codec.chunk_ids(chunk)) == want
            assert counter.chunk_count(chunk) == len(want)


def test_same_as_the_library(spark):
    """The file as a unigram model. Its never-used runs of markers, at -10**9, go to -40000: the library sums in single precision."""
    m = proto.ModelProto()
    with open(pieces.DEFAULT, "rb") as file:
        m.ParseFromString(file.read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        p.score = max(p.score, -40000.0)
    library = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    codec = sentence_pieces.Codec(pieces.Vocabulary(m.SerializeToString()))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t in texts + [w for t in texts[:50] for w in t.split()] + [t for t in FUZZ if not set(t) & set("▁\0")]:
        assert codec.encode(t) == library.encode(t), t
        assert codec.decode(codec.encode(t)) == t


def test_round_trip_and_counts():
    codec, counter = sentence_pieces.codec(), token_counts.counter()
    for t in FUZZ + ["", " ", "  x", "▁", "a" * 3000, "▁ ▁"]:
        ids = codec.encode(t)
        assert codec.decode(ids) == t and counter.count(t) == len(ids)
    assert codec.decode([1, *codec.encode("x"), 2, 3 + 0xFF]) == "x�"


def test_memo_keeps_what_is_used():
    asked = []
    memo = pieces.Memo(lambda c: asked.append(c) or len(c), most=3)
    for c in ["a", "b", "c", "a", "d", "a", "e", "f", "a"]:
        assert memo[c] == 1
    assert asked.count("a") == 1 and len(memo) + len(memo.old) <= 6


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, "long " * 60_000)]
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, ids string, n_ids int")
    got = sentence_pieces.pieces_of(docs)
    assert got.columns == docs.columns
    ids = {r.doc_id: r.ids for r in got.collect()}
    assert ids[1] == ids[2] == [] and len(ids[4]) == sentence_pieces.codec().encode("long " * 60_000).__len__()
    counts = {r.doc_id: r.n_tokens for r in token_counts.counts(docs).collect()}
    assert counts == {k: len(v) for k, v in ids.items()}
    back = got.select("doc_id", sentence_pieces.decoded(got["ids"]).alias("t")).collect()
    assert {r.doc_id: r.t for r in back} == {i: t or "" for i, t in rows}
    assert sentence_pieces.pieces_of(docs.filter("false")).collect() == token_counts.counts(docs.filter("false")).collect() == []


def test_query(spark):
    assert sentence_pieces.query(spark, "/root/testdata/sf0.001").filter("not restored").count() == 0
