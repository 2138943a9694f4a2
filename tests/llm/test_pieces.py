import random

import numpy as np
import pytest
import sentencepiece

import __spark_entry__ as entry
from sparcel.llm import pieces as P

EDGES = [
    "", "a", " ", "  ", "   a", "a  ", "a  b   c", "x   1 2", " 1", "  1", "\n", "\n\n a\n", "a\nb", "hello world 123 foo.bar()", "日本語 テキスト 🎉🎉 é", "\t\tx",
    " " * 20 + "q" + " " * 37, "   日", "  🎉 ", "a🎉b", "<s> </s> <0x0A> <unk>", "a" * 31 + " ", "thetheinginging" * 30, "x" * 300, "\0 a\0",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


@pytest.fixture(scope="module")
def coder():
    return P.Encoder(P.Vocabulary(open(P.MODEL, "rb").read()))


@pytest.fixture(scope="module")
def decoder():
    return P.Decoder(open(P.MODEL, "rb").read())


def random_texts(n):
    rng = random.Random(1)
    return ["".join(rng.choice("  \n\tabcdeinghtor.,1-_({é日🎉A") for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_equals_the_library(coder, decoder, library):
    texts = EDGES + random_texts(2000)
    for text, ids in zip(texts, coder.encode(texts)):
        assert ids.tolist() == library.encode(text), repr(text)
        assert decoder.decode(ids) == text


def test_documents_equal_the_library(spark, sf_dir, coder, library):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert [ids.tolist() for ids in coder.encode(texts)] == library.encode(texts)


def test_bounds_do_not_change_results(monkeypatch, library):
    monkeypatch.setattr(P, "REMEMBERED", 40)
    monkeypatch.setattr(P, "INDEXED", 30)
    monkeypatch.setattr(P, "TAKEN", 120)
    monkeypatch.setattr(P, "LONG", 5)
    coder = P.Encoder(P.Vocabulary(open(P.MODEL, "rb").read()))
    texts = EDGES + random_texts(300) + ["some words and   more words\n" * 40]
    assert [ids.tolist() for ids in coder.encode(texts)] == [library.encode(t) for t in texts]


def test_suffix_array():
    codes = np.frombuffer(b"banana\0anna\0", np.uint8).astype(np.int64)
    order, _ = P.suffix_array(codes, 4, 8)
    text = lambda i, n=4: bytes(codes[i : i + n].tolist()).ljust(n, b"\0")
    assert sorted(order.tolist()) == list(range(len(codes)))
    assert [text(i) for i in order] == sorted(text(i) for i in range(len(codes)))
    deep, _ = P.suffix_array(codes, 8, 20)  # three characters a key
    assert [text(i, 8) for i in deep] == sorted(text(i, 8) for i in range(len(codes)))


def test_spaces_mark_decodes_to_a_space(coder, decoder, library):
    assert coder.encode(["▁x▁▁y"])[0].tolist() == library.encode("▁x▁▁y")
    assert decoder.decode(coder.encode(["▁x▁▁y"])[0]) == " x  y"


def test_frames(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "same text", None), (3, "same text", None), (None, "long " * 100_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pieces string")
    got = P.decode(P.encode(docs, "ids"), "back", "ids")
    assert got.columns == ["doc_id", "text", "pieces", "ids", "back"]
    assert [r.back for r in got.collect()] == [t or "" for _, t, _ in rows]
    assert P.encode(docs.limit(0)).count() == 0
    both = P.round_trip(docs, "ids", "back")
    assert both.columns == got.columns and sorted(both.collect(), key=repr) == sorted(got.collect(), key=repr)
    assert P.round_trip(docs.limit(0)).count() == 0


def test_query(spark, sf_dir, library):
    got = {r.doc_id: r for r in entry.queries()["op2_sentencepiece"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        assert got[r.doc_id].round_trip and got[r.doc_id].n_pieces == len(library.encode(r.text))
