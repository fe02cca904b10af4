import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from quillspark.llm import bpe_pieces as B

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    rnd = random.Random(7)
    alphabet = list(" \n\t\rab▁théß日本語😀\u0000ﬁ①Ǻxyz<0x0A>0123   eeinn...")
    out = ["", " ", "  ", "\n", "▁", "▁▁▁a", "a" * 300, " " * 70, "the " * 50, "<s> </s> <unk>", "x" * 65 + " y"]
    return out + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(150))) for _ in range(400)]


def test_encode_and_decode_match_the_library(library):
    vocab = B.pieces(MODEL)
    for t in texts():
        ids = library.encode(t)
        assert vocab.encode(t) == ids, repr(t)
        assert vocab.decode(ids) == library.decode(ids), repr(t)


def test_heap_and_steps_agree():
    vocab = B.pieces(MODEL)
    rnd = random.Random(3)
    for size in (1, 2, 5, 40):
        runs = ["▁" + "".join(rnd.choice("theandonigrs日é") for _ in range(size)) for _ in range(60)]
        assert vocab.in_step(runs) == [vocab.by_heap(r) for r in runs]


def test_tables(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(texts()[:60])] + [(1000, None, None), (1000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(B.digests(docs, MODEL).collect())
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert [tuple(r) for r in got] == sorted(want)
    back = {r.doc_id: r.text for r in B.decode(B.encode(docs, MODEL), MODEL).collect()}
    assert all(back[i] == library.decode(library.encode(t or "")) for i, t, _ in rows)
    assert B.digests(spark.createDataFrame([], docs.schema), MODEL).count() == 0


def test_a_wrong_run_is_caught():
    vocab = B.pieces(MODEL)
    with pytest.raises(ValueError):
        vocab.check(["▁the"], [[5]])
