import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from quillspark.llm import block_anchors as A
from quillspark.llm import repeats as P
from quillspark.llm import run_index as R


def brute_words(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = {}
    for w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            count[key] = count.get(key, 0) + 1
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows, length):
    low = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            k = raw[i : i + length]
            low[k] = min(low.get(k, d), d)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            if low[raw[i : i + length]] < d:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed, n=60, vocabulary=40):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdéß日e") for _ in range(rnd.randrange(1, 7))) for _ in range(vocabulary)]
    passages = [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(20, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(0, 50)))]
        for _ in range(rnd.randrange(0, 3)):
            parts.append(rnd.choice(passages))
            parts.append(" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(0, 30))))
        rows.append((i * 3, rnd.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(1, rows[5][1]), (400, rows[5][1]), (401, rows[7][1][:-3] + "zz"), (402, None), (403, ""), (404, "w " * 500), (405, "ab " * 300), (406, "x" * 400), (407, passages[0] + " q " + passages[0])]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_both_match_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, _spans string, _fp int").repartition(3)
    assert sorted((tuple(r) for r in A.query(docs).collect()), key=str) == brute_words(rows, 35)
    assert sorted(tuple(r) for r in R.query(docs).collect()) == brute_bytes(rows, 50)


def test_other_lengths(spark):
    rows = corpus(9, 25, 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for window in (1, 2, 5, 12):
        assert sorted((tuple(r) for r in A.query(docs, window).collect()), key=str) == brute_words(rows, window)
    for length in (9, 16, 33, 64):
        assert sorted(tuple(r) for r in R.query(docs, length).collect()) == brute_bytes(rows, length)


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, "one " + text), (None, "lone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_removed) for r in A.query(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 60, 60), (1, 60, 60), (2, 61, 60), (None, 1, 0)], key=str)
    by = sorted(((r.doc_id, r.n_removed) for r in R.query(docs).collect()), key=str)
    assert by == sorted([(1, 0), (1, 0), (2, len(text)), (None, 0)], key=str)


def test_a_document_id_with_two_texts(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    docs = spark.createDataFrame([(1, a), (1, b), (2, b), (0, a[:200])], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in R.query(docs).collect())
    assert got == sorted([(0, 200, 0), (1, len(a), 200), (1, len(b), 0), (2, len(b), len(b))])


def test_strip_keeps_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "a"), (2, "é" + text + "ü", "b"), (3, None, None)], "doc_id long, text string, lang string")
    out = R.strip_repeats(docs)
    assert out.columns == docs.columns
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(1, text, "a"), (2, "éü", "b"), (3, None, None)], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert A.query(docs).count() == 0 and R.query(docs).count() == 0 and R.strip_repeats(docs).count() == 0


def test_driver_tables_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in A.query(docs).collect()), key=str) == brute_words(rows, 35)
    assert sorted(tuple(r) for r in R.query(docs).collect()) == brute_bytes(rows, 50)


def marked(pieces):
    return np.frombuffer(b"".join(p + b"\xff" for p in pieces), np.uint8)


def test_index_against_sorted_suffixes():
    rnd = random.Random(5)
    for _ in range(20):
        text = marked([bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(0, 40))) for _ in range(9)])
        raw, ends = text.tobytes(), [i for i, b in enumerate(text) if b == 255]
        upto = lambda i: min(e for e in ends if e >= i)
        order = sorted(range(len(raw)), key=lambda i: (raw[i : upto(i)], i))
        index = R.RunIndex.build(text)
        sizes = np.diff(np.append(index.heads, len(text)))
        assert np.repeat(index.byte, sizes).tolist() == [raw[i - 1] for i in order]
        assert index.first_at.tolist() == [order[h] for h in index.heads] and index.last_at.tolist() == [order[h + n - 1] for h, n in zip(index.heads, sizes)]
        for length in (1, 4, 9):
            low = {}
            for i in range(len(raw)):
                if upto(i) - i >= length:
                    low.setdefault(raw[i : i + length], i)
                    assert index.least_places(length)[i] == low[raw[i : i + length]]


def test_index_of_repetitive_text_grows_with_its_runs():
    rnd = random.Random(6)
    base = bytes(rnd.choice(b"abcdefgh ") for _ in range(2000))
    pieces = []
    for _ in range(200):
        p = bytearray(base)
        p[rnd.randrange(len(p))] = 33
        pieces.append(bytes(p))
    text = marked(pieces)
    index = R.RunIndex.build(text)
    assert len(text) > 20 * len(index.byte)
    assert index.nbytes == 13 * len(index.byte) < len(text)
    assert (index.least_places(50) < np.arange(len(text))).mean() > 0.9


def test_samples_and_anchors_decide(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(4), "doc_id long, text string")
    texts = [b"x " * 3 + b" ".join(b"w%d" % i for i in range(50)), b" ".join(b"w%d" % i for i in range(50)) + b" end"]
    piece = P.Pieces(texts, np.zeros(2, np.uint64), np.array([3, 5]), np.ones(2, np.int64))
    assert [len(x) for x in R.finder(R.spec(50))(piece)] == [0, 1] and [len(x) for x in A.finder(A.spec(35))(piece)] == [1, 1]
    monkeypatch.setattr(R.RunIndex, "statistics", lambda self, length: iter(()))
    monkeypatch.setattr(A, "anchored", lambda *a: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert [len(x) for x in R.finder(R.spec(50))(piece)] == [0, 0] and [len(x) for x in A.finder(A.spec(35))(piece)] == [0, 0]
    assert docs.count()


def test_blocks_of_one_hash(monkeypatch):
    rnd = random.Random(8)
    rows = [[rnd.randrange(3) for _ in range(rnd.randrange(0, 30))] for _ in range(12)]
    code = np.array([c for r in rows for c in r], np.int64)
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    monkeypatch.setattr(A.K, "ngrams", lambda h, k: np.ones(max(len(h) - k + 1, 0), np.uint64))
    for length in (1, 2, 3, 6):
        windows = [tuple(r[i : i + length]) for r in rows for i in range(len(r) - length + 1)]
        starts = [f + i for f, r in zip(first.tolist(), rows) for i in range(len(r) - length + 1)]
        want = [s for s, w in zip(starts, windows) if windows.count(w) > 1]
        assert A.repeated_starts(code, code.astype(np.uint64), first, np.ones(len(rows), np.int64), length).tolist() == want


def test_texts_of_one_hash_and_hot_texts(spark, monkeypatch):
    monkeypatch.setattr(P, "_content", lambda text: F.length(text).cast("bigint") % 7)
    monkeypatch.setattr(P, "PARTITION_BYTES", 4000)
    rows = corpus(12) + [(1000 + i, "hot " * 60) for i in range(80)] + [(2000 + i, None) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((tuple(r) for r in A.query(docs).collect()), key=str) == brute_words(rows, 35)
    assert sorted(tuple(r) for r in R.query(docs).collect()) == brute_bytes(rows, 50)
