import zlib
from math import log

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from quillspark.llm import language_id as L

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, lang string, score double, _key string"
PIECES = L.vocabulary(PATH)


def ways(word, p):
    """Probability of a word and expected uses of pieces, over all segmentations written out."""
    number = {x: i for i, x in enumerate(PIECES)}
    s = L.MARK + word

    def every(i):
        if i == len(s):
            yield 1.0, []
        for j in range(i + 1, len(s) + 1):
            k = number.get(s[i:j], len(PIECES) if j == i + 1 else None)
            if k is not None:
                for q, rest in every(j):
                    yield p[k] * q, [k, *rest]

    total, uses = 0.0, np.zeros(len(PIECES) + 1)
    for q, ks in every(0):
        total += q
        np.add.at(uses, ks, q)
    return total, uses / total


def test_forward_and_backward_sum_all_segmentations():
    p = np.random.default_rng(5).random(len(PIECES) + 1) / len(PIECES)
    words = ["a", "the", "éclair", "straße", "日本", "qxzjq", "thinking", "ħħʒ"]
    trie, q = L.Pieces(PIECES), L.scaled(PIECES, p)
    got = trie.lattice(words).log_probability(q[:, None])[:, 0]
    uses = trie.lattice(words).expected(q, np.arange(1.0, 9))
    want = [ways(w, p) for w in words]
    assert np.allclose(got, [log(t) for t, _ in want], rtol=1e-12)
    assert np.allclose(uses, sum(n * u for n, (_, u) in enumerate(want, 1)), rtol=1e-9, atol=1e-12)


def test_longest_runs_stay_in_range():
    trie = L.Pieces(PIECES)
    for share in (1.0, L.FLOOR / (len(PIECES) + 1)):
        q = L.scaled(PIECES, np.full((len(PIECES) + 1, 1), share))
        got = trie.lattice(["ħ" * L.RUN, "e" * L.RUN]).log_probability(q)
        assert np.isfinite(got).all()


def test_runs_of_a_text():
    column = pa.array(["The CAT's 2nd—día, x²y", None, "", "12 !?", "ab" * 40])
    found = [[] for _ in column]
    for tokens, row in L.stretches(column):
        slots, texts, new, which = L.Known().of(tokens)
        for k, w in zip(row + tokens.row_of_word(), which):
            found[k] += L.clean(texts[slots[w]])
    assert found == [["the", "cat", "s", "nd", "día", "x", "y"], [], [], [], ["ab" * 32, "ab" * 8]]


def test_long_texts_are_cut_between_tokens(monkeypatch):
    monkeypatch.setattr(L.K, "SLICE_BYTES", 100)
    texts = ["word " * 100, "x" * 1000 + " tail", "short", "", "y" * 350, "a b " * 60 + "z" * 300]
    count = {}
    for tokens, row in L.stretches(pa.array(texts)):
        for k, (i, j) in zip(row + tokens.row_of_word(), zip(tokens.starts, tokens.ends)):
            count.setdefault(int(k), []).append(tokens.data[i:j].tobytes().decode())
    assert [count.get(k, []) for k in range(len(texts))] == [t.split() for t in texts]


def brute_scores(rows):
    """The model in plain terms: rounds of expected uses over all training words, then sums of word probabilities."""
    learn = [(L_, t) for i, t, L_ in rows if i is not None and L_ is not None and t is not None and zlib.crc32(str(i).encode()) % 5]
    words = lambda t: [w for raw in t.lower().split() for w in L.clean(raw)]
    languages = sorted({a for a, t in learn if words(t)})
    p = None
    for _ in range(L.ROUNDS):
        uses = np.zeros((len(PIECES) + 1, len(languages)))
        for a, t in learn:
            for w in words(t):
                k = languages.index(a)
                uses[:, k] += ways(w, np.full(len(PIECES) + 1, 1 / (len(PIECES) + 1)) if p is None else p[:, k])[1]
        mean = uses.sum(1, keepdims=True) / uses.sum()
        p = (1 - L.FLOOR) * (uses + L.SMOOTHING * mean) / (uses.sum(0) + L.SMOOTHING) + L.FLOOR / (len(PIECES) + 1)
    out = {}
    for i, t, _ in rows:
        found = words(t or "")
        s = np.array([sum(log(ways(w, p[:, k])[0]) for w in found) for k in range(len(languages))])
        e = np.exp(s - s.max())
        out[i] = (languages[int(s.argmax())], 1 / e.sum()) if found else ("und", 0.0)
    return out


def test_against_brute_force(spark):
    rows = [(i, t, a) for i, (t, a) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("die katze und der hund", "de"), ("Dog and cat", "en"), ("und die", "de"), ("et le", "fr"), ("1 2 3", "xx"), ("über", None)] * 3)]
    df = spark.createDataFrame([(*r, 1.0, "k") for r in rows], SCHEMA).repartition(4)
    want = brute_scores(rows)
    got = L.query(df, PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["lang_pred"] == want[r["doc_id"]][0]
        assert r["score"] == pytest.approx(want[r["doc_id"]][1], rel=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_small_tables_of_known_runs_change_nothing(spark, monkeypatch):
    rows = [(i, f"{'the cat' if i % 2 else 'le chien'} {chr(97 + i % 26) * (i % 7)}", "en" if i % 2 else "fr", 0.0, "") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = L.train(df, PATH)
    want = sorted(L.predict(df, model).collect())
    monkeypatch.setattr(L, "COUNTED", 10)
    monkeypatch.setattr(L, "CELLS", 50)
    again = L.train(df, PATH)
    assert np.allclose(again.p, model.p, rtol=1e-9)
    assert [r["lang_pred"] for r in sorted(L.predict(df, again).collect())] == [r["lang_pred"] for r in want]


def test_nulls_ties_and_empty_tables(spark):
    rows = [(None, "the", "en", 0.0, ""), (1, None, "en", 0.0, ""), (2, "", None, 0.0, ""), (2, "...", "en", 0.0, ""), (3, "the " * 200_000, "en", 0.0, ""), (3, "the " * 200_000, "en", 0.0, ""), (4, "x" * 100_000, "fr", 0.0, ""), (6, "²½", "de", 0.0, "")]
    got = L.query(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["lang_pred"]) for r in got} >= {(1, "und"), (2, "und"), (3, "en"), (6, "und")}
    assert not any(r["held_out"] for r in got if r["doc_id"] is None) and all(0 <= r["score"] <= 1 for r in got)
    assert L.query(spark.createDataFrame([], SCHEMA), PATH).collect() == []
    [r] = L.query(spark.createDataFrame([(1, "no language to learn", None, 0.0, "")], SCHEMA), PATH).collect()
    assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.query(docs, PATH).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("lang_pred = lang").count() >= 0.98 * got.count() > 0
