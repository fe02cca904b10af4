import random

import numpy as np
from quillspark.llm import decontamination as D


def fold(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    while "  " in t:
        t = t.replace("  ", " ")
    return t.encode()


def least_edits(window, text):
    """Edits between a window and its best place in a text, by the full table."""
    prev = [0] * (len(text) + 1)
    for i, w in enumerate(window, 1):
        cur = [i]
        for j, c in enumerate(text, 1):
            cur.append(min(prev[j - 1] + (w != c), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def brute(docs, items):
    out = set()
    for d, text in docs:
        t = fold(text)
        for i, item in items:
            f = fold(item).strip(b" ")
            if len(f) < D.Q:
                continue
            starts = list(range(0, max(len(f) - D.WINDOW, 0), D.WINDOW // 2)) + [max(len(f) - D.WINDOW, 0)]
            for s in starts:
                w = f[s : s + D.WINDOW]
                k = max(min(int(D.EDITS * len(w)), len(w) // D.Q - 1), 0)
                if least_edits(w, t) <= k:
                    out.add((d, i))
    return out


def case(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 3, 6, 20, 50])))) for i in range(12)] + [(50, None), (51, ""), (52, "short")]
    docs = []
    for d in range(50):
        t = [word() for _ in range(rnd.randrange(0, 25))]
        if rnd.random() < 0.7:
            x = list(rnd.choice(items[:12])[1])
            for _ in range(rnd.randrange(0, 1 + len(x) // 12)):
                p = rnd.randrange(len(x))
                x[p : p + 1] = rnd.choice([[], [rnd.choice("xyz")], [x[p], "q"]])
            x = "".join(x)
            t.insert(rnd.randrange(len(t) + 1), rnd.choice([x, x.upper().replace("É", "é"), x.replace(" ", "\n  ")]))
        docs.append((d, " ".join(t)))
    return docs + [(100, None), (101, ""), (102, items[4][1])], items


def test_pairs_match_the_full_table(spark):
    for seed in (1, 2):
        docs, items = case(seed)
        x = spark.createDataFrame([(d, t, "e") for d, t in docs], "doc_id long, text string, edits string")
        b = spark.createDataFrame(items, "item_id long, text string")
        got = {(r.doc_id, r.item_id) for r in D.pairs(x, b).collect()}
        want = brute(docs, items)
        assert got == want and want
        kept = D.clean(x, b)
        assert kept.columns == x.columns
        assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_blocks_change_nothing(spark, monkeypatch):
    docs, items = case(3)
    x, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted((r.doc_id, r.item_id, r.edits) for r in D.pairs(x, b).collect())
    monkeypatch.setattr(D, "BLOCK_BYTES", 300)
    assert sorted((r.doc_id, r.item_id, r.edits) for r in D.pairs(x, b).collect()) == one
    assert D.clean(x, b).count() == len(docs) - len({d for d, *_ in one})


def test_empty_tables(spark):
    x = spark.createDataFrame([(1, "some text that is long enough")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert D.pairs(x, b).count() == 0 and D.clean(x, b).count() == 1
    assert D.pairs(x.limit(0), spark.createDataFrame([(1, "some text that is long enough")], "item_id long, text string")).count() == 0


def test_filter_bound_is_the_lemma():
    index = D.Index.build([(1, "x" * 400), (2, "abcdefghijkl"), (3, "abc")])
    assert (index.needed == index.size + 1 - D.Q * (index.edits + 1)).all() and (index.needed >= 1).all()
    assert set(np.unique(index.item)) == {0, 1} and (index.edits <= D.BAND).all()


def test_passages_cut_anywhere(spark):
    """Verbatim passages at every offset of an item, held against plain string search, which knows no windows."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(rnd.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(n)) for i, n in enumerate((16, 22, 45, 90))]
    docs = [(-k, prose(60)) for k in range(1, 21)]
    for i, item in items:
        docs += [(1000 * i + p, f"{prose(9)} {item[p : p + 76]} {prose(9)}") for p in range(len(item) - 75)]
    want = {(d, i) for d, text in docs for i, item in items if any(item[p : p + 74] in text for p in range(len(item) - 73))}
    x, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert want and {(r.doc_id, r.item_id) for r in D.pairs(x, b).collect()} == want
    assert {r.doc_id for r in D.clean(x, b).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_edited_and_upper_cased_copies(spark):
    """Whole items with every tenth word replaced, or in capitals of several scripts."""
    rnd = random.Random(6)
    prose = lambda n, of: " ".join("".join(rnd.choice(of) for _ in range(rnd.randrange(3, 9))) for _ in range(n))
    items = [(i, prose(24, of)) for i, of in enumerate(["abcdefghijklmnop"] * 30 + ["aéñüçoøþ"] * 5 + ["αβγδοςω", "абвгжыя"])]
    edited = [(i, " ".join("xyzzy" if k % 10 == i % 10 else w for k, w in enumerate(item.split()))) for i, item in items[:30]]
    docs = [(i, f"{prose(9, 'qrstuv')} {text} {prose(9, 'qrstuv')}") for i, text in edited + [(i, item.upper().replace("Σ", "ς")) for i, item in items[30:]]]
    x, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.pairs(x, b).collect()} == {(i, i) for i, _ in items}


def test_folding_keeps_lengths():
    text = "ÀÉÑÜ×ßſİŸĀΩЯԱ ǅ Aa\t\n é"
    data = np.frombuffer(text.encode(), np.uint8)
    folded, offsets = D.normalised(data, np.array([0, len(data)]))
    assert folded.tobytes().decode() == "àéñü×ßſİÿāωяա ǆ aa é" and offsets[-1] == len(folded)


def test_other_key_types_and_clashing_columns(spark):
    text = "The quick brown fox jumps over the lazy dog while twelve other animals look on and wonder."
    docs = spark.createDataFrame([("d1", "before " + text + " after", 1, "x"), ("d2", None, 2, "y"), ("d1", "before " + text + " after", 1, "x")], "doc_id string, text string, window int, item_id string")
    bench = spark.createDataFrame([("b1", text, 7), (None, text, 8), ("b3", "", 9)], "item_id string, text string, doc_id int")
    got = sorted(((r.doc_id, r.item_id) for r in D.pairs(docs, bench).collect()), key=str)
    assert got == sorted([("d1", "b1"), ("d1", None)], key=str)
    assert [r.doc_id for r in D.clean(docs, bench).collect()] == ["d2"]
    long = spark.createDataFrame([("b", "word " * 60000 + text)], "item_id string, text string")
    assert {r.item_id for r in D.pairs(docs, long).collect()} == {"b"}
