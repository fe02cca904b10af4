import numpy as np
from quillspark.llm import quality_gam as G


def good(i):
    r = np.random.default_rng(i)
    return " ".join("".join(r.choice(list("abcdefghij"), r.integers(2, 9))) for _ in range(r.integers(60, 200)))


def bad(i):
    return [good(i).upper().replace(" ", "!! "), " ".join(["again"] * 150), good(i).replace(" ", "### ")][i % 3]


def test_held_out_accuracy_and_no_leak(spark):
    rows = [(i, good(i) if i % 2 else bad(i)) for i in range(400)] + [(1000, None), (1001, ""), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(5, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in G.query(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    test = [i for i in range(400) if got[i].held_out]
    assert 60 < len(test) < 140
    assert np.mean([got[i].predicted == i % 2 for i in test]) > 0.95
    # labels of held-out rows change nothing
    flipped = labels.withColumn("quality", __import__("pyspark").sql.functions.expr("case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end"))
    again = {r.doc_id: r.score for r in G.query(docs, flipped).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-12 for i in got)


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in G.query(docs, none).collect()] == [0.5]
    assert G.query(docs.limit(0), none).count() == 0


def test_lookup_sum_is_the_score():
    x = np.random.default_rng(0).random((500, len(G.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = G.fit(x, y)
    assert m.pairs and ((m.score(x) > 0.5) == y).mean() > 0.9
    b = m.bins(x[:1])[0]
    margin = m.base + sum(t[b[k]] for k, t in enumerate(m.tables)) + sum(t[b[i], b[j]] for i, j, t in m.pairs)
    assert np.isclose(m.score(x[:1])[0], 1 / (1 + np.exp(-margin)))


def test_repeated_rows_count_once(spark):
    rows = [(i, good(i) if i % 2 else bad(i)) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    once = G.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    often = G.train(spark.createDataFrame(rows + [rows[3]] * 500, "doc_id long, text string"), labels)
    assert once.base == often.base and all((a == b).all() for a, b in zip(once.tables, often.tables))
