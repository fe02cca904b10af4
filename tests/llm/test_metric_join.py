import random
import re

import pytest
from quillspark.llm import metric_join as M


def shingles(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def brute(rows, k, percent):
    """Union-find over all pairs; rows of one id are one document."""
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingles(t, k)) for d, t in rows]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return sorted((d, len(s), root(d)) for d, s in sets)


def corpus(seed, n=150):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    common = " ".join(rnd.choice(vocab) for _ in range(40))
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.6:
            w = rnd.choice(rows)[1].split()
            for _ in range(rnd.randrange(0, 5)):
                if w:
                    w[rnd.randrange(len(w))] = rnd.choice(vocab)
            t = rnd.choice([" ", "\n"]).join(w)
            t = t.upper() if rnd.random() < 0.2 else t
        else:
            t = " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(0, 120)))
            t = t + " " + common if rnd.random() < 0.4 else t
        rows.append((i * 2 + 1, t))
    return rows + [(1000, ""), (1001, None), (1002, " \t"), (1003, "a b"), (1004, "A  B"), (1005, "a"), (1006, "É b c d e"), (1007, "é b c d e")]


@pytest.mark.parametrize("seed,k,percent", [(1, 4, 85), (2, 5, 80), (3, 1, 50), (4, 3, 95)])
def test_matches_brute_force(spark, seed, k, percent):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 1, "q") for d, t in rows], "doc_id long, text string, n int, comp string").repartition(4)
    assert sorted(tuple(r) for r in M.groups(docs, k, percent).collect()) == brute(rows, k, percent)


def test_cells_alone_are_exact(spark, monkeypatch):
    monkeypatch.setattr(M, "SMALL", 1)
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in M.groups(docs, 4, 85).collect()) == brute(rows, 4, 85)


@pytest.mark.parametrize("cell,size,rounds", [(10, 1 << 20, 4), (10, 1 << 20, 0), (1000, 3000, 2)])
def test_wide_cells_are_exact(spark, monkeypatch, cell, size, rounds):
    monkeypatch.setattr(M, "SMALL", 1)
    monkeypatch.setattr(M, "CELL", cell)
    monkeypatch.setattr(M, "CELL_BYTES", size)
    monkeypatch.setattr(M, "ROUNDS", rounds)
    rows = corpus(10)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in M.groups(docs, 2, 70).collect()) == brute(rows, 2, 70)


def test_near_copies_in_a_wide_cell_stay_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(M, "CELL", 100)
    rnd = random.Random(11)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(600):
        w = list(base)
        for _ in range(rnd.randrange(1, 9)):
            w[rnd.randrange(200)] = f"n{rnd.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = []
    real = M.cell_links

    def seen(cells, k, percent):
        sizes.extend(r["count"] for r in cells.groupBy("p").count().collect())
        return real(cells, k, percent)

    monkeypatch.setattr(M, "cell_links", seen)
    assert sorted(tuple(r) for r in M.groups(docs, 4, 85).collect()) == brute(rows, 4, 85)
    assert sum(sizes) < 20 * 600 and max(sizes, default=0) <= 150


def joined(sets, percent):
    import numpy as np

    cell = M._Cell(sets, percent)
    cell.join(np.arange(len(sets)), np.zeros(int(cell.code.max()) + 1, bool))
    return [cell.root(i) for i in range(len(sets))]


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_recursive_join_of_a_cell(monkeypatch, percent):
    import numpy as np

    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 60, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rnd.permutation(base)[: rnd.integers(35, 60)], rnd.integers(0, 1 << 60, rnd.integers(1, 6), dtype=np.uint64)])) for _ in range(300)]
    parent = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n) and parent[i] != parent[j]:
                low, high = sorted((parent[i], parent[j]))
                parent = [low if x == high else x for x in parent]
    for leaf in (5, 40, 10**6):
        monkeypatch.setattr(M, "LEAF", leaf)
        assert joined(sets, percent) == parent


def test_near_copies_in_one_cell_cost_about_their_number():
    import time

    import numpy as np

    rnd = np.random.default_rng(4)
    base = rnd.integers(0, 1 << 60, 300, dtype=np.uint64)
    took = []
    for n in (1000, 4000):
        sets = [np.unique(np.concatenate([rnd.permutation(base)[:290], rnd.integers(0, 1 << 60, 5, dtype=np.uint64)])) for _ in range(n)]
        start = time.process_time()
        assert set(joined(sets, 85)) == {0}
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0] + 1


def test_frequent_shingles_change_nothing(spark, monkeypatch):
    rows = corpus(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(M, "HOT_LEAST", 2)
    assert sorted(tuple(r) for r in M.groups(docs, 4, 85).collect()) == brute(rows, 4, 85)


def test_repeated_ids_and_nulls(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, a), (7, b), (5, b), (9, a)]
    docs = spark.createDataFrame([*rows, (None, a)], "doc_id long, text string")
    got = sorted((tuple(r) for r in M.groups(docs, 4, 85).collect()), key=str)
    assert got == sorted([(5, 27, 5), (5, 27, 5), (7, 27, 5), (5, 27, 5), (9, 27, 5), (None, 27, None)], key=str)


def test_keep_one(spark):
    rows = corpus(7)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, x string")
    kept = M.keep_one(docs, 4, 85)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, c in brute(rows, 4, 85) if d == c)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert M.groups(docs).count() == 0 and M.keep_one(docs).count() == 0


def test_tasks_grow_with_the_seeds(spark, monkeypatch):
    monkeypatch.setattr(M, "TASK_SEEDS", 100)
    own = lambda n: spark.range(n).selectExpr("id as x", "id as n", "array(id, id + 1, id + 2, id + 3) as _prefix")
    assert [M.seed_parts(own(n)) for n in (0, 10, 1000, 2000, 4000)] == [12, 12, 40, 80, 160]
