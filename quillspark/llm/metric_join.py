"""N-gram Jaccard join in metric space, exact.

A document is the set of its distinct k-word shingles; the Jaccard distance between sets is a metric.
Documents with equal sets are one class. Classes first meet in the regions they may share with a
neighbour: with shingles in one global order, two sets of similarity >= t share one of their first
n - ceil(t n) + 1, so each such shingle is the seed of a region. The order puts frequent shingles last
and, before those, shingles of common words later; it is the same for all documents and decides the cost only.
A seed's region is cut wherever two consecutive set sizes differ by more than the radius allows (the distance to a
common superset or subset of both obeys the triangle inequality too).

Regions of at most SMALL members give pairs, which are counted: a pair that shares too few seeds for its sizes
cannot be linked and goes no further. The members of the larger regions, in so far as they share enough seeds with another one there, become the cell of their region's pivot, the member with the
smallest hash, so that the many seeds of one group of copies mostly lead to one cell. A cell is joined
recursively: the exact distance of all members to a pivot links those within the radius; by the triangle inequality two
members can only be linked if their distances to the pivot differ by at most the radius, so members fall into rings of
that width (the regions of the next level) and are replicated into the next ring, where the neighbours beyond the boundary are. Rings are
split around pivots of their own until they are small or no longer shrink, then joined exactly.

One task gathers no cell of more than CELL members or CELL_BYTES of text. Such a cell is narrowed by distributed rounds: its
members, in parts, are measured against PIVOTS pivots, and those linked to a pivot, or to one that shares a member with
it, get one label. Where it spares work, every member goes to the Voronoi region of its nearest pivot and, as its
neighbours may be there, to all regions whose pivot is at most twice the radius further; else the cell stays as it is and has
other pivots in the next round. What has one label is finished. What is still wide after ROUNDS rounds is joined in
blocks: members outside its largest label meet all members, those within it need not meet each other. That is exact
too, and linear for copies around a centre; many members that no label holds cost their square, in bounded tasks.

Defined results: null, empty and blank texts have no shingles and link with nothing. Rows that share a
doc_id are one document that has the links of all its rows. A null doc_id has a null component.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .common import salted_join, staged, tidied, tune, unstage, width
from .graph import components
from .repeats import _as_table, _chunks, _column

#: A shingle in at least this share of the documents comes last in the order; so do at most HOT_MOST of them.
HOT_SHARE, HOT_LEAST, HOT_MOST = 1 / 2000, 8, 500_000
#: A word that a chunk of documents holds this often counts as common; so do at most WORDS_MOST.
WORD_LEAST, WORDS_MOST = 20, 100_000
#: Regions of up to SMALL members are joined by pairs. Cells of more than CELL members are split over pivots.
#: Within a cell, parts of up to LEAF members are joined without another pivot.
SMALL, CELL, LEAF = 16, 6000, 200
#: So do cells of more than CELL_BYTES of text. They meet PIVOTS pivots at a time, for at most ROUNDS rounds.
CELL_BYTES, PIVOTS, ROUNDS = 64 << 20, 16, 4


def _sets(words: K.Words, h: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's sorted distinct shingle hashes, and the first word of one occurrence of each."""
    grams = K.ngrams(h, k)
    out = []
    for a, n in zip(words.first[:-1].tolist(), words.counts.tolist()):
        if n >= k:
            u, at = np.unique(grams[a : a + n - k + 1], return_index=True)
            out.append((u, at + a))
        else:
            out.append((K.ngrams(h[a : a + n], n) if n else grams[:0], np.full(min(n, 1), a)))
    return out


def _text_sets(t: pa.Table, k: int):
    """(first row, word hashes, sets) for slices of a table's _text."""
    data, offsets = K.buffers(_column(t, "_text"))
    for i, j in K.slices(offsets):
        words = K.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        h = words.hashes(lower=True)
        yield i, h, _sets(words, h, k)


def _top(values: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    value, count = np.unique(np.concatenate(values), return_counts=True)
    return value[count >= least].view(np.int64), count[count >= least]


def frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequent shingles; common words and the bits each is worth. From all documents, to steer the order only.

    What is rare in every chunk of documents is not reported, so at most a chunk's share of values returns.
    """

    def run(batches):
        for held in _chunks(batches):
            t = _as_table(held)
            sets, words = [], []
            for _, h, got in _text_sets(t, k):
                sets += [u for u, _ in got]
                words.append(h)
            s, n = _top(sets, HOT_LEAST)
            w, m = _top(words, WORD_LEAST)
            total = sum(map(len, words))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([s, w, [0, 0]])), pa.array(np.concatenate([n, m, [t.num_rows, total]])), pa.array(np.repeat([0, 1, 2, 3], [len(s), len(w), 1, 1]))], names=["v", "n", "kind"])

    counts = staged(docs.select("_text").mapInArrow(tidied(run), "v bigint, n bigint, kind bigint").groupBy("v", "kind").agg(F.sum("n").alias("n")), "frequent")
    total = {r.kind: r.n for r in counts.where("kind > 1").collect()}

    def most(kind: int, least: float, limit: int):
        got = counts.where((F.col("kind") == kind) & (F.col("n") >= least)).orderBy(F.desc("n"), "v").limit(limit).select("v", "n").toPandas()
        v, n = got["v"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.float64)
        order = np.argsort(v)
        return v[order], n[order]

    hot, _ = most(0, max(HOT_LEAST, total.get(2, 0) * HOT_SHARE), HOT_MOST)
    word, n = most(1, WORD_LEAST, WORDS_MOST)
    return hot, word, np.log2(max(total.get(3, 0), 1) / np.maximum(n, 1)).astype(np.int64)


def _find(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether, and where, each of x is among sorted values."""
    if not len(sorted_values):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x, at


def signatures(docs: DataFrame, k: int, percent: int, order: tuple) -> DataFrame:
    """doc_id, n (set size), s1, s2 (equal for equal sets only) and _prefix (seeds of its regions)."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        hot, word, bits = shared.value
        rare = int(bits.max(initial=0)) + 1
        for held in _chunks(batches, 4 << 20):
            t = _as_table(held)
            ids = _column(t, "doc_id")
            for i, h, sets in _text_sets(t, k):
                known, at = _find(word, h)
                worth = np.where(known, bits[at] if len(bits) else 0, rare)
                worth = np.convolve(worth, np.ones(k, np.int64))[k - 1 :] if len(h) else worth  # of the k words from each
                n, s1, s2, prefix = [], [], [], []
                for u, first in sets:
                    n.append(len(u))
                    s1.append(int(K.mix(u).sum()) if len(u) else 0)
                    s2.append(int(K.mix(u ^ np.uint64(0xA0761D6478BD642F)).sum()) if len(u) else 0)
                    want = len(u) - (percent * len(u) + 99) // 100 + 1 if len(u) else 0
                    level = worth[first] if len(u) > 1 else np.zeros(len(u), np.int64)
                    place = np.where(_find(hot, u)[0], 1 << 20, -(level >> 2))
                    prefix.append(u[np.argsort(place, kind="stable")[:want]].view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(i, len(sets)), pa.array(n, pa.int64()), pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)), lists], names=["doc_id", "n", "s1", "s2", "_prefix"])

    return docs.select("doc_id", "_text").mapInArrow(tidied(run), "doc_id bigint, n bigint, s1 bigint, s2 bigint, _prefix array<bigint>")


#: Seeds that a task sorts at most, on average (24 bytes each, a few copies).
TASK_SEEDS = 2_000_000


def seed_parts(own: DataFrame) -> int:
    """Tasks that seeds are dealt to: as many as their number asks for, those of a shuffle at least."""
    seeds = own.agg(F.sum(F.size("_prefix"))).first()[0] or 0
    return max(width(own.sparkSession), -(-seeds // TASK_SEEDS))


def regions(own: DataFrame, hot: np.ndarray, percent: int) -> DataFrame:
    """g, x, n, pos: members of the regions that can hold a linked pair, and the seed's place in theirs. own: x, n, _prefix.

    Seeds travel packed by destination. Frequent seeds keep apart: their regions are keyed by size class
    (each member in its own class and the next), so none of them is gathered in one place.
    """
    spark = own.sparkSession
    parts = seed_parts(own)
    shared = spark.sparkContext.broadcast(hot)
    step = -np.log(percent / 100) if percent < 100 else 1e-6

    def flat(t: pa.Table):
        lists = _column(t, "_prefix")
        times = lists.value_lengths().to_numpy(zero_copy_only=False)
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return (lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), *(np.repeat(_column(t, c).to_numpy(zero_copy_only=False), times) for c in ("x", "n")), place)

    def ask(batches):
        for held in _chunks(batches, 4 << 20):
            s, x, n, pos = flat(_as_table(held))
            keep = ~_find(shared.value, s)[0]
            s, x, n, pos = s[keep], x[keep], n[keep], pos[keep]
            if not len(s):
                continue
            bucket = (s >> np.uint64(40)).astype(np.int64) % parts
            order = np.argsort(bucket, kind="stable")
            bucket, s, x, n, pos = bucket[order], s[order], x[order], n[order].astype(np.int32), pos[order].astype(np.int32)
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            blobs = [s[a:b].tobytes() + x[a:b].tobytes() + n[a:b].tobytes() + pos[a:b].tobytes() for a, b in zip(cut.tolist(), np.append(cut[1:], len(s)).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int64()), pa.array(blobs, pa.binary())], names=["_bucket", "_blob"])

    def settle(batches):
        got = []
        for b in batches:
            for blob in b.column(1).to_pylist():
                m = len(blob) // 24
                got.append((np.frombuffer(blob, np.uint64, m), np.frombuffer(blob, np.int64, m, 8 * m), np.frombuffer(blob, np.int32, m, 16 * m), np.frombuffer(blob, np.int32, m, 20 * m)))
        if not got:
            return
        s, x, n, pos = (np.concatenate(v) for v in zip(*got))
        order = np.lexsort((n, s))
        s, x, n, pos = s[order], x[order], n[order].astype(np.int64), pos[order].astype(np.int64)
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (100 * n[:-1] < percent * n[1:])])
        chain = np.cumsum(new) - 1
        many = (np.bincount(chain) > 1)[chain]
        head = np.flatnonzero(new)[chain]
        g = K.mix(s ^ (n[head].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))[many].view(np.int64)
        x, n, pos = x[many], n[many], pos[many]
        for i in range(0, len(g), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(v[i : i + 50_000]) for v in (g, x, n, pos)], names=["g", "x", "n", "pos"])

    def apart(batches):
        for held in _chunks(batches, 4 << 20):
            s, x, n, pos = flat(_as_table(held))
            keep = _find(shared.value, s)[0]
            s, x, n, pos = s[keep], x[keep], n[keep], pos[keep]
            size = np.floor(np.log(np.maximum(n, 1)) / step + 1e-9).astype(np.int64)
            for more in (0, 1):
                g = K.mix(s ^ ((size + more).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(x), pa.array(n), pa.array(pos)], names=["g", "x", "n", "pos"])

    schema = "g bigint, x bigint, n bigint, pos bigint"
    return own.mapInArrow(tidied(ask), "_bucket bigint, _blob binary").repartition(parts, "_bucket").mapInArrow(tidied(settle), schema).union(own.mapInArrow(tidied(apart), schema))


def measured(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """a, b and the sizes of their sets' intersection and union, for pairs (a, b) of documents with texts (x, _text)."""
    both = pairs.join(texts.select(F.col("x").alias("a"), F.col("_text").alias("_ta")), "a").join(texts.select(F.col("x").alias("b"), F.col("_text").alias("_tb")), "b")

    def run(batches):
        for held in _chunks(batches, 2 << 20):
            t = _as_table(held)
            data, offsets = {}, {}
            for c in ("_ta", "_tb"):
                data[c], offsets[c] = K.buffers(_column(t, c))
            common, either = [], []
            for i, j in K.slices(offsets["_ta"] + offsets["_tb"]):
                sides = []
                for c in ("_ta", "_tb"):
                    words = K.Words(data[c][offsets[c][i] : offsets[c][j]], offsets[c][i : j + 1] - offsets[c][i])
                    sides.append(_sets(words, words.hashes(lower=True), k))
                for (u, _), (v, _) in zip(*sides):
                    n = len(np.intersect1d(u, v, assume_unique=True))
                    common.append(n)
                    either.append(len(u) + len(v) - n)
            yield pa.RecordBatch.from_arrays([_column(t, "a"), _column(t, "b"), pa.array(common, pa.int64()), pa.array(either, pa.int64())], names=["a", "b", "common", "either"])

    return both.select("a", "b", "_ta", "_tb").mapInArrow(tidied(run), "a bigint, b bigint, common bigint, either bigint")


def _linked(percent: int) -> Column:
    return 100 * F.col("common") >= percent * F.col("either")


def _counted(region: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of small regions that share enough seeds. region: g, x, n, pos, _m."""
    large = F.sum(F.when(F.col("_m") > SMALL, 1).otherwise(0))
    seeds = region.groupBy("x").agg(large.alias("l"), F.count_if(F.col("_m") <= SMALL).alias("s")).where("s > 0").select("x", "l")
    small = region.where(F.col("_m") <= SMALL).join(seeds, "x")
    side = lambda k: small.select("g", *[F.col(v).cast(t).alias(f"{v}{k}") for v, t in (("x", "bigint"), ("n", "int"), ("pos", "int"), ("l", "int"))])
    met = side("a").join(side("b"), "g").where("xa < xb").where((100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na")))
    shared_large = F.least("la", "lb").alias("l")
    met = met.groupBy(F.col("xa").alias("a"), F.col("xb").alias("b"), "na", "nb", shared_large).agg(F.count(F.lit(1)).alias("c"), F.min(F.col("na") - F.col("posa")).alias("ra"), F.min(F.col("nb") - F.col("posb")).alias("rb"))
    # seeds of large regions count as shared
    return _possible(met, F.col("c") + F.col("l"), F.least("ra", "rb") - 1, percent).select("a", "b").distinct()


def _possible(pairs: DataFrame, common: Column, after: Column, percent: int) -> DataFrame:
    """Pairs (na, nb) that can be linked: ``common`` seeds at most, and ``after`` the last of them as much is left of the shorter rest.

    Past the prefix that ends first in the order, a pair shares no more than is left of that set either.
    """
    rest = lambda n: F.floor((percent * F.col(n) + 99) / 100) - 1
    most = common + F.least(after, F.greatest(rest("na"), rest("nb")))
    return pairs.where(100 * most >= percent * (F.col("na") + F.col("nb") - most))


def _close(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that their whole prefixes still allow to be linked."""
    side = lambda k: own.select(F.col("x").alias(k), F.col("n").alias(f"n{k}"), F.col("_prefix").alias(f"p{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("_c", F.array_intersect("pa", "pb"))
    last = F.element_at("_c", -1)  # in the order of the prefixes
    after = F.least(F.col("na") - F.array_position("pa", last), F.col("nb") - F.array_position("pb", last))
    return _possible(both.where(F.size("_c") > 0), F.size("_c"), after, percent).select("a", "b").distinct()


class _Cell:
    """The recursive exact join of some sets; ``edges`` connect whatever links connect."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.size = np.array([len(u) for u in sets], np.int64)
        self.parent = np.arange(len(sets))
        values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        _, self.code = np.unique(values, return_inverse=True)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.width = max(1 - percent / 100, 1e-6)

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = int(self.parent[x])
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def common(self, x: int, rows: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Sizes of x's intersections with the sets of rows."""
        own = self.code[self.at[x] : self.at[x + 1]]
        mark[own] = True
        sizes = self.size[rows]
        flat = np.repeat(self.at[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        got = np.add.reduceat(mark[self.code[flat]].astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]])) if len(rows) else np.zeros(0, np.int64)
        mark[own] = False
        return got

    def linked(self, x: int, rows: np.ndarray, common: np.ndarray) -> np.ndarray:
        return 100 * common >= self.percent * (self.size[x] + self.size[rows] - common)

    def leaf(self, rows: np.ndarray, mark: np.ndarray) -> None:
        """All pairs of different components, through the lists of sets that hold each shingle or, where fewer are left, set by set."""
        sizes = self.size[rows]
        flat = np.repeat(self.at[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        code, owner = self.code[flat], np.repeat(np.arange(len(rows)), sizes)
        order = np.argsort(code, kind="stable")
        held = owner[order]
        _, first = np.unique(code[order], return_index=True)
        ends = np.append(first[1:], len(held))
        place = np.empty(len(code), np.int64)
        place[order] = np.repeat(np.arange(len(first)), ends - first)
        start = np.concatenate([[0], np.cumsum(sizes)])
        part = np.array([self.root(int(r)) for r in rows], np.int64)
        for i in range(len(rows) - 1):
            others = i + 1 + np.flatnonzero(part[i + 1 :] != part[i])
            if not len(others):
                continue
            lists = place[start[i] : start[i + 1]]
            lo, n = first[lists], ends[lists] - first[lists]
            if sizes[others].sum() < n.sum():
                both = self.common(int(rows[i]), rows[others], mark)
            else:
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                both = np.bincount(held[at], minlength=len(rows))[others]
            for j in others[self.linked(rows[i], rows[others], both)].tolist():
                if part[j] != part[i]:
                    self.link(int(rows[i]), int(rows[j]))
                    part[part == part[j]] = part[i]

    def join(self, rows: np.ndarray, mark: np.ndarray) -> None:
        """All links of rows: those of a pivot first; its linked members then meet only others near enough to it, not each other."""
        work = [rows]
        while work:
            rows = work.pop()
            if len(rows) <= LEAF:
                if len(rows) > 1:
                    self.leaf(rows, mark)
                continue
            pivot, rest = int(rows[0]), rows[1:]
            common = self.common(pivot, rest, mark)
            far = 1 - common / (self.size[pivot] + self.size[rest] - common)
            near = self.linked(pivot, rest, common)
            for j in rest[near].tolist():
                self.link(pivot, j)
            star, star_far, others, far = rest[near], far[near], rest[~near], far[~near]
            for y, d in zip(others.tolist(), far.tolist()):
                if d <= 2 * self.width + 1e-9 and self.root(y) != self.root(pivot):
                    meet = star[star_far >= d - self.width - 1e-9]
                    if len(meet) and self.linked(y, meet, self.common(y, meet, mark)).any():
                        self.link(pivot, y)
            ring = np.floor(far / self.width + 1e-9).astype(np.int64)
            parts = [others[(ring == k) | (ring == k + 1)] for k in np.unique(ring).tolist()]
            if parts and max(map(len, parts)) > 0.9 * len(rows):
                self.leaf(others, mark)
            else:
                work += parts


def cell_links(cells: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) within cells (p, x, c, _text); members of equal labels c are connected already."""

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(_column(t, "x").to_numpy(zero_copy_only=False), kind="stable")))
        ids = _column(t, "x").to_numpy(zero_copy_only=False)
        cell = _Cell([u for _, _, sets in _text_sets(t, k) for u, _ in sets], percent)
        _, first, label = np.unique(_column(t, "c").to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
        for i, j in zip(first[label].tolist(), range(len(ids))):
            cell.link(i, j)
        cell.join(np.arange(len(ids)), np.zeros(int(cell.code.max(initial=0)) + 1, bool))
        root = np.array([cell.root(i) for i in range(len(ids))], np.int64)
        off = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"a": pa.array(ids[off]), "b": pa.array(ids[root[off]])})

    return cells.groupBy("p").applyInArrow(run, "a bigint, b bigint")


def _worth(cells: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """cells (p, x) without the members that share too few seeds with every other member. Cells above CELL, or of too many shingles, stay whole."""

    def run(t: pa.Table) -> pa.Table:
        lists = _column(t, "_prefix")
        n, sizes = _column(t, "n").to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        _, code = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        owner = np.repeat(np.arange(len(n)), sizes)
        order = np.argsort(code, kind="stable")
        held, first = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code))])
        start = np.concatenate([[0], np.cumsum(sizes)])
        rest = -(-percent * n // 100) - 1
        place = (np.arange(len(code)) - np.repeat(start[:-1], sizes))[order]
        keep = np.zeros(len(n), bool)
        for i in range(len(n)):
            lists_of = code[start[i] : start[i + 1]]
            lo, times = first[lists_of], first[lists_of + 1] - first[lists_of]
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            mine, theirs = np.full(len(n), -1), np.full(len(n), -1)
            np.maximum.at(mine, held[at], np.repeat(np.arange(len(times)), times))
            np.maximum.at(theirs, held[at], place[at])
            # as in _possible
            after = np.minimum(np.minimum(n[i] - mine, n - theirs) - 1, np.maximum(rest[i], rest))
            most = np.bincount(held[at], minlength=len(n)) + after
            may = (mine >= 0) & (100 * most >= percent * (n[i] + n - most))
            may[i] = False
            keep[i] = may.any()
        return t.select(["p", "x"]).filter(pa.array(keep))

    size = cells.join(own.select("x", "n"), "x").groupBy("p").agg(F.count(F.lit(1)).alias("_m"), F.sum("n").alias("_n"))
    wide = size.where((F.col("_m") > CELL) | (F.col("_n") > CELL_BYTES // 8)).select("p")
    seeds = cells.join(wide, "p", "left_anti").join(own.select("x", "n", "_prefix"), "x").select("p", "x", "n", "_prefix")
    return seeds.groupBy("p").applyInArrow(run, "p bigint, x bigint").unionByName(cells.join(wide, "p"))


def _wide(size: DataFrame) -> DataFrame:
    return size.where((F.col("_m") > CELL) | (F.col("_s") > CELL_BYTES))


def _sized(live: DataFrame, texts: DataFrame) -> DataFrame:
    """p, _m members, _s bytes of text, _one: whether all of them have one label."""
    return live.join(texts.select("x", "_b"), "x").groupBy("p").agg(F.count(F.lit(1)).alias("_m"), F.sum("_b").alias("_s"), (F.min("c") == F.max("c")).alias("_one"))


def _shares(members: str, size: str) -> Column:
    """So many parts of half a cell at most hold that many members and bytes."""
    return F.ceil(F.greatest(2 * F.col(members) / CELL, 2 * F.col(size) / CELL_BYTES, F.lit(1))).cast("bigint")


def _merge(t: pa.Table) -> pa.Table:
    """The least label that each label (columns a, b: of connected ones) leads to, for one cell."""
    least: dict = {}

    def root(v: int) -> int:
        while least.setdefault(v, v) != v:
            v = least[v]
        return v

    for a, b in zip(t.column("a").to_pylist(), t.column("b").to_pylist()):
        a, b = root(a), root(b)
        least[max(a, b)] = min(a, b)
    names = pa.MapArray.from_arrays(pa.array([0, len(least)], pa.int32()), pa.array(list(least), pa.int64()), pa.array([root(v) for v in list(least)], pa.int64()))
    return pa.table({"p": t.column("p").slice(0, 1), "_names": names})


def _measured_pivots(wide: DataFrame, texts: DataFrame, k: int, percent: int, turn: int) -> DataFrame:
    """Members (p, x, c, _k, _salt) with the pivots q of their cell, the distances d and the pivots linked to them.

    Half of the pivots have the least distance to the pivots before, the others come from what has no label yet.
    Members meet copies of the pivots in parts of half a cell.
    """

    many = pa.list_(pa.int64())
    none = pa.schema([*((c, pa.int64()) for c in ("p", "x", "c", "_k", "_salt")), ("q", many), ("d", pa.list_(pa.float64())), ("star", many)]).empty_table()

    def run(t: pa.Table, pivots: pa.Table) -> pa.Table:
        if not t.num_rows:
            return none
        pivots = pivots.select(["pivot", "_pivot"]).rename_columns(["x", "_text"]).sort_by("x")
        q = _column(pivots, "x").to_numpy(zero_copy_only=False)
        cell = _Cell([u for part in (pivots, t) for _, _, sets in _text_sets(part.combine_chunks(), k) for u, _ in sets], percent)
        rows, mark = np.arange(len(q), len(cell.sets)), np.zeros(int(cell.code.max(initial=0)) + 1, bool)
        common = np.stack([cell.common(i, rows, mark) for i in range(len(q))], axis=1)
        either = cell.size[: len(q)] + cell.size[rows][:, None] - common
        near = 100 * common >= percent * either
        lists = lambda v, n: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(v))
        every = np.full(len(rows), len(q))
        star = lists(np.broadcast_to(q, near.shape)[near], near.sum(axis=1))
        return pa.table([*(t.column(c) for c in ("p", "x", "c", "_k", "_salt")), lists(np.tile(q, len(rows)), every), lists((1 - common / either).ravel(), every), star], names=["p", "x", "c", "_k", "_salt", "q", "d", "star"])

    first = Window.partitionBy("p").orderBy("r", F.xxhash64("x", F.lit(2 * turn)))
    other = Window.partitionBy("p").orderBy(F.col("c") != F.col("x"), F.xxhash64("x", F.lit(2 * turn + 1)))
    top = lambda w: wide.select("p", "x", "_k", F.row_number().over(w).alias("_n")).where(F.col("_n") <= PIVOTS // 2).select("p", "x", "_k")
    member = wide.withColumn("_salt", F.pmod(F.xxhash64("x", F.lit(3)), F.col("_k"))).join(texts.select("x", "_text"), "x")
    copies = top(first).union(top(other)).distinct().join(texts.select("x", "_text"), "x").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_k") - 1)))
    met = member.select("p", "x", "c", "_k", "_salt", "_text").groupBy("p", "_salt").cogroup(copies.select(F.col("p").alias("cell"), F.col("_salt").alias("part"), F.col("x").alias("pivot"), F.col("_text").alias("_pivot")).groupBy("cell", "part"))
    return met.applyInArrow(run, "p bigint, x bigint, c bigint, _k bigint, _salt bigint, q array<bigint>, d array<double>, star array<bigint>")


def _labelled(far: DataFrame, radius: float) -> DataFrame:
    """Members of the next round (p, x, c, r): labels joined through the pivots, cells split where that spares members."""
    parts = F.filter(F.arrays_zip("q", "d"), lambda v: v["d"] <= F.array_min("d") + 2 * radius + 1e-9)
    star = far.where(F.size("star") > 0).withColumn("a", F.col("star")[0])
    pairs = star.select("p", "a", F.explode("star").alias("b")).union(star.where("c <> x").select("p", "a", F.col("c").alias("b"))).distinct()
    names = pairs.groupBy("p").applyInArrow(_merge, "p bigint, _names map<bigint,bigint>")
    about = far.groupBy("p").agg(F.max("_k").alias("_k"), (2 * F.sum(F.size(parts)) <= 3 * F.count(F.lit(1))).alias("_split")).join(names, "p")
    about = about.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_k") - 1))).drop("_k")
    c = F.when(F.size("star") > 0, F.col("star")[0]).otherwise(F.col("c"))
    named = far.join(about, ["p", "_salt"]).withColumn("c", F.coalesce(F.try_element_at("_names", c), c)).withColumn("r", F.aggregate("d", F.lit(0.0), lambda s, v: s + v))
    # a region of each pivot that is not more than twice the radius further than the nearest, or the cell as it is
    to = F.when(F.col("_split"), F.transform(parts, lambda v: F.xxhash64("p", v["q"]))).otherwise(F.array("p"))
    return named.select(F.explode(to).alias("p"), "x", "c", "r")


def _blocks(wide: DataFrame, texts: DataFrame) -> DataFrame:
    """Cells (p, x, c) of bounded size in which every member outside the largest label of its cell meets all others."""
    count = wide.groupBy("p", "c").agg(F.count(F.lit(1)).alias("_n"))
    main = count.groupBy("p").agg(F.max_by("c", F.struct("_n", "c")).alias("_main"), F.sum("_n").alias("_m"))
    rows = staged(salted_join(wide.select("p", "x", "c", "_k"), main, ["p"], "_m").join(texts.select("x", "_b"), "x"), "blocks")
    others = rows.where("c <> _main").groupBy("p").agg(F.count(F.lit(1)).alias("_n"), F.sum("_b").alias("_s"), F.max("_m").alias("_m"))
    rows = salted_join(rows.drop("_m"), others.select("p", "_m", _shares("_n", "_s").alias("_o")), ["p"], "_m").where("_o is not null")
    at = lambda n, salt: F.pmod(F.xxhash64("x", F.lit(salt)), F.col(n))
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    all_of = rows.select("p", "x", "c", F.explode(upto("_o")).alias("i"), at("_k", 5).alias("j"))
    other = rows.where("c <> _main").select("p", "x", "c", at("_o", 4).alias("i"), F.explode(upto("_k")).alias("j"))
    return all_of.union(other).distinct().select(F.xxhash64("p", "i", "j").alias("p"), "x", "c")


def _narrow(cells: DataFrame, texts: DataFrame, k: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """(cells (p, x, c) of bounded members and bytes, tables of links (a, b) found on the way). Equal labels c are connected."""
    live = cells.select("p", "x", F.col("x").alias("c"), F.lit(0.0).alias("r"))
    if _wide(_sized(live, texts)).isEmpty():
        return live.select("p", "x", "c"), []
    done, edges = [], []
    for turn in range(ROUNDS + 1):
        size = _sized(live, texts).where("_m > 1 and not _one")
        sized = staged(salted_join(live, size.withColumn("_k", _shares("_m", "_s")), ["p"], "_m").where("_m is not null"), "sized")
        wide = _wide(sized)
        done.append(sized.join(wide.select("x", "p"), ["x", "p"], "left_anti").select("p", "x", "c"))
        if wide.isEmpty():
            break
        if turn == ROUNDS:
            done.append(_blocks(wide, texts))
            break
        far = staged(_measured_pivots(wide, texts, k, percent, turn), "far")
        edges.append(staged(far.select(F.explode("star").alias("a"), F.col("x").alias("b")).where("a <> b"), "edges"))
        live = staged(_labelled(far, 1 - percent / 100), "live")
        unstage(far)
    return functools.reduce(DataFrame.unionByName, done), edges


def links(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(signature of each row with its class id ``x``, links (a, b) that connect whatever is connected).

    docs: doc_id and _text. Not every pair of a connected group is listed.
    """
    order = frequent(docs, k)
    sign = staged(signatures(docs, k, percent, order), "signatures")
    classes = staged(sign.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("x")).where("x is not null"), "classes")
    # one prefix per class: the row of its smallest id
    own = sign.where("n > 0").join(classes.select("n", "s1", "s2", F.col("x").alias("doc_id")), ["n", "s1", "s2", "doc_id"]).select(F.col("doc_id").alias("x"), "n", "_prefix")
    own = staged(own, "own")
    first = staged(regions(own, order[0], percent), "region")
    size = first.groupBy("g").agg(F.count(F.lit(1)).alias("_m"), F.min(F.struct(F.xxhash64("x"), "x")).alias("_p")).where("_m > 1")
    region = staged(first.join(size.select("g", "_m", F.col("_p.x").alias("p")), "g"), "region")
    unstage(first)
    direct = staged(_close(_counted(region, percent), own, percent), "pairs")
    large = region.where(F.col("_m") > SMALL)
    every = staged(large.select("p", "x").union(large.select("p", F.col("p").alias("x"))).distinct(), "cells")
    cells = staged(_worth(every, own, percent).distinct(), "cells")
    unstage(region, every, own)
    members = direct.select(F.col("a").alias("x")).union(direct.select("b")).union(cells.select("x")).distinct()
    texts = staged(docs.select(F.col("doc_id").alias("x"), "_text", F.octet_length("_text").cast("bigint").alias("_b")).join(members.hint("shuffle_hash"), "x"), "texts")
    edges = staged(measured(direct, texts, k).where(_linked(percent)).select("a", "b"), "edges")
    narrow, found = _narrow(cells, texts, k, percent)
    inner = staged(cell_links(narrow.join(texts, "x").select("p", "x", "c", "_text"), k, percent), "edges")
    unstage(direct, cells, texts)
    inner = functools.reduce(DataFrame.union, found, inner)
    return sign.select("doc_id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"], "left"), edges.union(inner).distinct()


def groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id that links lead to."""
    tune(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    rows, edges = links(src, k, percent)
    comp = components(edges)
    # rows of one doc_id are one document: its classes are linked too
    named = staged(rows.select("doc_id", "n", F.coalesce("x", "doc_id").alias("x")), "rows")
    split = named.where("doc_id <> x").select("doc_id", "x").distinct()
    also = split.join(named.where("doc_id = x and n > 0").select("doc_id").distinct(), "doc_id")
    if not also.isEmpty():  # only where ids repeat
        comp = components(edges.union(also.select(F.col("doc_id").alias("a"), F.col("x").alias("b"))))
    out = named.join(comp.withColumnRenamed("node", "x"), "x", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "x")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the near duplicates of a document with a smaller id (columns unchanged)."""
    stay = groups(docs, k, percent).where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select("doc_id").distinct()
    held = docs.join(stay, "doc_id", "left_semi")
    return held.unionByName(docs.where("doc_id is null")).select(*docs.columns)
