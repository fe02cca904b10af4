"""Whitening of embeddings through a covariance that is summed tile by tile.

Vectors become integers, x = floor(1024 * c) + 100000. A first pass gives the count and each dimension's exact sum. Then the
dimensions are cut into tiles: each batch of rows (a row block) sends one column block for each tile, as the
smallest integers that hold x less its rounded mean, shuffled by row block. The task that owns a row block centres its column blocks and multiplies
every pair of tiles (i <= j); a worker's products of one pair are added up before they leave it, then summed per tile pair by
another shuffle. The tiles make the covariance (a matrix of the vectors' width, never of the rows), which the driver decomposes.
Rows are projected where they are read. ``identity_error`` is measured on the projected rows.

Rows whose vector is null or holds null or non-finite entries are dropped; so are empty vectors and vectors of another length
than the commonest (of equally common ones the longest). Entries are limited to x within 2^61 either way. ``deviation``
is exact; it is null where it exceeds a long (from about 10^8 vectors of width 64 with a spread of 0.1 on). A
component without variance (eigenvalue below rounding) has a null ``whitened`` and takes no part in ``identity_error``, which is null if
there is no other. An empty table gives no rows; repeated rows and ids count as often as they stand there. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, tidied, tune, width

SCALE, SHIFT = 1024, 100_000
#: A tile is a sixteenth of the width, within these bounds.
TILE_LEAST, TILE_MOST = 16, 256
COMPONENTS = 8
#: Tile products kept in a worker before they are sent on.
HELD_BYTES = 64 << 20
_MOST = 1 << 62


def quantised(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, x) of the usable vectors of a batch, for each length."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    child = column.values
    values = child.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes nan
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    lengths = np.diff(offsets)
    usable = column.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]]) & (lengths > 0)
    for n in np.unique(lengths[usable]):
        rows = np.flatnonzero(usable & (lengths == n))
        c = values[offsets[rows][:, None] + np.arange(n)]
        with np.errstate(over="ignore"):
            f = np.clip(np.floor(SCALE * c), -float(_MOST // 2), float(_MOST // 2))
        yield rows, f.astype(np.int64) + SHIFT


def _exact(x: np.ndarray, most: int) -> np.ndarray:
    """x as it is, or as Python integers where sums of up to ``most`` times its largest entry could pass 64 bits."""
    return x if not x.size or int(np.abs(x).max()) * most < _MOST else x.astype(object)


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """The number of usable vectors (of the commonest length) and the exact sum of x in each dimension."""

    def run(batches):
        total: dict[int, list] = {}
        for b in batches:
            for rows, x in quantised(b.column(0)):
                t = total.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object)])
                t[0] += len(rows)
                t[1] = t[1] + np.array([int(v) for v in _exact(x, len(rows)).sum(0)], object)
        for d, (n, s) in sorted(total.items()):
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(int(v)) for v in s], pa.decimal128(38, 0))], names=["length", "dim", "n", "s"])

    parts = vectors.mapInArrow(tidied(run), "length int, dim int, n bigint, s decimal(38,0)")
    total = staged(parts.groupBy("length", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "sums")
    best = total.where("dim = 0").orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    if not best:
        return 0, []
    got = total.where(F.col("length") == best[0]["length"]).orderBy("dim").collect()  # one row a dimension
    return best[0]["n"], [int(r["s"]) for r in got]


class Centre:
    """Subtracts the mean S / n: its rounded part in integers, the rest as a double."""

    def __init__(self, n: int, total: list[int]):
        self.n, self.width = n, len(total)
        self.whole = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
        self.left = [s - n * int(m) for s, m in zip(total, self.whole)]  # within n / 2 of 0
        self.rest = np.array([r / n for r in self.left], np.float64)

    def deviation(self, x: np.ndarray) -> pa.Array:
        """The sum over dimensions of (n * x - S) ** 2, exact; null beyond a long."""
        y = x - self.whole
        most = (int(np.abs(y).max()) + 1) * self.n if y.size else 0
        if most * most * self.width < _MOST:
            d = self.n * y - np.array(self.left, np.int64)
            return pa.array((d * d).sum(1))
        d = self.n * y.astype(object) - np.array(self.left, object)
        return pa.array([v if v < 1 << 63 else None for v in map(int, (d * d).sum(1))], pa.int64())


def _small(y: np.ndarray) -> np.ndarray:
    """y in the smallest integers that hold it."""
    lo, hi = (int(y.min()), int(y.max())) if y.size else (0, 0)
    return y.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= lo and hi <= np.iinfo(t).max))


def covariance(vectors: DataFrame, centre: Centre, tile: int | None = None) -> np.ndarray:
    """The covariance (divisor n) of the usable vectors of the centre's length."""
    d, parts = centre.width, width(vectors.sparkSession)
    tile = tile or min(max(d // 16, TILE_LEAST), TILE_MOST)
    edges = [(k, min(k + tile, d)) for k in range(0, d, tile)]

    def column_blocks(batches):
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for rows, x in quantised(b.column(0)):
                if x.shape[1] != d:
                    continue
                cut = [_small(x[:, i:j] - centre.whole[i:j]) for i, j in edges]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(cut), pa.int64()), pa.array(range(len(cut)), pa.int32()), pa.array([c.dtype.str for c in cut]), pa.array([np.ascontiguousarray(c).tobytes() for c in cut], pa.binary())],
                    names=["block", "tile", "kind", "cells"],
                )
                block += 1

    def sent(held: dict[tuple[int, int], np.ndarray], origin: int) -> pa.RecordBatch:
        keys = sorted(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in keys], pa.int32()), pa.array([j for _, j in keys], pa.int32()), pa.array([origin] * len(keys), pa.int64()), pa.array([held[k].tobytes() for k in keys], pa.binary())],
            names=["i", "j", "origin", "cells"],
        )

    def products(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        now, own, origin, size = None, {}, TaskContext.get().partitionId() << 32, 0

        def multiply() -> None:
            nonlocal size
            for i in own:
                for j in own:
                    if i <= j:
                        p = own[i].T @ own[j]
                        if (i, j) in held:
                            held[i, j] += p
                        else:
                            held[i, j] = p
                            size += p.nbytes

        for b in batches:
            for block, t, kind, cells in zip(*(c.to_pylist() for c in b.columns)):
                if block != now:
                    multiply()
                    now, own = block, {}
                    if size > HELD_BYTES:
                        yield sent(held, origin)
                        held, size, origin = {}, 0, origin + 1
                i, j = edges[t]
                own[t] = np.frombuffer(cells, kind).reshape(-1, j - i).astype(np.float64) - centre.rest[i:j]
        multiply()
        if held:
            yield sent(held, origin)

    def summed(batches):
        now, total = None, None
        for b in batches:
            for i, j, _, cells in zip(*(c.to_pylist() for c in b.columns)):
                if (i, j) != now:
                    if now:
                        yield sent({now: total}, 0)
                    now, total = (i, j), np.frombuffer(cells, np.float64).copy()
                else:
                    total += np.frombuffer(cells, np.float64)
        if now:
            yield sent({now: total}, 0)

    kept = "i int, j int, origin bigint, cells binary"
    blocks = vectors.mapInArrow(tidied(column_blocks), "block bigint, tile int, kind string, cells binary")
    by_block = blocks.repartition(parts, "block").sortWithinPartitions("block", "tile")
    by_tile = by_block.mapInArrow(tidied(products), kept).repartition(parts, "i", "j").sortWithinPartitions("i", "j", "origin")
    out = np.zeros((d, d))
    for r in by_tile.mapInArrow(tidied(summed), kept).collect():  # width squared numbers
        (a, b), (x, y) = edges[r["i"]], edges[r["j"]]
        out[a:b, x:y] = np.frombuffer(r["cells"], np.float64).reshape(b - a, y - x)
        out[x:y, a:b] = out[a:b, x:y].T
    return out / centre.n


def components(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns), the largest entry of each vector positive. Values below rounding are 0."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    e = np.where(e > len(e) * np.finfo(float).eps * max(e[0], 0), e, 0.0)
    u = u * np.where(u[np.abs(u).argmax(0), np.arange(len(e))] < 0, -1, 1)
    return e[:most], u[:, :most]


def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS, tile: int | None = None) -> DataFrame:
    """``key``, component (from 1), n, deviation, whitened, explained, identity_error of every usable vector and component."""
    spark = embeddings.sparkSession
    tune(spark)
    rows = embeddings.select(F.col(vector).cast("array<double>").alias("_v"), F.col(key).alias("_key"))
    kind = rows.schema["_key"].dataType.simpleString()
    n, total = sums(rows.select("_v"))
    if not n:
        return spark.createDataFrame([], f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    centre = Centre(n, total)
    v = covariance(rows.select("_v"), centre, tile)
    e, u = components(v, most)
    whole = float(np.trace(v))
    flat = e <= 0
    onto = u / np.sqrt(np.where(flat, 1.0, e))

    def project(batches):
        for b in batches:
            for at, x in quantised(b.column(0)):
                if x.shape[1] == centre.width:
                    w = ((x - centre.whole).astype(np.float64) - centre.rest) @ onto
                    cells = pa.array(w.ravel(), mask=np.broadcast_to(flat, w.shape).ravel())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32()), cells)
                    yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(at)), centre.deviation(x), lists], names=["_key", "deviation", "_w"])

    done = staged(rows.mapInArrow(tidied(project), f"_key {kind}, deviation bigint, _w array<double>"), "whitened")
    live = [k for k in range(len(e)) if not flat[k]]
    pairs = [(i, j) for i in live for j in live if i <= j]
    cov = done.agg(*[F.covar_pop(F.col("_w")[i], F.col("_w")[j]) for i, j in pairs]).first() if pairs else ()
    error = max((abs(c - (i == j)) for c, (i, j) in zip(cov, pairs)), default=None)
    share = F.array(*[F.lit(float(x / whole) if whole > 0 else None).cast("double") for x in e])
    out = done.select(F.col("_key").alias(key), "deviation", F.posexplode("_w").alias("_c", "whitened"))
    return out.select(key, (F.col("_c") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", F.get(share, F.col("_c")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def query(embeddings: DataFrame) -> DataFrame:
    return whiten(embeddings)
