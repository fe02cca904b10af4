"""Benchmark decontamination by the q-gram lemma.

Texts are lower-cased (characters of one or two bytes) and runs of white space become one space. Each benchmark item is cut into
windows of at most WINDOW bytes, half overlapping; a window of m bytes allows k = floor(EDITS * m) edits. A
region of a document within k edits of a window shares at least m + 1 - q (k + 1) q-grams with it, on
diagonals at most k apart. A verbatim passage of PASSAGE bytes, cut anywhere, holds a window. So shared q-grams are counted in overlapping bands of diagonals, bands that meet
the bound are kept, and a banded alignment decides.

The benchmark is handled in blocks of about BLOCK_BYTES, each sent to all documents.

Defined results: null, empty and very short items (fewer than q bytes after normalising) match nothing; items
shorter than a window match as a whole. Verbatim passages shorter than PASSAGE are found where they hold a window. Null texts match nothing. Rows that share a doc_id give joint rows.
A null item_id or doc_id is reported as null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textkernel as K
from .common import tidied, tune

Q, WINDOW, EDITS, BAND = 7, 50, 0.1, 8
#: A verbatim passage of an item of this many bytes always holds a whole window.
PASSAGE = WINDOW + WINDOW // 2 - 1
BLOCK_BYTES = 2 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_OUTSIDE = 0xFF
#: Small letters of the characters of two bytes (Latin, Greek, Cyrillic, Armenian), where those have two bytes as well.
_FOLD_2 = np.array([ord(x) if len(x := chr(k).lower()) == 1 and 0x80 <= ord(x) < 0x800 else k for k in range(0x800)], np.int32)


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes and their row offsets."""
    folded = _FOLD[data]
    at = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
    if len(at):
        small = _FOLD_2[(data[at] & 31).astype(np.int32) << 6 | data[at + 1] & 63]
        folded[at], folded[at + 1] = 0xC0 | small >> 6, 0x80 | small & 63
    blank = folded == 32
    again = blank & np.concatenate([[False], blank[:-1]]) if len(data) else blank
    heads = offsets[:-1][offsets[:-1] < len(data)]
    again[heads] = False
    kept = np.concatenate([[0], np.cumsum(~again)])
    return folded[~again], kept[offsets]


@dataclass
class Index:
    """The windows of a block of items, and where each q-gram occurs in them."""

    items: list
    item: np.ndarray  # of each window
    text: np.ndarray  # window bytes, padded
    size: np.ndarray
    edits: np.ndarray
    needed: np.ndarray
    grams: np.ndarray
    first: np.ndarray  # occurrences of gram i: first[i]:first[i + 1]
    window: np.ndarray
    offset: np.ndarray
    slots: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple]) -> Index:
        items, item, parts = [r[0] for r in rows], [], []
        for k, (_, text) in enumerate(rows):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            folded, _ = normalised(raw, np.array([0, len(raw)]))
            folded = np.frombuffer(folded.tobytes().strip(b" "), np.uint8)
            if len(folded) < Q:
                continue
            starts = list(range(0, max(len(folded) - WINDOW, 0), WINDOW // 2)) + [max(len(folded) - WINDOW, 0)]
            for s in dict.fromkeys(starts):
                item.append(k)
                parts.append(folded[s : s + WINDOW])
        size = np.array([len(p) for p in parts], np.int64)
        text = np.full((len(parts), WINDOW), _OUTSIDE - 1, np.uint8)
        for k, p in enumerate(parts):
            text[k, : len(p)] = p
        edits = np.maximum(np.minimum((EDITS * size).astype(np.int64), size // Q - 1), 0)
        grams = [K.byte_ngrams(p, Q) for p in parts]
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        window = np.repeat(np.arange(len(parts)), [len(g) for g in grams]) if grams else np.zeros(0, np.int64)
        offset = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        distinct, first = np.unique(every[order], return_index=True)
        slots = np.zeros(1 << 20, bool)
        slots[(distinct >> np.uint64(44)).astype(np.int64)] = True
        return cls(items, np.array(item, np.int64), text, size, edits, size + 1 - Q * (edits + 1), distinct, np.append(first, len(every)), window[order], offset[order], slots)


def candidates(index: Index, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, window, band) where shared q-grams reach the bound; band b: diagonals b * BAND up to (b + 2) * BAND."""
    none = (np.zeros(0, np.int64),) * 3
    if len(data) < Q or not len(index.grams):
        return none
    h = K.byte_ngrams(data, Q)
    at = np.flatnonzero(index.slots[(h >> np.uint64(44)).astype(np.int64)] & K.window_ok(offsets, len(data), Q))
    pos = np.minimum(np.searchsorted(index.grams, h[at]), len(index.grams) - 1)
    hit = index.grams[pos] == h[at]
    at, pos = at[hit], pos[hit]
    if not len(at):
        return none
    times = index.first[pos + 1] - index.first[pos]
    inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    where = np.repeat(index.first[pos], times) + inner
    at = np.repeat(at, times)
    window = index.window[where]
    row = np.searchsorted(offsets, at, "right") - 1
    band = (at - offsets[row] - index.offset[where] + WINDOW) // BAND  # diagonals within the row, made positive
    row, window, band = np.concatenate([row, row]), np.concatenate([window, window]), np.concatenate([band, band - 1])
    n_band = int(band.max()) + 2
    key, count = np.unique((row * len(index.size) + window) * n_band + band + 1, return_counts=True)
    row_window, band = key // n_band, key % n_band - 1
    row, window = row_window // len(index.size), row_window % len(index.size)
    good = count >= np.maximum(index.needed[window], 1)
    return row[good], window[good], band[good]


def align(index: Index, data: np.ndarray, offsets: np.ndarray, row: np.ndarray, window: np.ndarray, band: np.ndarray, step: int = 2048):
    """Least edits of each candidate within its band, and where the best region ends (in the row)."""
    best, end = np.full(len(row), 1 << 14), np.zeros(len(row), np.int64)
    wide = 2 * BAND + 2 * int(index.edits.max(initial=0)) + 1
    ramp = np.arange(wide, dtype=np.int32)
    for i in range(0, len(row), step):
        r, w = row[i : i + step], window[i : i + step]
        low = band[i : i + step] * BAND - WINDOW - index.edits[w]  # first diagonal, in the row
        begin, stop = offsets[r], offsets[r + 1]
        cost = np.zeros((len(r), wide), np.int32)
        place = begin[:, None] + low[:, None] + ramp[None, :].astype(np.int64)
        for m in range(int(index.size[w].max(initial=0))):
            col = place + m
            inside = (col >= begin[:, None]) & (col < stop[:, None])
            byte = np.where(inside, data[np.clip(col, 0, len(data) - 1)], _OUTSIDE)
            change = cost + (byte != index.text[w, m][:, None])
            change[:, :-1] = np.minimum(change[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(change - ramp, axis=1) + ramp
            done = np.flatnonzero(index.size[w] == m + 1)
            if len(done):
                c = cost[done].argmin(axis=1)
                best[i + done] = cost[done, c]
                end[i + done] = low[done] + c + m + 1
    return best, end


def matches(index: Index, data: np.ndarray, offsets: np.ndarray):
    """(row, window, edits, start) of every window found in some texts."""
    data, offsets = normalised(data, offsets)
    row, window, band = candidates(index, data, offsets)
    if not len(row):
        return row, window, row, row
    edits, end = align(index, data, offsets, row, window, band)
    good = edits <= index.edits[window]
    row, window, edits, start = row[good], window[good], edits[good], np.maximum(end[good] - index.size[window[good]], 0)
    order = np.lexsort((start, edits, window, row))
    row, window, edits, start = row[order], window[order], edits[order], start[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (window[1:] != window[:-1])]) if len(row) else np.zeros(0, bool)
    return row[new], window[new], edits[new], start[new]


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """An index for each block of items. Only one block's items are gathered at a time."""
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("length(text) > 0")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for k in range(n):
        yield Index.build([tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()])


def pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows (of the item, found in the document), edits (least), start (of the first, normalised bytes)."""
    spark = docs.sparkSession
    tune(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType
    item_type = to_arrow_type(item_kind)
    schema = f"doc_id {kind}, item_id {item_kind.simpleString()}, window int, edits int, start bigint"
    out = None
    for index in blocks(benchmark):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            x = sent.value
            for b in batches:
                data, offsets = K.buffers(b.column(1))
                for i, j in K.slices(offsets):
                    row, window, edits, start = matches(x, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    if len(row):
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + i)), pa.array([x.items[k] for k in x.item[window].tolist()], item_type), pa.array(window.astype(np.int32)), pa.array(edits.astype(np.int32)), pa.array(start.astype(np.int64))], names=["doc_id", "item_id", "window", "edits", "start"])

        part = docs.select("doc_id", F.col("text").cast("string").alias("_text")).mapInArrow(tidied(run), schema)
        out = part if out is None else out.union(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id").agg(F.countDistinct("window").alias("n_windows"), F.min("edits").alias("edits"), F.min("start").alias("start"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, unchanged, without a shuffle."""
    tune(docs.sparkSession)
    at = docs.columns.index("text")
    out = docs
    for index in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for b in batches:
                data, offsets = K.buffers(b.column(at))
                for i, j in K.slices(offsets):
                    row, *_ = matches(sent.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    keep = np.ones(j - i, bool)
                    keep[row] = False
                    yield b.slice(i, j - i).filter(pa.array(keep))

        out = out.mapInArrow(tidied(run), docs.schema)
    return out
