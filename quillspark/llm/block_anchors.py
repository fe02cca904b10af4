"""Substring dedup by fixed-block anchors.

Candidate pieces come from :mod:`repeats`. The non-overlapping blocks of every piece are indexed, and every rolling
window of a block's length probes the index; a hit is checked on the words themselves. The hits of one block are
extended to both sides, a word at a time and all at once: those with equal next words stay together, and a hit that is left
alone has reached the end of its maximal repeat. Where left and right extension of a hit add up to a whole window with
another hit still beside it, that window repeats. A block has half a window (rounded up), so whatever
window repeats holds one whole indexed block of either copy.

Nulls are empty texts. Texts shorter than the window keep all their words. Rows that share a
doc_id are separate documents; a repeated row repeats all its windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkernel as K
from .common import tidied, tune
from .repeats import Finder, Pieces, Spec, identity, repeated_spans

WINDOW = 35


def spec(window: int) -> Spec:
    return Spec("words", window, max(1, window // 4 + 1), True)


def _codes(words: K.Words) -> np.ndarray:
    """A number for each word, equal for equal words only."""
    inside = np.zeros(len(words.data) + 1, np.int32)
    np.add.at(inside, words.starts, 1)
    np.add.at(inside, words.ends, -1)
    kept = words.data[np.cumsum(inside[:-1]) > 0]
    offsets = np.concatenate([[0], np.cumsum(words.ends - words.starts)]).astype(np.int64)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words.starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def anchored(code: np.ndarray, hashes: np.ndarray, first: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The hits: places where a run of ``block`` words equals an indexed block, and which (blocks numbered alike where equal).

    The index holds the blocks at multiples of ``block`` words of each row; first: the rows' first words.
    """
    n = len(code)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    probe, fits = K.ngrams(hashes, block), K.window_ok(first, n, block)
    place = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    at = np.flatnonzero(fits & (place[: len(fits)] % block == 0))
    if not len(at):
        return none
    index, which = np.unique(probe[at], return_index=True)
    holder = at[which]
    slot = np.minimum(np.searchsorted(index, probe), len(index) - 1)
    hit = np.flatnonzero(fits & (index[slot] == probe))
    group = slot[hit]
    equal = np.ones(len(hit), bool)
    for j in range(block):
        equal &= code[hit + j] == code[holder[group] + j]
    if not equal.all():  # different blocks of one hash: number them by their words
        group = np.unique(np.stack([code[hit + j] for j in range(block)], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
        indexed = np.zeros(int(group.max()) + 1, bool)
        indexed[group[np.isin(hit, at)]] = True
        hit, group = hit[indexed[group]], group[indexed[group]]
    return hit, group


def _extended(group: np.ndarray, weight: np.ndarray, code: np.ndarray, nexts: list[np.ndarray]) -> list[np.ndarray]:
    """Group of each hit after 0, 1, ... words of extension; -1 once it has none beside it. nexts: its next word's place, -1 for none."""
    level = np.where(np.bincount(group, weight)[group] > 1, group, -1) if len(group) else group
    out = [level]
    for at in nexts:
        live = np.flatnonzero((level >= 0) & (at >= 0))
        rank, _ = K.pair_ranks(level[live], code[at[live]])
        together = np.bincount(rank, weight[live])[rank] > 1 if len(live) else np.zeros(0, bool)
        level = np.full(len(group), -1, np.int64)
        level[live[together]] = rank[together]
        out.append(level)
    return out


def repeated_starts(code: np.ndarray, hashes: np.ndarray, first: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """The starts of the windows of ``length`` words that occur twice or more. count: times that each row is there."""
    block = (length + 1) // 2
    more = length - block
    hit, group = anchored(code, hashes, first, block)
    row = np.searchsorted(first, hit, "right") - 1
    begin, end, weight = first[row], first[row + 1], count[row]
    left = _extended(group, weight, code, [np.where(hit - d >= begin, hit - d, -1) for d in range(1, more + 1)])
    right = _extended(group, weight, code, [np.where(hit + block + d < end, hit + block + d, -1) for d in range(more)])
    found = np.zeros(len(code), bool)
    for d in range(more + 1):
        a, b = left[d], right[more - d]
        live = np.flatnonzero((a >= 0) & (b >= 0))
        if len(live):
            rank, _ = K.pair_ranks(a[live], b[live])
            found[hit[live[np.bincount(rank, weight[live])[rank] > 1]] - d] = True
    return np.flatnonzero(found)


def finder(s: Spec) -> Finder:
    def find(p: Pieces) -> list:
        sizes = np.array([len(x) for x in p.text], np.int64)
        words = K.Words(np.frombuffer(b"".join(p.text), np.uint8), np.concatenate([[0], np.cumsum(sizes)]))
        out: list = [[] for _ in p.text]
        start = repeated_starts(_codes(words), words.hashes(), words.first, p.count, s.length)
        piece = np.searchsorted(words.first, start, "right") - 1
        begin = start - words.first[piece]
        # maximal runs
        head = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (begin[1:] > begin[:-1] + s.length)])) if len(start) else start
        last = np.append(head[1:], len(start)) - 1 if len(start) else head
        for k, a, b in zip(piece[head].tolist(), begin[head].tolist(), begin[last].tolist()):
            out[k].append((a, b + s.length, 0))
        return out

    return find


def _marks(spans: pa.Array, sizes: np.ndarray, n: int, keep=None) -> np.ndarray:
    """Items of a batch that lie in a span of their row. sizes: first item of each row."""
    lengths = np.nan_to_num(spans.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    flat = spans.flatten()
    if not len(flat):
        return np.zeros(n, bool)
    row = np.repeat(np.arange(len(spans)), lengths)
    a, b, d = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    if keep is not None:
        good = keep(row, d)
        a, b, row = a[good], b[good], row[good]
    return K.covered(a + sizes[row], b + sizes[row], n)


def removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (doc_id, text) with identity columns, _n (rows of its text) and _spans (repeated words)."""
    s = spec(window)
    return repeated_spans(identity(docs), s, finder(s))


def query(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    tune(docs.sparkSession)

    def run(batches):
        for b in batches:
            data, offsets = K.buffers(b.column(1))
            copied = b.column(3).to_numpy(zero_copy_only=False) > 1
            for i, j in K.slices(offsets):
                words = K.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                gone = _marks(b.column(2).slice(i, j - i), words.first, len(words.starts))
                gone |= np.repeat(copied[i:j] & (words.counts >= window), words.counts)
                raw = words.data.tobytes()
                keep = np.flatnonzero(~gone)
                texts = [raw[x:y] for x, y in zip(words.starts[keep].tolist(), words.ends[keep].tolist())]
                cut = np.searchsorted(keep, words.first)
                sha = [hashlib.sha256(b" ".join(texts[x:y])).hexdigest() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
                n_gone = words.counts - np.diff(cut)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(words.counts.astype(np.int64)), pa.array(n_gone.astype(np.int64)), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return removed(docs, window).select("doc_id", "_text", "_spans", "_n").mapInArrow(tidied(run), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
