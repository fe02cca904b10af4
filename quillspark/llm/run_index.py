"""Suffix-array dedup with a run-length index.

Candidate pieces come from :mod:`repeats`. Each partition builds a run-compressed Burrows-Wheeler transform of its
distinct pieces, laid out by their smallest document: the byte and first row of each run, and the text positions sampled at the two
ends of every run. The suffix order itself is dropped after the build, so what stays grows with the runs, not with the text.

Matching statistics are streamed from the samples, in text order. The suffix before a run's first row is the last sample of the run
before it, and the two are compared byte by byte; from one sampled position to the next, the suffix before that of
each further position is one place on and matches one byte less. Where the statistic reaches ``length``, the position is
linked to that place; positions with one string form one chain of such links, and the least
position on a chain lies in the smallest document that has the string.

Nulls are empty texts. Texts shorter than the window keep all bytes. Documents with one doc_id are never
smaller than each other, so a repeated row keeps its bytes. Bytes are removed on the input's own strings.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .block_anchors import _marks
from .common import tidied, tune
from .repeats import Finder, Pieces, Spec, identity, repeated_spans

LENGTH = 50
_END = 0xFF  # in no UTF-8 text
#: Samples whose statistics are streamed at once.
STREAM = 1 << 16


def spec(length: int) -> Spec:
    return Spec("bytes", length, max(1, length * 3 // 8), False)


def _suffix_order(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes in order, each up to its own end mark; equal ones by place. left: bytes before the end mark."""
    n = len(text)
    number = np.zeros(256, np.int64)
    number[np.unique(text)] = 1
    number = np.cumsum(number) * number  # bytes that occur, from 1; 0: the end
    number[_END] = 0
    bits = int(number.max()).bit_length() or 1
    size = max(1, (62 - int(n).bit_length()) // bits)
    code = np.concatenate([number[text], np.zeros(size, np.int64)])
    key = code[:n].copy()
    for j in range(1, size):
        key <<= bits
        key |= np.where(j < left, code[j : j + n], 0)
    rank, order = K.pair_ranks(key, np.zeros(n, np.int64))
    longest = int(left.max(initial=0))
    while size < longest:
        step = min(size, longest - size)
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = np.where(left[: n - step] > step, rank[step:] + 1, 0)
        rank, order = K.pair_ranks(rank, ahead)
        size += step
    return order


@dataclass
class RunIndex:
    """The runs of the transform: byte and first row of each, and the text positions of their first and last rows."""

    text: np.ndarray  # pieces, each with an end mark
    byte: np.ndarray
    heads: np.ndarray
    first_at: np.ndarray
    last_at: np.ndarray

    @classmethod
    def build(cls, text: np.ndarray) -> RunIndex:
        ends = np.flatnonzero(text == _END)
        left = np.repeat(ends, np.diff(np.concatenate([[-1], ends]))) - np.arange(len(text))
        order = _suffix_order(text, left)
        column = text[order - 1]  # the row of position 0 takes the last byte, an end mark
        # the first suffix of a piece has no byte before it: a run of its own
        heads = np.flatnonzero(np.concatenate([[True], (column[1:] != column[:-1]) | (column[1:] == _END)]))
        tails = np.append(heads[1:], len(text)) - 1
        return cls(text, column[heads], heads.astype(np.int32), order[heads].astype(np.int32), order[tails].astype(np.int32))

    @property
    def nbytes(self) -> int:
        """What the index holds besides the text."""
        return sum(x.nbytes for x in (self.byte, self.heads, self.first_at, self.last_at))

    def common(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common bytes of the texts at positions x and y, up to ``most``, which end marks must not be in."""
        padded = np.concatenate([self.text, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(self.text) + 1, "<u8", padded.data, strides=(1,))
        got, live = np.zeros(len(x), np.int64), np.flatnonzero(most > 0)
        while len(live):
            differ = eight[x[live] + got[live]] ^ eight[y[live] + got[live]]
            same = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3)
            got[live] += same
            live = live[(same == 8) & (got[live] < most[live])]
        return np.minimum(got, most)

    def statistics(self, length: int):
        """(positions, places): where the suffix before that of a position matches it for ``length`` bytes, streamed by position."""
        ends = np.flatnonzero(self.text == _END)
        by_place = 1 + np.argsort(self.first_at[1:], kind="stable")
        for i in range(0, len(by_place), STREAM):
            runs = by_place[i : i + STREAM]
            at, before = self.first_at[runs].astype(np.int64), self.last_at[runs - 1].astype(np.int64)
            beyond = int(self.first_at[by_place[i + STREAM]]) if i + STREAM < len(by_place) else len(self.text)
            reach = np.append(at[1:], beyond) - at  # positions that this sample answers for
            rest = np.minimum(ends[np.searchsorted(ends, at)] - at, ends[np.searchsorted(ends, before)] - before)
            size = self.common(at, before, np.minimum(rest, reach + length))
            times = np.clip(size - length + 1, 0, reach)
            step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            yield np.repeat(at, times) + step, np.repeat(before, times) + step

    def least_places(self, length: int) -> np.ndarray:
        """For each text position the least one with the same ``length`` bytes (itself where its statistic never reaches that)."""
        top = np.arange(len(self.text))
        linked = []
        for at, before in self.statistics(length):
            top[at] = before
            linked.append(at)
        if not linked:
            return top
        at = np.concatenate(linked)
        while True:  # to the first place of each chain, doubling the step
            ahead = top[top[at]]
            if (ahead == top[at]).all():
                break
            top[at] = ahead
        least = np.arange(len(self.text))
        np.minimum.at(least, top[at], at)
        return least[top]


def finder(s: Spec) -> Finder:
    def find(p: Pieces) -> list:
        out: list = [[] for _ in p.text]
        by_doc = np.argsort(p.least, kind="stable")  # a smaller position is in a smaller document
        mark = bytes([_END])
        text = np.frombuffer(mark.join(p.text[k] for k in by_doc.tolist()) + mark, np.uint8)
        sizes = np.array([len(p.text[k]) for k in by_doc.tolist()], np.int64)
        start = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        places = RunIndex.build(text).least_places(s.length)
        windows = np.maximum(sizes - s.length + 1, 0)
        piece = np.repeat(np.arange(len(sizes)), windows)
        a = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
        low = p.least[by_doc]
        own, d = low[piece], low[np.searchsorted(start, places[start[piece] + a], "right") - 1]
        many = (p.count[by_doc] > 1)[piece]
        for which in (d < own, (d == own) & many):
            k, b, e = piece[which], a[which], d[which]
            head = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (b[1:] > b[:-1] + 1)])) if len(k) else np.zeros(0, np.int64)
            last = np.append(head[1:], len(k)) - 1 if len(k) else head
            top = np.maximum.reduceat(e, head) if len(k) else e
            for j, x, y, z in zip(by_doc[k[head]].tolist(), b[head].tolist(), b[last].tolist(), top.tolist()):
                out[j].append((x, y + s.length, z))
        return out

    return find


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with identity columns, _least (smallest id with its text) and _spans (a, b, d): bytes that document d has too."""
    s = spec(length)
    return repeated_spans(identity(docs), s, finder(s))


def _gone(ids: np.ndarray, least: np.ndarray, spans: pa.Array, at: np.ndarray, length: int) -> np.ndarray:
    """Bytes to remove: the spans that a smaller document has; all of a text that a smaller document has as a whole."""
    gone = _marks(spans, at, int(at[-1]), lambda row, d: d < ids[row])
    return gone | np.repeat((least < ids) & (np.diff(at) >= length), np.diff(at))


def query(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    tune(docs.sparkSession)

    def run(batches):
        for b in batches:
            ids, least = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 4))
            data, offsets = K.buffers(b.column(2))
            for i, j in K.slices(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                gone = _gone(ids[i:j], least[i:j], b.column(3).slice(i, j - i), at, length)
                total = np.concatenate([[0], np.cumsum(gone)])
                begins = gone & ~np.concatenate([[False], gone[:-1]]) if len(gone) else gone
                heads = at[:-1][at[:-1] < len(gone)]
                begins[heads] = gone[heads]
                runs = np.concatenate([[0], np.cumsum(begins)])
                keep = part[~gone].tobytes()
                cut = at - total[at]
                sha = [hashlib.sha256(keep[x:y]).hexdigest() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(np.diff(total[at])), pa.array(np.diff(runs[at])), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return removed(docs, length).select("doc_id", "_id", "_text", "_spans", "_least").mapInArrow(tidied(run), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def strip_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text`` (same columns; null texts stay null).

    A cut that would split a UTF-8 character leaves that character's bytes out entirely.
    """
    tune(docs.sparkSession)
    columns = docs.columns
    rest = F.struct(*(F.col(f"`{c}`") for c in columns if c != "text"))
    keyed = identity(docs.select("doc_id", "text", rest.alias("_rest"), F.col("text").isNull().alias("_null")), "_rest", "_null")
    s = spec(length)
    both = repeated_spans(keyed, s, finder(s)).select("_id", "_text", "_spans", "_least", "_rest", "_null")

    def run(batches):
        for b in batches:
            ids, least = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 3))
            data, offsets = K.buffers(b.column(1))
            texts: list = []
            for i, j in K.slices(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                gone = _gone(ids[i:j], least[i:j], b.column(2).slice(i, j - i), at, length)
                keep = part[~gone].tobytes()
                cut = (at - np.concatenate([[0], np.cumsum(gone)])[at]).tolist()
                texts += [keep[x:y].decode("utf-8", "ignore") for x, y in zip(cut[:-1], cut[1:])]
            null = b.column(5).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(4), pa.array([None if z else t for t, z in zip(texts, null)], pa.string())], names=["_rest", "text"])

    out = both.mapInArrow(tidied(run), T.StructType([both.schema["_rest"], T.StructField("text", T.StringType())]))
    return out.select(*(F.col("text") if c == "text" else F.col(f"_rest.`{c}`") for c in columns))
