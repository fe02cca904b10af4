"""Encoding and decoding with merge-type piece vocabularies.

Encoding keeps, for every run of symbols, an agenda of its adjacent pairs ordered by the score of
the piece they form (leftmost first among equal scores), and merges from its top until no pair
forms a piece. Runs of equal length advance together: one numpy step pops the top of each run's
agenda. Long runs use a heap. No piece holds a word mark after another character, so runs end
before a mark and are encoded once per batch whatever their number of copies.

Of each Arrow batch's new runs, those that begin with one mark and go on (the words of a text but those at the start of later lines) are also
encoded by the sentencepiece library; any difference raises. Runs behind a newline, newlines, lone marks, whole texts and decoding are
not held against it in a batch; tests do that.

Nulls are empty texts: no ids, an empty decoded text.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied, tune

MARK = "▁"
_NONE = -1
#: Runs kept between batches of one worker, and the longest run that is kept or encoded in step.
CACHE_RUNS = 200_000
LONG_RUN = 64


class Pieces:
    """A vocabulary read from a model file: pieces, scores, and the table of pairs that merge."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.hidden = {i for i in range(n) if lib.is_control(i)}
        self.unknown = lib.unk_id()
        normal = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.id_of = {self.pieces[i]: i for i in normal}
        if any(MARK in self.pieces[i].lstrip(MARK) for i in normal):
            raise ValueError("pieces with an inner word mark are not supported")
        # symbols: normal pieces by id, then characters that occur only within pieces
        self.symbol = dict(self.id_of)
        for i in normal:
            for c in self.pieces[i]:
                self.symbol.setdefault(c, n + len(self.symbol))
        self.width = max(self.symbol.values()) + 2
        self.inner = {k: c for c, k in self.symbol.items() if k >= n}
        #: code point -> symbol; characters in no piece are -2 - code point and never merge
        self.char_symbol = -2 - np.arange(0x110000, dtype=np.int64)
        for c, k in self.symbol.items():
            if len(c) == 1:
                self.char_symbol[ord(c)] = k
        pairs = {}
        for i in normal:
            p = self.pieces[i]
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = i
        self.pairs = pairs
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_keys = keys
        self.pair_ids = np.array([pairs[k] for k in keys.tolist()], dtype=np.int64)
        score = np.full(n, -np.inf)
        score[normal] = [lib.get_score(i) for i in normal]
        # an agenda's order: higher score first; equal scores share a rank
        self.rank = np.searchsorted(np.unique(-score[normal]), -score)
        # a slot table turns a pair's key into its piece without a search
        bits = max(16, int(4 * len(keys)).bit_length())
        self.bits = bits
        self._slots(bits)
        self.out = [self._shown(i) for i in range(n)]

    def _slots(self, bits: int) -> None:
        size = 1 << bits
        slot_key = np.full(size, -1, dtype=np.int64)
        slot_id = np.full(size, _NONE, dtype=np.int64)
        left = np.arange(len(self.pair_keys))
        at = self._hash(self.pair_keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = slot_key[at[left]] == -1
            cand = left[free]
            _, one = np.unique(at[cand], return_index=True)
            done = cand[one]
            slot_key[at[done]] = self.pair_keys[done]
            slot_id[at[done]] = self.pair_ids[done]
            left = np.setdiff1d(left, done, assume_unique=True)
            at[left] = (at[left] + 1) & (size - 1)
        self.slot_key, self.slot_id = slot_key, slot_id

    def _hash(self, key: np.ndarray) -> np.ndarray:
        x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols forms, or -1."""
        key = a * self.width + b
        key[(a < 0) | (b < 0)] = -2
        shape, key = key.shape, key.ravel()
        at = self._hash(key)
        out = np.full(len(key), _NONE, dtype=np.int64)
        todo = np.arange(len(key))
        for _ in range(self.probes):
            found = self.slot_key[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.slot_id[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & (len(self.slot_key) - 1)
        return out.reshape(shape)

    def _shown(self, i: int) -> bytes:
        if i in self.byte_of:
            return bytes([self.byte_of[i]])
        if i in self.hidden:
            return b""
        if i == self.unknown:
            return " ⁇ ".encode()
        return self.pieces[i].replace(MARK, " ").encode()

    # ---- encoding

    def _ids(self, symbols: list[str]) -> list[int]:
        out = []
        for s in symbols:
            i = self.id_of.get(s)
            if i is not None:
                out.append(i)
            elif self.byte_id:
                out.extend(self.byte_id[b] for b in s.encode())
            else:
                out.append(self.unknown)
        return out

    def by_heap(self, run: str) -> list[int]:
        """One run, by a heap of adjacent pairs."""
        sym = list(run)
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap: list = []

        def offer(a: int, b: int) -> None:
            i = self.id_of.get(sym[a] + sym[b])
            if i is not None:
                heapq.heappush(heap, (int(self.rank[i]), a, b, len(sym[a]) + len(sym[b]), i))

        for a in range(len(sym) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, size, i = heapq.heappop(heap)
            if sym[a] is None or sym[b] is None or len(sym[a]) + len(sym[b]) != size or after[a] != b:
                continue
            sym[a], sym[b] = self.pieces[i], None
            after[a] = after[b]
            if after[a] < len(sym):
                before[after[a]] = a
                offer(a, after[a])
            if before[a] >= 0:
                offer(before[a], a)
        return self._ids([s for s in sym if s is not None])

    def in_step(self, runs: list[str]) -> list[list[int]]:
        """Runs of one length: each step takes the best pair of every run that still has one."""
        code = np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32).reshape(len(runs), len(runs[0]))
        sym = self.char_symbol[code]
        out: list = [None] * len(runs)
        row = np.arange(len(runs))
        worst = np.int64(1 << 40)
        piece = self.merged(sym[:, :-1], sym[:, 1:])
        rank = np.where(piece >= 0, self.rank[piece], worst)

        def finish(which: np.ndarray) -> None:
            for r, s in zip(row[which].tolist(), sym[which].tolist()):
                ids: list[int] = []
                for x in s:
                    if 0 <= x < len(self.pieces):
                        ids.append(x)
                    else:
                        ids.extend(self._ids([chr(-2 - x) if x < 0 else self.inner[x]]))
                out[r] = ids

        while len(row):
            if sym.shape[1] < 2:
                finish(np.arange(len(row)))
                break
            top = rank.argmin(axis=1)
            at = np.arange(len(row))
            has = rank[at, top] < worst
            if not has.all():
                finish(np.flatnonzero(~has))
                sym, piece, rank, row, top = sym[has], piece[has], rank[has], row[has], top[has]
                at = np.arange(len(row))
                if not len(row):
                    break
            sym[at, top] = piece[at, top]
            m, w = sym.shape
            keep = np.ones((m, w), dtype=bool)
            keep[at, top + 1] = False
            sym = sym[keep].reshape(m, w - 1)
            keep = np.ones((m, w - 1), dtype=bool)
            keep[at, top] = False
            piece, rank = piece[keep].reshape(m, w - 2), rank[keep].reshape(m, w - 2)
            for col, ok in ((top - 1, top > 0), (top, top < w - 2)):
                r, c = at[ok], col[ok]
                if len(r):
                    new = self.merged(sym[r, c], sym[r, c + 1])
                    piece[r, c] = new
                    rank[r, c] = np.where(new >= 0, self.rank[new], worst)
        return out

    def encode_runs(self, runs: list[str]) -> list[list[int]]:
        out: list = [None] * len(runs)
        by_size: dict[int, list[int]] = {}
        for k, r in enumerate(runs):
            if len(r) > LONG_RUN:
                out[k] = self.by_heap(r)
            else:
                by_size.setdefault(len(r), []).append(k)
        for where in by_size.values():
            for k, ids in zip(where, self.in_step([runs[k] for k in where])):
                out[k] = ids
        return out

    _RUN = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")

    def runs(self, text: str) -> list[str]:
        """The runs of a text: spaces become marks and one mark leads the text."""
        return self._RUN.findall(MARK + text.replace(" ", MARK)) if text else []

    def check(self, runs: list[str], ids: list[list[int]]) -> None:
        """Hold runs against the library: those that start with one mark, as texts of their own."""
        mine = [k for k, r in enumerate(runs) if r[0] == MARK and len(r) > 1]
        theirs = self.library.encode([runs[k][1:] for k in mine], num_threads=1)
        for k, want in zip(mine, theirs):
            if ids[k] != want:
                raise ValueError(f"run {runs[k]!r}: {ids[k]} but the library gives {want}")

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_runs(self.runs(text)) for i in ids]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(self.out[i] for i in ids)
        if raw[:1] == b" " and ids and self.pieces[ids[0]].startswith(MARK):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_loaded: dict[str, Pieces] = {}


def pieces(model_file: str) -> Pieces:
    """The vocabulary of a file, kept until :func:`clear`."""
    if model_file not in _loaded:
        _loaded[model_file] = Pieces(model_file)
    return _loaded[model_file]


def clear() -> None:
    """Forget the vocabularies, so that an idle worker holds none."""
    _loaded.clear()


class _Runs(dict):
    """run -> (number of ids, decimal ids joined by commas, decoded bytes)."""

    def learn(self, vocab: Pieces, texts_runs: list[list[str]], verify: bool) -> None:
        new = list({r for rs in texts_runs for r in rs if r not in self})
        ids = vocab.encode_runs(new)
        if verify:
            vocab.check(new, ids)
        for r, x in zip(new, ids):
            self[r] = (len(x), ",".join(map(str, x)), b"".join([vocab.out[i] for i in x]))


def _decoded(parts: list[bytes]) -> bytes:
    raw = b"".join(parts)
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace").encode()


def _rows(model_file: str, texts: list, cache: _Runs, verify: bool):
    vocab = pieces(model_file)
    split = [vocab.runs(t or "") for t in texts]
    if len(cache) > CACHE_RUNS:
        cache.clear()
    cache.learn(vocab, split, verify)
    for rs in split:
        got = [cache[r] for r in rs]
        yield sum(g[0] for g in got), ",".join([g[1] for g in got]), _decoded([g[2] for g in got])


def _chunks(column: pa.Array, size: int = 1 << 20):
    """Row ranges of about ``size`` characters, with their texts."""
    texts, at, total = column.to_pylist(), 0, 0
    for k, t in enumerate(texts):
        total += len(t or "")
        if total >= size:
            yield at, texts[at : k + 1]
            at, total = k + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def digests(docs: DataFrame, model_file: str, verify: bool = True) -> DataFrame:
    """Per document: n_tokens, and SHA-256 of the comma-joined ids and of the decoded text."""
    tune(docs.sparkSession)

    def run(batches):
        cache = _Runs()
        for b in batches:
            for at, texts in _chunks(b.column(1)):
                n, ids, text = [], [], []
                for k, x, raw in _rows(model_file, texts, cache, verify):
                    n.append(k)
                    ids.append(hashlib.sha256(x.encode()).hexdigest())
                    text.append(hashlib.sha256(raw).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        del cache
        clear()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("_text")).mapInArrow(tidied(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, model_file: str, verify: bool = True) -> DataFrame:
    """Per document: doc_id and its ids as an array."""
    tune(docs.sparkSession)

    def run(batches):
        cache = _Runs()
        for b in batches:
            for at, texts in _chunks(b.column(1)):
                ids = [[int(i) for i in x.split(",")] if x else [] for _, x, _ in _rows(model_file, texts, cache, verify)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("_text")).mapInArrow(tidied(run), "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """The texts of ``encode``'s rows. Null ids decode to an empty text."""

    def run(batches):
        for b in batches:
            vocab = pieces(model_file)
            texts = [vocab.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidied(run), "doc_id bigint, text string")
