"""Where a corpus repeats itself: candidate pieces routed by minimizer, for exact repeat finders.

A *window* is ``length`` consecutive items (bytes or words) of one text. Each window's *minimizer*
is the leftmost of its least ``k``-item hashes. Equal windows have equal minimizers, so a window that
occurs twice has a minimizer that occurs twice. Texts that are equal as a whole count once, under their
content hash. Three steps, all linear in the input:

1. ``shared_minimizers``: per text, the minimizers that occur elsewhere too. Each chunk of
   documents first settles what repeats within the chunk and asks about the rest once, so a
   minimizer has at most one question per chunk, however many documents hold it.
2. ``pieces``: the items of all windows of one shared minimizer's place. Equal pieces of a chunk are
   sent once, packed by destination; the chunk keeps the list of their places.
3. ``resolve``: pieces meet by minimizer, where an exact finder marks the windows. Its answers go
   back to the chunks, which turn them into spans of texts.

The filter only leaves out windows that occur once; every other window is judged by the finder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import partition_keys, salted_join, staged, tidied, tune, unstage, width

#: Text of a chunk, in bytes.
CHUNK_BYTES = 12 << 20
#: Text that a finder gets at once, in bytes.
FIND_BYTES = 1 << 18
#: Distinct text for each partition of the Python stages, which hold what a partition gets.
PARTITION_BYTES = 8 << 20
_NO_ID = -(1 << 63)
_SALT = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD6E8FEB86659FD93
_BACK = pow(_STEP, -1, 1 << 64)


@dataclass(frozen=True)
class Spec:
    """unit: bytes or words; length: items of a window; k: items of a minimizer."""

    unit: str
    length: int
    k: int
    same_document: bool  # do repeats within one document count?

    @property
    def span(self) -> int:
        return self.length - self.k + 1

    @property
    def least_bytes(self) -> int:
        """Bytes that a text with a window has at least."""
        return self.length if self.unit == "bytes" else 2 * self.length - 1


def _content(text: Column) -> Column:
    return F.xxhash64(text, F.length(text))


def identity(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, _id (never null), _cid and _chk (hashes of the text), _text (never null) and the columns ``more``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("_id"), _content(text).alias("_cid"), F.xxhash64(F.lit(7), text).alias("_chk"), text.alias("_text"), *more)


def classes(docs: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame, int]:
    """(docs, kinds, bytes): the classes of equal texts that have a window, and the bytes of one text each.

    kinds: _cid, its smallest _id (_least) and its number of rows (_n). Texts of one _cid but different _chk are told apart by a new _cid.
    """
    while True:
        long = docs.where(F.octet_length("_text") >= spec.least_bytes)
        found = long.groupBy("_cid").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n"), F.min("_chk").alias("_lo"), F.max("_chk").alias("_hi"), F.max(F.octet_length("_text")).alias("_b"))
        found = staged(found, "classes")
        size, clashes = found.agg(F.sum("_b"), F.count_if(F.col("_lo") != F.col("_hi"))).first()
        if not clashes:
            return docs, found.select("_cid", "_least", "_n"), size or 0
        clash = found.where("_lo <> _hi").select("_cid", F.lit(True).alias("_clash"))
        docs = docs.join(clash, "_cid", "left").withColumn("_cid", F.when(F.col("_clash"), F.xxhash64("_cid", "_chk")).otherwise(F.col("_cid"))).drop("_clash")


class Items:
    """The items of some texts: hashes of k items, and each row's first item."""

    def __init__(self, spec: Spec, data: np.ndarray, offsets: np.ndarray):
        self.spec, self.data, self.offsets = spec, data, offsets
        if spec.unit == "words":
            self.words = K.Words(data, offsets)
            self.first = self.words.first
            self.grams = K.ngrams(self.words.hashes(), spec.k)
        else:
            self.first = offsets
            self.grams = K.byte_ngrams(data, spec.k)
        self.n = int(self.first[-1])

    def minimizers(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions that are the least of a window, and their hashes. Ties are all taken."""
        w, L = self.spec.span, self.spec.length
        ok = K.window_ok(self.first, self.n, L)
        if not ok.any():
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        low = K.sliding_min(self.grams, w)[: len(ok)]
        low[~ok] = 0
        # a position is a minimizer when the largest of the minima around it is its own hash
        padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
        top = K.sliding_max(padded, w)[: len(self.grams)]
        at = np.flatnonzero((top == self.grams[: len(top)]) & (top != 0))
        return at, self.grams[at]

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1

    def windows_of(self, at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of the windows whose minimizer is the one at ``at`` (last < first: none)."""
        w, g = self.spec.span, self.grams
        begin, end = self.first[row], self.first[row + 1]
        low, high = np.maximum(at - w + 1, begin), np.minimum(at, end - self.spec.length)
        own = g[at]
        for d in range(1, w):
            q = np.maximum(at - d, 0)
            low = np.where((at - d >= begin) & (g[q] <= own), np.maximum(low, q + 1), low)
            q = np.minimum(at + d, len(g) - 1)
            high = np.where((at + d <= end - self.spec.k) & (g[q] < own), np.minimum(high, q - w), high)
        return low, high

    def span_hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.spec.unit == "words":
            value = self.words.hashes()
        else:
            value = K.mix(self.data.astype(np.uint64) + np.uint64(1))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * K.powers(_STEP, len(value)))])
        return K.mix((total[b] - total[a]) * K.powers(_BACK, len(value) + 1)[a] + (b - a).astype(np.uint64))

    def texts(self, a: np.ndarray, b: np.ndarray) -> list[bytes]:
        """The items of each span; words are joined by one space."""
        raw = self.data.tobytes()
        if self.spec.unit == "bytes":
            return [raw[x:y] for x, y in zip(a.tolist(), b.tolist())]
        s, e = self.words.starts, self.words.ends
        if len(s) > 1:  # bytes between words must be one space each, or the span is rebuilt
            plain = np.concatenate([[0], np.cumsum((s[1:] - e[:-1] != 1) | (self.data[np.minimum(e[:-1], len(self.data) - 1)] != 32))])
        else:
            plain = np.zeros(max(len(s), 1), np.int64)
        out = []
        for x, y in zip(a.tolist(), b.tolist()):
            t = raw[s[x] : e[y - 1]]
            out.append(t if plain[y - 1] == plain[x] else b" ".join(raw[p:q] for p, q in zip(s[x:y].tolist(), e[x:y].tolist())))
        return out


def _chunks(batches, limit: int = CHUNK_BYTES):
    """Batches gathered to chunks of about ``limit`` bytes."""
    held, size = [], 0
    for b in batches:
        for i in range(0, b.num_rows, 64):
            part = b.slice(i, 64)
            held.append(part)
            size += part.nbytes
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def _as_table(held: list) -> pa.Table:
    return pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str):
    c = table.column(name)
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _np(table: pa.Table, name: str) -> np.ndarray:
    return _column(table, name).to_numpy(zero_copy_only=False)


def _lists(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The values of each owner (owners sorted)."""
    head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    return owner[head], pa.ListArray.from_arrays(pa.array(np.append(head, len(owner)).astype(np.int32)), pa.array(value))


def shared_minimizers(docs: DataFrame, spec: Spec, parts: int) -> DataFrame:
    """_cid and _shared: its minimizers that occur elsewhere, for texts that have any."""
    tune(docs.sparkSession)
    keys = partition_keys(parts)

    def ask(batches):
        for held in _chunks(batches):
            t = _as_table(held)
            t = t.take(pa.array(np.unique(_np(t, "_cid"), return_index=True)[1]))
            cids = _np(t, "_cid")
            data, offsets = K.buffers(_column(t, "_text"))
            fps, rows = [], []
            for i, j in K.slices(offsets):
                x = Items(spec, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at, fp = x.minimizers()
                fps.append(fp)
                rows.append(cids[i + x.row_of(at)] if len(at) else np.zeros(0, np.int64))
            fp, owner = np.concatenate(fps), np.concatenate(rows)
            if not len(fp):
                continue
            order = np.lexsort((owner, fp))
            fp, owner = fp[order], owner[order]
            new_fp = np.concatenate([[True], fp[1:] != fp[:-1]])
            new_pair = new_fp | np.concatenate([[True], owner[1:] != owner[:-1]])
            group = np.cumsum(new_fp) - 1
            times = np.bincount(group, None if spec.same_document else new_pair)
            known = times[group] > 1
            # 0: is it anywhere else? 1: it is known to repeat; tells the others. 2: known, for this text
            first, some = np.flatnonzero(new_fp), np.flatnonzero(new_pair & known)
            kind = np.concatenate([known[first].astype(np.uint8), np.full(len(some), 2, np.uint8)])
            take = np.concatenate([first, some])
            fp, owner = fp[take], owner[take]
            bucket = keys[np.where(kind < 2, fp >> np.uint64(40), K.mix(owner.view(np.uint64)) >> np.uint64(40)).astype(np.int64) % parts]
            order = np.argsort(bucket, kind="stable")
            bucket, fp, owner, kind = bucket[order], fp[order], owner[order], kind[order]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            blobs = [fp[a:b].tobytes() + owner[a:b].tobytes() + kind[a:b].tobytes() for a, b in zip(cut.tolist(), np.append(cut[1:], len(bucket)).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int64()), pa.array(blobs, pa.binary())], names=["_bucket", "_blob"])

    def settle(batches):
        got = []
        for b in batches:
            for blob in b.column(1).to_pylist():
                n = len(blob) // 17
                got.append((np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.int64, n, 8 * n), np.frombuffer(blob, np.uint8, n, 16 * n)))
        if not got:
            return
        fp, owner, kind = (np.concatenate(x) for x in zip(*got))
        asked = kind < 2
        known_fp, known_owner = fp[~asked], owner[~asked]
        order = np.lexsort((owner[asked], fp[asked]))
        fp, owner, kind = fp[asked][order], owner[asked][order], kind[asked][order]
        if len(fp):
            new_fp = np.concatenate([[True], fp[1:] != fp[:-1]])
            new_pair = new_fp | np.concatenate([[True], owner[1:] != owner[:-1]])
            group = np.cumsum(new_fp) - 1
            yes = (kind == 0) & new_pair & ((np.bincount(group, new_pair) > 1) | (np.bincount(group, kind) > 0))[group]
            fp, owner = fp[yes], owner[yes]
        fp, owner = np.concatenate([fp, known_fp]), np.concatenate([owner, known_owner])
        bucket = keys[(K.mix(owner.view(np.uint64)) >> np.uint64(40)).astype(np.int64) % parts]
        order = np.lexsort((fp, owner, bucket))
        bucket, fp, owner = bucket[order], fp[order], owner[order]
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else bucket
        blobs = [fp[a:b].tobytes() + owner[a:b].tobytes() for a, b in zip(cut.tolist(), np.append(cut[1:], len(bucket)).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int64()), pa.array(blobs, pa.binary())], names=["_bucket", "_blob"])

    def gather(batches):
        got = []
        for b in batches:
            for blob in b.column(1).to_pylist():
                n = len(blob) // 16
                got.append((np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.int64, n, 8 * n)))
        if not got:
            return
        fp, owner = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(owner, kind="stable")
        ids, lists = _lists(owner[order], fp[order].view(np.int64))
        for i in range(0, len(ids), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 1000]), lists.slice(i, 1000)], names=["_cid", "_shared"])

    packed = "_bucket bigint, _blob binary"
    found = docs.select("_cid", "_text").mapInArrow(tidied(ask), packed).repartition(parts, "_bucket").mapInArrow(tidied(settle), packed)
    return found.repartition(parts, "_bucket").mapInArrow(tidied(gather), "_cid bigint, _shared array<bigint>")


def pieces(texts: DataFrame, spec: Spec, parts: int) -> DataFrame:
    """Packed pieces by destination, and each chunk's places (bucket -1).

    texts: _cid, _least, _n, _text, _shared.
    """
    keys = partition_keys(parts)

    def run(batches):
        for held in _chunks(batches):
            t = _as_table(held)
            cids, least, n = _np(t, "_cid"), _np(t, "_least"), _np(t, "_n")
            lists = _column(t, "_shared")
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            list_at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            data, offsets = K.buffers(_column(t, "_text"))
            cols: list = [[], [], [], [], []]
            texts: list = []
            for i, j in K.slices(offsets):
                x = Items(spec, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at, fp = x.minimizers()
                row = x.row_of(at)
                mine = flat[list_at[i] : list_at[j]]
                mine_row = np.repeat(np.arange(j - i), np.diff(list_at[i : j + 1])).astype(np.uint64)
                keep = np.isin(K.mix(fp ^ (row.astype(np.uint64) * _SALT)), K.mix(mine ^ (mine_row * _SALT)))
                at, fp, row = at[keep], fp[keep], row[keep]
                if not len(at):
                    continue
                a, b = x.windows_of(at, row)
                some = a <= b
                a, b, fp, row = a[some], b[some] + spec.length, fp[some], row[some]
                for col, v in zip(cols, (fp, x.span_hashes(a, b), i + row, a - x.first[row], np.arange(len(texts), len(texts) + len(a)))):
                    col.append(v)
                texts += x.texts(a, b)
            if not texts:
                continue
            fp, value, row, place, number = (np.concatenate(c) for c in cols)
            order = np.lexsort((number, value, fp))
            alike = (fp[order][1:] == fp[order][:-1]) & (value[order][1:] == value[order][:-1])
            for q in np.flatnonzero(alike).tolist():  # a hash is not enough
                alike[q] = texts[order[q]] == texts[order[q + 1]]
            new = np.concatenate([[True], ~alike])
            rep = np.empty(len(order), np.int64)
            rep[order] = np.cumsum(new) - 1
            head = order[new]
            count = np.bincount(rep, n[row]).astype(np.int64)
            low = np.full(len(head), np.iinfo(np.int64).max)
            np.minimum.at(low, rep, least[row])
            chunk = uuid.uuid4().hex
            out = [(-1, _pack(pa.RecordBatch.from_arrays([pa.array(rep.astype(np.int32)), pa.array(cids[row]), pa.array(place.astype(np.int32))], names=["rep", "cid", "at"])))]
            bucket = keys[(fp[head] >> np.uint64(40)).astype(np.int64) % parts]
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]]))
            for a, b in zip(cut.tolist(), np.append(cut[1:], len(order)).tolist()):
                k = order[a:b]
                out.append((int(bucket[k[0]]), _pack(pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(fp[head[k]]), pa.array(low[k]), pa.array(count[k]), pa.array([texts[q] for q in head[k].tolist()], pa.binary())], names=["rep", "fp", "least", "n", "text"]))))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([chunk] * len(out)), pa.array([x for _, x in out], pa.binary())], names=["_bucket", "_chunk", "_blob"])

    return texts.select("_cid", "_least", "_n", "_text", "_shared").mapInArrow(tidied(run), "_bucket bigint, _chunk string, _blob binary")


@dataclass
class Pieces:
    """Distinct pieces, in order of their minimizers: text, minimizer, smallest document id, number of places."""

    text: list
    fp: np.ndarray
    least: np.ndarray
    count: np.ndarray


#: Per piece, the repeats in it: (start, end, id) in items; id: of a document that also has it.
Finder = Callable[[Pieces], list]


def _found(chunks: list, tables: list, finder: Finder):
    """(chunk, packed answers) for packed pieces of one destination."""
    t = pa.concat_tables(tables)
    chunk = np.repeat(np.arange(len(tables)), [x.num_rows for x in tables])
    fp, least, n, rep = (_np(t, c) for c in ("fp", "least", "n", "rep"))
    text = t.column("text").to_pylist()
    order = np.argsort(fp, kind="stable")
    ends = np.append(np.flatnonzero(fp[order][1:] != fp[order][:-1]) + 1, len(order))
    answer: dict = {}
    start, size = 0, 0
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
        size += sum(len(text[k]) for k in order[a:b].tolist())
        if size < FIND_BYTES and b < len(order):
            continue
        mine = order[start:b]
        distinct: dict = {}
        of = np.fromiter((distinct.setdefault((f, text[k]), len(distinct)) for k, f in zip(mine.tolist(), fp[mine].tolist())), np.int64, len(mine))
        count = np.bincount(of, n[mine]).astype(np.int64)
        low = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(low, of, least[mine])
        spans = finder(Pieces([x for _, x in distinct], np.array([f for f, _ in distinct], np.uint64), low, count))
        for k, o in zip(mine.tolist(), of.tolist()):
            if spans[o]:
                answer.setdefault(int(chunk[k]), []).append((int(rep[k]), spans[o]))
        start, size = b, 0
    for c, got in answer.items():
        yield chunks[c], _pack(pa.RecordBatch.from_arrays([pa.array(np.repeat([r for r, _ in got], [len(x) for _, x in got]).astype(np.int32)), *(pa.array([v[f] for _, x in got for v in x], kind) for f, kind in enumerate((pa.int32(), pa.int32(), pa.int64())))], names=["rep", "a", "b", "d"]))


def resolve(packed: DataFrame, finder: Finder, parts: int) -> DataFrame:
    """_cid and _spans: the finder's (a, b, d) at their places in each text."""

    def find(batches):
        chunks, tables = [], []
        for batch in batches:
            for c, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                chunks.append(c)
                tables.append(_unpack(blob))
        if tables:
            got = list(_found(chunks, tables, finder))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in got], pa.string()), pa.array([x for _, x in got], pa.binary())], names=["_chunk", "_answer"])

    def place(batches):
        for batch in batches:
            for blob, answers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t, m = pa.concat_tables([_unpack(x) for x in answers]), _unpack(blob)
                rep, a, b, d = (_np(t, c) for c in ("rep", "a", "b", "d"))
                order = np.argsort(rep, kind="stable")
                rep, a, b, d = rep[order], a[order], b[order], d[order]
                where, cid, at = (_np(m, c) for c in ("rep", "cid", "at"))
                lo, hi = np.searchsorted(rep, where, "left"), np.searchsorted(rep, where, "right")
                times = hi - lo
                index = np.repeat(lo - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
                owner, shift = np.repeat(cid, times), np.repeat(at, times)
                order = np.argsort(owner, kind="stable")
                index, owner, shift = index[order], owner[order], shift[order]
                marks = pa.StructArray.from_arrays([pa.array((a[index] + shift).astype(np.int32)), pa.array((b[index] + shift).astype(np.int32)), pa.array(d[index])], names=["a", "b", "d"])
                ids, lists = _lists(owner, marks)
                for i in range(0, len(ids), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 500]), lists.slice(i, 500)], names=["_cid", "_spans"])

    found = packed.where("_bucket >= 0").repartition(parts, "_bucket").mapInArrow(tidied(find), "_chunk string, _answer binary")
    answers = found.groupBy("_chunk").agg(F.collect_list("_answer").alias("_answers"))
    both = packed.where("_bucket < 0").join(answers, "_chunk").select("_blob", "_answers")
    return both.mapInArrow(tidied(place), "_cid bigint, _spans array<struct<a:int,b:int,d:bigint>>").dropDuplicates(["_cid"])


def repeated_spans(docs: DataFrame, spec: Spec, finder: Finder) -> DataFrame:
    """``docs`` (with the columns of :func:`identity`) and _least, _n and, for the row of _least, _spans (null if none).

    Texts too short for a window, null and empty ones among them, take part in no shuffle by content.
    """
    tune(docs.sparkSession)
    docs, kinds, size = classes(docs, spec)
    parts = max(width(docs.sparkSession), -(-size // PARTITION_BYTES))
    short = F.octet_length("_text") < spec.least_bytes
    long = docs.where(~short).select("_cid", "_id", "_text")
    shared = staged(shared_minimizers(long, spec, parts).join(kinds, "_cid"), "shared")
    asked = long.join(shared.withColumnRenamed("_least", "_id").hint("shuffle_hash"), ["_cid", "_id"])
    packed = staged(pieces(asked.withColumnRenamed("_id", "_least"), spec, parts), "pieces")
    marks = staged(resolve(packed, finder, parts), "marks")
    unstage(shared, packed)
    told = kinds.join(marks, "_cid", "left").where("_n > 1 or _spans is not null")
    out = salted_join(docs, told, ["_cid"], "_n", short)
    own = F.coalesce("_least", "_id")
    return out.withColumns({"_least": own, "_n": F.coalesce("_n", F.lit(1).cast("bigint")), "_spans": F.when(F.col("_id") == own, F.col("_spans"))})
