"""Language identification by segmentation-marginalised unigrams.

A run is a maximal sequence of letters, lower-cased, with the vocabulary's word mark before it (runs of more than RUN letters are cut
into runs of RUN; case is folded within stretches free of ASCII other than letters). Each language has a probability for every letter piece of a fixed public vocabulary; a run's probability in a language is
the sum, over all its segmentations into pieces, of the products of their probabilities, which a forward pass over its letters gives.
A letter that is no piece of the vocabulary counts as one unknown piece. A text's log-probability is the sum over its runs, the prediction
the likeliest language (of equals the first by name), ``score`` its posterior with even priors.

The probabilities are learned from all labelled rows that are not held out, by ROUNDS of expectation maximisation: forward and backward
passes give the expected uses of each piece over all segmentations (in round one all pieces are alike), Spark sums them by language and piece, and
they are smoothed towards their mean over languages and mixed with FLOOR of an even share. The model has a number for each piece and language:
that is what the driver gathers (at most MAX_LANGUAGES languages, else a ValueError), whatever the number of documents.

Texts are read once a round and once for scoring and never shuffled. Each distinct stretch of a task is segmented once for as long as a bounded
table of known ones holds it; they are told apart by 64-bit hashes. A text that is null or holds no letter is ``und`` with score 0; so is every text if no language
could be learned. A null id is neither learned from nor held out. Repeated rows count as often as they stand there. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import tidied, tune

MARK = "▁"
RUN = 64
ROUNDS = 2
FLOOR, SMOOTHING = 0.01, 1000.0
MAX_LANGUAGES = 500
#: Counts of distinct runs by language that a task holds before it segments the runs, and bytes of known runs' scores that it keeps.
COUNTED, KNOWN_BYTES = 1 << 20, 32 << 20
#: Cells of forward tables handled at once.
CELLS = 1 << 17
#: Probabilities of a run are kept times SCALE for each letter, so that none of RUN letters leaves a double's range.
SCALE = 1e3
UNDETERMINED = "und"

_IN_RUN = np.zeros(256, dtype=bool)
_IN_RUN[65:91] = _IN_RUN[97:123] = _IN_RUN[128:] = True
_U = np.uint64


class Tokens(K.Words):
    """Stretches of ASCII letters and non-ASCII characters, whatever those are."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = _IN_RUN[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        self.starts = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)


def stretches(column: pa.Array) -> Iterator[tuple[Tokens, int]]:
    """Tokens of about a megabyte of the column's texts, and the row that they begin with. A longer text is cut between tokens."""
    data, offsets = K.buffers(column)
    for i, j in K.slices(offsets):
        at, end = int(offsets[i]), int(offsets[j])
        while j == i + 1 and end - at > K.SLICE_BYTES:
            gaps = np.flatnonzero(~_IN_RUN[data[at : at + K.SLICE_BYTES]])
            cut = at + int(gaps[-1]) + 1 if len(gaps) else at
            for k in range(at + K.SLICE_BYTES, end, K.SLICE_BYTES):  # a token longer than a slice
                if cut > at:
                    break
                gaps = np.flatnonzero(~_IN_RUN[data[k : min(k + K.SLICE_BYTES, end)]])
                cut = k + int(gaps[0]) + 1 if len(gaps) else at
            if cut == at:
                break
            yield Tokens(data[at:cut], np.array([0, cut - at])), i
            at = cut
        yield Tokens(data[at:end], np.concatenate([[0], offsets[i + 1 : j + 1] - at])), i


class Known:
    """Slots of the distinct tokens seen, by their 64-bit hash (A-Z and a-z alike)."""

    def __init__(self):
        self.slot: dict[int, int] = {}

    def of(self, tokens: Tokens) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """(slots of the distinct tokens, texts of those that are new, their slots in turn, number of each token among the distinct)."""
        distinct, first, which = np.unique(tokens.hashes(lower=True), return_index=True, return_inverse=True)
        slots = np.fromiter((self.slot.get(h, -1) for h in distinct.tolist()), np.int64, len(distinct))
        new = np.flatnonzero(slots < 0)
        slots[new] = np.arange(len(self.slot), len(self.slot) + len(new))
        self.slot.update(zip(distinct[new].tolist(), slots[new].tolist()))
        raw, at = tokens.data.tobytes(), first[new]
        texts = b" ".join([raw[i:j] for i, j in zip(tokens.starts[at].tolist(), tokens.ends[at].tolist())]).decode().lower().split(" ") if len(new) else []
        return slots, texts, slots[new], which


def clean(token: str) -> list[str]:
    """Runs of letters of a lower-cased token, cut to RUN."""
    if len(token) <= RUN and token.isalpha():
        return [token]
    found = "".join(c if c.isalpha() else " " for c in token).split()
    return [s[i : i + RUN] for s in found for i in range(0, len(s), RUN)]


def vocabulary(path: str) -> list[str]:
    """The letter pieces of a SentencePiece vocabulary, lower case, with or without its word mark in front."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    pieces = {model.id_to_piece(i) for i in ids}
    return sorted(p for p in pieces if p == p.lower() and (p == MARK or p.removeprefix(MARK).isalpha()))


class Pieces:
    """A trie of pieces, as hashes of its nodes in two open tables: whole arrays of substrings are looked up at once."""

    BITS = 19
    BASE = _U(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)  # number n is the unknown letter
        sizes = np.fromiter(map(len, pieces), np.int64, self.n)
        self.longest = int(sizes.max(initial=0))
        text = np.frombuffer("".join(p.ljust(self.longest) for p in pieces).encode("utf-32-le"), np.uint32).astype(_U).reshape(self.n, self.longest)
        found, of, h = [], [], np.zeros(self.n, _U)
        for i in range(self.longest):
            h = self.step(h, text[:, i])
            found.append(h[sizes > i])
            of.append(np.where(sizes == i + 1, np.arange(self.n), -1)[sizes > i])
        found, of = np.concatenate([*found, np.zeros(1, _U)]), np.concatenate([*of, [-1]])
        self.hashes = np.unique(found)  # the first is 0, no node
        self.piece = np.full(len(self.hashes), -1, np.int32)
        whole = of >= 0
        self.piece[np.searchsorted(self.hashes, found[whole])] = of[whole]
        if (self.piece >= 0).sum() < self.n:
            raise ValueError("two pieces share a hash")
        self.tables = [np.zeros(1 << self.BITS, np.int32) for _ in range(3)]
        left = np.arange(1, len(self.hashes))
        for k, t in enumerate(self.tables):
            slots = self.slot(self.hashes[left], k)
            t[slots[::-1]] = left[::-1]
            left = left[t[slots] != left]
        if len(left):
            raise ValueError("too many pieces for the tables")

    @classmethod
    def step(cls, h, ch):
        with np.errstate(over="ignore"):
            return (h ^ (ch + _U(1))) * cls.BASE + (h >> _U(29))

    def slot(self, h: np.ndarray, k: int) -> np.ndarray:
        return ((h >> _U(64 - self.BITS - 13 * k)) & _U((1 << self.BITS) - 1)).astype(np.int64)

    def nodes(self, h: np.ndarray) -> np.ndarray:
        """The node of each hash, 0 if there is none."""
        at = self.tables[0][self.slot(h, 0)]
        for k in (1, 2):
            miss = np.flatnonzero(self.hashes[at] != h)
            at[miss] = self.tables[k][self.slot(h[miss], k)]
        at[self.hashes[at] != h] = 0
        return at

    def lattice(self, words: list[str]) -> Lattice:
        """All pieces at all places of the words, each with the mark in front."""
        text = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le"), np.uint32).astype(_U)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        first = np.concatenate([[0], np.cumsum(sizes)])
        place = np.arange(len(text)) - np.repeat(first[:-1], sizes)
        room = np.repeat(sizes, sizes) - place
        live, h = np.arange(len(text)), np.zeros(len(text), _U)
        arcs: list[tuple[np.ndarray, np.ndarray]] = []
        for size in range(1, self.longest + 1):
            h = self.step(h, text[live + size - 1])
            node = self.nodes(h)
            piece = self.piece[node]
            if size == 1:
                arcs.append((live, np.where(piece < 0, self.n, piece)))
            else:
                hit = piece >= 0
                arcs.append((live[hit], piece[hit]))
            on = (node > 0) & (room[live] > size)
            live, h = live[on], h[on]
            if not len(live):
                break
        return Lattice(first, sizes, place, arcs)


class Lattice:
    """Pieces by start and length. Node k + w is the place before character k of word w; each word has a node behind its end."""

    def __init__(self, first: np.ndarray, sizes: np.ndarray, place: np.ndarray, arcs: list[tuple[np.ndarray, np.ndarray]]):
        word = np.repeat(np.arange(len(sizes)), sizes)
        self.begin = first[:-1] + np.arange(len(sizes))
        self.end = self.begin + sizes
        self.sizes, self.total = sizes, int(first[-1] + len(sizes))
        #: For each place in a word and each length: starting nodes and pieces. A start has one piece of a length at most.
        self.groups: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(int(sizes.max(initial=0)))]
        for size, (start, piece) in enumerate(arcs, 1):
            p = place[start].astype(np.uint16)
            order = np.argsort(p, kind="stable")
            start, piece, p = start[order], piece[order], p[order]
            cuts = np.searchsorted(p, np.arange(len(self.groups) + 1))
            node = start + word[start]
            for i in range(len(self.groups)):
                if cuts[i] < cuts[i + 1]:
                    self.groups[i].append((size, node[cuts[i] : cuts[i + 1]], piece[cuts[i] : cuts[i + 1]]))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """p: scaled probabilities of pieces, perhaps with a column for each language. The scaled probability of reaching each node, summed over segmentations."""
        a = np.zeros((self.total, *p.shape[1:]))
        a[self.begin] = 1.0
        for group in self.groups:
            for size, node, piece in group:
                a[node + size] += a[node] * p[piece]
        return a

    def log_probability(self, p: np.ndarray) -> np.ndarray:
        return np.log(self.forward(p)[self.end]) - np.log(SCALE) * self.sizes[:, None]

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations, the words taken ``counts`` times. p: scaled, of one language."""
        a = self.forward(p)
        b = np.zeros(self.total)
        b[self.end] = counts / a[self.end]
        pieces, uses = [], []
        for group in reversed(self.groups):
            for size, node, piece in group:
                way = p[piece] * b[node + size]
                b[node] += way
                pieces.append(piece)
                uses.append(a[node] * way)
        return np.bincount(np.concatenate(pieces), np.concatenate(uses), len(p)) if pieces else np.zeros(len(p))


def _chunks(words: list[str], columns: int) -> Iterator[np.ndarray]:
    """Numbers of words whose forward tables have about CELLS cells; short words first, so that a chunk has few places."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    cells = np.cumsum((sizes[order] + 2) * columns) // CELLS
    return iter(np.split(order, np.flatnonzero(np.diff(cells)) + 1)) if len(words) else iter(())


def scaled(pieces: list[str], p: np.ndarray) -> np.ndarray:
    """Probabilities times SCALE for each character of the piece (of an unknown one: one)."""
    by = SCALE ** np.array([*map(len, pieces), 1], np.float64)
    return p * (by[:, None] if p.ndim == 2 else by)


class Model:
    """languages (sorted), and p: a probability for each piece (the last one unknown) and language."""

    def __init__(self, pieces: list[str], languages: list[str], p: np.ndarray):
        self.pieces, self.languages, self.p = pieces, languages, p

    def column(self, language: str) -> np.ndarray:
        return self.p[:, self.languages.index(language)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _uses(rows: DataFrame, pieces: list[str], model: Model | None) -> DataFrame:
    """language, piece and expected uses under the model (none: all pieces alike). rows: language and text."""

    def run(batches):
        trie, known, texts = Pieces(pieces), Known(), []
        languages: dict[str, int] = {}
        counts = np.zeros((0, 0))
        total: dict[str, np.ndarray] = {}

        def settle() -> None:
            nonlocal known, counts
            parts = [clean(x) for x in texts]
            owner = np.repeat(np.arange(len(parts)), np.fromiter(map(len, parts), np.int64, len(parts)))
            words = [w for p in parts for w in p]
            for at, language in enumerate(list(languages)[: counts.shape[1]]):
                n = counts[owner, at]
                mine = np.flatnonzero(n)
                if not len(mine):
                    continue
                own = [words[k] for k in mine]
                p = scaled(pieces, model.column(language) if model else np.full(len(pieces) + 1, 1.0 / (len(pieces) + 1)))
                out = total.setdefault(language, np.zeros(len(pieces) + 1))
                for chunk in _chunks(own, 4):
                    out += trie.lattice([own[k] for k in chunk]).expected(p, n[mine[chunk]])
            known, counts = Known(), np.zeros((0, len(languages)))
            texts.clear()

        for b in batches:
            named = b.column(0).dictionary_encode()
            for x in named.dictionary.to_pylist():
                languages.setdefault(x, len(languages))
            row_language = np.array([languages[x] for x in named.dictionary.to_pylist()], np.int64)[named.indices.to_numpy(zero_copy_only=False)]
            for tokens, row in stretches(b.column(1)):
                slots, new, _, which = known.of(tokens)
                texts.extend(new)
                grown = np.zeros((max(len(texts), len(counts)), len(languages)))
                grown[: len(counts), : counts.shape[1]] = counts
                counts = grown
                of = np.repeat(row_language[row : row + len(tokens.counts)], tokens.counts)
                counts[slots] += np.bincount(which * len(languages) + of, minlength=len(slots) * len(languages)).reshape(len(slots), len(languages))
                if counts.size > COUNTED:
                    settle()
        settle()
        for language, uses in total.items():
            k = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(k), pa.string()), pa.array(k, pa.int32()), pa.array(uses[k])], names=["language", "piece", "uses"])

    return rows.mapInArrow(tidied(run), "language string, piece int, uses double").groupBy("language", "piece").agg(F.sum("uses").alias("uses"))


def train(docs: DataFrame, path: str, text: str = "text", label: str = "lang", key: str = "doc_id", rounds: int = ROUNDS) -> Model:
    """The model of all rows with an id and a label that are not held out."""
    tune(docs.sparkSession)
    pieces = vocabulary(path)
    rows = docs.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key))).select(F.col(label).alias("_language"), F.col(text).alias("_text")).where("_text is not null")
    model = None
    for _ in range(rounds):
        uses = _uses(rows, pieces, model).toPandas()  # pieces by languages
        languages = sorted(uses["language"].unique())
        if len(languages) > MAX_LANGUAGES:
            raise ValueError(f"{len(languages)} languages; at most {MAX_LANGUAGES}")
        p = np.zeros((len(pieces) + 1, len(languages)))
        p[uses["piece"].to_numpy(), np.searchsorted(np.array(languages, object), uses["language"].to_numpy())] = uses["uses"].to_numpy()
        if not languages:
            return Model(pieces, [], p)
        mean = p.sum(1, keepdims=True) / p.sum()
        p = (p + SMOOTHING * mean) / (p.sum(0) + SMOOTHING)
        model = Model(pieces, languages, (1 - FLOOR) * p + FLOOR / len(p))
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, lang_pred and score of every row."""
    tune(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    n = len(model.languages)
    most = max(KNOWN_BYTES // (8 * max(n, 1) + 64), 10_000)

    def run(batches):
        trie, known = Pieces(model.pieces), Known()
        p = scaled(model.pieces, model.p)
        table = np.zeros((0, n + 1))  # of each known token: log-probabilities, and its number of runs
        used = 0

        def learn(new: list[str]) -> None:
            nonlocal table, used
            parts = [clean(x) for x in new]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            words = [w for x in parts for w in x]
            found = np.zeros((len(words) + 1, n))
            for chunk in _chunks(words, n):
                found[chunk] = trie.lattice([words[k] for k in chunk]).log_probability(p)
            rows = np.zeros((len(new), n + 1))
            rows[:, n] = sizes
            some = np.flatnonzero(sizes)
            if len(some):
                rows[some, :n] = np.add.reduceat(found[:-1], (np.cumsum(sizes) - sizes)[some], axis=0)
            if used + len(new) > len(table):
                table = np.concatenate([table[:used], np.zeros((max(len(new), used), n + 1))])
            table[used : used + len(new)] = rows
            used += len(new)

        for b in batches:
            total = np.zeros((b.num_rows, n + 1))
            for tokens, row in stretches(b.column(1)) if n else ():
                if used > most:
                    known, used = Known(), 0
                slots, new, _, which = known.of(tokens)
                learn(new)
                of = row + tokens.row_of_word()
                cells = table[slots[which]]
                first = np.flatnonzero(np.diff(of, prepend=-1))
                if len(first):
                    total[of[first]] += np.add.reduceat(cells, first, axis=0)
            sure = total[:, n] > 0
            best = total[:, :n].argmax(1) if n else np.zeros(b.num_rows, np.int64)
            margin = total[:, :n] - total[np.arange(b.num_rows), best][:, None]
            score = np.where(sure, 1.0 / np.maximum(np.exp(margin).sum(1), 1.0), 0.0) if n else np.zeros(b.num_rows)
            names = np.array([*model.languages, UNDETERMINED], object)[np.where(sure, best, n)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score)], names=["_key", "lang_pred", "score"])

    out = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(tidied(run), f"_key {kind}, lang_pred string, score double")
    return out.withColumnRenamed("_key", key)


def query(docs: DataFrame, path: str) -> DataFrame:
    out = predict(docs, train(docs, path))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
