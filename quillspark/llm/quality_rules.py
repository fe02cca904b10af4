"""Rule bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per
failed rule. A policy is a versioned mask over those bits, so changing a policy or measuring what
each rule contributes never rereads the texts.

Nulls count as empty texts. An empty text has no words and fails ``few_words``. Extra input
columns are ignored by :func:`measure`; repeated rows give repeated ledger rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import tidied, tune

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_alpha")
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_ALPHA = _UPPER.copy()
_ALPHA[97:123] = True


def rules(c: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """name -> failing condition, in the order of their bits; a new rule is appended, never inserted."""
    return {
        "few_words": c("n_words") < 50,
        "repeated_windows": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols": 100 * c("n_symbols") > 30 * c("n_words"),
        "duplicate_lines": (c("n_lines") >= 4) & (100 * c("n_dup_lines") > 60 * c("n_lines")),
        "short_words": c("word_chars") < 2 * c("n_words"),
        "long_words": c("word_chars") > 25 * c("n_words"),
        "shouting": (c("n_alpha") >= 50) & (100 * c("n_upper") > 70 * c("n_alpha")),
    }


#: policy version -> the rules it enforces.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words", "shouting"),
}


def _counts(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def measure_rows(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of some texts (UTF-8 buffer and row offsets)."""
    rows = len(offsets) - 1
    words = K.Words(data, offsets)
    out = {"n_words": words.counts}
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    per_word = points[words.ends] - points[words.starts]
    total = np.concatenate([[0], np.cumsum(per_word)])
    out["word_chars"] = total[words.first[1:]] - total[words.first[:-1]]
    out["n_symbols"] = _counts(_SYMBOL[data], offsets)
    out["n_upper"] = _counts(_UPPER[data], offsets)
    out["n_alpha"] = _counts(_ALPHA[data], offsets)
    # 3-word windows found twice in their text
    h = words.hashes()
    grams, ok = K.ngrams(h, 3), K.window_ok(words.first, len(h), 3)
    at = np.flatnonzero(ok)
    key = K.mix(grams[at] + words.row_of_word()[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[count[back] > 1]
    inside = K.covered(twice, twice + 3, len(h))
    out["n_repeat_words"] = _counts(inside, words.first)
    # lines with a word that equal an earlier line of their text
    brk = np.flatnonzero(data == 10)
    line_start = np.union1d(offsets[:-1], brk + 1)
    line_start = line_start[line_start < len(data)]
    has_word = np.concatenate([[0], np.cumsum(K.IS_WORD[data], dtype=np.int64)])
    nxt = np.concatenate([line_start[1:], [len(data)]]).astype(np.int64)
    row = np.searchsorted(offsets, line_start, "right") - 1
    end = np.minimum(nxt, offsets[row + 1])
    end = end - ((end > line_start) & (data[np.maximum(end - 1, 0)] == 10)) if len(data) else end
    keep = has_word[end] > has_word[line_start]
    out["n_lines"] = np.bincount(row[keep], minlength=rows)
    text = data.tobytes()
    dup = np.zeros(rows, dtype=np.int64)
    seen: set = set()
    last = -1
    for r, a, b in zip(row[keep].tolist(), line_start[keep].tolist(), end[keep].tolist()):
        if r != last:
            seen, last = set(), r
        line = text[a:b]
        if line in seen:
            dup[r] += 1
        else:
            seen.add(line)
    out["n_dup_lines"] = dup
    return out


def _measured(src: DataFrame, text_col: str) -> DataFrame:
    """All columns of ``src`` and, after them, MEASURES under names that start with ``_q_``."""
    tune(src.sparkSession)
    at = src.columns.index(text_col)

    def run(batches):
        for b in batches:
            data, offsets = K.buffers(b.column(at))
            for i, j in K.slices(offsets):
                part = measure_rows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                own = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(part[m].astype(np.int64)) for m in MEASURES)], names=[*own.schema.names, *(f"_q_{m}" for m in MEASURES)])

    schema = T.StructType([*src.schema.fields, *(T.StructField(f"_q_{m}", T.LongType()) for m in MEASURES)])
    return src.mapInArrow(tidied(run), schema)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of measurements per input row: the id and MEASURES."""
    src = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return _measured(src, "_text").select(id_col, *(F.col(f"_q_{m}").alias(m) for m in MEASURES))


def failed_bits(c: Callable[[str], Column] = F.col) -> Column:
    """One number for each document: bit i is set when rule i fails."""
    bits = F.lit(0).cast("bigint")
    for i, condition in enumerate(rules(c).values()):
        bits = bits.bitwiseOR(F.when(F.coalesce(condition, F.lit(True)), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return bits


def ledger(measured: DataFrame) -> DataFrame:
    """Adds ``failed``, the rules' bits, to the measurements."""
    return measured.withColumn("failed", failed_bits())


def mask(policy: str) -> int:
    names = list(rules())
    return sum(1 << names.index(r) for r in POLICIES[policy])


def violates(policy: str, bits: str = "failed") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy)).cast("bigint")) != 0


def ablation(book: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: documents it fails, those that only it fails, and those kept without it."""
    m = mask(policy)
    masked = book.select(F.col("failed").bitwiseAND(F.lit(m).cast("bigint")).alias("f"))
    counts = masked.groupBy("f").count()  # at most 2 ** rules rows
    names = list(rules())
    lines = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("bigint").alias("bit")) for r in POLICIES[policy]])).alias("r")
    x = counts.select("f", "count", lines).select("f", "count", "r.rule", "r.bit")
    return x.groupBy("rule").agg(
        F.sum(F.when(F.col("f").bitwiseAND(F.col("bit")) != 0, F.col("count")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("f") == F.col("bit"), F.col("count")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("f").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("count")).otherwise(0)).alias("n_kept_without"),
    )


def query(docs: DataFrame, policy: str = "v1") -> DataFrame:
    book = ledger(measure(docs))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", violates("base").alias("base_failed"), (~violates("base") & ~violates(policy)).alias("kept"), F.col("failed").alias("failed_bits"))


def filter_documents(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy's mask keeps by their ledger bits, all columns unchanged, without a shuffle."""
    book = _measured(docs, text_col).select(*docs.columns, failed_bits(lambda m: F.col(f"_q_{m}")).alias("_q_failed"))
    return book.where(~violates(policy, "_q_failed")).select(*docs.columns)
