"""Matching over collections: titles against the words of pages, names and years against the text of drafts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillspark.functions import text as T
from quillspark.functions import unicode as U
from quillspark.operators.triage import as_of
from quillspark.shipping import ship
from quillspark.staging import staged


#: Words of the titles that one task holds at a time.
TITLE_WORDS = 3_000_000
#: Pairs that a task hands on at a time.
PAIRS = 500_000


def contained_titles(titles: DataFrame, pages: DataFrame, title: str = "title", page: str = "page", words: str = "words", percent: int = 60, most: int = TITLE_WORDS) -> DataFrame:
    """``title``, ``page`` and shared: pages that hold at least ``percent`` of a title's distinct words. Titles without words match nothing.

    titles: an id and an array of words; pages: the same. Titles are dealt into blocks of about ``most`` words, pages into as many parts as
    keep all cores busy; each task has one block and one part. It indexes its titles by word and counts, for one page after the other, the words that
    each title shares with it. Only titles and pages move, each page once a block and each title once a part: no pair is shuffled or
    stored before it is known to hold, and none is left out. Pages stream through, so a task's memory is that of its titles.
    """
    spark = titles.sparkSession
    ship(spark)
    sets = F.array_distinct(F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda w: w.isNotNull()))
    t, p = (x.select(F.col(key).alias("_id"), sets.alias("_words")).where(F.size("_words") > 0) for x, key in ((titles, title), (pages, page)))
    blocks = -(-(t.agg(F.sum(F.size("_words"))).first()[0] or 1) // most)
    parts = -(-3 * spark.sparkContext.defaultParallelism // blocks)
    dealt = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kinds = [titles.schema[title].dataType, pages.schema[page].dataType]
    t = t.withColumn("_block", dealt(blocks)).withColumn("_part", every(parts)).withColumn("_page", F.lit(None).cast(kinds[1])).withColumnRenamed("_id", "_title")
    p = p.withColumn("_part", dealt(parts)).withColumn("_block", every(blocks)).withColumn("_title", F.lit(None).cast(kinds[0])).withColumnRenamed("_id", "_page")
    columns = [(F.col("_block") * parts + F.col("_part")).alias("_task"), "_title", "_page", "_words"]
    both = t.select(*columns, F.lit(False).alias("_is_page")).union(p.select(*columns, F.lit(True).alias("_is_page")))
    met = both.repartitionById(blocks * parts, F.col("_task")).sortWithinPartitions("_task", "_is_page").mapInArrow(_meeting(percent), StructType([StructField("_title", kinds[0]), StructField("_page", kinds[1]), StructField("shared", LongType())]))
    return met.select(F.col("_title").alias(title), F.col("_page").alias(page), "shared")


def _meeting(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows ordered by task, titles before pages: the pairs of each task that hold."""

    def run(batches):
        task, held, index = None, [], None
        for batch in batches:
            kinds = 2 * batch["_task"].to_numpy().astype("int64") + batch["_is_page"].to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
            for i, j in pairwise(edges) if len(kinds) else ():
                rows = batch.slice(i, j - i)
                if kinds[i] // 2 != task:
                    task, held, index = kinds[i] // 2, [], None
                if not kinds[i] % 2:
                    held.append(rows.select(["_title", "_words"]))
                elif held or index:
                    index, held = index or _Index(held, percent), []
                    yield from index.meet(rows)

    return run


class _Index:
    """Titles by word."""

    def __init__(self, rows: list[pa.RecordBatch], percent: int):
        table = pa.Table.from_batches(rows).combine_chunks()
        self.ids, words = table["_title"], table["_words"].chunk(0)
        sizes = pc.list_value_length(words).to_numpy()
        coded = words.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        self.vocabulary = coded.dictionary
        self.needs = np.maximum(np.ceil(sizes * percent / 100), 1).astype("int64")
        self.titles = np.repeat(np.arange(len(sizes)), sizes)[np.argsort(codes, kind="stable")]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(self.vocabulary)))])

    def meet(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words = rows["_words"]
        sizes = pc.list_value_length(words).to_numpy()
        known = pc.fill_null(pc.index_in(words.flatten(), self.vocabulary), -1).to_numpy()
        found, n = [], 0
        for at, codes in enumerate(np.split(known, np.cumsum(sizes)[:-1])):
            lists = [self.titles[self.starts[k] : self.starts[k + 1]] for k in codes[codes >= 0].tolist()]
            if lists:
                shared = np.bincount(np.concatenate(lists), minlength=len(self.needs))
                hits = np.flatnonzero(shared >= self.needs)
                found.append((hits, np.full(len(hits), at), shared[hits]))
                n += len(hits)
            if n >= PAIRS:
                yield self._pairs(found, rows)
                found, n = [], 0
        if n:
            yield self._pairs(found, rows)

    def _pairs(self, found: list, rows: pa.RecordBatch) -> pa.RecordBatch:
        titles, pages, shared = (np.concatenate(x) for x in zip(*found, strict=True))
        ids = self.ids.take(pa.array(titles)).combine_chunks()
        return pa.RecordBatch.from_arrays([ids, rows["_page"].take(pa.array(pages)), pa.array(shared, pa.int64())], ["_title", "_page", "shared"])


#: Letters, digits and the underscore, as parts of a word.
_PART = r"[\p{L}\p{N}_]"
#: A year that begins a word; looked behind only where one may be.
_YEAR = rf"[12](?<!{_PART}.)[09](?<=19|20)\d\d"
#: Between a name and its year stand at most this many characters, and no bracket that closes.
WINDOW = 45
#: Up to so many names of a draft are first looked for as plain text in a passage.
MANY_NAMES = 20


def dated_passages(text: Column, reach: int) -> Column:
    """Every year of a text as a struct stop (the place behind it), year, passage (what stands before it).

    passage: the text from the year before it (or the start) up to the year, its last ``reach`` characters. A text is split at its years once,
    and places are running sums of what the split gave, in the JVM.
    """
    years, pieces = F.regexp_extract_all(text, F.lit(_YEAR), F.lit(0)), F.split(text, _YEAR)

    def built(y, p):
        stops = _sums(F.transform(F.slice(p, F.lit(1), F.size(y)), lambda x: F.length(x) + 4))
        last = lambda x: F.substr(x, F.greatest(F.length(x) - reach + 1, F.lit(1)), F.lit(reach))
        return _let(stops, lambda at: F.transform(y, lambda year, i: F.struct(F.get(at, i).alias("stop"), year.cast("int").alias("year"), last(F.get(p, i)).alias("passage"))))

    return _let(years, lambda y: _let(pieces, lambda p: built(y, p)))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _sums(lengths: Column) -> Column:
    """The running sums of an array: within stretches of 64, and over the stretches, so that no long array is appended to again and again."""
    n = 64
    run = lambda xs: F.aggregate(xs, F.array(F.lit(0).cast("bigint")), lambda a, e: F.array_append(a, F.element_at(a, -1) + e))

    def summed(xs):
        stretches = F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / n).cast("int")), lambda i: run(F.slice(xs, i * n + 1, F.lit(n))))
        over = lambda inner: _let(run(F.transform(inner, lambda x: F.element_at(x, -1))), lambda before: F.flatten(F.transform(inner, lambda x, i: F.transform(F.slice(x, 2, n), lambda v: v + F.get(before, i)))))
        return _let(stretches, over)

    return _let(lengths, summed)


def words_at(text: Column) -> Column:
    """Every word of a text as a struct word, at (characters before it)."""
    words, gaps = F.regexp_extract_all(text, F.lit(f"{_PART}+"), F.lit(0)), F.split(text, f"{_PART}+")

    def built(w, g):
        stops = _sums(F.transform(w, lambda x, i: F.length(x) + F.length(F.get(g, i))))
        return _let(stops, lambda at: F.transform(w, lambda x, i: F.struct(x.alias("word"), (F.get(at, i) - F.length(x)).alias("at"))))

    return _let(words, lambda w: _let(gaps, lambda g: built(w, g)))


def numbered_headings(text: Column) -> Column:
    """Headings ``# 3. `` and ``**3\\. `` at the start of a line as structs start, section, by running sums like :func:`dated_passages`."""
    # Fixed value: the pattern of a numbered heading.
    pattern = r"(?dm)^(?:#+[\s\p{Z}]*|\*\*)\d+\\?\.[\s\p{Z}]"
    heads, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)

    def built(h, p):
        stops = _sums(F.transform(h, lambda x, i: F.length(x) + F.length(F.get(p, i))))
        return _let(stops, lambda at: F.transform(h, lambda x, i: F.struct((F.get(at, i) - F.length(x)).alias("start"), F.regexp_extract(x, r"\d+", 0).cast("int").alias("section"))))

    return _let(heads, lambda h: _let(pieces, lambda p: built(h, p)))


def citing_sections(references: DataFrame, drafts: DataFrame, key: str, text: str, name: str, year: str, slack: int = 1) -> DataFrame:
    """references and ``sections``: the numbered sections of their draft that cite them, ascending; empty if none does.

    references: ``key`` (of the draft), ``name`` and ``year`` (null: any year counts). A mention is the name as whole words with a year behind it:
    the first one, at most WINDOW characters on, no ``)`` or ``]`` between, and at most ``slack`` years off. Names of one letter are mentioned nowhere, nor are
    names that hold a year themselves.
    Images and the reference list are left out of the draft first; case, accents and kinds of dash do not matter; mentions before
    the first heading belong to no section. Repeated references stay repeated; a null or unknown draft cites nothing.

    Drafts meet the first words of their references first, each text once, so only passages that hold such a word become rows, and of these only such words;
    the rest of a name is compared in place. Headings are found by an as-of scan, so no mention is paired with a heading.
    """
    refs = staged(references.withColumn("_r", F.monotonically_increasing_id()))
    body = F.when(F.contains(F.col(text), F.lit("[image")), F.regexp_replace(F.col(text), r"(?dm)^\[image\d+\]:.*$", "")).otherwise(F.col(text))
    first = F.regexp_extract("_name", rf"{_PART}+", 0)
    names = staged(refs.select(key, "_r", U.folded(F.col(name)).alias("_name"), F.col(year).cast("int").alias("_y")).where(F.length("_name") >= 2).withColumn("_first", first).where("_first <> ''"))
    longest = names.agg(F.max(F.length("_name"))).first()[0] or 0
    firsts = names.groupBy(key).agg(F.collect_set("_first").alias("_firsts"))
    d = drafts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, T.before_bibliography(body).alias("_raw"))
    holds = lambda p: (F.size("_firsts") > MANY_NAMES) | F.exists("_firsts", lambda x: F.contains(p["passage"], x))
    meets = lambda p: holds(p) & F.arrays_overlap(F.regexp_extract_all(p["passage"], F.lit(f"{_PART}+"), F.lit(0)), F.col("_firsts"))
    d = d.join(firsts.hint("shuffle_hash"), key).withColumn("_t", U.folded("_raw"))
    seen = staged(d.select(key, "_firsts", F.filter(dated_passages(F.col("_t"), longest + WINDOW + 1), meets).alias("_passages"), numbered_headings(F.col("_raw")).alias("_heads")))
    near = seen.select(key, "_firsts", F.explode("_passages").alias("_p")).select(key, "_firsts", "_p.*")
    # one index row for each word near a year that begins a name: the word, where it starts in the passage, and the year
    index = near.select(key, "stop", "year", "passage", F.explode(F.filter(words_at(F.col("passage")), lambda w: F.array_contains(F.col("_firsts"), w["word"]))).alias("_e"))
    met = names.join(index.select(key, "stop", "year", "passage", F.col("_e.word").alias("_first"), F.col("_e.at").alias("_at")), [key, "_first"]).where(F.col("_y").isNull() | (F.abs(F.col("year") - F.col("_y")) <= slack))
    # the name starts where its first word does, less what stands before that word in the name
    at = F.col("_at") - (F.instr(F.col("_name"), F.col("_first")) - 1)
    n, p = F.length("_name"), F.col("passage")
    part = lambda c: F.coalesce(c.rlike(rf"^{_PART}$"), F.lit(False))
    edge = lambda i: part(F.substr(p, i, F.lit(1))) != part(F.substr(p, i + 1, F.lit(1)))
    gap = F.substr(p, (at + n + 1).cast("int"), F.length(p))
    i = at.cast("int")
    after_year = F.col("stop") - 4 > F.length(p)  # a digit stands before the passage
    begins = F.when(i > 0, edge(i)).otherwise(part(F.substr(p, F.lit(1), F.lit(1))) != after_year)
    ends = F.when(F.length(gap) > 0, edge(i + n)).otherwise(~part(F.substr("_name", n, F.lit(1))))
    hit = (at >= 0) & (F.substr(p, i + 1, n) == F.col("_name")) & begins & ends & (F.length(gap) <= WINDOW) & ~gap.rlike(r"[)\]]")
    start = F.col("stop") - 4 - F.length(p) + at
    mentions = met.where(hit).groupBy("_r", key, "stop").agg(F.min(start).alias("start"))  # a name twice before one year is one mention
    heads = seen.select(key, F.explode("_heads").alias("_h")).select(key, "_h.*")
    placed = as_of(staged(mentions.select("_r", key, "start")), heads, [key], ["start"], "section").where("section is not null")
    sections = placed.groupBy("_r").agg(F.array_sort(F.collect_set("section")).alias("sections"))
    return refs.join(sections, "_r", "left").select(*references.columns, F.coalesce("sections", F.array().cast("array<int>")).alias("sections"))
