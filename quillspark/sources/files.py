"""Readers and writers for the file formats of a literature library, on Spark's own sources and sinks."""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import unicode as U
from quillspark.operators.ranking import places
from quillspark.shipping import ship
from quillspark.staging import scratch, staged

ENTRY = "struct<title:string,doi:string,pmid:string,pmcid:string,year:string,authors:string,source_of_fulltext:string,files:array<string>,projects:array<string>,fetched_at:string,cited_dois:array<string>,refs_source:string,role:string>"
MANIFEST = f"by_id map<string,string>, entries map<string,{ENTRY}>"
TRIAGE = "doi stem year first_author journal title draft_sections crossref_citations have_pdf proposed_tier tier replacement_doi note".split()
AUTHOR_COLUMNS = ("tier", "replacement_doi", "note")
META = "map<string,struct<year:int,first_author:string,journal:string,title:string,type:string,crossref_citations:bigint>>"


def put(spark: SparkSession, path: str, text: str) -> None:
    """One small file from the driver, such as a note or an export's readme."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


# ---- the ledger


def manifest_tables(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(identifiers(id, stem), papers(stem, ...)) from ledger JSON texts."""
    m = raw.select(F.from_json(value, MANIFEST).alias("m"))
    ids = m.select(F.explode(F.map_entries("m.by_id")).alias("e")).select(F.col("e.key").alias("id"), F.col("e.value").alias("stem"))
    papers = m.select(F.explode(F.map_entries("m.entries")).alias("e")).select(F.col("e.key").alias("stem"), "e.value.*")
    return ids, papers


_MANIFEST_HEAD, _MANIFEST_MIDDLE, _MANIFEST_TAIL = '{"by_id":{', '},"entries":{', "}}"


def read_manifest(spark: SparkSession, path: str, missing_ok: bool = True) -> tuple[DataFrame, DataFrame]:
    """The ledger's tables; a missing file is an empty ledger, or an error if that is not allowed.

    A ledger of :func:`write_manifest` is read line by line, by many tasks; one of another writer is one JSON document, read whole.
    """
    if not exists(spark, path):
        if not missing_ok:
            raise FileNotFoundError(path)
        return manifest_tables(spark.createDataFrame([("{}",)], "value string"))
    lines = spark.read.text(path)
    if not lines.where(F.col("value") == _MANIFEST_HEAD).limit(1).count():
        return manifest_tables(spark.read.text(path, wholetext=True))
    entry = F.concat(F.lit("{"), F.ltrim("value", F.lit(",")), F.lit("}"))
    rows = lines.where(~F.col("value").isin(_MANIFEST_HEAD, _MANIFEST_MIDDLE, _MANIFEST_TAIL)).select(entry.alias("v"), F.col("value").rlike(r'^,?"(?:[^"\\]|\\.)*":\{').alias("paper"))
    ids = rows.where("not paper").select(F.explode(F.from_json("v", "map<string,string>")).alias("id", "stem"))
    papers = rows.where("paper").select(F.explode(F.from_json("v", f"map<string,{ENTRY}>")).alias("stem", "_e")).select("stem", "_e.*")
    return ids, papers


def _key(c: Column | str) -> Column:
    """A string as JSON."""
    text = F.to_json(F.array(c))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _entries(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """_k and line: a line for each key, with a comma in front of all but the first. Of rows of one key the largest value counts."""
    one = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(value).alias("_v"))
    first = one.agg(F.min("_k")).first()[0]
    return one.select("_k", F.concat(F.when(F.col("_k") == F.lit(first), "").otherwise(","), _key("_k"), F.lit(":"), F.coalesce("_v", F.lit("null"))).alias("line"))


def write_document(parts: list[str | DataFrame], path: str, spark: SparkSession) -> None:
    """One text document as files that follow each other in name order.

    parts: lines, and tables of _k and line, which are written in order of _k. Rows are range-sorted, so every task writes its own
    stretch of the document; no task sees all of it.
    """
    rows = None
    for n, part in enumerate(parts):
        x = spark.createDataFrame([("", part)], "_k string, line string") if isinstance(part, str) else part.select(F.col("_k").cast("string").alias("_k"), "line")
        x = x.withColumn("_n", F.lit(n))
        rows = x if rows is None else rows.unionByName(x)
    rows.orderBy("_n", "_k").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def in_written_order(spark: SparkSession, path: str, name: str = "line") -> DataFrame:
    """value and ``name`` (from 1): the lines of a document of :func:`write_document`, numbered by file name and place in the file."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    return places(staged(rows), ["_f", "_b", "_i"], (), name).select("value", name)


def write_manifest(ids: DataFrame, papers: DataFrame, path: str) -> None:
    """The ledger's JSON, keys sorted, a line an entry. ids: id and stem. papers: stem and fields."""
    fields = [c for c in papers.columns if c != "stem"]
    by_id, entries = _entries(ids, "id", _key("stem")), _entries(papers, "stem", F.to_json(F.struct(*fields)))
    write_document([_MANIFEST_HEAD, by_id, _MANIFEST_MIDDLE, entries, _MANIFEST_TAIL], path, ids.sparkSession)


# ---- lists and tables


def identifier_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Trimmed lines without blanks and comments, leading blanks allowed before #."""
    return lines.where(~F.col(value).rlike(r"^\s*#") & (F.trim(value) != "")).select(F.trim(value).alias("token"))


def doi_lines(lines: DataFrame, value: str = "value", pos: str = "pos") -> DataFrame:
    """Lines that do not start with #, one per DOI whatever its case: the first spelling, by place."""
    rows = lines.where(~F.col(value).startswith("#") & (F.trim(value) != "")).select(F.trim(value).alias("doi"), pos)
    return rows.groupBy(F.lower("doi").alias("_k")).agg(F.min(F.struct(pos, "doi")).alias("_f")).select("_f.*")


_TSV = {"sep": "\t", "quote": '"', "escape": '"'}


def read_triage(spark: SparkSession, path: str) -> DataFrame:
    """The triage table, all columns as text; a missing file is empty."""
    schema = ", ".join(f"{c} string" for c in TRIAGE)
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.csv(path, schema=schema, **_TSV).na.fill("")
    return rows.where(~F.concat_ws("\t", *TRIAGE).eqNullSafe(F.lit("\t".join(TRIAGE))))  # the header is in the first file only


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """doi (lower case) and what its author decided in an earlier run; rows without a doi or any decision are left out."""
    rows = read_triage(spark, path).select(F.lower(F.trim("doi")).alias("doi"), *(F.trim(c).alias(c) for c in AUTHOR_COLUMNS))
    return rows.where((F.col("doi") != "") & (F.concat(*AUTHOR_COLUMNS) != ""))


def write_triage(rows: DataFrame, path: str, order: list | None = None) -> None:
    """Tab-separated files that follow each other in name order: a header, then the rows in the given order (else by tier, year and doi); minimal quoting, LF ends."""
    keys = {f"_o{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order or ["tier", "year", "doi"])}
    body = rows.select(*TRIAGE, F.lit(1).alias("_n"), *[c.alias(k) for k, c in keys.items()])
    head = rows.sparkSession.createDataFrame([tuple(TRIAGE)], ", ".join(f"{c} string" for c in TRIAGE)).withColumns({"_n": F.lit(0), **{k: F.lit(None).cast(body.schema[k].dataType) for k in keys}})
    both = head.unionByName(body).orderBy("_n", *keys).select(*TRIAGE)
    both.write.mode("overwrite").csv(path, lineSep="\n", emptyValue="", nullValue="", header=False, **_TSV)


def markdown_rows(lines: DataFrame, value: str = "value") -> DataFrame:
    """doi, approved, cells of a suggestion table's rows; header, separator and short rows are left out."""
    t = F.trim(value)
    cells = F.transform(F.split(F.regexp_replace(t, r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))
    x = lines.where(t.startswith("|")).select(cells.alias("cells")).where((F.size("cells") >= 9) & (F.lower(F.get("cells", F.lit(1))) != "year") & F.exists("cells", lambda c: ~c.rlike("^[-: ]*$")))
    hit = F.get(F.filter("cells", lambda c: c.rlike(T.DOI_IN_CELL)), F.lit(0))
    return x.select(T.first_doi_in_cell(hit).alias("doi"), F.lower(F.get("cells", F.lit(0))).contains("[x]").alias("approved"), "cells").where("doi <> ''")


def bib_keys(lines: DataFrame, value: str = "value") -> DataFrame:
    return lines.select(F.regexp_extract(value, r"^\s*@\w+\s*\{\s*([^,\s]+)\s*,", 1).alias("key")).where("key <> ''").distinct()


def concept_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """concept, pos and stem of lines ``- [[concept]] <- a, b``."""
    pattern = r"^-\s*\[\[(.+?)\]\]\s*<-\s*(.+?)\s*$"
    x = lines.where(F.col(value).rlike(pattern)).select(F.trim(F.regexp_extract(value, pattern, 1)).alias("concept"), F.posexplode(F.split(F.regexp_extract(value, pattern, 2), ",")).alias("pos", "_s"))
    return x.select("concept", "pos", F.trim("_s").alias("stem")).where("stem <> ''")


# ---- notes, XML, PDF


def parse_nodes(texts: DataFrame, name: Column, value: str = "value") -> DataFrame:
    """stem, doi, projects, cited of note files; those without frontmatter are dropped. name: file name without ending."""
    v = F.col(value)
    return texts.where(T.frontmatter(v) != "").select(
        F.coalesce(T.known(T.front_value(v, "citekey")), name).alias("stem"), F.lower(T.front_value(v, "doi")).alias("doi"),
        T.front_list(v, "projects").alias("projects"), F.array_distinct(F.filter(F.transform(T.front_list(v, "cited_dois"), lambda d: F.lower(d)), lambda d: d != "")).alias("cited"),
    )


def read_nodes(spark: SparkSession, folder: str) -> DataFrame:
    raw = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("_name"))
    return parse_nodes(raw, F.regexp_replace("_name", r"\.md$", ""))


def stems(spark: SparkSession, folder: str, ending: str, recursive: bool = False) -> DataFrame:
    """File names of a folder without their ending. Spark's file sources pass over empty files, so those are not listed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ending}").option("recursiveFileLookup", recursive).load(folder)
    return files.select(F.expr(f"substr(_metadata.file_name, 1, length(_metadata.file_name) - {len(ending)})").alias("stem")).distinct()


def tree(spark: SparkSession, root: str) -> DataFrame:
    """path (relative) and content of all files below a folder, but for empty ones, which Spark's file sources pass over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.lit(root.rstrip("/").removeprefix("file://").removeprefix("file:"))
    return files.select(F.expr("regexp_replace(path, '^file:/*', '/')").alias("_p"), "content").select(F.substr("_p", F.length(base) + 2).alias("path"), "content")


def file_digests(spark: SparkSession, root: str, known: DataFrame | None = None) -> DataFrame:
    """path (relative), size, modified, digest and read of all files below a folder, but for empty ones.

    known: the result for an earlier state of the folder. A file of the same size and time keeps the digest that it has there; only others are
    read (``read``), each as a stream by the task that owns its row. The listing itself opens no file.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.lit(root.rstrip("/").removeprefix("file://").removeprefix("file:"))
    whole = F.expr("regexp_replace(path, '^file:/*', '/')")
    rows = listing.select(F.substr(whole, F.length(base) + 2).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    if known is not None:
        rows = rows.join(known.select("path", "size", "modified", F.col("digest").alias("_old")), ["path", "size", "modified"], "left")
    else:
        rows = rows.withColumn("_old", F.lit(None).cast("string"))
    rows = staged(rows)

    def run(batches):
        store, folder = _store(root)
        for b in batches:
            found = []
            for name in b.column(0).to_pylist():
                sha = hashlib.sha256()
                with store.open_input_stream(f"{folder}/{name}") as data:
                    while chunk := data.read(1 << 20):
                        sha.update(chunk)
                found.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=[*b.schema.names, "digest"])

    ship(spark)
    fresh = rows.where("_old is null").select("path", "size", "modified").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    fresh = fresh.mapInArrow(run, "path string, size bigint, modified timestamp, digest string").withColumn("read", F.lit(True))
    return staged(rows.where("_old is not null").select("path", "size", "modified", F.col("_old").alias("digest"), F.lit(False).alias("read")).unionByName(fresh))


def read_articles(spark: SparkSession, folder: str) -> DataFrame:
    """stem and the parsed fields of article XML files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(folder)
    return files.select(F.expr("regexp_replace(_metadata.file_name, '[.]xml$', '')").alias("stem"), U.article_xml("content").alias("a")).select("stem", "a.*")


def pdfs(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return files.select(F.expr("regexp_replace(_metadata.file_name, '[.]pdf$', '')").alias("stem"), T.looks_pdf(F.col("content")).alias("is_pdf"))


# ---- cache, log, reports


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """doi and its metadata (null: a known miss); missing or corrupt files are empty.

    A cache with a line an entry is read line by line, by many tasks; any other is one JSON document, read whole.
    """
    if not exists(spark, path):
        rows = spark.createDataFrame([("{}",)], "value string")
    else:
        lines = spark.read.text(path).where(~F.trim("value").isin("{", "}", "")).select(F.concat(F.lit("{"), F.ltrim("value", F.lit(",")), F.lit("}")).alias("value"))
        odd = lines.where(F.from_json("value", "map<string,string>").isNull()).limit(1).count()
        rows = spark.read.text(path, wholetext=True) if odd else lines
    got = rows.select(F.explode(F.from_json("value", META)).alias("doi", "meta"))
    return got.select("doi", F.when(F.col("meta.title").isNotNull() | F.col("meta.year").isNotNull(), F.col("meta")).alias("meta"))


def write_cache(rows: DataFrame, path: str) -> None:
    """One JSON document, keys sorted, a line an entry; a null meta is kept as a known miss. rows: doi, meta."""
    write_document(["{", _entries(rows, "doi", F.to_json("meta")), "}"], path, rows.sparkSession)


def log_rows(fetched: DataFrame, relinked: DataFrame, gaps: DataFrame, project: str) -> DataFrame:
    """project, kind, stem, detail of a run's three collections."""
    parts = [d.select(F.lit(project).alias("project"), F.lit(k).alias("kind"), "stem", "detail") for d, k in ((fetched, "fetched"), (relinked, "re-linked"), (gaps, "gap"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def append_log(rows: DataFrame, path: str) -> None:
    rows.withColumn("ts", F.current_timestamp()).write.mode("append").parquet(path)


def report(rows: DataFrame, line: Column, order: list, path: str) -> None:
    """Lines of text in a given order, as files that follow each other in name order."""
    rows.orderBy(*order).select(line.alias("value")).write.mode("overwrite").text(path)


def bibliography(entries: DataFrame, path: str) -> None:
    """A head with the number of entries, then the entries (key, entry) by key, blank lines between. Lines of an entry stay together."""
    head = f"% {entries.count()} entries; do not edit, generate anew\n"
    write_document([head, entries.select(F.col("key").alias("_k"), F.concat("entry", F.lit("\n")).alias("line"))], path, entries.sparkSession)


# ---- files by tasks


def _store(uri: str):
    """(file system, path) of a URI, in a worker."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def _safe(name: str | None) -> bool:
    return bool(name) and not name.startswith("/") and ".." not in name.split("/")


def write_files(rows: DataFrame, root: str, path: str = "path", content: str = "content") -> DataFrame:
    """``path`` (relative) and size of files that the tasks wrote below ``root``, one for each row; a name that would leave the folder raises an error.

    Each file is written under another name and then moved, so that a task that is tried again leaves whole files only.
    """

    def run(batches):
        store, base = _store(root)
        for b in batches:
            sizes = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not _safe(name):
                    raise ValueError(f"unsafe file name: {name}")
                _put_whole(store, f"{base}/{name}", lambda out, data=data: out.write(data or b""))
                sizes.append(len(data or b""))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["path", "size"])

    ship(rows.sparkSession)
    return staged(rows.select(F.col(path).alias("path"), F.col(content).cast("binary")).mapInArrow(run, "path string, size bigint"))


def _put_whole(store, target: str, fill) -> None:
    store.create_dir(target.rpartition("/")[0], recursive=True)
    part = f"{target}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        fill(out)
    store.move(part, target)


def export_project(papers: DataFrame, project: str, library: str, target: str) -> DataFrame:
    """stem, file, status (copied, missing, unsafe, none listed) and size of a project's member files, copied from ``library`` to ``target``.

    papers: stem, files and projects, as in the ledger. Every file is copied once, whatever the number of papers that list it, by the
    task that owns its row, as a stream; contents never pass through Spark. The library is only read. A null project list is no membership.
    """
    spark = papers.sparkSession
    members = staged(papers.where(F.array_contains("projects", project)).select("stem", F.explode_outer("files").alias("file")))

    def run(batches):
        (source, base), (store, out) = _store(library), _store(target)
        for b in batches:
            status, sizes = [], []
            for name in b.column(0).to_pylist():
                size = None
                if not _safe(name):
                    state = "unsafe"
                elif not source.get_file_info(f"{base}/{name}").is_file:
                    state = "missing"
                else:
                    with source.open_input_stream(f"{base}/{name}") as data:
                        size = _copy(data, store, f"{out}/{name}")
                    state = "copied"
                status.append(state)
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(status, pa.string()), pa.array(sizes, pa.int64())], names=["file", "status", "size"])

    ship(spark)
    names = members.where("file is not null").select("file").distinct()
    done = staged(names.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file").mapInArrow(run, "file string, status string, size bigint"))
    return members.join(done, "file", "left").select("stem", "file", F.coalesce("status", F.lit("none listed")).alias("status"), "size")


def _copy(data, store, target: str) -> int:
    size = 0

    def fill(out) -> None:
        nonlocal size
        while chunk := data.read(1 << 20):
            out.write(chunk)
            size += len(chunk)

    _put_whole(store, target, fill)
    return size


def export_totals(exported: DataFrame) -> DataFrame:
    """One row: papers, copied and missing files of an export."""
    return exported.agg(F.count_distinct("stem").alias("papers"), F.count_if(F.col("status") == "copied").alias("copied"), F.count_if(F.col("status") == "missing").alias("missing"))
