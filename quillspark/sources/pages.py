"""Landed pages of a service's answers as a Spark data source: ``spark.read.format("landed_pages")``.

A page is a folder ``page=<token>`` of text files; a line is one answer, ``{"id": ..., "answer": {...}}``. A scan has one partition
a page, and comparisons of the column ``page`` with numbers choose pages before any file is opened. A line that is not
such an object is a row with ``error`` and no payload: one bad answer stops nothing. Nothing here talks to a network.
"""

from __future__ import annotations

import json
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from quillspark.shipping import ship

SCHEMA = "page bigint, position bigint, id string, payload string, error string"


class LandedPages(D.DataSource):
    """Options: path, the folder that holds the pages."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Pages:
        if "path" not in self.options:
            raise ValueError("landed_pages needs a path")
        return Pages(self.options["path"])


class Page(D.InputPartition):
    def __init__(self, token: int, files: list[str]):
        super().__init__((token, files))


class Pages(D.DataSourceReader):
    def __init__(self, path: str):
        self.path, self.tests = path, []

    def pushFilters(self, filters):
        """Takes comparisons of ``page``; all others stay with Spark."""
        kinds = {D.EqualTo: operator.eq, D.GreaterThan: operator.gt, D.GreaterThanOrEqual: operator.ge, D.LessThan: operator.lt, D.LessThanOrEqual: operator.le}
        for f in filters:
            if getattr(f, "attribute", None) == ("page",) and type(f) in kinds:
                self.tests.append((kinds[type(f)], f.value))
            elif getattr(f, "attribute", None) == ("page",) and isinstance(f, D.In):
                self.tests.append((lambda token, among: token in among, set(f.value)))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        from quillspark.sources.files import _store

        store, root = _store(self.path)
        pages: dict[int, list[str]] = {}
        for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            kind, _, token = info.base_name.partition("=")
            if kind == "page" and token.isdigit() and all(test(int(token), value) for test, value in self.tests):
                pages[int(token)] = [info.path]
        return [Page(token, folders) for token, folders in sorted(pages.items())]

    def read(self, partition):
        from pyarrow import fs

        from quillspark.sources.files import _store

        if partition is None:  # no page is left to read
            return
        token, folders = partition.value
        store, _ = _store(self.path)
        at = 0
        for folder in folders:
            for info in sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda i: i.path):
                if not info.is_file or info.base_name.startswith(("_", ".")):
                    continue
                with store.open_input_stream(info.path) as data:
                    for line in _lines(data):
                        at += 1
                        yield (token, at, *_answer(line))


def _lines(data):
    """Lines of a stream, read a megabyte at a time."""
    rest = b""
    while chunk := data.read(1 << 20):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _answer(line: bytes) -> tuple[str | None, str | None, str | None]:
    try:
        row = json.loads(line)
        return str(row["id"]), json.dumps(row["answer"], ensure_ascii=False), None
    except (ValueError, KeyError, TypeError) as e:
        return None, None, f"{type(e).__name__}: {e}"


def land(rows: DataFrame, page: Column, id: Column, payload: Column, path: str) -> None:
    """Writes payloads (JSON texts) as pages, the way a connector leaves them. A page's answers are written by one task: keep pages small."""
    line = F.concat(F.lit('{"id":'), F.to_json(F.array(id.cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(id.cast("string")))) - 2), F.lit(',"answer":'), payload, F.lit("}"))
    rows.select(page.cast("bigint").alias("page"), line.alias("value")).repartition("page").write.mode("overwrite").partitionBy("page").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """page, position, id, payload, error of the landed pages below ``path``."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedPages)
    return spark.read.format("landed_pages").option("path", path).load()
