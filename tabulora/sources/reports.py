"""A data source for folders of mixed files: `spark.read.format("reports").load(path)`.

Each file gives rows of one relation: a row of kind text for text, Markdown, HTML and unknown files; for PDF rows of kind
line, block, table and image by a backend; a row of kind error for a file that cannot be read or parsed, which fails
nothing else. Files are listed once and dealt to partitions by their bytes; executors read and parse them one at a time.

A backend is a function of (path, bytes), named as `module:function` in the option `backend`, that yields dicts with kind
and page, and with idx, x0, y0, x1, y1, text or rows where they apply. The engine comes without one: without the option,
PDF files are error rows.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tabulora.cut import cut
from tabulora.functions.text import collapse
from tabulora.operators.elements import elements_of

SCHEMA = "source string, title string, doc_type string, kind string, page int, idx int, x0 double, y0 double, x1 double, y1 double, text string, rows array<array<string>>, error string"
FIELDS = [f.split(" ")[0] for f in re.split(r", (?=\w+ )", SCHEMA)]
#: Bytes of files in a partition; a larger file is one of its own.
BYTES = 64 << 20
STRICT = ("txt", "md", "html", "htm")


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


def _system(path: str):
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    if path.startswith("file:"):
        path = path.removeprefix("file:")
    return fs.LocalFileSystem(), path


class ReportReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.backend = options.get("path"), options.get("backend")
        self.bytes = int(options.get("partitionbytes", BYTES))
        if not self.path:
            raise ValueError("reports: no path")

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, at = _system(self.path)
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"file not found: {self.path}")
        found = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
        head = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else ""
        out, size = [[]], 0
        for f in sorted(found, key=lambda f: f.path):
            if out[-1] and size + f.size > self.bytes:
                out.append([])
                size = 0
            out[-1].append(head + f.path)
            size += f.size
        return [Files(paths) for paths in out]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            name = path.rsplit("/", 1)[-1]
            stem, dot, suffix = name.rpartition(".")
            kind = suffix.lower() if dot and stem else "unknown"
            base = {"source": path, "title": stem if dot and stem else name, "doc_type": kind}
            rows: list[dict] = []
            try:
                system, at = _system(path)
                with system.open_input_stream(at) as f:
                    raw = f.read()
                if kind == "pdf":
                    rows = list(self._pdf(path, raw))
                else:
                    rows = [{"kind": "text", "page": 1, "text": raw.decode("utf-8", "strict" if kind in STRICT else "ignore")}]
            except Exception as e:  # noqa: BLE001  a file's failure is its own row
                rows = [{"kind": "error", "error": f"{type(e).__name__}: {e}"[:500]}]
            for row in rows:
                row = base | row
                yield tuple(row.get(c) for c in FIELDS)

    def _pdf(self, path: str, raw: bytes) -> Iterator[dict]:
        if not self.backend:
            raise ValueError("no backend for PDF files")
        module, _, function = self.backend.partition(":")
        yield from getattr(importlib.import_module(module), function)(path, raw)


class ReportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "reports"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ReportReader(dict(self.options))


def read_reports(spark: SparkSession, path: str, backend: str | None = None, partition_bytes: int = BYTES) -> DataFrame:
    """The rows of a file or of all files under a folder."""
    spark.dataSource.register(ReportSource)
    reader = spark.read.format("reports").option("partitionbytes", partition_bytes)
    return (reader.option("backend", backend) if backend else reader).load(path)


def parsed(spark: SparkSession, path: str, backend: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (source, title, doc_type, text), their elements (source, element_seq, …) and errors (source, error).

    The text of a document of elements is that of its text elements, in order; files that failed are errors only.
    """
    rows = cut(read_reports(spark, path, backend))
    kind = lambda k: rows.where(F.col("kind") == k).withColumn("doc_id", F.col("source"))
    lines = kind("line").select("doc_id", "page", F.coalesce("y0", F.lit(0.0)).alias("y"), F.coalesce("idx", F.lit(0)).alias("seq"), collapse(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''")
    blocks = kind("block").select("doc_id", "page", F.col("idx").alias("block_id"), "x0", "y0", "x1", "y1", "text")
    tables = kind("table").select("doc_id", "page", F.col("idx").alias("table_idx"), "x0", "y0", "x1", "y1", "rows")
    images = kind("image").select("doc_id", "page", F.col("idx").alias("image_idx"))
    none = F.lit(None).cast("string")
    texts = kind("text")
    whole = texts.select("doc_id", F.lit(0).alias("element_seq"), F.lit("text").alias("element_type"), F.col("text").alias("content"), F.lit(1).alias("page_number"), none.alias("section_title"), none.alias("table_title"), none.alias("figure_title"))
    elements = cut(elements_of(lines, blocks, tables, images).unionByName(whole))
    from tabulora.operators.elements import merged_text

    merged = merged_text(elements.join(texts.select("doc_id"), "doc_id", "left_anti")).unionByName(texts.select("doc_id", "text"))
    names = rows.where("kind <> 'error'").select(F.col("source").alias("doc_id"), "title", "doc_type").distinct()
    documents = names.join(merged, "doc_id", "left").select(F.col("doc_id").alias("source"), "title", "doc_type", F.coalesce("text", F.lit("")).alias("text"))
    return documents, elements.withColumnRenamed("doc_id", "source"), rows.where("kind = 'error'").select("source", "error")
