"""Files as documents and elements, report listings, stock lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulora.functions.text import collapse, strip

LINES = "path string, page int, seq int, y double, text string"


def read_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """(source, title, doc_type, text) of text, Markdown and HTML files (tags stay), and of any other but PDF.

    Bytes that are not UTF-8 are replaced. A file is one row; files are read by the executors.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    rows = rows.select(F.col("path").alias("source"), F.regexp_replace(name, r"\.[^.]*$", "").alias("title"), F.when(suffix == "", "unknown").otherwise(suffix).alias("doc_type"), "content")
    return rows.where("doc_type <> 'pdf'").select("source", "title", "doc_type", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def text_elements(documents: DataFrame) -> DataFrame:
    """A text document is one element on page 1."""
    none = F.lit(None).cast("string")
    return documents.select("source", F.lit(0).alias("element_seq"), F.lit("text").alias("element_type"), F.col("text").alias("content"), F.lit(1).alias("page_number"), none.alias("section_title"), none.alias("table_title"), none.alias("figure_title"))


def pdf_lines(spark: SparkSession, backend: Callable[[str, bytes], Iterator[tuple]], *paths: str) -> DataFrame:
    """(path, page, seq, y, text) of PDF files by a backend that yields (page, seq, y, text) for a file's bytes.

    The backend runs on the executors, one file at a time; the engine comes without one.
    """

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = [(p, *line) for p, raw in zip(pdf["path"], pdf["content"], strict=True) for line in backend(p, raw)]
            yield pd.DataFrame(rows, columns=["path", "page", "seq", "y", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(list(paths))
    return files.select("path", "content").mapInPandas(run, LINES).withColumn("text", collapse("text")).where("text <> ''")


def stock_list(spark: SparkSession, path: str) -> DataFrame:
    """(stock): lines that are neither empty nor comments."""
    return spark.read.text(path).select(strip("value").alias("stock")).where("stock <> '' and not startswith(stock, '#')")


def latest_quarterly(files: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """(code, path) of the newest report of files (path) whose names end in _Q1报.pdf or _Q3报.pdf, by the first year that
    the name holds and the quarter. The code is the six digits at the name's start, or empty."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    quarter = F.regexp_extract(name, r"_Q([13])报\.pdf$", 1)
    rows = files.where(quarter != "").select("path", F.regexp_extract(name, r"^(\d{6})", 1).alias("code"), F.struct(F.regexp_extract(name, r"(20\d{2})", 1).alias("y"), quarter.alias("q"), "path").alias("k"))
    rows = rows if codes is None else rows.join(codes, "code", "left_semi")
    return rows.groupBy("code").agg(F.max_by("path", "k").alias("path"))


def industry_map(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, industry) of a JSON object."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return raw.select(F.explode("m").alias("ticker", "industry"))
