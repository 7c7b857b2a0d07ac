"""Passages out of elements: greedy packing of text, row groups of tables, labels and prefixes.

Packing depends on what was packed before, so it is a fold. A run is what a document has between two tables or images; its
paragraphs come to one task in order and are packed as they pass, with the open passage as the only state.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tabulora.functions.text import SPACE, _col, collapse, has_all, has_any, join_parts, lines, strip
from tabulora.plans import rules

#: Characters of a passage, of one in a key section; rows and characters of a table in one piece.
TEXT, KEY_TEXT, ROWS, TABLE, HEAD = 420, 520, 12, 1400, 4


def limit_of(section) -> Column:
    return F.when(has_any(F.coalesce(_col(section), F.lit("")), rules.KEY_SECTIONS), KEY_TEXT).otherwise(TEXT)


# ---------------------------------------------------------------- packing
def _pack(units: Iterable[tuple[str, bool]], most: int, between: str) -> list[str]:
    """Joins units (text, hard) while they fit; a hard unit stands alone."""
    done, held, size = [], [], 0
    for text, hard in units:
        joined = size + len(between) + len(text) if held else len(text)
        if held and (hard or joined > most):
            done.append(between.join(held))
            held, joined = [], len(text)
        if hard:
            done.append(text)
        elif text or held:
            held.append(text)
            size = joined
    return [*done, between.join(held)] if held else done


def _split(text: str, marks: str) -> Iterator[str]:
    for part in re.split(rf"(?<=[{marks}])\s*", text):
        if part := part.strip():
            yield part


def _clauses(sentence: str, most: int) -> list[str]:
    """A sentence that is too long, packed by clauses; a clause that is too long in equal pieces."""

    def units() -> Iterator[tuple[str, bool]]:
        for clause in _split(sentence, "，、：:,"):
            if len(clause) > most:
                yield from ((clause[k : k + most], True) for k in range(0, len(clause), most))
            else:
                yield clause, False

    return _pack(units(), most, "")


def units_of(paragraph: str, most: int) -> list[str]:
    """A paragraph as units of at most `most` characters: whole, by sentences, by clauses, in pieces."""
    if len(paragraph) <= most:
        return [paragraph] if paragraph else []

    def units() -> Iterator[tuple[str, bool]]:
        for sentence in _split(paragraph, "。！？；;"):
            if len(sentence) > most:
                yield from ((c, True) for c in _clauses(sentence, most))
            else:
                yield sentence, False

    return _pack(units(), most, " ") or [paragraph]


def text_units(text, most: Column) -> Column:
    """The units of a paragraph as a Column."""

    def run(paragraphs: pd.Series, limits: pd.Series) -> pd.Series:
        return pd.Series([units_of(p or "", int(m)) for p, m in zip(paragraphs, limits, strict=True)])

    return F.pandas_udf(run, "array<string>")(collapse(text), most)


class _Run:
    """The passage that is being filled. A new section ends it, but the page stays that of the first paragraph since the
    last passage that was full."""

    def __init__(self):
        self.held, self.size, self.section, self.page, self.part = [], 0, None, None, 0

    def _end(self, section, page) -> tuple:
        out = (self.part, section, page, "\n".join(self.held))
        self.held, self.size, self.part = [], 0, self.part + 1
        return out

    def add(self, paragraph: str, section: str | None, page: int | None, most: int) -> Iterator[tuple]:
        for i, unit in enumerate(units_of(paragraph, most)):
            if not i and self.held and self.section is not None and section is not None and self.section != section:
                yield self._end(self.section, self.page)
            self.page = self.page or page
            joined = self.size + 1 + len(unit) if self.held else len(unit)
            if self.held and joined > most:
                yield self._end(section, self.page)
                self.page, joined = page, len(unit)
            self.held.append(unit)
            self.size, self.section = joined, section

    def end(self) -> Iterator[tuple]:
        if self.held:
            yield self._end(self.section, self.page)


#: Passages that a task holds before it hands them on.
HELD = 2000


def _packed(names: list[str]):
    """Passages of sorted paragraphs (doc_id, run, seq, section, page, most, text), one run after the other."""

    def run(batches):
        import pyarrow as pa

        key, state, rows = None, _Run(), []

        def batch():
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        types = None
        for rb in batches:
            types = types or [rb.schema.field("doc_id").type, rb.schema.field("seq").type, pa.int32(), pa.string(), pa.int32(), pa.string()]
            for d, r, seq, section, page, most, text in zip(*[rb.column(c).to_pylist() for c in ("doc_id", "run", "seq", "section", "page", "most", "text")], strict=True):
                if key is None or (d, r) != key[:2]:
                    rows += [(key[0], key[2], *p) for p in state.end()] if key else []
                    key, state = (d, r, seq), _Run()
                rows += [(d, key[2], *p) for p in state.add(text, section, page, most)]
                if len(rows) >= HELD:
                    yield batch()
                    rows = []
        if key:
            rows += [(key[0], key[2], *p) for p in state.end()]
        if rows:
            yield batch()

    return run


def packed_runs(text: DataFrame) -> DataFrame:
    """(doc_id, seq, part, section, page, content): passages of paragraphs (doc_id, run, element_seq, section, page_number,
    content). A run's paragraphs are read in order from sorted rows, so none is gathered into one row or one list."""
    rows = text.select("doc_id", "run", F.col("element_seq").alias("seq"), "section", F.col("page_number").cast("int").alias("page"), limit_of("section").cast("int").alias("most"), collapse("content").alias("text"))
    rows = rows.repartition("doc_id", "run").sortWithinPartitions("doc_id", "run", "seq")
    kind = lambda c: rows.schema[c].dataType
    schema = StructType([StructField("doc_id", kind("doc_id")), StructField("seq", kind("seq")), StructField("part", IntegerType()), StructField("section", StringType()), StructField("page", IntegerType()), StructField("content", StringType())])
    return rows.mapInArrow(_packed(schema.names), schema)


def table_label(text, section, title) -> Column:
    """The statement that a table is, by its words, or null."""
    all_of = F.regexp_replace(join_parts([_col(section), _col(title), _col(text)]), rf"(?U){SPACE}+", "")
    income = has_any(all_of, ["营业总收入", "营业收入"]) & has_any(all_of, ["营业利润", "利润总额", "净利润"])
    return (
        F.when(has_any(all_of, rules.SUMMARY), "主要会计数据和财务指标")
        .when(has_all(all_of, ["经营活动产生的现金流量", "投资活动产生的现金流量"]) | F.contains(all_of, F.lit("现金及现金等价物净增加额")), "合并现金流量表")
        .when(has_all(all_of, ["流动资产", "非流动资产"]) | has_all(all_of, ["资产总计", "负债合计"]), "合并资产负债表")
        .when(income, "合并利润表")
    )


def _bars(row: Column) -> Column:
    return F.regexp_count(row, F.lit(r"\|"))


def header_size(rows) -> Column:
    """One header row, or two if the second has almost as many cells; one in tables of two rows."""
    rows = _col(rows)
    first, second = F.try_element_at(rows, F.lit(1)), F.try_element_at(rows, F.lit(2))
    return F.when((F.size(rows) > 2) & (_bars(second) >= _bars(first) - 1), 2).otherwise(1)


def table_pieces(tables: DataFrame) -> DataFrame:
    """tables (…, content, table_title) with `piece` (0: whole or overview, then row groups), `title` and `text`.

    A large table gives an overview and, for each ROWS body rows, a piece that repeats the header.
    """
    rows = tables.withColumn("_r", lines("content")).where("size(_r) > 0").withColumn("_h", header_size("_r"))
    rows = rows.withColumn("_head", F.slice("_r", F.lit(1), F.col("_h"))).withColumn("_body", F.slice("_r", F.col("_h") + 1, F.greatest(F.size("_r") - F.col("_h"), F.lit(0))))
    large = (F.size("_r") > ROWS) | (F.length("content") > TABLE)
    n = F.size("_body")
    more = F.concat(F.lit("... total_rows="), n.cast("string"), F.lit(f" grouped_rows_per_chunk={ROWS}"))
    overview = F.concat(F.col("_head"), F.slice("_body", 1, HEAD), F.when(n > HEAD, F.array(more)).otherwise(F.array().cast("array<string>")))
    piece = lambda no, title, text: F.struct(no.cast("int").alias("piece"), title.alias("title"), text.alias("text"))
    title = F.col("table_title")

    def group(g: Column) -> Column:
        named = F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit(" 行组"), (g + 1).cast("string"))).otherwise(title)
        return piece(g + 1, named, F.array_join(F.concat(F.col("_head"), F.slice("_body", g * ROWS + 1, ROWS)), "\n"))

    groups = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.ceil(F.greatest(n, F.lit(1)) / ROWS).cast("int") - 1), group)).otherwise(F.array().cast("array<struct<piece:int,title:string,text:string>>"))
    whole = F.array(piece(F.lit(0), title, F.col("content")))
    pieces = F.when(large, F.concat(F.array(piece(F.lit(0), title, F.array_join(overview, "\n"))), groups)).otherwise(whole)
    return rows.withColumn("_p", F.explode(pieces)).select(*tables.columns, "_p.*")


def finished(kind, section, title, page, content) -> Column:
    """A passage's final text: a table with its title and label, a short answer with its page and section."""
    kind, section, title, page = _col(kind), _col(section), _col(title), _col(page)
    text, is_table = strip(content), kind == "table"
    text = F.when(is_table & (F.coalesce(title, F.lit("")) != "") & ~F.contains(text, title), F.concat(title, F.lit("\n"), text)).otherwise(text)
    label = table_label(text, section, title)
    text = F.when(is_table & label.isNotNull() & ~F.contains(text, label), F.concat(label, F.lit("\n"), text)).otherwise(text)
    named = F.coalesce(section, F.lit(""))
    bare = text.isin(rules.SHORT_ANSWERS) | (F.length(named) >= 20) | ~has_any(text, ["。", "！", "？", "；"])
    short = (kind == "text") & (named != "") & (F.length(text) < 80) & ~F.startswith(text, named) & bare
    mark = F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit("[第"), page.cast("string"), F.lit("页]")))
    return F.when(short, join_parts([mark, named, text])).otherwise(text)


def split_elements(elements: DataFrame) -> DataFrame:
    """Passages (doc_id, chunk_index, chunk_type, section_title, table_title, figure_title, page_number, content,
    token_count) of elements (doc_id, element_seq, element_type, content, page_number, section_title, table_title,
    figure_title)."""
    rows = elements.where(strip("content") != "")
    order = Window.partitionBy("doc_id").orderBy("element_seq")
    rows = rows.withColumn("run", F.sum((F.col("element_type") != "text").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    named = F.last(F.nullif("section_title", F.lit("")), ignorenulls=True).over(Window.partitionBy("doc_id", "run").orderBy("element_seq").rowsBetween(Window.unboundedPreceding, 0))
    text = rows.where("element_type = 'text'").withColumn("section", named)
    text = packed_runs(text)
    none = F.lit(None).cast("string")
    text = text.select("doc_id", "seq", "part", F.lit("text").alias("chunk_type"), F.col("section").alias("section_title"), none.alias("table_title"), none.alias("figure_title"), F.col("page").alias("page_number"), "content")
    keep = ["doc_id", F.col("element_seq").alias("seq")]
    tables = table_pieces(rows.where("element_type = 'table'"))
    tables = tables.select(*keep, F.col("piece").alias("part"), F.col("element_type").alias("chunk_type"), "section_title", F.col("title").alias("table_title"), "figure_title", F.col("page_number").cast("int"), F.col("text").alias("content"))
    other = rows.where("element_type not in ('text', 'table')")
    other = other.select(*keep, F.lit(0).alias("part"), F.col("element_type").alias("chunk_type"), "section_title", "table_title", "figure_title", F.col("page_number").cast("int"), "content")
    every = text.unionByName(tables).unionByName(other)
    final = finished("chunk_type", "section_title", "table_title", "page_number", "content")
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "part")) - 1
    every = every.withColumn("content", final).withColumn("chunk_index", index)
    return every.select("doc_id", "chunk_index", "chunk_type", "section_title", "table_title", "figure_title", "page_number", "content", F.length("content").alias("token_count"))
