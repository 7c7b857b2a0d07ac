"""Elements of documents out of the lines, blocks, tables and images of their pages.

Three states run from page to page of a document: the section, the last title of each section's tables and the last
title at all. A page's own headings decide its section where it has any; else the section goes on. Instead of a loop
over pages, each page says what it hands on: a section that holds whatever came before, or one that holds only if
nothing came before. Both are scans by document (see scan.carry), as are the titles.

Inputs: lines (doc_id, page, y, seq, text), blocks (doc_id, page, block_id, x0, y0, x1, y1, text), tables (doc_id, page,
table_idx, x0, y0, x1, y1, rows: an array of arrays of cells), images (doc_id, page, image_idx). Numbers of tables and
images count from 1 on each page. Further columns are not looked at.

Defined results: pages without anything do not matter; a null text, cell or box is an empty one; a table without any cell
gives no element but keeps its number; pages of contents give neither text nor tables, but images.

Rows that several steps read (joined lines, tables with their headings, the sections of pages, titles) are packed once and
go when the elements are packed, which are then numbered: what a step takes of the disk does not add up over the steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulora.cut import packed, shared_folder
from tabulora.functions.text import collapse
from tabulora.operators import clean, layout
from tabulora.operators.scan import carry, numbered

#: Pages of a block of the scans: documents of fewer pages are one block.
PAGES = 256


def page_states(pages: DataFrame, headed: DataFrame, own: DataFrame) -> DataFrame:
    """(doc_id, page, section): the section that holds on each page. pages: all pages; headed: (doc_id, page, table_idx,
    found) of the tables with their own headings; own: (doc_id, page, section) of the pages' own headings."""
    last = F.max(F.when(F.col("found").isNotNull(), F.struct("table_idx", F.col("found").alias("h"))))
    bare = F.max(F.when(F.col("found").isNull(), F.col("table_idx")))
    of_tables = headed.groupBy("doc_id", "page").agg(last.alias("last"), bare.alias("bare"))
    rows = pages.join(own.withColumnRenamed("section", "own"), ["doc_id", "page"], "left").join(of_tables, ["doc_id", "page"], "left")
    # the last table has a heading of its own: that holds from here on; else the page's section does, if it has one
    sure = F.when(F.col("last").isNotNull() & (F.col("last.table_idx") > F.coalesce("bare", F.lit(-1))), F.col("last.h"))
    rows = carry(rows, ["doc_id"], ["page"], F.floor(F.col("page") / PAGES), last={"sure": F.coalesce(sure, "own")}, first={"spare": F.when(F.coalesce(sure, "own").isNull(), F.col("last.h"))})
    return rows.select("doc_id", "page", F.coalesce("own", "sure", "spare").alias("section"))


def table_elements(rows: DataFrame, tables: DataFrame, states: DataFrame, headed: DataFrame, pack: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, page, table_idx, content, section, table_title) of tables with content. pack: writes rows for several steps."""
    numbers = Window.partitionBy("doc_id", "page").orderBy("y", "seq")
    named = rows.where(F.startswith("text", F.lit("表")) & (F.length("text") <= 120)).select("doc_id", "page", "text", F.row_number().over(numbers).alias("table_idx"))
    named = named.withColumnRenamed("text", "explicit")
    t = headed.join(states.withColumnRenamed("section", "state"), ["doc_id", "page"], "left").join(named, ["doc_id", "page", "table_idx"], "left")
    t = t.join(layout.captions_before(rows, tables), ["doc_id", "page", "table_idx"], "left").withColumn("section", F.coalesce("found", "state"))
    title = layout.table_title("explicit", "caption", layout.inferred_title("content"), "section", "page", "table_idx", F.col("y0"))
    names = ["doc_id", "page", "table_idx", "content", "section", "table_title"]
    return layout.steady_titles(pack(t.withColumn("table_title", title).select(*names))).select(*names)


def elements_of(lines: DataFrame, blocks: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, element_seq, element_type, content, page_number, section_title, table_title, figure_title): on each page its
    text, then tables, then images."""
    with shared_folder(lines.sparkSession, "elements") as at:
        out = packed(_placed(lines, blocks, tables, images, at)).hint("merge")
    out = numbered(out, ["doc_id"], ["page", "kind", "idx"], F.floor(F.col("page") / PAGES), "element_seq")
    return out.select("doc_id", F.col("element_seq").cast("int").alias("element_seq"), "element_type", "content", F.col("page").alias("page_number"), F.col("section").alias("section_title"), "table_title", "figure_title")


def _placed(lines: DataFrame, blocks: DataFrame, tables: DataFrame, images: DataFrame, at: str) -> DataFrame:
    """Elements with their place: page, kind (0: text, 1: table, 2: image) and number on the page. at: a folder for what several
    steps read."""
    # Spark sizes packed rows by their files and would broadcast far more than it takes them for: merge joins are asked for
    pack = lambda df: packed(df, at).hint("merge")
    rows = pack(layout.marked(clean.glued_lines(lines.select("doc_id", "page", "y", "seq", "text"))))
    place = ["doc_id", "page"]
    pages = lines.select(*place).union(blocks.select(*place)).union(tables.select(*place)).union(images.select(*place)).distinct()
    toc = clean.toc_pages(rows, "toc")
    full = tables.select(*place, "table_idx", F.coalesce("y0", F.lit(0.0)).alias("y0"), layout.table_text(F.coalesce("rows", F.array().cast("array<array<string>>"))).alias("content"))
    full = full.where("content <> ''").join(toc, place, "left_anti")
    full = headed = pack(layout.sections_before(rows, full).withColumnRenamed("section", "found"))
    tops = tables.select(*place, F.coalesce("y0", F.lit(0.0)).alias("y0"))
    states = pack(page_states(pages, headed, layout.page_sections(rows, tops)))

    texts = layout.page_texts(blocks, tables).join(toc, place, "left_anti").join(states, place, "left")
    none = F.lit(None).cast("string")
    out = texts.select(*place, F.lit(0).alias("kind"), F.lit(0).alias("idx"), F.lit("text").alias("element_type"), F.col("text").alias("content"), "section", none.alias("table_title"), none.alias("figure_title"))
    with shared_folder(lines.sparkSession, "tables") as own:
        of_tables = pack(table_elements(rows, full, states, headed, lambda df: packed(df, own).hint("merge")))
    out = out.union(of_tables.select(*place, F.lit(1), "table_idx", F.lit("table"), "content", "section", "table_title", none))
    shown = layout.image_elements(images, rows).join(states, place, "left")
    return out.union(shown.select(*place, F.lit(2), "image_idx", F.lit("image"), "content", "section", none, "figure_title"))


def merged_text(elements: DataFrame) -> DataFrame:
    """(doc_id, text): the texts of a document's text elements, in order, an empty line between two."""
    kept = elements.where("element_type = 'text' and content is not null").where(collapse("content") != "")
    every = F.array_sort(F.collect_list(F.struct("element_seq", "content")))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(every, lambda e: e.content), "\n\n").alias("text"))
