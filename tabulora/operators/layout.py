"""Layout of pages: sections before tables, captions, overlaps of blocks and tables, titles that carry on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulora.functions.text import _col, let, lines, settle, strip
from tabulora.operators.clean import figure_caption, heading, is_report_title, is_row_heading, is_section_heading, is_toc_line, is_weak_title, title_candidate, titles
from tabulora.operators.scan import carry


def overlap(a: str = "b", t: str = "t") -> Column:
    """Share of rectangle a's area (1 at least) that rectangle t covers; columns are prefixed with their names."""
    wide = F.greatest(F.lit(0.0), F.least(F.col(f"{a}_x1"), F.col(f"{t}_x1")) - F.greatest(F.col(f"{a}_x0"), F.col(f"{t}_x0")))
    high = F.greatest(F.lit(0.0), F.least(F.col(f"{a}_y1"), F.col(f"{t}_y1")) - F.greatest(F.col(f"{a}_y0"), F.col(f"{t}_y0")))
    area = F.greatest((F.col(f"{a}_x1") - F.col(f"{a}_x0")) * (F.col(f"{a}_y1") - F.col(f"{a}_y0")), F.lit(1.0))
    return F.when((wide > 0) & (high > 0), wide * high / area).otherwise(F.lit(0.0))


def _boxes(df: DataFrame, name: str) -> DataFrame:
    return df.select("doc_id", "page", *[F.col(c).alias(f"{name}_{c}") for c in ("x0", "y0", "x1", "y1")])


def blocks_outside_tables(blocks: DataFrame, tables: DataFrame, least: float = 0.35) -> DataFrame:
    """Blocks that no table of their page covers by `least` of their area: an anti-join on the page and the overlap."""
    b = blocks.select("*", *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    t = _boxes(tables, "t").withColumnsRenamed({"doc_id": "t_doc", "page": "t_page"})
    on = (F.col("doc_id") == F.col("t_doc")) & (F.col("page") == F.col("t_page")) & (overlap() >= least)
    return b.join(t, on, "left_anti").drop("b_x0", "b_y0", "b_x1", "b_y1")


def page_texts(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, page, text): blocks outside tables from top to bottom and left to right."""
    kept = blocks_outside_tables(blocks, tables).withColumn("text", strip("text")).where("text <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("y0", "x0", "block_id", "text")))
    return kept.groupBy("doc_id", "page").agg(F.array_join(F.transform(ordered, lambda b: b.text), "\n").alias("text"))


def table_text(rows) -> Column:
    """Cells joined by a bar, rows without any cell left out."""
    cells = F.transform(_col(rows), lambda r: F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))))
    full = F.filter(cells, lambda r: F.exists(r, lambda c: c != ""))
    return F.array_join(F.transform(full, lambda r: F.array_join(r, " | ")), "\n")


def inferred_title(text) -> Column:
    """The first cell of a table's text as a title, or empty."""
    def of(first: Column) -> Column:
        return let(strip(F.element_at(F.split(first, r"\|", 2), 1)), lambda cell: F.coalesce(title_candidate(F.when(cell != "", cell).otherwise(first)), F.lit("")))

    return let(F.coalesce(F.try_element_at(lines(text), F.lit(1)), F.lit("")), of)


def marked(page_lines: DataFrame) -> DataFrame:
    """page_lines with `toc` (a line of contents) and `mark` (the heading that the line is, or null), unless they are there:
    who asks a page's lines several times has them marked once."""
    if {"toc", "mark"} <= set(page_lines.columns):
        return page_lines
    return settle(page_lines, toc=is_toc_line("text"), mark=F.when(is_section_heading("text"), heading("text")))


def sections_before(page_lines: DataFrame, tables: DataFrame, fallback: str | None = None) -> DataFrame:
    """tables with `section`: the last heading of the page at or above the table's top, else the fallback column.

    A backward as-of join as one sorted pass: tables and headings of a page are united, and the last heading is carried
    down. A table's own row sorts after headings of the same height. Tables pass through whole, so they are read once.
    """
    own = F.struct(*tables.columns).alias("_t")
    rows = tables.select("doc_id", "page", F.col("y0").alias("y"), F.lit(0).alias("seq"), F.lit(None).cast("string").alias("mark"), F.lit(1).alias("kind"), own)
    none = F.lit(None).cast(rows.schema["_t"].dataType).alias("_t")
    marks = marked(page_lines).where("mark is not null").select("doc_id", "page", "y", "seq", "mark", F.lit(0).alias("kind"), none)
    order = Window.partitionBy("doc_id", "page").orderBy("y", "kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    last = F.when(F.col("doc_id").isNotNull() & F.col("page").isNotNull(), F.last("mark", ignorenulls=True).over(order))
    out = marks.unionByName(rows).withColumn("found", last).where("kind = 1").select("_t.*", "found")
    if fallback:
        out = out.withColumn("found", F.coalesce("found", F.when(~is_row_heading(fallback), F.col(fallback))))
    return out.withColumnRenamed("found", "section")


def page_sections(page_lines: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, page, section): the first heading among the 40 first lines, above the first table by 6 points."""
    tops = tables.where("y0 > 0").groupBy("doc_id", "page").agg(F.min("y0").alias("top"))
    rows = marked(page_lines).join(tops, ["doc_id", "page"], "left").where("top is null or y < top - 6")
    order = Window.partitionBy("doc_id", "page").orderBy("y", "seq")
    rows = rows.withColumn("n", F.row_number().over(order)).where("n <= 40").where("not toc and mark is not null")
    return rows.groupBy("doc_id", "page").agg(F.min_by("mark", "n").alias("section"))


def captions_before(page_lines: DataFrame, tables: DataFrame, reach: float = 90.0) -> DataFrame:
    """(doc_id, page, table_idx, caption): the nearest usable line at most `reach` above a table, below any heading.

    Lines and tables of a page meet by an equi-join on the page; what is in reach is a fixed stretch of it.
    """
    t = tables.select("doc_id", "page", "table_idx", F.col("y0").alias("top"))
    near = marked(page_lines).join(t, ["doc_id", "page"]).where(F.col("y") < F.col("top")).where(F.col("top") - F.col("y") <= reach)
    near = near.where(~(F.col("toc") | is_report_title("text")))
    near = settle(near, stops=F.col("mark").isNotNull(), t=title_candidate("text"))
    usable = ~F.col("stops") & (F.col("t") != "") & ~is_weak_title("t")
    place = F.struct("y", "seq")
    best = near.groupBy("doc_id", "page", "table_idx").agg(F.max(F.when(F.col("stops"), place)).alias("stop"), F.max(F.when(usable, F.struct("y", "seq", "t"))).alias("use"))
    below = F.col("stop").isNull() | (F.struct("use.y", "use.seq") > F.col("stop"))
    return best.where(F.col("use").isNotNull() & below).select("doc_id", "page", "table_idx", F.col("use.t").alias("caption"))


def table_title(explicit, caption, inferred, section, page, index, top) -> Column:
    """The first strong one of explicit, caption and inferred title, else one made of section, page and index."""
    strong = [let(title_candidate(F.coalesce(_col(c), F.lit(""))), lambda t: F.when((t != "") & ~is_weak_title(t), t)) for c in (explicit, caption, inferred)]
    made = F.concat(F.lit("第"), _col(page).cast("string"), F.lit("页表"), _col(index).cast("string"))
    named = F.coalesce(_col(section), F.lit(""))
    out = F.when((named != "") & ~is_row_heading(named) & ~is_weak_title(named), F.concat(named, F.lit(" "), made))
    return F.coalesce(*strong, out.when(_col(top) <= 110, F.lit("")).otherwise(made))


def steady_titles(tables: DataFrame, pages: int = 256) -> DataFrame:
    """Weak titles replaced by the last strong one of the section, else of the document, marked as continued.

    The strong titles are those of the rows themselves, so both carry-forwards are scans over the page order, by blocks of
    pages.
    """
    rows = tables.withColumn("_s", F.when(~is_weak_title("table_title"), F.col("table_title"))).withColumn("_k", F.coalesce(F.nullif("section", F.lit("")), F.lit("__default__")))
    order, block = ["page", "table_idx"], F.floor(F.col("page") / pages)
    rows = carry(rows, ["doc_id", "_k"], order, block, last={"_in": F.col("_s")})
    rows = carry(rows, ["doc_id"], order, block, last={"_any": F.col("_s")})
    title = F.coalesce("_s", F.concat(F.coalesce("_in", "_any"), F.lit("（续）")), "table_title")
    return rows.withColumn("table_title", title).drop("_s", "_k", "_in", "_any")


def tail_sections(tables: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, page, section) that holds after each page: the last usable table section, else the page's own, carried
    over pages without any."""
    usable = F.when(~is_row_heading("section"), F.struct("table_idx", F.col("section").alias("s")))
    last = tables.where("section is not null").groupBy("doc_id", "page").agg(F.max(usable).alias("m")).select("doc_id", "page", F.col("m.s").alias("of_table"))
    both = sections.join(last, ["doc_id", "page"], "full")
    order = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return both.select("doc_id", "page", F.last(F.coalesce("of_table", "section"), ignorenulls=True).over(order).alias("section"))


def image_elements(images: DataFrame, page_lines: DataFrame) -> DataFrame:
    """(doc_id, page, image_idx, content, figure_title) of images (doc_id, page, image_idx), captioned by their order."""
    every = F.array_sort(F.collect_list(F.struct("y", "seq", "text")))
    of_page = page_lines.groupBy("doc_id", "page").agg(F.transform(every, lambda x: x.text).alias("l"))
    rows = images.join(of_page, ["doc_id", "page"], "left").withColumn("l", F.coalesce("l", F.array().cast("array<string>")))
    title = F.coalesce(F.try_element_at(titles("l", "图"), F.col("image_idx")), figure_caption(F.array_join("l", "\n")))
    page, index = F.col("page").cast("string"), F.col("image_idx").cast("string")
    content = F.coalesce(title, F.concat(F.lit("Image block detected on page "), page, F.lit(".")))
    return rows.select("doc_id", "page", "image_idx", content.alias("content"), F.coalesce(title, F.concat(F.lit("Figure "), index, F.lit(" on page "), page)).alias("figure_title"))


