"""Tokens for lexical search and for feature hashing, Latin and CJK."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulora.functions.text import _col, join_parts

#: Tokens that carry no meaning in reports (fixed values).
STOP = ["公司", "什么", "情况", "是否", "以及", "其中", "有关", "进行", "根据", "关于", "主要", "本期", "期末", "期初"]
#: Fields of a passage before its content, in the order in which they are searched.
FIELDS = ["title", "company", "ticker", "section_title", "table_title", "figure_title"]


def passage_text(content="content", **fields) -> Column:
    """The passage's fields and content that are not empty, one to a line."""
    parts = [_col(fields.get(f, f)) for f in FIELDS]
    return join_parts([*parts, _col(content)])


def simple_tokens(s) -> Column:
    """Latin words, then single CJK characters."""
    s = _col(s)
    return F.concat(F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9]+"), F.lit(0)), F.regexp_extract_all(s, F.lit("[一-鿿]"), F.lit(0)))


def lexical_tokens(s) -> Column:
    """Latin words with inner marks, then for each CJK run the run itself (up to 4), its pairs and its triples. Texts
    without CJK skip the second part; no stop word is Latin."""
    text, none = F.lower(_col(s)), F.array().cast("array<string>")
    latin = F.regexp_extract_all(text, F.lit("[a-z0-9][a-z0-9._/-]*"), F.lit(0))
    runs = F.filter(F.regexp_extract_all(text, F.lit("[一-鿿]+"), F.lit(0)), lambda r: F.length(r) > 1)

    def grams(r: Column, n: int) -> Column:
        at = F.sequence(F.lit(1), F.length(r) - (n - 1))
        return F.when(F.length(r) >= n, F.transform(at, lambda i: F.substring(r, i, F.lit(n)))).otherwise(none)

    def of(r: Column) -> Column:
        whole = F.when(F.length(r) <= 4, F.array(r)).otherwise(none)
        return F.concat(whole, grams(r, 2), grams(r, 3))

    cjk = F.filter(F.flatten(F.transform(runs, of)), lambda t: ~t.isin(STOP))
    return F.concat(latin, F.when(text.rlike("[一-鿿]"), cjk).otherwise(F.when(text.isNotNull(), none)))
