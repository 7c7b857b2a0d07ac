"""Numbers in report lines: tokens, values, units, percentages, footnotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulora.functions.text import _col, strip

#: A number with thousands separators; with brackets it is negative (fixed patterns).
PLAIN = r"-?[0-9][0-9,]*(?:\.\d+)?"
TOKEN = r"[\(（]-?[0-9][0-9,]*(?:\.\d+)?[\)）]|-?[0-9][0-9,]*(?:\.\d+)?"
FOOTNOTES = ["(1)", "（1）", "(2)", "（2）", "(3)", "（3）", "(4)", "（4）"]
#: Units, the more specific first (fixed values).
UNITS = [("百万元", 1_000_000.0), ("亿元", 100_000_000.0), ("万元", 10_000.0), ("千元", 1_000.0)]


def tokens(s) -> Column:
    return F.regexp_extract_all(_col(s), F.lit(TOKEN), F.lit(0))


def plain_tokens(s) -> Column:
    return F.regexp_extract_all(_col(s), F.lit(PLAIN), F.lit(0))


def value(s) -> Column:
    """A token's number, or null; brackets of either width make it negative."""
    bare = strip(F.regexp_replace(_col(s), ",", ""))
    inner = F.regexp_extract(bare, r"^(?:\((.*)\)|（(.*)）)$", 1)
    wide = F.regexp_extract(bare, r"^（(.*)）$", 1)
    narrow = F.when(inner != "", inner).when(wide != "", wide)
    text = F.coalesce(strip(narrow), bare)
    return F.when(narrow.isNotNull(), -text.try_cast("double")).otherwise(text.try_cast("double"))


def change(candidates) -> Column:
    """The first number of at most 1000, taken for a change in percent."""
    values = F.transform(_col(candidates), value)
    return F.try_element_at(F.filter(values, lambda x: x.isNotNull() & (F.abs(x) <= 1000)), F.lit(1))


def multiplier(unit, unknown: float | None = 1.0) -> Column:
    """Yuan for one of the unit; a null unit and one without any known part give `unknown`."""
    compact = F.replace(_col(unit), F.lit(" "), F.lit(""))
    out = F.when(compact.isNull() | (compact == ""), F.lit(unknown).cast("double"))
    for name, factor in UNITS:
        out = out.when(F.contains(compact, F.lit(name)), F.lit(factor))
    if unknown is None:
        out = out.when(F.contains(compact, F.lit("元")), F.lit(1.0))
    return out.otherwise(F.lit(unknown).cast("double"))


def formatted(x) -> Column:
    """#,##0.00, without a fraction of zero."""
    return F.regexp_replace(F.format_number(_col(x), 2), r"\.00$", "")


def _digit(first: Column) -> Column:
    return F.coalesce(first.rlike("^[0-9]+$"), F.lit(False)) & (F.coalesce(first.try_cast("bigint"), F.lit(99)) <= 9)


def _rest(values: Column) -> Column:
    return F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))


def without_footnote(source, values) -> Column:
    """Drops a leading note number such as (1), or a digit that the text puts in brackets at its start."""
    source, values = strip(source), _col(values)
    first = F.try_element_at(values, F.lit(1))
    bracketed = F.lit(False)
    for form in ("({})", "（{}）", "{}（", "{}("):
        head, tail = form.split("{}")
        bracketed = bracketed | F.startswith(source, F.concat(F.lit(head), first, F.lit(tail)))
    note = first.isin(FOOTNOTES) | (_digit(first) & bracketed)
    return F.when((F.size(values) > 0) & note, _rest(values)).otherwise(values)


def without_eps_footnote(source, term: Column, values) -> Column:
    """Drops a note number that follows the term at once."""
    source, values = strip(source), _col(values)
    first = F.try_element_at(values, F.lit(1))
    suffix = F.regexp_replace(F.substring(source, F.length(term) + 1, F.lit(1 << 30)), r"(?U)^[\s\x1c-\x1f]+", "")
    note = first.isin(FOOTNOTES) | (_digit(first) & F.startswith(suffix, first))
    at = F.startswith(source, term) & (F.size(values) > 0) & (suffix != "")
    return F.when(at & note, _rest(values)).otherwise(values)


def without_leading_digit(values) -> Column:
    """Drops a first token of one digit where others follow."""
    values = _col(values)
    first = F.try_element_at(values, F.lit(1))
    return F.when((F.size(values) >= 2) & _digit(first), _rest(values)).otherwise(values)
