"""Text as Unicode text: white space, lines and containment, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script and the separators of the C0 block; plain \s and trim() know ASCII only.
SPACE = r"[\s\x1c-\x1f]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it: an expression is otherwise copied to each place."""
    return F.element_at(F.transform(F.array(_col(x)), f), 1)


def strip(s) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_col(s), rf"(?U)^{SPACE}+|{SPACE}+$", "")


def strip_chars(s, chars: str) -> Column:
    """Without any of these characters at both ends."""
    return F.trim(_col(s), F.lit(chars))


def collapse(s) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(s), rf"(?U){SPACE}+", " "))


def squeeze(s) -> Column:
    """All white space removed, lower case: the form in which phrases are compared."""
    return F.lower(F.regexp_replace(_col(s), rf"(?U){SPACE}+", ""))


def lines(s) -> Column:
    """Stripped lines that are not empty, in order."""
    return F.filter(F.transform(F.split(_col(s), LINE_END), strip), lambda x: x != "")


def matches(s, pattern: str) -> Column:
    """Whether the whole text fits the pattern (Unicode classes)."""
    return F.coalesce(_col(s), F.lit("")).rlike(rf"(?U)^(?:{pattern})$")


def found(s, pattern: str) -> Column:
    return F.coalesce(_col(s), F.lit("")).rlike(f"(?U){pattern}")


def first_match(s, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    return F.nullif(F.regexp_extract(_col(s), pattern, group), F.lit(""))


def has_any(s, needles: Iterable[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(_col(s), F.lit(n))
    return out


def has_all(s, needles: Iterable[str]) -> Column:
    out = F.lit(True)
    for n in needles:
        out = out & F.contains(_col(s), F.lit(n))
    return out


def starts_any(s, heads: Iterable[str]) -> Column:
    out = F.lit(False)
    for h in heads:
        out = out | F.startswith(_col(s), F.lit(h))
    return out


def join_parts(parts: list[Column], by: str = "\n") -> Column:
    """The parts that are neither null nor empty, joined."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), by)


def settle(df, **columns: Column):
    """df with columns that later steps take as they are.

    Filters are otherwise pushed below a projection with its expressions in place of its columns, so long chains of
    derived columns grow with each step. The output of a generator over one row is a boundary to that.
    """
    one = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(one)))


def total(rules: Iterable[tuple[Column, float]]) -> Column:
    """Sum of the weights whose condition holds: an additive rule table as one expression."""
    out = F.lit(0.0)
    for condition, weight in rules:
        out = out + F.when(F.coalesce(condition, F.lit(False)), F.lit(float(weight))).otherwise(F.lit(0.0))
    return out
