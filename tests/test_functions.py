"""Text, numbers, tokens, vectors and metadata on single values."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from tabulora.functions import metadata, numbers, text, tokens, vectors
from tabulora.operators import clean


def one(spark, column, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")]
    return spark.range(1).select(*cols).select(column).first()[0]


def test_white_space_of_any_kind(spark):
    assert one(spark, text.strip("s"), s="　 a b \t") == "a b"
    assert one(spark, text.collapse("s"), s="　a\r\n b ") == "a b"
    assert one(spark, text.squeeze("s"), s=" A　b\tC") == "abc"
    assert one(spark, text.lines("s"), s="a\r\n\n 　\nb\x0bc d\n") == ["a", "b", "c", "d"]


@pytest.mark.parametrize(("token", "want"), [("1,234.50", 1234.5), ("(36,015)", -36015.0), ("（36,015）", -36015.0), ("-7,032,976.00", -7032976.0), ("(-5)", 5.0), ("abc", None), ("", None), ("-", None)])
def test_value(spark, token, want):
    assert one(spark, numbers.value("s"), s=token) == want


def test_footnotes(spark):
    strip = lambda source, values: one(spark, numbers.without_footnote(F.lit(source), F.array(*[F.lit(v) for v in values])))
    assert strip("营业收入(1) 5", ["(1)", "5"]) == ["5"]
    assert strip("(3)营业收入 5", ["3", "5"]) == ["5"]
    assert strip("营业收入 3 5", ["3", "5"]) == ["3", "5"]
    eps = lambda source, values: one(spark, numbers.without_eps_footnote(F.lit(source), F.lit("基本每股收益"), F.array(*[F.lit(v) for v in values])))
    assert eps("基本每股收益 2 0.52 0.48", ["2", "0.52", "0.48"]) == ["0.52", "0.48"]
    assert eps("基本每股收益 0.52 0.48", ["0.52", "0.48"]) == ["0.52", "0.48"]
    assert one(spark, numbers.without_leading_digit(F.array(F.lit("7"), F.lit("1.5")))) == ["1.5"]
    assert one(spark, numbers.without_leading_digit(F.array(F.lit("7")))) == ["7"]


def test_units(spark):
    for unit, want in (("人民币百万元", 1e6), ("亿元", 1e8), ("万元", 1e4), ("千 元", 1e3), ("元", 1.0), (None, 1.0)):
        assert one(spark, numbers.multiplier(F.lit(unit).cast("string"))) == want
    assert one(spark, numbers.multiplier(F.lit("股"), None)) is None and one(spark, numbers.multiplier(F.lit("元"), None)) == 1.0
    assert one(spark, numbers.formatted(F.lit(1234567.5))) == "1,234,567.50" and one(spark, numbers.formatted(F.lit(31000.0))) == "31,000"


def test_hashed_vector_is_that_of_md5(spark):
    t = "net 利润 net abc"
    want = [0.0] * 48
    for w in ["net", "net", "abc", "利", "润"]:
        want[int(hashlib.md5(w.encode()).hexdigest(), 16) % 48] += 1
    size = math.sqrt(sum(x * x for x in want))
    got = one(spark, vectors.hashed_vector(F.lit(t), 48))
    assert got == pytest.approx([x / size for x in want])
    assert one(spark, vectors.hashed_vector(F.lit("。！"), 8)) == [0.0] * 8
    rows = vectors.hashed_counts(spark.createDataFrame([(1, t), (2, "")], "id long, t string"), "id", "t", 48).collect()
    assert {r.idx: r.value for r in rows} == pytest.approx({k: x / size for k, x in enumerate(want) if x})


def test_dot_and_cosine(spark):
    array = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, vectors.dot(array(1, 2, 3), array(4, 5))) == 14.0
    assert one(spark, vectors.dot(array(1), F.array().cast("array<double>"))) == 0.0
    assert one(spark, vectors.cosine(array(1, 0), array(1, 1))) == pytest.approx(0.5**0.5)
    assert one(spark, vectors.cosine(array(1, 0), array(0, 0))) is None and one(spark, vectors.cosine(array(1), array(1, 2))) is None
    assert one(spark, vectors.parsed(F.lit("[1, 2.5]"))) == [1.0, 2.5] and one(spark, vectors.parsed(F.lit("x"))) is None


def test_lexical_tokens(spark):
    assert one(spark, tokens.lexical_tokens(F.lit("净利润 v1.2/x 公司"))) == ["v1.2/x", "净利润", "净利", "利润", "净利润"]
    assert one(spark, tokens.lexical_tokens(F.lit("是 A"))) == ["a"]


@pytest.mark.parametrize(
    ("title", "want"),
    [("600519_贵州茅台_2026_Q1报", "贵州茅台"), ("招商银行 AB 2026", "招商银行AB"), ("中国核建", "中国核建"), ("AB 茅台", None), ("alpha: x", None), ("alpha-beta", "alpha"), ("x：说明", "x：说明"), ("a b：c", "a b"), ("2026_年报", None), ("", None)],
)
def test_company(spark, title, want):
    assert one(spark, metadata.company("t"), t=title) == want


def test_metadata(spark):
    assert one(spark, metadata.ticker(F.lit("a1234567b 600519x"))) == "600519" and one(spark, metadata.ticker(F.lit("12345"))) is None
    assert one(spark, metadata.stock_code(F.lit("sh.600519"))) == "600519" and one(spark, metadata.stock_code(F.lit("60051"))) is None
    assert str(one(spark, metadata.published(F.lit("于2026年4月30日")))).startswith("2026-04-30") and one(spark, metadata.published(F.lit("2026-02-30"))) is None
    assert one(spark, metadata.industry_from_label(F.lit("所属行业：房地产 主营业务"))) == "房地产"
    assert one(spark, metadata.industry_from_label(F.lit("行业分类: 集成电路设计"))) == "半导体"
    assert one(spark, metadata.industry_from_words(F.lit("x"), F.lit("物流"))) is None and one(spark, metadata.industry_from_words(F.lit("物流"), F.lit(""))) == "物流运输"
    assert one(spark, metadata.identity(F.lit("茅台 2025 半年报"), F.lit(""))) == "2025:annual"  # the annual marker is inside the other
    assert one(spark, metadata.identity(F.lit("x"), F.lit("y"))) is None


def plain_clean(t):
    out = []
    for line in t.splitlines():
        s = line.strip()
        noise = re.fullmatch(r"\d+\s*/\s*\d+", s) or re.search(r"[.。·…]{8,}\s*\d", s) or s.startswith("请务必阅读正文之后的") or (s.startswith("免责声明") and len(s) > 12)
        if s and not noise:
            out.append(s)
    return "\n".join(out)


def test_clean_text(spark):
    t = "\ta　\r\n3 / 4\n\n目录........12 x\n免责声明\n免责声明：本报告仅供参考，不构成建议\nkept \n请务必阅读正文之后的条款"
    assert one(spark, clean.clean_text(F.lit(t))) == plain_clean(t) == "a\n免责声明\nkept"
    rows = spark.createDataFrame([(1, t), (2, " \n3/4"), (3, "ok")], "id int, content string")
    assert {r.id for r in clean.clean_elements(rows).collect()} == {1, 3}
