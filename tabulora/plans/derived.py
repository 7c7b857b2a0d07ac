"""Report-like tables that follow from `orders`, `lineitem`, `customer` and `part`, as SQL that Spark and other engines
read alike.

A customer is a document, its orders are pages and their items lines. What a line says is one of a list of phrases,
chosen by the item's keys, with the item's own amounts in it, so every kind of line occurs and all tables grow with the
given ones. The phrases are those of fixtures.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulora.cut import cut, packed
from tabulora.plans import fixtures

GIVEN = ("orders", "lineitem", "customer", "part")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of one of the tables below over the given tables of a folder; without a folder, those of fixtures.py."""
    if not sf_dir:
        return spark.sql(getattr(fixtures, name))
    sql = SQL[name]
    if ITEMS in sql:  # joined and numbered by shuffles of their own
        return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in GIVEN if "{" + t + "}" in sql})
    return spark.sql(sql, **{t: _dealt(spark, sf_dir, t) for t in GIVEN if "{" + t + "}" in sql})


#: Narrow tables whose rows become many lines: the key by which they are dealt out.
DEALT = {"customer": "c_custkey", "orders": "o_orderkey"}


def _dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Few row groups would be few tasks, each with all the lines that follow from its rows, so narrow
    tables are dealt out first."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in DEALT:
        return rows
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, DEALT[name])


def of_items(spark: SparkSession, sf_dir: str, *names: str, at: str | None = None) -> list[DataFrame]:
    """Several of the tables that follow from items, which are joined and numbered once for all of them; at: a folder in which
    the items are packed."""
    if not sf_dir:
        return [frame(spark, sf_dir, n) for n in names]
    given = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem")}
    items = spark.sql(ITEMS, **given)
    items = packed(items, at) if at else cut(items)
    return [spark.sql(SQL[n].replace(f"({ITEMS})", "{items}"), items=items) for n in names]


def text(name: str) -> str:
    """The same as a subquery for an engine that knows the given tables by their names."""
    return "(" + SQL[name].format(**{t: t for t in GIVEN}) + ")"


def phrases(*words: str | None) -> str:
    return fixtures.values("pick, words", *enumerate(words))


def whole(x: str) -> str:
    return f"cast(cast(floor({x}) as bigint) as string)"


def money(x: str) -> str:
    """An amount with separators and two decimals."""
    cents = f"lpad(cast(cast(round({x} * 100) as bigint) % 100 as string), 2, '0')"
    thousands = f"{whole(f'{x} / 1000')} || ',' || lpad(cast(cast(floor({x}) as bigint) % 1000 as string), 3, '0')"
    return f"(case when {x} >= 1000 then {thousands} else {whole(x)} end || '.' || {cents})"


#: Items with a number of their own in the order, whatever repeats among line numbers.
_SEQ = "cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) as int)"
ITEMS = f"""select o_custkey as doc_id, o_orderkey, cast(dense_rank() over (partition by o_custkey order by o_orderkey) as int) as page, seq, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, o_orderdate
    from (select *, {_SEQ} as seq from {{lineitem}}) i join {{orders}} o on o.o_orderkey = i.l_orderkey"""

# ---------------------------------------------------------------- pages
_PHRASES = phrases(
    "一、主要会计数据", "二、重要事项", "三、", "第二节", "1.公司简介。内容如下", "12.", "(二)", "财务报告", "单位：元", "项目", "期末余额", "表 收入构成", "图 趋势", "某某股份有限公司2026年第一季度报告", "1.5", "3 / 12",
    "普通正文", "收入构成情况如下", "现金流量情况", "（1）应收账款", "目录........ 7", "这一行的字数超过四十个所以不会与前面的标题编号连成一行而是保持原来的样子不变动也不会被并入前一行", "  ", "Figure", "风险提示", "主营业务 分析如下", "  第三节　 公司治理", "资产情况 合计", "四、",
)
_N = 29
SQL = {}
SQL["PAGE_LINES"] = f"""select i.doc_id, i.page, i.seq, cast(30 + 40 * i.seq + i.l_suppkey % 3 as double) as y,
    case when i.o_orderkey % 9 = 0 then '第' || cast(i.seq as string) || '节........ ' || cast(i.page as string)
      when k.pick in (11, 12, 23) then k.words || ' ' || cast(i.seq as string) when k.pick in (16, 17, 25, 27) then k.words || ' ' || {money("i.l_extendedprice")} else k.words end as text
    from ({ITEMS}) i join ({_PHRASES}) k on k.pick = (i.l_partkey + 3 * i.l_suppkey) % {_N}"""
_SECTIONS = phrases("一、主要会计数据", "二、重要事项", None, "期末余额", "三、财务报告", "风险提示")
_TITLES = phrases("收入构成情况如下", "单位：元", "项目", "", "现金流量情况", "（2）其他", "1,234", "期末余额合计", "资产 负债情况：")
_CELLS = phrases("项目", "收入构成明细", "单位：元", "资产总计", "", "（2）其他", "流动负债合计情况", "1,234", "期末余额")
SQL["TABLES"] = f"""select i.doc_id, i.page, cast(row_number() over (partition by i.doc_id, i.page order by i.seq) as int) as table_idx, cast(50 as double) as x0,
    cast(case when i.l_suppkey % 17 = 0 then 0 else 45 + 40 * i.seq + i.l_partkey % 5 * 10 end as double) as y0, cast(500 as double) as x1, cast(case when i.l_suppkey % 17 = 0 then 0 else 80 + 40 * i.seq + i.l_partkey % 5 * 10 end as double) as y1,
    k.words as c1, case when k.words = '' then '' when i.l_partkey % 2 = 0 then ' 本期 ' end as c2, case when k.words = '' then '' else '营业收入' end as c3, case when k.words = '' then null else {money("i.l_extendedprice")} end as c4
, s.words as section, t.words as table_title
    from ({ITEMS}) i join ({_CELLS}) k on k.pick = (i.l_partkey + i.l_suppkey) % 9 join ({_SECTIONS}) s on s.pick = (i.l_partkey + 2 * i.l_suppkey) % 6 join ({_TITLES}) t on t.pick = (2 * i.l_partkey + i.l_suppkey) % 9 where i.l_partkey % 3 = 0"""
SQL["BLOCKS"] = f"""select doc_id, page, seq as block_id, cast(50 + l_suppkey % 50 as double) as x0, cast(30 + 40 * seq as double) as y0, cast(350 + l_suppkey % 50 as double) as x1, cast(60 + 40 * seq as double) as y1,
    case when l_partkey % 13 = 0 then '  ' when l_partkey % 13 = 1 then null else ' 第' || cast(page as string) || '页 ' || {money("l_extendedprice")} || ' ' end as text from ({ITEMS}) i"""
SQL["IMAGES"] = f"""select doc_id, page, cast(row_number() over (partition by doc_id, page order by seq) as int) as image_idx from ({ITEMS}) i where l_suppkey % 4 = 0"""

# ---------------------------------------------------------------- lines, words, numbers
SQL["LINES"] = f"""select i.o_orderkey * 100 + i.seq as line_id, case when k.line_id in (20, 22) then k.line || ' ' || {money("i.l_extendedprice")} when k.line_id = 16 then {money("i.l_extendedprice")} else k.line end as line
    from ({ITEMS}) i join ({fixtures.LINES}) k on k.line_id = (i.l_partkey + 3 * i.l_suppkey) % 24 + 1"""
SQL["TOKENS"] = f"""select p_partkey as text_id, k.text || case when p_size % 3 = 0 then '' else ' ' || p_name || ' ' || p_brand || '_' || cast(p_size as string) end as text
    from {{part}} p join ({fixtures.TOKENS}) k on k.text_id = p.p_partkey % 8 + 1"""
SQL["NUMBERS"] = f"""select i.o_orderkey * 100 + i.seq as num_id, k.unit, case k.num_id when 1 then '营业收入 | ' || {money("i.l_extendedprice")} || ' | ' || {money("i.l_quantity")} || ' | ' || {whole("i.l_quantity")} || '.5'
      when 2 then '净利润（净亏损） (' || {money("i.l_extendedprice")} || ') | （' || {whole("i.l_quantity")} || '） | -' || {whole("i.l_quantity")} || '.1' when 5 then '每股收益 (' || {whole("i.l_quantity")} || ') ' || {money("i.l_quantity")} || ' 0.48' else k.line end as line
    from ({ITEMS}) i join ({fixtures.NUMBERS}) k on k.num_id = (i.l_partkey + i.l_suppkey) % 7 + 1"""

# ---------------------------------------------------------------- documents
_ORDERS = "select *, lpad(cast(o_custkey as string), 6, '0') as code, cast(year(o_orderdate) + 5 as string) as y from {orders}"
SQL["TITLES"] = f"""select o.o_orderkey as title_id, case k.title_id when 5 then k.title || ' ' || o.y when 7 then k.title else replace(replace(replace(replace(replace(k.title, '2025', o.y), '2026', o.y), '600519', o.code), '600036', o.code), '603036', o.code) end as title,
      case when k.title_id = 1 then 'data/' || o.code || '_' || o.y || '.pdf' else k.source end as source, k.text || case when o.o_orderkey % 3 = 0 then ' ' || o.y || '-' || cast(month(o.o_orderdate) as string) || '-' || cast(o.o_orderkey % 32 as string) else '' end as text
    from ({_ORDERS}) o join ({fixtures.TITLES}) k on k.title_id = o.o_orderkey % 7 + 1"""
_PAPERS = """select o_orderkey as doc_id, case o_orderkey % 4 when 0 then code || '_贵州茅台_' || y || '_Q1报' when 1 then 'same title ' || cast(o_custkey as string) when 2 then code || '_招商银行_' || y || '_年报' else 'other ' || cast(o_orderkey as string) end as title,
      's' || cast(o_orderkey * 7 % 20011 as string) as source, case when o_orderkey % 5 = 4 then null else code end as ticker"""
SQL["OLD"] = f"{_PAPERS} from ({_ORDERS}) o where o_orderkey % 10 <> 0"
SQL["NEW"] = f"{_PAPERS} from ({_ORDERS}) o where o_orderkey % 10 = 0"

_CUSTOMERS = "select c_custkey, abs(c_acctbal) as bal, cast(2020 + c_custkey % 7 as string) as y, lpad(cast(c_custkey as string), 6, '0') as code from {customer}"
SQL["REPORTS"] = f"""select c.c_custkey as doc_id, replace(replace(k.title, '2026', c.y), coalesce(k.ticker, '#'), c.code) as title, replace(replace(k.source, '2026', c.y), coalesce(k.ticker, '#'), c.code) as source, k.company, case when k.ticker is not null then c.code end as ticker, k.industry,
      replace(replace(k.raw_text, '5,000.00', {money("c.bal")}), '900', {whole("c.bal")}) as raw_text
    from ({_CUSTOMERS}) c join ({fixtures.REPORTS}) k on k.doc_id = c.c_custkey % 3 + 1"""
SQL["PASSAGES"] = f"""select c.c_custkey * 100 + k.chunk_id as chunk_id, c.c_custkey as doc_id, k.chunk_index, k.chunk_type, k.section_title, k.table_title, k.figure_title, k.page_number,
      replace(replace(replace(k.content, '5,100.00', {money("c.bal")}), '1,000', {whole("c.bal")}), '600519', c.code) as content
    from ({_CUSTOMERS}) c join ({fixtures.PASSAGES}) k on k.doc_id = c.c_custkey % 3 + 1"""
SQL["QUESTIONS"] = f"""select c.c_custkey as query_id, replace(replace(k.query, '600519', c.code), '2026', c.y) as query
    from ({_CUSTOMERS}) c join ({fixtures.QUESTIONS}) k on k.query_id = cast(floor(c.c_custkey / 50) as bigint) % 6 + 1 where c.c_custkey % 50 = 0"""
SQL["FACTS"] = f"""select c.c_custkey as doc_id, k.metric, k.fact_origin, k.numeric_value * (1 + c.c_custkey % 7) + case when k.metric = 'total_liabilities' then floor(c.bal / 100) else 0 end as numeric_value,
      k.normalized_value_cny * (1 + c.c_custkey % 7) + case when k.metric = 'total_liabilities' then floor(c.bal / 100) else 0 end as normalized_value_cny, k.source_page, k.section_title, k.confidence
    from ({_CUSTOMERS}) c join ({fixtures.FACTS}) k on k.doc_id = c.c_custkey % 5 + 1"""
SQL["REVIEWS"] = f"""select o.o_orderkey as id, k.label, k.want, k.title, k.logged, case when k.id = 3 and o.o_custkey % 2 = 0 then '结论 4,900' else k.answer end as answer
    from {{orders}} o join ({fixtures.REVIEWS}) k on k.id = o.o_orderkey % 6 + 1"""
