"""Small tables with Chinese text, as VALUES that Spark and other SQL engines read alike."""

from __future__ import annotations


def values(columns: str, *rows: tuple) -> str:
    """SELECT over VALUES; None is NULL, strings may hold line ends but neither quotes nor backslashes."""

    def cell(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return "TRUE" if x else "FALSE"
        if isinstance(x, float):
            return f"CAST({x!r} AS DOUBLE)"
        return str(x) if isinstance(x, int) else f"'{x}'"

    body = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


LINES = values(
    "line_id, line",
    (1, "12 / 34"), (2, "第一节 重要提示"), (3, "某某股份有限公司2026年第一季度报告"), (4, "目录........ 12"), (5, "一、主要会计数据"), (6, "　1.公司简介。内容如下　"), (7, "1.5"), (8, "3.2%"),
    (9, "项目"), (10, "单位：元"), (11, "期末余额"), (12, "免责声明"), (13, "免责声明：本报告仅供参考，不构成投资建议"), (14, "请务必阅读正文之后的免责条款"), (15, "（1）应收账款"), (16, "1,234.50"),
    (17, "某某股份有限公司董事会报告。"), (18, "合并资产负债表"), (19, "√适用□不适用"), (20, "表 1 收入构成明细"), (21, "二、"), (22, "plain text line"), (23, "2.3 小节"), (24, "核心竞争力分析"),
)

TOKENS = values(
    "text_id, text",
    (1, "贵州茅台2026年一季报营业收入是多少"), (2, "净利润 net_profit v1.2-beta 是"), (3, "公司主要情况"), (4, "A股代码 600519.SH　总资产"), (5, ""), (6, "资产负债表 Q1 2026"), (7, "是 否"), (8, "现金流量净额ABC现金"),
)

NUMBERS = values(
    "num_id, line, unit",
    (1, "营业收入 | 1,234.50 | 1,000.00 | 23.45", "万元"), (2, "净利润（净亏损） (36,015) | （7,032） | -5.1", "人民币百万元"), (3, "总资产 -7,032,976.00 6,000,000", "元"), (4, "no numbers", None),
    (5, "每股收益 (1) 0.52 0.48", "亿元"), (6, "12,345,678", "千元"), (7, "比例 5,000 1200 88", "股"),
)

TITLES = values(
    "title_id, title, source, text",
    (1, "600519_贵州茅台_2026_Q1报", "data/600519_2026_Q1.pdf", "单位：万元 币种：人民币\n2026-04-25 发布"), (2, "平安银行 2025 年报", "a.pdf", "所属行业：货币金融服务主营业务银行"), (3, "中国核建：2025年半年度报告", "b.pdf", "单位: 人民币百万元"),
    (4, "600036-招商银行-2026-一季报", "c.pdf", "金额以百万元列示"), (5, "research note", "d.txt", "2026年2月30日 report 688233"), (6, "603036_油气_2025_三季报", "e.pdf", "报告期 单位：元"), (7, "002001 新和成 季报", "f.pdf", "半导体 芯片 人民币"),
)

PAGE_LINES = values(
    "doc_id, page, seq, y, text",
    (1, 1, 0, 50.0, "一、主要会计数据"), (1, 1, 1, 80.0, "单位：元"), (1, 1, 2, 90.0, "收入构成情况如下"), (1, 1, 3, 300.0, "二、重要事项"), (1, 1, 4, 320.0, "1.5"), (1, 2, 0, 40.0, "三、"), (1, 2, 1, 60.0, "财务报告"), (1, 2, 2, 200.0, "普通正文"),
    (2, 1, 0, 30.0, "目录........ 1"), (2, 1, 1, 40.0, "第一节........ 2"), (2, 1, 2, 50.0, "第二节........ 3"), (2, 1, 3, 60.0, "第三节........ 4"), (2, 2, 0, 100.0, "图 1 趋势"),
)
TABLES = values(
    "doc_id, page, table_idx, x0, y0, x1, y1, section, table_title",
    (1, 1, 1, 50.0, 120.0, 500.0, 280.0, "一、主要会计数据", "收入构成情况如下"), (1, 1, 2, 50.0, 340.0, 500.0, 500.0, "二、重要事项", "单位：元"), (1, 2, 1, 50.0, 55.0, 500.0, 190.0, "二、重要事项", "项目"), (1, 2, 2, 50.0, 300.0, 500.0, 420.0, "三、财务报告", ""),
    (2, 2, 1, 10.0, 150.0, 100.0, 200.0, None, "现金流量情况"),
)
BLOCKS = values(
    "doc_id, page, block_id, x0, y0, x1, y1, text",
    (1, 1, 1, 50.0, 40.0, 500.0, 100.0, "heading block"), (1, 1, 2, 60.0, 130.0, 400.0, 260.0, "inside table"), (1, 1, 3, 50.0, 270.0, 500.0, 330.0, "partly"), (1, 2, 1, 50.0, 200.0, 500.0, 290.0, "free"), (2, 2, 1, 10.0, 150.0, 100.0, 200.0, "all of it"), (3, 1, 1, 0.0, 0.0, 10.0, 10.0, "no tables"),
)
IMAGES = values("doc_id, page, image_idx", (1, 1, 1), (1, 2, 1), (2, 2, 1), (2, 2, 2), (3, 1, 1))

REPORTS = values(
    "doc_id, title, source, company, ticker, industry, raw_text",
    (1, "600519_贵州茅台_2026_Q1报", "r/600519_2026_Q1.pdf", "贵州茅台", "600519", "白酒", "单位：元 币种：人民币\n营业收入  5,000.00  4,000.00  25.00\n三、净利润（净亏损） 2,000.00 1,500.00\n资产总计  90,000.00  80,000.00"),
    (2, "600036_招商银行_2026_Q1报", "r/600036_2026_Q1.pdf", "招商银行", "600036", "银行", "人民币百万元\n负债合计  900  800\n无数字的营业收入"),
    (3, "空白报告", "r/none.txt", None, None, None, "nothing here"),
)
PASSAGES = values(
    "chunk_id, doc_id, chunk_index, chunk_type, section_title, table_title, figure_title, page_number, content",
    (11, 1, 0, "table", "主要会计数据", "主要会计数据和财务指标", None, 2, "项目 | 本报告期 | 上年同期\n营业收入 | 5,100.00 | 4,000.00 | 27.5\n归属于上市公司股东的净利润 | 1,900.00 | 1,400.00 | 35.7\n基本每股收益 | 1.52 | 1.10\n总资产 | 91,000.00 | 80,000.00\n归属于上市公司股东的所有者权益 | 60,000.00 | 50,000.00"),
    (12, 1, 1, "table", "合并资产负债表", "合并资产负债表", None, 5, "负债合计 | 200,000.00 | 30,000.00"),
    (13, 1, 2, "text", "重要提示", None, None, 1, "公司负责人保证季度报告内容真实。证券代码 600519"),
    (14, 1, 3, "table", "合并现金流量表", "合并现金流量表", None, 7, "经营活动产生的现金流量净额 | (300.00) | 250.00"),
    (21, 2, 0, "table", "主要财务指标", "主要财务指标", None, 2, "营业收入 | 800 | 750\n总资产 | 1,000 | 950\n归属于本行股东权益 | 100 | 90\n归属于本行股东的净利润 | 300 | 280"),
    (22, 2, 1, "image", "经营情况", None, "图 1 资产结构", 9, "图 1 资产结构"),
    (31, 3, 0, "text", None, None, None, None, "研究 notes about revenue growth and cash"),
)
QUESTIONS = values("query_id, query", (1, "贵州茅台2026年一季报营业收入是多少"), (2, "招商银行 总资产"), (3, "600519 股票代码"), (4, "cash growth"), (5, "董事长是谁"), (6, "资产负债表 负债合计"))

FACTS = values(
    "doc_id, metric, fact_origin, numeric_value, normalized_value_cny, source_page, section_title, confidence",
    (1, "total_assets", "raw_extracted", 100.0, 1000000.0, 2, "主要会计数据", 0.95), (1, "total_liabilities", "raw_extracted", 300.0, 3000000.0, 8, "资产负债表", 0.9), (1, "equity_attributable", "raw_extracted", 60.0, 600000.0, 2, "主要财务指标", 0.92), (1, "revenue", "raw_extracted", 50.0, 500000.0, 2, "主要会计数据", 0.99), (1, "net_profit_attributable", "raw_extracted", 0.0, 0.0, 2, "主要会计数据", 0.9), (1, "net_profit", "raw_extracted", 5.0, 50000.0, 4, "利润表", 0.85),
    (2, "total_assets", "raw_extracted", 100.0, 100.0, 8, "x", 0.95), (2, "total_liabilities", "raw_extracted", 130.0, 130.0, 8, "x", 0.9), (2, "equity_attributable", "raw_extracted", 10.0, 10.0, 8, "x", 0.9), (2, "operating_cash_flow", "raw_extracted", -5.0, -5.0, 8, "x", 0.9),
    (3, "total_assets", "raw_extracted", 100.0, 100.0, 1, "x", 0.95), (3, "total_liabilities", "raw_extracted", 60.0, 60.0, 1, "x", 0.95), (3, "equity_attributable", "raw_extracted", 40.0, 40.0, 1, "x", 0.95), (3, "revenue", "raw_extracted", 80.0, 80.0, 1, "x", 0.7), (3, "operating_cash_flow", "raw_extracted", 8.0, 8.0, 1, "x", 0.9),
    (4, "total_liabilities", "raw_extracted", 60.0, 60.0, 1, "x", 0.95), (5, "total_assets", "raw_extracted", 100.0, 100.0, 1, "x", 0.95), (5, "total_liabilities", "raw_extracted", 20.0, 20.0, 1, "x", 0.95), (5, "equity_attributable", "raw_extracted", 10.0, 10.0, 1, "x", 0.95),
)

OLD = values(
    "doc_id, title, source, ticker",
    (1, "600519_贵州茅台_2026_Q1报", "a", "600519"), (2, "600519_贵州茅台_2025_年报", "b", "600519"), (3, "other", "c", None), (4, "same title", "d", None), (5, "600036_招商银行_2026_Q3报", "e", "600036"),
)
NEW = values("doc_id, title, source, ticker", (11, "茅台 2026 一季报", "z", "600519"), (12, "same title", "y", None), (13, "fresh", "c", None))
REVIEWS = values(
    "id, label, want, title, logged, answer",
    (1, "should_refuse", None, None, "x", "当前知识库中没有足够证据支持回答"), (2, "bad_refusal", None, None, "x", "没有足够证据"), (3, "wrong", "5,100", "A", "x", "结论 5,100"), (4, "wrong", None, None, "same", "same"), (5, "wrong", None, None, "old", "new"), (6, "wrong", "9", None, "x", "结论 5,100"),
)
