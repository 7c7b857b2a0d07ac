"""Rule tables. Conditions name texts by key; functions compile them to one expression."""

from __future__ import annotations

#: Names of reports that end a company name in a title (fixed values).
REPORT_MARKERS = ["q1报", "q3报", "一季报", "三季报", "季报", "半年报", "年报"]

#: Kind of report by the first marker found (fixed values).
IDENTITY_MARKERS = [
    ("年报", "annual"), ("年度报告", "annual"), ("半年报", "semiannual"), ("半年度报告", "semiannual"),
    ("q1", "q1"), ("一季报", "q1"), ("第一季度", "q1"), ("q3", "q3"), ("三季报", "q3"), ("第三季度", "q3"),
    ("季报", "quarterly"), ("季度报告", "quarterly"),
]

#: Industries and the words that tell them, in order (fixed values).
INDUSTRIES = [
    ("银行", ["银行", "商业银行", "股份制银行", "金融服务"]),
    ("保险", ["保险", "寿险", "财险"]),
    ("白酒", ["白酒", "茅台酒", "酒类产品", "酿酒"]),
    ("石油化工", ["石化", "炼化", "聚酯", "pta", "化工"]),
    ("新能源电力与燃气", ["绿能", "风电", "光伏", "天然气", "燃气", "新能源发电", "售气"]),
    ("建筑工程", ["核建", "建筑施工", "工程建设", "基建", "施工总承包", "核电工程"]),
    ("物流运输", ["物流", "航运", "货运", "运输服务", "航道运输"]),
    ("建材", ["玻璃纤维", "玻纤", "复合材料", "建材"]),
    ("半导体", ["半导体", "硅片", "芯片", "集成电路"]),
    ("传媒出版", ["出版", "传媒", "图书", "发行"]),
    ("光电设备", ["光电", "光学", "检测设备", "成像设备"]),
    ("橡胶", ["天然橡胶", "橡胶加工", "割胶"]),
    ("商贸零售", ["零售", "百货", "商业运营", "商贸"]),
]

#: Industry by ticker (fixed values).
INDUSTRY_OF = {
    "600000": "银行", "600036": "银行", "600133": "环保与科技园区", "600176": "建材", "600212": "新能源设备",
    "600281": "新材料", "600346": "石油化工", "600428": "航运", "600519": "白酒", "600725": "煤化工",
    "600824": "商贸零售", "600956": "新能源电力与燃气", "601118": "橡胶", "601318": "保险", "601598": "物流运输",
    "601611": "建筑工程", "601818": "银行", "603036": "油气装备", "603058": "包装印刷", "603069": "道路运输",
    "603117": "物流运输", "603688": "新材料", "605577": "传媒出版", "688009": "轨道交通设备", "688233": "半导体",
    "688610": "光电设备",
}

#: Words of section headings, of table rows, and titles that say nothing (fixed values).
SECTION_WORDS = [
    "风险提示", "重大风险", "公司面临的风险", "管理层讨论与分析", "经营情况讨论与分析", "董事会报告", "财务报告",
    "会计数据和财务指标", "主要会计数据", "主营业务分析", "核心竞争力分析", "行业情况", "重要事项",
]
ROW_WORDS = ["期初余额", "期末余额", "期初账面价值", "本期增加金额", "本期减少金额", "账面价值", "账面余额", "累计摊销", "减值准备", "内部开发支出"]
GENERIC_TITLES = ["项目", "名称", "合计", "任公司", "币种：人民币", "单位：元", "√适用□不适用", "□适用√不适用", "□不适用", "正在办理中"]
STRONG_HEADING = r"^(?:[一二三四五六七八九十]+、|第[一二三四五六七八九十]+节|\d+、|[（(]\d+[）)]|\d+\.(?!\d))"
OPEN_HEADING = r"^(?:[一二三四五六七八九十]+、|第[一二三四五六七八九十]+节|\(?[一二三四五六七八九十]+\)|\d+\.)$"
TOC_TAIL = r"[\.。·…]{8,}\s*\d+\s*$"

#: Sections whose text is packed into longer passages; answers that are too short to stand alone (fixed values).
KEY_SECTIONS = [
    "重要提示", "风险提示", "重大风险", "公司面临的风险", "管理层讨论与分析", "经营情况讨论与分析", "董事会报告",
    "财务报告", "会计数据和财务指标", "主要会计数据", "主营业务分析",
]
SHORT_ANSWERS = ["否", "是", "不适用", "适用", "√适用□不适用", "□适用√不适用"]

#: Report terms that a query's words call for (fixed values).
REPORT_TERMS = [
    ("年报", ["年报", "年度报告"]), ("年度报告", ["年报", "年度报告"]),
    ("半年报", ["半年报", "半年度报告"]), ("半年度报告", ["半年报", "半年度报告"]),
    ("季报", ["季报", "季度报告"]), ("季度报告", ["季报", "季度报告"]),
    ("一季报", ["q1", "一季报", "第一季度"]), ("q1", ["q1", "一季报", "第一季度"]),
    ("三季报", ["q3", "三季报", "第三季度"]), ("q3", ["q3", "三季报", "第三季度"]),
    ("公告", ["公告"]), ("研报", ["研报"]),
]
PLAIN_TITLE_PARTS = ["年报", "半年报", "季报", "公告", "研报"]

SUMMARY = ["主要会计数据", "主要财务指标"]
ATTRIBUTABLE = ["归属于上市公司股东的净利润", "归属于母公司所有者的净利润", "归属于母公司股东的净利润", "归属于本行股东的净利润", "归属于本行普通股股东的净利润"]

#: Metrics in report order: key, display name, terms, scope, amount, unit, contexts that speak for and against (fixed values).
METRICS = [
    ("revenue", "营业收入", ["营业收入", "营业总收入"], "current_period", True, None, [*SUMMARY, "本报告期"], ["变动比例", "主要原因"]),
    (
        "net_profit_attributable", "归母净利润",
        [
            "归属于上市公司股东的净利润", "上市公司股东的净利润", "归属于母公司所有者的净利润", "归属于母公司股东的净利润",
            "母公司股东的净利润", "归属于本行股东的净利润", "本行股东的净利润", "归属于本行普通股股东的净利润", "本行普通股股东的净利润",
        ],
        "current_period", True, None, [*SUMMARY, "本报告期", "经营情况", "报告期内"], [],
    ),
    (
        "net_profit", "净利润", ["净利润"], "current_period", True, None, [*SUMMARY, "本报告期"],
        ["扣除非经常性损益", *ATTRIBUTABLE, "少数股东损益", "持续经营净利润", "终止经营净利润"],
    ),
    ("total_assets", "总资产", ["总资产", "资产总额", "资产总计", "资产合计"], "period_end", True, None, [*SUMMARY, "本报告期末", "上年度末", "经营情况", "资产负债表分析"], []),
    (
        "total_liabilities", "总负债", ["总负债", "负债合计", "负债总额"], "period_end", True, None,
        ["资产负债表", "负债合计", "所有者权益", "经营情况", "资产负债表分析"], ["递延所得税负债", "流动负债合计", "非流动负债合计", "期末现金及现金等价物余额"],
    ),
    (
        "equity_attributable", "归母净资产",
        [
            "归属于上市公司股东的所有者权益", "上市公司股东的所有者权益", "归属于上市公司股东的净资产", "上市公司股东的净资产",
            "归属于母公司所有者权益", "归属于母公司股东权益", "母公司股东权益", "归属于本行股东权益", "本行股东权益",
            "归属于本行普通股股东的净资产", "本行股东的净资产",
        ],
        "period_end", True, None, [*SUMMARY, "本报告期末", "上年度末", "经营情况", "资产负债表分析"], ["代理承销证券款"],
    ),
    ("operating_cash_flow", "经营活动现金流净额", ["经营活动产生的现金流量净额"], "current_period", True, None, ["现金流量表", "2026年第一季度", "本报告期"], []),
    ("eps_basic", "基本每股收益", ["基本每股收益"], "current_period", False, "元/股", SUMMARY, []),
]
METRIC_KEYS = [m[0] for m in METRICS]

#: Phrases of lines that do not state the metric that they contain (fixed values).
NOT_REVENUE = ["比营业收入", "其中营业收入"]
NOT_NET_PROFIT = ["扣除非经常性损益", *ATTRIBUTABLE, "影响本行股东净利润", "影响少数股东净利润"]
SHARE_OF_REVENUE = ["利息净收入比营业收入", "非利息净收入比营业收入", "手续费及佣金净收入比营业收入"]

#: Metrics of questions: label and the terms that ask for it (fixed values).
ASKED = [
    ("营业收入", ["营业收入", "营业总收入"]),
    ("总资产", ["总资产"]),
    ("股票代码", ["股票代码", "证券代码", "a股代码"]),
    ("归母净利润", ["归属于上市公司股东的净利润", "归母净利润", "归属于本行股东的净利润"]),
    ("净利润", ["净利润"]),
    ("总负债", ["总负债", "负债合计", "负债总额"]),
    ("归母净资产", ["归属于上市公司股东的所有者权益", "归母净资产", "归属于本行股东的净资产"]),
    ("经营活动现金流量净额", ["经营活动产生的现金流量净额", "经营活动现金流量净额"]),
    ("基本每股收益", ["基本每股收益", "每股收益", "eps"]),
]

#: Answers without evidence, and to questions that facts alone cannot answer (fixed values).
REFUSAL = "当前知识库中没有足够证据支持回答这个问题，请补充更具体的公司、时间或文档范围。"
UNSUPPORTED = "当前服务未配置可用的 LLM，只支持财报中的基础指标与结构化事实问答。像董事长、管理层职责或开放式分析问题暂不直接回答。"

#: Gold seed: metric, terms, phrases that rule a line out (fixed values).
_SEED_PROFIT = ["归属于上市公司股东的净利润", "归属于母公司股东的净利润", "归属于母公司所有者的净利润", "归属于本行股东的净利润", "归属于本行普通股股东的净利润"]
SEED = [
    ("revenue", ["营业收入", "营业总收入"], ["其中营业收入"]),
    ("net_profit_attributable", _SEED_PROFIT, []),
    (
        "net_profit",
        [
            "净利润（净亏损以“－”号填列）", "净利润（净亏损以“-”号填列）", "五、净利润（净亏损以“－”号填列）", "五、净利润（净亏损以“-”号填列）",
            "1.持续经营净利润（净亏损以“－”号填列）", "1.持续经营净利润（净亏损以“-”号填列）", "净利润",
        ],
        [*_SEED_PROFIT, "扣除非经常性损益", "非经常性损益"],
    ),
    ("total_assets", ["总资产", "资产总额"], []),
    ("total_liabilities", ["总负债", "负债总额", "负债合计"], ["流动负债合计", "非流动负债合计", "递延所得税负债"]),
    (
        "equity_attributable",
        [
            "归属于上市公司股东的所有者权益", "归属于上市公司股东的净资产", "归属于上市公司股东的所有者权益（或股东权益）", "归属于母公司股东权益",
            "归属于母公司所有者权益", "归属于母公司所有者权益（或股东权益）", "归属于本行股东权益", "归属于本行普通股股东的净资产",
        ],
        [],
    ),
    ("operating_cash_flow", ["经营活动产生的现金流量净额"], []),
    ("eps_basic", ["基本每股收益"], []),
]
