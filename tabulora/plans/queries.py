"""Named queries over the driver's tables and fixtures, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulora.cut import cut
from tabulora.functions import metadata, numbers
from tabulora.functions.text import lines
from tabulora.functions.tokens import lexical_tokens, simple_tokens
from tabulora.functions.vectors import hashed_counts
from tabulora.operators import answer, chunk, clean, embed, evaluate, facts, goldseed, layout, retrieve, store
from tabulora.plans import derived, rules
from tabulora.plans.ingest import chunked, described

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: White space and line ends for RE2, which knows ASCII only.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
EOL = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def any_of(text: str, words: list[str]) -> str:
    """SQL: whether the text contains any of the words."""
    return "(" + " or ".join(f"contains({text}, '{w}')" for w in words) + ")"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


NOISE = (
    r"(regexp_full_match(x, '\d+\s*/\s*\d+') or (contains(x, '股份有限公司') and contains(x, '报告') and length(x) <= 40 and not (x like '%。' or x like '%：' or x like '%:'))"
    r" or regexp_matches(x, '[\.。·…]{8,}\s*\d+') or starts_with(x, '请务必阅读正文之后的') or (starts_with(x, '免责声明') and length(x) > 12))"
)
LATIN = "[a-z0-9][a-z0-9._/-]*"


# ---------------------------------------------------------------- text
@query(
    f"""with l as (select doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '{EOL}'), lambda x: {strip_sql('x')}), lambda x: x <> '') ls from documents),
    c as (select doc_id, len(ls) n_lines, list_filter(ls, lambda x: not {NOISE}) kept from l)
    select doc_id, n_lines::bigint n_lines, len(kept)::bigint n_kept, sha256(array_to_string(kept, chr(10))) cleaned_sha256 from c"""
)
def clean_text_stats(spark, sf_dir):
    """Cleaned text of every document."""
    ls = lines(F.coalesce("text", F.lit("")))
    kept = F.filter(ls, lambda x: ~clean.is_noise(x))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(ls).cast("long").alias("n_lines"), F.size(kept).cast("long").alias("n_kept"), F.sha2(F.array_join(kept, "\n"), 256).alias("cleaned_sha256"))


_ROW_HEAD = f"(s in ({', '.join(repr(t) for t in rules.GENERIC_TITLES)}) or {any_of('s', rules.ROW_WORDS)})"


@query(
    f"""with b as (select line_id, {strip_sql('line')} s, line from {derived.text('LINES')}),
    f as (select line_id, s, {NOISE.replace('x,', 's,').replace('(x)', '(s)').replace('(x ', '(s ').replace(' or x ', ' or s ')} is_noise, {_ROW_HEAD} is_row,
      ({any_of('s', ['年度报告', '半年度报告', '季度报告'])} and length(s) <= 40 and not {any_of('s', ['真实性', '完整性'])}) is_title,
      regexp_matches(s, '[\\.。·…]{{8,}}\\s*\\d+\\s*$') is_toc,
      regexp_matches(s, '^([一二三四五六七八九十]+、|第[一二三四五六七八九十]+节|\\d+、|[（(]\\d+[）)]|\\d+\\.([^0-9]|$))') strong,
      regexp_matches(s, '^\\d+\\.([^0-9]|$)') dotted from b)
    select line_id, is_noise, is_toc, is_row is_row_heading,
      (not (length(s) > 120 or is_title or is_toc or regexp_full_match(s, '\\d+\\s*/\\s*\\d+') or regexp_full_match(s, '\\d+(\\.\\d+)?%?') or is_row) and ({any_of('s', rules.SECTION_WORDS)} or strong)) is_section_heading,
      case when dotted then regexp_replace(s, '[。；;:：].*$', '') else s end as heading from f"""
)
def line_predicates(spark, sf_dir):
    """Predicates and normal form of lines."""
    s = F.col("s")
    rows = derived.frame(spark, sf_dir, "LINES").withColumn("s", F.regexp_replace("line", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    return rows.select("line_id", clean.is_noise(s).alias("is_noise"), clean.is_toc_line(s).alias("is_toc"), clean.is_row_heading(s).alias("is_row_heading"), clean.is_section_heading(s).alias("is_section_heading"), clean.heading(s).alias("heading"))


@query(
    f"""with t as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') a, regexp_extract_all(lower(coalesce(text, '')), '{LATIN}') b from documents)
    select doc_id, len(a)::bigint n_simple, len(b)::bigint n_lexical, len(list_distinct(b))::bigint n_distinct, md5(array_to_string(b, ' ')) lexical_md5 from t"""
)
def token_counts(spark, sf_dir):
    """E1, E2 on every document (the corpus is Latin)."""
    text = F.coalesce("text", F.lit(""))
    lex = lexical_tokens(text)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.size(simple_tokens(text)).cast("long").alias("n_simple"), lex.alias("l"))
    return rows.select("doc_id", "n_simple", F.size("l").cast("long").alias("n_lexical"), F.size(F.array_distinct("l")).cast("long").alias("n_distinct"), F.md5(F.array_join("l", " ").cast("binary")).alias("lexical_md5"))


@query(
    f"""with t as (select text_id, text, regexp_extract_all(lower(text), '{LATIN}') latin, list_filter(regexp_extract_all(lower(text), '[\\x{{4e00}}-\\x{{9fff}}]+'), lambda r: length(r) > 1) runs from {derived.text('TOKENS')})
    select text_id, array_to_string(list_concat(regexp_extract_all(lower(text), '[a-z0-9]+'), regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]')), ' ') simple,
      array_to_string(list_filter(list_concat(latin, flatten(list_transform(runs, lambda r: list_concat(list_concat(case when length(r) <= 4 then [r] else [] end,
        list_transform(range(1, length(r)), lambda i: substr(r, i::int, 2))), list_transform(range(1, greatest(length(r) - 1, 1)), lambda i: substr(r, i::int, 3)))))),
        lambda t: t not in ({', '.join(repr(t) for t in ["公司", "什么", "情况", "是否", "以及", "其中", "有关", "进行", "根据", "关于", "主要", "本期", "期末", "期初"])})), ' ') lexical from t"""
)
def cjk_tokens(spark, sf_dir):
    """Latin words and CJK grams."""
    return derived.frame(spark, sf_dir, "TOKENS").select("text_id", F.array_join(simple_tokens("text"), " ").alias("simple"), F.array_join(lexical_tokens("text"), " ").alias("lexical"))


@query(
    f"""with t as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{LATIN}')) term from documents)
    select term, count(distinct doc_id)::bigint df, count(*)::bigint tf from t group by 1"""
)
def doc_freq(spark, sf_dir):
    """Document and term frequency of every token. Counts per document come first, so common terms are combined."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(lexical_tokens(F.coalesce("text", F.lit("")))).alias("term"))
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))


@query(
    f"""with t as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) token from documents),
    b as (select doc_id, ((('0x' || substr(md5(token), 1, 16))::ubigint % 64) * (18446744073709551616 % 64) + (('0x' || substr(md5(token), 17, 16))::ubigint % 64)) % 64 idx, count(*) n from t group by 1, 2),
    s as (select doc_id, sqrt(sum(n * n)) norm from b group by 1)
    select doc_id, idx::int idx, round(n / norm, 9) as value from b join s using (doc_id)"""
)
def hash_embed(spark, sf_dir):
    """Hashed unit vectors of every document, entries that are not zero."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return hashed_counts(docs, "doc_id", "text", 64).select("doc_id", "idx", F.round("value", 9).alias("value"))


@query(
    f"""with n as (select num_id, regexp_extract_all(line, '[\\(（]-?[0-9][0-9,]*(?:\\.\\d+)?[\\)）]|-?[0-9][0-9,]*(?:\\.\\d+)?') ts, unit from {derived.text('NUMBERS')}),
    v as (select num_id, unit, ts, list_transform(ts, lambda x: try_cast(regexp_replace(x, '[(（）),]', '', 'g') as double) * case when regexp_matches(x, '^[(（]') then -1 else 1 end) vs from n)
    select num_id, array_to_string(ts, ' ') tokens, vs[1] as first, list_sum(vs) total, list_filter(vs[3:], lambda x: abs(x) <= 1000)[1] change_pct,
      case when unit is null then 1.0 when contains(unit, '百万元') then 1e6 when contains(unit, '亿元') then 1e8 when contains(unit, '万元') then 1e4 when contains(unit, '千元') then 1e3 else 1.0 end::double multiplier from v"""
)
def numeric_extract(spark, sf_dir):
    """tokens, values, change and unit."""
    rows = derived.frame(spark, sf_dir, "NUMBERS").withColumn("ts", numbers.tokens("line")).withColumn("vs", F.transform("ts", numbers.value))
    total = F.when(F.size("vs") > 0, F.aggregate("vs", F.lit(0.0), lambda s, x: s + x))
    return rows.select("num_id", F.array_join("ts", " ").alias("tokens"), F.try_element_at("vs", F.lit(1)).alias("first"), total.alias("total"), numbers.change(F.slice("ts", 3, 1 << 20)).alias("change_pct"), numbers.multiplier("unit").alias("multiplier"))


@query(
    f"""with t as (select *, title || ' ' || source h, nullif(regexp_extract(title || ' ' || source, '(20\\d{{2}})', 1), '') y from {derived.text('TITLES')}),
    k as (select *, case when contains(lower(h), 'q1') or {any_of('h', ['一季报', '第一季度'])} then 'Q1' when contains(lower(h), 'q3') or {any_of('h', ['三季报', '第三季度'])} then 'Q3'
      when {any_of('h', ['半年报', '半年度报告'])} then 'H1' when {any_of('h', ['年报', '年度报告'])} then 'FY' else '' end m from t)
    select title_id, nullif(regexp_extract(title, '(?:^|[^0-9])(\\d{{6}})(?:[^0-9]|$)', 1), '') ticker, y || m report_period,
      case m when 'Q1' then 'quarterly' when 'Q3' then 'quarterly' when 'H1' then 'semiannual' when 'FY' then 'annual' else 'unknown' end report_type,
      case when y is null and not {any_of('lower(h)', [m for m, _ in rules.IDENTITY_MARKERS])} then null else coalesce(y, 'unknown') || ':' ||
        case {' '.join(f"when contains(lower(h), '{m}') then '{v}'" for m, v in rules.IDENTITY_MARKERS)} else 'unknown' end end as identity,
      case when contains(text, '人民币') then 'CNY' end currency,
      coalesce(nullif(trim(regexp_extract(text, '单位[:：]\\s*([^\\n；;。]{{1,30}})', 1)), ''), case when contains(text, '人民币百万元') then '人民币百万元' when contains(text, '百万元') then '百万元' end) unit from k"""
)
def report_metadata(spark, sf_dir):
    """Ticker, period, identity, currency and unit."""
    period, kind = metadata.period("title", "source")
    money, unit = metadata.currency_and_unit("text")
    return derived.frame(spark, sf_dir, "TITLES").select("title_id", metadata.ticker("title").alias("ticker"), period.alias("report_period"), kind.alias("report_type"), metadata.identity("title", "source").alias("identity"), money.alias("currency"), unit.alias("unit"))


@query()
def company_industry(spark, sf_dir):
    """M1, M3-M5: company, date and industry (folds and cascades; tests hold the values)."""
    rows = derived.frame(spark, sf_dir, "TITLES").select(F.col("title_id").alias("doc_id"), "title", "source", F.lit("pdf").alias("doc_type"), "text")
    return described(rows).select("doc_id", "company", "ticker", "industry", F.date_format("published_at", "yyyy-MM-dd").alias("published"))


# ---------------------------------------------------------------- retrieval
def _texts(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _asked(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))


BM25_SQL = f"""
    q as (select item_id query_id, text qtext, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{LATIN}')) ts from benchmark),
    qt as (select query_id, unnest(ts) term from q),
    d as (select doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '{LATIN}') t from documents),
    st as (select count(*) n, sum(len(t)) total, count(*) filter (len(t) > 0) full_ from d),
    tf as (select doc_id, len, term, count(*) tf from (select doc_id, len(t) len, unnest(t) term from d) where term in (select term from qt) group by 1, 2, 3),
    df as (select term, count(*) df from tf group by 1),
    b as (select query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (total / full_)))) s from tf join df using (term) join qt using (term), st group by 1, 2),
    bm as (select query_id, doc_id, s + case when contains(d.text, q.qtext) then 1.0 else 0.0 end score from b join d using (doc_id) join q using (query_id) where s > 0),
    kw as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) rank from bm)"""


@query(f"with {BM25_SQL} select query_id, doc_id, rank::int rank, round(score, 6) score from kw where rank <= 10")
def bm25_topk(spark, sf_dir):
    """Every benchmark text against every document."""
    hits = retrieve.bm25(_asked(spark, sf_dir), _texts(spark, sf_dir), 10)
    return hits.select("query_id", F.col("chunk_id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


@query(
    """with q as (select vec_id query_id, embedding::double[] v from embeddings where vec_id % 50 = 0),
    s as (select query_id, vec_id, list_inner_product(v, embedding::double[]) score from q, embeddings),
    r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) rank from s where score > 0)
    select query_id, vec_id, rank::int rank, round(score, 6) score from r where rank <= 10"""
)
def knn_topk(spark, sf_dir):
    """Dot products of every 50th vector with all vectors."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = retrieve.nearest(asked, v.select(F.col("vec_id").alias("chunk_id"), "embedding"), 10)
    return hits.select("query_id", F.col("chunk_id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


@query(
    """with q as (select vec_id query_id, embedding::double[] v from embeddings where vec_id % 50 = 0),
    s as (select query_id, vec_id, list_cosine_similarity(v, embedding::double[]) score from q, embeddings),
    r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) rank from s)
    select query_id, vec_id, rank::int rank, round(score, 6) score from r where rank <= 5"""
)
def cosine_topk(spark, sf_dir):
    """True cosine, negative scores kept."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = retrieve.nearest(asked, v.select(F.col("vec_id").alias("chunk_id"), "embedding"), 5, true_cosine=True)
    return hits.select("query_id", F.col("chunk_id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


HASHED_SQL = """
    tk as (select 0 kind, doc_id id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) token from documents union all select 1, item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) from benchmark),
    hb as (select kind, id, ((('0x' || substr(md5(token), 17, 16))::ubigint) % 64)::int idx, count(*) n from tk group by 1, 2, 3),
    hv as (select kind, id, idx, n / sqrt(sum(n * n) over (partition by kind, id)) v from hb),
    hs as (select q.id query_id, d.id doc_id, sum(q.v * d.v) score from hv q join hv d using (idx) where q.kind = 1 and d.kind = 0 group by 1, 2),
    vc as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) rank from hs where score > 0)"""
RRF_SQL = """
    legs as (select query_id, doc_id, rank from kw where rank <= 40 union all select query_id, doc_id, rank from vc where rank <= 40),
    fused as (select query_id, doc_id, sum(1.0 / (60 + rank)) score from legs group by 1, 2),
    fr as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) rank from fused)"""


def _legs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    asked, texts = _asked(spark, sf_dir), _texts(spark, sf_dir)
    q = embed.hashed(asked, "query_id", "query", 64)
    v = embed.hashed(texts, "chunk_id", "text", 64)
    none, one = F.lit(None).cast("string"), F.lit(1)
    passages = texts.select("chunk_id", "doc_id", F.lit(0).alias("chunk_index"), F.lit("text").alias("chunk_type"), *[none.alias(c) for c in ("section_title", "table_title", "figure_title", "title", "company", "ticker", "source")], one.alias("page_number"), F.col("text").alias("content"))
    return asked, retrieve.bm25(asked, texts, 40), retrieve.nearest(q, v, 40), passages


@query(f"with {BM25_SQL}, {HASHED_SQL}, {RRF_SQL} select query_id, doc_id, rank::int rank, round(score, 6) score from fr where rank <= 10")
def hybrid_rrf(spark, sf_dir):
    """Both legs of every benchmark text, fused by rank."""
    _, keyword, vector, passages = _legs(spark, sf_dir)
    out = retrieve.fuse(keyword, vector, passages, 10)
    return out.select("query_id", F.col("chunk_id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


@query(
    f"""with {BM25_SQL}, {HASHED_SQL}, {RRF_SQL},
    sq as (select item_id query_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) a from benchmark), sd as (select doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) b from documents),
    rr as (select query_id, doc_id, score + len(list_intersect(a, b)) / greatest(len(a), 1)::double score, rank prev from fr join sq using (query_id) join sd using (doc_id) where rank <= 40),
    ro as (select *, row_number() over (partition by query_id order by round(score, 9) desc, prev) rank from rr)
    select query_id, doc_id, rank::int rank, round(score, 6) score from ro where rank <= 5"""
)
def hybrid_rerank(spark, sf_dir):
    """Fused lists reranked by coverage."""
    asked, keyword, vector, passages = _legs(spark, sf_dir)
    out = retrieve.rerank(asked, retrieve.fuse(keyword, vector, passages, 40), passages, 5)
    return out.select("query_id", F.col("chunk_id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


@query(
    f"""with {BM25_SQL}, truth as (select item_id query_id, list(doc_id) ds from benchmark b join documents d on contains(d.text, b.text) group by 1),
    f as (select q.query_id, min(rank) filter (list_contains(ds, doc_id)) first from q left join truth using (query_id) left join (select * from kw where rank <= 10) k using (query_id) group by 1)
    select count(*)::bigint cases, round(avg(coalesce((first <= 1)::int, 0)), 4) hit_at_1, round(avg(coalesce((first <= 3)::int, 0)), 4) hit_at_3 from f"""
)
def hit_at_k(spark, sf_dir):
    """V3: how often a document that holds the benchmark text is first, or among three."""
    asked, texts = _asked(spark, sf_dir), _texts(spark, sf_dir)
    hits = retrieve.bm25(asked, texts, 10).join(texts.select("chunk_id", F.col("text").alias("content")), "chunk_id")
    none = F.lit(None).cast("string")
    hits = hits.select("query_id", "rank", "content", *[none.alias(c) for c in ("title", "section_title", "chunk_type")], F.lit(None).cast("int").alias("page_number"))
    cases = asked.select("query_id", F.array("query").alias("expected_keywords"), *[none.alias(c) for c in ("expected_title", "expected_section", "expected_chunk_type")], F.lit(None).cast("int").alias("expected_page"))
    return evaluate.hit_rates(evaluate.match_ranks(cases, hits))


def _library(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = derived.frame(spark, sf_dir, "REPORTS")
    passages = derived.frame(spark, sf_dir, "PASSAGES").join(docs.select("doc_id", "title", "company", "ticker", "source"), "doc_id")
    return docs, passages, derived.frame(spark, sf_dir, "QUESTIONS")


@query()
def query_filters(spark, sf_dir):
    """What queries name, and the documents that pass (tests hold the values)."""
    docs, _, asked = _library(spark, sf_dir)
    meta = cut(retrieve.query_metadata(asked, docs))
    return retrieve.listed(meta, docs).select("query_id", "ticker", "company", "year", F.array_join("title_terms", ",").alias("title_terms"), F.array_join("report_terms", ",").alias("report_terms"), "docs")


@query()
def retrieve_reports(spark, sf_dir):
    """R14 with R13: filters, BM25, fusion and intent boosts over report passages (tests hold the order)."""
    docs, passages, asked = _library(spark, sf_dir)
    hits = retrieve.retrieve(asked, passages, docs, top_k=3)
    return hits.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"), F.array_join("reasons", ",").alias("reasons"))


@query()
def answer_questions(spark, sf_dir):
    """Answers with citations out of the retrieved passages (tests hold the values)."""
    docs, passages, asked = _library(spark, sf_dir)
    hits = retrieve.retrieve(asked, passages, docs, top_k=3).join(passages, "chunk_id").withColumn("doc_type", F.lit("pdf")).withColumn("published_at", F.lit(None).cast("string"))
    out = answer.answer(asked, hits)
    return out.select("query_id", "answer", "guard_passed", "refusal_reason", "answer_mode", F.coalesce(F.size("citations"), F.lit(0)).alias("n_citations"))


@query(
    f"""with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '{LATIN}') t from documents), q as (select item_id query_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{LATIN}')) ts from benchmark)
    select query_id, doc_id from q join d on list_has_all(t, ts)"""
)
def all_terms_match(spark, sf_dir):
    """Documents that hold every token of a benchmark text."""
    return retrieve.all_terms(_asked(spark, sf_dir), _texts(spark, sf_dir)).select("query_id", F.col("chunk_id").alias("doc_id"))


# ---------------------------------------------------------------- layout and passages
@query(
    f"""with t as {derived.text('TABLES')}, l as {derived.text('PAGE_LINES')},
    h as (select *, text h from l where regexp_matches(text, '^([一二三四五六七八九十]+、|第[一二三四五六七八九十]+节)') and not regexp_matches(text, '[\\.。·…]{{8,}}\\s*\\d+\\s*$') or text = '财务报告')
    select t.doc_id, t.page, t.table_idx, arg_max(h.h, (h.y, h.seq)) as section from t left join h on h.doc_id = t.doc_id and h.page = t.page and h.y <= t.y0 group by 1, 2, 3"""
)
def section_asof(spark, sf_dir):
    """The last heading above each table."""
    rows, t = derived.of_items(spark, sf_dir, "PAGE_LINES", "TABLES")
    return layout.sections_before(rows, t.drop("section")).select("doc_id", "page", "table_idx", "section")


@query(
    f"""with t as {derived.text('TABLES')}, b as {derived.text('BLOCKS')}
    select doc_id, page, block_id from b where not exists (select 1 from t where t.doc_id = b.doc_id and t.page = b.page
      and greatest(0, least(b.x1, t.x1) - greatest(b.x0, t.x0)) * greatest(0, least(b.y1, t.y1) - greatest(b.y0, t.y0)) / greatest((b.x1 - b.x0) * (b.y1 - b.y0), 1) >= 0.35)"""
)
def overlap_antijoin(spark, sf_dir):
    """Blocks that no table covers."""
    return layout.blocks_outside_tables(derived.frame(spark, sf_dir, "BLOCKS"), derived.frame(spark, sf_dir, "TABLES")).select("doc_id", "page", "block_id")


@query(
    f"""with t as (select *, case when table_title not in ('', '单位：元', '项目') then table_title end s, coalesce(section, '-') k from {derived.text('TABLES')}),
    w as (select *, last_value(s ignore nulls) over (partition by doc_id, k order by page, table_idx rows between unbounded preceding and 1 preceding) a,
      last_value(s ignore nulls) over (partition by doc_id order by page, table_idx rows between unbounded preceding and 1 preceding) b from t)
    select doc_id, page, table_idx, coalesce(s, coalesce(a, b) || '（续）', table_title) table_title from w"""
)
def title_carry_forward(spark, sf_dir):
    """Weak titles continue strong ones."""
    return layout.steady_titles(derived.frame(spark, sf_dir, "TABLES")).select("doc_id", "page", "table_idx", "table_title")


@query()
def page_layout(spark, sf_dir):
    """Glued lines, sections, captions and tail sections of pages (tests hold the values)."""
    rows, t = derived.of_items(spark, sf_dir, "PAGE_LINES", "TABLES")
    # lines are glued and marked once for all that is asked of them
    rows = cut(layout.marked(clean.glued_lines(rows)))
    rows = rows.join(clean.toc_pages(rows, "toc"), ["doc_id", "page"], "left_anti")
    sections = layout.page_sections(rows, t)
    tails = layout.tail_sections(t, sections).withColumnRenamed("section", "tail")
    caps = layout.captions_before(rows, t).groupBy("doc_id", "page").agg(F.array_join(F.array_sort(F.collect_list("caption")), ",").alias("captions"))
    return tails.join(sections, ["doc_id", "page"], "left").join(caps, ["doc_id", "page"], "left")


@query(
    """with r as (select conv_id, list(role || ' | ' || regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g') order by turn) rs from conversations group by 1),
    x as (select conv_id, rs, array_to_string(rs, chr(10)) body, case when len(rs) > 2 and len(string_split(rs[2], '|')) - 1 >= len(string_split(rs[1], '|')) - 2 then 2 else 1 end h from r),
    p as (select conv_id, unnest(case when len(rs) > 12 or length(body) > 1400 then list_concat(
        [{'piece': 0, 'n': h + least(4, len(rs) - h) + case when len(rs) - h > 4 then 1 else 0 end}],
        list_transform(range(0, ((len(rs) - h) + 11) // 12), lambda g: {'piece': g::int + 1, 'n': h + least(12, len(rs) - h - g * 12)}))
      else [{'piece': 0, 'n': len(rs)}] end) u from x)
    select conv_id, u.piece::int piece, u.n::bigint n_lines from p"""
)
def table_row_groups(spark, sf_dir):
    """K4, K5: each conversation as a table, in pieces."""
    body = F.concat("role", F.lit(" | "), F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("b")).groupBy("conv_id")
    rows = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "b"))), lambda x: x.b), "\n").alias("content")).withColumn("table_title", F.lit("turns"))
    return chunk.table_pieces(rows).select("conv_id", "piece", F.size(lines("text")).cast("long").alias("n_lines"))


@query()
def text_packing(spark, sf_dir):
    """K1-K3, K6: passages of every document (a fold; tests hold it against a plain loop)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return chunked(docs).select("doc_id", "chunk_index", "token_count", F.sha2("content", 256).alias("content_sha256"))


# ---------------------------------------------------------------- facts
def _facts(spark, sf_dir) -> DataFrame:
    """The fixture's facts with all columns of a fact."""
    none = F.lit(None).cast("string")
    rows = derived.frame(spark, sf_dir, "FACTS").withColumns({c: none for c in ("display_name", "term", "value", "previous_value", "citation_title", "table_title", "quality_flag", "scope")})
    rows = rows.withColumns({"previous_numeric_value": F.lit(None).cast("double"), "change_pct": F.lit(None).cast("double"), "consistency_gap": F.lit(None).cast("double"), "reported_unit": F.lit("万元"), "currency": F.lit("CNY"), "ord": F.lit(0)})
    return rows


CHECKED_SQL = f"""
    f as {derived.text('FACTS')}, amt as (select *, coalesce(normalized_value_cny, numeric_value) v, coalesce(source_page <= 3, false) and {any_of("coalesce(section_title, '')", rules.SUMMARY)} summ from f),
    w as (select doc_id, max(v) filter (metric = 'total_assets') a, max(v) filter (metric = 'total_liabilities') l0, max(v) filter (metric = 'equity_attributable') e,
      bool_or(summ) filter (metric = 'total_assets') sa, bool_or(summ) filter (metric = 'equity_attributable') se from amt group by 1),
    x as (select *, coalesce(a <> 0 and l0 > a * 1.2 and e is not null and sa and se, false) derive from w),
    y as (select *, case when derive then greatest(a - e, 0) else l0 end l from x),
    z as (select *, case when a <> 0 and l > a * 1.2 then abs(l - a) / greatest(a, 1) end over_, case when a <> 0 and abs(l + e - a) / greatest(a, 1) > 0.35 then abs(l + e - a) / greatest(a, 1) end gap from y),
    c as (select f.doc_id, metric, (metric = 'total_liabilities' and derive) made, case when metric = 'total_liabilities' and derive then l else v end amount, f.confidence c0, f.fact_origin o0,
      case when metric in ('total_liabilities', 'equity_attributable') and gap is not null then 'balance_sheet_gap' when metric = 'total_liabilities' and over_ is not null then 'balance_sheet_inconsistent'
        when metric = 'total_liabilities' and derive then 'derived_from_assets_minus_equity' end flag,
      case when metric in ('total_liabilities', 'equity_attributable') and gap is not null then gap when metric = 'total_liabilities' and over_ is not null then over_ end g from amt f join z using (doc_id)),
    checked as (select doc_id, metric, amount, flag, round(g, 6) g, case when made then 'derived' when g is not null then 'downgraded_raw' else o0 end origin, case when g is not null then least(case when made then 0.88 else c0 end, 0.49) when made then 0.88 else c0 end conf from c)"""


@query(f"with {CHECKED_SQL} select doc_id, metric, amount as normalized_value_cny, flag quality_flag, g consistency_gap, origin fact_origin, round(conf, 4)::double confidence from checked")
def balance_sheet_consistency(spark, sf_dir):
    """derived and downgraded facts."""
    return facts.consistent(_facts(spark, sf_dir)).select("doc_id", "metric", "normalized_value_cny", "quality_flag", "consistency_gap", "fact_origin", "confidence")


@query(
    f"""with {CHECKED_SQL}, p as (select doc_id, {', '.join(f"max(amount) filter (metric = '{k}' and conf >= 0.8) {k}" for k in rules.METRIC_KEYS)} from checked group by 1)
    select doc_id, round(coalesce(nullif(net_profit_attributable, 0), net_profit) / nullif(revenue, 0), 6) net_margin, round(total_liabilities / nullif(total_assets, 0), 6) debt_to_assets,
      round(operating_cash_flow / nullif(revenue, 0), 6) operating_cashflow_margin, round(equity_attributable / nullif(total_assets, 0), 6) equity_ratio from p"""
)
def fundamental_ratios(spark, sf_dir):
    """Ratios of facts that are certain enough."""
    f = facts.consistent(_facts(spark, sf_dir))
    return facts.analysis(f, f.select("doc_id").distinct()).select("doc_id", "net_margin", "debt_to_assets", "operating_cashflow_margin", "equity_ratio")


@query(
    f"""with {CHECKED_SQL}, k as (select unnest([{', '.join(repr(k) for k in rules.METRIC_KEYS)}]) metric), d as (select distinct doc_id from f)
    select 'missing' as counter, metric as name, count(*)::bigint n from d cross join k where not exists (select 1 from checked c where c.doc_id = d.doc_id and c.metric = k.metric) group by 2
    union all select 'low_confidence', metric, count(*) from checked where conf < 0.8 group by 2 union all select 'derived', metric, count(*) from checked where origin = 'derived' and conf >= 0.8 group by 2"""
)
def audit_counters(spark, sf_dir):
    """V8: how often metrics are missing, uncertain or derived."""
    f = facts.consistent(_facts(spark, sf_dir))
    a = facts.analysis(f, f.select("doc_id").distinct())
    return evaluate.counters(a, missing="missing_metrics", low_confidence="low_confidence_metrics", derived="derived_metrics")


def _extracted(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = derived.frame(spark, sf_dir, "REPORTS").withColumn("published_at", F.lit(None).cast("timestamp_ntz"))
    return docs, facts.extract(docs, derived.frame(spark, sf_dir, "PASSAGES"))


@query()
def extract_facts(spark, sf_dir):
    """Facts of reports out of passages and raw text (tests hold the values)."""
    _, f = _extracted(spark, sf_dir)
    return f.select("doc_id", "metric", "term", "value", "numeric_value", "previous_value", "change_pct", "reported_unit", "normalized_value_cny", "source_page", "confidence", "fact_origin", "quality_flag")


@query()
def report_analysis(spark, sf_dir):
    """signals and summaries of reports (tests hold the values)."""
    docs, f = _extracted(spark, sf_dir)
    return facts.analysis(f, docs).select("doc_id", "net_margin", "debt_to_assets", F.array_join(F.transform("signals", lambda s: F.concat(s["name"], F.lit("="), s.value)), ",").alias("signals"), F.array_join("missing_metrics", ",").alias("missing"), F.array_join("summary", "|").alias("summary"))


@query()
def artifact_payloads(spark, sf_dir):
    """Both artifacts as JSON."""
    docs, f = _extracted(spark, sf_dir)
    return facts.payloads(docs, f)


@query()
def gold_seed(spark, sf_dir):
    """Candidates of the second extractor, raw texts as pages (tests hold the values)."""
    pages = derived.frame(spark, sf_dir, "REPORTS").select("doc_id", F.lit(1).alias("page"), F.col("raw_text").alias("text"))
    pages = pages.unionByName(derived.frame(spark, sf_dir, "PASSAGES").select("doc_id", F.coalesce("page_number", F.lit(9)).alias("page"), F.col("content").alias("text")))
    return goldseed.candidates(pages).select("doc_id", "metric", "rank", "page", "term", "value", "unit", "numeric_value", "normalized_value_cny", "score")


# ---------------------------------------------------------------- store, logs, evaluation
@query(
    f"""with o as {derived.text('OLD')}, n as {derived.text('NEW')}, i as (select *, nullif(regexp_extract(title || ' ' || source, '(20\\d{{2}})', 1), '') y,
      case {' '.join(f"when contains(lower(title || ' ' || source), '{m}') then '{v}'" for m, v in rules.IDENTITY_MARKERS)} end k from (select * from o union all select * from n)),
    d as (select *, case when y is null and k is null then null else coalesce(y, 'unknown') || ':' || coalesce(k, 'unknown') end ident from i)
    select doc_id, title, source, ticker from d where doc_id > 10 or not exists (select 1 from d m where m.doc_id > 10 and (m.source = d.source or m.title = d.title or (m.ticker = d.ticker and m.ident = d.ident)))"""
)
def upsert_identity(spark, sf_dir):
    """New reports take the place of the same ones."""
    return store.upsert(derived.frame(spark, sf_dir, "OLD"), derived.frame(spark, sf_dir, "NEW"))


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc nulls last, o_orderkey desc) n from orders) where n = 1")
def newest_per_key(spark, sf_dir):
    """The newest order of each customer."""
    return store.newest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("select event_id id, event_type as query, json_extract_string(props, '$.k') k from events order by ts desc nulls last, event_id desc limit 20")
def log_recent(spark, sf_dir):
    """The last 20 rows of a log with a JSON field."""
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("query"), F.col("ts").alias("created_at"), F.get_json_object("props", "$.k").alias("k"))
    return store.recent(log, 20).select("id", "query", "k")


@query(
    f"""select id, label, case when label = 'should_refuse' then contains(answer, '没有足够证据') when label = 'bad_refusal' then not contains(answer, '没有足够证据')
      when want is null and title is null then answer <> logged else (want is null or contains(answer, want)) and (title is null or title = 'A') end passed from {derived.text('REVIEWS')}"""
)
def review_replay(spark, sf_dir):
    """V9: reviews against new answers."""
    rows = derived.frame(spark, sf_dir, "REVIEWS")
    reviews = rows.select("id", "label", F.when(F.col("want").isNotNull(), F.array("want")).alias("expected_answer_contains"), F.col("title").alias("expected_citation_title"), "logged")
    return evaluate.replayed(reviews, rows.select("id", "answer", F.array(F.lit("A"), F.lit("B")).alias("citation_titles")))


@query(
    """select case when coalesce(d.n_chars, 0) >= 200 then 'long' else 'short' end metric, count(*)::bigint n, count(*) filter (quality = (coalesce(d.n_chars, 0) >= 200)::int)::bigint n_correct,
      round(avg((quality = (coalesce(d.n_chars, 0) >= 200)::int)::int), 4) accuracy from labels l join documents d using (doc_id) group by 1"""
)
def gold_accuracy(spark, sf_dir):
    """V6: labels as gold against a rule on the length."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n")), "doc_id")
    ok = F.col("quality") == (F.col("n") >= 200).cast("int")
    return evaluate.field_accuracy(rows.select("doc_id", F.when(F.col("n") >= 200, "long").otherwise("short").alias("metric"), ok.alias("correct")))


@query("select 'event' as counter, event_type as name, count(*)::bigint n from events group by 2 union all select 'source', source, count(*) from documents group by 2")
def table_counters(spark, sf_dir):
    """V8: counters over whole tables."""
    e = table(spark, sf_dir, "events").select(F.array("event_type").alias("event"))
    d = table(spark, sf_dir, "documents").select(F.array("source").alias("source"))
    return evaluate.counters(e, event="event").unionByName(evaluate.counters(d, source="source"))


_GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" union all ".join(f"select '{n}' as name, count(*)::bigint n from {n}" for n in _GIVEN))
def preflight_counts(spark, sf_dir):
    """Rows of each table."""
    return store.counts(**{n: table(spark, sf_dir, n) for n in _GIVEN})


from tabulora.plans import corpus_queries  # noqa: E402, F401  its queries are registered with these
from tabulora.plans import report_queries  # noqa: E402, F401
