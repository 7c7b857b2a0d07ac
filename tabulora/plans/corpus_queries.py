"""More named queries: text forms, elements, metadata, layout and evaluation over whole tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulora.functions import metadata, numbers
from tabulora.functions.text import collapse, lines, squeeze
from tabulora.functions.tokens import passage_text
from tabulora.functions.vectors import as_literal, parsed
from tabulora.operators import answer, clean, evaluate, facts, goldseed, layout, retrieve, store
from tabulora.plans import derived, rules
from tabulora.plans.queries import EOL, NOISE, ORACLE_SQL, WS, any_of, query, strip_sql, table

LINES_SQL = f"list_filter(list_transform(string_split_regex(coalesce(text, ''), '{EOL}'), lambda x: {strip_sql('x')}), lambda x: x <> '')"


def text_() -> Column:
    return F.coalesce("text", F.lit(""))


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def bare_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' |：:。.')"


def candidate_sql(x: str) -> str:
    t = bare_sql(x)
    return rf"(case when length({t}) < 4 or regexp_full_match({t}, '[\d,.\-/]+') then '' else substr({t}, 1, 40) end)"


def row_heading_sql(x: str) -> str:
    return f"({x} in ({quoted(rules.GENERIC_TITLES)}) or {any_of(x, rules.ROW_WORDS)})"


def weak_sql(x: str) -> str:
    t = bare_sql(f"coalesce({x}, '')")
    return rf"({t} = '' or regexp_matches({t}, '^(单位|币种)[：:]') or regexp_full_match({t}, '[√□]?(适用)?[√□]?(不适用)?|[\d,.\-/]+|[（(]?\d+[）)].*') or {row_heading_sql(t)})"


# ---------------------------------------------------------------- text
@query(
    f"""select doc_id, sha256(lower(regexp_replace(coalesce(text, ''), '{WS}+', '', 'g'))) squeezed_sha256, sha256(trim(regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g'))) collapsed_sha256 from documents"""
)
def text_forms(spark, sf_dir):
    """Both normal forms of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(squeeze(text_()), 256).alias("squeezed_sha256"), F.sha2(collapse(text_()), 256).alias("collapsed_sha256"))


@query(f"select doc_id, sha256(c) content_sha256 from (select doc_id, array_to_string(list_filter({LINES_SQL}, lambda x: not {NOISE}), chr(10)) c from documents) where c <> ''")
def cleaned_elements(spark, sf_dir):
    """Every document as an element; those that are left empty go."""
    out = clean.clean_elements(table(spark, sf_dir, "documents").select("doc_id", text_().alias("content")))
    return out.select("doc_id", F.sha2("content", 256).alias("content_sha256"))


@query("select doc_id, sha256(concat_ws(chr(10), nullif(source, ''), nullif(lang, ''), nullif(text, ''))) passage_sha256 from documents")
def passage_fields(spark, sf_dir):
    """The text in which a passage is searched, with source and language as fields before the content."""
    none = F.lit(None).cast("string")
    form = passage_text("text", title="source", company="lang", ticker=none, section_title=none, table_title=none, figure_title=none)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(form, 256).alias("passage_sha256"))


@query(
    f"""with l as (select doc_id, {LINES_SQL} ls from documents), f as (select doc_id, list_concat(ls, ['Figure ' || doc_id]) ls from l)
    select doc_id, sha256(array_to_string(list_transform(ls, lambda x: {candidate_sql('x')}), '|')) candidates_sha256, len(list_filter(ls, lambda x: {weak_sql('x')}))::int n_weak,
      len(list_filter(ls, lambda x: starts_with(x, 'T') and length(x) <= 120))::int n_headed, substr(list_filter(ls, lambda x: regexp_matches(x, '^(图|Figure|figure)'))[1], 1, 120) caption from f"""
)
def title_candidates(spark, sf_dir):
    """Every line of every document as a title; lines with a mark; the first figure caption."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(text_(), F.lit("\nFigure "), F.col("doc_id").cast("string")).alias("text"))
    rows = docs.withColumn("ls", lines("text"))
    return rows.select(
        "doc_id", F.sha2(F.array_join(F.transform("ls", clean.title_candidate), "|"), 256).alias("candidates_sha256"), F.size(F.filter("ls", clean.is_weak_title)).alias("n_weak"),
        F.size(clean.titles("ls", "T")).alias("n_headed"), clean.figure_caption("text").alias("caption"),
    )


@query(
    f"""with l as {derived.text('LINES')}, t as {derived.text('TITLES')}, p as (select line_id id, line s from l union all select 100 + title_id, title from t)
    select id, {candidate_sql('s')} candidate, {weak_sql('s')} weak, array_to_string(list_filter(list_transform(string_split_regex(s, '[_\\-]|{WS}'), lambda x: {strip_sql('x')}),
      lambda x: length(x) >= 2 and not regexp_full_match(x, '\\d{{4,}}') and x not in ({quoted(rules.PLAIN_TITLE_PARTS)}) and regexp_matches(x, '[\\x{{4e00}}-\\x{{9fff}}]')), ',') terms from p"""
)
def title_forms(spark, sf_dir):
    """Report lines and titles as titles, and the terms that they name."""
    rows = derived.frame(spark, sf_dir, "LINES").select(F.col("line_id").alias("id"), F.col("line").alias("s")).unionByName(derived.frame(spark, sf_dir, "TITLES").select((F.col("title_id") + 100).alias("id"), F.col("title").alias("s")))
    return rows.select("id", clean.title_candidate("s").alias("candidate"), clean.is_weak_title("s").alias("weak"), F.array_join(retrieve.title_terms("s"), ",").alias("terms"))


# ---------------------------------------------------------------- metadata
@query(
    """with s as (select o_orderkey, (o_custkey || '-' || o_orderkey) k, regexp_replace(o_custkey || '-' || o_orderkey, '[^0-9]', '', 'g') d, year(o_orderdate) + 10 y, month(o_orderdate) m, o_orderkey % 32 dd from orders)
    select o_orderkey, case when length(d) = 6 then d end code, strftime(try_cast(y || '-' || lpad(m::varchar, 2, '0') || '-' || lpad(dd::varchar, 2, '0') as date), '%Y-%m-%d') published from s"""
)
def order_codes(spark, sf_dir):
    """Codes of six digits and dates (some of them impossible) of every order."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("-", "o_custkey", "o_orderkey").alias("k"), F.concat(F.lit("on "), F.year("o_orderdate") + 10, F.lit("年"), F.month("o_orderdate"), F.lit("月"), F.col("o_orderkey") % 32, F.lit("日")).alias("s"))
    return rows.select("o_orderkey", metadata.stock_code("k").alias("code"), F.date_format(metadata.published("s"), "yyyy-MM-dd").alias("published"))


_PARTS = rf"list_filter(list_transform(string_split_regex(title, '[_\-]|{WS}'), lambda x: {strip_sql('x')}), lambda x: x <> '')"
_ENDS = rf"(regexp_full_match(x, '20\d{{2}}') or lower(x) in ({quoted(rules.REPORT_MARKERS)}) or (lower(x) like 'q%' and lower(x) like '%报'))"
_FITS = r"(regexp_matches(x, '[\x{4e00}-\x{9fff}]') or (regexp_full_match(x, '[A-Za-z]{1,4}') and i > 1))"
_CANON = "case " + " ".join(f"when sq = '{name.lower()}' or {any_of('sq', [w.lower() for w in words])} then '{name}'" for name, words in rules.INDUSTRIES) + " end"
_WORDS = ", ".join(
    "{'s': " + " + ".join(f"(2 * contains(head, '{w}')::int + {2 if len(w) >= 3 else 1} * contains(body, '{w}')::int)" for w in words) + f", 'o': {-i}, 'n': '{name}'}}"
    for i, (name, words) in enumerate(rules.INDUSTRIES)
)
_KNOWN = " ".join(f"when '{k}' then '{v}'" for k, v in rules.INDUSTRY_OF.items())
ORACLE_SQL["company_industry"] = f"""with a as (select title_id doc_id, title, text, {_PARTS} p0, nullif(regexp_extract(title, '(?:^|[^0-9])(\\d{{6}})(?:[^0-9]|$)', 1), '') t1,
      nullif(regexp_extract(text, '(?:^|[^0-9])(\\d{{6}})(?:[^0-9]|$)', 1), '') t2, regexp_extract(text, '(20\\d{{2}})[-/年](\\d{{1,2}})[-/月](\\d{{1,2}})', ['y', 'm', 'd']) dy,
      trim(regexp_extract(regexp_replace(text, '{WS}+', '', 'g'), '(?:所属行业|公司所处行业|所处行业|行业分类)[:：]?(.*?)(?:主营业务|主要业务|经营情况|公司简介|报告期|$)', 1), '：:，,；;。 ') raw,
      lower(regexp_replace(title, '{WS}+', '', 'g')) head, lower(regexp_replace(text, '{WS}+', '', 'g')) body from {derived.text('TITLES')}),
    b as (select *, case when regexp_full_match(coalesce(p0[1], ''), '\\d{{6}}') then p0[2:] else p0 end p, substr(raw, 1, 24) cand, lower(regexp_replace(substr(raw, 1, 24), '{WS}+', '', 'g')) sq, coalesce(t1, t2) code from a),
    c as (select *, coalesce(list_position(list_transform(p, lambda x, i: {_ENDS} or not {_FITS}), true), len(p) + 1) stop, list_sort([{_WORDS}], 'DESC')[1] best from b)
    select doc_id, case when stop > 1 then substr(array_to_string(p[1:stop - 1], ''), 1, 64) when contains(title, '：') then substr({strip_sql("string_split(title, '：')[1]")}, 1, 64)
        when contains(title, '-') then substr({strip_sql("string_split(title, '-')[1]")}, 1, 64) end company, code ticker,
      coalesce(case code {_KNOWN} end, case t1 {_KNOWN} end, case when sq <> '' then {_CANON} end, case when length(cand) between 2 and 16 then cand end, case when best.s >= 2 then best.n end) industry,
      strftime(try_cast(dy.y || '-' || lpad(dy.m, 2, '0') || '-' || lpad(dy.d, 2, '0') as date), '%Y-%m-%d') published from c"""


# ---------------------------------------------------------------- queries over reports
_EDGE = r"[^0-9A-Za-z_\x{4e00}-\x{9fff}]"
_TERMS = "list_concat(" + ", ".join(f"case when contains(lower(query), '{t}') then [{quoted(names)}] else [] end" for t, names in rules.REPORT_TERMS) + ")"
ORACLE_SQL["query_filters"] = f"""with d as {derived.text('REPORTS')}, q as {derived.text('QUESTIONS')},
    terms as (select distinct unnest(list_filter(list_transform(string_split_regex(title, '[_\\-]|{WS}'), lambda x: {strip_sql('x')}),
      lambda x: length(x) >= 2 and not regexp_full_match(x, '\\d{{4,}}') and x not in ({quoted(rules.PLAIN_TITLE_PARTS)}) and regexp_matches(x, '[\\x{{4e00}}-\\x{{9fff}}]'))) term from d),
    m as (select query_id, query, nullif(regexp_extract(query, '(?:^|{_EDGE})(\\d{{6}})(?:{_EDGE}|$)', 1), '') ticker, try_cast(nullif(regexp_extract(query, '(?:^|{_EDGE})(20\\d{{2}})(?:{_EDGE}|$)', 1), '') as int) as year,
      (select company from d where company <> '' and contains(q.query, company) order by length(company) desc, company desc limit 1) company,
      coalesce((select list(term order by term) from terms where contains(q.query, term)), []) tt, {_TERMS} r0 from q),
    n as (select *, list_filter(r0, lambda x, i: list_position(r0, x) = i) rt from m),
    s as (select query_id, string_agg(doc_id::varchar, ',' order by doc_id) docs from n, (select doc_id, coalesce(title, '') t, coalesce(source, '') s, ticker dt, company dc from d) d
      where (n.ticker is not null or n.company is not null or year is not null or len(tt) > 0 or len(rt) > 0)
        and (n.ticker is null or coalesce(dt = n.ticker, false)) and (n.company is null or coalesce(dc = n.company, false)) and (year is null or contains(t, year::varchar) or contains(s, year::varchar))
        and (len(tt) = 0 or len(list_filter(tt, lambda x: contains(lower(t), lower(x)))) > 0) and (len(rt) = 0 or len(list_filter(rt, lambda x: contains(lower(t), x) or contains(lower(s), x))) > 0) group by 1)
    select query_id, ticker, company, year, array_to_string(tt, ',') title_terms, array_to_string(rt, ',') report_terms, docs from n left join s using (query_id)"""


@query(
    f"""with q as (select query_id, lower(regexp_replace(query, '{WS}+', '', 'g')) q from {derived.text('QUESTIONS')})
    select query_id, case {' '.join(f"when {any_of('q', terms)} then '{label}'" for label, terms in rules.ASKED)} end label from q"""
)
def asked_metric(spark, sf_dir):
    """The metric that a question is after."""
    return derived.frame(spark, sf_dir, "QUESTIONS").select("query_id", answer.asked("query").label.alias("label"))


# ---------------------------------------------------------------- layout


@query(f"select doc_id, page from {derived.text('PAGE_LINES')} where regexp_matches(text, '[\\.。·…]{{8,}}\\s*\\d+\\s*$') group by 1, 2 having count(*) >= 4")
def contents_pages(spark, sf_dir):
    """Pages of contents."""
    return clean.toc_pages(derived.frame(spark, sf_dir, "PAGE_LINES"))


@query(
    f"""with i as {derived.text('IMAGES')}, l as (select doc_id, page, list(text order by y, seq) ls from {derived.text('PAGE_LINES')} group by 1, 2),
    c as (select i.*, coalesce(list_filter(ls, lambda x: starts_with(x, '图') and length(x) <= 120)[image_idx], substr(list_filter(ls, lambda x: regexp_matches({strip_sql('x')}, '^(图|Figure|figure)'))[1], 1, 120)) t from i left join l using (doc_id, page))
    select doc_id, page, image_idx, coalesce(t, 'Image block detected on page ' || page || '.') as content, coalesce(t, 'Figure ' || image_idx || ' on page ' || page) figure_title from c"""
)
def image_captions(spark, sf_dir):
    """Image elements with their captions."""
    return layout.image_elements(derived.frame(spark, sf_dir, "IMAGES"), derived.frame(spark, sf_dir, "PAGE_LINES"))


@query(
    f"""with t as (select *, {candidate_sql("coalesce(table_title, '')")} c, '第' || page || '页表' || table_idx made, coalesce(section, '') s from {derived.text('TABLES')})
    select doc_id, page, table_idx, case when c <> '' and not {weak_sql('c')} then c when s <> '' and not {row_heading_sql('s')} and not {weak_sql('s')} then s || ' ' || made when y0 <= 110 then '' else made end title from t"""
)
def table_titles(spark, sf_dir):
    """The choice of a table's title."""
    none = F.lit(None).cast("string")
    title = layout.table_title(none, F.col("table_title"), none, F.col("section"), "page", "table_idx", F.col("y0"))
    return derived.frame(spark, sf_dir, "TABLES").select("doc_id", "page", "table_idx", title.alias("title"))


@query(
    f"""with r as (select conv_id, list(concat_ws(' | ', {strip_sql("coalesce(role, '')")}, {strip_sql("coalesce(text, '')")}) order by turn) filter ({strip_sql("coalesce(role, '')")} <> '' or {strip_sql("coalesce(text, '')")} <> '') rs from conversations group by 1),
    b as (select conv_id, coalesce(array_to_string(rs, chr(10)), '') body from r), f as (select *, coalesce(list_filter(list_transform(string_split_regex(body, '{EOL}'), lambda x: {strip_sql('x')}), lambda x: x <> '')[1], '') first from b),
    c as (select *, {strip_sql("string_split(first, '|')[1]")} cell from f)
    select conv_id, sha256(body) text_sha256, {candidate_sql("case when cell <> '' then cell else first end")} inferred from c"""
)
def table_texts(spark, sf_dir):
    """Each conversation as a table's text, with the title that its first cell gives."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.array(x.role, x.text)).alias("rows"))
    rows = rows.select("conv_id", layout.table_text("rows").alias("body"))
    return rows.select("conv_id", F.sha2("body", 256).alias("text_sha256"), layout.inferred_title("body").alias("inferred"))


# ---------------------------------------------------------------- numbers and units
@query(
    f"""with n as (select num_id, {strip_sql('line')} s, regexp_extract_all(line, '[\\(（]-?[0-9][0-9,]*(?:\\.\\d+)?[\\)）]|-?[0-9][0-9,]*(?:\\.\\d+)?') ts from {derived.text('NUMBERS')}), f as (select *, coalesce(ts[1], '') t, coalesce(regexp_full_match(ts[1], '0*[0-9]'), false) digit from n)
    select num_id, array_to_string(case when t in ({quoted(numbers.FOOTNOTES)}) or (digit and (starts_with(s, '(' || t || ')') or starts_with(s, '（' || t || '）') or starts_with(s, t || '（') or starts_with(s, t || '('))) then ts[2:] else ts end, ' ') without_note,
      array_to_string(case when len(ts) >= 2 and digit then ts[2:] else ts end, ' ') without_digit from f"""
)
def footnotes(spark, sf_dir):
    """F8: numeric tokens without the numbers of notes."""
    rows = derived.frame(spark, sf_dir, "NUMBERS").withColumn("ts", numbers.tokens("line"))
    return rows.select("num_id", F.array_join(numbers.without_footnote("line", "ts"), " ").alias("without_note"), F.array_join(numbers.without_leading_digit("ts"), " ").alias("without_digit"))


@query(
    f"""with p as (select 'report' as kind, doc_id id, raw_text text from {derived.text('REPORTS')} union all select 'title', title_id, text from {derived.text('TITLES')} union all select 'document', doc_id, coalesce(text, '') from documents),
    h as (select kind, id, array_to_string(string_split_regex(text, '{EOL}')[1:40], chr(10)) head from p)
    select kind, id, coalesce(nullif({strip_sql(f"regexp_extract(head, '单位[:：]{WS}*([^' || chr(10) || ']{{1,30}})', 1)")}, ''), case when contains(head, '人民币百万元') then '人民币百万元' when contains(head, '单位：万元') then '万元' when contains(head, '单位：亿元') then '亿元' when contains(head, '单位：元') then '元' end) unit from h"""
)
def page_units(spark, sf_dir):
    """The unit that a page names."""
    pages = derived.frame(spark, sf_dir, "REPORTS").select(F.lit("report").alias("kind"), F.col("doc_id").cast("long").alias("id"), F.col("raw_text").alias("text"))
    pages = pages.unionByName(derived.frame(spark, sf_dir, "TITLES").select(F.lit("title").alias("kind"), F.col("title_id").cast("long").alias("id"), "text"))
    pages = pages.unionByName(table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("id"), text_().alias("text")))
    return pages.select("kind", "id", goldseed.page_unit(F.col("text")).alias("unit"))


@query("select vec_id, len(embedding)::int dim, round(list_sum(list_transform(embedding, lambda x: x::double)), 4) total from embeddings")
def vector_codec(spark, sf_dir):
    """Every vector through its text form and back."""
    v = parsed(as_literal("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


# ---------------------------------------------------------------- store and evaluation
@query(
    """select c_custkey doc_id, (select count(*) from orders where o_custkey = c_custkey)::bigint chunk_count, coalesce(k, '') artifact_types
    from customer left join (select o_custkey, string_agg(distinct o_orderstatus, ',' order by o_orderstatus) k from orders group by 1) on o_custkey = c_custkey"""
)
def document_list(spark, sf_dir):
    """Customers as documents, orders as their passages and artifacts."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("artifact_type"))
    out = store.document_list(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id")), orders, orders)
    return out.select("doc_id", "chunk_count", F.array_join("artifact_types", ",").alias("artifact_types"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels) or doc_id % 50 = 0")
def store_copy(spark, sf_dir):
    """Documents that a second store lacks: it has the labelled ones, but for every 50th."""
    source = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("s"), "doc_id").alias("source"))
    return store.copied(source, table(spark, sf_dir, "labels").where("doc_id % 50 <> 0").select(F.concat(F.lit("s"), "doc_id").alias("source"))).select("doc_id")


def _turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role", text_().alias("content"))


@query(
    """select conv_id doc_id, count(*)::bigint n_elements, contains(coalesce(string_agg(coalesce(text, ''), chr(10) || chr(10) order by turn) filter (role = 'user'), ''), 'the') and count(*) filter (role = 'user') >= 2 passed from conversations group by 1"""
)
def parse_cases(spark, sf_dir):
    """Conversations as parsed documents: turns of users are texts, others are tables."""
    turns = _turns(spark, sf_dir)
    elements = turns.select("doc_id", F.when(F.col("role") == "user", "text").otherwise("table").alias("element_type"), F.col("turn").alias("element_seq"), "content")
    cases = turns.select("doc_id").distinct().select("doc_id", F.col("doc_id").cast("string").alias("name"), F.array(F.lit("the")).alias("expected_text_contains"), F.create_map(F.lit("text"), F.lit(2)).alias("min_element_counts"))
    return evaluate.parse_cases(cases, elements).select("doc_id", "n_elements", "passed")


@query(
    """select conv_id doc_id, count(*)::bigint n_chunks, max(length(coalesce(text, '')))::int longest, round(avg(length(coalesce(text, ''))), 2) mean_length,
      count(*) >= 3 and max(length(coalesce(text, ''))) <= 3000 and bool_or(contains(coalesce(text, ''), 'a')) and count(*) filter (role = 'user') >= 2 passed from conversations group by 1"""
)
def chunk_cases(spark, sf_dir):
    """V2: turns as passages: their number, their sizes and a word that must be there."""
    turns = _turns(spark, sf_dir)
    cases = turns.select("doc_id").distinct().select("doc_id", F.col("doc_id").cast("string").alias("name"), F.lit(3).alias("min_chunks"), F.lit(3000).alias("max_chunk_length"), F.lit("a").alias("required_keyword"), F.create_map(F.lit("user"), F.lit(2)).alias("min_chunk_counts"))
    return evaluate.chunk_cases(cases, turns.withColumnsRenamed({"turn": "chunk_index", "role": "chunk_type"})).drop("name")


@query(
    """with a as (select conv_id, string_agg(coalesce(text, ''), ' ' order by turn) answer, list(role) roles from conversations group by 1)
    select conv_id query_id, contains(answer, 'the') and list_contains(roles, 'assistant') and not contains(answer, '没有足够证据') passed from a"""
)
def answer_cases(spark, sf_dir):
    """V4: conversations as answers, their roles as cited titles."""
    every = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    answers = _turns(spark, sf_dir).groupBy(F.col("doc_id").alias("query_id")).agg(every.alias("t"))
    answers = answers.select("query_id", F.array_join(F.transform("t", lambda x: x.content), " ").alias("answer"), F.transform("t", lambda x: F.struct(x.role.alias("title"))).alias("citations"))
    cases = answers.select("query_id", F.array(F.lit("the")).alias("expected_answer_contains"), F.lit("assistant").alias("expected_citation_title"), F.lit(True).alias("forbid_refusal"))
    return evaluate.answer_cases(cases, answers)


@query("select l.doc_id, coalesce(d.lang = 'en' and length(d.source) >= 4, false) passed from labels l left join documents d using (doc_id)")
def fact_cases(spark, sf_dir):
    """V5: languages of labelled documents as facts against cases."""
    none = F.lit(None).cast("string")
    have = table(spark, sf_dir, "documents").select("doc_id", F.lit("lang").alias("metric"), F.col("lang").alias("value"), F.length("source").alias("confidence"), none.alias("source_page"), none.alias("quality_flag"), none.alias("fact_origin"))
    cases = table(spark, sf_dir, "labels").select("doc_id", F.lit("lang").alias("metric"), F.lit("en").alias("value"), F.lit(4).alias("min_confidence"), none.alias("source_page"), none.alias("quality_flag"), none.alias("fact_origin"))
    return evaluate.fact_cases(cases, have).select("doc_id", "passed")


@query(
    """with f as (select l.doc_id, case when toxic = 1 then 'eps_basic' else 'revenue' end metric, quality, n_chars % 2 n from labels l left join documents d using (doc_id))
    select metric, count(*)::bigint n, count(*) filter (coalesce(n = quality, false))::bigint n_correct, round(avg(coalesce(n = quality, false)::int), 4) accuracy from f group by 1"""
)
def gold_fields(spark, sf_dir):
    """V6: labels as gold values, by number, against a property of the documents."""
    n = (F.col("n_chars") % 2).cast("double")
    have = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit("eps_basic"), F.lit("revenue"))).alias("metric"), F.lit(None).cast("string").alias("value"), n.alias("numeric_value"), n.alias("normalized_value_cny"))
    want = F.col("quality").cast("double")
    gold = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "eps_basic").otherwise("revenue").alias("metric"), F.lit(None).cast("string").alias("value"), want.alias("expected_numeric_value"), want.alias("expected_normalized_value_cny"))
    return evaluate.field_accuracy(evaluate.gold_fields(gold, have))


@query("select d.doc_id, d.lang as metric, case when exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1 and d.lang = 'en') then 'patched' else d.source end as value from documents d")
def gold_corrections(spark, sf_dir):
    """Corrections take the place of values."""
    gold = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("metric"), F.col("source").alias("value"))
    patches = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit("en").alias("metric"), F.lit("patched").alias("value"))
    return goldseed.corrected(gold, patches)


# ---------------------------------------------------------------- lines of facts
@query(
    f"""with l as (select conv_id, turn, {strip_sql("coalesce(text, '')")} t from conversations), n as (select *, lead(t) over (partition by conv_id order by turn) after from l where t <> '')
    select conv_id doc_id, turn * 2 line_seq, sha256(t) line_sha256 from n union all select conv_id, turn * 2 + 1, sha256(t || ' ' || after) from n where length(t || ' ' || after) <= 180"""
)
def layout_pairs(spark, sf_dir):
    """turns as the lines of a page, each alone and with the next one."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page"), F.col("turn").alias("seq"), text_().alias("text"))
    return facts.layout_lines(rows).select("doc_id", "line_seq", F.sha2("text", 256).alias("line_sha256"))


_ALL_TERMS = sorted({t for m in rules.METRICS for t in m[2]})


@query(
    f"""with p as (select doc_id, raw_text text from {derived.text('REPORTS')} union all select 100 + chunk_id, content from {derived.text('PASSAGES')}), l as (select distinct doc_id, unnest({LINES_SQL}) line from p),
    t as (select unnest([{quoted(_ALL_TERMS)}]) term), f as (select *, lower(regexp_replace(line, '{WS}+', '', 'g')) flat from l, t), m as (select *, strpos(flat, term) ahead from f where contains(flat, term))
    select doc_id, line, term, not (term = '营业收入' and {any_of('flat', rules.NOT_REVENUE)}) and not (term = '净利润' and {any_of('flat', rules.NOT_NET_PROFIT)}) states,
      (case when contains(line, term) then strpos(line, term) else list_filter(range(1, length(line) + 1), lambda i: length(regexp_replace(substr(line, 1, i::int - 1), '{WS}+', '', 'g')) = ahead - 1 and not regexp_matches(substr(line, i::int, 1), '{WS}'))[1] end)::int start,
      ahead <= 13 and length(line) <= 140 and len(regexp_extract_all(line, '[\\(（]-?[0-9][0-9,]*(?:\\.\\d+)?[\\)）]|-?[0-9][0-9,]*(?:\\.\\d+)?')) >= 2
        and (contains(line, '|') or regexp_matches(line, '{WS}{{2,}}') or ahead = 1 or contains(substr(line, 1, 8), '、')) statement_row from m"""
)
def term_lines(spark, sf_dir):
    """Whether lines of reports state a metric's term, where it begins, and which are rows of a statement."""
    pages = derived.frame(spark, sf_dir, "REPORTS").select("doc_id", F.col("raw_text").alias("text")).unionByName(derived.frame(spark, sf_dir, "PASSAGES").select((F.col("chunk_id") + 100).alias("doc_id"), F.col("content").alias("text")))
    rows = pages.select("doc_id", F.explode(lines("text")).alias("line")).distinct().withColumn("flat", squeeze("line"))
    rows = rows.withColumn("term", F.explode(F.array(*[F.lit(t) for t in _ALL_TERMS]))).where(F.contains("flat", "term"))
    line, flat, term = F.col("line"), F.col("flat"), F.col("term")
    return rows.select("doc_id", "line", "term", facts.matches_term(flat, term).alias("states"), facts.term_start(line, flat, term).alias("start"), facts.is_statement_row(line, flat, term).alias("statement_row"))


@query(
    f"""with c as (select doc_id, page, seq, y, trim(regexp_replace(text, '{WS}+', ' ', 'g')) t from {derived.text('PAGE_LINES')}), l as (select *, lead(t) over w after from c where t <> '' window w as (partition by doc_id, page order by y, seq)),
    o as (select *, coalesce(regexp_full_match(t, '[一二三四五六七八九十]+、|第[一二三四五六七八九十]+节|\\(?[一二三四五六七八九十]+\\)|\\d+\\.') and length(after) <= 40, false) can from l),
    g as (select *, sum((not can)::int) over (partition by doc_id, page order by y, seq) run from o), k as (select *, can and row_number() over (partition by doc_id, page, run, can order by y, seq) % 2 = 1 starts from g),
    e as (select *, coalesce(lag(starts) over (partition by doc_id, page order by y, seq), false) eaten from k)
    select doc_id, page, seq, case when starts then t || after else t end as text from e where not eaten"""
)
def glued_lines(spark, sf_dir):
    """headings' numbers put before the words of the next line."""
    return clean.glued_lines(derived.frame(spark, sf_dir, "PAGE_LINES")).select("doc_id", "page", "seq", "text")


@query(
    f"""with t as (select doc_id, page, min(y0) top from {derived.text('TABLES')} where y0 > 0 group by 1, 2), l as (select * from {derived.text('PAGE_LINES')} left join t using (doc_id, page) where top is null or y < top - 6),
    n as (select *, row_number() over (partition by doc_id, page order by y, seq) n from l)
    select doc_id, page, arg_min(text, n) as section from n where n <= 40 and (regexp_matches(text, '^([一二三四五六七八九十]+、|第[一二三四五六七八九十]+节)') and not regexp_matches(text, '[\\.。·…]{{8,}}\\s*\\d+\\s*$') or text = '财务报告') group by 1, 2"""
)
def page_sections(spark, sf_dir):
    """The first heading of each page above its first table."""
    return layout.page_sections(derived.frame(spark, sf_dir, "PAGE_LINES"), derived.frame(spark, sf_dir, "TABLES"))
