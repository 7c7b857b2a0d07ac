"""Named queries over report-like tables that follow from the given ones (see derived.py), and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulora import surface
from tabulora.cut import cut, shared_folder
from tabulora.operators import clean, elements, evaluate
from tabulora.operators.fulltext import full_text
from tabulora.operators.neighbors import CELLS, InvertedLists, nearest, recall
from tabulora.operators.postings import StoredIndex
from tabulora.plans import derived, rules
from tabulora.plans.corpus_queries import candidate_sql, row_heading_sql, weak_sql
from tabulora.plans.queries import BM25_SQL, EOL, LATIN, NOISE, ORACLE_SQL, WS, _asked, _texts, any_of, query, strip_sql, table


# ---------------------------------------------------------------- SQL of lines
def toc_sql(x: str) -> str:
    return rf"regexp_matches({x}, '[\.。·…]{{8,}}\s*\d+\s*$')"


def report_title_sql(x: str) -> str:
    return f"({any_of(x, ['年度报告', '半年度报告', '季度报告'])} and length({x}) <= 40 and not {any_of(x, ['真实性', '完整性'])})"


def is_heading_sql(x: str) -> str:
    number = rf"regexp_full_match({x}, '\d+\s*/\s*\d+|\d+(\.\d+)?%?')"
    strong = rf"regexp_matches({x}, '^([一二三四五六七八九十]+、|第[一二三四五六七八九十]+节|\d+、|[（(]\d+[）)]|\d+\.([^0-9]|$))')"
    return f"(length({x}) <= 120 and not ({report_title_sql(x)} or {toc_sql(x)} or {number} or {row_heading_sql(x)}) and ({any_of(x, rules.SECTION_WORDS)} or {strong}))"


def heading_sql(x: str) -> str:
    return rf"substr(case when regexp_matches({x}, '^\d+\.([^0-9]|$)') then {strip_sql(f"regexp_extract({x}, '^[^。；;:：]*')")} else {x} end, 1, 120)"


def glued_sql(lines: str) -> str:
    """Common table expressions that end with gl (doc_id, page, seq, y, text): lines with headings' numbers joined."""
    return rf"""
    gc as (select doc_id, page, seq, y, trim(regexp_replace(text, '{WS}+', ' ', 'g')) t from {lines}),
    ga as (select *, lead(t) over w after from gc where t <> '' window w as (partition by doc_id, page order by y, seq)),
    go as (select *, coalesce(regexp_full_match(t, '[一二三四五六七八九十]+、|第[一二三四五六七八九十]+节|\(?[一二三四五六七八九十]+\)|\d+\.') and length(after) <= 40, false) can from ga),
    gg as (select *, sum((not can)::int) over (partition by doc_id, page order by y, seq) run from go),
    gk as (select *, can and row_number() over (partition by doc_id, page, run, can order by y, seq) % 2 = 1 starts from gg),
    ge as (select *, coalesce(lag(starts) over (partition by doc_id, page order by y, seq), false) eaten from gk),
    gl as (select doc_id, page, seq, y, case when starts then t || after else t end as text from ge where not eaten)"""


def figure_sql() -> str:
    return f"coalesce(list_filter(ls, lambda x: starts_with(x, '图') and length(x) <= 120)[image_idx], substr(list_filter(ls, lambda x: regexp_matches({strip_sql('x')}, '^(图|Figure|figure)'))[1], 1, 120))"


_CELLS = ", ".join(f"[{strip_sql(f"coalesce({a}, '')")}, {strip_sql(f"coalesce({b}, '')")}]" for a, b in (("c1", "c2"), ("c3", "c4")))
ELEMENTS_SQL = rf"""
    rl as (select * from {derived.text('PAGE_LINES')}), tb as (select * from {derived.text('TABLES')}), bl as (select * from {derived.text('BLOCKS')}), im as (select * from {derived.text('IMAGES')}),
    {glued_sql('rl')},
    hl as (select *, {toc_sql('text')} is_toc, {is_heading_sql('text')} is_head, {heading_sql('text')} head, {report_title_sql('text')} is_title, {candidate_sql('text')} cand from gl),
    toc as (select doc_id, page from hl where is_toc group by 1, 2 having count(*) >= 4),
    tops as (select doc_id, page, min(y0) top from tb where y0 > 0 group by 1, 2),
    own as (select doc_id, page, arg_min(head, n) own from (select *, row_number() over (partition by doc_id, page order by y, seq) n from hl left join tops using (doc_id, page) where top is null or y < top - 6) where n <= 40 and is_head and not is_toc group by 1, 2),
    tt as (select doc_id, page, table_idx, y0, array_to_string(list_transform(list_filter([{_CELLS}], lambda r: r[1] <> '' or r[2] <> ''), lambda r: array_to_string(r, ' | ')), chr(10)) body from tb anti join toc using (doc_id, page)),
    th as (select t.doc_id, t.page, t.table_idx, any_value(t.y0) y0, any_value(body) body, arg_max(head, (y, seq)) filter (is_head) found,
        max((y, seq)) filter (is_head and y < t.y0 and t.y0 - y <= 90 and not is_toc and not is_title) stop,
        arg_max(cand, (y, seq)) filter (y < t.y0 and t.y0 - y <= 90 and not is_toc and not is_title and not is_head and cand <> '' and not {weak_sql('cand')}) cap,
        max((y, seq)) filter (y < t.y0 and t.y0 - y <= 90 and not is_toc and not is_title and not is_head and cand <> '' and not {weak_sql('cand')}) cap_at
      from tt t left join hl h on h.doc_id = t.doc_id and h.page = t.page and h.y <= t.y0 where body <> '' group by 1, 2, 3),
    pg as (select doc_id, page, row_number() over (partition by doc_id order by page) pi from (select doc_id, page from rl union select doc_id, page from bl union select doc_id, page from tb union select doc_id, page from im)),
    pn as (select doc_id, page, pi, own, hs from pg left join own using (doc_id, page) left join (select doc_id, page, list(found order by table_idx desc) hs from th group by 1, 2) using (doc_id, page)),
    st(doc_id, pi, page, s, tail) as (
      select doc_id, 0::bigint, null::int, null::varchar, null::varchar from pn where pi = 1
      union all
      select p.doc_id, p.pi, p.page, coalesce(own, tail), coalesce(list_filter(list_transform(coalesce(hs, []), lambda h: coalesce(h, own, tail)), lambda h: h is not null and not {row_heading_sql('h')})[1], own, tail)
      from st join pn p on p.doc_id = st.doc_id and p.pi = st.pi + 1),
    ex as (select doc_id, page, list(text order by y, seq) filter (starts_with(text, '表') and length(text) <= 120) es, list(text order by y, seq) ls from gl group by 1, 2),
    tc as (select doc_id, page, table_idx, y0, body, coalesce(found, s) sec, {candidate_sql("coalesce(es[table_idx], '')")} c1, case when stop is null or cap_at > stop then cap else '' end c2, string_split(body, chr(10))[1] line from th join st using (doc_id, page) left join ex using (doc_id, page)),
    ti as (select *, {candidate_sql(f"case when {strip_sql("string_split(line, '|')[1]")} <> '' then {strip_sql("string_split(line, '|')[1]")} else line end")} c3, '第' || page || '页表' || table_idx made from tc),
    tp as (select *, case when c1 <> '' and not {weak_sql('c1')} then c1 when c2 <> '' then c2 when c3 <> '' and not {weak_sql('c3')} then c3
        when coalesce(sec, '') <> '' and not {row_heading_sql('sec')} and not {weak_sql('sec')} then sec || ' ' || made when y0 <= 110 then '' else made end title from ti),
    ts as (select *, case when not {weak_sql('title')} then title end strong, coalesce(sec, '-') k from tp),
    tw as (select *, last_value(strong ignore nulls) over (partition by doc_id, k order by page, table_idx rows between unbounded preceding and 1 preceding) a,
        last_value(strong ignore nulls) over (partition by doc_id order by page, table_idx rows between unbounded preceding and 1 preceding) b from ts),
    free as (select *, {strip_sql('text')} x from bl anti join toc using (doc_id, page) where not exists (select 1 from tb t where t.doc_id = bl.doc_id and t.page = bl.page
        and greatest(0, least(bl.x1, t.x1) - greatest(bl.x0, t.x0)) * greatest(0, least(bl.y1, t.y1) - greatest(bl.y0, t.y0)) / greatest((bl.x1 - bl.x0) * (bl.y1 - bl.y0), 1) >= 0.35)),
    fi as (select im.*, {figure_sql()} f from im left join ex using (doc_id, page)),
    el as (select doc_id, page, 0 kind, 0 idx, 'text' element_type, string_agg(x, chr(10) order by y0, x0, block_id) as content, null::varchar table_title, null::varchar figure_title, null::varchar sec from free where x <> '' group by 1, 2
      union all select doc_id, page, 1, table_idx, 'table', body, coalesce(strong, coalesce(a, b) || '（续）', title), null, sec from tw
      union all select doc_id, page, 2, image_idx, 'image', coalesce(f, 'Image block detected on page ' || page || '.'), null, coalesce(f, 'Figure ' || image_idx || ' on page ' || page), null from fi),
    es as (select el.doc_id, (row_number() over (partition by el.doc_id order by el.page, kind, idx) - 1)::int element_seq, element_type, el.page page_number, content, case when kind = 1 then sec else s end section_title, table_title, figure_title from el join st on st.doc_id = el.doc_id and st.page = el.page)"""


def report_elements(spark, sf_dir) -> DataFrame:
    """The elements of the derived pages."""
    with shared_folder(spark, "items") as at:
        page_lines, blocks, tables, images = derived.of_items(spark, sf_dir, "PAGE_LINES", "BLOCKS", "TABLES", "IMAGES", at=at)
        tables = tables.withColumn("rows", F.array(F.array("c1", "c2"), F.array("c3", "c4")))
        return elements.elements_of(page_lines, blocks, tables, images)


@query(f"with recursive {ELEMENTS_SQL} select doc_id, element_seq, element_type, page_number, sha256(content) content_sha256, section_title, table_title, figure_title from es")
def document_elements(spark, sf_dir):
    """Customers as documents, orders as pages: their elements, with sections and titles that go on."""
    out = report_elements(spark, sf_dir)
    return out.select("doc_id", "element_seq", "element_type", "page_number", F.sha2("content", 256).alias("content_sha256"), "section_title", "table_title", "figure_title")


@query(f"with recursive {ELEMENTS_SQL} select doc_id, sha256(string_agg(content, chr(10) || chr(10) order by element_seq)) text_sha256 from es where element_type = 'text' group by 1")
def document_texts(spark, sf_dir):
    """The text of each document out of its elements."""
    return elements.merged_text(report_elements(spark, sf_dir)).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


# ---------------------------------------------------------------- SQL of queries that stand beside their operators
ORACLE_SQL["section_asof"] = f"""with t as (select * from {derived.text('TABLES')}), h as (select *, {heading_sql('x')} head from (select doc_id, page, seq, y, text x from {derived.text('PAGE_LINES')}) where {is_heading_sql('x')})
    select t.doc_id, t.page, t.table_idx, arg_max(head, (h.y, h.seq)) as section from t left join h on h.doc_id = t.doc_id and h.page = t.page and h.y <= t.y0 group by 1, 2, 3"""
ORACLE_SQL["page_sections"] = f"""with t as (select doc_id, page, min(y0) top from {derived.text('TABLES')} where y0 > 0 group by 1, 2), l as (select * from {derived.text('PAGE_LINES')} left join t using (doc_id, page) where top is null or y < top - 6),
    n as (select *, row_number() over (partition by doc_id, page order by y, seq) n from l)
    select doc_id, page, arg_min({heading_sql('text')}, n) as section from n where n <= 40 and {is_heading_sql('text')} group by 1, 2"""
ORACLE_SQL["title_carry_forward"] = f"""with t as (select *, case when not {weak_sql('table_title')} then table_title end s, coalesce(section, '-') k from {derived.text('TABLES')}),
    w as (select *, last_value(s ignore nulls) over (partition by doc_id, k order by page, table_idx rows between unbounded preceding and 1 preceding) a,
      last_value(s ignore nulls) over (partition by doc_id order by page, table_idx rows between unbounded preceding and 1 preceding) b from t)
    select doc_id, page, table_idx, coalesce(s, coalesce(a, b) || '（续）', table_title) table_title from w"""
_MARKS = " ".join(f"when contains(lower(title || ' ' || source), '{m}') then '{v}'" for m, v in rules.IDENTITY_MARKERS)
ORACLE_SQL["upsert_identity"] = f"""with i as (select *, nullif(regexp_extract(title || ' ' || source, '(20\\d{{2}})', 1), '') y, case {_MARKS} end k from (select *, false fresh from {derived.text('OLD')} union all select *, true from {derived.text('NEW')})),
    d as (select *, case when y is null and k is null then null else coalesce(y, 'unknown') || ':' || coalesce(k, 'unknown') end ident from i), n as (select * from d where fresh)
    select doc_id, title, source, ticker from d where fresh or not (source in (select source from n) or title in (select title from n) or coalesce((ticker, ident) in (select (ticker, ident) from n where ticker is not null and ident is not null), false))"""


# ---------------------------------------------------------------- stored index
@query(f"with {BM25_SQL} select query_id, doc_id, rank::int rank, round(score, 6) score from kw where rank <= 10")
def stored_bm25_topk(spark, sf_dir):
    """Documents are indexed in two batches; the second one replaces what the first one had of a third of them.
    Benchmark texts are then searched in the stored postings."""
    texts, asked = _texts(spark, sf_dir), _asked(spark, sf_dir)
    late = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    with shared_folder(spark, "index") as path:
        index = StoredIndex(spark, path)
        index.add(texts.withColumn("text", F.when(late, F.concat(F.reverse("text"), F.lit(" an older text"))).otherwise(F.col("text"))))
        index.add(texts.where(late))
        hits = cut(index.search(asked, 10))
    return hits.select("query_id", F.col("chunk_id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


@query(
    f"""with d as (select doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '{LATIN}') t from documents), q as (select item_id query_id, text qtext, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{LATIN}')) ts from benchmark),
    m as (select query_id, doc_id, contains(text, qtext) whole, t, ts from q join d on list_has_all(t, ts) where len(ts) > 0),
    p as (select query_id, doc_id, term, list_transform(list_filter(range(1, len(t) + 1), lambda i: t[i] = term)[1:256], lambda i: least(i, 16383)) ps from (select query_id, doc_id, t, unnest(ts) term from m)),
    e as (select query_id, doc_id, term, unnest(ps) pos from p),
    w as (select a.query_id, a.doc_id, 1 - exp(sum(ln(1 - 0.1 * sqrt(case when abs(a.pos - b.pos) > 100 then 1e-30 else 1 / (1.005 + 0.05 * exp(abs(a.pos - b.pos) / 1.5 - 2)) end)))) s
      from e a join e b on a.query_id = b.query_id and a.doc_id = b.doc_id and a.term < b.term group by 1, 2),
    o as (select query_id, doc_id, list_sum(list_transform(range(1, len(ps) + 1), lambda k: 0.1 / (k * k))) / 1.64493406685 s from p join m using (query_id, doc_id) where len(ts) = 1),
    r as (select query_id, doc_id, whole, coalesce(w.s, o.s) s from m left join w using (query_id, doc_id) left join o using (query_id, doc_id))
    select query_id, doc_id, row_number() over (partition by query_id order by round(s, 9) desc, doc_id)::int rank, round(s + whole::int, 6) score from r"""
)
def full_text_ranks(spark, sf_dir):
    """Documents that hold every token of a benchmark text, ranked by how near the tokens stand."""
    hits = full_text(_asked(spark, sf_dir), _texts(spark, sf_dir))
    return hits.select("query_id", F.col("chunk_id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


@query(
    f"""with d as (select c_custkey doc_id, list_distinct(['alpha' || c_nationkey, lower(c_mktsegment), 'k' || (c_custkey % 10), case when c_custkey % 3 = 0 then 'gamma' else 'delta' end]) ts, [lower(c_mktsegment), 'alpha' || c_nationkey, 'k' || (c_custkey % 10), case when c_custkey % 3 = 0 then 'gamma' else 'delta' end, lower(c_mktsegment)] t from customer),
    q as (select n_nationkey query_id, ['alpha' || n_nationkey, case when n_nationkey % 2 = 0 then 'gamma' end] ts0 from nation), q1 as (select query_id, list_filter(ts0, lambda x: x is not null) ts from q),
    m as (select query_id, doc_id, t, q1.ts from q1 join d on list_has_all(d.t, q1.ts)),
    e as (select query_id, doc_id, ts, list_position(t, ts[1]) a, list_position(t, ts[2]) b from m),
    s as (select query_id, doc_id, case when len(ts) = 1 then 0.1 / 1.64493406685 else 0.1 * sqrt(1 / (1.005 + 0.05 * exp(abs(a - b) / 1.5 - 2))) end s from e)
    select query_id, doc_id, row_number() over (partition by query_id order by round(s, 9) desc, doc_id)::int rank, round(s, 6) score from s qualify rank <= 5"""
)
def full_text_short(spark, sf_dir):
    """Queries of one and two words over short texts made of customers, the best five."""
    c = table(spark, sf_dir, "customer")
    alpha, kind = F.concat(F.lit("alpha"), "c_nationkey"), F.lower("c_mktsegment")
    words = F.array(kind, alpha, F.concat(F.lit("k"), F.col("c_custkey") % 10), F.when(F.col("c_custkey") % 3 == 0, "gamma").otherwise("delta"), kind)
    texts = c.select(F.col("c_custkey").alias("chunk_id"), F.col("c_custkey").alias("doc_id"), F.array_join(words, " ").alias("text"))
    # a mark after the words keeps the point for whole queries out
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.lit("? alpha"), "n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, " gamma").otherwise("")).alias("query"))
    return full_text(asked, texts, 5).select("query_id", F.col("chunk_id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every 50th vector as a query, and all vectors."""
    v = table(spark, sf_dir, "embeddings")
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v.select(F.col("vec_id").alias("chunk_id"), "embedding")


@query(ORACLE_SQL["cosine_topk"])
def stored_cosine_topk(spark, sf_dir):
    """True cosine over stored inverted lists, added in two batches, with all cells searched."""
    asked, vectors = _vectors(spark, sf_dir)
    with shared_folder(spark, "vectors") as path:
        index = InvertedLists(spark, path)
        index.add(vectors.where("chunk_id % 2 = 0"))
        index.add(vectors.where("chunk_id % 2 = 1"))
        hits = cut(index.search(asked, 5, probes=CELLS))
    return hits.select("query_id", F.col("chunk_id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


@query()
def vector_index_recall(spark, sf_dir):
    """Recall of the 10 best in two thirds of the cells (the given vectors have no clusters) against the exact scan, for each query."""
    asked, vectors = _vectors(spark, sf_dir)
    with shared_folder(spark, "vectors") as path:
        index = InvertedLists(spark, path)
        index.add(vectors)
        found = index.search(asked, 10, probes=max(4, len(index.centers()) * 2 // 3))
        out = cut(recall(found, nearest(asked, vectors, 10, true_cosine=True)))
    return out.select("query_id", F.round("recall", 4).alias("recall"))


def _pack_sql(units: str, between: str) -> str:
    """Greedy packing of a list of (t, hard)."""
    most, step = 420, f"a.b || {between} || b.b"
    flush = "case when a.b <> '' then list_append(a.d, a.b) else a.d end"
    fold = f"""list_reduce(list_transform({units}, lambda u: {{'d': []::varchar[], 'b': u.t, 'h': u.hard}}), lambda a, b: case when b.h then {{'d': list_append({flush}, b.b), 'b': '', 'h': false}}
        when a.b = '' then {{'d': a.d, 'b': b.b, 'h': false}} when length({step}) > {most} then {{'d': list_append(a.d, a.b), 'b': b.b, 'h': false}} else {{'d': a.d, 'b': {step}, 'h': false}} end, {{'d': []::varchar[], 'b': '', 'h': false}})"""
    return f"(case when len({units}) = 0 then []::varchar[] else list_transform([{fold}], lambda r: case when r.b <> '' then list_append(r.d, r.b) else r.d end)[1] end)"


def _split_sql(x: str, marks: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({x}, '([{marks}]){WS}*', '\1' || chr(1), 'g'), chr(1)), lambda y: {strip_sql('y')}), lambda y: y <> '')"


_CLAUSES = _pack_sql(f"flatten(list_transform({_split_sql('s', '，、：:,')}, lambda c: case when length(c) > 420 then list_transform(range(0, (length(c) + 419) // 420), lambda k: {{'t': substr(c, (k * 420 + 1)::int, 420), 'hard': true}}) else [{{'t': c, 'hard': false}}] end))", "''")
ORACLE_SQL["text_packing"] = f"""with l as (select doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '{EOL}'), lambda x: {strip_sql('x')}), lambda x: x <> '') ls from documents),
    c as (select doc_id, trim(regexp_replace(array_to_string(list_filter(ls, lambda x: not {NOISE}), chr(10)), '{WS}+', ' ', 'g')) p from l),
    s as (select doc_id, p, unnest(case when length(p) > 420 then list_transform({_split_sql('p', '。！？；;')}, lambda s, i: {{'s': s, 'i': i}}) else [{{'s': p, 'i': 1}}] end) x from c where p <> ''),
    v as (select doc_id, p, x.s s, x.i i from s),
    k as (select doc_id, p, i, case when length(p) > 420 and length(s) > 420 then list_transform({_CLAUSES}, lambda t: {{'t': t, 'hard': true}}) else [{{'t': s, 'hard': false}}] end u from v),
    g as (select doc_id, any_value(p) p, flatten(list(u order by i)) us from k group by 1),
    h as (select doc_id, list_transform(case when length(p) <= 420 then [p] else {_pack_sql('us', "' '")} end, lambda t: {{'t': t, 'hard': false}}) un from g),
    f as (select doc_id, {_pack_sql('un', 'chr(10)')} ps from h),
    o as (select doc_id, unnest(list_transform(ps, lambda t, i: {{'t': {strip_sql('t')}, 'i': i}})) z from f)
    select doc_id, (z.i - 1)::int chunk_index, length(z.t)::int token_count, sha256(z.t) content_sha256 from o"""


@query(ORACLE_SQL["text_packing"].replace("length(z.t)::int token_count, sha256(z.t) content_sha256", "sha256(z.t) content_sha256"))
def split_passages_sql(spark, sf_dir):
    """2.13: passages of every document by the table function, from SQL."""
    surface.register(spark)
    rows = table(spark, sf_dir, "documents").select("doc_id", clean.clean_text(F.coalesce("text", F.lit(""))).alias("text"))
    return spark.sql("select c.doc_id, p.chunk_index, sha2(p.content, 256) content_sha256 from {c} c, lateral split_passages(c.text, null) p", c=rows)


@query(
    """select doc_id, coalesce(quality = 1, false) and n_chars >= 200 passed from documents left join (select doc_id, max(quality) quality from labels group by 1) using (doc_id) where doc_id is not null"""
)
def report_cases(spark, sf_dir):
    """V5: documents as reports: the label as the period, derived metrics of those that are long."""
    docs, labels = table(spark, sf_dir, "documents").where("doc_id is not null"), table(spark, sf_dir, "labels")
    none = F.array().cast("array<string>")
    infos = labels.groupBy("doc_id").agg(F.max("quality").cast("string").alias("report_period"))
    made = F.when(F.coalesce(F.col("n_chars") >= 200, F.lit(False)), F.array(F.lit("a"), F.lit("b"))).otherwise(none)
    analysed = docs.select("doc_id", made.alias("raw_metrics"), made.alias("derived_metrics"), none.alias("excluded_metrics"))
    usable = F.create_map(F.lit("raw_metrics"), F.array(F.lit("b")))
    cases = docs.select("doc_id", F.lit("1").alias("expected_report_period"), F.array(F.lit("a"), F.lit("b")).alias("expected_derived_metrics"), usable.alias("expected_usable"))
    return evaluate.report_cases(cases, infos, analysed)
