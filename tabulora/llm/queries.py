"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from tabulora.llm import archive, bpe, conversations, decontaminate, fingerprints, infill, jaccard, lm, quality, spelling, substrings, toxicity, urls

QUERIES = {
    "op1_document_fingerprints": fingerprints.op1_document_fingerprints,
    "op2_chat_formatting": conversations.op2_chat_formatting,
    "op3_ngram_jaccard_join": jaccard.op3_ngram_jaccard_join,
    "op3_ngram_jaccard_links": jaccard.op3_ngram_jaccard_links,
    "op4_url_filters": urls.op4_url_filters,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op6_byte_level_bpe": bpe.op6_byte_level_bpe,
    "op7_lm_scoring": lm.op7_lm_scoring,
    "op8_warc_archive": archive.op8_warc_archive,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_substring_dedup": substrings.op10_substring_dedup,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_fill_in_middle": infill.op12_fill_in_middle,
    "op13_quality_classifier": quality.op13_quality_classifier,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _seed_sql(table: str, key: str, words: str) -> str:
    """Spaced seeds of a table's word lists as text, from the masks."""
    parts = []
    for n, mask in enumerate(decontaminate.MASKS):
        taken = " || ' ' || ".join(f"{words}[i + {k}]" for k, c in enumerate(mask) if c == "1")
        parts.append(f"select {key}, i, {n} k, {taken} s from (select {key}, {words}, unnest(range(1, len({words}) - {len(mask) - 2})) i from {table} where len({words}) >= {len(mask)})")
    return " union all ".join(parts)


def _url_sql() -> str:
    """The rules, and the tree of templates level by level."""
    u = urls
    levels, last = [], "f"
    for d in range(u.DEPTH):
        rest = "(nl - cl)"
        pooled = "(nb / greatest(nl, 1))"
        spread = f"sqrt({pooled} * (1 - {pooled}) * (1.0 / greatest(cl, 1) + 1.0 / greatest({rest}, 1)))"
        gap = f"abs(cb / greatest(cl, 1) - (nb - cb) / greatest({rest}, 1))"
        differs = f"(cl >= {u.LABELLED} and {rest} >= {u.LABELLED} and {gap} > {u.DIFFERS} * {spread})"
        varied = f"(kids >= {u.MANY} and kids >= {u.VARIED} * nn)"
        levels.append(f"""
        s{d} as (select *, coalesce(segs[{d + 1}], '') seg from {last}),
        c{d} as (select host, prefix, seg, sum(n) cn, sum(lab) cl, sum(bad) cb from s{d} group by all),
        n{d} as (select *, sum(cn) over w nn, sum(cl) over w nl, sum(cb) over w nb, count(*) over w kids from c{d} window w as (partition by host, prefix)),
        m{d} as (select host, prefix, seg, case when seg = '' then '' when kids > 1 and ({varied} or not {differs}) then '*' else seg end as name from n{d}),
        t{d} as (select s.host, s.form, s.n, s.lab, s.bad, s.segs, s.prefix || case when len(s.segs) > {d} then '/' || m.name else '' end prefix from s{d} s join m{d} m using (host, prefix, seg)),""")
        last = f"t{d}"
    fits = []
    for rule, verdict in sorted(u.RULES, key=lambda r: (-len(r[0]), r[0])):
        host, _, path = rule.partition("/")
        fits.append((f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '/{path}')", rule, verdict))
    rules = " ".join(f"when {c} then '{r}'" for c, r, _ in fits)
    verdicts = " ".join(f"when '{r}' then '{v}'" for _, r, v in fits)
    return rf"""
        with raw as (select page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['h', 'p']) x from pages),
        p as (select page_id, translate(x.h, '{UPPER}', '{LOWER}') host, x.p path from raw),
        g as (select *, array_to_string(list_transform(string_split(path, '/'), lambda s, i: case when i = 1 then s
            when regexp_full_match(s, '[0-9]+(\.[A-Za-z]{{1,5}})?') then regexp_replace(s, '^[0-9]+', '{{n}}')
            when regexp_matches(s, '[0-9]') and regexp_full_match(s, '[0-9A-Fa-f-]{{8,}}(\.[A-Za-z]{{1,5}})?') then regexp_replace(s, '^[0-9A-Fa-f-]+', '{{x}}') else s end), '/') form from p),
        marks as (select doc_id page_id, max(1 - quality) bad from labels where quality is not null group by 1),
        f as (select host, form, count(*) n, count(bad)::double lab, coalesce(sum(bad), 0)::double bad, string_split(form, '/')[2:] segs, '' prefix from g left join marks using (page_id) group by host, form),
        {"".join(levels)}
        z as (select host, form, lab, bad, prefix || case when len(segs) > {u.DEPTH} then '/' || array_to_string(segs[{u.DEPTH + 1}:], '/') else '' end template from {last}),
        share as (select coalesce(sum(bad), 0) / greatest(coalesce(sum(lab), 0), 1) v from z),
        pure as (select host, template, (sum(bad) + {u.WEIGHT} * any_value(v)) / (sum(lab) + {u.WEIGHT}) purity from z, share group by 1, 2),
        j as (select page_id, host, path, case {rules} end as rule, template, purity from g join z using (host, form) join pure using (host, template))
        select page_id, host, path, rule, case rule {verdicts} else case when purity >= {u.REJECT} then 'block' else 'allow' end end verdict, template from j"""


ORACLE_SQL = {
    "op4_url_filters": _url_sql(),
    "op5_benchmark_decontamination": rf"""
        with d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
        b as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') g from benchmark),
        ds as ({_seed_sql("d", "doc_id", "w")}), bs as ({_seed_sql("b", "item_id", "g")}),
        sh as (select distinct doc_id, item_id, ds.i - bs.i s from ds join bs using (k, s)),
        e as (select doc_id, item_id, s, list_transform(range(1, len(g) + 1), lambda j: case when j + s between 1 and len(w) and w[j + s] = g[j] then 1 else 0 end) q from sh join d using (doc_id) join b using (item_id)),
        v as (select doc_id, item_id, s, list_sum(q)::bigint n_equal, len(q)::bigint n_item,
              list_max(list_transform(range(1, greatest(len(q) - 12, 1) + 1), lambda i: list_sum(q[i:i + 12]))) / least(len(q), 13) as share from e),
        r as (select *, row_number() over (partition by doc_id, item_id order by share desc, n_equal desc, s) n from v where share >= 0.75)
        select doc_id, item_id, s::bigint item_at, n_equal, n_item, share from r where n = 1""",
    "op2_chat_formatting": """
        with r as (select distinct conv_id, turn, coalesce(role, '') "role", coalesce(text, '') txt from conversations where conv_id is not null),
        c as (select conv_id, list({'role': "role", 'txt': txt} order by turn nulls first, "role", txt) t from r group by 1),
        k as (select t, min(conv_id) conv_id from c group by t),
        p as (select distinct t[1:i] t from (select t, unnest(range(1, len(t))) i from k))
        select conv_id, len(t)::bigint n_turns,
               array_to_string(list_transform(t, lambda x: '<|im_start|>' || x.role || chr(10) || x.txt || '<|im_end|>' || chr(10)), '') rendered
        from k where not exists (select 1 from p where p.t = k.t)""",
    "op3_ngram_jaccard_join": r"""
        with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
        s as (select distinct doc_id, g from (select doc_id, case when len(ws) < 4 then ws else ws[i:i + 3] end g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) i from w where len(ws) > 0))),
        n as (select doc_id, count(*) n from s group by 1),
        p as (select a.doc_id a, b.doc_id b, count(*) shared from s a join s b using (g) where a.doc_id < b.doc_id group by 1, 2),
        e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared)),
        d as (select a, b from e union select b, a from e),
        r(a, b) as (select doc_id, doc_id from w union select r.a, d.b from r join d on r.b = d.a)
        select w.doc_id, coalesce(n.n, 0)::bigint n_shingles, c.c component_id
        from w left join n using (doc_id) join (select a doc_id, min(b) c from r group by 1) c using (doc_id)""",
    "op3_ngram_jaccard_links": r"""
        with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
        s as (select distinct doc_id, g from (select doc_id, case when len(ws) < 4 then ws else ws[i:i + 3] end g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) i from w where len(ws) > 0))),
        n as (select doc_id, count(*) n from s group by 1),
        p as (select a.doc_id a, b.doc_id b, count(*) shared from s a join s b using (g) where a.doc_id <> b.doc_id group by 1, 2),
        e as (select a, count(*) k, min(case when shared = x.n and shared = y.n then b end) least_copy from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared) group by a)
        select w.doc_id, coalesce(n.n, 0)::bigint n_shingles, least(w.doc_id, coalesce(least_copy, w.doc_id)) class_id, coalesce(k, 0)::bigint n_links
        from w left join n using (doc_id) left join e on e.a = w.doc_id""",
    "op8_warc_archive": """
        with p as (select page_id, coalesce(html, '') h from pages),
        d as (select page_id, h, sha1(h) x, max(page_id) over (partition by h) m from p),
        g as (select page_id, h, m, list_transform(range(0, 8), lambda k: ('0x' || substr(x, 1 + 5 * k::int, 5))::bigint) v from d)
        select page_id, strlen(h)::bigint payload_bytes,
               array_to_string(list_transform(flatten(list_transform(v, lambda n: [(n >> 15) & 31, (n >> 10) & 31, (n >> 5) & 31, n & 31])), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', i::int + 1, 1)), '') payload_digest,
               case when page_id = m then 'response' else 'revisit' end record_type,
               case when page_id = m then null else m end refers_to
        from g""",
    "op10_substring_dedup": r"""
        with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
        win as (select doc_id, i, list_slice(ws, i, i + 12) g from (select doc_id, ws, unnest(range(1, len(ws) - 11)) i from w)),
        m as (select g, min(doc_id) lo from win group by g),
        gone as (select doc_id, list(distinct p) ps from (select doc_id, unnest(range(i, i + 13)) p from win join m using (g) where doc_id > lo) group by 1)
        select w.doc_id, len(ws)::bigint n_words, coalesce(len(ps), 0)::bigint n_removed,
               sha256(array_to_string(case when ps is null then ws else list_filter(ws, lambda x, i: not list_contains(ps, i)) end, ' ')) kept_sha256
        from w left join gone using (doc_id)""",
    "op11_spelling_variants": rf"""
        with recursive t as (select list_transform(range(0, 256), lambda b: list_reduce(range(0, 8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b::bigint)) crc),
        r as (select distinct doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{UPPER}', '{LOWER}') w from documents),
        c as (select doc_id, w, coalesce(xor(list_reduce(list_transform(range(1, strlen(k) + 1), lambda i: ('0x' || substr(hex(encode(k)), 2 * i::int - 1, 2))::bigint), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295), 1) h from (select *, doc_id || ':' || w k from r), t),
        m as (select doc_id, w, case when h % 97 = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end v from c),
        o as (select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{UPPER}', '{LOWER}') w from documents),
        a as (select v word, sum(k)::bigint n from (select doc_id, w, count(*) k from o group by all) join m using (doc_id, w) group by 1 having length(v) >= 5 and sum(k) >= 3),
        g as (select word, n, i, substr(word, 1, i::int - 1) || substr(word, i::int + 1) d from (select word, n, unnest(range(1, length(word) + 1)) i from a)),
        e as (select x.word, y.word near, y.n m from g x join g y on x.i = y.i and x.d = y.d and x.word <> y.word and length(x.word) = length(y.word)
              union select x.word, y.word, y.n from g x join a y on x.d = y.word union select y.word, x.word, x.n from g x join a y on x.d = y.word),
        b as (select word, count(*)::bigint n_near, first(near order by m desc, near) near, max(m) m from e group by 1),
        f as (select a.word, a.n, coalesce(n_near, 0)::bigint n_near, case when m >= 2 * a.n then near end form, case when m >= 2 * a.n then m end form_n from a left join b using (word)),
        z(word, root) as (select word, word from f union all select z.word, f.form from z join f on f.word = z.root where f.form is not null)
        select f.word, f.form, z.root, f.n, f.n_near, f.form_n from f join z on z.word = f.word join f u on u.word = z.root where u.form is null""",
    "op12_fill_in_middle": r"""
        with d as (select doc_id, coalesce(text, '') x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') u, sha256('1:' || coalesce(doc_id::varchar, '')) s from documents),
        h as (select *, len(u)::bigint n, list_transform([1, 9, 17, 25], lambda p: ('0x' || substr(s, p::int, 8))::bigint) h from d),
        f as (select *, case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or h[3] % 100 >= 90 then 'plain' when h[4] % 100 < 20 then 'spm' else 'psm' end form,
              least(h[1] % (n + 1), h[2] % (n + 1)) a, greatest(h[1] % (n + 1), h[2] % (n + 1)) b from h),
        p as (select *, array_to_string(u[1:a], '') pre, array_to_string(u[a + 1:b], '') mid, array_to_string(u[b + 1:], '') suf from f)
        select doc_id, n, form, case when form <> 'plain' then length(pre)::bigint end prefix_chars, case when form <> 'plain' then length(mid)::bigint end middle_chars,
               sha256(case form when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid when 'spm' then '<S>' || suf || '<P>' || pre || '<M>' || mid else x end) output_sha256,
               sha256(x) restored_sha256 from p""",
}
