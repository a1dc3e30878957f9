"""The queries of this package and the SQL that checks them."""

from __future__ import annotations

from . import ann, chat, jaccard_join, mixing, pieces, pii, quality_rules, secrets, substring_dedup, toxicity


def queries() -> dict:
    return {
        "op1_secret_scans": secrets.op1_secret_scans,
        "op2_ngram_jaccard_join": jaccard_join.op2_ngram_jaccard_join,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_sentencepiece": pieces.op4_sentencepiece,
        "op5_mixing": mixing.op5_mixing,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_substring_dedup": substring_dedup.op7_substring_dedup,
        "op8_nearest_neighbours": ann.op8_nearest_neighbours,
        "op9_chat_formatting": chat.op9_chat_formatting,
        "op10_pii": pii.op10_pii,
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op2_ngram_jaccard_join": rf"""with recursive d as (select row_number() over () as id, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
        g as (select distinct id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from d),
        n as (select id, count(*) as n, md5(string_agg(s, chr(10) order by s)) as digest from g group by 1), c as (select digest, min(id) as id, any_value(n) as n from n group by 1),
        r as (select g.* from g join c using (id)), p as (select a.id as a, b.id as b, count(*) as shared from r a join r b on a.s = b.s and a.id < b.id group by 1, 2),
        l as (select a, b from p join c x on x.id = a join c y on y.id = b where 100 * shared >= 90 * (x.n + y.n - shared)), e as (select a, b from l union all select b, a from l),
        t as (select id as a, id as b from c union select t.a, e.b from t join e on e.a = t.b), k as (select n.id, n.digest, d.doc_id, n.n from n join d using (id)),
        m as (select digest, min(doc_id) as class_id from k group by 1), z as (select t.a, min(m.class_id) as component_id from t join c on c.id = t.b join m using (digest) group by 1)
        select d.doc_id, coalesce(k.n, 0) as n_shingles, coalesce(m.class_id, d.doc_id) as class_id, coalesce(z.component_id, d.doc_id) as component_id
        from d left join k using (id) left join m using (digest) left join c on c.digest = k.digest left join z on z.a = c.id""",
    "op6_quality_rules": r"""with d as (select row_number() over () as id, doc_id, source, coalesce(text, '') as t from documents), w as (select id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from d),
        u as (select id, unnest(w) as word, generate_subscripts(w, 1) as pos from w), f as (select id, pos, string_agg(word, ' ') over x as win, count(*) over x as n from u window x as (partition by id order by pos rows between current row and 4 following)),
        r as (select id, pos, n = 5 and count(*) over (partition by id, n, win) > 1 as twice from f), v as (select id, pos, max(twice) over (partition by id order by pos rows between 4 preceding and current row) as covered from r), q as (select id, count(*) filter (where covered) as repeated from v group by 1),
        l as (select id, source, unnest(string_split(t, chr(10))) as line from d), m as (select id, source, line, regexp_extract_all(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[^\x20\x09-\x0D]+') as ws from l),
        k as (select id, source, line, len(ws) as words, array_to_string(ws, ' ') as norm from m where len(ws) > 0), dup as (select id, count(*) - count(distinct line) as n_dup_lines from k group by 1),
        h as (select source, count(*) as docs from d group by 1), o as (select k.source, norm from k join h on k.source is not distinct from h.source group by 1, 2, docs having count(distinct id) > 5 and (count(distinct id) > 20 or count(distinct id) > 0.1 * docs)),
        g as (select id, sum(words) as removed from k join o on o.norm = k.norm and o.source is not distinct from k.source group by 1),
        a as (select d.doc_id, len(w.w) as n_words, length(array_to_string(w.w, '')) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(repeated, 0) as n_repeat_words, coalesce(removed, 0) as removed
        from d join w using (id) left join dup using (id) left join q using (id) left join g using (id)), b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, cast(n_words - removed as bigint) as words_left from a)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, words_left, not base_failed and words_left >= 10 and words_left >= 0.5 * n_words as kept from b""",
    "op8_nearest_neighbours": """with v as (select row_number() over () as id, vec_id, cast(embedding as double[]) as e from embeddings where vec_id is not null and embedding is not null),
        u as (select * from v where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
        s as (select q.id, q.vec_id as query_id, c.vec_id, sqrt(list_sum(list_transform(generate_series(1, len(q.e)), lambda i: (c.e[i] - q.e[i]) * (c.e[i] - q.e[i])))) as score from u q join u c on c.id <> q.id and len(c.e) = len(q.e) where q.vec_id % 100 = 0),
        r as (select *, row_number() over (partition by id order by score, vec_id) as rank from s) select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 10""",
    "op7_substring_dedup": r"""with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w, row_number() over () as id from documents),
        w as (select id, unnest(w) as word, generate_subscripts(w, 1) as pos from d),
        g as (select id, pos, word, string_agg(word, ' ') over f as win, count(*) over f as n from w window f as (partition by id order by pos rows between current row and 34 following)),
        r as (select win from g where n = 35 group by win having count(*) > 1),
        h as (select id, pos, word, case when n = 35 and win in (select win from r) then 1 else 0 end as hit from g),
        k as (select id, pos, word, max(hit) over (partition by id order by pos rows between 34 preceding and current row) as gone from h)
        select any_value(doc_id) as doc_id, cast(any_value(len(d.w)) as bigint) as n_words, cast(coalesce(sum(gone), 0) as bigint) as n_removed, sha256(coalesce(string_agg(case when gone = 0 then word end, ' ' order by pos), '')) as kept_sha256
        from d left join k using (id) group by id""",
    "op9_chat_formatting": """with t as (select conv_id, row_number() over (partition by conv_id order by turn, coalesce(role, ''), coalesce(text, '')) as nth, coalesce(role, '') as r, coalesce(text, '') as x from conversations),
        c as (select conv_id, count(*) as n_turns, string_agg('<|' || r || '|>' || chr(10) || x || chr(10) || '<|end|>' || chr(10), '' order by nth) as chat from t group by conv_id)
        select conv_id, n_turns, chat from c where not exists (select 1 from c d where d.n_turns > c.n_turns and starts_with(d.chat, c.chat)) and not exists (select 1 from c d where d.chat = c.chat and d.conv_id < c.conv_id)""",
}


def oracle_sql() -> dict:
    return dict(ORACLE)
