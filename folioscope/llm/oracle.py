"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from folioscope.llm.lines import MIN_CHARS, MIN_FUZZY, WORD_LINES
from folioscope.llm.quality import MAX_REPEAT_PERCENT, MIN_WORDS, RULES, STOP_WORDS, WINDOW
from folioscope.llm.queries import URL_RULES

_WORD = r"[^\x20\x09-\x0D]+"


def quality_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    ok = []
    for r in RULES:
        ratio = f"(case when {r.below} > 0 then {r.above} / {r.below} end)"
        ok += [f"coalesce({ratio} >= {r.low}, true)"] if r.low is not None else []
        ok += [f"coalesce({ratio} <= {r.high}, true)"] if r.high is not None else []
    return rf"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as t from documents),
w as (select k, doc_id, t, regexp_extract_all(t, '{_WORD}') as w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as lines from d),
win as (select k, i, list_slice(w, i, i + {WINDOW - 1}) as g from (select k, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) as i from w)),
twice as (select k, g from win group by k, g having count(*) > 1),
cov as (select k, count(distinct j) as n from (select win.k, unnest(generate_series(i, i + {WINDOW - 1})) as j from win join twice on win.k = twice.k and win.g = twice.g) group by k),
m as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, len(lines)::bigint as n_lines,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words,
        len(regexp_extract_all(t, '!'))::bigint as n_shouts,
        len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}')))::bigint as n_letter_words,
        len(list_filter(w, lambda x: lower(x) in ({stops})))::bigint as n_stop_words,
        len(list_filter(w, lambda x, i: i > 1 and x = w[i - 1]))::bigint as n_echoes
      from w left join cov using (k))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and {" and ".join(ok)}) as kept
from (select *, (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) as base_failed from m)"""


def urls_sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    return rf"""
with r(verdict, h, p) as (values {rules}),
u as (select row_number() over () as k, page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
s as (select k, page_id, regexp_extract(rest, '^[^/?#]*') as raw, rest from u),
q as (select k, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from s),
m as (select k, max(struct_pack(n := length(h || p), l := length(h), rule := h || p, verdict := verdict)) as best
      from q join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by k)
select page_id, host, path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict from q left join m using (k)"""


TOP_K_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as w from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5"""


def lines_sql(source: str = "documents") -> str:
    """Earlier lines by plain comparison: pairs of distinct lines that share a half are compared, by characters or by words."""
    return rf"""
with d as (select distinct doc_id, text from {source}),
l as (select doc_id, text, unnest(generate_series(1, len(ls))) as no, unnest(ls) as raw from (select *, string_split(text, chr(10)) as ls from d where text is not null)),
m as (select doc_id, text, no, raw, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as norm from l),
f as (select norm, length(norm) as n, string_split(norm, ' ') as w, min({{'doc_id': doc_id, 'no': no}}) as at from m where length(norm) >= {MIN_CHARS} group by norm),
r as (select *, n - d as s, d from f, (values (0), (1)) v(d) where n - d >= {MIN_FUZZY} and len(w) < {WORD_LINES}),
h as (select *, substr(norm, 1, (s // 2)::int) as a, substr(norm, (s // 2)::int + 1 + d) as b from r),
p as (select x.norm as one, y.norm as two, x.at as one_at, y.at as two_at from h x join h y on x.s = y.s and x.a = y.a and x.d <= y.d and x.norm <> y.norm
  union select x.norm, y.norm, x.at, y.at from h x join h y on x.s = y.s and x.b = y.b and x.d <= y.d and x.norm <> y.norm),
rw as (select *, len(w) - d as s, d from f, (values (0), (1)) v(d) where len(w) - d >= {WORD_LINES}),
hw as (select *, w[1:(s // 2)] as a, w[(s // 2 + 1 + d):] as b from rw),
pw as (select x.norm as one, y.norm as two, x.w as v, y.w as w, x.at as one_at, y.at as two_at from hw x join hw y on x.s = y.s and x.a = y.a and x.d <= y.d and x.norm <> y.norm
  union select x.norm, y.norm, x.w, y.w, x.at, y.at from hw x join hw y on x.s = y.s and x.b = y.b and x.d <= y.d and x.norm <> y.norm),
e as (select *, len(list_filter(range(1, least(len(v), len(w)) + 1), lambda i: v[1:i] = w[1:i])) + len(list_filter(range(1, least(len(v), len(w)) + 1), lambda i: v[(len(v) - i + 1):] = w[(len(w) - i + 1):])) as alike from pw),
g as (select distinct case when one_at < two_at then two else one end as norm from (
  select one, two, one_at, two_at from p where levenshtein(one, two) <= 1
  union all select one, two, one_at, two_at from e where alike >= greatest(len(v), len(w)) - 1)),
k as (select m.*, (length(m.norm) < {MIN_CHARS} or (m.doc_id = f.at.doc_id and m.no = f.at.no and g.norm is null)) as keep
  from m left join f on m.norm = f.norm left join g on m.norm = g.norm),
t as (select doc_id, text, coalesce(string_agg(raw, chr(10) order by no) filter (keep), '') as new, count(*)::bigint as n_lines, count(*) filter (not keep)::bigint as n_removed from k group by doc_id, text)
select doc_id, case when text is null then null else coalesce(new, text) end as text, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed
from d left join (select doc_id, text, new, n_lines, n_removed from t) using (doc_id, text)"""


ORACLE = {"op1_line_dedup": lines_sql(), "op2_top_k_search": TOP_K_SQL, "op3_quality_rules": quality_sql(), "op5_url_filters": urls_sql()}
