"""SQL that must give the same rows as those opN_ queries that SQL can express."""

from __future__ import annotations

from priorframe.llm import secrets

PROBE = r"\### Assistant: </turn> ok"
WORD = r"[^\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op2() -> str:
    """Pieces between matches and the matches themselves add up to the offsets."""
    parts, each = [], []
    for k, (kind, pattern, group, least, _) in enumerate(secrets.RULES):
        p = _quoted(pattern)
        parts.append(f"regexp_extract_all(t, {p}) m{k}, regexp_extract_all(t, {p}, {group}) g{k}, string_split_regex(t, {p}) s{k}")
        start = f"coalesce(list_sum(list_transform(s{k}[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m{k}[1:i - 1], lambda x: length(x))), 0)"
        each.append(
            f"list_transform(list_filter(range(1, len(m{k}) + 1), lambda i: length(g{k}[i]) >= {least}), lambda i: {{'a': ({start})::bigint, 'r': {k}, 'e': ({start} + length(m{k}[i]))::bigint, 'k': '{kind}'}})"
        )
    joined = "list_sort(flatten([" + ", ".join(each) + "]))"
    text = "array_to_string(list_transform({}, lambda x: x.k || ':' || x.a || ':' || x.e), ',')"
    n = ", ".join(f"len(list_filter(l, lambda x: x.r = {k}))::bigint n_{kind}" for k, kind in enumerate(secrets.BASE))
    return f"""with d as (select doc_id, coalesce(text, '') t from documents), p as (select *, {', '.join(parts)} from d), q as (select doc_id, t, {joined} l from p)
select doc_id, {n}, sha256(coalesce({text.format('list_filter(l, lambda x: x.r < 3)')}, '')) base_sha256, coalesce({text.format('l')}, '') spans, sha256(t) blob from q"""


OP5 = rf"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') w from documents),
win as (select doc_id, i, hash(array_to_string(w[i:i + 12], ' ')) k, array_to_string(w[i:i + 12], ' ') words from d, unnest(range(1, len(w) - 11)) t(i)),
first as (select k, words, min(doc_id) m from win group by k, words),
hit as (select win.doc_id, win.i from win join first using (k, words) where m < win.doc_id),
gone as (select doc_id, list_distinct(flatten(list(range(i, i + 13)))) c from hit group by doc_id),
kept as (select d.doc_id, w, coalesce(len(c), 0) n, case when c is null then w else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: not list_contains(c, x[2])), lambda x: x[1]) end k from d left join gone using (doc_id))
select doc_id, len(w)::bigint n_words, n::bigint n_removed, sha256(coalesce(array_to_string(k, ' '), '')) kept_sha256 from kept"""

OP6 = rf"""with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations union all select -7, 0, 'user', '{PROBE}' union all select -7, 1, 'assistant', '{PROBE}'),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, r, t) n from c), b as (select *, n = 1 or r <> lag(r) over (partition by conv_id order by n) starts from o),
s as (select *, length(regexp_replace(t, '(###|</turn>|<cut/>)', '\\\1', 'g')) + case when starts then 6 + length(replace(replace(r, '\', '\\'), chr(10), '\n')) + 9 else 8 end chars from b)
select conv_id, count(*)::bigint n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by n)) turns_sha256, coalesce(sum(length(t)) filter (r = 'assistant'), 0)::bigint loss_chars,
sha256(coalesce(string_agg(t, '' order by n) filter (r = 'assistant'), '')) loss_sha256, sum(chars)::bigint formatted_chars, count(*) filter (starts)::bigint n_blocks from s group by conv_id"""

OP7 = """with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) q from embeddings where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select a.vec_id query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint score from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
r as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int rank from p) select query_id, rank, vec_id, score from r where rank <= 10"""

_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1))"
_SEGMENT = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]*)', 1)"


def _day(c: str, place: int) -> str:
    return f"(date '2024-01-01' + (('0x' || substr(md5({c}), {place}, 4))::int % 360))::date"


OP10 = f"""with p as (select page_id, url, {_day('url', 1)} "at", {_HOST} h, {_SEGMENT} s from pages),
hosts as (select distinct h, s from p where h <> ''),
listed as (select distinct 'host' kind, regexp_replace(h, '^(m|blog|www)\\.', '') v from hosts union select 'path', h || '/' || s from hosts where s <> ''),
picked as (select * from listed where (kind = 'host' and substr(md5(v), 9, 1) in ('0', '1', '2', '3', '4')) or (kind = 'path' and substr(md5(v), 9, 1) in ('5', '6'))),
log as (select kind, v, 'add' a, {_day('v', 17)} "at" from picked union select kind, v, 'remove', {_day('v', 21)} from picked where substr(md5(v), 10, 1) < '8'),
spans as (select *, lead("at") over (partition by kind, v order by "at", a) till from log), live as (select kind, v, "at" since, till from spans where a = 'add' and (till is null or till > "at")),
hit as (select page_id, url, p."at", max({{'n': length(v), 'v': v, 'since': since}}) b from p join live l on p."at" >= since and (till is null or p."at" < till) and h <> '' and ((kind = 'host' and (h = v or ends_with(h, '.' || v))) or (kind = 'path' and s <> '' and h || '/' || s = v)) group by all)
select p.page_id, p.url, p."at" fetched_at, b is not null listed, b.v rule, b.since since from p left join hit on p.page_id is not distinct from hit.page_id and p.url = hit.url and p."at" = hit."at" """

SQL = {"op2_secret_ledger": op2(), "op5_fm_substrings": OP5, "op6_chat_format": OP6, "op7_mtree_top_k": OP7, "op10_dated_lists": OP10}
