"""DuckDB SQL for those queries of this subpackage that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLE_SQL = {
    "op1_warc": """with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
k as (select *, max(page_id) over (partition by payload_digest) as keeper from p),
t as (select *, payload_bytes >= 1000 and keeper is not null and page_id is distinct from keeper as again from k)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then keeper end as refers_to from t""",
    "op8_jaccard_join": f"""with recursive w as (select doc_id, {_WORDS} as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as sh from w),
n as (select doc_id, count(*) as n from s group by 1),
-- equal sets need one comparison: pairs are made between the smallest doc_ids of each
sig as (select doc_id, md5(string_agg(sh, chr(10) order by sh)) as sig from s group by 1),
rep as (select doc_id, min(doc_id) over (partition by sig) as rep from sig),
u as (select s.* from s join rep r on r.doc_id = s.doc_id and r.rep = r.doc_id),
o as (select a.doc_id as x, b.doc_id as y, count(*) as c from u a join u b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from o join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)),
e as (select x, y from l union select y, x from l),
reach as (select distinct rep as node, rep as to_ from rep union select r.node, e.y from reach r join e on e.x = r.to_),
comp as (select node, min(to_) as component from reach group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.component, d.doc_id) as component_id, coalesce(r.rep, d.doc_id) as set_id
from documents d left join n on n.doc_id = d.doc_id left join rep r on r.doc_id = d.doc_id left join comp c on c.node = r.rep""",
    "op9_suffix_dedup": f"""with w as (select doc_id, {_WORDS} as w from documents),
wins as (select doc_id, i as pos, md5(array_to_string(list_slice(w, i + 1, i + 50), ' ')) as h from (select doc_id, w, unnest(range(0, greatest(len(w) - 49, 0))) as i from w)),
g as (select doc_id, pos, count(*) over (partition by h) as c, first_value(doc_id) over (partition by h order by doc_id, pos) as sd, first_value(pos) over (partition by h order by doc_id, pos) as sp from wins),
r as (select *, doc_id = sd and pos = sp as is_source from g where c > 1),
b as (select *, case when pos <= lag(pos) over (partition by doc_id, is_source order by pos) + 50 then 0 else 1 end as fresh from r),
k as (select *, sum(fresh) over (partition by doc_id, is_source order by pos) as island from b)
select doc_id, min(pos)::bigint as start_word, (max(pos) + 50 - min(pos))::bigint as n_words, is_source, arg_min(sd, pos) as source_doc_id, arg_min(sp, pos)::bigint as source_start from k group by doc_id, is_source, island""",
}
