"""DuckDB SQL for the queries of ``package_queries``."""

from .oracles import CELLS, NOTES

_PAGES = "p as (select page_id, url, regexp_extract(html, '<h1>([^<]*)</h1>', 1) as t from pages), w as (select *, string_split(t, ' ')[1] as word, t || ' ' || string_split(t, ' ')[1] as text, case page_id % 3 when 0 then url when 1 then '#top' end as target from p)"

ORACLE_SQL = {
    "docx_tables": f"""with {CELLS}, placed as (select *, coalesce(sum(grid_span) over (partition by t, row order by cell rows between unbounded preceding and 1 preceding), 0) as col from cells),
islands as (select *, sum((coalesce(v_merge, '') <> 'continue')::int) over (partition by t, col order by row, cell) as isl from placed),
spans as (select *, (1 + case when v_merge = 'restart' then sum((coalesce(v_merge, '') = 'continue')::int) over (partition by t, col, isl) else 0 end)::int as row_span from islands),
places as (select t, (row_number() over (partition by t % 200 order by t) - 1)::int as pos from (select distinct t from cells))
select (t % 200)::varchar as doc_id, pos, row, (row_number() over (partition by t, row order by cell) - 1)::int as k, text, grid_span as col_span, row_span from spans join places using (t) where coalesce(v_merge, '') <> 'continue'""",
    "docx_notes": f"""with {NOTES}, hosted as (select *, last_value(case when kind not in ('footnote', 'endnote', 'comment') then pos end ignore nulls) over (partition by doc_id order by pos) as host from el),
ranked as (select *, case kind when 'footnote' then 1 when 'endnote' then 2 when 'comment' then 3 else 0 end as rank from hosted)
select doc_id, (row_number() over (partition by doc_id order by host, rank, pos) - 1)::int as pos, kind, text, note_id, author,
  case kind when 'heading' then '# ' || text when 'footnote' then '[^' || note_id || ']: ' || text when 'endnote' then '[^endnote' || note_id || ']: ' || text when 'comment' then '> **Comment ' || note_id || ' (' || author || '):** ' || text else text end as markdown,
  case kind when 'footnote' then '[' || note_id || '] ' || text when 'endnote' then '[endnote ' || note_id || '] ' || text when 'comment' then '[comment ' || note_id || ' by ' || author || '] ' || text else text end as plain from ranked""",
    "docx_links": f"""with {_PAGES} select page_id::varchar as doc_id, text, (target is not null)::int as n_links, target as url,
  case when target is null then text else substr(text, 1, strpos(text, word) - 1) || '[' || word || '](' || target || ')' || substr(text, strpos(text, word) + length(word)) end as markdown from w""",
    "docx_rels": "select page_id::varchar as doc_id, 'rel1' as rel_id, url as target, true as is_external from pages where page_id % 3 = 0",
    "docx_parts": "select page_id::varchar as doc_id, 1 as n_items, (page_id % 3 = 0)::int as n_rels, 9 as n_styles, page_id % 3 = 0 as has_rels, true as has_main, 'application/xml' as content_type from pages",
    "docx_sections": """with n as (select * from nation join region on n_regionkey = r_regionkey), c as (select c_nationkey as d, row_number() over (partition by c_nationkey order by c_custkey) - 1 as pos, c_name from customer),
m as (select n_nationkey as d, count(c_custkey) as m from nation left join customer on c_nationkey = n_nationkey group by 1)
select d::varchar as doc_id, pos::int as pos, 'paragraph' as kind, null as slot, c_name as text, 0 as n_content, c_name as markdown from c
union all select d::varchar, m::int, 'header', 'default', null, 2, '> [Header]' || chr(10) || '> ' || n_name || chr(10) || '> ' || chr(10) || '> ' || r_name from n join m on d = n_nationkey
union all select d::varchar, (m + 1)::int, 'header', 'first', null, 1, '> [Header]' || chr(10) || '> ' || n_name from n join m on d = n_nationkey
union all select d::varchar, (m + 2)::int, 'footer', 'even', null, 1, '> [Footer]' || chr(10) || '> ' || r_name from n join m on d = n_nationkey""",
    "docx_formatting": """select (p_partkey % 50)::varchar as doc_id, (row_number() over (partition by p_partkey % 50 order by p_partkey) - 1)::int as item_ord, p_name as text,
  case when p_size % 5 = 0 then false else p_size % 4 in (0, 1) end as bold, p_size % 5 = 1 or p_size % 4 in (1, 2) as italic, p_size % 5 = 2 as underline,
  (case when p_size % 5 = 3 then 30 when p_size % 4 < 3 then 20 end)::bigint as size, case when p_size % 4 = 2 then 'FF0000' end as color from part""",
    "docx_headings": """with e as (select (p_partkey % 50)::varchar as doc_id, (row_number() over (partition by p_partkey % 50 order by p_partkey) - 1)::int as pos, p_name as text, ([2, 4, 4, null, 7])[p_size % 5 + 1] as level from part)
select doc_id, pos, case when level is null then 'paragraph' else 'heading' end as kind, level::int as level, text, case when level is null then last_value(case when level is not null then text end ignore nulls) over (partition by doc_id order by pos) end as h_text from e""",
    "docx_lists": """with e as (select o_custkey % 40 as d, (row_number() over (partition by o_custkey % 40 order by o_orderkey) - 1)::int as pos, 1 + o_orderkey % 3 as num, (o_custkey % 3 % 2)::int as level, o_orderpriority as text from orders),
r as (select *, case when level = 1 then sum((level = 0)::int) over (partition by d, num order by pos) else 0 end as run from e),
i as (select *, row_number() over (partition by d, num, level, run order by pos) as n from r)
select d::varchar as doc_id, pos, 'list_item' as kind, level, (['decimal', 'bullet', 'lower_roman'])[num] as list_type, (case num when 1 then n + 2 when 3 then n end)::bigint as display_index,
  repeat('  ', level) || case when num = 1 then (n + 2)::varchar || '.' else '-' end || ' ' || text as markdown from i""",
    "docx_images": """select (vec_id % 20)::varchar as doc_id, 'word/media/image' || vec_id as path, (['image/png', 'image/jpeg', 'image/gif', 'image/bmp', 'image/webp', 'application/octet-stream'])[vec_id % 6 + 1] as content_type,
  (([8, 3, 6, 2, 12, 1])[vec_id % 6 + 1] + length(vec_id::varchar))::bigint as size, null::varchar as error from embeddings""",
    "docx_errors": """with v as (select s_suppkey::varchar as doc_id, s_suppkey % 8 as k from supplier)
select doc_id, case when k in (4, 5, 7) then 'elements' else 'open' end as stage, (['zip', 'missing_part', 'missing_part', 'xml_parse', 'xml_parse', 'zip_bomb', 'circular_style'])[k] as kind from v where k > 0""",
}
