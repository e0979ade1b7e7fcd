"""DuckDB SQL for the queries of ``queries``."""

_TOK = r"(3 * len(regexp_extract_all({}, '\S+')) + 1) // 2"
_EDGES = r"'^\s+|\s+$'"
_SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace({{}}, '([.!?]) ', concat('\1', chr(1)), 'g'), chr(1)), lambda x: regexp_replace(x, {_EDGES}, '', 'g')), lambda x: x <> '')"
_PACK = """list_append(r.o, r.b)"""
_FOLD = (
    "list_reduce(list_transform(list_transform({0}, lambda s: {{'s': s, 'n': " + _TOK.format("s") + "}}), lambda x: {{'o': []::varchar[], 'b': x.s, 'n': x.n::bigint, 's': x.s}}), "
    "lambda a, x: case when a.b <> '' and a.n + x.n > {1} then {{'o': list_append(a.o, a.b), 'b': x.s, 'n': x.n, 's': x.s}} else {{'o': a.o, 'b': a.b || ' ' || x.s, 'n': a.n + x.n, 's': x.s}} end)"
)

STREAM = """
stream as (
  select doc_id, n, pos, kind, text, (case when pos % 7 = 0 then 1 + (n + pos) % 3 when pos % 7 between 1 and 3 then pos % 3 end)::int as level from (
    select doc_id::varchar as doc_id, doc_id as n, p - 1 as pos, l[p] as text, case when (p - 1) % 7 = 0 then 'heading' when (p - 1) % 7 between 1 and 3 then 'list_item' else 'paragraph' end as kind
    from (select doc_id, string_split(text, chr(10)) as l, unnest(range(1, len(string_split(text, chr(10))) + 1)) as p from documents)
  )
), counted as (
  select *, sum((level < 1)::int) over w as s1, sum((level < 2)::int) over w as s2 from stream where kind = 'list_item' window w as (partition by doc_id order by pos)
), indexed as (
  select doc_id, pos, row_number() over (partition by doc_id, level, case level when 0 then 0 when 1 then s1 else s2 end order by pos) as display_index from counted
), el as (
  select s.doc_id, s.pos::int as pos, s.kind, s.text, s.level, i.display_index,
    case when s.kind = 'paragraph' then last_value(case when s.kind = 'heading' then s.level end ignore nulls) over (partition by s.doc_id order by s.pos) end as h_level,
    case when s.kind = 'paragraph' then last_value(case when s.kind = 'heading' then s.text end ignore nulls) over (partition by s.doc_id order by s.pos) end as h_text,
    null::bigint as note_id, null::varchar as author
  from stream s left join indexed i using (doc_id, pos)
)"""

NOTES = """
el as (
  select doc_id, pos::int as pos, kind, text, case when kind = 'heading' then 1 end as level, case when kind in ('footnote', 'endnote', 'comment') then pos end as note_id, case when kind = 'comment' then role end as author from (
    select *, case when pos % 5 = 4 then 'comment' when pos % 2 = 1 then (case when pos % 4 = 1 then 'footnote' else 'endnote' end) when pos % 4 = 0 then 'heading' else 'paragraph' end as kind from (
      select conv_id::varchar as doc_id, role, text, row_number() over (partition by conv_id order by turn, role, text) - 1 as pos from conversations))
)"""

_PLAIN = "case kind when 'footnote' then '[' || note_id || '] ' || text when 'endnote' then '[endnote ' || note_id || '] ' || text when 'comment' then '[comment ' || note_id || ' by ' || author || '] ' || text else text end"
_MARKDOWN = "case kind when 'heading' then repeat('#', least(level, 6)::int) || ' ' || text when 'list_item' then repeat('  ', level::int) || display_index || '. ' || text else text end"
_MINIMAL = "prof as (select * replace ((row_number() over (partition by doc_id order by pos) - 1)::int as pos) from el where kind not in ('footnote', 'endnote', 'comment'))"
_ACADEMIC = """
hosted as (select *, last_value(case when kind not in ('footnote', 'endnote') then pos end ignore nulls) over (partition by doc_id order by pos) as host from el),
suffixes as (select doc_id, host, string_agg(' (' || case kind when 'footnote' then 'Note ' else 'Endnote ' end || note_id || ': ' || text || ')', '' order by pos) as s from hosted where kind in ('footnote', 'endnote') group by 1, 2),
prof as (
  select h.doc_id, (row_number() over (partition by h.doc_id order by h.pos) - 1)::int as pos, h.kind, h.level, h.note_id, h.author, case when h.kind in ('paragraph', 'list_item', 'heading') then h.text || coalesce(s.s, '') else h.text end as text
  from hosted h left join suffixes s on s.doc_id = h.doc_id and s.host = h.pos where h.kind not in ('footnote', 'endnote')
)"""


def _chunk_rows(source: str, budget: int) -> str:
    keep = ", ".join(f"case when {'true' if k == 1 else f'p{k} > greatest(-1, ' + ', '.join(f'coalesce(p{j}, -1)' for j in range(1, k)) + ')'} and p{k} is not null then '{k}:' || t{k} end" for k in (1, 2, 3))
    places = ", ".join(f"max(case when kind = 'heading' and level = {k} then pos end) over w as p{k}, last_value(case when kind = 'heading' and level = {k} then text end ignore nulls) over w as t{k}" for k in (1, 2, 3))
    return f"""
sized as (select doc_id, pos, kind, level, {_PLAIN} as text from {source}),
over_ as (select *, kind <> 'heading' and {_TOK.format("text")} > {budget} as over from sized),
flags as (select *, lag(pos) over (partition by doc_id order by pos) is not null and (kind = 'heading' or over or coalesce(lag(over) over (partition by doc_id order by pos), false)) as begins, {places} from over_ window w as (partition by doc_id order by pos)),
rows_ as (select *, concat_ws(' > ', {keep}) as stack, sum(begins::int) over (partition by doc_id order by pos) as grp from flags)"""


def _chunks(head: str, source: str, budget: int) -> str:
    fold = _FOLD.format(_SENTENCES.format("text"), budget)
    return f"""with {head}, {_chunk_rows(source, budget)},
groups_ as (select doc_id, grp, string_agg(text, chr(10) || chr(10) order by pos) as text, string_agg(pos::varchar, ',' order by pos) as indices, string_agg(kind, ',' order by pos) as types, arg_max(stack, pos) as context, bool_or(over) as over from rows_ group by 1, 2),
folded as (select *, case when over then {fold} end as r from groups_),
pieces as (select doc_id, grp, indices, types, context, over, case when over then list_append(r.o, r.b) else [text] end as l from folded),
flat as (select * exclude (l), unnest(l) as text, unnest(range(len(l))) as k from pieces)
select doc_id, (row_number() over (partition by doc_id order by grp, k) - 1)::int as chunk_id, text, indices, types, context, ({_TOK.format("text")})::bigint as token_estimate, over as is_oversized from flat"""


def _documents(head: str, render: str, name: str) -> str:
    return f"""with {head}, shown as (select doc_id, pos, kind, {render} as t from el),
apart as (select *, coalesce(max((t <> '')::int) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as seen, lag(kind) over (partition by doc_id order by pos) as before from shown)
select doc_id, string_agg(case when seen = 0 then '' when kind = 'list_item' and before = 'list_item' then chr(10) else chr(10) || chr(10) end || t, '' order by pos) as {name} from apart group by 1"""


_NESTED = f"""with {STREAM}, others as (select *, sum((kind <> 'list_item')::int) over (partition by doc_id order by pos) as o from el), items as (select * from others where kind = 'list_item')"""
CELLS = """lines_ as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 as k from lineitem),
cells as (select l_orderkey as t, (k // 2)::int as row, (k % 2)::int as cell, (1 + l_linenumber % 2)::int as grid_span, case l_returnflag when 'R' then 'restart' when 'A' then 'continue' end as v_merge, l_linestatus as text from lines_)"""

ORACLE_SQL = {
    "token_estimate": f"select doc_id, ({_TOK.format('text')})::bigint as tokens from documents",
    "sentences": f"select doc_id, unnest(range(len(l)))::int as n, unnest(l) as sentence from (select doc_id, {_SENTENCES.format('text')} as l from documents)",
    "packed_fragments": f"with f as (select doc_id, {_FOLD.format(_SENTENCES.format('text'), 800)} as r from documents where {_TOK.format('text')} > 800), g as (select doc_id, list_append(r.o, r.b) as l from f) select doc_id, unnest(range(len(l)))::int as n, unnest(l) as fragment from g",
    "parent_heading": f"with {STREAM} select doc_id, pos, kind, h_level, h_text from el",
    "list_numbering": f"with {STREAM} select doc_id, pos, level, 'decimal' as list_type, display_index from el where kind = 'list_item'",
    "heading_stack": f"with {STREAM}, {_chunk_rows('el', 800)} select doc_id, pos, stack from rows_",
    "chunk_groups": f"with {STREAM}, {_chunk_rows('el', 60)} select doc_id, pos, over, grp::bigint as grp from rows_",
    "list_nesting": f"{_NESTED}, last_ as (select *, max(case when level = 0 then pos end) over w as p0, max(case when level = 1 then pos end) over w as p1 from items window w as (partition by doc_id, o order by pos rows between unbounded preceding and 1 preceding)) select doc_id, pos, (case level when 0 then null when 1 then p0 else greatest(p0, p1) end)::int as parent_pos from last_",
    "list_runs": f"{_NESTED}, runs as (select *, (dense_rank() over (partition by doc_id order by o) - 1)::int as list_id from items) select doc_id, list_id, min(pos)::int as first_pos, count(*) as items from runs group by 1, 2",
    "rag_chunks_default": _chunks(STREAM, "el", 800),
    "rag_chunks_small": _chunks(STREAM, "el", 60),
    "rag_chunks_minimal": _chunks(f"{NOTES}, {_MINIMAL}", "prof", 800),
    "rag_chunks_academic": _chunks(f"{NOTES}, {_ACADEMIC}", "prof", 800),
    "markdown_elements": f"with {STREAM} select doc_id, pos, {_MARKDOWN} as markdown from el",
    "markdown_docs": _documents(STREAM, _MARKDOWN, "markdown"),
    "plain_text_docs": _documents(NOTES, _PLAIN, "plain_text"),
    "table_spans": f"""with {CELLS}, placed as (select *, coalesce(sum(grid_span) over (partition by t, row order by cell rows between unbounded preceding and 1 preceding), 0) as col from cells),
islands as (select *, sum((coalesce(v_merge, '') <> 'continue')::int) over (partition by t, col order by row, cell) as isl from placed)
select t, row, cell, text, col_span, row_span from (select t, row, cell, text, grid_span as col_span, v_merge, (1 + case when v_merge = 'restart' then sum((coalesce(v_merge, '') = 'continue')::int) over (partition by t, col, isl) else 0 end)::int as row_span from islands) where coalesce(v_merge, '') <> 'continue'""",
    "table_markdown": f"""with {CELLS}, lines as (select t, row, '| ' || string_agg(text, ' | ' order by cell) || ' |' as md, string_agg(text, ' | ' order by cell) as plain, count(*) as n from cells group by 1, 2)
select t, string_agg(case when row = 0 then md || chr(10) || '|' || repeat(' --- |', n::int) else md end, chr(10) order by row) as markdown, string_agg(plain, chr(10) order by row) as plain from lines group by 1""",
    "style_resolution": """with recursive s as (select (p_partkey % 16)::varchar as doc_id, p_partkey // 16 as k, case when p_size % 3 = 0 then p_size % 10 end as o from part),
walk as (select doc_id, k as start_, k as cur, 0 as hop, o from s union all select w.doc_id, w.start_, s.k, w.hop + 1, s.o from walk w join s on s.doc_id = w.doc_id and s.k = w.cur // 2 where w.cur > 0)
select doc_id, style_id, depth, outline_level, case when outline_level between 0 and 8 then (outline_level + 1)::int end as heading_level from (select doc_id, start_::varchar as style_id, count(*)::int as depth, arg_min(o, hop)::int as outline_level from walk group by 1, 2)""",
    "list_formats": """with nums as (select (o_custkey % 100)::varchar as doc_id, o_orderkey as num_id, o_orderkey % 7 as a from orders), levels as (select (range // 7)::varchar as doc_id, range % 7 as a, range % 3 as start, (['decimal', 'bullet', 'lowerRoman', 'none', 'upperLetter'])[range % 5 + 1] as num_fmt from range(700))
select doc_id, num_id, start, num_fmt, case num_fmt when 'lowerRoman' then 'lower_roman' when 'upperLetter' then 'other' else num_fmt end as list_type from nums join levels using (doc_id, a) where a < 6""",
    "link_markdown": """with p as (select page_id, url, regexp_extract(html, '<h1>([^<]*)</h1>', 1) as t from pages), w as (select *, (string_split(t, ' '))[2] as word, case page_id % 3 when 0 then nullif(url, '') when 1 then '#top' end as target from p)
select page_id, case when word is null or target is null then t else substr(t, 1, strpos(t, word) - 1) || '[' || word || '](' || target || ')' || substr(t, strpos(t, word) + length(word)) end as markdown from w""",
    "image_types": "select vec_id, (['image/png', 'image/jpeg', 'image/gif', 'image/bmp', 'image/webp', 'application/octet-stream'])[vec_id % 6 + 1] as content_type from embeddings",
    "zip_guards": "with e as (select o_orderkey, trunc(o_totalprice * 1000)::bigint as size, o_orderkey % 200000 as packed from orders) select o_orderkey, size > 104857600 or (size > 0 and packed > 0 and packed::double / size < 0.001) as bomb from e",
    "docx_roundtrip_elements": f"with {STREAM} select doc_id, pos, kind, text, level, display_index, h_text from el",
    "docx_roundtrip_chunks": _chunks(STREAM, "el", 800),
    "docx_markdown": _documents(STREAM, _MARKDOWN, "markdown"),
}
