"""PAGE XML in SQL, for comparisons: tags by a regular expression, nesting by running sums over them.

A body counts if its tags close in order, it has one root with nothing but blanks beside it,
attributes are quoted, and every ampersand begins a reference. The level of each tag is the
running sum of opening and closing ones; on one level openings and closings take turns, so
the next tag of a level ends an element.
"""

from __future__ import annotations

NUMBER = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"
#: Tags with the text behind them; comments, instructions and declarations are no tags.
PIECE = r"(?s)(<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>]*>|<[^<>]*>)([^<]*)"
TAG = r"""^<(/[^\s/<>="'']+\s*|[^\s/<>="'']+(\s+[^\s=<>"'']+\s*=\s*("[^"<]*"|''[^''<]*''))*\s*/?)>$"""
REFERENCE = "&(amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);"


def attribute(name: str) -> str:
    """The value of an attribute of ``tag``, null without it."""
    whole = rf"""\s{name}\s*=\s*("[^"]*"|''[^'']*'')"""
    return f"""case when regexp_matches(tag, '{whole}') then {plain(f"regexp_extract(tag, '{whole}', 1)[2:-2]")} end"""


def plain(t: str) -> str:
    """Text without references and with line ends as XML has them."""
    t = f"replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    named = " ".join(f"when c = '&{n};' then chr({ord(x)})" for n, x in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", chr(39)), ("amp", "&")))
    each = f"case when c[1:3] = '&#x' then chr(('0x' || c[4:-2])::int) when c[1:2] = '&#' then chr(c[3:-2]::int) {named} else c end"
    return f"array_to_string(list_transform(regexp_extract_all({t}, '{REFERENCE}|[^&]+|&', 0), lambda c: {each}), '')"


BASE = rf"""with bodies as (select distinct xml_id, ltrim(body, chr(65279)) as body from page_xml where trim(body) <> ''),
 pieces as (select xml_id, unnest(regexp_extract_all(body, '{PIECE}', 1)) as tag, unnest(regexp_extract_all(body, '{PIECE}', 2)) as txt, unnest(range(1, len(regexp_extract_all(body, '{PIECE}', 1)) + 1)) as i from bodies),
 runs as (select *, sum((tag[2] not in ('!', '?'))::int) over (partition by xml_id order by i) as g from pieces),
 texts as (select xml_id, g, string_agg(case when tag[1:4] = '<![C' then tag[10:-4] else '' end || {plain("txt")}, '' order by i) as content from runs group by all),
 tags as (select *, case when tag[2] = '/' then -1 when tag[-2:] = '/>' then 0 else 1 end as d, regexp_extract(tag, '^</?([^\s/>]+)', 1) as name from runs where tag[2] not in ('!', '?')),
 deep as (select *, sum(d) over (partition by xml_id order by i) as dep, regexp_extract(name, '([^:]*)$', 1) as local from tags),
 lev as (select *, case when d = 1 then dep else dep + 1 end as level from deep),
 turns as (select xml_id, i, lag(name) over w as prev, lag(d) over w as prev_d, lead(i) over w as after from lev where d <> 0 window w as (partition by xml_id, level order by i)),
 el as (select l.*, t.prev, t.prev_d, case when l.d = 0 then l.i else t.after end as until from lev l left join turns t using (xml_id, i)),
 left_over as (select xml_id, regexp_replace(body, '{PIECE}', '', 'g') as x from bodies),
 bad as (select xml_id from el where (d = -1 and (prev is distinct from name or prev_d is distinct from 1)) or dep < 0 or not regexp_matches(tag, '{TAG}') or contains(regexp_replace(tag, '{REFERENCE}', '', 'g'), '&') or (dep = 0 and trim(txt, chr(32) || chr(9) || chr(10) || chr(13)) <> '')
  union select xml_id from pieces where contains(regexp_replace(txt, '{REFERENCE}', '', 'g'), '&') and tag[1:4] <> '<![C'
  union select xml_id from left_over where trim(x, chr(32) || chr(9) || chr(10) || chr(13)) <> ''
  union select xml_id from el group by xml_id having sum(d) <> 0 or count(*) filter (level = 1 and d >= 0) <> 1),
 good as (select * from el where d >= 0 and xml_id not in (select xml_id from bad)),
 regions as (select xml_id, i, until, level, (row_number() over (partition by xml_id order by i) - 1)::int as region_no, {attribute("id")} as region_id from good where local = 'TextRegion'),
 lines0 as (select xml_id, i, until, level, (row_number() over (partition by xml_id order by i) - 1)::int as line_no, {attribute("id")} as line_id from good where local = 'TextLine'),
 lines as (select l.xml_id, l.i, l.until, l.level, line_no, any_value(line_id) as line_id, arg_max(region_no, r.level) as region_no, arg_max(struct_pack(x := region_id), r.level).x as region_id from lines0 l left join regions r on r.xml_id = l.xml_id and r.i < l.i and r.until > l.i group by l.xml_id, l.i, l.until, l.level, line_no),
 kids as (select g.*, l.line_no, l.region_no from good g join lines l on g.xml_id = l.xml_id and g.level = l.level + 1 and g.i > l.i and g.i < l.until where g.local in ('Coords', 'TextEquiv')),
 coords as (select xml_id, i, until, level, line_no, region_no, {attribute("points")} as points from kids where local = 'Coords'),
 written as (select xml_id, line_no, region_no, i, unnest(regexp_extract_all(points, '{NUMBER},{NUMBER}')) as xy, unnest(range(1, len(regexp_extract_all(points, '{NUMBER},{NUMBER}')) + 1)) as k from coords where regexp_matches(points, '^\s*{NUMBER},{NUMBER}(\s+{NUMBER},{NUMBER})*\s*$')),
 marks as (select c.xml_id, c.line_no, c.region_no, c.i, p.i as k, {attribute("x")} as x, {attribute("y")} as y from coords c join good p on p.xml_id = c.xml_id and p.level = c.level + 1 and p.i > c.i and p.i < c.until and p.local = 'Point' where coalesce(trim(points), '') = ''),
 whole as (select xml_id, i from marks group by all having bool_and(coalesce(regexp_matches(x, '^\s*{NUMBER}\s*$') and regexp_matches(y, '^\s*{NUMBER}\s*$'), false))),
 points as (select xml_id, line_no, region_no, (row_number() over (partition by xml_id, line_no order by i, k) - 1)::int as point_no, x, y from (
  select xml_id, line_no, region_no, i, k, split_part(xy, ',', 1)::double as x, split_part(xy, ',', 2)::double as y from written
  union all select xml_id, line_no, region_no, i, k, trim(x)::double, trim(y)::double from marks join whole using (xml_id, i))),
 said as (select e.xml_id, e.i, arg_min(struct_pack(t := content), u.i) filter (u.local = 'Unicode') as unicode, arg_min(struct_pack(t := content), u.i) filter (u.local = 'PlainText') as other from kids e join (select * from good join texts using (xml_id, g)) u on u.xml_id = e.xml_id and u.level = e.level + 1 and u.i > e.i and u.i < e.until where e.local = 'TextEquiv' group by all),
 readings as (select xml_id, line_no, region_no, (row_number() over (partition by xml_id, line_no order by i) - 1)::int as reading_no, {attribute("index")} as idx, {attribute("conf")} as conf, coalesce(unicode.t, other.t) as text from kids left join said using (xml_id, i) where local = 'TextEquiv')"""

SQL = {
    "p2_found": f"{BASE} select xml_id, region_no, line_no, 'line' as child, 0::int as child_no from lines union all select xml_id, region_no, line_no, 'coords', point_no from points union all select xml_id, region_no, line_no, 'textequiv', reading_no from readings",
    "p2_lines": f"{BASE} select xml_id, region_no, line_no, line_id, region_id from lines",
    "p2_points": f"{BASE} select xml_id, line_no, point_no, x, y from points",
    "p2_readings": f"{BASE} select xml_id, line_no, reading_no, idx, conf, text from readings",
}
