"""The queries of the core operators as SQL, for an independent engine."""

P2_FOUND = r"""
with r as (
  select distinct 'unit_aircraft' as ref_table, link_id as ref_id, trim(translate(lower(en_designator), '–－', '--')) as k, ingested_at as t from unit_aircraft where trim(en_designator) <> ''
  union all
  select distinct 'rag_chunks', chunk_id, cast(parent_id as varchar), ingested_at from rag_chunks where parent_id is not null),
w as (select trim(translate(lower(asset_title), '–－', '--')) as title, ingested_at as a, deleted_at as z from weg_assets),
keys as (
  select k, a, z from (select title as k, a, z from w union select title[: i - 1], a, z from w, unnest(range(2, length(title) + 1)) as s(i) where title[i] in (' ', '(')) where k <> ''),
g as (
  select 'unit_aircraft' as ref_table, k, a, z from keys
  union all select distinct 'rag_chunks', cast(parent_id as varchar), ingested_at, deleted_at from rag_parents),
j as (
  select r.ref_table, r.ref_id, r.t, count(g.a) as n, count(case when a <= t then 1 end) as begun, count(case when a <= t and (z is null or t < z) then 1 end) as alive
  from r left join g on g.ref_table = r.ref_table and g.k = r.k group by r.ref_table, r.ref_id, r.k, r.t)
select distinct ref_table, ref_id, case when n = 0 then 'missing' when begun > 0 then 'deleted' else 'late' end as reason, strftime(t, '%Y-%m') as ref_month from j where alive = 0
"""

P4_FOUND = r"""
with recursive n as (
  select asset_seq, '' as path, '' as near, false as element, json(dynamic_payload) as v from weg_assets where json_valid(dynamic_payload)
  union all
  select asset_seq, case when path = '' then step else path || ' > ' || step end, case when element then path else near end, is_item and json_type(child) = 'OBJECT', child from (
    select asset_seq, path, near, element, true as is_item, '[' || (i - 1) || ']' as step, json_extract(v, '$[' || (i - 1) || ']') as child
    from n, unnest(range(1, cast(json_array_length(v) as bigint) + 1)) as s(i) where json_type(v) = 'ARRAY'
    union all
    select asset_seq, path, near, element, false, k, json_extract(v, '$."' || k || '"') from n, unnest(json_keys(v)) as s(k) where json_type(v) = 'OBJECT'))
select distinct asset_seq, path as object_path, near as parent_path from n where element
"""


ASSETS = "select * exclude (rn) from (select *, row_number() over (partition by asset_title order by ingested_at desc, asset_seq desc) as rn from weg_assets where asset_title is not null) where rn = 1"
UNITS = """select * exclude (rn) from (select *, row_number() over (partition by unit_key order by ingested_at desc nulls last, unit_name desc nulls last, service desc nulls last, branch desc nulls last, role desc nulls last,
  theater_command desc nulls last, location_text desc nulls last, province desc nulls last, airbase desc nulls last, tactical_code desc nulls last, remarks desc nulls last) as rn from units where unit_key is not null) where rn = 1"""
LINKS = "select * exclude (rn) from (select *, row_number() over (partition by unit_key, raw_designator order by ingested_at, link_id) as rn from unit_aircraft) where rn = 1"
WITH = f"with a as ({ASSETS}), u as ({UNITS}), l as ({LINKS})"
ORIGIN = "case when json_valid(dynamic_payload) then json_extract_string(dynamic_payload, '$.Metadata.Origin') end"
DOMAIN = "case when json_valid(dynamic_payload) then json_extract_string(dynamic_payload, '$.Metadata.Domain') end"
CATEGORY = f"coalesce(list_filter(list_transform(string_split({DOMAIN}, ','), lambda x: trim(x)), lambda x: x <> '')[-1], '(uncategorized)')"
VALID = f"v as (select * exclude (dynamic_payload), case when json_valid(dynamic_payload) then dynamic_payload end as dynamic_payload from a)"

LAYDOWN = f"""
{WITH}, t as (select asset_title, {ORIGIN} as origin, {DOMAIN} as domain from a)
select u.unit_key, u.unit_name, u.service, u.branch, u.role, u.theater_command, u.location_text, u.airbase, l.raw_designator, l.en_designator, t.asset_title as weg_asset_title, t.origin, t.domain
from l join u on l.unit_key = u.unit_key
left join t on lower(t.asset_title) = lower(l.en_designator) or lower(t.asset_title) like lower(l.en_designator) || ' %' or lower(t.asset_title) like lower(l.en_designator) || '(%'
"""
LAYDOWN_FILTERED = f"""
select * from ({LAYDOWN}) where lower(service) like '%guard%' and lower(theater_command) like '%march%' and (lower(en_designator) like '%tzp-2%' or lower(raw_designator) like '%tzp-2%' or (unit_key, raw_designator) in (select (unit_key, raw_designator) from unit_aircraft where lower(cn_designator) like '%tzp-2%'))
order by theater_command nulls first, unit_name nulls first, raw_designator nulls first, unit_key nulls first, weg_asset_title nulls first limit 100
"""

DOT = "list_dot_product(list_transform(embedding, lambda x: x::double), [0.5, -0.25, 0.125, 1.0, -1.0, 0.75, 0.0, 0.3]::double[])"
CHUNKS = "c as (select distinct chunk_id, parent_id, source, embedding from rag_chunks where len(embedding) = 8 and list_count(embedding) = 8)"
POOL = f"{CHUNKS}, s as (select distinct chunk_id, parent_id, {DOT} as score from c), pool as (select * from s order by score desc, chunk_id limit 15)"

PAGES = r"""
p as (select distinct source, parent_id as page_id, text from rag_parents),
x as (select source, page_id, unnest(string_split_regex(text, '\r\n|[\n\r\x0c\x0b\x1c-\x1e\x{85}\x{2028}\x{2029}]')) as line, generate_subscripts(string_split_regex(text, '\r\n|[\n\r\x0c\x0b\x1c-\x1e\x{85}\x{2028}\x{2029}]'), 1) as i from p),
y as (select source, page_id, i, regexp_replace(line, '^[\s\x{a0}\x{3000}\x{2000}-\x{200a}]+|[\s\x{a0}\x{3000}\x{2000}-\x{200a}]+$', '', 'g') as line from x),
z as (select *, trim(regexp_replace(regexp_replace(lower(line), '\d+', '', 'g'), '[^a-z]+', ' ', 'g')) as line_key from y where line <> ''),
n as (select source, count(distinct page_id) as n from p group by source),
k as (select source, line_key, count(distinct page_id) as pages from z where length(line_key) >= 8 group by source, line_key),
b as (select k.source, line_key, pages from k join n using (source) where n >= 2 and pages >= greatest(2, floor(n * 0.05)))
"""
WORDS = r"list_filter(string_split_regex(text, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda w: w <> '')"

GOLD = "g as (select id, e.source, e.page, e.quote from (select id, unnest(expected) as e from gold_cases))"
def _vectors(words: str, key: str, rows: str) -> str:
    return f"""select k, bucket, n / sqrt(sum(n * n) over (partition by k)) as x from (
      select k, cast('0x' || right(sha1(w), 8) as bigint) % 64 as bucket, count(*) as n from (select {key} as k, unnest({words}) as w from {rows}) group by 1, 2)"""


RETRIEVED = f"""
pa as (select distinct parent_id, source, page, text from rag_parents where parent_id is not null),
pv as ({_vectors(WORDS.replace("text", "lower(text)"), "parent_id", "pa")}),
sa as (select id, concat_ws(' ', query_text, array_to_string(list_transform(expected, lambda e: e.quote), ' ')) as said from gold_cases),
qv as ({_vectors(WORDS.replace("text", "lower(said)"), "id", "sa")}),
dp as (select qv.k as id, pv.k as parent_id, sum(qv.x * pv.x) as score from qv join pv using (bucket) group by 1, 2),
al as (select c.id, p.parent_id, coalesce(score, 0) as score from gold_cases c cross join (select distinct parent_id from pa) p left join dp on dp.id = c.id and dp.parent_id = p.parent_id),
tp as (select *, row_number() over (partition by id order by round(score, 9) desc, parent_id) as rank from al),
r as (select id, rank, source, page from tp join pa using (parent_id) where rank <= 10)
"""
RETRIEVED_ALL = """
h as (select distinct id, source from g),
pg as (select distinct source, page from rag_parents),
r as (select * from (select id, row_number() over (partition by id order by page desc nulls last, source) as rank, h.source, page from h join pg using (source)) where rank <= 10)
"""


def _metrics(k: int, tolerance: int, retrieved: str = RETRIEVED) -> str:
    return f"""
{GOLD}, {retrieved},
j as (select r.id, rank, g.source as gs, g.page as gp, r.source = g.source and abs(r.page - g.page) <= {tolerance} as ok, r.source = g.source as same from r join g using (id)),
pr as (select id, rank, max(ok::int) as rel, max(same::int) as same from j group by id, rank),
br as (select id, max(same) as same, min(case when rel = 1 then rank end) as best_rank, sum(case when rank <= {k} then rel else 0 end) as right_in_k, sum(case when rank <= {k} and rel = 1 then 1 / log2(rank + 1) else 0 end) as dcg from pr group by id),
fo as (select id, count(distinct (gs, gp)) as found from j where ok and rank <= {k} group by id),
la as (select id, count(*) as labels from g group by id),
m as (select c.id, c.verified, coalesce(labels, 0) as labels, best_rank is not null as hit, coalesce(same, 0) = 1 as source_hit, best_rank, coalesce(1.0 / best_rank, 0.0) as reciprocal_rank, coalesce(right_in_k, 0) as right_in_k, coalesce(found, 0) as found,
  coalesce(right_in_k, 0) / {k}.0 as precision, case when coalesce(labels, 0) > 0 then coalesce(found, 0) / labels else 0.0 end as recall,
  case when coalesce(labels, 0) > 0 and coalesce(dcg, 0) > 0 then dcg / list_sum(list_transform(range(1, least({k}, labels) + 1), lambda i: 1 / log2(i + 1))) else 0.0 end as ndcg
  from gold_cases c left join la using (id) left join br using (id) left join fo using (id))
"""


LINES = r"li as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents where text is not null)"
FOLDED = r"lower(regexp_replace(regexp_replace(translate({0}, '’‘“”—–' || chr(173), '{q}{q}\"\"--'), '[\s\x{{a0}}]+', ' ', 'g'), '^ | $', '', 'g'))".replace("{q}", "''").replace('\\"', '"')

CASES = lambda c, names, other: f"case {c} " + " ".join(f"when '{a}' then '{b}'" for a, b in names) + f" else {other} end"
CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, '\[([^\]]*?)\]\([^)]*\)', '\1', 'g'), '\\?\[(?:註|注|编辑)[^\]]*\\?\]', '', 'g'), '\s+', ' ', 'g'))"
FIRST = lambda c, names: "case " + " ".join(f"when contains({c}, '{a}') then '{b}'" for a, b in names) + " end"
SERVICE_NAMES = [("Skyguard", "空军"), ("Coastwing", "海军"), ("Home Reserve", "院校训练部队")]
ROLE_NAMES = [("fighter", "歼击机"), ("bomber", "轰炸机"), ("transport", "运输机"), ("academy", "学院")]
THEATER_NAMES = [("Northreach", "北部战区"), ("Eastmarch", "东部战区"), ("Southmere", "南部战区"), ("Westfold", "西部战区"), ("Midland", "中部战区")]
THEATER = "case when contains({0}, '战区') then " + FIRST("{0}", [("东部", "Eastern"), ("南部", "Southern"), ("西部", "Western"), ("北部", "Northern"), ("中部", "Central")]) + " end"
ARTICLES = rf"""
{WITH}, air as (select unit_key, string_agg(distinct raw_designator, '、' order by raw_designator) as aircraft from l group by unit_key),
src as (select u.*, md5(u.unit_key) as h, coalesce(aircraft, '') as aircraft, translate(regexp_replace(u.unit_key, '[^0-9]', '', 'g'), '0123456789', '零一二三四五六七八九') as n from u left join air on air.unit_key = u.unit_key),
parts as (select substr(h, 1, 2) as doc, cast('0x' || substr(h, 3, 8) as bigint) * 16 as first, coalesce(source_url, null) as source_url, [
  case when substr(h, 11, 1) < '6' then '## ' || {CASES("service", SERVICE_NAMES, "'其他'")} end, '### ' || coalesce(branch, '某') || '部队[注 1]', '#### ' || {CASES("role", ROLE_NAMES, "'其他'")},
  '##### ' || {CASES("theater_command", THEATER_NAMES, "null")}, '| 航空兵部队 | 装备 |', '| --- | :-: |',
  '| [' || coalesce(unit_name, '') || '](http://x.example/u) | ' || case when province is null then '' else '江右省' end || case when location_text is null then '' else '望北市' end || case when airbase is null then '' else n || '机场' end
    || ' | ' || aircraft || ' | ' || coalesce(tactical_code, '') || ' | ' || coalesce(remarks, '') || ' |', '', '| 名称 | 装备 |', '| 甲 | 溟澍-1 |'] as lines from src),
li as (select doc, first + i - 1 as line_no, source_url, lines[i] as text from parts, unnest(range(1, 11)) as r(i) where lines[i] is not null),
hd as (select *, length(regexp_extract(text, '^(#{{2,6}})\s+(.*)$', 1)) as level, {CLEAN.format("regexp_extract(text, '^(#{2,6})\\s+(.*)$', 2)".replace(chr(92) * 2, chr(92)))} as head, text like '|%' as is_row,
  list_transform(string_split(regexp_replace(trim(text), '^\||\|$', '', 'g'), '|'), lambda x: {CLEAN.format("x")}) as cells from li),
st as (select *, is_row and not coalesce(lag(is_row) over (partition by doc order by line_no), false) as opens from hd),
s1 as (select *, (last_value(case when level = 2 then {{'v': {FIRST("head", [("空军", "PLAAF"), ("海军", "PLANAF"), ("院校训练部队", "Training")])}}} end ignore nulls) over w).v as service,
  (last_value(case when level in (2, 3) then {{'v': case when level = 3 then head end}} end ignore nulls) over w).v as branch,
  (last_value(case when level in (2, 3, 4, 5) then {{'v': case when level = 5 then {THEATER.format("head")} end}} end ignore nulls) over w).v as theater,
  last_value(case when is_row and cells[1] in ('航空兵部队', '航空兵部隊') then true when level > 0 or opens then false end ignore nulls) over w as inside
  from st window w as (partition by doc order by line_no rows unbounded preceding)),
s2 as (select *, (last_value(case when level in (2, 3, 4) then {{'v': case when level > 2 then coalesce({FIRST("head", [("歼击机", "fighter"), ("轰炸机", "bomber"), ("运输机", "transport")])}, case when service = 'Training' or head like '%学院%' or head like '%大学%' then 'academy' end) end}} end ignore nulls)
  over (partition by doc order by line_no rows unbounded preceding)).v as role from s1),
rw as (select * from s2 where is_row and inside and cells[1] not in ('航空兵部队', '航空兵部隊') and not regexp_full_match(array_to_string(list_filter(cells, lambda c: c <> ''), ''), '[:-]*')),
ce as (select doc, line_no, i, cells[i] as cell from rw, unnest(range(2, len(cells) + 1)) as r(i) where cells[i] <> ''),
tk as (select doc, line_no, i, list_transform(list_filter(list_distinct(list_transform(string_split_regex(cell, '[、，,]|和'), lambda x: trim(x))), lambda x: x <> ''), lambda x: x) as all_tokens, string_split_regex(cell, '[、，,]|和') as raw from ce),
to1 as (select doc, line_no, i, min(k) as k, t from (select doc, line_no, i, k, trim(raw[k]) as t from tk, unnest(range(1, len(raw) + 1)) as r(k)) where t <> '' group by doc, line_no, i, t),
to2 as (select *, regexp_extract(t, '^([一-鿿]+)[-－–]?(\d+)', 1) as p, regexp_extract(t, '^([一-鿿]+)[-－–]?(\d+)', 2) as num from to1),
kn as (select doc, line_no, i, string_agg(en || num, ';' order by k) as known from (select *, case when num = '' then null when p like '渊锋镝%' then 'ZKX-' when p like '炽珀鹳%' then 'TZP-' when p like '晖砾铎%' then 'FBN-' when p like '溟澍%' then 'DBK-' end as en from to2) where en is not null group by doc, line_no, i),
cl as (select ce.*, known, case when known is not null then 'aircraft' when regexp_full_match(cell, '[0-9][0-9A-Za-zX]{{2,6}}') then 'code' when {THEATER.format("cell")} is not null then 'theater' when regexp_matches(cell, '省|市|县|区|机场|機場|场站|州|镇|村|旗') then 'place' else 'remark' end as kind from ce left join kn using (doc, line_no, i)),
cm as (select *, case when kind = 'place' and i > min(case when kind = 'place' then i end) over (partition by doc, line_no) then 'remark' else kind end as kind2 from cl),
fo as (select doc, line_no, coalesce(string_agg(known, ';' order by i), '') as aircraft, max_by(case when kind2 = 'code' then cell end, case when kind2 = 'code' then i end) as tactical_code, max(case when kind2 = 'place' then cell end) as location_text,
  string_agg(case when kind2 in ('remark', 'theater') then cell end, '; ' order by i) as remarks from cm group by doc, line_no),
ou as (select coalesce(nullif(cells[1], ''), coalesce(nullif(role, ''), 'unit') || '|' || coalesce(nullif(location_text, ''), '?')) as unit_key, cells[1] as unit_name, service, branch, role, theater as theater_command, location_text,
  nullif(regexp_extract(location_text, '^([一-鿿]{{2,4}}?(?:省|自治区|直辖市))', 1), '') as province, nullif(regexp_extract(location_text, '([^省市县区州盟旗]*(?:机场|機場|场站))$', 1), '') as airbase, tactical_code, nullif(remarks, '') as remarks, source_url, coalesce(aircraft, '') as aircraft, doc, line_no
  from rw left join fo using (doc, line_no))
select * from ou where unit_name <> '' or aircraft <> '' or location_text is not null
"""
SQUEEZE = r"trim(regexp_replace({0}, '[\s\x{{a0}}\x{{3000}}\x{{2000}}-\x{{200a}}]+', ' ', 'g'))"
LAYOUT_ASSETS = f"""
with a as (select asset_seq, {SQUEEZE.format("asset_title")} as title, nullif({SQUEEZE.format("notes")}, '') as notes, source_url, case when json_valid(dynamic_payload) and json_type(dynamic_payload) = 'OBJECT' then json_keys(dynamic_payload) else [] end as names from weg_assets),
k as (select asset_seq, min(i) as i, {SQUEEZE.format("names[i]")} as name from a, unnest(range(1, len(names) + 1)) as r(i) where names[i] not in ('Metadata', 'Notes') and {SQUEEZE.format("names[i]")} <> '' group by asset_seq, name),
o as (select asset_seq, string_agg(', ' || to_json(name) || ': {{"Crew": ["2",' || to_json('of ' || name) || '], "_text": "free text", "Part": {{"Kind": "x"}}}}', '' order by i) as sections from k group by asset_seq)
select substr(md5(cast(asset_seq as varchar)), 1, 2) as doc, row_number() over (partition by doc order by asset_seq) as asset_seq, title as asset_title, source_url, notes, '{{"Metadata": {{"Tier": "' || a.asset_seq || '"}}' || coalesce(sections, '') || '}}' as dynamic_payload
from a left join o using (asset_seq) where title <> ''
"""

NODES = r"""
t as (select a.asset_seq, t.id, t.parent, t.key, t.type, t.atom from (select distinct asset_seq, dynamic_payload from {0} where json_valid(dynamic_payload)) a, json_tree(a.dynamic_payload) t),
n as (
  select asset_seq, id, type, '' as path, '' as parent_path, '' as under, cast(null as varchar) as section, cast(null as varchar) as key, cast(null as integer) as position, 0 as depth, false as element, atom from t where parent is null
  union all
  select asset_seq, id, type, case when path = '' then step else path || ' > ' || step end, under, case when is_item and type = 'OBJECT' then case when path = '' then step else path || ' > ' || step end else under end,
    coalesce(section, step), case when is_item then null else step end, case when is_item then cast(key as integer) end, depth + 1, is_item and type = 'OBJECT', atom from (
    select t.asset_seq, t.id, t.type, t.key, t.atom, n.path, n.under, n.section, n.depth, n.type = 'ARRAY' as is_item, case when n.type = 'ARRAY' then '[' || t.key || ']' else t.key end as step from n join t on t.asset_seq = n.asset_seq and t.parent = n.id)),
f as (select *, case type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' when 'OBJECT' then 'object' when 'ARRAY' then 'array' else 'number' end as kind, case when type = 'NULL' then null else atom ->> '$' end as value from n)
"""
SPECS = """
(select asset_seq, trim(key) as spec, min_by(case when kind = 'null' then 'None' when kind = 'boolean' then upper(value[1]) || value[2:] else trim(value) end, r * 1000000 + id) as value
 from f join (values ('System', 1), ('Automotive', 2), ('Dimensions', 3), ('Armament', 4), ('Main Missile Systems', 5), ('Missile Weapon Systems', 6), ('Bomb Weapon Systems', 7)) as s(sec, r) on sec = section
 where depth > 1 and key is not null and kind not in ('object', 'array') and trim(lower(key)) not in ('image sources', 'manufacturer', 'alternate designation(s)') group by asset_seq, trim(key))
"""
NUMERALS = "translate(regexp_replace(unit_key, '[^0-9]', '', 'g'), '0123456789', '零一二三四五六七八九')"

SQL = {
    "p4_assets": f"with recursive {NODES.format('weg_assets')} select asset_seq, count(case when depth = 1 then 1 end) as sections, count(case when element then 1 end) as objects, cast(max(depth) as integer) as deepest from f group by asset_seq",
    "p4_sections": f"with recursive {NODES.format('weg_assets')} select asset_seq, section, max(case when depth = 1 then kind end) as kind, count(case when depth = 2 then 1 end) as entries from f where depth in (1, 2) group by asset_seq, section",
    "p4_fields": f"with recursive {NODES.format('weg_assets')} select distinct asset_seq, path, parent_path, section, key, position, kind, value from f where depth > 0 and kind not in ('object', 'array')",
    "flatten_first_wins": f"with recursive {NODES.format('weg_assets')} select * from {SPECS}",
    "laydown_specs": f"with recursive {NODES.format('(' + ASSETS + ')')} select weg_asset_title, spec, value from {SPECS} p join (select asset_seq, asset_title as weg_asset_title from ({ASSETS})) using (asset_seq) where weg_asset_title in (select weg_asset_title from ({LAYDOWN}))",
    "cell_split": f"""{WITH}, x as (select unit_key, string_agg(distinct raw_designator, '、' order by raw_designator) as cell from l group by unit_key), y as (select u.unit_key, string_split_regex(coalesce(cell, ''), '[、，,]|和') as raw from u left join x on x.unit_key = u.unit_key),
      k as (select unit_key, min(i) as i, t from (select unit_key, i, trim(raw[i]) as t from y, unnest(range(1, len(raw) + 1)) as r(i)) group by unit_key, t),
      e as (select unit_key, i, regexp_extract(t, '^([一-鿿]+)[-－–]?(\\d+)', 2) as num, regexp_extract(t, '^([一-鿿]+)[-－–]?(\\d+)', 1) as p from k),
      b as (select *, case when num = '' then null when p like '渊锋镝%' then 'ZKX-' when p like '炽珀鹳%' then 'TZP-' when p like '晖砾铎%' then 'FBN-' when p like '溟澍%' then 'DBK-' end || num as en from e)
      select y.unit_key, cast(count(en) as integer) as known, coalesce(string_agg(en, ';' order by i), '') as bases from y left join b on b.unit_key = y.unit_key group by y.unit_key""",
    "airbase_extract": f"{WITH} select unit_key, case when airbase is null then null when tactical_code is null then {NUMERALS} || '机场' else '江右省' || {NUMERALS} || '机场' end as airbase from u",
    "article_units": ARTICLES,
    "article_units_fielding": f"select doc, line_no, unit_key from ({ARTICLES}) where aircraft <> ''",
    "layout_assets": LAYOUT_ASSETS,
    "layout_spans": r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents),
      w as (select doc_id, line_no, unnest(string_split(line, ' ')) as word, generate_subscripts(string_split(line, ' '), 1) as span from l),
      v as (select *, cast(8 + length(word) % 7 as double) as size from w where regexp_replace(word, '[\t-\r\x{85}\p{Z}]+', '', 'g') <> '')
      select cast(doc_id as varchar) as doc, 1000000000 + line_no as line_no, md5(trim(regexp_replace(string_agg(word, ' ' order by span), '[\t-\r\x{85}\p{Z}]+', ' ', 'g'))) as digest,
        max(size) as size, 'F' || (arg_max(length(word), size * 1000000 - span) % 3) as font from v group by doc_id, line_no""",
    "laydown_prefix_join": LAYDOWN,
    "laydown_filtered": LAYDOWN_FILTERED,
    "laydown_chinese": f"{WITH} select unit_key, raw_designator, en_designator from l where lower(en_designator) = 'dbk-27' or lower(cn_designator) like '%dbk-27%' or lower(raw_designator) like '%dbk-27%'",
    "laydown_linked": f'select count(*) as "rows", count(weg_asset_title) as linked from ({LAYDOWN})',
    "capability_view": f"select distinct en_designator, trim(split_part(weg_asset_title, '(', 1)) as kind, weg_asset_title from ({LAYDOWN}) where weg_asset_title is not null",
    "laydown_view": f"select distinct unit_name, en_designator as designator, theater_command, airbase, location_text from ({LAYDOWN})",
    "catalog_search": f"""{WITH} select asset_title, source_url, {ORIGIN} as origin, {DOMAIN} as domain from a where lower(asset_title) like '%trainer%' and lower({ORIGIN}) like '%velmora%' and lower({DOMAIN}) like '%air%'
      order by asset_title nulls first, source_url limit 50""",
    "catalog_point": f"{WITH} select asset_title, asset_seq, cast(len(json_keys(dynamic_payload)) as integer) as sections from a where asset_title = 'DBK-272 Ostrelian Survey Drone'",
    "origin_filter": f"select asset_seq, asset_title from weg_assets where lower(coalesce({ORIGIN}, '')) like '%velmora%' or lower(asset_title) like '%velmora%'",
    "origin_filter_limit": f"select asset_seq, asset_title from weg_assets where lower(coalesce({ORIGIN}, '')) like '%tarsk%' or lower(asset_title) like '%tarsk%' order by asset_seq limit 25",
    "origin_filter_source": f"select asset_seq, asset_title from weg_assets where asset_seq <= 200 and (lower(coalesce({ORIGIN}, '')) like '%velmora%' or lower(asset_title) like '%velmora%')",
    "catalog_sample": f"{WITH} select asset_title, asset_seq from a order by starts_with(asset_title, 'TZP-2') desc, asset_title nulls last limit 1",
    "json_path_counts": f"{WITH} select coalesce(nullif({ORIGIN}, ''), '(unknown)') as origin, count(*) as n from a group by 1",
    "category_breakdown": f"{WITH} select {CATEGORY} as category, count(*) as n from a group by 1",
    "category_of_origin": f"{WITH} select {CATEGORY} as category, count(*) as n from a where lower({ORIGIN}) like '%velmora%' group by 1",
    "share_of_total": f"{WITH} select {CATEGORY} as category, count(*) as n, round(100 * count(*) / sum(count(*)) over (), 4) as percent from a group by 1",
    "json_sections": f"{WITH}, {VALID} select asset_title, cast(generate_subscripts(json_keys(dynamic_payload), 1) - 1 as integer) as position, unnest(json_keys(dynamic_payload)) as section from v where json_type(dynamic_payload) = 'OBJECT'",
    "json_section_fetch": f"{WITH}, {VALID} select asset_title, cast(json_extract(dynamic_payload, '$.Metadata') as varchar) as section from v where json_extract(dynamic_payload, '$.Metadata') is not null",
    "search_units": f"{WITH} select unit_key, unit_name, service, role from u where lower(service) like '%sky%' and lower(role) like '%transport%' order by unit_name nulls first, unit_key nulls first limit 50",
    "unit_point": f"{WITH} select unit_key, role, coalesce((select string_agg(distinct raw_designator, ';' order by raw_designator) from l where l.unit_key = u.unit_key), '') as aircraft from u where unit_key = 'Squadron 131 Calorvik'",
    "hub_with_children": f"{WITH}, x as (select unit_key, string_agg(distinct raw_designator, ';' order by raw_designator) as aircraft from l group by unit_key) select u.unit_key, unit_name, coalesce(aircraft, '') as aircraft from u left join x on x.unit_key = u.unit_key",
    "units_for_item_semi": f"{WITH} select distinct u.unit_key, unit_name, theater_command from u join l on l.unit_key = u.unit_key where lower(en_designator) like '%dbk-2%' or lower(cn_designator) like '%dbk-2%' or lower(raw_designator) like '%dbk-2%'",
    "inventory_distinct": f"{WITH} select coalesce(nullif(coalesce(nullif(en_designator, ''), cn_designator), ''), '(unknown)') as designator, count(distinct u.unit_key) as units from l join u on l.unit_key = u.unit_key group by 1",
    "inventory_of_service": f"{WITH} select coalesce(nullif(coalesce(nullif(en_designator, ''), cn_designator), ''), '(unknown)') as designator, count(distinct u.unit_key) as units from l join u on l.unit_key = u.unit_key where lower(service) like '%coast%' group by 1",
    "role_breakdown": f"{WITH} select coalesce(nullif(role, ''), '(unknown)') as role, count(*) as n from u group by 1",
    "theater_breakdown": f"{WITH} select coalesce(nullif(theater_command, ''), '(none)') as theater, count(*) as n from u group by 1",
    "row_counts": " union all ".join(f"select '{n}' as table_name, count(*) as n from {n}" for n in ("weg_assets", "units", "unit_aircraft", "rag_parents", "rag_chunks")),
    "upsert_latest": f"select asset_title, asset_seq, ingested_at from ({ASSETS})",
    "upsert_events": "select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1",
    "insert_or_ignore": f"select unit_key, raw_designator, link_id from ({LINKS})",
    "cascade_links": f"{WITH} select unit_key, raw_designator from l where unit_key in (select unit_key from u)",
    "vector_topk": f"with {POOL} select chunk_id, parent_id, round(score, 6) as score from pool",
    "vector_topk_parent": f"""with {POOL}, b as (select parent_id, max(score) as score from pool group by parent_id order by score desc, parent_id limit 4)
      select distinct b.parent_id, source || ' p.' || page as citation, round(score, 4) as score from b join rag_parents p on p.parent_id = b.parent_id""",
    "vector_topk_sources": f"with {CHUNKS} select chunk_id, round(score, 6) as score from (select distinct chunk_id, parent_id, {DOT} as score from c where source = 'composite_field_manual.pdf') order by score desc, chunk_id limit 15",
    "context_snippets": f"""with {POOL}, b as (select parent_id, max(score) as score from pool group by parent_id order by score desc, parent_id limit 4)
      select citation, md5(text) as digest, score from (select distinct b.parent_id, source || ' p.' || page as citation, text, round(score, 4) as score from b join rag_parents p on p.parent_id = b.parent_id)""",
    "passage_pages": """with p as (select source, page, parent_id as page_id from (select *, row_number() over (partition by source, page order by ingested_at desc nulls last, parent_id desc) as rn from rag_parents) where rn = 1)
      select distinct chunk_id, c.source, c.page, page_id from rag_chunks c left join p on p.source = c.source and p.page = c.page""",
    "vector_sizes": "select cast(coalesce(len(embedding), -1) as integer) as dimension, count(*) as passages from (select distinct chunk_id, embedding from rag_chunks) group by 1",
    "vector_batch": """
      with s as (select q.vec_id as query_id, v.vec_id as chunk_id, list_dot_product(list_transform(q.embedding, lambda x: x::double), list_transform(v.embedding, lambda x: x::double)) as score from embeddings q, embeddings v where q.vec_id % 20 = 0),
      k as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s) select query_id, chunk_id, cast(rank as integer) as rank, round(score, 6) as score from k where rank <= 10""",
    "l2_normalize": """
      with c as (select distinct chunk_id, parent_id, source, list_transform(embedding, lambda x: x::double) as v from rag_chunks where embedding is not null),
      n as (select chunk_id, v, sqrt(coalesce(list_sum(list_transform(v, lambda x: x * x)), 0)) as n from c)
      select chunk_id, cast(len(v) as integer) as size, case when list_count(v) < len(v) then null when n = 0 then 0.0 else 1.0 end as norm, round(v[1] / case when n = 0 then 1 else n end, 6) as first from n""",
    "hash_embed": r"""
      with w as (select id, unnest(list_filter(string_split_regex(lower(query_text), '\s+'), lambda w: w <> '')) as w from gold_cases),
      b as (select id, cast(('0x' || right(sha1(w), 8)) as bigint) % 64 as bucket, count(*) as n from w group by 1, 2)
      select id, cast(bucket as integer) as bucket, round(n / sqrt(sum(n * n) over (partition by id)), 6) as weight from b""",
    "ir_metrics": f"with {_metrics(4, 1)} select id, labels, hit, source_hit, cast(best_rank as integer) as best_rank, round(reciprocal_rank, 6) as reciprocal_rank, round(precision, 6) as precision, round(recall, 6) as recall, round(ndcg, 6) as ndcg from m",
    "ir_summary": f"""with {_metrics(10, 3)} select count(*) as cases, cast(sum(labels) as bigint) as labels, count(case when not verified then 1 end) as unverified, round(avg(hit::int), 6) as hit_rate, round(avg(source_hit::int), 6) as source_hit_rate, round(avg(reciprocal_rank), 6) as mrr,
      round(avg(precision), 6) as mean_precision, round(avg(recall), 6) as mean_recall, round(avg(ndcg), 6) as mean_ndcg, round(sum(right_in_k) / (count(*) * 10), 6) as micro_precision, round(sum(found) / greatest(sum(labels), 1), 6) as micro_recall from m""",
    "ir_to_inspect": f"with {_metrics(4, 1)} select id, 'missed' as reason from m where not hit union all select id, 'unverified' from m where not coalesce(verified, false)",
    "ir_right_pages": f"with {GOLD}, {RETRIEVED} select distinct r.id, cast(rank as integer) as rank, r.source, r.page from r join g on g.id = r.id and g.source = r.source and abs(g.page - r.page) <= 1",
    "ir_all_metrics": f"with {_metrics(4, 1, RETRIEVED_ALL)} select id, labels, hit, source_hit, cast(best_rank as integer) as best_rank, round(reciprocal_rank, 6) as reciprocal_rank, round(precision, 6) as precision, round(recall, 6) as recall, round(ndcg, 6) as ndcg from m",
    "ir_all_summary": f"""with {_metrics(10, 3, RETRIEVED_ALL)} select count(*) as cases, cast(sum(labels) as bigint) as labels, count(case when not verified then 1 end) as unverified, round(avg(hit::int), 6) as hit_rate, round(avg(source_hit::int), 6) as source_hit_rate, round(avg(reciprocal_rank), 6) as mrr,
      round(avg(precision), 6) as mean_precision, round(avg(recall), 6) as mean_recall, round(avg(ndcg), 6) as mean_ndcg, round(sum(right_in_k) / (count(*) * 10), 6) as micro_precision, round(sum(found) / greatest(sum(labels), 1), 6) as micro_recall from m""",
    "ir_all_to_inspect": f"with {_metrics(4, 1, RETRIEVED_ALL)} select id, 'missed' as reason from m where not hit union all select id, 'unverified' from m where not coalesce(verified, false)",
    "ir_all_right_pages": f"with {GOLD}, {RETRIEVED_ALL} select distinct r.id, cast(rank as integer) as rank, r.source, r.page from r join g on g.id = r.id and g.source = r.source and abs(g.page - r.page) <= 1",
    "quote_validation": f"""with {GOLD}, q as (select distinct id, source, page, quote from g where quote <> '')
      select q.id, q.source, q.page, coalesce(max(contains({FOLDED.format("p.text")}, {FOLDED.format("q.quote")})), false) as valid from q left join rag_parents p on p.source = q.source and p.page = q.page group by q.id, q.source, q.page, q.quote""",
    "anti_missing_refs": f"with {GOLD} select distinct source from g where source is not null and source not in (select source from rag_parents where source is not null)",
    "boilerplate_keys": f"with {PAGES} select * from b",
    "strip_boilerplate": f"""with {PAGES},
      o as (select source, page_id, string_agg(line, ' ' order by i) as text from z where not regexp_full_match(lower(line), '(?:page\\s*)?\\d{{1,4}}') and not exists (select 1 from b where b.source = z.source and b.line_key = z.line_key) group by source, page_id)
      select distinct p.source, p.page_id, trim(regexp_replace(coalesce(o.text, ''), '[\\s\\x{{a0}}\\x{{3000}}]+', ' ', 'g')) as text from p left join o on o.source = p.source and o.page_id = p.page_id""",
    "chunk_windows": f"""
      with p as (select distinct source, parent_id as page_id, text from rag_parents), w as (select page_id, {WORDS} as w from p),
      c as (select page_id, w, unnest(range(0, 1 + greatest(0, cast(ceil((len(w) - 150) / 120) as bigint)))) as child_no from w where len(w) > 0)
      select distinct page_id, cast(child_no as integer) as child_no, cast(len(w[child_no * 120 + 1 : child_no * 120 + 150]) as integer) as words, md5(array_to_string(w[child_no * 120 + 1 : child_no * 120 + 150], ' ')) as digest from c where len(w[child_no * 120 + 1 : child_no * 120 + 150]) >= 20""",
    "code_normalize": r"""
      with x as (select distinct raw_designator, regexp_extract(trim(raw_designator), '^([一-鿿]+)[-－–]?(\d+)', 1) as p, regexp_extract(trim(raw_designator), '^([一-鿿]+)[-－–]?(\d+)', 2) as n from unit_aircraft where raw_designator is not null),
      y as (select *, case when n = '' then null when p like '渊锋镝%' then 1 when p like '炽珀鹳%' then 2 when p like '晖砾铎%' then 3 when p like '溟澍%' then 4 end as k from x)
      select raw_designator, case k when 1 then '渊锋镝-' || n when 2 then '炽珀鹳-' || n when 3 then '晖砾铎-' || n when 4 then '溟澍-' || n else trim(raw_designator) end as cn_base,
      case k when 1 then 'ZKX-' || n when 2 then 'TZP-' || n when 3 then 'FBN-' || n when 4 then 'DBK-' || n end as en_base from y""",
    "scenario_resolve": r"""
      with x as (select doc_id, text, lower(text) as t, regexp_extract(text, '(?:^|[^\p{L}\p{N}_])([A-Za-z]{1,3}-\d{1,3}[A-Za-z]?)(?:$|[^\p{L}\p{N}_])', 1) as latin from documents),
      y as (select *, case when contains(t, 'coastal outpost') then 'coastal outpost' when contains(t, 'field manual') then 'field manual' when contains(t, 'outpost') then 'outpost' when contains(t, 'manual') then 'manual' end as place from x)
      select doc_id, nullif(upper(latin), '') as designator, case place when 'coastal outpost' then 'Northmarch' when 'field manual' then 'Eastmarch+Westfold' when 'outpost' then 'Eastmarch' when 'manual' then 'Westfold' else '' end as theaters,
      case when contains(t, 'tanker') then 'transport' when contains(t, 'trainer') then 'training' when contains(t, 'drone') then 'uav' when contains(t, 'airframe') then 'fighter' end as role, place as matched_location from y""",
    "retrieval_text": "select doc_id, concat_ws(' ', nullif(source, ''), nullif(subject_code, ''), nullif(lang, '')) as q from documents",
    "kv_lines": rf"""
      with {LINES}, k as (select doc_id, cast(line_no as integer) as line_no, regexp_replace(line[: position(': ' in line) - 1], '^\s+|\s+$', '', 'g') as label, regexp_replace(line[position(': ' in line) + 2 :], '^\s+|\s+$', '', 'g') as value from li where position(': ' in line) > 0)
      select * from k where label <> '' and value <> ''""",
    "kv_parse": rf"""
      with {LINES}, k as (select doc_id, cast(line_no as integer) as line_no, regexp_replace(line[: position(': ' in line) - 1], '^\s+|\s+$', '', 'g') as label, regexp_replace(line[position(': ' in line) + 2 :], '^\s+|\s+$', '', 'g') as value from li where position(': ' in line) > 0)
      select doc_id, label, count(*) as lines, min(value) as least, max(value) as most from k where label <> '' and value <> '' group by doc_id, label""",
    "line_classify": f"with {LINES} select case when length(line) < 40 then 'title' when length(line) < 80 then 'section' when length(line) < 160 then 'subsection' else 'body' end as kind, count(*) as lines from li group by 1",
    "carry_state": f"""with {LINES}, s as (select *, case when regexp_matches(line, '^(In|For) ') then line_no when line = '' then -1 end as mark from li)
      select doc_id, cast(line_no as integer) as line_no, cast(nullif(last_value(mark ignore nulls) over (partition by doc_id order by line_no rows unbounded preceding), -1) as integer) as carried from s""",
    "segment_runs": f"""with {LINES}, s as (select doc_id, line_no, case when coalesce((length(line) < 80) <> lag(length(line) < 80) over (partition by doc_id order by line_no), true) then 1 else 0 end as begins from li),
      r as (select *, sum(begins) over (partition by doc_id order by line_no rows unbounded preceding) as run from s) select doc_id, cast(run as bigint) as run, count(*) as lines, cast(min(line_no) as integer) as first from r group by doc_id, run""",
    "layout_titles": rf"""with {LINES} select cast(doc_id as varchar) as doc, 1::bigint as asset_seq, trim(regexp_replace(line, '[\s\x{{a0}}]+', ' ', 'g')) as asset_title from li where line_no = 0 and line <> ''""",
    "unit_key_synthesis": "select distinct unit_key, coalesce(nullif(unit_name, ''), coalesce(nullif(role, ''), 'unit') || '|' || coalesce(nullif(location_text, ''), '?')) as made from units",
    "quote_fold": f"with {GOLD} select distinct id, md5({FOLDED.format('quote')}) as folded, case when length(source) > 20 then source[:17] || '...' else source end as source from g where quote is not null",
    "p2_found": P2_FOUND,
    "p2_by_month": f"select ref_table, ref_month, reason, count(*) as refs from ({P2_FOUND}) group by all",
    "p4_found": P4_FOUND,
}
