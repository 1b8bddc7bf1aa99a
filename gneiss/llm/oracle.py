"""Queries of the text operators as SQL, where SQL can express them."""

P1_FOUND = r"""
with t as (
  select 'rag_parents' as table_name, parent_id as record_id, text from rag_parents
  union select 'rag_chunks', chunk_id, text from rag_chunks),
l as (
  select table_name, record_id, t.text as whole, unnest(string_split(replace(t.text, chr(13) || chr(10), chr(10)), chr(10))) as line,
    generate_subscripts(string_split(replace(t.text, chr(13) || chr(10), chr(10)), chr(10)), 1) as i
  from t where t.text is not null),
m as (
  select *, trim(line, ' ' || chr(9)) = '' as blank,
    lag(trim(line, ' ' || chr(9)) = '', 1, true) over (partition by table_name, record_id, whole order by i) as after_blank from l),
b as (
  select *, sum(case when not blank and after_blank then 1 else 0 end) over (partition by table_name, record_id, whole order by i) as block_no from m)
select distinct table_name, record_id, cast(block_no as integer) as block_no from b where not blank
group by table_name, record_id, whole, block_no having sum(length(line) + 1) - 1 > 1500
"""

P6_FOUND = r"""
with q as (
  select id, regexp_extract_all(lower(e.expected.quote), '[\p{L}\p{N}]+') as w from (select id, unnest(expected) as expected from gold_cases) e where e.expected.quote is not null),
g as (select distinct id, array_to_string(w[i : i + 11], ' ') as k from q, unnest(range(1, len(w) - 10)) as r(i)),
d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
h as (select distinct doc_id, array_to_string(w[i : i + 11], ' ') as k from d, unnest(range(1, len(w) - 10)) as r(i))
select distinct h.doc_id, g.id from h join g using (k)
"""

#: The longest run of words that each document has in common with each passage: equal runs of twelve words that follow one another in both.
P6_RUNS = r"""
with q as (
  select distinct id, passage, regexp_extract_all(lower(quote), '[\p{L}\p{N}]+') as w from (
    select id, cast(generate_subscripts(expected, 1) - 1 as integer) as passage, unnest(expected).quote as quote from gold_cases) where quote is not null),
g as (select id, passage, i, array_to_string(w[i : i + 11], ' ') as k from q, unnest(range(1, len(w) - 10)) as r(i)),
d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
h as (select doc_id, i, array_to_string(w[i : i + 11], ' ') as k from d, unnest(range(1, len(w) - 10)) as r(i)),
m as (select doc_id, id, passage, h.i - g.i as diagonal, g.i - row_number() over (partition by doc_id, id, passage, h.i - g.i order by g.i) as island from h join g using (k)),
n as (select doc_id, id, passage, count(*) + 11 as run from m group by doc_id, id, passage, diagonal, island)
select doc_id, id, passage, cast(max(run) as integer) as common_words from n group by doc_id, id, passage
"""

#: A source short of its share is so by far, whatever the tokenizer; bytes stand for tokens here.
P7_FOUND = """
with n as (select source, sum(octet_length(encode(text))) as n from documents group by source), a as (select sum(n) as total from n)
select m.source from mix_targets m left join n on n.source = m.source cross join a where coalesce(n, 0) * max_repeats < target_share * 0.5 * total
"""

P8_FOUND = """
with w as (
  select distinct doc_id, md5_number(text[i : i + 299]) as k from documents, unnest(range(1, length(text) - 298)) as r(i)),
k as (select k from w group by k having count(*) > 1), s as (select w.* from w join k using (k))
select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from s a join s b on a.k = b.k and a.doc_id < b.doc_id
"""

#: Starts of windows that another document has too, then runs of them that touch or overlap.
P8_SPANS = """
with w as (select doc_id, i, md5_number(text[i : i + 299]) as k from (select distinct doc_id, text from documents), unnest(range(1, length(text) - 298)) as r(i)),
k as (select k from w group by k having min(doc_id) <> max(doc_id)), s as (select distinct doc_id, i from w join k using (k)),
m as (select *, case when i - lag(i) over (partition by doc_id order by i) <= 300 then 0 else 1 end as new from s),
r as (select *, sum(new) over (partition by doc_id order by i rows unbounded preceding) as run from m)
select doc_id, cast(min(i) - 1 as bigint) as start, cast(max(i) + 299 as bigint) as stop from r group by doc_id, run
"""

P8_SHARE = f"""
with s as (select doc_id, count(*) as spans, cast(sum(stop - start) as bigint) as shared_chars from ({P8_SPANS}) group by doc_id),
d as (select doc_id, cast(max(coalesce(length(text), 0)) as bigint) as chars from documents group by doc_id)
select doc_id, chars, coalesce(shared_chars, 0) as shared_chars, coalesce(spans, 0) as spans, case when chars > 0 then round(coalesce(shared_chars, 0) / chars, 4) else 0.0 end as share from d left join s using (doc_id)
"""

SQL = {
    "p1_found": P1_FOUND,
    "p1_whole": """select distinct table_name, record_id, true as within_limit, true as overlapping, md5(text) as digest from (
      select 'rag_parents' as table_name, parent_id as record_id, text from rag_parents union all select 'rag_chunks', chunk_id, text from rag_chunks) where length(text) > 1500""",
    "p7_bounds": f"select source, true as within_repeats, true as between, source in ({P7_FOUND}) as short from mix_targets",
    "p6_found": P6_FOUND,
    "p6_runs": P6_RUNS,
    "p6_cases": f"select id, count(*) as documents from ({P6_FOUND}) group by id",
    "p7_found": P7_FOUND,
    "p8_found": P8_FOUND,
    "p8_spans": P8_SPANS,
    "p8_share": P8_SHARE,
}
