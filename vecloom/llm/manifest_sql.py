"""SQL for DuckDB that gives the rows of the manifest and resampling queries.  It has no crc32, so that is written out."""

# ``crc_table``: what one byte does to the register, from the polynomial.
CRC_TABLE = """
crc_table as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, unused: xor(c >> 1, 3988292384 * (c & 1))) order by i) as tab
  from (select unnest(range(256)) as i))
"""


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of the UTF-8 bytes of ``text``; ``crc_table`` must be in the query."""
    code = f"hex(encode({text}))"
    data = f"list_transform(range(0, length({code}) // 2), lambda i: ('0x' || substr({code}, (2 * i + 1)::int, 2))::bigint)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {data}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def _counted(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::varchar))::varchar || ':' || {value}::varchar, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_counted(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, base: str) -> str:
    return f"""
{name}(tree, level, idx, digest, n) as (
  {base}
  union all
  select tree, level + 1, idx // 16, sha256(string_agg(digest, '' order by idx)), (n + 15) // 16
  from {name} where n > 1 group by tree, level, idx // 16, n)"""


OP11_SQL = f"""
with recursive {CRC_TABLE},
leaves as (
  select doc_id, coalesce('s' || source, '') as tree, {_leaf('text')} as leaf,
    case when {crc32_sql('doc_id::varchar')} % 5 = 0 then {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as changed
  from documents, crc_table),
placed as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by tree) as n from leaves),
{_levels('nodes', 'select tree, 0, idx, leaf, n from placed')},
subroots as (
  select tree, digest, row_number() over (order by tree) - 1 as pos, count(*) over () as n from nodes where n = 1),
{_levels('tops', "select 't', 0, pos, digest, n from subroots")},
every as (select * from nodes union all select * from tops),
kids as (
  select tree, level, idx // 16 as run, list(digest order by idx) as digests from every where n > 1 group by all),
up(place, doc_id, tree, level, idx, folded, siblings) as (
  select row_number() over (), doc_id, tree, 0, idx, coalesce(changed, leaf), '' from placed
  union all
  select u.place, doc_id, case when k.tree is null then 't' else u.tree end, case when k.tree is null then 0 else u.level + 1 end,
    case when k.tree is null then s.pos else u.idx // 16 end,
    case when k.tree is null then folded
         else sha256(array_to_string(k.digests[:(u.idx % 16)::int], '') || folded || array_to_string(k.digests[(u.idx % 16)::int + 2:], '')) end,
    case when k.tree is null then siblings
         else siblings || array_to_string(k.digests[:(u.idx % 16)::int], '') || array_to_string(k.digests[(u.idx % 16)::int + 2:], '') end
  from up u left join kids k on u.tree = k.tree and u.level = k.level and u.idx // 16 = k.run left join subroots s on u.tree = s.tree
  where k.tree is not null or u.tree <> 't'),
ends as (
  select *, row_number() over (partition by place order by tree = 't' desc, level desc) as last from up),
root as (select digest as root from tops where n = 1),
numbered as (select *, row_number() over () as place from placed)
select p.doc_id, p.leaf, s.digest as subroot, root.root, sha256(e.siblings) as proof_sha256, e.folded as folded_root, e.folded = root.root as verified
from numbered p join ends e on p.place = e.place and e.last = 1 join subroots s on p.tree = s.tree, root
"""

WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
with {CRC_TABLE},
docs as (select row_number() over () as place, doc_id, coalesce({WORDS}, []) as words from documents),
asked as (select coalesce({WORDS}, []) as words from benchmark),
doc_runs as (
  select place, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) as run from docs),
asked_runs as (
  select unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) as run from asked),
hashed as (
  select run, {crc32_sql('run')} % 10000 as bucket from (select run from doc_runs union select run from asked_runs), crc_table),
s as (select bucket, count(*) as n from doc_runs join hashed using (run) group by bucket),
t as (select bucket, count(*) as n from asked_runs join hashed using (run) group by bucket),
totals as (select (select coalesce(sum(n), 0)::double from s) as all_s, (select coalesce(sum(n), 0)::double from t) as all_t),
gains as (
  select bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * (all_s + 10000) / ((s.n + 1)::double * (all_t + 10000))))::bigint as gain
  from s left join t using (bucket), totals),
weights as (
  select place, count(*) as n_features, floor(sum(gain) / count(*)::double)::bigint as weight
  from doc_runs join hashed using (run) join gains using (bucket) group by place),
scored as (
  select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, len(words) as n_words,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || coalesce(doc_id::varchar, '')), 8))::bigint + 0.5) / 4294967296)))::bigint as score
  from docs left join weights using (place)),
ranked as (
  select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls first, n_features) as place,
    count(*) over (partition by n_words >= 20) as eligible from scored)
select doc_id, n_features, weight, score, case when n_words >= 20 and place <= 25 * eligible // 100 then place end as rank from ranked
"""
