"""SQL for DuckDB with the rows of the queries of stored objects and uploads."""

from shelfmark.plans.catalogue import NOW_NS
from shelfmark.plans.oracle_catalogue import CAT, EXIST, HASHES, PARTS
from shelfmark.plans.oracle_catalogue import SQL as _CATALOGUE

SQL: dict[str, str] = {}

SQL["put_objects"] = f"""
select source as bucket, 'doc/' || doc_id as key, case when written_at is not null then 'old' else sha256(source || '/doc/' || doc_id || '/{NOW_NS}') end as id,
  case when title is not null then octet_length(encode(text)) else 0 end::bigint as size, case when title is not null then '"' || md5(text) || '"' end as etag,
  case when title is not null then 3 else 1 end::int as scan_level, case when written_at is not null then 0 else {NOW_NS} end::bigint as created_at_ns
from documents where title is not null or written_at is not null
"""
_DONE = PARTS + """, first as (select * from pp qualify row_number() over (partition by upload_id, part_number order by uploaded_at, id) = 1),
up as (select * from multipart_uploads qualify row_number() over (partition by id order by recorded_at desc) = 1),
whole as (select f.upload_id, bool_and(coalesce(f.etag = c.etag, false)) as whole, '"' || md5(unhex(string_agg(replace(f.etag, '"', ''), '' order by f.part_number))) || '-' || count(*) || '"' as etag, sum(c.size)::bigint as size
  from first f join cur c using (upload_id, part_number) group by 1)
"""
SQL["multipart_complete"] = _DONE + "select w.upload_id, case when u.id is null then 'no_such_upload' when not whole then 'invalid_part' else 'complete' end as outcome from whole w left join up u on u.id = w.upload_id"
SQL["multipart_objects"] = _DONE + f"select u.bucket, u.key, sha256(u.bucket || '/' || u.key || '/{NOW_NS}') as id, w.size, w.etag, coalesce(nullif(u.content_type, ''), 'application/octet-stream') as content_type from whole w join up u on u.id = w.upload_id where whole"
SQL["cleanup_report"] = f"select bucket, count(*) as uploads, sum(parts)::bigint as parts, sum(bytes)::bigint as bytes from ({_CATALOGUE['abandoned_uploads']}) group by 1"
SQL["parts_page"] = PARTS + "select upload_id, part_number, etag, size from cur where part_number > 5 and upload_id = (select upload_id from cur group by 1 order by count(*) desc, 1 limit 1) order by part_number limit 20"
SQL["parts_page_more"] = PARTS + """, p7 as (select upload_id, part_number from cur where upload_id = (select upload_id from cur group by 1 order by count(*) desc, 1 limit 1) order by part_number limit 8)
select upload_id, part_number, (select count(*) > 7 from p7) as has_more, case when (select count(*) from p7) > 7 then (select part_number from p7 order by 1 offset 6 limit 1) else -1 end::int as next_token
from p7 order by part_number limit 7
"""
SQL["uploads_page_more"] = """
with u as (select distinct bucket, id, key from multipart_uploads), o as (select *, row_number() over (order by key, id) as n from u), l as (select * from o where n between 2 and 12), m as (select count(*) > 10 as more from l)
select bucket, id, key, more as has_more, case when more then (select key from l where n = 11) else '' end as key_marker, case when more then (select id from l where n = 11) else '' end as id_marker from l, m where n <= 11
"""
SQL["head_objects"] = CAT + EXIST + "select bucket, key, etag, content_type from cat c where exists (select 1 from now_there t where t.bucket = c.bucket and t.key = c.key)"
SQL["fetch_by_keys"] = CAT + "select position, bucket, key, cat.id from cat join (select lower(winner_object_id) as id, min(epoch_us(merged_at)) as position from merge_results group by 1) w on w.id = cat.id"
SQL["dir_sizes"] = CAT + """, p as (select bucket, coalesce(size, 0) as size, string_split(rtrim(prefix, '/'), '/') as parts, case when prefix = '' then 0 else length(prefix) - length(replace(prefix, '/', '')) end as depth from cat),
e as (select bucket, size, parts, unnest(range(0, depth + 1)) as n from p)
select bucket, case when n = 0 then '' else array_to_string(parts[1:n], '/') || '/' end as directory, count(*) as files, sum(size)::bigint as bytes from e group by 1, 2
"""
SQL["dirs_unhashed"] = CAT + "select bucket, prefix from live where prefix <> '' and (coalesce(stale, true) or dir_hash is null)"
SQL["dirs_stored"] = CAT + ", hashed as (" + HASHES.format(files="cat") + """)
select l.bucket, l.prefix, coalesce(h.dir_hash, l.dir_hash) as dir_hash, case when h.dir_hash is null then l.file_count else h.file_count end as file_count,
  case when h.dir_hash is null then l.total_size else h.total_size end as total_size, case when h.dir_hash is null then l.stale else false end as stale
from live l left join hashed h on h.bucket = l.bucket and h.prefix = l.prefix and h.dir_hash is not null
"""
SQL["query_strings"] = CAT + "select bucket, prefix, 'acl=&delimiter=%2F&list-type=2&prefix=' || url_encode(prefix) as query from live"
SQL["link_expiry"] = """
select distinct id, strftime(recorded_at at time zone 'UTC', '%Y%m%dT%H%M%SZ') as signed, floor(epoch_us(deleted_at) / 1000000) - floor(epoch_us(recorded_at) / 1000000) > 86400 as expired from multipart_uploads where deleted_at is not null
"""

#: Integers that may be unknown: -1 stands for that in results, so that they stay integers everywhere.
UNKNOWN = {"dirs_stored": ["file_count", "total_size"], "multipart_objects": ["size"], "parts_page": ["size"]}

for _name, _columns in UNKNOWN.items():
    SQL[_name] = f"select * replace ({', '.join(f'coalesce({c}, -1) as {c}' for c in _columns)}) from ({SQL[_name]})"
