"""SQL for DuckDB with the rows of the catalogue queries."""

from shelfmark.plans.catalogue import NOW_NS

SQL: dict[str, str] = {}

CAT = r"""
with bare as (select distinct on (id) *, regexp_replace(regexp_replace(checksum_sha256, '[\s"'']', '', 'g'), '^sha256:', '') as h from objects),
cat as (select * replace (case when h is null then null when length(h) = 64 then base64(unhex(h)) else rtrim(replace(replace(h, '-', '+'), '_', '/'), '=') || '=' end as checksum_sha256) from bare),
live as (select distinct on (bucket, prefix) * from directories where deleted_at_ns is null)
"""
_GROUPS = CAT + """, grp as (
  select bucket, checksum_sha256, count(*) as files, sum(coalesce(size, 0))::bigint as total_size, coalesce(max(size), 0) * (count(*) - 1) as wasted_size,
    coalesce(bool_or({match}), false) as matched
  from cat where checksum_sha256 is not null group by 1, 2 having count(*) > 1)
"""

SQL["dup_groups"] = _GROUPS.format(match="true") + "select bucket, checksum_sha256, files, total_size, wasted_size from grp"
SQL["dup_key_contains"] = _GROUPS.format(match="key ilike '%REPORT%.%'") + "select bucket, checksum_sha256, files, total_size, wasted_size from grp where matched"
SQL["dup_key_depth"] = _GROUPS.format(match="key ilike '%scan_%' and length(key) - length(replace(key, '/', '')) <= 3") + "select bucket, checksum_sha256, files, total_size, wasted_size from grp where matched"
SQL["dup_members"] = _GROUPS.format(match="true") + "select c.bucket, c.checksum_sha256, c.id, c.key from cat c join grp using (bucket, checksum_sha256)"
SQL["dup_first_size"] = CAT + "select bucket, checksum_sha256, arg_min_null(size, (prefix, name)) as size from cat where checksum_sha256 is not null group by all"
_CROSS = CAT + """, grp as (
  select checksum_sha256, count(*) as files, sum(coalesce(size, 0))::bigint as total_size, count(distinct bucket) as buckets
  from cat where checksum_sha256 is not null group by 1 having count(*) > 1)
"""
SQL["dup_cross_bucket"] = _CROSS + "select * from grp"
SQL["dup_page"] = _CROSS + "select * from grp order by total_size desc, checksum_sha256 limit 100"
SQL["dup_page2"] = _CROSS + "select * from grp where total_size < 1000000 or (total_size = 1000000 and checksum_sha256 > '0') order by total_size desc, checksum_sha256 limit 100"
SQL["bucket_stats"] = _GROUPS.format(match="true") + """
select bucket, count(*) as files, sum(coalesce(size, 0))::bigint as total_size,
  coalesce((select sum(files - 1) from grp g where g.bucket = c.bucket), 0)::bigint as duplicate_files,
  coalesce((select sum(total_size - total_size // files) from grp g where g.bucket = c.bucket), 0)::bigint as duplicate_size,
  (select count(*) from (select dir_hash from live l where l.bucket = c.bucket and not stale and dir_hash is not null and file_count >= 1 group by 1 having count(*) > 1)) as duplicate_directories
from cat c group by bucket
"""

HASHES = """
  select bucket, prefix, case when bool_and(checksum_sha256 is not null) filter (where not junk) and count(*) filter (where not junk) > 0
      then sha256(string_agg(name || ':' || checksum_sha256 || chr(10), '' order by name) filter (where not junk)) end as dir_hash,
    (count(*) filter (where not junk))::int as file_count, coalesce(sum(size) filter (where not junk), 0)::bigint as total_size
  from (select *, name in ('.DS_Store', 'Thumbs.db', 'desktop.ini') as junk from {files} where prefix <> '') group by 1, 2
"""
SQL["dir_hashes"] = CAT + HASHES.format(files="cat")
_ORDERS = """
with lines as (select l_orderkey as o, l_linenumber as n, min(l_returnflag || l_linestatus) as c from lineitem group by 1, 2),
files as (select 'orders' as bucket, 'o' || lpad(o::varchar, 8, '0') || '/' as prefix, 'line_' || n || '.txt' as name, octet_length(encode(c))::bigint as size, base64(unhex(sha256(c))) as checksum_sha256 from lines),
dirs as (""" + HASHES.format(files="files") + """),
grp as (select bucket, dir_hash, count(*) as directories, min(file_count) as file_count, sum(total_size)::bigint as total_size, bool_or(prefix ilike 'O0000_%' and length(prefix) - length(replace(prefix, '/', '')) <= 1) as m
  from dirs where dir_hash is not null and file_count >= {least} group by 1, 2 having count(*) > 1)
"""
SQL["dup_dirs"] = _ORDERS.format(least=1) + "select bucket, dir_hash, directories, file_count, total_size from grp"
SQL["dup_dirs_members"] = _ORDERS.format(least=1) + "select bucket, prefix, dir_hash from dirs join grp using (bucket, dir_hash)"
SQL["dup_dirs_prefix"] = _ORDERS.format(least=1) + "select bucket, dir_hash, directories, file_count, total_size from grp where m"
SQL["dup_dirs_min_files"] = _ORDERS.format(least=3) + "select bucket, dir_hash, directories, file_count, total_size from grp"
SQL["dup_dirs_page"] = _ORDERS.format(least=1) + "select dir_hash, directories, file_count, total_size from grp where dir_hash > '4' order by dir_hash limit 100"
_COMPARE = CAT + """, l as (select bucket, regexp_replace(key, '^[^/]*/', '') as path, min(checksum_sha256) as h from cat where starts_with(key, 'archive/') group by 1, 2),
r as (select bucket, regexp_replace(key, '^[^/]*/', '') as path, min(checksum_sha256) as h from cat where starts_with(key, 'exports/') group by 1, 2),
cmp as (select coalesce(l.bucket, r.bucket) as bucket, coalesce(l.path, r.path) as path,
    case when r.path is null then 'only_in_left' when l.path is null then 'only_in_right' when l.h is not distinct from r.h then 'identical' else 'modified' end as status, l.h as left_hash, r.h as right_hash
  from l full join r on l.bucket = r.bucket and l.path = r.path)
"""
SQL["compare_dirs"] = _COMPARE + "select * from cmp"
SQL["compare_summary"] = _COMPARE + """
select bucket, count(*) filter (where status = 'identical') as files_identical, count(*) filter (where status = 'only_in_left') as files_only_in_left,
  count(*) filter (where status = 'only_in_right') as files_only_in_right, count(*) filter (where status = 'modified') as files_modified, bool_and(status = 'identical') as identical
from cmp group by 1
"""
SQL["compare_buckets"] = CAT + """
select coalesce(l.name, r.name) as name, case when r.name is null then 'only_in_left' when l.name is null then 'only_in_right' when l.h is not distinct from r.h then 'identical' else 'modified' end as status, l.h as left_hash, r.h as right_hash
from (select name, min(checksum_sha256) as h from cat where bucket = 'field-notes' group by 1) l
full join (select name, min(checksum_sha256) as h from cat where bucket = 'scan-archive' group by 1) r on l.name = r.name
"""
SQL["compare_buckets_by_key"] = CAT + """, side as (select bucket, key, min(checksum_sha256) as h from cat where bucket in ('field-notes', 'scan-archive') and key is not null group by 1, 2),
l as (select * from side where bucket = 'field-notes'), r as (select * from side where bucket = 'scan-archive')
select key, case when r.key is null then 'only_in_left' when l.key is null then 'only_in_right' when l.h is not distinct from r.h then 'identical' else 'modified' end as status, l.h as left_hash, r.h as right_hash
from l full join r using (key)
"""

SQL["list_flat"] = CAT + "select bucket, id, key from cat order by prefix, name limit 1000"
SQL["list_prefix"] = CAT + "select bucket, id, key from cat where starts_with(key, 'archive/de') order by prefix, name limit 1000"
SQL["list_page"] = CAT + "select bucket, id, key from cat where (prefix, name) > ('devices/h', 'm') order by prefix, name limit 1000"
SQL["list_keys"] = CAT + "select bucket, key from cat where starts_with(key, 'staging/')"
_ROLL = CAT + """, rest as (select key, size, substr(key, {n} + 1) as r from cat where starts_with(key, '{p}')),
rolled as (select case when contains(r, '{d}') then 'prefix' else 'object' end as kind, case when contains(r, '{d}') then '{p}' || left(r, instr(r, '{d}') + length('{d}') - 1) else key end as entry,
  case when not contains(r, '{d}') then size end as size from rest),
ent as (select kind, entry, max(size) as size from rolled group by 1, 2)
"""
SQL["list_delimiter"] = _ROLL.format(p="", n=0, d="/") + "select * from ent"
SQL["list_delimiter_below"] = _ROLL.format(p="archive/", n=8, d="-0") + "select * from ent"
SQL["list_entries_page"] = _ROLL.format(p="archive/", n=8, d="/") + ", later as (select * from ent where entry > 'archive/delta/' order by entry limit 51) select kind, entry, size, (select count(*) > 50 from later) as has_more from later order by entry limit 50"
_BUCKET_ROLL = CAT + """, ent as (
  select bucket, case when contains(r, '{d}') then 'prefix' else 'object' end as kind, case when contains(r, '{d}') then '{p}' || split_part(r, '{d}', 1) || '{d}' else key end as entry,
    coalesce(max(size) filter (where not contains(r, '{d}')), -1) as size
  from (select bucket, key, size, substr(key, length('{p}') + 1) as r from cat where starts_with(key, '{p}')) group by 1, 2, 3)
"""
SQL["list_bucket_delimiter"] = _BUCKET_ROLL.format(p="", d="/") + "select * from ent"
SQL["list_bucket_delimiter_below"] = _BUCKET_ROLL.format(p="archive/", d="-0") + "select * from ent"
SQL["list_bucket_entries_page"] = _BUCKET_ROLL.format(p="archive/", d="/") + """, later as (select * from ent where (bucket, entry) > ('field-notes', 'archive/delta/') order by bucket, entry limit 51)
select bucket, kind, entry, size, (select count(*) > 50 from later) as has_more from later order by bucket, entry limit 50"""
SQL["list_by_parent"] = CAT + "select bucket, prefix, count(*) as files, min(name) as first_name from cat group by 1, 2"
SQL["list_root"] = CAT + "select bucket, id, key from cat where prefix = ''"
SQL["list_buckets"] = "select distinct bucket from objects"
_EVENTS = r""", ev as (
  select distinct on (event_id) event_id, event_time, bucket, regexp_replace(lower(trim(event_name)), '^s3:', '') as kind, event_name, size, etag,
    ltrim(url_decode(replace(object_key, '+', ' ')), '/') as key, lower(object_id) as id from object_events)
"""
EXIST = _EVENTS + ", now_there as (select bucket, key from (select *, row_number() over (partition by bucket, key order by event_time desc, event_id desc) as r from ev where kind like 'objectcreated%' or kind like 'objectremoved%') where r = 1 and kind like 'objectcreated%')"
SQL["get_objects"] = CAT + EXIST + "select c.bucket, c.key, c.id, c.size, c.scan_level from cat c join now_there using (bucket, key)"
SQL["get_by_inode"] = CAT + "select bucket, inode, device_id, min(key) as key from cat where inode is not null and device_id is not null group by 1, 2, 3"

SQL["count_objects"] = "select count(distinct id) as objects from objects"
SQL["scan_status"] = CAT + "select bucket, count(*) as files, count(*) filter (where scan_level >= 3) as complete, count(*) filter (where scan_level < 3) as pending, 100.0::double * count(*) filter (where scan_level >= 3) / count(*) as percent from cat group by 1"
SQL["remaining"] = CAT + "select bucket, count(*) as files, coalesce(sum(size), 0)::bigint as bytes from cat where scan_level < 3 group by 1"
SQL["at_level_3"] = CAT + "select bucket, id, key from cat where scan_level >= 3"
SQL["below_level_page"] = CAT + "select bucket, id, key from cat where scan_level < 3 and (prefix, name) > ('devices/', '') order by prefix, name limit 1000"
SQL["byte_budget"] = CAT + """, run as (select bucket, key, coalesce(size, 0) as size, sum(coalesce(size, 0)) over w as running, row_number() over w as n from cat where scan_level < 3 window w as (partition by bucket order by prefix, name rows unbounded preceding))
select bucket, key, size, running::bigint as running from run where n <= 10000 and (running - size < 52428800 or n = 1)"""
PARTS = """
with p as (select *, lower(regexp_replace(upload_id, '[^0-9A-Fa-f]', '', 'g')) as hex from parts where upload_id is not null),
pp as (select * replace (hex[1:8] || '-' || hex[9:12] || '-' || hex[13:16] || '-' || hex[17:20] || '-' || hex[21:32] as upload_id) from p),
cur as (select * from pp qualify row_number() over (partition by upload_id, part_number order by uploaded_at desc, id desc) = 1)
"""
SQL["upload_throughput"] = PARTS + """, folded as (
  select upload_id, list_reduce(list(size::double order by part_number), lambda a, r: r * 0.3 + a * (1 - 0.3)) as rate from cur where size is not null group by 1)
select upload_id, round(rate, 3) as rate, least(floor(rate * 120)::bigint, 50 * 1024 * 1024 * 1024::bigint) as budget,
  case when rate <= 524288 then 32 when rate <= 1048576 then 16 when rate <= 8388608 then 8 else 1 end as readers from folded
"""

_L1 = r"""
with raw as (select bucket, snapshot_no, size, inode, device_id, mtime_ns, regexp_replace(regexp_replace(replace(prefix, '\', '/') || '/' || name, '^(\.?/)+', ''), '/(\.?/)+', '/', 'g') as key from disk_snapshot),
nos as (select bucket, snapshot_no, row_number() over (partition by bucket order by snapshot_no desc) as back from (select distinct bucket, snapshot_no from raw)),
old as (select distinct on (raw.bucket, key) raw.* from raw join nos using (bucket, snapshot_no) where back = 2),
new as (select distinct on (raw.bucket, key) raw.* from raw join nos using (bucket, snapshot_no) where back = 1),
side as (select coalesce(o.bucket, n.bucket) as bucket, coalesce(o.key, n.key) as key, coalesce(n.size, o.size) as size,
    case when n.key is null then o.inode else n.inode end as inode, case when n.key is null then o.device_id else n.device_id end as device_id, case when n.key is null then o.size else n.size end as s,
    case when o.key is null then 'new' when n.key is null then 'deleted' when (o.inode, o.device_id, o.size) is not distinct from (n.inode, n.device_id, n.size) then 'unchanged' else 'modified' end as class
  from old o full join new n on o.bucket = n.bucket and o.key = n.key),
f as (select bucket, inode, device_id, s, min(key) filter (where class = 'new') as nk, min(key) filter (where class = 'deleted') as ok from side where inode is not null and device_id is not null and s is not null group by 1, 2, 3, 4),
mv as (select * from f where nk is not null and ok is not null),
cls as (select side.bucket, side.key, mv.ok as old_key, case when mv.ok is not null then 'moved' else class end as class
  from side left join mv on mv.bucket = side.bucket and mv.nk = side.key where not exists (select 1 from mv g where g.bucket = side.bucket and g.ok = side.key))
"""
SQL["l1_classify"] = _L1 + "select * from cls"
SQL["l1_moves"] = _L1 + "select bucket, old_key, key from cls where class = 'moved'"
SQL["l1_stale"] = _L1 + "select bucket, key from cls where class = 'deleted'"
SQL["l1_report"] = _L1 + 'select bucket, count(*) filter (where class = \'new\') as "new", count(*) filter (where class = \'unchanged\') as unchanged, count(*) filter (where class = \'modified\') as modified, count(*) filter (where class = \'moved\') as moved, count(*) filter (where class = \'deleted\') as deleted from cls group by 1'
SQL["l1_next"] = _L1 + f"""
select c.bucket, c.key, sha256(c.bucket || '/' || coalesce(c.old_key, c.key) || case when class = 'new' then '/{NOW_NS}' else '' end) as id, n.size, n.inode,
  case when class in ('new', 'modified') then 1 else 2 end::int as scan_level, case when class in ('new', 'modified', 'moved') then {NOW_NS} else 0 end::bigint as last_modified_ns
from cls c join new n on n.bucket = c.bucket and n.key = c.key where class <> 'deleted'
"""
SQL["stale_dirs"] = _L1 + r"""
select distinct coalesce(o.bucket, n.bucket) as bucket, regexp_replace(coalesce(o.key, n.key), '[^/]*$', '') as prefix
from old o full join new n on o.bucket = n.bucket and o.key = n.key
where o.key is null or n.key is null or concat_ws('/', o.size, o.mtime_ns) is distinct from concat_ws('/', n.size, n.mtime_ns)
"""
_WRITTEN = _EVENTS + ", wr as (select *, epoch_us(event_time) * 1000 as created_at_ns from ev where kind like 'objectcreated%'), lastw as (select * from wr qualify row_number() over (partition by bucket, key order by event_time desc, event_id desc) = 1)"
SQL["upsert_latest"] = CAT + _WRITTEN + """
select coalesce(c.bucket, w.bucket) as bucket, coalesce(c.key, w.key) as key, case when c.key is null then w.id else c.id end as id,
  case when c.key is null then w.created_at_ns else c.created_at_ns end as created_at_ns, case when w.key is null then c.size else w.size end as size, case when w.key is null then c.etag else w.etag end as etag
from cat c full join lastw w on c.bucket = w.bucket and c.key = w.key
"""
_GONE = _EVENTS + ", gone as (select distinct bucket, key from ev where kind like 'objectremoved%')"
SQL["delete_anti"] = CAT + _GONE + "select bucket, key, id from cat c where not exists (select 1 from gone g where g.bucket = c.bucket and g.key = c.key)"
SQL["bulk_delete"] = CAT + _GONE + "select bucket, key, exists (select 1 from cat c where g.bucket = c.bucket and g.key = c.key) as existed from gone g"
SQL["rename_apply"] = CAT + f""", mv as (select bucket, key, replace(key, '/tmp/', '/') as nk from cat where contains(prefix, '/tmp/')),
ok as (select * from mv where not exists (select 1 from cat c where c.bucket = mv.bucket and c.key = mv.nk))
select c.bucket, coalesce(nk, c.key) as key, case when nk is null then c.prefix else regexp_replace(nk, '[^/]*$', '') end as prefix, case when nk is null then c.name else regexp_extract(nk, '[^/]*$') end as name, id,
  case when nk is null then last_modified_ns else {NOW_NS} end as last_modified_ns
from cat c left join ok on ok.bucket = c.bucket and ok.key = c.key
"""
SQL["rename_outcomes"] = CAT + EXIST + r""", asked as (select distinct bucket, key as old_key, regexp_replace(key, '\.tmp$', '.part') as new_key from ev where kind = 'objectcreated:copy')
select a.*, case when not exists (select 1 from now_there t where t.bucket = a.bucket and t.key = old_key) then 'no_such_key'
  when new_key <> old_key and exists (select 1 from now_there t where t.bucket = a.bucket and t.key = new_key) then 'exists' else 'moved' end as outcome from asked a
"""
SQL["enrich_monotone"] = CAT + _WRITTEN + """
select c.bucket, c.key, case when w.key is not null and c.scan_level < 2 then w.size else c.size end as size, case when w.key is not null and c.scan_level < 2 then w.etag else c.etag end as etag,
  case when w.key is not null and c.scan_level < 2 then 2 else c.scan_level end as scan_level from cat c left join lastw w on c.bucket = w.bucket and c.key = w.key
"""
SQL["reset_level"] = CAT + _WRITTEN + "select c.bucket, c.key, case when w.key is not null then least(c.scan_level, 1) else c.scan_level end as scan_level from cat c left join lastw w on c.bucket = w.bucket and c.key = w.key"
SQL["copy_apply"] = CAT + f"select 'copies' as bucket, bucket || '/' || key as key, bucket || '/' || prefix as prefix, name, sha256('copies/' || bucket || '/' || key || '/{NOW_NS}') as id, size, checksum_sha256 from cat where starts_with(prefix, 'shared/')"
SQL["merge_plan"] = CAT + """, w as (select distinct lower(winner_object_id) as winner_id from merge_results), asked as (
  select distinct w.winner_id, coalesce(l.id, 'none') as loser_id from w left join cat c on c.id = w.winner_id left join cat l on l.bucket = c.bucket and l.prefix = c.prefix)
select winner_id, loser_id, case when winner_id = loser_id then 'same_object' when c.id is null or l.id is null then 'no_such_key' when c.checksum_sha256 is null or l.checksum_sha256 is null then 'scan_pending'
  when c.checksum_sha256 <> l.checksum_sha256 then 'mismatch' else 'delete' end as outcome
from asked left join cat c on c.id = winner_id left join cat l on l.id = loser_id
"""

_FILES = """
with d as (select *, source as bucket, coalesce(lang, 'none') || '/doc_' || lpad(doc_id::varchar, 8, '0') || '.txt' as key, octet_length(encode(text)) as size, doc_id % 10 as ten, (doc_id // 10) % 2 as odd from documents),
v as (select bucket, key, size, case when ten = 9 then null when ten = 1 then 'file_missing' when ten = 5 then 'read_error'
  when ten = 3 then case when odd = 1 then 'content_mismatch_mtime_changed' else 'content_mismatch_no_mtime_change' end end as reason from d)
"""
SQL["integrity_reasons"] = _FILES + "select bucket, key, reason from v where reason is not null"
SQL["integrity_rollup"] = _FILES + "select bucket, count(*) as files_checked, count(*) filter (where reason is null) as files_ok, coalesce(sum(size) filter (where reason is null), 0)::bigint as bytes_checked, count(*) filter (where reason is not null) as discrepancies from v group by 1"

SQL["tags_get"] = CAT + "select bucket, key as object_key, e.key as tag, e.value as value from (select bucket, key, unnest(map_entries(metadata)) as e from cat)"
SQL["tags_limits"] = """
select source as bucket, doc_id::varchar as object_id, case when lang is null then 'no_such_object' when octet_length(encode(coalesce(title, 'none'))) > 128 then 'key_too_long' when octet_length(encode(text)) > 256 then 'value_too_long' end as problem
from documents where lang is null or octet_length(encode(coalesce(title, 'none'))) > 128 or octet_length(encode(text)) > 256
"""
SQL["multipart_etag"] = PARTS + """
select upload_id, case when count(etag) = count(*) then '"' || md5(unhex(string_agg(replace(etag, '"', ''), '' order by part_number))) || '-' || count(*) || '"' end as etag, count(*) as parts, coalesce(sum(size), 0)::bigint as size from cur group by 1
"""
SQL["multipart_check"] = PARTS + """
select f.upload_id, f.part_number, f.etag, coalesce(f.etag = c.etag, false) as valid
from (select * from pp qualify row_number() over (partition by upload_id, part_number order by uploaded_at, id) = 1) f join cur c on c.upload_id = f.upload_id and c.part_number = f.part_number
"""
SQL["multipart_list"] = "select distinct bucket, id, key from multipart_uploads where key ilike 'TEAMS/%' and key > 'teams/b' order by key, id limit 100"
SQL["abandoned_uploads"] = PARTS + """
select u.id, u.bucket, u.key, count(c.id) as parts, coalesce(sum(c.size), 0)::bigint as bytes
from (select distinct on (id) * from multipart_uploads where initiated_at < '2025-04-01') u left join cur c on c.upload_id = u.id group by 1, 2, 3
"""
SQL["webhook_match"] = r"""
with ev as (select event_id, bucket, string_split(regexp_replace(lower(trim(event_name)), '^s3:', ''), ':') as n, ltrim(url_decode(replace(object_key, '+', ' ')), '/') as object_key from object_events)
select event_id, 'w1' as webhook_id, object_key from ev where bucket = 'field-notes' and n[1] = 'objectcreated' and starts_with(object_key, 'archive/')
union all select event_id, 'w2', object_key from ev where bucket = 'field-notes' and n in (['objectremoved', 'delete'], ['objectcreated', 'put']) and suffix(object_key, '.jpg')
union all select event_id, 'w3', object_key from ev where bucket = 'scan-archive'
union all select event_id, 'w4', object_key from ev where bucket = 'studio-raw' and (n = ['objectcreated', 'p'] or n[1] = 'objecttagging') and starts_with(object_key, 'teams/') and suffix(object_key, '.json')
"""
SQL["cors_match"] = """
with a as (select event_id, event_type = 'view' as v, value > 50 as far, case event_type when 'click' then 'GET' when 'error' then 'HEAD' else 'PUT' end as m from events)
select event_id, case when v then case when not coalesce(far, false) and m in ('PUT', 'GET') then 1 end
  when far and m = 'GET' then 1 when m = 'HEAD' then 2 when not coalesce(far, false) then 3 end::int as rule from a
"""
SQL["conditional_get"] = CAT + _WRITTEN + """, a as (select w.event_id, w.etag, w.event_time, c.etag as held, make_timestamptz(c.last_modified_ns // 1000) as modified from wr w join cat c on c.bucket = w.bucket and c.key = w.key)
select event_id, case when held is not distinct from etag and etag is not null then 'not_modified' when modified <= event_time then 'not_modified' else 'ok' end as outcome,
  case when etag is not null and held is distinct from etag then 'failed' when modified > event_time then 'failed' else 'ok' end as copy_outcome from a
"""

SQL["digests"] = "select doc_id, '\"' || md5(text) || '\"' as etag, base64(unhex(sha256(text))) as sha256, base64(unhex(sha1(text))) as sha1, octet_length(encode(text))::int as size from documents"


def _table(polynomial: int) -> str:
    """What each byte does to a register, by eight steps of a bit."""
    return f"(select list(v order by i) from (select i, list_reduce(list_prepend(i::bigint, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, {polynomial}) else c // 2 end) as v from range(256) r(i)))"


_CRC = "base64(unhex(printf('%08x', xor(list_reduce(list_prepend(4294967295::bigint, l), lambda s, x: xor(s // 256, {t}[(xor(s, x) & 255) + 1])), 4294967295))))"
SQL["crc_digests"] = f"""
with tables as materialized (select {_table(0xEDB88320)} as a, {_table(0x82F63B78)} as b), texts as materialized (select doc_id, hex(encode(text)) as h from documents),
bytes as materialized (select doc_id, list_transform(range(0, length(h) // 2), lambda n: ('0x' || h[2 * n + 1:2 * n + 2])::bigint) as l from texts)
select doc_id, {_CRC.format(t='a')} as crc32, {_CRC.format(t='b')} as crc32c from bytes, tables
"""
# Kinds of the files that the tables' listings name, as the register of media types has them.
_KINDS = """('jpg', 'image/jpeg'), ('png', 'image/png'), ('tif', 'image/tiff'), ('pdf', 'application/pdf'), ('json', 'application/json'), ('csv', 'text/csv'), ('txt', 'text/plain'),
  ('md', 'text/markdown'), ('mp4', 'video/mp4'), ('wav', 'audio/x-wav'), ('bin', 'application/octet-stream')"""
SQL["content_types"] = f"with kinds(ext, kind) as (values {_KINDS}) select name, coalesce(kind, 'application/octet-stream') as content_type from (select distinct name from disk_snapshot) left join kinds on ext = lower(regexp_extract(name, '[^./]\\.([^./]+)$', 1))"
SQL["key_parts"] = CAT + """
select id, regexp_replace(key, '[^/]*$', '') as prefix, regexp_extract(key, '[^/]*$') as name, (length(key) - length(replace(key, '/', '')))::int as depth, replace(url_encode(key), '%2F', '/') as encoded,
  replace(replace(replace(replace(replace(key, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') as escaped from cat
"""
SQL["size_texts"] = CAT + """
select id, case when size >= 1073741824 then printf('%.1f GB', size / 1073741824.0::double) when size >= 1048576 then printf('%.1f MB', size / 1048576.0::double) when size >= 1024 then printf('%.1f KB', size / 1024.0::double) else printf('%d B', size) end as size_text from cat
"""
SQL["bucket_names"] = r"""
with p as (select distinct rtrim(prefix, '/') as path from directories), b as (select path, regexp_extract(path, '[^/]*$') as last from p),
t as (select *, regexp_replace(regexp_replace(trim(regexp_replace(lower(last), '[^a-z0-9.-]', '-', 'g'), '-.'), '-{2,}', '-', 'g'), '\.{2,}', '.', 'g') as n from b)
select path, case when n = '' then 'bucket' when length(n) < 3 then n || '-bucket' else n end as name,
  case when octet_length(encode(last)) not between 3 and 63 then 'invalid_length' when not regexp_full_match(last, '[a-z0-9.-]*') then 'invalid_characters' when regexp_matches(last, '^[.-]|[.-]$') then 'invalid_start_end'
    when contains(last, '--') or contains(last, '..') then 'consecutive_hyphens_or_periods' end as problem from t
"""
SQL["date_texts"] = "select distinct epoch_us(event_time) as event_us, strftime(event_time at time zone 'UTC', '%a, %d %b %Y %H:%M:%S GMT') as http_date, strftime(event_time at time zone 'UTC', '%Y-%m-%dT%H:%M:%S.%fZ') as rfc3339, epoch_us(event_time) // 1000000 * 1000000 as parsed_us from object_events"
SQL["byte_ranges"] = CAT + """, h as (select id, size, unnest(['bytes=0-' || size // 2, 'bytes=1024-', 'bytes=-1024']) as header, unnest([1, 2, 3]) as k from cat where size is not null)
select id, header, case k when 1 then 0 when 2 then 1024 else greatest(size - 1024, 0) end::bigint as first, case k when 1 then size // 2 else size - 1 end::bigint as last from h
"""

_PAGE = """
, top as (select *, row_number() over (order by {order}) as turn from {rows} order by {order} limit {limit} + 1),
pg as (select *, (select count(*) > {limit} from top) as has_more, (select case when count(*) > {limit} then max({token}) filter (where turn = {limit}) end from top) as nt from top where turn <= {limit})
"""
_TO64 = "base64(encode({}))"
SQL["dup_page_more"] = _CROSS + ", later as (select * from grp where total_size < 1000000 or (total_size = 1000000 and checksum_sha256 > '0'))" + _PAGE.format(
    rows="later", order="total_size desc, checksum_sha256", limit=50, token=_TO64.format("total_size || ':' || checksum_sha256")
) + "select checksum_sha256, files, total_size, buckets, has_more, coalesce(nt, '') as next_token from pg"
SQL["dup_dirs_page_more"] = _ORDERS.format(least=1) + ", later as (select dir_hash, directories, file_count, total_size from grp where dir_hash > '4')" + _PAGE.format(
    rows="later", order="dir_hash", limit=100, token=_TO64.format("dir_hash")
) + "select dir_hash, directories, file_count, total_size, has_more, coalesce(nt, '') as next_token from pg"
SQL["dup_cross_members"] = _CROSS + ", first as (select checksum_sha256, (select count(*) > 100 from grp) as truncated from grp order by 1 limit 100) select c.checksum_sha256, c.bucket, c.key, truncated from cat c join first using (checksum_sha256)"
SQL["dup_partial"] = _GROUPS.format(match="true") + """
select g.bucket, checksum_sha256, files, total_size, wasted_size, pending, pending = 0 as scan_complete
from grp g join (select bucket, count(*) filter (where scan_level < 3) as pending from cat group by 1) using (bucket)
"""
SQL["list_bucket_entries_more"] = _BUCKET_ROLL.format(p="archive/", d="/") + _PAGE.format(rows="ent", order="bucket, entry, kind", limit=20, token=_TO64.format("bucket || chr(0) || entry")) + "select bucket, kind, entry, size, has_more, coalesce(nt, '') as next_token from pg"
SQL["list_page_more"] = CAT + ", later as (select * from cat where bucket = 'field-notes' and (prefix, name) > ('archive/', ''))" + _PAGE.format(
    rows="later", order="prefix, name", limit=50, token=_TO64.format("key")
) + "select bucket, id, key, has_more, coalesce(nt, '') as next_token from pg"
SQL["get_object"] = """
with o as (select distinct bucket, id, key, inode, device_id from objects), f as (select * from o where key is not null and inode is not null and device_id is not null order by bucket, key limit 1)
select 'key' as by, o.bucket, o.id, o.key from o join f on o.bucket = f.bucket and o.key = f.key
union all select 'id', o.bucket, o.id, o.key from o join f on o.id = f.id
union all select 'identity', bucket, id, key from (select o.* from o join f on o.bucket = f.bucket and o.inode = f.inode and o.device_id = f.device_id order by o.key limit 1)
"""
SQL["byte_budget_next"] = CAT + """, one as (select *, sum(coalesce(size, 0)) over w as running, row_number() over w as n from cat where scan_level < 3 window w as (partition by bucket order by prefix, name rows unbounded preceding)),
rest as (select bucket, prefix, name, key, size from one where not (n <= 100 and (running - coalesce(size, 0) < 52428800 or n = 1))),
two as (select *, sum(coalesce(size, 0)) over w as running, row_number() over w as n from rest window w as (partition by bucket order by prefix, name rows unbounded preceding))
select bucket, count(*) as files, sum(coalesce(size, 0))::bigint as bytes, arg_max(key, n) as last_key, sum(coalesce(size, 0)) < 52428800 and count(*) < 100 as exhausted
from two where n <= 100 and (running - coalesce(size, 0) < 52428800 or n = 1) group by 1
"""
SQL["scopes"] = CAT + "select id, starts_with(key, 'archive/') as in_subtree, key in ('archive/delta/index.html', 'readme.txt') as in_files, true as in_bucket from cat"
SQL["file_keys"] = CAT + """, made as (select id, unnest([0, 1, 2, 3, 4]) as n, unnest([key, '/' || key, replace(key, '/', '/../'), '.shelfmark/' || key, '']) as k from cat)
select id, n::int as n, coalesce(k <> '' and k not like '/%' and not list_contains(string_split(k, '/'), '..') and string_split(k, '/')[1] <> '.shelfmark', false) as names_a_file from made
"""
SQL["durations"] = """
select part_number || unit as text, case unit when 's' then 1 when 'm' then 60 when 'h' then 3600 when 'd' then 86400 end * part_number::bigint as seconds
from (select distinct part_number from parts), (values ('s'), ('m'), ('h'), ('d')) u(unit)
union all select part_number || unit, -1 from (select distinct part_number from parts), (values ('w'), ('')) u(unit)
"""
SQL["copy_sources"] = CAT + "select id, bucket, key from cat where key is not null"
SQL["metadata_texts"] = CAT + "select id, coalesce(cardinality(metadata), 0)::int as entries, 0 as entries_cut from cat"
SQL["metadata_headers"] = CAT + "select id, lower(e.key) as name, e.value as value from (select id, unnest(map_entries(metadata)) as e from cat)"
SQL["rates"] = CAT + """, s as (select bucket, coalesce(sum(size) filter (where scan_level >= 3), 0) as size, count(*) filter (where scan_level >= 3) as done, count(*) as tried from cat group by 1)
select bucket, round(case when done > 0 then size * (tried / done) else size end / 10.0, 3)::double as rate from s
"""

#: Integers that may be unknown: -1 stands for that in results, so that they stay integers everywhere.
UNKNOWN = {"dup_first_size": ["size"], "list_delimiter": ["size"], "list_delimiter_below": ["size"], "list_entries_page": ["size"], "get_objects": ["size"], "l1_next": ["size", "inode"], "upsert_latest": ["size"], "enrich_monotone": ["size"], "copy_apply": ["size"], "cors_match": ["rule"]}

for _name, _columns in UNKNOWN.items():
    SQL[_name] = f"select * replace ({', '.join(f'coalesce({c}, -1) as {c}' for c in _columns)}) from ({SQL[_name]})"
