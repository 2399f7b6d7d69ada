"""SQL for DuckDB that gives the rows of the queries, written independently of the operators."""

from shelfmark.plans.oracle_catalogue import SQL as catalogue_sql
from shelfmark.plans.oracle_objects import SQL as objects_sql

SQL: dict[str, str] = {**catalogue_sql, **objects_sql}

_CHANGES = r"""
select *, regexp_replace(lower(trim(event_name)), '^s3:', '') as kind,
  ltrim(url_decode(replace(object_key, '+', ' ')), '/') as plain,
  lower(object_id) as oid
from object_events
"""

SQL["p1_found"] = f"""
with e as ({_CHANGES}), c as (
  select bucket, plain, oid, kind like 'objectcreated%' as made,
    row_number() over (partition by bucket, plain order by event_time desc, event_id desc) as r
  from e where kind like 'objectcreated%' or kind like 'objectremoved%')
select bucket, plain as object_key, oid as object_id from c where r = 1 and made
"""

SQL["p1_watermark"] = """
select coalesce(min(event_id) filter (where not exists (select 1 from object_events n where n.event_id = e.event_id + 1)), 0) as watermark
from object_events e
"""

_THEN = f"""
with seen as (select *, event_id as n from ({_CHANGES}) where received_at <= timestamp '2025-03-15'),
steps as (select n, n - lag(n, 1, 0) over (order by n) as step from (select distinct n from seen)),
reached as (select coalesce((select min(n) from steps where step > 1), (select coalesce(max(n), 0) + 1 from steps)) as first_beyond)
"""

# numbers from the first one on that has a gap before it are held
SQL["p1_held"] = _THEN + "select distinct event_id from seen, reached where n >= first_beyond"
SQL["p1_then"] = _THEN + """
select bucket, plain as object_key, oid as object_id from (
  select *, row_number() over (partition by bucket, plain order by event_time desc, event_id desc) as r
  from seen, reached where n < first_beyond and (kind like 'objectcreated%' or kind like 'objectremoved%')) where r = 1 and kind like 'objectcreated%'
"""

_UUID = "lower(regexp_replace({c}, '[^0-9A-Fa-f]', '', 'g'))"

_ORPHANS = f"""
with refs as (
  select 'parts' as child_table, 'multipart_uploads' as parent_table, id as child_id, '' as scope, {_UUID.format(c='upload_id')} as k,
    date_trunc('month', uploaded_at at time zone 'UTC') as m
  from parts where upload_id is not null
  union all
  select 'objects', 'directories', id, bucket, parent_dir_id::varchar, date_trunc('month', to_timestamp(created_at_ns / 1000000000.0) at time zone 'UTC')
  from objects where parent_dir_id is not null),
lives as (
  select 'multipart_uploads' as parent_table, '' as scope, {_UUID.format(c='id')} as k, recorded_at at time zone 'UTC' as a, deleted_at at time zone 'UTC' as b from multipart_uploads
  union all
  select 'directories', bucket, id::varchar, to_timestamp(recorded_at_ns / 1000000000.0) at time zone 'UTC', to_timestamp(deleted_at_ns / 1000000000.0) at time zone 'UTC' from directories),
lost as (
  select * from refs r where not exists (
    select 1 from lives l where l.parent_table = r.parent_table and l.scope = r.scope and l.k = r.k
      and l.a < r.m + interval 1 month and (l.b is null or l.b >= r.m + interval 1 month)))
"""

SQL["p2_found"] = _ORPHANS + "select distinct child_table, child_id, strftime(m, '%Y-%m') as period_month from lost"

SQL["p2_report"] = _ORPHANS + """
select child_table, parent_table, strftime(m, '%Y-%m') as period_month, count(distinct (scope, k)) as keys, count(*) as "references"
from lost group by all
"""

_LISTINGS = r"""
with raw as (
  select bucket, snapshot_no, loaded_at, is_symlink, symlink_target, size, mtime_ns, inode, device_id,
    regexp_replace(regexp_replace(replace(prefix, '\', '/') || '/' || name, '^(\.?/)+', ''), '/(\.?/)+', '/', 'g') as k
  from disk_snapshot),
rows_once as (select * from (select *, row_number() over (partition by bucket, snapshot_no, k order by loaded_at desc) as c from raw) where c = 1),
steps as (select bucket, snapshot_no, lead(snapshot_no) over (partition by bucket order by snapshot_no) as later from (select distinct bucket, snapshot_no from raw)),
old as (select s.later, o.* from rows_once o join steps s using (bucket, snapshot_no) where s.later is not null),
new as (select n.* from rows_once n join steps s on s.bucket = n.bucket and s.later = n.snapshot_no),
both_sides as (
  select coalesce(o.bucket, n.bucket) as bucket, coalesce(o.later, n.snapshot_no) as snapshot_no, o.k as ok, n.k as nk,
    o.inode as oi, o.device_id as od, o.size as os, n.inode as ni, n.device_id as nd, n.size as ns,
    (o.is_symlink, o.symlink_target, o.size, o.mtime_ns, o.inode, o.device_id) is distinct from (n.is_symlink, n.symlink_target, n.size, n.mtime_ns, n.inode, n.device_id) as differs
  from old o full join new n on n.bucket = o.bucket and n.snapshot_no = o.later and n.k = o.k),
gone as (select *, row_number() over (partition by bucket, snapshot_no, oi, od, os order by ok) as r from both_sides where nk is null and oi is not null and od is not null and os is not null),
come as (select *, row_number() over (partition by bucket, snapshot_no, ni, nd, ns order by nk) as r from both_sides where ok is null and ni is not null and nd is not null and ns is not null),
moved as (select g.bucket, g.snapshot_no, g.ok, c.nk from gone g join come c on c.bucket = g.bucket and c.snapshot_no = g.snapshot_no and c.ni = g.oi and c.nd = g.od and c.ns = g.os and c.r = g.r),
changes as (
  select bucket, snapshot_no, 'changed' as change_kind, ok as old_key, nk as new_key from both_sides where ok is not null and nk is not null and differs
  union all select bucket, snapshot_no, 'moved', ok, nk from moved
  union all select bucket, snapshot_no, 'removed', ok, '' from both_sides b where nk is null and not exists (select 1 from moved m where m.bucket = b.bucket and m.snapshot_no = b.snapshot_no and m.ok = b.ok)
  union all select bucket, snapshot_no, 'added', '', nk from both_sides b where ok is null and not exists (select 1 from moved m where m.bucket = b.bucket and m.snapshot_no = b.snapshot_no and m.nk = b.nk))
"""

SQL["p4_found"] = _LISTINGS + "select * from changes"
SQL["p4_report"] = _LISTINGS + "select bucket, snapshot_no, change_kind, count(*) as files from changes group by all"

_CONTENTS = r"""
with bare as (select id, key, size, regexp_replace(regexp_replace(checksum_sha256, '[\s"'']', '', 'g'), '^sha256:', '') as h from objects where checksum_sha256 is not null),
contents as (
  select id, key, size, case when length(h) = 64 then base64(unhex(h)) else rtrim(replace(replace(h, '-', '+'), '_', '/'), '=') || '=' end as content_hash from bare),
groups as (select content_hash, count(*) as n from contents group by 1),
sizes as (
  select content_hash, size from (
    select content_hash, size, row_number() over (partition by content_hash order by count(*) desc, size) as r from contents where size is not null group by 1, 2) where r = 1)
"""

SQL["p5_found"] = _CONTENTS + """
select g.content_hash, s.size from groups g left join sizes s using (content_hash)
where g.n >= 0.03 * (select count(*) from contents)
"""

SQL["p5_members"] = _CONTENTS + """
select c.content_hash, c.id, c.key, coalesce(s.size, -1) as group_size, g.n as group_rows
from contents c join groups g using (content_hash) left join sizes s using (content_hash) where g.n > 1
"""
