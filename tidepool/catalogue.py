"""Registry of the store's queries, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import digest, documents, scalars
from tidepool.operators import listing, multipart, retention, state, stats, tenancy, tree
from tidepool.sources import tables
from tidepool.streaming import flows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# The tables of tidepool.sources.tables, for the oracle.
CTES = {
    "obj": "select 'ns-' || source as ns, lang || '/' || (doc_id % 10) || '/' || doc_id || '.txt' as key, sha256(text) as hash, strlen(text) as size, doc_id from documents",
    "pg": "select regexp_extract(url, '^https?://([^/]+)/([^?#]*)', 1) as ns, regexp_extract(url, '^https?://([^/]+)/([^?#]*)', 2) as key, sha256(html) as hash, strlen(html) as size from pages",
    "ops": """select event_id as seq, ts, 'ns-' || (user_id % 5) as ns, 'u' || (user_id % 50) || '/k' || (cast(regexp_extract(props, '"k": *([0-9]+)', 1) as bigint) % 10) as key,
      case event_type when 'error' then 'delete' when 'view' then 'read' else 'put' end as op, sha256(cast(event_id % 997 as varchar)) as hash, (event_id % 997) * 100 as size from events""",
    "w": "select *, row_number() over (partition by ns, key order by seq desc) as rn, lag(case when op = 'put' then hash end) over (partition by ns, key order by seq) as released from ops where op in ('put', 'delete')",
    "live": "select * from w where rn = 1 and op = 'put'",
    "refs": """select p.hash, p.size, coalesce(c.n, 0) as refcount, t.seq as updated_seq from (select hash, max(size) as size from ops where op = 'put' group by hash) p
      left join (select hash, count(*) as n from live group by hash) c using (hash)
      left join (select hash, max(seq) as seq from (select hash, seq from w where op = 'put' union all select released, seq from w where released is not null) group by hash) t using (hash)""",
    "ten": "select cast(r_regionkey as bigint) as id, r_name as name from region",
    "nss": "select cast(n_nationkey as bigint) as id, lower(replace(n_name, ' ', '-')) as name, case when n_nationkey % 7 <> 0 then cast(n_regionkey as bigint) end as tenant_id from nation",
    "mem": """select cast(n_regionkey as bigint) as tenant_id, lower(replace(c_name, '#', '-')) || '@example.com' as email,
      case when c_custkey % 50 = 0 and n_regionkey <> 4 then 'owner' else 'member' end as role from customer join nation on c_nationkey = n_nationkey""",
    "nobj": "select doc_id % 25 as namespace_id, doc_id || '.txt' as key, sha256(text) as hash, strlen(text) as size from documents",
    "owned": "select o.*, n.tenant_id from nobj o join nss n on n.id = o.namespace_id where n.tenant_id is not null",
    "ups": "select distinct conv_id as id, 'ns-' || (conv_id % 5) as ns, 'up/' || (conv_id % 7) || '/' || conv_id as key, timestamp '2024-01-01' + to_hours(conv_id) as created_at from conversations",
    "prt": "select conv_id as upload_id, cast(turn + 1 as int) as part_number, text as content, sha256(text) as etag, strlen(text) as size, timestamp '2024-01-01' + to_hours(conv_id + turn) as created_at from conversations",
    "man": """select upload_id, row_number() over (partition by upload_id order by case when upload_id % 5 = 3 then -part_number else part_number end) as pos, part_number,
      case when upload_id % 5 = 1 and part_number = 2 then '"bad"' else '"' || etag || '"' end as etag from prt where not (upload_id % 5 = 4 and part_number = 1)
      union all select upload_id, 99, 99, 'x' from prt where upload_id % 5 = 2 and part_number = 1""",
    "chk": """select m.upload_id, m.pos, m.part_number, case when m.part_number <= coalesce(lag(m.part_number) over (partition by m.upload_id order by m.pos), 0) then 'not_ascending'
      when p.etag is null then 'not_uploaded' when p.etag <> trim(m.etag, '"') then 'etag_mismatch' else 'ok' end as status from man m left join prt p using (upload_id, part_number)""",
    "ids": """select distinct array_to_string(p[1:d], '/') || case when d < len(p) then '/' else '' end as id, case when d > 1 then array_to_string(p[1:d-1], '/') || '/' end as parent_id,
      cast(d - 1 as int) as depth, d < len(p) as is_group from (select p, unnest(range(1, len(p) + 1)) as d from (select distinct string_split(key, '/') as p from obj))""",
    "tr": "select *, cast(row_number() over (partition by parent_id order by is_group desc, id) - 1 as int) as idx from ids",
    "anc": """select id, array_to_string(p[1:k], '/') || '/' as ancestor, cast(len(p) - k as int) as distance
      from (select id, p, unnest(range(1, len(p))) as k from (select id, string_split(rtrim(id, '/'), '/') as p from ids))""",
    "pos": "select id, parent_id, depth, is_group, row_number() over (order by id) - 1 as pos from ids",
}
_NEEDS = {"w": ["ops"], "live": ["w"], "refs": ["live"], "owned": ["nobj", "nss"], "man": ["prt"], "chk": ["man"], "ids": ["obj"], "tr": ["ids"], "anc": ["ids"], "pos": ["ids"]}


def _with(names: str, body: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return "with " + ", ".join(f"{n} as ({CTES[n]})" for n in order) + " " + body if order else body


def query(names: str = "", sql: str | None = None) -> Callable:
    """Registers a query; names: the oracle's tables; sql: its body (none: beyond SQL)."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = _with(names, sql)
        return f

    return keep


def _inline(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    return spark.sql(f"select * from values {', '.join(_tuple(r) for r in rows)} as v({names})")


def _said(x: object) -> str:
    return "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def _tuple(row: tuple) -> str:
    return "(" + ", ".join(map(_said, row)) + ")"


def _values(names: str, rows: list[tuple]) -> str:
    return f"(values {', '.join(_tuple(r) for r in rows)}) v({names})"


# -- statistics


_TOTALS = "cast(count(*) as bigint) as blobs, cast(sum(size) as bigint) as physical"


@query("obj", f"""select o.objects, o.logical, b.blobs, b.physical, o.logical / b.physical as ratio, o.logical - b.physical as saved
  from (select count(*) as objects, cast(sum(size) as bigint) as logical from obj) o, (select {_TOTALS} from (select distinct hash, size from obj)) b""")
def stats_global(spark, sf_dir):
    return stats.with_savings(stats.totals(tables.objects(spark, sf_dir)))


@query("obj", f"""select o.ns, o.objects, o.logical, b.blobs, b.physical, case when logical > 0 then printf('%.1f%%', 100.0 * (logical - physical) / logical) else '—' end as percent
  from (select ns, count(*) as objects, cast(sum(size) as bigint) as logical from obj group by ns) o join (select ns, {_TOTALS} from (select distinct ns, hash, size from obj) group by ns) b using (ns)""")
def stats_by_namespace(spark, sf_dir):
    t = stats.totals(tables.objects(spark, sf_dir), "ns")
    return t.withColumn("percent", stats.dedup_percent(F.col("logical"), F.col("physical")))


@query("owned", f"""select tenant_id, o.namespaces, o.objects, o.logical, b.blobs, b.physical from (select tenant_id, count(distinct namespace_id) as namespaces, count(*) as objects, cast(sum(size) as bigint) as logical from owned group by 1) o
  join (select tenant_id, {_TOTALS} from (select distinct tenant_id, hash, size from owned) group by 1) b using (tenant_id)""")
def stats_by_tenant(spark, sf_dir):
    own = tenancy.stats_inputs(tables.nation_objects(spark, sf_dir), tables.namespaces(spark, sf_dir))
    return own.select("tenant_id", "namespace_id").distinct().groupBy("tenant_id").agg(F.count("*").alias("namespaces")).join(stats.totals(own, "tenant_id"), "tenant_id")


@query("obj", "select cast(1 as double) as empty_ratio, '—' as empty_percent, sum(size) / (select sum(size) from (select distinct hash, size from obj)) as ratio from obj")
def dedup_ratio(spark, sf_dir):
    empty = stats.totals(tables.objects(spark, sf_dir).where("size < 0"))
    empty = empty.select(stats.ratio(F.col("logical"), F.col("physical")).alias("empty_ratio"), stats.dedup_percent(F.col("logical"), F.col("physical")).alias("empty_percent"))
    return empty.join(F.broadcast(stats.totals(tables.objects(spark, sf_dir)).select(stats.ratio(F.col("logical"), F.col("physical")).alias("ratio"))))  # a row each


# -- listing


def _listed(prefix: str, delimiter: str, marker: str, k: int, source: str = "obj", where: str = "ns = 'ns-src0'", compat: bool = False) -> str:
    n = len(prefix)
    group = f"case when strpos(substr(key, {n + 1}), '{delimiter}') > 0 then substr(key, 1, {n} + strpos(substr(key, {n + 1}), '{delimiter}')) end" if delimiter else "cast(null as varchar)"
    not_succ = f"and e.key not in (select substr(g, 1, length(g) - 1) || '{chr(ord(delimiter) + 1)}' from e where g is not null)" if compat else ""
    return f"""select * from (with e as (select key, {group} as g from {source} where {where} and starts_with(key, '{prefix}') and key > '{marker}'),
      n as (select distinct coalesce(g, key) as entry, g is not null as is_prefix from e where g is not null or (g is null {not_succ}))
      select entry, is_prefix, (select count(*) from n) > {k} as truncated from n order by entry limit {k})"""


def _ns0(spark, sf_dir):
    return tables.objects(spark, sf_dir).where("ns = 'ns-src0'")


@query("obj", _listed("", "", "", 20))
def list_flat(spark, sf_dir):
    return listing.page(listing.grouped(_ns0(spark, sf_dir)), 20)


@query("obj", _listed("en/", "/", "", 1000))
def list_delimited(spark, sf_dir):
    return listing.page(listing.grouped(_ns0(spark, sf_dir), "en/", "/"))


@query("obj", _listed("", "/", "en/3/", 2))
def list_page2(spark, sf_dir):
    return listing.page(listing.grouped(_ns0(spark, sf_dir), "", "/", "en/3/"), 2)


@query("obj", _listed("en/", "", "en/2/1", 10))
def list_start_after(spark, sf_dir):
    return listing.page(listing.grouped(_ns0(spark, sf_dir), "en/", None, "en/2/1"), 10)


_EDGES = [("a/x",), ("a0",), ("b",), ("a/",), ("/lead",), ("100%",), ("a_b",), ("é/è",), ("a/y/z",)]


@query("", _listed("", "/", "", 1000, _values("key", _EDGES), "true", True))
def list_successor_compat(spark, sf_dir):
    return listing.page(listing.grouped(_inline(spark, "key", _EDGES), "", "/", "", compat=True))


@query("", _listed("a", "/", "a/m", 2, _values("key", _EDGES), "true"))
def list_edges(spark, sf_dir):
    return listing.page(listing.grouped(_inline(spark, "key", _EDGES), "a", "/", "a/m"), 2)


@query("pg", _listed("en/", "/", "", 50, "pg", "true"))
def list_pages(spark, sf_dir):
    return listing.page(listing.grouped(tables.page_objects(spark, sf_dir).select("key").distinct(), "en/", "/"), 50)


@query("obj", """select count(*) as key_count, true as truncated, substr(max(entry), 1, length(max(entry)) - 1) || '0' as next_marker
  from (select distinct split_part(key, '/', 1) || '/' as entry from obj where ns = 'ns-src0' order by 1 limit 2)""")
def list_next_marker(spark, sf_dir):
    return listing.next_marker(listing.page(listing.grouped(_ns0(spark, sf_dir), "", "/"), 2), "/")


@query("obj", """select distinct case when strpos(substr(key, 4), '/') > 0 then substr(key, 1, 3 + strpos(substr(key, 4), '/')) else key end as entry, strpos(substr(key, 4), '/') > 0 as is_prefix,
  rtrim(substr(entry, 4), '/') as name from obj where ns = 'ns-src0' and starts_with(key, 'en/')""")
def list_level_all(spark, sf_dir):
    return listing.level(_ns0(spark, sf_dir), "en/").orderBy(F.col("is_prefix").desc(), "entry")


@query("obj", """select distinct '' as parent, split_part(key, '/', 1) || '/' as entry, true as is_prefix from obj where ns = 'ns-src0'
  union all select distinct 'en/', 'en/' || split_part(key, '/', 2) || '/', true from obj where ns = 'ns-src0' and starts_with(key, 'en/')""")
def list_expanded(spark, sf_dir):
    return listing.expanded(_ns0(spark, sf_dir), ["en/"])


# -- tenants


_MAIL = "customer-000000007@example.com"


@query("nss mem", f"select id, name, tenant_id from nss where tenant_id in (select tenant_id from mem where email = '{_MAIL}')")
def tenant_namespaces(spark, sf_dir):
    return tenancy.visible_namespaces(tables.namespaces(spark, sf_dir), tables.members(spark, sf_dir), _MAIL)


@query("nss", "select id, name, tenant_id from nss where tenant_id in (1, 3)")
def namespaces_for_tenants(spark, sf_dir):
    return tenancy.namespaces_of(tables.namespaces(spark, sf_dir), [1, 3])


@query("ten mem", f"select id, name, role from ten join mem on id = tenant_id where email = '{_MAIL}'")
def tenants_for_email(spark, sf_dir):
    return tenancy.tenants_of(tables.tenants(spark, sf_dir), tables.members(spark, sf_dir), _MAIL)


@query("mem", f"select tenant_id, role from mem where email = '{_MAIL}'")
def member_role(spark, sf_dir):
    return tables.members(spark, sf_dir).where(F.col("email") == _MAIL).select("tenant_id", "role")


@query("nss", "select id, name, tenant_id from nss where name = 'nation_3'")
def get_namespace(spark, sf_dir):
    return tables.namespaces(spark, sf_dir).where("name = 'nation_3'").select("id", "name", "tenant_id")


@query("nss", "select id, name, tenant_id from nss order by name")
def list_namespaces(spark, sf_dir):
    return tables.namespaces(spark, sf_dir).select("id", "name", "tenant_id").orderBy("name")


@query("nss mem", f"select id, name from nss join mem using (tenant_id) where email = '{_MAIL}' and name = 'nation_2'")
def namespace_for_member(spark, sf_dir):
    mine = tables.members(spark, sf_dir).where(F.col("email") == _MAIL).select("tenant_id")
    return tables.namespaces(spark, sf_dir).where("name = 'nation_2'").join(mine, "tenant_id").select("id", "name")


@query("ten", "select id from ten where name = (select min(name) from ten)")
def tenant_id_by_name(spark, sf_dir):
    t = tables.tenants(spark, sf_dir)
    return t.join(t.agg(F.min("name").alias("name")), "name", "left_semi").select("id")


@query("mem", "select email, role from mem where tenant_id = 2 order by email")
def list_members(spark, sf_dir):
    return tables.members(spark, sf_dir).where("tenant_id = 2").select("email", "role").orderBy("email")


@query("ten mem", "select id, name, count(*) filter (role = 'owner') as owners, count(role) as members from ten left join mem on id = tenant_id group by 1, 2")
def owner_counts(spark, sf_dir):
    return tenancy.owner_counts(tables.tenants(spark, sf_dir), tables.members(spark, sf_dir))


@query("ten mem", "select id, name from ten where id not in (select tenant_id from mem where role = 'owner')")
def ownerless_tenants(spark, sf_dir):
    return tenancy.owner_counts(tables.tenants(spark, sf_dir), tables.members(spark, sf_dir)).where("owners = 0").select("id", "name")


_NEW = [(1, "nation_3"), (2, "fresh"), (3, "fresh"), (4, "other")]


@query("nss", f"select seq, name, case when name in (select name from nss) or row_number() over (partition by name order by seq) > 1 then 'exists' else 'created' end as status from {_values('seq, name', _NEW)}")
def create_namespace_outcomes(spark, sf_dir):
    return tenancy.create_outcomes(_inline(spark, "seq, name", _NEW), tables.namespaces(spark, sf_dir))


_GONE = [("nation_3",), ("nation_24",), ("nowhere",)]


@query("nss nobj", f"""select v.name, case when id is null then 'missing' when id in (select namespace_id from nobj where size > 6000) then 'not_empty' else 'deleted' end as status
  from {_values('name', _GONE)} left join nss using (name)""")
def delete_namespace_outcomes(spark, sf_dir):
    return tenancy.delete_namespace_outcomes(_inline(spark, "name", _GONE), tables.namespaces(spark, sf_dir), tables.nation_objects(spark, sf_dir).where("size > 6000"))


@query("nss nobj", "select count(*) filter (id not in (select namespace_id from nobj where size > 6000)) as deleted, count(*) filter (id in (select namespace_id from nobj where size > 6000)) + 1 as failed from nss")
def delete_outcome_counts(spark, sf_dir):
    spaces = tables.namespaces(spark, sf_dir)
    asked = spaces.select("name").unionByName(_inline(spark, "name", [("nowhere",)]))
    return state.outcome_counts(tenancy.delete_namespace_outcomes(asked, spaces, tables.nation_objects(spark, sf_dir).where("size > 6000")))


_FOUND = [(1, "fresh", "ann@corp.io"), (2, "ASIA", "bob@corp.io"), (3, "fresh", "cy@corp.io"), (4, "other", "cy@corp.io")]


@query("ten mem", f"""select t.id, t.name, m.owners, m.members from (select id, name from ten union all select (select max(id) from ten) + row_number() over (order by seq), name from (select name, min(seq) as seq from {_values('seq, name, email', _FOUND)}
  where name not in (select name from ten) group by name)) t left join (select tenant_id, count(*) filter (role = 'owner') as owners, count(*) as members from (select tenant_id, role from mem union all
  select (select max(id) from ten) + row_number() over (order by seq), 'owner' from (select name, min(seq) as seq from {_values('seq, name, email', _FOUND)} where name not in (select name from ten) group by name)) group by 1) m on t.id = m.tenant_id""")
def create_tenants(spark, sf_dir):
    t, m = tenancy.create_tenants(_inline(spark, "seq, name, email", _FOUND), tables.tenants(spark, sf_dir), tables.members(spark, sf_dir))
    held = m.groupBy(F.col("tenant_id").alias("id")).agg(F.count_if(F.col("role") == "owner").alias("owners"), F.count("*").alias("members"))
    return t.join(held, "id", "left").select("id", "name", "owners", "members")


_OUT = [("REGION_0",), ("AFRICA",), ("ASIA",), ("ATLANTIS",)]


@query("ten nss", f"select v.name, case when id is null then 'missing' when id in (select tenant_id from nss where tenant_id is not null) then 'not_empty' else 'deleted' end as status from {_values('name', _OUT)} left join ten using (name)")
def delete_tenant_outcomes(spark, sf_dir):
    return tenancy.delete_tenant_outcomes(_inline(spark, "name", _OUT), tables.tenants(spark, sf_dir), tables.namespaces(spark, sf_dir))


_CHANGES = "select tenant_id, email, case role when 'owner' then 'member' else 'owner' end as role, row_number() over (order by tenant_id, email) as seq from mem where email like '%7@example.com'"


@query("mem", f"select tenant_id, email, coalesce(c.role, mem.role) as role from mem left join ({_CHANGES}) c using (tenant_id, email)")
def upsert_members(spark, sf_dir):
    m = tables.members(spark, sf_dir)
    flipped = F.when(F.col("role") == "owner", "member").otherwise("owner").alias("role")
    changes = m.where(F.col("email").like("%7@example.com")).select("tenant_id", "email", flipped, F.xxhash64("email").alias("seq")).withColumn("seq", F.abs(F.col("seq") % 1000))
    return tenancy.upsert_members(m, changes)


@query("mem", """select r.tenant_id, r.email, case when mem.role is null then 'absent' when mem.role = 'owner' and (select count(*) from mem m where m.tenant_id = r.tenant_id and m.role = 'owner') <= 1 then 'last_owner' else 'removed' end as status
  from (select tenant_id, min(email) as email from mem where role = 'owner' group by 1 union all select tenant_id, 'nobody@example.com' from mem group by 1 union all select tenant_id, max(email) from mem where role = 'member' group by 1) r left join mem using (tenant_id, email)""")
def remove_member_outcomes(spark, sf_dir):
    m = tables.members(spark, sf_dir)
    first = m.where("role = 'owner'").groupBy("tenant_id").agg(F.min("email").alias("email"))
    last = m.where("role = 'member'").groupBy("tenant_id").agg(F.max("email").alias("email"))
    nobody = m.select("tenant_id").distinct().withColumn("email", F.lit("nobody@example.com"))
    return tenancy.remove_member_outcomes(first.unionByName(nobody).unionByName(last), m)


@query("ten mem", f"""select t.name as tenant, '{_MAIL}' as email, o.owner_only, case when role is null then 404 when o.owner_only and role <> 'owner' then 403 else 200 end as status
  from ten t, (values (true), (false)) o(owner_only) left join mem on t.id = tenant_id and mem.email = '{_MAIL}'""")
def authorise(spark, sf_dir):
    t = tables.tenants(spark, sf_dir)
    asked = t.select(F.col("name").alias("tenant"), F.lit(_MAIL).alias("email"), F.explode(F.array(F.lit(True), F.lit(False))).alias("owner_only"))
    return tenancy.authorise(asked, t, tables.members(spark, sf_dir))


@query("owned", "select t as tenant_id, hash, exists (select 1 from owned o where o.tenant_id = t and o.hash = d.hash) as visible from (select distinct sha256(text) as hash from documents) d, (values (0::bigint), (1::bigint)) v(t)")
def blob_visible_in_tenant(spark, sf_dir):
    asked = tables.load(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("hash")).distinct().withColumn("tenant_id", F.explode(F.expr("array(0L, 1L)")))
    return tenancy.blob_visible(asked, tables.nation_objects(spark, sf_dir), tables.namespaces(spark, sf_dir))


@query("owned", """select d.t as tenant_id, d.hash, o.size, case when o.size is null then 'miss' else 'linked' end as status
  from (select distinct doc_id % 5 as t, sha256(text) as hash from documents) d left join (select distinct tenant_id, hash, size from owned) o on o.tenant_id = d.t and o.hash = d.hash""")
def link_outcomes(spark, sf_dir):
    asked = tables.load(spark, sf_dir, "documents").select((F.col("doc_id") % 5).alias("tenant_id"), F.sha2("text", 256).alias("hash")).distinct()
    o = tables.nation_objects(spark, sf_dir)
    seen = tenancy.stats_inputs(o, tables.namespaces(spark, sf_dir)).select("tenant_id", "hash").distinct()
    return state.links(asked, o.select("hash", "size").distinct(), seen)


# -- state


@query("live", "select ns, key, hash, size, seq, (select min(x.seq) from w x where x.op = 'put' and x.ns = live.ns and x.key = live.key and x.seq > coalesce((select max(g.seq) from w g where g.op = 'delete' and g.ns = live.ns and g.key = live.key), -1)) as created_seq from live")
def objects_current(spark, sf_dir):
    return state.current(tables.operations(spark, sf_dir))


@query("refs", "select hash, size, refcount, updated_seq from refs")
def blob_refcounts(spark, sf_dir):
    return state.refcounts(tables.operations(spark, sf_dir))


@query("refs", """select count(*) as blobs, count(*) filter (refcount is distinct from n) as differing, count(*) filter (refcount = 0) as dead from refs full join
  (select hash, greatest(sum(d), 0) as n from (select hash, 1 as d from w where op = 'put' union all select released, -1 from w where released is not null) group by 1) using (hash)""")
def refcount_reconcile(spark, sf_dir):
    ops = tables.operations(spark, sf_dir)
    both = state.refcounts(ops).join(state.incremental_refcounts(ops).select("hash", F.col("refcount").alias("counted")), "hash", "full")
    return both.agg(F.count("*").alias("blobs"), F.count_if(~F.col("refcount").eqNullSafe(F.col("counted"))).alias("differing"), F.count_if(F.col("refcount") == 0).alias("dead"))


@query("ops", "select seq, ns, key, seq = min(seq) over (partition by hash) as is_new from ops where op = 'put'")
def put_is_new(spark, sf_dir):
    return state.put_outcomes(tables.operations(spark, sf_dir))


@query("w", "select seq, ns, key, op, released from w")
def overwrite_releases(spark, sf_dir):
    return state.transitions(tables.operations(spark, sf_dir)).select("seq", "ns", "key", "op", "released")


@query("live", """select r.ns, r.key as src, r.key || '.copy' as dst, hash, size, case when hash is null then 'NoSuchKey' else 'copied' end as status
  from (select distinct ns, key from ops) r left join (select ns, key, hash, size from live) using (ns, key)""")
def copy_objects(spark, sf_dir):
    ops = tables.operations(spark, sf_dir)
    asked = ops.select("ns", F.col("key").alias("src")).distinct().withColumn("dst", F.concat("src", F.lit(".copy")))
    return state.copies(asked, state.current(ops), ("ns",))


@query("live", "select r.ns, r.key, 'deleted' as status, l.key is not null as existed from (select distinct ns, key from ops) r left join (select ns, key from live) l on l.ns = r.ns and l.key = r.key")
def batch_delete_outcomes(spark, sf_dir):
    ops = tables.operations(spark, sf_dir)
    return state.batch_delete(ops.select("ns", "key").distinct(), state.current(ops), by=("ns",))


# -- multipart


@query("prt", "select upload_id, sha256(string_agg(content, '' order by part_number)) as digest, cast(sum(size) as bigint) as size, count(*) as parts from prt group by 1")
def multipart_assemble(spark, sf_dir):
    return multipart.assembled(tables.parts(spark, sf_dir))


def _manifest(spark, sf_dir):
    p = tables.parts(spark, sf_dir)
    order = F.expr("row_number() over (partition by upload_id order by if(upload_id % 5 = 3, -part_number, part_number))")
    said = F.when(F.expr("upload_id % 5 = 1 and part_number = 2"), '"bad"').otherwise(scalars.etag(F.col("etag"))).alias("etag")
    own = p.where("not (upload_id % 5 = 4 and part_number = 1)").select("upload_id", order.cast("long").alias("pos"), "part_number", said)
    extra = p.where("upload_id % 5 = 2 and part_number = 1").select("upload_id", F.lit(99).cast("long").alias("pos"), F.lit(99).alias("part_number"), F.lit("x").alias("etag"))
    return own.unionByName(extra)


@query("chk", "select upload_id, cast(pos as bigint) as pos, part_number, status from chk")
def manifest_validation(spark, sf_dir):
    return multipart.validated(_manifest(spark, sf_dir), tables.parts(spark, sf_dir))


@query("chk", """select v.upload_id, v.status, case when v.status = 'complete' then a.digest end as digest, case when v.status = 'complete' then a.size end as size, case when v.status = 'complete' then n.n else 0 end as dropped
  from (select upload_id, coalesce(min_by(status, pos) filter (status <> 'ok'), 'complete') as status from chk group by 1) v
  left join (select upload_id, sha256(string_agg(content, '' order by part_number)) as digest, cast(sum(size) as bigint) as size from man join prt using (upload_id, part_number) group by 1) a using (upload_id)
  left join (select upload_id, count(*) as n from prt group by 1) n using (upload_id)""")
def multipart_complete(spark, sf_dir):
    return multipart.completed(_manifest(spark, sf_dir), tables.parts(spark, sf_dir))


@query("prt", "select part_number, size, etag, (select count(*) from prt where upload_id = 1 and part_number > 1) > 2 as truncated from prt where upload_id = 1 and part_number > 1 order by part_number limit 2")
def parts_page(spark, sf_dir):
    return multipart.parts_page(tables.parts(spark, sf_dir), 1, 1, 2)


_PW = "select user_id % 20 as upload_id, cast(event_id % 4 + 1 as int) as part_number, event_id as seq, 'staging/' || event_id as staging_key, event_id * 10 as size, sha256(cast(event_id as varchar)) as etag from events"


def _part_writes(spark, sf_dir):
    return tables.load(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).alias("upload_id"), (F.col("event_id") % 4 + 1).cast("int").alias("part_number"), F.col("event_id").alias("seq"),
        tables.staging_path(F.col("event_id").cast("string")).alias("staging_key"), (F.col("event_id") * 10).alias("size"), F.sha2(F.col("event_id").cast("string"), 256).alias("etag"),
    )


@query("", f"select upload_id, part_number, max_by(staging_key, seq) as staging_key, max_by(size, seq) as size, max_by(etag, seq) as etag, max(seq) as seq from ({_PW}) group by 1, 2")
def parts_latest(spark, sf_dir):
    return multipart.latest_parts(_part_writes(spark, sf_dir))


@query("", f"select upload_id, part_number, seq, lag(staging_key) over (partition by upload_id, part_number order by seq) as replaced from ({_PW})")
def part_replacements(spark, sf_dir):
    return multipart.replaced(_part_writes(spark, sf_dir))


@query("", f"select upload_id, max_by(staging_key, seq) as staging_key from ({_PW}) where upload_id in (3, 5) group by upload_id, part_number")
def upload_removed(spark, sf_dir):
    gone = _inline(spark, "id", [(3,), (5,), (99999,)])
    return multipart.removed(tables.uploads(spark, sf_dir), multipart.latest_parts(_part_writes(spark, sf_dir)), gone)[1]


@query("ups", "select id, key, (select count(*) from ups where starts_with(key, 'up/3/')) > 1000 as truncated from ups where starts_with(key, 'up/3/') order by key, id limit 1000")
def uploads_by_prefix(spark, sf_dir):
    return multipart.uploads_under(tables.uploads(spark, sf_dir), "up/3/")


@query("ups", "select id, key, (select count(*) from ups where key like 'up_3%') > 1000 as truncated from ups where key like 'up_3%' order by key, id limit 1000")
def uploads_by_pattern_compat(spark, sf_dir):
    return multipart.uploads_under(tables.uploads(spark, sf_dir), "up_3", compat=True)


# -- retention


@query("refs", "select r.hash, o.ts as updated_at from refs r join ops o on o.seq = r.updated_seq where r.refcount = 0 and o.ts < (select max(ts) from ops) - interval 300 second order by 2, 1 limit 1000")
def gc_candidates(spark, sf_dir):
    ops = tables.operations(spark, sf_dir)
    dated = state.touched(ops)
    as_of = F.lit(ops.agg(F.max("ts")).first()[0])
    return retention.collectable(dated, as_of).select("hash", "updated_at")


_AS_OF = "timestamp_ntz '2024-01-04 00:00:00'"


@query("ups prt", "select id, key from ups where created_at < timestamp '2024-01-03' and id not in (select upload_id from prt where created_at >= timestamp '2024-01-03')")
def abandoned_uploads(spark, sf_dir):
    return retention.abandoned(tables.uploads(spark, sf_dir), tables.parts(spark, sf_dir), F.expr(_AS_OF)).select("id", "key")


@query("", f"""select 'staging/' || e.event_id as path from events e where e.ts <= timestamp '2024-01-04' - interval 300 second
  and 'staging/' || e.event_id not in (select max_by(staging_key, seq) from ({_PW}) group by upload_id, part_number)""")
def orphan_staging(spark, sf_dir):
    files = tables.load(spark, sf_dir, "events").select(tables.staging_path(F.col("event_id").cast("string")).alias("path"), F.col("ts").alias("modified"))
    return retention.orphans(files, multipart.latest_parts(_part_writes(spark, sf_dir)), F.expr(_AS_OF)).select("path")


@query("ups prt", "select (select count(*) from ups where ns not in ('ns-1', 'ns-3')) as uploads, (select count(*) from prt where upload_id % 5 not in (1, 3)) as parts")
def cascade_delete(spark, sf_dir):
    gone = _inline(spark, "ns", [("ns-1",), ("ns-3",)])
    u, p = retention.cascade(gone, tables.uploads(spark, sf_dir), tables.parts(spark, sf_dir))
    return u.agg(F.count("*").alias("uploads")).join(F.broadcast(p.agg(F.count("*").alias("parts"))))  # a row each


# -- scalar functions


_RANGES = [("bytes=0-4", 0, 4, "ok"), ("bytes=5-", 5, 9, "ok"), ("bytes=-3", 7, 9, "ok"), ("bytes=0-99", 0, 9, "ok"), ("bytes=10-", None, None, "invalid"), ("bytes=-0", None, None, "invalid"),
           ("bytes=0-1,3-4", None, None, "none"), ("bytes=-", None, None, "invalid"), ("bytes=x-1", None, None, "invalid"), ("items=1-2", None, None, "none"), ("bytes=7-3", None, None, "invalid"), ("bytes=-40", 0, 9, "ok"),
           (" bytes=0-4\t", 0, 4, "ok"), ("bytes= 0 - 4 ", 0, 4, "ok"), ("bytes=+1-4", 1, 4, "ok"), ("bytes=1-+4", 1, 4, "ok"), ("bytes=--3", None, None, "invalid"), ("Bytes=0-4", None, None, "none")]


@query("", f"select header, status, cast(first as bigint) as first, cast(last as bigint) as last from {_values('header, first, last, status', _RANGES)}")
def range_parse(spark, sf_dir):
    given = _inline(spark, "header", [(r[0],) for r in _RANGES])
    return given.select("header", scalars.byte_range(F.col("header"), F.lit(10).cast("long")).alias("r")).select("header", "r.*")


@query("", "select doc_id, sha256(case when strlen(text) > 5 then encode(text)[6:25] end) as head, sha256(case when strlen(text) > 0 then encode(text)[greatest(strlen(text) - 19, 1):strlen(text)] end) as tail, sha256(encode(text)) as whole from documents")
def object_range_read(spark, sf_dir):
    content = F.col("text").cast("binary")
    parts = {"head": "bytes=5-24", "tail": "bytes=-20", "whole": None}
    return tables.load(spark, sf_dir, "documents").select("doc_id", *[F.sha2(scalars.ranged(content, F.lit(h).cast("string")), 256).alias(k) for k, h in parts.items()])


@query("", "select n, delay_ms from (values (0, cast(250 as bigint)), (1, 500), (2, null)) v(n, delay_ms)")
def retry_delays(spark, sf_dir):
    return _inline(spark, "n", [(0,), (1,), (2,)]).select("n", scalars.retry_delay(F.col("n")).alias("delay_ms"))


@query("", f"select header, cast(case status when 'ok' then 206 when 'none' then 200 else 416 end as int) as code, cast(case status when 'ok' then last - first + 1 when 'none' then 10 else 0 end as bigint) as length from {_values('header, first, last, status', _RANGES)}")
def range_response(spark, sf_dir):
    given = _inline(spark, "header", [(r[0],) for r in _RANGES])
    return given.select("header", scalars.response_of(F.col("header"), F.lit(10).cast("long")).alias("r")).select("header", "r.*")


_NAMES = [("abc",), ("a",), ("ab",), ("a.b-c",), ("-abc",), ("abc-",), ("Abc",), ("a_b",), ("api",), ("x" * 63,), ("x" * 64,), ("",)]


@query("", f"select name, regexp_full_match(name, '[a-z0-9][a-z0-9.-]{{1,61}}[a-z0-9]') as valid from {_values('name', _NAMES)}")
def name_validation(spark, sf_dir):
    return _inline(spark, "name", _NAMES).select("name", scalars.valid_name(F.col("name")).alias("valid"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MAILS = [(" Ann@Example.com ", True), ("bob@corp.io", False), ("no-at", True), (None, True), ("", True), ("x@y@Example.com", True), ("x@\u212a.com", True), ("Y@K.com", True), ("\tz@k.com\n", True), ("\u0130@k.com", True)]


@query("", f"select email, verified, case when verified then translate(regexp_replace(email, '^\\s+|\\s+$', '', 'g'), '{_UPPER}', '{_LOWER}') end as normal, coalesce(regexp_replace(email, '^\\s+|\\s+$', '', 'g') <> '' and contains(email, '@'), false) as plausible from {_values('email, verified', _MAILS)}")
def email_normalise(spark, sf_dir):
    e, v = F.col("email"), F.col("verified")
    return _inline(spark, "email, verified", _MAILS).select("email", "verified", scalars.normal_email(e, v).alias("normal"), scalars.plausible_email(e).alias("plausible"))


@query("", f"select email, verified, coalesce(verified and (translate(email, '{_UPPER}', '{_LOWER}') in ('bob@corp.io') or translate(regexp_extract(email, '@([^@]*)$', 1), '{_UPPER}', '{_LOWER}') in ('example.com', 'k.com')), false) as admitted, true as open from {_values('email, verified', _MAILS)}")
def allowlist(spark, sf_dir):
    e, v = F.col("email"), F.col("verified")
    return _inline(spark, "email, verified", _MAILS).select("email", "verified", scalars.admitted(e, v, ["example.com", "K.com"], ["bob@corp.io"]).alias("admitted"), scalars.admitted(e, v, [], []).alias("open"))


_SIZES = [(0,), (1,), (1023,), (1024,), (1536,), (1048576,), (5368709120,), (1099511627776,), (1125899906842624,)]


@query("", f"""select n, case when n < 1024 then n || ' B' when n < 1024 ** 2 then printf('%.1f KB', n / 1024.0) when n < 1024 ** 3 then printf('%.1f MB', n / 1024.0 ** 2)
  when n < 1024 ** 4 then printf('%.1f GB', n / 1024.0 ** 3) when n < 1024 ** 5 then printf('%.1f TB', n / 1024.0 ** 4) else printf('%.1f PB', n / 1024.0 ** 5) end as said from (select cast(n as bigint) as n from {_values('n', _SIZES)})""")
def human_bytes(spark, sf_dir):
    return _inline(spark, "n", _SIZES).select(F.col("n").cast("long").alias("n"), scalars.human_bytes(F.col("n").cast("long")).alias("said"))


@query("", f"select n, greatest(8388608, cast(ceil(n / 10000) as bigint)) as part_size, cast(ceil(n / greatest(8388608, cast(ceil(n / 10000) as bigint))) as bigint) as parts, case when n < 16777216 then 'single' else 'multipart' end as strategy from (select cast(n as bigint) as n from {_values('n', _SIZES)})")
def part_plan(spark, sf_dir):
    n = F.col("n")
    return _inline(spark, "n", _SIZES).select(n.cast("long").alias("n")).select("n", scalars.part_plan(n).alias("p"), scalars.upload_strategy(n, F.lit(False)).alias("strategy")).select("n", "p.*", "strategy")


_FILES = [("a/b.PNG", None, "image/png", "image"), ("x.txt", None, "text/plain", "text"), ("x", None, scalars.GENERIC, "none"), ("v.mp4", "video/webm", "video/webm", "video"),
          ("d.pdf", scalars.GENERIC, scalars.GENERIC, "pdf"), ("s.json", None, "application/json", "text"), ("a.b/c", None, scalars.GENERIC, "none"), ("m.mp3", "", "", "none")]


@query("", f"select key, header, guessed, kind from {_values('key, header, guessed, kind', _FILES)}")
def content_type_guess(spark, sf_dir):
    given = _inline(spark, "key, header", [f[:2] for f in _FILES])
    guessed = scalars.content_type(F.col("header"), F.col("key"))
    return given.select("key", "header", guessed.alias("guessed"), scalars.preview_kind(F.col("header"), F.col("key")).alias("kind"))


@query("obj", "select key, 'blobs/' || hash[1:2] || '/' || hash[3:4] || '/' || hash as path, '\"' || hash || '\"' as etag, regexp_replace(key, '[^/]*$', '') as folder, base64(encode(key)) as marker from obj")
def key_paths(spark, sf_dir):
    k = F.col("key")
    return tables.objects(spark, sf_dir).select("key", tables.blob_path(F.col("hash")).alias("path"), scalars.etag(F.col("hash")).alias("etag"), scalars.dirname(k).alias("folder"), scalars.marker(k).alias("marker"))


_TEXTS = [("a b/c~*", "a%20b/c~%2A"), ("é", "%C3%A9"), ("x%y_z\\", "x%25y_z%5C"), ("<a & \"b\">", "%3Ca%20%26%20%22b%22%3E"), ("", "")]


@query("", f"select s, encoded, replace(replace(replace(s, '\\', '\\\\'), '%', '\\%'), '_', '\\_') as escaped, replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as html from {_values('s, encoded', _TEXTS)}")
def text_escapes(spark, sf_dir):
    given = spark.range(1).select(F.explode(F.array(*[F.lit(t[0]) for t in _TEXTS])).alias("s"))
    return given.select("s", scalars.encoded(F.col("s")).alias("encoded"), scalars.like_escaped(F.col("s")).alias("escaped"), scalars.html_escaped(F.col("s")).alias("html"))


_PATHS = [("/ui/x", "/ui/x", "ui/x/"), ("//evil", "/ui/", "evil/"), ("x", "/ui/", "x/"), (None, "/ui/", None), (" /a/b/ ", "/ui/", "a/b/"), ("", "/ui/", "")]


@query("", f"select path, redirect, destination from {_values('path, redirect, destination', _PATHS)}")
def path_rules(spark, sf_dir):
    p = F.col("path")
    return _inline(spark, "path", [(x[0],) for x in _PATHS]).select("path", scalars.safe_redirect(p).alias("redirect"), scalars.destination(p).alias("destination"))


@query("", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') as iso, strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') as http from events")
def time_formats(spark, sf_dir):
    e = tables.load(spark, sf_dir, "events")
    return e.select("event_id", scalars.iso_millis(F.col("ts")).alias("iso"), scalars.http_date(F.col("ts")).alias("http"))


_PARTS = [("1", 1), ("10000", 10000), ("0", None), ("10001", None), ("-1", None), ("x", None), ("", None), ("007", 7)]


@query("", f"select s, cast(n as int) as n from {_values('s, n', _PARTS)}")
def part_numbers(spark, sf_dir):
    return _inline(spark, "s", [(x[0],) for x in _PARTS]).select("s", scalars.part_number(F.col("s")).alias("n"))


# The signing key and the pads of HMAC for the constant keys, as blobs for the oracle.
_SCOPE = ("20240101", "us-east-1", "s3")
_SIGNING = digest.signing_key("secret", *_SCOPE)


def _hmac_sql(key: bytes, message: str) -> str:
    inner, outer = (bytes(x ^ pad for x in key.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


_REQUEST = "concat_ws(chr(10), 'GET', '/' || page_id, 'a=1&b=2%2F%20' || page_id, 'host:h' || chr(10), 'host', 'UNSIGNED-PAYLOAD')"
_TO_SIGN = f"concat_ws(chr(10), 'AWS4-HMAC-SHA256', '20240101T000000Z', '{'/'.join(_SCOPE)}/aws4_request', sha256({_REQUEST}))"


@query("", f"select page_id, {_hmac_sql(_SIGNING, _TO_SIGN)} as signature from pages")
def sigv4_signature(spark, sf_dir):
    page = F.col("page_id").cast("string")
    rest = [F.lit(x) for x in ("host:h\n", "host", "UNSIGNED-PAYLOAD")]
    said = scalars.request_signature(_SIGNING, f"{'/'.join(_SCOPE)}/aws4_request", "20240101T000000Z", F.lit("GET"), F.concat(F.lit("/"), page), F.concat(F.lit("b=2/%20"), page, F.lit("&a=1")), *rest)
    return tables.load(spark, sf_dir, "pages").select("page_id", said.alias("signature"))


@query()
def blake3_etag(spark, sf_dir):
    return tables.contents(spark, sf_dir).select("ns", "key", digest.blake3(F.col("content")).alias("digest"))


_B64 = "replace(replace(rtrim(base64({}), '='), '+', '-'), '/', '_')"


@query("", f"select doc_id, {_B64.format('encode(text)')} || '.' || {_B64.format('unhex(' + _hmac_sql(b'secret', 'text') + ')')} as value from documents")
def cookie_sign(spark, sf_dir):
    return tables.load(spark, sf_dir, "documents").select("doc_id", scalars.signed_value("secret", F.col("text")).alias("value"))


# -- trees


def _nodes(spark, sf_dir):
    return tree.rows(tables.objects(spark, sf_dir))


@query("tr", "select id, parent_id, depth, is_group, idx from tr")
def tree_rows(spark, sf_dir):
    return _nodes(spark, sf_dir)


@query("anc", "select id, ancestor, distance from anc")
def tree_ancestors(spark, sf_dir):
    return tree.ancestors(_nodes(spark, sf_dir))


@query("ids", "select id from ids where starts_with(id, 'en/1/') and id <> 'en/1/' or starts_with(id, 'fr/') and id <> 'fr/'")
def tree_descendants(spark, sf_dir):
    return tree.descendants(_nodes(spark, sf_dir), ["en/1/", "fr/"])


@query("ids", "select id from ids where not (starts_with(id, 'en/1/') and id <> 'en/1/' or starts_with(id, 'fr/') and id <> 'fr/')")
def tree_visible(spark, sf_dir):
    return tree.visible(_nodes(spark, sf_dir), _inline(spark, "id", [("en/1/",), ("fr/",)])).select("id")


@query("ids", "select parent_id, count(*) as siblings from ids group by 1")
def tree_sibling_count(spark, sf_dir):
    return tree.sibling_counts(_nodes(spark, sf_dir))


@query("pos", "select id, pos from pos where pos between (select pos from pos where id = 'en/0/') and (select pos from pos where id = 'en/1/')")
def tree_range_select(spark, sf_dir):
    return tree.select_range(tree.positions(_nodes(spark, sf_dir)), "en/1/", "en/0/").withColumn("pos", F.col("pos").cast("long"))


@query("ids", "select id from ids where parent_id = 'en/' and is_group")
def tree_expand_siblings(spark, sf_dir):
    return tree.siblings_groups(_nodes(spark, sf_dir), "en/1/")


@query("ids", "select id, parent_id, cast(row_number() over (partition by parent_id order by is_group desc, id) - 1 as int) as idx from ids where not starts_with(id, 'en/1/')")
def tree_remove(spark, sf_dir):
    return tree.removed(_nodes(spark, sf_dir), ["en/1/"]).select("id", "parent_id", "idx")


_PUT = [("en/a-new/", 0), ("en/b-new/", 1)]


@query("tr", f"""select id, parent_id, cast(row_number() over (partition by parent_id order by idx, old, place) - 1 as int) as idx from (select id, parent_id, idx, 1 as old, 0 as place from tr
  union all select v.id, tr.parent_id, tr.idx, 0, v.place from {_values('id, place', _PUT)} join tr on tr.id = 'en/1/')""")
def tree_insert(spark, sf_dir):
    return tree.inserted(_nodes(spark, sf_dir), _inline(spark, "id, place", _PUT), "en/1/")


@query("ids", "select id from ids where is_group and not starts_with(id, 'en/') and id <> 'fr/2/'")
def tree_collapse(spark, sf_dir):
    return tree.collapsed(_nodes(spark, sf_dir).where("is_group").select("id"), ["en/", "fr/2/"])


@query("ids", "select id from ids where is_group and (depth = 0) <> starts_with(id, 'en/')")
def tree_toggle(spark, sf_dir):
    groups = _nodes(spark, sf_dir).where("is_group")
    return tree.toggled(groups.where("depth = 0").select("id"), groups.where(F.col("id").startswith("en/")).select("id"))


@query("ids", "select count(*) filter (not is_group) as files, count(*) filter (is_group) as folders from ids where starts_with(id, 'fr/')")
def selection_summary(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    chosen = nodes.where(F.col("id").startswith("fr/")).select("id").unionByName(_inline(spark, "id", [("nowhere/",), ("fr/1/",)]))
    return tree.selection_summary(nodes, chosen)


@query("pos", """select id, coalesce(lag(id) over (order by pos), id) as up, coalesce(lead(id) over (order by pos), id) as down, (select min_by(id, pos) from pos) as home, (select max_by(id, pos) from pos) as "end",
  case when parent_id in (select id from pos) then parent_id end as left, (select min_by(c.id, c.pos) from pos c where c.parent_id = pos.id) as right from pos""")
def tree_keyboard(spark, sf_dir):
    return tree.keyboard(tree.positions(_nodes(spark, sf_dir)))


@query("ids", "select id from (values ('en/'), ('fr/2/'), ('de/1/')) v(id)")
def tree_without_nested(spark, sf_dir):
    return tree.without_nested(_inline(spark, "id", [("en/",), ("en/1/",), ("fr/2/",), ("de/1/",)]))


@query("obj", "select distinct key from obj where starts_with(key, 'en/1/') or starts_with(key, 'en/') or starts_with(key, 'fr/2/')")
def delete_expansion(spark, sf_dir):
    return tree.keys_under(tables.objects(spark, sf_dir), ["en/1/", "en/", "fr/2/"])


@query("ids", "select id from ids where is_group")
def tree_group_ids(spark, sf_dir):
    return _nodes(spark, sf_dir).where("is_group").select("id")


@query("pos", "select id, coalesce(lead(id) over (order by pos), id) as next, coalesce(lag(id) over (order by pos), id) as previous from pos")
def tree_moves(spark, sf_dir):
    return tree.moves(tree.positions(_nodes(spark, sf_dir)))


@query("pos", "select id, pos from pos where starts_with(regexp_extract(id, '([^/]*)/?$', 1), '2') order by (pos - 3 - 1 + (select count(*) from pos)) % (select count(*) from pos) limit 1")
def tree_type_ahead(spark, sf_dir):
    return tree.type_ahead(tree.positions(_nodes(spark, sf_dir)), 3, "2").withColumn("pos", F.col("pos").cast("long"))


@query("pos", "select distinct a.id, b.depth as guide from pos a join pos b on b.pos > a.pos and b.depth < a.depth where b.pos < coalesce((select min(r.pos) from pos r where r.depth = 0 and r.pos > a.pos), 1073741824)")
def tree_guides(spark, sf_dir):
    return tree.guides(tree.positions(_nodes(spark, sf_dir)))


@query("tr", "select parent_id as id, list(id order by idx) as children from tr where parent_id is not null group by 1")
def tree_nested(spark, sf_dir):
    return tree.nested(_nodes(spark, sf_dir))


@query("ids", "select id, true as has from ids where is_group")
def tree_has_children(spark, sf_dir):
    return tree.has_children(_nodes(spark, sf_dir), _inline(spark, "id", [("en/",), ("fr/",)]))


@query("tr", """select id, parent_id, depth, is_group, idx from tr union all
  select 'en/' || v.n, 'en/', 1, v.n = 'zz/', cast(v.k + (select count(*) from tr where parent_id = 'en/') as int) from (values ('new', 0), ('zz/', 1)) v(n, k)""")
def tree_with_children(spark, sf_dir):
    new = _inline(spark, "id, is_group", [("en/new", False), ("en/zz/", True)])
    return tree.with_children(_nodes(spark, sf_dir), "en/", new)


# -- requests and bodies


_AUTH = [("AWS4-HMAC-SHA256 Credential=AK/20240101/eu/s3/aws4_request, SignedHeaders=host;x-amz-date, Signature=abc", "AK", "eu", "host:h v\nx-amz-date:d\n"), ("Basic xyz", None, None, None),
         ("AWS4-HMAC-SHA256 Credential=AK/20240101/eu/s3, SignedHeaders=host, Signature=abc", None, None, None), ("AWS4-HMAC-SHA256 Credential=A/1/r/s/t,SignedHeaders=host;nope,Signature=f", "A", "r", None)]


@query("", f"select header, key_id, region, lines from {_values('header, key_id, region, lines', _AUTH)}")
def auth_header_parse(spark, sf_dir):
    given = spark.range(1).select(F.explode(F.array(*[F.lit(a[0]) for a in _AUTH])).alias("header"))
    sent = F.create_map(F.lit("host"), F.lit("  h   v "), F.lit("x-amz-date"), F.lit("d"))
    parsed = given.select("header", scalars.auth_header(F.col("header")).alias("a"))
    return parsed.select("header", "a.key_id", "a.region", scalars.canonical_headers(sent, F.col("a.signed")).alias("lines"))


_SOURCES = [("/ns/a%20b/c", "ns", "a b/c"), ("ns/k+1", "ns", "k+1"), ("nokey", None, None), ("ns/%C3%A9", "ns", "é")]


@query("", f"select header, ns, key from {_values('header, ns, key', _SOURCES)}")
def copy_source(spark, sf_dir):
    return _inline(spark, "header", [(x[0],) for x in _SOURCES]).select("header", scalars.copy_source(F.col("header")).alias("c")).select("header", "c.*")


_STRINGS = [("a=1&b=2&a=3", "3"), ("a=x%20y&c", "x y"), ("", None), ("b=1", None), ("a", "")]


@query("", f"select raw, a from {_values('raw, a', _STRINGS)}")
def query_strings(spark, sf_dir):
    return _inline(spark, "raw", [(x[0],) for x in _STRINGS]).select("raw", F.try_element_at(scalars.query_pairs(F.col("raw")), F.lit("a")).alias("a"))


@query("", "select ['email', 'profile'] as by_default, ['a'] as asked")
def scope_list(spark, sf_dir):
    none = F.lit(None).cast("array<string>")
    return spark.range(1).select(scalars.scopes(none).alias("by_default"), scalars.scopes(F.array(F.lit("openid"), F.lit("a"))).alias("asked"))


@query("", "select page_id, strlen(html) <= 4096 as fits, sha256(encode(html)[1:101]) as shown, strlen(html) > 101 as truncated from pages")
def body_limits(spark, sf_dir):
    p = tables.load(spark, sf_dir, "pages")
    return p.select("page_id", scalars.within_cap(F.col("html"), 4096).alias("fits"), scalars.preview_window(F.col("html").cast("binary"), 101).alias("v")).select("page_id", "fits", F.sha2("v.shown", 256).alias("shown"), "v.truncated")


@query("obj", """select '{"ns":"' || ns || '","key":"' || key || '","etag":"' || hash || '","size":' || size || '}' as json from obj""")
def listing_json(spark, sf_dir):
    return tables.objects(spark, sf_dir).select(F.to_json(F.struct("ns", "key", F.col("hash").alias("etag"), "size")).alias("json"))


@query("obj", "select ns, key, size from obj")
def listing_xml_round_trip(spark, sf_dir):
    xml = F.to_xml(F.struct(F.col("key").alias("Key"), F.col("size").alias("Size")), {"rowTag": "Contents"})
    return tables.objects(spark, sf_dir).select("ns", F.from_xml(xml, "Key string, Size long").alias("x")).select("ns", F.col("x.Key").alias("key"), F.col("x.Size").alias("size"))


@query("", "select user_id, count(*) as live from events where ts + interval 24 hour > (select max(ts) from events) group by 1")
def live_sessions(spark, sf_dir):
    e = tables.load(spark, sf_dir, "events")
    as_of = F.lit(e.agg(F.max("ts")).first()[0])
    return e.where(F.col("ts") > as_of - F.expr("interval 24 hours")).groupBy("user_id").agg(F.count("*").alias("live"))


# -- streams


@query("ops", "select hash, count(*) as puts from ops where op = 'put' group by 1")
def stream_put_counts(spark, sf_dir):
    return flows.drained(flows.put_counts(flows.log_stream(spark, sf_dir)), "complete")


@query("", """select user_id, min(ts) as started, max(ts) + interval 12 hour as ended, count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id) as s
  from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 12 hour then 0 else 1 end as new from events)) group by user_id, s
  having max(ts) + interval 12 hour <= (select max(ts) from events) - interval 10 minute""")
def stream_sessions(spark, sf_dir):
    closed = flows.drained(flows.sessions(flows.log_stream(spark, sf_dir)), "append")
    return closed.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")


@query("", """select upload_id, min(ts) as started, max(ts) as last_seen, count(*) as n from (select *, sum(new) over (partition by upload_id order by ts, event_id) as s
  from (select *, user_id % 20 as upload_id, case when ts - lag(ts) over (partition by user_id % 20 order by ts, event_id) < interval 24 hour then 0 else 1 end as new from events)) group by upload_id, s
  having max(ts) + interval 24 hour <= (select max(ts) from events) - interval 10 minute""")
def stream_idle_uploads(spark, sf_dir):
    closed = flows.drained(flows.idle_uploads(flows.log_stream(spark, sf_dir)), "append")
    return closed.select("upload_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "n")


# -- more of the store


@query("ups", "select seq, ns, key, coalesce(kind, 'application/octet-stream') as content_type, case when ns in ('ns-0', 'ns-1', 'ns-2', 'ns-3', 'ns-4') then sha256(seq || '|' || ns || '|' || key) end as id, case when ns in ('ns-0', 'ns-1', 'ns-2', 'ns-3', 'ns-4') then 'created' else 'NoSuchBucket' end as status from (select id as seq, 'ns-' || (id % 7) as ns, key, case when id % 2 = 0 then 'text/plain' end as kind from ups)")
def create_uploads(spark, sf_dir):
    kind = F.when(F.col("id") % 2 == 0, "text/plain")
    asked = tables.uploads(spark, sf_dir).select(F.col("id").alias("seq"), F.concat(F.lit("ns-"), (F.col("id") % 7).cast("string")).alias("ns"), "key", kind.alias("content_type"))
    return multipart.created(asked, _inline(spark, "name", [(f"ns-{k}",) for k in range(5)]))


@query("ups", "select id, 'ns-' || (id % 6) as ns, key, case when id % 6 = id % 5 then 'found' else 'NoSuchUpload' end as status from ups")
def upload_lookup(spark, sf_dir):
    u = tables.uploads(spark, sf_dir)
    return multipart.found(u.select("id", F.concat(F.lit("ns-"), (F.col("id") % 6).cast("string")).alias("ns"), "key"), u)


@query("nss nobj", "select id, name, count(key) as objects, coalesce(cast(sum(size) as bigint), 0) as logical, (select count(*) from nss) as namespaces from nss left join (select * from nobj where size > 6000) o on o.namespace_id = nss.id group by 1, 2")
def namespace_counts(spark, sf_dir):
    spaces = tables.namespaces(spark, sf_dir)
    own = tables.nation_objects(spark, sf_dir).where("size > 6000").withColumnRenamed("namespace_id", "id")
    return stats.by_namespace(spaces, own)


@query("ten mem", "select id, name, email, role from ten left join mem on id = tenant_id")
def tenant_member_lists(spark, sf_dir):
    return tenancy.member_lists(tables.tenants(spark, sf_dir), tables.members(spark, sf_dir))


@query("refs ups prt", """select (select count(*) from (select r.hash from refs r join ops o on o.seq = r.updated_seq where r.refcount = 0 and o.ts < (select max(ts) from ops) - interval 300 second limit 1000)) as blobs,
  (select count(*) from gone) as uploads, (select count(*) from prt where upload_id in (select id from gone)) as parts
  from (select 1), (select 1) x where true""".replace("(select count(*) from gone)", "(select count(*) from (select id from ups where created_at < timestamp '2024-01-03' and id not in (select upload_id from prt where created_at >= timestamp '2024-01-03')))").replace("(select id from gone)", "(select id from ups where created_at < timestamp '2024-01-03' and id not in (select upload_id from prt where created_at >= timestamp '2024-01-03'))"))
def sweep_counts(spark, sf_dir):
    ops = tables.operations(spark, sf_dir)
    blobs = retention.collectable(state.touched(ops), F.lit(ops.agg(F.max("ts")).first()[0]))
    parts = tables.parts(spark, sf_dir)
    return retention.swept(blobs, retention.abandoned(tables.uploads(spark, sf_dir), parts, F.expr(_AS_OF)), parts)


@query("nss mem", "select name, email, cast(case when exists (select 1 from mem m where m.tenant_id = r.tenant_id and m.email = r.email) then 200 else 404 end as int) as status from (select n.name, n.tenant_id, m.email from nss n, (select distinct email from mem where role = 'owner') m) r")
def namespace_authorise(spark, sf_dir):
    spaces, held = tables.namespaces(spark, sf_dir), tables.members(spark, sf_dir)
    names = spaces.agg(F.collect_list("name").alias("names"))  # a request for each of some 25 names
    asked = held.where("role = 'owner'").select("email").distinct().join(F.broadcast(names)).select(F.explode("names").alias("name"), "email")
    return tenancy.authorise_namespace(asked, spaces, held)


@query("obj", "select key as entry, false as is_prefix, (select count(*) from obj where starts_with(key, 'en/')) > 500 as truncated from obj where starts_with(key, 'en/') order by 1 limit 500")
def list_json_page(spark, sf_dir):
    return listing.page(listing.grouped(tables.objects(spark, sf_dir), "en/"), listing.page_size(None, default=500))


@query("", f"select n, cast(k as int) as part_number, (k - 1) * part_size as offset, least(part_size, n - (k - 1) * part_size) as length from (select n, part_size, unnest(range(1, cast(ceil(n / part_size) as bigint) + 1)) as k from (select n, greatest(8388608, cast(ceil(n / 10000) as bigint)) as part_size from (select cast(n as bigint) as n from {_values('n', _SIZES)})))")
def part_rows(spark, sf_dir):
    n = F.col("n").cast("long")
    return _inline(spark, "n", _SIZES).select(n.alias("n")).select("n", F.explode(scalars.part_rows(F.col("n"))).alias("p")).select("n", "p.*")


_BROWSED = [("/a/b", "a/b"), ("  //x ", "x"), ("a/", "a/"), ("", ""), ("/", ""), ("\t/ a", " a")]


@query("", f"select s, regexp_replace(regexp_replace(s, '^\\s+|\\s+$', '', 'g'), '^/+', '') as prefix from {_values('s, prefix', _BROWSED)}")
def browse_prefix(spark, sf_dir):
    return _inline(spark, "s", [(x[0],) for x in _BROWSED]).select("s", scalars.browse_prefix(F.col("s")).alias("prefix"))


@query("", "select doc_id, regexp_full_match(v, '(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}') as uuid, case when lang = 'en' then 'owner' when lang = 'fr' then 'member' end as role from (select doc_id, lang, case when doc_id % 3 = 0 then sha256(text) else sha256(text)[1:8] || '-' || sha256(text)[9:12] || '-' || sha256(text)[13:16] || '-' || sha256(text)[17:20] || '-' || sha256(text)[21:32] end as v from documents)")
def ids_and_roles(spark, sf_dir):
    h = F.sha2("text", 256)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    v = F.when(F.col("doc_id") % 3 == 0, h).otherwise(F.concat_ws("-", *parts))
    said = F.when(F.col("lang") == "en", "owner").when(F.col("lang") == "fr", F.lit(None).cast("string")).otherwise("guest")
    return tables.load(spark, sf_dir, "documents").select("doc_id", scalars.is_uuid(v).alias("uuid"), scalars.role_of(said).alias("role"))


@query("ids tr", """select r.id, '{"id":"' || r.id || '","children":[' || string_agg('{"id":"' || g.id || '","children":[' || g.kids || ']}', ',' order by g.idx) || ']}' as tree from tr r
  join (select f.id, f.parent_id, f.idx, string_agg('{"id":"' || k.id || '"}', ',' order by k.idx) as kids from tr f join tr k on k.parent_id = f.id where f.depth = 1 group by 1, 2, 3) g on g.parent_id = r.id where r.depth = 0 group by r.id""")
def tree_nested_whole(spark, sf_dir):
    return tree.nested_below(_nodes(spark, sf_dir), 2)


@query("refs", """select c.seq, c.hash, r.size, case when r.hash is null then 'miss' else 'claimed' end as status, r.refcount + row_number() over (partition by c.hash order by c.seq) as refcount
  from (select doc_id as seq, sha256(cast(doc_id % 1100 as varchar)) as hash from documents) c left join (select * from refs where hash not in
  (select r.hash from refs r join ops o on o.seq = r.updated_seq where r.refcount = 0 and o.ts < (select max(ts) from ops) - interval 300 second order by o.ts, r.hash limit 1000)) r using (hash)""")
def blob_claims(spark, sf_dir):
    ops = tables.operations(spark, sf_dir)
    blobs = state.touched(ops)
    asked = tables.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.sha2((F.col("doc_id") % 1100).cast("string"), 256).alias("hash"))
    return state.claims(asked, blobs, retention.collectable(blobs, F.lit(ops.agg(F.max("ts")).first()[0])))


@query("live", """select r.seq, r.ns, r.key as src, r.key || '.copy' as dst, case when b.op = 'put' then b.hash end as hash, case when b.op = 'put' then b.size end as size, case when b.op = 'put' then 'type/' || (b.seq % 3) end as content_type,
  case when b.op = 'put' then 'copied' else 'NoSuchKey' end as status from ops r left join (select r.seq as at, max(x.seq) as seq from ops r join w x on x.ns = r.ns and x.key = r.key and x.seq < r.seq where r.op = 'read' group by 1) l on l.at = r.seq
  left join ops b on b.seq = l.seq where r.op = 'read'""")
def copies_in_log(spark, sf_dir):
    ops = tables.operations(spark, sf_dir).withColumn("content_type", F.concat(F.lit("type/"), (F.col("seq") % 3).cast("string")))
    asked = ops.where("op = 'read'").select("seq", "ns", F.col("key").alias("src"), F.concat("key", F.lit(".copy")).alias("dst"))
    return state.copies_as_of(asked, ops, ops.where("op = 'put'").select("hash"))


# -- answers and bodies


def _dated(spark, sf_dir):
    return _ns0(spark, sf_dir).withColumn("updated", F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, cast(size as decimal(18, 6)) / 1000)"))


def _answer_sql(prefix: str, delimiter: str, marker: str, k: int, head: str, where: str, item: str, group: str, tail: str) -> str:
    """A document around the entries of a page; where: what tells of markers, with the next one as m."""
    after = f"case when max_by(is_prefix, entry) then substr(max(entry), 1, length(max(entry)) - 1) || '{chr(ord(delimiter) + 1)}' else max(entry) end" if delimiter else "max(entry)"
    return f"""select {head} || n || {where} || own || groups || {tail} as doc from (select count(*) as k, max(truncated) as more, case when max(truncated) then {after} end as m,
      coalesce(string_agg({item}, '' order by entry) filter (not is_prefix), '') as own, coalesce(string_agg({group}, '' order by entry) filter (is_prefix), '') as groups,
      '<KeyCount>' || count(*) || '</KeyCount><IsTruncated>' || max(truncated) || '</IsTruncated>' as n
      from ({_listed(prefix, delimiter, marker, k)}) l left join (select *, timestamp '2024-01-01' + to_milliseconds(size) as updated from obj where ns = 'ns-src0') o on o.key = l.entry and not l.is_prefix)"""


_XML_HEAD = f"'<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<ListBucketResult xmlns=\"{documents.XMLNS}\"><Name>ns-src0</Name>"
_XML_ITEM = """'<Contents><Key>' || entry || '</Key><LastModified>' || strftime(updated, '%Y-%m-%dT%H:%M:%S.%gZ') || '</LastModified><ETag>"' || hash || '"</ETag><Size>' || size || '</Size><StorageClass>STANDARD</StorageClass></Contents>'"""
_XML_GROUP, _XML_TAIL = "'<CommonPrefixes><Prefix>' || entry || '</Prefix></CommonPrefixes>'", "'</ListBucketResult>'"


@query("obj", "select doc as xml from (" + _answer_sql("en/", "/", "", 3, _XML_HEAD + "<Prefix>en/</Prefix><Delimiter>/</Delimiter><MaxKeys>3</MaxKeys>'", "'<Marker/>' || coalesce('<NextMarker>' || m || '</NextMarker>', '')", _XML_ITEM, _XML_GROUP, _XML_TAIL) + ")")
def list_answer_v1(spark, sf_dir):
    return listing.answer_xml(_dated(spark, sf_dir), "ns-src0", "en/", "/", 3)


@query("obj", "select doc as xml from (" + _answer_sql("", "", "en/1", 7, _XML_HEAD + "<Prefix/><MaxKeys>7</MaxKeys>'", "'<ContinuationToken>ZW4vMQ==</ContinuationToken>' || coalesce('<NextContinuationToken>' || base64(encode(m)) || '</NextContinuationToken>', '')", _XML_ITEM, _XML_GROUP, _XML_TAIL) + ")")
def list_answer_v2(spark, sf_dir):
    return listing.answer_xml(_dated(spark, sf_dir), "ns-src0", max_keys=7, token="ZW4vMQ==", v2=True)


_JSON_ITEM = """',{"key":"' || entry || '","size":' || size || ',"etag":"' || hash || '","content_type":"text/plain","last_modified":"' || regexp_replace(strftime(updated, '%Y-%m-%dT%H:%M:%S.%g'), '\\.000$', '') || 'Z"}'"""


@query("obj", "select '{\"objects\":[' || substr(own, 2) || '],\"common_prefixes\":[' || substr(groups, 2) || '],\"next_token\":' || coalesce('\"' || base64(encode(m)) || '\"', 'null') || '}' as json from (select own, groups, m from ("
       + _answer_sql("", "", "", 500, "''", "''", _JSON_ITEM, "',\"' || entry || '\"'", "''").replace("as doc from", "as doc, own, groups, m from", 1) + "))")
def list_answer_json(spark, sf_dir):
    return listing.answer_json(_dated(spark, sf_dir))


_ERRORS = [("NoSuchKey", "no such key: a<b>&'c'", "no such key: a&lt;b&gt;&amp;&apos;c&apos;"), ("InvalidRange", 'range "x"', "range &quot;x&quot;"), ("InternalError", "", "")]


@query("", f"""select code, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<Error><Code>' || code || '</Code><Message>' || said || '</Message></Error>' as xml from {_values('code, message, said', _ERRORS)}""")
def error_answers(spark, sf_dir):
    return _inline(spark, "code, message, said", [(c, m, w) for c, m, w in _ERRORS]).select("code", documents.error(F.col("code"), F.col("message")).alias("xml"))


_SENT = [("<Delete><Object><Key>a b</Key></Object><Object><Key>c&amp;d</Key></Object><Quiet>true</Quiet></Delete>", "a b|c&d", True), ("<Delete><Object><Key>one</Key></Object></Delete>", "one", False),
         ("<Delete></Delete>", "", False), ("<Delete><Object><Key>cut", None, None), ("nothing", None, None)]


@query("", f"select body, keys, quiet from {_values('body, keys, quiet', _SENT)}")
def delete_bodies(spark, sf_dir):
    said = _inline(spark, "body", [(x[0],) for x in _SENT]).select("body", documents.delete_body(F.col("body")).alias("d"))
    return said.select("body", F.array_join("d.keys", "|").alias("keys"), "d.quiet")


def _sent_manifests(spark, sf_dir):
    """(upload_id, xml, json): the completing request of every upload."""
    m = _manifest(spark, sf_dir)
    one = documents.group("Part", documents.element("PartNumber", F.col("part_number")), documents.element("ETag", F.col("etag")))
    lines = m.select("upload_id", F.struct("pos", one.alias("xml"), F.struct("part_number", "etag").alias("part")).alias("line")).groupBy("upload_id").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    xml = documents.group("CompleteMultipartUpload", F.array_join(F.transform("lines", lambda x: x["xml"]), ""))
    return lines.select("upload_id", xml.alias("xml"), F.to_json(F.struct(F.transform("lines", lambda x: x["part"]).alias("parts"))).alias("json"))


_IN_ORDER = "select upload_id, cast(row_number() over (partition by upload_id order by pos) as int) as place, part_number, etag from man"


@query("man", _IN_ORDER)
def complete_bodies_xml(spark, sf_dir):
    parts = _sent_manifests(spark, sf_dir).select("upload_id", F.posexplode(documents.complete_body(F.col("xml"))).alias("place", "p"))
    return parts.select("upload_id", (F.col("place") + 1).alias("place"), "p.part_number", "p.etag")


@query("man", _IN_ORDER)
def complete_bodies_json(spark, sf_dir):
    parts = _sent_manifests(spark, sf_dir).select("upload_id", F.posexplode(documents.complete_body(F.col("json"), "json")).alias("place", "p"))
    return parts.select("upload_id", (F.col("place") + 1).alias("place"), "p.part_number", "p.etag")
