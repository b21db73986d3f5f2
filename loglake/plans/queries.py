"""Registered queries over the derived tables, with the SQL that DuckDB answers them by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.functions import scalars as S
from loglake.operators import analytics as W
from loglake.operators import crosswalk, declarative, detect, enrich, features, framing, identity, normalize, query, sinks, snapshots, stats, validate
from loglake.operators.extract import extract
from loglake.operators.ordered import written
from loglake.plans.ingest import ingest, parse
from loglake.plans.tables import MIXED, SEC_EVENTS, SEC_LINES, raw, view

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

SEC = f"sec as ({SEC_EVENTS})"
LIN = f"lin as ({SEC_LINES})"
MIX = f"mix as ({MIXED})"
IDS = """ids as (select *, sha256(line) as raw_hash, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('loglake:' || tenant_id || ':edge:' || sha256(line))) as h from lin),
    uid as (select *, substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || translate(substr(h,17,1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h,18,3) || '-' || substr(h,21,12) as event_id from ids)"""


def q(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _events(spark, sf):
    """Normalised events of the CEF lines, with the source columns that analytics needs."""
    return normalize.to_ues(normalize.normalize(parse(raw(spark, sf), formats=["cef"]), formats=["cef"]))


def _flat(spark, sf):
    return sinks.flatten_events(_events(spark, sf))


def _sec(spark, sf):
    return raw(spark, sf)


# --- identity and archive ------------------------------------------------------------------


@q(f"with {LIN}, {IDS} select seq, raw_hash, event_id from uid")
def i01_identity(spark, sf):
    return identity.with_event_id(identity.with_raw_hash(raw(spark, sf))).select("seq", "raw_hash", "event_id")


@q(f"with {LIN}, {IDS} select event_id, raw_hash as sha256, length(line)::bigint as length, tenant_id, strftime(ts, '%Y-%m-%d') as dt from uid")
def i03_archive(spark, sf):
    r = identity.with_event_id(identity.with_raw_hash(raw(spark, sf)))
    return identity.raw_archive(r.unionByName(r)).select("event_id", "sha256", "length", "tenant_id", F.col("dt").cast("string").alias("dt"))


@q(f"with {LIN}, {IDS} select event_id, length(line)::bigint as length from uid where tenant_id = 'tenant_alpha'")
def i04_lookup(spark, sf):
    r = identity.with_event_id(identity.with_raw_hash(raw(spark, sf)))
    ids = r.select("event_id").unionByName(spark.createDataFrame([("not-a-uuid",)], "event_id string"))
    return identity.lookup_raw(identity.raw_archive(r), ids, "tenant_alpha").select("event_id", "length")


@q(f"with {LIN}, {IDS} select event_id, seq % 3 <> 0 as archived, seq % 3 <> 0 as intact from uid")
def i06_integrity(spark, sf):
    r = identity.with_event_id(identity.with_raw_hash(raw(spark, sf)))
    return identity.verify_integrity(r, identity.raw_archive(r.filter("seq % 3 <> 0")))


@q("select user_id, event_type, max(event_id) as seq from events group by 1, 2")
def i07_dedup_latest(spark, sf):
    return identity.dedup_latest(_sec(spark, sf), ["user_id", "event_type"], ["seq"]).select("user_id", "event_type", "seq")


# --- framing -------------------------------------------------------------------------------


@q("""select conv_id, turn, strlen(l) > 200 as is_oversized, case when strlen(l) > 200 then left(l, 1024) || '...[TRUNCATED]' else l end as line
    from (select conv_id, turn, regexp_replace(unnest(string_split(text, chr(10))), '\\r+$', '') as l from conversations) where trim(l) <> ''""")
def r01_frame_lines(spark, sf):
    c = view(spark, sf, "select conv_id, turn, explode(split(text, '\\n')) as line from conversations", "conversations")
    return framing.frame_lines(c, 200).select("conv_id", "turn", "is_oversized", "line")


BLANKS = "' ' || chr(9) || chr(13) || chr(10)"


@q(f"select conv_id, turn, trim(x, {BLANKS}) as line from (select conv_id, turn, unnest(string_split(text, '. ')) as x from conversations) where trim(x, {BLANKS}) <> ''")
def r02_frame_delimited(spark, sf):
    c = view(spark, sf, "select conv_id, turn, text from conversations", "conversations")
    return framing.frame_delimited(c, ". ", text_col="text").select("conv_id", "turn", "line")


@q("""with n as (select conv_id, turn, role || ': ' || text as l, sum((role = 'user')::int) over (partition by conv_id order by turn) as record from conversations)
    select conv_id, record::bigint as record, min(turn) as turn, string_agg(l, chr(10) order by turn) as line from n group by 1, 2""")
def r03_frame_multiline(spark, sf):
    c = view(spark, sf, "select conv_id, turn, concat(role, ': ', text) as line from conversations", "conversations")
    return framing.frame_multiline(c, "^user: ", "conv_id", "turn").select("conv_id", "record", "turn", "line")


@q("""with n as (select conv_id * 1000 + turn as seq, role || ': ' || text as l, sum((role = 'user')::int) over (order by conv_id * 1000 + turn) as record from conversations)
    select record::bigint as record, min(seq) as seq, string_agg(l, chr(10) order by seq) as line from n group by 1""")
def r03_one_source(spark, sf):
    """All turns as the lines of one source, in blocks of its numbers."""
    c = view(spark, sf, "select conv_id * 1000 + turn as seq, concat(role, ': ', text) as line from conversations", "conversations")
    return framing.frame_multiline(c, "^user: ", [], "seq").select("record", "seq", "line")


@q("select user_id, count(*)::bigint as n_objects from events group by 1")
def r04_json_stream(spark, sf):
    """The objects of a user are one body, of which each row is a chunk."""
    b = view(spark, sf, "select user_id, event_id, props as line from events")
    return framing.frame_json_stream(b, partition_by="user_id", order_by="event_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_objects"))


#: Texts cut behind their fourth sign, as two rows in order.
HALVES = "select user_id, event_id * 2 + h as seq, case h when 0 then substr(t, 1, 4) else substr(t, 5) end as line from (select *, explode(array(0, 1)) as h from ({}) x) y"


@q("select user_id, event_id * 2 as seq, props as line, null::varchar as frame_error from events")
def r04_json_chunks(spark, sf):
    b = view(spark, sf, HALVES.format("select user_id, event_id, concat(' ', props) as t from events"))
    return framing.frame_json_stream(b, partition_by="user_id").select("user_id", "seq", "line", "frame_error")


@q("select user_id, event_id * 2 as seq, props as line, null::varchar as frame_error from events")
def r05_octet_chunks(spark, sf):
    """Octet-counted messages of a user as one body, cut within their heads and texts."""
    b = view(spark, sf, HALVES.format("select user_id, event_id, concat(cast(octet_length(props) as string), ' ', props) as t from events"))
    return framing.frame_octet_counted(b, partition_by="user_id").select("user_id", "seq", "line", "frame_error")


@q("select event_id as seq, props as line from events")
def r05_octet_counted(spark, sf):
    b = view(spark, sf, "select event_id as seq, concat(cast(octet_length(props) as string), ' ', props) as line from events")
    return framing.frame_octet_counted(b).select("seq", "line")


# --- detection and extraction --------------------------------------------------------------

FORMAT_OF = """case user_id % 9 when 0 then 'cef' when 1 then 'leef' when 2 then 'cisco_asa' when 3 then 'paloalto_csv' when 4 then 'syslog_rfc3164'
    when 5 then 'syslog_rfc5424' when 6 then 'json_passthrough' when 7 then 'kv' else 'unknown' end"""
MIX_FORMATS = ["cef", "leef", "cisco_asa", "paloalto_csv", "syslog_rfc3164", "syslog_rfc5424", "json_passthrough"]


@q(f"with {SEC} select 'edge' as source_tag, {FORMAT_OF} as format_id, count(*) as n from sec group by 1, 2")
def d01_format_profile(spark, sf):
    return detect.format_profile(detect.detect_format(raw(spark, sf, MIXED)))


@q(f"with {SEC} select seq, case when event_type = 'view' then 'kv' when event_type = 'click' then 'leef' else {FORMAT_OF} end as format_id from sec")
def d02_overrides(spark, sf):
    r = raw(spark, sf, MIXED).withColumn("source_tag", F.concat(F.lit("tag:"), "event_type"))
    rules = spark.createDataFrame([("tag:view", "kv", 1), ("tag:vi", "cef", 2), ("tag:click", "leef", 3)], "prefix string, format string, rule_order int")
    return detect.detect_format(r, rules).select("seq", "format_id")


CEF_SEV = "case when sev = 0 then 1 when sev between 1 and 10 then sev else 5 end"


@q(f"""with {SEC} select seq, {FORMAT_OF} as format_id, case when user_id % 9 in (4, 5) then null else src_ip end as src_ip, case when user_id % 9 in (4, 5) then null else src_port end::varchar as src_port,
    (case user_id % 9 when 0 then {CEF_SEV} when 1 then {CEF_SEV} when 2 then 6 when 3 then 3 when 4 then 8 when 5 then 5 else least(10, sev) end)::varchar as severity,
    case when user_id % 9 in (0, 1, 3, 6) then 'user' || user_id end as username,
    case when user_id % 9 in (4, 5, 6) then '2026-08-05 10:20:30' when user_id % 9 = 2 then '2026-08-05 10:20:30' when user_id % 9 = 3 then '2026-01-02 03:04:05' end as event_ts
    from sec where user_id % 9 < 7""")
def p01_extract_fields(spark, sf):
    x = extract(detect.detect_format(raw(spark, sf, MIXED)), 2026, MIX_FORMATS).filter("parse_error IS NULL")
    f = lambda *ks: F.coalesce(*[F.try_element_at(F.col("extracted"), F.lit(k))["v"] for k in ks])
    return x.select("seq", "format_id", f("src_ip", "src").alias("src_ip"), f("src_port", "spt").alias("src_port"), f("severity_ues", "severity_numeric").alias("severity"), f("username", "suser", "src_user", "user").alias("username"), F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss").alias("event_ts"))


@q("select event_id as seq, (cast(json_extract(props, '$.k') as bigint))::varchar as k, 'long' as k_type from events")
def p12_json_types(spark, sf):
    e = view(spark, sf, "select event_id as seq, props as line, 'json_passthrough' as format_id from events")
    k = F.try_element_at(F.col("extracted"), F.lit("k"))
    return extract(e, formats=["json_passthrough"]).select("seq", k["v"].alias("k"), k["t"].alias("k_type"))


@q("""select o_orderkey, 'user ' || o_custkey as who, o_orderstatus as st, round(o_totalprice)::bigint::varchar as price from orders""")
def p13_key_value(spark, sf):
    o = view(spark, sf, "select o_orderkey, concat('st=', o_orderstatus, ' who=\"user ', cast(o_custkey as string), '\" price=', cast(cast(round(o_totalprice) as bigint) as string)) as line from orders", "orders")
    m = declarative.extract_kv(F.col("line"))
    return o.select("o_orderkey", *[F.try_element_at(m, F.lit(k)).alias(k) for k in ("who", "st", "price")])


@q("select c_custkey, 'a, ' || c_custkey as name, c_mktsegment as seg, 'x' as col_2 from customer")
def p14_csv(spark, sf):
    c = view(spark, sf, "select c_custkey, concat('\"a, ', cast(c_custkey as string), '\",', c_mktsegment, ', x') as line from customer", "customer")
    m = declarative.extract_csv(F.col("line"), ["name", "seg"])
    return c.select("c_custkey", *[F.try_element_at(m, F.lit(k)).alias(k) for k in ("name", "seg", "col_2")])


@q("select event_id as seq, json_extract_string(props, '$.k') as k, event_type as deep from events")
def p15_json_paths(spark, sf):
    e = view(spark, sf, "select event_id as seq, concat('{\"a\":{\"b\":[{\"t\":\"', event_type, '\"}]},', substr(props, 2)) as line from events")
    m = declarative.extract_json_paths(F.col("line"), {"deep": "a.b[0].t"})
    return e.select("seq", *[F.try_element_at(m, F.lit(k))["v"].alias(k) for k in ("k", "deep")])


@q("select event_id as seq, event_type as kind, user_id::varchar as who from events where event_type <> 'view'")
def p16_regex(spark, sf):
    e = view(spark, sf, "select event_id as seq, concat('user ', cast(user_id as string), ' did ', event_type) as line from events")
    m = declarative.extract_regex(F.col("line"), r"user (?P<who>\d+) did (?P<kind>[c-z][a-u]\w+)")
    return e.select("seq", *[F.try_element_at(m, F.lit(k)).alias(k) for k in ("kind", "who")]).filter("kind IS NOT NULL AND kind <> 'view'")


@q("select c_custkey, c_mktsegment as seg, c_nationkey::varchar as nation from customer")
def p17_delimited(spark, sf):
    c = view(spark, sf, "select c_custkey, concat(c_mktsegment, ' || ', cast(c_nationkey as string)) as line from customer", "customer")
    m = declarative.extract_delimited(F.col("line"), ["seg", "nation"], "||")
    return c.select("c_custkey", *[F.try_element_at(m, F.lit(k)).alias(k) for k in ("seg", "nation")])


@q("select event_id as seq, case when user_id % 3 = 0 then user_id::varchar else 'n' || user_id end as n, case when user_id * 500 <= 65535 then (user_id * 500)::varchar end as port, (event_type = 'view')::varchar as flag from events")
def p18_types(spark, sf):
    e = view(spark, sf, "select event_id as seq, if(user_id % 3 = 0, cast(user_id as string), concat('n', user_id)) as a, cast(user_id * 500 as string) as b, if(event_type = 'view', 'Yes', 'no') as c from events")
    return e.select("seq", declarative.convert(F.col("a"), "int").alias("n"), declarative.convert(F.col("b"), "port").alias("port"), declarative.convert(F.col("c"), "bool").alias("flag"))


KEY_VALUE = f"select *, concat('srcip=', src_ip, ' spt=', cast(src_port as varchar(20)), if(seq % 4 = 0, ' n=1', '')) as line from ({SEC_EVENTS}) s"


@q("""with k as (select unnest(['srcip', 'spt', 'n']) as key, unnest(['network.src_ip', 'network.src_port', null]) as role)
    select key, count(*) as n, round(count(*) / (select count(*) from events), 6)::double as coverage, role from k join events on key <> 'n' or event_id % 4 = 0 group by key, role""")
def p21_key_profile(spark, sf):
    return declarative.key_profile(raw(spark, sf, KEY_VALUE))


# --- normalisation and validation ----------------------------------------------------------


@q(f"""with {SEC}, m as (select *, user_id % 9 as k, case outcome when 'failure' then 'deny' when 'success' then 'allow' else 'log' end as act from sec where user_id % 9 < 7)
    select seq,
      case k when 0 then 'Acme' when 1 then 'Acme' when 2 then 'Cisco' when 3 then 'Palo Alto Networks' end as vendor,
      case k when 0 then case when category = 'authentication' then 'authentication' when category = 'threat' then 'threat' when category = 'policy' then 'policy' else 'network' end
             when 1 then 'network' when 2 then 'network' when 3 then 'network' when 4 then 'authentication' when 5 then 'network' else 'network' end as category,
      case k when 0 then act when 1 then act when 2 then 'permitted' when 3 then act when 6 then event_type end as action,
      case when k in (0, 1, 3) then outcome when k = 2 then 'success' end as outcome,
      (case k when 0 then {CEF_SEV} when 1 then {CEF_SEV} when 2 then 6 when 3 then 3 when 4 then 8 when 5 then 5 else least(10, sev) end)::double as severity,
      case when k in (4, 5) then null else src_ip end as src_ip, case when k in (4, 5) then null else src_port end as src_port,
      case when k in (0, 2, 3) then 'tcp' end as protocol, case when k = 3 then 'inbound' end as direction, case when k in (0, 1, 3, 6) then 'user' || user_id end as username,
      case k when 0 then event_type when 1 then event_type when 2 then '106100' end as rule_id
    from m""")
def n01_normalize(spark, sf):
    x = extract(detect.detect_format(raw(spark, sf, MIXED)), 2026, MIX_FORMATS).filter("parse_error IS NULL")
    return normalize.normalize(x, formats=MIX_FORMATS).select(
        "seq", "source.vendor", "event.category", "event.action", "event.outcome", F.col("event.severity_numeric").alias("severity"), "network.src_ip", "network.src_port", "network.protocol", "network.direction",
        "identity.username", "rule.rule_id",
    )


@q(f"""with {SEC} select seq, case when outcome = 'failure' then 'Deny' when outcome = 'success' then 'Allow' else 'Log' end as activity_name,
    case when outcome = 'failure' then 3 when outcome = 'success' then 2 end as activity_id,
    case when category = 'authentication' then 3001 when category = 'threat' then 2001 when category = 'policy' then 5001 else 4001 end as class_uid from sec""")
def n12_taxonomy(spark, sf):
    return _events(spark, sf).select("seq", "event.activity_name", "event.activity_id", "event.class_uid")


@q(f"with {SEC} select seq, 'cs1' as key, seq::varchar as value from sec")
def n14_vendor_attributes(spark, sf):
    return _events(spark, sf).select("seq", F.explode(F.map_filter("vendor_attributes", lambda k, v: k == "cs1")).alias("key", "v")).select("seq", "key", F.col("v.v").alias("value"))


BIG_PORT = SEC_LINES.replace("1024 + user_id as src_port", "1024 + user_id * 900 as src_port")


@q("select case when 1024 + user_id * 900 > 65535 then 1 else 0 end as n_errors, count(*) as n from events group by 1")
def q06_validate(spark, sf):
    e = normalize.to_ues(normalize.normalize(parse(raw(spark, sf, BIG_PORT), formats=["cef"]), formats=["cef"]))
    return validate.validate(e).groupBy(F.size("errors").alias("n_errors")).agg(F.count(F.lit(1)).alias("n"))


@q("""select 'events' as stage, count(*) as n from events where user_id % 9 < 7 union all
    select 'detection', count(*) from events where user_id % 9 >= 7""")
def u01_ingest_outcomes(spark, sf):
    good, bad = ingest(raw(spark, sf, MIXED), formats=MIX_FORMATS)
    return good.select(F.lit("events").alias("stage")).unionByName(bad.select("stage")).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


# --- enrichment ----------------------------------------------------------------------------

THREAT = "case when user_id % 6 = 1 then ['Tor exit nodes', 'Tor exit nodes (torproject.org bulk list)'] end"


@q(f"with {SEC} select distinct src_ip as ip, unnest(['Tor exit nodes (torproject.org bulk list)', 'Tor exit nodes']) as service from sec where user_id % 6 = 1")
def j01_threat_all(spark, sf):
    ips = _sec(spark, sf).select(F.col("src_ip").alias("ip"))
    m = enrich.match_cidr(ips, enrich.threat_table(spark), small=False)
    return m.select("ip", F.explode("matches").alias("m")).select("ip", "m.service")


@q(f"with {SEC} select distinct src_ip as ip, case user_id % 6 when 2 then 'Cloudflare' else 'AWS' end as service from sec where user_id % 6 in (2, 4)")
def j02_cloud_first(spark, sf):
    m = enrich.match_cidr(_sec(spark, sf), enrich.cloud_table(spark), "first", ip_col="src_ip")
    return m.select("ip", F.col("matches")[0]["service"].alias("service"))


@q(f"with {SEC} select src_ip as ip, case when user_id % 6 in (0, 5) then 'private' else 'public' end as ip_type, count(*) as n from sec group by 1, 2")
def j03_ip_class(spark, sf):
    return _sec(spark, sf).groupBy(F.col("src_ip").alias("ip"), enrich.ip_class(F.col("src_ip")).alias("ip_type")).agg(F.count(F.lit(1)).alias("n"))


@q(f"""with {SEC} select seq, case when user_id % 6 in (0, 5) then true else false end as src_internal, case when user_id % 6 = 1 then true end as threat,
    case user_id % 6 when 2 then 'Cloudflare' when 4 then 'Amazon Web Services' end as cloud, 'private' as dst_type from sec""")
def j04_enrich(spark, sf):
    e = enrich.enrich_ips(_events(spark, sf), enrich.threat_table(spark), enrich.cloud_table(spark))
    x = "enrichment."
    return e.select("seq", F.col(x + "src_ip_context.is_internal").alias("src_internal"), F.col(x + "threat_ip_detected").alias("threat"), F.col(x + "src_ip_context.cloud_provider").alias("cloud"), F.col(x + "dst_ip_context.ip_type").alias("dst_type"))


@q(f"with {LIN}, {IDS} select event_id, line as payload from uid")
def j06_event_detail(spark, sf):
    flat = written(_flat(spark, sf), "flat")
    archive = identity.raw_archive(identity.with_event_id(identity.with_raw_hash(raw(spark, sf))))
    return query.event_detail(flat, archive, flat.select("event_id")).select("event_id", "payload")


@q(f"""with {SEC}, c as (select {FORMAT_OF} as parser_name, count(*) as n from sec group by 1)
    select p.parser_name, coalesce(c.n, 0) as n_events, case when c.n > 0 then 'active' else 'idle' end as status
    from (select unnest(['cisco_asa','cef','leef','syslog_rfc5424','xml_generic','aws_cloudtrail','gcp_audit','azure_monitor','json_passthrough','paloalto_csv','syslog_rfc3164']) as parser_name) p left join c using (parser_name)""")
def j07_parser_health(spark, sf):
    d = detect.detect_format(raw(spark, sf, MIXED)).withColumnRenamed("format_id", "parser_name")
    return query.parser_health(d, spark.createDataFrame([(f,) for f in detect.FORMATS], "parser_name string"))


# --- snapshots -----------------------------------------------------------------------------

SNAPS = "select distinct case when user_id % 2 = 0 then 'a' else 'b' end as host, date_trunc('day', ts) as snap_ts, user_id as pid, event_type as name from events"


@q(f"""with s as (select distinct host, strftime(snap_ts, '%Y-%m-%d') as snap_ts, pid from ({SNAPS})), d as (select host, snap_ts, row_number() over (partition by host order by snap_ts) as n from (select distinct host, snap_ts from s)),
    r as (select s.*, d.n from s join d using (host, snap_ts))
    select a.host, a.snap_ts, a.pid, 'started' as change from r a where a.n > 1 and not exists (select 1 from r b where b.host = a.host and b.pid = a.pid and b.n = a.n - 1)
    union all select a.host, d.snap_ts, a.pid, 'stopped' from r a join d on d.host = a.host and d.n = a.n + 1 where not exists (select 1 from r b where b.host = a.host and b.pid = a.pid and b.n = a.n + 1)""")
def j11_snapshot_diff(spark, sf):
    s = view(spark, sf, SNAPS).withColumn("snap_ts", F.date_format("snap_ts", "yyyy-MM-dd"))
    return snapshots.snapshot_diff(s, ["pid"])


@q("select user_id, event_type, min(event_id) as seq from events group by 1, 2")
def j12_first_seen(spark, sf):
    return snapshots.first_seen(_sec(spark, sf), ["user_id", "event_type"], "seq").select("user_id", "event_type", "seq")


@q("select event_id as seq, case when event_type = 'view' then 'p' || user_id else 'System' end as process, case user_id % 4 when 0 then 'HTTPS' when 1 then 'SSH' else 'TCP' end as service from events")
def j09_connections(spark, sf):
    c = view(spark, sf, "select event_id as seq, event_type as host, 1 as snap_ts, user_id as pid, case user_id % 4 when 0 then 443 else 4000 end as dst_port, case user_id % 4 when 1 then 22 else 50000 end as src_port, 'tcp' as proto from events")
    p = c.filter("host = 'view'").select("host", "snap_ts", "pid", F.concat(F.lit("p"), "pid").alias("name")).distinct()
    return snapshots.label_services(snapshots.resolve_processes(c, p)).select("seq", "process", "service")


# --- filters, sorts, pages -----------------------------------------------------------------


@q(f"with {LIN}, {IDS} select event_id from uid where tenant_id = 'tenant_beta' and category = 'threat' and outcome = 'failure' and {CEF_SEV} >= 2")
def q01_filter(spark, sf):
    return query.filter_events(_flat(spark, sf), severity_min=2, tenant_id="tenant_beta", category="threat", outcome="failure").select("event_id")


@q(f"with {LIN}, {IDS} select event_id from uid where lower(line) like '%user1%' or src_port::varchar like '%user1%'")
def q02_search(spark, sf):
    return query.search_events(_flat(spark, sf), "USER1").select("event_id")


@q(f"with {LIN}, {IDS} select event_id, ts::varchar as t from (select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as ts, sev, bytes_in from uid) order by t desc, event_id limit 20 offset 20")
def t02_page(spark, sf):
    rows, _, _ = query.page(query.sort_events(written(_flat(spark, sf), "flat").withColumn("ingest_timestamp", F.date_format("ingest_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")), "ingest_timestamp"), 2, 20)
    return rows.select("event_id", F.col("ingest_timestamp").alias("t"))


@q(f"with {SEC} select tenant_id, src_ip, count(*) as fired, max(chain)::int as longest from (select tenant_id, src_ip, seq, category, outcome, case when category = 'authentication' and outcome = 'failure' then sum((category = 'authentication' and outcome = 'failure')::int) over (partition by src_ip, i order by seq) else 0 end as chain from (select *, sum((category = 'authentication' and outcome = 'success')::int) over (partition by src_ip order by seq) as i from sec)) where chain >= 5 group by 1, 2 order by longest desc, src_ip limit 50")
def t04_top_auth_chains(spark, sf):
    """Which addresses show chains of failed logins, by tenant? From the raw lines on."""
    e = parse(raw(spark, sf), formats=["cef"])
    f = lambda k: F.try_element_at(F.col("extracted"), F.lit(k))["v"]
    rows = e.select("tenant_id", "seq", f("src").alias("src_ip"), f("Name").alias("category"), normalize.outcome_of(f("act")).alias("outcome"))
    chains = W.auth_failure_chain(rows).filter("chain_fires")
    return chains.groupBy("tenant_id", "src_ip").agg(F.count(F.lit(1)).alias("fired"), F.max("chain").cast("int").alias("longest")).orderBy(F.desc("longest"), "src_ip").limit(50)


# --- aggregates ----------------------------------------------------------------------------


def _base(spark, sf):
    return _sec(spark, sf).withColumn("vendor", F.when(F.col("user_id") % 5 > 0, F.concat(F.lit("v"), F.col("user_id") % 5))).withColumn("action", F.col("event_type")).withColumn("severity_numeric", F.col("sev").cast("double"))


@q(f"""with {SEC}, b as (select *, coalesce(case when user_id % 5 > 0 then 'v' || (user_id % 5) end, 'Unknown') as vendor, case when sev < 4 then 'low' when sev < 7 then 'medium' else 'high' end as severity,
      ts >= (select max(ts) from events) - interval 1 hour as h, ts >= (select max(ts) from events) - interval 24 hour as d from sec)
    select 'category' as section, category as key, count(*)::bigint as n from b group by 2 union all select 'vendor', vendor, count(*) from b group by 2 union all select 'outcome', outcome, count(*) from b group by 2
    union all select 'action', event_type, count(*) from b group by 2 union all select 'severity', severity, count(*) from b group by 2 union all select 'total', 'all', count(*) from b
    union all select 'velocity', 'last_hour', sum(h::int)::bigint from b union all select 'velocity', 'last_day', sum(d::int)::bigint from b union all select 'dead_letter', 'all', count(*) from b where user_id % 10 = 0""")
def a08_event_stats(spark, sf):
    b = _base(spark, sf)
    now = b.agg(F.max("ingest_ts").cast("string")).first()[0]
    return stats.event_stats(b, b.filter("user_id % 10 = 0"), now=now)


@q(f"with {SEC} select category, count(*) as n from sec group by 1")
def a02_by_category(spark, sf):
    return stats.count_by(_base(spark, sf), "category")


@q(f"with {SEC} select count_if(sev < 4) ::bigint as low, count_if(sev >= 4 and sev < 7)::bigint as medium, count_if(sev >= 7)::bigint as high from sec")
def a05_severity_bands(spark, sf):
    return stats.severity_bands(_base(spark, sf))


@q("select count_if(user_id % 10 > 0)::bigint as n_valid, count_if(user_id % 10 = 0)::bigint as n_dead, round(100 * count_if(user_id % 10 > 0) / count(*), 1) as valid_rate from events")
def a07_valid_rate(spark, sf):
    b = _base(spark, sf)
    return stats.valid_rate(b.filter("user_id % 10 > 0"), b.filter("user_id % 10 = 0"))


TEL = f"""{SEC}, t as (select {FORMAT_OF} as source_id, user_id % 9 < 7 as ok, seq from sec), g as (select source_id, count(*) as received, count_if(ok)::bigint as valid, count_if(not ok)::bigint as dead_lettered from t group by 1)"""


def _telemetry(spark, sf):
    d = detect.detect_format(raw(spark, sf, MIXED)).withColumn("t", S.iso(F.col("ingest_ts")))
    ok = F.col("format_id").isin(MIX_FORMATS)
    e = d.filter(ok).select(F.col("format_id").alias("parser_name"), F.col("t").alias("ingest_timestamp"))
    return stats.source_telemetry(e, d.filter(~ok).select(F.col("format_id").alias("parser"), F.col("t").alias("timestamp"), F.lit("no parser").alias("error_message")))


@q(f"with {TEL} select *, case when dead_lettered = 0 then 'healthy' when valid > 0 then 'degraded' else 'failing' end as health from g")
def a10_source_telemetry(spark, sf):
    return _telemetry(spark, sf).select("source_id", "received", "valid", "dead_lettered", "health")


@q(f"with {TEL} select count(*) as n_sources, count_if(valid > 0)::bigint as n_active, sum(received)::bigint as received, sum(valid)::bigint as valid, sum(dead_lettered)::bigint as dead_lettered, round(100 * sum(valid) / sum(received), 1) as valid_pct, round(100 * sum(dead_lettered) / sum(received), 1) as dead_pct from g")
def a11_pipeline_metrics(spark, sf):
    return stats.pipeline_metrics(_telemetry(spark, sf))


@q(f"with {SEC} select category, count(*) as n, round(count(*) / (select count(*) from sec), 6) as share from sec group by 1")
def a13_category_share(spark, sf):
    return stats.category_share(_sec(spark, sf)).select("category", "n", F.round("share", 6).alias("share"))


@q(f"with {SEC}, r as (select *, row_number() over (partition by src_ip order by seq desc) as k from sec) select src_ip, count(*) as n, round(avg(sev), 6) as mean, round(stddev_pop(sev), 6) as std from r where k <= 50 group by 1")
def a14_rolling_stats(spark, sf):
    return W.rolling_stats(_sec(spark, sf), "src_ip", "sev", ["seq"], 50).select("src_ip", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@q(f"with {SEC}, l as (select src_ip, list_sort(list(bytes_in)) as v from sec group by 1) select src_ip, len(v)::bigint as n, v[len(v) // 4 + 1] as q1, v[3 * len(v) // 4 + 1] as q3 from l")
def a15_index_quartiles(spark, sf):
    return W.index_quartiles(_sec(spark, sf), "src_ip", "bytes_in")


@q(f"with {MIX} select 'edge' as source_tag, {FORMAT_OF} as format_id, count(*) as n, sum(strlen(line))::bigint as n_bytes from mix group by 1, 2")
def a17_volume(spark, sf):
    return stats.volume_profile(detect.detect_format(raw(spark, sf, MIXED)))


# --- analytics -----------------------------------------------------------------------------

BASE = """last as (select *, row_number() over (partition by src_ip order by seq desc) as k from sec), sevs as (select src_ip, count(*) as n, avg(sev) as mean, stddev_pop(sev) as std from last where k <= 50 group by 1),
    pool as (select src_ip, bytes_in::double as b, row_number() over (partition by src_ip order by seq desc) as k from sec where bytes_in > 0), vals as (select src_ip, list_sort(list(b)) as v from pool where k <= 50 group by 1),
    iqr as (select src_ip, v[len(v) // 4 + 1] as q1, v[3 * len(v) // 4 + 1] as q3, len(v) as n from vals),
    z as (select sec.*, case when n < 5 then 0.0 when std > 0 then abs(sev - mean) / std when abs(sev - mean) > 1e-4 then 10.0 else 0.0 end as z from sec join sevs using (src_ip)),
    o as (select z.*, coalesce(bytes_in > 0 and iqr.n >= 10 and (bytes_in < q1 - 1.5 * (q3 - q1) or bytes_in > q3 + 1.5 * (q3 - q1)), false) as outlier from z left join iqr using (src_ip))"""
BURST = """bu as (select *, floor(epoch(ts))::bigint as u from o), bw as (select *, count(*) over (partition by src_ip order by u range between 86400 preceding and current row) as near,
      count(*) over r as n, u - min(u) over r as span from bu window r as (partition by src_ip order by u, seq rows 499 preceding)),
    b2 as (select *, n >= 15 and span >= 10 and near >= 3 and near / 86400 > 3 * n / greatest(span, 1) as is_burst from bw)"""
BURST_ARGS = {"window_seconds": 86_400, "min_recent": 3}


def _baseline(spark, sf):
    return W.build_baseline(_sec(spark, sf), 50)


@q(f"with {SEC}, {BASE} select src_ip, n::bigint as sev_n, round(mean, 6) as sev_mean, round(std, 6) as sev_std, coalesce((select len(v) from vals where vals.src_ip = sevs.src_ip), -1)::int as n_bytes from sevs")
def w01_baseline(spark, sf):
    return _baseline(spark, sf).select("src_ip", "sev_n", F.round("sev_mean", 6).alias("sev_mean"), F.round("sev_std", 6).alias("sev_std"), F.coalesce(F.size("bytes_values"), F.lit(-1)).alias("n_bytes"))


@q(f"with {SEC} select seq, count(sev) over w as sev_n, round(avg(sev) over w, 6) as sev_mean, round(stddev_pop(sev) over w, 6) as sev_std from sec window w as (partition by src_ip order by seq rows between 20 preceding and 1 preceding)")
def w01_online_baseline(spark, sf):
    return W.online_baseline(_sec(spark, sf), 20).select("seq", "sev_n", F.round("sev_mean", 6).alias("sev_mean"), F.round("sev_std", 6).alias("sev_std"))


@q(f"with {SEC}, {BASE} select seq, round(z, 6) as z, outlier from o")
def w03_z_and_bytes(spark, sf):
    b = _baseline(spark, sf)
    return W.bytes_outlier(W.severity_z(_sec(spark, sf), b), b).select("seq", F.round("z", 6).alias("z"), F.col("bytes_outlier").alias("outlier"))


@q(f"with {SEC}, {BASE}, {BURST} select seq, is_burst from b2")
def w05_burst(spark, sf):
    return W.burst(_sec(spark, sf), **BURST_ARGS).select("seq", "is_burst")


@q(f"with {SEC}, {BASE}, {BURST} select seq, is_burst from b2")
def w05_burst_split(spark, sf):
    """The same where all addresses of over fifty rows count as hot: ranks and range counts."""
    return W.burst(_sec(spark, sf), **BURST_ARGS, hot=50).select("seq", "is_burst")


@q(f"with {SEC} select seq, count(sev) over w as sev_n, round(avg(sev) over w, 6) as sev_mean, round(stddev_pop(sev) over w, 6) as sev_std from sec window w as (partition by src_ip order by seq rows between 20 preceding and 1 preceding)")
def w01_online_baseline_split(spark, sf):
    return W.online_baseline(_sec(spark, sf), 20, hot=50).select("seq", "sev_n", F.round("sev_mean", 6).alias("sev_mean"), F.round("sev_std", 6).alias("sev_std"))


@q(f"with {SEC} select seq, category = 'database' as is_rare from sec")
def w06_rare(spark, sf):
    d = _sec(spark, sf)
    return W.rare_category(d, stats.category_share(d)).select("seq", "is_rare")


CHAIN = """ci as (select *, sum((category = 'authentication' and outcome = 'success')::int) over (partition by src_ip order by seq) as i from {t}),
    cc as (select *, case when category = 'authentication' and outcome = 'failure' then sum((category = 'authentication' and outcome = 'failure')::int) over (partition by src_ip, i order by seq) else 0 end as chain from ci)"""


@q(f"with {SEC}, {CHAIN.format(t='sec')} select seq, chain::int as chain from cc")
def w07_auth_chain(spark, sf):
    return W.auth_failure_chain(_sec(spark, sf)).select("seq", F.col("chain").cast("int").alias("chain"))


@q(f"""with {SEC}, {BASE}, {BURST}, {CHAIN.format(t='b2')},
    s as (select *, least(1.0, round((case when z >= 3 then 0.35 when z >= 2 then 0.20 else 0.0 end)::double + (case when outlier then 0.25 else 0 end)::double + (case when is_burst then 0.30 else 0 end)::double
      + (case when category = 'database' then 0.15 else 0 end)::double + (case when user_id % 6 = 1 then 0.40 else 0 end)::double + (case when chain >= 5 then 0.30 else 0 end)::double, 3)) as score from cc)
    select seq, score as anomaly_score, score >= 0.5 as is_anomalous, ((z >= 2)::int + outlier::int + is_burst::int + (category = 'database')::int + (user_id % 6 = 1)::int + (chain >= 5)::int)::int as n_reasons from s where score >= 0.15""")
def w08_score(spark, sf):
    d = _sec(spark, sf).withColumn("threat_ip_detected", F.col("user_id") % 6 == 1)
    found, _ = W.analyze(d, 50, BURST_ARGS)
    return found.select("seq", "anomaly_score", "is_anomalous", F.size("anomaly_reasons").alias("n_reasons"))


# --- features, crosswalks, sinks -----------------------------------------------------------


@q(f"""with {SEC} select seq, round(sin(2 * pi() * hour(ts) / 24), 6) as hour_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) as dow_cos, round(({CEF_SEV}) / 10, 6) as severity_norm,
    round(least(1, log10(1 + bytes_in) / 9), 6) as log_bytes_in, 1.0::double as port_well_known, (outcome = 'failure')::int::double as outcome_failure from sec""")
def e05_features(spark, sf):
    e = _events(spark, sf).withColumn("source_event_timestamp", F.col("ingest_timestamp"))
    c = features.feature_columns(e)
    names = ["hour_sin", "dow_cos", "severity_norm", "log_bytes_in", "port_well_known", "outcome_failure"]
    return e.select("seq", *[F.round(c[k], 6).alias(k) for k in names])


CAT = "case when category in ('authentication', 'threat', 'policy') then category else 'network' end"


@q(f"""with {SEC} select seq, case when {CAT} = 'authentication' then 3001 when {CAT} = 'threat' then 2001 when {CAT} = 'policy' then 5001 else 4001 end as class_uid,
    case when s >= 9 then 'Critical' when s >= 7 then 'High' when s >= 5 then 'Medium' when s >= 3 then 'Low' else 'Informational' end as severity, case outcome when 'success' then 1 when 'failure' then 2 else 0 end as status_id,
    src_ip, 'tcp' as protocol, bytes_in, 'user' || user_id as username, event_type as policy_uid from (select *, {CEF_SEV} as s from sec)""")
def x01_ocsf(spark, sf):
    e = _events(spark, sf)
    return crosswalk.to_ocsf(e.withColumn("tenant_id", F.col("seq").cast("string"))).select(
        F.col("metadata.tenant_uid").cast("bigint").alias("seq"), "class_uid", "severity", "status_id", F.col("src_endpoint.ip").alias("src_ip"), F.col("connection_info.protocol_name").alias("protocol"),
        "traffic.bytes_in", F.col("user.name").alias("username"), F.col("policy.uid").alias("policy_uid"),
    )


@q(f"with {SEC} select seq, ({CEF_SEV}) * 10 as severity, outcome, src_ip, nullif(bytes_in, 0) as n_bytes, seq::varchar as vendor_cs1 from sec")
def x02_ecs(spark, sf):
    e = crosswalk.to_ecs(_events(spark, sf).withColumn("tenant_id", F.col("seq").cast("string")))
    return e.select(F.col("labels")["tenant_id"].cast("bigint").alias("seq"), "event.severity", "event.outcome", F.col("source.ip").alias("src_ip"), F.col("network.bytes").alias("n_bytes"), F.col("labels")["vendor_cs1"].alias("vendor_cs1"))


@q(f"with {LIN}, {IDS} select event_id, tenant_id, raw_hash, 'Acme' as vendor, src_ip, src_port, bytes_in, 'user' || user_id as username, 'cef' as parser_name, {CAT} as category from uid")
def k02_flatten(spark, sf):
    return _flat(spark, sf).select("event_id", "tenant_id", "raw_hash", "vendor", "src_ip", "src_port", "bytes_in", "username", "parser_name", "category")


@q(f"""with {LIN}, {IDS} select event_id, 'CEF:0|Acme|Edge|1.2.0|' || event_type || '|' || case outcome when 'failure' then 'Deny' when 'success' then 'Allow' else 'Log' end || '|' || ({CEF_SEV}) || '|src=' || src_ip || ' spt=' || src_port
    || ' dst=10.0.0.1 dpt=443 proto=tcp in=' || bytes_in || ' suser=user' || user_id || ' act=' || case outcome when 'failure' then 'deny' when 'success' then 'allow' else 'log' end || ' externalId=' || event_id as line from uid""")
def k05_cef(spark, sf):
    return sinks.to_cef(_events(spark, sf))


@q(f"""with {LIN}, {IDS} select event_id, 'LEEF:2.0|Acme|Edge|1.2.0|' || event_type || '|x09|src=' || src_ip || chr(9) || 'spt=' || src_port || chr(9) || 'dst=10.0.0.1' || chr(9) || 'dpt=443' || chr(9) || 'proto=tcp' || chr(9) || 'usrName=user' || user_id
    || chr(9) || 'sev=' || ({CEF_SEV}) || chr(9) || 'action=' || case outcome when 'failure' then 'deny' when 'success' then 'allow' else 'log' end || chr(9) || 'outcome=' || outcome as line from uid""")
def k06_leef(spark, sf):
    return sinks.to_leef(_events(spark, sf))


@q(f"with {LIN}, {IDS} select event_id, src_ip from uid where outcome = 'failure' order by ts desc, event_id limit 100")
def k09_export(spark, sf):
    return sinks.export_rows(_flat(spark, sf), 100, outcome="failure").select("event_id", "src_ip")
