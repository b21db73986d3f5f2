"""Registered queries over scans, sinks, cloud and XML formats, declared sources, the query
surface and streams: most of them write what they read back."""

from __future__ import annotations

import pathlib
import tempfile

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from loglake.functions import scalars as S
from loglake.operators import analytics as W
from loglake.operators import crosswalk, declarative, detect, enrich, framing, identity, normalize, query, sinks, stats
from loglake.operators.features import features
from loglake.operators.ordered import held, written
from loglake.operators.extract import AZURE_CATEGORY, AZURE_OUTCOME, AZURE_VERBS, GCP_FAILED, GCP_METHODS, GCP_SEVERITY, WINDOWS_EVENTS, event_dim, extract, extract_generic_xml, join_event_dim
from loglake.plans.ingest import ingest
from loglake.plans.queries import BLANKS, CEF_SEV, IDS, LIN, MIX, MIX_FORMATS, SEC, _events, _flat, _sec, _telemetry, q
from loglake.plans.streams import _finished, _folder, _sec_stream, _sliced_stream
from loglake.plans.tables import MIXED, SEC_EVENTS, raw, view
from loglake.schema import CATEGORIES, OUTCOMES
from loglake.sources import readers
from loglake.streaming import jobs

TENANT = "tenant_beta"
_CAT = "case when category in ('authentication', 'threat', 'policy') then category else 'network' end"

# --- scans and sinks -----------------------------------------------------------------------


@q(f"with {LIN} select line, strlen(line)::bigint as n_bytes, 'acme' as tenant_id from lin")
def s01_read_raw(spark, sf):
    """Lines to files of two kinds in nested folders, and back; other extensions are left out."""
    top = _folder(spark, "raw")
    lines = raw(spark, sf).select("line", (F.col("seq") % 3).alias("part"))
    lines.write.partitionBy("part").text(f"{top}/a/b", compression="none")
    lines.select("line").write.option("compression", "gzip").text(f"{top}/other")
    r = readers.read_raw(spark, top, recursive=True, extensions=["txt"], tenant_id="acme", ingest_ts="2026-01-01 00:00:00")
    return r.select("line", F.octet_length("raw_bytes").cast("long").alias("n_bytes"), "tenant_id")


@q(f"with {LIN}, {IDS} select event_id, src_ip, 'user' || user_id as username, ({CEF_SEV})::double as severity from uid")
def s02_read_events(spark, sf):
    """Events as NDJSON, with a broken line beside them, and back (K-01, S-02)."""
    path = _folder(spark, "events")
    sinks.write_ndjson(_events(spark, sf).drop("ingest_ts", "seq"), path)
    spark.range(1).select(F.lit('{"broken').alias("value")).write.mode("append").text(path)
    e = readers.read_events(spark, path).filter("event_id IS NOT NULL")
    return e.select("event_id", "network.src_ip", "identity.username", F.col("event.severity_numeric").alias("severity"))


def _dead(spark, sf):
    return ingest(raw(spark, sf, MIXED), formats=MIX_FORMATS)[1]


@q(f"with {MIX} select 'detection' as stage, line as raw_payload, tenant_id from mix where user_id % 9 >= 7")
def s03_dead_letters(spark, sf):
    """What no format takes, written by stage and read back (K-07, S-03)."""
    path = _folder(spark, "dead")
    sinks.write_dead_letter(_dead(spark, sf), path)
    return readers.read_dead_letter(spark, path).select("stage", "raw_payload", "tenant_id")


@q(f"with {LIN}, {IDS} select event_id, strftime(ts, '%Y-%m-%d') as dt, src_ip from uid where tenant_id = '{TENANT}' and strftime(ts, '%Y-%m-%d') between (select strftime(min(ts), '%Y-%m-%d') from events) and (select strftime(min(ts) + interval 12 hour, '%Y-%m-%d') from events)")
def s04_lake(spark, sf):
    """The partitioned lake, of which a tenant's days are read (K-02, S-04)."""
    path = _folder(spark, "lake")
    sinks.write_lake(_events(spark, sf), path)
    first = view(spark, sf, "select cast(min(ts) as string) as a, cast(min(ts) + interval 12 hours as string) as z from events").first()
    return readers.read_lake(spark, path, TENANT, first["a"][:10], first["z"][:10]).select("event_id", F.col("dt").cast("string").alias("dt"), "src_ip")


BODIES = "select conv_id * 1000 + turn as seq, unnest(string_split(text, chr(10))) as line from conversations"


@q(f"select seq, regexp_replace(line, '\\r+$', '') as line from ({BODIES}) where trim(regexp_replace(line, '\\r+$', '')) <> ''")
def s05_bodies(spark, sf):
    c = view(spark, sf, "select conv_id * 1000 + turn as seq, text from conversations", "conversations")
    return readers.raw_from_lines(c, "batch", body_col="text", seq_col="seq").select("seq", "line")


@q(f"with {LIN} select line from lin")
def s06_stream_raw(spark, sf):
    """Files of a folder as a stream, two at most in a batch (S-06, M-08)."""
    path = _folder(spark, "tail")
    raw(spark, sf).select("line").repartition(5).write.text(path)
    return _finished(readers.stream_raw(spark, path, max_files=2), "raw").select("line")


@q(f"with {LIN}, {IDS} select event_id as key, seq, src_ip from uid")
def k03_kafka_rows(spark, sf):
    rows = sinks.to_kafka_rows(_events(spark, sf).select("event_id", "seq", "network"))
    v = F.from_json("value", "seq long, network struct<src_ip: string>")
    return rows.select("key", v["seq"].alias("seq"), v["network"]["src_ip"].alias("src_ip"))


@q(f"with {LIN}, {IDS} select 'loglake.events' as topic, event_id as key, seq from uid")
def k04_kafka_envelope(spark, sf):
    path = _folder(spark, "envelope")
    sinks.write_kafka_envelope(_events(spark, sf).select("event_id", "seq"), path)
    return spark.read.schema("topic string, key string, value struct<seq: long>").json(path).select("topic", "key", "value.seq")


@q(f"with {LIN}, {IDS} select event_id, 'written' as outcome, null as failed_sink from uid union all select event_id, 'sink', 'broken' from uid")
def k08_fan_out(spark, sf):
    """Two sinks, of which one fails: the other has all rows, and dead letters tell the cause."""
    path = _folder(spark, "fan")

    def broken(df):
        raise ValueError("no room")

    failed, dead = sinks.fan_out(written(_events(spark, sf), "events"), {"broken": broken, "files": lambda d: sinks.write_ndjson(d.select("event_id"), path)}, kept=True)
    assert list(failed) == ["broken"]
    good = spark.read.schema("event_id string").json(path).select("event_id", F.lit("written").alias("outcome"), F.lit(None).cast("string").alias("failed_sink"))
    return good.unionByName(dead.select("event_id", F.col("stage").alias("outcome"), "failed_sink"))


@q(f"""with {LIN}, {IDS} select '1.2.0' as schema_version, tenant_id, event_id, line as raw_payload, 'cef' as raw_format, raw_hash, 'Acme' as vendor, 'Edge' as product, {_CAT} as category, outcome,
    ({CEF_SEV})::double as severity_numeric, src_ip, src_port, '10.0.0.1' as dst_ip, 443 as dst_port, 'tcp' as protocol, bytes_in, 'user' || user_id as username, null as user_domain, null::double as anomaly_score, false as is_anomalous, 'cef' as parser_name,
    strftime(ts, '%Y-%m-%d') as dt from uid""")
def k02_lake_columns(spark, sf):
    """The columns of the lake's flat table that lines of CEF have, written and read (K-02)."""
    path = _folder(spark, "flat")
    sinks.write_lake(_events(spark, sf), path)
    cols = ["schema_version", "tenant_id", "event_id", "raw_payload", "raw_format", "raw_hash", "vendor", "product", "category", "outcome", "severity_numeric", "src_ip", "dst_ip", "protocol", "bytes_in", "username", "user_domain", "anomaly_score", "is_anomalous", "parser_name"]
    return readers.read_lake(spark, path).select(*cols, F.col("src_port").cast("int").alias("src_port"), F.col("dst_port").cast("int").alias("dst_port"), F.col("dt").cast("string").alias("dt"))


@q("select event_id as seq, event_type from events")
def i08_rebuild(spark, sf):
    """The query table, written twice from the source: the second time replaces the first."""
    path, e = _folder(spark, "table"), view(spark, sf, "select event_id as seq, event_type from events")
    identity.rebuild(spark, e.filter("seq % 2 = 0"), path)
    return identity.rebuild(spark, e, path)


# --- framing -------------------------------------------------------------------------------


@q(f"select conv_id, turn, trim(x, {BLANKS}) as line from (select conv_id, turn, unnest(string_split(text, '. ')) as x from conversations) where trim(x, {BLANKS}) <> ''")
def r06_frame_source(spark, sf):
    c = view(spark, sf, "select conv_id, turn, text as line from conversations", "conversations")
    return framing.frame_source(c, {"framing": {"type": "delimiter", "delimiter": ". "}}).select("conv_id", "turn", "line")


@q("""select conv_id, turn, strlen(l) > 200 as quarantined, strlen(l)::bigint as n_bytes from
    (select conv_id, turn, unnest(string_split(text, chr(10))) as l from conversations) where trim(l) <> ''""")
def r07_quarantine(spark, sf):
    """Lines above the bound go to the other output, with all their bytes."""
    c = view(spark, sf, "select conv_id, turn, explode(split(text, '\\n')) as line from conversations", "conversations").withColumn("raw_bytes", F.col("line").cast("binary"))
    good, bad = framing.split_oversized(framing.frame_lines(c, 200))
    rows = good.select("conv_id", "turn", F.lit(False).alias("quarantined"), "raw_bytes").unionByName(bad.select("conv_id", "turn", F.lit(True).alias("quarantined"), "raw_bytes"))
    return rows.select("conv_id", "turn", "quarantined", F.octet_length("raw_bytes").cast("long").alias("n_bytes"))


# --- cloud JSON and XML --------------------------------------------------------------------

_V = "cast({} as varchar(20))"
_U, _N, _P = _V.format("user_id"), _V.format("seq"), _V.format("src_port")
CLOUD = f"""select *, case user_id % 5
      when 0 then concat('{{"eventVersion":"1.08","eventSource":"iam.amazonaws.com","eventName":"', case when outcome = 'failure' then 'DeleteUser' else 'ListUsers' end, '","eventTime":"2026-01-01T00:00:00Z","awsRegion":"eu-1","sourceIPAddress":"', src_ip, '","userIdentity":{{"userName":"user', {_U}, '","accountId":"', {_N}, '"}}}}')
      when 1 then concat('{{"time":"2026-01-01T00:00:00.1234567Z","resourceId":"/subscriptions/s', {_U}, '/resourceGroups/g1/providers/p/t/n', {_N}, '","operationName":"vm/delete","resultType":"', case when outcome = 'failure' then 'Failed' else 'Success' end, '","category":"Security","callerIpAddress":"', src_ip, ':55","properties":{{"code":"', {_N}, '"}}}}')
      when 2 then concat('{{"logName":"projects/p1/logs/a%2Factivity","severity":"NOTICE","insertId":"', {_N}, '","timestamp":"2026-01-01T00:00:00Z","protoPayload":{{"@type":"type.googleapis.com/google.cloud.audit.AuditLog","methodName":"iam.roles.get","status":{{"code":', case when outcome = 'failure' then '7' else '0' end, '}},"authenticationInfo":{{"principalEmail":"user', {_U}, '@x.org"}},"requestMetadata":{{"callerIp":"', src_ip, '"}}}}}}')
      when 3 then concat('<Event xmlns="http://x"><System><EventID>', case when outcome = 'failure' then '4625' else '4688' end, '</EventID><Level>4</Level><Computer>pc', {_U}, '</Computer></System><EventData><Data Name="NewProcessName">C:', chr(92), 'dir', chr(92), 'tool', {_U}, '.exe</Data><Data Name="IpAddress">', src_ip, '</Data></EventData></Event>')
      else concat('<log><host>h', {_U}, '</host><msg n="', {_N}, '">text</msg></log>') end as line
    from ({SEC_EVENTS}) s"""
CLO = f"clo as ({CLOUD})"
CLOUD_FORMATS = ["aws_cloudtrail", "azure_monitor", "gcp_audit", "xml_generic"]


def _cloud(spark, sf):
    x = extract(detect.detect_format(raw(spark, sf, CLOUD)), 2026, CLOUD_FORMATS)
    return x, lambda *ks: F.coalesce(*[F.try_element_at(F.col("extracted"), F.lit(k))["v"] for k in ks])


@q(f"with {CLO} select seq, case user_id % 5 when 0 then 'aws_cloudtrail' when 1 then 'azure_monitor' when 2 then 'gcp_audit' else 'xml_generic' end as format_id from clo")
def d03_json_family(spark, sf):
    return detect.detect_format(raw(spark, sf, CLOUD)).select("seq", "format_id")


@q(f"""with {CLO} select seq, 'IAM' as product, case when outcome = 'failure' then 'DeleteUser' else 'ListUsers' end as event_name, 'success' as outcome, 'user' || user_id as username, src_ip,
    seq::varchar as account from clo where user_id % 5 = 0""")
def p07_cloudtrail(spark, sf):
    x, f = _cloud(spark, sf)
    x = x.filter("format_id = 'aws_cloudtrail'")
    return x.select("seq", f("product").alias("product"), f("event_name").alias("event_name"), f("outcome").alias("outcome"), f("username").alias("username"), f("src_ip").alias("src_ip"), f("account_id", "aws_account_id", "user_account").alias("account"))


@q(f"""with {CLO} select seq, 'threat' as category, case when outcome = 'failure' then 'failure' else 'success' end as outcome, 's' || user_id as subscription, 'g1' as resource_group, 'n' || seq as resource, src_ip, seq::varchar as code from clo where user_id % 5 = 1""")
def p08_azure(spark, sf):
    x, f = _cloud(spark, sf)
    x = x.filter("format_id = 'azure_monitor'")
    return x.select("seq", f("category").alias("category"), f("outcome").alias("outcome"), f("subscription_id").alias("subscription"), f("resource_group").alias("resource_group"), f("resource_name").alias("resource"), f("src_ip").alias("src_ip"), f("properties.code").alias("code"))


@q(f"""with {CLO} select seq, 'authentication' as category, case when outcome = 'failure' then 'failure' else 'success' end as outcome, 'p1' as project_id, 'activity' as log_type, src_ip from clo where user_id % 5 = 2""")
def p09_gcp(spark, sf):
    x, f = _cloud(spark, sf)
    x = x.filter("format_id = 'gcp_audit'")
    return x.select("seq", f("category").alias("category"), f("outcome").alias("outcome"), f("project_id").alias("project_id"), f("log_type").alias("log_type"), f("src_ip").alias("src_ip"))


@q(f"""with {CLO} select seq, case when outcome = 'failure' then '4625' else '4688' end as event_id, 'tool' || user_id || '.exe' as process, 'pc' || user_id as hostname, src_ip from clo where user_id % 5 = 3""")
def p10_windows_xml(spark, sf):
    x, f = _cloud(spark, sf)
    x = x.filter("format_id = 'xml_generic' AND line LIKE '<Event%'")
    return x.select("seq", f("windows_event_id").alias("event_id"), f("process_name").alias("process"), f("hostname").alias("hostname"), f("src_ip").alias("src_ip"))


_IDS = [e[0] for e in WINDOWS_EVENTS] + [1, 99999]
#: One event of the table after the other, and two that are not in it.
WINDOWS = f"""select *, concat('<Event xmlns="http://x"><System><EventID>', cast(num as varchar(20)), '</EventID><Level>', cast(seq % 5 + 1 as varchar(20)), '</Level><Computer>pc', {_U}, '</Computer></System><EventData><Data Name="IpAddress">', src_ip, '</Data></EventData></Event>') as line
    from (select *, case seq % {len(_IDS)} {" ".join(f"when {i} then {n}" for i, n in enumerate(_IDS))} end as num from ({SEC_EVENTS}) s) t"""
_DIM = ", ".join("({}, '{}', {}, '{}')".format(e[0], e[1], e[2], e[3]) for e in WINDOWS_EVENTS)


@q(f"""with w as ({WINDOWS}), d(num, category, severity, action) as (values {_DIM})
    select seq, w.num::varchar as event_id, d.category, d.action, 'pc' || user_id as hostname, src_ip from w join d on d.num = w.num""")
def p10_windows_events(spark, sf):
    """All events of the table by their number: category and action (P-10)."""
    x = extract(detect.detect_format(raw(spark, sf, WINDOWS)), 2026, ["xml_generic"])
    f = lambda *ks: F.coalesce(*[F.try_element_at(F.col("extracted"), F.lit(k))["v"] for k in ks])
    known = F.col("_n").isin([e[0] for e in WINDOWS_EVENTS])
    x = x.withColumn("_n", f("windows_event_id").cast("int")).filter(known)
    return x.select("seq", f("windows_event_id").alias("event_id"), f("category").alias("category"), f("action").alias("action"), f("hostname").alias("hostname"), f("src_ip").alias("src_ip"))


_AZ = list(AZURE_CATEGORY.items())
_RES = list(AZURE_OUTCOME.items())
_VERBS = [*AZURE_VERBS, "restart"]
_pick = lambda by, items: "case {} {} end".format(by, " ".join(f"when {i} then '{x}'" for i, x in enumerate(items)))
AZURE = f"""select *, concat('{{"time":"2026-01-01T00:00:00.1234567Z","resourceId":"/subscriptions/s1/resourceGroups/g1/providers/p/t/n1","operationName":"vm/', verb, '","resultType":"', result, '","category":"', az, '","callerIpAddress":"', src_ip, ':55","correlationId":"c', {_N}, '"}}') as line
    from (select *, {_pick(f"seq % {len(_AZ)}", [k for k, _ in _AZ])} as az, {_pick(f"user_id % {len(_RES)}", [k for k, _ in _RES])} as result, {_pick(f"(seq + user_id) % {len(_VERBS)}", _VERBS)} as verb from ({SEC_EVENTS}) s) t"""


@q(f"""with a as ({AZURE}) select seq, 'azure_monitor' as format_id, case az {" ".join(f"when '{k}' then '{v}'" for k, v in _AZ)} end as category, case result {" ".join(f"when '{k}' then '{v}'" for k, v in _RES)} end as outcome,
    (case when lower(result) in ('failed', 'failure') then 7 else case verb {" ".join(f"when '{k}' then {v}" for k, v in AZURE_VERBS.items())} else 4 end end)::varchar as severity, verb as action, 'Azure vm/' || verb || ' [' || result || ']' as message, 'c' || seq as correlation, src_ip from a""")
def p08_azure_tables(spark, sf):
    """All categories, results and verbs of the tables (P-08)."""
    x = extract(detect.detect_format(raw(spark, sf, AZURE)), 2026, ["azure_monitor"])
    f = lambda k: F.try_element_at(F.col("extracted"), F.lit(k))["v"]
    return x.select("seq", "format_id", f("category").alias("category"), f("outcome").alias("outcome"), f("severity_numeric").alias("severity"), f("action").alias("action"), f("message").alias("message"), f("correlation_id").alias("correlation"), f("src_ip").alias("src_ip"))


_METHODS = [*[(m + "thing.get", c) for m, c in GCP_METHODS.items()], ("x.login.do", "authentication"), ("other.get", "network")]
_CODES = [0, 2, 4, *GCP_FAILED]
_SEVS = list(GCP_SEVERITY.items())
GCP = f"""select *, concat('{{"logName":"projects/p1/logs/a%2Factivity","severity":"', sv, '","insertId":"', {_N}, '","timestamp":"2026-01-01T00:00:00Z","protoPayload":{{"@type":"type.googleapis.com/google.cloud.audit.AuditLog","methodName":"', method, '","status":{{"code":', cast(code as varchar(20)), '}},"authenticationInfo":{{"principalEmail":"user', {_U}, '@x.org"}},"requestMetadata":{{"callerIp":"', src_ip, '"}}}}}}') as line
    from (select *, {_pick(f"seq % {len(_METHODS)}", [k for k, _ in _METHODS])} as method, {_pick(f"user_id % {len(_SEVS)}", [k for k, _ in _SEVS])} as sv, case (seq + user_id) % {len(_CODES)} {" ".join(f"when {i} then {c}" for i, c in enumerate(_CODES))} end as code from ({SEC_EVENTS}) s) t"""


@q(f"""with g as ({GCP}) select seq, method, case method {" ".join(f"when '{k}' then '{v}'" for k, v in _METHODS)} end as category, case when code = 0 then 'success' when code in ({", ".join(map(str, GCP_FAILED))}) then 'failure' else 'unknown' end as outcome,
    case when method = 'x.login.do' then 'do' else 'get' end as action, code::varchar as status_code, 'user' || user_id || '@x.org' as username, src_ip from g""")
def p09_gcp_tables(spark, sf):
    """All method prefixes and failure codes of the tables (P-09)."""
    x = extract(detect.detect_format(raw(spark, sf, GCP)), 2026, ["gcp_audit"])
    f = lambda k: F.try_element_at(F.col("extracted"), F.lit(k))["v"]
    return x.select("seq", f("method_name").alias("method"), f("category").alias("category"), f("outcome").alias("outcome"), f("action").alias("action"), f("status_code").alias("status_code"), f("username").alias("username"), f("src_ip").alias("src_ip"))


@q(f"with {CLO} select seq, 'h' || user_id as host, seq::varchar as n from clo where user_id % 5 = 4")
def p11_generic_xml(spark, sf):
    x = extract_generic_xml(raw(spark, sf, CLOUD).filter("line LIKE '<log>%'"))
    v = lambda word: F.get(F.map_values(F.map_filter("extracted", lambda k, v: F.lower(k).rlike(word))), F.lit(0))["v"]
    return x.select("seq", v(r"host$").alias("host"), v(r"[@._]n$").alias("n"))


@q(f"with {CLO} select seq, case when outcome = 'failure' then 'authentication' else 'system' end as category from clo where user_id % 5 = 3")
def j08_event_dimension(spark, sf):
    x, f = _cloud(spark, sf)
    x = x.filter("format_id = 'xml_generic' AND line LIKE '<Event%'").select("seq", f("windows_event_id").cast("int").alias("event_id_num"))
    return join_event_dim(x, event_dim(spark)).select("seq", "category")


@q("select o_orderkey, 'o' || o_orderkey || '.log' as name from orders")
def f09_basename(spark, sf):
    o = view(spark, sf, "select o_orderkey, concat('C:\\\\data/', o_orderstatus, '\\\\o', cast(o_orderkey as string), '.log', if(o_orderkey % 2 = 0, '\\\\', '')) as p from orders", "orders")
    return o.select("o_orderkey", S.win_basename(F.col("p")).alias("name"))


@q("select c_custkey, 's' || c_nationkey as subscription_id, 'g' || c_custkey as resource_group, case when c_custkey % 2 = 0 then 'prov' end as provider, case when c_custkey % 2 = 0 then c_mktsegment end as resource_name from customer")
def f10_resource_id(spark, sf):
    c = view(spark, sf, "select c_custkey, concat('/Subscriptions/s', cast(c_nationkey as string), '/resourceGroups/g', cast(c_custkey as string), if(c_custkey % 2 = 0, concat('/providers/prov/type/', c_mktsegment), '')) as id from customer", "customer")
    r = S.azure_resource(F.col("id"))
    return c.select("c_custkey", r["subscription_id"].alias("subscription_id"), r["resource_group"].alias("resource_group"), r["provider"].alias("provider"), r["resource_name"].alias("resource_name"))


# --- escapes and specifications ------------------------------------------------------------


@q("select doc_id from documents where contains(text, '%%') or contains(source, '%%') union select doc_id from documents where contains(lower(text), 'a_b')")
def f06_search_escapes(spark, sf):
    """Signs of patterns in a search term stand for themselves."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return query.search_events(d, "%%", ["text", "source"]).unionByName(query.search_events(d, "a_B", ["text"])).select("doc_id").distinct()


@q("""with t as (select conv_id, turn, replace(text, '\\', '\\\\') as e from conversations), n as (select *, regexp_replace(replace(e, '=', '\\='), '\\r\\n|\\n|\\r', '\\\\n', 'g') as cef, regexp_replace(replace(e, chr(9), '\\t'), '\\r\\n|\\n|\\r', '\\\\n', 'g') as leef from t)
    select conv_id, turn, replace(e, '|', '\\|') as header, cef, leef from n""")
def f07_escapes(spark, sf):
    c, t = view(spark, sf, "select conv_id, turn, text from conversations", "conversations"), F.col("text")
    return c.select("conv_id", "turn", S.cef_header(t).alias("header"), S.cef_value(t).alias("cef"), S.leef_value(t).alias("leef"))


@q("select c_custkey, upper('n ' || c_nationkey) as up, lower(c_mktsegment) as low, 'x' as strip, c_nationkey::varchar as split, case when c_nationkey > 9 then 'n ' || c_nationkey else 'none' end as or_default, c_mktsegment as first from customer")
def n04_specifications(spark, sf):
    """_upper, _lower, _strip, _split, _default, _first over a map of fields (N-04, N-06, N-07)."""
    c = view(spark, sf, "select c_custkey, concat('n ', cast(c_nationkey as string)) as n, if(c_nationkey > 9, concat('n ', cast(c_nationkey as string)), ' ') as d, c_mktsegment as m from customer", "customer")
    v = lambda x: F.struct(x.alias("v"), F.lit("string").alias("t"))
    e = c.withColumn("extracted", F.create_map(*[y for k, x in (("n", F.col("n")), ("m", F.col("m")), ("d", F.col("d")), ("s", F.lit("  x "))) for y in (F.lit(k), v(x))]))
    spec = normalize.compile_spec
    return e.select("c_custkey", spec("_upper:n").alias("up"), spec("_lower:m").alias("low"), spec("_strip:s").alias("strip"), spec("_split:n, ,1").alias("split"), spec("_default:d,none").alias("or_default"), spec("_first:zz,m,n").alias("first"))


@q(f"with {SEC} select seq, upper(event_type) as product, 'L' as vendor from sec")
def g06_mappings(spark, sf):
    """Rules of a YAML file in place of the built-in ones."""
    folder = pathlib.Path(tempfile.mkdtemp(prefix="loglake-"))  # read by the driver only
    (folder / "cef.yaml").write_text("source:\n  vendor: '_literal:L'\n  product: '_upper:SignatureID'\n")
    e = normalize.normalize(extract(detect.detect_format(raw(spark, sf)), formats=["cef"]), mappings=normalize.load_mappings(str(folder)))
    return e.select("seq", "source.product", "source.vendor")


@q(f"with {SEC} select seq, event_type as word from sec")
def g01_registered_format(spark, sf):
    """A format of one's own is detected and extracted as the built-in ones are."""
    r = raw(spark, sf).withColumn("line", F.concat(F.lit("MINE "), "event_type"))
    detect.register_format("mine", lambda s: s.startswith("MINE "), lambda s: F.create_map(F.lit("word"), F.substr(s, F.lit(6))))
    try:
        return extract(detect.detect_format(r)).select("seq", F.col("extracted")["word"]["v"].alias("word"))
    finally:
        detect.unregister_format("mine")


# --- declared sources ----------------------------------------------------------------------

SOURCE = """
name: gate
vendor: Acme
product: Gate
parser: {type: key_value}
detection: {contains: [srcip=, spt=], contains_mode: all}
fields: {types: {spt: port}, timestamp: when}
normalize: {network.src_ip: srcip, network.src_port: spt, event.category: "_literal:policy", event.action: act, event.severity_numeric: sev}
"""
OFF = "name: unused\nenabled: false\nparser: {type: key_value}\ndetection: {contains: [srcip=]}\n"
DECLARED = SEC_EVENTS.replace("select event_id", "select concat('srcip=', case when user_id % 6 = 0 then '10.0.0.' else '52.10.1.' end, cast(user_id % 250 as varchar(20)), ' spt=', cast(user_id * 900 as varchar(20)), ' act=', case when value > 60 then 'blocked' else 'permit' end, ' when=\"2026-01-02 03:04:05\" extra=', cast(event_id as varchar(20))) as line, event_id", 1)


def _sources():
    folder = pathlib.Path(tempfile.mkdtemp(prefix="loglake-"))  # read by the driver only
    (folder / "a_off.yaml").write_text(OFF)
    (folder / "gate.yaml").write_text(SOURCE)
    return declarative.load_sources(str(folder))


@q(f"""with d as ({DECLARED}) select seq, 'Acme' as vendor, 'policy' as category, case when outcome = 'failure' then 'failure' else 'success' end as outcome, 5.0::double as severity,
    case when user_id * 900 <= 65535 then (user_id * 900)::int end as src_port, seq::varchar as extra, '2026-01-02 03:04:05' as event_ts from d""")
def g02_declared_sources(spark, sf):
    """Sources from YAML end to end: detection, types, time, normalisation; one is switched off
    (D-05, P-19, N-15, G-02, G-03)."""
    rules = _sources()
    x = extract(detect.detect_format(raw(spark, sf, DECLARED), declarative=rules), formats=["cef"], declarative=rules)
    e = normalize.normalize(x.withColumn("t", F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss")), declarative=rules)
    extra = F.col("vendor_attributes")["extra"]["v"].alias("extra")
    return e.select("seq", "source.vendor", "event.category", "event.outcome", F.col("event.severity_numeric").alias("severity"), F.col("network.src_port").cast("int").alias("src_port"), extra, F.col("t").alias("event_ts"))


@q("select count(*) as lines, count(*) as matched, count(*) as extracted, count(*) as timed from events")
def p20_dry_run(spark, sf):
    return declarative.dry_run(raw(spark, sf, DECLARED), _sources()[1]).select("lines", "matched", "extracted", "timed")


# --- query surface -------------------------------------------------------------------------

SCORED = "select cast(event_id as varchar(20)) as event_id, value / 100 as anomaly_score, value > 90 as is_anomalous, user_id, event_type, cast(ts as varchar(30)) as t from events"


def _scored(spark, sf):
    return view(spark, sf, SCORED).withColumn("ingest_timestamp", F.date_format(F.col("t").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")).withColumn("timestamp", F.col("ingest_timestamp"))


@q(f"select event_id from ({SCORED}) where anomaly_score >= 0.75")
def q03_above_score(spark, sf):
    return query.above_score(_scored(spark, sf), 0.75).select("event_id")


CONN = "select event_id as seq, case user_id % 3 when 0 then '127.0.0.1' when 1 then '10.0.0.9' else '8.8.8.8' end as dst_ip, case user_id % 4 when 0 then 5432 else 443 end as dst_port, 50000 as src_port, event_type as process, user_id % 5 = 0 as is_threat from events"


@q(" union all ".join(f"select '{k}' as kind, seq from ({CONN}) where {c}" for k, c in {"clean": "not is_threat", "db": "dst_port = 5432", "remote": "dst_ip <> '127.0.0.1'", "localhost": "dst_ip = '127.0.0.1'", "all": "process ilike '%view%'"}.items()))
def q04_connections(spark, sf):
    c, out = view(spark, sf, CONN), None
    for kind in ("clean", "db", "remote", "localhost", "all"):
        rows = query.filter_connections(c, kind, "VIEW" if kind == "all" else None).select(F.lit(kind).alias("kind"), "seq")
        out = rows if out is None else out.unionByName(rows)
    return out


@q(f"with {SEC}, s as (select distinct case user_id % 9 when 7 then 'kv' when 8 then 'unknown' else 'ok' || (user_id % 9) end as k from sec) select 'healthy' as kind, 7::bigint as n union all select 'issues', count(*) from s where k in ('kv', 'unknown') union all select 'builtin', count(*) from s")
def q05_sources(spark, sf):
    t, out = _telemetry(spark, sf).withColumn("source_type", F.lit("builtin")), None
    for kind in ("healthy", "issues", "builtin"):
        rows = query.filter_sources(t, kind).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@q("select event_id::varchar as event_id, event_type from events where event_id = (select max(event_id) // 2 from events)")
def t03_event_by_id(spark, sf):
    e = _scored(spark, sf)
    n = e.agg(F.expr("max(bigint(event_id)) div 2")).first()[0]
    return query.get_event(e, str(n)).select("event_id", "event_type")


@q(f"select event_id, anomaly_score from ({SCORED}) where anomaly_score >= 0.1 order by anomaly_score desc, event_id limit 20")
def t04_top_anomalies(spark, sf):
    return query.top_anomalies(_scored(spark, sf), 20, 0.1).select("event_id", "anomaly_score")


@q(f"select event_id from (select *, strftime(t::timestamp, '%Y-%m-%dT%H:%M:%S') as s from ({SCORED})) order by s desc, event_id desc limit 50 offset 50")
def t05_dead_letter_page(spark, sf):
    return query.dead_letter_page(_scored(spark, sf), 2, 50).select("event_id")


@q(f"select event_id from (select *, strftime(t::timestamp, '%Y-%m-%dT%H:%M:%S') as s from ({SCORED})) order by s desc, event_id limit 250")
def t06_recent(spark, sf):
    return query.recent(_scored(spark, sf)).select("event_id")


@q(f"select count(*) as total, count_if(is_anomalous)::bigint as anomalous, round(100 * count_if(is_anomalous) / count(*), 2) as rate_pct from ({SCORED})")
def a16_anomaly_summary(spark, sf):
    return stats.anomaly_summary(_scored(spark, sf))


@q("select count(*) as processed, count_if(user_id % 9 < 7)::bigint as valid, 0::bigint as invalid, count_if(user_id % 9 >= 7)::bigint as errors from events")
def a12_run_stats(spark, sf):
    good, bad = ingest(raw(spark, sf, MIXED), formats=MIX_FORMATS)
    return stats.run_stats(good, bad)


@q("select count(*) as rows, count_if(value > 60)::bigint as invalid from events")
def g07_observed(spark, sf):
    """Counts that are read off while the rows are written elsewhere."""
    e = view(spark, sf, "select event_id, if(value > 60, array('too much'), array()) as errors from events")
    seen, counts = stats.observe_outcomes(e, "outcomes")
    seen.write.mode("overwrite").format("noop").save()
    return spark.createDataFrame([(counts.get["rows"], counts.get["invalid"])], "rows long, invalid long")


@q(f"with {LIN}, {IDS} select event_id from uid where seq % 3 = 0 and tenant_id = '{TENANT}'")
def j13_semi(spark, sf):
    """Events whose payload is archived, of one tenant."""
    r = identity.with_event_id(identity.with_raw_hash(raw(spark, sf)))
    archive = identity.raw_archive(r.filter("seq % 3 = 0"))
    return query.semi(query.semi(r, archive.select("event_id"), "event_id"), spark.createDataFrame([(TENANT,)], "tenant_id string"), "tenant_id").select("event_id")


@q(f"with {SEC} select seq, case when user_id % 6 = 1 then true end as threat, 'seen' as tag from sec")
def j05_enrichers(spark, sf):
    """A chain of enrichers of which one has lost its feed: the others go on (J-05, G-04)."""
    lost = enrich.optional_feed(spark, _folder(spark, "no-feed"))
    chain = [lambda d: enrich.enrich_ips(d, enrich.threat_table(spark), lost), lambda d: d.withColumn("tag", F.lit("seen"))]
    return enrich.enrich_all(_events(spark, sf), chain).select("seq", F.col("enrichment.threat_ip_detected").alias("threat"), "tag")


@q(f"""with {SEC} select seq, case when user_id % 6 = 1 then true end as threat, case when user_id % 7 > 0 then 'user' || (1000 // (user_id % 7)) end as note, null::varchar as score, 'seen' as tag,
    case when user_id % 7 = 0 then ['score', 'note'] else ['score'] end as errors, (select count(*) from events)::bigint as n_score, (select count_if(user_id % 7 = 0) from events)::bigint as n_note from sec""")
def j05_best_effort(spark, sf):
    """Enrichers that fail at run time, one on some rows and one as a whole: the columns of the
    others stay, and failures are counted in the pass that writes the rows (J-05)."""

    def note(name):  # no users without a remainder: a division by zero
        return f"user{1000 // (int(name[4:]) % 7)}"

    chain = [
        enrich.guarded("score", lambda d: d.withColumn("score", F.when(F.col("seq") % 50 == 7, F.raise_error(F.lit("no score"))).otherwise("1")), {"score": "string"}),
        lambda d: enrich.enrich_ips(d, enrich.threat_table(spark), enrich.cloud_table(spark)),
        enrich.row_enricher("note", "note", "string", note, "identity.username"),
        enrich.guarded("tag", lambda d: d.withColumn("tag", F.lit("seen")), {"tag": "string"}),
    ]
    events = written(_events(spark, sf).select("seq", "event_id", "network", "identity", "enrichment"), "events")
    e, counts = enrich.observe_failures(enrich.enrich_all(events, chain), ["score", "note"])
    path = _folder(spark, "best-effort")
    e.select("seq", F.col("enrichment.threat_ip_detected").alias("threat"), "note", "score", "tag", F.col(enrich.ERRORS).alias("errors")).write.parquet(path)
    n = counts.get
    return spark.read.parquet(path).withColumns({"n_score": F.lit(n["score"]).cast("long"), "n_note": F.lit(n["note"]).cast("long")})


@q(f"""with {SEC}, last as (select *, row_number() over (partition by src_ip order by seq desc) as k from sec), s as (select src_ip, k, sev from last where k <= 50),
    twice as (select src_ip, sev, k from s union all select src_ip, sev, k + 100 from s), cut as (select *, row_number() over (partition by src_ip order by k) as r from twice)
    select src_ip, count(*) as sev_n, round(avg(sev), 6) as sev_mean, round(stddev_pop(sev), 6) as sev_std from cut where r <= 70 group by 1""")
def w10_saved_baseline(spark, sf):
    """A baseline is saved, read, and goes on with new values: the last seventy stay."""
    path = _folder(spark, "baseline")
    b = W.build_baseline(_sec(spark, sf), 50)
    W.write_baseline(b, path)
    m = W.merge_baseline(W.read_baseline(spark, path), b, 70)
    return m.select("src_ip", "sev_n", F.round("sev_mean", 6).alias("sev_mean"), F.round("sev_std", 6).alias("sev_std"))


_FEATURES = [
    "sin(2 * pi() * hour(ts) / 24)", "cos(2 * pi() * hour(ts) / 24)", "sin(2 * pi() * (isodow(ts) - 1) / 7)", "cos(2 * pi() * (isodow(ts) - 1) / 7)", f"({CEF_SEV}) / 10", "0",
    "least(1, log10(1 + bytes_in) / 9)", "0", "1", "0", "0", *[f"(outcome = '{o}')::int" for o in OUTCOMES], "(user_id % 6 = 1)::int", "(user_id % 6 in (2, 4))::int", *[f"({_CAT} = '{c}')::int" for c in CATEGORIES],
]


@q(f"with {LIN}, {IDS} select event_id, [{', '.join(f'round(({x})::double, 6) + 0.0' for x in _FEATURES)}] as features from uid")
def e05_feature_vector(spark, sf):
    """All 24 features of enriched events, as a vector (E-01 to E-05)."""
    e = enrich.enrich_ips(_events(spark, sf), enrich.threat_table(spark), enrich.cloud_table(spark)).withColumn("source_event_timestamp", F.col("ingest_timestamp"))
    return features(e).select("event_id", F.transform("features", lambda x: F.round(x, 6)).alias("features"))


@q("select 'ocsf' as target, count(*) as n from events union all select 'ecs', count(*) from events")
def x03_crosswalk(spark, sf):
    """The bulk job writes every event in both vocabularies."""
    paths = {target: _folder(spark, target) for target in ("ocsf", "ecs")}
    with held(spark, "events") as hold:
        e = hold(_events(spark, sf))
        for target, path in paths.items():
            crosswalk.write_crosswalk(e, target, path)
    out = None
    for target, path in paths.items():
        rows = spark.read.text(path).filter("try_parse_json(value) IS NOT NULL").agg(F.count(F.lit(1)).alias("n")).select(F.lit(target).alias("target"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@q(f"""with {LIN}, {IDS}, r as (select event_id, src_ip, ({CEF_SEV}) as s, bytes_in, outcome, 'user' || user_id as username from uid), n as (select (select count(*) from events)::bigint as converted, (select count_if(event_id % 10 = 0) * 2 from events)::bigint as failed)
    select 'ocsf' as target, event_id as uid, src_ip, (case when s >= 9 then 5 when s >= 7 then 4 when s >= 5 then 3 when s >= 3 then 2 else 1 end)::int as severity, (case outcome when 'success' then 1 when 'failure' then 2 else 0 end)::varchar as outcome, bytes_in as n_bytes, username, n.* from r, n
    union all select 'ecs', event_id, src_ip, s * 10, outcome, nullif(bytes_in, 0), username, n.* from r, n""")
def x03_crosswalk_lines(spark, sf):
    """Lines of events, among which some are no events, in both vocabularies: all converted rows,
    and the numbers of converted and failed lines from the same pass."""
    path, out = _folder(spark, "lines"), None
    sinks.write_ndjson(_events(spark, sf).drop("ingest_ts", "seq"), path, compact=True)
    bad = _sec(spark, sf).filter("seq % 10 = 0").select(F.explode(F.array(F.concat(F.lit('{"event_id": "'), F.col("seq").cast("string")), F.lit("[1, 2]"), F.lit("  "))).alias("value"))
    bad.write.mode("append").text(path)
    fields = {
        "ocsf": ("metadata struct<uid: string>, src_endpoint struct<ip: string>, severity_id int, status_id int, traffic struct<bytes_in: long>, user struct<name: string>", ["metadata.uid", "src_endpoint.ip", "severity_id", "status_id", "traffic.bytes_in", "user.name"]),
        "ecs": ("event struct<id: string, severity: int, outcome: string>, source struct<ip: string>, network struct<bytes: long>, user struct<name: string>", ["event.id", "source.ip", "event.severity", "event.outcome", "network.bytes", "user.name"]),
    }
    for target, (ddl, cols) in fields.items():
        to = _folder(spark, target)
        rows, counts = crosswalk.crosswalk_lines(spark.read.text(path), target)
        rows.write.options(**sinks.COMPACT).text(to)
        n = counts.get
        read = spark.read.schema(ddl).json(to).select(F.lit(target).alias("target"), *[F.col(c).cast("string" if k == "outcome" else t).alias(k) for c, k, t in zip(cols, ["uid", "src_ip", "severity", "outcome", "n_bytes", "username"], ["string", "string", "int", "string", "long", "string"])])
        read = read.withColumns({k: F.lit(n[k]).cast("long") for k in ("converted", "failed")})
        out = read if out is None else out.unionByName(read)
    return out


# --- streams -------------------------------------------------------------------------------


@q(f"with {MIX}, {SEC} select 'events' as stage, count(*) as n from sec where user_id % 9 < 7 union all select 'detection', count(*) from sec where user_id % 9 >= 7")
def m01_stream_ingest(spark, sf):
    """Raw files through the batch job in micro-batches: events to a sink, the rest to dead letters."""
    top = _folder(spark, "ingest")
    raw(spark, sf, MIXED).select("line").repartition(4).write.text(f"{top}/in")
    stream = readers.stream_raw(spark, f"{top}/in", max_files=2)
    sink = {"files": sinks.by_batch(f"{top}/events", prepare=lambda d: d.select("event_id"))}
    w = jobs.stream_ingest(stream, lambda d, hold: ingest(d, formats=MIX_FORMATS, hold=hold), sink, sinks.by_batch(f"{top}/dead", partition_by=("stage",)), f"{top}/ck", available_now=True)
    w.awaitTermination()
    good = spark.read.schema("event_id string").json(f"{top}/events").select(F.lit("events").alias("stage"))
    return good.unionByName(readers.read_dead_letter(spark, f"{top}/dead").select("stage")).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@q(f"with {LIN}, {IDS} select event_id, 'written' as stage, null as failed_sink from uid union all select event_id, 'sink', 'broken' from uid")
def m01_exactly_once(spark, sf):
    """A batch fails behind its sinks, runs again after a restart, and is there once; one sink
    fails in all runs, and its records are dead letters of the batch, once too."""
    top = _folder(spark, "once")
    raw(spark, sf).select("line", "tenant_id").repartition(4).write.partitionBy("tenant_id").text(f"{top}/in")
    dead, failures = sinks.by_batch(f"{top}/dead", partition_by=("stage",)), [OSError("no room")]

    def broken(df, number):
        raise ValueError("no such index")

    def dead_letter(df, number):
        dead(df, number)
        if failures:  # all of the batch is written, but Spark does not know of it yet
            raise failures.pop()

    def start():
        stream = readers.stream_raw(spark, f"{top}/in/*", max_files=3).withColumn("tenant_id", F.regexp_extract("source_tag", "tenant_id=([^/]+)", 1)).withColumn("source_tag", F.lit("edge"))
        parse = lambda d, hold: ingest(d, formats=["cef"], hold=hold)
        return jobs.stream_ingest(stream, parse, {"broken": broken, "files": sinks.by_batch(f"{top}/events", prepare=lambda d: d.select("event_id"))}, dead_letter, f"{top}/ck", available_now=True)

    try:
        start().awaitTermination()
    except StreamingQueryException:
        start().awaitTermination()
    good = spark.read.schema("event_id string").json(f"{top}/events").select("event_id", F.lit("written").alias("stage"), F.lit(None).cast("string").alias("failed_sink"))
    return good.unionByName(readers.read_dead_letter(spark, f"{top}/dead").select("event_id", "stage", "failed_sink"))


@q(f"with {LIN} select 'syslog.' || tenant_id as source_tag, seq, line, 'net' as tenant_id from lin")
def s07_network(spark, sf):
    """Records that a collector received from the network, through a stream that stops and goes
    on: the collector writes some of them twice, and more while the stream is away."""
    top = _folder(spark, "spool")
    rows = raw(spark, sf).select(F.concat(F.lit("syslog."), "tenant_id").alias("topic"), (F.col("seq") % 3).alias("partition"), F.col("seq").alias("offset"), F.col("raw_bytes").alias("value"), F.col("ingest_ts").alias("timestamp"))
    for part in ("offset % 5 < 3", "offset % 5 >= 2"):
        readers.write_spool(rows.filter(part), f"{top}/in")
        s = readers.stream_spool_raw(spark, f"{top}/in", "net", max_files=3, watermark="3650 days")
        with readers.state_on_disk(spark):
            w = s.writeStream.format("parquet").option("path", f"{top}/rows").option("checkpointLocation", f"{top}/ck").trigger(availableNow=True).start()
        w.awaitTermination()
    return spark.read.parquet(f"{top}/rows").select("source_tag", "seq", "line", "tenant_id")


@q("select distinct event_type, user_id from events")
def m02_stream_index(spark, sf):
    """Each id is appended once, though the stream has it many times."""
    path = _folder(spark, "index")
    e = _sec_stream(spark, sf).select(F.concat("event_type", F.lit("|"), F.col("user_id").cast("string")).alias("event_id"), F.col("ts").alias("ingest_ts"))
    jobs.stream_index(e, f"{path}/rows", f"{path}/ck", "3650 days").awaitTermination()
    p = F.split("event_id", r"\|")
    return spark.read.schema(e.schema).parquet(f"{path}/rows").select(p[0].alias("event_type"), p[1].cast("long").alias("user_id"))


@q(f"""with {SEC}, w as (select seq, src_ip, sev, count(*) over r as n, avg(sev) over r as m, stddev_pop(sev) over r as s from sec window r as (partition by src_ip order by seq rows between 20 preceding and 1 preceding))
    select seq, round(case when n < 5 then 0 when s > 1e-9 then abs(sev - m) / s when abs(sev - m) > 1e-4 then 10 else 0 end, 4)::double as z from w""")
def m03_stream_score(spark, sf):
    return _finished(jobs.stream_score(_sliced_stream(spark, sf), 20, None), "score", least=5).select("seq", F.round("z", 4).alias("z"))


@q(f"""with {SEC}, r as (select src_ip, count(*) / 864000.0 as rate from sec group by 1), w as (select src_ip, time_bucket(interval 1 day, ts::timestamp, timestamp '1970-01-01') as s, count(*) as n from sec group by 1, 2)
    select w.src_ip, strftime(s, '%Y-%m-%d') as day, n from w join r using (src_ip) where n >= 2 and n / 86400 > 0.5 * rate""")
def m05_stream_burst(spark, sf):
    rates = view(spark, sf, SEC_EVENTS).groupBy("src_ip").agg((F.count(F.lit(1)) / 864000.0).alias("rate"))
    return _updated(jobs.stream_burst(_sec_stream(spark, sf), rates, "1 day", "1 day", 0.5, 2, watermark="3650 days"), "burst").select("src_ip", F.date_format("start", "yyyy-MM-dd").alias("day"), "n")


def _updated(stream, name):
    """The last state of a windowed stream in update mode: its batches, of which the latest
    row of each window is the largest count."""
    out = _folder(stream.sparkSession, name)
    w = stream.writeStream.outputMode("update").foreachBatch(lambda d, _: d.write.mode("append").parquet(f"{out}/rows")).option("checkpointLocation", f"{out}/ck")
    w.trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")
    return rows.groupBy(*[c for c in rows.columns if c != "n"]).agg(F.max("n").alias("n"))


@q("select strftime(time_bucket(interval 1 day, ts::timestamp, timestamp '1970-01-01'), '%Y-%m-%d') as day, count(*) as n from events group by 1")
def m06_stream_velocity(spark, sf):
    return _updated(jobs.stream_velocity(_sec_stream(spark, sf), "1 day", watermark="3650 days"), "velocity").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n")
