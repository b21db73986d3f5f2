"""Literal lines and the fields they must give."""

import pytest
from pyspark.sql import functions as F

from loglake.operators import declarative, detect, framing, identity
from loglake.operators.extract import extract
from loglake.plans.ingest import ingest
from loglake.sources.readers import raw_from_lines, read_raw

LINES = {
    "cef": ("<13>Aug  5 10:00:00 h CEF:0|Acme|Edge|1|100|Login failed|9|src=10.1.2.3 spt=4242 msg=two words here suser=ann rt=1785924000000", {"src": "10.1.2.3", "msg": "two words here", "suser": "ann", "severity_ues": "9"}),
    "leef": ("LEEF:2.0|Acme|Gate|1|55|^|src=10.0.0.9^sev=high^usrName=bob^empty=", {"src_ip": "10.0.0.9", "severity_numeric": "8", "username": "bob", "empty": ""}),
    "cisco_asa": ("<166>Aug  5 10:20:30 fw1 %ASA-6-106100: access-list OUT denied tcp outside/1.2.3.4(99) -> inside/10.0.0.1(443)", {"acl_action": "denied", "src_ip": "1.2.3.4", "dst_port": "443", "severity_ues": "3"}),
    "syslog_rfc3164": ("<34>Aug  5 10:20:30 host1 sshd[77]: hello there", {"facility": "4", "syslog_severity": "2", "tag": "sshd", "pid": "77", "severity_ues": "8"}),
    "syslog_rfc5424": ('<165>1 2026-08-05T10:20:30.123Z host2 - 9 ID1 [ex@1 a="b" c="d"] text', {"hostname": "host2", "appname": None, "sd_ex@1_c": "d", "message": "text"}),
    "json_passthrough": ('{"ts":"2026-01-01T00:00:00Z","severity":99,"user":7,"o":{"x":1}}', {"severity_ues": "10", "user": "7"}),
    "aws_cloudtrail": (
        '{"eventVersion":"1.08","eventSource":"iam.amazonaws.com","eventName":"DeleteUser","eventTime":"2026-01-01T00:00:00Z","sourceIPAddress":"1.2.3.4","userIdentity":{"userName":"eve","accountId":"1"}}',
        {"product": "IAM", "category": "policy", "severity_numeric": "7", "outcome": "success", "username": "eve"},
    ),
    "azure_monitor": (
        '{"time":"2026-01-01T00:00:00.1234567Z","resourceId":"/subscriptions/s1/resourceGroups/g1/providers/p/t/n","operationName":"vm/delete","resultType":"Failed","category":"Security","callerIpAddress":"1.2.3.4:55","properties":{"code":"x"}}',
        {"severity_numeric": "7", "category": "threat", "outcome": "failure", "resource_group": "g1", "src_ip": "1.2.3.4", "properties.code": "x"},
    ),
    "gcp_audit": (
        '{"logName":"projects/p1/logs/a%2Factivity","severity":"NOTICE","insertId":"i","timestamp":"2026-01-01T00:00:00Z","protoPayload":{"@type":"type.googleapis.com/google.cloud.audit.AuditLog","methodName":"iam.roles.get","status":{"code":7},"authorizationInfo":[{"granted":false}],"authenticationInfo":{"principalEmail":"a@b"}}}',
        {"severity_numeric": "8", "outcome": "failure", "authorization_granted": "false", "project_id": "p1", "log_type": "activity", "category": "authentication"},
    ),
    "xml_generic": (
        "<Event xmlns='http://x'><System><EventID>4688</EventID><Level>1</Level><Computer>pc</Computer></System><EventData><Data Name='NewProcessName'>C:\\a\\cmd.exe</Data><Data Name='IpAddress'>10.0.0.5</Data></EventData></Event>",
        {"process_name": "cmd.exe", "severity_numeric": "8", "event_description": "Process: cmd.exe (process_start)", "src_ip": "10.0.0.5"},
    ),
}
PAN = ",".join(["2026/01/02 03:04:05", "1", "TRAFFIC", "", "", "", "10.0.0.1", "10.0.0.2", "", "", '"a, b"', "u", "", "web", "", "trust", "untrust", "e1", "", "", "", "9", "1", "50", "443", "", "", "", "TCP", "drop", "5", "6", "7", "", "", ""])
LINES["paloalto_csv"] = (PAN, {"rule": "a, b", "action_ues": "deny", "proto": "tcp", "bytes_received": "7", "dst_user": None})


@pytest.fixture(scope="module")
def parsed(spark):
    rows = spark.createDataFrame([(k, v[0]) for k, v in LINES.items()], "want string, line string").withColumn("source_tag", F.lit("t"))
    return {r["want"]: r for r in extract(detect.detect_format(rows)).collect()}


@pytest.mark.parametrize("fmt", sorted(LINES))
def test_line(parsed, fmt):
    r = parsed[fmt]
    assert (r["format_id"], r["parse_error"]) == (fmt, None)
    got = {k: (r["extracted"].get(k) or {"v": None})["v"] for k in LINES[fmt][1]}
    assert got == LINES[fmt][1]


def test_types_and_times(parsed):
    j = parsed["json_passthrough"]["extracted"]
    assert (j["user"]["t"], j["o"]["t"], j["ts"]["t"]) == ("long", "object", "string")
    assert str(parsed["cisco_asa"]["event_ts"]).startswith("2026-08-05 10:20:30")
    assert parsed["cef"]["event_ts"] is not None


def test_failures_become_dead_letters(spark):
    lines = ["a=b", "plain", '{"broken":', "<!DOCTYPE x><a/>", "<Event><!DOCTYPE y></Event>", "<165>1 short", "", "   "]
    raw = raw_from_lines(spark.createDataFrame([(x,) for x in lines], "line string"), "t")
    good, bad = ingest(raw)
    assert good.count() == 0
    assert sorted(r["stage"] for r in bad.collect()) == ["detection"] * 4 + ["extraction"] * 2


def test_uuid_is_the_standard_one(spark):
    import uuid

    names = ["a", "tenant:x", "é"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", identity.uuid5_url(F.col("n")).alias("u")).collect()
    assert all(r["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, r["n"])) for r in rows)


def test_read_raw_keeps_bytes(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\n\n\xff\xfe bytes\nlone\rcr\n")
    rows = read_raw(spark, str(tmp_path)).orderBy("seq").collect()
    assert [bytes(r["raw_bytes"]) for r in rows] == [b"one", b"\xff\xfe bytes", b"lone\rcr"]


def test_framing(spark):
    t = spark.createDataFrame([('{"a":1}\n{"b":"}"} {"c":{}}{"d":',)], "line string")
    assert [(r["line"], r["frame_error"]) for r in framing.frame_json_stream(t).collect()] == [('{"a":1}', None), ('{"b":"}"}', None), ('{"c":{}}', None), ('{"d":', "unterminated record")]
    t = spark.createDataFrame([("5 hello6 wörld",)], "line string")
    assert [r["line"] for r in framing.frame_octet_counted(t).collect()] == ["hello", "wörld"]
    good, bad = framing.split_oversized(framing.frame_lines(spark.createDataFrame([("x" * 5000,), ("ok",)], "line string"), 1024))
    assert good.count() == 1 and bad.first()["line"].endswith("[TRUNCATED]") and len(bytes(bad.first()["raw_bytes"])) == 5000


def test_declared_source(spark):
    cfg = {
        "name": "gate", "vendor": "Acme", "parser": {"type": "key_value"}, "detection": {"contains": ["gate=", "act="]},
        "fields": {"types": {"spt": "port"}, "timestamp": "when"}, "normalize": {"event.action": "act", "network.src_ip": "ip", "network.src_port": "spt", "event.category": "_literal:network"},
    }
    rule = declarative.SourceRule(cfg)
    raw = raw_from_lines(spark.createDataFrame([('gate=1 act=blocked ip=10.0.0.1 spt=99999 when="2026-01-01 00:00:00"',), ("gate=2 act=ok ip=x spt=80",)], "line string"), "t")
    good, bad = ingest(raw, declarative=[rule], formats=["cef"])
    rows = {r["event"]["action"]: r for r in good.collect()}
    assert bad.count() == 0 and rows["blocked"]["event"]["outcome"] == "failure" and rows["blocked"]["network"]["src_port"] is None and rows["ok"]["network"]["src_port"] == 80
    assert declarative.dry_run(raw, rule).first()["matched"] == 2
    with pytest.raises(ValueError):
        declarative.SourceRule({"parser": {"type": "nope"}})


def test_registered_format(spark):
    detect.register_format("mine", lambda s: s.startswith("MINE "), lambda s: F.create_map(F.lit("rest"), F.substr(s, F.lit(6))))
    try:
        r = extract(detect.detect_format(spark.createDataFrame([("t", "MINE abc")], "source_tag string, line string"))).first()
        assert r["format_id"] == "mine" and r["extracted"]["rest"]["v"] == "abc"
    finally:
        detect.unregister_format("mine")


def test_times_of_no_layout_are_null_and_weekdays_are_read(spark):
    """A layout that Spark refuses made such rows raise, and the expressions around it interpreted."""
    from loglake.functions.scalars import parse_ts

    texts = ["Wed, 5 Aug 2026 10:20:30 +0000", "08/05/2026 10:20:30", "20260805T102030Z", "nonsense", "5 Aug 2026 10:20:30 +0000"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_timestamp(parse_ts(F.col("t"))).alias("s")).collect()
    assert [r["s"] for r in rows] == [1785925230, 1785925230, 1785925230, None, None]


def test_projections_of_parsing_are_compiled(spark):
    """With the fallback to interpretation off, an expression without code fails the job."""
    spark.conf.set("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")
    try:
        line = "CEF:0|A|B|1|9|login|3|src=10.0.0.1 rt=Wed, 5 Aug 2026 10:20:30 +0000 msg=a b"
        d = spark.createDataFrame([(line, "cef")], "line string, format_id string").repartition(1)
        row = extract(d, formats=["cef"]).select(F.unix_timestamp("event_ts").alias("s"), F.try_element_at("extracted", F.lit("msg"))["v"].alias("msg")).first()
    finally:
        spark.conf.unset("spark.sql.codegen.factoryMode")
    assert (row["s"], row["msg"]) == (1785925230, "a b")
