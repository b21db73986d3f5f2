"""Field extraction: one pass that adds ``extracted``, ``event_ts`` and ``parse_error``.

Each format is a function of the line's column that returns a struct of the fields, the
event time and whether the line is valid. Values carry a tag of their JSON type. No expression
raises; a line that its format refuses gets a parse_error.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.functions.scalars import azure_resource, blank_to_null, bsd_text, let, once, parse_trimmed, parse_ts, safe_int, safe_port, valid_ip, win_basename
from loglake.operators.detect import REGISTERED
from loglake.schema import FIELDS


def Parsed(fields: Column, ts: Column, ok: Column) -> Column:  # noqa: N802
    """What a format makes of a line: its fields, event time, and whether the line is valid."""
    return F.struct(fields.cast(FIELDS).alias("fields"), ts.alias("ts"), F.coalesce(ok, F.lit(False)).alias("ok"))


def value(c: Column, kind: str = "string") -> Column:
    v = c.cast("string")
    return F.struct(v.alias("v"), F.when(v.isNull(), "null").otherwise(kind).alias("t"))


def fields_of(pairs: dict[str, Column | tuple[Column, str]]) -> Column:
    entries = []
    for k, c in pairs.items():
        c, kind = c if isinstance(c, tuple) else (c, "string")
        entries.append(F.struct(F.lit(k).alias("k"), value(c, kind).alias("x")))
    return F.map_from_entries(F.array(*entries))


def strings(m: Column) -> Column:
    """A map of strings as a map of fields."""
    return F.transform_values(m, lambda k, v: value(v))


def group(s: Column, pattern: str, i: int) -> Column:
    """A group of the first match; null where it is empty or nothing matches."""
    return F.nullif(F.regexp_extract(s, pattern, i), F.lit(""))


#: Stands between the groups of a match; a line that holds it loses it.
SEP = "\x01\x02\x03"


class Head(NamedTuple):
    """A format whose lines one anchored pattern takes apart, with what becomes of the groups
    ``g(i)`` in steps: attributes ``a``, times, fields. ``extract`` makes each step a column, as
    a step in a lambda is interpreted."""

    pattern: str
    n: int  # groups of the pattern
    fields: Callable  # (g, a): a map of fields
    times: Callable  # (g, a, reference_year): texts of the event time, tried in turn
    attributes: Callable | None = None  # (g): a map of strings


def groups(s: Column, head: Head) -> Column:
    """The groups of a head's pattern between two more elements; fewer where it does not match.
    The pattern runs once a line, not once for each group."""
    text = SEP + SEP.join(f"${i}" for i in range(1, head.n + 1)) + SEP
    return F.split(F.regexp_replace(F.replace(s, F.lit(SEP), F.lit("")), head.pattern, text), SEP, -1)


def lookup(table: dict, key: Column) -> Column:
    flat = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*flat), key)


def null_ts() -> Column:
    return F.lit(None).cast("timestamp")


# Severities of the input formats on the 0 to 10 scale.
SYSLOG_SEVERITY = {0: 10, 1: 9, 2: 8, 3: 7, 4: 6, 5: 5, 6: 3, 7: 1}
SYSLOG_NAME = {0: "emergency", 1: "alert", 2: "critical", 3: "error", 4: "warning", 5: "notice", 6: "informational", 7: "debug"}
ASA_NAME = SYSLOG_NAME | {5: "notification"}
LEEF_WORDS = {"low": 2, "medium": 5, "high": 8, "critical": 10, "unknown": 3}
GCP_SEVERITY = {"DEFAULT": 3, "DEBUG": 1, "INFO": 3, "NOTICE": 4, "WARNING": 6, "ERROR": 7, "CRITICAL": 9, "ALERT": 9, "EMERGENCY": 10}

CEF_HEAD = r"(?s)^(?:<\d+>.*?\s)?CEF:(\d+)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$"
CEF_HEAD_ESCAPED = CEF_HEAD.replace("[^|]*", r"(?:[^|\\]|\\.)*+")
#: key=value up to the next key; unrolled, so that long values do not deepen the stack.
CEF_PAIR = r"(\w+)=([^\\=]*(?:\\.[^\\=]*)*)(?=(?:\s+\w+=|$))"
CEF_TIMES = ["rt", "start", "end", "deviceReceiptTime", "deviceCustomDate1", "deviceCustomDate2"]


def cef(unescape: bool = False) -> Head:
    return Head(CEF_HEAD_ESCAPED if unescape else CEF_HEAD, 8, lambda g, a: _cef(g, a, unescape), lambda g, a, year: [F.try_element_at(a, F.lit(k)) for k in CEF_TIMES], lambda g: _cef_pairs(g(8), unescape))


def _cef_pairs(tail: Column, unescape: bool) -> Column:
    def pair(p: Column) -> Column:
        v = F.trim(F.substr(p, F.instr(p, "=") + 1))
        if unescape:
            v = F.regexp_replace(F.regexp_replace(v, r"\\n", "\n"), r"\\([\\=|])", "$1")
        return F.struct(F.substring_index(p, "=", 1).alias("k"), v.alias("v"))

    return F.map_from_entries(F.transform(F.regexp_extract_all(tail, F.lit(CEF_PAIR), F.lit(0)), pair))


def _cef(group, ext: Column, unescape: bool) -> Column:
    g = lambda i: F.trim(group(i))
    h = (lambda i: F.regexp_replace(g(i), r"\\([\\|])", "$1")) if unescape else g
    sev = safe_int(g(7))
    ues = F.when(sev == 0, 1).when(sev.between(1, 10), sev).otherwise(5)
    base = fields_of(
        {
            "cef_version": (g(1), "long"),
            "DeviceVendor": h(2),
            "DeviceProduct": h(3),
            "DeviceVersion": h(4),
            "SignatureID": h(5),
            "Name": h(6),
            "Severity": g(7),
            "severity_ues": (ues, "long"),
        }
    )
    return F.map_concat(base, strings(ext))


# Names that LEEF attributes get.
LEEF_NAMES = {
    "src": "src_ip", "dst": "dst_ip", "spt": "src_port", "dpt": "dst_port", "proto": "protocol", "usrName": "username",
    "devTime": "timestamp_raw", "cat": "category_raw", "sev": "severity_raw", "msg": "message", "srcBytes": "bytes_in", "dstBytes": "bytes_out",
}
LEEF_HEAD = r"(?s)^(?:<\d+>.*?\s)?LEEF:([12]\.0)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)(?:\|([^|a-zA-Z0-9\s]|x[0-9A-Fa-f]{2}))?\|(.*)$"


def leef() -> Head:
    return Head(LEEF_HEAD, 7, _leef, lambda g, a, year: [F.try_element_at(a, F.lit("timestamp_raw"))], _leef_pairs)


def _leef_pairs(g) -> Column:
    given = g(6)
    hexed = F.char(F.conv(F.substring(given, 2, 2), 16, 10).try_cast("int"))
    delim = F.when((g(1) != "2.0") | (given == ""), "\t").when(F.length(given) == 3, hexed).otherwise(given)
    pairs = F.filter(F.split(g(7), F.concat(F.lit("\\Q"), delim, F.lit("\\E"))), lambda p: F.contains(p, F.lit("=")))
    keys = F.transform(pairs, lambda p: F.trim(F.substring_index(p, "=", 1)))
    vals = F.transform(pairs, lambda p: F.trim(F.substr(p, F.instr(p, "=") + 1)))
    return F.map_from_arrays(F.transform(keys, lambda k: F.coalesce(lookup(LEEF_NAMES, k), k)), vals)


def _leef(g, a: Column) -> Column:
    at = lambda k: F.try_element_at(a, F.lit(k))
    raw = F.lower(F.trim(F.coalesce(at("severity_raw"), F.lit("5"))))
    n = safe_int(raw)
    sev = F.coalesce(F.when(n == 0, 1).when(n.between(1, 10) & raw.rlike(r"^(?:\d|10)$"), n), lookup(LEEF_WORDS, raw), F.lit(5))
    base = fields_of({"leef_version": g(1), "vendor": F.nullif(g(2), F.lit("")), "product": F.nullif(g(3), F.lit("")), "product_version": F.nullif(g(4), F.lit("")), "event_id": F.nullif(g(5), F.lit(""))})
    typed = fields_of(
        {
            "src_ip": valid_ip(at("src_ip")),
            "dst_ip": valid_ip(at("dst_ip")),
            "src_port": (safe_port(at("src_port")), "long"),
            "dst_port": (safe_port(at("dst_port")), "long"),
            "bytes_in": (safe_int(at("bytes_in")), "long"),
            "bytes_out": (safe_int(at("bytes_out")), "long"),
            "severity_numeric": (sev, "long"),
        }
    )
    proto = F.when(at("protocol").isNotNull(), fields_of({"protocol": F.lower(at("protocol"))})).otherwise(F.create_map().cast(FIELDS))
    return F.map_concat(base, strings(a), typed, proto)


MONTHS = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
ASA_HEAD = rf"(?s)^<(\d+)>({MONTHS}\s+\d{{1,2}}\s+\d{{2}}:\d{{2}}:\d{{2}}|\d{{4}}-\d{{2}}-\d{{2}}T\S+)\s+(\S+)\s+%ASA-(\d)-(\d+):\s*(.*)$"
_IP = r"\d{1,3}(?:\.\d{1,3}){3}"
ASA_CONN = rf"(?i)(?:from|permitted|denied)\s+(?:\w+\s+)?(?:[\w-]+/)?\(?({_IP})\)?(?:\((\d+)\))?(?:\s*->\s*(?:[\w-]+/)?({_IP})(?:\((\d+)\))?)?"
ASA_ACL = r"(?i)access-list\s+(\S+)\s+(permitted|denied)\s+(\w+)"


def _when_map(cond: Column, m: Column) -> Column:
    return F.when(cond, m).otherwise(F.create_map().cast(FIELDS))


def _bsd_time(g, a, year: int) -> list[Column]:
    return [bsd_text(g(2), year)]


def cisco_asa() -> Head:
    return Head(ASA_HEAD, 6, _asa, _bsd_time)


def _asa(g, a) -> Column:
    pri, sev, msg = safe_int(g(1)), safe_int(g(4)), F.trim(g(6))
    c = lambda i: group(msg, ASA_CONN, i)
    l = lambda i: F.regexp_extract(msg, ASA_ACL, i)  # noqa: E731, E741
    base = fields_of(
        {
            "vendor": F.lit("Cisco"),
            "product": F.lit("ASA"),
            "hostname": g(3),
            "priority": (pri, "long"),
            "facility": (F.shiftright(pri, 3), "long"),
            "asa_severity": g(4),
            "asa_severity_name": F.coalesce(lookup(ASA_NAME, sev.cast("int")), F.lit("unknown")),
            "severity_ues": (F.coalesce(lookup(SYSLOG_SEVERITY, sev.cast("int")), F.lit(5)), "long"),
            "asa_mnemonic": g(5),
            "timestamp_raw": g(2),
            "message": msg,
        }
    )
    acl = fields_of({"acl_name": l(1), "acl_action": F.lower(l(2)), "proto": F.lower(l(3))})
    conn = fields_of({"src_ip": valid_ip(c(1)), "src_port": (safe_port(c(2)), "long"), "dst_ip": valid_ip(c(3)), "dst_port": (safe_port(c(4)), "long")})
    return F.map_concat(base, _when_map(msg.rlike(ASA_ACL), acl), _when_map(msg.rlike(ASA_CONN), conn))


# The positions of a traffic record.
PAN_COLUMNS = [
    "receive_time", "serial", "type", "threat_content_type", "config_version", "generate_time", "src_ip", "dst_ip", "natsrc", "natdst", "rule", "src_user",
    "dst_user", "app", "vsys", "src_zone", "dst_zone", "inbound_if", "outbound_if", "log_action", "session_end_reason", "sessionid", "repeatcnt", "src_port",
    "dst_port", "natsport", "natdport", "flags", "proto", "action", "bytes", "bytes_sent", "bytes_received", "packets", "start", "elapsed",
]
PAN_ACTION = {"drop": "deny", "reset-both": "deny", "reset-client": "deny", "reset-server": "deny"}


def paloalto(s: Column) -> Column:
    return let(F.from_csv(s, ", ".join(f"`{c}` string" for c in PAN_COLUMNS), {"mode": "PERMISSIVE"}), _paloalto)


def _paloalto(row: Column) -> Column:
    c = lambda k: F.trim(row[k])
    n = lambda k: F.nullif(c(k), F.lit(""))
    action = F.coalesce(F.lower(c("action")), F.lit(""))
    base = fields_of(
        {
            "vendor": F.lit("Palo Alto Networks"),
            "product": F.lit("PAN-OS"),
            "device_serial": c("serial"),
            "timestamp_raw": c("receive_time"),
            "src_ip": valid_ip(c("src_ip")),
            "dst_ip": valid_ip(c("dst_ip")),
            "src_port": (safe_port(c("src_port")), "long"),
            "dst_port": (safe_port(c("dst_port")), "long"),
            "proto": F.lower(n("proto")),
            "bytes_sent": (safe_int(c("bytes_sent")), "long"),
            "bytes_received": (safe_int(c("bytes_received")), "long"),
            "action_raw": action,
            "action_ues": F.coalesce(lookup(PAN_ACTION, action), action),
            "rule": c("rule"),
            **{k: n(k) for k in ("src_user", "app", "src_zone", "dst_zone", "inbound_if", "outbound_if")},
            "sessionid": c("sessionid"),
            "severity_ues": (F.lit(3), "long"),
        }
    )
    return Parsed(base, parse_ts(c("receive_time")), F.upper(c("type")) == "TRAFFIC")


RFC3164_HEAD = rf"(?s)^<(\d+)>({MONTHS}\s+\d{{1,2}}\s+\d{{2}}:\d{{2}}:\d{{2}}|\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d+)?(?:Z|[+-]\d{{2}}:\d{{2}})?)\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s*(.*)$"
RFC5424_HEAD = r"(?s)^<(\d+)>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+((?:\[.*?\])+|-)\s*(.*)$"
SD_ELEMENT = r'\[([\w@.-]+)((?:\s+[\w.-]+="[^"]*")*?)\]'
SD_PARAM = r'([\w.-]+)="([^"]*)"'


def _priority(pri: Column) -> dict:
    sev = pri.bitwiseAND(F.lit(7)).cast("int")
    return {
        "priority": (pri, "long"),
        "facility": (F.shiftright(pri, 3), "long"),
        "syslog_severity": (sev, "long"),
        "syslog_severity_name": lookup(SYSLOG_NAME, sev),
        "severity_ues": (lookup(SYSLOG_SEVERITY, sev), "long"),
    }


def rfc3164() -> Head:
    return Head(RFC3164_HEAD, 6, _rfc3164, _bsd_time)


def _rfc3164(g, a) -> Column:
    base = {"timestamp_raw": g(2), "hostname": g(3), "tag": g(4), "pid": F.nullif(g(5), F.lit("")), "message": F.trim(F.nullif(g(6), F.lit("")))}
    return fields_of(_priority(safe_int(g(1))) | base)


def rfc5424() -> Head:
    return Head(RFC5424_HEAD, 9, _rfc5424, lambda g, a, year: [_not_nil(g(3))], _sd_params)


def _not_nil(c: Column) -> Column:
    return F.when(c != "-", c)


def _sd_params(g) -> Column:
    ids = F.regexp_extract_all(g(8), F.lit(SD_ELEMENT), F.lit(1))
    params = F.regexp_extract_all(g(8), F.lit(SD_ELEMENT), F.lit(2))
    each = F.zip_with(
        ids,
        params,
        lambda i, p: F.zip_with(
            F.regexp_extract_all(p, F.lit(SD_PARAM), F.lit(1)),
            F.regexp_extract_all(p, F.lit(SD_PARAM), F.lit(2)),
            lambda k, v: F.struct(F.concat(F.lit("sd_"), i, F.lit("_"), k).alias("k"), v.alias("v")),
        ),
    )
    return F.map_from_entries(F.flatten(each))


def _rfc5424(g, sd: Column) -> Column:
    n = lambda i: _not_nil(g(i))
    base = {"version": (safe_int(g(2)), "long"), "timestamp_raw": n(3), "hostname": n(4), "appname": n(5), "procid": n(6), "msgid": n(7), "message": F.trim(F.nullif(g(9), F.lit("")))}
    return F.map_concat(fields_of(_priority(safe_int(g(1))) | base), strings(sd))


def json_fields(s: Column) -> Column:
    """Top-level keys with the JSON type of each value; of repeated keys the last."""

    def one(kinds: Column, k: Column, text: Column) -> Column:
        return F.struct(text.alias("v"), let(F.schema_of_variant(F.try_element_at(kinds, k)), lambda kind: tag_of(kind, text)).alias("t"))

    def tag_of(kind: Column, text: Column) -> Column:
        tag = F.when(kind == "STRING", "string").when(kind == "BIGINT", "long").when(kind == "BOOLEAN", "boolean").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "VOID", "null")
        return F.when(text.isNull(), "null").otherwise(F.coalesce(tag, F.lit("double")))

    return let(F.from_json(s, "map<string,variant>"), lambda kinds: F.transform_values(F.from_json(s, "map<string,string>"), lambda k, text: one(kinds, k, text)))


JSON_TIMES = ["ts", "timestamp", "time", "@timestamp", "event_time", "datetime"]
JSON_IPS = ["src", "dst", "src_ip", "dst_ip", "source_ip", "dest_ip"]


def json_any(s: Column) -> Column:
    return let(json_fields(s), lambda m: _json_any(s, m))


def _json_any(s: Column, m: Column) -> Column:
    at = lambda k: F.try_element_at(m, F.lit(k))
    sev = F.coalesce(at("severity"), at("level"), at("priority"))
    ues = F.when(sev["t"].isin("long", "boolean"), F.greatest(F.lit(0), F.least(F.lit(10), F.when(sev["t"] == "boolean", (sev["v"] == "true").cast("bigint")).otherwise(sev["v"].try_cast("bigint"))))).otherwise(5)
    # the first key that is there decides, even where it does not parse
    ts = F.lit(None).cast("timestamp")
    for k in reversed(JSON_TIMES):
        ts = F.when(F.map_contains_key(m, k), parse_ts(at(k)["v"])).otherwise(ts)
    return Parsed(F.map_concat(m, fields_of({"severity_ues": (ues, "long")})), ts, s.startswith("{") & s.endswith("}") & m.isNotNull())


# Service names, verbs and codes of cloud audit logs.
TRAIL_PRODUCTS = {
    "s3": "S3", "ec2": "EC2", "iam": "IAM", "rds": "RDS", "lambda": "Lambda", "sts": "STS", "cloudtrail": "CloudTrail", "kms": "KMS",
    "secretsmanager": "Secrets Manager", "guardduty": "GuardDuty",
}
TRAIL_VERBS = [
    ("network", "Get|List|Describe"), ("policy", "Create|Update|Modify|Put|Set|Attach|Add|Delete|Remove|Detach"),
    ("authentication", "Assume|Login|Logout|Auth|Console"), ("system", "Start|Stop|Terminate|Reboot|Run|Launch"),
]
TRAIL_DENIED = ["AccessDenied", "UnauthorizedAccess", "AuthFailure"]
TRAIL_TYPE = """eventVersion string, eventSource string, eventName string, eventTime string, eventType string, awsRegion string, sourceIPAddress string,
    errorCode string, errorMessage string, requestID string, eventID string, readOnly string, requestParameters string, responseElements string,
    userIdentity struct<type:string,userName:string,userId:string,arn:string,accountId:string,sessionContext:struct<sessionIssuer:struct<userName:string>>>"""


def cloudtrail(s: Column) -> Column:
    return let(F.from_json(s, TRAIL_TYPE), _cloudtrail)


def _cloudtrail(o: Column) -> Column:
    name, source = F.coalesce(o["eventName"], F.lit("")), F.coalesce(o["eventSource"], F.lit(""))
    error, user = F.nullif(o["errorCode"], F.lit("")), o["userIdentity"]
    category = F.lit("network")
    for cat, verbs in reversed(TRAIL_VERBS):
        category = F.when(name.rlike(f"^(?:{verbs})"), cat).otherwise(category)
    severity = F.when(error.isin(TRAIL_DENIED), 8).when(error.isNotNull(), 6).when((category == "policy") & name.rlike("Delete|Remove|Detach"), 7).when(category == "authentication", 4).otherwise(3)
    base = fields_of(
        {
            "vendor": F.lit("Amazon Web Services"),
            "product": F.coalesce(lookup({f"{k}.amazonaws.com": v for k, v in TRAIL_PRODUCTS.items()}, source), source),
            "event_version": o["eventVersion"],
            "event_name": name,
            "event_source": source,
            "event_type": o["eventType"],
            "aws_region": o["awsRegion"],
            "timestamp_raw": o["eventTime"],
            "src_ip": valid_ip(o["sourceIPAddress"]),
            "src_ip_raw": F.coalesce(o["sourceIPAddress"], F.lit("")),
            "username": F.coalesce(F.nullif(user["userName"], F.lit("")), F.nullif(user["userId"], F.lit("")), user["sessionContext"]["sessionIssuer"]["userName"]),
            "user_identity_type": user["type"],
            "user_arn": user["arn"],
            "account_id": user["accountId"],
            "error_code": error,
            "error_message": o["errorMessage"],
            "request_id": o["requestID"],
            "event_id": o["eventID"],
            "read_only": (o["readOnly"], "boolean"),
            "category": category,
            "severity_numeric": (severity, "long"),
            "outcome": F.when(error.isNull(), "success").otherwise("failure"),
            "action": name,
            "message": F.concat(F.lit("AWS "), name, F.lit(" on "), source, F.coalesce(F.concat(F.lit(" [ERROR: "), error, F.lit("]")), F.lit(""))),
            "_request_params": F.coalesce(o["requestParameters"], F.lit("{}")),
            "_response_elements": F.coalesce(o["responseElements"], F.lit("{}")),
        }
    )
    return Parsed(base, parse_ts(o["eventTime"]), o["eventVersion"].isNotNull())


AZURE_CATEGORY = {
    "Administrative": "policy", "Security": "threat", "ServiceHealth": "system", "Alert": "threat", "Recommendation": "policy", "Policy": "policy",
    "Autoscale": "system", "ResourceHealth": "system", "SignIn": "authentication", "AuditLogs": "authentication", "NonInteractiveUserSignInLogs": "authentication",
    "ServicePrincipalSignInLogs": "authentication", "ManagedIdentitySignInLogs": "authentication",
}
AZURE_OUTCOME = {"Success": "success", "Succeeded": "success", "Start": "unknown", "Accept": "success", "Failed": "failure", "Failure": "failure", "Canceled": "failure", "Rejected": "failure"}
AZURE_VERBS = {"delete": 8, "remove": 7, "disable": 7, "deny": 8, "write": 5, "create": 5, "update": 5, "modify": 5, "read": 3, "list": 2, "get": 2}
AZURE_TYPE = """operationName string, resourceId string, resultType string, category string, time string, `timestamp` string, resultSignature string,
    resultDescription string, callerIpAddress string, callerDisplayName string, correlationId string, operationId string, properties map<string,string>,
    identity struct<caller:string,claims:struct<name:string,upn:string,unique_name:string,tid:string>>"""


def azure(s: Column) -> Column:
    return let(F.from_json(s, AZURE_TYPE), _azure)


def _azure(o: Column) -> Column:
    op, result = F.coalesce(o["operationName"], F.lit("")), F.coalesce(o["resultType"], F.lit(""))
    claims, res = o["identity"]["claims"], azure_resource(o["resourceId"])
    verbs = F.lit(4)
    for verb, sev in reversed(AZURE_VERBS.items()):
        verbs = F.when(F.lower(op).endswith(verb), sev).otherwise(verbs)
    raw_ts = F.coalesce(F.nullif(o["time"], F.lit("")), o["timestamp"])
    nn = lambda c: F.nullif(c, F.lit(""))
    base = fields_of(
        {
            "vendor": F.lit("Microsoft"),
            "product": F.lit("Azure Monitor"),
            "timestamp_raw": raw_ts,
            "operation_name": op,
            "action": F.when(op == "", "unknown").otherwise(F.substring_index(op, "/", -1)),
            "resource_id": F.coalesce(o["resourceId"], F.lit("")),
            "az_category": F.coalesce(o["category"], F.lit("")),
            "result_type": result,
            "result_signature": o["resultSignature"],
            "result_description": o["resultDescription"],
            "src_ip": valid_ip(F.substring_index(o["callerIpAddress"], ":", 1)),
            "username": F.coalesce(nn(claims["name"]), nn(claims["upn"]), nn(claims["unique_name"]), nn(o["callerDisplayName"]), o["identity"]["caller"]),
            "category": F.coalesce(lookup(AZURE_CATEGORY, o["category"]), F.lit("policy")),
            "outcome": F.coalesce(lookup(AZURE_OUTCOME, result), F.lit("unknown")),
            "severity_numeric": (F.when(F.lower(result).rlike("failed|failure"), 7).otherwise(verbs), "long"),
            "message": F.concat(F.lit("Azure "), op, F.lit(" ["), result, F.lit("]")),
            "correlation_id": o["correlationId"],
            "operation_id": o["operationId"],
            "tenant_id": claims["tid"],
        }
    )
    parts = F.map_filter(fields_of({k: res[k] for k in ("subscription_id", "resource_group", "provider", "resource_type", "resource_name")}), lambda k, v: v["v"].isNotNull())
    props = F.transform_keys(strings(F.coalesce(o["properties"], F.create_map().cast("map<string,string>"))), lambda k, v: F.concat(F.lit("properties."), k))
    return Parsed(F.map_concat(props, base, parts), parse_ts(raw_ts), o["operationName"].isNotNull() | o["resourceId"].isNotNull())


GCP_METHODS = {
    "storage.": "network", "compute.": "network", "iam.": "authentication", "admin.": "policy", "cloudresourcemanager.": "policy", "container.": "system",
    "sqladmin.": "system", "logging.": "system", "cloudkms.": "policy", "secretmanager.": "policy",
}
GCP_FAILED = [1, 3, 5, 6, 7, 9, 13, 16]
GCP_TYPE = """logName string, severity string, insertId string, `timestamp` string, protoPayload struct<methodName:string,resourceName:string,serviceName:string,
    authenticationInfo:struct<principalEmail:string>,requestMetadata:struct<callerIp:string,callerSuppliedUserAgent:string>,
    status:struct<code:int,message:string>,authorizationInfo:array<struct<granted:boolean>>>"""


def gcp(s: Column) -> Column:
    return let(F.from_json(s, GCP_TYPE), _gcp)


def _gcp(o: Column) -> Column:
    p = o["protoPayload"]
    method, log = F.coalesce(p["methodName"], F.lit("")), F.coalesce(o["logName"], F.lit(""))
    low, code = F.lower(method), p["status"]["code"]
    category = F.when(low.rlike("login|auth|signin|token"), "authentication").otherwise("network")
    for prefix, cat in reversed(GCP_METHODS.items()):
        category = F.when(low.startswith(prefix), cat).otherwise(category)
    given = F.coalesce(o["severity"], F.lit("NOTICE"))
    severity = F.coalesce(lookup(GCP_SEVERITY, given), F.lit(4))
    granted = F.coalesce(F.forall(p["authorizationInfo"], lambda a: F.coalesce(a["granted"], F.lit(True))), F.lit(True))
    caller, email = F.coalesce(p["requestMetadata"]["callerIp"], F.lit("")), F.coalesce(p["authenticationInfo"]["principalEmail"], F.lit(""))
    project = group(log, r"(?:^|/)projects/([^/]*)", 1)
    base = fields_of(
        {
            "vendor": F.lit("Google"),
            "product": F.lit("Google Cloud Platform"),
            "timestamp_raw": o["timestamp"],
            "method_name": method,
            "action": F.when(method == "", "unknown").otherwise(F.substring_index(method, ".", -1)),
            "resource_name": F.coalesce(p["resourceName"], F.lit("")),
            "principal_email": email,
            "username": email,
            "src_ip": valid_ip(F.substring_index(caller, ":", 1)),
            "caller_ip_raw": caller,
            "user_agent": p["requestMetadata"]["callerSuppliedUserAgent"],
            "status_code": (code, "long"),
            "status_message": p["status"]["message"],
            "gcp_severity": given,
            "severity_numeric": (F.when(code.isin(7, 16), F.greatest(severity, F.lit(8))).otherwise(severity), "long"),
            "category": category,
            "outcome": F.when(F.coalesce(code, F.lit(0)) == 0, "success").when(code.isin(GCP_FAILED), "failure").otherwise("unknown"),
            "authorization_granted": (granted, "boolean"),
            "project_id": project,
            "log_name": log,
            "log_type": F.when(log.contains("logs/"), F.substring_index(F.substring_index(log, "logs/", -1), "%2F", -1)),
            "insert_id": o["insertId"],
            "service_name": p["serviceName"],
            "message": F.concat(F.lit("GCP "), method, F.lit(" ["), given, F.lit("]"), F.when(granted, "").otherwise(" DENIED")),
        }
    )
    return Parsed(base, parse_ts(o["timestamp"]), p.isNotNull())


# Id, category, severity, action and description of known Windows events.
WINDOWS_EVENTS = [
    (4624, "authentication", 3, "logon_success", "An account was successfully logged on"),
    (4625, "authentication", 7, "logon_failure", "An account failed to log on"),
    (4634, "authentication", 3, "logoff", "An account was logged off"),
    (4647, "authentication", 3, "logoff", "User initiated logoff"),
    (4648, "authentication", 6, "logon_explicit", "Logon using explicit credentials"),
    (4649, "authentication", 8, "replay_attack", "A replay attack was detected"),
    (4675, "authentication", 5, "sid_filter", "SIDs were filtered"),
    (4768, "authentication", 3, "kerberos_tgt", "Kerberos TGT was requested"),
    (4769, "authentication", 3, "kerberos_service", "Kerberos service ticket was requested"),
    (4771, "authentication", 7, "kerberos_fail", "Kerberos pre-authentication failed"),
    (4776, "authentication", 5, "ntlm_auth", "NTLM authentication attempted"),
    (4720, "authentication", 7, "user_created", "A user account was created"),
    (4722, "authentication", 5, "user_enabled", "A user account was enabled"),
    (4723, "authentication", 6, "password_change", "An attempt was made to change a password"),
    (4724, "authentication", 7, "password_reset", "Password reset attempted"),
    (4725, "authentication", 7, "user_disabled", "A user account was disabled"),
    (4726, "authentication", 8, "user_deleted", "A user account was deleted"),
    (4728, "policy", 7, "group_member_add", "Member added to security-enabled global group"),
    (4732, "policy", 7, "group_member_add", "Member added to security-enabled local group"),
    (4738, "authentication", 6, "user_modified", "A user account was changed"),
    (4670, "policy", 7, "permission_change", "Permissions on an object were changed"),
    (4698, "policy", 8, "task_created", "A scheduled task was created"),
    (4699, "policy", 9, "task_deleted", "A scheduled task was deleted"),
    (4702, "policy", 7, "task_updated", "A scheduled task was updated"),
    (4703, "policy", 6, "right_adjusted", "A user right was adjusted"),
    (4704, "policy", 7, "right_assigned", "A user right was assigned"),
    (4705, "policy", 7, "right_removed", "A user right was removed"),
    (4616, "system", 4, "time_changed", "System time was changed"),
    (4657, "system", 6, "registry_modified", "A registry value was modified"),
    (4688, "system", 4, "process_start", "A new process was created"),
    (4689, "system", 3, "process_stop", "A process has exited"),
    (4697, "system", 4, "service_install", "A service was installed in the system"),
    (7045, "system", 4, "service_install", "New service installed"),
    (16384, "system", 4, "service_spp", "Software Protection service update"),
    (15, "system", 4, "security_product_state", "Security Center state update"),
    (5140, "network", 5, "share_access", "A network share object was accessed"),
    (5145, "network", 5, "share_check", "A network share object was checked"),
    (5156, "network", 3, "connection_permit", "Windows Filtering Platform connection permitted"),
    (5157, "network", 5, "connection_block", "Windows Filtering Platform connection blocked"),
    (1102, "threat", 9, "audit_cleared", "The audit log was cleared"),
    (4713, "threat", 8, "policy_changed", "Kerberos policy was changed"),
    (4765, "threat", 8, "sid_history_add", "SID History was added to an account"),
    (4766, "threat", 8, "sid_history_fail", "Attempt to add SID History to an account failed"),
]
WINDOWS_TYPE = """System struct<EventID:string,Level:string,Computer:string,Channel:string,Provider:struct<_Name:string,_Guid:string>,TimeCreated:struct<_SystemTime:string>>,
    EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>"""


def event_dim(spark) -> DataFrame:
    """The table of known Windows events, a fixed few dozen rows."""
    return spark.createDataFrame(WINDOWS_EVENTS, "event_id_num int, category string, severity int, action string, description string")


def join_event_dim(df: DataFrame, dim: DataFrame) -> DataFrame:
    return df.join(F.broadcast(dim), "event_id_num", "left")


def _dim_value(i: int, key: Column, kind: str) -> Column:
    return lookup({e[0]: e[i] for e in WINDOWS_EVENTS}, key.try_cast("int")).cast(kind)


def windows_xml(s: Column) -> Column:
    """A Windows event; a DOCTYPE is refused before parsing."""
    safe = F.when(~s.rlike(r"(?i)<!DOCTYPE"), F.regexp_replace(s, r"\sxmlns(?::\w+)?=(?:'[^']*'|\"[^\"]*\")", ""))
    x = F.from_xml(safe, WINDOWS_TYPE, {"attributePrefix": "_", "valueTag": "_VALUE", "rowTag": "Event"})
    return let(x, _windows)


def _windows(x: Column) -> Column:
    sys, data = x["System"], x["EventData"]["Data"]
    named = F.filter(data, lambda d: d["_Name"].isNotNull())
    d = F.map_from_entries(F.transform(named, lambda e: F.struct(e["_Name"].alias("k"), F.trim(F.coalesce(e["_VALUE"], F.lit(""))).alias("v"))))
    return let(F.coalesce(d, F.create_map().cast("map<string,string>")), lambda m: _windows_fields(sys, m))


def _windows_fields(sys: Column, d: Column) -> Column:
    first = lambda *ks: F.coalesce(*[F.nullif(F.try_element_at(d, F.lit(k)), F.lit("")) for k in ks])
    eid = safe_int(sys["EventID"])
    process = first("NewProcessName", "ProcessName")
    name = win_basename(process)
    action = F.when(_dim_value(3, eid, "string").isNotNull(), F.coalesce(first("Action"), _dim_value(3, eid, "string")))
    desc = F.when(action.isNotNull() & process.isNotNull(), F.concat(F.lit("Process: "), name, F.lit(" ("), action, F.lit(")"))).when(action.isNotNull(), _dim_value(4, eid, "string"))
    level = F.trim(F.coalesce(sys["Level"], F.lit("")))
    known = _dim_value(2, eid, "int")
    some = F.coalesce(known, F.lit(5))
    sev = (
        F.when(level.isin("4", "5", "0") & ~F.coalesce(eid.isin(1102, 4649), F.lit(False)), F.least(some, F.lit(4)))
        .when(level == "1", F.greatest(some, F.lit(8)))
        .when(level == "2", F.greatest(some, F.lit(7)))
        .when(level == "3", F.greatest(some, F.lit(5)))
        .otherwise(known)
    )
    proto = F.lower(F.trim(first("ProtocolName", "Protocol")))
    dst = valid_ip(first("DestAddress", "DestinationAddress", "DestinationIpAddress", "TargetAddress"))
    raw_ts = sys["TimeCreated"]["_SystemTime"]
    base = fields_of(
        {
            "windows_event_id": (eid, "long"),
            "TimeCreated.SystemTime": raw_ts,
            "Provider.Name": sys["Provider"]["_Name"],
            "Provider.Guid": sys["Provider"]["_Guid"],
            "Computer": F.trim(sys["Computer"]),
            "Channel": F.trim(sys["Channel"]),
            "Level": level,
            "is_windows_event_log": (F.lit(True), "boolean"),
            "vendor": F.lit("Microsoft"),
            "product": F.lit("Windows"),
            "process_name": F.when(process.isNotNull(), name),
            "process_path": process,
            "category": _dim_value(1, eid, "string"),
            "severity_numeric": (sev, "long"),
            "action": action,
            "event_description": desc,
            "src_ip": valid_ip(first("IpAddress", "SourceAddress", "CallerIPAddress")),
            "src_port": (safe_port(first("SourcePort", "IpPort")), "long"),
            "dst_ip": dst,
            "dst_port": (safe_port(first("DestPort", "DestinationPort", "TargetPort")), "long"),
            "protocol": F.when(proto.isin("6", "tcp"), "tcp").when(proto.isin("17", "udp"), "udp").otherwise(proto),
            "direction": F.coalesce(first("Direction"), F.when(dst.isNotNull(), "outbound")),
            "username": first("SubjectUserName", "TargetUserName", "AccountName"),
            "hostname": F.coalesce(blank_to_null(sys["Computer"]), first("WorkstationName")),
            "timestamp_raw": raw_ts,
            "message": F.coalesce(desc, first("Message"), F.concat(F.lit("Windows Event ID "), F.coalesce(eid.cast("string"), F.lit("unknown")))),
        }
    )
    prefixed = F.transform_keys(strings(d), lambda k, v: F.concat(F.lit("EventData."), k))
    return Parsed(F.map_concat(base, prefixed), parse_ts(raw_ts), sys.isNotNull())


def generic_xml(c: Column) -> Column:
    """Dotted keys of any XML document, by an Arrow batch function: its shape is not known.
    Null where it does not parse or has a DOCTYPE."""
    @F.pandas_udf("map<string,string>")
    def flat(texts: pd.Series) -> pd.Series:
        import re
        from xml.etree import ElementTree

        bare = lambda tag: tag.rsplit("}", 1)[-1]

        def one(text):
            if text is None or re.search("<!DOCTYPE", text, re.I):
                return None
            try:
                todo, out = [(ElementTree.fromstring(text.strip()), "")], {}
            except ElementTree.ParseError:
                return None
            while todo:
                node, above = todo.pop()
                key = f"{above}.{bare(node.tag)}" if above else bare(node.tag)
                out |= {f"{key}.{bare(k)}": v for k, v in node.attrib.items()}
                if (node.text or "").strip():
                    out[key] = node.text.strip()
                todo += [(child, key) for child in reversed(node)]
            return out

        return texts.map(one)

    return flat(c)


def extract_generic_xml(df: DataFrame, line: str = "line") -> DataFrame:
    m = generic_xml(F.col(line))
    df = df.withColumn("_m", m)
    return df.withColumn("extracted", strings(F.col("_m"))).withColumn("event_ts", null_ts()).withColumn("parse_error", F.when(F.col("_m").isNull(), "not XML")).drop("_m")


FORMATS: dict[str, Head | Callable] = {
    "cef": cef(),
    "leef": leef(),
    "cisco_asa": cisco_asa(),
    "paloalto_csv": paloalto,
    "syslog_rfc3164": rfc3164(),
    "syslog_rfc5424": rfc5424(),
    "json_passthrough": json_any,
    "aws_cloudtrail": cloudtrail,
    "azure_monitor": azure,
    "gcp_audit": gcp,
    "xml_generic": windows_xml,
}
#: What the formats record as the log format of their source.
LOG_FORMAT = {"cisco_asa": "syslog_rfc3164", "paloalto_csv": "csv", "json_passthrough": "json", "aws_cloudtrail": "json", "azure_monitor": "json", "gcp_audit": "json", "xml_generic": "xml"}


def extract(df: DataFrame, reference_year: int = 2026, formats: list[str] | None = None, declarative: list | None = None) -> DataFrame:
    """Adds extracted, event_ts and parse_error by format_id. ``formats`` limits the branches
    to those that the table has, which shortens the plan."""
    s, fid = F.btrim(F.col("line"), F.lit(" \t\r\n")), F.col("format_id")
    picked = {k: FORMATS[k] for k in formats or FORMATS}
    heads = {k: f for k, f in picked.items() if isinstance(f, Head)}
    g, a = lambda i: F.coalesce(F.get("_g", F.lit(i)), F.lit("")), F.col("_a")

    def by_head(kind: str, make) -> Column:
        out = F.lit(None).cast(kind)
        for k, h in heads.items():
            c = make(h)
            out = out if c is None else F.when(fid == k, c).otherwise(out)
        return out

    df = once(df, {"_g": by_head("array<string>", lambda h: groups(s, h))})
    df = once(df, {"_a": by_head("map<string,string>", lambda h: h.attributes(g) if h.attributes else None)})
    df = once(df, {"_time": by_head("string", lambda h: F.trim(F.coalesce(*h.times(g, a, reference_year))))})

    def parsed_head(h: Head) -> Column:
        others = [F.when(t.isNotNull(), parse_ts(t)) for t in h.times(g, a, reference_year)[1:]]  # where the first does not parse
        return Parsed(h.fields(g, a), F.coalesce(null_ts(), *others), F.size("_g") == h.n + 2)

    chosen = {k: parsed_head(f) if k in heads else f(s) for k, f in picked.items()}
    for rule in declarative or []:
        chosen[rule.name] = rule.parsed(s)
    for name, _, fn in REGISTERED:
        chosen[name] = Parsed(strings(fn(F.col("line"))), null_ts(), F.lit(True))
    parsed = F.lit(None)
    for k, p in chosen.items():
        parsed = F.when(fid == k, p).otherwise(parsed)
    df = once(df, {"_p": parsed, "_ts": parse_trimmed(F.col("_time"))})
    ok = F.col("_p.ok")
    cause = F.when(~fid.isin(list(chosen)), F.concat(F.lit("no parser for format: "), fid)).when(~ok, F.concat(F.lit("not a valid line of format: "), fid))
    return df.withColumns({"extracted": F.when(ok, F.col("_p.fields")), "event_ts": F.when(ok, F.coalesce("_ts", "_p.ts")), "parse_error": cause}).drop("_p", "_ts", "_g", "_a", "_time")
