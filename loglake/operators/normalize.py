"""Normalisation: extracted fields become the blocks of the event schema, by rules."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.functions.scalars import once
from loglake.operators.extract import LOG_FORMAT, lookup
from loglake.schema import CATEGORIES, DIRECTIONS, FIELDS, SCHEMA_VERSION

RULESET = "1.2.0"

# Outcomes of actions, words of categories in order, classes and activities.
ACTION_OUTCOME = {k: "success" for k in ("allow", "permit", "permitted", "accept", "success")} | {k: "failure" for k in ("deny", "denied", "block", "drop", "reject", "reset", "fail", "failure")}
CATEGORY_WORDS = {
    "authentication": ["login", "logon", "auth", "vpn", "ssh", "rdp", "kerberos", "ldap", "password"],
    "threat": ["malware", "virus", "exploit", "attack", "intrusion", "alert", "ids", "ips", "threat", "scan", "flood", "dos", "ddos"],
    "policy": ["acl", "policy", "rule", "compliance", "violation"],
    "system": ["system", "config", "startup", "shutdown", "cpu", "memory", "interface up", "interface down"],
    "network": ["tcp", "udp", "icmp", "traffic", "connection", "session", "nat", "routing"],
}
CATEGORY_FIELDS = ["message", "Name", "tag", "app", "event", "asa_mnemonic"]
OCSF_CLASS = {
    "network": ("Network Activity", 4001), "authentication": ("Authentication", 3001), "threat": ("Security Finding", 2001), "system": ("System Activity", 1001),
    "policy": ("Policy Activity", 5001), "api": ("API Activity", 6003), "database": ("Database Activity", 6004), "unknown": ("Base Event", 1),
}
OCSF_ACTIVITY = {
    "logon": ("Logon", 1), "login": ("Logon", 1), "logoff": ("Logoff", 2), "logout": ("Logoff", 2), "connect": ("Connect", 1), "permit": ("Permit", 2),
    "permitted": ("Permit", 2), "allow": ("Allow", 2), "deny": ("Deny", 3), "denied": ("Deny", 3), "block": ("Block", 3), "drop": ("Drop", 4),
    "query": ("Query", 5), "create": ("Create", 1), "delete": ("Delete", 3),
}
OUTSIDE = "outside|untrust|external"

# For each format the fields that feed the event, in the order of TARGETS.
TARGETS = [
    "source.vendor", "source.product", "source.device_hostname", "source.source_ip",
    "event.category", "event.action", "event.outcome", "event.severity_numeric", "event.severity_original", "event.event_type_vendor_specific",
    "network.src_ip", "network.src_port", "network.dst_ip", "network.dst_port", "network.protocol", "network.bytes_in", "network.bytes_out", "network.direction", "network.interface",
    "identity.username", "identity.user_domain", "rule.rule_id", "rule.rule_name", "rule.policy_action",
]
PICKED = [k for k in TARGETS if k not in ("event.category", "event.action")]
#: Fields that no target names, but of which members are made.
OTHERS = ["severity_ues", "event_type_vendor_specific", "src_zone", "dst_zone"]
_BY_WORDS, _BY_ACTION, _BY_ZONES = "_category_default:network", "_outcome_from_action", "_direction_from_zones"
_NET9 = [None] * 9
_RULES = {
    "cef": ["DeviceVendor", "DeviceProduct", "dhost", "dvc", _BY_WORDS, "act", _BY_ACTION, "severity_ues", "Severity", "SignatureID", "src", "spt", "dst", "dpt", "proto", "in", "out", "deviceDirection", "deviceInboundInterface", "suser", None, "SignatureID", "Name", "act"],
    "leef": ["vendor", "product", None, None, _BY_WORDS, "action", _BY_ACTION, "severity_numeric", "severity_raw", "event_id", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "bytes_in", "bytes_out", None, None, "username", "domain", "event_id", None, "action"],
    "cisco_asa": ["vendor", "product", "hostname", None, _BY_WORDS, "acl_action", _BY_ACTION, "severity_ues", "asa_severity_name", "asa_mnemonic", "src_ip", "src_port", "dst_ip", "dst_port", "proto", None, None, None, None, None, None, "asa_mnemonic", "acl_name", "acl_action"],
    "paloalto_csv": ["vendor", "product", None, None, _BY_WORDS, "action_ues", _BY_ACTION, "severity_ues", "action_raw", "app", "src_ip", "src_port", "dst_ip", "dst_port", "proto", "bytes_received", "bytes_sent", _BY_ZONES, "inbound_if", "src_user", None, None, "rule", "action_ues"],
    "syslog_rfc3164": [None, None, "hostname", None, _BY_WORDS, None, None, "severity_ues", "syslog_severity_name", "tag", *_NET9, None, None, None, None, None],
    "syslog_rfc5424": [None, None, "hostname", None, _BY_WORDS, None, None, "severity_ues", "syslog_severity_name", "msgid", *_NET9, None, None, None, None, None],
    "json_passthrough": [None, None, "host", None, _BY_WORDS, "event", "result", "severity_ues", None, "event", "src", "src_port", "dst", "dst_port", "proto", "bytes_in", "bytes_out", None, None, "user", "domain", None, None, None],
    "aws_cloudtrail": ["vendor", "product", "aws_region", "src_ip", "category", "action", "outcome", "severity_numeric", None, "event_name", "src_ip", *_NET9[1:], "username", "account_id", "request_id", "event_name", "action"],
    "azure_monitor": ["vendor", "product", None, "src_ip", "category", "action", "outcome", "severity_numeric", "result_type", "operation_name", "src_ip", *_NET9[1:], "username", "tenant_id", "operation_id", "operation_name", "action"],
    "gcp_audit": ["vendor", "product", "project_id", "src_ip", "category", "action", "outcome", "severity_numeric", "gcp_severity", "method_name", "src_ip", *_NET9[1:], "username", None, "insert_id", "method_name", "action"],
    "xml_generic": ["_literal:Microsoft", "_literal:Windows Event Log", "hostname", None, "category", "action", _BY_ACTION, "severity_numeric", None, "windows_event_id", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", None, None, "direction", None, "username", None, "windows_event_id", "event_description", None],
}
MAPPINGS: dict[str, dict[str, str | None]] = {k: dict(zip(TARGETS, v)) for k, v in _RULES.items()}


def load_mappings(path: str) -> dict[str, dict[str, str | None]]:
    """Mapping rules from a folder of YAML files: blocks of target: specification."""
    import pathlib

    import yaml

    out = {}
    for f in sorted(pathlib.Path(path).glob("*.yaml")):
        rules = yaml.safe_load(f.read_text(encoding="utf-8")) or {}
        out[f.stem] = {f"{block}.{k}": v for block, body in rules.items() if isinstance(body, dict) for k, v in body.items()}
    return out


def raw_field(name: str) -> Column:
    return F.try_element_at(F.col("extracted"), F.lit(name))


def field(name: str) -> Column:
    return raw_field(name)["v"]


def compile_spec(spec: str | None) -> Column:
    """A specification as a column: a field, or _literal, _upper, _lower, _strip, _first, _split, _default."""
    s = "" if spec is None else str(spec).strip()
    if s in ("", "null", "none", "~"):
        return F.lit(None).cast("string")
    op, _, body = s.partition(":")
    if op == "_literal":
        return F.lit(body)
    if op in ("_upper", "_lower", "_strip"):
        return {"_upper": F.upper, "_lower": F.lower, "_strip": F.trim}[op](field(body.strip()))
    if op == "_first":
        return F.coalesce(F.lit(None).cast("string"), *[F.when(F.trim(field(c.strip())) != "", field(c.strip())) for c in body.split(",") if c.strip()])
    if op == "_split":
        rest, _, i = body.rpartition(",")
        name, comma, delim = rest.partition(",")
        if not comma or not i.strip().isdigit():
            return F.lit(None).cast("string")
        return F.trim(F.try_element_at(F.split(field(name.strip()), re.escape(delim), -1), F.lit(int(i) + 1)))
    if op == "_default":
        name, _, other = body.partition(",")
        return F.when(F.trim(field(name.strip())) != "", field(name.strip())).otherwise(other.strip())
    return field(s)


def searchable() -> Column:
    """The fields in which words of categories are looked for."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(field(c), F.lit("")) for c in CATEGORY_FIELDS]))


def infer_category(text: Column, default: str) -> Column:
    """The first category of which a word occurs in ``searchable`` text."""
    chain = F.when(F.lit(False), F.lit(""))
    for cat, words in CATEGORY_WORDS.items():
        chain = chain.when(reduce(or_, [text.contains(w) for w in words]), cat)
    return chain.otherwise(default)


def outcome_of(c: Column) -> Column:
    return F.coalesce(lookup(ACTION_OUTCOME, F.lower(F.trim(c))), F.lit("unknown"))


def direction_of(src: Column, dst: Column) -> Column:
    s, d = F.lower(F.coalesce(src, F.lit(""))), F.lower(F.coalesce(dst, F.lit("")))
    return F.when(s.rlike(OUTSIDE), "inbound").when(d.rlike(OUTSIDE), "outbound").when((s != "") & (s == d), "internal").otherwise("unknown")


def severity_of(c: Column) -> tuple[Column, Column]:
    """Severity within 0 to 10, and whether it had to be inferred."""
    n = F.trim(c).try_cast("double")
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(10.0), n)), F.lit(5.0)), n.isNull()


def ocsf_tags(category: Column, action: Column, vendor_type: Column) -> dict[str, Column]:
    key = F.coalesce(action, F.lower(vendor_type), F.lit(""))
    return {
        "class_name": F.coalesce(lookup({k: v[0] for k, v in OCSF_CLASS.items()}, category), F.lit("Base Event")),
        "class_uid": F.coalesce(lookup({k: v[1] for k, v in OCSF_CLASS.items()}, category), F.lit(1)),
        "activity_name": F.coalesce(lookup({k: v[0] for k, v in OCSF_ACTIVITY.items()}, key), F.concat(F.upper(F.left(action, F.lit(1))), F.lower(F.substr(action, F.lit(2))))),
        "activity_id": lookup({k: v[1] for k, v in OCSF_ACTIVITY.items()}, key),
    }


def block(members: dict[str, Column]) -> Column:
    """A struct; null when all its members are."""
    return F.when(F.coalesce(*[c.cast("string") for c in members.values()]).isNotNull(), F.struct(*[c.alias(k) for k, c in members.items()]))


def whole(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("bigint"))


def _pick(mappings: dict[str, dict], target: str, make=compile_spec) -> Column:
    """One expression for a target: the value by format."""
    by_spec: dict = {}
    for fmt, m in mappings.items():
        by_spec.setdefault(m.get(target), []).append(fmt)
    out = F.lit(None).cast("string")
    for spec, fmts in by_spec.items():
        if spec is not None:
            out = F.when(F.col("format_id").isin(fmts), make(spec)).otherwise(out)
    return out


def _bases(df: DataFrame, mappings: dict[str, dict]) -> DataFrame:
    """Adds _action, _cat and _bag, from which several members of the blocks are made, and
    _picked, the values of all other targets, as columns: a lookup in the fields goes through their
    keys, and members use their values more than once."""

    def category(spec: str) -> Column:
        return infer_category(F.col("_words"), spec.split(":", 1)[1]) if spec.startswith("_category_default:") else F.coalesce(compile_spec(spec), F.lit("unknown"))

    def plain(spec: str) -> Column:
        return F.lit(None).cast("string") if spec in (_BY_ACTION, _BY_ZONES) else compile_spec(spec)

    picked = {k: _pick(mappings, k, plain) for k in PICKED} | {k: field(k) for k in OTHERS}
    df = once(df, {"_words": searchable(), "_action": F.nullif(_pick(mappings, "event.action"), F.lit("")), "_picked": F.struct(*[c.alias(k.replace(".", "_")) for k, c in picked.items()])})
    return once(df, {"_cat": _pick(mappings, "event.category", category), "_bag": vendor_attributes(mappings)}).drop("_words")


def _blocks(mappings: dict[str, dict]) -> dict[str, dict[str, Column]]:
    text = {k: F.col(f"_picked.{k.replace('.', '_')}") for k in (*PICKED, *OTHERS)}
    given_by = lambda target, spec, other: F.when(F.col("format_id").isin([k for k, m in mappings.items() if m.get(target) == spec]), other).otherwise(text[target])
    cat = F.when(F.col("_cat").isin(CATEGORIES), F.col("_cat")).otherwise("unknown")
    action_raw = F.col("_action")
    action = F.lower(action_raw)
    given = F.nullif(given_by("event.outcome", _BY_ACTION, outcome_of(action_raw)), F.lit(""))
    outcome = F.when(given.isin("unknown"), "unknown").when(given.isNotNull(), outcome_of(given))
    severity, inferred = severity_of(F.coalesce(text["event.severity_numeric"], text["severity_ues"]))
    kind = F.nullif(text["event.event_type_vendor_specific"], F.lit(""))
    way = given_by("network.direction", _BY_ZONES, direction_of(text["src_zone"], text["dst_zone"]))
    return {
        "source": {k: text[f"source.{k}"] for k in ("vendor", "product", "device_hostname", "source_ip")},
        "event": {
            "category": cat,
            **ocsf_tags(cat, action, text["event_type_vendor_specific"]),
            "action": action,
            "outcome": outcome,
            "severity_numeric": severity,
            "severity_original": text["event.severity_original"],
            "severity_inferred": inferred,
            "event_type_vendor_specific": kind,
        },
        "network": {
            "src_ip": text["network.src_ip"],
            "src_port": whole(text["network.src_port"]),
            "dst_ip": text["network.dst_ip"],
            "dst_port": whole(text["network.dst_port"]),
            "protocol": F.lower(text["network.protocol"]),
            "bytes_in": whole(text["network.bytes_in"]),
            "bytes_out": whole(text["network.bytes_out"]),
            "direction": F.when(way.isin(DIRECTIONS), way).when(way.isNotNull(), "unknown"),
            "interface": text["network.interface"],
        },
        "identity": {k: text[f"identity.{k}"] for k in ("username", "user_domain")},
        "rule": {"rule_id": F.nullif(text["rule.rule_id"], F.lit("")), "rule_name": text["rule.rule_name"], "policy_action": text["rule.policy_action"]},
    }


def _unmapped(used: list[str]):
    return lambda k, v: ~k.isin(used) & ~k.startswith("_")


def vendor_attributes(mappings: dict[str, dict]) -> Column:
    """Fields that no rule names directly, by format; keys with an underscore in front stay out."""
    out = F.lit(None).cast(FIELDS)
    for fmt, m in mappings.items():
        used = ["timestamp_raw", "timestamp_dt", *{v for v in m.values() if v and not v.startswith("_")}]
        out = F.when(F.col("format_id") == fmt, F.map_filter("extracted", _unmapped(used))).otherwise(out)
    return out


def normalize(df: DataFrame, mappings: dict[str, dict] | None = None, declarative: list | None = None, formats: list[str] | None = None) -> DataFrame:
    """Adds the blocks source, event, network, identity, rule and vendor_attributes. ``formats``
    limits the rules to those of formats that the table has, which shortens the plan."""
    rules = mappings or MAPPINGS
    rules = {k: v for k, v in rules.items() if k in (formats or rules)}
    df, b = _bases(df, rules), _blocks(rules)
    log_format = F.coalesce(lookup(LOG_FORMAT, F.col("format_id")), F.col("format_id"))
    source = F.struct(*[c.alias(k) for k, c in b["source"].items()], log_format.alias("log_format"))
    event = F.struct(*[c.alias(k) for k, c in b["event"].items()])
    out = {"source": source, "event": event, **{k: block(b[k]) for k in ("network", "identity", "rule")}, "vendor_attributes": F.when(F.size("_bag") > 0, F.col("_bag"))}
    for rule in declarative or []:
        own = rule.normalized()
        out = {k: F.when(F.col("format_id") == rule.name, own[k]).otherwise(c) for k, c in out.items()}
    return once(df, out).drop("_action", "_cat", "_bag", "_picked")


def to_ues(df: DataFrame) -> DataFrame:
    """The event envelope with its lineage, from a normalised table with ids and hashes."""
    from loglake.functions.scalars import iso
    from loglake.schema import event_schema

    empty = {f.name: F.lit(None).cast(f.dataType) for f in event_schema() if f.name in ("enrichment", "analytics")}
    cols = {
        "schema_version": F.lit(SCHEMA_VERSION),
        "tenant_id": F.col("tenant_id"),
        "event_id": F.col("event_id"),
        "ingest_timestamp": iso(F.col("ingest_ts")),
        "source_event_timestamp": iso(F.col("event_ts")),
        "raw": F.struct(F.col("line").alias("raw_payload"), F.col("source.log_format").alias("raw_format"), F.col("raw_hash")),
        **{k: F.col(k) for k in ("source", "event", "network", "identity", "rule", "vendor_attributes")},
        **empty,
        "lineage": F.struct(F.col("format_id").alias("parser_name"), F.lit("1.0.0").alias("parser_version"), F.lit(RULESET).alias("normalization_ruleset_version")),
    }
    order = [f.name for f in event_schema()]
    extra = [c for c in ("source_tag", "seq", "ingest_ts", "event_ts") if c in df.columns]
    return df.select(*[cols[k].alias(k) for k in order], *extra)
