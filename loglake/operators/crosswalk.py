"""Translations of events to other taxonomies, as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.functions.scalars import safe_key
from loglake.operators.extract import lookup
from loglake.operators.sinks import COMPACT
from loglake.schema import EVENT_DDL

# Class id and name, category id and name of each category.
OCSF_CLASSES = {
    "network": (4001, "Network Activity", 4, "Network Activity"),
    "authentication": (3001, "Authentication", 3, "Identity & Access Management"),
    "threat": (2001, "Security Finding", 2, "Findings"),
    "system": (1001, "System Activity", 1, "System Activity"),
    "policy": (5001, "Policy Activity", 5, "Governance & Policy"),
    "database": (6004, "Database Activity", 6, "Application Activity"),
    "unknown": (1, "Base Event", 0, "Other"),
}
STATUS = {"success": ("Success", 1), "failure": ("Failure", 2), "unknown": ("Unknown", 0)}
SEVERITY = [(9.0, "Critical", 5), (7.0, "High", 4), (5.0, "Medium", 3), (3.0, "Low", 2)]


def _class(i: int) -> Column:
    return F.coalesce(lookup({k: v[i] for k, v in OCSF_CLASSES.items()}, F.col("event.category")), F.lit(OCSF_CLASSES["unknown"][i]))


def _severity(i: int, rest: tuple) -> Column:
    s = F.col("event.severity_numeric")
    chain = F.when(s.isNull(), rest[1])
    for row in SEVERITY:
        chain = chain.when(s >= row[0], row[i])
    return chain.when(s > 0, rest[0]).otherwise(rest[1])


def _some(*cols: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in cols]).isNotNull()


def _struct(**members) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in members.items()])


def attribute_texts() -> Column:
    return F.transform_values("vendor_attributes", lambda k, v: v["v"])


def to_ocsf(df: DataFrame) -> DataFrame:
    """Events in the open cybersecurity schema, 1.1.0; absent blocks are null."""
    outcome = F.lower(F.coalesce("event.outcome", F.lit("unknown")))
    ends = _some("network.src_ip", "network.dst_ip")
    user = F.when(_some("identity.username"), _struct(name="identity.username", domain="identity.user_domain"))
    product = _struct(vendor_name="source.vendor", name="source.product", version="lineage.parser_version")
    meta = _struct(
        version=F.lit("1.1.0"), uid="event_id", tenant_uid=F.coalesce("tenant_id", F.lit("default")), processed_time="ingest_timestamp", product=product,
        profiles=F.array(F.lit("host"), F.lit("security_control")), raw_data="raw.raw_payload", raw_hash="raw.raw_hash",
    )
    return df.select(
        meta.alias("metadata"),
        F.coalesce("source_event_timestamp", "ingest_timestamp").alias("time"),
        *[_class(i).alias(k) for i, k in enumerate(["class_uid", "class_name", "category_uid", "category_name"])],
        _severity(2, (1, 0)).alias("severity_id"),
        _severity(1, ("Informational", "Unknown")).alias("severity"),
        F.coalesce(lookup({k: v[1] for k, v in STATUS.items()}, outcome), F.lit(0)).alias("status_id"),
        F.coalesce(lookup({k: v[0] for k, v in STATUS.items()}, outcome), F.lit("Unknown")).alias("status"),
        F.coalesce(F.nullif(F.col("event.action"), F.lit("")), F.lit("Unknown")).alias("activity_name"),
        _struct(hostname="source.device_hostname", ip="source.source_ip", type="source.log_format").alias("device"),
        F.when(ends, _struct(ip="network.src_ip", port="network.src_port", interface_name="network.interface")).alias("src_endpoint"),
        F.when(ends, _struct(ip="network.dst_ip", port="network.dst_port")).alias("dst_endpoint"),
        F.when(ends & _some("network.protocol"), _struct(protocol_name="network.protocol", direction="network.direction")).alias("connection_info"),
        F.when(ends & F.coalesce("network.bytes_in", "network.bytes_out").isNotNull(), _struct(bytes_in="network.bytes_in", bytes_out="network.bytes_out")).alias("traffic"),
        user.alias("user"),
        F.when(user.isNotNull(), F.struct(user.alias("user"))).alias("actor"),
        F.when(_some("rule.rule_id", "rule.rule_name"), _struct(uid="rule.rule_id", name="rule.rule_name", action="rule.policy_action")).alias("policy"),
        F.when(F.size("vendor_attributes") > 0, attribute_texts()).alias("unmapped"),
        F.col("enrichment").alias("enrichments"),
    )


def to_ecs(df: DataFrame) -> DataFrame:
    """Events in the common schema, 8.11.0. Severity is ten times ours, cut to a whole number."""
    base = {"tenant_id": F.coalesce("tenant_id", F.lit("default")), "parser_name": F.col("lineage.parser_name"), "ruleset_version": F.col("lineage.normalization_ruleset_version")}
    labels = F.create_map(*[x for k, c in base.items() for x in (F.lit(k), c)])
    more = F.transform_keys(attribute_texts(), lambda k, v: F.concat(F.lit("vendor_"), safe_key(k)))
    size = F.nullif(F.coalesce("network.bytes_in", F.lit(0)) + F.coalesce("network.bytes_out", F.lit(0)), F.lit(0))
    event = _struct(
        id="event_id", kind=F.lit("event"), category=F.array(F.coalesce("event.category", F.lit("network"))), action="event.action", outcome=F.coalesce("event.outcome", F.lit("unknown")),
        severity=F.coalesce((F.col("event.severity_numeric") * 10).cast("int"), F.lit(50)), original="raw.raw_payload", hash=F.struct(F.col("raw.raw_hash").alias("sha256")), ingested="ingest_timestamp",
    )
    return df.select(
        F.coalesce("source_event_timestamp", "ingest_timestamp").alias("@timestamp"),
        F.struct(F.lit("8.11.0").alias("version")).alias("ecs"),
        event.alias("event"),
        _struct(vendor="source.vendor", product="source.product", hostname="source.device_hostname", ip="source.source_ip", type="source.log_format", version="lineage.parser_version").alias("observer"),
        F.when(F.size("vendor_attributes") > 0, F.map_concat(labels, more)).otherwise(labels).alias("labels"),
        F.when(_some("network.src_ip", "network.src_port"), _struct(ip="network.src_ip", port="network.src_port", bytes="network.bytes_out")).alias("source"),
        F.when(_some("network.dst_ip", "network.dst_port"), _struct(ip="network.dst_ip", port="network.dst_port", bytes="network.bytes_in")).alias("destination"),
        F.when(_some("network.protocol", "network.direction"), _struct(transport="network.protocol", direction="network.direction", bytes=size)).alias("network"),
        F.when(_some("identity.username", "identity.user_domain"), _struct(name="identity.username", domain="identity.user_domain")).alias("user"),
        F.when(_some("rule.rule_id", "rule.rule_name"), _struct(id="rule.rule_id", name="rule.rule_name", description="rule.policy_action")).alias("rule"),
        F.when(F.size("enrichment.threat_intel_tags") > 0, F.col("enrichment.threat_intel_tags")).alias("tags"),
    )


def crosswalk(df: DataFrame, target: str) -> DataFrame:
    """Translation of a table of events."""
    return {"ocsf": to_ocsf, "ecs": to_ecs}[target](df)


def write_crosswalk(df: DataFrame, target: str, path: str) -> None:
    """The bulk job over a table: every event as a line of JSON, in compressed files."""
    crosswalk(df, target).write.options(**COMPACT).json(path)


def crosswalk_lines(lines: DataFrame, target: str, text_col: str = "value"):
    """The bulk job over lines of JSON events: (converted lines, counts). Blank lines are passed
    over; a line that is no JSON object of an event's types is not converted, but counted.
    ``counts.get`` has converted and failed after the next action over the lines: the same pass."""
    from pyspark.sql import Observation

    o = Observation()
    parsed = lines.filter(F.trim(text_col) != "").select(F.from_json(text_col, EVENT_DDL + ", _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("e"))
    fine = F.col("e").isNotNull() & F.col("e._broken").isNull()
    parsed = parsed.withColumn("_fine", fine).observe(o, F.count_if("_fine").alias("converted"), F.count_if(~F.col("_fine")).alias("failed"))
    events = parsed.filter("_fine").select("e.*").drop("_broken")
    return crosswalk(events, target).select(F.to_json(F.struct("*")).alias(text_col)), o
