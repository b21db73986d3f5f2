"""Sinks: NDJSON, the Parquet lake, Kafka rows, CEF and LEEF lines, dead letters, exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.functions.scalars import cef_header, cef_value, leef_value
from loglake.operators.validate import dead_letters

Sink = Callable[[DataFrame], None]
MOST_EXPORTED = 100_000
EXPORT_COLUMNS = [
    "event_id", "ingest_timestamp", "source_event_timestamp", "vendor", "product", "category", "action", "outcome", "severity_numeric", "src_ip", "dst_ip", "dst_port",
    "username", "parser_name",
]

# The columns of the flat table and where they come from.
FLAT = {
    "schema_version": "schema_version", "tenant_id": "tenant_id", "event_id": "event_id", "ingest_timestamp": "ingest_timestamp", "source_event_timestamp": "source_event_timestamp",
    "raw_payload": "raw.raw_payload", "raw_format": "raw.raw_format", "raw_hash": "raw.raw_hash", "vendor": "source.vendor", "product": "source.product",
    "device_hostname": "source.device_hostname", "source_ip": "source.source_ip", "category": "event.category", "class_name": "event.class_name", "class_uid": "event.class_uid",
    "activity_name": "event.activity_name", "activity_id": "event.activity_id", "action": "event.action", "outcome": "event.outcome", "severity_numeric": "event.severity_numeric",
    "severity_inferred": "event.severity_inferred", "src_ip": "network.src_ip", "src_port": "network.src_port", "dst_ip": "network.dst_ip", "dst_port": "network.dst_port",
    "protocol": "network.protocol", "bytes_in": "network.bytes_in", "bytes_out": "network.bytes_out", "direction": "network.direction", "username": "identity.username",
    "user_domain": "identity.user_domain", "rule_name": "rule.rule_name", "anomaly_score": "analytics.anomaly_score", "is_anomalous": "analytics.is_anomalous",
    "parser_name": "lineage.parser_name", "vendor_attributes": "vendor_attributes",
}


def flatten_events(df: DataFrame) -> DataFrame:
    """The flat table of 36 columns; the bag of attributes is JSON text."""
    out = {k: F.col(v) for k, v in FLAT.items()}
    out["tenant_id"], out["category"] = F.coalesce("tenant_id", F.lit("default")), F.coalesce("event.category", F.lit("unknown"))
    for k in ("class_uid", "activity_id"):
        out[k] = out[k].cast("bigint")
    for k in ("severity_inferred", "is_anomalous"):
        out[k] = F.coalesce(out[k], F.lit(False))
    bag = F.transform_values("vendor_attributes", lambda k, v: v["v"])
    out["vendor_attributes"] = F.coalesce(F.to_json(bag), F.lit("{}"))
    extra = [c for c in ("ingest_ts", "seq") if c in df.columns]
    return df.select(*[c.alias(k) for k, c in out.items()], *extra)


#: JSON of events says its keys in every line: a sixth of its size at the least effort.
COMPACT = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def write_ndjson(df: DataFrame, path: str, compact: bool = False) -> None:
    df.write.mode("append").options(**COMPACT if compact else {}).json(path)


def write_lake(df: DataFrame, path: str) -> None:
    """Flat events by date and tenant. Rows are dealt by both with a few salts, so a hot
    tenant is written by several tasks and a small one leaves few files."""
    flat = flatten_events(df).drop("ingest_ts", "seq").withColumn("dt", F.to_date(F.left("ingest_timestamp", F.lit(10))))
    salt = F.pmod(F.xxhash64("event_id"), F.lit(8))
    flat.repartition("dt", "tenant_id", salt).write.mode("append").partitionBy("dt", "tenant_id").parquet(path)


def to_kafka_rows(df: DataFrame) -> DataFrame:
    return df.select(F.col("event_id").alias("key"), F.to_json(F.struct("*")).alias("value"))


def write_kafka(df: DataFrame, topic: str, servers: str) -> None:
    to_kafka_rows(df).write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all").option("topic", topic).save()


def write_kafka_envelope(df: DataFrame, path: str, topic: str = "loglake.events") -> None:
    """What would go to the topic, as files of {topic, key, value}."""
    df.select(F.lit(topic).alias("topic"), F.col("event_id").alias("key"), F.struct("*").alias("value")).write.mode("append").json(path)


def _text(c: str) -> Column:
    return F.nullif(F.col(c).cast("string"), F.lit(""))


def _first(*cols: Column | str, default: str) -> Column:
    return F.coalesce(*[_text(c) if isinstance(c, str) else c for c in cols], F.lit(default))


def _rounded(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(10), F.bround(c, 0).cast("int"))).cast("string")


def to_cef(df: DataFrame) -> DataFrame:
    """event_id and the event as a CEF:0 line; absent values are left out."""
    sev = F.col("event.severity_numeric")
    sev = F.when(sev == 0, 5.0).otherwise(F.coalesce(sev, F.lit(5.0)))
    head = [
        _first("source.vendor", default="LogLake"), _first("source.product", default="UnifiedLog"), _first("schema_version", default="1.2.0"),
        _first("event.event_type_vendor_specific", "event.activity_id", default="EVENT_0"), _first("event.activity_name", "event.action", "event.category", default="Generic Event"),
    ]
    # Keys of the extension, in order.
    keys = [("src", "network.src_ip"), ("spt", "network.src_port"), ("dst", "network.dst_ip"), ("dpt", "network.dst_port"), ("proto", "network.protocol"), ("in", "network.bytes_in"), ("out", "network.bytes_out"), ("suser", "identity.username"), ("act", "rule.policy_action"), ("externalId", "event_id"), ("rt", "source_event_timestamp")]
    ext = F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), cef_value(_text(c))) for k, c in keys])
    return df.select("event_id", F.concat(F.lit("CEF:0|"), F.concat_ws("|", *[cef_header(h) for h in head], _rounded(sev), ext)).alias("line"))


def to_leef(df: DataFrame) -> DataFrame:
    """event_id and the event as a LEEF:2.0 line with tabs between attributes."""
    head = [_first("source.vendor", default="LogLake"), _first("source.product", default="UnifiedLog"), _first("schema_version", default="1.2.0"), _first("event.event_type_vendor_specific", "event.activity_name", default="LEEF_EVENT")]
    keys = [("src", "network.src_ip"), ("spt", "network.src_port"), ("dst", "network.dst_ip"), ("dpt", "network.dst_port"), ("proto", "network.protocol"), ("usrName", "identity.username"), ("sev", None), ("action", "event.action"), ("outcome", "event.outcome"), ("devTime", "source_event_timestamp")]
    attrs = [F.concat(F.lit(f"{k}="), _rounded(F.col("event.severity_numeric")) if c is None else leef_value(_text(c))) for k, c in keys]
    return df.select("event_id", F.concat(F.lit("LEEF:2.0|"), F.concat_ws("|", *[cef_header(h) for h in head]), F.lit("|x09|"), F.concat_ws("\t", *attrs)).alias("line"))


def write_cef(df: DataFrame, path: str) -> None:
    to_cef(df).select("line").write.mode("append").text(path)


def write_leef(df: DataFrame, path: str) -> None:
    to_leef(df).select("line").write.mode("append").text(path)


def write_dead_letter(dlq: DataFrame, path: str) -> None:
    dlq.write.mode("append").partitionBy("stage").json(path)


def by_batch(path: str, fmt: str = "json", prepare: Callable[[DataFrame], DataFrame] | None = None, partition_by: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
    """A sink for streams: each micro-batch is a folder by its number. A batch that runs again
    replaces what its first run has left, so every record is there once."""

    def write(df: DataFrame, number: int) -> None:
        df = prepare(df) if prepare else df
        df.write.mode("overwrite").format(fmt).partitionBy(*partition_by).save(f"{path}/batch={number}")

    return write


def fan_out(df: DataFrame, sinks: dict[str, Sink], kept: bool = False) -> tuple[dict[str, str], DataFrame | None]:
    """Writes to every sink, whatever happens to the others. Returns the causes of failures
    by sink, and dead letters for them. ``kept`` events are a table already, which sinks and
    dead letters read; others are held in memory while the sinks run."""
    df = df if kept else df.persist()
    failed, dlqs = {}, None
    try:
        for name, sink in sinks.items():
            try:
                sink(df)
            except Exception as e:  # noqa: BLE001  one bad sink must not stop the rest
                failed[name] = f"{type(e).__name__}: {str(e)[:500]}"
        for name, cause in failed.items():
            d = dead_letters(df, "sink", cause.split(":")[0], F.lit(cause), failed_sink=name)
            dlqs = d if dlqs is None else dlqs.unionByName(d)
    finally:
        if not kept:
            df.unpersist()
    return failed, dlqs


def export_rows(flat: DataFrame, limit: int = MOST_EXPORTED, **filters) -> DataFrame:
    """The newest rows that pass the filters, up to the limit of an export."""
    from loglake.operators.query import filter_events, search_events

    term = filters.pop("search", None)
    df = filter_events(flat, **filters)
    df = search_events(df, term) if term else df
    return df.orderBy(F.desc("ingest_timestamp"), "event_id").limit(min(MOST_EXPORTED, limit))


def export_events(flat: DataFrame, path: str, fmt: str = "json", limit: int = MOST_EXPORTED, **filters) -> None:
    rows = export_rows(flat, limit, **filters)
    if fmt == "csv":
        rows.select(*EXPORT_COLUMNS).write.mode("overwrite").option("header", "true").csv(path)
    else:
        rows.write.mode("overwrite").json(path)
