"""Feature vectors of events: 24 numbers with names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.schema import CATEGORIES, OUTCOMES

FEATURE_NAMES = [
    "hour_sin", "hour_cos", "dow_sin", "dow_cos", "severity_norm", "severity_inferred", "log_bytes_in", "log_bytes_out", "port_well_known", "port_registered",
    "port_dynamic", *[f"outcome_{o}" for o in OUTCOMES], "threat_detected", "cloud_origin", *[f"category_{c}" for c in CATEGORIES],
]


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def feature_columns(df: DataFrame) -> dict[str, Column]:
    """One column for each name. Hour and weekday are in the offset of the time's own text."""
    t = F.coalesce("source_event_timestamp", "ingest_timestamp")
    ok = t.rlike(r"^\d{4}-\d{2}-\d{2}")
    hour = F.coalesce(F.when(ok, F.regexp_extract(t, r"^\d{4}-\d{2}-\d{2}[T ](\d{2})", 1).try_cast("int")), F.lit(0))
    day = F.coalesce(F.when(ok, F.weekday(F.left(t, F.lit(10)).try_cast("date"))), F.lit(0))
    sev = F.col("event.severity_numeric")
    sev = F.when(sev == 0, 5.0).otherwise(F.coalesce(sev, F.lit(5.0)))
    size = lambda c: F.least(F.lit(1.0), F.log10(1 + F.coalesce(F.col(c), F.lit(0))) / 9)
    port = F.coalesce(F.col("network.dst_port"), F.lit(0))
    out, cat = F.lower(F.coalesce("event.outcome", F.lit("unknown"))), F.lower(F.coalesce("event.category", F.lit("unknown")))
    turn = lambda x, n: x * (2 * 3.141592653589793 / n)
    values = [
        F.sin(turn(hour, 24)), F.cos(turn(hour, 24)), F.sin(turn(day, 7)), F.cos(turn(day, 7)), sev / 10, _flag(F.coalesce("event.severity_inferred", F.lit(False))),
        size("network.bytes_in"), size("network.bytes_out"), _flag((port > 0) & (port < 1024)), _flag(port.between(1024, 49151)), _flag(port > 49151),
        *[_flag(out == o) for o in OUTCOMES], _flag(F.coalesce("enrichment.threat_ip_detected", F.lit(False))), _flag(F.col("enrichment.src_ip_context.cloud_provider").isNotNull()),
        *[_flag(cat == c) for c in CATEGORIES],
    ]
    return dict(zip(FEATURE_NAMES, values))


def features(df: DataFrame, as_array: bool = True) -> DataFrame:
    """event_id with the vector as an array, or as 24 named columns for a VectorAssembler."""
    cols = feature_columns(df)
    if as_array:
        return df.select("event_id", F.array(*cols.values()).alias("features"))
    return df.select("event_id", *[c.alias(k) for k, c in cols.items()])
