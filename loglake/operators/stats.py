"""Aggregates over events and dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def count_by(df: DataFrame, col: str, null_as: str | None = None) -> DataFrame:
    """(value, n), the largest first."""
    c = F.coalesce(F.col(col), F.lit(null_as)) if null_as else F.col(col)
    return df.groupBy(c.alias(col)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)


def total(df: DataFrame, tenant_id: str | None = None) -> DataFrame:
    return (df if tenant_id is None else df.filter(F.col("tenant_id") == tenant_id)).agg(F.count(F.lit(1)).alias("n"))


def severity_bands(df: DataFrame, col: str = "severity_numeric") -> DataFrame:
    s = F.col(col)
    return df.agg(F.count_if(s < 4).alias("low"), F.count_if((s >= 4) & (s < 7)).alias("medium"), F.count_if(s >= 7).alias("high"))


def velocity(df: DataFrame, now: str, col: str = "ingest_ts") -> DataFrame:
    """Events of the hour and of the day before ``now``."""
    t = F.to_timestamp(F.lit(now))
    since = lambda h: F.count_if(F.col(col) >= t - F.expr(f"interval {h} hours"))
    return df.agg(since(1).alias("last_hour"), since(24).alias("last_day"))


def valid_rate(df: DataFrame, dlq: DataFrame, tenant_id: str | None = None) -> DataFrame:
    """Counts of valid events and dead letters, and the share of valid ones in percent (100 for none)."""
    v, d = total(df, tenant_id).withColumnRenamed("n", "n_valid"), total(dlq, tenant_id).withColumnRenamed("n", "n_dead")
    both = v.withColumn("k", F.lit(1)).join(d.withColumn("k", F.lit(1)), "k").drop("k")  # one row each
    return both.withColumn("valid_rate", F.when(F.col("n_valid") + F.col("n_dead") == 0, 100.0).otherwise(F.round(100 * F.col("n_valid") / (F.col("n_valid") + F.col("n_dead")), 1)))


def event_stats(df: DataFrame, dlq: DataFrame, tenant_id: str | None = None, now: str | None = None) -> DataFrame:
    """The dashboard summary as (section, key, n), from one scan with grouping sets."""
    if tenant_id is not None:
        df, dlq = df.filter(F.col("tenant_id") == tenant_id), dlq.filter(F.col("tenant_id") == tenant_id)
    t = F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
    base = df.select(
        F.coalesce("category", F.lit("unknown")).alias("category"),
        F.coalesce("vendor", F.lit("Unknown")).alias("vendor"),
        F.coalesce("outcome", F.lit("unknown")).alias("outcome"),
        F.coalesce("action", F.lit("unknown")).alias("action"),
        F.when(F.col("severity_numeric") < 4, "low").when(F.col("severity_numeric") < 7, "medium").when(F.col("severity_numeric").isNotNull(), "high").alias("severity"),
        (F.col("ingest_ts") >= t - F.expr("interval 1 hour")).cast("int").alias("h"),
        (F.col("ingest_ts") >= t - F.expr("interval 24 hours")).cast("int").alias("d"),
    )
    names = ["category", "vendor", "outcome", "action", "severity"]
    g = base.groupingSets([[F.col(c)] for c in names] + [[]], *names).agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h"), F.sum("d").alias("d"), *[F.grouping(c).alias(f"g_{c}") for c in names])
    section, key = F.lit("total"), F.lit("all")
    for c in names:
        section, key = F.when(F.col(f"g_{c}") == 0, c).otherwise(section), F.when(F.col(f"g_{c}") == 0, F.col(c)).otherwise(key)
    rows = g.select(section.alias("section"), key.alias("key"), "n", "h", "d")
    counts = rows.filter("key IS NOT NULL").select("section", "key", "n")
    speed = rows.filter("section = 'total'").selectExpr("stack(2, 'last_hour', coalesce(h, 0), 'last_day', coalesce(d, 0)) as (key, n)").select(F.lit("velocity").alias("section"), "key", "n")
    dead = dlq.agg(F.count(F.lit(1)).alias("n")).select(F.lit("dead_letter").alias("section"), F.lit("all").alias("key"), "n")
    return counts.unionByName(speed).unionByName(dead)


def source_telemetry(events: DataFrame, dlq: DataFrame) -> DataFrame:
    """Per source: received, valid, dead letters, last event, last error, health."""
    a = events.select(F.col("parser_name").alias("source_id"), F.lit(1).alias("ok"), F.col("ingest_timestamp").alias("t"), F.lit(None).cast("string").alias("error"))
    b = dlq.select(F.coalesce("parser", F.lit("unknown")).alias("source_id"), F.lit(0).alias("ok"), F.col("timestamp").alias("t"), F.col("error_message").alias("error"))
    g = a.unionByName(b).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("received"),
        F.sum("ok").alias("valid"),
        F.sum(1 - F.col("ok")).alias("dead_lettered"),
        F.max(F.when(F.col("ok") == 1, F.col("t"))).alias("last_event"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.struct("t", "error"))).alias("last_error"),
    )
    return g.withColumn("health", F.when(F.col("dead_lettered") == 0, "healthy").when(F.col("valid") > 0, "degraded").otherwise("failing"))


def pipeline_metrics(telemetry: DataFrame) -> DataFrame:
    share = lambda c: F.coalesce(F.round(100 * F.sum(c) / F.sum("received"), 1), F.lit(0.0))
    return telemetry.agg(
        F.count(F.lit(1)).alias("n_sources"), F.count_if(F.col("valid") > 0).alias("n_active"), F.sum("received").alias("received"), F.sum("valid").alias("valid"),
        F.sum("dead_lettered").alias("dead_lettered"), share("valid").alias("valid_pct"), share("dead_lettered").alias("dead_pct"),
    )


def run_stats(valid: DataFrame, dlq: DataFrame) -> DataFrame:
    """Processed, valid, invalid and failed records of one run."""
    v = valid.select(F.lit("valid").alias("stage"))
    g = v.unionByName(dlq.select("stage")).agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("stage") == "valid").alias("valid"), F.count_if(F.col("stage") == "validation").alias("invalid"))
    return g.withColumn("errors", F.col("processed") - F.col("valid") - F.col("invalid"))


def observe_outcomes(df: DataFrame, name: str):
    """The table with counts of good and bad rows that are read off its next action."""
    from pyspark.sql import Observation

    o = Observation(name)
    bad = F.size("errors") > 0
    return df.observe(o, F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("invalid")), o


def category_share(df: DataFrame) -> DataFrame:
    n = df.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("total", F.sum("n").over(Window.partitionBy())).withColumn("share", F.col("n") / F.col("total"))


def anomaly_summary(df: DataFrame, total_events: int | None = None) -> DataFrame:
    """From scored events: total, anomalous, rate in percent."""
    n = F.lit(total_events) if total_events is not None else F.count(F.lit(1))
    hit = F.count_if(F.col("is_anomalous"))
    return df.agg(n.cast("long").alias("total"), hit.alias("anomalous"), F.coalesce(F.round(100 * hit / n, 2), F.lit(0.0)).alias("rate_pct"))


def volume_profile(df: DataFrame) -> DataFrame:
    return df.groupBy("source_tag", "format_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("raw_bytes")).alias("n_bytes"))
