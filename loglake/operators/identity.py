"""Hashes, event ids, the raw archive and its lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglake.functions.scalars import let, once

#: The URL namespace of name-based UUIDs (RFC 4122).
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
SEED = "loglake"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def with_raw_hash(df: DataFrame) -> DataFrame:
    """Adds raw_hash: SHA-256 of the exact bytes."""
    return once(df, {"raw_hash": F.sha2(F.col("raw_bytes"), 256)})


def url_hash(name: Column) -> Column:
    return F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(name, "UTF-8")))


def uuid5(h: Column) -> Column:
    """A name-based UUID from its hash."""
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def uuid5_url(name: Column) -> Column:
    return let(url_hash(name), uuid5)


def with_event_id(df: DataFrame) -> DataFrame:
    """Adds event_id: a name-based UUID of tenant, source and hash; a re-ingest gives the same id."""
    h = once(df, {"_h": url_hash(F.concat_ws(":", F.lit(SEED), "tenant_id", "source_tag", "raw_hash"))})
    return once(h, {"event_id": uuid5(F.col("_h"))}).drop("_h")


def dedup_latest(df: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The last row of every key."""
    w = Window.partitionBy(*(keys or ["event_id"])).orderBy(*[F.desc(c) for c in order or ["ingest_ts", "seq"]])
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def raw_archive(df: DataFrame) -> DataFrame:
    """Archive rows, one for each event id."""
    rows = df.select("event_id", F.col("raw_hash").alias("sha256"), F.octet_length("raw_bytes").cast("long").alias("length"), "raw_bytes", "tenant_id", "ingest_ts", F.to_date("ingest_ts").alias("dt"))
    return rows.dropDuplicates(["event_id"])


def write_raw_archive(df: DataFrame, path: str) -> None:
    raw_archive(df).repartition("dt", "tenant_id").write.mode("append").partitionBy("dt", "tenant_id").parquet(path)


def valid_uuid(c: Column) -> Column:
    return c.rlike(UUID)


def lookup_raw(archive: DataFrame, ids: DataFrame, tenant_id: str | None = None) -> DataFrame:
    """Archive rows of the given event ids; ids that are not UUIDs find nothing."""
    a = archive if tenant_id is None else archive.filter(F.col("tenant_id") == tenant_id)
    return a.join(ids.select("event_id").filter(valid_uuid(F.col("event_id"))), "event_id", "left_semi")


def verify_integrity(events: DataFrame, archive: DataFrame) -> DataFrame:
    """event_id, archived, intact: whether the archived bytes still have the hash of the event."""
    a = archive.select("event_id", F.sha2("raw_bytes", 256).alias("_now"))
    return events.join(a, "event_id", "left").select("event_id", F.col("_now").isNotNull().alias("archived"), F.col("_now").eqNullSafe(F.col("raw_hash")).alias("intact"))


def rebuild(spark: SparkSession, source: DataFrame, path: str) -> DataFrame:
    """Write the query table anew from the source of truth."""
    source.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
