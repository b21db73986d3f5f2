"""Scans: raw logs, normalised events, dead letters, the lake, streams of them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.schema import DEAD_LETTER_DDL, EVENT_DDL


def _options(reader, recursive: bool, extensions: list[str] | None):
    reader = reader.option("lineSep", "\n").option("recursiveFileLookup", str(recursive).lower())
    if extensions:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}")
    return reader


def _raw(lines: DataFrame, tenant_id: str, ingest_ts, seq=None) -> DataFrame:
    path = F.regexp_replace("_metadata.file_path", "^file:/*", "/")
    df = lines.select(path.alias("source_tag"), F.rtrim("value", F.lit("\r")).alias("line"), (F.monotonically_increasing_id() if seq is None else seq).alias("seq"))
    df = df.filter(F.trim("line") != "")
    return df.select(F.lit(tenant_id).alias("tenant_id"), "source_tag", "seq", F.col("line").cast("binary").alias("raw_bytes"), "line", ingest_ts.alias("ingest_ts"))


def read_raw(spark: SparkSession, path: str, recursive: bool = False, extensions: list[str] | None = None, tenant_id: str = "default", ingest_ts: str | None = None) -> DataFrame:
    """Raw log lines of a file or folder: cut at newlines only, blank lines dropped."""
    ts = F.to_timestamp(F.lit(ingest_ts)) if ingest_ts else F.current_timestamp()
    return _raw(_options(spark.read, recursive, extensions).text(path), tenant_id, ts)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Normalised events from NDJSON; malformed lines are dropped."""
    return spark.read.schema(EVENT_DDL).option("mode", "DROPMALFORMED").json(path)


def read_dead_letter(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DEAD_LETTER_DDL).json(path)


def read_lake(spark: SparkSession, path: str, tenant_id: str | None = None, dt_from: str | None = None, dt_to: str | None = None) -> DataFrame:
    """The partitioned Parquet lake; the arguments prune partitions."""
    df = spark.read.parquet(path)
    if tenant_id is not None:
        df = df.filter(F.col("tenant_id") == tenant_id)
    if dt_from is not None:
        df = df.filter(F.col("dt") >= F.lit(dt_from).cast("date"))
    if dt_to is not None:
        df = df.filter(F.col("dt") <= F.lit(dt_to).cast("date"))
    return df


def raw_from_lines(lines: DataFrame, source_tag: str, tenant_id: str = "default", body_col: str = "line", seq_col: str | None = None) -> DataFrame:
    """Raw rows from any table of lines or of bodies with newlines."""
    keep = [F.col(seq_col).alias("seq")] if seq_col else []
    df = lines.select(*keep, F.explode(F.split(F.col(body_col), "\n")).alias("line")).withColumn("line", F.regexp_replace("line", "\r+$", "")).filter(F.trim("line") != "")
    seq = F.col("seq") if seq_col else F.monotonically_increasing_id().alias("seq")
    return df.select(F.lit(tenant_id).alias("tenant_id"), F.lit(source_tag).alias("source_tag"), seq, F.col("line").cast("binary").alias("raw_bytes"), "line", F.current_timestamp().alias("ingest_ts"))


def stream_raw(spark: SparkSession, path: str, tenant_id: str = "default", max_files: int | None = None) -> DataFrame:
    """New files of a folder as they come; ``max_files`` caps one batch. A stream cannot
    number lines: seq is the file's time in microseconds, the same for all its lines."""
    r = _options(spark.readStream, False, None)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return _raw(r.text(path).select("value", "_metadata"), tenant_id, F.current_timestamp(), F.unix_micros("_metadata.file_modification_time"))


def stream_events(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(EVENT_DDL)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.json(path)


def kafka_raw(rows: DataFrame, tenant_id: str = "default") -> DataFrame:
    """Raw records from rows in the form of Kafka's: the topic is the source, the place in its
    partition the order."""
    return rows.select(F.lit(tenant_id).alias("tenant_id"), F.col("topic").alias("source_tag"), F.col("offset").alias("seq"), F.col("value").alias("raw_bytes"), F.col("value").cast("string").alias("line"), F.col("timestamp").alias("ingest_ts"))


def stream_kafka_raw(spark: SparkSession, options: dict[str, str], tenant_id: str = "default") -> DataFrame:
    """Raw records of Kafka topics."""
    return kafka_raw(spark.readStream.format("kafka").options(**options).load(), tenant_id)


#: What a collector of network records writes where there is no broker.
SPOOL_DDL = "topic string, partition int, offset long, value binary, timestamp timestamp"


#: Rows of one file of a spool, about; fewer only where a lot would have less than six files.
SPOOL_ROWS = 1 << 20


def write_spool(rows: DataFrame, path: str) -> None:
    """Rows of ``SPOOL_DDL`` as further files of a spool. A stream takes a number of files at
    once, so files of few rows would make micro-batches of few rows, each of which has its cost."""
    rows = rows.coalesce(max(6, -(-rows.count() // SPOOL_ROWS)))
    rows.select("topic", F.col("partition").cast("int"), F.col("offset").cast("long"), F.col("value").cast("binary"), F.col("timestamp").cast("timestamp")).write.mode("append").parquet(path)


#: State in files on local disk; a micro-batch adds what it changed to the checkpoint.
STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",  # it reads each key before it is put
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state on disk: that of a spool has every record of
    the watermark's time, which need not fit the executors' memory."""
    before = {k: spark.conf.get(k, None) for k in STATE_ON_DISK}
    for k, v in STATE_ON_DISK.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_spool_raw(spark: SparkSession, path: str, tenant_id: str = "default", max_files: int | None = None, watermark: str | None = "24 hours") -> DataFrame:
    """Raw records that a collector received from the network and wrote to files. The stream's
    checkpoint keeps the place, so a restart loses nothing; records that a collector wrote
    again after its own restart (one topic, partition and offset within ``watermark``) count once."""
    r = spark.readStream.schema(SPOOL_DDL)
    rows = (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(path)
    if watermark:
        rows = rows.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(["topic", "partition", "offset"])
    return kafka_raw(rows, tenant_id)


def stream_socket_raw(spark: SparkSession, host: str, port: int, tenant_id: str = "default") -> DataFrame:
    """Lines of a socket, for tests."""
    s = spark.readStream.format("socket").option("host", host).option("port", port).option("includeTimestamp", "true").load()
    return s.select(F.lit(tenant_id).alias("tenant_id"), F.lit(f"syslog:{host}").alias("source_tag"), F.unix_micros("timestamp").alias("seq"), F.col("value").cast("binary").alias("raw_bytes"), F.col("value").alias("line"), F.col("timestamp").alias("ingest_ts"))
