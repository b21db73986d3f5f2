"""Registered streaming queries: each runs a stream over a table to its end and reads back
what it wrote."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.plans.queries import CHAIN, SEC, q
from loglake.plans.tables import SEC_EVENTS
from loglake.session import prepare
from loglake.streaming import jobs


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see; a local one only where none is configured, in
    local mode. On several machines that is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    top = top or "file://" + tempfile.mkdtemp(prefix="loglake-")
    return f"{top.rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"


def _sec_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = prepare(spark).read.parquet(f"{sf_dir}/events.parquet").schema
    # a glob, since a stream's path must not be one file
    spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").createOrReplaceTempView("_loglake_event_stream")
    return spark.sql(SEC_EVENTS.replace("from events", "from _loglake_event_stream")).withColumn("severity", F.col("sev").cast("double")).withColumn("ts", F.col("ts").cast("timestamp"))


#: Rows of one file of a sliced stream, at most; a table has six at least.
SLICE_ROWS = 1 << 20


def _sliced_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in slices by their order, of which each micro-batch takes one: state is
    carried from one to the next. A file source takes files by their time, so the slices are
    written one after the other."""
    table = prepare(spark).read.parquet(f"{sf_dir}/events.parquet")
    path, n = _folder(spark, "slices"), max(6, -(-table.count() // SLICE_ROWS))
    cuts = table.approxQuantile("event_id", [k / n for k in range(1, n)], 0.001)
    for low, high in zip([None, *cuts], [*cuts, None]):
        rows = table if low is None else table.filter(F.col("event_id") > low)
        (rows if high is None else rows.filter(F.col("event_id") <= high)).coalesce(1).write.mode("append").parquet(path)
    spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path).createOrReplaceTempView("_loglake_slices")
    return spark.sql(SEC_EVENTS.replace("from events", "from _loglake_slices")).withColumn("severity", F.col("sev").cast("double"))


def _finished(stream: DataFrame, name: str, least: int = 1) -> DataFrame:
    """What a stream writes up to the end of its input, in ``least`` micro-batches or more."""
    spark, out = stream.sparkSession, _folder(stream.sparkSession, name)
    w = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint")
    w = w.trigger(availableNow=True).start()
    w.awaitTermination()
    assert (w.lastProgress.batchId + 1 if w.lastProgress else 0) >= least, "fewer micro-batches than asked for"
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


@q(f"with {SEC}, {CHAIN.format(t='sec')} select src_ip, seq, chain::int as chain, chain >= 5 as fires from cc")
def m04_stream_auth_chain(spark, sf):
    return _finished(jobs.stream_auth_chain(_sliced_stream(spark, sf), timeout=None), "chain", least=5)


@q("select distinct user_id, event_type from events")
def m07_stream_first_seen(spark, sf):
    return _finished(jobs.stream_first_seen(_sec_stream(spark, sf), ["user_id", "event_type"], "60 days"), "first").select("user_id", "event_type")
