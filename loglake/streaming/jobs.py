"""Streaming jobs: the batch transforms over streams, and keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.operators.analytics import WINDOW, source_key
from loglake.operators.ordered import dealt, held


def stream_ingest(raw: DataFrame, transform: Callable[[DataFrame, Callable], tuple[DataFrame, DataFrame]], sinks: dict, dead_letter: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False):
    """Raw records to events and dead letters: each micro-batch goes through the batch job.

    ``transform(batch, hold)`` gives both; what it passes through ``hold`` is evaluated once
    for all of them, and is on disk until the batch ends, so a batch may be larger than memory.
    Its records are dealt out before, as files cut them into tasks by bytes and not by the work
    they make. Events should come from what was held, as several sinks read them. Sinks and
    ``dead_letter`` are called with the rows and the number of the batch. After a failure Spark
    runs the batch again under its number, so a sink that keys what it writes by it, as
    ``sinks.by_batch`` does, has every record once. A sink that fails is not run again: its
    records are dead letters of the same batch."""
    from loglake.operators.sinks import fan_out

    def batch(df: DataFrame, number: int) -> None:
        with held(df.sparkSession, "batch") as hold:
            good, bad = transform(dealt(df), hold)
            _, failed = fan_out(good, {name: partial(_numbered, sink, number) for name, sink in sinks.items()}, kept=True)
            dead_letter(bad if failed is None else bad.unionByName(failed, allowMissingColumns=True), number)

    w = raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="2 seconds")).start()


def _numbered(sink: Callable[[DataFrame, int], None], number: int, df: DataFrame) -> None:
    sink(df, number)


def dedup_stream(events: DataFrame, watermark: str = "24 hours", ts: str = "ingest_ts", keys: list[str] | None = None) -> DataFrame:
    return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys or ["event_id"])


def stream_index(events: DataFrame, path: str, checkpoint: str, watermark: str = "24 hours", available_now: bool = True):
    """Appends each event once to the query table; the checkpoint keeps the place."""
    w = dedup_stream(events, watermark).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def stream_first_seen(stream: DataFrame, keys: list[str], watermark: str = "1 hour", ts: str = "ts") -> DataFrame:
    return dedup_stream(stream, watermark, ts, keys)


def stream_velocity(events: DataFrame, every: str = "1 hour", ts: str = "ts", watermark: str = "2 hours") -> DataFrame:
    """Events of every window, for a query in update mode."""
    g = events.withWatermark(ts, watermark).groupBy(F.window(ts, every)).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), "n")


def stream_burst(events: DataFrame, rates: DataFrame, window: str = "60 seconds", slide: str = "10 seconds", mult: float = 3.0, min_recent: int = 10, ts: str = "ts", watermark: str = "10 minutes") -> DataFrame:
    """Windows in which an address is above ``mult`` times its usual rate. rates: src_ip, rate
    in events a second."""
    seconds = int(window.split()[0]) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[window.split()[1].rstrip("s")]
    g = events.withColumn("src_ip", source_key()).withWatermark(ts, watermark).groupBy("src_ip", F.window(ts, window, slide)).agg(F.count(F.lit(1)).alias("n"))
    j = g.join(rates, "src_ip")
    return j.filter((F.col("n") >= min_recent) & (F.col("n") / seconds > mult * F.col("rate"))).select("src_ip", F.col("window.start").alias("start"), "n")


#: Rows that a stateful step gives out at once.
SLICE = 10_000


def _keyed(stream: DataFrame, value: Column, kind: str, schema: str, state: str, step: Callable, timeout: str | None) -> DataFrame:
    """The values of each address in a micro-batch, in order of seq, through ``step(values,
    state) -> (columns of the output, state)``.

    Of a row only seq and one number reach Python, so an address takes 16 bytes for each of its
    rows in a micro-batch, which the source's option bounds (``maxFilesPerTrigger``,
    ``maxBytesPerTrigger``); batches follow each other in the order of seq. The output goes
    out in slices. The state of an address that stays away for ``timeout`` is dropped. With a
    timeout the query goes on by itself to watch the clock, so a run to the end of its input
    takes None."""
    millis = timeout and int(timeout.split()[0]) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[timeout.split()[1].rstrip("s")] * 1000

    def run(key, batches: Iterator, group) -> Iterator:
        import numpy as np
        import pandas as pd

        if group.hasTimedOut:
            group.remove()
            return
        parts = [(b["seq"].to_numpy(np.int64), b["_value"].to_numpy(kind)) for b in batches]
        seq, values = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.argsort(seq, kind="stable")
        out, new = step(values[order], group.get if group.exists else None)
        group.update(new)
        if millis:
            group.setTimeoutDuration(millis)
        for at in range(0, len(seq), SLICE):
            now = slice(at, at + SLICE)
            yield pd.DataFrame({"src_ip": key[0], "seq": seq[order[now]], **{k: v[now] for k, v in out.items()}})

    rows = stream.select(source_key().alias("src_ip"), "seq", value.alias("_value"))
    return rows.groupBy("src_ip").applyInPandasWithState(run, schema, state, "append", "ProcessingTimeTimeout" if millis else "NoTimeout")


def stream_auth_chain(events: DataFrame, threshold: int = 5, timeout: str | None = "24 hours") -> DataFrame:
    """(src_ip, seq, chain, fires): failures since the last success, over all batches."""

    def step(codes, state):
        import numpy as np

        total = np.cumsum(codes == 1) + (state[0] if state else 0)
        since = total - np.maximum.accumulate(np.where(codes == 2, total, 0))
        chain = np.where(codes == 1, since, 0).astype(np.int32)
        return {"chain": chain, "fires": chain >= threshold}, (int(since[-1]),)

    is_ = lambda outcome: F.coalesce((F.col("category") == "authentication") & (F.col("outcome") == outcome), F.lit(False))
    code = F.when(is_("failure"), 1).when(is_("success"), 2).otherwise(0).cast("byte")
    return _keyed(events, code, "int8", "src_ip string, seq long, chain int, fires boolean", "n int", step, timeout)


def stream_score(events: DataFrame, window: int = WINDOW, timeout: str | None = "24 hours") -> DataFrame:
    """(src_ip, seq, z): severity against the last ``window`` events before each one. The
    state is an array of at most ``window`` numbers an address."""

    def step(values, state):
        import numpy as np

        old = np.array(state[0] if state else [], float)
        v = np.r_[old, values]
        x = v - v[0]
        one, two = (np.r_[0.0, np.cumsum(y)] for y in (x, x * x))
        at = np.arange(len(old), len(v))
        low = np.maximum(0, at - window)
        n = np.maximum(1, at - low)
        mean = (one[at] - one[low]) / n
        std = np.sqrt(np.maximum(0.0, (two[at] - two[low]) / n - mean**2))
        d = np.abs(x[at] - mean)
        z = np.where(at - low < 5, 0.0, np.where(std > 1e-6, d / np.maximum(std, 1e-6), np.where(d > 1e-4, 10.0, 0.0)))
        return {"z": z}, (v[-window:].tolist(),)

    return _keyed(events, F.col("severity").cast("double"), "float64", "src_ip string, seq long, z double", "v array<double>", step, timeout)
