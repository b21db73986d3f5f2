"""Baselines for each source address, and scores of anomalies.

Columns used: seq (order), src_ip, severity, category, outcome, bytes_in, bytes_out, unix_ts,
threat_ip_detected, threat_intel. Addresses that are null count as 'unknown'; that group
may be very large, as any other address may. So ranks are cut before values are collected,
chains go over blocks of sequence numbers, and windows over the rows of an address split
the addresses of over ``HOT`` rows by ranks and times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglake.operators.ordered import BLOCK, hot_keys, order_statistics, over_last, ranked

WINDOW = 1000
SAVED = 100
#: Addresses of more rows are split; such an address is one in as many rows at most, so their
#: list is sent to all tasks.
HOT = 1 << 20

# Weights of the signs, and the bounds of a score.
WEIGHTS = {"z_high": 0.35, "z_medium": 0.20, "bytes": 0.25, "burst": 0.30, "rare": 0.15, "threat": 0.40, "auth_chain": 0.30}
ANNOTATE, ANOMALOUS = 0.15, 0.5


def source_key(c: str = "src_ip") -> Column:
    return F.coalesce(F.col(c), F.lit("unknown"))


def last_n(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of every key. Spark cuts such a rank within each task before the
    shuffle, so a hot key sends ``n`` rows a task at most."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def rolling_stats(df: DataFrame, key: str, value: str, order: list[str], window: int = WINDOW) -> DataFrame:
    """(key, n, mean, std) of the last ``window`` values; the deviation of the population."""
    return last_n(df, key, order, window).groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def index_quartiles(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, q1, q3): the values at n div 4 and 3n div 4 of the sorted list, not interpolated.
    No list is made: values are sorted by range, and a rank is taken within one range."""
    found = order_statistics(df, [key], value, {"q1": "n div 4", "q3": "3 * n div 4"})
    none = df.groupBy(key).agg(F.count(value).alias("n")).filter("n = 0")
    return found.unionByName(none, allowMissingColumns=True)


def bytes_pool(df: DataFrame) -> DataFrame:
    """(src_ip, seq, pos, bytes): in- and outgoing bytes above 0 in one order."""
    e = df.select(source_key().alias("src_ip"), "seq", F.posexplode(F.array("bytes_in", "bytes_out")).alias("pos", "bytes"))
    return e.filter("bytes > 0").withColumn("bytes", F.col("bytes").cast("double"))


def build_baseline(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """(src_ip, sev_n, sev_mean, sev_std, sev_values, bytes_values): two-pass mode, the last
    ``window`` values of each address."""
    s = last_n(df.select(source_key().alias("src_ip"), "seq", F.col("severity").cast("double").alias("severity")), "src_ip", ["seq"], window)
    ordered = lambda v, *o: F.transform(F.array_sort(F.collect_list(F.struct(*o, F.col(v).alias("x")))), lambda e: e["x"])
    sev = s.groupBy("src_ip").agg(F.count("severity").alias("sev_n"), F.avg("severity").alias("sev_mean"), F.stddev_pop("severity").alias("sev_std"), ordered("severity", "seq").alias("sev_values"))
    b = last_n(bytes_pool(df), "src_ip", ["seq", "pos"], window).groupBy("src_ip").agg(ordered("bytes", "seq", "pos").alias("bytes_values"))
    return sev.join(b, "src_ip", "left")


def _split_hot(df: DataFrame, most: int, plain, split) -> DataFrame:
    """``plain`` over the rows of all addresses but those of over ``most`` rows, which ``split``
    takes. Most tables have none of these, and are read by ``plain`` alone."""
    hot = hot_keys(df.select("src_ip"), "src_ip", most).select("src_ip")
    if hot.isEmpty():
        return plain(df)
    hot = F.broadcast(hot)
    return plain(df.join(hot, "src_ip", "left_anti")).unionByName(split(df.join(hot, "src_ip", "left_semi")))


def online_baseline(df: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """Adds sev_n, sev_mean, sev_std of the ``window`` events before each one."""

    def over(d: DataFrame, w) -> DataFrame:
        w = w.rowsBetween(-window, -1)
        return d.withColumns({"sev_n": F.count("severity").over(w), "sev_mean": F.avg("severity").over(w), "sev_std": F.stddev_pop("severity").over(w)})

    def split(d: DataFrame) -> DataFrame:
        rows, w = over_last(ranked(d, "src_ip", ["seq"]), "src_ip", window)
        return over(rows, w).filter("_home").drop("_rank", "_block", "_home")

    return _split_hot(df.withColumn("src_ip", source_key()), hot, lambda d: over(d, Window.partitionBy("src_ip").orderBy("seq")), split)


def z_of(severity: Column, n: Column, mean: Column, std: Column) -> Column:
    """Distance from the mean in deviations, in either direction; 10 off a constant baseline."""
    d = F.abs(severity - mean)
    return F.when(F.coalesce(n, F.lit(0)) < 5, 0.0).when(std > 0, d / std).when(d > 1e-4, 10.0).otherwise(0.0)


def severity_z(df: DataFrame, baseline: DataFrame) -> DataFrame:
    b = baseline.select("src_ip", "sev_n", "sev_mean", "sev_std")
    return df.withColumn("src_ip", source_key()).join(b, "src_ip", "left").withColumn("z", z_of(F.col("severity").cast("double"), F.col("sev_n"), F.col("sev_mean"), F.col("sev_std")))


def iqr_bounds(values: Column) -> tuple[Column, Column]:
    v, n = F.sort_array(values), F.size(values)
    q1, q3 = F.get(v, F.floor(n / 4).cast("int")), F.get(v, F.floor(3 * n / 4).cast("int"))
    ok = n >= 10
    return F.when(ok, q1 - 1.5 * (q3 - q1)), F.when(ok, q3 + 1.5 * (q3 - q1))


def bytes_outlier(df: DataFrame, baseline: DataFrame) -> DataFrame:
    """Adds bytes_outlier: bytes_in outside 1.5 quartile ranges; needs ten values."""
    low, high = iqr_bounds(F.col("bytes_values"))
    b = baseline.select("src_ip", low.alias("_lo"), high.alias("_hi"))
    x = F.col("bytes_in").cast("double")
    return df.withColumn("src_ip", source_key()).join(b, "src_ip", "left").withColumn("bytes_outlier", F.coalesce((x > 0) & ((x < F.col("_lo")) | (x > F.col("_hi"))), F.lit(False))).drop("_lo", "_hi")


def _range_counts(rows: DataFrame, seconds: int) -> DataFrame:
    """(src_ip, unix_ts, _near): the rows of an address within ``seconds`` up to each of its
    times, from ``ranked`` rows in the order of time.

    The last rank at a time is the number of rows up to it, so a range is a difference of two
    of them. Times are grouped in blocks of ``seconds`` or more: the rank before a range is
    found in the block or in the one before it, or else is what all earlier blocks hand on."""
    width = max(seconds, 1 << 12)
    cells = rows.groupBy("src_ip", "unix_ts").agg(F.max("_rank").alias("_up_to"))
    # rows without a time stand before all others
    cells = cells.withColumn("_b", F.coalesce(F.floor(F.col("unix_ts") / width), F.lit(-(1 << 50))))
    older = Window.partitionBy("src_ip").orderBy("_b").rangeBetween(Window.unboundedPreceding, -2)
    blocks = cells.groupBy("src_ip", "_b").agg(F.max("_up_to").alias("_end")).select("src_ip", "_b", F.max("_end").over(older).alias("_older"))
    both = cells.withColumn("_at", F.explode(F.array(F.col("_b"), F.col("_b") + 1)))
    inside = Window.partitionBy("src_ip", "_at").orderBy("unix_ts").rangeBetween(Window.unboundedPreceding, -(seconds + 1))
    both = both.withColumn("_in", F.max("_up_to").over(inside)).filter(F.col("_at") == F.col("_b"))
    out = both.join(blocks, ["src_ip", "_b"])
    return out.select("src_ip", "unix_ts", (F.col("_up_to") - F.coalesce("_in", "_older", F.lit(0))).alias("_near"))


def burst(df: DataFrame, window_seconds: int = 60, mult: float = 3.0, min_total: int = 15, min_recent: int = 10, last: int = 500, min_span: int = 10, hot: int = HOT) -> DataFrame:
    """Adds is_burst: the rate of the last ``window_seconds`` of event time is above ``mult``
    times the rate over the last ``last`` events of the address."""

    def plain(d: DataFrame) -> DataFrame:
        w = Window.partitionBy("src_ip").orderBy("unix_ts")
        # a range ends with all rows of one time, and so must the rows that it is compared with
        near = F.count(F.lit(1)).over(w.rangeBetween(-window_seconds, 0))
        rows = Window.partitionBy("src_ip").orderBy("unix_ts", "seq").rowsBetween(-(last - 1), 0)
        return d.withColumns({"_near": near, "_n": F.count(F.lit(1)).over(rows), "_first": F.min("unix_ts").over(rows)})

    def split(d: DataFrame) -> DataFrame:
        rows = ranked(d, "src_ip", ["unix_ts", "seq"])
        near = _range_counts(rows, window_seconds).select(F.col("src_ip").alias("_ip"), F.col("unix_ts").alias("_ts"), "_near")
        blocks, w = over_last(rows, "src_ip", last - 1)
        w = w.rowsBetween(-(last - 1), 0)
        out = blocks.withColumns({"_n": F.count(F.lit(1)).over(w), "_first": F.min("unix_ts").over(w)}).filter("_home")
        return out.join(near, (F.col("src_ip") == F.col("_ip")) & F.col("unix_ts").eqNullSafe(F.col("_ts"))).drop("_rank", "_block", "_home", "_ip", "_ts")

    d = _split_hot(df.withColumn("src_ip", source_key()), hot, plain, split).withColumn("_span", F.col("unix_ts") - F.col("_first"))
    hit = (F.col("_n") >= min_total) & (F.col("_span") >= min_span) & (F.col("_near") >= min_recent) & (F.col("_near") / window_seconds > mult * F.col("_n") / F.greatest(F.col("_span"), F.lit(1)))
    return d.withColumn("is_burst", hit).drop("_near", "_n", "_span", "_first")


def rare_category(df: DataFrame, share: DataFrame, threshold: float = 0.01, min_total: int = 100) -> DataFrame:
    """Adds is_rare; the table of shares has a row for each category of the closed set."""
    s = share.select(F.col("category").alias("_c"), ((F.col("share") < threshold) & (F.col("total") >= min_total)).alias("_rare"))
    return df.join(F.broadcast(s), F.col("category") == F.col("_c"), "left").withColumn("is_rare", F.coalesce("_rare", F.lit(False))).drop("_c", "_rare")


def auth_failure_chain(df: DataFrame, threshold: int = 5, block: int = BLOCK) -> DataFrame:
    """Adds chain and chain_fires: failures of an address since its last success. Only
    authentication events count; other outcomes neither add nor reset.

    Windows go over blocks of ``block`` sequence numbers, so that an address with any share
    of the events is many groups; what a block hands on to the next ones is one row."""
    auth = F.col("category") == "authentication"
    is_ = lambda outcome: F.coalesce(auth & (F.col("outcome") == outcome), F.lit(False))
    d = df.withColumn("src_ip", source_key()).withColumn("_b", F.coalesce(F.floor(F.col("seq") / block), F.lit(-1)))
    d = d.withColumn("_i", F.sum(is_("success").cast("int")).over(Window.partitionBy("src_ip", "_b").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_f", F.sum(is_("failure").cast("int")).over(Window.partitionBy("src_ip", "_b", "_i").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    # of each block: whether it has a success, and the failures after its last one
    ends = d.groupBy("src_ip", "_b").agg(F.max(F.struct("_i", "_f")).alias("_e"))
    by = Window.partitionBy("src_ip").orderBy("_b")
    ends = ends.withColumn("_g", F.sum((F.col("_e._i") > 0).cast("int")).over(by))
    ends = ends.withColumn("_open", F.sum("_e._f").over(Window.partitionBy("src_ip", "_g").orderBy("_b")))
    carried = ends.select("src_ip", "_b", F.coalesce(F.lag("_open").over(by), F.lit(0)).alias("_c"))
    d = d.join(carried, ["src_ip", "_b"])
    d = d.withColumn("chain", F.when(is_("failure"), F.col("_f") + F.when(F.col("_i") == 0, F.col("_c")).otherwise(0)).otherwise(0))
    return d.withColumn("chain_fires", F.col("chain") >= threshold).drop("_b", "_i", "_f", "_c")


# The texts of reasons are fixed values.
def score_anomalies(df: DataFrame, baseline: DataFrame, share: DataFrame, burst_args: dict | None = None) -> DataFrame:
    """Adds anomaly_score, anomaly_reasons, is_anomalous, risk_score; null below 0.15."""
    d = severity_z(df, baseline)
    d = bytes_outlier(d, baseline)
    d = auth_failure_chain(burst(d, **(burst_args or {})))
    d = rare_category(d, share)
    ip, z = F.col("src_ip"), F.col("z")
    threat = F.coalesce(F.col("threat_ip_detected"), F.lit(False)) if "threat_ip_detected" in df.columns else F.lit(False)
    intel = F.array_join("threat_intel", ", ") if "threat_intel" in df.columns else F.lit("")
    signs = [
        (z >= 3, "z_high", F.format_string("Severity z-score=%.1fσ (>3σ from baseline for %s)", z, ip)),
        ((z >= 2) & (z < 3), "z_medium", F.format_string("Elevated severity z-score=%.1fσ for %s", z, ip)),
        (F.col("bytes_outlier"), "bytes", F.format_string("Unusual bytes_in=%.0f (IQR outlier for %s)", F.col("bytes_in").cast("double"), ip)),
        (F.col("is_burst"), "burst", F.format_string("Event burst detected from %s (>3x baseline rate)", ip)),
        (F.col("is_rare"), "rare", F.format_string("Rare event category: '%s' (<1%% of historical events)", F.col("category"))),
        (threat, "threat", F.concat(F.lit("Threat intelligence match for "), ip, F.lit(": "), F.coalesce(intel, F.lit("")))),
        (F.col("chain_fires"), "auth_chain", F.format_string("Authentication failure chain: %d failures from %s", F.col("chain"), ip)),
    ]
    total = F.lit(0.0)
    for cond, name, _ in signs:
        total = total + F.when(cond, WEIGHTS[name]).otherwise(0.0)
    d = d.withColumn("_s", F.least(F.lit(1.0), F.round(total, 3)))
    d = d.withColumn("_why", F.array_compact(F.array(*[F.when(c, why) for c, _, why in signs])))
    sev = F.when(F.col("severity") == 0, 5.0).otherwise(F.coalesce(F.col("severity").cast("double"), F.lit(5.0)))
    seen = F.col("_s") >= ANNOTATE
    return d.withColumns(
        {
            "anomaly_score": F.when(seen, F.col("_s")),
            "anomaly_reasons": F.when(seen, F.col("_why")),
            "is_anomalous": F.when(seen, F.col("_s") >= ANOMALOUS),
            "risk_score": F.when(seen, F.bround(F.least(F.lit(10.0), sev * (1 + F.col("_s"))), 1)),
        }
    ).drop("_s", "_why")


def analyze(df: DataFrame, window: int = WINDOW, burst_args: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Two passes over a table of events: the anomalies, and the summary."""
    from loglake.operators.stats import category_share

    scored = score_anomalies(df, build_baseline(df, window), category_share(df), burst_args)
    hit = F.count_if(F.coalesce("is_anomalous", F.lit(False)))
    n = F.count(F.lit(1))
    summary = scored.agg(n.alias("total"), F.count("anomaly_score").alias("annotated"), hit.alias("anomalous"), F.coalesce(F.round(100 * hit / n, 2), F.lit(0.0)).alias("rate_pct"))
    return scored.filter("anomaly_score IS NOT NULL"), summary


def write_baseline(b: DataFrame, path: str) -> None:
    """Keeps the last hundred values of each address."""
    keep = lambda c: F.slice(c, F.greatest(F.lit(1), F.size(c) - SAVED + 1), SAVED).alias(c)
    b.select("src_ip", keep("sev_values"), keep("bytes_values")).write.mode("overwrite").parquet(path)


def _with_stats(b: DataFrame) -> DataFrame:
    n = F.size("sev_values")
    mean = F.aggregate("sev_values", F.lit(0.0), lambda a, x: a + x) / n
    b = b.withColumn("sev_n", n.cast("long")).withColumn("sev_mean", F.when(n > 0, mean))
    var = F.aggregate(F.transform("sev_values", lambda x: (x - F.col("sev_mean")) * (x - F.col("sev_mean"))), F.lit(0.0), lambda a, x: a + x) / n
    return b.withColumn("sev_std", F.when(n > 0, F.sqrt(var))).select("src_ip", "sev_n", "sev_mean", "sev_std", "sev_values", "bytes_values")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return _with_stats(spark.read.parquet(path))


def merge_baseline(old: DataFrame, new: DataFrame, window: int = WINDOW) -> DataFrame:
    """The old values and then the new ones of each address, the last ``window`` of them."""
    empty = F.array().cast("array<double>")
    j = old.select("src_ip", F.col("sev_values").alias("s0"), F.col("bytes_values").alias("b0")).join(new.select("src_ip", F.col("sev_values").alias("s1"), F.col("bytes_values").alias("b1")), "src_ip", "full")

    def last(a, b):
        v = F.concat(F.coalesce(a, empty), F.coalesce(b, empty))
        return F.slice(v, F.greatest(F.lit(1), F.size(v) - window + 1), window)

    return _with_stats(j.select("src_ip", last("s0", "s1").alias("sev_values"), last("b0", "b1").alias("bytes_values")))
