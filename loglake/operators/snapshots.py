"""Tables of processes and connections, taken again and again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglake.operators.extract import lookup

# Names of well-known ports.
SERVICES = {
    20: "FTP-Data", 21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 53: "DNS", 67: "DHCP", 68: "DHCP", 80: "HTTP", 110: "POP3", 123: "NTP", 143: "IMAP", 161: "SNMP", 389: "LDAP",
    443: "HTTPS", 445: "SMB", 465: "SMTPS", 587: "SMTP", 636: "LDAPS", 993: "IMAPS", 995: "POP3S", 1433: "MSSQL", 1521: "Oracle", 3306: "MySQL", 3389: "RDP", 5432: "PostgreSQL",
    5900: "VNC", 6379: "Redis", 8080: "HTTP-Alt", 8443: "HTTPS-Alt", 27017: "MongoDB",
}


def resolve_processes(conns: DataFrame, procs: DataFrame, default: str = "System") -> DataFrame:
    """Connections with the name of their process in the same snapshot."""
    p = procs.select("host", "snap_ts", "pid", F.col("name").alias("process"))
    return conns.join(p, ["host", "snap_ts", "pid"], "left").withColumn("process", F.coalesce("process", F.lit(default)))


def label_services(df: DataFrame) -> DataFrame:
    """Adds service: by the remote port, else the local one, else the protocol."""
    name = lambda c: lookup(SERVICES, F.col(c).cast("int"))
    return df.withColumn("service", F.coalesce(name("dst_port"), name("src_port"), F.upper("proto")))


def snapshot_diff(df: DataFrame, keys: list[str], order: str = "snap_ts", group: str = "host") -> DataFrame:
    """(group, order, keys, change): what started and stopped between snapshots that follow
    one another. A row is compared with the same key's neighbours in time, so no snapshot
    is joined with another as a whole."""
    snaps = df.select(group, order).distinct()
    w = Window.partitionBy(group).orderBy(order)
    snaps = snaps.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead(order).over(w))
    rows = df.select(group, order, *keys).distinct().join(snaps, [group, order])
    k = Window.partitionBy(group, *keys).orderBy("_n")
    rows = rows.withColumn("_before", F.lag("_n").over(k)).withColumn("_after", F.lead("_n").over(k))
    started = rows.filter((F.col("_n") > 1) & ~F.col("_before").eqNullSafe(F.col("_n") - 1)).select(group, order, *keys, F.lit("started").alias("change"))
    stopped = rows.filter(F.col("_next").isNotNull() & ~F.col("_after").eqNullSafe(F.col("_n") + 1)).select(group, F.col("_next").alias(order), *keys, F.lit("stopped").alias("change"))
    return started.unionByName(stopped)


def snapshot_diff_anti(df: DataFrame, keys: list[str], order: str = "snap_ts", group: str = "host") -> DataFrame:
    """The same by anti joins of each snapshot with its neighbour."""
    w = Window.partitionBy(group).orderBy(order)
    snaps = df.select(group, order).distinct().withColumn("_n", F.row_number().over(w))
    rows = df.select(group, order, *keys).distinct().join(snaps, [group, order])
    on = [group, "_n", *keys]
    shifted = lambda by: rows.select(group, (F.col("_n") + by).alias("_n"), *keys)
    last = snaps.groupBy(group).agg(F.max("_n").alias("_last"))
    started = rows.filter("_n > 1").join(shifted(1), on, "left_anti").select(group, "_n", *keys, F.lit("started").alias("change"))
    stopped = shifted(1).join(rows.select(*on), on, "left_anti").join(last, group).filter("_n <= _last").select(group, "_n", *keys, F.lit("stopped").alias("change"))
    return started.unionByName(stopped).join(snaps, [group, "_n"]).select(group, order, *keys, "change")


def first_seen(df: DataFrame, keys: list[str], order: list[str] | str = "snap_ts") -> DataFrame:
    """The first row of every key."""
    o = [order] if isinstance(order, str) else order
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*o))).filter("_r = 1").drop("_r")
