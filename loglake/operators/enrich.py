"""Enrichment: addresses against lists of networks, and chains of enrichers."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.functions.scalars import ip_hex, ip_num, is_ipv6, once, valid_ip

Enricher = Callable[[DataFrame], DataFrame]

# Networks of known abuse, and of cloud and delivery providers in the order
# in which the first match wins.
THREAT_NETWORKS = [
    ("185.220.100.0/22", "Tor exit nodes (torproject.org bulk list)"),
    ("185.220.101.0/24", "Tor exit nodes"),
    ("45.142.212.0/24", "Known scanner / Shodan-crawled malicious"),
    ("194.165.16.0/22", "Bulletproof hosting (AS49877)"),
    ("195.54.160.0/23", "Known spam/botnet infrastructure"),
    ("5.188.206.0/24", "Bulletproof VPS provider"),
    ("192.42.116.0/22", "Tor exit nodes (NL)"),
    ("199.87.154.0/24", "Known malicious hosting"),
]
CLOUD_NETWORKS = [
    ("3.0.0.0/9", "AWS", "Amazon Web Services"),
    ("52.0.0.0/6", "AWS", "Amazon Web Services"),
    ("54.64.0.0/11", "AWS", "Amazon Web Services"),
    ("13.32.0.0/12", "AWS CloudFront", "Amazon Web Services"),
    ("13.64.0.0/11", "Azure", "Microsoft"),
    ("20.0.0.0/11", "Azure", "Microsoft"),
    ("40.64.0.0/10", "Azure", "Microsoft"),
    ("104.208.0.0/13", "Azure", "Microsoft"),
    ("34.0.0.0/9", "GCP", "Google"),
    ("35.184.0.0/13", "GCP", "Google"),
    ("104.154.0.0/15", "GCP", "Google"),
    ("130.211.0.0/22", "GCP Load Balancer", "Google"),
    ("103.21.244.0/22", "Cloudflare", "Cloudflare"),
    ("103.22.200.0/22", "Cloudflare", "Cloudflare"),
    ("173.245.48.0/20", "Cloudflare", "Cloudflare"),
    ("104.16.0.0/13", "Cloudflare", "Cloudflare"),
    ("108.162.192.0/18", "Cloudflare", "Cloudflare"),
    ("23.0.0.0/12", "Akamai", "Akamai Technologies"),
    ("2.16.0.0/13", "Akamai", "Akamai Technologies"),
    ("96.16.0.0/15", "Akamai", "Akamai Technologies"),
    ("23.235.32.0/20", "Fastly", "Fastly"),
    ("151.101.0.0/16", "Fastly", "Fastly"),
]
PRIVATE_NETWORKS = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "224.0.0.0/4", "240.0.0.0/4", "100.64.0.0/10"]

NETWORK_DDL = "cidr string, service string, vendor string, lo bigint, hi bigint, prefix_len int, rank int, lo6 string, hi6 string"
#: Lists of so many networks at most are probed in place, row by row.
IN_PLACE = 64


def network_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(cidr, label[, vendor]) as a table; rank is the order of the list. IPv4 networks have
    their ends as numbers, IPv6 ones as 32 hexadecimal digits."""
    out = []
    for i, (cidr, service, *vendor) in enumerate(rows):
        n = ipaddress.ip_network(cidr)
        lo, hi = int(n.network_address), int(n.broadcast_address)
        ends = (lo, hi, n.prefixlen, i, None, None) if n.version == 4 else (None, None, n.prefixlen, i, f"{lo:032x}", f"{hi:032x}")
        out.append((cidr, service, vendor[0] if vendor else None, *ends))
    return spark.createDataFrame(out, NETWORK_DDL)


def threat_table(spark: SparkSession) -> DataFrame:
    return network_table(spark, THREAT_NETWORKS)


def cloud_table(spark: SparkSession) -> DataFrame:
    return network_table(spark, CLOUD_NETWORKS)


def ip_class(c: Column, number: Column | None = None) -> Column:
    """loopback, link_local, multicast, private, public or invalid; null for null. The
    address's ``ip_num`` may be given, which is used for every network."""
    n, ok = ip_num(c) if number is None else number, valid_ip(c)
    inside = lambda cidr: n.between(int(ipaddress.ip_network(cidr)[0]), int(ipaddress.ip_network(cidr)[-1]))
    six, low = is_ipv6(c), F.lower(c)
    private = F.lit(False)
    for p in PRIVATE_NETWORKS:
        private = private | F.coalesce(inside(p), F.lit(False))
    return (
        F.when(c.isNull() | (c == ""), F.lit(None).cast("string"))
        .when(ok.isNull(), "invalid")
        .when(inside("127.0.0.0/8") | low.rlike(r"^(?:0{1,4}:){7}0{0,3}1$|^::(?:0{1,4}:)*0{0,3}1$"), "loopback")
        .when(inside("169.254.0.0/16") | (six & low.rlike("^fe[89ab][0-9a-f]:")), "link_local")
        .when(inside("224.0.0.0/4") | (six & low.rlike("^ff[0-9a-f]{2}:")), "multicast")
        .when(private, "private")
        .otherwise("public")
    )


def _inside(n: Column, h: Column, x) -> Column:
    return F.coalesce(n.between(x["lo"], x["hi"]), h.between(x["lo6"], x["hi6"]), F.lit(False))


def match_cidr(ips: DataFrame, networks: DataFrame, mode: str = "all", small: bool | None = None, ip_col: str = "ip") -> DataFrame:
    """(ip, matches): an array of (rank, cidr, service, vendor), all of them or the first.

    A small list is broadcast with a range condition; its size is counted first. A large
    feed is met by equality of (prefix length, prefix), one probe for each length in use;
    IPv6 prefixes are met by whole hexadecimal digits, and then by their range.
    """
    ip = F.col("ip")
    a = ips.select(F.col(ip_col).alias("ip")).distinct().withColumn("n", ip_num(ip)).withColumn("h", ip_hex(ip)).filter("n IS NOT NULL OR h IS NOT NULL")
    if small is None:
        small = networks.limit(2001).count() <= 2000
    if small:
        near = F.broadcast(networks)
        j = a.join(near, _inside(F.col("n"), F.col("h"), {k: F.col(k) for k in ("lo", "hi", "lo6", "hi6")}))
    else:
        lengths = networks.select("prefix_len", F.col("lo6").isNotNull().alias("six")).distinct()  # 33 and 129 at most
        prefix = lambda n, h: F.coalesce(F.expr(f"string(shiftright({n}, 32 - prefix_len))"), F.expr(f"left({h}, prefix_len div 4)"))
        probes = a.join(F.broadcast(lengths), F.col("six") == F.col("n").isNull()).withColumn("p", prefix("n", "h"))
        j = probes.join(networks.withColumn("p", prefix("lo", "lo6")).withColumn("six", F.col("lo6").isNotNull()), ["six", "prefix_len", "p"])
        j = j.filter(F.col("n").isNotNull() | F.col("h").between(F.col("lo6"), F.col("hi6")))
    hit = F.struct("rank", "cidr", "service", "vendor")
    if mode == "first":
        return j.groupBy("ip").agg(F.array(F.min(hit)).alias("matches"))
    return j.groupBy("ip").agg(F.array_sort(F.collect_list(hit)).alias("matches"))


def matches_of(n: Column, h: Column, networks: list) -> Column:
    """The same for one address (ip_num and ip_hex) and a short list of rows, as a column: no
    join. Each network is a condition of its own, as these are compiled and lambdas are not; the
    array is made for addresses that are in one of them."""
    none = F.array().cast("array<struct<rank: int, cidr: string, service: string, vendor: string>>")
    hits, some = [], F.lit(False)
    for r in sorted(networks, key=lambda r: r["rank"]):
        inside = n.between(F.lit(r["lo"]).cast("bigint"), F.lit(r["hi"]).cast("bigint")) if r["lo6"] is None else h.between(F.lit(r["lo6"]), F.lit(r["hi6"]))
        some = some | F.coalesce(inside, F.lit(False))
        hits.append(F.when(inside, F.struct(F.lit(r["rank"]).cast("int").alias("rank"), *[F.lit(r[k]).cast("string").alias(k) for k in ("cidr", "service", "vendor")])))
    return F.when(some, F.array_compact(F.array(*hits))).otherwise(none) if hits else none


def matches_in(ip: Column, networks: list) -> Column:
    return matches_of(ip_num(ip), ip_hex(ip), networks)


def _context(ip: Column, kind: Column, threats: Column, cloud: Column) -> Column:
    """The context of an address of a kind, with its matches (an empty or null array: none)."""
    public = kind == "public"
    return F.struct(
        ip.alias("ip"),
        kind.alias("ip_type"),
        F.when(kind.isin("loopback", "link_local", "private"), True).when(kind.isin("multicast", "public"), False).alias("is_internal"),
        F.when(public, True).when(kind == "private", False).alias("is_public"),
        F.when(public, F.coalesce(F.size(threats) > 0, F.lit(False))).when(kind == "private", False).alias("is_threat"),
        F.when(public & (F.size(threats) > 0), F.transform(threats, lambda x: x["service"])).alias("threat_intel"),
        F.when(public, F.get(cloud, F.lit(0))["vendor"]).alias("cloud_provider"),
        F.when(public, F.get(cloud, F.lit(0))["service"]).alias("cloud_service"),
    )


def ip_context(ips: DataFrame, threat: DataFrame, cloud: DataFrame, ip_col: str = "ip") -> DataFrame:
    """(ip, context) for distinct addresses."""
    base = ips.select(F.col(ip_col).alias("ip")).filter("ip IS NOT NULL AND ip <> ''").distinct().withColumn("ip_type", ip_class(F.col("ip")))
    t = match_cidr(base, threat).withColumnRenamed("matches", "t")
    c = match_cidr(base, cloud, "first").withColumnRenamed("matches", "c")
    j = base.join(t, "ip", "left").join(c, "ip", "left")
    return j.select("ip", _context(F.col("ip"), F.col("ip_type"), F.col("t"), F.col("c")).alias("context"))


def enrich_ips(df: DataFrame, threat: DataFrame, cloud: DataFrame) -> DataFrame:
    """Sets the contexts of both addresses and threat_ip_detected; severity is not changed.

    Lists of ``IN_PLACE`` networks at most are probed in each row, so that the events are
    read once and not shuffled. For larger ones the distinct addresses are classified once
    and joined back."""
    src, dst = F.col("network.src_ip"), F.col("network.dst_ip")
    lists = [x.limit(IN_PLACE + 1).collect() for x in (threat, cloud)]
    if all(len(x) <= IN_PLACE for x in lists):
        ends, n, h = {"_s": src, "_d": dst}, lambda k: F.col(k + "n"), lambda k: F.col(k + "h")
        j = once(df, {k + x: f(ip) for k, ip in ends.items() for x, f in (("n", ip_num), ("h", ip_hex))})
        j = once(j, {k + x: c for k, ip in ends.items() for x, c in (("k", ip_class(ip, n(k))), *((x, matches_of(n(k), h(k), rows)) for x, rows in zip("tl", lists)))})
        j = once(j, {k + "c": F.when(F.coalesce(ip != "", F.lit(False)), _context(ip, F.col(k + "k"), F.col(k + "t"), F.col(k + "l"))) for k, ip in ends.items()})
    else:
        ips = df.select(F.explode(F.array_distinct(F.array(src, dst))).alias("ip"))
        ctx = ip_context(ips, threat, cloud)
        s, d = ctx.select(F.col("ip").alias("_s"), F.col("context").alias("_sc")), ctx.select(F.col("ip").alias("_d"), F.col("context").alias("_dc"))
        j = df.join(s, src == F.col("_s"), "left").join(d, dst == F.col("_d"), "left")
    hit = F.coalesce(F.col("_sc.is_threat"), F.lit(False)) | F.coalesce(F.col("_dc.is_threat"), F.lit(False))
    e = F.struct(F.col("_sc").alias("src_ip_context"), F.col("_dc").alias("dst_ip_context"), F.when(hit, True).alias("threat_ip_detected"), F.lit(None).cast("array<string>").alias("threat_intel_tags"))
    return j.withColumn("enrichment", e).select(*dict.fromkeys([*df.columns, "enrichment"]))


#: The names of the enrichers that failed on a row.
ERRORS = "enrichment_errors"


def _errors(df: DataFrame) -> Column:
    return F.col(ERRORS) if ERRORS in df.columns else F.array().cast("array<string>")


def row_enricher(name: str, column: str, ddl: str, fn: Callable, *inputs: str) -> Enricher:
    """Adds ``column`` by ``fn(*inputs)`` of a row. Where it raises, the column is null and the
    name is in ``enrichment_errors``; the row and all other enrichers go on."""
    import pandas as pd

    @F.pandas_udf(f"struct<value: {ddl}, failed: boolean>")
    def run(rows):
        out = []
        for row in rows.itertuples(index=False, name=None):
            try:
                out.append((fn(*[None if v is pd.NA or v != v else v for v in row]), False))
            except Exception:  # noqa: BLE001  an enricher's own error is its row's
                out.append((None, True))
        return pd.DataFrame(out, columns=["value", "failed"], dtype=object)

    def enrich(df: DataFrame) -> DataFrame:
        d = df.withColumn("_run", run(F.struct(*inputs)))
        return d.withColumns({column: F.col("_run.value"), ERRORS: F.concat(_errors(df), F.when(F.col("_run.failed"), F.array(F.lit(name))).otherwise(F.array()))}).drop("_run")

    return enrich


def guarded(name: str, enricher: Enricher, columns: dict[str, str], key: str = "event_id") -> Enricher:
    """An enricher over whole tables (joins with feeds, expressions that may raise) whose
    failure is its own: its ``columns`` (with types) are written by a job of their own and
    joined by ``key``. If the job fails they are null, or as they were, in all rows, and the
    name is in ``enrichment_errors``. Costs a pass over the events and a join."""
    from loglake.operators.ordered import written

    def enrich(df: DataFrame) -> DataFrame:
        try:
            side = written(enricher(df).select(F.col(key).alias("_key"), *[F.col(c).cast(t).alias(f"_new_{c}") for c, t in columns.items()]).dropDuplicates(["_key"]), "enriched")
        except Exception:  # noqa: BLE001  whatever a feed or an expression raises
            have = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
            return df.withColumns({**have, ERRORS: F.concat(_errors(df), F.array(F.lit(name)))})
        d = df.join(side, F.col(key) == F.col("_key"), "left").withColumns({c: F.col(f"_new_{c}") for c in columns})
        return d.withColumn(ERRORS, _errors(df)).drop("_key", *[f"_new_{c}" for c in columns])

    return enrich


def enrich_all(df: DataFrame, enrichers: list[Enricher]) -> DataFrame:
    """One enricher after the other. What cannot even be planned (a column or a feed that is
    not there) is left out and noted in ``enrichment_errors``; for failures at run time there
    are ``row_enricher`` and ``guarded``."""
    from pyspark.errors import PySparkException

    for e in enrichers:
        try:
            df = e(df)
        except PySparkException:
            df = df.withColumn(ERRORS, F.concat(_errors(df), F.array(F.lit(getattr(e, "__name__", "enricher")))))
    return df


def observe_failures(df: DataFrame, names: list[str]):
    """The table, and the number of rows on which each enricher failed, read off its next action."""
    from pyspark.sql import Observation

    o = Observation()
    return df.observe(o, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.array_contains(_errors(df), n)).alias(n) for n in names]), o


def optional_feed(spark: SparkSession, path: str) -> DataFrame:
    """A feed of networks; where it is missing or its files are broken, an empty one, so that
    the rest goes on. The feed is read once and kept as a table."""
    from pyspark.errors import PySparkException

    from loglake.operators.ordered import written

    try:
        return written(spark.read.schema(NETWORK_DDL).parquet(path), "feed")
    except (PySparkException, Py4JJavaError):
        return spark.createDataFrame([], NETWORK_DDL)
