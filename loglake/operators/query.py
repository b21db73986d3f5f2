"""The query surface: filters, search, sorting, pages, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.functions.scalars import escape_like

#: Filters by equality: argument and column of the flat table.
EQUAL = {"tenant_id": "tenant_id", "vendor": "vendor", "category": "category", "outcome": "outcome", "action": "action", "parser": "parser_name"}
SEARCHED = ["event_id", "vendor", "product", "device_hostname", "src_ip", "dst_ip", "username", "action", "category", "rule_name", "raw_payload", "src_port", "dst_port"]
SORTABLE = ["ingest_timestamp", "source_event_timestamp", "severity_numeric", "category", "vendor", "outcome", "action", "src_ip", "dst_ip", "username"]
MOST_ROWS = 1000


def filter_events(df: DataFrame, severity_min=None, severity_max=None, time_from=None, time_to=None, **equal) -> DataFrame:
    """A conjunction; arguments that are None do not filter."""
    for k, v in equal.items():
        if v is not None:
            df = df.filter(F.col(EQUAL[k]) == v)
    t = F.coalesce("source_event_timestamp", "ingest_timestamp")
    for v, cond in ((severity_min, F.col("severity_numeric") >= severity_min), (severity_max, F.col("severity_numeric") <= severity_max), (time_from, t >= time_from), (time_to, t <= time_to)):
        if v is not None:
            df = df.filter(cond)
    return df


def search_events(df: DataFrame, term: str, columns: list[str] | None = None) -> DataFrame:
    """Rows with the term, in any case, in one of the searched columns."""
    pattern = f"%{escape_like(term)}%"
    hit = F.lit(False)
    for c in columns or [c for c in SEARCHED if c in df.columns]:
        hit = hit | F.coalesce(F.col(c).cast("string").ilike(pattern), F.lit(False))
    return df.filter(hit)


def above_score(df: DataFrame, min_score: float) -> DataFrame:
    return df.filter(F.col("anomaly_score") >= min_score)


DB_PORTS = [1433, 1521, 3306, 5432, 6379, 27017]


def filter_connections(df: DataFrame, kind: str = "all", search: str | None = None) -> DataFrame:
    """Connections: all, clean (no threat), db, remote or localhost, with a text search."""
    local = F.col("dst_ip").startswith("127.") | F.col("dst_ip").isin("::1", "0.0.0.0", "localhost")
    port = F.col("dst_port").isin(DB_PORTS) | F.col("src_port").isin(DB_PORTS)
    cond = {"all": F.lit(True), "clean": ~F.coalesce(F.col("is_threat"), F.lit(False)) if "is_threat" in df.columns else F.lit(True), "db": port, "remote": ~local, "localhost": local}[kind]
    df = df.filter(F.coalesce(cond, F.lit(False)))
    return search_events(df, search, [c for c in ("process", "src_ip", "dst_ip", "service", "src_port", "dst_port") if c in df.columns]) if search else df


def filter_sources(df: DataFrame, kind: str = "all", search: str | None = None) -> DataFrame:
    """Sources: all, declarative, builtin, healthy or issues, with a text search."""
    healthy = F.col("health") == "healthy"
    cond = {"all": F.lit(True), "declarative": F.col("source_type") == "declarative", "builtin": F.col("source_type") != "declarative", "healthy": healthy, "issues": ~healthy}[kind]
    df = df.filter(cond)
    return search_events(df, search, [c for c in ("source_id", "vendor", "product") if c in df.columns]) if search else df


def _key(sort_by: str) -> Column:
    if sort_by in ("time", "source_event_timestamp"):
        return F.coalesce("source_event_timestamp", "ingest_timestamp")
    return F.col(sort_by if sort_by in SORTABLE else "ingest_timestamp")


def sort_events(df: DataFrame, sort_by: str = "time", order: str = "desc") -> DataFrame:
    """By an allowed key, else by ingest time; nulls are the least; ids break ties."""
    k = _key(sort_by)
    return df.orderBy(k.asc_nulls_first() if order == "asc" else k.desc_nulls_last(), "event_id")


def page(df: DataFrame, number: int = 1, size: int = 50) -> tuple[DataFrame, int, int]:
    """A page of a sorted table, the total and the number of pages."""
    number, size = max(1, number), min(MOST_ROWS, max(1, size))
    total = df.count()
    return df.offset((number - 1) * size).limit(size), total, max(1, -(-total // size))


def page_after(df: DataFrame, after_time: str, after_id: str, size: int = 50) -> DataFrame:
    """The page after a row in descending order of time: deep pages cost no more than early ones."""
    t = _key("time")
    return sort_events(df.filter((t < after_time) | ((t == after_time) & (F.col("event_id") > after_id)))).limit(min(MOST_ROWS, size))


def get_event(df: DataFrame, event_id: str) -> DataFrame:
    return df.filter(F.col("event_id") == event_id)


def top_anomalies(df: DataFrame, n: int = 20, min_score: float = 0.0) -> DataFrame:
    return above_score(df, min_score).orderBy(F.desc("anomaly_score"), "event_id").limit(n)


def dead_letter_page(dlq: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """Dead letters, newest first."""
    size = min(MOST_ROWS, max(1, size))
    return dlq.orderBy(F.desc_nulls_last("timestamp"), F.desc("event_id")).offset((max(1, number) - 1) * size).limit(size)


def recent(df: DataFrame, n: int = 250, order: str = "ingest_timestamp") -> DataFrame:
    return df.orderBy(F.desc(order), "event_id").limit(min(MOST_ROWS, n))


def event_detail(events: DataFrame, archive: DataFrame, ids: DataFrame) -> DataFrame:
    """Events by id with their payload: from the archive, else the copy in the event."""
    e = events.join(ids.select("event_id"), "event_id", "left_semi")
    a = archive.select("event_id", F.col("raw_bytes").cast("string").alias("_p"))
    return e.join(a, "event_id", "left").withColumn("payload", F.coalesce("_p", "raw_payload")).drop("_p")


def parser_health(events: DataFrame, parsers: DataFrame) -> DataFrame:
    """Every parser of the registry with its count of events, 0 if none, and a status."""
    n = events.groupBy("parser_name").agg(F.count(F.lit(1)).alias("n_events"))
    j = parsers.join(n, "parser_name", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))
    return j.withColumn("status", F.when(F.col("n_events") > 0, "active").otherwise("idle"))


def semi(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")
