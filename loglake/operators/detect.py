"""Format detection: one chain of conditions over the trimmed line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.functions.scalars import once

# The marks of the built-in formats, in order of precedence.
ASA = r"%ASA-\d-\d+"
CEF = r"(?:^|\s)CEF:\d"
LEEF = r"(?:^|\s)LEEF:[0-9.]+\|"
RFC5424 = r"^<\d+>1\s"
XML = r"^(?:<\?xml|<[a-zA-Z_])"
RFC3164 = r"^<\d+>(?:(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s|\d{4}-)"
KEY_VALUE = r"\b\w+=\S+"

FORMATS = ["cisco_asa", "cef", "leef", "syslog_rfc5424", "xml_generic", "aws_cloudtrail", "gcp_audit", "azure_monitor", "json_passthrough", "paloalto_csv", "syslog_rfc3164"]

#: User formats: (name, condition, extraction); see register_format.
REGISTERED: list[tuple] = []


def register_format(name: str, predicate, extract) -> None:
    """Add a format after the built-in ones. ``predicate`` and ``extract`` take the line's
    column and return a boolean column and a map of strings."""
    unregister_format(name)
    REGISTERED.append((name, predicate, extract))


def unregister_format(name: str) -> None:
    REGISTERED[:] = [r for r in REGISTERED if r[0] != name]


def valid_json(s: Column) -> Column:
    """Spark's parser takes text after an object, so the line must also end in a brace."""
    return s.startswith("{") & s.endswith("}") & F.try_parse_json(s).isNotNull()


def json_kind(s: Column) -> Column:
    """The JSON family of a trimmed line; null if it is not a JSON object."""
    has = lambda k: F.get_json_object(s, f"$.{k}").isNotNull()
    val = lambda k: F.get_json_object(s, f"$.{k}")
    trail = has("eventVersion") & val("eventSource").endswith(".amazonaws.com")
    gcp = (has("logName") | has("insertId")) & F.get_json_object(s, "$.protoPayload['@type']").startswith("type.googleapis.com/google.cloud.audit")
    azure = has("operationName") & has("resourceId") & (has("resultType") | has("category"))
    kind = F.when(trail, "aws_cloudtrail").when(gcp, "gcp_audit").when(azure, "azure_monitor").otherwise("json_passthrough")
    return F.when(valid_json(s), kind)


def is_pan_traffic(s: Column) -> Column:
    """Thirty fields or more, the third of them TRAFFIC; commas in quotes do not count."""
    plain = F.regexp_replace(s, '"[^"]*"', "")
    third = F.upper(F.trim(F.regexp_replace(F.regexp_extract(s, r'^(?:(?:"[^"]*"|[^",]*),){2}("[^"]*"|[^",]*)', 1), '"', "")))
    return s.contains("TRAFFIC") & (F.size(F.split(plain, ",")) >= 30) & (third == "TRAFFIC")


FORMAT_PREDICATES = [
    ("cisco_asa", lambda s: s.rlike(ASA)),
    ("cef", lambda s: s.rlike(CEF)),
    ("leef", lambda s: s.rlike(LEEF)),
    ("syslog_rfc5424", lambda s: s.rlike(RFC5424)),
    ("xml_generic", lambda s: s.rlike(XML)),
]


def format_of(line: Column, declarative: list | None = None, declarative_first: bool = False) -> Column:
    s = F.trim(F.btrim(line, F.lit(" \t\r\n")))
    named = [(r.name, r.predicate(line)) for r in declarative or [] if r.enabled]
    chain = F.when(F.lit(False), F.lit(""))
    for name, p in named if declarative_first else []:
        chain = chain.when(p, name)
    for name, p in FORMAT_PREDICATES:
        chain = chain.when(p(s), name)
    kind = json_kind(s)
    chain = chain.when(kind.isNotNull(), kind).when(is_pan_traffic(s), "paloalto_csv").when(s.rlike(RFC3164), "syslog_rfc3164")
    for name, p in [] if declarative_first else named:
        chain = chain.when(p, name)
    for name, p, _ in REGISTERED:
        chain = chain.when(p(line), name)
    # the wide match of a plain syslog line comes last among the built-in ones
    return chain.when(s.rlike(r"^<\d+>"), "syslog_rfc3164").when(s.rlike(KEY_VALUE), "kv").otherwise("unknown")


def detect_format(df: DataFrame, overrides: list[tuple[str, str]] | DataFrame | None = None, declarative: list | None = None, declarative_first: bool = False) -> DataFrame:
    """Adds format_id. Overrides are (source-tag prefix, format) and the first that fits
    wins: a short list becomes conditions, a table (prefix, format, rule_order) a join."""
    found = format_of(F.col("line"), declarative, declarative_first)
    if isinstance(overrides, DataFrame):
        rules = F.broadcast(overrides.select("prefix", "format", "rule_order"))
        tags = df.select("source_tag").distinct()
        best = tags.join(rules, F.col("source_tag").startswith(F.col("prefix"))).groupBy("source_tag").agg(F.min_by("format", "rule_order").alias("_o"))
        return df.join(best, "source_tag", "left").transform(lambda d: once(d, {"format_id": F.coalesce("_o", found)})).drop("_o")
    chain = F.when(F.lit(False), F.lit(""))
    for prefix, fmt in overrides or []:
        chain = chain.when(F.col("source_tag").startswith(prefix), fmt)
    return once(df, {"format_id": F.coalesce(chain, found)})


def format_profile(df: DataFrame) -> DataFrame:
    """Lines per source and format."""
    return df.groupBy("source_tag", "format_id").agg(F.count(F.lit(1)).alias("n"))
