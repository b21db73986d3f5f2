"""Scalar helpers as column expressions: times, addresses, numbers, text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Layouts of timestamps that are tried in turn, after ISO 8601.
TIME_LAYOUTS = [
    "yyyy MMM d HH:mm:ss",
    "yyyy/MM/dd HH:mm:ss",
    "MMM d yyyy HH:mm:ss",
    "d MMM yyyy HH:mm:ss",
    "dd/MMM/yyyy:HH:mm:ss Z",
    "d MMM yyyy HH:mm:ss Z",  # behind a weekday, see WEEKDAY
    "MM/dd/yyyy HH:mm:ss",
    "yyyyMMdd'T'HHmmss'Z'",
]

#: Spark has no letter for it when it parses, and refuses a layout that has one: the expressions
#: around it are then interpreted, and rows that come as far as the layout raise.
WEEKDAY = "^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), "

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_H = r"[0-9A-Fa-f]{1,4}"
IPV6 = (
    rf"^(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,7}}:|(?:{_H}:){{1,6}}:{_H}|(?:{_H}:){{1,5}}(?::{_H}){{1,2}}"
    rf"|(?:{_H}:){{1,4}}(?::{_H}){{1,3}}|(?:{_H}:){{1,3}}(?::{_H}){{1,4}}|(?:{_H}:){{1,2}}(?::{_H}){{1,5}}"
    rf"|{_H}:(?::{_H}){{1,6}}|:(?:(?::{_H}){{1,7}}|:))$"
)


def once(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Adds columns that are evaluated once a row. The optimizer merges projections and then
    copies an expression into each of its uses; a generator of one row stands between. The
    expressions are in the projection before it, which is compiled: those inside a generator
    are interpreted as soon as one of them has a lambda."""
    kept = [c for c in df.columns if c not in cols]
    made = df.select(*kept, F.struct(*[c.alias(k) for k, c in cols.items()]).alias("_made"))
    return made.select(*kept, F.explode(F.array("_made")).alias("_once")).select(*kept, *[F.col(f"_once.{k}").alias(k) for k in cols])


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def parse_ts(c: Column) -> Column:
    """A timestamp from text: whole numbers by magnitude (seconds, milli- or microseconds;
    beyond 1e17 null), else a calendar time. Without an offset it is UTC."""
    return let(F.trim(c), parse_trimmed)


def parse_trimmed(s: Column) -> Column:
    """The same for text without blanks around it in a column of its own: it is used often."""
    n = s.try_cast("bigint")
    size = F.abs(n)
    number = F.when(size >= F.lit(10**17), F.lit(None).cast("timestamp"))
    number = number.when(size >= F.lit(10**14), F.timestamp_micros(n)).when(size >= F.lit(10**11), F.timestamp_millis(n)).otherwise(F.timestamp_seconds(n))
    iso = s.try_cast("timestamp")
    one_space = F.regexp_replace(s, r"\s+", " ")
    text = lambda p: F.when(one_space.rlike(WEEKDAY), F.regexp_replace(one_space, WEEKDAY, "")) if p == "d MMM yyyy HH:mm:ss Z" else one_space
    calendar = F.when(s.rlike(r"^\d{4}-"), iso).otherwise(F.coalesce(*[F.try_to_timestamp(text(p), F.lit(p)) for p in TIME_LAYOUTS], iso))
    whole = s.rlike(r"^-?\d{9,}$")
    return F.when(s.isNull() | (s == ""), F.lit(None).cast("timestamp")).when(whole & (n.isNull() | (size >= F.lit(10**8))), number).otherwise(calendar)


def parse_ts_residue(c: Column) -> Column:
    """The same for free-form text, by an Arrow batch function; for rows that parse_ts leaves null."""
    @F.pandas_udf("timestamp")
    def free(values: pd.Series) -> pd.Series:
        from dateutil import parser

        def one(v):
            try:
                t = pd.Timestamp(parser.parse(v))
                return t.tz_localize("UTC") if t.tzinfo is None else t.tz_convert("UTC")
            except (ValueError, OverflowError, TypeError):
                return pd.NaT

        return pd.to_datetime(pd.Series([one(v) for v in values], index=values.index), utc=True)

    return F.coalesce(parse_ts(c), free(F.when(parse_ts(c).isNull() & c.isNotNull(), c)))


def iso(ts: Column) -> Column:
    """ISO 8601 text in UTC, with microseconds where there are any."""
    return F.when(F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))


def valid_ip(c: Column) -> Column:
    s = F.trim(c)
    return F.when(F.when(s.contains(":"), s.rlike(IPV6)).otherwise(s.rlike(IPV4)), s)


def is_ipv6(c: Column) -> Column:
    """Whether it is an IPv6 address; the long pattern runs on text with a colon only."""
    return c.contains(":") & c.rlike(IPV6)


def safe_int(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("bigint"))


def safe_double(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def safe_port(c: Column) -> Column:
    n = safe_int(c)
    return F.when(n.between(0, 65535), n)


def strip_quotes(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"""(?s)^(["'])(.*)\1$""", "$2")


def bsd_text(c: Column, reference_year: int) -> Column:
    """BSD syslog times have no year: it is a parameter."""
    return F.when(c.rlike(r"^\d{4}"), c).otherwise(F.concat(F.lit(f"{reference_year} "), F.regexp_replace(c, r"\s+", " ")))


def escape_like(term: str) -> str:
    return term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def cef_header(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def _newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n|\n|\r", r"\\n")


def cef_value(c: Column) -> Column:
    return _newlines(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("="), F.lit("\\=")))


def leef_value(c: Column) -> Column:
    return _newlines(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")))


def safe_key(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[^\p{L}\p{N}_]", "_")


def win_basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^\\/]+)[\\/]*$", 1)


def azure_resource(c: Column) -> Column:
    """Parts of a resource id: subscription_id, resource_group, provider, resource_type, resource_name."""
    p = F.filter(F.split(c, "/"), lambda x: x != "")
    at = lambda i: F.try_element_at(p, F.lit(i))
    has = lambda i, word: F.lower(at(i)) == word
    prov = has(5, "providers")
    deep = prov & (F.size(p) >= 8)
    return F.struct(
        F.when(has(1, "subscriptions"), at(2)).alias("subscription_id"),
        F.when(has(3, "resourcegroups"), at(4)).alias("resource_group"),
        F.when(prov, at(6)).alias("provider"),
        F.when(deep, at(7)).alias("resource_type"),
        F.when(deep, at(8)).alias("resource_name"),
    )


def ip_num(c: Column) -> Column:
    """IPv4 text as a number; null for all else."""
    n = F.lit(0).cast("bigint")
    for i in range(4):
        n = n * 256 + F.substring_index(F.substring_index(c, ".", i + 1), ".", -1).try_cast("bigint")
    return F.when(c.rlike(IPV4), n)


def ip_hex(c: Column) -> Column:
    """IPv6 text as 32 hexadecimal digits, which sort as the addresses do; null for all else."""
    digits = lambda part: F.filter(F.split(F.coalesce(part, F.lit("")), ":"), lambda g: g != "")
    halves = F.split(F.lower(c), "::")
    whole = let(
        F.struct(digits(F.get(halves, F.lit(0))).alias("a"), digits(F.get(halves, F.lit(1))).alias("z")),
        lambda p: F.array_join(F.transform(F.concat(p["a"], F.array_repeat(F.lit("0"), 8 - F.size(p["a"]) - F.size(p["z"])), p["z"]), lambda g: F.lpad(g, 4, "0")), ""),
    )
    return F.when(is_ipv6(c), whole)
