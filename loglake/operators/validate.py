"""The schema gate, and the dead letters of all stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.functions.scalars import iso
from loglake.schema import CATEGORIES, DIRECTIONS, OUTCOMES, SCHEMA_VERSION, dead_letter_schema


def _rules() -> list[tuple[Column, str]]:
    """(condition of an error, message), in the order of the schema."""
    c = F.col
    missing = [(c(k).isNull(), f"'{k}' is a required property") for k in ("event_id", "ingest_timestamp", "raw", "source", "event", "lineage")]
    inner = [(c(b).isNotNull() & c(k).isNull(), f"'{k.split('.')[1]}' is a required property of {b}") for b, k in (
        ("raw", "raw.raw_payload"), ("raw", "raw.raw_format"), ("raw", "raw.raw_hash"), ("source", "source.log_format"), ("event", "event.category"),
        ("lineage", "lineage.parser_name"), ("lineage", "lineage.parser_version"), ("lineage", "lineage.normalization_ruleset_version"))]
    sets = [(c(k).isNotNull() & ~c(k).isin(v), f"{k} is not one of its allowed values") for k, v in (("event.category", CATEGORIES), ("event.outcome", OUTCOMES), ("network.direction", DIRECTIONS))]
    ranges = [(~c(k).between(a, b), f"{k} is not within {a} and {b}") for k, a, b in (
        ("event.severity_numeric", 0, 10), ("network.src_port", 0, 65535), ("network.dst_port", 0, 65535), ("analytics.anomaly_score", 0, 1), ("analytics.risk_score", 0, 10))]
    least = [(c(k) < 0, f"{k} is below 0") for k in ("network.bytes_in", "network.bytes_out")]
    return [*missing, *inner, (~c("raw.raw_hash").rlike("^[a-f0-9]{64}$"), "raw.raw_hash does not match its pattern"), *sets, *ranges, *least]


def validate(df: DataFrame) -> DataFrame:
    """Adds errors: the messages of all rules that an event breaks; type_errors, if the table
    has them, come last."""
    found = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(msg)) for cond, msg in _rules()])
    errors = F.array_compact(found)
    if "type_errors" in df.columns:
        errors = F.concat(errors, F.coalesce("type_errors", F.array().cast("array<string>")))
    return df.withColumn("errors", errors)


def text_type_errors(specs: dict[str, str]) -> Column:
    """Messages for text members whose source field was of another JSON type: targets by field."""
    checks = [
        F.when(~F.coalesce(F.try_element_at(F.col("extracted"), F.lit(k))["t"].isin("string", "null"), F.lit(True)), F.lit(f"{target} is not of type 'string'"))
        for target, k in specs.items()
    ]
    return F.array_compact(F.array(*checks))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid events, and dead letters of the others."""
    checked = df if "errors" in df.columns else validate(df)
    good = checked.filter(F.size("errors") == 0).drop("errors")
    return good, dead_letters(checked.filter(F.size("errors") > 0), "validation", "ValidationError", F.concat(F.size("errors").cast("string"), F.lit(" schema errors")), F.col("errors"))


def dead_letters(df: DataFrame, stage: str, error_type: str, message: Column, errors: Column | None = None, failed_sink: str | None = None) -> DataFrame:
    """Records of one stage in the common dead-letter form, from raw rows or events."""
    cols = set(df.columns)
    none = F.lit(None).cast("string")
    raw = "raw" in cols
    when = F.col("ingest_timestamp") if "ingest_timestamp" in cols else iso(F.col("ingest_ts")) if "ingest_ts" in cols else none
    have = {
        "schema_version": F.lit(SCHEMA_VERSION),
        "tenant_id": F.col("tenant_id") if "tenant_id" in cols else none,
        "event_id": F.col("event_id") if "event_id" in cols else none,
        "ingest_timestamp": when,
        "raw_payload": F.col("raw.raw_payload") if raw else F.col("line"),
        "raw_hash": F.col("raw.raw_hash") if raw else F.col("raw_hash") if "raw_hash" in cols else none,
        "raw_format": F.col("raw.raw_format") if raw else F.col("format_id") if "format_id" in cols else none,
        "stage": F.lit(stage),
        "error_type": F.lit(error_type),
        "error_message": message,
        "validation_errors": errors if errors is not None else F.lit(None).cast("array<string>"),
        "source_tag": F.col("source_tag") if "source_tag" in cols else none,
        "parser": F.col("lineage.parser_name") if "lineage" in cols else F.col("format_id") if "format_id" in cols else none,
        "failed_sink": F.lit(failed_sink).cast("string"),
        "timestamp": when,
    }
    return df.select(*[have[f.name].cast(f.dataType).alias(f.name) for f in dead_letter_schema()])


def dead_letter_union(*dlqs: DataFrame) -> DataFrame:
    """The dead letters of all stages as one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dlqs)
