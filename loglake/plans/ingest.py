"""The ingest job: raw records to enriched, validated events and dead letters, as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.operators.detect import detect_format
from loglake.operators.enrich import Enricher, enrich_all
from loglake.operators.extract import extract
from loglake.operators.framing import frame_lines, split_oversized
from loglake.operators.identity import with_event_id, with_raw_hash
from loglake.operators.normalize import normalize, to_ues
from loglake.operators.validate import dead_letter_union, dead_letters, split_valid, validate


def parse(raw: DataFrame, declarative: list | None = None, formats: list[str] | None = None, overrides=None, reference_year: int = 2026) -> DataFrame:
    """Raw records with ids, formats and fields."""
    ids = with_event_id(with_raw_hash(raw))
    return extract(detect_format(ids, overrides, declarative), reference_year, formats, declarative)


def ingest(raw: DataFrame, enrichers: list[Enricher] | None = None, declarative: list | None = None, formats: list[str] | None = None, overrides=None, reference_year: int = 2026, hold: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, dead letters). Every record ends up in one of the two. Both come from the same
    parsed records and, of these, the same checked events; ``hold`` may keep both, so that they
    are made once."""
    framed, bad_frames = split_oversized(frame_lines(raw))
    parsed = parse(framed, declarative, formats, overrides, reference_year)
    parsed = hold(parsed) if hold else parsed
    failed = parsed.filter(F.col("parse_error").isNotNull())
    none = F.col("parse_error").startswith("no parser")
    missed = dead_letters(failed.filter(none), "detection", "ParserNotFound", F.col("parse_error"))
    refused = dead_letters(failed.filter(~none), "extraction", "ParseError", F.col("parse_error"))
    framing = dead_letters(with_event_id(with_raw_hash(bad_frames)), "framing", "FramingError", F.col("frame_error"))
    events = enrich_all(to_ues(normalize(parsed.filter(F.col("parse_error").isNull()), declarative=declarative, formats=formats)), enrichers or [])
    checked = events if "errors" in events.columns else validate(events)
    good, invalid = split_valid(hold(checked) if hold else checked)
    return good, dead_letter_union(framing, missed, refused, invalid)
