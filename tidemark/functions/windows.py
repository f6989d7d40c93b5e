"""Storage windows, timestamps and object keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def aligned_window_start(seconds: Column, width: int) -> Column:
    """Start of the UTC-aligned window of `width` seconds that holds an epoch second."""
    if width <= 0:
        raise ValueError("window duration must be greater than zero")
    return seconds - F.pmod(seconds, F.lit(width))


def compact_timestamp(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyyMMdd'T'HHmm'Z'")


def iso_minute(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm':00Z'")


def segment_key(cohort: Column, start: Column, part: Column) -> Column:
    return F.concat(F.lit("cohorts/"), cohort, F.lit("/window="), compact_timestamp(start), F.lit("/part-"), part, F.lit(".vseam"))


def measurement_key(cohort: Column, start: Column, part: Column, kind: str) -> Column:
    return F.concat(F.lit("measurements/"), cohort, F.lit("/window="), compact_timestamp(start), F.lit("/part-"), part, F.lit(f".{kind}.parquet"))


def round_key(cohort: Column, round_end: Column) -> Column:
    return F.concat(F.lit("calibrations/"), cohort, F.lit("/round-"), compact_timestamp(round_end), F.lit(".json"))


def part_of_path(path: Column) -> Column:
    """The part's ULID in a canonical object name; null for any other name."""
    return F.nullif(F.regexp_extract(path, r"part-([0-9A-HJKMNP-TV-Z]{26})\.vseam$", 1), F.lit(""))


def next_tick(tick: int, now: int, interval: int) -> tuple[int, int]:
    """(next tick after a round that ended at `now`, ticks skipped); the next tick is always later than `now`."""
    passed = max(0, (now - tick) // interval)
    return tick + (passed + 1) * interval, passed
