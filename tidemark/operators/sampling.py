"""Sampling: reservoirs, Bernoulli, the adaptive sampler, queue outcomes and split parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Fixed values of the adaptive sampler.
BUCKET_SECONDS = 5
EWMA_ALPHA = 0.5
MAX_IDLE_UPDATES = 10

#: A policy gives the boolean column of the captures that it samples.
SamplingPolicy = Callable[[DataFrame], Column]


def hash_order(seed: int, *keys: str) -> Column:
    """A seeded random order that any engine reproduces."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def reservoir(rows: DataFrame, limit: int, seed: int, *keys: str) -> DataFrame:
    """A uniform sample of `limit` rows: the least of a seeded hash, so each task keeps `limit` rows at most."""
    return rows.orderBy(hash_order(seed, *keys), *keys).limit(limit) if limit > 0 else rows.limit(0)


def shuffled(rows: DataFrame, seed: int, *keys: str) -> DataFrame:
    return rows.orderBy(hash_order(seed, *keys), *keys)


def unit_hash(seed: int, *keys: str) -> Column:
    """Uniform in [0, 1) from the hash's first 52 bits."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def bernoulli(rate: float, seed: int, *keys: str) -> SamplingPolicy:
    """Each capture with probability `rate`; 0 and 1 are decided without hashing."""
    if not 0.0 <= rate <= 1.0:
        raise ValueError("rate must be in [0, 1]")
    return lambda df: F.lit(rate == 1.0) if rate in (0.0, 1.0) else unit_hash(seed, *keys) < rate


def in_order(rows: DataFrame, group: list[str], order: list[str], value: str, new: str, fold: Callable[[], Callable[[Any], tuple]]) -> DataFrame:
    """Rows with the columns `new` (a schema text) from a fold over each group in order.

    fold() starts a group and gives a function of the next value. Groups stream
    through sorted partitions, so a task holds a batch and one state, however
    large a group is; an ordered fold of one group can't be split.
    """
    dealt = rows.repartition(*group).sortWithinPartitions(*group, *order)
    fields = T._parse_datatype_string(new).fields
    kinds = to_arrow_schema(T.StructType(fields)).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Any = run  # no group yet
        step = None
        for b in batches:
            out = []
            for *key, x in zip(*(b.column(c).to_pylist() for c in [*group, value]), strict=True):
                if key != now:
                    now, step = key, fold()
                out.append(step(x))
            columns = list(zip(*out, strict=True)) or [[] for _ in fields]
            added = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], [*b.schema.names, *(f.name for f in fields)])

    return dealt.mapInArrow(run, T.StructType([*dealt.schema.fields, *fields]))


def adaptive_rates(captures: DataFrame, target_per_second: float, cohort: str = "cohort", seconds: str = "second") -> DataFrame:
    """(cohort, bucket, rate, probability): the sampling probability of each 5-second bucket with captures.

    Buckets count from the cohort's first capture. A finished bucket's rate moves
    the estimate half way; an empty one moves it half way to nothing, and more than
    ten empty ones in a row end it. The fold runs over a cohort's buckets, one row
    per bucket and not per capture.
    """
    if not target_per_second > 0.0:
        raise ValueError("target_samples_per_second must be greater than 0.0")
    start = captures.groupBy(cohort).agg(F.min(seconds).alias("__s0"))
    bucket = F.floor((F.col(seconds) - F.col("__s0")) / BUCKET_SECONDS).cast("long")
    counts = captures.join(start, cohort).groupBy(cohort, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))

    def fold() -> Callable[[dict], tuple]:
        rate, last, n = 0.0, None, 0

        def step(b: dict) -> tuple[float]:
            nonlocal rate, last, n
            if last is not None:
                idle = b["bucket"] - last - 1
                after = EWMA_ALPHA * (n / float(BUCKET_SECONDS)) + (1 - EWMA_ALPHA) * rate
                rate = 0.0 if idle > MAX_IDLE_UPDATES else after * (1 - EWMA_ALPHA) ** float(idle)
            last, n = b["bucket"], b["n"]
            return (rate,)

        return step

    found = in_order(counts.withColumn("b", F.struct("bucket", "n")), [cohort], ["bucket"], "b", "rate double", fold)
    rate = F.col("rate")
    return found.select(cohort, "bucket", "rate", F.when(rate <= target_per_second, F.lit(1.0)).otherwise(F.lit(target_per_second) / rate).alias("probability"))


def adaptive_sample(captures: DataFrame, target_per_second: float, seed: int, key: str, cohort: str = "cohort", seconds: str = "second") -> DataFrame:
    """Captures with bucket, probability and sampled; the decision is by hash, so reruns agree."""
    start = captures.groupBy(cohort).agg(F.min(seconds).alias("__s0"))
    placed = captures.join(start, cohort).withColumn("bucket", F.floor((F.col(seconds) - F.col("__s0")) / BUCKET_SECONDS).cast("long")).drop("__s0")
    rates = adaptive_rates(captures, target_per_second, cohort, seconds).select(cohort, "bucket", "probability")
    return placed.join(rates, [cohort, "bucket"]).withColumn("sampled", unit_hash(seed, key) < F.col("probability"))


def queue_outcomes(captures: DataFrame, capacity_bytes: int, drain_group: list[str], order: list[str], size: str = "frame_bytes", sampled: str = "sampled") -> DataFrame:
    """Captures with outcome not_sampled, enqueued or queue_full: a byte-bounded queue that each drain empties.

    A frame that doesn't fit is refused and leaves room for later, smaller ones, so
    the fold runs in order over a drain's frames.
    """

    def fold() -> Callable[[int | None], tuple]:
        held = 0

        def step(size: int | None) -> tuple[str]:
            nonlocal held
            if size is None:
                return ("not_sampled",)
            if held + size > capacity_bytes:
                return ("queue_full",)
            held += size
            return ("enqueued",)

        return step

    asked = captures.withColumn("__b", F.when(F.col(sampled), F.col(size)))
    return in_order(asked, drain_group, order, "__b", "outcome string", fold).drop("__b")


def split_parts(records: DataFrame, cap_bytes: int, group: list[str], order: list[str], size: str = "frame_bytes") -> DataFrame:
    """Records with spill_no and record_index: a window's buffer is flushed whenever the next record would overfill it.

    Arrival order decides, so the fold runs over one window's records of a cohort.
    """

    def fold() -> Callable[[int], tuple]:
        held, spill, at = 0, 0, -1

        def step(size: int) -> tuple[int, int]:
            nonlocal held, spill, at
            if held and held + size > cap_bytes:
                held, spill, at = 0, spill + 1, -1
            held, at = held + size, at + 1
            return spill, at

        return step

    return in_order(records, group, order, size, "spill_no int, record_index int", fold)
