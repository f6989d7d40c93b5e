"""The calibration round: accounting, population, split, selection and carry.

Tables: parts (a row per listed part's header), metas (a row per measured
part's metadata), truth (a row per distinct vector of a part) and sweep (truth
rows x ef). One call handles many cohorts and round ends: `rounds` has a row
(cohort, round_end) for each.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import is_train_member, split_threshold
from tidemark.functions.stats import compliance_quantile, select_ef, target_met, transfer_confidence, type7
from tidemark.functions.windows import iso_minute
from tidemark.operators.summaries import quantiles


@dataclass(frozen=True)
class RoundConfig:
    """What a round is asked for; wrong values are refused when it is made."""

    ef_grid: tuple[int, ...] = (10, 20, 40, 80, 160)
    k: int = 10
    value: float = 0.8
    percentile: float = 0.9
    window_seconds: int = 86_400
    storage_seconds: int = 600
    train_fraction: float = 0.7
    split_seed: int = 0
    min_samples: int = 10
    target_name: str = "default"
    index: str = "docs_idx"
    table: str = "docs"
    column: str = "embedding"
    key: str = "vec_id"
    format_version: int = field(default=1)

    def __post_init__(self) -> None:
        if self.storage_seconds <= 0:
            raise ValueError("storage_window_seconds must be greater than zero")
        if self.storage_seconds % 60:
            raise ValueError("storage_window_seconds must be a multiple of 60")
        if self.window_seconds < self.storage_seconds:
            raise ValueError("window duration must be at least one storage window")
        if self.window_seconds % self.storage_seconds:
            raise ValueError("window duration must be a multiple of storage_window_seconds")
        if self.k < 1:
            raise ValueError("k must be >= 1")
        if not 0.0 < self.value <= 1.0:
            raise ValueError("value must be in (0, 1]")
        if not 0.0 < self.percentile < 1.0:
            raise ValueError("percentile must be in (0, 1)")
        grid = self.ef_grid
        if not grid or any(a >= b for a, b in zip(grid, grid[1:], strict=False)) or grid[0] < self.k or grid[-1] > 1000:
            raise ValueError("ef_grid must be non-empty, strictly increasing, >= k, and <= 1000")
        split_threshold(self.train_fraction)
        if self.min_samples < 10:
            raise ValueError("min_samples must be >= 10")

    @property
    def q(self) -> float:
        return compliance_quantile(self.percentile)


def unique_parts(parts: DataFrame) -> DataFrame:
    """One row per part_ulid; listings of one part that disagree are an error."""
    rest = [c for c in parts.columns if c != "part_ulid"]
    whole = F.struct(*rest)
    one = parts.groupBy("part_ulid").agg(F.min(whole).alias("lo"), F.max(whole).alias("hi"))
    same = F.assert_true(F.col("lo") == F.col("hi"), F.lit("conflicting listed part"))
    return one.where(same.isNull()).select("part_ulid", "lo.*")


def in_scope(rounds: DataFrame, parts: DataFrame, config: RoundConfig) -> DataFrame:
    """Parts wholly within [round_end - window, round_end), per round. A day's parts meet their rounds by an equi-join on whole windows."""
    width = F.lit(config.window_seconds)
    span = parts.withColumn("__end", F.col("window_start") + F.col("window_seconds"))
    # a part belongs to rounds that end within [its end, its start + window]: both fall in at most two buckets of the window's width
    bucket = lambda c: F.floor(c / width).cast("long")
    left = rounds.withColumn("__b", bucket(F.col("round_end")))
    right = span.withColumn("__b", F.explode(F.array_distinct(F.array(bucket(F.col("__end")), bucket(F.col("window_start") + width)))))
    joined = left.join(right, ["cohort", "__b"])
    return joined.where((F.col("window_start") >= F.col("round_end") - width) & (F.col("__end") <= F.col("round_end"))).drop("__b", "__end")


def accounting(rounds: DataFrame, parts: DataFrame, config: RoundConfig) -> DataFrame:
    """Per round: available, received, dropped_frame_fraction, windows_in_scope, windows_with_parts, empty_window_fraction.

    Rounds without parts have zeros and an empty fraction of 1.
    """
    listed = in_scope(rounds, unique_parts(parts), config)
    counts = F.assert_true(F.col("record_count") <= F.col("received_frame_count"), F.lit("part records exceed received frames"))
    per = listed.where(counts.isNull()).groupBy("cohort", "round_end").agg(
        F.sum("record_count").alias("available"), F.sum("received_frame_count").alias("received"), F.count_distinct(F.when(F.pmod(F.col("round_end") - F.col("window_start"), F.lit(config.storage_seconds)) == 0, F.col("window_start"))).alias("with_parts")
    )
    expected = config.window_seconds // config.storage_seconds
    out = rounds.join(per, ["cohort", "round_end"], "left")
    got = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    drop = F.when(got("received") == 0, F.lit(0.0)).otherwise(F.lit(1.0) - got("available").cast("double") / got("received").cast("double"))
    return out.select(
        "cohort", "round_end", got("available").alias("available"), got("received").alias("received"), drop.alias("dropped_frame_fraction"),
        F.lit(expected).cast("long").alias("windows_in_scope"), got("with_parts").alias("windows_with_parts"),
        ((F.lit(expected) - got("with_parts")) / F.lit(float(expected))).alias("empty_window_fraction"),
    )


def compatible(metas: DataFrame, config: RoundConfig) -> DataFrame:
    """metas with a boolean `compatible`: same format, k, index, table, column, key and grid."""
    same = (F.col("format_version") == config.format_version) & (F.col("k") == config.k) & (F.col("index") == config.index) & (F.col("table") == config.table) & (F.col("column") == config.column) & (F.col("key") == config.key)
    return metas.withColumn("compatible", same & (F.col("ef_grid") == F.array(*[F.lit(e) for e in config.ef_grid])))


def deduplicated(samples: DataFrame, by: list[str]) -> DataFrame:
    """The sample of the least (part_ulid, record_index) for each vector hash in a group: an aggregate, so hot hashes combine before the shuffle."""
    rest = [c for c in samples.columns if c not in {*by, "vector_hash"}]
    first = F.min_by(F.struct(*rest), F.struct("part_ulid", "record_index"))
    return samples.groupBy(*by, "vector_hash").agg(first.alias("s")).select(*by, "vector_hash", "s.*")


def first_in_part(records: DataFrame, vector: str = "vector_hash") -> DataFrame:
    """Per part and vector: the first ordinal, dup_count and the first's receive time."""
    return records.groupBy("part_ulid", vector).agg(F.min("record_index").alias("record_index"), F.count(F.lit(1)).cast("int").alias("dup_count"), F.min_by("receive_time_us", "record_index").alias("receive_time_us"))


def validate_population(samples: DataFrame, sweep: DataFrame, config: RoundConfig) -> DataFrame:
    """Rows of (kind, n) for each broken rule: missing efs, recall outside [0, 1], bad latencies."""
    bad = lambda c: c.isNull() | F.isnan(c) | (c < 0) | (c == float("inf"))
    grid = sweep.groupBy("part_ulid", "record_index").agg(F.array_sort(F.collect_list("ef")).alias("efs"))
    wrong = samples.join(grid, ["part_ulid", "record_index"], "left").where(~F.coalesce(F.col("efs") == F.array(*[F.lit(e) for e in config.ef_grid]), F.lit(False)))
    recall = sweep.where(F.col("recall").isNull() | F.isnan("recall") | ~F.col("recall").between(0.0, 1.0))
    checks = [("missing_ef", wrong), ("recall_range", recall), ("latency", sweep.where(bad(F.col("latency_ms")))), ("truth_latency", samples.where(bad(F.col("latency_ms"))))]
    out = None
    for kind, rows in checks:
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out.where("n > 0")


def calibration_rounds(rounds: DataFrame, parts: DataFrame, metas: DataFrame, truth: DataFrame, sweep: DataFrame, config: RoundConfig, aborts: DataFrame | None = None) -> DataFrame:
    """A row per round with every published field but the carry and the per-ef list (see per_ef).

    metas: part_ulid, cohort, measured_count, failed_count and what compatible()
    reads. truth: part_ulid, record_index, vector_hash, latency_ms. sweep: part_ulid,
    record_index, ef, hits, recall. aborts: (cohort, round_end, error) of rounds whose
    measuring was given up; they are insufficient whatever their samples.
    """
    account = accounting(rounds, parts, config)
    marked = compatible(metas, config)
    scope = in_scope(rounds, unique_parts(parts), config).select("cohort", "round_end", "part_ulid").join(marked.drop("cohort"), "part_ulid")
    used = scope.where("compatible")
    counted = scope.groupBy("cohort", "round_end").agg(
        F.sum(F.when(F.col("compatible"), F.col("measured_count"))).alias("measured"), F.sum(F.when(F.col("compatible"), F.col("failed_count"))).alias("failed"),
        F.count_if("compatible").alias("parts_used"), F.count_if(~F.col("compatible")).alias("incompatible_parts"),
    )
    samples = population(used, truth, config)
    per = samples.groupBy("cohort", "round_end").agg(
        F.count(F.lit(1)).alias("unique"), F.count_if("is_train").alias("train"), F.count_if(~F.col("is_train")).alias("test"), (F.sum("latency_ms") / F.count("latency_ms")).alias("ground_truth_latency_mean_ms")
    )
    picked = selection(samples, sweep, config)
    key = ["cohort", "round_end"]
    out = account.join(counted, key, "left").join(per, key, "left").join(picked, key, "left")
    out = out.join(aborts, key, "left") if aborts is not None else out.withColumn("error", F.lit(None).cast("string"))
    got = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = out.select(*account.columns, *[got(c) for c in ("measured", "failed", "parts_used", "incompatible_parts", "unique", "train", "test")], "ground_truth_latency_mean_ms", "error", *[c for c in picked.columns if c not in key])
    refused = F.col("error").isNotNull() | (F.col("unique") < config.min_samples) | (F.col("train") == 0) | (F.col("test") == 0)
    unless = lambda c: F.when(~refused, F.col(c)).alias(c)
    status = F.when(refused, "insufficient_samples").when(F.col("met"), "ok").otherwise("target_unmet")
    return out.select(
        "cohort", "round_end", iso_minute(F.col("round_end") - config.window_seconds).alias("window_from"), iso_minute(F.col("round_end")).alias("window_to"), status.alias("status"), "error",
        *[unless(c) for c in ("recommended_ef", "confidence", "transferred", "train_quantile_recall", "test_quantile_recall")],
        "available", "measured", "failed", "unique", "train", "test", "dropped_frame_fraction", "empty_window_fraction", "windows_in_scope", "windows_with_parts", "parts_used", "incompatible_parts", "ground_truth_latency_mean_ms",
    )


def population(used: DataFrame, truth: DataFrame, config: RoundConfig) -> DataFrame:
    """Distinct vectors of each round's compatible parts, with their side of the split."""
    rows = used.select("cohort", "round_end", "part_ulid").join(truth.select("part_ulid", "record_index", "vector_hash", "latency_ms"), "part_ulid").select("cohort", "round_end", "vector_hash", "part_ulid", "record_index", "latency_ms")
    return deduplicated(rows, ["cohort", "round_end"]).withColumn("is_train", is_train_member(F.col("vector_hash"), config.split_seed, config.train_fraction))


def valid_sweep(sweep: DataFrame) -> DataFrame:
    """`sweep` if recalls lie in [0, 1] and latencies, where it has them, are finite and not negative, else an error when it runs."""
    fine = F.col("recall").between(0.0, 1.0)
    if "latency_ms" in sweep.columns:
        fine = fine & F.col("latency_ms").isNotNull() & ~F.isnan("latency_ms") & F.col("latency_ms").between(0.0, 1e300)
    return sweep.where(F.assert_true(F.coalesce(fine, F.lit(False)), F.lit("recall or latency out of range")).isNull())


def selection(samples: DataFrame, sweep: DataFrame, config: RoundConfig) -> DataFrame:
    """Per round: the least ef whose train quantile meets the value, its holdout quantile and the confidence that it transfers."""
    key = ["cohort", "round_end"]
    rows = samples.select(*key, "part_ulid", "record_index", "is_train").join(valid_sweep(sweep).select("part_ulid", "record_index", "ef", "recall"), ["part_ulid", "record_index"])
    side = lambda on: type7(F.collect_list(F.when(on, F.col("recall"))), config.q)
    held = ~F.col("is_train")
    per = rows.groupBy(*key, "ef").agg(
        side(F.col("is_train")).alias("train_quantile_recall"), side(held).alias("test_quantile_recall"), F.count_if(held).alias("n"), F.count_if("is_train").alias("__train"), F.count_if(held & (F.col("recall") >= config.value)).alias("m")
    )
    # every sample has a row of each ef: as many rows of all, and the whole grid
    per = per.withColumn("__all", F.col("n") + F.col("__train"))
    whole = F.assert_true((F.min("__all") == F.max("__all")) & (F.sort_array(F.collect_set(F.col("ef").cast("int"))) == F.array(*[F.lit(e) for e in config.ef_grid])), F.lit("a sample lacks rows of the ef grid"))
    chosen = per.groupBy(*key).agg(whole.alias("__whole"), select_ef(F.col("ef"), F.col("train_quantile_recall"), config.value).alias("recommended_ef"), target_met(F.col("train_quantile_recall"), config.value).alias("met"))
    at = per.join(chosen.where("__whole is null"), key).where(F.col("ef") == F.col("recommended_ef"))
    return at.select(
        *key, "recommended_ef", "met", F.when(F.col("n") > 0, transfer_confidence(F.col("n"), F.col("m"), config.percentile)).alias("confidence"), (F.col("test_quantile_recall") >= config.value).alias("transferred"), "train_quantile_recall", "test_quantile_recall"
    )


def per_ef(samples: DataFrame, sweep: DataFrame, config: RoundConfig) -> DataFrame:
    """Per round and ef over the whole population: quantile_recall, mean_recall (from whole hits), latency_p50_ms and n."""
    key = ("cohort", "round_end", "ef")
    rows = samples.select("cohort", "round_end", "part_ulid", "record_index").join(sweep.select("part_ulid", "record_index", "ef", "hits", "recall", F.col("latency_ms").alias("sweep_ms")), ["part_ulid", "record_index"])
    n = F.count(F.lit(1))
    means = rows.groupBy(*key).agg((F.sum("hits") / (n * F.lit(float(config.k)))).alias("mean_recall"), n.alias("n"))
    both = quantiles(rows, key, "recall", {"quantile_recall": config.q}).join(quantiles(rows, key, "sweep_ms", {"latency_p50_ms": 0.5}), [*key])
    return both.join(means, [*key]).select(*key, "quantile_recall", "mean_recall", "latency_p50_ms", "n")


def effective(rounds: DataFrame) -> DataFrame:
    """Add what a consumer should apply: effective_ef, effective_confidence, source_round and carried.

    rounds: cohort, round_end, fingerprint (index, grid, k, value and percentile, as
    one value) and the results. A round without a result carries the last one of
    its cohort, but never across a change of fingerprint.
    """
    time = Window.partitionBy("cohort").orderBy("round_end")
    changed = F.coalesce((F.col("fingerprint") != F.lag("fingerprint").over(time)).cast("int"), F.lit(0))
    runs = rounds.withColumn("__run", F.sum(changed).over(time))
    so_far = Window.partitionBy("cohort", "__run").orderBy("round_end").rowsBetween(Window.unboundedPreceding, 0)
    good = F.when(F.col("recommended_ef").isNotNull(), F.struct("recommended_ef", "confidence", F.col("round_end").alias("source")))
    last = F.last(good, ignorenulls=True).over(so_far)
    out = runs.withColumn("__e", last)
    return out.withColumns({"effective_ef": F.col("__e.recommended_ef"), "effective_confidence": F.col("__e.confidence"), "source_round": F.col("__e.source"), "carried": F.when(F.col("__e").isNotNull(), F.col("recommended_ef").isNull())}).drop("__run", "__e")


def pending_parts(listed: DataFrame, truth_parts: DataFrame, sweep_parts: DataFrame, metas: DataFrame | None = None, config: RoundConfig | None = None) -> DataFrame:
    """Listed parts to measure: those without both halves of a pair, and those whose pair is of another configuration."""
    key = ["cohort", "part_ulid"]
    done = truth_parts.select(*key).distinct().join(sweep_parts.select(*key).distinct(), key, "left_semi")
    if metas is not None and config is not None:
        done = done.join(compatible(metas, config).where("compatible").select("part_ulid"), "part_ulid", "left_semi")
    return listed.join(done, key, "left_anti")


def pair_problems(truth: DataFrame, sweep: DataFrame, metas: DataFrame) -> DataFrame:
    """(part_ulid, problem) of malformed pairs: repeated samples, repeated or orphan sweep rows, another count than told."""
    repeat = lambda rows, by, name: rows.groupBy(*by).count().where("count > 1").select("part_ulid", F.lit(name).alias("problem"))
    orphan = sweep.join(truth, ["part_ulid", "record_index"], "left_anti").select("part_ulid", F.lit("orphan_sweep").alias("problem"))
    counts = metas.join(truth.groupBy("part_ulid").count(), "part_ulid", "left").where(F.coalesce("count", F.lit(0)) != F.col("measured_count")).select("part_ulid", F.lit("measured_count").alias("problem"))
    return repeat(truth, ["part_ulid", "record_index"], "repeated_sample").union(repeat(sweep, ["part_ulid", "record_index", "ef"], "repeated_sweep")).union(orphan).union(counts).distinct()


def source_mismatches(listed: DataFrame, metas: DataFrame) -> DataFrame:
    """Pairs whose metadata differs from the listed part's header in any shared field."""
    fields = ["cohort", "window_start", "window_seconds", "received_frame_count", "record_count"]
    a, b = listed.alias("a"), metas.alias("b")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    return a.join(b, F.col("a.part_ulid") == F.col("b.part_ulid")).where(~same).select(F.col("a.part_ulid").alias("part_ulid"))


def round_json(rounds: DataFrame, per: DataFrame, config: RoundConfig, computed_at: str) -> DataFrame:
    """(cohort, round_end, path, json): the published record, fields in a fixed order; computed_at is the caller's."""
    efs = per.groupBy("cohort", "round_end").agg(F.array_sort(F.collect_list(F.struct("ef", "quantile_recall", "mean_recall", "latency_p50_ms"))).alias("per_ef"))
    r = rounds.join(efs, ["cohort", "round_end"], "left")
    record = F.struct(
        F.lit(config.format_version).alias("format_version"), "cohort", F.lit(computed_at).alias("computed_at"),
        F.struct(F.col("window_from").alias("start"), F.col("window_to").alias("end"), F.lit(config.window_seconds).alias("duration_seconds")).alias("window"),
        F.struct(F.lit(config.target_name).alias("name"), F.lit(config.k).alias("k"), F.lit(config.value).alias("value"), F.lit(config.percentile).alias("percentile")).alias("target"),
        F.lit(config.index).alias("index"), F.array(*[F.lit(e) for e in config.ef_grid]).alias("ef_grid"), "status", "error", "recommended_ef", "confidence", "transferred", "train_quantile_recall", "test_quantile_recall",
        F.when(F.col("effective_ef").isNotNull(), F.struct(F.col("effective_ef").alias("recommended_ef"), F.col("effective_confidence").alias("confidence"), iso_minute(F.col("source_round")).alias("source_round"), "carried")).alias("effective"),
        F.struct("available", "measured", "failed", "unique", "train", "test").alias("samples"), "dropped_frame_fraction",
        F.struct("empty_window_fraction", "windows_in_scope", "windows_with_parts").alias("coverage"), "parts_used", "incompatible_parts", "ground_truth_latency_mean_ms",
        F.coalesce("per_ef", F.array().cast("array<struct<ef:int,quantile_recall:double,mean_recall:double,latency_p50_ms:double>>")).alias("per_ef"),
    )
    from tidemark.functions.windows import round_key

    return r.select("cohort", "round_end", round_key(F.col("cohort"), F.col("round_end")).alias("path"), F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))
