"""The reference roles on the test tables.

The corpus is `embeddings`; its search queries are the rows whose id is divisible
by 20. A captured query vector is an event: cohort by event type, received at
its time, with one of those queries as vector. Latencies are stand-ins computed
from ids, as wall times repeat nowhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashing import fnv1a_limbs, limbs_decimal
from tidemark.functions.windows import aligned_window_start
from tidemark.operators import calibration, measurement, sampling, search
from tidemark.operators.calibration import RoundConfig
from tidemark.sources import frames

EFS = [10, 20, 40, 80, 160]
K = 10
EVERY = 20
WINDOW = 600
DAY = 86_400
CAP_BYTES = 1000
CONFIG = RoundConfig(ef_grid=tuple(EFS), k=K, value=0.5, percentile=0.9, window_seconds=7 * DAY, storage_seconds=WINDOW, min_samples=10)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def query_set(docs: DataFrame) -> DataFrame:
    return docs.where(F.pmod("vec_id", F.lit(EVERY)) == 0)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    return search.as_lists(search.exact_topk(query_set(docs), docs, K))


def sweep(spark: SparkSession, sf_dir: str, searcher: search.Searcher | None = None) -> DataFrame:
    """qid, ef, hits, recall, result_count and dataset: a group of labels stands for each of two corpora."""
    docs = corpus(spark, sf_dir)
    found = (searcher or search.CandidateBudget()).search(query_set(docs), docs, K, EFS)
    names = docs.select(F.col("vec_id").alias("qid"), F.when(F.col("label") < 5, "low").otherwise("high").alias("dataset"))
    latency = (F.col("ef") / F.lit(10.0) + F.pmod("qid", F.lit(7))).alias("latency_ms")
    return search.sweep_recall(truth(spark, sf_dir), found, K).join(names, "qid").select("*", latency)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, cohort, receive_time_us, second, window_start, vec_id, frame_bytes, dropped."""
    docs = table(spark, sf_dir, "embeddings").agg(F.floor((F.max("vec_id") + EVERY) / EVERY).alias("__n"))
    events = table(spark, sf_dir, "events").join(F.broadcast(docs))
    cohort = F.concat(F.lit("events/"), F.col("event_type"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    vec = F.pmod(F.col("user_id") * 31 + F.col("event_id"), F.col("__n")) * EVERY
    rows = events.select("event_id", cohort.alias("cohort"), micros.alias("receive_time_us"), F.floor(micros / 1_000_000).cast("long").alias("second"), vec.cast("long").alias("vec_id"))
    return rows.select(
        "*", aligned_window_start(F.col("second"), WINDOW).alias("window_start"), (F.lit(28 + 4 * 64) + F.length("cohort")).cast("long").alias("frame_bytes"), (F.pmod("event_id", F.lit(17)) == 0).alias("dropped")
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored captures with part_ulid, spill_no and record_index."""
    kept = captures(spark, sf_dir).where(~F.col("dropped"))
    cut = sampling.split_parts(kept, CAP_BYTES, ["cohort", "window_start"], ["receive_time_us", "event_id"])
    ulid = F.concat(F.lpad(F.col("window_start").cast("string"), 12, "0"), F.lit("-"), F.lpad(F.col("spill_no").cast("string"), 4, "0"), F.lit("-"), F.col("cohort"))
    return cut.withColumn("part_ulid", ulid)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed parts: a window's dropped frames count as received with its first part."""
    rows = records(spark, sf_dir)
    drops = captures(spark, sf_dir).where("dropped").groupBy("cohort", "window_start").agg(F.count(F.lit(1)).alias("n"))
    per = rows.groupBy("part_ulid", "cohort", "window_start", "spill_no").agg(F.count(F.lit(1)).alias("record_count"), F.min("receive_time_us").alias("first_receive"), F.max("receive_time_us").alias("last_receive"))
    lost = F.when(F.col("spill_no") == 0, F.coalesce("n", F.lit(0))).otherwise(0)
    return per.join(drops, ["cohort", "window_start"], "left").select(
        "part_ulid", "cohort", "window_start", F.lit(WINDOW).alias("window_seconds"), (F.col("record_count") + lost).cast("long").alias("received_frame_count"), "record_count", "first_receive", "last_receive"
    )


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, vector_hash (unsigned decimal): the hash of the id's text stands for the payload's."""
    ids = table(spark, sf_dir, "embeddings").select("vec_id")
    return ids.select("vec_id", limbs_decimal(fnv1a_limbs(F.concat(F.lit("v:"), F.col("vec_id").cast("string")))).alias("vector_hash"))


def part_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per distinct vector of a part."""
    rows = calibration.first_in_part(records(spark, sf_dir), "vec_id")
    return rows.join(hashes(spark, sf_dir), "vec_id").withColumn("latency_ms", F.lit(400.5) + F.pmod("vec_id", F.lit(5)))


def part_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sweep(spark, sf_dir).select(F.col("qid").alias("vec_id"), "ef", "hits", "recall", "latency_ms")
    return part_truth(spark, sf_dir).select("part_ulid", "record_index", "vec_id").join(found, "vec_id").drop("vec_id")


def metas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part metadata; parts of windows divisible by 11 windows were measured with another grid."""
    counts = part_truth(spark, sf_dir).groupBy("part_ulid").agg(F.count(F.lit(1)).alias("measured_count"))
    old = F.pmod(F.floor(F.col("window_start") / WINDOW), F.lit(11)) == 0
    grid = F.when(old, F.array(*[F.lit(e) for e in EFS[:4]])).otherwise(F.array(*[F.lit(e) for e in EFS]))
    return parts(spark, sf_dir).join(counts, "part_ulid").select(
        "part_ulid", "cohort", "window_start", "window_seconds", "received_frame_count", "record_count", "measured_count", F.lit(0).cast("long").alias("failed_count"), F.lit(CONFIG.format_version).alias("format_version"), F.lit(CONFIG.k).alias("k"),
        F.lit(CONFIG.index).alias("index"), F.lit(CONFIG.table).alias("table"), F.lit(CONFIG.column).alias("column"), F.lit(CONFIG.key).alias("key"), grid.alias("ef_grid"),
    )


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round per cohort and day, from the day after its first capture to the day after its last."""
    span = captures(spark, sf_dir).groupBy("cohort").agg(F.min("second").alias("a"), F.max("second").alias("b"))
    day = lambda c: F.col(c) - F.pmod(F.col(c), F.lit(DAY)) + DAY
    return span.select("cohort", F.explode(F.sequence(day("a"), day("b"), F.lit(DAY).cast("long"))).alias("round_end"))


def stored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as scan_segments() gives them, from segments built of the captures; every thirteenth frame is of f64 elements."""
    vectors = corpus(spark, sf_dir).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    rows = records(spark, sf_dir).join(vectors, "vec_id")
    whole = frames.build_frame(F.col("cohort"), F.col("e"))
    f64 = F.concat(F.substring(whole, 1, 12), F.unhex(F.lit("02000000")), whole.substr(F.lit(17), F.lit(1 << 20)))
    framed = rows.select("part_ulid", "record_index", "receive_time_us", F.when(F.pmod("event_id", F.lit(13)) == 0, f64).otherwise(whole).alias("frame"))
    heads = parts(spark, sf_dir).select("part_ulid", "cohort", "window_start", "window_seconds", "received_frame_count")
    built = frames.build_segments(framed.join(heads, "part_ulid"))
    return frames.open_segments(built.select(F.concat(F.lit("part-"), "part_ulid", F.lit(".vseam")).alias("path"), F.col("segment").alias("content")))


def measured(spark: SparkSession, sf_dir: str) -> measurement.Measured:
    return measurement.measure(stored_records(spark, sf_dir), corpus(spark, sf_dir), CONFIG)
