"""Tumbling storage windows over a stream of captures.

Each cohort's windows close when the watermark passes them; frames counted as
dropped are received but not stored. Files read with Trigger.AvailableNow run
to their end and leave a checkpoint, so a later run takes up new files only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.windows import segment_key
from tidemark.plans.data import WINDOW
from tidemark.session import shared_dir
from tidemark.sources import frames


def windowed(captures: DataFrame, width: int = WINDOW, lateness: str = "0 seconds", receive: str = "receive_ts") -> DataFrame:
    """cohort, window_start, received, stored, bytes of each window; on a stream, append mode gives closed windows."""
    span = F.window(receive, f"{width} seconds")
    rows = captures.withWatermark(receive, lateness) if captures.isStreaming else captures
    out = rows.groupBy("cohort", span.alias("w")).agg(F.count(F.lit(1)).alias("received"), F.count_if(~F.col("dropped")).alias("stored"), F.sum("frame_bytes").alias("bytes"))
    return out.select("cohort", F.unix_seconds("w.start").alias("window_start"), "received", "stored", "bytes")


def publish(windows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write closed windows as Parquet, each exactly once; trigger: availableNow or processingTime."""
    return windows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream of captures."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(sf_dir)
    cohort = F.concat(F.lit("events/"), F.col("event_type"))
    return events.select(cohort.alias("cohort"), F.col("ts").cast("timestamp").alias("receive_ts"), (F.lit(28 + 4 * 64) + F.length(cohort)).cast("long").alias("frame_bytes"), (F.pmod("event_id", F.lit(17)) == 0).alias("dropped"))


def arrival_windows(rows: DataFrame, arrival: list[str], cohort: str = "cohort", window: str = "window_start") -> DataFrame:
    """Rows with open_window: windows only move on, so a record of an earlier window joins the one that is open in its cohort."""
    so_far = Window.partitionBy(cohort).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("open_window", F.max(window).over(so_far))


def frame_outcomes(rows: DataFrame) -> DataFrame:
    """cohort, outcome, n: frames by the error that refused them, or accepted."""
    parsed = rows.withColumn("p", frames.parse_frame("frame"))
    outcome = F.coalesce(frames.sample_error(F.col("p"), F.col("cohort")), F.lit("accepted"))
    return parsed.groupBy("cohort", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def observed(rows: DataFrame, name: str = "collector") -> DataFrame:
    """`rows` (dropped, frame_bytes and, where there, error) with the collector's counters observed on the way, in batch or stream."""
    error = F.col("error") if "error" in rows.columns else F.lit(None).cast("string")
    return rows.observe(
        name, F.count(F.lit(1)).alias("received"), F.count_if(~F.col("dropped")).alias("stored"), F.count_if("dropped").alias("dropped"),
        F.coalesce(F.sum("frame_bytes"), F.lit(0)).alias("received_bytes"), F.count(error).alias("invalid"),
    )


def flush_segments(root: str):
    """A foreachBatch sink: each micro-batch's records (see frames.build_segments) become one segment file a part.

    A batch that runs again writes the same names, so each part is there once.
    """

    def flush(batch: DataFrame, number: int) -> None:
        built = frames.build_segments(batch)
        heads = batch.groupBy("part_ulid").agg(F.first("cohort").alias("cohort"), F.first("window_start").alias("window_start"))
        out = built.join(heads, "part_ulid").select(segment_key(F.col("cohort"), F.col("window_start"), F.col("part_ulid")).alias("key"), "segment")
        out.write.mode("overwrite").parquet(f"{root}/batch={number}")

    return flush


def collect_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows of the events, by a streaming query in complete mode run to its end; each batch replaces the files of the one before."""
    path = f"{shared_dir(spark)}/windows"
    stream = windowed(event_stream(spark, sf_dir), lateness="0 seconds")
    put = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    query = stream.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path)
