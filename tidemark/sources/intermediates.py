"""Measured pairs on disk: truth, sweep and part metadata, partitioned by cohort and window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.calibration import pair_problems

TRUTH = "part_ulid string, cohort string, window_start long, record_index int, vector_hash decimal(20,0), dup_count int, receive_time_us long, latency_ms double, gt_keys array<bigint>, gt_distances array<double>"
SWEEP = "part_ulid string, cohort string, window_start long, record_index int, ef int, returned_keys array<bigint>, recall double, latency_ms double, result_count int"
METAS = "part_ulid string, cohort string, window_start long, window_seconds int, received_frame_count long, record_count long, index string, table string, column string, key string, k int, ef_grid array<int>, failed_count long, measured_count long, computed_at_us long, format_version int"


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def _as(df: DataFrame, schema: str) -> DataFrame:
    """Columns of the frozen schema, in its order; another set of columns is an error."""
    want = _schema(schema)
    if set(df.columns) != set(want.names):
        raise ValueError(f"columns differ from the schema: {sorted(set(df.columns) ^ set(want.names))}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want])


def write_pairs(root: str, truth: DataFrame, sweep: DataFrame, metas: DataFrame) -> None:
    """Truth first, then sweep, then metadata: a part counts as measured when its metadata is there.

    Windows written again replace themselves alone (dynamic overwrite), so a
    resumed round is idempotent.
    """
    for name, df, schema in (("truth", truth, TRUTH), ("sweep", sweep, SWEEP), ("parts", metas, METAS)):
        _as(df, schema).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("cohort", "window_start").parquet(f"{root}/measurements/{name}")


def has_pairs(spark: SparkSession, root: str) -> bool:
    """Whether metadata of any part is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/measurements/parts")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def add_pairs(root: str, truth: DataFrame, sweep: DataFrame, metas: DataFrame, have: tuple[DataFrame, DataFrame, DataFrame] | None) -> None:
    """write_pairs() of new parts beside the other parts of their windows, which the overwrite would lose."""
    new = [truth, sweep, metas]
    if have:
        fresh = metas.select("part_ulid", "window_start")
        windows = fresh.select("window_start").distinct()
        for i, old in enumerate(have):
            beside = old.join(windows, "window_start", "left_semi").join(fresh.select("part_ulid"), "part_ulid", "left_anti")
            new[i] = _settled(new[i].select(*old.columns).unionByName(beside), f"{root}/measurements/.new/{i}")
    write_pairs(root, *new)


def _settled(df: DataFrame, path: str) -> DataFrame:
    """`df` written to `path` and read back: what it reads may be overwritten then."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_pairs(spark: SparkSession, root: str, windows: list[int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(truth, sweep, parts) with explicit schemas; `windows` prunes partitions."""
    out = []
    for name, schema in (("truth", TRUTH), ("sweep", SWEEP), ("parts", METAS)):
        df = spark.read.schema(_schema(schema)).parquet(f"{root}/measurements/{name}").select(*_schema(schema).names)
        out.append(df if windows is None else df.where(F.col("window_start").isin(windows)))
    return tuple(out)


def sound_parts(truth: DataFrame, sweep: DataFrame, metas: DataFrame) -> DataFrame:
    """Metadata of parts whose pair is well-formed; the others are measured again."""
    return metas.join(pair_problems(truth, sweep, metas).select("part_ulid").distinct(), "part_ulid", "left_anti")


def publish_rounds(documents: DataFrame, root: str) -> None:
    """Round documents as one JSON line each: history by cohort and round end, and the latest of each cohort."""
    rows = documents.withColumnRenamed("json", "value")
    rows.select("cohort", "round_end", "value").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cohort", "round_end").text(f"{root}/calibrations/history")
    latest = rows.groupBy("cohort").agg(F.max_by("value", "round_end").alias("value"))
    latest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cohort").text(f"{root}/calibrations/latest")


def read_latest(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """cohort and the parsed latest round; no folder yet gives no rows, and a record that doesn't parse gives a null round."""
    try:
        rows = spark.read.text(f"{root}/calibrations/latest")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"cohort string, round struct<{schema}>")
    return rows.select("cohort", F.from_json("value", schema).alias("round"))
