"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: U+0020 and U+0009 to U+000D, nothing else.
SPACE = r"[ \t-\r]"


#: Shuffle files of a finished query go at once; held while stored() writes, as nothing else reads them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of rows that Spark hands to Python at once. Texts of 10,000 rows, Spark's own bound, would stand in memory
#: several times over; a longer row goes alone.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, about to be given to Python; the session's bound on batch bytes is set once, where it is unset.

    The setting is read when a plan runs, which for a returned DataFrame is after the operator is done, so it stays.
    """
    if df.sparkSession.conf.get(BATCH, None) is None:
        df.sparkSession.conf.set(BATCH, str(BATCH_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent, a temporary folder is set once if all runs in one
    process (tests); on a cluster, whose machines would each see their own, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not given.isDefined() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = given.get() if given.isDefined() else f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this module through the Hadoop file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def stored(df: DataFrame, codec: str = "lz4_raw") -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: the lineage ends here.

    The folder is removed when the Python process ends; a cluster that keeps
    the process alive can delete `tidemark-*` below spark.checkpoint.dir.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    had = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if had is None else spark.conf.set(CLEANUP, had)

    def clean() -> None:
        with contextlib.suppress(Exception):
            remove(spark, path)

    atexit.register(clean)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Remove what stored() wrote, once nothing reads it any more."""
    if path := getattr(df, "_tidemark_path", None):
        remove(df.sparkSession, path)


def small_or_shuffled(df: DataFrame, row_bytes: int, limit: int = 32 << 20, per_item: tuple[str, int] | None = None) -> DataFrame:
    """Mark `df` (already stored) for broadcast if its counted rows fit `limit` bytes.

    per_item: an array column and the bytes of one of its values, which count too.
    Beyond that the join is left to Spark, which shuffles both sides and splits
    skewed partitions.
    """
    extra = F.sum(F.size(per_item[0]).cast("long")) * per_item[1] if per_item else F.lit(0)
    size = df.agg((F.count(F.lit(1)) * row_bytes + F.coalesce(extra, F.lit(0))).alias("b")).first()["b"]
    return F.broadcast(df) if size <= limit else df


ROW = "__row"


def packed(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The columns of a row (all, or those named) as one struct, so that working columns clash with none of them."""
    return F.struct(*[df[f"`{c}`"].alias(c) for c in (df.columns if columns is None else columns)]).alias(ROW)


def unpacked(columns: list[str]) -> list[Column]:
    return [F.col(ROW).getField(c).alias(c) for c in columns]


def free_names(df: DataFrame, names: list[str]) -> dict[str, str]:
    """For each working column a name that no column of `df` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for name in names:
        free = f"__{name}"
        while free.lower() in taken:
            free = f"_{free}"
        out[name] = free
        taken.add(free.lower())
    return out


def clean_text(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a non-null text; empty array without any."""
    return let(F.btrim(text, F.lit(" \t\n\x0b\f\r")), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"{SPACE}+")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is evaluated once.

    Spark merges stacked projections, so that a column used many times, above
    all inside lambdas, would be computed again at each use; a lambda's variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rows_of(batch: pa.RecordBatch, columns: int, step: int = 256) -> Iterator[tuple]:
    """Rows of an Arrow batch as tuples of Python values, a few at a time: texts of a whole batch would stand in memory twice."""
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield from zip(*(part.column(c).to_pylist() for c in range(columns)), strict=True)
