"""Line dedup by site-relative frequency: drop lines that stand on too large a part of a host's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import clean_text, packed, small_or_shuffled, stored, unpacked

RATIO = 0.05
#: A line repeats if it is on so many pages; hosts of fewer than MIN_PAGES / RATIO pages so have a higher ratio.
MIN_PAGES = 3
BLANKS = " \t\n\x0b\f\r"


def _hashes(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.when(F.btrim(x, F.lit(BLANKS)) != "", F.xxhash64(F.btrim(x, F.lit(BLANKS)))))


def boilerplate_lines(df: DataFrame, host_col: str, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """(__host, __line hash, pages, host_pages) of lines on more than `ratio` of their host's pages.

    With `copies_once` a host's pages of equal text are one page, so that copies don't make a text boilerplate.

    A line counts once a page, trimmed; blank lines don't count. Counting is by
    (host, line), so a hot host's lines spread, and map-side sums come first.
    Lines on fewer than `min_pages` pages go before the join with host totals.
    """
    page = [F.xxhash64(clean_text(text_col)).alias("__page")] if copies_once else []
    pages = df.select(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("__host"), F.split(clean_text(text_col), "\n", -1).alias("__l"), *page)
    counted = pages.select("__host", "__page").distinct() if copies_once else pages
    totals = counted.groupBy("__host").agg(F.count(F.lit(1)).alias("host_pages"))
    lines = pages.select("__host", *["__page" for _ in page], F.explode(F.array_distinct(_hashes(F.col("__l")))).alias("__line")).where("__line is not null")
    lines = lines.distinct() if copies_once else lines
    often = lines.groupBy("__host", "__line").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    return often.join(totals, "__host").where(F.col("pages") > ratio * F.col("host_pages"))


def drop_boilerplate(df: DataFrame, host_col: str, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """`df` with boilerplate lines gone from `text_col`, and n_lines, n_removed (columns so named are replaced).

    A host's boilerplate lines number at most its mean lines a page over `ratio`,
    so they travel as one array per host. The table of all hosts' arrays is
    broadcast if it is small, else joined by shuffle, where Spark splits the
    partition of a hot host. A null host is the host ''. A null text stays null
    (one empty line); a text with nothing removed is unchanged to the byte. Repeated
    rows are pages of their own, or one page with `copies_once`; a line at the ratio
    exactly stays. An empty table stays empty.
    """
    heavy = stored(boilerplate_lines(df, host_col, text_col, ratio, min_pages, copies_once).select("__host", "__line"))
    sets = small_or_shuffled(stored(heavy.groupBy("__host").agg(F.collect_list("__line").alias("__heavy"))), 64, per_item=("__heavy", 8))
    rest = [c for c in df.columns if c.lower() not in {"n_lines", "n_removed"}]
    keyed = df.select(packed(df, rest), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("__host"), F.col(text_col).alias("__text"))
    lines = F.split(clean_text("__text"), "\n", -1)
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains("__heavy", F.xxhash64(F.btrim(x, F.lit(BLANKS)))) & (F.btrim(x, F.lit(BLANKS)) != ""), F.lit(False)))
    out = keyed.join(sets, "__host", "left").withColumn("__kept", F.when(F.col("__heavy").isNotNull(), kept))
    n_lines = F.size(lines).cast("long")
    removed = F.coalesce(n_lines - F.size("__kept"), F.lit(0)).cast("long")
    text = F.when(F.col("__heavy").isNull() | (removed == 0), F.col("__text")).otherwise(F.array_join("__kept", "\n"))
    return out.select(*[text.alias(c) if c == text_col else x for c, x in zip(rest, unpacked(rest), strict=True)], n_lines.alias("n_lines"), removed.alias("n_removed"))
