"""Recall and latency summaries by dataset and effort, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import select_ef, target_met, type7


def quantiles(rows: DataFrame, by: tuple[str, ...], value: str, at: dict[str, float]) -> DataFrame:
    """Per group and column name its exact type-7 quantile, from counts of values: no list of a group's values is made.

    The window runs over a group's different values; nulls and non-finite values are errors, as in stats.type7.
    """
    x = F.col(value).cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    counts = rows.groupBy(*by, F.when(bad, F.raise_error(F.lit("quantile of a non-finite value")).cast("double")).otherwise(x).alias("__x")).agg(F.count(F.lit(1)).alias("__c"))
    group = Window.partitionBy(*by)
    placed = counts.withColumns({"__upto": F.sum("__c").over(group.orderBy("__x")), "__n": F.sum("__c").over(group)})
    low = lambda q: F.floor((F.col("__n") - 1) * F.lit(q))
    at_place = lambda place: F.min(F.when(F.col("__upto") > place, F.col("__x")))
    sides = placed.groupBy(*by).agg(F.max("__n").alias("__n"), *[c for name, q in at.items() for c in (at_place(low(q)).alias(f"__a_{name}"), at_place(F.least(low(q) + 1, F.col("__n") - 1)).alias(f"__b_{name}"))])
    value_of = lambda name, q: F.col(f"__a_{name}") + ((F.col("__n") - 1) * F.lit(q) - low(q)) * (F.col(f"__b_{name}") - F.col(f"__a_{name}"))
    return sides.select(*by, *[value_of(name, q).alias(name) for name, q in at.items()])


def effort_summary(rows: DataFrame, k: int, by: tuple[str, ...] = ("dataset", "ef")) -> DataFrame:
    """Per group: query_count, recall_mean (from whole hits, so bit-stable), p90/p50/p10/p05 and frac_below_0_9."""
    n = F.count(F.lit(1))
    out = rows.groupBy(*by).agg(n.alias("query_count"), (F.sum("hits") / (n * F.lit(float(k)))).alias("recall_mean"), (F.count_if(F.col("recall") < 0.9) / n).alias("frac_below_0_9"))
    at = {"recall_p90": 0.9, "recall_p50": 0.5, "recall_p10": 0.1, "recall_p05": 0.05}
    return out.join(quantiles(rows, by, "recall", at), [*by]).select(*by, "query_count", "recall_mean", *at, "frac_below_0_9")


def latency_summary(rows: DataFrame, by: tuple[str, ...] = ("dataset", "ef")) -> DataFrame:
    """Mean, median and 90th percentile of latency_ms."""
    means = rows.groupBy(*by).agg(F.avg("latency_ms").alias("latency_mean_ms"))
    return means.join(quantiles(rows, by, "latency_ms", {"latency_p50_ms": 0.5, "latency_p90_ms": 0.9}), [*by])


def median_of_repeats(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The middle latency of repeated runs of a query."""
    return quantiles(rows, by, "latency_ms", {"latency_ms": 0.5})


def crossings(summary: DataFrame, target: float) -> DataFrame:
    """dataset, crossing_ef: where mean recall, read as a line between efforts, first meets `target`; null if never.

    An exact hit, or a flat piece at the target, gives its own effort.
    """
    w = Window.partitionBy("dataset").orderBy("ef")
    step = summary.select("dataset", F.col("ef").cast("double").alias("ef"), F.col("recall_mean").alias("r"), F.lead(F.col("ef").cast("double")).over(w).alias("ef2"), F.lead("recall_mean").over(w).alias("r2"))
    r, r2, t = F.col("r"), F.col("r2"), F.lit(target)
    at = (
        F.when(r == t, F.col("ef"))
        .when(r2.isNull() | ((r - t) * (r2 - t) > 0), None)
        .when(r2 == r, F.col("ef"))
        .otherwise(F.col("ef") + (t - r) / (r2 - r) * (F.col("ef2") - F.col("ef")))
    )
    return step.withColumn("at", at).groupBy("dataset").agg(F.min_by("at", F.when(F.col("at").isNotNull(), F.col("ef"))).alias("crossing_ef"))


def crossing_gap(crossed: DataFrame) -> DataFrame:
    return crossed.agg((F.max("crossing_ef") - F.min("crossing_ef")).alias("gap"), F.count("crossing_ef").alias("datasets_crossing"))


def boxplot(rows: DataFrame, ef: int) -> DataFrame:
    """Quartiles and range of recall at one effort; an effort without rows is an error when it runs."""
    mine = rows.where(F.col("ef") == ef)
    some = mine.agg(F.assert_true(F.count(F.lit(1)) > 0, F.lit(f"no rows of ef {ef}")).alias("some"))
    ends = mine.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.min("recall").alias("low"), F.max("recall").alias("high"))
    out = ends.join(quantiles(mine, ("dataset",), "recall", {"q1": 0.25, "median": 0.5, "q3": 0.75}), "dataset")
    return some.join(out, F.col("some").isNull(), "left").select("dataset", "n", "q1", "median", "q3", "low", "high")


def shuffled_split(rows: DataFrame, train_fraction: float, seed: int, by: str = "dataset", key: str = "qid") -> DataFrame:
    """dataset, qid, is_train: the first int(n * fraction) ids of a seeded order are train. The order is by hash, so it is the same on any cluster."""
    ids = rows.select(by, key).distinct()
    order = Window.partitionBy(by).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(by), F.lit(":"), F.col(key).cast("string"))), key)
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    return ids.select(by, key, (F.row_number().over(order) <= F.floor(n * F.lit(train_fraction))).alias("is_train"))


def calibration_transfer(rows: DataFrame, target: float, quantile_at: float, train_fraction: float = 0.7, seed: int = 7) -> DataFrame:
    """Per dataset: the least effort whose train quantile meets the target, and whether the holdout agrees."""
    split = shuffled_split(rows, train_fraction, seed)
    sides = rows.join(split, ["dataset", "qid"]).groupBy("dataset", "ef").agg(
        type7(F.collect_list(F.when(F.col("is_train"), F.col("recall"))), quantile_at).alias("train_q"),
        type7(F.collect_list(F.when(~F.col("is_train"), F.col("recall"))), quantile_at).alias("test_q"),
        F.count_if("is_train").alias("train_queries"),
        F.count_if(~F.col("is_train")).alias("test_queries"),
    )
    chosen = sides.groupBy("dataset").agg(select_ef(F.col("ef"), F.col("train_q"), target).alias("selected_ef"), target_met(F.col("train_q"), target).alias("cleared"))
    note = F.when(F.col("cleared"), "least ef whose train quantile meets the target").otherwise("no ef meets the target on train")
    out = chosen.join(sides, "dataset").where(F.col("ef") == F.col("selected_ef"))
    return out.select("dataset", "selected_ef", F.col("train_q").alias("train_p10"), F.col("test_q").alias("test_p10"), (F.col("test_q") >= target).alias("test_clears"), "train_queries", "test_queries", note.alias("selection_note"))


def compare_recalls(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Share of equal recalls and greatest difference of two sweeps over (qid, ef)."""
    both = ours.alias("a").join(theirs.alias("b"), ["qid", "ef"])
    gap = F.abs(F.col("a.recall") - F.col("b.recall"))
    return both.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(gap == 0).alias("equal"), F.max(gap).alias("max_gap"), F.avg(F.col("a.recall") - F.col("b.recall")).alias("mean_gap"))


def rolling_mean(rows: DataFrame, partition: str, order: list[str], value: str, last: int) -> DataFrame:
    """Mean of each row and up to last-1 before it."""
    w = Window.partitionBy(partition).orderBy(*order).rowsBetween(-(last - 1), 0)
    return rows.withColumn("rolling_mean", F.avg(value).over(w))
