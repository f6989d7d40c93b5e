"""Quantiles, effort selection and confidence."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def compliance_quantile(percentile: float) -> float:
    """The quantile that `percentile` of the samples must reach, in binary floating point."""
    return 1.0 - percentile


def type7(values: Column, q: float) -> Column:
    """Exact type-7 quantile of an array: low + fraction * (high - low), as written, so thresholds don't flip in the last bit.

    Null if the array is empty; a null or non-finite value is an error.
    """
    def of(s: Column) -> Column:
        h = (F.size(s) - 1) * F.lit(q)
        low = F.floor(h).cast("int")
        a = F.element_at(s, low + 1)
        b = F.element_at(s, F.least(low + 2, F.size(s)))
        return a + (h - low) * (b - a)

    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    ordered = F.get(F.transform(F.array(F.array_sort(values)), of), F.lit(0))
    return F.when(F.size(values) == 0, None).when(bad, F.raise_error(F.lit("quantile of a non-finite value"))).otherwise(ordered)


def select_ef(ef: Column, quantile: Column, value: float) -> Column:
    """Aggregate: the least ef whose quantile meets `value`, else the greatest."""
    return F.coalesce(F.min(F.when(quantile >= value, ef)), F.max(ef))


def target_met(quantile: Column, value: float) -> Column:
    return F.coalesce(F.max(quantile >= value), F.lit(False))


def transfer_confidence(n: Column, m: Column, p: float) -> Column:
    """P(Beta(m+1, n-m+1) >= p) = P(Binomial(n+1, p) <= m), each term from the logarithm of the one before.

    The largest term is factored out, so large n don't underflow.
    """
    odds = math.log(p) - math.log1p(-p)
    start = F.struct((n + 1).cast("double") * F.lit(math.log1p(-p)), F.lit(0.0), (n + 1).cast("double") * F.lit(math.log1p(-p)))
    start = F.struct(start["col1"].alias("term"), F.lit(1.0).alias("sum"), start["col1"].alias("top"))

    def step(s: Column, j: Column) -> Column:
        term = s["term"] + F.log((n + 2 - j).cast("double")) - F.log(j.cast("double")) + F.lit(odds)
        top = F.greatest(s["top"], term)
        return F.struct(term.alias("term"), (s["sum"] * F.exp(s["top"] - top) + F.exp(term - top)).alias("sum"), top.alias("top"))

    steps = F.when(m > 0, F.sequence(F.lit(1).cast("long"), m.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, step, lambda s: F.least(F.lit(1.0), F.exp(s["top"]) * s["sum"]))
