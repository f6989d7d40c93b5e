"""FNV-1a 64 and the train/holdout split, as native expressions.

ANSI arithmetic rejects a wrapping 64-bit product, so the state is two 32-bit
halves. The prime is 2**40 + 435: the low half times 435 carries into the high
one, and the 2**40 term adds the low half's 24 bits shifted by 8.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of FNV-1a 64.
OFFSET_BASIS = 0xCBF29CE484222325
PRIME = 0x100000001B3
SPLIT_BUCKETS = 10_000
_LOW = 0xFFFFFFFF


def _state(hi: Column, lo: Column) -> Column:
    return F.struct(hi.alias("hi"), lo.alias("lo"))


def fnv1a_limbs(text: Column) -> Column:
    """struct(hi, lo) of the FNV-1a 64 hash of a string of ASCII characters; null stays null."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    codes = F.when(F.length(text) > 0, codes).otherwise(F.array().cast("array<bigint>"))

    def step(s: Column, b: Column) -> Column:
        low = s["lo"].bitwiseXOR(b)
        product = low * 435
        high = s["hi"] * 435 + F.shiftright(product, 32) + F.shiftleft(low.bitwiseAND(0xFFFFFF), 8)
        return _state(high.bitwiseAND(_LOW), product.bitwiseAND(_LOW))

    start = _state(F.lit(OFFSET_BASIS >> 32).cast("long"), F.lit(OFFSET_BASIS & _LOW).cast("long"))
    return F.when(text.isNotNull(), F.aggregate(codes, start, step))


def limbs_decimal(limbs: Column) -> Column:
    """Unsigned value as decimal(20,0)."""
    return (limbs["hi"].cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(20,0)") + limbs["lo"].cast("decimal(20,0)")).cast("decimal(20,0)")


def limbs_text(limbs: Column) -> Column:
    """Unsigned value in decimal ASCII, the form that the split hashes."""
    return limbs_decimal(limbs).cast("string")


def limbs_hex(limbs: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(limbs["hi"]), 8, "0"), F.lpad(F.hex(limbs["lo"]), 8, "0")))


def limbs_mod(limbs: Column, modulus: int = SPLIT_BUCKETS) -> Column:
    return F.pmod(limbs["hi"] * F.lit((1 << 32) % modulus) + limbs["lo"], F.lit(modulus))


def split_threshold(fraction: float) -> int:
    """fraction of 10000, halves rounded up; it must leave both sides something."""
    if not math.isfinite(fraction):
        raise ValueError("train_fraction must be finite")
    threshold = math.floor(fraction * SPLIT_BUCKETS + 0.5)
    if not 1 <= threshold <= SPLIT_BUCKETS - 1:
        raise ValueError("train_fraction must round to 1..9999 of 10000")
    return threshold


def is_train_member(vector_hash: Column, seed: int, fraction: float) -> Column:
    """Whether a vector hash (unsigned, as decimal or digits) falls on the train side: content decides, never a row's place."""
    key = F.concat(F.lit(f"s:{seed}:"), vector_hash.cast("string"))
    return limbs_mod(fnv1a_limbs(key)) < split_threshold(fraction)


@F.pandas_udf(T.LongType())
def payload_hash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """FNV-1a 64 of binary payloads, as signed bigint; Arrow batches, a byte position of all rows at a time."""
    for payloads in batches:
        sizes = payloads.map(lambda b: -1 if b is None else len(b)).to_numpy()
        width = max(0, sizes.max(initial=0))
        grid = np.zeros((len(payloads), width), np.uint8)
        for row, payload in enumerate(payloads):
            if payload:
                grid[row, : len(payload)] = np.frombuffer(payload, np.uint8)
        state = np.full(len(payloads), OFFSET_BASIS, np.uint64)
        for at in range(width):
            more = (state ^ grid[:, at]) * np.uint64(PRIME)
            state = np.where(at < sizes, more, state)
        yield pd.Series(state.view(np.int64)).astype("Int64").mask(sizes < 0)


def unsigned(value: Column) -> Column:
    """A signed bigint's bits as an unsigned decimal(20,0)."""
    wide = value.cast("decimal(20,0)")
    return F.when(value < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")
