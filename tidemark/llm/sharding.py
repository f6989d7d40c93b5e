"""Histogram sort: exact byte counts below probe keys, refined until the splitters hold.

Native DataFrame code throughout; the driver sees histograms alone.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import clean_text, packed, stored, unpacked

#: Keys are the low 63 bits of a hash, so that they sort as signed longs.
KEY_BITS = 63
#: Bits of the first round's bins: the least, and the most, at which the driver sees a million counts.
FIRST_BITS, MOST_BITS = 12, 20
NEXT_BITS = 9


def _constant(values: list[int]) -> Column:
    """One folded array literal, however many values."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _histogram(rows: DataFrame, shift: int, within: list[int] | None, parent_shift: int) -> dict[int, tuple[int, int]]:
    """Exact (bytes, rows) per bin of 2**shift keys, inside the parent bins alone if given."""
    if within is not None:
        rows = rows.where(F.shiftright("__key", parent_shift).isin(within))
    found = rows.groupBy(F.shiftright("__key", shift).alias("bin")).agg(F.sum("__size").alias("b"), F.count(F.lit(1)).alias("n"))
    return {r["bin"]: (r["b"], r["n"]) for r in found.collect()}


def find_splitters(rows: DataFrame, n_shards: int, tolerance: float, first_bits: int = FIRST_BITS) -> tuple[list[int], dict[int, tuple[int, int]], int]:
    """Keys that begin shards 1 to n_shards-1, with the first histogram and its shift.

    A round counts bytes below evenly spaced probes; each next round puts new
    probes into those bins alone that hold an unmet target. It ends when each
    splitter is within `tolerance` of a shard's share, or its bin is one key.
    """
    shift = KEY_BITS - first_bits
    first = _histogram(rows, shift, None, 0)
    total = sum(b for b, _ in first.values())
    share = total / n_shards
    first_shift, splitters = shift, {}
    open_bins = {i: (0, 1 << KEY_BITS, 0) for i in range(1, n_shards)}  # target -> key range, bytes below it
    bins, parents = first, None
    while open_bins:
        edges: dict[int, list[tuple[int, int, int]]] = {}
        for i, (lo, hi, below) in list(open_bins.items()):
            if lo not in edges:
                at, here = below, []
                for b in sorted(x for x in bins if lo <= x << shift < hi):
                    here.append((at, b << shift, bins[b][0]))
                    at += bins[b][0]
                edges[lo] = here
            here, target = edges[lo], share * i
            if not here:
                splitters[i] = lo
                del open_bins[i]
                continue
            k = max(0, bisect_right([x[0] for x in here], target) - 1)
            at, key, size = here[k]
            near = min((at, key), (at + size, key + (1 << shift)), key=lambda x: abs(x[0] - target))
            if shift == 0 or abs(near[0] - target) <= tolerance * share:
                splitters[i] = min(near[1], (1 << KEY_BITS) - 1)
                del open_bins[i]
            else:
                open_bins[i] = (key, key + (1 << shift), at)
        if open_bins:
            parent_shift, shift = shift, max(0, shift - NEXT_BITS)
            parents = sorted({lo >> parent_shift for lo, _, _ in open_bins.values()})
            bins = _histogram(rows, shift, parents, parent_shift)
    return [splitters[i] for i in range(1, n_shards)], first, first_shift


def histogram_shards(
    df: DataFrame, n_shards: int = 24, tolerance: float = 1e-4, part_bytes: int = 256 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Deal whole rows into shards of near equal bytes, in a random but repeatable order.

    A row weighs the UTF-8 bytes of its text plus 8 (null text: 8). The sort key
    hashes the id and the row's place in the input, so that ids or texts that
    repeat, even a third of all rows, are spread like any others and no key ties.
    The rows are stored once with their keys; the rounds read keys and sizes
    alone; then each row moves once, to one of many parts, each of which lies
    within a shard and holds about `part_bytes`: no task gets a whole shard.

    Returns the input's columns (but those named like an output) and size, shard,
    slot (gapless from 0 in each shard, in key order) and no rows for an empty
    input. Null ids and repeated rows are ordinary rows.
    """
    rid = F.monotonically_increasing_id()
    size = F.octet_length(clean_text(text_col)).cast("long") + 8
    keep = [c for c in df.columns if c.lower() not in {"size", "shard", "slot"}]
    drawn = df.select(packed(df, keep), size.alias("__size"), rid.alias("__rid"), F.col(id_col).alias("__id"))
    rows = stored(drawn.withColumn("__key", F.xxhash64("__id", "__rid").bitwiseAND((1 << KEY_BITS) - 1)).drop("__id"))
    keys = rows.select("__key", "__size")
    total = keys.agg(F.sum("__size").alias("b")).first()["b"] or 0
    bits = min(MOST_BITS, max(FIRST_BITS, (total // part_bytes).bit_length() + 2))  # bins of a quarter of a part
    splitters, first, shift = find_splitters(keys, n_shards, tolerance, bits)

    coarse, filled = [], 0  # part of each first bin, before the shard's number is added
    at = 0
    for b in range(1 << bits):
        coarse.append(at)
        filled += first.get(b, (0, 0))[0]
        if filled >= part_bytes:
            at, filled = at + 1, 0
    n_parts = at + n_shards
    if n_shards <= 65:
        shard = sum((F.when(F.col("__key") >= s, 1).otherwise(0) for s in splitters), F.lit(0))
    else:
        cuts = _constant(splitters)
        shard = F.size(F.filter(cuts, lambda s: s <= F.col("__key")))
    part = (F.element_at(_constant(coarse), F.shiftright("__key", shift).cast("int") + 1) + F.col("__shard")).cast("int")
    place = lambda x: x.withColumn("__shard", shard.cast("int")).withColumn("__part", part)

    counts = {(r["__part"], r["__shard"]): r["n"] for r in place(keys).groupBy("__part", "__shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    base, before = [0] * n_parts, {}
    for (p, s), n in sorted(counts.items()):
        base[p] = before.get(s, 0)
        before[s] = base[p] + n
    dealt = place(rows).repartitionById(n_parts, F.col("__part"))
    slot = F.row_number().over(Window.partitionBy("__part").orderBy("__key", "__rid")) - 1 + F.element_at(_constant(base), F.col("__part") + 1)
    return dealt.select(*unpacked(keep), F.col("__size").alias("size"), F.col("__shard").alias("shard"), slot.cast("long").alias("slot"))
