"""Exact repeats of fixed length, the part that byte and word dedup share.

Each window of `length` units (bytes or words) picks its least `gram` hash, the
anchor, so equal windows share anchor and place in it. Windows next to each
other with one anchor form a context. Only contexts whose anchor occurs twice
matter, and equal contexts are one: the text of their first occurrence goes
through the structure that finds the repeats, with their number as its weight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import clean_text, drop_stored, rows_of, small_batches, small_or_shuffled, stored

#: Windows of a text handled at once; longer texts go in overlapping parts.
PART = 1 << 19
PLACE_BITS = 20
#: Different contexts of an anchor beyond which the group is cut by place and common core.
HOT = 2_000
#: Units of context text that a task analyses at once.
BATCH_UNITS = 1 << 19

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = x * _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(units: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each `gram` (a power of two) successive unit hashes."""
    h, have = units, 1
    while have < gram:
        h = mix(h[:-have] * _M2 + h[have:])
        have *= 2
    return h


def _least(x: np.ndarray, n: int) -> np.ndarray:
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def contexts(units: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor's place, anchor's hash) of each context of a text's unit hashes."""
    found = []
    for at in range(0, max(0, len(units) - length + 1), PART):
        h = gram_hashes(units[at : at + PART + length - 1], gram)
        mask = np.uint64((1 << PLACE_BITS) - 1)
        least = _least((h & ~mask) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        place = (least & mask).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        found.append((first + at, np.diff(np.append(first, len(place))), place[first] + at, h[place[first]]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


@dataclass(frozen=True)
class Kind:
    """How a text falls into units: read gives unit hashes, and cut the bytes of units [a, b)."""

    length: int
    gram: int
    piece: int  # window places that a piece of a hot group spans
    read: Callable[[str], tuple[np.ndarray, Callable[[int, int], bytes]]]
    cut: Callable[[str], Callable[[int, int], bytes]]


def _anchor_rows(kind: Kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for b in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            for d, h, t in rows_of(b, 3):
                units, cut = kind.read(t)
                first, n, place, anchor = contexts(units, kind.length, kind.gram)
                if len(first):
                    ends = first + n + kind.length - 1
                    marks = np.fromiter((xxh3_64_intdigest(cut(x, y)) for x, y in zip(first.tolist(), ends.tolist(), strict=True)), np.uint64, len(first))
                    for c, x in zip(cols, (anchor.view(np.int64), marks.view(np.int64), np.full(len(first), d), np.full(len(first), h), first, n, place - first), strict=True):
                        c.append(x)
            if cols[0]:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(cols, kinds, strict=True)], ["a", "c", "id", "h", "i", "n", "o"])

    return run


def _cut_rows(kind: Kind):
    """Texts with the wanted contexts -> (a, c, o, n, id, i, weight, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, d, wanted in rows_of(b, 3):
                cut = kind.cut(t)
                for w in wanted:
                    rows.append((w["a"], w["c"], w["o"], w["n"], d, w["i"], w["weight"], cut(w["i"], w["i"] + w["n"] + kind.length - 1)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["a", "c", "o", "n", "id", "i", "weight", "bytes"])

    return run


CUT = "a long, c long, o int, n int, id long, i long, weight long, bytes binary"


def _pieces(kind: Kind, slices):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for b in batches:
            rows = []
            for a, c, o, n, d, i, weight, data in zip(*(b.column(x).to_pylist() for x in range(8)), strict=True):
                cut, at = slices(data), 0
                while at < n:  # window `at` has the anchor at place o - at
                    top = (o - at) // kind.piece * kind.piece  # least place of the piece
                    end = min(n, o - top + 1)
                    # all windows of the piece, here or elsewhere, hold the units from
                    # place `top` before the anchor to length - top - kind.piece + 1 after it
                    core = cut(o - top, o - top - kind.piece + 1 + kind.length)
                    key = xxh3_64_intdigest(core + top.to_bytes(4, "little") + a.to_bytes(8, "little", signed=True))
                    rows.append((key - (1 << 64) if key >> 63 else key, a, c, o - at, end - at, d, i + at, weight, cut(at, end + kind.length - 1), at))
                    at = end
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["g", "a", "c", "o", "n", "id", "i", "weight", "bytes", "at"])

    return run


def _analyse(find: Callable[[list[tuple]], Iterator[tuple[int, int, int]]], length: int, size: Callable[[bytes], int]):
    """Groups in order of g -> (c, first window, windows) runs, a batch of whole groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, units, last = [], 0, None

        def flush() -> pa.RecordBatch:
            out = [(held[k][1], held[k][2], held[k][8] + s, m) for k, s, m in find(held)]
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["a", "c", "s", "m"])

        for b in batches:
            for row in zip(*(b.column(x).to_pylist() for x in range(9)), strict=True):
                if units >= BATCH_UNITS and row[0] != last:
                    yield flush()
                    held, units = [], 0
                last = row[0]
                held.append(row)
                units += size(row[7])
        if held:
            yield flush()

    return run


def repeated_runs(
    df: DataFrame, kind: Kind, id_col: str, text_col: str, find, slices: Callable[[bytes], Callable[[int, int], bytes]], size: Callable[[bytes], int], keep_first: bool
) -> DataFrame:
    """(id, h, runs): per document (id with the text's hash) its runs struct(s, e) of windows that repeat.

    keep_first: a window counts only if it also starts earlier (less id, or less
    start in one document); else if it starts anywhere else. Documents are read
    for anchors, then the representatives' texts are cut out. What grows with the
    input is shuffled at every size, and nothing of it is broadcast.
    """
    docs = keyed(small_batches(df), id_col, text_col)
    rows = stored(docs.select("id", "h", "t").mapInArrow(_anchor_rows(kind), "a long, c long, id long, h long, i long, n int, o int"))
    twice = stored(rows.groupBy("a").agg(F.count(F.lit(1)).alias("all")).where("all > 1").select("a"))
    seen = stored(rows.join(twice, "a"))
    drop_stored(rows)

    # one row for each different context, with its first occurrence
    each = seen.groupBy("a", "c").agg(F.min(F.struct("id", "i", "h", "n", "o")).alias("r"), F.count(F.lit(1)).alias("weight"))
    each = stored(each.select("a", "c", "r.*", "weight"))
    wanted = each.groupBy("id", "h").agg(F.collect_list(F.struct("a", "c", "o", "n", "i", "weight")).alias("wanted"))
    repeats = not docs.groupBy("id", "h").count().where("count > 1").isEmpty()  # such rows are one text to cut
    texts = docs.join(wanted, ["id", "h"]).select("t", "id", "wanted")
    cuts = stored(texts.mapInArrow(_cut_rows(kind), CUT).dropDuplicates(["a", "c"]) if repeats else texts.mapInArrow(_cut_rows(kind), CUT))
    hot = stored(each.groupBy("a").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > HOT).select("a"))
    order = ["g", "a", "c", "o", "n", "id", "i", "weight", "bytes", "at"]
    if hot.isEmpty():
        grouped = cuts.withColumns({"g": F.col("a"), "at": F.lit(0)}).select(*order)
    else:
        mark = small_or_shuffled(hot, 16)
        cool = cuts.join(mark, "a", "left_anti").withColumns({"g": F.col("a"), "at": F.lit(0)}).select(*order)
        cut = cuts.join(mark, "a", "left_semi").select("a", "c", "o", "n", "id", "i", "weight", "bytes")
        pieces = cut.mapInArrow(_pieces(kind, slices), "g long, a long, c long, o int, n int, id long, i long, weight long, bytes binary, at int")
        grouped = cool.union(pieces.select(*order))
    dealt = grouped.repartition("g").sortWithinPartitions("g", "id", "i").select("g", "a", "c", "n", "id", "i", "weight", "bytes", "at")
    found = stored(dealt.mapInArrow(_analyse(find, kind.length, size), "a long, c long, s int, m int"))
    per = found.groupBy("a", "c").agg(F.collect_list(F.struct("s", "m")).alias("found"))
    each = each.join(per, ["a", "c"], "left").select("a", "c", F.col("id").alias("id0"), F.col("i").alias("i0"), "found")
    each = stored(each)  # so that the join below is of two plain exchanges, whose hot partitions Spark splits
    all_windows = F.array(F.struct(F.lit(0).alias("s"), F.col("n").alias("m")))
    part = F.coalesce("found", F.array().cast("array<struct<s:int,m:int>>"))
    # the structure judges a context's first occurrence; the others repeat it from end to end
    first = (F.col("id") == F.col("id0")) & (F.col("i") == F.col("i0"))
    runs = F.when(first, part).otherwise(all_windows) if keep_first else part
    marked = seen.join(each, ["a", "c"]).select("id", "h", F.explode(F.transform(runs, lambda r: F.struct((F.col("i") + r["s"]).alias("s"), (F.col("i") + r["s"] + r["m"]).alias("e")))).alias("r"))
    return marked.groupBy("id", "h").agg(F.collect_set("r").alias("runs"))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (null: the least long), h and t of each row: h tells rows of one id apart, by their text; 0 where no id repeats."""
    mark = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    unique = df.groupBy(mark.alias("id")).count().where("count > 1").isEmpty()
    return df.select(F.col(id_col).cast("long").alias("doc_id"), mark.alias("id"), (F.lit(0).cast("long") if unique else F.xxhash64(text_col)).alias("h"), clean_text(text_col).alias("t"))
