"""Near-dedup at an exact Jaccard similarity of word shingles, by SimHash and BK-trees.

Documents that agree in a band of min-hashes are candidates; those that
candidates join form a shard. Each shard is a BK-tree over SimHash fingerprints
of the shingles, searched within RADIUS bits along the edges that can hold such
a pair; each pair found is verified on the shingles before it links. A shard of
more than CHUNK documents is taken band by band instead, and a large band as
pairs of chunks, so that no task grows with a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import clean_text, drop_stored, free_names, rows_of, small_batches, small_or_shuffled, stored
from tidemark.llm.components import components
from tidemark.llm.repeats import mix
from tidemark.llm.simhash import Forest, hook

SHINGLE = 5
#: Similarity that links, as a fraction.
NUM, DEN = 4, 5
#: Bands of min-hashes and min-hashes in each: two sets at the least similarity agree in none with a chance of 1 in 90,000.
BANDS, ROWS = 16, 3
#: SimHash bits in which linked documents may differ: at the least similarity 10 on average, or 12 of very few shingles, with a deviation of 3.
RADIUS = 26
#: Documents that one BK-tree holds; larger shards are divided.
CHUNK = 2000

_WORD = np.uint64(0x9E3779B97F4A7C15)
_HASHES = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the different lower-cased five-word shingles; all words are one shingle where there are fewer."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(SHINGLE, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * _WORD + h[k : len(h) - n + 1 + k]
    return np.unique(mix(out))


def simhash(hashes: np.ndarray) -> int:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view("<i8")[0])


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of min-hashes of a set; none of an empty one."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.array([np.min(hashes * a) for a in _HASHES]) if len(hashes) > 4096 else (hashes * _HASHES[:, None]).min(axis=1)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = key * _WORD + mix(least[k::ROWS])
    return mix(key).view(np.int64)


class Sets:
    """Sorted hash sets side by side; overlaps count shared members of one set with many."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.size)
        names, of, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        several = times[of] > 1
        self.member, owner = of[several], owner[several]
        self.start = np.searchsorted(owner, np.arange(len(sets) + 1))
        self.mark = np.zeros(len(names), np.int64)

    def overlaps(self, one: int, others: np.ndarray) -> np.ndarray:
        mine = self.member[self.start[one] : self.start[one + 1]]
        self.mark[mine] = 1
        a, n = self.start[others], self.start[others + 1] - self.start[others]
        ends = np.cumsum(n)
        hit = np.concatenate(([0], np.cumsum(self.mark[self.member[np.repeat(a - ends + n, n) + np.arange(ends[-1])]])))
        self.mark[mine] = 0
        return hit[ends] - hit[ends - n]


def linked(fp: np.ndarray, sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
    """For each document a fellow of its class, the same for all of a class; pairs of one part are left out where there are two parts."""
    label = np.arange(len(sets))
    table = Sets(sets)
    two = bool((part != part[0]).any())
    forest = Forest(fp, np.zeros(len(fp), np.int64))
    for q, node in forest.links(np.arange(len(fp)), RADIUS):
        few, many = np.minimum(table.size[q], table.size[node]), np.maximum(table.size[q], table.size[node])
        ask = (q < node) & (DEN * few >= NUM * many)
        if two:
            ask &= part[q] != part[node]
        order = np.argsort(q[ask], kind="stable")
        q, node = q[ask][order], node[ask][order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(q)) + 1, [len(q)])) if len(q) else np.zeros(1, np.int64)
        for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            one, others = int(q[a]), node[a:b]
            others = others[label[others] != label[one]]
            if len(others):
                shared = table.overlaps(one, others)
                others = others[DEN * shared >= NUM * (table.size[one] + table.size[others] - shared)]
                hook(label, np.full(len(others), one), others)
    return label


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_64_intdigest

    for b in batches:
        keys, found = [], []
        for _, _, t in rows_of(b, 3):
            s = shingles(t)
            keys.append(xxh3_64_intdigest(s.tobytes()))
            found.append(bands(s))
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
        m = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(keys, np.uint64).view(np.int64)), m], ["__id", "__h", "k", "m"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [shingles(t) for _, t in rows_of(b, 2)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([simhash(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary()), b.column(2)], ["k", "f", "s", "places"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, pair, part, k, f, s) in order of shard and pair -> links (u, v), one shard in memory."""
    now, held = None, []

    def flush() -> pa.RecordBatch:
        k = np.array([r[1] for r in held], np.int64)
        label = linked(np.array([r[2] for r in held], np.int64).view(np.uint64), [np.frombuffer(r[3], "<u8") for r in held], np.array([r[0] for r in held]))
        off = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(k[off]), pa.array(k[label[off]])], ["u", "v"])

    for b in batches:
        for shard, pair, *row in rows_of(b, 6):
            if (shard, pair) != now:
                if len(held) > 1:
                    yield flush()
                now, held = (shard, pair), []
            held.append(row)
    if len(held) > 1:
        yield flush()


def similar_components(marked: DataFrame, texts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of the keys `k` whose texts are linked: `marked` has (k, m); texts_of adds each key's text `t` to rows (k, places)."""
    rows = marked.select("k", F.explode("m").alias("x"))
    shared = stored(rows.groupBy("x").agg(F.min("k").alias("least"), F.max("k").alias("most")).where("least <> most").select("x", "least"))
    met = stored(rows.join(shared, "x").select("x", "k", "least").distinct())
    near = stored(components(met.select(F.col("k").alias("u"), F.col("least").alias("v"))))
    large = stored(near.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK).select("root"))
    place = lambda shard, pair, part: F.struct(shard.cast("long").alias("shard"), pair.cast("long").alias("pair"), part.cast("int").alias("part"))
    places = near.join(small_or_shuffled(large, 8), "root", "left_anti").select(F.col("node").alias("k"), place(F.col("root"), F.lit(0), F.lit(0)).alias("p"))
    if not large.isEmpty():
        in_large = near.join(small_or_shuffled(large, 8), "root").select(F.col("node").alias("k"))
        divided = stored(met.join(in_large, "k").select("k", "x"))
        counts = stored(divided.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks")).where("chunks > 1"))
        chunks = F.coalesce("chunks", F.lit(1).cast("long"))
        mine = F.pmod(F.xxhash64("k"), chunks)
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda c: place(F.col("x"), F.least(mine, c) * (1 << 20) + F.greatest(mine, c), mine))
        places = places.union(divided.join(small_or_shuffled(counts, 24), "x", "left").select("k", F.explode(pairs).alias("p")))
    wanted = stored(places.groupBy("k").agg(F.collect_list("p").alias("places")))
    full = stored(texts_of(wanted).select("k", "t", "places").mapInArrow(_sets, "k long, f long, s binary, places array<struct<shard:long,pair:long,part:int>>"))
    dealt = full.select("k", "f", "s", F.explode("places").alias("p")).repartition("p.shard", "p.pair").sortWithinPartitions("p.shard", "p.pair", "k")
    links = stored(dealt.select("p.shard", "p.pair", "p.part", "k", "f", "s").mapInArrow(_verified, "u long, v long"))
    drop_stored(full)
    return components(links)


def keep_one_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with one row of each component of documents linked by a similarity of 0.8 or more: that of the least id, nulls last.

    Rows are told apart by id and text, so repeated and null ids are rows like
    others, and rows equal in both are one. Texts without words (null, empty) equal
    each other. Ties of the id go by the text's hash. An empty table stays empty.
    """
    names = free_names(df, ["key", "gone"])
    key = [F.col(id_col).alias("__id"), F.xxhash64(clean_text(text_col)).alias("__h")]
    plain = small_batches(df).select(*key, clean_text(text_col).alias("t"))
    kind = plain.schema["__id"].dataType.simpleString()
    marked = stored(plain.mapInArrow(_marks, f"__id {kind}, __h long, k long, m array<long>"))
    order = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__h").alias("h"))
    classes = stored(marked.groupBy("k").agg(F.min(order).alias("r")))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    several = _repeats(marked)

    def texts_of(wanted: DataFrame) -> DataFrame:
        """Candidates alone meet the texts, which so are shuffled once at most."""
        rows = stored(wanted.join(classes, "k").select("k", "places", F.col("r.id").alias("i"), F.col("r.h").alias("h")))
        found = plain.join(small_or_shuffled(rows, 64, per_item=("places", 24)), same("__id", "i") & (F.col("__h") == F.col("h"))).select("k", "t", "places")
        return found.dropDuplicates(["k"]) if several else found

    roots = similar_components(marked.select("k", "m"), texts_of)
    named = stored(classes.join(roots, F.col("k") == F.col("node"), "left").select("k", "r", F.coalesce("root", "k").alias("root")))
    least = named.groupBy("root").agg(F.min("r").alias("r"))
    keep = named.select("k", "root").join(least, "root").select("k", "r")
    gone = marked.select("__id", "__h", "k").join(keep, "k").where(~(same("__id", "r.id") & (F.col("__h") == F.col("r.h")))).select(F.struct(F.col("__id").alias("id"), F.col("__h").alias("h")).alias(names["gone"])).distinct()
    gone = small_or_shuffled(stored(gone), 32)
    keyed = df.withColumn(names["key"], F.struct(F.col(id_col).alias("id"), F.xxhash64(clean_text(text_col)).alias("h")))
    out = keyed.join(gone, F.col(names["key"]).eqNullSafe(F.col(names["gone"])), "left_anti")
    return (out.dropDuplicates([names["key"]]) if several else out).drop(names["key"])


def _repeats(marked: DataFrame) -> bool:
    return not marked.groupBy("__id", "__h").count().where("count > 1").isEmpty()
