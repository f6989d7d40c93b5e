"""SimHash near-dedup with BK-trees.

Fingerprints that agree in one of four 16-bit blocks form a shard (two within
three bits always agree in one). A shard is cut once more by the blocks of its
other 48 bits, and each piece gets a BK-tree whose children are keyed by the
integer Hamming distance to their parent; a search follows only edges within
the radius. All trees of a task are built and searched together with numpy.
The trees are built where their shard's fingerprints land, instead of being
broadcast: a broadcast would gather every fingerprint on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import clean_text, free_names, rows_of, small_batches, small_or_shuffled, stored
from tidemark.llm.components import components

SEED = 42
SHINGLE = 3
RADIUS = 3
BLOCKS, SUB_BLOCKS = 4, 4
#: Distinct fingerprints of a block's shard that one task takes; larger shards are dealt as pairs of chunks.
CHUNK = 200_000
#: Tree nodes that one step of a search looks at.
FRONTIER = 250_000


def fingerprint(text: str | None) -> int:
    """64-bit SimHash over lower-cased 3-word shingles; 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: -SHINGLE] + 1)).tolist()
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    on = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(on, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([fingerprint(t) for _, t in rows_of(b, 2)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], ["__id", "__fp"])


def _blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of `parts` blocks that cover `bits` bits."""
    width = bits // parts
    return [(i * width, width if i < parts - 1 else bits - i * width) for i in range(parts)]


def _rest(fp: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The 48 bits beside the 16-bit block at `shift`."""
    low = fp & ((np.uint64(1) << shift) - np.uint64(1))
    high = np.where(shift < np.uint64(48), fp >> np.minimum(shift + np.uint64(16), np.uint64(63)), np.uint64(0))
    return (high << shift) | low


class Forest:
    """BK-trees over `fp`, one for each value of `shard` (sorted), built level by level."""

    def __init__(self, fp: np.ndarray, shard: np.ndarray) -> None:
        n = len(fp)
        self.fp = fp
        first = np.concatenate(([True], shard[1:] != shard[:-1])) if n else np.zeros(0, bool)
        self.root = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, np.int64)
        parent, label = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        left = np.flatnonzero(~first)
        at = self.root[left]
        while len(left):
            d = np.bitwise_count(fp[left] ^ fp[at]).astype(np.int64)
            _, head, of = np.unique(at * 65 + d, return_index=True, return_inverse=True)
            child = left[head]
            parent[child], label[child] = at[head], d[head]
            at = child[of]
            stay = np.ones(len(left), bool)
            stay[head] = False
            left, at = left[stay], at[stay]
        kids = np.flatnonzero(parent >= 0)
        key = parent[kids] * 65 + label[kids]
        order = np.argsort(key, kind="stable")
        self.kids, self.keys = kids[order], key[order]

    def links(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) index pairs within the radius, each from the tree of the query's shard."""
        work = [(queries, self.root[queries])]
        while work:
            q, node = work.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                work += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            d = np.bitwise_count(self.fp[q] ^ self.fp[node]).astype(np.int64)
            near = (d <= radius) & (q != node)
            if near.any():
                yield q[near], node[near]
            lo = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), side="right")
            n = hi - lo
            if n.any():
                q2 = np.repeat(q, n)
                kid = self.kids[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
                work.append((q2, kid))


def hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of a[i] and b[i] in place; label points at least members."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(label, up := label[label]):
            label[:] = up


#: Rows of shards that a task links at once; a single shard is at most two chunks.
ROWS = 400_000


def _shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of rows (block, value, pair, fp) in that order, some whole shards at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b.select(["block", "value", "pair", "fp"]))
        if sum(x.num_rows for x in held) >= ROWS:
            t = pa.Table.from_batches(held).combine_chunks()
            key = np.stack([t[c].to_numpy().astype(np.int64) for c in ("block", "value", "pair")])
            last = int(np.searchsorted((key != key[:, -1:]).any(axis=0)[::-1], True))  # rows of the last shard
            if last < t.num_rows:
                yield _links_of(t.slice(0, t.num_rows - last))
            held = t.slice(t.num_rows - last).to_batches()
    if held and (t := pa.Table.from_batches(held)).num_rows:
        yield _links_of(t)


def _links_of(t: pa.Table) -> pa.RecordBatch:
    """Spanning links of complete shards."""
    block, pair = t["block"].to_numpy().astype(np.uint64), t["pair"].to_numpy()
    fp = t["fp"].to_numpy().view(np.uint64)
    shift = block * np.uint64(16)
    value = (fp >> shift) & np.uint64(0xFFFF)
    rest = _rest(fp, shift)
    uniq, ids = np.unique(fp, return_inverse=True)
    label = np.arange(len(uniq))
    for at, width in _blocks(48, SUB_BLOCKS):
        sub = (rest >> np.uint64(at)) & np.uint64((1 << width) - 1)
        key = (block << np.uint64(28)) | (value << np.uint64(12)) | sub
        order = np.lexsort((fp, key, pair))
        k, p = key[order], pair[order]
        edge = np.concatenate(([True], (k[1:] != k[:-1]) | (p[1:] != p[:-1])))
        shard = np.cumsum(edge) - 1
        many = np.bincount(shard)[shard] > 1
        order, shard = order[many], shard[many]
        forest = Forest(fp[order], shard)
        for q, node in forest.links(np.arange(len(order)), RADIUS):
            hook(label, ids[order[q]], ids[order[node]])
    off = np.flatnonzero(label != np.arange(len(uniq)))
    return pa.RecordBatch.from_arrays([pa.array(uniq[off].view(np.int64)), pa.array(uniq[label[off]].view(np.int64))], ["u", "v"])


def fingerprint_links(classes: DataFrame) -> DataFrame:
    """(u, v): links enough to join all `fp` of `classes` (distinct longs) within the radius into components."""
    blocks = F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF).alias("value")) for i in range(BLOCKS)]))
    rows = classes.select("fp", blocks.alias("b")).select("fp", "b.block", "b.value")
    large = stored(rows.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK))
    if large.isEmpty():
        rows = rows.withColumn("pair", F.lit(0))
    else:
        chunks = F.ceil(F.col("n") / CHUNK).cast("int")
        mine = F.pmod(F.xxhash64("fp"), F.coalesce(chunks, F.lit(1))).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.coalesce(chunks, F.lit(1)) - 1), lambda c: F.least(mine, c) * 65536 + F.greatest(mine, c))
        rows = rows.join(small_or_shuffled(large, 32), ["block", "value"], "left").withColumn("pair", F.explode(pairs)).drop("n")
    dealt = rows.repartition("block", "value", "pair").select("block", "value", "pair", "fp").sortWithinPartitions("block", "value", "pair")
    return dealt.mapInArrow(_shard_links, "u long, v long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint hex, component_id) for every row.

    component_id is the least non-null id reachable over fingerprints that differ
    in at most 3 bits; null where all ids of a component are null. A null text has
    no words, so fingerprint zero, linked like any other. Equal fingerprints are
    one node, so copies cost one row each and no pairs.
    """
    plain = small_batches(df).select(F.col(id_col).alias("__id"), clean_text(text_col).alias("__t"))
    kind = plain.schema["__id"].dataType.simpleString()
    marked = stored(plain.mapInArrow(_fingerprints, f"__id {kind}, __fp long"))
    classes = stored(marked.groupBy(F.col("__fp").alias("fp")).agg(F.min("__id").alias("rep")))
    roots = components(fingerprint_links(classes.select("fp")))
    named = stored(classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_fp = named.join(least, "root").select("fp", "component_id")
    out = marked.join(by_fp, F.col("__fp") == F.col("fp"))
    return out.select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with the document of the least id of each component alone; null ids go unless all of a component's are.

    Rows that repeat the least id are reduced to one.
    """
    found = stored(near_duplicates(df, id_col, text_col).select(id_col, "component_id"))
    name = free_names(df, ["gone"])["gone"]
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    gone = small_or_shuffled(stored(gone), 16)
    out = df.join(gone, F.col(id_col) == F.col(name), "left_anti")
    orphans = found.where(F.col(id_col).isNull()).agg(F.count(F.lit(1)).alias("n"), F.count("component_id").alias("named")).first()
    if orphans["n"] and orphans["n"] == orphans["named"]:
        out = out.where(F.col(id_col).isNotNull())
    counts = found.where(F.col(id_col) == F.col("component_id")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_col).alias("d")).first()
    return out if counts["n"] == counts["d"] else out.dropDuplicates([id_col])
