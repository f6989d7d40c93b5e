"""Simple-8b: ids in word-aligned 64-bit words, and the file format of token output.

A word's top four bits select how many ids its other 60 bits hold, and their
width. Selector 0 is the escape: the next word is one id raw, for ids of more
than 60 bits. Every block of BLOCK ids starts a word, and a chunk lists its
blocks' first words, so that blocks decode alone and, by selector, all at once.

Chunk: "S8B1", u32 block size, u64 documents, ids, blocks and words, then i64
document ids (the least i64: null), u64 ids of each document, u64 first word of
each block, u64 words; all little-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import clean_text, rows_of, small_batches, stored
from tidemark.llm.tokens import default_path, encoded, encoder

#: Fixed values: (ids, bits) of selectors 1 to 15.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60), (120, 0)]
COUNTS = np.array([1] + [n for n, _ in SELECTORS])
WIDTHS = np.array([0] + [b for _, b in SELECTORS])
BLOCK = 4096
MAGIC = b"S8B1"
NULL_ID = -(1 << 63)
CHUNK_IDS = 1 << 19


def _window_max(x: np.ndarray, n: int) -> np.ndarray:
    """Maximum of each n successive values; past the end the last values stand."""
    out, done = x, 1
    while done < n:
        step = min(done, n - done)
        out = np.maximum(out, np.concatenate((out[step:], np.zeros(min(step, len(out)), out.dtype))))
        done += step
    return out


_COUNTS = COUNTS.astype(np.uint8)
#: Ids from each place to its block's end, as far as a word can reach.
_ROOM = np.minimum(np.arange(BLOCK, 0, -1), 255).astype(np.uint8)


def _word_starts(step: np.ndarray) -> np.ndarray:
    """Places that words start at, going by `step` through all blocks side by side."""
    n = len(step)
    at = np.arange(0, n, BLOCK)
    ends = np.minimum(at + BLOCK, n)
    found = []
    while len(at):
        found.append(at)
        at = at + step[at]
        more = at < ends
        if not more.all():
            at, ends = at[more], ends[more]
    return np.sort(np.concatenate(found))


_LENGTHS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _bit_length(ids: np.ndarray) -> np.ndarray:
    """Bits of each id; 61 for those of more than 60."""
    top = int(ids.max())
    if top < 1 << 16:
        return _LENGTHS[ids]
    if top < 1 << 52:
        return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    ids = ids.astype(np.uint64)
    high = np.frexp((ids >> np.uint64(32)).astype(np.float64))[1]
    low = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.minimum(np.where(high > 0, high + 32, low), 61).astype(np.uint8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of unsigned ids."""
    ids = np.asarray(ids)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    wide = _bit_length(ids)
    best = np.zeros(n, np.uint8)  # selector; 0: escape
    run, length = wide, 1
    for s in sorted(range(1, 16), key=lambda s: COUNTS[s]):
        run, length = _window_max(run, int(COUNTS[s]) - length + 1), int(COUNTS[s])
        fits = run <= WIDTHS[s]
        if not fits.any():  # longer runs have fewer bits
            break
        best[fits] = s  # past the block's end the word is padded
    step = np.minimum(_COUNTS[best], np.tile(_ROOM, -(-n // BLOCK))[:n])
    for i in range(max(0, n - int(_COUNTS.max())), n):  # the last block may be short
        step[i] = min(int(step[i]), n - i)
    at = _word_starts(step)
    sel, held = best[at], step[at]
    place = np.cumsum(1 + (sel == 0)) - 1  # of a word; an escape's raw id stands on it
    words = np.zeros(int(place[-1]) + 1, np.uint64)
    padded = np.concatenate((ids.astype(np.uint64), np.zeros(128, np.uint64)))
    for s in np.flatnonzero(np.bincount(sel, minlength=16)).tolist():
        mine = np.flatnonzero(sel == s)
        here, to = at[mine], place[mine]
        if s == 0:
            words[to] = ids[here]
            continue
        packed = np.full(len(mine), s << 60, np.uint64)
        size = held[mine]
        short = bool((size < COUNTS[s]).any())
        for k in range(COUNTS[s] if WIDTHS[s] else 0):
            part = padded[here + k]
            if short:
                part[size <= k] = 0
            packed |= part << np.uint64(k * WIDTHS[s])
        words[to] = packed
    first = place[np.searchsorted(at, np.arange(0, n, BLOCK))]
    return words, (first - (sel[np.searchsorted(at, np.arange(0, n, BLOCK))] == 0)).astype(np.uint64)


def decode(words: np.ndarray, blocks: np.ndarray, n: int) -> np.ndarray:
    """The n ids; blocks: each one's first word."""
    if not n:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(sel == 0).tolist():
        if not raw[i]:
            raw[i + 1] = True
    mark = (sel == 0) & ~raw
    count = np.where(raw, 1, np.where(mark, 0, COUNTS[sel]))
    ends = np.append(blocks[1:], len(words)).astype(np.int64)
    before = np.cumsum(count) - count
    # ids before a word: whole blocks, then the words since its block's first
    block = np.searchsorted(ends, np.arange(len(words)), side="right")
    at = block * BLOCK + before - before[blocks.astype(np.int64)][block]
    out = np.zeros((len(blocks) + 1) * BLOCK + 256, np.uint64)
    out[at[raw]] = words[raw]
    whole = at + count <= (block + 1) * BLOCK  # the others end with padding
    sel[raw] = 0
    for s in range(1, 16):
        mine = np.flatnonzero(sel == s)
        if not len(mine) or not WIDTHS[s]:
            continue
        here, to, full = words[mine], at[mine], whole[mine]
        mask, last = np.uint64((1 << int(WIDTHS[s])) - 1), (block[mine] + 1) * BLOCK
        cut = None if full.all() else np.flatnonzero(~full)
        for k in range(COUNTS[s]):
            value = here >> np.uint64(k * WIDTHS[s]) & mask
            if cut is None:
                out[to + k] = value
            else:
                real = full | (to + k < last)
                out[(to + k)[real]] = value[real]
    return out[:n]


def write_chunk(doc_ids: list[int | None], counts: list[int] | np.ndarray, ids: np.ndarray) -> bytes:
    words, blocks = encode(ids)
    head = MAGIC + struct.pack("<I4Q", BLOCK, len(doc_ids), len(ids), len(blocks), len(words))
    docs = np.array([NULL_ID if d is None else d for d in doc_ids], "<i8")
    return head + docs.tobytes() + np.array(counts, "<u8").tobytes() + blocks.astype("<u8").tobytes() + words.astype("<u8").tobytes()


def read_chunk(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, ids of each, all ids)."""
    if data[:4] != MAGIC:
        raise ValueError("not a Simple-8b chunk")
    size, n_docs, n_ids, n_blocks, n_words = struct.unpack_from("<I4Q", data, 4)
    if size != BLOCK:
        raise ValueError(f"blocks of {size} ids")
    at = 40
    docs = np.frombuffer(data, "<i8", n_docs, at)
    counts = np.frombuffer(data, "<u8", n_docs, at + 8 * n_docs)
    at += 16 * n_docs
    blocks = np.frombuffer(data, "<u8", n_blocks, at)
    words = np.frombuffer(data, "<u8", n_words, at + 8 * n_blocks)
    return [None if d == NULL_ID else d for d in docs.tolist()], counts.astype(np.int64), decode(words, blocks, n_ids)


def _encode_part(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, chunk, before = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        parts: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            ids, each = np.concatenate(parts), np.concatenate(counts)
            data = write_chunk(docs, each, ids)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "chunk": pa.array([chunk], pa.int64()), "before": pa.array([before], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "data": pa.array([data], pa.binary())})

        for (names,), ids, each in encoded(encoder(path), batches, 1, [0]):
            docs += names
            parts.append(ids)
            counts.append(each)
            held += len(ids)
            if held >= CHUNK_IDS:
                yield flush()
                chunk, before, docs, parts, counts, held = chunk + 1, before + held, [], [], [], 0
        if docs:
            yield flush()

    return run


def write_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Tokenise whole texts and write them in ascending id order as Simple-8b chunks.

    One exchange by id range carries the texts; ties of the id are ordered by the
    text's hash, and rows equal in both can be split by the input partition they
    come from, which is the same if a task runs again. Each task streams its range
    into chunks of CHUNK_IDS ids or more, up to a batch of rows beyond, held one at a time. The chunks are rows of a Parquet dataset in the shared folder, so that
    Spark's commit keeps exactly one copy of each task's; the returned DataFrame
    reads it: part (ascending with the ids), chunk, before (ids of the part before
    it), n_ids, data. Ids are 64-bit integers; null ids come first; a null text is
    empty and has the end id alone. Repeated rows are written each. An empty table
    gives no chunks. Other columns are not read, whatever their names.
    """
    rows = small_batches(df).select(F.col(id_col).cast("long").alias("__id"), clean_text(text_col).alias("__t"), F.xxhash64(text_col).alias("__h"), F.spark_partition_id().alias("__p"))
    order = ["__id", "__h", "__p"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("__id", "__t")
    chunks = dealt.mapInArrow(_encode_part(tokenizer or default_path()), "part int, chunk long, before long, n_ids long, data binary")
    return stored(chunks, "zstd")


def _decode_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from zlib import crc32

    for b in batches:
        for part, before, data in rows_of(b, 3, 1):
            docs, counts, ids = read_chunk(data)
            raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(counts)
            sums = [crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(before + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], ["part", "doc_id", "before", "n_tokens", "ids_crc32"])


def read_tokens(chunks: DataFrame) -> DataFrame:
    """Per document of the written chunks: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Only one total per part, of which there are as many as shuffle partitions, reaches the driver.
    """
    totals = sorted((r["part"], r["n"]) for r in chunks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base, at = [], 0
    for part, n in totals:
        while len(base) < part:
            base.append(at)
        base.append(at)
        at += n
    starts = F.split(F.lit(",".join(map(str, base or [0]))), ",").cast("array<bigint>")
    read = chunks.select("part", "before", "data").mapInArrow(_decode_part, "part int, doc_id long, before long, n_tokens long, ids_crc32 long")
    return read.select("doc_id", (F.element_at(starts, F.col("part") + 1) + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
