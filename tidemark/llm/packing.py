"""Lexical retrieval packing: a BM25 index per shard feeds each window with its seed's neighbours.

Documents are encoded once. A min-hash over runs of token ids deals them to
shards, so that documents that share much meet at any size of the input. Every
term of a seed counts in its scores; equal documents are one entry of the index.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import clean_text, small_batches, small_or_shuffled, stored
from tidemark.llm.repeats import gram_hashes, mix
from tidemark.llm.tokens import default_path, encoded, encoder

WINDOW = 1024
#: Ids and documents that one shard's index is made of, on average: about 12 MB of text.
SHARD_IDS, SHARD_DOCS = 4_000_000, 4096
#: More shards than this share partitions, one after the other.
MAX_PARTITIONS = 20_000
K1, B = 1.2, 0.75
#: Terms in more than this part of a shard's documents are scored for all seeds by one matrix product, up to so many documents; it only bears on speed.
DENSE, SQUARE = 0.1, 6000
#: Ids of a run whose hash can deal a document, and bits of that key.
RUN = 4
KEY_BITS = 62
#: Neighbours that are sorted first.
FIRST = 16


class Index:
    """BM25 inverted index over token ids; scores are of a seed's every different id, each counted once."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        n = self.n = len(lengths)
        key = ids.astype(np.int64) * max(1, n) + np.repeat(np.arange(n), lengths)
        key.sort()
        at = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        tf = np.diff(np.append(at, len(key)))
        term, doc = np.divmod(key[at], max(1, n))
        df = np.bincount(term)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(1.0, float(lengths.mean()))) if n else np.zeros(0)
        weight = idf[term] * (tf * (K1 + 1) / (tf + norm[doc]))
        wide = df > max(2, DENSE * n) if n <= SQUARE else np.zeros(len(df), bool)
        mine = wide[term]
        row = np.cumsum(wide) - 1
        dense = np.zeros((int(wide.sum()), n), np.float32)
        dense[row[term[mine]], doc[mine]] = weight[mine]
        self.square = (dense > 0).astype(np.float32).T @ dense
        # postings of the other terms, and each document's terms that others share
        self.doc, self.weight = doc[~mine], weight[~mine]
        self.start = np.concatenate(([0], np.cumsum(np.where(wide, 0, df))))
        ask = ~mine & (df[term] > 1)
        by = np.argsort(doc[ask], kind="stable")
        self.asks, self.asks_at = term[ask][by], np.searchsorted(doc[ask][by], np.arange(n + 1))

    def scores(self, seed: int) -> np.ndarray:
        out = self.square[seed].astype(np.float64)
        terms = self.asks[self.asks_at[seed] : self.asks_at[seed + 1]]
        if len(terms):
            spans = [slice(a, b) for a, b in zip(self.start[terms].tolist(), self.start[terms + 1].tolist(), strict=True)]
            out += np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        return out

    def neighbours(self, seed: int, free: np.ndarray) -> Iterator[int]:
        """Free documents that share a term with the seed, best score first, ties by place; FIRST are sorted before the rest is."""
        score = self.scores(seed)
        score[~free] = 0
        left = np.flatnonzero(score)
        if len(left) > FIRST:
            least = np.partition(score[left], len(left) - FIRST)[len(left) - FIRST]
            top = left[score[left] >= least]
            yield from top[np.argsort(-score[top], kind="stable")].tolist()
            left = left[score[left] < least]
        yield from left[np.argsort(-score[left], kind="stable")].tolist()


class Copies:
    """An index over different documents that answers with all documents: a seed's copies first, then each neighbour's."""

    def __init__(self, raws: list[bytes], width: int = 4) -> None:
        number: dict[bytes, int] = {}
        self.of = [number.setdefault(r, len(number)) for r in raws]
        self.members: list[list[int]] = [[] for _ in number]
        for d, e in enumerate(self.of):
            self.members[e].append(d)
        self.left = np.array([len(m) for m in self.members])
        self.next = [0] * len(number)
        lengths = np.array([len(r) // width for r in number], np.int64)
        self.index = Index(np.frombuffer(b"".join(number), f"<u{width}"), lengths)

    def _unused(self, entry: int, used: np.ndarray) -> Iterator[int]:
        mine = self.members[entry]
        while self.next[entry] < len(mine):
            d = mine[self.next[entry]]
            self.next[entry] += 1
            if not used[d]:
                yield d
        self.left[entry] = 0

    def neighbours(self, seed: int, used: np.ndarray) -> Iterator[int]:
        mine = self.of[seed]
        yield from self._unused(mine, used)
        for e in self.index.neighbours(mine, self.left > 0):
            yield from self._unused(e, used)


def pack(lengths: list[int], neighbours, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset): windows filled greedily, cut documents going on in the next.

    neighbours(seed, used) ranks unused documents. A window's seed is the document
    cut at the last window's end, or else the first unused one.
    """
    used = np.zeros(len(lengths), bool)
    nxt, cut, sequence = 0, None, 0
    n = len(lengths)
    while True:
        if cut is None:
            while nxt < n and used[nxt]:
                nxt += 1
            if nxt == n:
                return
            cut = (nxt, 0)
            used[nxt] = True
        seed, start = cut
        cut, offset = None, 0
        queue: Iterator[int] = iter(())
        asked = False
        doc = seed
        while True:
            take = min(lengths[doc] - start, window - offset)
            yield doc, start, take, sequence, offset
            offset += take
            if start + take < lengths[doc]:
                cut = (doc, start + take)
                break
            if offset == window:
                break
            if not asked:
                queue, asked = iter(neighbours(seed, used)), True
            doc = next((d for d in queue if not used[d]), -1)
            if doc < 0:
                while nxt < n and used[nxt]:
                    nxt += 1
                if nxt == n:
                    break
                doc = nxt
            used[doc], start = True, 0
        sequence += 1


def _keys(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Least hash of RUN successive ids of each document (of all its ids, if fewer), of KEY_BITS bits."""
    ends = np.cumsum(counts)
    units = mix(ids.astype(np.uint64) + np.uint64(1))
    runs = np.full(len(ids), np.iinfo(np.uint64).max, np.uint64)
    if len(ids) >= RUN:
        runs[: len(ids) - RUN + 1] = gram_hashes(units, RUN)
    over = ends[:, None] - np.arange(1, RUN)  # places whose run leaves the document
    runs[np.maximum(over, 0).ravel()] = np.iinfo(np.uint64).max
    least = np.minimum.reduceat(runs, ends - counts)
    short = counts < RUN
    least[short] = mix(units[(ends - counts)[short]] + counts[short].astype(np.uint64))
    return (mix(least) >> np.uint64(64 - KEY_BITS)).astype(np.int64)  # a least hash is small: mixed, keys are even again


def _encode_keyed(path: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (names,), ids, counts in encoded(encoder(path), batches, 1, [0]):
            offsets = np.concatenate(([0], np.cumsum(counts) * width)).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(f"<u{width}"))])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), raw, pa.array(counts, pa.int64()), pa.array(_keys(ids, counts))], ["__id", "__ids", "__n", "__k"])

    return run


def _pack_shards(window: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, docs, raws = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            lengths = [len(r) // width for r in raws]
            out: list[tuple] = []
            for d, start, n, seq, off in pack(lengths, Copies(raws, width).neighbours, window):
                ids = np.frombuffer(raws[d], f"<u{width}", n, width * start).astype("<u4").tobytes()
                out.append((docs[d], start, n, ids, lengths[d], (now << 32) + seq, off))
                if len(out) == 4096:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            for shard, d, raw in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if shard != now:
                    if docs:
                        yield from flush()
                    now, docs, raws = shard, [], []
                docs.append(d)
                raws.append(raw)
        if docs:
            yield from flush()

    return run


def retrieval_packing(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_ids: int = SHARD_IDS, shard_docs: int = SHARD_DOCS, tokenizer: str | None = None) -> DataFrame:
    """Pack every document into sequences of `window` ids next to lexical neighbours.

    Rows: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id (shard times 2**32 plus its number there) and offset. Documents
    go to shards of about `shard_ids` ids or `shard_docs` documents by their key,
    the least hash of RUN successive ids; a key that fills more than a shard alone
    (copies, empty texts) is dealt to shards of its own by id and ids. A shard fits
    a task's memory but for one document larger than all of it. Only a shard's last
    sequence may fall short of `window`. A null text is the end id alone; a null id
    stays null; repeated rows are documents of their own; ties of a score go by id,
    then ids. An empty table gives no rows; other columns are not read.
    """
    plain = small_batches(df).select(F.col(id_col).cast("long").alias("__id"), clean_text(text_col).alias("__t"))
    path = tokenizer or default_path()
    width = 2 if encoder(path).whole.get_vocab_size() <= 1 << 16 else 4  # bytes of an id until the result
    rows = stored(plain.mapInArrow(_encode_keyed(path, width), "__id long, __ids binary, __n long, __k long"), "zstd")
    weight = F.sum(F.greatest(F.col("__n") / shard_ids, F.lit(1.0) / shard_docs))  # in shards
    keys = rows.groupBy("__k").agg(weight.alias("w"))
    hot = stored(keys.where("w > 1").select("__k", F.ceil("w").alias("__parts")))
    total = rows.agg(weight.alias("w")).first()["w"] or 0
    shards = max(1, min(1 << 30, int(-(-total // 1))))
    parts = min(shards, MAX_PARTITIONS)
    cool = F.shiftright(F.shiftright("__k", KEY_BITS - 31) * shards, 31)
    split = F.pmod(F.xxhash64("__id", "__ids", F.spark_partition_id()), F.col("__parts"))
    shard = F.when(F.col("__parts").isNull(), cool).otherwise(shards + F.pmod(F.xxhash64("__k", split), F.lit(1 << 30)))
    marked = rows.join(small_or_shuffled(hot, 16), "__k", "left").select(shard.alias("__s"), "__id", "__ids")
    dealt = marked.repartition(parts, "__s").sortWithinPartitions("__s", "__id", "__ids")
    return dealt.mapInArrow(_pack_shards(window, width), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
