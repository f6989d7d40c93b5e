"""Word dedup on prefix-partitioned suffix trees.

The suffixes that start a window are dealt to groups by prefix, a word longer
wherever a group would not fit memory; each group is a subtree. Its suffixes in
order, with the words that neighbours share, are the tree's leaves and inner
nodes; nodes at least a window deep are the repeats, and the least leaf of
each is the occurrence that stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.bwt_dedup import finish, merged
from tidemark.llm.common import rows_of
from tidemark.llm.repeats import Kind, repeated_runs

LENGTH = 20
GRAM = 4
#: Suffixes of a subtree, unless they share a whole window.
SUBTREE = 1 << 16


def _hash_words(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def _read(text: str) -> tuple[np.ndarray, Callable[[int, int], bytes]]:
    words = text.encode("utf-8", "surrogatepass").split()
    return _hash_words(words), lambda a, b: b" ".join(words[a:b])


def prefix_groups(symbols: np.ndarray, at: np.ndarray, depth: int = 0, limit: int = SUBTREE) -> Iterator[np.ndarray]:
    """Split suffixes `at` by their next symbol until what shares a prefix fits `limit` or shares LENGTH symbols.

    Neighbouring prefixes that fit together make one group.
    """
    todo = [(at, depth)]
    while todo:
        group, deep = todo.pop()
        if len(group) <= limit or deep == LENGTH:
            yield group
            continue
        key = symbols[group + deep]
        order = np.argsort(key, kind="stable")
        held, size = [], 0
        for part in np.split(group[order], np.flatnonzero(np.diff(key[order])) + 1):
            if len(part) > limit:
                todo.append((part, deep + 1))
                continue
            if size + len(part) > limit:
                yield np.concatenate(held)
                held, size = [], 0
            held.append(part)
            size += len(part)
        if held:
            yield np.concatenate(held)


class Windows:
    """The LENGTH symbols from any place as a few numbers."""

    def __init__(self, symbols: np.ndarray) -> None:
        bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.wide = 63 // bits  # symbols that one number holds
        self.full, self.rest = (self._rolled(symbols, bits, n) for n in (self.wide, LENGTH % self.wide or self.wide))

    @staticmethod
    def _rolled(symbols: np.ndarray, bits: int, n: int) -> np.ndarray:
        out = np.zeros(len(symbols), np.int64)
        for k in range(n):
            out <<= bits
            out[: len(symbols) - k] |= symbols[k:]
        return out

    def keys(self, at: np.ndarray) -> list[np.ndarray]:
        places = range(0, LENGTH, self.wide)
        return [(self.full if k != places[-1] else self.rest)[at + k] for k in places]


def deep_nodes(windows: Windows, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaves in order, node of each): the inner nodes LENGTH deep of the subtree over suffixes `group`."""
    keys = windows.keys(group)
    order = np.lexsort(keys[::-1])
    shared = np.ones(max(0, len(group) - 1), bool)  # neighbours whose branching node is at least a window deep
    for key in keys:
        key = key[order]
        shared &= key[1:] == key[:-1]
    return group[order], np.concatenate(([0], np.cumsum(~shared)))


def repeated_later(held: list[tuple]) -> Iterator[tuple[int, int, int]]:
    """(context, first window, windows) runs that start earlier elsewhere, of contexts (g, a, c, n, id, i, weight, bytes, at)."""
    sizes = np.array([r[7].count(b" ") + 1 for r in held])
    joined = np.frombuffer(b" ".join([r[7] for r in held]) + b" ", np.uint8)
    ends = np.flatnonzero(joined == 32) + 1  # each word with the space after it
    words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate(([0], ends))), pa.py_buffer(joined)])
    symbols = words.dictionary_encode().indices.to_numpy().astype(np.int32)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    owner = np.repeat(np.arange(len(held)), sizes)
    local = np.arange(len(symbols)) - starts[owner]
    suffixes = np.flatnonzero(local < sizes[owner] - LENGTH + 1)
    doc = np.array([r[4] for r in held], np.int64)[owner]
    place = np.array([r[5] for r in held], np.int64)[owner] + local
    flag = np.zeros(len(symbols) + 1, bool)
    windows = Windows(symbols)
    for group in prefix_groups(symbols, suffixes):
        leaves, node = deep_nodes(windows, group)
        order = np.lexsort((place[leaves], doc[leaves], node))
        leaves, node = leaves[order], node[order]
        head = np.concatenate(([True], node[1:] != node[:-1]))
        first = leaves[np.maximum.accumulate(np.where(head, np.arange(len(node)), 0))]
        flag[leaves[(doc[leaves] != doc[first]) | (place[leaves] != place[first])]] = True
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flag)).astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        at = a
        while at < b:  # a run may cross from one context into the next
            k = int(owner[at])
            end = min(b, int(starts[k] + sizes[k]))
            yield k, at - int(starts[k]), end - at
            at = end


KIND = Kind(LENGTH, GRAM, 4, _read, lambda text: _slices(text.encode("utf-8", "surrogatepass")))


def _slices(data: bytes) -> Callable[[int, int], bytes]:
    words = data.split()
    return lambda a, b: b" ".join(words[a:b])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for d, t, runs in rows_of(b, 3):
            words = t.encode("utf-8", "surrogatepass").split()
            spans = merged(runs, LENGTH - 1)
            kept, at = [], 0
            for s, e in spans:
                kept += words[at:s]
                at = e
            kept += words[at:]
            rows.append((d, len(words), len(words) - len(kept), b" ".join(kept)))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            cols = list(zip(*rows, strict=True))
            cols[3] = [k.decode("utf-8", "replace") for k in cols[3]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept"])


def drop_repeated_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a LENGTH-word window that also starts earlier (less id, or less start in one document).

    Rows: doc_id (long), n_words, n_removed, kept (the other words joined by a space).
    Null text: no words. Null ids stay null and come before all others. Rows that
    repeat an id start nowhere earlier than each other at equal places.
    """
    runs = repeated_runs(df, KIND, id_col, text_col, repeated_later, _slices, lambda data: data.count(b" ") + 1, keep_first=True)
    return finish(df, runs, id_col, text_col, _remove, "doc_id long, n_words long, n_removed long, kept string")
