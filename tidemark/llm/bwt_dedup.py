"""Byte dedup on Burrows-Wheeler transforms.

The contexts that repeats.py gathers for a task are put end to end, with their
suffixes sorted as deep as the minimum length asks. Breadth-first backward
extension on the transform then visits the strings by length: the step that
reaches length n+1 finds the places between neighbours in the order whose common
prefix is n. It stops at the minimum length; places not found by then lie
between windows that are equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import rows_of, stored
from tidemark.llm.repeats import Kind, keyed, mix, repeated_runs

LENGTH = 400
GRAM = 32
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def _read(text: str) -> tuple[np.ndarray, Callable[[int, int], bytes]]:
    raw = text.encode("utf-8", "surrogatepass")
    return _BYTES[np.frombuffer(raw, np.uint8)], _slices(raw)


def _cut(text: str) -> Callable[[int, int], bytes]:
    return _slices(text.encode("utf-8", "surrogatepass"))


#: Places of a text up to this many bits are sorted within their keys, which is several times faster than an argsort.
PLACE = 21


def _order(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether each but the first differs from its forerunner) by two keys below 2**PLACE, or by argsort for longer texts."""
    n = len(high)
    if n < 1 << PLACE:
        key = np.sort(high << 2 * PLACE | low << PLACE | np.arange(n))
        return key & ((1 << PLACE) - 1), np.diff(key >> PLACE) != 0
    key = high << 31 | low
    order = np.argsort(key)
    return order, np.diff(key[order]) != 0


#: Symbols of nine bits that one word holds.
HEAD = 7


def heads(text: np.ndarray) -> np.ndarray:
    """The first HEAD symbols (0 to 257, each plus one; past the end: 0) of every suffix as one number."""
    key = np.zeros(len(text), np.int64)
    for k in range(HEAD):
        key <<= 9
        key[: max(0, len(text) - k)] |= text[k:] + 1
    return key


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first `depth` symbols, by doubling; ties in any order."""
    n = len(text)
    key = heads(text)
    order = np.argsort(key)
    fresh, have = np.diff(key[order]) != 0, HEAD
    while True:
        place = np.concatenate(([1], 1 + np.cumsum(fresh)))
        if have >= depth or place[-1] == n:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = place
        after = np.zeros(n, np.int64)
        after[: max(0, n - have)] = rank[have:]
        order, fresh = _order(rank, after)
        have *= 2


def short_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether suffix order[i] and its forerunner share less than `depth` symbols, for every i (the first: yes).

    Symbol 0 ends a text: no string is extended by it. The order itself tells the
    prefixes below HEAD symbols, so the search begins with all strings of HEAD.
    """
    n = len(text)
    last = text[order - 1]  # the transform; the text is taken as a ring
    back = np.argsort(last.astype(np.uint16), kind="stable")
    step = np.empty(n, np.int64)
    step[back] = np.arange(n)  # row of the suffix one symbol longer
    found = np.zeros(n + 1, bool)
    found[0] = found[n] = True
    lo = np.flatnonzero(np.concatenate(([True], np.diff(heads(text)[order]) != 0)))
    hi = np.append(lo[1:], n)
    found[lo] = True
    shift = max(PLACE, n.bit_length())
    for _ in range(HEAD, depth):
        width = hi - lo
        ends = np.cumsum(width)
        rows = np.repeat(lo - ends + width, width) + np.arange(ends[-1])
        symbol = last[rows]
        key = (np.repeat(np.arange(len(lo)) * 257, width) + symbol) << shift | rows
        key = key[symbol > 0]
        key.sort()
        if not len(key):
            break
        head = np.flatnonzero(np.concatenate(([True], np.diff(key >> shift) != 0)))
        lo = step[key[head] & ((1 << shift) - 1)]
        hi = lo + np.diff(np.append(head, len(key)))
        fresh = ~found[hi]
        lo, hi = lo[fresh], hi[fresh]
        found[hi] = True
        if not len(lo):
            break
    return found[:n]


def repeated_windows(held: list[tuple], length: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """(context, first window, windows) runs of windows that occur twice in contexts (g, a, c, n, id, i, weight, bytes, at)."""
    sizes = np.array([len(r[7]) for r in held])
    text = np.zeros(int(sizes.sum()) + len(held), np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    body = np.frombuffer(b"\0".join(r[7] for r in held) + b"\0", np.uint8).astype(np.int64) + 1
    text[:] = body
    text[starts + sizes] = 0
    order = suffix_order(text, length)
    cut = short_prefixes(text, order, length)
    owner = np.repeat(np.arange(len(held)), sizes + 1)
    valid = (np.arange(len(text)) - starts[owner]) < (sizes[owner] - length + 1)
    rows = order[valid[order]]
    # cuts between valid rows: any cut since the last valid row
    run = np.cumsum(cut)[valid[order]]
    _, of = np.unique(run, return_inverse=True)
    weight = np.array([r[6] for r in held])
    twice = np.bincount(of, weight[owner[rows]])[of] >= 2
    flag = np.zeros(len(text) + 1, bool)
    flag[rows[twice]] = True
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flag)).astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        k = int(owner[a])
        yield k, a - int(starts[k]), b - a


KIND = Kind(LENGTH, GRAM, 32, _read, _cut)


def _slices(data: bytes) -> Callable[[int, int], bytes]:
    return lambda a, b: data[a:b]


def merged(runs: list[dict] | None, extra: int) -> list[tuple[int, int]]:
    """Units [s, e) covered by runs of windows, each `extra` units longer than its last start, merged where they touch."""
    out: list[list[int]] = []
    for s, e in sorted((r["s"], r["e"] + extra) for r in runs or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for d, t, runs in rows_of(b, 3):
            raw = t.encode("utf-8", "surrogatepass")
            spans = merged(runs, LENGTH - 1)
            kept, at = [], 0
            for s, e in spans:
                kept.append(raw[at:s])
                at = e
            kept.append(raw[at:])
            rows.append((d, len(raw), sum(e - s for s, e in spans), [{"start": s, "end": e} for s, e in spans], b"".join(kept)))
        if rows:
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), span, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def drop_repeated_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte covered by a LENGTH-byte string that also starts anywhere else.

    Rows: doc_id (long), n_bytes, n_removed, spans (removed [start, end) runs, as far
    as they go), kept (the other bytes, which need not be UTF-8 where a run begins
    inside a character). Null text: empty. Null ids stay null. Rows that repeat an id
    and its text are occurrences of their own, so all of them lose their windows.
    """
    runs = repeated_runs(df, KIND, id_col, text_col, repeated_windows, _slices, len, keep_first=False)
    return finish(df, runs, id_col, text_col, _remove, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary")


def finish(df: DataFrame, runs: DataFrame, id_col: str, text_col: str, remove, schema: str) -> DataFrame:
    """Join each text to its runs and hand (id, text, runs) to `remove`."""
    runs = stored(runs)
    docs = keyed(df, id_col, text_col)
    return docs.join(runs, ["id", "h"], "left").select("doc_id", "t", "runs").mapInArrow(remove, schema)

