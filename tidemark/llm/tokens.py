"""Token ids of whole texts by a tokenizers file, a few megabytes of texts at a time.

A byte-level BPE first splits a text into pieces by a fixed pattern, then each
piece alone. The split is done here on the bytes of many texts at once, Arrow
finds the different pieces, and the library's model encodes those that no cache
holds. Stretches with characters whose class is not certain, and apostrophes,
go to the library whole, from one white space to the next. Added tokens of the
file, such as an end mark written out in a text, are one id, as the library has it.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 0
#: Pieces whose ids are kept; beyond, the half that was met last stays.
PIECES = 300_000
#: Bytes of text whose pieces are found at once.
WINDOW_BYTES = 8 << 20

HARD, LETTER, NUMBER, OTHER, SPACE, BLANK = range(6)


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's stand-in for each byte: itself where it prints, else the next code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@functools.cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte that is a character, and of each code point below U+0250; what is not certain is HARD."""
    import regex

    letter, number, blank = (regex.compile(p).fullmatch for p in (r"\p{L}", r"\p{N}", r"\s"))
    of = np.zeros(0x800, np.uint8)
    for c in [*range(0x21, 0x7F), *range(0xA1, 0x250)]:
        x = chr(c)
        of[c] = HARD if x == "'" or blank(x) else LETTER if letter(x) else NUMBER if number(x) else OTHER
    of[0x20] = SPACE
    of[[0x09, 0x0A, 0x0D]] = BLANK
    byte = np.zeros(256, np.uint8)
    byte[:0x80] = of[:0x80]
    return byte, of


def split_pieces(raw: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pieces of UTF-8 bytes; first: starts of the texts, ascending, none empty."""
    byte, two_bytes = _classes()
    n = len(raw)
    kind = byte[raw]
    two = np.flatnonzero((raw >= 0xC2) & (raw <= 0xC9))
    if len(two):
        kind[two] = kind[two + 1] = two_bytes[(raw[two].astype(np.int64) & 0x1F) << 6 | raw[two + 1] & 0x3F]
    white = kind >= SPACE
    last = np.zeros(n, bool)  # white, and a text's next character is not
    np.logical_and(white[:-1], ~white[1:], out=last[:-1])
    last[first[1:] - 1] = False
    start = np.empty(n, bool)
    start[0] = True
    before, here = kind[:-1], white[1:]
    start[1:] = (here & (~white[:-1] | last[1:])) | (~here & (before != kind[1:]) & (before != SPACE))
    start[first] = True
    hard = np.flatnonzero(kind == HARD)
    if len(hard):
        free = np.zeros(n, bool)  # starts of stretches that can be encoded alone
        free[1:] = here & (before < SPACE) & (before != HARD)
        free[first] = True
        chunks = np.flatnonzero(free)
        bad = np.unique(np.searchsorted(chunks, hard, side="right") - 1)
        inside = np.zeros(n + 1, np.int8)
        inside[chunks[bad]] += 1
        inside[np.append(chunks, n)[bad + 1]] -= 1
        start &= np.cumsum(inside[:-1], dtype=np.int8) == 0
        start[chunks[bad]] = True
    return np.flatnonzero(start)


class Encoder:
    """Token ids without the end id, of one text or of an Arrow array of texts."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        told = json.loads(Path(path).read_text())
        kind = told.get("pre_tokenizer") or {}
        added = self.whole.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        self.added_re = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        plain = all(t.content and not (t.lstrip or t.rstrip or t.single_word) for t in added.values())
        self.split = plain and told.get("normalizer") is None and kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True)
        self.model, self.alphabet = self.whole.model, _byte_alphabet()
        #: Texts without a HARD character.
        self.plain = regex.compile(r"[\t\n\r\x20-&\x28-\x7e\xa1-\u024f]*").fullmatch
        # known pieces, where their ids are in `flat`, how many, and the window that met them last
        self.known, self.at, self.size, self.met = pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.windows = np.zeros(0, "<u4"), 0

    def _piece(self, piece: bytes) -> list[int]:
        """Ids of a piece by the library."""
        if piece[1:].isalpha() and (piece[0] == 32 or piece[:1].isalpha()):
            return [t.id for t in self.model.tokenize(self.alphabet[piece[0]] + piece[1:].decode())]
        if self.plain(piece.decode()):
            return [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.alphabet))]
        return self.whole.encode(piece.decode(), add_special_tokens=False).ids

    def _forget(self) -> None:
        """Keep the half of the pieces that was met last."""
        stay = np.sort(np.argsort(-self.met, kind="stable")[: PIECES // 2])
        size = self.size[stay]
        ends = np.cumsum(size)
        self.flat = self.flat[np.repeat(self.at[stay] - ends + size, size) + np.arange(size.sum())]
        self.known, self.at, self.size, self.met = self.known.take(pa.array(stay)), ends - size, size, self.met[stay]

    def _window(self, raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts of pieces, ids before each piece and in all)."""
        starts = split_pieces(raw, first)
        offsets = np.append(starts, len(raw)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        if len(self.known) > PIECES:
            self._forget()
        place = pc.index_in(pieces.dictionary, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            names = pieces.dictionary.take(pa.array(fresh))
            found = list(map(self._piece, names.to_pylist()))
            size = np.fromiter(map(len, found), np.int64, len(found))
            place[fresh] = len(self.known) + np.arange(len(fresh))
            self.at = np.concatenate((self.at, len(self.flat) + np.cumsum(size) - size))
            self.flat = np.concatenate((self.flat, np.fromiter(itertools.chain.from_iterable(found), "<u4", int(size.sum()))))
            self.size = np.concatenate((self.size, size))
            self.met = np.concatenate((self.met, np.zeros(len(fresh), np.int64)))
            self.known = pa.concat_arrays([self.known, names])
        self.windows += 1
        self.met[place] = self.windows
        of = place[pieces.indices.to_numpy()]
        n = self.size[of]
        before = np.concatenate(([0], np.cumsum(n)))
        take = np.repeat(self.at[of] - before[:-1], n)
        take += np.arange(len(take))
        return self.flat[take], starts, before

    def _cuts(self, raw: np.ndarray) -> list[int]:
        """Places, about WINDOW_BYTES apart, where a long text can be cut: a space after an ASCII letter."""
        out, at = [0], WINDOW_BYTES
        while at < len(raw):
            near = raw[at - 1 : at + (1 << 16)]
            fit = np.flatnonzero((near[1:] == 32) & ((near[:-1] | 32) >= 97) & ((near[:-1] | 32) <= 122))
            if len(fit):
                at += int(fit[0])
                out.append(at)
                at += WINDOW_BYTES
            else:
                at += 1 << 16
        return out

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as unsigned 32-bit integers, ids of each); a null text has none."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        if not self.split:
            each = [np.array(x.ids, "<u4") for x in self.whole.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.concatenate(each), np.array([len(x) for x in each])
        texts = texts.fill_null("") if texts.null_count else texts
        if any(pc.any(pc.match_substring(texts, name)).as_py() for name in self.added):
            return self._with_added(texts)
        return self._without_added(texts)

    def _with_added(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts are cut at added tokens, what lies between is encoded, and their ids are put back."""
        between, owner, ids = [], [], []  # stretches, the text of each, and the added id after it or -1
        for k, text in enumerate(texts.to_pylist()):
            at = 0
            for found in self.added_re.finditer(text):
                between.append(text[at : found.start()])
                ids.append(self.added[found.group()])
                at = found.end()
            between.append(text[at:])
            ids.append(-1)
            owner += [k] * (len(between) - len(owner))
        flat, size = self._without_added(pa.array(between, pa.large_string()))
        put = np.array(ids)
        follows = put >= 0
        counts = np.zeros(len(texts), np.int64)
        np.add.at(counts, owner, size + follows)
        return np.insert(flat, np.cumsum(size)[follows], put[follows].astype("<u4")), counts

    def _without_added(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        bounds, owner = [], []
        for k in range(len(texts)):
            a, b = int(off[k]), int(off[k + 1])
            for cut in self._cuts(raw[a:b]) if b - a > WINDOW_BYTES else (0,):
                bounds.append(a + cut)
                owner.append(k)
        bounds.append(int(off[-1]))
        at, ids, counts = 0, [], np.zeros(len(texts), np.int64)
        edge = np.array(bounds)
        while at < len(owner):
            end = max(at + 1, int(np.searchsorted(edge, edge[at] + WINDOW_BYTES, side="right")) - 1)
            end = min(end, len(owner))
            lo, hi = int(edge[at]), int(edge[end])
            if hi > lo:
                mine = edge[at : end + 1] - lo
                got, starts, before = self._window(raw[lo:hi], np.unique(mine[:-1][mine[:-1] < mine[1:]]))
                ids.append(got)
                np.add.at(counts, owner[at:end], np.diff(before[np.searchsorted(starts, mine)]))
            at = end
        return (np.concatenate(ids) if ids else np.zeros(0, "<u4")), counts

    def encode(self, text: str) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit integers."""
        return self.encode_array(pa.array([text], pa.string()))[0].tobytes()


def encoded(enc: Encoder, batches: Iterable[pa.RecordBatch], text: int, others: list[int], step_bytes: int = WINDOW_BYTES) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(values of the other columns, ids with the end id after each text, ids of each) of some rows at a time, in order."""
    for b in batches:
        texts = b.column(text)
        wide = pa.types.is_large_string(texts.type)
        off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(off, int(off[at]) + step_bytes, side="right")) - 1)
            end = min(end, len(texts))
            ids, counts = enc.encode_array(texts.slice(at, end - at))
            out = np.full(len(ids) + len(counts), END_ID, "<u4")
            ends = np.cumsum(counts + 1)
            body = np.ones(len(out), bool)
            body[ends - 1] = False
            out[body] = ids
            yield [b.column(c).slice(at, end - at).to_pylist() for c in others], out, counts + 1
            at = end


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker and file, so that its caches outlive a task."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
