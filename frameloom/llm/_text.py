"""Byte-level text kernels in numpy: words, word hashes and n-gram hashes for a whole Arrow batch at once.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. Texts are processed whole; a batch is cut into
runs of whole texts of about ``SLICE_BYTES`` so that memory stays bounded by that figure and the longest text.
"""

from __future__ import annotations

import ctypes
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
_U = np.uint64


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=_U) + _U(seed)) * _U(0x9E3779B97F4A7C15))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x = x * _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
WORD_BYTE = ~_BLANK
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x5851F42D4C957F2D
#: Spans are hashed so many at a time, which bounds the arrays beside a text.
BLOCK_SPANS = 1 << 16
#: Spans of up to so many chunks of 8 bytes are hashed together, longer ones each for itself.
TOGETHER = 64
_CHUNK_KEYS = _splitmix(TOGETHER, 7)
_SIZE_KEY = _U(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def release() -> None:
    """Give back what a task's buffers held; workers are used again by later tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    if not (wide or pa.types.is_string(column.type)):
        column, wide = column.cast(pa.large_string()), True
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    off = off.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges of rows, each of about ``limit`` bytes, or of one longer text."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


class Words:
    """The words of a run of texts. ``starts``/``ends``: byte spans; ``first``: index of each text's first word, and the total."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, word_byte: np.ndarray = WORD_BYTE):
        self.raw, self.off = raw, off
        n = len(raw)
        solid = word_byte[raw]
        before = np.zeros(n, bool)
        before[1:] = solid[:-1]
        before[off[:-1][off[:-1] < n]] = False
        self.starts = np.flatnonzero(solid & ~before)
        after = np.zeros(n, bool)
        after[:-1] = solid[1:]
        after[off[1:][off[1:] > 0] - 1] = False
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.starts, off)
        self.counts = np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, fold: bool = False) -> np.ndarray:
        return span_hashes(self.raw, self.starts, self.ends, fold)


def _chunks(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of raw on as a number; beyond the end there are zeros."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded.data, 0, (1,))


def _long_hash(span: np.ndarray) -> int:
    """The sum of mixed chunks of a span longer than TOGETHER chunks, a piece at a time."""
    total = 0
    for at in range(0, len(span), 1 << 16):
        piece = span[at : at + (1 << 16)]
        padded = np.zeros(-(-len(piece) // 8) * 8, np.uint8)
        padded[: len(piece)] = piece
        total += int(mix64(padded.view("<u8") ^ _splitmix(len(padded) // 8, 7 + at // 8)).sum(dtype=_U))
    return total % (1 << 64)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans, which must rise and not overlap; with ``fold``, A-Z count as a-z.

    A span of up to 7 bytes is mixed together with its size, a bijection: such spans never share a hash. A longer one is cut
    in chunks of 8 bytes, each is mixed with a key of its place, and their sum is mixed with the size, so no pattern of
    the bytes gives equal hashes (as Thue-Morse words do under a polynomial modulo 2^64)."""
    out = np.empty(len(starts), _U)
    for i in range(0, len(starts), BLOCK_SPANS):
        j = min(i + BLOCK_SPANS, len(starts))
        base = int(starts[i])
        part = raw[base : int(ends[j - 1])]
        if fold:
            part = LOWER[part]
        s, size = starts[i:j] - base, ends[i:j] - starts[i:j]
        chunks = _chunks(part)
        h = out[i:j]
        h[:] = mix64((chunks[s] & _MASKS[np.minimum(size, 7)]) | (size.astype(_U) << _U(56)))
        more = np.flatnonzero(size > 7)
        if not len(more):
            continue
        at, left = s[more], size[more]
        total, open_ = np.zeros(len(more), _U), np.arange(len(more))
        with np.errstate(over="ignore"):
            for k in range(TOGETHER):
                total[open_] += mix64((chunks[at] & _MASKS[np.minimum(left, 8)]) ^ _CHUNK_KEYS[k])
                on = left > 8
                open_, at, left = open_[on], at[on] + 8, left[on] - 8
                if not len(open_):
                    break
            for k in open_.tolist():
                x = more[k]
                total[k] = _long_hash(part[s[x] : s[x] + size[x]])
            h[more] = mix64(total ^ (size[more].astype(_U) * _SIZE_KEY))
    return out


def same_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, sizes: np.ndarray, fold: bool = False) -> np.ndarray:
    """Whether the spans of two buffers hold the same bytes; ``fold`` folds those of a."""
    out = np.ones(len(sizes), bool)
    if fold:
        a = LOWER[a]
    x, y = _chunks(a), _chunks(b)
    open_ = np.flatnonzero(sizes > 0)
    for k in range(0, 8 * TOGETHER, 8):
        if not len(open_):
            return out
        mask = _MASKS[np.minimum(sizes[open_] - k, 8)]
        out[open_] = ((x[a_starts[open_] + k] ^ y[b_starts[open_] + k]) & mask) == 0
        open_ = open_[out[open_] & (sizes[open_] > k + 8)]
    for k in open_.tolist():
        out[k] = np.array_equal(a[a_starts[k] : a_starts[k] + sizes[k]], b[b_starts[k] : b_starts[k] + sizes[k]])
    return out


class SpanMemo:
    """Numbers distinct byte spans in the order in which a worker meets them. A hash only finds the place: the bytes of spans
    longer than 7 are kept and compared, and a span whose hash another one has goes to a further hash."""

    def __init__(self, fold: bool = False):
        self.fold = fold
        self.keys, self.slots = np.zeros(0, _U), np.zeros(0, np.int32)
        self.sizes, self.at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.body = np.zeros(0, np.uint8)

    def __len__(self) -> int:
        return len(self.sizes)

    def find(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each span, and one span's index for each slot that is new, in order."""
        keys, sizes = span_hashes(raw, starts, ends, self.fold), ends - starts
        long = sizes > 7
        while True:
            uniq, where, back = np.unique(keys, return_index=True, return_inverse=True)
            place = np.searchsorted(self.keys, uniq)
            place[place == len(self.keys)] = 0
            hit = self.keys[place] == uniq if len(self.keys) else np.zeros(len(uniq), bool)
            #: A span is compared with the one that has its place, or else with the first here that would get it.
            held = hit[back]
            kept = self.slots[place[back[held]]]
            same = sizes == sizes[where][back]
            same[held] = self.sizes[kept] == sizes[held]
            own = self._own(raw)
            some = np.flatnonzero(long & same & held)
            same[some] = same_spans(own, starts[some], self.body, self.at[self.slots[place[back[some]]]], sizes[some])
            some = np.flatnonzero(long & same & ~held & (where[back] != np.arange(len(keys))))
            same[some] = same_spans(own, starts[some], own, starts[where[back[some]]], sizes[some])
            if same.all():
                break
            with np.errstate(over="ignore"):
                keys[~same] = mix64(keys[~same] + _U(1))
        new = np.flatnonzero(~hit)
        slots = np.empty(len(uniq), np.int32)
        slots[hit] = self.slots[place[hit]]
        slots[new] = len(self) + np.arange(len(new), dtype=np.int32)
        if len(new):
            self._add(raw, starts[where[new]], sizes[where[new]], uniq[new], slots[new])
        return slots[back], where[new]

    def _own(self, raw: np.ndarray) -> np.ndarray:
        return LOWER[raw] if self.fold else raw

    def _add(self, raw, starts, sizes, keys, slots) -> None:
        held = np.where(sizes > 7, sizes, 0)
        ends = np.cumsum(held)
        total = int(ends[-1])
        own = raw[np.arange(total) + np.repeat(starts - (ends - held), held)]
        self.at = np.concatenate([self.at, len(self.body) + ends - held])
        self.body = np.concatenate([self.body, self._own(own)])
        self.sizes = np.concatenate([self.sizes, sizes])
        keys, slots = np.concatenate([self.keys, keys]), np.concatenate([self.slots, slots])
        order = np.argsort(keys, kind="stable")  # two sorted runs: a merge
        self.keys, self.slots = keys[order], slots[order]

    def keep(self, slots: np.ndarray) -> None:
        """Forget all but these slots, which rise; they are numbered anew in their order."""
        held = np.where(self.sizes > 7, self.sizes, 0)
        size = held[slots]
        ends = np.cumsum(size)
        chosen = np.zeros(len(self), bool)
        chosen[slots] = True
        self.body = self.body[np.repeat(chosen, held)]  # spans follow each other in the order of their slots
        number = np.full(len(self), -1, np.int32)
        number[slots] = np.arange(len(slots), dtype=np.int32)
        self.at, self.sizes = ends - size, self.sizes[slots]
        stay = number[self.slots] >= 0
        self.keys, self.slots = self.keys[stay], number[self.slots[stay]]


_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def span_crc32(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of byte spans; ``before``: for each span, the CRC-32 of what it continues."""
    out = np.zeros(len(starts), np.uint32) if before is None else before.astype(np.uint32)
    for i in range(0, len(starts), BLOCK_SPANS):
        at, end = starts[i : i + BLOCK_SPANS], ends[i : i + BLOCK_SPANS]
        state = ~out[i : i + BLOCK_SPANS]
        open_ = np.flatnonzero(at < end)
        for k in range(8 * TOGETHER):
            if not len(open_):
                break
            now = state[open_]
            state[open_] = _CRC[(now ^ raw[at[open_] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
            open_ = open_[at[open_] + (k + 1) < end[open_]]
        for k in open_.tolist():
            state[k] = ~np.uint32(zlib.crc32(raw[at[k] + 8 * TOGETHER : end[k]].tobytes(), int(~state[k])))
        out[i : i + BLOCK_SPANS] = ~state
    return out


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words that start at each of the first len - n + 1 words, across texts too; see ngram_starts."""
    if len(words) < n:
        return np.zeros(0, _U)
    m = len(words) - n + 1
    with np.errstate(over="ignore"):
        out = words[:m].copy()
        for j in range(1, n):
            out *= _U(_BASE)
            out += words[j : m + j]
        return mix64(out)


def ngram_starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indices at which n words of one text start, and how many there are in each text."""
    counts = np.maximum(np.diff(first) - (n - 1), 0)
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(first[:-1] - (ends - counts), counts), counts


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
