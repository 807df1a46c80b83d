"""Spelling variants: words one edit apart, found by Aho-Corasick automata over the words' halves.

1. Runs of letters of whole texts are lower-cased and counted; a task counts in a memo of its own before anything is shuffled.
   A run whose hash with the document's key is divisible by ``EVERY`` loses a code point first (the contract's planted slips).
2. A word is cut in two segments. One edit leaves at least one of them as it is: the first at the start of the other word, or
   the second at its end. Each shard of patterns is an automaton over the segments of some words, and every word that could
   match is scanned by it; a match counts if its place (start or end) and the lengths (at most one apart) fit, and the pair is
   then verified. A word goes to the shards of its outer code points only: shards are keyed by side and by the first or
   last two to four of them, which a fitting word shares. The words of one key are cut in blocks of ``BLOCK`` patterns and
   scanned words, so a shard is bounded whatever a key holds.
3. A pair that both halves tell is counted by the first one. A shard gives one row for each scanned word: how many words
   it found near and the commonest of them. So rows stay as many as words and blocks, not pairs.
4. Forms are followed to the last by pointer doubling; counts at least double along a chain, so chains are short.

Defined cases: a null text has no runs; a null key is written as an empty string; runs are counted as often as they occur,
repeated rows included; ties among forms go to the smallest in code-point order; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import checkpointed
from ._text import LOWER, SpanMemo, Words, release, slices, span_crc32, text_buffers

EVERY = 97
LEAST_CHARS = 5
LEAST_COUNT = 3
TIMES = 2
BLOCK = 20_000
#: So many distinct words, or bytes of them, a task holds before it hands its counts on.
HELD, HELD_BYTES = 500_000, 64_000_000
#: Words up to this length are verified as rows of a matrix, longer ones one by one.
WIDE = 40

_ASCII = np.zeros(256, bool)
_ASCII[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_FLAG = np.array([False] + [True] * 255)


def _runs(raw: np.ndarray, off: np.ndarray) -> Words:
    """Runs of A-Z, a-z and U+00C0 to U+00FF, which are C3 and one more byte in UTF-8."""
    lead = raw == 0xC3
    solid = _ASCII[raw] | lead
    solid[1:] |= lead[:-1]
    return Words(solid.view(np.uint8), off, _FLAG)


class _Counts:
    """Counts of distinct words, held until they are handed on."""

    def __init__(self):
        self.memo, self.n, self.words, self.changed, self.bytes = SpanMemo(), np.zeros(0, np.int64), [], {}, 0

    def add(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        slots, new = self.memo.find(low, starts, ends)
        self.words += [low[s:e].tobytes() for s, e in zip(starts[new].tolist(), ends[new].tolist())]
        self.bytes += int((ends[new] - starts[new]).sum())
        self.n = np.concatenate([self.n, np.zeros(len(new), np.int64)]) + np.bincount(slots, minlength=len(self.n) + len(new))

    def full(self) -> bool:
        return len(self.words) + len(self.changed) > HELD or self.bytes > HELD_BYTES

    def rows(self) -> pa.RecordBatch:
        words = [w.decode("utf-8", "replace") for w in self.words] + list(self.changed)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([*self.n.tolist(), *self.changed.values()], pa.int64())], names=["word", "n"])


def word_counts(df: DataFrame, key: str = "doc_id", text: str = "text", every: int = EVERY, least_chars: int = LEAST_CHARS) -> DataFrame:
    """word, n: the distinct words of all texts and how often they occur."""

    def run(batches):
        counts = _Counts()
        for batch in batches:
            keys = [zlib.crc32(f"{k or ''}:".encode()) for k in batch.column(0).to_pylist()]
            raw, off = text_buffers(batch.column(1))
            for i, j in slices(off):
                part, at = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                words, low = _runs(part, at), LOWER[part]
                before = np.repeat(np.array(keys[i:j], np.uint32), words.counts)
                h = span_crc32(low, words.starts, words.ends, before)
                slip = h % np.uint32(every) == 0
                inner = np.concatenate([[0], np.cumsum((part & 0xC0) == 0x80)])
                size = words.ends - words.starts - (inner[words.ends] - inner[words.starts])
                plain = ~slip & (size >= least_chars)
                if plain.any():
                    counts.add(low, words.starts[plain], words.ends[plain])
                for k in np.flatnonzero(slip & (size > least_chars)).tolist():
                    w = low[words.starts[k] : words.ends[k]].tobytes().decode("utf-8", "replace")
                    cut = int(h[k]) % len(w)
                    w = w[:cut] + w[cut + 1 :]
                    counts.changed[w] = counts.changed.get(w, 0) + 1
                if counts.full():
                    yield counts.rows()
                    counts = _Counts()
        yield counts.rows()
        release()

    own = df.select(F.col(f"`{key}`").cast("string").alias("row_key"), F.col(f"`{text}`").cast("string").alias("text"))
    return own.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Letters:
    """Words as rows of code points, from the left and from the right."""

    def __init__(self, words: list[str]):
        self.words = words
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        short = [w if len(w) <= WIDE else "" for w in words]
        flat = np.frombuffer("".join(short).encode("utf-32-le"), np.uint32)
        n = np.fromiter(map(len, short), np.int64, len(short))
        row = np.repeat(np.arange(len(short)), n)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        self.left, self.right = np.zeros((len(short), WIDE), np.uint32), np.zeros((len(short), WIDE), np.uint32)
        self.left[row, place] = flat
        self.right[row, n[row] - 1 - place] = flat


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many values rows of a and b share from the left, at most ``most``."""
    differ = a != b
    return np.minimum(np.where(differ.any(1), differ.argmax(1), a.shape[1]), most)


def _common_of(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # the longest common prefix by halving
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def near(scan: _Letters, i: np.ndarray, pattern: _Letters, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether scan[i] and pattern[j] are one edit apart, and how many code points they share from the start."""
    a, b = scan.size[i], pattern.size[j]
    least = np.minimum(a, b)
    left, right = _common(scan.left[i], pattern.left[j], least), _common(scan.right[i], pattern.right[j], least)
    for k in np.flatnonzero((a > WIDE) | (b > WIDE)).tolist():
        x, y = scan.words[i[k]], pattern.words[j[k]]
        left[k], right[k] = _common_of(x, y), _common_of(x[::-1], y[::-1])
    differ = (a != b) | (left < a)
    return differ & (np.abs(a - b) <= 1) & (left + right >= np.maximum(a, b) - 1), left


_FOUND = "word string, n_near long, form_n long, form string"


def _found(words: list[str], near: np.ndarray, form_n: np.ndarray, forms: list[str]) -> pa.Table:
    return pa.table([pa.array(words, pa.string()), pa.array(near, pa.int64()), pa.array(form_n, pa.int64()), pa.array(forms, pa.string())], names=["word", "n_near", "form_n", "form"])


def _shard(rows: pa.Table) -> pa.Table:
    """One shard: the near patterns of each scanned word, counted, and the commonest."""
    import ahocorasick

    none = _found([], np.zeros(0), np.zeros(0), [])
    tail = rows.column("tail")[0].as_py()
    own = rows.filter(rows.column("pattern")).sort_by("word")
    other = rows.filter(pc.invert(rows.column("pattern")))
    if not len(own) or not len(other):
        return none
    n, cell, scan_cell = own.column("n").to_numpy(), own.column("cell").to_numpy(), other.column("cell").to_numpy()
    names, own_names = other.column("word").to_pylist(), own.column("word").to_pylist()
    patterns, scans = _Letters(own_names), _Letters(names)
    halves = [w[len(w) // 2 :] if tail else w[: len(w) // 2] for w in patterns.words]
    number: dict[str, int] = {}
    segment = np.fromiter((number.setdefault(h, len(number)) for h in halves), np.int64, len(halves))
    automaton = ahocorasick.Automaton()
    for h, k in number.items():
        automaton.add_word(h, (k, len(h)))
    automaton.make_automaton()
    by = np.argsort(segment, kind="stable")
    first = np.searchsorted(segment[by], np.arange(len(number) + 1))
    at, hit = [], []
    for i, w in enumerate(scans.words):
        last = len(w) - 1
        for end, (k, size) in automaton.iter(w):
            if end == last if tail else end == size - 1:
                at.append(i)
                hit.append(k)
    at, hit = np.array(at, np.int64), np.array(hit, np.int64)
    many = first[hit + 1] - first[hit] if len(hit) else hit
    upto = np.cumsum(many)
    rows = []
    lo = 0
    while lo < len(hit):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + 100_000, "right")))
        part = many[lo:hi]
        i = np.repeat(at[lo:hi], part)
        j = by[np.arange(part.sum()) + np.repeat(first[hit[lo:hi]] - (np.cumsum(part) - part), part)]
        for c in range(0, len(i), 100_000):
            x, y = i[c : c + 100_000], j[c : c + 100_000]
            fit = (np.abs(scans.size[x] - patterns.size[y]) <= 1) & (scan_cell[x] == cell[y])
            x, y = x[fit], y[fit]
            good, left = near(scans, x, patterns, y)
            if tail:  # told by the first half already
                good &= left < patterns.size[y] // 2
            rows.append((x[good], y[good]))
        lo = hi
    if not rows or not sum(len(x) for x, _ in rows):
        return none
    x, y = (np.concatenate(c) for c in zip(*rows))
    #: A word may be scanned in more cells than one.
    number_of = other.column("word").combine_chunks().dictionary_encode().indices.to_numpy()[x]
    order = np.lexsort((y, -n[y], number_of))  # patterns are in code-point order
    x, y, number_of = x[order], y[order], number_of[order]
    head = np.flatnonzero(np.concatenate([[True], number_of[1:] != number_of[:-1]]))
    return _found([names[k] for k in x[head]], np.diff(np.append(head, len(x))), n[y[head]], [own_names[k] for k in y[head]])


def neighbours(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """vocabulary: distinct words of at least 4 code points and n. Returns word, n_near, form_n, form (the commonest near
    word, ties by code point) for each word that has a near one."""
    size = F.length("word")
    length = lambda s: F.greatest(F.least(F.floor(s / 2).cast("int"), F.lit(4)), F.lit(2))
    cut = lambda tail, r: F.when(tail, F.expr("word").substr(size - r + 1, r)).otherwise(F.expr("word").substr(F.lit(1), r))
    sides = vocabulary.select("word", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("tail"))
    pattern = sides.select("word", "n", "tail", cut(F.col("tail"), length(size)).alias("key"))
    #: A fitting word is up to one longer or shorter, so its key may have another length.
    scan = sides.select("word", "tail", F.explode(F.array_distinct(F.array(*[cut(F.col("tail"), length(size + d)) for d in (-1, 0, 1)]))).alias("key"))
    parts = lambda df, name: df.groupBy("tail", "key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    keys = parts(pattern, "own").join(parts(scan, "other"), ["tail", "key"])
    shards = max(1, -(-vocabulary.count() // block))
    #: A shard holds several cells (key, block of patterns, block of scanned words); words meet in one cell only.
    cell = F.xxhash64("key", "i", "j")
    of = [F.pmod(cell, F.lit(shards)).alias("shard"), cell.alias("cell")]
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    turn = lambda c: F.pmod(F.xxhash64(F.lit(3), "word"), F.col(c)).cast("int")
    a = pattern.join(keys, ["tail", "key"]).withColumn("i", turn("own")).withColumn("j", each("other")).select("tail", *of, "word", "n", F.lit(True).alias("pattern"))
    b = scan.join(keys, ["tail", "key"]).withColumn("j", turn("other")).withColumn("i", each("own")).select("tail", *of, "word", F.lit(None).cast("long").alias("n"), F.lit(False).alias("pattern"))
    found = a.union(b).groupBy("tail", "shard").applyInArrow(_shard, _FOUND)
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.minus")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """forms: word, form, without circles. Returns word, root: the last of the chain from each word."""
    now = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = checkpointed(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def variants(df: DataFrame, key: str = "doc_id", text: str = "text", every: int = EVERY, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n."""
    vocabulary = checkpointed(word_counts(df, key, text, every, least_chars).where((F.col("n") >= least_count) & (F.length("word") >= least_chars)))
    joined = vocabulary.join(neighbours(vocabulary), "word", "left")
    formed = F.col("form_n") >= times * F.col("n")
    rows = checkpointed(joined.select("word", F.when(formed, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("form_n")).alias("form_n")))
    last = roots(rows.where("form is not null"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.col("n_near").cast("long").alias("n_near"), "form_n")
