"""Packing by cutting-stock column generation.

Documents are tokenised (one end id after each) and cut at every ``LENGTH`` ids; what is left of each is a piece shorter
than that. The histogram of piece lengths (at most LENGTH bins, whatever the input) goes to the driver, where a linear
program over patterns (multisets of lengths that fit one sequence) is solved by column generation: the simplex prices
lengths, and a knapsack by dynamic programming finds the pattern that is worth most. Rounded-down patterns are used as
often as the program says, and the few pieces left, no more than the patterns' own, are placed by best fit. Pieces are
ranked within their length in Spark, and a piece's rank says which copy of which pattern it fills.

Distinct stretches of text are tokenised once for each batch: the tokenizer splits before every single space between
words, so a text's ids are those of its stretches, one after another.

Defined cases: a null text is an empty one and has the end id alone; an empty table gives no rows; repeated rows are
packed each; ties among equal lengths go by key, start and checksum; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frames import checkpointed, global_prefix
from ._text import WORD_BYTE, SpanMemo, release, slices, text_buffers

LENGTH = 1024
END = 0
GAP = 0.002
ROUNDS = 100
#: So many stretches are tokenised at once.
BLOCK = 2_000
#: Texts are taken in runs of about so many bytes.
RUN_BYTES = 1 << 20


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Ids:
    """Token ids of stretches of text. Remembers the stretches it has seen, up to ``most`` ids (about 50 MB); then it keeps those
    that came in more than one run of texts since, or, if they are too many, begins anew."""

    def __init__(self, path: str, most: int = 5_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.forget()

    def forget(self):
        self.seen = SpanMemo()
        self.at, self.n, self.used = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)

    def thin_out(self):
        often = self.used > 1
        keep = np.flatnonzero(often)
        size = self.n[keep].astype(np.int64)
        if size.sum() > self.most // 2:
            return self.forget()
        ends = np.cumsum(size)
        self.flat = self.flat[np.repeat(often, self.n)]  # the stretches' ids follow each other
        self.seen.keep(keep)
        self.at, self.n, self.used = (ends - size).astype(np.int32), self.n[keep], np.zeros(len(keep), np.int32)

    def texts(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the place of each text's first, and the total."""
        n = len(raw)
        solid = WORD_BYTE[raw]
        cut = np.zeros(n + 1, bool)
        if n > 2:
            cut[1 : n - 1] = (raw[1:-1] == 32) & solid[:-2] & solid[2:]
        cut[off] = True
        #: A space at the first or last place of its text is not between two words of it.
        cut[n] = False
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        if len(self.flat) > self.most:
            self.thin_out()
        slot, new = self.seen.find(raw, starts, ends)
        if len(new):
            body = raw.tobytes()
            #: Lists of ids take ten times the room of arrays, so they are kept for a block of stretches only.
            size, flat = [], [self.flat]
            for i in range(0, len(new), BLOCK):
                some = new[i : i + BLOCK]
                found = [e.ids for e in self.tokenizer.encode_batch_fast([body[s:e].decode("utf-8", "replace") for s, e in zip(starts[some].tolist(), ends[some].tolist())], add_special_tokens=False)]
                size.append(np.fromiter(map(len, found), np.int64, len(found)))
                flat.append(np.fromiter(chain.from_iterable(found), np.uint32, int(size[-1].sum())))
            sizes = np.concatenate(size)
            at = len(self.flat) + np.concatenate([[0], np.cumsum(sizes)[:-1]])
            self.flat = np.concatenate(flat)
            self.at, self.n, self.used = (np.concatenate([old, own.astype(np.int32)]) for old, own in ((self.at, at), (self.n, sizes), (self.used, np.zeros(len(new)))))
        self.used[np.unique(slot)] += 1
        at, size = self.at[slot].astype(np.int64), self.n[slot].astype(np.int64)
        ends_at = np.cumsum(size)
        total = int(ends_at[-1]) if len(ends_at) else 0
        ids = self.flat[np.arange(total) + np.repeat(at - (ends_at - size), size)]
        first = np.concatenate([[0], ends_at])[np.searchsorted(starts, off)]
        return ids, first


@lru_cache(2)
def _ids(path: str) -> Ids:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Ids(path)


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """Each document's ids cut at every ``length``: row_key, start, length, ids_crc32, doc_tokens."""
    path = path or tokenizer_path()
    own = df.select(F.col(key).alias("row_key"), F.col(text).alias("text"))
    schema = T.StructType([own.schema["row_key"], *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]])

    def run(batches):
        ids_of = _ids(path)
        for batch in batches:
            raw, off = text_buffers(batch.column(1))
            for i, j in slices(off, RUN_BYTES):
                ids, first = ids_of.texts(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                row, start, size, crc, total = [], [], [], [], []
                for k in range(j - i):
                    own_ids = np.append(ids[first[k] : first[k + 1]], np.uint32(end)).astype("<u4")
                    for at in range(0, len(own_ids), length):
                        part = own_ids[at : at + length]
                        row.append(i + k)
                        start.append(at)
                        size.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        total.append(len(own_ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, size, crc, total)]], names=schema.names)
            del ids, first, raw, off
            release()

    return own.mapInArrow(run, schema)


def knapsack(worth: np.ndarray, sizes: np.ndarray, room: int, most: int = 40) -> list[tuple[float, dict[int, int]]]:
    """Multisets of sizes (as indices) that fit ``room``, by dynamic programming: the one that is worth most, then the
    best that hold other sizes, ``most`` in all. ``sizes`` must rise."""
    idx = np.flatnonzero(worth > 1e-12)
    if not len(idx):
        return []
    size, gain = sizes[idx], worth[idx]
    best, pick = np.zeros(room + 1), np.full(room + 1, -1, np.int64)
    upto = np.searchsorted(size, np.arange(room + 1), "right").tolist()
    for c in range(int(size[0]), room + 1):
        value = best[c - size[: upto[c]]] + gain[: upto[c]]
        m = int(value.argmax())
        best[c] = best[c - 1]
        if value[m] > best[c] + 1e-15:
            best[c], pick[c] = value[m], m
    held = gain + best[room - size]
    out, seen = [], set()
    for k in np.argsort(-held)[: 4 * most]:
        parts = {int(idx[k]): 1}
        c = room - int(size[k])
        while c > 0:
            if pick[c] < 0:
                c -= 1
                continue
            i = int(idx[pick[c]])
            parts[i] = parts.get(i, 0) + 1
            c -= int(size[pick[c]])
        if (name := tuple(sorted(parts.items()))) not in seen:
            seen.add(name)
            out.append((float(held[k]), parts))
            if len(out) == most:
                break
    return out


def first_basis(sizes: np.ndarray, counts: np.ndarray, room: int) -> tuple[list[dict[int, int]], np.ndarray, list[int]]:
    """A feasible basis: first-fit patterns, each used until one of its sizes is used up, so that the basis is triangular."""
    left = counts.astype(float).copy()
    open_ = list(range(len(sizes)))
    patterns, x, used_up = [], [], []
    while open_:
        parts, free, k = {}, room, len(open_) - 1
        while k >= 0 and free > 0:
            i = open_[k]
            n = int(min(free // sizes[i], max(1, left[i])))
            if n > 0:
                parts[i] = n
                free -= n * int(sizes[i])
            k = bisect_right(open_, free, key=lambda j: sizes[j], hi=k) - 1
        t, gone = min((left[i] / n, i) for i, n in parts.items())
        for i, n in parts.items():
            left[i] = max(left[i] - t * n, 0)
        open_.remove(gone)
        patterns.append(parts)
        x.append(t)
        used_up.append(gone)
    return patterns, np.array(x), used_up


def column_generation(sizes: np.ndarray, counts: np.ndarray, room: int = LENGTH, gap: float = GAP, rounds: int = ROUNDS) -> tuple[list[dict[int, int]], np.ndarray]:
    """Patterns (index of size: how often) and how often each is used, fractional; covers the counts in nearly least sequences.

    Revised simplex with an explicit inverse; each pricing by knapsack offers several columns. Stops when the best
    pattern's worth proves the program within ``gap`` of its optimum, or when the sequences are full within ``gap``.
    """
    m = len(sizes)
    patterns, x, used_up = first_basis(sizes, counts, room)
    #: The size that a pattern used up is in no later one, so the inverse follows row by row.
    inverse, held = np.zeros((m, m)), {i: {} for i in range(m)}
    for j, p in enumerate(patterns):
        for i, k in p.items():
            held[i][j] = k
    for j, i in enumerate(used_up):
        row = np.zeros(m)
        row[i] = 1.0
        for other, k in held[i].items():
            if other != j:
                row -= k * inverse[other]
        inverse[j] = row / held[i][j]
    dual = inverse.sum(0)
    full = float((sizes * counts).sum()) / room
    for _ in range(rounds):
        if x.sum() <= (1 + gap) * full:
            break
        offers = knapsack(np.maximum(dual, 0), sizes, room)
        if not offers or offers[0][0] <= 1 + gap:
            break
        turned = False
        for _, pattern in offers:
            idx, k = np.array(list(pattern)), np.array(list(pattern.values()), float)
            worth = float((dual[idx] * k).sum())
            if worth <= 1 + gap / 2:
                continue
            enter = (inverse[:, idx] * k).sum(1)
            able = enter > 1e-9
            if not able.any():
                continue
            ratio = np.where(able, x / np.where(able, enter, 1), np.inf)
            j = int(ratio.argmin())
            t = ratio[j]
            x = np.maximum(x - t * enter, 0)
            x[j] = t
            row = inverse[j] / enter[j]
            inverse -= np.outer(enter, row)
            inverse[j] = row
            dual = dual + (1 - worth) * row
            patterns[j] = pattern
            turned = True
        if not turned:
            break
    return patterns, x


def layout(counts: dict[int, int], room: int = LENGTH) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: intervals of ranks. (first rank, sequence of that rank, offset there, step of the sequence by rank: 1, or 0 in one sequence).

    A rank r in the interval that starts at f goes to sequence base + (r - f) at the offset.
    """
    todo = {s: n for s, n in counts.items() if n}
    used: dict[int, int] = {s: 0 for s in todo}
    spans: dict[int, list[tuple[int, int, int]]] = {s: [] for s in todo}
    base = 0

    def place(parts: dict[int, int], times: int):
        nonlocal base
        offset = 0
        for s in sorted(parts, reverse=True):
            for _ in range(parts[s]):
                spans[s].append((used[s], base, offset))
                used[s] += times
                offset += s
        base += times

    if room in todo:
        place({room: 1}, todo[room])
    short = sorted(s for s in todo if s != room)
    if short:
        sizes, need = np.array(short), np.array([todo[s] for s in short], float)
        patterns, x = column_generation(sizes, need, room)
        left = {s: todo[s] for s in short}
        for p, t in sorted(zip(patterns, x), key=lambda q: -q[1]):
            parts = {short[i]: k for i, k in p.items()}
            times = min([int(t + 1e-6), *[left[s] // k for s, k in parts.items()]])
            if times > 0:
                place(parts, times)
                for s, k in parts.items():
                    left[s] -= k * times
        #: The rest, at most the patterns' own pieces: best fit, from the longest; equal fills are counted together.
        bins: list[tuple[int, dict[int, int]]] = []
        by_room: dict[int, list[int]] = {}
        for s in sorted(left, reverse=True):
            for _ in range(left[s]):
                gap = next((g for g in range(s, room + 1) if by_room.get(g)), None)
                if gap is None:
                    bins.append((room - s, {s: 1}))
                    by_room.setdefault(room - s, []).append(len(bins) - 1)
                else:
                    b = by_room[gap].pop()
                    parts = bins[b][1]
                    parts[s] = parts.get(s, 0) + 1
                    bins[b] = (gap - s, parts)
                    by_room.setdefault(gap - s, []).append(b)
        for _, parts in bins:
            place(parts, 1)
    return {s: tuple(np.array(c, np.int64) for c in zip(*sorted(v))) for s, v in spans.items()}


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row a piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = checkpointed(pieces(df, key, text, path, length, end))  # the range sampling would tokenise again
    ranked, totals = global_prefix(cut, ["length"], ["row_key", "start", "ids_crc32", "doc_tokens"])
    counts = {int(r["length"]): int(r["n"]) for r in totals.groupBy("length").agg(F.sum("rows").alias("n")).collect()}  # at most ``length`` rows
    plan = layout(counts, length)
    ranked = ranked.select("row_key", "start", "length", "ids_crc32", "doc_tokens", "rank")
    schema = T.StructType([*ranked.drop("rank").schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        for batch in batches:
            size, rank = batch.column(2).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)
            seq, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
                first, base, at = plan[int(size[own[0]])]
                k = np.searchsorted(first, rank[own], "right") - 1
                seq[own], offset[own] = base[k] + rank[own] - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(run, schema).withColumnRenamed("row_key", key)
