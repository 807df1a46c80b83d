"""LM scoring by a weighted backoff automaton.

The model is a smoothed n-gram model written as an automaton: a context that was seen in training is a state; a seen
n-gram is an arc with the log-probability of its last token; any other token takes the failure arc to the state of the
shorter context, whose weight is the context's backoff. With c(h, w) counts and mu a constant,

    p(w | h) = (c(h, w) + mu * p(w | h')) / (c(h) + mu),     p(w) = (c(w) + 1) / (N + V + 1)

so the failure weight of h is log10(mu / (c(h) + mu)), and the probabilities of all known tokens and one unknown sum to 1.

Nothing of the model is broadcast, capped or shortened; keys have 64 bits at every size. Documents are dealt into chunks of
about ``CHUNK_BYTES``. A chunk sends its distinct n-grams (hash keys and training counts, packed) to holders of key ranges,
which add up the counts of all chunks and answer for the keys that each chunk asked. With many chunks the messages go by
levels: a holder of level l has the keys of ``FAN`` ** l chunks in one of as many ranges, splits them in ``FAN`` finer ranges
for the next level, and routes the answers back, so a holder's keys stay about a chunk's in number and messages grow with
the input, not with its square. Only distinct n-grams of a chunk move, so a frequent word costs no more than a rare one.

A chunk then has the counts of the automaton's part that its texts can visit. It builds that part (``_Part``): for each seen
n-gram an arc weight and the state that the arc leads to, for each state its failure weight and its failure state. Texts are
traversed from left to right, ``STRETCH`` tokens at a time in lockstep; a stretch enters in the state that its last
``order - 1`` tokens before it determine, so cutting a long text changes nothing.

Defined cases: a null text is empty and has the end token alone; a null key counts as the empty string in the hold-out
rule; a corpus without training rows gives every token 1 / (0 + 0 + 1); repeated rows are scored and counted each; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import Words, mix64, slices, text_buffers, _splitmix

ORDER = 2
MU = 8.0
CHUNK_BYTES = 8 << 20
HOLDER_BYTES = 16 << 20
FAN = 512
STRETCH = 256
END, START = _splitmix(2, 303)


def held_out(key: str = "doc_id", mod: int = 7, rest: int = 2) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(mod)) == rest


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, one end after each text's words, and the place of each text's first."""
    raw, off = text_buffers(column)
    parts, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in slices(off):
        words = Words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
        parts.append(np.insert(words.hashes(fold=True), words.first[1:], END))
        counts.append(words.counts + 1)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def ngram_keys(tok: np.ndarray, first: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For k = 1..order: places at which a k-gram ends (its text has that many tokens before, the start counts as one), and its key."""
    n = len(tok)
    at = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    out = [(np.arange(n), tok)]
    past = np.empty(n, np.uint64)
    if n:
        past[1:] = tok[:-1]
        past[first[:-1]] = START
    context = past.copy()
    for k in range(2, order + 1):
        where = np.flatnonzero(at >= k - 2)
        with np.errstate(over="ignore"):
            out.append((where, mix64(context[where] * np.uint64(0x9E3779B97F4A7C15) + tok[where] + np.uint64(k))))
            deeper = np.zeros(n, np.uint64)
            deeper[1:] = context[:-1]
            context = mix64(deeper * np.uint64(0x9E3779B97F4A7C15) + past + np.uint64(k))
    return out


def pack_numbers(values: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, compressed."""
    if not len(values):
        return b""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_numbers(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    out = np.zeros((flat.shape[1], 8), np.uint8)
    out[:, : blob[0]] = flat.T
    return out.view("<u8")[:, 0]


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack_numbers(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(blob), dtype=np.uint64)


class Automaton:
    """The backoff automaton over explicit tokens, for small corpora and tests; the distributed scorer gives the same sums."""

    def __init__(self, texts: list[list], order: int = ORDER, mu: float = MU):
        self.order, self.mu, self.counts = order, mu, {}
        for text in texts:
            seq = ["\x02", *text, "\x03"]
            for i in range(1, len(seq)):
                for k in range(1, order + 1):
                    if i - k + 1 >= 0:
                        gram = tuple(seq[i - k + 1 : i + 1])
                        self.counts[gram] = self.counts.get(gram, 0) + 1
        unigrams = {g: c for g, c in self.counts.items() if len(g) == 1}
        self.total, self.types = sum(unigrams.values()), len(unigrams)
        self.contexts: dict = {}
        for gram, c in self.counts.items():
            if len(gram) > 1:
                self.contexts[gram[:-1]] = self.contexts.get(gram[:-1], 0) + c

    def failure(self, state: tuple) -> float:
        return math.log10(self.mu / (self.contexts[state] + self.mu))

    def arc(self, state: tuple, token) -> float | None:
        """The weight of a seen arc; at the root every token has one."""
        if not state:
            return math.log10((self.counts.get((token,), 0) + 1) / (self.total + self.types + 1))
        c = self.counts.get((*state, token))
        if not c:
            return None
        return math.log10((c + self.mu * 10 ** self.weight(state[1:], token)) / (self.contexts[state] + self.mu))

    def known(self, state: tuple) -> tuple:
        while state and state not in self.contexts:
            state = state[1:]
        return state

    def weight(self, state: tuple, token) -> float:
        state, out = self.known(state), 0.0
        while (w := self.arc(state, token)) is None:
            out += self.failure(state)
            state = self.known(state[1:])
        return out + w

    def score(self, text: list) -> float:
        """One traversal, left to right."""
        past, out = ("\x02",), 0.0
        for token in [*text, "\x03"]:
            state = self.known(past[max(0, len(past) - self.order + 1) :]) if self.order > 1 else ()
            out += self.weight(state, token)
            past = (*past, token)[-self.order :]
        return out


def _whole(column) -> pa.Array:
    if isinstance(column, pa.Array):
        return column
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


class _Grams:
    """The n-grams of a chunk's texts: for k = 1..order the distinct keys, and at each place the k-gram that ends there (-1: none)."""

    def __init__(self, column, order: int):
        self.tok, self.first = tokens(_whole(column))
        self.order, self.keys, self.at, self.sample = order, [], [], []
        for where, keys in ngram_keys(self.tok, self.first, order):
            uniq, sample, back = np.unique(keys, return_index=True, return_inverse=True)
            at = np.full(len(self.tok), -1, np.int64)
            at[where] = back
            self.keys.append(uniq)
            self.at.append(at)
            self.sample.append(where[sample])

    def counts(self, teaches: np.ndarray) -> list[np.ndarray]:
        return [np.bincount(at[teaches & (at >= 0)], minlength=len(uniq)).astype(np.uint64) for uniq, at in zip(self.keys, self.at)]


class _Part:
    """The automaton's states and arcs that the n-grams of a chunk can visit.

    A state is a seen context, named by its length and number (0: the root, and 1-grams, 2-grams, ...; at a text's first
    place the state of length 1 is the start). The arc of a seen k-gram leaves the state of its first k - 1 tokens."""

    def __init__(self, grams: _Grams, totals: list[np.ndarray], n: int, v: int, mu: float):
        self.grams, self.totals, order = grams, totals, grams.order
        opening = np.zeros(len(grams.tok), bool)
        opening[grams.first[:-1]] = True
        ends = totals[0][grams.at[0][grams.first[1:] - 1]].max(initial=0.0)  # trained texts, the mass of the start
        p = (totals[0] + 1) / (n + v + 1)
        self.arcs, self.fail = [np.log10(p)], [np.zeros(len(totals[0]))]
        for k in range(1, order):
            #: Each distinct gram by the place of one sample: its context ends there one token earlier, its suffix ends there too.
            at = grams.sample[k]
            before = grams.at[k - 1][at - 1]
            first = opening[at]
            mass = np.where(first, ends if k == 1 else 0.0, totals[k - 1][before] if len(totals[k - 1]) else 0.0)
            p = (totals[k] + mu * p[grams.at[k - 1][at]]) / (mass + mu)
            self.arcs.append(np.log10(p))
            self.fail.append(np.log10(mu / (mass + mu)))

    def traverse(self) -> np.ndarray:
        """The log-probability of each text: from left to right, ``STRETCH`` tokens of every text at a time."""
        grams, order = self.grams, self.grams.order
        sizes = np.diff(grams.first)
        if not len(sizes):
            return np.zeros(0)
        runs = -(-sizes // STRETCH)
        text = np.repeat(np.arange(len(sizes)), runs)
        start = grams.first[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)) * STRETCH
        size = np.minimum(start + STRETCH, grams.first[1:][text]) - start
        by_size = np.argsort(-size, kind="stable")
        text, start, size = text[by_size], start[by_size], size[by_size]
        total, state = np.zeros(len(text)), np.empty(len(text), np.int64)
        live = np.searchsorted(-size, -np.arange(1, STRETCH + 1), "right")
        state[:] = self._entered(start)
        for t in range(int(size[0])):
            m = int(live[t])
            place = start[:m] + t
            depth = state[:m]  # the length of the state's context; its tokens are those before the place
            for k in range(order - 1, 0, -1):
                gram = grams.at[k][place]
                able = (depth == k) & (gram >= 0)
                arc = np.flatnonzero(able)
                missed = arc[self.totals[k][gram[arc]] == 0]
                total[missed] += self.fail[k][gram[missed]]  # the failure arc, to the state of one token less
                depth[missed] = k - 1
                hit = arc[self.totals[k][gram[arc]] > 0]
                total[hit] += self.arcs[k][gram[hit]]
                depth[hit] = -(k + 1)
            root = np.flatnonzero(depth == 0)
            gram = grams.at[0][place[root]]
            total[root] += self.arcs[0][gram]
            depth[root] = np.where(self.totals[0][gram] > 0, -1, 0)
            #: The arc of a k-gram leads to the state of its last order - 1 tokens, or of all of them.
            state[:m] = np.minimum(-depth, order - 1)
        return np.bincount(text, total, minlength=len(sizes))

    def _entered(self, start: np.ndarray) -> np.ndarray:
        """The state in which each place is entered: the longest seen context among the order - 1 tokens before it."""
        grams, order = self.grams, self.grams.order
        out = np.zeros(len(start), np.int64)
        inside = ~np.isin(start, grams.first[:-1])
        for k in range(1, order):
            before = np.where(inside, grams.at[k - 1][start - 1], -1)
            seen = np.flatnonzero(before >= 0)
            out[seen[self.totals[k - 1][before[seen]] > 0]] = k
        if order > 1:
            out[~inside] = 1  # the start
        return out


def _levels(size: int, fan: int, holder_bytes: int) -> list[int]:
    """Bits of the key that each level splits; their sum gives holders of about ``holder_bytes`` of text."""
    bits, most = max(6, int(size // holder_bytes).bit_length()), max(1, fan.bit_length() - 1)
    levels = -(-bits // most)
    return [bits * (i + 1) // levels - bits * i // levels for i in range(levels)]


def score(df: DataFrame, train: Column, key: str = "doc_id", text: str = "text", order: int = ORDER, mu: float = MU, chunk_bytes: int = CHUNK_BYTES, holder_bytes: int = HOLDER_BYTES, fan: int = FAN) -> DataFrame:
    """One row for each of df's: key, trained, n_tokens, n_known, train_tokens, base_score, score. Rows where ``train`` holds teach the model."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    size = df.agg(F.coalesce(F.sum(F.octet_length(body)), F.lit(0)).alias("n")).first()[0]
    chunks = max(48, size // chunk_bytes + 1)
    levels = _levels(size, fan, holder_bytes)
    docs = df.select(F.col(key).alias("doc_id"), body.alias("text"), F.coalesce(train, F.lit(False)).alias("trained")).withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.crc32("text")), F.lit(chunks)).cast("long"))
    #: A message goes from a holder (chunk at level 0) to the one that has its keys' range at the next level, and back.
    ask_schema, back_schema = "k int, range long, pack long, sender long, keys binary, counts binary", "k int, range long, pack long, totals binary, mass long, types long"

    def messages(k: int, group: int, prefix: int, keys: np.ndarray, counts: np.ndarray, level: int) -> list[tuple]:
        """The sorted keys of a range, split by the level's bits. Every range gets a message for 1-grams, since all must
        tell their tokens and types; for longer n-grams only those that have keys."""
        done, bits = sum(levels[: level + 1]), levels[level]
        names = [(prefix << bits) + i for i in range(1 << bits)]
        at = np.concatenate([[0], np.searchsorted(keys, np.array([n << (64 - done) for n in names[1:]], np.uint64)), [len(keys)]])
        pack = group >> bits if level + 1 < len(levels) else 0
        return [(k, r, pack, group, pack_sorted(keys[i:j] - np.uint64(r << (64 - done))), pack_numbers(counts[i:j])) for r, i, j in zip(names, at, at[1:]) if k == 0 or i < j]

    def asked(rows: list[tuple]) -> pa.Table:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(("k", "range", "pack", "sender", "keys", "counts"), kinds))})

    def ask(key, table):
        grams = _Grams(table.column("text"), order)
        teaches = np.repeat(table.column("trained").to_numpy(), np.diff(grams.first)).astype(bool)
        return asked([m for k, (keys, counts) in enumerate(zip(grams.keys, grams.counts(teaches))) for m in messages(k, key[0].as_py(), 0, keys, counts, 0)])

    def held(table, level: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """What each message asked, all keys, where each asked key is among them, and their counts so far."""
        base = np.uint64(table.column("range")[0].as_py() << (64 - sum(levels[: level + 1])))
        each = [unpack_sorted(b) + base for b in table.column("keys").to_pylist()]
        counts = [unpack_numbers(b) for b in table.column("counts").to_pylist()]
        keys, back = np.unique(np.concatenate(each), return_inverse=True)
        total = np.zeros(len(keys), np.uint64)
        np.add.at(total, back, np.concatenate(counts))
        return each, keys, back, total

    def replies(k: int, to_range: list[int], table, each, back, total, n: int, v: int) -> pa.Table:
        ends = np.cumsum([len(a) for a in each])
        m = table.num_rows
        blobs = [pack_numbers(total[back[e - len(a) : e]]) for e, a in zip(ends, each)]
        return pa.table({"k": pa.array([k] * m, pa.int32()), "range": pa.array(to_range, pa.int64()), "pack": table.column("sender").cast(pa.int64()), "totals": pa.array(blobs, pa.binary()), "mass": pa.array([n] * m, pa.int64()), "types": pa.array([v] * m, pa.int64())})

    def answer(key, table):
        each, _, back, total = held(table, len(levels) - 1)
        return replies(key[0].as_py(), [key[1].as_py()] * table.num_rows, table, each, back, total, int(total.sum()), int((total > 0).sum()))

    def pass_on(level):
        def run(key, table):
            _, keys, _, total = held(table, level - 1)
            return asked(messages(key[0].as_py(), key[2].as_py(), key[1].as_py(), keys, total, level))

        return run

    def in_order(table) -> np.ndarray:
        """The totals of all replies, which come by ranges, in the order of the keys."""
        order_of = np.argsort(table.column("range").to_numpy())
        blobs = table.column("totals").to_pylist()
        return np.concatenate([np.zeros(0, np.uint64), *[unpack_numbers(blobs[i]) for i in order_of]])

    def route_at(level):
        def run(key, table, answers):
            each, _, back, _ = held(table, level - 1)
            n, v = (int(answers.column(c).to_numpy().sum()) for c in ("mass", "types"))
            return replies(key[0].as_py(), [key[1].as_py()] * table.num_rows, table, each, back, in_order(answers), n, v)

        return run

    sent = [docs.groupBy("chunk").applyInArrow(ask, ask_schema)]
    for level in range(1, len(levels)):
        sent.append(sent[-1].groupBy("k", "range", "pack").applyInArrow(pass_on(level), ask_schema))
    got = sent[-1].groupBy("k", "range").applyInArrow(answer, back_schema)
    for level in range(len(levels) - 1, 0, -1):
        own = sent[level - 1].withColumn("name", F.col("range")).groupBy("k", "name", "pack")
        got = own.cogroup(got.withColumn("name", F.shiftright("range", levels[level])).groupBy("k", "name", "pack")).applyInArrow(route_at(level), back_schema)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("trained", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")], *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]])

    def read(key, own, answers):
        grams = _Grams(own.column("text"), order)
        level = answers.column("k").to_numpy()
        parts = [answers.filter(pa.array(level == k)) for k in range(order)]
        totals = [in_order(p).astype(np.float64) for p in parts]
        n, v = (int(parts[0].column(c).to_numpy().sum()) for c in ("mass", "types"))
        total = _Part(grams, totals, n, v, mu).traverse()
        seen = totals[0][grams.at[0]]
        base = np.log10((seen + 1) / (n + v + 1))
        sums = lambda x: np.add.reduceat(x, grams.first[:-1]) if len(x) else np.zeros(0)
        return pa.table({"doc_id": own.column("doc_id"), "trained": own.column("trained"), "n_tokens": pa.array(np.diff(grams.first), pa.int64()), "n_known": pa.array(sums((seen > 0).astype(np.int64)), pa.int64()), "train_tokens": pa.array([n] * own.num_rows, pa.int64()), "base_score": pa.array(sums(base), pa.float64()), "score": pa.array(total, pa.float64())})

    return docs.groupBy("chunk").cogroup(got.groupBy("pack")).applyInArrow(read, schema).withColumnRenamed("doc_id", key)
