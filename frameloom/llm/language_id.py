"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a stretch (a word, at most ``STRETCH`` bytes; A-Z as a-z) in both directions, labels every
position with a distribution over the learned languages, and a document's probability is the mean over all its
positions. It is trained here, in numpy, by backpropagation through time, on at most ``SAMPLE`` labelled rows of each
language (chosen by hash; the bound is a parameter), whose texts are read whole, as they are in prediction. Equal stretches of a batch, and of earlier batches of the same worker, are run through the network once.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows with a null language never teach; no
labelled rows at all make every prediction ``und``; stretches longer than ``STRETCH`` bytes are read piece by piece;
repeated rows are predicted each; an empty table gives no rows; languages, sources and keys are no input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import LOWER, SpanMemo, Words, release, slices, text_buffers

STRETCH = 16
HIDDEN = 8
SAMPLE = 300
STEPS = 300
BATCH = 256

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_MAYBE = _ASCII_LETTER | (np.arange(256) >= 0x80)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Model:
    """Weights: for each direction wx (256, 3H), wh (H, 3H), b (3H); v (2H, L), c (L). Gates: update, reset, candidate."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        f = lambda *s, k: (rng.standard_normal(s) * k).astype(np.float32)
        self.w = {}
        for d in "fb":
            self.w |= {f"wx{d}": f(256, 3 * hidden, k=0.3), f"wh{d}": f(hidden, 3 * hidden, k=hidden**-0.5), f"b{d}": np.zeros(3 * hidden, np.float32)}
        self.w |= {"v": f(2 * hidden, len(langs), k=0.3), "c": np.zeros(len(langs), np.float32)}

    def forward(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (T, B, H) of one direction over bytes x (T, B); a masked step carries the state."""
        h, wh, xs = np.zeros((x.shape[1], self.hidden), np.float32), self.w["wh" + d], self.w["wx" + d] + self.w["b" + d]
        k = self.hidden
        out = np.empty((*x.shape, k), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a = xs[x[t]]
            zr = _sigmoid(a[:, : 2 * k] + h @ wh[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            rh = r * h
            n = np.tanh(a[:, 2 * k :] + rh @ wh[:, 2 * k :])
            m = mask[t][:, None]
            new = np.where(m, z * h + (1 - z) * n, h)
            if keep is not None:
                keep.append((t, h, z, r, rh, n, m))
            h = out[t] = new
        return out

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients by backpropagation through time."""
        kf, kb = [], []
        s = np.concatenate([self.forward(x, mask, "f", kf), self.forward(x, mask, "b", kb)], 2)
        logits = s @ self.w["v"] + self.w["c"]
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        n = max(1, mask.sum())
        rows = np.arange(x.shape[1])
        loss = -float((np.log(p[:, rows, y] + 1e-9) * mask).sum()) / n
        g = p.copy()
        g[:, rows, y] -= 1
        g *= mask[:, :, None] / np.float32(n)
        k = self.hidden
        grads = {"v": np.einsum("tbh,tbl->hl", s, g), "c": g.sum((0, 1))}
        ds = g @ self.w["v"].T
        for d, kept, part in (("f", kf, ds[:, :, :k]), ("b", kb, ds[:, :, k:])):
            wh = self.w["wh" + d]
            dwx, dwh, db = np.zeros_like(self.w["wx" + d]), np.zeros_like(wh), np.zeros(3 * k, np.float32)
            dh = np.zeros((x.shape[1], k), np.float32)
            for t, h, z, r, rh, cand, m in reversed(kept):
                dh = dh + part[t]
                own = np.where(m, dh, 0)
                dn = own * (1 - z) * (1 - cand * cand)
                dz = own * (h - cand) * z * (1 - z)
                drh = dn @ wh[:, 2 * k :].T
                dr = drh * h * r * (1 - r)
                da = np.concatenate([dz, dr, dn], 1)
                np.add.at(dwx, x[t], da)
                db += da.sum(0)
                dwh[:, : 2 * k] += h.T @ da[:, : 2 * k]
                dwh[:, 2 * k :] += rh.T @ dn
                dh = np.where(m, 0, dh) + own * z + drh * r + da[:, : 2 * k] @ wh[:, : 2 * k].T
            grads |= {"wx" + d: dwx, "wh" + d: dwh, "b" + d: db}
        return loss, grads

    def _run(self, x: np.ndarray, d: str) -> np.ndarray:
        """States (T, B, H) of one direction, without masks; every stretch has T bytes."""
        k = self.hidden
        wx, wh = (self.w["wx" + d] + self.w["b" + d]).copy(), self.w["wh" + d].copy()
        wx[:, : 2 * k] *= 0.5  # a sigmoid is (tanh(x / 2) + 1) / 2
        wh[:, : 2 * k] *= 0.5
        gates, cand = np.ascontiguousarray(wh[:, : 2 * k]), np.ascontiguousarray(wh[:, 2 * k :])
        out = np.empty((*x.shape, k), np.float32)
        h = np.zeros((x.shape[1], k), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a = wx.take(x[t], axis=0)
            zr = h @ gates
            zr += a[:, : 2 * k]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            n = (zr[:, k:] * h) @ cand
            n += a[:, 2 * k :]
            np.tanh(n, out=n)
            new = out[t]
            np.subtract(h, n, out=new)
            new *= zr[:, :k]
            new += n
            h = new
        return out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (T, B, L) of each position of stretches of T bytes."""
        k = self.hidden
        logits = self._run(x, "f") @ self.w["v"][:k]
        logits += self._run(x, "b") @ self.w["v"][k:]
        logits += self.w["c"]
        p = np.exp(logits.clip(-30, 30))
        return p / p.sum(2, keepdims=True)

    def label(self, text: str) -> list[tuple[str, str, float]]:
        """(word, language, probability) of the label at each word's positions, pooled."""
        raw = np.frombuffer(text.encode(), np.uint8)
        starts, ends = stretches(Words(raw, np.array([0, len(raw)])))[:2]
        sums = self.pooled(raw, starts, ends)
        return [(raw[s:e].tobytes().decode("utf-8", "replace"), self.langs[int(v.argmax())], float(v.max()) / max(1, e - s)) for s, e, v in zip(starts, ends, sums)]

    def pooled(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The sum of the positions' probabilities for each stretch (n, L)."""
        out = np.zeros((len(starts), len(self.langs)), np.float32)
        sizes = ends - starts
        low = LOWER[raw]
        for t in np.unique(sizes):
            own = np.flatnonzero(sizes == t)
            for i in range(0, len(own), 2048):
                some = own[i : i + 2048]
                x = low[starts[some][None, :] + np.arange(t)[:, None]]
                out[some] = self.positions(x).sum(0)
        return out


def stretches(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words that may hold a letter, cut at STRETCH bytes: starts, ends, and the text of each."""
    seen = np.concatenate([[0], np.cumsum(_MAYBE[words.raw])])
    good = seen[words.ends] > seen[words.starts]
    starts, ends, doc = words.starts[good], words.ends[good], words.doc[good]
    pieces = -(-(ends - starts) // STRETCH)
    if len(pieces) and pieces.max() > 1:
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(starts, pieces) + k * STRETCH
        ends = np.minimum(starts + STRETCH, np.repeat(ends, pieces))
        doc = np.repeat(doc, pieces)
    return starts, ends, doc


def train(texts: list[str], langs: list[str], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, seed: int = 1) -> Model | None:
    """Adam over random stretches of the labelled texts, languages drawn evenly."""
    names = sorted(set(langs))
    if not names:
        return None
    body = [t.encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b"".join(body), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(b) for b in body], dtype=np.int64)])
    starts, ends, doc = stretches(Words(raw, off))
    target = np.array([names.index(x) for x in langs])[doc]
    if not len(starts):
        return None
    model, rng = Model(names, hidden, seed), np.random.default_rng(seed)
    by = [np.flatnonzero(target == i) for i in range(len(names))]
    by = [b for b in by if len(b)]
    low = LOWER[raw]
    m = {k: np.zeros_like(v) for k, v in model.w.items()}
    v = {k: np.zeros_like(x) for k, x in model.w.items()}
    for step in range(1, steps + 1):
        pick = np.concatenate([b[rng.integers(0, len(b), max(1, batch // len(by)))] for b in by])
        size = ends[pick] - starts[pick]
        t = np.arange(int(size.max()))[:, None]
        mask = t < size[None, :]
        x = np.where(mask, low[np.minimum(starts[pick][None, :] + t, len(raw) - 1)], 0)
        _, grads = model.step(x, mask, target[pick])
        rate = 0.01 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            model.w[k] = (model.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


class _Memo:
    """Pooled probabilities of the stretches that a worker has seen, up to ``most``."""

    def __init__(self, model: Model, most: int = 1_000_000):
        self.model, self.most = model, most
        self.seen, self.values = SpanMemo(fold=True), np.zeros((0, len(model.langs)), np.float32)

    def of(self, raw, starts, ends) -> np.ndarray:
        if len(self.seen) > self.most:
            self.__init__(self.model, self.most)
        slot, new = self.seen.find(raw, starts, ends)
        if len(new):
            self.values = np.concatenate([self.values, self.model.pooled(raw, starts[new], ends[new])])
        return self.values[slot]


_memos: dict[str, _Memo] = {}


def _has_letter(raw: np.ndarray, off: np.ndarray, column: list) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[raw])])
    out = seen[off[1:]] > seen[off[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in raw[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def sample(df: DataFrame, teach: Column, key: str, text: str, lang: str, per_lang: int = SAMPLE) -> tuple[list[str], list[str]]:
    """At most about ``per_lang`` rows of each language, chosen by a hash of the row, with their whole texts: a bounded sample for the driver."""
    rows = df.where(teach & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).agg(F.count(F.lit(1))).collect()}
    if not counts:
        return [], []
    draw = F.pmod(F.xxhash64(F.lit(5), key, F.crc32(text)), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1 << 30, int((1 << 30) * per_lang / n)))])
    got = rows.withColumn("draw", draw).where(F.col("draw") < share[F.col(lang)]).select("draw", F.col(lang).alias("lang"), F.col(text).alias("text")).orderBy("draw", "lang", "text").limit(2 * per_lang * len(counts)).collect()
    return [r["text"] for r in got], [r["lang"] for r in got]


def fit(df: DataFrame, teach: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> Model | None:
    return train(*sample(df, teach, key, text, lang), **options)


def predict(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each of df's: key, lang_pred, score."""
    own = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    if model is None:
        return own.select(F.col("doc_id").alias(key), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = T.StructType([own.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    name = hashlib.sha256(b"".join(model.w[k].tobytes() for k in sorted(model.w))).hexdigest()

    def run(batches):
        memo = _memos.setdefault(name, _Memo(model))
        for batch in batches:
            raw, off = text_buffers(batch.column(1))
            langs, scores = [], []
            for i, j in slices(off):
                part, at = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                starts, ends, doc = stretches(Words(part, at))
                sums = np.zeros((j - i, len(model.langs)))
                if len(starts):
                    values = memo.of(part, starts, ends)
                    for c in range(len(model.langs)):
                        sums[:, c] = np.bincount(doc, values[:, c], minlength=j - i)
                total = sums.sum(1)
                real = _has_letter(part, at, None) & (total > 0)
                best = sums.argmax(1)
                langs += [model.langs[b] if r else "und" for b, r in zip(best, real)]
                scores += np.where(real, sums.max(1) / np.where(total > 0, total, 1), 0.0).clip(0, 1).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)
        _memos.clear()
        release()

    return own.mapInArrow(run, schema).withColumnRenamed("doc_id", key)
