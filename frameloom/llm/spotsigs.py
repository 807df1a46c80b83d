"""SpotSigs fingerprints: chains of content words that follow common words, compared through pruned Jaccard.

Every anchor (a common word) followed by content words gives one signature: the anchor and the next ``CHAIN`` content
words. A fingerprint is the set of a text's signatures (32-bit hashes), written as base64 of the sorted values, so equal
texts have equal fingerprints and likeness is computed from fingerprints alone. A text without a full chain has one
signature: all its words. Likeness is Jaccard. ``fingerprint_with_next`` compares each document with two others that are given;
``similar_pairs`` finds all pairs over a threshold: sets are partitioned by length, and what length or prefix rule out is never compared.

Defined cases: a null text is empty; a text without words has the empty fingerprint, whose likeness to another empty one
is 1 and to any other 0; equal keys are ordered by the text's checksum; a null key is the last; a single document is
followed by itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frames import checkpointed, map_text, shuffle_partitions
from ._text import LOWER, WORD_BYTE, Words, mix64, span_hashes

CHAIN = 2
#: Common words of the languages, the anchors; other words are content.
ANCHORS = {
    "en": "a an and are as at be been but by for from had has have he her his if in is it its not of on or she that the their there they this to was we were which will with you".split(),
    "fr": "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour que qui sa se ses son sont sur un une vous".split(),
    "de": "als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nicht noch nur oder sein sich sie sind so und von war wie wir zu zum zur".split(),
    "es": "al como con de del el en es esta este ha la las le lo los más me mi no o para pero por que se sin sobre su sus un una y ya".split(),
}
#: Letters and digits and all bytes beyond ASCII: punctuation does not belong to a signature's words.
_PART = WORD_BYTE.copy()
for _c in range(0x21, 0x7F):
    _PART[_c] = chr(_c).isalnum()


def _anchor_hashes() -> np.ndarray:
    words = sorted({w for ws in ANCHORS.values() for w in ws})
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    sizes = np.array([len(w.encode()) for w in words])
    ends = np.cumsum(sizes)
    return np.sort(span_hashes(raw, ends - sizes, ends, True))


_ANCHOR = _anchor_hashes()


def signatures(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct signatures (sorted uint32) of each text, flat, and offsets."""
    words = Words(raw, off, _PART)
    h = words.hashes(fold=True)
    n = len(off) - 1
    place = np.searchsorted(_ANCHOR, h)
    place[place == len(_ANCHOR)] = 0
    anchor = _ANCHOR[place] == h
    doc = words.doc
    content = np.flatnonzero(~anchor)
    spots = np.flatnonzero(anchor)
    nxt = np.searchsorted(content, spots)
    ok = nxt + CHAIN <= len(content)
    spots, nxt = spots[ok], nxt[ok]
    same = doc[content[nxt + CHAIN - 1]] == doc[spots] if len(spots) else np.zeros(0, bool)
    spots, nxt = spots[same], nxt[same]
    with np.errstate(over="ignore"):
        sig = h[spots]
        for k in range(CHAIN):
            sig = mix64(sig * np.uint64(0x9E3779B97F4A7C15) + h[content[nxt + k]])
    where = doc[spots]
    bare = np.flatnonzero((words.counts > 0) & (np.bincount(where, minlength=n) == 0))
    if len(bare):
        whole = np.array([mix64(np.add.reduce(h[words.first[d] : words.first[d + 1]] * (2 * np.arange(words.counts[d], dtype=np.uint64) + np.uint64(1)), keepdims=True))[0] for d in bare], np.uint64)
        sig, where = np.concatenate([sig, whole]), np.concatenate([where, bare])
    both = (where.astype(np.uint64) << np.uint64(32)) | (sig >> np.uint64(32))
    both = np.unique(both)
    return both.astype(np.uint32), np.searchsorted(both >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))


def encode(values: np.ndarray) -> str:
    return base64.b64encode(values.astype("<u4").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Jaccard of two sorted sets; 0 when the threshold is out of reach by set lengths."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(large):
        return 1.0
    if len(small) < threshold * len(large) or not len(small):
        return 0.0
    if a.tobytes() == b.tobytes():
        return 1.0
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    out = both / (len(a) + len(b) - both)
    return out if out >= threshold else 0.0


def _fingerprints(texts: list[str], limit: int = 1 << 21) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    part: list[bytes] = []
    size = 0

    def close():
        raw = np.frombuffer(b"".join(part), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(p) for p in part], dtype=np.int64)])
        values, first = signatures(raw, off)
        out.extend(values[first[i] : first[i + 1]] for i in range(len(part)))
        part.clear()

    for t in texts:
        b = t.encode("utf-8", "surrogatepass")
        part.append(b)
        size += len(b)
        if size > limit:
            close()
            size = 0
    if part:
        close()
    return out


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the head of the following one."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


#: Fingerprints stay raw bytes, and texts compressed ones, until the last step: what is shuffled and checkpointed is small.
_FIELDS = "doc_id {0}, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, part int, side string, body binary"


def _packed(column: pa.Array) -> list[pa.Array]:
    press = zstandard.ZstdCompressor(level=3)
    return [pa.array([press.compress((t or "").encode("utf-8", "surrogatepass")) for t in column.to_pylist()], pa.binary())]


def _unpacked(bodies: list[bytes]) -> list[str]:
    press = zstandard.ZstdDecompressor()
    return [press.decompress(b).decode("utf-8", "surrogatepass") for b in bodies]


def _rows(keys, texts, followers) -> list[list]:
    """Result columns for documents whose follower is known."""
    changed = [edited(t, f) for t, f in zip(texts, followers)]
    prints = _fingerprints([*texts, followers[-1], *changed]) if texts else []
    n = len(texts)
    own, last, other = prints[:n], prints[n : n + 1], prints[n + 1 :]
    nxt = own[1:] + last
    return [
        keys, [len(t) for t in texts], [hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed], [p.astype("<u4").tobytes() for p in own], [p.astype("<u4").tobytes() for p in other],
        [likeness(a, b) for a, b in zip(own, other)], [likeness(a, b) for a, b in zip(own, nxt)],
    ]


def fingerprint_with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each of df's in descending order of the key: key, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. One shuffle of the texts, by range; the last row of a range gets the
    first of the next range from a side table of two rows a range."""
    kind = df.schema[key].dataType.simpleString()
    own = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("tie", F.crc32("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie").asc()]
    packed = map_text(own, _packed, [T.StructField("body", T.BinaryType())], drop=["text"])
    ranged = packed.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order, "body").select("doc_id", "body")
    schema = T.StructType.fromDDL(_FIELDS.format(kind))
    names = schema.names
    types = [None, pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.binary()]

    def batch_of(key_type, columns):
        return pa.RecordBatch.from_arrays([pa.array(c, t or key_type) for c, t in zip(columns, types)], names=names[: len(columns)])

    def run(batches):
        part = TaskContext.get().partitionId()
        last = None
        edge = lambda key_type, side, row: batch_of(key_type, [[row[0]], [0], *[[None]] * 5, [part], [side], [row[1]]])
        for batch in batches:
            key_type = batch.schema.field(0).type
            keys, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not keys:
                continue
            if last is None:
                yield edge(key_type, "head", (keys[0], bodies[0]))
            else:
                keys, bodies = [last[0], *keys], [last[1], *bodies]
            last = (keys[-1], bodies[-1])
            at = 0
            while at < len(keys) - 1:  # a few MB at a time
                stop, size = at, 0
                while stop < len(keys) - 1 and size < 1_000_000:
                    size += len(bodies[stop])
                    stop += 1
                texts = _unpacked(bodies[at : stop + 1])
                yield batch_of(key_type, [*_rows(keys[at:stop], texts[:-1], texts[1:]), [part] * (stop - at), [None] * (stop - at), [None] * (stop - at)])
                at = stop
        if last is not None:
            yield edge(key_type, "tail", last)

    done = checkpointed(ranged.mapInArrow(run, schema))
    heads = done.where("side = 'head'").select("part", F.col("body").alias("head"))
    #: One row for each range that has rows: its follower's first text, or the first of all.
    chain = Window.orderBy("part")
    following = heads.select("part", F.coalesce(F.lead("head").over(chain), F.first("head").over(chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("following"))
    tails = done.where("side = 'tail'").join(following, "part").select("doc_id", "body", "following")

    def finish(batches):
        for batch in batches:
            for k, t, f in zip(*[c.to_pylist() for c in batch.columns]):
                yield batch_of(batch.schema.field(0).type, _rows([k], _unpacked([t]), _unpacked([f])))

    ends = tails.mapInArrow(finish, T.StructType(schema.fields[:7]))
    both = done.where("side is null").select(*names[:7]).unionByName(ends)
    return both.withColumns({c: F.base64(c) for c in ("fingerprint", "edited_fingerprint")}).withColumnRenamed("doc_id", key)


def similar_pairs(prints: DataFrame, threshold: float = 0.8, key: str = "doc_id", fingerprint: str = "fingerprint") -> DataFrame:
    """Pairs of distinct fingerprints with Jaccard >= threshold: a < b (fingerprints' least keys), likeness.

    Equal fingerprints are one row first. Sets are partitioned by length, in parts whose bounds rise by 1 / threshold: a set meets
    those of its own part and of the next, in [n, n / threshold], through the least frequent of its signatures, enough of them
    that a pair over the threshold must share one.
    """

    def parts(batches):
        for batch in batches:
            sets = [decode(f) for f in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "n", "sigs"])

    once = prints.where(F.length(fingerprint) > 0).groupBy(fingerprint).agg(F.min(key).alias("id")).select("id", fingerprint)
    kind = once.schema["id"].dataType.simpleString()
    sets = checkpointed(once.mapInArrow(parts, f"id {kind}, n long, sigs array<long>"))
    use = sets.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("use"))
    ranked = sets.select("id", "n", F.explode("sigs").alias("sig")).join(use, "sig").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("use", "sig")))
    #: Lengths within a factor of the threshold are in one part or in two that follow each other.
    part = F.floor(F.log(F.col("n")) / F.lit(-math.log(threshold)))
    prefix = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).select("id", "n", "sig", part.alias("part"))
    short = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    long = prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "sig", "part")
    met = short.join(long, ["part", "sig"]).where((F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))).where(F.col("na") >= F.col("nb") * threshold).select("a", "b").distinct()
    full = met.join(sets.select(F.col("id").alias("a"), F.col("sigs").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("sigs").alias("sb")), "b")
    like = F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))
    return full.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), like.alias("likeness")).where(F.col("likeness") >= threshold)
