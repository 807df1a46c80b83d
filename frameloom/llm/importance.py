"""Importance resampling towards a target distribution.

1. Features of a text are its runs of 1 to ``longest`` words, hashed to ``buckets``. One pass counts the buckets of the raw
   documents, another those of the target's texts; a task sums what it reads in one array. The totals, at most ``buckets`` rows
   each, go to the driver, which makes the array of gains: a bucket's log ratio of the two smoothed shares, in thousandths.
2. A second pass scores each document from that array: the floored mean gain of its features, plus Gumbel noise from a hash of
   its key. So the highest scores are a draw without repeats by weight.
3. The k-th key in the order (score falling, key rising) is found exactly by radix selection: the rows are counted by one
   16-bit digit of the composite key at a time, the digit in which the k-th row lies is fixed, and the next digit is counted
   among the rows that share the digits so far. At most 65,536 counts come to the driver in each round; rows are only read.
4. The rows up to that key, and no others, are dealt by range, sorted and ranked.

Defined cases: a null text has no features and weight 0; a null key is hashed as an empty string and comes last among ties;
rows equal in score and key are interchangeable, and as many of them are drawn as are wanted; without a document long
enough nothing is drawn; an empty target gives gains by the smoothing alone; empty tables give no rows; other columns are not
read. Keys must be whole numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frames import checkpointed, global_prefix
from ._text import LOWER, Words, ngram_starts, release, segment_sum, slices, span_crc32, text_buffers

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
DIGIT = 16

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _features(raw: np.ndarray, off: np.ndarray, longest: int, buckets: int):
    """Of each length of run: the bucket of every run, and how many each text has; and the texts' words."""
    low = LOWER[raw]
    words = Words(low, off, _WORD)
    crc, out = np.zeros(0, np.uint32), []
    for n in range(1, longest + 1):
        if n == 1:
            crc = span_crc32(low, words.starts, words.ends)
        else:  # the run up to the word before, a space, the word
            space = np.full(1, 32, np.uint8)
            crc = span_crc32(space, np.zeros(len(crc) - 1, np.int64), np.ones(len(crc) - 1, np.int64), crc[:-1]) if len(crc) else crc
            crc = span_crc32(low, words.starts[n - 1 :], words.ends[n - 1 :], crc) if len(crc) else crc
        at, counts = ngram_starts(words.first, n)
        out.append(((crc[at] % np.uint32(buckets)).astype(np.int64), counts))
    return out, words.counts


def bucket_counts(df: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all of df's texts fall in each bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            raw, off = text_buffers(batch.column(0))
            for i, j in slices(off):
                for where, _ in _features(raw[off[i] : off[j]], off[i : j + 1] - off[i], longest, buckets)[0]:
                    total += np.bincount(where, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])
        release()

    out = np.zeros(buckets, np.int64)
    for r in df.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the target's smoothed share over the source's) of each bucket."""
    n = len(source)
    s_all, t_all = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weights(df: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """One row for each of df's: row_key, n_words, n_features, weight."""
    own = df.select(F.col(f"`{key}`").cast("long").alias("row_key"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            raw, off = text_buffers(batch.column(1))
            words, n, total = (np.zeros(len(off) - 1, np.int64) for _ in range(3))
            for i, j in slices(off):
                found, words[i:j] = _features(raw[off[i] : off[j]], off[i : j + 1] - off[i], longest, len(gain))
                for where, counts in found:
                    n[i:j] += counts
                    total[i:j] += segment_sum(gain[where], np.concatenate([[0], np.cumsum(counts)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (words, n, total // np.maximum(n, 1))]], names=["row_key", "n_words", "n_features", "weight"])
        release()

    return own.mapInArrow(run, "row_key long, n_words long, n_features long, weight long")


def noise(key: Column, seed: str = SEED) -> Column:
    """floor(1000 * a Gumbel variate) from a hash of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


_TOP = -(1 << 63)


def kth(rows: DataFrame, parts: list[Column], k: int) -> list[int]:
    """The k-th (from 1) of the rows' composite keys, or a key between it and the next one. parts: longs, compared as
    unsigned numbers, the first one first. There must be k rows."""
    fixed: list[int] = []
    among, left, whole = F.lit(True), k, False
    for part in parts:
        if whole:
            fixed.append((1 << 64) - 1)
            continue
        low, high = rows.where(among).agg(F.min(part.bitwiseXOR(F.lit(_TOP))), F.max(part.bitwiseXOR(F.lit(_TOP)))).first()
        low, high = low + (1 << 63), high + (1 << 63)
        shift = -(-(low ^ high).bit_length() // DIGIT) * DIGIT  # the digits above are the same in all
        prefix = low >> shift
        while shift and not whole:
            shift -= DIGIT
            digit = F.shiftrightunsigned(part, shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
            above = F.shiftrightunsigned(part, shift + DIGIT) == F.lit(prefix) if shift + DIGIT < 64 else F.lit(True)
            counts = rows.where(among & above).groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n")).collect()
            for d, n in sorted((r["digit"], r["n"]) for r in counts):
                if left <= n:
                    break
                left -= n
            prefix, whole = prefix << DIGIT | d, left == n
        fixed.append((prefix + 1 << shift) - 1 if whole else prefix)
        among = among & (part == F.lit(_signed(fixed[-1])))
    return fixed


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _upto(parts: list[Column], bound: list[int]) -> Column:
    """Whether a row's composite key is at most the bound."""
    out = F.lit(True)
    for part, at in reversed(list(zip(parts, bound))):
        x, y = part.bitwiseXOR(F.lit(_TOP)), F.lit(_signed(at)).bitwiseXOR(F.lit(_TOP))
        out = (x < y) | ((x == y) & out)
    return out


def resample(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """One row for each of df's: key, n_words, n_features, weight, score, rank (from 1; null if it isn't drawn)."""
    gain = gains(bucket_counts(df, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    scored = checkpointed(weights(df, gain, key, text, longest).withColumn("score", F.col("weight") + noise(F.col("row_key"), seed)))
    able = F.col("n_words") >= least_words
    k = scored.where(able).count() * percent // 100
    columns = [F.col("row_key").alias(key), "n_words", "n_features", "weight", "score"]
    if k == 0:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    parts = [F.bitwise_not(F.col("score").bitwiseXOR(F.lit(_TOP))), F.col("row_key").isNull().cast("long"), F.coalesce("row_key", F.lit(0)).bitwiseXOR(F.lit(_TOP))]
    chosen = able & _upto(parts, kth(scored.where(able), parts, k))
    ordered = scored.where(chosen).withColumn("falling", F.bitwise_not("score")).withColumn("keyless", F.col("row_key").isNull())
    ranked, _ = global_prefix(ordered, [], ["falling", "keyless", "row_key"])
    drawn = ranked.select(*columns, F.when(F.col("rank") < k, F.col("rank") + 1).alias("rank"))
    return drawn.union(scored.where(~chosen).select(*columns, F.lit(None).cast("long").alias("rank")))
