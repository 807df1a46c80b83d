"""Statistics of features: by episode, pooled over episodes, by dimension, with exact or histogram quantiles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .windows import EPISODE, FRAME, in_order

QUANTILES = (0.01, 0.10, 0.50, 0.90, 0.99)


def quantile_name(q: float) -> str:
    """Quantile names are truncated percents: 0.29 is q28."""
    return f"q{int(q * 100):02d}"


def aggregates(value: Column, quantiles: Sequence[float]) -> list[Column]:
    exact = F.percentile(value, F.array(*[F.lit(q) for q in quantiles])) if quantiles else None
    out = [F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("count")]
    if quantiles:
        out.append(exact.alias("_q"))
    return out


def split_quantiles(df: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    if not quantiles:
        return df
    few = F.col("count") < 2
    for i, q in enumerate(quantiles):
        df = df.withColumn(quantile_name(q), F.when(few, F.col("mean")).otherwise(F.col("_q")[i]))
    return df.drop("_q")


#: A sketch's error in rank is at most a group's size by this; brackets are four times as wide on either side. A task holds a sketch of
#: each group, up to a few times so many values: what a bracket holds is counted by a shuffle and costs no task memory.
_SHARP = 10_000
#: Datasets of no more values are quantiled in one pass, in which a group's distinct values are one task's.
FEW_VALUES = 2_000_000


def selected_quantiles(df: DataFrame, value: str, by: Sequence[str] = (), quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Exact quantiles (linear between ranks) of groups of any size: by, and a column for each.

    A sketch, whose error in rank is bounded, brackets each quantile; a second pass counts what lies below a bracket and each
    value inside it. So no task holds a group's values, only the distinct ones of a bracket (of a group of ``_SHARP`` values or
    fewer, all). Nulls are left out, and NaN is the largest value."""
    #: NaN sorts last in Spark, in the sketch as in comparisons.
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    around = [min(1.0, max(0.0, q + 4 * d / _SHARP)) for q in quantiles for d in (-1, 1)]
    sketch = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", around, _SHARP).alias("_a"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    held = _beside(rows, sketch, by)
    few = F.col("_n") <= _SHARP
    low, high = (lambda i: F.when(few, F.col("_lo")).otherwise(F.col("_a")[2 * i])), (lambda i: F.when(few, F.col("_hi")).otherwise(F.col("_a")[2 * i + 1]))
    marks = F.array(*[F.struct(F.lit(i).alias("i"), low(i).alias("low"), high(i).alias("high")) for i in range(len(quantiles))])
    below = [F.sum(F.when(F.col("_v") < low(i), 1).otherwise(0)).alias(f"_b{i}") for i in range(len(quantiles))]
    under = held.groupBy(*by).agg(F.first("_n").alias("_n"), *below)
    inside = held.select(*by, "_v", F.explode(F.filter(marks, lambda m: (m["low"] <= F.col("_v")) & (F.col("_v") <= m["high"]))).alias("_m"))
    counted = inside.groupBy(*by, F.col("_m.i").alias("_i"), "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*by, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = _beside(counted.withColumn("_to", F.sum("_c").over(upto)), under, by)
    out, start = [], F.element_at(F.array(*[F.col(f"_b{i}") for i in range(len(quantiles))]), F.col("_i") + 1)
    for i, q in enumerate(quantiles):
        rank = F.lit(q) * (F.col("_n") - 1)
        hit = lambda r: F.min(F.when((F.col("_i") == i) & (start + F.col("_to") > r), F.col("_v")))  # noqa: B023, E731
        first, last, part = hit(F.floor(rank)), hit(F.ceil(rank)), F.max(rank - F.floor(rank))
        out.append((first + F.when(part > 0, (last - first) * part).otherwise(F.lit(0.0))).alias(quantile_name(q)))
    return placed.groupBy(*by).agg(*out)


def _beside(rows: DataFrame, one: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows with the columns of their group's single row; without groups that row is broadcast. A null group is a group."""
    if not by:
        return rows.join(F.broadcast(one.withColumn("_one", F.lit(1))), F.col("_one") == F.lit(1)).drop("_one")
    right = one.withColumnsRenamed({c: f"_k_{c}" for c in by})
    match = [rows[c].eqNullSafe(right[f"_k_{c}"]) for c in by]
    return rows.join(right, match).drop(*[f"_k_{c}" for c in by])


def feature_stats(df: DataFrame, value: str, by: Sequence[str] = (), quantiles: Sequence[float] = QUANTILES, bounded: bool | None = None) -> DataFrame:
    """min, max, mean, population std, count and exact quantiles; under two rows std is 0 and quantiles are the mean.

    bounded: quantiles by ``selected_quantiles``; by default where groups aren't episodes and there are more than
    ``FEW_VALUES`` rows. Otherwise one pass, in which a group's distinct values are one task's. Both are exact."""
    if bounded is None:
        bounded = bool(quantiles) and EPISODE not in by and df.count() > FEW_VALUES
    if not quantiles or not bounded:
        return split_quantiles(df.groupBy(*by).agg(*aggregates(F.col(value), quantiles)), quantiles)
    own = df.groupBy(*by).agg(*aggregates(F.col(value), ()))
    names = [quantile_name(q) for q in quantiles]
    picked = selected_quantiles(df, value, by, quantiles)
    if by:
        right = picked.withColumnsRenamed({c: f"_k_{c}" for c in by})
        both = own.join(right, [own[c].eqNullSafe(right[f"_k_{c}"]) for c in by], "left").drop(*[f"_k_{c}" for c in by])
    else:
        both = own.withColumn("_one", F.lit(1)).join(F.broadcast(picked.withColumn("_one", F.lit(1))), "_one", "left").drop("_one")
    return both.withColumns({n: F.when(F.col("count") < 2, F.col("mean")).otherwise(F.col(n)) for n in names})


#: Moments are (n, mean, m2), m2 the sum of squared distances from the mean: E[x^2] - mean^2 loses all digits far from 0.
def _joined_moments(a: Column, b: Column) -> Column:
    """Two structs (n, mean, m2) as one."""
    n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
    share = b["n"] / n
    return F.when(a["n"] == 0, b).otherwise(F.struct(n.alias("n"), (a["mean"] + apart * share).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * share).alias("m2")))


def _pooled(parts: DataFrame, by: Sequence[str], n: str, mean: str) -> DataFrame:
    """parts with _mid, the mean of their group weighted by n. Distances from it are small whatever the values are."""
    mids = parts.groupBy(*by).agg((F.sum(F.col(mean) * F.col(n)) / F.nullif(F.sum(n), F.lit(0))).alias("_mid"))
    return _beside(parts, mids, by)


def moments(df: DataFrame, value: str, by: Sequence[str] = (), low: float = 0.0, high: float = 1.0, bins: int = 5000) -> DataFrame:
    """What statistics of parts merge by: n, mean, m2 (the sum of squared distances from the mean), min, max, and a histogram on a
    fixed range (a map of bin to count; values beyond the range are in its first or last bin). One pass: a bin's own
    moments, ``bins`` of them a group at most, are merged."""
    bin_ = F.least(F.greatest(F.floor((F.col(value) - low) / F.lit((high - low) / bins)), F.lit(0)), F.lit(bins - 1)).cast("int")
    x = F.col(value).cast("double")
    cells = df.where(F.col(value).isNotNull()).groupBy(*by, bin_.alias("_bin")).agg(F.count(value).alias("_c"), F.avg(x).alias("_m"), (F.var_pop(x) * F.count(value)).alias("_q"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    merged = F.aggregate(F.sort_array(F.collect_list(F.struct("_bin", F.struct(F.col("_c").cast("double").alias("n"), F.col("_m").alias("mean"), F.col("_q").alias("m2")).alias("of")))), F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")), lambda a, c: _joined_moments(a, c["of"]))
    whole = cells.groupBy(*by).agg(F.sum("_c").alias("n"), merged.alias("_of"), F.min("_lo").alias("min"), F.max("_hi").alias("max"), F.map_from_entries(F.collect_list(F.struct("_bin", "_c"))).alias("histogram"))
    return whole.select(*by, "n", "_of.mean", "_of.m2", "min", "max", "histogram")


def merged_moments(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The moments of several parts as those of the whole; any order of merging gives the same but for rounding."""
    apart = F.col("mean") - F.col("_mid")
    sums = _pooled(parts, by, "n", "mean").groupBy(*by).agg(F.sum("n").alias("n"), F.first("_mid").alias("mean"), F.sum(F.col("m2") + F.col("n") * apart * apart).alias("m2"), F.min("min").alias("min"), F.max("max").alias("max"))
    cells = parts.select(*by, F.explode("histogram").alias("_bin", "_c")).groupBy(*by, "_bin").agg(F.sum("_c").alias("_c"))
    maps = cells.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_bin", "_c"))).alias("histogram"))
    return _beside(sums, maps, by)


def moment_stats(parts: DataFrame) -> DataFrame:
    """std and count of moments beside their mean; fewer than two values raise, as there is nothing to estimate from."""
    enough = F.when(F.col("n") < 2, F.raise_error(F.lit("fewer than two values"))).otherwise(F.col("n"))
    return parts.withColumns({"std": F.sqrt(F.col("m2") / F.col("n")), "count": enough.cast("long")})


def vector_stats(df: DataFrame, vector: str, by: Sequence[str] = (), quantiles: Sequence[float] = QUANTILES, bounded: bool | None = None) -> DataFrame:
    """feature_stats for each dimension of an array column."""
    long = df.select(*by, F.posexplode(vector).alias("dim", "value"))
    return feature_stats(long, "value", [*by, "dim"], quantiles, bounded)


def row_stats(vector: str) -> list[Column]:
    """Statistics across the dimensions of one row, by array functions."""
    c, n = F.col(vector), F.size(vector)
    total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    mean = total / n
    var = F.aggregate(c, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    return [F.array_min(c).alias("min"), F.array_max(c).alias("max"), mean.alias("mean"), F.sqrt(var).alias("std"), n.cast("long").alias("count")]


def global_stats(df: DataFrame, vector: str) -> DataFrame:
    """Over all elements of all rows; count is the number of rows."""
    x = F.col("_x").cast("double")
    return df.select(F.posexplode_outer(vector).alias("_at", "_x")).agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count_if(F.coalesce("_at", F.lit(0)) == 0).alias("count"))


def pooled_stats(stats: DataFrame, by: Sequence[str] = (), quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Statistics of parts as those of the whole: least min, greatest max, count-weighted mean, pooled variance, and
    count-weighted averages of quantiles (which are not the quantiles of the whole; see feature_stats for those). A quantile
    that a part lacks (null) is null in the whole; one that the table lacks as a column is left out."""
    n, total = F.col("count"), F.nullif(F.sum("count"), F.lit(0))
    apart = F.col("mean") - F.col("_mid")
    return _pooled(stats, by, "count", "mean").groupBy(*by).agg(
        F.min("min").alias("min"), F.max("max").alias("max"), F.first("_mid").alias("mean"), F.sqrt(F.sum((F.col("std") * F.col("std") + apart * apart) * n) / total).alias("std"), F.sum("count").alias("count"),
        *[F.when(F.count(F.lit(1)) == F.count(quantile_name(q)), F.sum(F.col(quantile_name(q)) * n) / total).alias(quantile_name(q)) for q in quantiles if quantile_name(q) in stats.columns],
    )


def histogram_quantiles(df: DataFrame, value: str, by: Sequence[str] = (), quantiles: Sequence[float] = QUANTILES, bins: int = 5000) -> DataFrame:
    """Quantiles from an equal-width histogram of each group: the first bin whose cumulated count reaches q * n, linear
    inside the bin; in the first bin, its left edge. Two passes: range, then bins (no re-binning)."""
    key = list(by) or ["_all"]
    rows = df.withColumn("_all", F.lit(0)).select(*key, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    span = rows.groupBy(*key).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / bins).otherwise(F.lit(1.0))
    binned = rows.join(span, key).withColumn("_w", width).withColumn("_b", F.least(F.floor((F.col("_v") - F.col("_lo")) / F.col("_w")), F.lit(bins - 1)))
    counted = binned.groupBy(*key, "_lo", "_w", "_n", "_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cum = counted.withColumn("_cum", F.sum("_c").over(upto))
    out = []
    for q in quantiles:
        inside = F.col("_lo") + F.col("_w") * (F.col("_b") + (F.lit(q) * F.col("_n") - (F.col("_cum") - F.col("_c"))) / F.col("_c"))
        at = F.when(F.col("_b") == 0, F.col("_lo")).otherwise(inside)
        out.append(F.min_by(at, F.when(F.col("_cum") >= F.lit(q) * F.col("_n"), F.col("_b"))).alias(quantile_name(q)))
    return cum.groupBy(*key).agg(*out).drop("_all")


#: The finest bins of growing histograms are 2^-FINEST wide.
FINEST = 40


def _width(low: np.ndarray, high: np.ndarray, bins: int) -> np.ndarray:
    """The least exponent k at which low and high fall in bins of width 2^k fewer than ``bins`` apart."""
    k = np.full(low.shape, -FINEST, np.int64)
    with np.errstate(divide="ignore"):
        k = np.maximum(k, np.floor(np.log2(np.maximum(high - low, 2.0**-FINEST) / bins)).astype(np.int64) - 1)
    while True:
        wide = np.floor(np.ldexp(high, -k)) - np.floor(np.ldexp(low, -k)) >= bins
        if not wide.any():
            return k
        k = k + wide


def growing_histogram(df: DataFrame, value: str, by: Sequence[str] = (), bins: int = 1024) -> DataFrame:
    """A histogram of each group whose range is not known before: by, k, bin, n, where a bin is [bin, bin + 1) * 2^k and k is the least
    for which the group needs no more than ``bins`` of them (-FINEST at least).

    One scan: a task keeps ``bins`` counts a group and doubles the width when a value lies beyond them, two bins becoming
    one. Halving bin numbers twice is halving them at once, so merging is associative and the result the same however
    the rows were dealt. Nulls, NaN and infinities are left out. A task hands its counts on after ``HELD_GROUPS`` groups."""
    names = [f"_g{i}" for i in range(len(by))]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(by, names)], F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v) and abs(_v) < double('inf')")
    schema = T.StructType([*[rows.schema[n] for n in names], T.StructField("_k", T.LongType()), T.StructField("_b", T.LongType()), T.StructField("_n", T.LongType())])

    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            all_ = batch.column(len(names)).to_numpy(zero_copy_only=False)
            #: Rows by their group: the groups' columns are numbered, nulls too, and the numbers joined.
            number = np.zeros(len(all_), np.int64)
            for i in range(len(names)):
                codes = batch.column(i).dictionary_encode("encode")
                number = np.unique(number * len(codes.dictionary) + codes.indices.to_numpy(), return_inverse=True)[1]
            order = np.argsort(number, kind="stable")
            heads = np.flatnonzero(np.diff(number[order], prepend=-1))
            for lo, hi in zip(heads, [*heads[1:], len(order)]):
                v = all_[order[lo:hi]]
                key = tuple(batch.column(i)[int(order[lo])].as_py() for i in range(len(names)))
                k = int(_width(v.min(keepdims=True), v.max(keepdims=True), bins)[0])
                at, n = np.unique(np.floor(np.ldexp(v, -k)).astype(np.int64), return_counts=True)
                held[key] = _merged_bins(held[key], (k, at, n), bins) if key in held else (k, at, n)
            if len(held) > HELD_GROUPS:
                yield from _bin_rows(held, kinds)
                held = {}
        yield from _bin_rows(held, kinds)

    parts = rows.mapInArrow(run, schema)
    #: Bins of the widest k so far may still be too many together: the group's range tells the final one.
    ends = parts.groupBy(*names).agg(F.max("_k").alias("_w"), F.min(F.col("_b") * F.pow(F.lit(2.0), "_k")).alias("_lo"), F.max((F.col("_b") + 0.5) * F.pow(F.lit(2.0), "_k")).alias("_hi"))
    apart = lambda j: F.floor(F.col("_hi") / F.pow(F.lit(2.0), F.col("_w") + j)) - F.floor(F.col("_lo") / F.pow(F.lit(2.0), F.col("_w") + j))
    final = ends.withColumn("_f", F.col("_w") + F.coalesce(*[F.when(apart(j) < bins, F.lit(j)) for j in range(64)])).select(*names, "_f")
    both = _beside(parts, final, names)
    at = F.floor(F.col("_b") / F.pow(F.lit(2.0), F.col("_f") - F.col("_k")))
    out = both.groupBy(*names, F.col("_f").alias("k"), at.cast("long").alias("bin")).agg(F.sum("_n").alias("n"))
    return out.select(*[F.col(n).alias(c) for c, n in zip(by, names)], "k", "bin", "n")


HELD_GROUPS = 10_000


def _merged_bins(a: tuple, b: tuple, bins: int) -> tuple:
    """Two histograms (k, bins, counts) as one, as wide as their range asks."""
    k = max(a[0], b[0])
    while True:
        at = np.concatenate([a[1] >> min(k - a[0], 63), b[1] >> min(k - b[0], 63)])
        if at.max() - at.min() < bins:
            break
        k += 1
    uniq, back = np.unique(at, return_inverse=True)
    return k, uniq, np.bincount(back, np.concatenate([a[2], b[2]])).astype(np.int64)


def _bin_rows(held: dict, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    for key, (k, at, n) in held.items():
        yield pa.RecordBatch.from_arrays([*[pa.array([x] * len(at), f.type) for x, f in zip(key, kinds)], pa.array([k] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64())], schema=kinds)


def growing_quantiles(histogram: DataFrame, by: Sequence[str] = (), quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Quantiles from a growing histogram: off by less than a bin's width from the exact ones, which are linear between ranks.

    The two values beside q * (n - 1) are each placed in their own bin and joined by the rank's part: where few values lie far
    apart, as in a tail, a quantile is between bins."""
    upto = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cum = histogram.withColumn("_cum", F.sum("n").over(upto)).withColumn("_all", F.sum("n").over(Window.partitionBy(*by)))
    width = F.pow(F.lit(2.0), "k")
    out = []
    for q in quantiles:
        rank = F.lit(q) * (F.col("_all") - 1)
        at = lambda r: F.min_by(width * (F.col("bin") + (r - (F.col("_cum") - F.col("n")) + 0.5) / F.col("n")), F.when(F.col("_cum") > r, F.col("bin")))
        first, last, part = at(F.floor(rank)), at(F.ceil(rank)), F.max(rank - F.floor(rank))
        out.append((first + (last - first) * part).alias(quantile_name(q)))
    return cum.groupBy(*by).agg(*out, F.sum("n").alias("count"))


def episode_bounds(frames: DataFrame, index: str = "index") -> DataFrame:
    return frames.groupBy(EPISODE).agg(F.min(index).alias("from"), (F.max(index) + 1).alias("to"), F.count(F.lit(1)).alias("length"))


def episode_runs(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Runs of equal neighbouring values as [from, to): gaps and islands over the order."""
    w = Window.partitionBy(*by).orderBy(*order)
    starts = (~F.lag(value).over(w).eqNullSafe(F.col(value)) | F.lag(F.lit(1)).over(w).isNull()).cast("long")
    rows = df.withColumn("_at", F.row_number().over(w) - 1).withColumn("_new", starts).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return rows.groupBy(*by, "run").agg(F.first(value).alias(value), F.min("_at").alias("from"), (F.max("_at") + 1).alias("to"))


def rollout_metrics(frames: DataFrame, reward: str, success: str, done: str) -> DataFrame:
    """Each rollout up to one step past its first done: sum and max of reward, any success. A rollout without done is kept whole.

    Rewards after that count as 0, so the max is at least 0 where something is cut."""
    first = F.min(F.when(F.col(done), F.col(FRAME))).over(Window.partitionBy(EPISODE))
    rows = frames.withColumn("_in", F.coalesce(F.col(FRAME) <= first + 1, F.lit(True)))
    kept = lambda c: F.when(F.col("_in"), F.col(c)).otherwise(F.lit(0.0))
    return rows.groupBy(EPISODE).agg(F.sum(kept(reward)).alias("sum_reward"), F.max(kept(reward)).alias("max_reward"), F.max(F.when(F.col("_in"), F.col(success)).otherwise(False)).alias("success"))


def grouped_and_overall(df: DataFrame, group: str, values: Sequence[str], percent: Sequence[str] = ()) -> DataFrame:
    """Averages (NaN is no value) by group and overall, in one pass of grouping sets; the overall row has a null group."""
    clean = lambda c: F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")))
    return df.rollup(group).agg(F.count(F.lit(1)).alias("n"), *[clean(c).alias(f"avg_{c}") for c in values], *[(clean(c) * 100).alias(f"pc_{c}") for c in percent], F.grouping_id().cast("long").alias("level"))


def running_mean(value: str, weight: str, order: Sequence[str], by: Sequence[str]) -> Column:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(F.col(value) * F.col(weight)).over(w) / F.sum(weight).over(w)


def progress_counters(steps: Column, batch: int, frames_per_episode: float, total_frames: int) -> dict[str, Column]:
    """Samples, episodes and epochs that so many training steps have seen."""
    samples = steps * F.lit(batch)
    return {"samples": samples, "episodes": samples / F.lit(float(frames_per_episode)), "epochs": samples / F.lit(float(total_frames))}


def agreement(parts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Metadata of several datasets (a row for each): for each column how many values there are, and whether all are one."""
    counts = parts.agg(*[F.count_distinct(F.coalesce(F.to_json(F.struct(F.col(c))), F.lit("{}"))).alias(c) for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & (F.col(c) <= 1)
    return counts.withColumn("same", same)


def frame_rate(seconds: Column) -> Column:
    """(n - 1) / (last - first), 0 if the span is too short."""
    span = F.max(seconds) - F.min(seconds)
    return F.when(span > 1e-6, (F.count(seconds) - 1) / span).otherwise(F.lit(0.0))


def latency(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str], last: int = 100, q: float = 0.95) -> DataFrame:
    """Running quantile of the last values and the maximum so far; negative values are ignored."""
    rows = df.where(F.col(value) >= 0)
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("quantile", F.percentile(value, q).over(w.rowsBetween(1 - last, 0))).withColumn("max_ever", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def temporal_proportions(subtasks: DataFrame, episode: str = EPISODE, name: str = "name", duration: str = "duration", order: str = "start") -> DataFrame:
    """Mean share of each subtask over the episodes that have it, renormalised to 1. Repeated names: the last duration
    counts, the total counts all; episodes without duration are left out."""
    total = subtasks.groupBy(episode).agg(F.sum(duration).alias("_total")).where("_total > 0")
    one = subtasks.groupBy(episode, name).agg(F.max_by(duration, order).alias("_d"))
    mean = one.join(total, episode).groupBy(name).agg(F.avg(F.col("_d") / F.col("_total")).alias("_mean"))
    return mean.withColumn("proportion", F.col("_mean") / F.sum("_mean").over(Window.partitionBy())).drop("_mean")
