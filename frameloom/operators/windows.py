"""Temporal windows inside episodes: one sort by (episode, frame), never across episodes.

Frames are rows with ``episode_index`` and ``frame_index`` (0, 1, ... in each episode, without gaps).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPISODE, FRAME = "episode_index", "frame_index"


def in_order(episode: str = EPISODE, frame: str = FRAME):
    return Window.partitionBy(episode).orderBy(frame)


def whole(episode: str = EPISODE, frame: str = FRAME):
    return in_order(episode, frame).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def delta_indices(deltas: Sequence[float], fps: float, tolerance: float = 1e-4) -> list[int]:
    """Offsets in seconds as frame counts, rounded half to even; each must be a multiple of 1 / fps within the tolerance."""
    out = []
    for d in deltas:
        k = round(d * fps)
        if abs(d * fps - k) / fps > tolerance:
            raise ValueError(f"{d} s is no multiple of 1/{fps} s within {tolerance}")
        out.append(k)
    return out


def _named(name: str) -> Column:
    """A column of the whole name, dots included."""
    return F.col(f"`{name}`")


def _shifted(c: Column, k: int, w) -> Column:
    return F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w) if k else c


def clamped(name: str, k: int, length: Column | None = None) -> Column:
    """The value k frames on, or that of the episode's first or last frame where there is none; nulls inside stay null."""
    w, all_ = in_order(), whole()
    n = length if length is not None else F.count(F.lit(1)).over(all_)
    c = _named(name)
    if k == 0:
        return c
    edge = F.first(c).over(all_) if k < 0 else F.last(c).over(all_)
    return F.when((F.col(FRAME) + k).between(0, n - 1), _shifted(c, k, w)).otherwise(edge)


def is_pad(k: int) -> Column:
    n = F.count(F.lit(1)).over(whole())
    return ~(F.col(FRAME) + k).between(0, n - 1)


def _suffix(k: int) -> str:
    return f"m{-k}" if k < 0 else f"p{k}"


def delta_window(frames: DataFrame, windows: dict[str, Sequence[int]]) -> DataFrame:
    """For each feature and offset: <feature>_<m|p><k> and <feature>_<m|p><k>_is_pad. One shuffle and sort for all of them."""
    out = {}
    for name, ks in windows.items():
        for k in ks:
            out[f"{name}_{_suffix(k)}"] = clamped(name, k)
            out[f"{name}_{_suffix(k)}_is_pad"] = is_pad(k)
    return frames.withColumns(out)


def delta_arrays(frames: DataFrame, name: str, ks: Sequence[int], halo: int | None = None) -> DataFrame:
    """The window as arrays (<name>_window, <name>_is_pad), gathered from the frames around each; for long offset lists."""
    low, high = min(0, *ks), max(0, *ks)
    around = in_order().rowsBetween(low, high)
    n = F.count(F.lit(1)).over(whole())
    #: Values around a frame, as structs so that nulls keep their place.
    values = F.collect_list(F.struct(F.col(FRAME).alias("at"), F.col(name).alias("v"))).over(around)
    frames = frames.withColumn("_n", n).withColumn("_around", values)
    at = lambda k: F.greatest(F.lit(0), F.least(F.col("_n") - 1, F.col(FRAME) + k))
    gather = lambda k: F.element_at("_around", (at(k) - F.greatest(F.col(FRAME) + low, F.lit(0)) + 1).cast("int"))["v"]
    return frames.withColumns({f"{name}_window": F.transform(F.array(*[F.lit(k) for k in ks]), gather), f"{name}_is_pad": F.transform(F.array(*[F.lit(k) for k in ks]), lambda k: (F.col(FRAME) + k < 0) | (F.col(FRAME) + k >= F.col("_n")))}).drop("_n", "_around")


def repeated_window(frames: DataFrame, name: str, ks: Sequence[int]) -> DataFrame:
    """The streaming reader's rule: offsets are tried from the nearest on, each side apart; one that is outside the episode repeats the last value fetched."""
    n = F.count(F.lit(1)).over(whole())
    out = {}
    for side in (sorted(k for k in ks if k <= 0)[::-1], sorted(k for k in ks if k > 0)):
        last = F.col(name)
        for k in side:
            inside = (F.col(FRAME) + k).between(0, n - 1)
            last = F.when(inside, _shifted(F.col(name), k, in_order())).otherwise(last)
            out[f"{name}_{_suffix(k)}"] = last
            out[f"{name}_{_suffix(k)}_is_pad"] = ~inside
    return frames.withColumns(out)


def chunks(frames: DataFrame, name: str, length: int) -> DataFrame:
    """All full windows of ``length`` frames: <name>_chunk; episodes that are shorter give none."""
    ahead = in_order().rowsBetween(0, length - 1)
    return frames.withColumn(f"{name}_chunk", F.collect_list(name).over(ahead)).where(F.size(f"{name}_chunk") == length)


def velocity(name: str, dt: float) -> Column:
    """(x - previous x) / dt, 0 in the first frame; for a vector, by dimension."""
    c = _named(name)
    return F.coalesce((c - F.lag(c).over(in_order())) / F.lit(dt), F.lit(0.0))


def vector_velocity(name: str, dt: float) -> Column:
    c = _named(name)
    return F.zip_with(c, F.coalesce(F.lag(c).over(in_order()), c), lambda a, b: (a - b) / F.lit(dt))


def time_limit(limit: int, truncated: Column) -> Column:
    return (F.col(FRAME) + 1 >= limit) | truncated


def is_last() -> Column:
    """The last frame of its episode: done is inferred there."""
    return F.lead(FRAME).over(in_order()).isNull()


def next_state(name: str) -> Column:
    """The next frame's value; the last frame's is its own."""
    return F.when(is_last(), _named(name)).otherwise(F.lead(_named(name)).over(in_order()))


def rising_edge(flag: Column) -> Column:
    return flag & ~F.coalesce(F.lag(flag).over(in_order()), F.lit(False))


def latch(frames: DataFrame, name: str, flag: Column, to: str) -> DataFrame:
    so_far = in_order().rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("_edge", rising_edge(flag)).withColumn(to, F.last(F.when(F.col("_edge"), F.col(name)), ignorenulls=True).over(so_far)).withColumnRenamed("_edge", f"{to}_edge")


def jump(name: str, most: float, strict: bool = False) -> Column:
    """Whether the value moved more than ``most`` since the frame before; strict: raise."""
    flag = F.coalesce(F.abs(F.col(name) - F.lag(name).over(in_order())) > most, F.lit(False))
    return F.when(flag, F.raise_error(F.lit(f"{name} jumps by more than {most}")).cast("boolean")).otherwise(flag) if strict else flag


def interpolated(name: str) -> Column:
    """Nulls and NaN filled linearly between the finite values around, flat beyond them; no values: null."""
    w = in_order()
    v = F.when(~F.isnan(name), F.col(name))
    known = F.when(v.isNotNull(), F.struct(F.col(FRAME).alias("at"), v.alias("v")))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    line = before["v"] + (after["v"] - before["v"]) * (F.col(FRAME) - before["at"]) / F.nullif(after["at"] - before["at"], F.lit(0))
    return F.when(v.isNotNull(), v).when(before.isNull(), after["v"]).when(after.isNull(), before["v"]).otherwise(line)


def progress_delta(name: str, ahead: int) -> Column:
    """Progress ``ahead`` frames on (at most the last frame) minus progress now; null if either is unknown."""
    v = F.when(~F.isnan(name), F.col(name))
    later = F.when(F.lead(FRAME, ahead).over(in_order()).isNotNull(), F.lead(v, ahead).over(in_order())).otherwise(F.last(v).over(whole()))
    return later - v


def strided(half: int, stride: int) -> list[int]:
    """Symmetric offsets -half*stride .. half*stride."""
    return [i * stride for i in range(-half, half + 1)]


def gap_order(gap: int) -> list[Column]:
    return [F.col(FRAME) % gap, F.col(FRAME)]


def rewind(frames: DataFrame, name: str, steps: int) -> DataFrame:
    """The ``steps`` frames before each, newest first (reversed history), clamped at the first."""
    return delta_arrays(frames, name, [-k for k in range(1, steps + 1)])


#: Prefix sums over an integer key are made by buckets of so many key values, so a task has no more rows of a table with one row a key.
SPAN = 1 << 16


def prefix_sums(table: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """Exclusive prefix sums (name: expression to sum) in the order of an integer key.

    Buckets of the key are summed apart; only their totals, a row for ``SPAN`` values, go through one window. A null key is first."""
    bucket = F.coalesce(F.floor(F.col(key) / SPAN), F.lit(-(1 << 62)))
    rows = table.withColumn("_bucket", bucket)
    totals = rows.groupBy("_bucket").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select("_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_h_{n}") for n in sums])
    within = Window.partitionBy("_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()})
    return local.join(heads, "_bucket").withColumns({n: F.col(n) + F.col(f"_h_{n}") for n in sums}).drop("_bucket", *[f"_h_{n}" for n in sums])


def prefix_bounds(episodes: DataFrame, length: str = "length", episode: str = EPISODE) -> DataFrame:
    """dataset_from_index and dataset_to_index by prefix sum over the episode table (one row an episode)."""
    out = prefix_sums(episodes, episode, {"dataset_from_index": F.col(length)})
    return out.withColumn("dataset_to_index", F.col("dataset_from_index") + F.col(length)).select(*episodes.columns, "dataset_from_index", "dataset_to_index")


def ensemble(predictions: DataFrame, coefficient: float, target: str = "target_frame", made: str = FRAME, value: str = "prediction") -> DataFrame:
    """Predictions for one target step, averaged with weights exp(-c * i), i = 0 the oldest."""
    age = Window.partitionBy(EPISODE, target).orderBy(made)
    weight = F.exp(F.lit(-coefficient) * (F.row_number().over(age) - 1))
    return predictions.withColumn("_w", weight).groupBy(EPISODE, target).agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias(value), F.count(F.lit(1)).alias("n_predictions"))


def target_frames(frames: DataFrame, half: int, gap: int, rewinds: Column, most: int) -> DataFrame:
    """For each sample the frames that its targets are made for: (slot, at). Slots 0 .. 2 * half are the observations around it,
    clamped to the episode; the next ones go back from the earliest observation by ``gap``, as many as ``rewinds`` asks and the
    history before that observation allows, ``most`` at most."""
    n = F.count(F.lit(1)).over(whole())
    first = F.col(FRAME) - half * gap
    back = F.greatest(F.lit(0), F.least(rewinds, F.lit(most), F.floor(first / gap))).cast("int")
    around = F.transform(F.array(*[F.lit(k) for k in strided(half, gap)]), lambda k, i: F.struct(i.cast("int").alias("slot"), F.greatest(F.lit(0), F.least(F.col("_n") - 1, F.col(FRAME) + k)).cast("long").alias("at")))
    behind = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda j: F.struct((j + 2 * half).cast("int").alias("slot"), F.greatest(F.lit(0), first - j * gap).cast("long").alias("at")))
    behind = F.slice(behind, F.lit(1), F.when(first > 0, back).otherwise(F.lit(0)))
    return frames.withColumn("_n", n).select(*frames.columns, F.inline(F.concat(around, behind)))


def padded_row(slots: int, slot: str, value: str) -> Column:
    """An aggregate: values by slot as one array, 0 where a slot has none."""
    cells = F.map_from_entries(F.collect_list(F.struct(slot, value)))
    return F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.coalesce(F.try_element_at(cells, i), F.lit(0.0)))


def prefix_weights(schedule: str, start: int, end: int, total: int) -> list[float]:
    """How firmly each step of a new chunk holds to the old one: 1 before start, 0 from end on, between them by schedule."""
    start = min(start, end)
    if schedule == "zeros":
        return [1.0 if i < start else 0.0 for i in range(total)]
    if schedule == "ones":
        return [1.0 if i < end else 0.0 for i in range(total)]
    if schedule not in ("linear", "exp"):
        raise ValueError(schedule)
    out = []
    for i in range(total):
        n = min(end, total) - start
        x = 1.0 if i < start else 0.0 if i >= end else 1 - (i - start + 1) / (n + 1)
        out.append(x * math.expm1(x) / (math.e - 1) if schedule == "exp" else x)
    return out
