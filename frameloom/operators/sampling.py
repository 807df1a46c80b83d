"""Episode-aware sampling and weights; all choices are functions of keys and seeds, so reruns agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import EPISODE, FRAME, whole


def spread(key: Column, seed: int = 0, mod: int = 1_000_003) -> Column:
    """An engine-neutral hash of an integer key, in [0, mod)."""
    return F.pmod((key.cast("long") + seed) * F.lit(2654435761), F.lit(mod))


def rewind_steps(key: Column, most: int, seed: int = 0) -> Column:
    """A number of steps in 1 .. most by a hash of the key."""
    return spread(key, seed) % most + 1


def through_buffer(rows: DataFrame, order: str, size: int, seed: int) -> DataFrame:
    """The order in which a shuffle buffer of ``size`` rows gives a stream's rows: rows may come early by any number, late only
    by what the buffer holds. Adds shuffle_key; rows of a stretch of ``size`` are dealt over it and the next."""
    late = spread(F.col(order), seed, 2 * size)
    return rows.withColumn("shuffle_key", F.col(order) + late).orderBy("shuffle_key", order)


def sharded_order(rows: DataFrame, index: str, shards: int) -> DataFrame:
    """Adds shard and place: a dense index dealt to the shards in turn, and the row's place in its shard."""
    return rows.withColumn("shard", F.pmod(F.col(index), F.lit(shards))).withColumn("place", F.floor(F.col(index) / shards).cast("long"))


def buffer_shuffled(rows: DataFrame, index: str, shards: int, files: int, size: int, seed: int) -> DataFrame:
    """The order in which a streaming reader gives a dataset's rows: shards, as many as asked or as there are ``files``, are read
    side by side, and each row goes through its shard's buffer of ``size`` rows. A full buffer puts the new row in a slot drawn
    by the seed and gives out the row that was there; at the end the rest comes in an order drawn by the seed.
    Adds shard, place and given, the row's place in what its shard gives. No row comes more than size places early (given >=
    place - size + 1); how late one comes is drawn.

    Which row a draw gives out is the last one that was put in the same slot, so a row goes out at the next draw of its
    slot: a window by (shard, slot), in which no task holds a shard and no buffer is kept."""
    placed = sharded_order(rows, index, min(shards, files))
    drawn = spread(F.col("place") * 31 + F.col("shard"), seed)
    slotted = placed.withColumn("_draw", drawn).withColumn("_slot", F.when(F.col("place") < size, F.col("place")).otherwise(F.col("_draw") % size))
    out_at = slotted.withColumn("_out", F.lead("place").over(Window.partitionBy("shard", "_slot").orderBy("place")))
    #: What is left at the end, at most ``size`` rows a shard, follows all that went out before.
    counts = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("_n"))
    rest = Window.partitionBy("shard", F.col("_out").isNull()).orderBy("_draw", "place")
    left = out_at.where("_out is null").withColumn("_r", F.row_number().over(rest) - 1).join(counts, "shard")
    gone = out_at.where("_out is not null").withColumn("given", F.col("_out") - size)
    last = left.withColumn("given", (F.greatest(F.col("_n") - size, F.lit(0)) + F.col("_r")).cast("long"))
    columns = [*rows.columns, "shard", "place", "given"]
    return gone.select(*columns).unionByName(last.select(*columns))


def kept_frames(frames: DataFrame, drop_first: int = 0, drop_last: int = 0, episodes: Sequence[int] | None = None) -> DataFrame:
    """Frames in [drop_first, length - drop_last) of the chosen episodes; too short episodes give none."""
    rows = frames if episodes is None else frames.where(F.col(EPISODE).isin(list(episodes)))
    n = F.count(F.lit(1)).over(whole())
    return rows.withColumn("_n", n).where((F.col(FRAME) >= drop_first) & (F.col(FRAME) < F.col("_n") - drop_last)).drop("_n")


def sampler_weights(offline: DataFrame, online: DataFrame | None = None, ratio: float | None = None, offline_drop: int = 0, online_drop: int = 0, strict: bool = False) -> DataFrame:
    """Weight of each frame: each source's mass (1 - ratio, ratio) spread over its frames that aren't dropped, then
    normalised. If all weights are 0 they are uniform (as without an online source, whose mass then is 0); strict gives
    the offline source all mass instead."""
    if (online is None) != (ratio is None):
        raise ValueError("online and ratio belong together")
    mass = {0: (1.0 if strict else 0.0) if ratio is None else 1 - ratio, 1: ratio or 0.0}
    parts = []
    for i, (part, drop) in enumerate(((offline, offline_drop), (online, online_drop))):
        if part is not None:
            n = F.count(F.lit(1)).over(whole())
            parts.append(part.select(F.lit(i).alias("source"), EPISODE, FRAME, (F.col(FRAME) < n - drop).alias("_in")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    kept = rows.groupBy("source").agg(F.sum(F.col("_in").cast("long")).alias("_k"), F.count(F.lit(1)).alias("_n"))
    share = F.when(F.col("source") == 0, F.lit(mass[0])).otherwise(F.lit(mass[1]))
    sums = kept.agg(F.sum(F.when(F.col("_k") > 0, share).otherwise(0.0)).alias("_mass"), F.sum("_n").alias("_all")).first()
    total, count = sums["_mass"] or 0.0, sums["_all"] or 0
    raw = F.when(F.col("_in"), share / F.col("_k")).otherwise(F.lit(0.0))
    weight = raw / F.lit(total) if total else F.lit(1.0 / count if count else 0.0)
    return rows.join(kept.drop("_n"), "source").select("source", EPISODE, FRAME, weight.alias("weight"))


def sample_count(n: int, least: int = 100, most: int = 10_000, power: float = 0.75) -> int:
    return max(min(least, n), min(int(n**power), most))


def sample_positions(length: Column) -> Column:
    """Evenly spaced positions 0 .. length - 1, rounded half to even, as many as sample_count says; none of an empty length."""
    k = F.greatest(F.least(F.lit(100), length), F.least(F.floor(F.pow(length, F.lit(0.75))), F.lit(10_000))).cast("int")
    step = (length - 1) / F.nullif(k - 1, F.lit(0))
    #: A sequence from 0 to -1 counts down, so the first k are taken; a condition around the positions would double their time.
    return F.transform(F.slice(F.sequence(F.lit(0), k - 1), F.lit(1), k), lambda i: F.rint(i * F.coalesce(step, F.lit(0.0))).cast("long"))


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """A reproducible shuffle: order by a hash of the key."""
    return rows.withColumn("shuffle_key", spread(F.col(key), seed)).orderBy("shuffle_key", key)


def draw_with_replacement(rows: DataFrame, index: str, total: int, draws: int, seed: int) -> DataFrame:
    """``draws`` uniform draws with replacement, by joining hashed draw numbers with a gapless index."""
    spark = rows.sparkSession
    picks = spark.range(draws).select(F.col("id").alias("draw"), F.pmod((F.col("id") + seed) * F.lit(2654435761) + F.floor(F.col("id") / 7), F.lit(total)).alias(index))
    return picks.join(rows, index)


def buffer_batch(rows: DataFrame, index: str, batch: int, seed: int, capacity: int | None = None, shared_next: bool = False) -> DataFrame:
    """A batch of a buffer (gapless index), drawn with replacement, no larger than what the buffer holds. With ``shared_next`` a
    transition's next state is the next row's, so the newest row of a buffer that isn't full can't be drawn."""
    held = rows.count()
    if not held:
        raise ValueError("the buffer is empty")
    open_end = shared_next and (capacity is None or held < capacity)
    return draw_with_replacement(rows, index, max(1, held - 1) if open_end else held, min(batch, held), seed)


def mixed_batch(online: DataFrame, offline: DataFrame) -> DataFrame:
    """Two batches as one: columns that one of them lacks are null there; ``origin`` tells them apart."""
    return online.withColumn("origin", F.lit("online")).unionByName(offline.withColumn("origin", F.lit("offline")), allowMissingColumns=True)


def episode_fraction(frames: DataFrame, fraction: float, seed: int) -> DataFrame:
    """max(1, int(n * fraction)) frames of each episode without replacement, those with the least hash."""
    order = Window.partitionBy(EPISODE).orderBy(spread(F.col(FRAME) * 7919 + F.col(EPISODE), seed), FRAME)
    n = F.count(F.lit(1)).over(Window.partitionBy(EPISODE))
    return frames.withColumn("_r", F.row_number().over(order)).withColumn("_k", F.greatest(F.lit(1), F.floor(n * fraction))).where("_r <= _k").drop("_r", "_k")


def weighted_subset(rows: DataFrame, weight: str, key: str, k: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """k rows of each group without replacement, with chances by weight: the least of -ln(u) / w."""
    u = (spread(F.col(key), seed) + 1) / F.lit(1_000_004.0)
    order = Window.partitionBy(*by).orderBy(-F.log(u) / F.col(weight), key)
    return rows.where(F.col(weight) > 0).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def batch_weights(weight: str, by: Sequence[str], epsilon: float = 1e-6) -> Column:
    """Weights of a batch, scaled to sum to its size."""
    w = Window.partitionBy(*by)
    return F.col(weight) * F.count(F.lit(1)).over(w) / (F.sum(weight).over(w) + F.lit(epsilon))
