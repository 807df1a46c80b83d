"""Buffers and transitions: last-N by sequence, admission, episode cuts, action timing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .windows import EPISODE, FRAME


def last_n(rows: DataFrame, sequence: str, capacity: int) -> DataFrame:
    """What a ring buffer of that capacity holds after all rows: those with the greatest sequence numbers, oldest first."""
    return rows.orderBy(F.col(sequence).desc()).limit(capacity).orderBy(sequence)


def last_n_by(rows: DataFrame, by: Sequence[str], sequence: str, capacity: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col(sequence).desc())
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= capacity).drop("_r")


def appended(held: DataFrame, incoming: DataFrame, index: str = "index", episode: str = EPISODE) -> DataFrame:
    """Incoming rows numbered to follow what is held."""
    last = held.agg(F.max(index).alias("i"), F.max(episode).alias("e")).first()
    i, e = (last["i"] + 1 if last["i"] is not None else 0), (last["e"] + 1 if last["e"] is not None else 0)
    return held.unionByName(incoming.withColumn(index, F.col(index) + i).withColumn(episode, F.col(episode) + e))


def episodes_from_flags(rows: DataFrame, sequence: str, end: Column, by: Sequence[str] = ()) -> DataFrame:
    """Cut a sequence into episodes after each end flag: episode_index, frame_index."""
    w = Window.partitionBy(*by).orderBy(sequence)
    out = rows.withColumn("_end", end.cast("long")).withColumn(EPISODE, F.coalesce(F.sum("_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.withColumn(FRAME, F.row_number().over(Window.partitionBy(*by, EPISODE).orderBy(sequence)).cast("long") - 1).drop("_end")


def cumulative_done(frames: DataFrame, done: Column, most: int) -> DataFrame:
    """done stays true once set, and is forced at the last step."""
    so_far = Window.partitionBy(EPISODE).orderBy(FRAME).rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("done", F.max(done).over(so_far) | (F.col(FRAME) + 1 >= most))


def timed_actions(chunks: DataFrame, actions: str, start_time: str, start_step: str, dt: float) -> DataFrame:
    """One row for each action of a chunk, under the same name: timestamp t0 + i * dt and timestep i0 + i."""
    rest = [c for c in chunks.columns if c != actions]
    rows = chunks.select(*rest, F.posexplode(actions).alias("_i", actions))
    return rows.withColumn("timestamp", F.col(start_time) + F.col("_i") * F.lit(dt)).withColumn("timestep", F.col(start_step) + F.col("_i")).drop("_i")


def latest(rows: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """The newest row of each key, as a queue of size one keeps it."""
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rows.columns), order).alias("_m")).select("_m.*")


def trimmed_queue(actions: Column, delay: int) -> Column:
    """A replaced queue: what is left of a new chunk after the delay."""
    return F.slice(actions, delay + 1, F.greatest(F.size(actions) - delay, F.lit(0)))


def appended_queue(left: Column, used: int, actions: Column) -> Column:
    return F.concat(F.slice(left, used + 1, F.greatest(F.size(left) - used, F.lit(0))), actions)


def without_nan(rows: DataFrame, vectors: Sequence[str]) -> DataFrame:
    """Transitions without a NaN in any of the vectors; a null vector has none."""
    clean = F.lit(True)
    for v in vectors:
        clean = clean & ~F.coalesce(F.exists(F.col(f"`{v}`"), lambda x: F.isnan(x)), F.lit(False))
    return rows.where(clean)


def admit(rows: DataFrame, by: str, timestep: str, vector: str, tolerance: float, must_go: str | None = None, order: str | None = None) -> DataFrame:
    """Observations that would be processed: the first, forced ones, and those whose timestep is unseen and whose state
    is not within the tolerance of the last admitted one.

    A fold over rows sorted by (key, order), which streams: it holds one key's last admitted state, not its rows. In the
    order of timesteps a seen one can only be the last admitted; in another order the key's admitted timesteps are held."""
    own = order or timestep
    schema = T.StructType([*rows.schema.fields, T.StructField("admitted", T.BooleanType())])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, seen, last = None, set(), None
        for pdf in batches:
            out = []
            for k, step, v, force in zip(pdf[by], pdf[timestep], pdf[vector], pdf[must_go] if must_go else [False] * len(pdf)):
                if last is None or k != key:
                    key, seen, last = k, set(), None
                ok = bool(force) or last is None or (step not in seen and sum((a - b) ** 2 for a, b in zip(v, last)) ** 0.5 >= tolerance)
                if ok:
                    last = v
                    if own == timestep:
                        seen.clear()
                    seen.add(step)
                out.append(ok)
            yield pdf.assign(admitted=out)

    return rows.repartition(by).sortWithinPartitions(by, own, timestep).mapInPandas(fold, schema)
