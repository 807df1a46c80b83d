"""Evaluation rollouts as dataset frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import EPISODE, FRAME, prefix_sums


def compiled(rollouts: DataFrame, done: str, observations: Sequence[str], fps: float, first_episode: int = 0, first_index: int = 0) -> DataFrame:
    """Frames of each rollout up to the one observation after its first done, whose other columns are those of the frame
    before, frame number included. The last row of a rollout is an observation alone; a rollout without done is done in the
    row before it. Adds timestamp (frame / fps) and index; episodes are counted from ``first_episode``."""
    w = Window.partitionBy(EPISODE)
    end = F.least(F.coalesce(F.min(F.when(F.col(done), F.col(FRAME))).over(w), F.max(FRAME).over(w) - 1), F.max(FRAME).over(w) - 1)
    rows = rollouts.withColumn("_end", end).where(F.col(FRAME) <= F.col("_end") + 1)
    before = Window.partitionBy(EPISODE).orderBy(FRAME)
    others = [c for c in rollouts.columns if c not in (EPISODE, FRAME, *observations)]
    #: All rows from one sort: the row after the end takes the others from the row before.
    late = F.col(FRAME) > F.col("_end")
    rows = rows.withColumns({c: F.when(late, F.lag(c).over(before)).otherwise(F.col(c)) for c in others}).withColumn("_at", F.col(FRAME)).withColumn(FRAME, F.least(F.col(FRAME), F.col("_end")))
    bounds = prefix_sums(rows.groupBy(EPISODE).agg(F.count(F.lit(1)).alias("_n")), EPISODE, {"_from": F.col("_n"), "_rank": F.lit(1).cast("long")}).select(EPISODE, "_from", "_rank")
    out = rows.join(bounds, EPISODE).withColumn("timestamp", F.col(FRAME) / F.lit(float(fps))).withColumn("index", F.col("_from") + F.col("_at") + first_index).withColumn(EPISODE, F.col("_rank") + first_episode)
    return out.drop("_end", "_at", "_from", "_rank")
