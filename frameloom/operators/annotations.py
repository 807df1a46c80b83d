"""Subtask annotations: five list columns in the episode table, and a row for each subtask outside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import clock_seconds
from .windows import EPISODE

#: The list columns, under a prefix (sparse or dense); without it they are the older form of sparse.
COLUMNS = ("subtask_names", "subtask_start_times", "subtask_end_times", "subtask_start_frames", "subtask_end_frames")


def column_of(columns: list[str], prefix: str, name: str) -> str | None:
    """The prefixed column, else the plain one, else None."""
    return next((c for c in (f"{prefix}_{name}", name) if c in columns), None)


def annotated(episodes: DataFrame, subtasks: DataFrame, fps: float, prefix: str = "sparse") -> DataFrame:
    """Episodes with their subtasks (EPISODE, position, name, start and end as MM:SS) as list columns; null lists for an
    episode without any. Under ``sparse`` the plain columns follow, and keep their values where an episode has none."""
    start, end = clock_seconds(F.col("start")).cast("double"), clock_seconds(F.col("end")).cast("double")
    frame = lambda seconds: F.floor(seconds * F.lit(float(fps))).cast("long")
    fields = F.struct("position", F.col("name").alias("_0"), start.alias("_1"), end.alias("_2"), frame(start).alias("_3"), frame(end).alias("_4"))
    lists = subtasks.groupBy(EPISODE).agg(F.array_sort(F.collect_list(fields)).alias("_s"))
    rows = episodes.drop(*[f"{prefix}_{c}" for c in COLUMNS]).join(lists, EPISODE, "left")
    cell = lambda i: F.transform("_s", lambda s: s[f"_{i}"])
    out = {f"{prefix}_{c}": cell(i) for i, c in enumerate(COLUMNS)}
    if prefix == "sparse":
        out |= {c: F.coalesce(cell(i), F.col(c)) if c in episodes.columns else cell(i) for i, c in enumerate(COLUMNS)}
    return rows.withColumns(out).drop("_s")


def clock(seconds: Column) -> Column:
    """Whole seconds as MM:SS."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60)


def subtasks_of(episodes: DataFrame, prefix: str = "sparse") -> DataFrame:
    """A row for each subtask: EPISODE, position, name, start, end (MM:SS). Plain columns stand in for ``sparse``; no
    columns give no rows."""
    names = f"{prefix}_{COLUMNS[0]}"
    if names in episodes.columns:
        own = [f"{prefix}_{c}" for c in COLUMNS[:3]]
    elif prefix == "sparse" and COLUMNS[0] in episodes.columns:
        own = list(COLUMNS[:3])
    else:
        return episodes.select(EPISODE, F.lit(0).alias("position"), F.lit("").alias("name"), F.lit("").alias("start"), F.lit("").alias("end")).limit(0)
    each = episodes.select(EPISODE, F.posexplode(F.arrays_zip(*[F.col(c).alias(a) for c, a in zip(own, ("name", "s", "e"))])).alias("position", "_z"))
    return each.select(EPISODE, "position", F.col("_z.name").alias("name"), clock(F.col("_z.s")).alias("start"), clock(F.col("_z.e")).alias("end"))


def one_stage(episodes: DataFrame, duration: Column, name: str = "task") -> DataFrame:
    """One stage for each episode, as long as the episode."""
    return episodes.select(EPISODE, F.lit(0).alias("position"), F.lit(name).alias("name"), F.lit("00:00").alias("start"), clock(duration).alias("end"))


def stage_lists(episodes: DataFrame, prefix: str) -> Column:
    """An array of (start, end, name) in frames from whichever columns the episode table has; null without."""
    own = [column_of(episodes.columns, prefix, c) for c in (COLUMNS[3], COLUMNS[4], COLUMNS[0])]
    if None in own:
        return F.lit(None)
    return F.arrays_zip(*[F.col(c).alias(a) for c, a in zip(own, ("start", "end", "name"))])
