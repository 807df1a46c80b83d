"""Dataset edits as copy-on-write: new frames, new episode numbers, new indices, all lazy.

Global indices are ``episode start + frame``; starts are prefix sums over the episode table by buckets of episodes, so neither
a frame window nor an episode window spans the dataset.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import fsum

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .windows import EPISODE, FRAME, prefix_bounds, prefix_sums


def _lengths(frames: DataFrame) -> DataFrame:
    return frames.groupBy(EPISODE).agg(F.count(F.lit(1)).alias("length"))


def episodes_of(frames: DataFrame) -> DataFrame:
    return prefix_bounds(_lengths(frames))


def _ranked(frames: DataFrame) -> DataFrame:
    """EPISODE, its rank among the episodes (_new) and the frames before it (_from)."""
    return prefix_sums(_lengths(frames), EPISODE, {"_new": F.lit(1).cast("long"), "_from": F.col("length")}).select(EPISODE, "_new", "_from")


def renumbered(frames: DataFrame) -> DataFrame:
    """Episodes numbered 0, 1, ... in order, and index from 0 without gaps."""
    out = frames.drop("index").join(_ranked(frames), EPISODE)
    return out.withColumn(EPISODE, F.col("_new")).withColumn("index", F.col("_from") + F.col(FRAME)).drop("_new", "_from")


def delete_episodes(frames: DataFrame, episodes: Sequence[int]) -> DataFrame:
    if not episodes:
        raise ValueError("no episodes to delete")
    return renumbered(frames.where(~F.col(EPISODE).isin(list(episodes))))


def check_episodes(frames: DataFrame, episodes: Sequence[int]) -> None:
    """Raise for episodes that aren't there, or if all would go."""
    have = {r[0] for r in frames.where(F.col(EPISODE).isin(list(episodes))).select(EPISODE).distinct().collect()}
    if absent := set(episodes) - have:
        raise ValueError(f"no such episodes: {sorted(absent)}")
    if frames.where(~F.col(EPISODE).isin(list(episodes))).isEmpty():
        raise ValueError("all episodes would be deleted")


def split_bounds(total: int, fractions: dict[str, float]) -> dict[str, tuple[int, int]]:
    """Ranges of episode ranks from the cumulated whole parts of the fractions; the last one's range is open to the total.
    Names whose whole part is 0 have no range."""
    if fsum(fractions.values()) > 1 + 1e-9:
        raise ValueError("fractions sum to more than 1")
    whole = pd.Series({name: int(total * f) for name, f in fractions.items()}, dtype="int64")
    table = pd.DataFrame({"low": whole.cumsum() - whole, "high": whole.cumsum()})
    table.iloc[-1:, 1] = total
    return {name: (int(low), int(high)) for name, low, high in table[whole > 0].itertuples()}


def labelled_split(frames: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """The frames with ``split``, each split renumbered from 0: one pass over the episode ranks, one join."""
    ranked = _ranked(frames)
    bounds = split_bounds(ranked.count(), fractions)
    label, first = F.lit(None).cast("string"), F.lit(None).cast("long")
    for name, (low, high) in bounds.items():
        inside = F.col("_new").between(low, high - 1)
        label, first = F.when(inside, name).otherwise(label), F.when(inside, low).otherwise(first)
    placed = ranked.withColumn("split", label).where("split is not null").withColumn("_low", first)
    heads = placed.groupBy("split").agg(F.min("_from").alias("_head"))  # a row for each split
    placed = placed.join(heads, "split").select(EPISODE, "split", (F.col("_new") - F.col("_low")).alias("_new"), (F.col("_from") - F.col("_head")).alias("_from"))
    return _moved(frames, placed)


def _moved(frames: DataFrame, placed: DataFrame) -> DataFrame:
    out = frames.drop("index").join(placed, EPISODE)
    return out.withColumn(EPISODE, F.col("_new")).withColumn("index", F.col("_from") + F.col(FRAME)).select(*[c for c in frames.columns if c != "index"], "index", "split")


def split_lists(frames: DataFrame, lists: dict[str, Sequence[int]]) -> DataFrame:
    """labelled_split by explicit episodes. Raises for empty lists, episodes in two of them, or such that aren't there."""
    if empty := [n for n, ids in lists.items() if not len(ids)]:
        raise ValueError(f"empty splits: {empty}")
    every = pd.Series([e for ids in lists.values() for e in ids])
    if twice := sorted(set(every[every.duplicated()])):
        raise ValueError(f"episodes in more than one place: {twice}")
    wanted = frames.sparkSession.createDataFrame([(int(e), n) for n, ids in lists.items() for e in ids], f"{EPISODE} long, split string")
    lengths = _lengths(frames)
    if absent := sorted(r[0] for r in wanted.join(lengths, EPISODE, "left_anti").collect()):
        raise ValueError(f"no such episodes: {absent}")
    w = Window.partitionBy("split").orderBy(EPISODE)  # no longer than the lists
    before = F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lengths.join(wanted, EPISODE).select(EPISODE, "split", (F.row_number().over(w).cast("long") - 1).alias("_new"), before.alias("_from"))
    return _moved(frames, placed)


def split(frames: DataFrame, fractions: dict[str, float]) -> dict[str, DataFrame]:
    """Each split renumbered from 0."""
    labelled = labelled_split(frames, fractions)
    names = split_bounds(_lengths(frames).count(), fractions)
    return {name: labelled.where(F.col("split") == name).drop("split") for name in names}


def _tagged(parts: Sequence[DataFrame]) -> DataFrame:
    """All parts with their common columns and ``dataset_index``."""
    common = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
    out = parts[0].select(*common, F.lit(0).alias("dataset_index"))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.select(*common, F.lit(i).alias("dataset_index")))
    return out


def _first_seen(rows: DataFrame, task: str) -> DataFrame:
    first = rows.groupBy(task).agg(F.min(F.struct("dataset_index", "index")).alias("_first"))
    return first.select(task, (F.row_number().over(Window.orderBy("_first", task)).cast("long") - 1).alias("task_index"))


def first_seen_tasks(parts: Sequence[DataFrame], task: str = "task") -> DataFrame:
    """Tasks of all parts, numbered in the order in which they are first seen (by part, then index)."""
    return _first_seen(_tagged([p.select(task, "index") for p in parts]), task)


def part_offsets(rows: DataFrame) -> DataFrame:
    """dataset_index, and the episodes and frames of the parts before it: one aggregation, a row for each part."""
    totals = rows.groupBy("dataset_index").agg((F.max(EPISODE) + 1).alias("_e"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("dataset_index").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("dataset_index", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_e", "_n")])


def merge(parts: Sequence[DataFrame], task: str = "task") -> DataFrame:
    """All parts one after another: episodes and indices are offset, tasks unified, ``dataset_index`` tells the part."""
    rows = _tagged(parts).drop("task_index")
    offsets = F.broadcast(part_offsets(rows))  # as many rows as there are parts
    moved = rows.join(offsets, "dataset_index").withColumn(EPISODE, F.col(EPISODE) + F.col("_e_before")).withColumn("index", F.col("index") + F.col("_n_before"))
    return moved.drop("_e_before", "_n_before").join(_first_seen(rows, task), task)


def merge_metadata(episodes: Sequence[DataFrame], videos: Sequence[str] = ()) -> DataFrame:
    """Episode rows of several datasets as those of the merged one, whose files follow each other: episode numbers, frame
    ranges and file numbers are offset by the parts before, and each video's times by the seconds of the files they join."""
    rows = _tagged(episodes)
    files = [f"{v}/file_index" for v in ("data", *[f"videos/{v}" for v in videos])]
    totals = rows.groupBy("dataset_index").agg(
        (F.max(EPISODE) + 1).alias("_e"), F.max("dataset_to_index").alias("_n"), *[(F.max(f"`{f}`") + 1).alias(f"_f{i}") for i, f in enumerate(files)], *[F.max(f"`videos/{v}/to_timestamp`").alias(f"_v{i}") for i, v in enumerate(videos)]
    )
    before = Window.orderBy("dataset_index").rowsBetween(Window.unboundedPreceding, -1)
    names = [c for c in totals.columns if c != "dataset_index"]
    offsets = F.broadcast(totals.select("dataset_index", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_") for c in names]))
    moved = {EPISODE: F.col(EPISODE) + F.col("_e_"), "dataset_from_index": F.col("dataset_from_index") + F.col("_n_"), "dataset_to_index": F.col("dataset_to_index") + F.col("_n_")}
    moved |= {f: F.col(f"`{f}`") + F.col(f"_f{i}_") for i, f in enumerate(files)}
    for i, v in enumerate(videos):
        moved |= {f"videos/{v}/{e}_timestamp": F.col(f"`videos/{v}/{e}_timestamp`") + F.col(f"_v{i}_") for e in ("from", "to")}
    return rows.join(offsets, "dataset_index").withColumns(moved).drop(*[f"{c}_" for c in names])


def retask(episodes: DataFrame, override: DataFrame | None = None, default: str | None = None, task: str = "task") -> DataFrame:
    """Each episode's task: the override's, else the default, else its own; task_index by sorted task text."""
    out = episodes
    if override is not None:
        out = out.join(override.select(EPISODE, F.col(task).alias("_o")), EPISODE, "left")
    own = [F.col("_o")] if override is not None else []
    new = F.coalesce(*own, F.lit(default)) if default is not None else F.coalesce(*own, F.col(task))
    out = out.withColumn(task, new).drop("_o")
    ids = out.select(task).distinct().withColumn("task_index", F.row_number().over(Window.orderBy(task)).cast("long") - 1)
    return out.drop("task_index").join(ids, task)


REQUIRED = ("timestamp", "frame_index", "episode_index", "index", "task_index")


def modify_features(frames: DataFrame, add: dict[str, Column] | None = None, remove: Sequence[str] = ()) -> DataFrame:
    if held := [c for c in remove if c in REQUIRED]:
        raise ValueError(f"required features: {held}")
    if known := [c for c in add or {} if c in frames.columns]:
        raise ValueError(f"already there: {known}")
    if absent := [c for c in remove if c not in frames.columns]:
        raise ValueError(f"no such features: {absent}")
    return frames.withColumns(add or {}).drop(*remove)


def add_by_position(frames: DataFrame, name: str, values: DataFrame | Sequence, index: str = "index") -> DataFrame:
    """A feature whose value for each frame is the one at the frame's global index: a table (index, value), or a list that
    the driver holds. Vectors of one element are that element. Raises if the numbers of frames and values differ, and when it
    is read if a frame has no value at its index."""
    if name in frames.columns:
        raise ValueError(f"already there: {name}")
    if not isinstance(values, DataFrame):
        plain = [v.tolist() if isinstance(v, np.ndarray) else v for v in values]
        values = frames.sparkSession.createDataFrame([(i, v[0] if isinstance(v, list) and len(v) == 1 else v) for i, v in enumerate(plain)], [index, "value"])
    have, want = values.count(), frames.count()
    if have != want:
        raise ValueError(f"{have} values for {want} frames")
    joined = frames.join(values.select(F.col(index), F.struct("value").alias("_v")), index, "left")
    return joined.withColumn(name, F.when(F.col("_v").isNull(), F.raise_error(F.concat(F.lit("no value at index "), F.col(index)))).otherwise(F.col("_v.value"))).drop("_v")


def add_by_call(frames: DataFrame, name: str, call: Callable[[dict, int, int], object], kind: str = "double") -> DataFrame:
    """A feature that a Python function makes of (row, episode, frame), an Arrow batch at a time; an array of one element is that element.
    An expression in ``modify_features`` is the fast path."""
    if name in frames.columns:
        raise ValueError(f"already there: {name}")

    def one(row: dict):
        value = call(row, row[EPISODE], row[FRAME])
        return value.item() if isinstance(value, np.ndarray) and value.size == 1 else value

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{name: [one(r) for r in pdf.to_dict("records")]})

    return frames.mapInPandas(run, T.StructType([*frames.schema.fields, T.StructField(name, T._parse_datatype_string(kind))]))


def without_images(frames: DataFrame, images: Sequence[str], episodes: Sequence[int] | None = None) -> DataFrame:
    """Frames of some episodes without their image columns, as they are when images become videos."""
    out = frames if episodes is None else frames.where(F.col(EPISODE).isin(list(episodes)))
    return out.drop(*images)


def remapped(rows: DataFrame, mapping: DataFrame, old: str, new: str, column: str = EPISODE) -> DataFrame:
    """The column's values through a map (old, new); values that it hasn't stay as they are."""
    to = mapping.select(F.col(old).alias(column), F.col(new).alias("_to"))
    return rows.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


@dataclass(frozen=True)
class Cap:
    """A limit of a greedy bin. reaches: the next row closes a bin of positive size if with it the sum would reach the limit;
    else it closes one that has rows if the sum would exceed it."""

    limit: float
    reaches: bool

    def closes_at(self, upto: np.ndarray, at: int, held: float, rows: int) -> int:
        """The first row from ``at`` on that closes a bin which holds ``held`` in ``rows`` rows; upto: sums before each row, and of all."""
        found = int(np.searchsorted(upto[1:], self.limit - held + upto[at], "left" if self.reaches else "right"))
        if self.reaches:
            first = at if held > 0 else int(np.searchsorted(upto, upto[at], "right"))
        else:
            first = at if rows else at + 1
        return max(found, first)


def greedy_bins(table: DataFrame, order: str, capped: Sequence[tuple[Column, Cap]], name: str) -> DataFrame:
    """Consecutive rows in bins under all caps: adds the bin's number.

    Where a bin ends depends on all bins before it, so the keys and sizes of the table (one row an episode) go through one
    sorted task. It takes a search for each bin, not a step for each row, and carries the open bin from batch to batch."""
    narrow = table.select(F.col(order), *[c.cast("double").alias(f"_c{i}") for i, (c, _) in enumerate(capped)])
    caps = [cap for _, cap in capped]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bin_, rows, held = 0, 0, [0.0] * len(caps)
        for pdf in batches:
            n = len(pdf)
            upto = [np.concatenate([[0.0], np.cumsum(pdf[f"_c{i}"].to_numpy(float))]) for i in range(len(caps))]
            out, at = np.empty(n, np.int64), 0
            while at < n:
                end = min([n, *[c.closes_at(u, at, h, rows) for c, u, h in zip(caps, upto, held)]])
                out[at:end] = bin_
                rows, held = rows + end - at, [h + u[end] - u[at] for h, u in zip(held, upto)]
                if end < n:
                    bin_, rows, held = bin_ + 1, 0, [0.0] * len(caps)
                at = end
            yield pd.DataFrame({order: pdf[order], name: out})

    schema = T.StructType([narrow.schema[order], T.StructField(name, T.LongType())])
    return table.join(narrow.repartition(1).sortWithinPartitions(order).mapInPandas(fold, schema), order)


def file_bins(episodes: DataFrame, size: str, limit: float, files_per_chunk: int = 1000, order: str = EPISODE) -> DataFrame:
    """chunk_index and file_index of each episode: a file takes episodes while what it holds stays under the limit."""
    out = greedy_bins(episodes, order, [(F.col(size), Cap(limit, True))], "_bin")
    return out.withColumn("chunk_index", F.floor(F.col("_bin") / files_per_chunk)).withColumn("file_index", F.col("_bin") % files_per_chunk).drop("_bin")


def episode_batches(episodes: DataFrame, mb_per_frame: float, limit_mb: float, most_episodes: int | None = None, most_frames: int | None = None) -> DataFrame:
    """Greedy batches of consecutive episodes under size, episode and frame caps: adds batch."""
    caps = [(F.col("length") * mb_per_frame, Cap(limit_mb, True))]
    caps += [(F.lit(1), Cap(most_episodes, False))] if most_episodes is not None else []
    caps += [(F.col("length"), Cap(most_frames, False))] if most_frames is not None else []
    return greedy_bins(episodes, EPISODE, caps, "batch")
