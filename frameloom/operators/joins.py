"""The joins that episode data needs: lookups, nearest in time, intervals, clamped maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import EPISODE


def lookup(facts: DataFrame, dimension: DataFrame, on: str | Sequence[str], optional: bool = False) -> DataFrame:
    """Equi lookup; the optimizer broadcasts the dimension when its measured size allows."""
    return facts.join(dimension, on, "left" if optional else "inner")


def nearest(queries: DataFrame, series: DataFrame, by: str, query_time: str, time: str, values: Sequence[str], tolerance: float, strict: bool = False) -> DataFrame:
    """As-of nearest within each group: for each query the series row closest in time (ties: the earlier), with its
    ``distance`` and ``is_pad`` where it is further than the tolerance; strict: raise there instead.

    Both sides are put in one order, and each query takes the last row before it and the first after it: one sort, no
    pairs. Column names of values must not clash with the queries'.
    """
    q = queries.select(*queries.columns, F.col(query_time).alias("_t"), F.lit(1).alias("_q"), F.lit(None).cast(series.select(F.struct(time, *values)).schema[0].dataType).alias("_s"))
    s = series.select(*[(F.col(by) if c == by else F.lit(None).cast(queries.schema[c].dataType)).alias(c) for c in queries.columns], F.col(time).alias("_t"), F.lit(0).alias("_q"), F.struct(time, *values).alias("_s"))
    w = Window.partitionBy(by).orderBy("_t", "_q")
    back = Window.partitionBy(by).orderBy(F.col("_t").desc(), "_q")
    both = q.unionByName(s)
    #: Equal times: rows of the series come first in both orders, so both sides see them; of equal series times the first in time order wins.
    before = F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("_s", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumn("_b", before).withColumn("_a", after).where("_q = 1")
    gap = lambda c: F.abs(F.col(f"{c}.{time}") - F.col("_t"))
    pick = F.when(F.col("_a").isNull() | (gap("_b") <= gap("_a")), F.col("_b")).otherwise(F.col("_a"))
    rows = rows.withColumn("_m", pick)
    distance = F.abs(F.col(f"_m.{time}") - F.col("_t"))
    bad = F.coalesce(distance > tolerance if not strict else distance >= tolerance, F.lit(True))
    flag = F.when(bad, F.raise_error(F.lit("no row within the tolerance")).cast("boolean")).otherwise(bad) if strict else bad
    return rows.select(*queries.columns, F.col(f"_m.{time}").alias(f"matched_{time}"), *[F.col(f"_m.{v}").alias(v) for v in values], distance.alias("distance"), flag.alias("is_pad"))


def _level(length: Column) -> Column:
    """The least power of two, as its exponent, that is not below the length."""
    n = F.greatest(length.cast("double"), F.lit(1.0))
    k = F.ceil(F.log2(n)).cast("int")  # log2 may be off by one at large powers: one step either way settles it
    k = F.when(F.pow(F.lit(2.0), k) < n, k + 1).otherwise(k)
    return F.greatest(F.when(F.pow(F.lit(2.0), k - 1) >= n, k - 1).otherwise(k), F.lit(0)).cast("int")


def _cells(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """intervals [start, end] with _level and _cell: on the level of its own length an interval touches two cells at most."""
    rows = intervals.withColumn("_level", _level(F.col(end) - F.col(start) + 1))
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), "_level")).cast("long")
    return rows.withColumn("_cell", F.explode(F.array_distinct(F.array(cell(start), F.greatest(cell(start), cell(end))))))


def _probes(points: DataFrame, cells: DataFrame, point: str) -> DataFrame:
    """points with a _level and _cell for each level that the intervals have; there are 64 levels at most."""
    levels = sorted(r[0] for r in cells.select("_level").distinct().collect())
    return points.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels]) if levels else F.array().cast("array<int>"))).withColumn("_cell", F.floor(F.col(point) / F.pow(F.lit(2.0), "_level")).cast("long"))


def containing(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pairs of a point and an interval with start <= point < end (of one group, if by is given): an equi join on (level, cell), so there is
    no range join, nothing is broadcast unless the optimizer measures that it may be, and an interval makes two rows
    however long it is. Starts and ends are whole numbers below 2^53."""
    cells = _cells(intervals.select(*by, *dict.fromkeys([start, end, *values])).withColumn("_last", F.col(end) - 1), start, "_last").where(F.col(start) < F.col(end))
    keys = [F.col(f"p.{c}") == F.col(f"i.{c}") for c in (*by, "_level", "_cell")]
    met = _probes(points, cells, point).alias("p").join(cells.alias("i"), keys).where((F.col(f"i.{start}") <= F.col(f"p.{point}")) & (F.col(f"p.{point}") < F.col(f"i.{end}")))
    return met.select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"i.{v}") for v in values])


def first_interval(points: DataFrame, intervals: DataFrame, by: str, point: str, start: str, end: str, values: Sequence[str], order: str, width: float = 1024) -> DataFrame:
    """For each point the first interval (by ``order``) of its group with start <= point <= end; null if there is none.

    An interval is in the cells that it touches on the level of its own length, two at most, and a point is looked up in
    its cell of each level: an equi join on (group, level, cell), so no group's intervals come together in one row, and
    there is no range join. ``width`` is the width of the cells of level 0; shorter intervals share it."""
    unit = lambda c: F.floor(F.col(c) / F.lit(float(width)))
    cut = _cells(intervals.select(by, F.struct(*dict.fromkeys([order, start, end, *values])).alias("_i"), unit(start).alias("_s"), F.greatest(unit(start), unit(end)).alias("_e")), "_s", "_e")
    lists = cut.groupBy(by, "_level", "_cell").agg(F.array_sort(F.collect_list("_i")).alias("_is"))
    hit = F.filter("_is", lambda i: (i[start] <= F.col(point)) & (F.col(point) <= i[end]))
    probes = _probes(points.select(by, point).distinct().withColumn("_u", unit(point)), cut, "_u").join(lists, [by, "_level", "_cell"])
    found = probes.withColumn("_h", F.try_element_at(hit, F.lit(1))).where("_h is not null").groupBy(by, point).agg(F.min("_h").alias("_h"))
    right = found.select(F.col(by).alias("_by"), F.col(point).alias("_point"), "_h")
    return points.join(right, (points[by] == right["_by"]) & (points[point] == right["_point"]), "left").select(*points.columns, *[F.col(f"_h.{v}").alias(v) for v in values])


def prefer_left(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Full outer join in which the left value wins cell by cell."""
    r = right.select(F.col(on), *[F.col(c).alias(f"_r_{c}") for c in right.columns if c != on])
    both = left.join(r, on, "full")
    names = [c for c in left.columns if c != on] + [c for c in right.columns if c != on and c not in left.columns]
    cell = lambda c: F.coalesce(*[F.col(x) for x in (c if c in left.columns else None, f"_r_{c}" if c in right.columns else None) if x])
    return both.select(on, *[cell(c).alias(c) for c in names])


def missing(wanted: DataFrame, present: DataFrame, on: str = EPISODE) -> DataFrame:
    """Rows of wanted that present lacks; empty means all are there."""
    return wanted.join(present, on, "left_anti")


#: How two action chunks are blended where they overlap.
BLENDS = {"weighted_average": (0.3, 0.7), "latest_only": (0.0, 1.0), "average": (0.5, 0.5), "conservative": (0.7, 0.3)}


def merge_actions(queue: DataFrame, incoming: DataFrame, latest: int, step: str = "timestep", action: str = "action", blend: str = "weighted_average", by: Sequence[str] = ()) -> DataFrame:
    """The queue after a chunk arrives: steps up to ``latest`` are late and go; steps that both have are blended; the rest is the chunk's."""
    old, new = BLENDS[blend]
    q = queue.select(*by, step, F.col(action).alias("_old"))
    mixed = F.when(F.col("_old").isNull(), F.col(action)).otherwise(F.lit(old) * F.col("_old") + F.lit(new) * F.col(action))
    return incoming.where(F.col(step) > latest).join(q, [*by, step], "left").withColumn(action, mixed).drop("_old")


def source_of(index: Column, sizes: Sequence[int]) -> Column:
    """Which of several concatenated datasets a global index falls in, from their sizes."""
    out, total = None, 0
    for i, n in enumerate(sizes):
        total += n
        out = F.when(index < total, i) if out is None else out.when(index < total, i)
    return out
