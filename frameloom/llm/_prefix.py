"""Pairs of sets that may be alike, by an inverted index on the sets' prefixes; exact and without a cap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._frames import checkpointed

#: A list that more prefixes hold is met by blocks of about so many rows.
BLOCK = 512


def _shared(df: DataFrame) -> DataFrame:
    """The values that sets of two components hold, and how many sets do."""
    return df.groupBy("s").agg(F.count(F.lit(1)).alias("held"), F.min("l").alias("l0"), F.max("l").alias("l1")).where("l0 <> l1").select("s", "held")


def prefixes(sets: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """sets: id, l (its component), n (its size), all (array of its values). Returns their prefixes: id, l, n, s, place, and what else marks has of each id.

    Sets of n and more values that are alike share one of the first n - ceil(percent * n / 100) + 1 of each, in any order that is
    the same for all. The order here: values of one component only, then the others from rare to common. So values that tell a
    component from the rest fill the prefixes, and they make no pair. Components may be joined afterwards (l is then another):
    sets that are still in two were so before."""
    rows = sets.select("id", "l", F.explode("all").alias("s"))
    of_set = Window.partitionBy("id")
    placed = rows.select("id", "s").join(_shared(rows), "s").join(sets.select("id", "l", "n"), "id").withColumn("place", F.row_number().over(of_set.orderBy("held", "s")) + F.col("n") - F.count(F.lit(1)).over(of_set))
    return checkpointed(placed.where(f"place <= n - (n * {percent} + 99) div 100 + 1").select("id", "l", "n", "s", "place").join(marks.drop("n"), "id"))


def pairs_of(first: DataFrame, percent: int, apart: Callable[[], Column]) -> DataFrame:
    """Distinct pairs of sets in two components that share a value of both prefixes, among which every pair with
    100 * common >= percent * union is: id_x, id_y, apart. ``apart()``, above 0 for pairs that can't be alike, is tested where the pair meets."""
    #: One side of a long list is cut in blocks, the other is in all of them; lists are counted by aggregation.
    lists = _shared(first).select("s", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"))
    dealt = first.join(lists, "s")
    cells = [c for c in first.columns if c != "s"]
    x = dealt.select("s", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), *[F.col(c).alias(f"{c}_x") for c in cells])
    y = dealt.select("s", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *[F.col(c).alias(f"{c}_y") for c in cells])
    #: The first value that both have leaves room for the common ones that the pair needs.
    need = f"{percent} * (n_x + n_y)"
    met = x.join(y, ["s", "block"]).where("l_x < l_y").where(f"{100 + percent} * (n_x - place_x + 1) >= {need} and {100 + percent} * (n_y - place_y + 1) >= {need}")
    met = met.where(f"100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y)")
    return met.withColumn("apart", apart()).where("apart <= 0").select("id_x", "id_y", "apart").distinct()


def nearest(pairs: DataFrame, most: int = 3) -> DataFrame:
    """The pairs that are among the ``most`` nearest of one of their sets: id_x, id_y."""
    ends = pairs.select("id_x", "id_y", "apart", F.explode(F.array("id_x", "id_y")).alias("of"))
    place = F.row_number().over(Window.partitionBy("of").orderBy("apart", F.xxhash64("id_x", "id_y"), "id_x", "id_y"))
    return ends.withColumn("place", place).where(F.col("place") <= most).select("id_x", "id_y").distinct()
