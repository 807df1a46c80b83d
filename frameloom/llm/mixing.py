"""Mixing sources to target weights by systematic sampling.

Every document of a source expects target / source_size copies. With the documents in one order, the expected copies
are prefix-summed within the source, one random offset is added, and a copy is emitted for each integer boundary that
the sum crosses. The order is by size, so neighbours are alike and the words that are taken miss the target by little
more than the largest document. Targets come from weights, capped at ``most`` times the source's size, by a water level
that is found in one pass over the sources. The offset is a hash of seed and source, so reruns agree. DataFrame
functions only; a source may hold any share of the rows (ranges of it are numbered apart).

Defined cases: a null text has size 0; a null source is one source, last in the order of weights; a source without
words has target 0 and its documents aren't taken; an empty table gives no rows; equal rows are interchangeable, and
their copies are counted together; columns of any name are kept by ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._frames import WORD, fresh, global_prefix, row_key

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes: no_source, source_name, source_size. Adds target: min(most * size, level * weight), which sum to all sizes."""
    order = Window.orderBy("no_source", "source_name")
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1).cast("long")).withColumn("cap", F.lit(most) * F.col("source_size"))
    #: By rising cap / weight, the capped sources come first; the level after k of them is (all - caps) / (weights left).
    rising = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "no_source", "source_name")
    upto, rest = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(upto), F.lit(0))) / F.sum("weight").over(rest)
    stepped = weighed.withColumn("level", level)
    free = F.col("level") * F.col("weight") <= F.col("cap")
    final = F.min(F.when(free, F.struct(F.col("cap") / F.col("weight"), "no_source", "source_name", "level"))).over(Window.partitionBy())["level"]
    return stepped.withColumn("final", final).select("no_source", "source_name", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("final") * F.col("weight"), F.lit(0.0))).alias("target"))


def _offset(seed: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("no_source").cast("string"), F.col("source_name")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def plan(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """One row for each of df's: row_key (its key), size, source_size, target, copies, and h1, h2 (a hash of the row)."""
    digest = df.select(
        F.col(key).alias("row_key"),
        F.col(source).isNull().cast("int").alias("no_source"),
        F.coalesce(F.col(source), F.lit("")).alias("source_name"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        row_key(df, 1).alias("h1"),
        row_key(df, 2).alias("h2"),
    )
    group = ["no_source", "source_name"]
    ranked, totals = global_prefix(digest, group, ["size", "row_key", "h1", "h2"], "size")
    sizes = totals.groupBy(*group).agg(F.sum("amount").alias("source_size"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    aimed = targets(sizes, weights, most).withColumn("each", each).withColumn("offset", _offset(seed))
    upto = lambda rank: F.floor(rank.cast("double") * F.col("each") + F.col("offset"))
    return ranked.join(aimed, group).select("row_key", "size", "source_size", "target", (upto(F.col("rank") + 1) - upto(F.col("rank"))).alias("copies"), "h1", "h2")


def mix(df: DataFrame, **options) -> DataFrame:
    """df's rows, each as often as the plan takes it."""
    h1, h2, n = fresh(df, "h1", "h2", "copies")
    copies = plan(df, **options).groupBy("h1", "h2").agg(F.sum("copies").alias(n)).where(F.col(n) > 0).withColumnsRenamed({"h1": h1, "h2": h2})
    once = df.withColumn(h1, row_key(df, 1)).withColumn(h2, row_key(df, 2)).groupBy(h1, h2).agg(*[F.first(f"`{c}`").alias(c) for c in df.columns])
    return once.join(copies, [h1, h2]).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*[f"`{c}`" for c in df.columns])
