"""Shared DataFrame parts: reliable checkpoints, row keys, global prefix sums and Arrow passes over texts."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._text import release

WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a folder of our own only where that is unset and the session is local, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="frameloom-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


_made: ContextVar[list | None] = ContextVar("checkpoints", default=None)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    checkpoint_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    if (made := _made.get()) is not None:
        file = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            made.append(file.get())
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in any store that Spark reaches."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def let_go(spark: SparkSession) -> None:
    """Have the driver collect what nothing refers to any more: only then does Spark remove the files of its shuffles
    (by itself it waits for a full heap or half an hour)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def passing_checkpoints(spark: SparkSession):
    """Checkpoints that are made inside are deleted at the end; what reads them must be written by then."""
    token = _made.set([])
    try:
        yield
    finally:
        for path in _made.get():
            delete(spark, path)
        _made.reset(token)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, for columns that are put beside its own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(df: DataFrame, seed: int) -> Column:
    """A 64-bit hash of the whole row in which a null differs from any value and from its place."""
    parts = [x for c in df.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return F.xxhash64(F.lit(seed), *parts)


def global_prefix(df: DataFrame, group: Sequence[str], order: Sequence[str], measure: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Ranks and exclusive prefix sums over a total order, without a task that holds a whole group.

    Rows are dealt by range of (group, order), each range is numbered by itself, and the ranges' totals, one row for
    each range and group in it, are prefix-summed and added. The ranged rows are checkpointed, so that a lost executor
    can't change where ranges were cut. Group columns must not be null. Returns the rows with ``rank`` and ``before``,
    and the totals (range, group, ``rows``, ``amount``). Rows equal in all order columns are interchangeable.
    """
    n = shuffle_partitions(df.sparkSession)
    ranged = checkpointed(df.repartitionByRange(n, *group, *order).withColumn("range_id", F.spark_partition_id()))
    amount = F.col(measure) if measure else F.lit(0).cast("long")
    totals = ranged.groupBy("range_id", *group).agg(F.count(F.lit(1)).alias("rows"), F.sum(amount).alias("amount"))
    earlier = Window.partitionBy(*group).orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select("range_id", *group, F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("head_rank"), F.coalesce(F.sum("amount").over(earlier), F.lit(0)).alias("head_before"))
    within = Window.partitionBy("range_id", *group).orderBy(*order)
    local = ranged.withColumn("rank", F.row_number().over(within).cast("long") - 1)
    if measure:
        local = local.withColumn("before", F.sum(amount).over(within.rowsBetween(Window.unboundedPreceding, 0)) - amount)
    else:
        local = local.withColumn("before", F.lit(0).cast("long"))
    out = local.join(heads, ["range_id", *group]).withColumns({"rank": F.col("rank") + F.col("head_rank"), "before": F.col("before") + F.col("head_before")})
    return out.drop("range_id", "head_rank", "head_before"), totals


def map_text(df: DataFrame, kernel: Callable[[pa.Array], list[pa.Array]], fields: Sequence[T.StructField], text: str = "text", drop: Sequence[str] = ()) -> DataFrame:
    """Append columns that ``kernel`` makes from the text column, an Arrow batch at a time; no shuffle."""
    keep = [f for f in df.schema.fields if f.name not in drop]
    schema = T.StructType([*keep, *fields])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in keep]

    def run(batches):
        for batch in batches:
            new = kernel(batch.column(batch.schema.get_field_index(text)))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names] + list(new)
            yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)
        release()

    return df.mapInArrow(run, schema)
