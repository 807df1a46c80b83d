"""Other episodic sources as frames, and side tables of a dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.windows import EPISODE, FRAME


def is_success(path: Column) -> Column:
    """Whether an episode's file lies in a folder of successes."""
    return path.contains("/success/")


def single(df: DataFrame) -> DataFrame:
    """Doubles, and arrays of them, as floats."""
    to = {T.DoubleType(): "float", T.ArrayType(T.DoubleType()): "array<float>", T.ArrayType(T.DoubleType(), False): "array<float>"}
    return df.withColumns({f.name: F.col(f"`{f.name}`").cast(to[f.dataType]) for f in df.schema.fields if f.dataType in to})


def ported(steps: DataFrame, episode: str, order: Sequence[str], vectors: dict[str, Sequence[str]], instructions: Sequence[str], fps: float, path: str | None = None) -> DataFrame:
    """Steps of another store as frames: vectors are their parts end to end (scalars are one element), the task is the first
    instruction that isn't empty, first and last steps are marked, numbers are single precision.

    Episodes are numbered by ``episode``, an integer of the source; frames by ``order`` in each."""
    from pyspark.sql import Window

    w = Window.partitionBy(episode).orderBy(*order)
    part = lambda c: F.col(f"`{c}`") if isinstance(steps.schema[c].dataType, T.ArrayType) else F.array(F.col(f"`{c}`"))
    task = F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in instructions], F.lit(""))
    out = steps.withColumns({to: F.concat(*[part(c).cast("array<double>") for c in own]) for to, own in vectors.items()})
    out = out.withColumn("task", task).withColumn(FRAME, F.row_number().over(w).cast("long") - 1).withColumn("is_first", F.lag(F.lit(1)).over(w).isNull()).withColumn("is_last", F.lead(F.lit(1)).over(w).isNull())
    out = out.withColumn("timestamp", F.col(FRAME) / F.lit(float(fps)))
    if path is not None:
        out = out.withColumn("is_episode_successful", is_success(F.col(path)))
    return single(out.withColumnRenamed(episode, EPISODE))


def progress(spark: SparkSession, path: str, head: str = "sparse") -> DataFrame:
    """index, EPISODE and progress of a progress table for one head; NaN is no progress. Raises if the head isn't there."""
    df = spark.read.parquet(path)
    column = f"progress_{head}"
    if column not in df.columns:
        raise ValueError(f"no {column}; there are {sorted(c for c in df.columns if c.startswith('progress'))}")
    return df.select("index", EPISODE, F.when(~F.isnan(column), F.col(column)).alias("progress"))


def inlined(frames: DataFrame, images: Sequence[str], files: DataFrame) -> DataFrame:
    """Image columns (a struct of bytes and path) with the bytes of their files where they have only a path. files: path, content."""
    out = frames
    for c in images:
        body = files.select(F.col("path").alias("_path"), F.col("content").alias("_body"))
        name = F.element_at(F.split(F.col(f"`{c}`")["path"], "/"), -1)
        out = out.join(body, F.col(f"`{c}`")["path"] == F.col("_path"), "left").withColumn(c, F.struct(F.coalesce(F.col(f"`{c}`")["bytes"], F.col("_body")).alias("bytes"), name.alias("path"))).drop("_path", "_body")
    return out
