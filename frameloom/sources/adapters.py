"""The test tables read as episodes and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: an episode for each user, a frame for each event in order of time. value, task, ts, event_id."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_index"), (F.row_number().over(order).cast("long") - 1).alias("frame_index"), "value", F.col("event_type").alias("task"), "ts", "event_id")


EVENT_FRAMES = "f AS (SELECT user_id AS episode_index, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index, value, event_type AS task, ts, event_id FROM events)"


def line_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: an episode for each order, a frame for each line; a four-dimensional action vector."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    action = F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("episode_index"), (F.row_number().over(order).cast("long") - 1).alias("frame_index"), action.alias("action"), F.col("l_returnflag").alias("task"))


LINE_FRAMES = "g AS (SELECT l_orderkey AS episode_index, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS frame_index, [l_quantity, l_extendedprice, l_discount, l_tax] AS action, l_returnflag AS task FROM lineitem)"


def vector_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: an episode for each label, a frame for each vector."""
    order = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("episode_index"), (F.row_number().over(order).cast("long") - 1).alias("frame_index"), F.col("embedding").cast("array<double>").alias("state"), "vec_id")


VECTOR_FRAMES = "e AS (SELECT label::BIGINT AS episode_index, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_index, embedding::DOUBLE[] AS state, vec_id FROM embeddings)"
