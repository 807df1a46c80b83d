"""What a dataset is like in a few rows: totals, quality of compression, statistics brought up to date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stats import QUANTILES, feature_stats, pooled_stats, quantile_name
from .windows import EPISODE


def summary(frames: DataFrame, fps: float, task: str = "task") -> DataFrame:
    """Episodes, frames, tasks, frames an episode, and seconds an episode, rounded as they are printed."""
    own = frames.agg(F.count_distinct(EPISODE).alias("total_episodes"), F.count(F.lit(1)).alias("total_frames"), F.count_distinct(task).alias("total_tasks"))
    mean = F.col("total_frames") / F.nullif(F.col("total_episodes"), F.lit(0))
    return own.withColumns({"frames_per_episode": F.round(mean, 1), "seconds_per_episode": F.round(mean / F.lit(float(fps)), 1), "fps": F.lit(float(fps))})


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """path and bytes of each file below a folder, from the store's listing; no file is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))


def rows_in_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of each Parquet file: no column is read, so the counts come from the footers."""
    return spark.read.parquet(path).groupBy(F.input_file_name().alias("path")).agg(F.count(F.lit(1)).alias("rows"))


def compression_quality(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means over samples (load_video_ms, load_images_ms, and lists mse, psnr, ssim with a value for each frame); the load-time
    ratio is one of means."""
    lists = ("mse", "psnr", "ssim")
    sums = [F.sum(F.aggregate(F.coalesce(c, F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x)).alias(f"_s_{c}") for c in lists]
    sizes = [F.sum(F.size(F.coalesce(c, F.array().cast("array<double>")))).alias(f"_n_{c}") for c in lists]
    own = samples.groupBy(*by).agg(F.avg("load_video_ms").alias("avg_load_time_video_ms"), F.avg("load_images_ms").alias("avg_load_time_images_ms"), *sums, *sizes)
    ratio = F.col("avg_load_time_video_ms") / F.nullif(F.col("avg_load_time_images_ms"), F.lit(0.0))
    return own.withColumn("video_images_load_time_ratio", ratio).withColumns({f"avg_{c}": F.col(f"_s_{c}") / F.nullif(F.col(f"_n_{c}"), F.lit(0)) for c in lists}).drop(*[f"_{k}_{c}" for k in "sn" for c in lists])


def has_quantiles(stats: dict[str, dict] | None, quantiles: Sequence[float] = QUANTILES) -> bool:
    return any(quantile_name(q) in own for own in (stats or {}).values() for q in quantiles)


def with_quantiles(frames: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Statistics with quantiles as a dataset holds them: each episode's, then pooled (quantiles are count-weighted means)."""
    return pooled_stats(feature_stats(frames, value, [*by, EPISODE]), by)


def check_stats(parts: Sequence[dict[str, dict]]) -> None:
    """Raise unless statistics are lists, counts have one value, and an image's have the shape (3, 1, 1)."""

    def shape(x) -> tuple:
        return (len(x), *(shape(x[0]) if x else ())) if isinstance(x, (list, tuple)) else ()

    for part in parts:
        for feature, own in part.items():
            for name, value in own.items():
                have = shape(value)
                want = (1,) if name == "count" else (3, 1, 1) if "image" in feature else have
                if not have or have != want:
                    raise ValueError(f"{feature}/{name}: shape {have or 'scalar'}, not {want or 'a list'}")
