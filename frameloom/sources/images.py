"""Images as frames: Spark's image source, pixel structs, and Arrow kernels over raw pixels.

An image is a struct (height, width, nChannels, data) of unsigned bytes in height, width, channel order, as Spark's image
source gives it (channels there are B, G, R; ``read_images`` turns them to R, G, B).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.stats import pooled_stats

PIXELS = T.StructType([T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("nChannels", T.IntegerType()), T.StructField("data", T.BinaryType())])


def _array(row) -> np.ndarray:
    return np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])


def _views(images: pa.StructArray) -> Iterator[np.ndarray | None]:
    """Each image as a view of the batch's buffer; None for a null."""
    data, *sizes = (images.field(n) for n in ("data", "height", "width", "nChannels"))
    wide = pa.types.is_large_binary(data.type)
    _, offsets, body = data.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    there = images.is_valid().to_numpy(zero_copy_only=False) & data.is_valid().to_numpy(zero_copy_only=False)
    shapes = np.stack([s.fill_null(0).to_numpy(zero_copy_only=False) for s in sizes], 1)
    for i in range(len(images)):
        yield raw[at[i] : at[i + 1]].reshape(shapes[i]) if there[i] else None


def _packed(images: list[np.ndarray | None]) -> pa.StructArray:
    shapes = np.array([a.shape if a is not None else (0, 0, 0) for a in images], np.int32).reshape(-1, 3)
    columns = [pa.array(shapes[:, i]) for i in range(3)] + [pa.array([None if a is None else np.ascontiguousarray(a).tobytes() for a in images], pa.binary())]
    return pa.StructArray.from_arrays(columns, PIXELS.names, mask=pa.array([a is None for a in images], pa.bool_()))


def mapped(kernel: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """A column function that applies ``kernel`` to each image, over an Arrow batch's buffers; a null stays null."""

    @F.arrow_udf(PIXELS)
    def run(images: pa.Array) -> pa.Array:
        return _packed([None if a is None else kernel(a) for a in _views(images)])

    return run


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, image (R, G, B). Files that are no image are dropped."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path)
    raw = rows.select(F.col("image.origin").alias("path"), F.struct("image.height", "image.width", "image.nChannels", "image.data").alias("image"))
    turn = mapped(lambda a: a[:, :, [2, 1, 0, *range(3, a.shape[2])]] if a.shape[2] >= 3 else a)
    return raw.withColumn("image", turn("image"))


def flipped(horizontal: bool = True) -> Callable[[Column], Column]:
    return mapped((lambda a: a[:, ::-1]) if horizontal else (lambda a: a[::-1]))


def cropped(top: int, left: int, height: int, width: int, size: tuple[int, int] | None = None) -> Callable[[Column], Column]:
    """A region, and if size is given that region at this (height, width) by nearest pixels."""

    def kernel(a):
        part = a[top : top + height, left : left + width]
        if size is None:
            return part
        y = np.minimum((np.arange(size[0]) + 0.5) * part.shape[0] / size[0], part.shape[0] - 1).astype(int)
        x = np.minimum((np.arange(size[1]) + 0.5) * part.shape[1] / size[1], part.shape[1] - 1).astype(int)
        return part[y][:, x]

    return mapped(kernel)


def shifted(pad: int, seed: int) -> Callable[[Column, Column], Column]:
    """Random shift by up to ``pad`` pixels with edge padding, by a hash of the key."""

    def moved(a: np.ndarray, key: int) -> np.ndarray:
        dy, dx = np.random.default_rng([seed, key & 0x7FFFFFFF]).integers(0, 2 * pad + 1, 2)
        big = np.pad(a, ((pad, pad), (pad, pad), (0, 0)), mode="edge")
        return big[dy : dy + a.shape[0], dx : dx + a.shape[1]]

    @F.arrow_udf(PIXELS)
    def run(images: pa.Array, key: pa.Array) -> pa.Array:
        return _packed([None if a is None else moved(a, int(k or 0)) for a, k in zip(_views(images), key.to_pylist())])

    return run


def stride_for(height: int, width: int, least: int = 300, target: int = 150) -> int:
    """Images of 300 pixels or more on a side are thinned to about 150 for statistics."""
    return 1 if max(height, width) < least else max(1, int(width / target) if width > height else int(height / target))


def vector(mean: Sequence[float] | None = None, std: Sequence[float] | None = None, channels_first: bool = True) -> Callable[[Column], Column]:
    """Pixels as floats in [0, 1], normalised by channel if mean and std are given, channels first."""

    shift = np.array(mean, np.float32) if mean is not None else np.float32(0)
    scale = np.array(std, np.float32) if mean is not None else np.float32(1)

    def floats(a: np.ndarray) -> np.ndarray:
        out = (a.astype(np.float32) / 255 - shift) / scale
        return (out.transpose(2, 0, 1) if channels_first else out).ravel()

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(images: pa.Array) -> pa.Array:
        return pa.array([None if a is None else floats(a) for a in _views(images)], pa.list_(pa.float32()))

    return run


def channel_stats(frames: DataFrame, image: str, by: Sequence[str] = ()) -> DataFrame:
    """min, max, mean, std of each channel over all pixels in [0, 1]; count is the number of images. Each image gives one
    row of statistics a channel, which are pooled by their numbers of pixels."""
    names = ("n", "mean", "std", "min", "max")
    moments = T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in names]))

    def own(a: np.ndarray) -> list[dict]:
        k = stride_for(*a.shape[:2])
        pixels = a[::k, ::k].astype(np.float64) / 255
        return [dict(zip(names, (float(c.size), float(c.mean()), float(c.std()), float(c.min()), float(c.max())))) for c in pixels.transpose(2, 0, 1)]

    @F.arrow_udf(moments)
    def of(images: pa.Array) -> pa.Array:
        cell = pa.struct([(c, pa.float64()) for c in names])
        return pa.array([None if a is None else own(a) for a in _views(images)], pa.list_(cell))

    long = frames.select(*by, F.posexplode(of(F.col(image))).alias("channel", "m")).select(*by, "channel", F.col("m.n").alias("count"), "m.mean", "m.std", "m.min", "m.max")
    counts = long.groupBy(*by, "channel").agg(F.count(F.lit(1)).alias("count"))
    pooled = pooled_stats(long, [*by, "channel"], ()).drop("count").withColumnsRenamed({c: f"_{c}" for c in [*by, "channel"]})
    same = [counts[c].eqNullSafe(pooled[f"_{c}"]) for c in [*by, "channel"]]
    return counts.join(pooled, same).select(*by, "channel", "min", "max", "mean", "std", "count")
