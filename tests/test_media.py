"""Images and tokens."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.functions import tokens
from frameloom.sources import images


def png(a):
    """An 8-bit RGB PNG."""
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    body = b"".join(b"\0" + row.tobytes() for row in a)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def pixels():
    return np.random.default_rng(0).integers(0, 256, (6, 8, 3), dtype=np.uint8)


def test_images(spark, tmp_path, pixels):
    (tmp_path / "a.png").write_bytes(png(pixels))
    (tmp_path / "b.png").write_bytes(b"no image")
    df = images.read_images(spark, str(tmp_path))
    rows = df.collect()
    assert len(rows) == 1 and images._array(rows[0]["image"]).tolist() == pixels.tolist()
    out = df.select(images.flipped()("image").alias("f"), images.cropped(1, 2, 4, 4)("image").alias("c"), images.cropped(0, 0, 6, 8, (3, 4))("image").alias("s"), images.vector([0.5] * 3, [0.5] * 3)("image").alias("v"), images.shifted(2, 1)("image", F.lit(3)).alias("m")).first()
    assert images._array(out["f"]).tolist() == pixels[:, ::-1].tolist() and images._array(out["c"]).tolist() == pixels[1:5, 2:6].tolist()
    assert (out["s"]["height"], out["s"]["width"]) == (3, 4) and images._array(out["m"]).shape == pixels.shape
    assert np.allclose(out["v"], ((pixels / 255 - 0.5) / 0.5).transpose(2, 0, 1).ravel(), atol=1e-5)
    stats = images.channel_stats(df, "image").orderBy("channel").collect()
    for c, r in enumerate(stats):
        v = pixels[:, :, c] / 255
        assert (r["min"], r["max"], r["mean"], r["std"], r["count"]) == pytest.approx((v.min(), v.max(), v.mean(), v.std(), 1))
    nulls = df.select("image").unionByName(df.select(F.lit(None).cast(df.schema["image"].dataType).alias("image")))
    assert nulls.where(images.flipped()("image").isNull()).count() == 1 and images.channel_stats(nulls, "image").first()["count"] == 1
    assert images.stride_for(100, 200) == 1 and images.stride_for(480, 640) == 4


def test_tokens(spark):
    import public_tokenizers

    df = spark.createDataFrame([("hello world",), (None,)], "t string").withColumn("ids", tokens.token_ids(F.col("t"), public_tokenizers.path("byte_bpe_50k.json")))
    ids, mask = tokens.padded_ids(F.col("ids"), 4)
    left, _ = tokens.padded_ids(F.col("ids"), 4, side="left")
    rows = df.select("ids", ids.alias("p"), mask.alias("m"), left.alias("l"), tokens.framed_action(F.col("ids"), 100_000, [1], [2]).alias("a")).collect()
    n = len(rows[0]["ids"])
    assert rows[0]["p"] == rows[0]["ids"] + [0] * (4 - n) and rows[0]["m"] == [True] * n + [False] * (4 - n) and rows[0]["l"] == [0] * (4 - n) + rows[0]["ids"] and rows[1]["p"] == [0] * 4
    assert rows[0]["a"] == [1, *[100_000 - i for i in rows[0]["ids"]], 2]
