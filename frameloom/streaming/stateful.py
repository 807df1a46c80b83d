"""Structured Streaming forms of the stateful operators; event time comes from a cast to TIMESTAMP in UTC."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_folder
from .ordered import STORE, looked_around, running_steps  # noqa: F401


def frame_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files, or a glob (a single file must be given as one)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(stream: DataFrame, time: str, width: str, by: list[str], value: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Tumbling or sliding event-time windows with a watermark: count, sum, min and max."""
    rows = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    w = F.window("_t", width, slide) if slide else F.window("_t", width)
    return rows.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total", "low", "high")


def sessions(stream: DataFrame, time: str, gap: str, by: list[str], late: str = "1 hour") -> DataFrame:
    rows = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return rows.groupBy(F.session_window("_t", gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def _added(n: int, mean: float, m2: float, v: np.ndarray) -> tuple[int, float, float]:
    """The moments (n, mean, sum of squared distances from it) after more values."""
    k = len(v)
    own = float(v.mean())
    apart, both = own - mean, n + k
    return both, mean + apart * k / both, m2 + float(((v - own) ** 2).sum()) + apart * apart * n * k / both


def online_stats(stream: DataFrame, by: str, value: str) -> DataFrame:
    """Running n, mean, population std, min and max of each key, emitted at each trigger: moments merge, nothing else is kept."""

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2, lo, hi = state.get if state.exists else (0, 0.0, 0.0, float("inf"), float("-inf"))
        for pdf in batches:
            v = pdf[value].dropna().to_numpy(float)
            if len(v):
                n, mean, m2 = _added(n, mean, m2, v)
                lo, hi = min(lo, float(v.min())), max(hi, float(v.max()))
        state.update((n, mean, m2, lo, hi))
        yield pd.DataFrame({by: [key[0]], "n": [n], "mean": [mean if n else None], "std": [(m2 / n) ** 0.5 if n else None], "min": [lo if n else None], "max": [hi if n else None]})

    kind = stream.schema[by].dataType.simpleString()
    return stream.select(by, value).groupBy(by).applyInPandasWithState(update, f"{by} {kind}, n long, mean double, std double, min double, max double", "n long, mean double, m2 double, lo double, hi double", "update", GroupStateTimeout.NoTimeout)


def online_histogram(stream: DataFrame, by: str, value: str, low: float, high: float, bins: int = 256) -> DataFrame:
    """online_stats with a histogram on a fixed range (values beyond it in its ends), from which quantiles come; the state is
    ``bins`` counts and five numbers a key."""

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2, lo, hi, counts = state.get if state.exists else (0, 0.0, 0.0, float("inf"), float("-inf"), [0] * bins)
        counts = np.array(counts, np.int64)
        for pdf in batches:
            v = pdf[value].dropna().to_numpy(float)
            if len(v):
                n, mean, m2 = _added(n, mean, m2, v)
                lo, hi = min(lo, float(v.min())), max(hi, float(v.max()))
                at = np.clip(((v - low) / (high - low) * bins).astype(np.int64), 0, bins - 1)
                counts += np.bincount(at, minlength=bins)
        held = counts.tolist()
        state.update((n, mean, m2, lo, hi, held))
        yield pd.DataFrame({by: [key[0]], "n": [n], "mean": [mean if n else None], "std": [(m2 / n) ** 0.5 if n else None], "min": [lo if n else None], "max": [hi if n else None], "histogram": [held]})

    kind = stream.schema[by].dataType.simpleString()
    return stream.select(by, value).groupBy(by).applyInPandasWithState(update, f"{by} {kind}, n long, mean double, std double, min double, max double, histogram array<long>", "n long, mean double, m2 double, lo double, hi double, counts array<long>", "update", GroupStateTimeout.NoTimeout)


def ring(stream: DataFrame, by: str, sequence: str, value: str, capacity: int) -> DataFrame:
    """A ring buffer for each key: after each trigger, its newest ``capacity`` values with their sequence numbers."""

    def update(key, batches, state: GroupState):
        seq, val = (list(x) for x in state.get) if state.exists else ([], [])
        for pdf in batches:
            seq += pdf[sequence].tolist()
            val += pdf[value].tolist()
        kept = sorted(zip(seq, val))[-capacity:]
        state.update(([k for k, _ in kept], [v for _, v in kept]))
        yield pd.DataFrame({by: [key[0]], "sequences": [[k for k, _ in kept]], "held": [[v for _, v in kept]]})

    kind = stream.schema[by].dataType.simpleString()
    return stream.select(by, sequence, value).groupBy(by).applyInPandasWithState(update, f"{by} {kind}, sequences array<long>, held array<double>", "sequences array<long>, held array<double>", "update", GroupStateTimeout.NoTimeout)


def admitted(stream: DataFrame, by: str, timestep: str, value: str, tolerance: float, horizon: int = 100_000) -> DataFrame:
    """Observations that pass: the first of a key, and those with an unseen timestep whose value moved by the tolerance.

    The state holds the admitted timesteps of the last ``horizon``; an observation that is older than that is late and doesn't pass."""

    def update(key, batches, state: GroupState):
        seen, last = (set(state.get[0]), state.get[1]) if state.exists else (set(), None)
        newest = max(seen, default=None)
        rows = pd.concat(list(batches)).sort_values(timestep)
        out = []
        for step, v in zip(rows[timestep], rows[value]):
            if last is None or (step > newest - horizon and step not in seen and abs(v - last) >= tolerance):
                seen.add(int(step))
                newest = int(step) if newest is None else max(newest, int(step))
                last = float(v)
                out.append((key[0], int(step), float(v)))
        state.update((sorted(s for s in seen if s > newest - horizon), last))
        yield pd.DataFrame(out, columns=[by, timestep, value])

    kind = stream.schema[by].dataType.simpleString()
    return stream.select(by, timestep, value).groupBy(by).applyInPandasWithState(update, f"{by} {kind}, {timestep} long, {value} double", "seen array<long>, last double", "append", GroupStateTimeout.NoTimeout)


def joined_chunks(parts: DataFrame, message: str = "message", place: str = "place", state: str = "state", body: str = "body") -> DataFrame:
    """Messages that came in pieces (state: begin, middle, end) put together; only those whose begin and end have come and
    whose places have no gap."""
    whole = parts.groupBy(message).agg(F.array_sort(F.collect_list(F.struct(place, body))).alias("_p"), F.max(F.when(F.col(state) == "end", F.col(place))).alias("_last"), F.min(F.when(F.col(state) == "begin", F.col(place))).alias("_first"))
    complete = whole.where((F.size("_p") == F.col("_last") - F.col("_first") + 1))
    return complete.select(message, F.aggregate("_p", F.unhex(F.lit("")), lambda a, x: F.concat(a, x[body])).alias(body))


def chunked(messages: DataFrame, message: str = "message", body: str = "body", size: int = 1 << 21) -> DataFrame:
    """Each message's bytes in pieces of ``size``: place, state (begin, middle or end; a single piece is begin and then end) and body."""
    n = F.greatest(F.ceil(F.length(body) / F.lit(float(size))), F.lit(2)).cast("int")
    pieces = messages.select(message, n.alias("_n"), body, F.explode(F.sequence(F.lit(0), n - 1)).alias("place"))
    state = F.when(F.col("place") == 0, "begin").when(F.col("place") == F.col("_n") - 1, "end").otherwise("middle")
    return pieces.select(message, "place", state.alias("state"), F.substring(F.col(body), F.col("place") * size + 1, F.lit(size)).alias(body))


def merged_actions(stream: DataFrame, by: str, timestep: str, action: str, weights: tuple[float, float] = (0.3, 0.7)) -> DataFrame:
    """The action queue of each key: steps already run are late, overlaps are blended, the queue is the newest chunk's
    steps. ``latest`` (a column of the stream) is the last step that was run when the chunk came."""
    old, new = weights

    def update(key, batches, state: GroupState):
        steps, held = (list(x) for x in state.get) if state.exists else ([], [])
        queue = dict(zip(steps, held))
        rows = pd.concat(list(batches)).sort_values(["chunk", timestep])
        for _, chunk in rows.groupby("chunk", sort=True):
            ok = chunk[chunk[timestep] > chunk["latest"]]
            queue = {int(s): (old * queue[int(s)] + new * float(a) if int(s) in queue else float(a)) for s, a in zip(ok[timestep], ok[action])}
        state.update((list(queue), list(queue.values())))
        yield pd.DataFrame({by: [key[0]] * len(queue), timestep: list(queue), action: list(queue.values())})

    kind = stream.schema[by].dataType.simpleString()
    return stream.groupBy(by).applyInPandasWithState(update, f"{by} {kind}, {timestep} long, {action} double", "steps array<long>, held array<double>", "update", GroupStateTimeout.NoTimeout)


def route(stream: DataFrame, folder: str, flag: str, checkpoint: str):
    """Every transition without NaN to <folder>/online, and flagged ones also to <folder>/offline; exactly-once by file sink batches."""

    def write(batch: DataFrame, epoch: int) -> None:
        kept = batch.where(~F.isnan("reward")).withColumn("epoch", F.lit(epoch)).persist()
        kept.write.mode("overwrite").parquet(f"{folder}/online/epoch={epoch}")
        kept.where(flag).write.mode("overwrite").parquet(f"{folder}/offline/epoch={epoch}")
        kept.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, mode: str, keys: list[str] | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there, and read what it gave from Parquet in the shared folder; nothing comes to the driver.

    Each trigger's rows are one folder, written anew if a trigger is run again. In complete mode the last trigger's rows are
    the result; in update mode, with ``keys``, each key's rows of the last trigger that has it."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    schema = stream.schema

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")

    writer = stream.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{folder}/checkpoint")
    #: The store of ordered.py's state; the query keeps what the session has when it starts.
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, STORE)
    try:
        query = writer.start()
    finally:
        spark.conf.set(setting, before)
    query.awaitTermination()
    kept = T.StructType([*schema.fields, T.StructField("epoch", T.IntegerType())])
    rows = spark.read.schema(kept).option("basePath", f"{folder}/rows").option("recursiveFileLookup", "false").parquet(f"{folder}/rows")
    if mode == "complete":
        rows = rows.join(rows.agg(F.max("epoch").alias("epoch")), "epoch")
    elif mode == "update" and keys:
        rows = rows.join(rows.groupBy(*keys).agg(F.max("epoch").alias("epoch")), [*keys, "epoch"])
    return rows.select(*schema.names)
