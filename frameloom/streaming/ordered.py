"""Streams whose rows are handled in frame order, whatever batches and triggers bring them in.

A key's rows go out in the order of their frame numbers, from 0. A row whose predecessors have not all come is held in the key's
state; a gap is given up when the watermark has passed the held row, for then nothing older can come. A key is over when the
watermark has passed its newest row by ``idle`` milliseconds: what is left goes out and its state goes. Both are event-time
timers, one for each key at most; a bucket of keys wakes at its first. State so holds the rows of the disorder that the watermark's delay allows, and no more.

Rows whose frame has gone out already, and second rows of one frame, are left out. Frame numbers and event times must not be null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: State stays outside the heap in this store; streaming.stateful.run_to_table sets it for the query.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys are dealt into so many groups of state.
BUCKETS = 512


class InOrder:
    """The rows of each key in order. Subclasses say what a run of rows gives (``step``) and what they remember (``MEMORY``).

    Keys are handled by buckets of their hash, for a call costs far more than a key does. A bucket's state is an array with an
    entry for each of its keys: next frame, newest time, the key's timer, memory, and the held rows by column."""

    MEMORY = "unused int"
    START: tuple = (0,)

    def __init__(self, by: str, columns: dict[str, str], out: list[str], idle: int):
        """columns: the row's own columns and their kinds, the frame number first."""
        self.by, self.columns, self.out, self.idle = by, columns, out, idle

    def state_schema(self, kind: T.DataType) -> T.StructType:
        held = ", ".join(f"held_{i} array<{k}>" for i, k in enumerate([*self.columns.values(), "long"]))
        own = T.StructType.fromDDL(f"next long, newest long, timer long, {self.MEMORY}, {held}")
        return T.StructType([T.StructField("keys", T.ArrayType(T.StructType([T.StructField("key", kind), *own.fields])))])

    def step(self, memory: tuple, rows: dict[str, np.ndarray], over: bool) -> tuple[tuple, list]:
        raise NotImplementedError

    def _by_key(self, bucket: int, batches: Iterator[pd.DataFrame]) -> dict:
        """The new rows of each key, by column."""
        names = [*self.columns, "at_ms"]
        pdf = pd.concat([p[[self.by, *names]] for p in batches])
        #: Null keys have a bucket of their own.
        codes, keys = pd.factorize(pdf[self.by]) if bucket >= 0 else (np.zeros(len(pdf), np.int64), np.array([None]))
        order = np.argsort(codes, kind="stable")
        ends = np.searchsorted(codes[order], np.arange(len(keys) + 1))
        columns = [pdf[c].to_numpy()[order] for c in names]
        return {key: [c[lo:hi] for c in columns] for key, lo, hi in zip(keys.tolist(), ends[:-1], ends[1:])}

    def handle(self, bucket, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs()
        new = {} if state.hasTimedOut else self._by_key(bucket[0], batches)
        have = {k[0]: tuple(k[1:]) for k in state.get[0]} if state.exists else {}
        start = (0, 0, 0, *self.START, *[[]] * (len(self.columns) + 1))
        stay, keys, outs = [], [], []
        for key in {**have, **new}:
            own, rows = have.get(key, start), new.get(key)
            if rows is None and own[2] > passed:
                stay.append((key, *own))
                continue
            left, out = self._go(own, rows, passed)
            if left is not None:
                stay.append((key, *left))
            if len(out):
                keys += [key] * len(out[0])
                outs.append(out)
        if stay:
            state.update((stay,))
            #: It goes off when the watermark is beyond its time.
            state.setTimeoutTimestamp(max(passed, min(k[3] for k in stay) - 1))
        elif state.exists:
            state.remove()
        if keys:
            joined = [np.concatenate(c) if isinstance(c[0], np.ndarray) else list(chain.from_iterable(c)) for c in zip(*outs)]
            yield pd.DataFrame({self.by: keys, **dict(zip(self.out, joined))})

    def _go(self, own: tuple, new: list[np.ndarray] | None, passed: int) -> tuple[tuple | None, list]:
        """A key's state (None if it is over) and its rows after new ones, or after its timer."""
        k = len(self.columns) + 1
        following, newest, _, *memory = own[:-k]
        parts = [[*([np.array(h)] if len(h) else []), *([new[i]] if new else [])] for i, h in enumerate(own[-k:])]
        all_ = [np.concatenate(p) if p else np.zeros(0) for p in parts]
        number = all_[0].astype(np.int64)
        order = np.argsort(number, kind="stable")
        number = number[order]
        fresh = number >= following
        fresh[1:] &= number[1:] != number[:-1]
        order, number = order[fresh], number[fresh]
        at = all_[-1][order].astype(np.int64)
        newest = max(newest, int(at.max())) if len(at) else newest
        #: Up to the last row that the watermark has passed, and on from there as long as there is no gap.
        due = np.flatnonzero(at <= passed)
        n = int(due[-1]) + 1 if len(due) else 0
        expected = int(number[n - 1]) + 1 if n else following
        run = number[n:] - np.arange(len(number) - n) == expected
        n += int(np.argmin(run)) if not run.all() else len(run)
        following = int(number[n - 1]) + 1 if n else following
        over = new is None and passed >= newest + self.idle and n == len(number)
        memory, out = self.step(tuple(memory), {c: v[order[:n]] for c, v in zip(self.columns, all_)}, over)
        timer = max(passed + 1, int(at[n:].min()) if n < len(at) else newest + self.idle)
        return None if over else (following, newest, timer, *memory, *[v[order[n:]].tolist() for v in all_[:-1]], at[n:].tolist()), out


class _RunningSteps(InOrder):
    MEMORY = "before double, raised boolean, latched double"
    START = (None, False, None)

    def __init__(self, by, columns, out, idle, dt: float, limit: int):
        super().__init__(by, columns, out, idle)
        self.dt, self.limit = dt, limit

    def step(self, memory, rows, over):
        before, raised, latched = memory
        frame, value, flag = rows.values()
        if not len(frame):
            return memory, []
        v, up = value.astype(float), np.where(pd.isna(flag), False, flag).astype(bool)
        ahead = np.concatenate([[np.nan if before is None else before], v[:-1]])
        velocity = np.where(np.isnan(ahead), 0.0, (v - ahead) / self.dt)
        edge = up & ~np.concatenate([[bool(raised)], up[:-1]])
        last = np.maximum.accumulate(np.where(edge & ~np.isnan(v), np.arange(len(v)), -1))
        held = np.where(last >= 0, v[last], np.nan if latched is None else latched)
        out = [frame.astype(np.int64), velocity, frame + 1 >= self.limit, held]
        return (float(v[-1]), bool(up[-1]), None if np.isnan(held[-1]) else float(held[-1])), out


class _LookAround(InOrder):
    MEMORY = "frames array<long>, kept array<double>, gone long, first boolean"
    START = ([], [], 0, True)

    def __init__(self, by, columns, out, idle, offsets: list[int]):
        super().__init__(by, columns, out, idle)
        self.offsets, self.back, self.ahead = offsets, -min(0, *offsets), max(0, *offsets)

    def step(self, memory, rows, over):
        """frames, kept: the last ``back`` rows that have gone out and those that wait; gone: how many of them have gone;
        first: whether they begin with the episode."""
        frames, kept, gone, first = memory
        number, value = rows.values()
        frames = list(frames) + number.astype(np.int64).tolist()
        kept = list(kept) + value.astype(float).tolist()
        last = len(frames) - 1
        upto = len(frames) if over else max(gone, len(frames) - self.ahead)
        at = np.arange(gone, upto)[:, None] + np.array(self.offsets)
        window = np.array(kept)[np.clip(at, 0, last)].tolist() if len(at) else []
        pad = ((bool(first) & (at < 0)) | (at > last)).tolist()
        cut = max(0, upto - self.back)
        return (frames[cut:], kept[cut:], upto - cut, first and cut == 0), [frames[gone:upto], window, pad]


def _handled(stream: DataFrame, by: str, columns: list[str], make, out: list[tuple[str, str]], late: str, clock: str) -> DataFrame:
    kinds = {c: stream.schema[c].dataType.simpleString() for c in columns}
    timed = stream.withColumn("event_time", F.col(clock).cast("timestamp")).withWatermark("event_time", late).select(by, *columns, "event_time", F.unix_millis("event_time").alias("at_ms"), F.when(F.col(by).isNull(), -1).otherwise(F.pmod(F.xxhash64(by), F.lit(BUCKETS))).alias("bucket_"))
    schema = T.StructType([stream.schema[by], *[T.StructField(c, T.DataType.fromDDL(k)) for c, k in out]])
    own = make(kinds, [c for c, _ in out])
    return timed.groupBy("bucket_").applyInPandasWithState(own.handle, schema, own.state_schema(stream.schema[by].dataType), "append", GroupStateTimeout.EventTimeTimeout)


def running_steps(stream: DataFrame, by: str, frame: str, value: str, flag: str, dt: float, limit: int, late: str = "1 hour", clock: str = "ts", idle: int = 0) -> DataFrame:
    """Velocity, time limit and latch (the value at which the flag last rose) of each frame of each key, in frame order."""
    make = lambda kinds, out: _RunningSteps(by, kinds, out, idle, dt, limit)
    return _handled(stream, by, [frame, value, flag], make, [(frame, "long"), ("velocity", "double"), ("truncated", "boolean"), ("latched", "double")], late, clock)


def looked_around(stream: DataFrame, by: str, frame: str, value: str, offsets: list[int], late: str = "1 hour", clock: str = "ts", idle: int = 0) -> DataFrame:
    """Bounded look-back and look-ahead: for each frame the values ``offsets`` frames away in the frame order, clamped to the
    episode's ends, with pad flags. A frame goes out when the one furthest ahead of it has, an episode's last ones when it
    is over. Beside the disorder, the state holds no more rows than the offsets span."""
    make = lambda kinds, out: _LookAround(by, kinds, out, idle, offsets)
    return _handled(stream, by, [frame, value], make, [(frame, "long"), ("window", "array<double>"), ("is_pad", "array<boolean>")], late, clock)
