"""Shuffle buffers, growing histograms, lookups by range, order-true streams: against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import joins as J
from frameloom.operators import sampling as P
from frameloom.operators import stats as S
from frameloom.session import shared_folder
from frameloom.streaming import stateful as Z


@pytest.mark.parametrize("n,size", [(200, 8), (5, 8), (1, 1), (64, 1)])
def test_buffer_gives_what_a_buffer_gives(spark, n, size):
    df = spark.range(n).withColumnRenamed("id", "index").repartition(3)
    got = {(r["shard"], r["given"]): r["index"] for r in P.buffer_shuffled(df, "index", 4, 3, size, 9).collect()}
    draw = lambda place, shard: (place * 31 + shard + 9) * 2654435761 % 1_000_003
    want = {}
    for shard in range(3):
        held, out = [], []
        rows = list(range(shard, n, 3))
        for place, index in enumerate(rows):
            if len(held) < size:
                held.append((place, index))
            else:
                k = draw(place, shard) % size
                out.append(held[k][1])
                held[k] = (place, index)
        out += [i for _, i in sorted(held, key=lambda x: (draw(x[0], shard), x[0]))]
        want |= {(shard, g): i for g, i in enumerate(out)}
    assert got == want and all(i // 3 - g < size for (_, g), i in got.items())


@pytest.mark.parametrize("values", [[0.0] * 5, [1.7e9 + i * 1e-3 for i in range(500)], [-(2.0**i) for i in range(40)] + [3.5], [random.Random(2).gauss(0, 1) * 10 ** (i % 7) for i in range(700)]])
def test_growing_histogram_is_the_same_however_rows_are_dealt(spark, values):
    bins = 32
    k = next(k for k in range(-S.FINEST, 80) if math.floor(max(values) / 2.0**k) - math.floor(min(values) / 2.0**k) < bins)
    want = {}
    for v in values:
        want[math.floor(v / 2.0**k)] = want.get(math.floor(v / 2.0**k), 0) + 1
    df = spark.createDataFrame([("a", v) for v in values] + [("a", None), ("a", float("nan")), ("a", float("inf")), (None, 1.0)], "g string, v double")
    for dealt in (df.coalesce(1), df.repartition(7), df.repartitionByRange(5, "v")):
        rows = S.growing_histogram(dealt, "v", ["g"], bins).where("g = 'a'").collect()
        assert {r["bin"]: r["n"] for r in rows} == want and {r["k"] for r in rows} == {k}
    whole = S.growing_histogram(df.where("g = 'a'"), "v", (), bins)
    assert {r["bin"]: r["n"] for r in whole.collect()} == want
    q = S.growing_quantiles(whole, (), (0.5,)).first()
    exact = float(np.sort(values)[math.ceil(0.5 * len(values)) - 1])
    assert q["count"] == len(values) and abs(q["q50"] - exact) <= 2.0**k


def test_growing_quantiles_between_far_values(spark):
    """The exact quantile is between two values that lie many bins apart."""
    values = [i / 100 for i in range(186)] + [500.0, 1000.0]
    h = S.growing_histogram(spark.createDataFrame([(v,) for v in values], "v double"), "v", (), 64)
    got, width = S.growing_quantiles(h).first(), 2.0 ** h.first()["k"]
    assert got["count"] == len(values)
    for q in S.QUANTILES:
        assert abs(got[S.quantile_name(q)] - float(np.quantile(values, q))) <= width


def test_growing_histogram_merges_in_any_order():
    rng = random.Random(3)
    parts = []
    for _ in range(6):
        v = np.array([rng.gauss(0, 10 ** rng.randint(-3, 6)) for _ in range(50)])
        k = int(S._width(v.min(keepdims=True), v.max(keepdims=True), 64)[0])
        parts.append((k, *[x.astype(np.int64) for x in np.unique(np.floor(np.ldexp(v, -k)), return_counts=True)]))
    left = parts[0]
    for p in parts[1:]:
        left = S._merged_bins(left, p, 64)
    right = parts[-1]
    for p in parts[-2::-1]:
        right = S._merged_bins(p, right, 64)
    assert left[0] == right[0] and left[1].tolist() == right[1].tolist() and left[2].tolist() == right[2].tolist()


def test_lookup_by_range(spark):
    rng = random.Random(6)
    bounds, at = [], 0
    for e in range(60):  # from one unit to a second in nanoseconds
        at += rng.choice([0, 1, 1000, 10**9])
        n = rng.choice([0, 1, 2, 3, 1000, 1 << 20, 10**9])
        bounds.append((e, at, at + n))
        at += n
    points = sorted({p for _, a, b in bounds for p in (a - 1, a, a + 1, (a + b) // 2, b - 1, b)} | {rng.randrange(at) for _ in range(200)})
    frames = spark.createDataFrame([(p,) for p in points], "p long")
    index = spark.createDataFrame(bounds, "e long, s long, t long")
    got = sorted(map(tuple, J.containing(frames, index, "p", "s", "t", ["e"]).collect()))
    assert got == sorted((p, e) for p in points for e, a, b in bounds if a <= p < b)
    assert J._cells(index.withColumn("l", F.col("t") - 1).where("s < t"), "s", "l").count() <= 2 * len(bounds)
    assert J.containing(frames, index.limit(0), "p", "s", "t", ["e"]).count() == 0


def _stream(spark, rows, schema, parts):
    folder = shared_folder(spark)
    for k in range(parts):
        spark.createDataFrame([r for i, r in enumerate(rows) if i % parts == k], schema).coalesce(1).write.parquet(f"{folder}/{k}")
    last = spark.createDataFrame([("end", 0, 0.0, False, "2030-01-01 00:00:00")], schema)
    last.coalesce(1).write.parquet(f"{folder}/{parts}")
    return Z.frame_stream(spark, f"{folder}/*", last.schema)


def test_order_true_steps_over_small_batches_and_gaps(spark):
    """Shuffled rows over five triggers and Arrow batches of 20 rows; key b lacks frame 7, key c has a frame twice."""
    rng = random.Random(8)
    rows = [(k, f, float(f * f), f % 5 == 2, f"2024-01-01 00:{f // 60:02d}:{f % 60:02d}") for k in "abc" for f in range(150) if (k, f) != ("b", 7)] + [("c", 20, -1.0, False, "2024-01-01 00:00:20")]
    rng.shuffle(rows)
    rows.sort(key=lambda r: (r[0], r[1]) == ("c", 20) and r[2] == -1.0)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        stream = _stream(spark, rows, "k string, f long, v double, up boolean, ts string", 5)
        out = [r for r in Z.run_to_table(Z.running_steps(stream, "k", "f", "v", "up", 0.5, 100, "1 hour"), "append").collect() if r["k"] != "end"]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(out) == len(rows) - 1
    for r in out:
        k, f = r["k"], r["f"]
        ahead = f - 2 if (k, f) == ("b", 8) else f - 1
        assert r["velocity"] == (0.0 if f == 0 else (f * f - ahead * ahead) / 0.5) and r["truncated"] == (f + 1 >= 100)
        risen = max((g for g in range(f + 1) if g % 5 == 2 and (k, g) != ("b", 7)), default=None)
        assert r["latched"] == (None if risen is None else float(risen * risen))


def test_action_tokens_are_the_cosine_transform(spark):
    from frameloom.functions import tokens as K

    rng = random.Random(5)
    chunks = [[[rng.uniform(-1, 1) for _ in range(3)] for _ in range(6)] for _ in range(40)]
    m = np.array(K.cosine_matrix(6))
    assert np.allclose(m @ m.T, np.eye(6))
    df = spark.createDataFrame([(i, c) for i, c in enumerate(chunks)], "i int, c array<array<double>>")
    rows = df.select("i", K.action_tokens(F.col("c"), 6, 3, 20.0).alias("t")).withColumn("back", K.actions_of(F.col("t"), 6, 3, 20.0)).orderBy("i").collect()
    for r, c in zip(rows, chunks):
        assert r["t"] == np.rint(20 * (m @ np.array(c))).astype(int).ravel().tolist()
        assert np.abs(np.array(r["back"]) - np.array(c)).max() <= math.sqrt(6) / 40


def test_values_at_other_indices_raise(spark):
    from frameloom.operators import edits as E

    frames = spark.createDataFrame([(i, float(i)) for i in range(4)], "index long, x double")
    values = spark.createDataFrame([(i, 2.0 * i) for i in (0, 1, 2, 9)], "index long, value double")
    with pytest.raises(Exception, match="no value at index 3"):
        E.add_by_position(frames, "v", values).collect()


def test_a_call_steps_all_keys_of_a_bucket(spark):
    """Many keys share one state row: a call an episode made the time of a trigger that of its episodes' calls."""
    import pandas as pd

    from frameloom.streaming import ordered as R

    class State:
        exists, hasTimedOut, get, passed = False, False, None, 0

        def getCurrentWatermarkMs(self):
            return self.passed

        def update(self, value):
            self.get, self.exists = value, True

        def setTimeoutTimestamp(self, ms):
            self.wakes = ms

        def remove(self):
            self.exists = False

    state, steps = State(), R._RunningSteps("k", {"f": "bigint", "v": "double", "up": "boolean"}, ["f", "velocity", "truncated", "latched"], 0, 0.5, 10)
    feed = lambda rows: pd.concat(list(steps.handle((7,), iter([pd.DataFrame(rows, columns=["k", "f", "v", "up", "at_ms"])]), state)) or [pd.DataFrame()])
    first = feed([("a", 1, 3.0, False, 20), ("b", 0, 1.0, True, 15), ("a", 0, 2.0, True, 10), ("c", 1, 5.0, False, 30)])
    assert sorted(first[["k", "f", "velocity", "latched"]].itertuples(index=False, name=None)) == [("a", 0, 0.0, 2.0), ("a", 1, 2.0, 2.0), ("b", 0, 0.0, 1.0)]
    assert len(state.get[0]) == 3 and state.wakes == 14
    state.passed = 16  # b is over when its timer goes off; c still waits for its first frame
    state.hasTimedOut = True
    assert not list(steps.handle((7,), iter([]), state)) and sorted(k[0] for k in state.get[0]) == ["a", "c"]
    state.passed, state.hasTimedOut = 40, True
    assert [tuple(r)[:3] for p in steps.handle((7,), iter([]), state) for r in p.itertuples(index=False)] == [("c", 1, 0.0)] and not state.exists
    nulls = pd.concat(list(steps.handle((-1,), iter([pd.DataFrame({"k": [None, None], "f": [0, 1], "v": [1.0, 2.0], "up": [False, None], "at_ms": [50, 51]})]), State())))
    assert nulls["k"].isna().all() and nulls["velocity"].tolist() == [0.0, 2.0]
