"""Operators of schemas, bridges, steps, statistics and streams on small fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameloom.functions import bridges as B
from frameloom.operators import annotations as N
from frameloom.operators import edits as E
from frameloom.operators import joins as J
from frameloom.operators import reports as R
from frameloom.operators import stats as S
from frameloom.operators import windows as W
from frameloom.plans.pipeline import STEPS, ActionStep, ComplementaryStep, FromTransition, Identity, Normalize, ObservationStep, Pipeline, PolicyActionStep, Rename, RewardStep, ToTransition, Velocity
from frameloom.session import shared_folder
from frameloom.sources import dataset as D
from frameloom.sources import external as G
from frameloom.streaming import stateful as Z


def test_prefix_sums_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(W, "SPAN", 8)
    rng = random.Random(1)
    keys = rng.sample(range(-50, 400), 120)
    rows = [(k, rng.randrange(9)) for k in keys] + [(None, 5)]
    got = {r["k"]: (r["n"], r["s"]) for r in W.prefix_sums(spark.createDataFrame(rows, "k long, v long"), "k", {"n": F.lit(1), "s": F.col("v")}).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for i, (k, v) in enumerate(order):
        assert got[k] == (i, at)
        at += v


@pytest.mark.parametrize("seed", range(4))
def test_greedy_bins_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 2, 7, 30, 120]) for _ in range(200)]
    most_mb, most_n, most_f = rng.choice([50, 100]), rng.choice([None, 3, 6]), rng.choice([None, 40, 90])
    df = spark.createDataFrame(list(enumerate(sizes)), "episode_index long, length long")
    got = [r["batch"] for r in E.episode_batches(df, 1.0, most_mb, most_n, most_f).orderBy("episode_index").collect()]
    want, batch, held = [], 0, []
    for s in sizes:
        if sum(held) > 0 and sum(held) + s >= most_mb or held and (most_n is not None and len(held) + 1 > most_n or most_f is not None and sum(held) + s > most_f):
            batch, held = batch + 1, []
        held.append(s)
        want.append(batch)
    assert got == want


def test_greedy_bins_carry_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.createDataFrame([(i, 1.0) for i in range(100)], "episode_index long, mb double")
        got = [(r["chunk_index"], r["file_index"]) for r in E.file_bins(df, "mb", 10, 3).orderBy("episode_index").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(i // 9 // 3, i // 9 % 3) for i in range(100)]


def test_split_lists_checks(spark):
    df = spark.createDataFrame([(e, f) for e in range(4) for f in range(2)], "episode_index long, frame_index long")
    got = E.split_lists(df, {"a": [3, 0], "b": [2]}).orderBy("split", "index").collect()
    assert [(r["split"], r["episode_index"], r["index"]) for r in got] == [("a", 0, 0), ("a", 0, 1), ("a", 1, 2), ("a", 1, 3), ("b", 0, 0), ("b", 0, 1)]
    for bad in ({"a": [0], "b": [0]}, {"a": [9]}, {"a": []}):
        with pytest.raises(ValueError):
            E.split_lists(df, bad)


def test_features_by_position_and_call(spark):
    df = spark.createDataFrame([(e, f, 2 * e + f) for e in range(2) for f in range(2)], "episode_index long, frame_index long, index long")
    assert [r["v"] for r in E.add_by_position(df, "v", [np.array([x]) for x in (5.0, 6.0, 7.0, 8.0)]).orderBy("index").collect()] == [5, 6, 7, 8]
    assert [r["v"] for r in E.add_by_call(df, "v", lambda row, e, f: np.array([row["index"] * 10.0])).orderBy("index").collect()] == [0, 10, 20, 30]
    with pytest.raises(ValueError):
        E.add_by_position(df, "v", [1.0])
    with pytest.raises(ValueError):
        E.add_by_call(df, "index", lambda *a: 0)


def test_first_interval_over_stretches(spark):
    rng = random.Random(5)
    intervals = [(rng.randrange(3), s, s + rng.randrange(60), f"i{i}") for i, s in enumerate(rng.sample(range(200), 40))]
    points = [(k, p) for k in range(4) for p in range(0, 260, 3)]
    got = J.first_interval(spark.createDataFrame(points, "k long, p long"), spark.createDataFrame(intervals, "k long, s long, e long, name string"), "k", "p", "s", "e", ["name"], "s", width=16)
    first = lambda k, p: min(((s, n) for g, s, e, n in intervals if g == k and s <= p <= e), default=(None, None))[1]
    assert {(r["k"], r["p"]): r["name"] for r in got.collect()} == {(k, p): first(k, p) for k, p in points}


def test_selected_quantiles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(S, "_SHARP", 50)
    rng = random.Random(2)
    rows = [("a", rng.gauss(0, 1)) for _ in range(3000)] + [("b", float(rng.randrange(3))) for _ in range(2000)] + [("c", 1e9 if i == 0 else i / 1e6) for i in range(500)] + [("d", 4.0), ("e", None), (None, 2.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    for bounded in (True, False):
        got = {r["g"]: r for r in S.feature_stats(df, "v", ["g"], bounded=bounded).collect()}
        for g in ("a", "b", "c", "d", None):
            v = [x for k, x in rows if k == g]
            want = np.quantile(v, S.QUANTILES) if len(v) > 1 else [v[0]] * 5
            assert [got[g][S.quantile_name(q)] for q in S.QUANTILES] == pytest.approx(list(want)), (g, bounded)
        assert got["e"]["q50"] is None and got["e"]["count"] == 0
    whole = S.feature_stats(df, "v", bounded=True).first()
    assert whole["q50"] == pytest.approx(np.quantile([x for _, x in rows if x is not None], 0.5))


def test_sketches_stay_small(spark, monkeypatch):
    sharp, own = [], F.percentile_approx
    monkeypatch.setattr(S.F, "percentile_approx", lambda c, p, accuracy: sharp.append(accuracy) or own(c, p, accuracy))
    df = spark.range(60_000).select((F.col("id") % 2).alias("g"), F.pow(F.lit(1.0003), F.pmod(F.col("id") * 7919, F.lit(60_000))).alias("v"))
    got = {r["g"]: r for r in S.feature_stats(df, "v", ["g"], bounded=True).collect()}
    for g in (0, 1):
        v = [1.0003 ** (i * 7919 % 60_000) for i in range(g, 60_000, 2)]
        assert [got[g][S.quantile_name(q)] for q in S.QUANTILES] == pytest.approx(list(np.quantile(v, S.QUANTILES)))
    assert sharp and max(sharp) <= 20_000  # a task may hold a sketch of each dimension


def test_moments_merge_in_any_order(spark):
    rng = random.Random(3)
    rows = [(i % 4, rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "part long, v double")
    parts = S.moments(df, "v", ["part"], bins=20)
    for some in (parts, S.merged_moments(parts.where("part < 2")).unionByName(S.merged_moments(parts.where("part >= 2")))):
        r = S.moment_stats(S.merged_moments(some)).first()
        v = np.array([x for _, x in rows])
        assert (r["count"], r["min"], r["max"]) == (400, v.min(), v.max()) and r["mean"] == pytest.approx(v.mean()) and r["std"] == pytest.approx(v.std())
        assert [r["histogram"].get(i, 0) for i in range(20)] == np.histogram(v, 20, (0, 1))[0].tolist()
    with pytest.raises(Exception, match="fewer than two"):
        S.moment_stats(S.moments(df.limit(1), "v")).collect()


def test_pooled_quantiles_need_every_part(spark):
    df = spark.createDataFrame([(0.0, 1.0, 0.5, 0.1, 4, 0.2), (0.0, 2.0, 1.0, 0.2, 4, None)], "min double, max double, mean double, std double, count long, q50 double")
    assert S.pooled_stats(df, quantiles=(0.5, 0.9)).first()["q50"] is None
    assert S.pooled_stats(df.limit(1), quantiles=(0.5,)).first()["q50"] == pytest.approx(0.2)


def test_agreement_and_counters(spark):
    df = spark.createDataFrame([(30.0, "a", ["x"]), (30.0, "a", ["x"])], "fps double, robot_type string, features array<string>")
    assert S.agreement(df, df.columns).first()["same"] and not S.agreement(df.unionByName(df.withColumn("fps", F.lit(10.0))), df.columns).first()["same"]
    r = spark.range(1).select(*[c.alias(k) for k, c in S.progress_counters(F.lit(10), 64, 100.0, 6400).items()]).first()
    assert (r["samples"], r["episodes"], r["epochs"]) == (640, 6.4, 0.1)


def test_stat_checks():
    R.check_stats([{"state": {"mean": [1.0], "count": [3]}, "observation.image": {"mean": [[[0.1]], [[0.2]], [[0.3]]], "count": [1]}}])
    for bad in ({"state": {"count": [1, 2]}}, {"observation.image": {"mean": [0.1, 0.2, 0.3]}}, {"state": {"mean": 1.0}}):
        with pytest.raises(ValueError):
            R.check_stats([bad])
    assert R.has_quantiles({"a": {"q50": [1]}}) and not R.has_quantiles({"a": {"mean": [1]}}) and not R.has_quantiles(None)


def test_names_and_schemas():
    assert B.kept("observation.state.x", None) and B.kept("a.b", ["z", r"\.b$"]) and not B.kept("a.b", ["z"])
    assert B.stripped("action.joint", B.PREFIXES) == "joint" and B.stripped("other", B.PREFIXES) == "other"
    made = B.dataset_schema({"action.a": float, "action.b": float}, {"observation.state.x": float, "observation.images.cam": (4, 6, 3), "noise": float}, patterns=["action", "state"])
    assert made == {"action": {"dtype": "float32", "shape": (2,), "names": ("a", "b")}, "observation.state": {"dtype": "float32", "shape": (1,), "names": ("x",)}, "observation.images.cam": {"dtype": "video", "shape": (4, 6, 3), "names": ("height", "width", "channels")}}
    assert "observation.images.cam" not in B.dataset_schema({}, {"observation.images.cam": (4, 6, 3)}, images=False)
    assert B.offsets_in_seconds(["action", "observation.state", "next.reward", "task"], 10, action=[0, 1], observation=[-1, 0]) == {"action": [0.0, 0.1], "observation.state": [-0.1, 0.0]}
    assert B.offsets_in_seconds(["task"], 10, action=[0]) is None
    assert B.checkpoint_stats({"normalize_inputs.buffer_observation_state.mean": [1], "unnormalize_outputs.buffer_action.std": [2], "model.weight": [3], "normalize.action.min": [0]}) == {"observation.state": {"mean": [1]}, "action": {"std": [2], "min": [0]}}
    kinds, modes = B.kinds_and_modes({"observation.image": {"mean": 1, "std": 1}, "observation.state": {"min": 0, "max": 1}, "action": {"min": 0, "max": 1}})
    assert kinds == {"observation.image": "VISUAL", "observation.state": "STATE", "action": "ACTION"} and modes == {"VISUAL": "MEAN_STD", "STATE": "MIN_MAX", "ACTION": "MIN_MAX"}
    assert D.policy_features({"c": D.Feature("video", (4, 6, 3), ("height", "width", "channels")), "action": D.Feature("float32", (2,)), "other": D.Feature("int64")}) == {"c": ("VISUAL", (3, 4, 6)), "action": ("ACTION", (2,))}


def test_environment_observations(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0], (1.5,), (b"x", b"y"))], "agent_pos array<double>, environment_state array<double>, robot_state struct<z: double>, pixels struct<top: binary, side: binary>")
    out = B.policy_observation(df)
    assert set(out.columns) == {"observation.state", "observation.environment_state", "observation.robot_state", "observation.images.top", "observation.images.side"}
    assert out.schema["observation.state"].dataType == T.ArrayType(T.FloatType())


def test_transition_round_trip(spark):
    df = spark.createDataFrame([([1.0], [0.5], 2.0, True, "t", 7, False)], "`observation.state` array<double>, action array<double>, `next.reward` double, done boolean, task string, index long, `observation.state_is_pad` boolean")
    t = ToTransition()(df)
    inner = t.first()["transition"]
    assert inner["reward"] == 2.0 and inner["done"] and not inner["truncated"] and inner["complementary"]["index"] == 7 and not inner["complementary"]["observation.state_is_pad"]
    back = FromTransition()(t.select("transition")).first()
    assert (back["observation.state"], back["action"], back["next.reward"], back["next.done"], back["next.truncated"], back["task"], back["index"]) == ([1.0], [0.5], 2.0, True, False, "t", 7)


class _Doubled(ObservationStep):
    def cell(self, c, name):
        return F.transform(c, lambda x: x * 2)


class _Flipped(PolicyActionStep):
    def cell(self, c, name):
        return F.transform(c, lambda x: -x)


class _Paid(RewardStep):
    def cell(self, c, name):
        return c + 1


class _Tagged(ComplementaryStep):
    def cell(self, c, name):
        return F.upper(c) if name == "task" else c


def test_typed_steps_and_their_schemas(spark):
    df = spark.createDataFrame([(0, 0, [1.0], [0.5], 2.0, "t")], "episode_index long, frame_index long, `observation.state` array<double>, action array<double>, reward double, task string")
    steps = Pipeline([_Doubled(), _Flipped(), _Paid(), _Tagged(), Identity(), Velocity("observation.state")])
    r = steps.schema(df.schema)
    assert r.names == [*df.columns, "velocity"] and r["velocity"].dataType == T.ArrayType(T.DoubleType())
    out = Pipeline(steps.steps[:5])(df).first()
    assert (out["observation.state"], out["action"], out["reward"], out["task"]) == ([2.0], [-0.5], 3.0, "T")
    steps.reset()
    with pytest.raises(ValueError):
        _Paid()(df.drop("reward"))
    with pytest.raises(TypeError):
        _Flipped()(df.withColumn("action", F.lit(1.0)))
    assert issubclass(_Flipped, ActionStep) and _Tagged()(df.drop("task")).columns == [c for c in df.columns if c != "task"]


def test_saved_state_and_overrides(spark):
    own = Normalize({"x": "MEAN_STD"}, {"x": {"mean": 2.0, "std": 4.0}})
    assert "stats" not in own.config()
    again = Pipeline.from_json(Pipeline([Identity(), own]).to_json())
    assert again[1].stats == own.stats and again.state() == {"1": {"x.mean": 2.0, "x.std": 4.0}}
    other = Pipeline.from_json(Pipeline([own]).to_json(), {"normalizer": {"stats": {"x": {"mean": 0.0, "std": 1.0}}}})
    assert other[0].stats == {"x": {"mean": 0.0, "std": 1.0}}
    assert Rename({"a": "b"}).stats({"a": {"mean": 1}, "c": {}}) == {"b": {"mean": 1}, "c": {}}
    with pytest.raises(ValueError):
        Identity().load_state({"a": 1})
    assert "from_transition" in STEPS.names()


def test_annotations_keep_older_columns(spark):
    episodes = spark.createDataFrame([(0, ["old"], [1.0], [2.0]), (1, ["kept"], [3.0], [4.0])], "episode_index long, subtask_names array<string>, subtask_start_times array<double>, subtask_end_times array<double>")
    subtasks = spark.createDataFrame([(0, 1, "b", "00:10", "01:05"), (0, 0, "a", "00:00", "00:09")], "episode_index long, position int, name string, start string, end string")
    out = N.annotated(episodes, subtasks, 10.0)
    rows = {r["episode_index"]: r for r in out.collect()}
    assert rows[0]["sparse_subtask_names"] == ["a", "b"] == rows[0]["subtask_names"] and rows[0]["sparse_subtask_end_frames"] == [90, 650]
    assert rows[1]["sparse_subtask_names"] is None and rows[1]["subtask_names"] == ["kept"]
    assert sorted(map(tuple, N.subtasks_of(out).collect())) == [(0, 0, "a", "00:00", "00:09"), (0, 1, "b", "00:10", "01:05")]
    assert [r["name"] for r in N.subtasks_of(episodes).orderBy("episode_index").collect()] == ["old", "kept"]
    assert N.subtasks_of(episodes, "dense").count() == 0
    assert N.column_of(["dense_subtask_names", "subtask_names"], "dense", "subtask_names") == "dense_subtask_names" and N.column_of([], "dense", "x") is None


def test_create_and_write_dataset(spark, tmp_path):
    info = D.Info(fps=10.0, features={"x": D.Feature("float64"), "cam": D.Feature("video", (4, 6, 3))})
    made = D.create(spark, str(tmp_path / "new"), info)
    assert D.EpisodeDataset.load(spark, made.root).info.total_episodes == 0 and made.camera_keys == made.video_keys == ["cam"] and made.shapes["cam"] == (4, 6, 3)
    with pytest.raises(FileExistsError):
        D.create(spark, made.root, info)
    with pytest.raises(ValueError):
        D.create(spark, str(tmp_path / "bad"), D.Info(10.0, {"index": D.Feature("int64")}))
    rows = spark.createDataFrame([(e, 10 - f, float(f), "t") for e in range(3) for f in range(4)], "episode_index long, at long, x double, task string")
    done = D.write(D.recorded(rows, "at", 10.0).drop("at"), str(tmp_path / "data"), D.Info(10.0, {"x": D.Feature("float64")}))
    assert [r["x"] for r in done.frames([1]).orderBy("frame_index").collect()] == [3.0, 2.0, 1.0, 0.0]
    sizes = R.file_sizes(spark, f"{done.root}/data")
    assert sizes.where("bytes > 0").count() == sizes.count() > 0
    with pytest.raises(ValueError):
        G.progress(spark, f"{done.root}/data/*/*.parquet", "dense")


def _stream_of(spark, rows, schema, parts):
    folder = shared_folder(spark)
    for i in range(parts):
        spark.createDataFrame([r for k, r in enumerate(rows) if k * parts // len(rows) == i], schema).coalesce(1).write.mode("append").parquet(folder)
    return Z.frame_stream(spark, folder, spark.createDataFrame([], schema).schema)


def test_streams_over_several_triggers(spark):
    rng = random.Random(4)
    rows = [(i % 3, i, float(rng.randrange(50))) for i in range(90)]
    stream = lambda: _stream_of(spark, rows, "k long, seq long, v double", 4)
    stats = {r["k"]: r for r in Z.run_to_table(Z.online_stats(stream(), "k", "v"), "update", ["k"]).collect()}
    for k in range(3):
        v = np.array([x for g, _, x in rows if g == k])
        assert stats[k]["n"] == 30 and stats[k]["mean"] == pytest.approx(v.mean()) and stats[k]["std"] == pytest.approx(v.std())
    ring = {r["k"]: r["sequences"] for r in Z.run_to_table(Z.ring(stream(), "k", "seq", "v", 5), "update", ["k"]).collect()}
    assert ring == {k: [s for g, s, _ in rows if g == k][-5:] for k in range(3)}
    passed = sorted((r["k"], r["seq"]) for r in Z.run_to_table(Z.admitted(stream(), "k", "seq", "v", 15.0), "append").collect())
    want = []
    for k in range(3):
        last = None
        for g, s, v in rows:
            if g == k and (last is None or abs(v - last) >= 15):
                last = v
                want.append((k, s))
    assert passed == sorted(want)


def test_bounded_look_around(spark):
    rows = [(e, f, 10.0 * e + f, f"2024-01-0{1 + e} 00:00:{f:02d}") for e in range(3) for f in range(12)]
    stream = _stream_of(spark, rows, "k long, f long, v double, ts string", 5)
    out = Z.run_to_table(Z.looked_around(stream, "k", "f", "v", [-3, 0, 2], "1 minute"), "append").collect()
    got = {(r["k"], r["f"]): (r["window"], r["is_pad"]) for r in out}
    assert len(got) == len(out)
    for (k, f), (window, pad) in got.items():
        assert window == [10.0 * k + min(max(f + d, 0), 11) for d in (-3, 0, 2)] and pad == [not 0 <= f + d <= 11 for d in (-3, 0, 2)]
    #: Episodes that the watermark has passed are whole; the last one waits for later rows.
    assert {(k, f) for k in range(2) for f in range(12)} <= set(got) and {(2, f) for f in range(10)} <= set(got)


def test_messages_with_gaps_are_left_out(spark):
    parts = Z.chunked(spark.createDataFrame([("a", bytearray(b"x" * 25)), ("b", bytearray(b"")), ("c", bytearray(b"hello"))], "message string, body binary"), size=10)
    whole = {r["message"]: bytes(r["body"]) for r in Z.joined_chunks(parts).collect()}
    assert whole == {"a": b"x" * 25, "b": b"", "c": b"hello"}
    assert {r["message"] for r in Z.joined_chunks(parts.where("not (message = 'a' and place = 1)")).collect()} == {"b", "c"}
    assert math.isclose(parts.where("message = 'a'").count(), 3)
