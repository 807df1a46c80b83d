"""Literals of small fixtures."""

import json
import math

import pytest
from pyspark.sql import functions as F

from frameloom.functions import features as X
from frameloom.operators import edits as E
from frameloom.operators import joins as J
from frameloom.operators import replay as R
from frameloom.operators import sampling as P
from frameloom.operators import stats as S
from frameloom.operators import windows as W
from frameloom.plans.pipeline import STEPS, Normalize, Pipeline, Registry, Rename, hot_swap
from frameloom.sources import dataset as D


def frames(spark, lengths, start=0.0):
    rows = [(e, f, start + 10.0 * e + f) for e, n in enumerate(lengths) for f in range(n)]
    return spark.createDataFrame(rows, "episode_index long, frame_index long, value double")


def test_vector_stats_literals(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([4.0, 5.0, 6.0],), ([7.0, 8.0, 9.0],)], "v array<double>")
    got = S.vector_stats(df, "v").orderBy("dim").collect()
    assert [r["min"] for r in got] == [1, 2, 3] and [r["max"] for r in got] == [7, 8, 9] and [r["mean"] for r in got] == [4, 5, 6]
    assert all(math.isclose(r["std"], 2.44948974, rel_tol=1e-8) and r["count"] == 3 for r in got)
    rows = df.select(*S.row_stats("v")).collect()
    assert all(math.isclose(r["std"], 0.81649658, rel_tol=1e-7) for r in rows)
    g = S.global_stats(df, "v").first()
    assert (g["min"], g["max"], g["mean"], g["count"]) == (1, 9, 5, 3) and math.isclose(g["std"], 2.5819889, rel_tol=1e-7)


def test_pooled_stats_literals(spark):
    df = spark.createDataFrame([(1.0, 10.0, 5.0, 2.0, 1), (2.0, 12.0, 6.0, 2.5, 1)], "min double, max double, mean double, std double, count long")
    r = S.pooled_stats(df, quantiles=()).first()
    assert (r["min"], r["max"], r["mean"], r["count"]) == (1, 12, 5.5, 2) and math.isclose(r["std"], 2.318405, rel_tol=1e-6)


def test_single_row_quantiles_are_the_mean(spark):
    r = S.feature_stats(spark.createDataFrame([(3.0,)], "v double"), "v").first()
    assert r["std"] == 0 and r["q01"] == r["q99"] == 3.0
    assert S.quantile_name(0.29) == "q28"


@pytest.mark.parametrize("n,k", [(1, 1), (10, 10), (100, 100), (200, 100), (1000, 177), (2000, 299), (5000, 594), (10000, 1000), (20000, 1681), (50000, 3343), (500000, 10000)])
def test_sample_count(n, k):
    assert P.sample_count(n) == k


def test_sample_positions_equal_sql_at_odd_lengths(spark, tmp_path):
    import duckdb

    from frameloom.plans import catalog

    con = duckdb.connect()
    con.execute(f"COPY (SELECT unnest(range(9)) AS doc_id, unnest([0, NULL, 1, 2, 3, 101, 256, 9999, 128657]) AS n_chars) TO '{tmp_path}/documents.parquet'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    ours = catalog.queries()["sample_positions"](spark, str(tmp_path)).select("doc_id", "k", "total", "last").collect()
    theirs = con.execute(f"SELECT doc_id, k, total, last FROM ({catalog.oracle_sql()['sample_positions']})").fetchall()
    assert sorted(map(tuple, ours)) == sorted(theirs)
    assert 0 not in {r["doc_id"] for r in ours}
    assert spark.range(1).select(P.sample_positions(F.lit(0)).alias("p")).first()["p"] == []


def test_delta_indices():
    assert W.delta_indices([i / 30 for i in range(-10, 10)], 30) == list(range(-10, 10))
    W.delta_indices([1 / 30 + 0.9e-4], 30)
    with pytest.raises(ValueError):
        W.delta_indices([1 / 30 + 1.1e-4], 30)


def test_windows_clamp_and_keep_nulls(spark):
    df = spark.createDataFrame([(0, 0, None), (0, 1, 1.0), (0, 2, 2.0)], "episode_index long, frame_index long, value double")
    got = W.delta_window(df, {"value": [-5, -1, 1]}).orderBy("frame_index").collect()
    assert [r["value_m1"] for r in got] == [None, None, 1.0] and [r["value_m5_is_pad"] for r in got] == [True] * 3 and [r["value_p1"] for r in got] == [1.0, 2.0, 2.0]


def test_batch_and_streaming_windows_differ(spark):
    df = frames(spark, [4])
    batch = W.delta_window(df, {"value": [-5, 0]}).where("frame_index = 2").first()
    stream = W.repeated_window(df, "value", [-5, 0]).where("frame_index = 2").first()
    assert batch["value_m5"] == 0.0 and stream["value_m5"] == 2.0


def test_prefix_weights():
    assert W.prefix_weights("zeros", 2, 4, 6) == [1, 1, 0, 0, 0, 0] and W.prefix_weights("ones", 2, 4, 6) == [1, 1, 1, 1, 0, 0]
    assert W.prefix_weights("linear", 1, 4, 6) == pytest.approx([1, 0.75, 0.5, 0.25, 0, 0])
    assert W.prefix_weights("exp", 1, 4, 6)[1] == pytest.approx(0.75 * math.expm1(0.75) / (math.e - 1))


def test_interpolation_edges(spark):
    df = spark.createDataFrame([(0, 0, None), (0, 1, 1.0), (0, 2, float("nan")), (0, 3, 3.0), (0, 4, None), (1, 0, None)], "episode_index long, frame_index long, p double")
    got = [r[0] for r in df.withColumn("q", W.interpolated("p")).orderBy("episode_index", "frame_index").select("q").collect()]
    assert got == [1.0, 1.0, 2.0, 3.0, 3.0, None]


def test_edits_round_trip(spark):
    df = frames(spark, [3, 2, 4, 1])
    kept = E.delete_episodes(df, [1])
    rows = kept.orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(8)) and {r["episode_index"] for r in rows} == {0, 1, 2}
    with pytest.raises(ValueError):
        E.delete_episodes(df, [])
    with pytest.raises(ValueError):
        E.check_episodes(df, [9])
    with pytest.raises(ValueError):
        E.check_episodes(df, [0, 1, 2, 3])
    parts = E.split(df.withColumn("task", F.lit("t")), {"a": 0.5, "b": 0.25})
    assert {k: v.select("episode_index").distinct().count() for k, v in parts.items()} == {"a": 2, "b": 2}
    merged = E.merge([parts["a"], parts["b"]])
    assert sorted(r["index"] for r in merged.collect()) == list(range(10)) and merged.agg(F.sum("value")).first()[0] == df.agg(F.sum("value")).first()[0]
    assert E.split_bounds(3, {"a": 0.1, "b": 0.9}) == {"b": (0, 3)}


def test_modify_features_errors(spark):
    df = frames(spark, [2])
    with pytest.raises(ValueError):
        E.modify_features(df, remove=["frame_index"])
    with pytest.raises(ValueError):
        E.modify_features(df, {"value": F.lit(1)})
    with pytest.raises(ValueError):
        E.modify_features(df, remove=["nothing"])


def test_sampler_weights_literals(spark):
    off, on = frames(spark, [2, 2]), frames(spark, [2, 2, 2, 2])
    w = lambda **o: [round(r["weight"], 6) for r in P.sampler_weights(off, on, **o).orderBy("source", "episode_index", "frame_index").collect()]
    assert w(ratio=0.8) == [0.05] * 4 + [0.1] * 8
    assert w(ratio=0.8, online_drop=1) == [0.05] * 4 + [0.2, 0.0] * 4
    two = P.sampler_weights(frames(spark, [2]), on, 0.5, 1, 1).orderBy("source", "episode_index", "frame_index").collect()
    assert [r["weight"] for r in two] == pytest.approx([0.5, 0, 0.125, 0, 0.125, 0, 0.125, 0, 0.125, 0])
    assert [r["weight"] for r in P.sampler_weights(off, offline_drop=1).collect()] == [0.25] * 4
    assert sorted(r["weight"] for r in P.sampler_weights(off, offline_drop=1, strict=True).collect()) == [0, 0, 0.5, 0.5]
    assert P.kept_frames(frames(spark, [3, 2]), 2, 2).count() == 0


def test_nearest_ties_and_tolerance(spark):
    q = spark.createDataFrame([(1, 1.0), (1, 9.0), (2, 0.0)], "g long, qt double")
    s = spark.createDataFrame([(1, 0.5, "a"), (1, 1.5, "b")], "g long, t double, v string")
    got = {(r["g"], r["qt"]): (r["v"], r["is_pad"]) for r in J.nearest(q, s, "g", "qt", "t", ["v"], 1.0).collect()}
    assert got == {(1, 1.0): ("a", False), (1, 9.0): ("b", True), (2, 0.0): (None, True)}


def test_proportions_literals(spark):
    rows = [(0, "reach", 0, 80.0), (0, "grasp", 1, 20.0), (1, "reach", 0, 40.0), (1, "grasp", 1, 160.0)]
    got = {r["name"]: r["proportion"] for r in S.temporal_proportions(spark.createDataFrame(rows, "episode_index long, name string, start long, duration double")).collect()}
    assert got == pytest.approx({"reach": 0.5, "grasp": 0.5})


def test_stage_and_progress(spark):
    stages = [(0, 10, 0), (15, 20, 1)]
    df = spark.createDataFrame([(f, stages) for f in (-1, 5, 10, 12, 20, 25)], "f long, s array<struct<start:long,end:long,stage:long>>")
    st, tau = X.stage_and_tau(F.col("f"), F.col("s"), 3)
    assert [tuple(r) for r in df.select(st, tau).collect()] == [(0, 0.0), (0, 0.5), (0, 1.0), (0, 1.0), (1, 1.0), (2, 0.999)]
    assert X.breakpoints([2, 2]) == [0.0, 0.5, 1.0]
    p = spark.createDataFrame([(-1.0,), (0.5,), (1.5,), (3.0,)], "x double").select(X.overall_progress(F.col("x"), [0.0, 0.2, 1.0]))
    assert [r[0] for r in p.collect()] == pytest.approx([0, 0.1, 0.6, 1])


def test_advantage_weights(spark):
    df = spark.createDataFrame([(0.5,), (0.01,), (-0.1,), (None,), (float("nan"),)], "d double")
    got = [r[0] for r in df.select(X.advantage_weight(F.col("d"), 0.02, 0.01, 0.1, 0.7)).collect()]
    assert got == pytest.approx([1.0, (0.01 - 0.0) / (0.04 + 1e-6), 0.0, 0.7, 0.7])


def test_discretize_edges(spark):
    df = spark.createDataFrame([(-1.5,), (-1.0,), (0.0,), (0.999,), (1.0,), (5.0,)], "x double")
    assert [r[0] for r in df.select(X.discretize(F.col("x"))).collect()] == [-1, 0, 128, 255, 255, 255]


def test_rotations(spark):
    half = math.sqrt(0.5)
    df = spark.range(1).withColumn("q", F.array(F.lit(0.0), F.lit(0.0), F.lit(half), F.lit(half)))
    q = F.col("q")
    r = df.select(X.quaternion_to_axis_angle(q).alias("a"), X.rotate(X.quaternion_to_matrix(q), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).alias("v"), X.quaternion_multiply(q, X.quaternion_inverse(q)).alias("i"), X.rotvec_to_quaternion(X.quaternion_to_axis_angle(q)).alias("b"), X.six_d_to_matrix(F.array(*[F.lit(x) for x in (2.0, 0.0, 0.0, 1.0, 3.0, 0.0)])).alias("m")).first()
    assert r["a"] == pytest.approx([0, 0, math.pi / 2]) and r["v"] == pytest.approx([0, 1, 0]) and r["i"] == pytest.approx([0, 0, 0, 1]) and r["b"] == pytest.approx([0, 0, half, half])
    assert [x for row in r["m"] for x in row] == pytest.approx([1, 0, 0, 0, 1, 0, 0, 0, 1], abs=1e-5)


def test_units_round_trip(spark):
    df = spark.createDataFrame([(100.0, 0.0, 200.0), (250.0, 0.0, 200.0)], "x double, lo double, hi double")
    for mode in ("RANGE_M100_100", "RANGE_0_100"):
        n = df.withColumn("n", X.unit_value(F.col("x"), F.col("lo"), F.col("hi"), mode, F.lit(True)))
        assert [r[0] for r in n.select(X.unit_value(F.col("n"), F.col("lo"), F.col("hi"), mode, F.lit(True), inverse=True)).collect()] == [100, 200]


def test_text(spark):
    df = spark.createDataFrame([("pick_up\nit ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(X.formal(F.col("t"))).collect()][1:] == ["Perform the task."] * 2
    assert df.select(X.with_stop(F.col("t"))).collect()[2][0] == "Execute the robot action."
    assert spark.range(1).select(X.clock_seconds(F.lit("02:05")), X.clock_seconds(F.lit("65"))).first()[:] == (125, 65)


def test_rollout_keeps_one_step_past_done(spark):
    df = spark.createDataFrame([(0, f, 1.0, f == 3, f == 1) for f in range(5)] + [(1, f, -1.0, False, False) for f in range(3)], "episode_index long, frame_index long, r double, s boolean, d boolean")
    got = {r["episode_index"]: r for r in S.rollout_metrics(df, "r", "s", "d").collect()}
    assert got[0]["sum_reward"] == 3.0 and got[0]["success"] is False and got[1]["max_reward"] == -1.0


def test_pipeline_registry_and_json(spark):
    reg = Registry()
    reg.register("x")(Rename)
    with pytest.raises(ValueError):
        reg.register("x")(Rename)
    Rename.registry_name = "rename"
    with pytest.raises(KeyError, match="rename"):
        STEPS.get("nothing")
    p = Pipeline([Rename({"value": "v"}), Normalize({"v": "MEAN_STD"}, {"v": {"mean": 1.0, "std": 2.0}})])
    again = Pipeline.from_json(p.to_json())
    df = frames(spark, [3])
    assert [r["v"] for r in again(df).orderBy("frame_index").collect()] == pytest.approx([-0.5, 0.0, 0.5])
    assert len(list(p.step_through(df))) == 3 and len(p[:1]) == 1
    swapped = hot_swap(p, {"v": {"mean": 0.0, "std": 1.0}})
    assert swapped(df).agg(F.max("v")).first()[0] == pytest.approx(2.0)
    with pytest.raises(KeyError):
        Pipeline.from_json(p.to_json(), {"nothing": {}})
    with pytest.raises(ValueError):
        Pipeline.from_json(p.to_json(), {"rename": {"bad": 1}})
    assert json.loads(p.to_json())["steps"][0]["registry_name"] == "rename"


def test_vector_normalize_round_trip(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "a array<double>")
    stats = {"a": {"min": [1.0, 5.0], "max": [3.0, 5.0]}}
    out = Pipeline([Normalize({"a": "MIN_MAX"}, stats)])(df)
    assert [r["a"] for r in out.collect()] == [[-1.0, -1.0], [1.0, -1.0]]
    back = Pipeline([Normalize({"a": "MIN_MAX"}, stats, True)])(out)
    assert [r["a"] for r in back.collect()] == [[1.0, 5.0], [3.0, 5.0]]


def test_replay(spark):
    df = spark.createDataFrame([(i, i == 2 or i == 3) for i in range(6)], "i long, d boolean")
    got = [(r["episode_index"], r["frame_index"]) for r in R.episodes_from_flags(df, "i", F.col("d")).orderBy("i").collect()]
    assert got == [(0, 0), (0, 1), (0, 2), (1, 0), (2, 0), (2, 1)]
    assert [r["i"] for r in R.last_n(df, "i", 2).collect()] == [4, 5]
    a = spark.createDataFrame([(0, s, [float(v)]) for s, v in enumerate([0, 0.5, 3, 3.2, 9])], "k long, t long, v array<double>")
    assert [r["admitted"] for r in R.admit(a, "k", "t", "v", 1.0).orderBy("t").collect()] == [True, False, True, False, True]


def test_dataset_round_trip(spark, tmp_path):
    rows = [(e, f, f"task_{e % 2}", [float(e), float(f)]) for e in range(5) for f in range(10)]
    df = spark.createDataFrame(rows, "episode_index long, frame_index long, task string, action array<float>")
    info = D.Info(30, {"action": D.Feature("float32", (2,), ("x", "y"))}, "dummy", data_files_size_in_mb=1)
    root = str(tmp_path / "set")
    D.write(df, root, info, mb_per_frame=0.05)
    ds = D.EpisodeDataset.load(spark, root)
    assert (ds.info.total_episodes, ds.info.total_frames, ds.info.total_tasks, ds.info.splits) == (5, 50, 2, {"train": "0:5"})
    assert ds.frames([1, 3]).count() == 20 and ds.with_tasks().where("task = 'task_1'").count() == 20
    ep = ds.episodes().orderBy("episode_index").collect()
    assert [r["dataset_from_index"] for r in ep] == [0, 10, 20, 30, 40] and len({r["data/file_index"] for r in ep}) > 1
    assert not [c for c in ds.episodes().columns if c.startswith("stats/")] and "stats/action/mean" in ds.episodes(True).columns
    assert ds.stats()["action"]["mean"] == pytest.approx([2.0, 4.5]) and ds.stats()["action"]["count"] == [50]
    assert ds.missing_episodes([1, 7]).count() == 1 and ds.file_paths([0]).count() == 1 and ds.subtasks() is None
    assert sum(D.violations(ds.frames(), ds.info.features).first()) == 0
    with pytest.raises(ValueError):
        D.violations(ds.frames().drop("action"), ds.info.features)
    with pytest.raises(ValueError):
        D.check_version("v2.1")
    with pytest.raises(ValueError):
        D.schema_of({"a/b": D.Feature("float32")})
    assert D.unflatten(D.flatten({"a": {"b": 1}, "c": 2})) == {"a": {"b": 1}, "c": 2}
    assert D.merged_features({"s": D.Feature("float32", (1,), ("a",))}, {"s": D.Feature("float32", (1,), ("b",))})["s"].shape == (2,)
    assert sorted(r["index"] for i in range(3) for r in D.safe_shard(ds.frames(), 3, i).collect()) == list(range(50))


def test_entry_without_llm(tmp_path):
    """The library imports without its llm folders."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "frameloom", tmp_path / "frameloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'delta_window_clamped' in q and not any(k.startswith('op') and k[2].isdigit() for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
