"""Datasets written and read back, edits of them, annotations, rollouts, reports and bridges."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions import bridges as B
from ...functions import features as X
from ...functions import tokens as K
from ...operators import annotations as N
from ...operators import edits as E
from ...operators import joins as J
from ...operators import replay as Q
from ...operators import reports as R
from ...operators import rollouts as O
from ...operators import sampling as P
from ...operators import stats as S
from ...operators import windows as W
from ...operators.windows import EPISODE
from ...session import shared_folder
from ...sources import appending as A
from ...sources import dataset as D
from ...sources import external as G
from ...sources.adapters import EVENT_FRAMES, LINE_FRAMES, VECTOR_FRAMES, event_frames, line_frames, table, vector_frames
from ...streaming import stateful as Z
from ..pipeline import FromTransition, ToTransition

QUERIES, ORACLES = {}, {}


def _add(name, query, sql):
    QUERIES[name], ORACLES[name] = query, sql


# A dataset on disk

_INFO = D.Info(fps=10.0, features={"value": D.Feature("float64"), "action": D.Feature("float32", (2,), ("a", "b"))}, robot_type="none", data_files_size_in_mb=1)


def _recorded(spark, sf):
    f = event_frames(spark, sf)
    rows = f.select(EPISODE, "task", "value", F.array(F.col("value") / 2, F.lit(1.0)).alias("action"), "ts", "event_id")
    return D.recorded(rows, ["ts", "event_id"], 10.0).drop("ts", "event_id")


def _written(spark, sf):
    return D.write(_recorded(spark, sf), shared_folder(spark), _INFO, 0.001)


def _appended(spark, sf):
    """The events' episodes appended in three steps of a third of them each, under a small cap."""
    rows = _recorded(spark, sf)
    top = rows.agg(F.max(EPISODE)).first()[0]
    ds = A.create(spark, shared_folder(spark), _INFO)
    for k in range(3):
        some = (F.col(EPISODE) * 3 > top * k) & (F.col(EPISODE) * 3 <= top * (k + 1)) if k else F.col(EPISODE) * 3 <= top
        ds = A.append(ds, rows.where(some), 0.001, 0.01)
    return ds


class _Lost(RuntimeError):
    pass


def _lost_append(spark, sf):
    """An append that is lost after it has staged everything: the dataset is as before."""

    def lose():
        raise _Lost

    ds = A.append(A.create(spark, shared_folder(spark), _INFO), _recorded(spark, sf), 0.001)
    try:
        A.append(ds, _recorded(spark, sf), 0.001, before_commit=lose)
    except _Lost:
        pass
    return A.LoggedDataset.load(spark, ds.root)


_NUMBERED = f"""{EVENT_FRAMES}, n AS (SELECT dense_rank() OVER (ORDER BY episode_index) - 1 AS episode_index, frame_index, value, task, row_number() OVER (ORDER BY episode_index, frame_index) - 1 AS index FROM f),
    tasks AS (SELECT task, row_number() OVER (ORDER BY min(index)) - 1 AS task_index FROM n GROUP BY 1)"""
_ALL = "episode_index, frame_index, index, task_index, value, action[1]::DOUBLE AS a, action[2]::DOUBLE AS b, round(timestamp::DOUBLE, 4) AS t"
_BACK = f"WITH {_NUMBERED} SELECT episode_index, frame_index, index, task_index, value, (value / 2)::FLOAT::DOUBLE AS a, 1.0::DOUBLE AS b, round((frame_index / 10)::FLOAT::DOUBLE, 4) AS t FROM n JOIN tasks USING (task)"


def _cells(df):
    return df.select(EPISODE, "frame_index", "index", "task_index", "value", F.col("action")[0].cast("double").alias("a"), F.col("action")[1].cast("double").alias("b"), F.round(F.col("timestamp").cast("double"), 4).alias("t"))


_add("dataset_frames", lambda spark, sf: _cells(_written(spark, sf).frames()), _BACK)
_add("dataset_some_episodes", lambda spark, sf: _cells(_written(spark, sf).frames([1, 5, 8])), f"{_BACK} WHERE episode_index IN (1, 5, 8)")
_add("appended_frames", lambda spark, sf: _cells(_appended(spark, sf).frames()), _BACK)
_add(
    "appended_episodes",
    lambda spark, sf: _appended(spark, sf).episodes(True).select(EPISODE, "length", "dataset_from_index", "dataset_to_index", F.array_join("tasks", "|").alias("tasks"), F.round(F.col("`stats/value/mean`")[0], 9).alias("mean"), F.col("`stats/value/count`")[0].alias("count")),
    f"WITH {_NUMBERED} SELECT episode_index, count(*) AS length, min(index) AS dataset_from_index, max(index) + 1 AS dataset_to_index, string_agg(DISTINCT task, '|' ORDER BY task) AS tasks, round(avg(value), 9) AS mean, count(*) AS count FROM n GROUP BY 1",
)
_add(
    "appended_state",
    lambda spark, sf: (lambda d: d.files().agg(F.sum("episodes").alias("episodes"), (F.max("mb") < 1).alias("under_cap"), (F.count(F.lit(1)) >= F.floor(F.lit(d.info.total_frames * 0.001))).alias("enough_files")).select("episodes", "under_cap", "enough_files", F.lit(d.version).cast("long").alias("version"), F.lit(d.info.total_frames).cast("long").alias("frames"), F.lit(round(d.stats()["value"]["mean"][0], 6)).alias("mean"), F.lit(round(d.stats()["value"]["std"][0], 6)).alias("std")))(_appended(spark, sf)),
    "SELECT count(DISTINCT user_id)::BIGINT AS episodes, true AS under_cap, true AS enough_files, 3::BIGINT AS version, count(*) AS frames, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events",
)
def _more_quantiles(spark, sf):
    """Quartiles added to an appended dataset: read back from the episodes, and whether the data files are the same as before."""
    before = _appended(spark, sf)
    after = A.add_quantiles(before, (0.25, 0.75))
    kept = before.files().select("path").join(after.files().select("path"), "path").count() == before.files().count() == after.files().count()
    return after.episodes(True).select(EPISODE, *[F.round(F.col(f"`stats/value/{q}`")[0], 9).alias(q) for q in ("q25", "q50", "q75")], F.lit(kept).alias("frames_untouched"))


_add(
    "quantiles_added_back",
    _more_quantiles,
    f"WITH {_NUMBERED} SELECT episode_index, CASE WHEN count(*) < 2 THEN round(avg(value), 9) ELSE round(quantile_cont(value, 0.25), 9) END AS q25, CASE WHEN count(*) < 2 THEN round(avg(value), 9) ELSE round(quantile_cont(value, 0.5), 9) END AS q50, CASE WHEN count(*) < 2 THEN round(avg(value), 9) ELSE round(quantile_cont(value, 0.75), 9) END AS q75, true AS frames_untouched FROM n GROUP BY 1",
)
_add("lost_append", lambda spark, sf: _cells(_lost_append(spark, sf).frames()), _BACK)
_add("dataset_tasks", lambda spark, sf: _written(spark, sf).tasks().select("task", "task_index"), f"WITH {_NUMBERED} SELECT * FROM tasks")
_add("dataset_with_tasks", lambda spark, sf: (lambda d: d.with_tasks().select("index", "task"))(_written(spark, sf)), f"WITH {_NUMBERED} SELECT index, task FROM n")
_add(
    "dataset_episodes",
    lambda spark, sf: _written(spark, sf).episodes().select(EPISODE, "length", "dataset_from_index", "dataset_to_index", F.array_join("tasks", "|").alias("tasks")),
    f"WITH {_NUMBERED} SELECT episode_index, count(*) AS length, min(index) AS dataset_from_index, max(index) + 1 AS dataset_to_index, array_to_string(list_sort(list_distinct(list(task))), '|') AS tasks FROM n GROUP BY 1",
)
_add(
    "dataset_episode_stats",
    lambda spark, sf: _written(spark, sf).episodes(True).select(EPISODE, *[F.round(F.col(f"`stats/value/{s}`")[0], 9).alias(s) for s in ("min", "max", "mean", "std", "q50")], F.col("`stats/value/count`")[0].alias("count")),
    f"WITH {_NUMBERED} SELECT episode_index, round(min(value), 9) AS min, round(max(value), 9) AS max, round(avg(value), 9) AS mean, CASE WHEN count(*) < 2 THEN 0 ELSE round(stddev_pop(value), 9) END AS std, CASE WHEN count(*) < 2 THEN round(avg(value), 9) ELSE round(quantile_cont(value, 0.5), 9) END AS q50, count(*) AS count FROM n GROUP BY 1",
)


def _info(spark, sf):
    made = _written(spark, sf)
    info = D.EpisodeDataset.load(spark, made.root).info
    pooled = made.stats()["value"]
    return spark.createDataFrame([(info.total_episodes, info.total_frames, info.total_tasks, info.splits["train"], float(info.fps), pooled["min"][0], pooled["max"][0], round(pooled["mean"][0], 6), pooled["count"][0])], "episodes long, frames long, tasks long, train string, fps double, low double, high double, mean double, n long")


_add("dataset_info", _info, "SELECT count(DISTINCT user_id) AS episodes, count(*) AS frames, count(DISTINCT event_type) AS tasks, '0:' || count(DISTINCT user_id) AS train, 10.0::DOUBLE AS fps, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, count(*) AS n FROM events")
_add(
    "dataset_file_rows",
    lambda spark, sf: (lambda d: R.rows_in_files(spark, f"{d.root}/data/*").agg(F.sum("rows").alias("rows"), (F.sum("rows") == d.info.total_frames).alias("whole")))(_written(spark, sf)),
    "SELECT count(*)::BIGINT AS rows, true AS whole FROM events",
)

# Edits

_add(
    "split_by_lists",
    lambda spark, sf: E.split_lists(event_frames(spark, sf).select(EPISODE, "frame_index", "value"), _lists(spark, sf)),
    f"""WITH {EVENT_FRAMES}, s AS (SELECT *, CASE WHEN episode_index % 2 = 0 THEN 'even' ELSE 'odd' END AS split FROM f)
    SELECT dense_rank() OVER (PARTITION BY split ORDER BY episode_index) - 1 AS episode_index, frame_index, value, row_number() OVER (PARTITION BY split ORDER BY episode_index, frame_index) - 1 AS index, split FROM s""",
)


def _lists(spark, sf):
    ids = sorted(r[0] for r in event_frames(spark, sf).select(EPISODE).distinct().collect())
    return {"even": [e for e in ids if e % 2 == 0], "odd": [e for e in ids if e % 2]}


def _indexed(spark, sf):
    return E.renumbered(event_frames(spark, sf).select(EPISODE, "frame_index", "value", "task"))


_INDEXED = f"{EVENT_FRAMES}, i AS (SELECT dense_rank() OVER (ORDER BY episode_index) - 1 AS episode_index, frame_index, value, task, row_number() OVER (ORDER BY episode_index, frame_index) - 1 AS index FROM f)"
_add(
    "add_feature_by_position",
    lambda spark, sf: (lambda f: E.add_by_position(f, "doubled", f.select("index", (F.col("value") * 2 + F.col("index")).alias("value"))).select("index", "doubled"))(_indexed(spark, sf)),
    f"WITH {_INDEXED} SELECT index, value * 2 + index AS doubled FROM i",
)
_add(
    "add_feature_by_call",
    lambda spark, sf: E.add_by_call(_indexed(spark, sf), "made", lambda row, episode, frame: row["value"] * 3 + episode - frame).select("index", "made"),
    f"WITH {_INDEXED} SELECT index, value * 3 + episode_index - frame_index AS made FROM i",
)
_add(
    "replace_episodes",
    lambda spark, sf: E.remapped(event_frames(spark, sf).select(EPISODE, "frame_index", "value"), event_frames(spark, sf).where(F.col(EPISODE) % 3 == 0).select(F.col(EPISODE).alias("old"), (F.col(EPISODE) + 100_000).alias("new")).distinct(), "old", "new"),
    f"WITH {EVENT_FRAMES} SELECT CASE WHEN episode_index % 3 = 0 THEN episode_index + 100000 ELSE episode_index END AS episode_index, frame_index, value FROM f",
)


def _episode_rows(spark, sf, odd):
    f = E.renumbered(event_frames(spark, sf).where(F.col(EPISODE) % 2 == odd).select(EPISODE, "frame_index"))
    rows = f.groupBy(EPISODE).agg(F.min("index").alias("dataset_from_index"), (F.max("index") + 1).alias("dataset_to_index"))
    seconds = F.col("dataset_from_index") / 10, F.col("dataset_to_index") / 10
    return rows.withColumns({"data/file_index": F.floor(F.col(EPISODE) / 10), "videos/cam/file_index": F.floor(F.col(EPISODE) / 20), "videos/cam/from_timestamp": seconds[0], "videos/cam/to_timestamp": seconds[1]})


_add(
    "merge_episode_metadata",
    lambda spark, sf: E.merge_metadata([_episode_rows(spark, sf, 0), _episode_rows(spark, sf, 1)], ["cam"]).withColumnsRenamed({"data/file_index": "data_file", "videos/cam/file_index": "video_file", "videos/cam/from_timestamp": "start", "videos/cam/to_timestamp": "stop"}),
    f"""WITH {EVENT_FRAMES}, p AS (SELECT *, (episode_index % 2)::INT AS dataset_index FROM f),
    q AS (SELECT dataset_index, dense_rank() OVER (PARTITION BY dataset_index ORDER BY episode_index) - 1 AS e, row_number() OVER (PARTITION BY dataset_index ORDER BY episode_index, frame_index) - 1 AS i FROM p),
    r AS (SELECT dataset_index, e, min(i) AS a, max(i) + 1 AS b FROM q GROUP BY 1, 2),
    o AS (SELECT max(e) + 1 AS es, max(b) AS n, max(e // 10) + 1 AS df, max(e // 20) + 1 AS vf FROM r WHERE dataset_index = 0)
    SELECT dataset_index, e + CASE dataset_index WHEN 0 THEN 0 ELSE es END AS episode_index, a + CASE dataset_index WHEN 0 THEN 0 ELSE n END AS dataset_from_index, b + CASE dataset_index WHEN 0 THEN 0 ELSE n END AS dataset_to_index,
      e // 10 + CASE dataset_index WHEN 0 THEN 0 ELSE df END AS data_file, e // 20 + CASE dataset_index WHEN 0 THEN 0 ELSE vf END AS video_file, a / 10 + CASE dataset_index WHEN 0 THEN 0 ELSE n / 10 END AS start, b / 10 + CASE dataset_index WHEN 0 THEN 0 ELSE n / 10 END AS stop FROM r, o""",
)
_add(
    "capped_batches",
    lambda spark, sf: E.episode_batches(event_frames(spark, sf).groupBy(EPISODE).agg(F.count(F.lit(1)).alias("length")), 1.0, 100000.0, 7, 450),
    """WITH RECURSIVE e AS (SELECT user_id AS episode_index, count(*) AS length, row_number() OVER (ORDER BY user_id) AS r FROM events GROUP BY 1),
    w AS (SELECT r, episode_index, length, length::BIGINT AS held, 1::BIGINT AS n, 0::BIGINT AS b FROM e WHERE r = 1
    UNION ALL SELECT e.r, e.episode_index, e.length, CASE WHEN w.n >= 7 OR w.held + e.length > 450 THEN e.length ELSE w.held + e.length END, CASE WHEN w.n >= 7 OR w.held + e.length > 450 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n >= 7 OR w.held + e.length > 450 THEN w.b + 1 ELSE w.b END FROM w JOIN e ON e.r = w.r + 1)
    SELECT episode_index, length, b AS batch FROM w""",
)

# Annotations


def _subtasks(spark, sf):
    """A subtask of nine seconds for every tenth frame of an episode, a second a frame."""
    at = F.col("frame_index")
    return event_frames(spark, sf).where(at % 10 == 0).select(EPISODE, (at / 10).cast("int").alias("position"), F.col("task").alias("name"), N.clock(at.cast("double")).alias("start"), N.clock(at + 9.0).alias("end"))


def _annotated(spark, sf):
    return N.annotated(event_frames(spark, sf).groupBy(EPISODE).agg(F.count(F.lit(1)).alias("length")), _subtasks(spark, sf), 30.0, "dense")


_STEPS = f"{EVENT_FRAMES}, s AS (SELECT episode_index, (frame_index // 10)::INT AS position, task AS name, frame_index AS a, frame_index + 9 AS b FROM f WHERE frame_index % 10 = 0)"
_add(
    "annotate_episodes",
    lambda spark, sf: _annotated(spark, sf).select(EPISODE, "length", F.array_join("dense_subtask_names", "|").alias("names"), F.array_join(F.col("dense_subtask_start_frames").cast("array<string>"), "|").alias("starts"), F.array_join(F.col("dense_subtask_end_frames").cast("array<string>"), "|").alias("ends")),
    f"WITH {_STEPS} SELECT e.episode_index, e.length, names, starts, ends FROM (SELECT episode_index, count(*) AS length FROM f GROUP BY 1) e LEFT JOIN (SELECT episode_index, string_agg(name, '|' ORDER BY position) AS names, string_agg((a * 30)::VARCHAR, '|' ORDER BY position) AS starts, string_agg((b * 30)::VARCHAR, '|' ORDER BY position) AS ends FROM s GROUP BY 1) USING (episode_index)",
)
_add("annotations_back", lambda spark, sf: N.subtasks_of(_annotated(spark, sf), "dense"), f"WITH {_STEPS} SELECT episode_index, position, name, printf('%02d:%02d', a // 60, a % 60) AS start, printf('%02d:%02d', b // 60, b % 60) AS \"end\" FROM s")
_add(
    "annotate_one_stage",
    lambda spark, sf: N.one_stage(event_frames(spark, sf).groupBy(EPISODE).agg(F.count(F.lit(1)).alias("length")), F.col("length") / 3.0),
    "SELECT user_id AS episode_index, 0 AS position, 'task' AS name, '00:00' AS start, printf('%02d:%02d', floor(count(*) / 3)::BIGINT // 60, floor(count(*) / 3)::BIGINT % 60) AS \"end\" FROM events GROUP BY 1",
)


def _targets(spark, sf):
    f = event_frames(spark, sf).select(EPISODE, "frame_index")
    slots = W.target_frames(f, 2, 5, F.col("frame_index") % 4, 3)
    rows = slots.withColumn("v", F.col("at") / 100.0)
    return rows.groupBy(EPISODE, "frame_index").agg(W.padded_row(8, "slot", "v").alias("row")).select(EPISODE, "frame_index", *[F.col("row")[i].alias(f"s{i}") for i in range(8)])


def _target_sql():
    around = [f"greatest(0, least(n - 1, frame_index + {k})) / 100.0::DOUBLE AS s{i}" for i, k in enumerate((-10, -5, 0, 5, 10))]
    behind = [f"CASE WHEN frame_index > 10 AND {j} <= least(frame_index % 4, 3, (frame_index - 10) // 5) THEN greatest(0, frame_index - 10 - {5 * j}) / 100.0::DOUBLE ELSE 0.0 END::DOUBLE AS s{4 + j}" for j in (1, 2, 3)]
    return f"WITH {EVENT_FRAMES}, c AS (SELECT *, count(*) OVER (PARTITION BY episode_index) AS n FROM f) SELECT episode_index, frame_index, {', '.join(around + behind)} FROM c"


_add("batch_targets", _targets, _target_sql())

# Rollouts and reports


def _rollout(spark, sf):
    rows = event_frames(spark, sf).select(EPISODE, "frame_index", F.col("value").alias("observation"), (F.col("value") / 10).alias("action"), (F.col("value") > 80).alias("done"))
    return O.compiled(rows, "done", ["observation"], 20.0, 5, 1000).select(EPISODE, "frame_index", "index", F.round("timestamp", 6).alias("timestamp"), "observation", "action", "done")


_add(
    "compile_rollouts",
    _rollout,
    f"""WITH {EVENT_FRAMES}, d AS (SELECT *, least(coalesce(min(CASE WHEN value > 80 THEN frame_index END) OVER w, max(frame_index) OVER w - 1), max(frame_index) OVER w - 1) AS fin FROM f WINDOW w AS (PARTITION BY episode_index)),
    k AS (SELECT *, frame_index > fin AS late, lag(value) OVER (PARTITION BY episode_index ORDER BY frame_index) AS prev FROM d WHERE frame_index <= fin + 1)
    SELECT dense_rank() OVER (ORDER BY episode_index) - 1 + 5 AS episode_index, least(frame_index, fin) AS frame_index, row_number() OVER (ORDER BY episode_index, frame_index) - 1 + 1000 AS index, round(least(frame_index, fin) / 20, 6) AS timestamp, value AS observation,
      CASE WHEN late THEN prev ELSE value END / 10 AS action, CASE WHEN late THEN prev ELSE value END > 80 AS done FROM k""",
)
_add(
    "dataset_summary",
    lambda spark, sf: R.summary(event_frames(spark, sf), 30.0),
    "SELECT e AS total_episodes, n AS total_frames, t AS total_tasks, round(n / e, 1) AS frames_per_episode, round(n / e / 30, 1) AS seconds_per_episode, 30.0::DOUBLE AS fps FROM (SELECT count(DISTINCT user_id) AS e, count(*) AS n, count(DISTINCT event_type) AS t FROM events)",
)
_add(
    "compression_quality",
    lambda spark, sf: R.compression_quality(line_frames(spark, sf).select("task", F.col("action")[0].alias("load_video_ms"), (F.col("action")[0] + F.col("frame_index") + 1).alias("load_images_ms"), F.col("action").alias("mse"), F.slice("action", 1, 2).alias("psnr"), F.slice("action", 3, 1).alias("ssim")), ["task"]),
    f"WITH {LINE_FRAMES} SELECT task, avg(action[1]) AS avg_load_time_video_ms, avg(action[1] + frame_index + 1) AS avg_load_time_images_ms, avg(action[1]) / avg(action[1] + frame_index + 1) AS video_images_load_time_ratio, sum(list_sum(action)) / (4 * count(*)) AS avg_mse, sum(action[1] + action[2]) / (2 * count(*)) AS avg_psnr, avg(action[3]) AS avg_ssim FROM g GROUP BY 1",
)
_add(
    "quantile_stats_added",
    lambda spark, sf: R.with_quantiles(event_frames(spark, sf), "value").select("count", *[F.round(c, 9).alias(c) for c in ("min", "max", "mean", "std", "q01", "q50", "q99")]),
    "WITH p AS (SELECT count(*) AS n, min(value) AS mn, max(value) AS mx, avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, 0.01) AS q01, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.99) AS q99 FROM events GROUP BY user_id), t AS (SELECT sum(n) AS n, sum(mean * n) / sum(n) AS mean FROM p) SELECT (SELECT n FROM t)::BIGINT AS count, round(min(mn), 9) AS min, round(max(mx), 9) AS max, round(sum(p.mean * p.n) / sum(p.n), 9) AS mean, round(sqrt(sum((std * std + (p.mean - t.mean) * (p.mean - t.mean)) * p.n) / sum(p.n)), 9) AS std, round(sum(q01 * p.n) / sum(p.n), 9) AS q01, round(sum(q50 * p.n) / sum(p.n), 9) AS q50, round(sum(q99 * p.n) / sum(p.n), 9) AS q99 FROM p, t",
)

# Sources


def _ported(spark, sf):
    steps = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array("l_quantity", "l_discount").alias("joints"), F.col("l_tax").alias("gripper"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise(F.lit(" ")).alias("first"), F.col("l_linestatus").alias("second"), F.concat(F.lit("/data"), F.when(F.col("l_orderkey") % 2 == 0, "/success/").otherwise("/failure/"), "l_orderkey").alias("file"))
    out = G.ported(steps, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], {"state": ["joints", "gripper"]}, ["first", "second"], 15.0, "file")
    return out.select(EPISODE, "frame_index", "task", "is_first", "is_last", "is_episode_successful", *[F.round(F.col("state")[i].cast("double"), 3).alias(f"s{i}") for i in range(3)])


_add(
    "port_steps",
    _ported,
    "SELECT l_orderkey AS episode_index, row_number() OVER w - 1 AS frame_index, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE l_linestatus END AS task, row_number() OVER w = 1 AS is_first, lead(1) OVER w IS NULL AS is_last, l_orderkey % 2 = 0 AS is_episode_successful, round(l_quantity::FLOAT::DOUBLE, 3) AS s0, round(l_discount::FLOAT::DOUBLE, 3) AS s1, round(l_tax::FLOAT::DOUBLE, 3) AS s2 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)",
)


def _progress(spark, sf):
    path = f"{shared_folder(spark)}/progress"
    _indexed(spark, sf).select("index", EPISODE, "frame_index", F.when(F.col("value") > 90, F.lit(float("nan"))).otherwise(F.col("value") / 100).alias("progress_dense")).write.parquet(path)
    return G.progress(spark, path, "dense")


_add("progress_table", _progress, f"WITH {_INDEXED} SELECT index, episode_index, CASE WHEN value <= 90 THEN value / 100 END AS progress FROM i")
_add(
    "image_bytes",
    lambda spark, sf: G.inlined(table(spark, sf, "supplier").select("s_suppkey", F.struct(F.when(F.col("s_suppkey") % 2 == 0, F.encode("s_name", "UTF-8")).alias("bytes"), F.concat(F.lit("dir/"), F.col("s_suppkey")).alias("path")).alias("image")), ["image"], table(spark, sf, "supplier").select(F.concat(F.lit("dir/"), F.col("s_suppkey")).alias("path"), F.encode(F.concat(F.lit("file "), "s_suppkey"), "UTF-8").alias("content"))).select("s_suppkey", F.decode("image.bytes", "UTF-8").alias("body"), "image.path"),
    "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'file ' || s_suppkey END AS body, s_suppkey::VARCHAR AS path FROM supplier",
)

# Buffers


def _buffer(spark, sf):
    f = _indexed(spark, sf).select("index", "value")
    online, offline = (P.buffer_batch(f, "index", 300, s, None, True) for s in (1, 2))
    return P.mixed_batch(online, offline.drop("value")).select("origin", "draw", "index", "value")


_add(
    "mixed_buffer_batch",
    _buffer,
    f"WITH {_INDEXED}, n AS (SELECT count(*) AS n FROM i), d AS (SELECT d, ((d + 1) * 2654435761 + d // 7) % (n - 1) AS a, ((d + 2) * 2654435761 + d // 7) % (n - 1) AS b FROM range(300) r(d), n WHERE d < n) SELECT 'online' AS origin, d AS draw, index, value FROM d JOIN i ON index = a UNION ALL SELECT 'offline', d, b, NULL FROM d",
)
_add(
    "nan_transitions",
    lambda spark, sf: Q.without_nan(line_frames(spark, sf).withColumn("state", F.when(F.col("frame_index") == 1, F.array(F.lit(float("nan")))).otherwise(F.col("action"))).withColumn("next_state", F.when(F.col("frame_index") == 3, F.array(F.lit(float("nan")))).otherwise(F.col("action"))), ["state", "action", "next_state"]).select(EPISODE, "frame_index"),
    f"WITH {LINE_FRAMES} SELECT episode_index, frame_index FROM g WHERE frame_index NOT IN (1, 3)",
)

# Bridges

_add(
    "vector_bridge",
    lambda spark, sf: table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", B.gathered(["l_quantity", "l_tax"], "double").alias("v")).select("l_orderkey", "l_linenumber", *B.spread("v", ["quantity", "tax"], "motor_")),
    "SELECT l_orderkey, l_linenumber, l_quantity AS motor_quantity, l_tax AS motor_tax FROM lineitem",
)
_add(
    "inference_frames",
    lambda spark, sf: B.inference_frame(table(spark, sf, "lineitem"), {"observation.state": ["l_quantity", "l_discount"]}, "pick").select(F.round(F.col("`observation.state`")[0].cast("double"), 3).alias("a"), F.round(F.col("`observation.state`")[1].cast("double"), 3).alias("b"), "task", "robot_type"),
    "SELECT round(l_quantity::FLOAT::DOUBLE, 3) AS a, round(l_discount::FLOAT::DOUBLE, 3) AS b, 'pick' AS task, '' AS robot_type FROM lineitem",
)


def _nested(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.struct(F.struct(F.array("l_quantity", "l_tax").alias("pos")).alias("eef"), F.array(F.array("l_discount"), F.array("l_quantity")).alias("grid"), F.col("l_tax").alias("one")).alias("policy"))
    return rows.withColumn("v", B.flat_state(rows, "policy", ["grid", "eef", "one"])).select("l_orderkey", "l_linenumber", F.size("v").cast("long").alias("n"), *[F.round(F.col("v")[i].cast("double"), 3).alias(f"v{i}") for i in range(5)])


_add("flatten_state", _nested, "SELECT l_orderkey, l_linenumber, 5::BIGINT AS n, round(l_discount::FLOAT::DOUBLE, 3) AS v0, round(l_quantity::FLOAT::DOUBLE, 3) AS v1, round(l_quantity::FLOAT::DOUBLE, 3) AS v2, round(l_tax::FLOAT::DOUBLE, 3) AS v3, round(l_tax::FLOAT::DOUBLE, 3) AS v4 FROM lineitem")
_add(
    "robot_state_vector",
    lambda spark, sf: event_frames(spark, sf).withColumn("h", F.col("value") / 100).select("event_id", B.robot_state(F.array("value", F.lit(1.0), F.lit(2.0)), F.array(F.sin("h"), F.lit(0.0), F.lit(0.0), F.cos("h")), F.array(F.lit(0.5), F.lit(-0.5))).alias("v")).select("event_id", F.size("v").cast("long").alias("n"), *[F.round(F.col("v")[i].cast("double"), 3).alias(f"v{i}") for i in (0, 3, 4, 7)]),
    "SELECT event_id, 8::BIGINT AS n, round(value::FLOAT::DOUBLE, 3) AS v0, round((CASE WHEN value > 0 THEN sin(value / 100) / sqrt(1 - cos(value / 100) ** 2) * 2 * acos(cos(value / 100)) ELSE 0 END)::FLOAT::DOUBLE, 3) AS v3, 0.0::DOUBLE AS v4, -0.5::DOUBLE AS v7 FROM events",
)


def _phone(spark, sf):
    f = event_frames(spark, sf)
    own = B.phone_action(F.col("event_id") % 2 == 0, F.array("value", F.col("value") + 1, F.col("value") + 2), F.array(F.col("value") + 3, F.col("value") + 4, F.col("value") + 5), False, F.create_map(F.lit("reservedButtonA"), F.col("value")))
    return f.select("event_id", *[c.alias(n) for n, c in own.items()])


_add(
    "phone_remap",
    _phone,
    "SELECT event_id, e AS enabled, CASE WHEN e THEN -(value + 1) ELSE 0 END::DOUBLE AS target_x, CASE WHEN e THEN value ELSE 0 END::DOUBLE AS target_y, CASE WHEN e THEN value + 2 ELSE 0 END::DOUBLE AS target_z, CASE WHEN e THEN value + 4 ELSE 0 END::DOUBLE AS target_wx, CASE WHEN e THEN value + 3 ELSE 0 END::DOUBLE AS target_wy, CASE WHEN e THEN -(value + 5) ELSE 0 END::DOUBLE AS target_wz, value AS gripper_vel FROM (SELECT event_id, value, event_id % 2 = 0 AS e FROM events)",
)
_add(
    "state_prompt",
    lambda spark, sf: B.with_domain(line_frames(spark, sf), 3).select(EPISODE, "frame_index", B.state_prompt(F.concat(F.lit(" pick_up "), "task"), F.transform("action", lambda a: X.discretize(a / 100 - 1))).alias("prompt"), "domain_id"),
    f"WITH {LINE_FRAMES} SELECT episode_index, frame_index, 'Task: pick up ' || task || ', State: ' || array_to_string(list_transform(action, lambda a: CASE WHEN a / 100 - 1 < -1 THEN -1 ELSE least(floor((a / 100 - 1 + 1) * 128), 255) END::BIGINT), ' ') || ';' || chr(10) AS prompt, 3::BIGINT AS domain_id FROM g",
)
_add(
    "viewer_series",
    lambda spark, sf: B.series(line_frames(spark, sf).withColumn("reward", F.when(F.col("frame_index") > 0, F.col("action")[0])), {"action": "action"}, ["reward"], [EPISODE, "frame_index"]),
    f"WITH {LINE_FRAMES} SELECT episode_index, frame_index, 'action/' || (i - 1) AS entity, action[i] AS value FROM g, range(1, 5) r(i) UNION ALL SELECT episode_index, frame_index, 'reward', action[1] FROM g WHERE frame_index > 0",
)


def _video_times(spark, sf):
    n = F.count(F.lit(1)).over(W.whole())
    f = event_frames(spark, sf).withColumn("n", n)
    times, outside = B.clamped_times(F.col("frame_index") / 10, [-2, 0, 3], 10.0, F.lit(0.0), (F.col("n") - 1) / 10)
    return f.select("event_id", times.alias("t"), outside.alias("o")).select("event_id", *[F.round(F.col("t")[i], 6).alias(f"t{i}") for i in range(3)], F.col("o")[0].alias("o0"))


_add("video_time_clamp", _video_times, f"WITH {EVENT_FRAMES}, c AS (SELECT *, count(*) OVER (PARTITION BY episode_index) AS n FROM f) SELECT event_id, round(greatest(0, least((n - 1) / 10, frame_index / 10 - 0.2)), 6)::DOUBLE AS t0, round(frame_index / 10, 6)::DOUBLE AS t1, round(greatest(0, least((n - 1) / 10, frame_index / 10 + 0.3)), 6)::DOUBLE AS t2, frame_index < 2 AS o0 FROM c")


def _turned(spark, sf):
    """A turn about z by the value in hundredths, as a matrix, in front of one about x by half of it."""
    f = event_frames(spark, sf).withColumn("h", F.col("value") / 100)
    z = X.quaternion_to_matrix(F.array(F.lit(0.0), F.lit(0.0), F.sin(F.col("h") / 2), F.cos(F.col("h") / 2)))
    x = X.quaternion_to_matrix(F.array(F.sin(F.col("h") / 4), F.lit(0.0), F.lit(0.0), F.cos(F.col("h") / 4)))
    both = f.withColumn("m", X.matrix_multiply(z, x)).withColumn("q", X.matrix_to_quaternion(F.col("m")))
    same = both.withColumn("back", X.rotate(X.matrix_inverse(F.col("m")), X.rotate(F.col("m"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))))
    return same.select("event_id", *[F.round(F.abs(F.col("q")[i]), 6).alias(f"q{i}") for i in range(4)], *[F.round(F.col("back")[i], 6).alias(f"b{i}") for i in range(3)])


_add(
    "matrix_quaternions",
    _turned,
    "SELECT event_id, round(abs(cos(a) * sin(b)), 6) AS q0, round(abs(sin(a) * sin(b)), 6) AS q1, round(abs(sin(a) * cos(b)), 6) AS q2, round(abs(cos(a) * cos(b)), 6) AS q3, 1.0::DOUBLE AS b0, 2.0::DOUBLE AS b1, 3.0::DOUBLE AS b2 FROM (SELECT event_id, value / 200 AS a, value / 400 AS b FROM events)",
)


def _six_d(spark, sf):
    h = F.col("value") / 100
    action = F.array(F.col("value"), F.lit(1.0), F.lit(2.0), F.cos(h), F.sin(h), F.lit(0.0), F.lit(-3.0) * F.sin(h) + F.cos(h), F.lit(3.0) * F.cos(h) + F.sin(h), F.lit(0.0), (F.col("event_id") % 3) / 2)
    out = event_frames(spark, sf).withColumn("a", X.six_d_action(action))
    return out.select("event_id", F.size("a").cast("long").alias("n"), F.col("a")[0].alias("x"), *[F.round(F.col("a")[i], 3).alias(f"w{i}") for i in (3, 4, 5)], F.col("a")[6].alias("gripper"))


#: The turn is about z, so the matrix has four entries and one on the diagonal; Gram-Schmidt's 1e-6 is in them.
_add(
    "six_d_actions",
    _six_d,
    """WITH a AS (SELECT event_id, value, cos(value / 100) / 1.000001 AS x1, sin(value / 100) / 1.000001 AS y1, cos(value / 100) - 3 * sin(value / 100) AS x2, sin(value / 100) + 3 * cos(value / 100) AS y2 FROM events),
    o AS (SELECT *, x2 - (x1 * x2 + y1 * y2) * x1 AS ox, y2 - (x1 * x2 + y1 * y2) * y1 AS oy FROM a), n AS (SELECT *, ox / (sqrt(ox * ox + oy * oy) + 1e-6) AS u, oy / (sqrt(ox * ox + oy * oy) + 1e-6) AS v FROM o),
    m AS (SELECT *, x1 * v - y1 * u AS k FROM n), q AS (SELECT *, x1 + v + k >= k - x1 - v AS wide, sqrt(greatest(x1 + v + k, k - x1 - v) + 1) * 2 AS r FROM m),
    w AS (SELECT *, least(1, greatest(-1, CASE WHEN wide THEN r / 4 ELSE (y1 - u) / r END)) AS w, CASE WHEN wide THEN (y1 - u) / r ELSE r / 4 END AS z FROM q)
    SELECT event_id, 7::BIGINT AS n, value AS x, 0.0::DOUBLE AS w3, 0.0::DOUBLE AS w4, round(CASE WHEN sqrt(1 - w * w) > 1e-10 THEN z / sqrt(1 - w * w) * 2 * acos(w) ELSE 0 END, 3) AS w5, CASE WHEN (event_id % 3) / 2 > 0.5 THEN 1.0 ELSE -1.0 END::DOUBLE AS gripper FROM w""",
)
_add(
    "delta_actions",
    lambda spark, sf: event_frames(spark, sf).select("event_id", *[c.alias(k) for k, c in X.delta_action(F.array(F.col("value") / 1000, F.lit(0.01), F.lit(0.0)), F.col("event_id") % 2, 0.5, 0.04).items()]),
    "SELECT event_id, sqrt((value / 1000) ** 2 + 0.0001) > 0.04 AS enabled, value / 2000 AS target_x, 0.005::DOUBLE AS target_y, 0.0::DOUBLE AS target_z, 0.0::DOUBLE AS target_wx, 0.0::DOUBLE AS target_wy, 0.0::DOUBLE AS target_wz, (event_id % 2)::DOUBLE AS gripper_vel FROM events",
)
_add("rewind_choice", lambda spark, sf: event_frames(spark, sf).select("event_id", P.rewind_steps(F.col("event_id"), 4, 3).alias("steps")), "SELECT event_id, ((event_id + 3) * 2654435761) % 1000003 % 4 + 1 AS steps FROM events")
_add("shuffle_buffer", lambda spark, sf: P.through_buffer(table(spark, sf, "events").select("event_id"), "event_id", 50, 7), "SELECT event_id, event_id + ((event_id + 7) * 2654435761) % 100 AS shuffle_key FROM events")
#: A fold with the buffer as a list: the draw's slot gives its row out and takes the new one.
_add(
    "buffer_shuffle",
    lambda spark, sf: P.buffer_shuffled(E.renumbered(event_frames(spark, sf)).select("index", "event_id"), "index", 16, 7, 20, 5).withColumn("early", F.col("place") - F.col("given") < 20),
    f"""WITH RECURSIVE {EVENT_FRAMES}, r AS (SELECT row_number() OVER (ORDER BY episode_index, frame_index) - 1 AS index, event_id FROM f),
    s AS (SELECT index, event_id, index % 7 AS shard, index // 7 AS place, ((index // 7 * 31 + index % 7 + 5) * 2654435761) % 1000003 AS draw FROM r),
    fold AS (
      SELECT shard, 0::BIGINT AS step, []::BIGINT[] AS held, NULL::BIGINT AS gone FROM (SELECT DISTINCT shard FROM s)
      UNION ALL
      SELECT fold.shard, step + 1, CASE WHEN step < 20 THEN list_append(held, index) ELSE list_concat(list_append(held[:(draw % 20)], index), held[(draw % 20) + 2:]) END, CASE WHEN step < 20 THEN NULL ELSE held[(draw % 20) + 1] END
      FROM fold JOIN s ON s.shard = fold.shard AND s.place = fold.step),
    rest AS (SELECT shard, step, unnest(held) AS index FROM (SELECT shard, max(step) AS step, arg_max(held, step) AS held FROM fold GROUP BY shard)),
    given AS (
      SELECT gone AS index, step - 21 AS given FROM fold WHERE gone IS NOT NULL
      UNION ALL SELECT rest.index, greatest(step - 20, 0) + row_number() OVER (PARTITION BY rest.shard ORDER BY draw, place) - 1 FROM rest JOIN s USING (index))
    SELECT index, event_id, shard, place, given, true AS early FROM s JOIN given USING (index)""",
)
#: The least k is searched over all that may be, from the range alone.
_add(
    "growing_histogram",
    lambda spark, sf: S.growing_histogram(event_frames(spark, sf), "value", ["task"], 64),
    """WITH e AS (SELECT event_type AS task, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1), k AS (SELECT task, min(k) AS k FROM e, range(-40, 40) r(k) WHERE floor(hi / pow(2.0, k)) - floor(lo / pow(2.0, k)) < 64 GROUP BY task)
    SELECT task, k, floor(value / pow(2.0, k))::BIGINT AS bin, count(*) AS n FROM events JOIN k ON task = event_type GROUP BY ALL""",
)


def _quantile_gap(spark, sf):
    """Whether each quantile of the growing histogram is within a bin of the exact one."""
    f = event_frames(spark, sf)
    h = S.growing_histogram(f, "value", ["task"], 64)
    exact = S.feature_stats(f, "value", ["task"]).select("task", *[F.col(S.quantile_name(q)).alias(f"e_{S.quantile_name(q)}") for q in S.QUANTILES])
    both = S.growing_quantiles(h, ["task"]).join(exact, "task").join(h.groupBy("task").agg(F.max(F.pow(F.lit(2.0), "k")).alias("w")), "task")
    return both.select("task", "count", *[(F.abs(F.col(S.quantile_name(q)) - F.col(f"e_{S.quantile_name(q)}")) <= F.col("w")).alias(S.quantile_name(q)) for q in S.QUANTILES])


_add("growing_quantiles", _quantile_gap, "SELECT event_type AS task, count(*) AS count, true AS q01, true AS q10, true AS q50, true AS q90, true AS q99 FROM events GROUP BY 1")
_add(
    "episode_of_sparse_index",
    lambda spark, sf: (lambda f: J.containing(f.select((F.col("index") * 100 + F.col("index") % 7).alias("at")), f.groupBy(EPISODE).agg((F.min("index") * 100).alias("from"), (F.max("index") * 100 + 50).alias("to")), "at", "from", "to", [EPISODE, "from"]))(E.renumbered(event_frames(spark, sf))),
    f"WITH {_NUMBERED} SELECT index * 100 + index % 7 AS at, episode_index, min(index) OVER (PARTITION BY episode_index) * 100 AS \"from\" FROM n",
)


def _action_tokens(spark, sf):
    """Chunks of eight frames, of two dimensions, as tokens, and how far the decoded chunk is off."""
    f = W.delta_arrays(event_frames(spark, sf), "value", list(range(8))).withColumn("chunk", F.transform("value_window", lambda x: F.array(x / 100, 1 - x / 50)))
    out = f.withColumn("tokens", K.action_tokens(F.col("chunk"), 8, 2)).withColumn("back", K.actions_of(F.col("tokens"), 8, 2))
    gap = F.array_max(F.flatten(F.zip_with("chunk", "back", lambda a, b: F.zip_with(a, b, lambda x, y: F.abs(x - y)))))
    return out.select("event_id", F.array_join("tokens", " ").alias("tokens"), (gap <= math.sqrt(8) / 20).alias("near"))


_add(
    "action_tokens",
    _action_tokens,
    f"""WITH {EVENT_FRAMES}, w AS (SELECT event_id, list(value) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS v FROM f),
    p AS (SELECT event_id, t, k, v[least(t + 1, len(v))] AS x FROM w, range(8) r(t), range(8) q(k)),
    c AS (SELECT event_id, k, sum(x / 100 * cos(pi() * (t + 0.5) * k / 8)) * sqrt(CASE WHEN k = 0 THEN 1 ELSE 2 END / 8) AS a, sum((1 - x / 50) * cos(pi() * (t + 0.5) * k / 8)) * sqrt(CASE WHEN k = 0 THEN 1 ELSE 2 END / 8) AS b FROM p GROUP BY 1, 2)
    SELECT event_id, string_agg(round_even(a * 10, 0)::INT || ' ' || round_even(b * 10, 0)::INT, ' ' ORDER BY k) AS tokens, true AS near FROM c GROUP BY 1""",
)
_add(
    "large_group_quantiles",
    lambda spark, sf: S.feature_stats(event_frames(spark, sf), "value", ["task"], bounded=True).select("task", "count", *[F.round(F.col(S.quantile_name(q)), 9).alias(S.quantile_name(q)) for q in S.QUANTILES]),
    "SELECT event_type AS task, count(*) AS count, round(quantile_cont(value, 0.01), 9) AS q01, round(quantile_cont(value, 0.1), 9) AS q10, round(quantile_cont(value, 0.5), 9) AS q50, round(quantile_cont(value, 0.9), 9) AS q90, round(quantile_cont(value, 0.99), 9) AS q99 FROM events GROUP BY 1",
)
_add(
    "merged_moments",
    lambda spark, sf: S.moment_stats(S.merged_moments(S.moments(event_frames(spark, sf), "value", [EPISODE, "task"], 0.0, 100.0, 10), ["task"])).select("task", "count", "min", "max", F.round("mean", 9).alias("mean"), F.round("std", 6).alias("std"), F.coalesce(F.try_element_at("histogram", F.lit(3)), F.lit(0)).alias("third")),
    "SELECT event_type AS task, count(*) AS count, min(value) AS min, max(value) AS max, round(avg(value), 9) AS mean, round(stddev_pop(value), 6) AS std, count(*) FILTER (floor(value / 10) = 3) AS third FROM events GROUP BY 1",
)
_add(
    "transition_back",
    lambda spark, sf: FromTransition()(ToTransition()(event_frames(spark, sf).select("event_id", F.array("value").alias("observation.state"), (F.col("value") / 10).alias("action"), F.col("value").alias("next.reward"), (F.col("value") > 80).alias("done"), "task"))).select("event_id", F.col("`observation.state`")[0].alias("state"), "action", F.col("`next.reward`").alias("reward"), F.col("`next.done`").alias("done"), F.col("`next.truncated`").alias("truncated"), "task"),
    "SELECT event_id, value AS state, value / 10 AS action, value AS reward, value > 80 AS done, false AS truncated, event_type AS task FROM events",
)
_add(
    "metadata_differences",
    lambda spark, sf: S.agreement(table(spark, sf, "nation").select("n_regionkey", F.lit(30.0).alias("fps"), F.when(F.col("n_nationkey") > 3, F.lit("arm")).alias("robot")), ["n_regionkey", "fps", "robot"]),
    "SELECT count(DISTINCT n_regionkey) AS n_regionkey, 1::BIGINT AS fps, 2::BIGINT AS robot, false AS same FROM nation",
)
_add(
    "training_counters",
    lambda spark, sf: event_frames(spark, sf).select("event_id", *[c.alias(k) for k, c in S.progress_counters(F.col("event_id"), 8, 50.0, 1000).items()]),
    "SELECT event_id, event_id * 8 AS samples, event_id * 8 / 50 AS episodes, event_id * 8 / 1000 AS epochs FROM events",
)

# Streams


def _file(spark, sf, *columns):
    return Z.frame_stream(spark, f"{sf}/events.parque[t]", table(spark, sf, "events").schema).select(*columns)


#: Rows of a part come this share of the whole time early or late.
_PARTS = 5


def _shuffled(spark, sf):
    """The events with frame numbers as a stream of six triggers and a closing one. A key's rows are shuffled over neighbouring
    triggers and in each; the closing row lets the watermark pass all. Returns the stream, and the delay and the
    idle time (ms) that suit its disorder and its pauses."""
    folder = shared_folder(spark)
    f = event_frames(spark, sf).select(EPISODE, "frame_index", "value", F.col("ts").cast("timestamp").alias("ts"), (F.col("task") == "click").alias("flag"), "event_id")
    low, high = f.agg(F.unix_seconds(F.min("ts")), F.unix_seconds(F.max("ts"))).first()
    span = max(high - low, 1)
    jitter = F.pmod(F.xxhash64(F.lit(7), "event_id"), F.lit(1000)) / 1000
    part = F.floor((F.unix_seconds("ts") - low) / F.lit(float(span)) * _PARTS + jitter)
    made = f"{shared_folder(spark)}/frames"  # numbered once for all triggers
    f.withColumn("part", part).drop("event_id").write.partitionBy("part").parquet(made)
    numbered = spark.read.schema(f.drop("event_id").schema.add("part", "long")).parquet(made)
    for k in range(_PARTS + 2):  # a trigger each, so a write each
        rows = numbered.where(F.col("part") == k).drop("part").repartition(2, "value")
        rows.sortWithinPartitions(F.xxhash64("frame_index", EPISODE)).write.parquet(f"{folder}/{k}")
    last = spark.range(1).select(F.lit(-1).cast("long").alias(EPISODE), F.lit(0).cast("long").alias("frame_index"), F.lit(0.0).alias("value"), F.timestamp_seconds(F.lit(high + 4 * span)).alias("ts"), F.lit(False).alias("flag"))
    last.write.parquet(f"{folder}/{_PARTS + 2}")
    return Z.frame_stream(spark, f"{folder}/*", f.drop("event_id").schema, 2), f"{span // 4 + 1} seconds", 2000 * span


def _running(spark, sf):
    stream, late, idle = _shuffled(spark, sf)
    return Z.run_to_table(Z.running_steps(stream, EPISODE, "frame_index", "value", "flag", 0.5, 30, late, "ts", idle), "append").where(F.col(EPISODE) >= 0)


def _look_around(spark, sf):
    stream, late, idle = _shuffled(spark, sf)
    out = Z.run_to_table(Z.looked_around(stream, EPISODE, "frame_index", "value", [-3, 0, 2], late, "ts", idle), "append").where(F.col(EPISODE) >= 0)
    return out.select(EPISODE, "frame_index", *[F.col("window")[i].alias(f"v{i}") for i in range(3)], *[F.col("is_pad")[i].alias(f"p{i}") for i in (0, 2)])


_add(
    "stream_look_around",
    _look_around,
    f"""WITH {EVENT_FRAMES} SELECT episode_index, frame_index, coalesce(lag(value, 3) OVER w, first_value(value) OVER w) AS v0, value AS v1, coalesce(lead(value, 2) OVER w, last_value(value) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS v2,
    lag(value, 3) OVER w IS NULL AS p0, lead(value, 2) OVER w IS NULL AS p2 FROM f WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)""",
)
_add(
    "stream_running_steps",
    _running,
    f"""WITH {EVENT_FRAMES}, e AS (SELECT *, task = 'click' AND coalesce(lag(task) OVER w <> 'click', true) AS edge, coalesce((value - lag(value) OVER w) / 0.5, 0) AS v FROM f WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index))
    SELECT episode_index, frame_index, v AS velocity, frame_index + 1 >= 30 AS truncated, last_value(CASE WHEN edge THEN value END IGNORE NULLS) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS latched FROM e""",
)
_add(
    "chunked_messages",
    lambda spark, sf: Z.joined_chunks(Z.chunked(table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("message"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body")), size=97)).select("message", F.decode("body", "UTF-8").alias("text")),
    "SELECT concat_ws('-', conv_id, turn) AS message, coalesce(text, '') AS text FROM conversations",
)
_add(
    "stream_histogram",
    lambda spark, sf: Z.run_to_table(Z.online_histogram(_file(spark, sf, "event_type", "value"), "event_type", "value", 0.0, 200.0, 8), "update", ["event_type"]).select("event_type", "n", F.round("mean", 9).alias("mean"), F.round("std", 6).alias("std"), "min", "max", *[F.col("histogram")[i].alias(f"h{i}") for i in range(3)]),
    "SELECT event_type, count(*) AS n, round(avg(value), 9) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, count(*) FILTER (value < 25) AS h0, count(*) FILTER (value >= 25 AND value < 50) AS h1, count(*) FILTER (value >= 50 AND value < 75) AS h2 FROM events GROUP BY 1",
)
