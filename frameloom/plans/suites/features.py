"""Feature functions: normalisation, vectors, text, progress, geometry, units."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import features as X
from ...operators import stats as S
from ...operators import windows as W
from ...sources.adapters import EVENT_FRAMES, LINE_FRAMES, event_frames, line_frames, table

QUERIES, ORACLES = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


_STATS_SQL = "s AS (SELECT event_type AS task, min(value) AS mn, max(value) AS mx, avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, 0.01) AS q01, quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.9) AS q90, quantile_cont(value, 0.99) AS q99 FROM events GROUP BY 1)"


def _with_stats(spark, sf):
    f = event_frames(spark, sf).select("episode_index", "frame_index", "task", F.col("value").alias("x"))
    return f.join(S.feature_stats(f, "x", ["task"]), "task")


def _normalized(mode):
    def query(spark, sf):
        f, stats = _with_stats(spark, sf), {k: F.col(k) for k in ("min", "max", "mean", "std", "q01", "q10", "q90", "q99")}
        return f.withColumn("y", X.normalize(F.col("x"), mode, stats)).select("episode_index", "frame_index", "y", X.normalize(F.col("y"), mode, stats, inverse=True).alias("back"), X.tokenizer_normalize(F.col("x"), mode, stats).alias("t"))

    return query


def _range_sql(lo, hi, clip):
    y, d = f"(2 * (value - {lo}) / CASE WHEN {hi} = {lo} THEN 1e-8 ELSE {hi} - {lo} END - 1)", f"CASE WHEN {hi} = {lo} THEN 1e-8 ELSE {hi} - {lo} END"
    v = f"greatest(least(value, {hi}), {lo})" if clip else "value"
    return f"{y} AS y, ({y} + 1) / 2 * {d} + {lo} AS back, 2 * ({v} - {lo}) / greatest({hi} - {lo}, 1e-8) - 1 AS t"


for _name, _sql in {
    "MEAN_STD": "(value - mean) / (std + 1e-8) AS y, (value - mean) / (std + 1e-8) * std + mean AS back, (value - mean) / greatest(std, 1e-8) AS t",
    "MIN_MAX": _range_sql("mn", "mx", False), "QUANTILES": _range_sql("q01", "q99", True), "QUANTILE10": _range_sql("q10", "q90", True),
}.items():
    _add(f"normalize_{_name.lower()}", _normalized(_name), f"WITH {EVENT_FRAMES}, {_STATS_SQL} SELECT episode_index, frame_index, {_sql} FROM f JOIN s USING (task)")
_add(
    "packed_min_max",
    lambda spark, sf: _with_stats(spark, sf).withColumn("y", X.packed_min_max(F.col("x"), F.col("min"), F.col("max"))).select("episode_index", "frame_index", "y", X.packed_min_max(F.col("y"), F.col("min"), F.col("max"), True).alias("back")),
    f"WITH {EVENT_FRAMES}, {_STATS_SQL} SELECT episode_index, frame_index, 2 * (value - mn) / (mx - mn) - 1 AS y, ((2 * (value - mn) / (mx - mn) - 1) + 1) / 2 * (mx - mn) + mn AS back FROM f JOIN s USING (task)",
)


def _vectors(spark, sf):
    first = F.first("action").over(W.whole())
    return line_frames(spark, sf).withColumn("state", first)


_LV = f"{LINE_FRAMES}, v AS (SELECT *, first_value(action) OVER (PARTITION BY episode_index ORDER BY frame_index) AS state FROM g)"
_add(
    "delta_transform",
    lambda spark, sf: _vectors(spark, sf).withColumn("d", X.delta("action", "state", [True, True, False, True])).select("episode_index", "frame_index", *X.named("d", ["d0", "d1", "d2", "d3"])),
    f"WITH {_LV} SELECT episode_index, frame_index, action[1] - state[1] AS d0, action[2] - state[2] AS d1, action[3] AS d2, action[4] - state[4] AS d3 FROM v",
)
_add(
    "pad_vector",
    lambda spark, sf: line_frames(spark, sf).select("episode_index", "frame_index", F.size(X.pad_vector("action", 6)).cast("long").alias("padded"), F.element_at(X.pad_vector("action", 6), 6).alias("last"), F.size(X.pad_vector("action", 2, True)).cast("long").alias("cut")),
    f"WITH {LINE_FRAMES} SELECT episode_index, frame_index, len(p)::BIGINT AS padded, p[6]::DOUBLE AS last, len(action[1:2])::BIGINT AS cut FROM (SELECT *, list_resize(action, greatest(len(action), 6), 0.0::DOUBLE) AS p FROM g)",
)
_add("discretize_state", lambda spark, sf: event_frames(spark, sf).select("event_id", X.discretize(F.col("value") / 60 - 1.1).alias("bin")), "SELECT event_id, CASE WHEN value / 60 - 1.1::DOUBLE < -1 THEN -1 ELSE least(floor((value / 60 - 1.1::DOUBLE + 1) * 128), 255) END::BIGINT AS bin FROM events")
_add("observation_similarity", lambda spark, sf: _vectors(spark, sf).select("episode_index", "frame_index", X.distance(F.col("action"), F.col("state")).alias("distance"), X.similar(F.col("action"), F.col("state"), 1000.0).alias("similar")), f"WITH {_LV} SELECT episode_index, frame_index, list_distance(action, state) AS distance, list_distance(action, state) < 1000 AS similar FROM v")
_add(
    "prompt_build",
    lambda spark, sf: line_frames(spark, sf).select("episode_index", "frame_index", X.prompt(F.concat(F.lit(" pick_up "), "task", F.lit("\n")), F.transform("action", lambda a: X.discretize(a / 100 - 1))).alias("prompt")),
    f"WITH {LINE_FRAMES} SELECT episode_index, frame_index, 'Task: pick up ' || task || ', State: ' || array_to_string(list_transform(action, lambda a: CASE WHEN a / 100 - 1 < -1 THEN -1 ELSE least(floor((a / 100 - 1 + 1) * 128), 255) END::BIGINT), ' ') || ';' || chr(10) || 'Action: ' AS prompt FROM g",
)
_add(
    "task_text",
    lambda spark, sf: table(spark, sf, "conversations").select("conv_id", "turn", X.formal(F.col("text")).alias("formal"), X.with_newline(F.col("role")).alias("line"), X.with_stop(F.col("role")).alias("stop")),
    "SELECT conv_id, turn, CASE WHEN coalesce(text, '') = '' THEN 'Perform the task.' ELSE regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', '', 'g') END AS formal, role || chr(10) AS line, role || '.' AS stop FROM conversations",
)
_add(
    "clock_frames",
    lambda spark, sf: event_frames(spark, sf).withColumn("clock", F.format_string("%02d:%02d", F.floor(F.col("value") / 10), (F.col("event_id") % 60))).select("event_id", "clock", X.clock_seconds(F.col("clock")).alias("seconds"), X.frame_of(X.clock_seconds(F.col("clock")), 29.97).alias("frame")),
    "SELECT event_id, clock, s AS seconds, trunc(s * 29.97::DOUBLE)::BIGINT AS frame FROM (SELECT event_id, printf('%02d:%02d', floor(value / 10)::BIGINT, event_id % 60) AS clock, floor(value / 10)::BIGINT * 60 + event_id % 60 AS s FROM events)",
)
_add("big_number", lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", X.big_number(F.floor("o_totalprice") * 1000 + 7, 2).alias("text")), "SELECT o_orderkey, CASE WHEN n < 1000 THEN printf('%.2f', n::DOUBLE) WHEN n < 1000000 THEN printf('%.2fK', n / 1e3) WHEN n < 1000000000 THEN printf('%.2fM', n / 1e6) ELSE printf('%.2fB', n / 1e9) END AS text FROM (SELECT o_orderkey, floor(o_totalprice) * 1000 + 7 AS n FROM orders)")
_add("file_paths", lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", X.file_path(F.floor(F.col("o_orderkey") / 1000), F.col("o_orderkey") % 1000).alias("path")).distinct(), "SELECT DISTINCT o_orderkey, printf('data/chunk-%03d/file-%03d.parquet', o_orderkey // 1000, o_orderkey % 1000) AS path FROM orders")


def _staged(spark, sf):
    f = event_frames(spark, sf)
    stages = f.where("frame_index % 12 = 2").groupBy("episode_index").agg(F.array_sort(F.collect_list(F.struct(F.col("frame_index").alias("start"), (F.col("frame_index") + 9).alias("end"), F.floor(F.col("frame_index") / 12).cast("long").alias("stage")))).alias("stages"))
    rows = f.join(stages, "episode_index", "left")
    stage, tau = X.stage_and_tau(F.col("frame_index"), F.col("stages"), 8)
    return rows.select("episode_index", "frame_index", stage.alias("stage"), tau.alias("tau")).withColumn("progress", X.overall_progress(F.col("stage") + F.col("tau"), X.breakpoints([1, 2, 1, 1, 2, 1, 1, 1])))


_POINTS = [float(x) for x in X.breakpoints([1, 2, 1, 1, 2, 1, 1, 1])]
_CASES = " ".join(f"WHEN x < {i + 1} THEN {a!r}::DOUBLE + (x - {i}) * ({b!r}::DOUBLE - {a!r}::DOUBLE)" for i, (a, b) in enumerate(zip(_POINTS, _POINTS[1:])))
_add(
    "stage_progress",
    _staged,
    f"""WITH {EVENT_FRAMES}, l AS (SELECT episode_index, max(frame_index) AS last FROM f WHERE frame_index % 12 = 2 GROUP BY 1),
    t AS (SELECT f.episode_index, frame_index, CASE WHEN last IS NULL OR frame_index < 2 THEN 0 WHEN frame_index > last + 9 THEN 7 WHEN (frame_index - 2) % 12 <= 9 THEN (frame_index - 2) // 12 ELSE (frame_index - 2) // 12 END::BIGINT AS stage,
      CASE WHEN last IS NULL OR frame_index < 2 THEN 0 WHEN frame_index > last + 9 THEN 0.999 WHEN (frame_index - 2) % 12 <= 9 THEN ((frame_index - 2) % 12) / 9 ELSE 1 END::DOUBLE AS tau FROM f LEFT JOIN l USING (episode_index)),
    x AS (SELECT *, stage + tau AS x FROM t) SELECT episode_index, frame_index, stage, tau, CASE WHEN x < 0 THEN 0 WHEN x >= 8 THEN 1 {_CASES} END AS progress FROM x""",
)


def _rabc(spark, sf):
    d = event_frames(spark, sf).withColumn("delta", W.progress_delta("value", 3) / 100)
    stats = d.agg(F.greatest(F.coalesce(F.avg("delta"), F.lit(0.0)), F.lit(0.0)).alias("mean"), F.greatest(F.coalesce(F.stddev_pop("delta"), F.lit(0.0)), F.lit(1e-6)).alias("std")).first()
    return d.select("episode_index", "frame_index", "delta", X.advantage_weight(F.col("delta"), stats["mean"], stats["std"], 0.3).alias("weight"))


_add(
    "rabc_weights",
    _rabc,
    f"""WITH {EVENT_FRAMES}, d AS (SELECT episode_index, frame_index, (CASE WHEN frame_index + 3 < count(*) OVER (PARTITION BY episode_index) THEN lead(value, 3) OVER (PARTITION BY episode_index ORDER BY frame_index)
      ELSE last_value(value) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END - value) / 100 AS delta FROM f),
    s AS (SELECT greatest(avg(delta), 0) AS mean, greatest(stddev_pop(delta), 1e-6) AS std FROM d)
    SELECT episode_index, frame_index, delta, CASE WHEN delta IS NULL THEN 1 WHEN delta > 0.3 THEN 1 WHEN delta >= 0 THEN greatest(0, least(1, (delta - (mean - 2 * std)) / (4 * std + 1e-6))) ELSE 0 END::DOUBLE AS weight FROM d, s""",
)
_QUAT = "[sin(value / 100) * 0.6, 0, sin(value / 100) * 0.8, cos(value / 100)]"
_add(
    "quaternion_axis_angle",
    lambda spark, sf: event_frames(spark, sf).withColumn("h", F.col("value") / 100).withColumn("q", F.array(F.sin("h") * 0.6, F.lit(0.0), F.sin("h") * 0.8, F.cos("h"))).withColumn("v", X.quaternion_to_axis_angle(F.col("q"))).select("event_id", *[F.round(F.col("v")[i], 7).alias(f"v{i}") for i in range(3)]),
    "SELECT event_id, " + ", ".join(f"round(CASE WHEN sqrt(1 - cos(value / 100) ** 2) > 1e-10 THEN {c} * sin(value / 100) / sqrt(1 - cos(value / 100) ** 2) * 2 * acos(cos(value / 100)) ELSE 0 END, 7) AS v{i}" for i, c in enumerate(("0.6::DOUBLE", "0::DOUBLE", "0.8::DOUBLE"))) + " FROM events",
)
_add(
    "rotation_round_trip",
    lambda spark, sf: event_frames(spark, sf).withColumn("h", F.col("value") / 50).withColumn("q", X.rotvec_to_quaternion(F.array(F.lit(0.0), F.lit(0.0), F.col("h")))).withColumn("v", X.rotate(X.quaternion_to_matrix(F.col("q")), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))).select("event_id", F.round(F.col("v")[0], 6).alias("x"), F.round(F.col("v")[1], 6).alias("y"), F.round(F.col("v")[2], 6).alias("z")),
    "SELECT event_id, round(cos(value / 50) - 2 * sin(value / 50), 6) AS x, round(sin(value / 50) + 2 * cos(value / 50), 6) AS y, 3.0::DOUBLE AS z FROM events",
)
_add("gripper_penalty", lambda spark, sf: line_frames(spark, sf).select("episode_index", "frame_index", X.gripper_penalty(F.col("action")[0], F.col("action")[0] * F.col("frame_index") / 2, 50.0, -0.02).alias("penalty"), X.gripper_position(F.col("action")[0], F.col("frame_index"), 5.0, 0.0, 50.0).alias("position")), f"WITH {LINE_FRAMES}, s AS (SELECT *, action[1] / 50 AS s, action[1] * frame_index / 2 / 50 AS a FROM g) SELECT episode_index, frame_index, CASE WHEN (s < 0.5 AND a > 0.5) OR (s > 0.75 AND a < 0.5) THEN -0.02 ELSE 0 END::DOUBLE AS penalty, greatest(0, least(50, action[1] + frame_index * 5))::DOUBLE AS position FROM s")
_add(
    "motor_units",
    lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", X.unit_value(F.col("o_totalprice"), F.lit(1000.0), F.lit(300000.0), "RANGE_M100_100", F.col("o_orderkey") % 2 == 0).alias("m100"), X.unit_value(F.col("o_totalprice"), F.lit(1000.0), F.lit(300000.0), "RANGE_0_100").alias("p100"), X.unit_value(F.col("o_totalprice"), F.lit(1000.0), F.lit(300000.0), "DEGREES").alias("degrees")),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * ((least(300000, greatest(1000, o_totalprice)) - 1000) / 299000 * 200 - 100) AS m100, (least(300000, greatest(1000, o_totalprice)) - 1000) / 299000 * 100 AS p100, (o_totalprice - 150500) * 360 / 4095 AS degrees FROM orders",
)
_add("intervention_override", lambda spark, sf: event_frames(spark, sf).select("event_id", X.intervened(F.col("value"), F.lit(0.5), F.col("task") == "click").alias("action"), (F.col("task") == "purchase").cast("double").alias("reward"), X.clipped(F.col("value"), 10.0, 60.0).alias("bounded")), "SELECT event_id, CASE WHEN event_type = 'click' THEN 0.5 ELSE value END::DOUBLE AS action, (event_type = 'purchase')::INT::DOUBLE AS reward, greatest(10, least(60, value))::DOUBLE AS bounded FROM events")
_add("delta_enabled", lambda spark, sf: line_frames(spark, sf).select("episode_index", "frame_index", X.delta_enabled(F.slice("action", 3, 2), 0.08).alias("enabled"), X.float_position(F.col("action"), 0.05).alias("place")), f"WITH {LINE_FRAMES} SELECT episode_index, frame_index, sqrt(action[3] ** 2 + action[4] ** 2) > 0.08 AS enabled, CASE WHEN abs(action[1] - 0.05) < 1e-6 THEN 0 WHEN abs(action[2] - 0.05) < 1e-6 THEN 1 WHEN abs(action[3] - 0.05) < 1e-6 THEN 2 WHEN abs(action[4] - 0.05) < 1e-6 THEN 3 ELSE -1 END::BIGINT AS place FROM g")
_add("nan_filter", lambda spark, sf: line_frames(spark, sf).withColumn("v", F.when(F.col("frame_index") == 2, F.array(F.lit(float("nan")))).otherwise(F.col("action"))).where(~X.has_nan(F.col("v"))).select("episode_index", "frame_index"), f"WITH {LINE_FRAMES} SELECT episode_index, frame_index FROM g WHERE frame_index <> 2")
