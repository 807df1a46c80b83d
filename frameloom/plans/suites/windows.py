"""Temporal windows over the episodes of events and lineitem."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...operators import windows as W
from ...sources.adapters import EVENT_FRAMES, LINE_FRAMES, event_frames, line_frames

QUERIES, ORACLES = {}, {}
_IN = "PARTITION BY episode_index ORDER BY frame_index"
_ALL = f"({_IN} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def _add(name, query, sql, frames=EVENT_FRAMES):
    QUERIES[name] = query
    ORACLES[name] = f"WITH {frames}, n AS (SELECT *, count(*) OVER (PARTITION BY episode_index) AS n FROM {frames.split()[0]}) {sql}"


def _shift(k):
    return f"lag(value, {-k}) OVER ({_IN})" if k < 0 else f"lead(value, {k}) OVER ({_IN})" if k else "value"


def _clamp(k):
    edge = f"first_value(value) OVER {_ALL}" if k < 0 else f"last_value(value) OVER {_ALL}"
    return f"CASE WHEN frame_index + {k} BETWEEN 0 AND n - 1 THEN {_shift(k)} ELSE {edge} END" if k else "value"


def _cell(k):
    return f"m{-k}" if k < 0 else f"p{k}"


_KS = (-2, -1, 0, 1)
_add(
    "delta_window_clamped",
    lambda spark, sf: W.delta_window(event_frames(spark, sf).select("episode_index", "frame_index", "value"), {"value": _KS}),
    "SELECT episode_index, frame_index, value, " + ", ".join(f"{_clamp(k)} AS value_{_cell(k)}, NOT frame_index + {k} BETWEEN 0 AND n - 1 AS value_{_cell(k)}_is_pad" for k in _KS) + " FROM n",
)
_LONG = (-5, -3, 0, 2, 4)
_add(
    "delta_window_arrays",
    lambda spark, sf: W.delta_arrays(event_frames(spark, sf), "value", _LONG).select("episode_index", "frame_index", F.posexplode(F.arrays_zip("value_window", "value_is_pad")).alias("k", "c")).select("episode_index", "frame_index", F.col("k").cast("long").alias("k"), F.col("c.value_window").alias("value"), F.col("c.value_is_pad").alias("is_pad")),
    " UNION ALL ".join(f"SELECT episode_index, frame_index, {i}::BIGINT AS k, {_clamp(k)} AS value, NOT frame_index + {k} BETWEEN 0 AND n - 1 AS is_pad FROM n" for i, k in enumerate(_LONG)),
)
_GAPS = (-5, -1, 0, 3, 6)


def _repeat_sql():
    cells = []
    for side in (sorted(k for k in _GAPS if k <= 0)[::-1], sorted(k for k in _GAPS if k > 0)):
        last = "value"
        for k in side:
            last = f"CASE WHEN frame_index + {k} BETWEEN 0 AND n - 1 THEN {_shift(k)} ELSE {last} END"
            cells.append(f"{last} AS value_{_cell(k)}, NOT frame_index + {k} BETWEEN 0 AND n - 1 AS value_{_cell(k)}_is_pad")
    return ", ".join(cells)


_add("delta_window_streaming", lambda spark, sf: W.repeated_window(event_frames(spark, sf).select("episode_index", "frame_index", "value"), "value", _GAPS), f"SELECT episode_index, frame_index, value, {_repeat_sql()} FROM n")
_add(
    "action_chunks",
    lambda spark, sf: W.chunks(event_frames(spark, sf), "value", 4).select("episode_index", "frame_index", *[F.col("value_chunk")[i].alias(f"c{i}") for i in range(4)]),
    f"SELECT episode_index, frame_index, c0, c1, c2, c3 FROM (SELECT episode_index, frame_index, n, value AS c0, lead(value, 1) OVER ({_IN}) AS c1, lead(value, 2) OVER ({_IN}) AS c2, lead(value, 3) OVER ({_IN}) AS c3 FROM n) WHERE frame_index + 4 <= n",
)
_add("velocity", lambda spark, sf: event_frames(spark, sf).select("episode_index", "frame_index", W.velocity("value", 0.1).alias("velocity")), f"SELECT episode_index, frame_index, coalesce((value - lag(value) OVER ({_IN})) / 0.1::DOUBLE, 0) AS velocity FROM n")
_add(
    "vector_velocity",
    lambda spark, sf: line_frames(spark, sf).withColumn("v", W.vector_velocity("action", 0.5)).select("episode_index", "frame_index", F.posexplode("v").alias("dim", "velocity")).withColumn("dim", F.col("dim").cast("long")),
    f"SELECT episode_index, frame_index, dim - 1 AS dim, (action[dim] - coalesce(before[dim], action[dim])) / 0.5 AS velocity FROM (SELECT episode_index, frame_index, action, lag(action) OVER ({_IN}) AS before, unnest([1, 2, 3, 4])::BIGINT AS dim FROM (SELECT episode_index, frame_index, action FROM n)) ",
    LINE_FRAMES,
)
ORACLES["vector_velocity"] = f"WITH {LINE_FRAMES}, b AS (SELECT episode_index, frame_index, action, lag(action) OVER ({_IN}) AS before FROM g) SELECT episode_index, frame_index, dim - 1 AS dim, (action[dim] - coalesce(before[dim], action[dim])) / 0.5::DOUBLE AS velocity FROM b, (SELECT unnest([1, 2, 3, 4])::BIGINT AS dim)"
_add("time_limit", lambda spark, sf: event_frames(spark, sf).select("episode_index", "frame_index", W.time_limit(20, F.col("task") == "error").alias("truncated")), "SELECT episode_index, frame_index, frame_index + 1 >= 20 OR task = 'error' AS truncated FROM n")
_add("done_inference", lambda spark, sf: event_frames(spark, sf).select("episode_index", "frame_index", W.is_last().alias("done")), "SELECT episode_index, frame_index, frame_index = n - 1 AS done FROM n")
_add(
    "rising_edge_latch",
    lambda spark, sf: W.latch(event_frames(spark, sf), "value", F.col("value") > 50, "reference").select("episode_index", "frame_index", "reference_edge", "reference"),
    f"SELECT episode_index, frame_index, edge AS reference_edge, last_value(CASE WHEN edge THEN value END IGNORE NULLS) OVER ({_IN}) AS reference FROM (SELECT *, value > 50 AND NOT coalesce(lag(value > 50) OVER ({_IN}), false) AS edge FROM n)",
)
_add("jump_check", lambda spark, sf: event_frames(spark, sf).select("episode_index", "frame_index", W.jump("value", 40.0).alias("jumps")), f"SELECT episode_index, frame_index, coalesce(abs(value - lag(value) OVER ({_IN})) > 40, false) AS jumps FROM n")
_SPARSE = "CASE WHEN event_id % 5 = 0 THEN value END"
_add(
    "interpolate_progress",
    lambda spark, sf: event_frames(spark, sf).withColumn("progress", F.expr(_SPARSE)).select("episode_index", "frame_index", W.interpolated("progress").alias("progress")),
    f"SELECT episode_index, frame_index, CASE WHEN v IS NOT NULL THEN v WHEN b_at IS NULL THEN av WHEN a_at IS NULL THEN bv ELSE bv + (av - bv) * (frame_index - b_at) / nullif(a_at - b_at, 0) END AS progress FROM (SELECT *, "
    f"last_value(v IGNORE NULLS) OVER ({_IN}) AS bv, last_value(CASE WHEN v IS NOT NULL THEN frame_index END IGNORE NULLS) OVER ({_IN}) AS b_at, "
    f"first_value(v IGNORE NULLS) OVER ({_IN} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS av, first_value(CASE WHEN v IS NOT NULL THEN frame_index END IGNORE NULLS) OVER ({_IN} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a_at FROM (SELECT *, {_SPARSE} AS v FROM n))",
)
_add(
    "progress_delta",
    lambda spark, sf: event_frames(spark, sf).select("episode_index", "frame_index", W.progress_delta("value", 3).alias("delta")),
    f"SELECT episode_index, frame_index, CASE WHEN frame_index + 3 < n THEN lead(value, 3) OVER ({_IN}) ELSE last_value(value) OVER {_ALL} END - value AS delta FROM n",
)
_STRIDED = W.strided(2, 3)
_add(
    "strided_window",
    lambda spark, sf: W.delta_window(event_frames(spark, sf).select("episode_index", "frame_index", "value"), {"value": _STRIDED}),
    "SELECT episode_index, frame_index, value, " + ", ".join(f"{_clamp(k)} AS value_{_cell(k)}, NOT frame_index + {k} BETWEEN 0 AND n - 1 AS value_{_cell(k)}_is_pad" for k in _STRIDED) + " FROM n",
)
_add(
    "rewind_history",
    lambda spark, sf: W.rewind(event_frames(spark, sf), "value", 3).select("episode_index", "frame_index", *[F.col("value_window")[i].alias(f"r{i + 1}") for i in range(3)]),
    f"SELECT episode_index, frame_index, {_clamp(-1)} AS r1, {_clamp(-2)} AS r2, {_clamp(-3)} AS r3 FROM n",
)
_add(
    "gap_order",
    lambda spark, sf: event_frames(spark, sf).select("episode_index", "frame_index", F.row_number().over(Window.partitionBy("episode_index").orderBy(*W.gap_order(5))).cast("long").alias("visit")),
    "SELECT episode_index, frame_index, row_number() OVER (PARTITION BY episode_index ORDER BY frame_index % 5, frame_index) AS visit FROM n",
)
_add(
    "episode_prefix_index",
    lambda spark, sf: W.prefix_bounds(event_frames(spark, sf).groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"))),
    "SELECT episode_index, length, (sum(length) OVER (ORDER BY episode_index) - length)::BIGINT AS dataset_from_index, (sum(length) OVER (ORDER BY episode_index))::BIGINT AS dataset_to_index FROM (SELECT episode_index, count(*) AS length FROM n GROUP BY 1)",
)
_add(
    "video_offsets",
    lambda spark, sf: W.prefix_bounds(event_frames(spark, sf).groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"))).select("episode_index", (F.col("dataset_from_index") / 30.0).alias("from_timestamp"), (F.col("dataset_to_index") / 30.0).alias("to_timestamp")),
    "SELECT episode_index, (sum(k) OVER (ORDER BY episode_index) - k)::DOUBLE / 30 AS from_timestamp, (sum(k) OVER (ORDER BY episode_index))::DOUBLE / 30 AS to_timestamp FROM (SELECT episode_index, count(*) AS k FROM n GROUP BY 1)",
)
_add(
    "temporal_ensemble",
    lambda spark, sf: W.ensemble(event_frames(spark, sf).select("episode_index", "frame_index", "value", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select("episode_index", "frame_index", (F.col("frame_index") + F.col("k")).alias("target_frame"), (F.col("value") + F.col("k")).alias("prediction")), 0.1),
    "SELECT episode_index, target_frame, sum(w * prediction) / sum(w) AS prediction, count(*) AS n_predictions FROM (SELECT episode_index, frame_index + k AS target_frame, value + k AS prediction, exp(-0.1 * (row_number() OVER (PARTITION BY episode_index, frame_index + k ORDER BY frame_index) - 1)) AS w FROM n, range(4) r(k)) GROUP BY 1, 2",
)
_WEIGHTS = W.prefix_weights("exp", 3, 12, 16)
_WEIGHTS_SQL = "[" + ", ".join(f"{w!r}::DOUBLE" for w in _WEIGHTS) + "]"
_add(
    "prefix_weighted_chunk",
    lambda spark, sf: event_frames(spark, sf).where("frame_index < 16").withColumn("w", F.element_at(F.array(*[F.lit(w) for w in _WEIGHTS]), (F.col("frame_index") + 1).cast("int"))).groupBy("episode_index").agg(F.sum(F.col("w") * F.col("value")).alias("blended"), F.sum("w").alias("mass")),
    f"SELECT episode_index, sum({_WEIGHTS_SQL}[frame_index + 1] * value) AS blended, sum({_WEIGHTS_SQL}[frame_index + 1]) AS mass FROM n WHERE frame_index < 16 GROUP BY 1",
)
_add("next_state", lambda spark, sf: event_frames(spark, sf).select("episode_index", "frame_index", "value", W.next_state("value").alias("next_value"), W.is_last().alias("done")), f"SELECT episode_index, frame_index, value, CASE WHEN frame_index = n - 1 THEN value ELSE lead(value) OVER ({_IN}) END AS next_value, frame_index = n - 1 AS done FROM n")
