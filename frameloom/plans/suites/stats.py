"""Statistics over events, lineitem and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import edits as E
from ...operators import stats as S
from ...sources.adapters import EVENT_FRAMES, LINE_FRAMES, VECTOR_FRAMES, event_frames, line_frames, table, vector_frames

QUERIES, ORACLES = {}, {}
_Q = S.QUANTILES
_QUANT = ", ".join(f"CASE WHEN count(v) < 2 THEN avg(v) ELSE quantile_cont(v, {q}) END AS {S.quantile_name(q)}" for q in _Q)
_STATS = f"min(v) AS min, max(v) AS max, avg(v) AS mean, stddev_pop(v) AS std, count(v) AS count, {_QUANT}"


def _add(name, query, sql):
    QUERIES[name], ORACLES[name] = query, sql


def _event_stats(spark, sf):
    return S.feature_stats(event_frames(spark, sf), "value", ["episode_index"])


_add("episode_stats", _event_stats, f"SELECT user_id AS episode_index, {_STATS} FROM (SELECT user_id, value AS v FROM events) GROUP BY 1")
_POOL = "min(min) AS min, max(max) AS max, sum(mean * count) / sum(count) AS mean, sqrt(greatest(sum((std * std + mean * mean) * count) / sum(count) - (sum(mean * count) / sum(count)) ** 2, 0)) AS std, sum(count)::BIGINT AS count, " + ", ".join(f"sum({S.quantile_name(q)} * count) / sum(count) AS {S.quantile_name(q)}" for q in _Q)
_add("pooled_stats", lambda spark, sf: S.pooled_stats(_event_stats(spark, sf)), f"SELECT {_POOL} FROM (SELECT user_id, {_STATS} FROM (SELECT user_id, value AS v FROM events) GROUP BY 1)")
#: Values like unix times: far from 0 beside their spread.
_FAR = "1.7e9 + value / 100"
_add(
    "pooled_far_stats",
    lambda spark, sf: S.pooled_stats(S.feature_stats(event_frames(spark, sf).withColumn("value", F.expr("1.7e9D + value / 100")), "value", ["episode_index"], ()), (), ()).select("min", "max", F.round(F.col("mean") - 1.7e9, 5).alias("mean"), F.round("std", 5).alias("std"), "count"),
    f"SELECT min(v) AS min, max(v) AS max, round(avg(v - 1.7e9), 5) AS mean, round(stddev_pop(v - 1.7e9), 5) AS std, count(*) AS count FROM (SELECT {_FAR} AS v FROM events)",
)
_add(
    "merged_far_moments",
    lambda spark, sf: S.moment_stats(S.merged_moments(S.moments(event_frames(spark, sf).withColumn("value", F.expr("1.7e9D + value / 100")), "value", ["episode_index", "task"], 1.7e9, 1.7e9 + 1, 10), ["task"])).select("task", "count", F.round(F.col("mean") - 1.7e9, 5).alias("mean"), F.round("std", 5).alias("std")),
    f"SELECT event_type AS task, count(*) AS count, round(avg(v - 1.7e9), 5) AS mean, round(stddev_pop(v - 1.7e9), 5) AS std FROM (SELECT event_type, {_FAR} AS v FROM events) GROUP BY 1",
)
_add("exact_quantiles", lambda spark, sf: S.feature_stats(event_frames(spark, sf), "value", ["task"]), f"SELECT event_type AS task, {_STATS} FROM (SELECT event_type, value AS v FROM events) GROUP BY 1")
_add("vector_dim_stats", lambda spark, sf: S.vector_stats(vector_frames(spark, sf), "state").withColumn("dim", F.col("dim").cast("long")), f"SELECT dim, {_STATS} FROM (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY 1")
_add(
    "vector_episode_stats",
    lambda spark, sf: S.vector_stats(vector_frames(spark, sf), "state", ["episode_index"], ()).withColumn("dim", F.col("dim").cast("long")),
    "SELECT label::BIGINT AS episode_index, dim, min(v) AS min, max(v) AS max, avg(v) AS mean, stddev_pop(v) AS std, count(v) AS count FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY 1, 2",
)
_add(
    "row_stats",
    lambda spark, sf: vector_frames(spark, sf).select("vec_id", *S.row_stats("state")),
    "SELECT vec_id, list_min(s) AS min, list_max(s) AS max, list_avg(s) AS mean, list_stddev_pop(s) AS std, len(s) AS count FROM (SELECT vec_id, embedding::DOUBLE[] AS s FROM embeddings)",
)
_add("global_stats", lambda spark, sf: S.global_stats(vector_frames(spark, sf), "state"), "SELECT min(v) AS min, max(v) AS max, avg(v) AS mean, stddev_pop(v) AS std, (SELECT count(*) FROM embeddings) AS count FROM (SELECT unnest(embedding)::DOUBLE AS v FROM embeddings)")
_BINS = 100
_HIST = ", ".join(f"arg_min(CASE WHEN b = 0 THEN lo ELSE lo + w * (b + ({q} * n - (cum - c)) / c) END, CASE WHEN cum >= {q} * n THEN b END) AS {S.quantile_name(q)}" for q in _Q)
_add(
    "histogram_quantiles",
    lambda spark, sf: S.histogram_quantiles(event_frames(spark, sf), "value", ["task"], bins=_BINS),
    f"""WITH s AS (SELECT event_type AS task, min(value) AS lo, max(value) AS hi, count(*) AS n FROM events GROUP BY 1),
    b AS (SELECT task, lo, n, (hi - lo) / {_BINS} AS w, least(floor((value - lo) / ((hi - lo) / {_BINS})), {_BINS - 1})::BIGINT AS b FROM events JOIN s ON s.task = event_type),
    c AS (SELECT task, lo, w, n, b, count(*) AS c FROM b GROUP BY ALL), d AS (SELECT *, sum(c) OVER (PARTITION BY task ORDER BY b) AS cum FROM c)
    SELECT task, {_HIST} FROM d GROUP BY task""",
)
_add("episode_bounds", lambda spark, sf: S.episode_bounds(E.renumbered(event_frames(spark, sf))), f"WITH {EVENT_FRAMES}, g AS (SELECT dense_rank() OVER (ORDER BY episode_index) - 1 AS episode_index, row_number() OVER (ORDER BY episode_index, frame_index) - 1 AS index FROM f) SELECT episode_index, min(index) AS \"from\", max(index) + 1 AS \"to\", count(*) AS length FROM g GROUP BY 1")
_add(
    "episode_runs",
    lambda spark, sf: S.episode_runs(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), "event_type", ["ts", "event_id"], ["user_id"]).select("user_id", F.col("run").cast("long").alias("run"), "event_type", F.col("from").cast("long").alias("from"), F.col("to").cast("long").alias("to")),
    """WITH r AS (SELECT user_id, event_type, row_number() OVER w - 1 AS place, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS fresh, ts, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS run FROM r) SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, min(place) AS "from", max(place) + 1 AS "to" FROM s GROUP BY user_id, run""",
)
_add("distinct_tasks", lambda spark, sf: event_frames(spark, sf).groupBy("task").agg(F.count_distinct("episode_index").alias("episodes"), F.count(F.lit(1)).alias("frames")), "SELECT event_type AS task, count(DISTINCT user_id) AS episodes, count(*) AS frames FROM events GROUP BY 1")
_add("dataset_totals", lambda spark, sf: event_frames(spark, sf).agg(F.count_distinct("episode_index").alias("total_episodes"), F.count(F.lit(1)).alias("total_frames"), F.count_distinct("task").alias("total_tasks"), (F.count(F.lit(1)) / F.count_distinct("episode_index")).alias("avg_frames"), (F.count(F.lit(1)) / F.count_distinct("episode_index") / 30).alias("avg_seconds")), "SELECT count(DISTINCT user_id) AS total_episodes, count(*) AS total_frames, count(DISTINCT event_type) AS total_tasks, count(*) / count(DISTINCT user_id) AS avg_frames, count(*) / count(DISTINCT user_id) / 30 AS avg_seconds FROM events")
_add(
    "rollout_metrics",
    lambda spark, sf: S.rollout_metrics(event_frames(spark, sf).withColumn("done", F.col("value") > 90).withColumn("success", F.col("task") == "purchase"), "value", "success", "done"),
    f"WITH {EVENT_FRAMES}, d AS (SELECT *, min(CASE WHEN value > 90 THEN frame_index END) OVER (PARTITION BY episode_index) AS first FROM f), k AS (SELECT *, coalesce(frame_index <= first + 1, true) AS inside FROM d) SELECT episode_index, sum(CASE WHEN inside THEN value ELSE 0 END) AS sum_reward, max(CASE WHEN inside THEN value ELSE 0 END) AS max_reward, bool_or(inside AND task = 'purchase') AS success FROM k GROUP BY 1",
)
_add(
    "evaluation_groups",
    lambda spark, sf: S.grouped_and_overall(event_frames(spark, sf).withColumn("success", (F.col("value") > 50).cast("double")), "task", ["value"], ["success"]),
    "SELECT event_type AS task, count(*) AS n, avg(value) AS avg_value, avg((value > 50)::INT) * 100 AS pc_success, grouping(event_type)::BIGINT AS level FROM events GROUP BY ROLLUP (event_type)",
)
_add("running_mean", lambda spark, sf: event_frames(spark, sf).withColumn("w", F.col("frame_index") % 3 + 1).select("episode_index", "frame_index", S.running_mean("value", "w", ["frame_index"], ["episode_index"]).alias("mean")), f"WITH {EVENT_FRAMES} SELECT episode_index, frame_index, sum(value * (frame_index % 3 + 1)) OVER w / sum(frame_index % 3 + 1) OVER w AS mean FROM f WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)")
_add(
    "frame_rate",
    lambda spark, sf: event_frames(spark, sf).withColumn("t", F.expr("unix_micros(cast(ts as timestamp)) / 1e6D")).groupBy("episode_index").agg(S.frame_rate(F.col("t")).alias("fps")),
    "SELECT user_id AS episode_index, CASE WHEN max(t) - min(t) > 1e-6 THEN (count(t) - 1) / (max(t) - min(t)) ELSE 0 END AS fps FROM (SELECT user_id, epoch_us(ts) / 1e6 AS t FROM events) GROUP BY 1",
)
_add(
    "latency_quantile",
    lambda spark, sf: S.latency(event_frames(spark, sf).withColumn("v", F.col("value") - 5), "v", ["frame_index"], ["episode_index"], 20).select("episode_index", "frame_index", "quantile", "max_ever"),
    f"WITH {EVENT_FRAMES} SELECT episode_index, frame_index, quantile_cont(value - 5, 0.95) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS quantile, max(value - 5) OVER (PARTITION BY episode_index ORDER BY frame_index) AS max_ever FROM f WHERE value - 5 >= 0",
)
_add(
    "compression_stats",
    lambda spark, sf: table(spark, sf, "documents").select(F.length("text").alias("l"), F.size(F.split("text", " ")).alias("t")).agg((F.sum("l") / F.sum("t")).alias("ratio"), F.avg("t").alias("mean_tokens"), F.percentile("t", 0.99).alias("p99_tokens"), F.min("t").cast("long").alias("min_tokens"), F.max("t").cast("long").alias("max_tokens")),
    "SELECT sum(l) / sum(t) AS ratio, avg(t) AS mean_tokens, quantile_cont(t, 0.99)::DOUBLE AS p99_tokens, min(t) AS min_tokens, max(t) AS max_tokens FROM (SELECT length(text) AS l, len(string_split(text, ' ')) AS t FROM documents)",
)
_SUBTASKS = "SELECT user_id AS episode_index, event_type AS name, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS start, value AS duration FROM events"
_add(
    "temporal_proportions",
    lambda spark, sf: S.temporal_proportions(event_frames(spark, sf).select("episode_index", F.col("task").alias("name"), F.col("frame_index").alias("start"), F.col("value").alias("duration"))),
    f"WITH s AS ({_SUBTASKS}), t AS (SELECT episode_index, sum(duration) AS total FROM s GROUP BY 1 HAVING sum(duration) > 0), o AS (SELECT episode_index, name, arg_max(duration, start) AS d FROM s GROUP BY 1, 2), m AS (SELECT name, avg(d / total) AS mean FROM o JOIN t USING (episode_index) GROUP BY 1) SELECT name, mean / sum(mean) OVER () AS proportion FROM m",
)
_add("metadata_agreement", lambda spark, sf: line_frames(spark, sf).groupBy(F.size("action").alias("shape")).agg(F.count(F.lit(1)).alias("n")).agg((F.count(F.lit(1)) == 1).alias("agrees"), F.sum("n").alias("rows")), f"WITH {LINE_FRAMES} SELECT count(DISTINCT len(action)) = 1 AS agrees, count(*) AS rows FROM g")
_ = VECTOR_FRAMES
