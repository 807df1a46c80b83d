"""Lookups, nearest in time, intervals and maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import joins as J
from ...operators.windows import EPISODE
from ...sources.adapters import EVENT_FRAMES, LINE_FRAMES, event_frames, line_frames, table

QUERIES, ORACLES = {}, {}


def _add(name, query, sql):
    QUERIES[name], ORACLES[name] = query, sql


def _tasks(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("task")).distinct().withColumn("task_index", F.length("task").cast("long") * 10 + F.ascii("task"))


_TASKS = "tasks AS (SELECT task, length(task) * 10 + ascii(task) AS task_index FROM (SELECT DISTINCT event_type AS task FROM events))"
_add("task_lookup", lambda spark, sf: J.lookup(event_frames(spark, sf), _tasks(spark, sf), "task").select(EPISODE, "frame_index", "task", "task_index"), f"WITH {EVENT_FRAMES}, {_TASKS} SELECT episode_index, frame_index, task, task_index FROM f JOIN tasks USING (task)")
_add("subtask_lookup", lambda spark, sf: J.lookup(event_frames(spark, sf), _tasks(spark, sf).where("task_index % 2 = 0"), "task", True).select(EPISODE, "frame_index", "task", "task_index"), f"WITH {EVENT_FRAMES}, {_TASKS} SELECT episode_index, frame_index, task, task_index FROM f LEFT JOIN (SELECT * FROM tasks WHERE task_index % 2 = 0) USING (task)")
_add(
    "episode_bounds_lookup",
    lambda spark, sf: J.lookup(event_frames(spark, sf), event_frames(spark, sf).groupBy(EPISODE).agg(F.count(F.lit(1)).alias("length")), EPISODE).select(EPISODE, "frame_index", "length"),
    f"WITH {EVENT_FRAMES} SELECT episode_index, frame_index, count(*) OVER (PARTITION BY episode_index) AS length FROM f",
)
_SECONDS = "cast(unix_micros(cast(ts as timestamp)) as double) / 1e6D"


def _series(spark, sf):
    f = event_frames(spark, sf).withColumn("t", F.expr(_SECONDS))
    return f.where("event_id % 3 = 0").select(EPISODE, F.col("t").alias("query_t"), F.col("event_id").alias("query_id")), f.where("event_id % 3 <> 0").select(EPISODE, "t", "value", "event_id")


def _nearest(spark, sf):
    q, s = _series(spark, sf)
    return J.nearest(q, s, EPISODE, "query_t", "t", ["value", "event_id"], 3600.0).select(EPISODE, "query_id", "value", "event_id", "distance", "is_pad")


_add(
    "nearest_asof",
    _nearest,
    f"""WITH {EVENT_FRAMES}, t AS (SELECT *, epoch_us(ts)::DOUBLE / 1e6 AS t FROM f), q AS (SELECT * FROM t WHERE event_id % 3 = 0), s AS (SELECT * FROM t WHERE event_id % 3 <> 0),
    m AS (SELECT q.episode_index, q.event_id AS query_id, s.value, s.event_id, abs(s.t - q.t) AS distance, row_number() OVER (PARTITION BY q.event_id ORDER BY abs(s.t - q.t), s.t) AS r FROM q LEFT JOIN s ON q.episode_index = s.episode_index)
    SELECT episode_index, query_id, value, event_id, distance, coalesce(distance > 3600, true) AS is_pad FROM m WHERE r = 1""",
)
_add(
    "file_map",
    lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("file")).join(table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("file"), (F.col("n_regionkey") * 100).cast("long").alias("to_file")), "file", "left").select("o_orderkey", F.coalesce("to_file", F.lit(0)).cast("long").alias("to_file")),
    "SELECT o_orderkey, coalesce(n_regionkey * 100, 0)::BIGINT AS to_file FROM orders LEFT JOIN nation ON o_custkey % 50 = n_nationkey",
)
_add(
    "task_remap",
    lambda spark, sf: table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name", F.col("r_regionkey").cast("long").alias("task_index")),
    "SELECT s_suppkey, n_name, r_name, r_regionkey::BIGINT AS task_index FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
_add(
    "episode_remap",
    lambda spark, sf: event_frames(spark, sf).join(event_frames(spark, sf).select(EPISODE).distinct().withColumn("new_episode", F.col(EPISODE) * 10), EPISODE).select("new_episode", "frame_index", "value"),
    f"WITH {EVENT_FRAMES} SELECT episode_index * 10 AS new_episode, frame_index, value FROM f",
)
_add(
    "late_metadata",  # customers and orders: keys that only one side has, and null cells on the left
    lambda spark, sf: J.prefer_left(table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.expr("case when c_custkey % 4 = 0 then c_acctbal end").alias("v")), table(spark, sf, "orders").groupBy(F.col("o_orderkey").alias("k")).agg(F.max("o_totalprice").alias("v"), F.max("o_orderpriority").alias("w")), "k"),
    "SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v, b.w FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal END AS v FROM customer) a FULL JOIN (SELECT o_orderkey AS k, max(o_totalprice) AS v, max(o_orderpriority) AS w FROM orders GROUP BY 1) b ON a.k = b.k",
)
_add("missing_episodes", lambda spark, sf: J.missing(table(spark, sf, "customer").select(F.col("c_custkey").alias(EPISODE)), event_frames(spark, sf).select(EPISODE).distinct()), "SELECT c_custkey AS episode_index FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
_add("present_episodes", lambda spark, sf: table(spark, sf, "customer").select(F.col("c_custkey").alias(EPISODE)).join(event_frames(spark, sf), EPISODE, "left_semi"), "SELECT c_custkey AS episode_index FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")


def _intervals(spark, sf):
    """Stages of ten frames and a gap of two, from the frames that open them."""
    return event_frames(spark, sf).where("frame_index % 12 = 0").select(EPISODE, F.col("frame_index").alias("start"), (F.col("frame_index") + 9).alias("end"), F.col("task").alias("name"))


_add(
    "subtask_ranges",
    lambda spark, sf: J.first_interval(event_frames(spark, sf).select(EPISODE, "frame_index"), _intervals(spark, sf), EPISODE, "frame_index", "start", "end", ["name", "start"], "start"),
    f"WITH {EVENT_FRAMES}, s AS (SELECT episode_index, frame_index AS start, task AS name FROM f WHERE frame_index % 12 = 0) SELECT f.episode_index, f.frame_index, s.name, s.start FROM f LEFT JOIN s ON f.episode_index = s.episode_index AND f.frame_index BETWEEN s.start AND s.start + 9",
)


def _merge(blend):
    def query(spark, sf):
        f = event_frames(spark, sf).select(EPISODE, F.col("frame_index").alias("timestep"), F.col("value").alias("action"))
        return J.merge_actions(f.where("timestep < 30"), f.where("timestep >= 20").withColumn("action", F.col("action") * 2), 24, blend=blend, by=[EPISODE])

    return query


for _name, (_o, _n) in J.BLENDS.items():
    _add(f"action_merge_{_name}", _merge(_name), f"WITH {EVENT_FRAMES} SELECT episode_index, frame_index AS timestep, CASE WHEN frame_index < 30 THEN {_o}::DOUBLE * value + {_n}::DOUBLE * (value * 2) ELSE value * 2 END AS action FROM f WHERE frame_index > 24")
def _sources(spark, sf):
    """Event numbers as global indices of three datasets, of which the last two have a quarter and a third of the rows."""
    events = table(spark, sf, "events").select("event_id")
    n = (events.agg(F.max("event_id")).first()[0] or 0) + 1
    return events.select("event_id", J.source_of(F.col("event_id"), (n - n // 4 - n // 3, n // 4, n // 3)).alias("dataset_index"))


_add("dataset_of_index", _sources, "SELECT event_id, CASE WHEN event_id < n - n // 4 - n // 3 THEN 0 WHEN event_id < n - n // 3 THEN 1 WHEN event_id < n THEN 2 END AS dataset_index FROM events, (SELECT max(event_id) + 1 AS n FROM events)")
_add(
    "line_order_join",
    lambda spark, sf: line_frames(spark, sf).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias(EPISODE), "o_orderpriority"), EPISODE).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.col("action")[0]).alias("quantity")),
    f"WITH {LINE_FRAMES} SELECT o_orderpriority, count(*) AS frames, sum(action[1]) AS quantity FROM g JOIN orders ON o_orderkey = episode_index GROUP BY 1",
)
