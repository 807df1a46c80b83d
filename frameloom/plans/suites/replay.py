"""Buffers, transitions, streams, and Spark's own relational surface over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...operators import replay as R
from ...operators.windows import EPISODE
from ...sources.adapters import EVENT_FRAMES, LINE_FRAMES, event_frames, line_frames, table
from ...streaming import stateful as T
from ..pipeline import Intervention, Pipeline, TimeLimit, ToTransition

QUERIES, ORACLES = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


_add("fifo_last_n", lambda spark, sf: R.last_n(table(spark, sf, "events").select("event_id", "value"), "event_id", 500), "SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 500")
_add("fifo_last_n_by_key", lambda spark, sf: R.last_n_by(event_frames(spark, sf).select(EPISODE, "frame_index", "value"), [EPISODE], "frame_index", 7), f"WITH {EVENT_FRAMES} SELECT episode_index, frame_index, value FROM f QUALIFY row_number() OVER (PARTITION BY episode_index ORDER BY frame_index DESC) <= 7")
_add(
    "episodes_from_done",
    lambda spark, sf: R.episodes_from_flags(table(spark, sf, "events").select("user_id", "event_id", "value"), "event_id", F.col("value") > 80, ["user_id"]).select("user_id", "event_id", EPISODE, "frame_index"),
    "WITH e AS (SELECT user_id, event_id, coalesce(sum((value > 80)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS episode_index FROM events) SELECT *, row_number() OVER (PARTITION BY user_id, episode_index ORDER BY event_id) - 1 AS frame_index FROM e",
)
_add("cumulative_done", lambda spark, sf: R.cumulative_done(event_frames(spark, sf), F.col("value") > 80, 40).select(EPISODE, "frame_index", "done"), f"WITH {EVENT_FRAMES} SELECT episode_index, frame_index, bool_or(value > 80) OVER (PARTITION BY episode_index ORDER BY frame_index) OR frame_index + 1 >= 40 AS done FROM f")
_add(
    "timed_actions",
    lambda spark, sf: R.timed_actions(line_frames(spark, sf).select(EPISODE, "frame_index", "action", F.col("frame_index").cast("double").alias("t0"), (F.col("frame_index") * 4).alias("i0")), "action", "t0", "i0", 0.25).select(EPISODE, "timestep", "timestamp", F.col("action").alias("a")),
    f"WITH {LINE_FRAMES} SELECT episode_index, frame_index * 4 + i AS timestep, frame_index + i * 0.25::DOUBLE AS timestamp, action[i + 1] AS a FROM g, range(4) r(i)",
)
_add("latest_observation", lambda spark, sf: R.latest(event_frames(spark, sf).select(EPISODE, "frame_index", "value", "event_id"), [EPISODE], "frame_index"), f"WITH {EVENT_FRAMES} SELECT episode_index, frame_index, value, event_id FROM f QUALIFY row_number() OVER (PARTITION BY episode_index ORDER BY frame_index DESC) = 1")
_add("trimmed_queue", lambda spark, sf: line_frames(spark, sf).select(EPISODE, "frame_index", F.size(R.trimmed_queue(F.col("action"), 1)).cast("long").alias("left"), R.trimmed_queue(F.col("action"), 1)[0].alias("head"), F.size(R.appended_queue(F.col("action"), 2, F.col("action"))).cast("long").alias("both")), f"WITH {LINE_FRAMES} SELECT episode_index, frame_index, 3::BIGINT AS left, action[2] AS head, 6::BIGINT AS both FROM g")
#: The fold, a step for each frame: what passes becomes the state that the next is compared with.
_ADMITTED = """a AS (SELECT episode_index, frame_index, event_id, value, value AS last, true AS ok FROM f WHERE frame_index = 0
    UNION ALL SELECT f.episode_index, f.frame_index, f.event_id, f.value, CASE WHEN abs(f.value - a.last) >= 15 THEN f.value ELSE a.last END, abs(f.value - a.last) >= 15 FROM a JOIN f ON f.episode_index = a.episode_index AND f.frame_index = a.frame_index + 1)"""
_add("observation_admission", lambda spark, sf: R.admit(event_frames(spark, sf).select(EPISODE, "frame_index", F.array("value").alias("state")), EPISODE, "frame_index", "state", 15.0).select(EPISODE, "frame_index", "admitted"), f"WITH RECURSIVE {EVENT_FRAMES}, {_ADMITTED} SELECT episode_index, frame_index, ok AS admitted FROM a")


def _transitions(spark, sf):
    f = event_frames(spark, sf).withColumnsRenamed({"value": "observation.state"}).withColumn("action", F.col("`observation.state`") / 10)
    f = f.withColumn("teleop_action", F.lit(0.0)).withColumn("is_intervention", F.col("task") == "click").withColumn("success", F.col("task") == "purchase").withColumn("terminate", F.col("task") == "error")
    steps = Pipeline([Intervention(), TimeLimit(30), ToTransition()])
    t = steps(f)
    return t.select(EPISODE, "frame_index", F.col("transition.observation")["observation.state"].alias("state"), "transition.action", "transition.done", "transition.truncated", "reward")


_add("transition_pipeline", _transitions, f"WITH {EVENT_FRAMES} SELECT episode_index, frame_index, value AS state, CASE WHEN task = 'click' THEN 0 ELSE value / 10 END::DOUBLE AS action, task = 'error' OR task = 'purchase' AS done, frame_index + 1 >= 30 AS truncated, (task = 'purchase')::INT::DOUBLE AS reward FROM f")


def _stream(spark, sf, columns):
    return T.frame_stream(spark, f"{sf}/events.parque[t]", table(spark, sf, "events").schema).select(*columns)


def _windowed_stream(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    out = T.windowed(_stream(spark, sf, ["ts", "event_type", "value"]), "ts", "1 day", ["event_type"], "value", "30 days")
    return T.run_to_table(out, "complete").select(F.unix_timestamp("start").alias("start"), "event_type", "n", "total", "low", "high")


_add("stream_windows", _windowed_stream, "SELECT epoch(date_trunc('day', ts))::BIGINT AS start, event_type, count(*) AS n, sum(value) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2")
_add("stream_online_stats", lambda spark, sf: T.run_to_table(T.online_stats(_stream(spark, sf, ["event_type", "value"]), "event_type", "value"), "update", ["event_type"]), "SELECT event_type, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max FROM events GROUP BY 1")
_add("stream_ring", lambda spark, sf: T.run_to_table(T.ring(_stream(spark, sf, ["user_id", "event_id", "value"]), "user_id", "event_id", "value", 5), "update", ["user_id"]).select("user_id", F.explode("sequences").alias("event_id")), "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")
_add("stream_admission", lambda spark, sf: T.run_to_table(T.admitted(_stream(spark, sf, ["user_id", "event_id", "value"]), "user_id", "event_id", "value", 15.0), "append"), f"WITH RECURSIVE f AS (SELECT user_id AS episode_index, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_index, value, event_id FROM events), {_ADMITTED} SELECT episode_index AS user_id, event_id, value FROM a WHERE ok")

# Spark's own surface


def _sql(name, spark_query, duck=None, tables=()):
    def query(spark, sf):
        for t in tables:
            table(spark, sf, t).createOrReplaceTempView(t)
        return spark.sql(spark_query)

    _add(name, query, duck or spark_query)


_sql("rank_windows", "SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER w AS q, percent_rank() OVER w AS p FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)", None, ["customer"])
_sql("cube_totals", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2 FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None, ["lineitem"])
_sql("set_operations", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1", None, ["customer", "supplier", "nation"])
_sql("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None, ["customer", "supplier"])
_sql("pricing_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice * (1 - l_discount)) AS revenue, avg(l_discount) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus", None, ["lineitem"])
_sql("top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50", None, ["orders"])
_sql("order_months", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2", "SELECT year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, count(*) AS n FROM orders GROUP BY 1, 2", ["orders"])
_add("event_props", lambda spark, sf: table(spark, sf, "events").select("event_id", F.length("props").cast("long").alias("n"), F.size(F.json_object_keys("props")).cast("long").alias("keys")), "SELECT event_id, length(props) AS n, len(json_keys(props)) AS keys FROM events")
_add("session_gaps", lambda spark, sf: table(spark, sf, "events").withColumn("t", F.expr("unix_micros(cast(ts as timestamp))")).withColumn("new", (F.coalesce(F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("t", "event_id")), F.lit(10**15)) > 3600 * 10**6).cast("long")).groupBy("user_id").agg(F.sum("new").alias("sessions")), "SELECT user_id, sum(fresh)::BIGINT AS sessions FROM (SELECT user_id, CASE WHEN coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 1000000000000000) > 3600000000 THEN 1 ELSE 0 END AS fresh FROM events) GROUP BY 1")
