"""Dataset edits and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import edits as E
from ...operators import sampling as P
from ...operators.windows import EPISODE
from ...sources.adapters import EVENT_FRAMES, event_frames, table

QUERIES, ORACLES = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


_GONE = [3, 7, 11, 42]
_add(
    "delete_reindex",
    lambda spark, sf: E.delete_episodes(event_frames(spark, sf).select(EPISODE, "frame_index", "value"), _GONE),
    f"WITH {EVENT_FRAMES} SELECT dense_rank() OVER (ORDER BY episode_index) - 1 AS episode_index, frame_index, value, row_number() OVER (ORDER BY episode_index, frame_index) - 1 AS index FROM f WHERE episode_index NOT IN (3, 7, 11, 42)",
)
_FRACTIONS = {"train": 0.6, "val": 0.25, "test": 0.1}
_add(
    "split_fractions",
    lambda spark, sf: E.labelled_split(event_frames(spark, sf).select(EPISODE, "frame_index", "value"), _FRACTIONS),
    f"""WITH {EVENT_FRAMES}, r AS (SELECT *, dense_rank() OVER (ORDER BY episode_index) - 1 AS k FROM f), t AS (SELECT count(DISTINCT episode_index) AS t FROM f),
    s AS (SELECT r.*, CASE WHEN k < floor(t * 0.6) THEN 'train' WHEN k < floor(t * 0.6) + floor(t * 0.25) THEN 'val' ELSE 'test' END AS split FROM r, t)
    SELECT dense_rank() OVER (PARTITION BY split ORDER BY k) - 1 AS episode_index, frame_index, value, row_number() OVER (PARTITION BY split ORDER BY k, frame_index) - 1 AS index, split FROM s""",
)


def _parts(spark, sf):
    f = event_frames(spark, sf).select(EPISODE, "frame_index", "value", "task")
    return [E.renumbered(f.where(F.col(EPISODE) % 2 == 0)), E.renumbered(f.where(F.col(EPISODE) % 2 == 1)).withColumn("extra", F.lit(1))]


_MERGED = f"""{EVENT_FRAMES}, p AS (SELECT *, (episode_index % 2)::INT AS dataset_index FROM f),
    i AS (SELECT dense_rank() OVER (ORDER BY dataset_index, episode_index) - 1 AS episode_index, frame_index, value, task, row_number() OVER (ORDER BY dataset_index, episode_index, frame_index) - 1 AS index, dataset_index FROM p),
    k AS (SELECT task, row_number() OVER (ORDER BY min(index)) - 1 AS task_index FROM i GROUP BY 1)"""
_add("merge_offsets", lambda spark, sf: E.merge(_parts(spark, sf)), f"WITH {_MERGED} SELECT i.*, task_index FROM i JOIN k USING (task)")
_add(
    "retask",
    lambda spark, sf: E.retask(
        event_frames(spark, sf).groupBy(EPISODE).agg(F.min_by("task", "frame_index").alias("task"), F.count(F.lit(1)).alias("length")), table(spark, sf, "events").select(F.col("user_id").alias(EPISODE)).distinct().where(F.col(EPISODE) % 5 == 0).withColumn("task", F.concat(F.lit("special "), F.col(EPISODE) % 2))
    ),
    f"WITH {EVENT_FRAMES}, e AS (SELECT episode_index, CASE WHEN episode_index % 5 = 0 THEN 'special ' || (episode_index % 2) ELSE arg_min(task, frame_index) END AS task, count(*) AS length FROM f GROUP BY 1) SELECT *, dense_rank() OVER (ORDER BY task) - 1 AS task_index FROM e",
)
_add(
    "add_remove_features",
    lambda spark, sf: E.modify_features(event_frames(spark, sf).select(EPISODE, "frame_index", "value", "task"), {"scaled": F.col("value") * 2 + 1, "is_first": F.col("frame_index") == 0}, ["task"]),
    f"WITH {EVENT_FRAMES} SELECT episode_index, frame_index, value, value * 2 + 1 AS scaled, frame_index = 0 AS is_first FROM f",
)
_add("episode_filter", lambda spark, sf: table(spark, sf, "events").where(F.col("user_id").isin(1, 5, 9, 77)).select("event_id", "user_id", "value"), "SELECT event_id, user_id, value FROM events WHERE user_id IN (1, 5, 9, 77)")
_add(
    "relative_index",
    lambda spark, sf: E.renumbered(event_frames(spark, sf).where(F.col(EPISODE).isin(1, 5, 9, 77)).select(EPISODE, "frame_index", "event_id")).select("index", "event_id"),
    f"WITH {EVENT_FRAMES} SELECT row_number() OVER (ORDER BY episode_index, frame_index) - 1 AS index, event_id FROM f WHERE episode_index IN (1, 5, 9, 77)",
)


def _episodes(spark, sf):
    return event_frames(spark, sf).groupBy(EPISODE).agg(F.count(F.lit(1)).alias("length"))


_BINS = """WITH RECURSIVE e AS (SELECT user_id AS episode_index, count(*) AS length, row_number() OVER (ORDER BY user_id) AS r FROM events GROUP BY 1),
    w AS (SELECT r, episode_index, length, length::BIGINT AS held, 0::BIGINT AS b FROM e WHERE r = 1
    UNION ALL SELECT e.r, e.episode_index, e.length, CASE WHEN w.held + e.length >= 400 THEN e.length ELSE w.held + e.length END, CASE WHEN w.held + e.length >= 400 THEN w.b + 1 ELSE w.b END FROM w JOIN e ON e.r = w.r + 1)"""
_add("file_rollover", lambda spark, sf: E.file_bins(_episodes(spark, sf), "length", 400, 10), f"{_BINS} SELECT episode_index, length, b // 10 AS chunk_index, b % 10 AS file_index FROM w")
_add("episode_batches", lambda spark, sf: E.episode_batches(_episodes(spark, sf), 1.0, 400.0), f"{_BINS} SELECT episode_index, length, b AS batch FROM w")

_add(
    "sampler_drop_first_last",
    lambda spark, sf: P.kept_frames(event_frames(spark, sf), 3, 5).select(EPISODE, "frame_index"),
    f"WITH {EVENT_FRAMES} SELECT episode_index, frame_index FROM (SELECT *, count(*) OVER (PARTITION BY episode_index) AS n FROM f) WHERE frame_index >= 3 AND frame_index < n - 5",
)


def _weights(ratio):
    def query(spark, sf):
        f = event_frames(spark, sf).select(EPISODE, "frame_index")
        return P.sampler_weights(f if ratio is None else f.where(F.col(EPISODE) < 50), f.where(F.col(EPISODE) >= 50) if ratio is not None else None, ratio, 2, 1)

    return query


_add(
    "sampler_weights",
    _weights(0.8),
    f"WITH {EVENT_FRAMES}, s AS (SELECT *, CASE WHEN episode_index < 50 THEN 0 ELSE 1 END AS source, count(*) OVER (PARTITION BY episode_index) AS n FROM f), k AS (SELECT *, frame_index < n - CASE source WHEN 0 THEN 2 ELSE 1 END AS inside FROM s), c AS (SELECT source, count(*) FILTER (inside) AS k FROM k GROUP BY 1) SELECT source, episode_index, frame_index, CASE WHEN inside THEN CASE source WHEN 0 THEN 1 - 0.8::DOUBLE ELSE 0.8::DOUBLE END / k ELSE 0 END / (SELECT sum(CASE source WHEN 0 THEN 1 - 0.8::DOUBLE ELSE 0.8::DOUBLE END) FROM c WHERE k > 0) AS weight FROM k JOIN c USING (source)",
)
_add("sampler_weights_offline_only", _weights(None), f"WITH {EVENT_FRAMES} SELECT 0 AS source, episode_index, frame_index, 1.0::DOUBLE / count(*) OVER () AS weight FROM f")
_add(
    "sample_positions",
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", F.posexplode(P.sample_positions(F.col("n_chars"))).alias("k", "place")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("place").alias("total"), F.max("place").alias("last")),
    "WITH d AS (SELECT doc_id, n_chars AS n, greatest(least(100, n_chars), least(floor(n_chars ** 0.75)::BIGINT, 10000)) AS k FROM documents), p AS (SELECT doc_id, k, round_even(i * coalesce((n - 1)::DOUBLE / nullif(k - 1, 0), 0), 0)::BIGINT AS place FROM (SELECT *, unnest(range(k)) AS i FROM d)) SELECT doc_id, count(*) AS k, sum(place)::BIGINT AS total, max(place) AS last FROM p GROUP BY 1",
)
_add("hashed_shuffle", lambda spark, sf: P.shuffled(table(spark, sf, "events").select("event_id"), "event_id", 17), "SELECT event_id, ((event_id + 17) * 2654435761) % 1000003 AS shuffle_key FROM events")
def _replayed(spark, sf):
    rows = E.renumbered(event_frames(spark, sf).select(EPISODE, "frame_index", "value"))
    return P.draw_with_replacement(rows, "index", rows.count(), 500, 9).select("draw", "index", "value")


_add(
    "replay_sample",
    _replayed,
    f"WITH {EVENT_FRAMES}, i AS (SELECT row_number() OVER (ORDER BY episode_index, frame_index) - 1 AS index, value FROM f), n AS (SELECT count(*) AS n FROM f) SELECT d AS draw, index, value FROM (SELECT d, ((d + 9) * 2654435761 + d // 7) % n AS place FROM range(500) r(d), n) JOIN i ON index = place",
)
_add(
    "episode_fraction",
    lambda spark, sf: P.episode_fraction(event_frames(spark, sf), 0.2, 5).select(EPISODE, "frame_index"),
    f"WITH {EVENT_FRAMES} SELECT episode_index, frame_index FROM (SELECT *, row_number() OVER (PARTITION BY episode_index ORDER BY ((frame_index * 7919 + episode_index + 5) * 2654435761) % 1000003, frame_index) AS r, count(*) OVER (PARTITION BY episode_index) AS n FROM f) WHERE r <= greatest(1, floor(n * 0.2::DOUBLE))",
)
_add(
    "weighted_subset",
    lambda spark, sf: P.weighted_subset(event_frames(spark, sf), "value", "event_id", 3, 1, [EPISODE]).select(EPISODE, "event_id"),
    f"WITH {EVENT_FRAMES} SELECT episode_index, event_id FROM (SELECT *, row_number() OVER (PARTITION BY episode_index ORDER BY -ln((((event_id + 1) * 2654435761) % 1000003 + 1) / 1000004.0::DOUBLE) / value, event_id) AS r FROM f WHERE value > 0) WHERE r <= 3",
)
_add("batch_weights", lambda spark, sf: event_frames(spark, sf).select(EPISODE, "frame_index", P.batch_weights("value", [EPISODE]).alias("weight")), f"WITH {EVENT_FRAMES} SELECT episode_index, frame_index, value * count(*) OVER w / (sum(value) OVER w + 1e-6) AS weight FROM f WINDOW w AS (PARTITION BY episode_index)")
_add("replay_episode", lambda spark, sf: event_frames(spark, sf).where(F.col(EPISODE) == 5).orderBy("frame_index").select("frame_index", "value"), f"WITH {EVENT_FRAMES} SELECT frame_index, value FROM f WHERE episode_index = 5")
