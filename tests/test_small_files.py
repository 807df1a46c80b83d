"""Datasets of many small files: how their writing is dealt, and that nothing opens them again for statistics."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameReader

from frameloom.operators import stats as S
from frameloom.operators.windows import EPISODE
from frameloom.sources import appending as A
from frameloom.sources import dataset as D

INFO = D.Info(10.0, {"x": D.Feature("float64"), "v": D.Feature("float32", (2,), ("a", "b"))}, data_files_size_in_mb=1)


def _frames(spark, episodes=6, frames=10):
    rows = [(e, f, float(100 * e + f) if f % 4 else None, [float(f), -float(e)], f"t{e % 2}") for e in range(episodes) for f in range(frames)]
    return spark.createDataFrame(rows, "episode_index long, frame_index long, x double, v array<float>, task string")


def test_tasks_follow_the_number_of_files(spark, monkeypatch):
    monkeypatch.setattr(D, "FILES_PER_TASK", 2)
    rows = spark.range(400).select((F.col("id") % 40 % 2).alias("chunk"), (F.col("id") % 40).alias("file"), "id")
    out = D.dealt(rows, 40, "chunk", "file", "id").withColumn("p", F.spark_partition_id())
    assert out.rdd.getNumPartitions() == 20
    assert out.groupBy("chunk", "file").agg(F.count_distinct("p").alias("p")).where("p > 1").isEmpty()


@pytest.mark.parametrize("appended", [False, True])
def test_data_files_are_not_opened_for_statistics(spark, tmp_path, monkeypatch, appended):
    opened, own = [], DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *paths, **kw: opened.extend(paths) or own(self, *paths, **kw))
    root = str(tmp_path / "d")
    ds = A.append(A.create(spark, root, INFO), _frames(spark), 0.03) if appended else D.write(_frames(spark), root, INFO, 0.03)
    assert not [p for p in opened if p.startswith(f"{root}/data/")]
    rows = ds.episodes(True).orderBy(EPISODE).collect()
    assert [(r["length"], r["dataset_from_index"], r["dataset_to_index"], r["tasks"]) for r in rows] == [(10, 10 * e, 10 * e + 10, [f"t{e % 2}"]) for e in range(6)]
    assert (ds.files() if appended else ds.file_paths()).count() == 2
    assert rows[2]["stats/x/count"] == [7] and rows[2]["stats/x/max"] == [209.0] and rows[2]["stats/v/min"] == [0.0, -2.0]


def test_scalars_by_episode_are_as_in_long_form(spark):
    rows = _frames(spark).union(_frames(spark, 1, 1).withColumn(EPISODE, F.lit(9).cast("long")))
    features = {"x": INFO.features["x"], "frame_index": D.Feature("int64"), "v": INFO.features["v"]}
    order = [EPISODE, "feature", "dim"]
    want = S.feature_stats(D.feature_cells(rows, features), "value", order).orderBy(*order)
    got = D.feature_statistics(rows, features).orderBy(*order)
    assert got.columns == want.columns and got.collect() == want.collect()
