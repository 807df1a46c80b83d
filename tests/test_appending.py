"""Appends: commits, open files, lost and competing writers."""

import pytest
from pyspark.sql import functions as F

from frameloom.sources import appending as A
from frameloom.sources import dataset as D

SCHEMA = "episode_index long, frame_index long, x double, task string"


def _frames(spark, first, last, task="t", frames=10):
    return spark.createDataFrame([(e, f, float(100 * e + f), f"{task}{e % 2}") for e in range(first, last) for f in range(frames)], SCHEMA)


@pytest.fixture(scope="module")
def info():
    return D.Info(10.0, {"x": D.Feature("float64")}, data_files_size_in_mb=1)


def _values(ds):
    return [(r["episode_index"], r["index"], r["x"]) for r in ds.frames().orderBy("index").collect()]


def test_append_goes_on_in_the_open_file(spark, tmp_path, info):
    first = A.append(A.create(spark, str(tmp_path / "d"), info), _frames(spark, 0, 5), 0.03, 0.21)
    #: 0.3 MB an episode under a cap of 1 MB: three to a file; 0.21 an episode row: four to a file.
    files = {(r["chunk"], r["file"]): (r["path"], r["episodes"]) for r in first.files().collect()}
    assert {k: n for k, (_, n) in files.items()} == {(0, 0): 3, (0, 1): 2}
    second = A.append(first, _frames(spark, 0, 4, "u"), 10.0 / 333, 0.21)
    later = {(r["chunk"], r["file"]): (r["path"], r["episodes"]) for r in second.files().collect()}
    assert later[0, 0] == files[0, 0] and sum(n for _, n in later.values()) == 9
    want = [(e, 10 * e + f, float(100 * (e if e < 5 else e - 5) + f)) for e in range(9) for f in range(10)]
    assert _values(second) == want and second.info.total_frames == 90 and second.info.total_episodes == 9
    assert [(r["task"], r["task_index"]) for r in second.tasks().orderBy("task_index").collect()] == [("t0", 0), ("t1", 1), ("u0", 2), ("u1", 3)]
    rows = second.episodes().orderBy("episode_index").collect()
    assert [r["dataset_from_index"] for r in rows] == [10 * e for e in range(9)] and sum(r["episodes"] for r in second.files("episodes").collect()) == 9
    x = [v for _, _, v in want]
    mean = sum(x) / len(x)
    assert second.stats()["x"]["mean"][0] == pytest.approx(mean) and second.stats()["x"]["std"][0] == pytest.approx((sum((v - mean) ** 2 for v in x) / len(x)) ** 0.5)
    #: The state before can still be read, and not after a vacuum.
    old = A.LoggedDataset.load(spark, second.root, first.version)
    assert _values(old) == want[:50]
    gone = A.vacuum(spark, second.root)
    assert gone and not {p for p, _ in later.values()} & set(gone) and _values(A.LoggedDataset.load(spark, second.root)) == want


def test_competing_and_lost_appends(spark, tmp_path, info):
    start = A.create(spark, str(tmp_path / "d"), info)
    one = A.append(start, _frames(spark, 0, 2))
    with pytest.raises(A.Conflict):
        A.append(start, _frames(spark, 0, 3))
    assert _values(A.LoggedDataset.load(spark, start.root)) == _values(one)
    #: A log file without its last line is no commit.
    D.write_text(spark, f"{start.root}/{A.LOG}/{2:012d}.json", '{"version": 2, "action": "add", "kind": "data", "path": "data/none.parquet"}')
    assert A.LoggedDataset.load(spark, start.root).version == 1 and _values(A.LoggedDataset.load(spark, start.root)) == _values(one)


def test_adopted_dataset(spark, tmp_path, info):
    whole = D.write(_frames(spark, 0, 4), str(tmp_path / "w"), info)
    ds = A.append(A.adopt(spark, whole.root), _frames(spark, 7, 9))
    assert ds.info.total_episodes == 6 and ds.frames().count() == 60 and ds.frames([5]).count() == 10
    assert ds.frames().select("task_index").distinct().count() == 2 and ds.episodes(True).where(F.col("`stats/x/count`")[0] == 10).count() == 6


def test_episode_rows_are_rewritten_by_file(spark, tmp_path, info):
    ds = A.append(A.create(spark, str(tmp_path / "d"), info), _frames(spark, 0, 9), 0.03, 0.21)
    before = {(r["chunk"], r["file"]): r["path"] for r in ds.files("episodes").collect()}
    after = A.rewrite_episodes(ds, lambda rows: rows.withColumn("note", F.concat(F.lit("e"), F.col("episode_index"))), F.col("episode_index") == 5)
    paths = {(r["chunk"], r["file"]): r["path"] for r in after.files("episodes").collect()}
    assert len(before) == 3 and [k for k in before if before[k] != paths[k]] == [(0, 1)]
    notes = {r["episode_index"]: r["note"] for r in after.episodes().collect()}
    assert notes == {e: f"e{e}" if 4 <= e < 8 else None for e in range(9)}
    more = A.add_quantiles(after, (0.25, 0.5))
    assert A.add_quantiles(more, (0.25,)).version == more.version == after.version + 1
    assert [r[0][0] for r in more.episodes(True).orderBy("episode_index").select("`stats/x/q25`").collect()] == [100.0 * e + 2.25 for e in range(9)]
    assert more.stats()["x"]["q25"][0] == pytest.approx(402.25) and {r["path"] for r in more.files().collect()} == {r["path"] for r in ds.files().collect()}
    #: The next append goes on from here; its episodes lack what only the others have.
    last = A.append(more, _frames(spark, 0, 1), 0.03, 0.21)
    assert last.episodes().count() == 10 and last.episodes().where("note is null").count() == 6


def test_many_files_are_read_by_their_folders(spark, tmp_path, info, monkeypatch):
    """Files that a commit removed, those of lost appends and those of later states are left out."""
    monkeypatch.setattr(A, "FEW_FILES", 0)
    first = A.append(A.create(spark, str(tmp_path / "d"), info), _frames(spark, 0, 5), 0.03, 0.21)

    def lose():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        A.append(first, _frames(spark, 0, 3), 0.03, 0.21, before_commit=lose)
    second = A.append(first, _frames(spark, 5, 8), 10.0 / 333, 0.21)
    want = [(e, 10 * e + f, float(100 * e + f)) for e in range(8) for f in range(10)]
    assert _values(second) == want and _values(A.LoggedDataset.load(spark, second.root, first.version)) == want[:50]
    assert sorted(r[0] for r in second.episodes().select("episode_index").collect()) == list(range(8))
    assert len(second.frames().inputFiles()) < len([*tmp_path.glob("d/data/*/*.parquet")])
