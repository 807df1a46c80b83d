"""Appending to a dataset on disk: staged files, a log of commits, and last files that stay open.

A commit is one file of JSON lines below meta/log: which files it adds and removes, and as its last line the dataset's state
(info, pooled statistics, the tasks file). It is made by creating a file that must not exist, so of two writers one fails; a log
file without its last line is no commit, and what a lost append has written is no part of any state. Readers take the files that
the commits up to theirs leave: old states stay readable until ``vacuum``.

The last data file and the last episodes file are open while they are below the cap: the next append writes them anew,
under another name, with its first episodes behind the old ones (Parquet files can't grow). All other files are left alone. An
append reads the open files and its own frames, not the dataset; statistics are pooled from the old ones and the new episodes'.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import edits, stats
from ..operators.windows import EPISODE, FRAME
from . import dataset as D

LOG = "meta/log"
#: About what an episode row with its statistics takes; files of EPISODES_PER_FILE rows are 100 MB.
EPISODE_MB = 100 / D.EPISODES_PER_FILE
_ENTRY = "version long, action string, kind string, path string, chunk long, file long, episodes long, mb double, body string"


class Conflict(RuntimeError):
    """Another append has committed this version."""


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = D._path(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def entries(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The log's lines of all commits, or of those up to a version."""
    rows = spark.read.schema(_ENTRY).json(f"{root}/{LOG}/*.json")
    whole = rows.where("action = 'state'").select("version")
    out = rows.join(whole, "version", "left_semi")
    return out if version is None else out.where(F.col("version") <= version)


def active(log: DataFrame) -> DataFrame:
    """The files that the log's commits leave."""
    gone = log.where("action = 'remove'").select("kind", "path")
    return log.where("action = 'add'").join(gone, ["kind", "path"], "left_anti")


class LoggedDataset(D.EpisodeDataset):
    """A dataset as of one commit of its log."""

    version: int
    state: dict

    @staticmethod
    def load(spark: SparkSession, root: str, version: int | None = None) -> LoggedDataset:
        """The last commit's state, or an earlier one's."""
        last = entries(spark, root, version).where("action = 'state'").orderBy(F.desc("version")).limit(1).collect()
        if not last:
            raise FileNotFoundError(f"{root}/{LOG}")
        state = json.loads(last[0]["body"])
        out = LoggedDataset(spark, root, D.Info.from_json(json.dumps(state["info"])))
        out.version, out.state = last[0]["version"], state
        return out

    def files(self, kind: str = "data") -> DataFrame:
        return active(entries(self.spark, self.root, self.version)).where(F.col("kind") == kind)

    def _read(self, kind: str, schema=None, merge: bool = False) -> DataFrame:
        log = entries(self.spark, self.root, self.version).where(F.col("kind") == kind).select("action", "path").collect()  # as many as a scan lists
        gone = {r["path"] for r in log if r["action"] == "remove"}
        paths = [r["path"] for r in log if r["action"] == "add" and r["path"] not in gone]
        if not paths:
            return self.spark.createDataFrame([], schema or f"{EPISODE} long")
        return _parquet(self.spark, self.root, paths, gone, schema, merge)

    def frames(self, episodes=None) -> DataFrame:
        out = self._read("data", D.schema_of(self.info.features))
        return out if episodes is None else out.where(F.col(EPISODE).isin(list(episodes)))

    def episodes(self, with_stats: bool = False) -> DataFrame:
        out = self._read("episodes", merge=True)  # files written before a column was added lack it
        return out if with_stats else out.drop(*[c for c in out.columns if c.startswith("stats/")])

    def tasks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.state['tasks']}") if self.state["tasks"] else self.spark.createDataFrame([], "task string, task_index long")

    def stats(self) -> dict:
        return self.state["stats"]


#: So many files are read by their names; more by their folders, as a reader lists each name that it is given apart.
FEW_FILES = 100


def _tag(path: str) -> str:
    """What tells a file of one append from others: the end of its name; a file that was written whole has none."""
    return name.split("-")[2] if (name := path.rsplit("/", 1)[1].removesuffix(".parquet")).count("-") > 1 else ""


def _parquet(spark: SparkSession, root: str, paths: Sequence[str], gone: set[str], schema=None, merge: bool = False) -> DataFrame:
    """The files ``paths``. A commit names all files of its tag, so of many the folders are read for the tags' files without those that
    are ``gone``: a filter on the files' names, by which the scan leaves the others out."""
    reader = spark.read.option("mergeSchema", str(merge).lower())
    reader = reader.schema(schema) if schema else reader
    if len(paths) <= FEW_FILES:
        return reader.parquet(*[f"{root}/{p}" for p in paths])
    tags = {_tag(p) for p in paths}
    rows = reader.option("pathGlobFilter", "{" + ",".join(f"*-{t}.parquet" if t else "*.parquet" for t in sorted(tags)) + "}").parquet(*sorted({f"{root}/{p.rsplit('/', 1)[0]}" for p in paths}))
    names = rows.columns
    own = F.substring_index("_metadata.file_path", "/", -2)
    if "" in tags:
        rows = rows.where(F.regexp_extract(own, r"-\d+-([^/]+)\.parquet$", 1).isin(sorted(tags)))
    if left := sorted({"/".join(p.split("/")[-2:]) for p in gone if _tag(p) in tags}):
        rows = rows.where(~own.isin(left))
    return rows.select(*[f"`{c}`" for c in names])


def commit(spark: SparkSession, root: str, version: int, lines: list[dict], state: dict) -> None:
    """Write one commit, or raise Conflict if the version is taken."""
    body = "\n".join(json.dumps({"version": version} | x) for x in [*lines, {"action": "state", "body": json.dumps(state)}])
    p, fs = D._path(spark, f"{root}/{LOG}/{version:012d}.json")
    if fs.exists(p):
        raise Conflict(f"version {version} of {root}")
    try:
        out = fs.create(p, False)
    except Exception as e:  # the store says that it exists
        if fs.exists(p):
            raise Conflict(f"version {version} of {root}") from e
        raise
    try:
        out.write(bytearray(body.encode()))
    finally:
        out.close()


def create(spark: SparkSession, root: str, info: D.Info) -> LoggedDataset:
    """An empty dataset with a log."""
    made = D.create(spark, root, info)
    commit(spark, root, 0, [], {"info": json.loads(made.info.to_json()), "stats": {}, "tasks": None})
    return LoggedDataset.load(spark, root)


def adopt(spark: SparkSession, root: str) -> LoggedDataset:
    """Give a dataset that was written whole a log; its files stay as they are."""
    ds = D.EpisodeDataset.load(spark, root)
    lines = []
    for kind, folder in (("data", "data"), ("episodes", "meta/episodes")):
        held = {(r[0], r[1]): r[2] for r in ds.episodes().groupBy(f"`{folder}/chunk_index`", f"`{folder}/file_index`").agg(F.count(F.lit(1))).collect()}
        for chunk in _names(spark, f"{root}/{folder}"):
            for name in _names(spark, f"{root}/{folder}/{chunk}"):
                if name.endswith(".parquet"):
                    c, f = int(chunk.split("-")[1]), int(name.split(".")[0].split("-")[1])
                    lines.append({"action": "add", "kind": kind, "path": f"{folder}/{chunk}/{name}", "chunk": c, "file": f, "episodes": held[c, f], "mb": _mb(spark, f"{root}/{folder}/{chunk}/{name}")})
    commit(spark, root, 0, lines, {"info": json.loads(ds.info.to_json()), "stats": ds.stats(), "tasks": "meta/tasks.parquet"})
    return LoggedDataset.load(spark, root)


def _mb(spark: SparkSession, path: str) -> float:
    p, fs = D._path(spark, path)
    return fs.getFileStatus(p).getLen() / 1e6


def _last(files: DataFrame) -> dict | None:
    """The last file's parts: chunk, file, mb, and their paths."""
    rows = files.join(files.agg(F.max(F.struct("chunk", "file")).alias("_l")), F.struct("chunk", "file") == F.col("_l")).collect()
    return {"chunk": rows[0]["chunk"], "file": rows[0]["file"], "mb": sum(r["mb"] for r in rows), "episodes": max(r["episodes"] for r in rows), "paths": [r["path"] for r in rows]} if rows else None


def _binned(sizes: DataFrame, open_: dict | None, limit: float, per_chunk: int) -> DataFrame:
    """sizes: EPISODE, mb. Adds chunk and file: first what fits the open file, then new ones."""
    start = open_["chunk"] * per_chunk + open_["file"] if open_ else 0
    if open_:  # the open file's content is a row before all
        sizes = sizes.unionByName(sizes.sparkSession.createDataFrame([(-1, float(open_["mb"]))], f"{EPISODE} long, mb double"))
    out = edits.greedy_bins(sizes, EPISODE, [(F.col("mb"), edits.Cap(limit, True))], "bin").where(F.col(EPISODE) >= 0)
    at = F.col("bin") + start
    return out.select(EPISODE, "mb", F.floor(at / per_chunk).alias("chunk"), (at % per_chunk).alias("file"))


def _staged(rows: DataFrame, root: str, folder: str, tag: str, order: str, files: int) -> dict[tuple[int, int], tuple[str, float]]:
    """Write rows (with chunk and file) as so many files below ``folder``; no reader sees them before a commit names them. Their paths and MB."""
    spark = rows.sparkSession
    made = f"{root}/_staged/{tag}/{folder}"
    D.dealt(rows, files, "chunk", "file", order).write.options(**D.PLACED_BY_TASKS).partitionBy("chunk", "file").parquet(made)
    out, pairs = {}, []
    for path, size in D.listed(spark, made):
        c, f = (int(x.split("=")[1]) for x in path.split("/")[-3:-1])
        if (c, f) in out:
            raise RuntimeError(f"more than one part of {out[c, f][0]}")
        out[c, f] = f"{folder}/chunk-{c:03d}/file-{f:03d}-{tag}.parquet", size / 1e6
        pairs.append((path, f"{root}/{out[c, f][0]}"))
    D.moved(spark, pairs)
    return out


def _files(binned: DataFrame) -> int:
    return binned.select("chunk", "file").distinct().count()


def _actions(kind: str, made: dict, counts: dict, open_: dict | None) -> list[dict]:
    lines = [{"action": "add", "kind": kind, "path": path, "chunk": c, "file": f, "episodes": counts[c, f], "mb": mb} for (c, f), (path, mb) in sorted(made.items())]
    if open_ and (open_["chunk"], open_["file"]) in made:
        lines += [{"action": "remove", "kind": kind, "path": p} for p in open_["paths"]]
    return lines


def append(ds: LoggedDataset, frames: DataFrame, mb_per_frame: float = 0.001, episode_mb: float = EPISODE_MB, before_commit: Callable[[], None] | None = None) -> LoggedDataset:
    """Recorded frames (EPISODE, FRAME, task, features) behind the dataset's: episodes and indices go on, tasks that it has keep
    their numbers, new ones follow in the order in which they are first seen. Returns the new state; raises Conflict if
    another append came first. ``before_commit`` is called when all is staged."""
    spark, root, info = ds.spark, ds.root, ds.info
    tag = uuid.uuid4().hex[:8]
    version = ds.version + 1
    schema = D.schema_of(info.features)
    numbered = edits.renumbered(frames).withColumns({EPISODE: F.col(EPISODE) + info.total_episodes, "index": F.col("index") + info.total_frames})
    if "timestamp" not in frames.columns:
        numbered = numbered.withColumn("timestamp", (F.col(FRAME) / F.lit(float(info.fps))).cast("float"))
    numbered = D.kept(numbered.select("task", *[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema if f.name != "task_index"]), f"{root}/_staged/{tag}/rows")
    old_tasks = ds.tasks()
    fresh = numbered.groupBy("task").agg(F.min("index").alias("first")).join(old_tasks, "task", "left_anti")
    fresh = fresh.select("task", (F.row_number().over(Window.orderBy("first")) - 1 + info.total_tasks).cast("long").alias("task_index"))  # the append's own new tasks
    tasks_path = f"meta/tasks-{tag}.parquet"
    old_tasks.select("task", F.col("task_index").cast("long").alias("task_index")).unionByName(fresh).coalesce(1).sortWithinPartitions("task_index").write.parquet(f"{root}/{tasks_path}")
    tasks = spark.read.parquet(f"{root}/{tasks_path}")
    rows = numbered.join(tasks, "task").select("task", *[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])

    open_data = _last(ds.files("data"))
    per = numbered.groupBy(EPISODE).agg((F.count(F.lit(1)) * mb_per_frame).alias("mb"))
    binned = D.kept(_binned(per, open_data, info.data_files_size_in_mb, info.chunks_size), f"{root}/_staged/{tag}/bins")
    placed = rows.drop("task").join(binned.drop("mb"), EPISODE)
    #: The open file is read again only if an episode goes into it.
    goes_on = bool(open_data) and not binned.where((F.col("chunk") == open_data["chunk"]) & (F.col("file") == open_data["file"])).isEmpty()
    if goes_on:
        old = spark.read.schema(schema).parquet(*[f"{root}/{p}" for p in open_data["paths"]])
        placed = placed.unionByName(old.withColumns({"chunk": F.lit(open_data["chunk"]), "file": F.lit(open_data["file"])}))
    made = _staged(placed, root, "data", tag, "index", _files(binned))

    #: Episodes and statistics are made from the staged rows, which are the new ones of the data files: those aren't opened again.
    new = F.col(EPISODE) >= info.total_episodes
    counted = {k: f for k, f in info.features.items() if k not in ("index", "task_index")}
    per_stats = D.kept(D.feature_statistics(rows, counted), f"{root}/_staged/{tag}/stats")
    episodes = D.episode_rows(rows).join(D.wide_statistics(per_stats, counted), EPISODE)
    episodes = episodes.join(binned.select(EPISODE, F.col("chunk").alias("data/chunk_index"), F.col("file").alias("data/file_index")), EPISODE)

    open_meta = _last(ds.files("episodes"))
    meta = _binned(episodes.select(EPISODE, F.lit(float(episode_mb)).alias("mb")), open_meta and open_meta | {"mb": open_meta["episodes"] * episode_mb}, info.data_files_size_in_mb, info.chunks_size).drop("mb")
    meta = D.kept(meta, f"{root}/_staged/{tag}/meta_bins")
    where = {"meta/episodes/chunk_index": F.col("chunk"), "meta/episodes/file_index": F.col("file")}
    listed = episodes.join(meta, EPISODE).withColumns(where)
    if open_meta and not meta.where((F.col("chunk") == open_meta["chunk"]) & (F.col("file") == open_meta["file"])).isEmpty():
        old = spark.read.parquet(*[f"{root}/{p}" for p in open_meta["paths"]])
        listed = listed.unionByName(old.withColumns({"chunk": F.lit(open_meta["chunk"]), "file": F.lit(open_meta["file"])}), allowMissingColumns=True)
    made_meta = _staged(listed, root, "meta/episodes", tag, EPISODE, _files(meta))

    held = _parquet(spark, root, [p for p, _ in made_meta.values()], set()) if made_meta else None
    of_data = {(r[0], r[1]): r[2] for r in held.groupBy("`data/chunk_index`", "`data/file_index`").agg(F.count(F.lit(1))).collect()} if held is not None else {}
    of_meta = {(r[0], r[1]): r[2] for r in held.groupBy("`meta/episodes/chunk_index`", "`meta/episodes/file_index`").agg(F.count(F.lit(1))).collect()} if held is not None else {}
    if goes_on and (key := (open_data["chunk"], open_data["file"])) in made:
        of_data[key] = open_data["episodes"] + binned.where((F.col("chunk") == key[0]) & (F.col("file") == key[1])).count()
    lines = _actions("data", made, of_data, open_data) + _actions("episodes", made_meta, of_meta, open_meta)
    added = held.where(new).agg(F.count(F.lit(1)).alias("e"), F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first() if held is not None else {"e": 0, "n": 0}
    total = info.total_episodes + added["e"]
    done = replace(info, total_episodes=total, total_frames=info.total_frames + added["n"], total_tasks=tasks.count(), splits={"train": f"0:{total}"})
    pooled = D.statistics_tree(stats.pooled_stats(_tree_rows(spark, ds.stats()).unionByName(per_stats.drop(EPISODE)), ["feature", "dim"]))
    if before_commit:
        before_commit()
    commit(spark, root, version, lines, {"info": json.loads(done.to_json()), "stats": pooled, "tasks": tasks_path})
    return LoggedDataset.load(spark, root)


def rewrite_episodes(ds: LoggedDataset, change: Callable[[DataFrame], DataFrame], touched=None, state: dict | None = None) -> LoggedDataset:
    """Episode rows by ``change``, which keeps their numbers and may add columns. Copy on write by file: only files that hold a row for which
    ``touched`` (a condition) is true are written anew, under another name; frames and the other files are left alone."""
    spark, root, tag = ds.spark, ds.root, uuid.uuid4().hex[:8]
    files = {(r["chunk"], r["file"]): r for r in ds.files("episodes").collect()}
    place = [F.col("`meta/episodes/chunk_index`").alias("chunk"), F.col("`meta/episodes/file_index`").alias("file")]
    hit = {tuple(r) for r in ds.episodes().where(touched).select(*place).distinct().collect()} if touched is not None else set(files)
    if not hit:
        return ds
    rows = ds._read("episodes", merge=True) if len(hit) == len(files) else spark.read.option("mergeSchema", "true").parquet(*[f"{root}/{files[k]['path']}" for k in sorted(hit)])
    made = _staged(change(rows).withColumns({"chunk": place[0], "file": place[1]}), root, "meta/episodes", tag, EPISODE, len(hit))
    lines = _actions("episodes", made, {k: files[k]["episodes"] for k in hit}, None) + [{"action": "remove", "kind": "episodes", "path": files[k]["path"]} for k in sorted(hit)]
    commit(spark, root, ds.version + 1, lines, ds.state | (state or {}))
    return LoggedDataset.load(spark, root)


def add_quantiles(ds: LoggedDataset, quantiles: Sequence[float]) -> LoggedDataset:
    """Quantiles that the episodes' statistics lack, added to them and, pooled, to the dataset's: the frames are read once, only
    episode files are written."""
    counted = {k: f for k, f in ds.info.features.items() if k not in ("index", "task_index")}
    have = {c.rsplit("/", 1)[1] for c in ds.episodes(True).columns if c.startswith("stats/")}
    new = [q for q in quantiles if stats.quantile_name(q) not in have]
    if not new:
        return ds
    names = [stats.quantile_name(q) for q in new]
    per = D.kept(D.feature_statistics(ds.frames(), counted, quantiles=new), f"{ds.root}/_staged/{uuid.uuid4().hex[:8]}/stats")
    tree = {k: dict(v) for k, v in ds.stats().items()}
    for r in stats.pooled_stats(per, ["feature", "dim"], new).orderBy("feature", "dim").collect():  # a row a dimension
        for n in names:
            tree[r["feature"]].setdefault(n, []).append(r[n])
    flat = D.wide_statistics(per, counted, names)
    return rewrite_episodes(ds, lambda rows: rows.join(flat, EPISODE, "left"), None, {"stats": tree})


def _tree_rows(spark: SparkSession, tree: dict) -> DataFrame:
    """Nested pooled statistics as rows: feature, dim and the statistics (a row a dimension)."""
    names = [s for s in D.STATS if s != "count"]
    rows = [(k, i, own["count"][0], *[own[s][i] for s in names]) for k, own in tree.items() for i in range(len(own["mean"]))]
    out = spark.createDataFrame(rows, "feature string, dim int, count long, " + ", ".join(f"{s} double" for s in names))
    return out.select("feature", "dim", "min", "max", "mean", "std", "count", *[s for s in D.STATS if s.startswith("q")])


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Delete files that the last state doesn't name: older states can't be read afterwards, and a running append is lost."""
    ds = LoggedDataset.load(spark, root)
    kept = {r["path"] for r in active(entries(spark, root, ds.version)).select("path").collect()}
    gone = []
    for folder in ("data", "meta/episodes"):
        gone += [p for chunk in _names(spark, f"{root}/{folder}") for name in _names(spark, f"{root}/{folder}/{chunk}") if name.endswith(".parquet") and (p := f"{folder}/{chunk}/{name}") not in kept]
    gone += [f"meta/{x}" for x in _names(spark, f"{root}/meta") if x.startswith("tasks") and f"meta/{x}" != ds.state["tasks"]]
    gone += ["_staged"] if _names(spark, f"{root}/_staged") else []
    for path in gone:
        p, fs = D._path(spark, f"{root}/{path}")
        fs.delete(p, True)
    return gone
