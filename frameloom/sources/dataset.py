"""The episode dataset on disk: Parquet frames and episodes, JSON metadata; written and read as DataFrames.

Layout (fixed values): data/chunk-XXX/file-XXX.parquet, meta/episodes/chunk-XXX/file-XXX.parquet, meta/tasks.parquet,
meta/info.json, meta/stats.json; at most 1000 files a chunk. Metadata JSON is read and written through Spark's file
system layer, so any store that Spark reaches will do.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import edits, stats
from ..operators.windows import EPISODE, FRAME

VERSION = "v3.0"
FILES_PER_CHUNK = 1000
DATA_MB, VIDEO_MB = 100, 200
#: About 100 MB of episode rows with their statistics.
EPISODES_PER_FILE = 20_000
DATA_PATH = "data/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet"
VIDEO_PATH = "videos/{video_key}/chunk-{chunk_index:03d}/file-{file_index:03d}.mp4"

_SCALARS = {
    "float32": T.FloatType(), "float64": T.DoubleType(), "float16": T.FloatType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "bool": T.BooleanType(), "string": T.StringType(),
}
IMAGE = T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("path", T.StringType())])


@dataclass(frozen=True)
class Feature:
    dtype: str
    shape: tuple[int, ...] = (1,)
    names: tuple[str, ...] | None = None

    def spark_type(self) -> T.DataType | None:
        """The column's type; None for a video, which has no column."""
        if self.dtype == "video":
            return None
        if self.dtype == "image":
            return IMAGE
        if self.dtype not in _SCALARS:
            raise NotImplementedError(self.dtype)
        own = _SCALARS[self.dtype]
        if self.shape == (1,) or self.dtype == "string":
            return own
        if len(self.shape) > 5:
            raise ValueError("more than five dimensions")
        return reduce(lambda t, _: T.ArrayType(t), self.shape, own)

    def kind(self, name: str) -> str | None:
        """VISUAL, ENV, STATE or ACTION by name, as policies see it."""
        if self.dtype in ("image", "video"):
            return "VISUAL"
        if name == "observation.environment_state":
            return "ENV"
        if name.startswith("observation"):
            return "STATE"
        return "ACTION" if name.startswith("action") else None


def policy_features(features: dict[str, Feature]) -> dict[str, tuple[str, tuple[int, ...]]]:
    """Kind and shape of each feature as policies take them: cameras with channels first. Features of no kind are left out."""
    out = {}
    for name, f in features.items():
        kind = f.kind(name)
        if kind == "VISUAL":
            if len(f.shape) != 3:
                raise ValueError(f"{name} has {len(f.shape)} dimensions, not 3")
            last = f.names and f.names[2] in ("channel", "channels")
            out[name] = (kind, (f.shape[2], f.shape[0], f.shape[1]) if last else f.shape)
        elif kind:
            out[name] = (kind, f.shape)
    return out


DEFAULTS = {"timestamp": Feature("float32"), FRAME: Feature("int64"), EPISODE: Feature("int64"), "index": Feature("int64"), "task_index": Feature("int64")}


def schema_of(features: dict[str, Feature]) -> T.StructType:
    fields = []
    for name, f in features.items():
        if "/" in name:
            raise ValueError(f"no slash in feature names: {name}")
        if (t := f.spark_type()) is not None:
            fields.append(T.StructField(name, t, metadata={"ref_dtype": f.dtype, "shape": list(f.shape), "names": list(f.names or ())}))
    return T.StructType(fields)


def merged_features(*parts: dict[str, Feature]) -> dict[str, Feature]:
    """Vector names are joined and shapes follow; one dtype for a name."""
    out: dict[str, Feature] = {}
    for part in parts:
        for name, f in part.items():
            have = out.get(name)
            if have is None:
                out[name] = f
                continue
            if have.dtype != f.dtype:
                raise ValueError(f"{name}: {have.dtype} and {f.dtype}")
            if have.names and f.names:
                names = (*have.names, *[n for n in f.names if n not in have.names])
                out[name] = replace(have, names=names, shape=(len(names),))
    return out


@dataclass
class Info:
    fps: float
    features: dict[str, Feature]
    robot_type: str | None = None
    total_episodes: int = 0
    total_frames: int = 0
    total_tasks: int = 0
    chunks_size: int = FILES_PER_CHUNK
    data_files_size_in_mb: int = DATA_MB
    video_files_size_in_mb: int = VIDEO_MB
    splits: dict[str, str] = field(default_factory=dict)
    codebase_version: str = VERSION
    data_path: str = DATA_PATH
    video_path: str | None = VIDEO_PATH

    def to_json(self) -> str:
        out = {k: v for k, v in self.__dict__.items() if k != "features"}
        return json.dumps(out | {"features": {k: {"dtype": f.dtype, "shape": list(f.shape), "names": list(f.names) if f.names else None} for k, f in self.features.items()}}, indent=4)

    @staticmethod
    def from_json(text: str) -> Info:
        raw = json.loads(text)
        own = {f for f in Info.__dataclass_fields__}
        check_version(raw.get("codebase_version", VERSION))
        features = {k: Feature(v["dtype"], tuple(v["shape"]), tuple(v["names"]) if isinstance(v.get("names"), list) else None) for k, v in raw["features"].items()}
        return Info(**{k: v for k, v in raw.items() if k in own and k != "features"}, features=features)


def check_version(version: str, current: str = VERSION) -> bool:
    """An older major version is an error; an older minor one is False."""
    have, want = ([int(x) for x in v.lstrip("v").split(".")] for v in (version, current))
    if have[0] < want[0]:
        raise ValueError(f"dataset version {version} must be converted to {current}")
    return have >= want


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Paths and bytes of the part files two folders below, as partitioned writes by two columns leave them; several folders at a time."""
    p, fs = _path(spark, f"{path}/*")
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def below(folder: str) -> list[tuple[str, int]]:
        return [(x.getPath().toString(), x.getLen()) for x in fs.globStatus(new(f"{folder}/*/part-*")) or []]

    with ThreadPoolExecutor(16) as pool:
        return sorted(x for part in pool.map(below, [x.getPath().toString() for x in fs.globStatus(p) or []]) for x in part)


#: Tasks put their files in place themselves: the driver moves none, and nothing reads the folder before it is settled.
PLACED_BY_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


#: A task writes about so many files, one after the other: most of a small file's time is making it, whatever it holds.
FILES_PER_TASK = 64


def dealt(rows: DataFrame, files: int, chunk: str, file: str, order: str) -> DataFrame:
    """rows (with chunk and file) so that a file is one task's, in order; files: how many there are. The number of tasks follows theirs, not the
    rows' size, by which few tasks would make many small files."""
    return rows.repartition(-(-files // FILES_PER_TASK) or 1, chunk, file).sortWithinPartitions(chunk, file, order)


def moved(spark: SparkSession, pairs: Sequence[tuple[str, str]]) -> None:
    """Rename files, several at a time; folders are made once."""
    if not pairs:
        return
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    _, fs = _path(spark, pairs[0][1])
    for folder in sorted({to.rsplit("/", 1)[0] for _, to in pairs}):
        fs.mkdirs(new(folder))

    def move(pair: tuple[str, str]) -> None:
        if not fs.rename(new(pair[0]), new(pair[1])):
            raise OSError(f"{pair[0]} was not renamed to {pair[1]}")

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(move, pairs))


def kept(rows: DataFrame, path: str) -> DataFrame:
    """Rows that are read several times, written once."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def flatten(tree: dict, sep: str = "/", head: str = "") -> dict:
    out = {}
    for k, v in tree.items():
        name = f"{head}{sep}{k}" if head else str(k)
        out |= flatten(v, sep, name) if isinstance(v, dict) else {name: v}
    return out


def unflatten(flat: dict, sep: str = "/") -> dict:
    out: dict = {}
    for k, v in flat.items():
        *path, last = k.split(sep)
        at = out
        for p in path:
            at = at.setdefault(p, {})
        at[last] = v
    return out


@dataclass
class EpisodeDataset:
    spark: SparkSession
    root: str
    info: Info

    @property
    def camera_keys(self) -> list[str]:
        return [k for k, f in self.info.features.items() if f.dtype in ("image", "video")]

    @property
    def video_keys(self) -> list[str]:
        return [k for k, f in self.info.features.items() if f.dtype == "video"]

    @property
    def names(self) -> dict[str, tuple[str, ...] | None]:
        return {k: f.names for k, f in self.info.features.items()}

    @property
    def shapes(self) -> dict[str, tuple[int, ...]]:
        return {k: f.shape for k, f in self.info.features.items()}

    @staticmethod
    def load(spark: SparkSession, root: str) -> EpisodeDataset:
        return EpisodeDataset(spark, root, Info.from_json(read_text(spark, f"{root}/meta/info.json")))

    def frames(self, episodes: Sequence[int] | None = None) -> DataFrame:
        """All frames, or those of some episodes; the filter reaches the Parquet scan."""
        out = self.spark.read.schema(schema_of(self.info.features)).parquet(f"{self.root}/data/*")
        return out if episodes is None else out.where(F.col(EPISODE).isin(list(episodes)))

    def episodes(self, with_stats: bool = False) -> DataFrame:
        out = self.spark.read.parquet(f"{self.root}/meta/episodes/*")
        return out if with_stats else out.drop(*[c for c in out.columns if c.startswith("stats/")])

    def tasks(self) -> DataFrame:
        out = self.spark.read.parquet(f"{self.root}/meta/tasks.parquet")
        return out.withColumnRenamed("__index_level_0__", "task")

    def subtasks(self) -> DataFrame | None:
        path = f"{self.root}/meta/subtasks.parquet"
        return self.spark.read.parquet(path).withColumnRenamed("__index_level_0__", "subtask") if exists(self.spark, path) else None

    def stats(self) -> dict:
        path = f"{self.root}/meta/stats.json"
        return json.loads(read_text(self.spark, path)) if exists(self.spark, path) else {}

    def with_tasks(self, frames: DataFrame | None = None) -> DataFrame:
        return (frames if frames is not None else self.frames()).join(self.tasks(), "task_index")

    def file_paths(self, episodes: Sequence[int] | None = None) -> DataFrame:
        """The data files that hold the episodes, each once."""
        rows = self.episodes()
        rows = rows if episodes is None else rows.where(F.col(EPISODE).isin(list(episodes)))
        return rows.select(F.format_string("data/chunk-%03d/file-%03d.parquet", F.col("`data/chunk_index`"), F.col("`data/file_index`")).alias("path")).distinct()

    def video_paths(self, episodes: Sequence[int] | None = None) -> DataFrame:
        """The video files of the episodes, each once."""
        rows = self.episodes()
        rows = rows if episodes is None else rows.where(F.col(EPISODE).isin(list(episodes)))
        return rows.select(F.explode(F.array(*[F.format_string(f"videos/{k}/chunk-%03d/file-%03d.mp4", F.col(f"`videos/{k}/chunk_index`"), F.col(f"`videos/{k}/file_index`")) for k in self.video_keys])).alias("path")).distinct()

    def missing_episodes(self, episodes: Sequence[int]) -> DataFrame:
        return self.spark.createDataFrame([(int(e),) for e in episodes], f"{EPISODE} long").join(self.episodes(), EPISODE, "left_anti")


def recorded(rows: DataFrame, order: str | Sequence[str], fps: float) -> DataFrame:
    """Recorded rows (EPISODE, task, features) with frame numbers in the order of ``order`` and, where they bring none, timestamps."""
    w = Window.partitionBy(EPISODE).orderBy(*([order] if isinstance(order, str) else order))
    out = rows.withColumn(FRAME, F.row_number().over(w).cast("long") - 1)
    return out if "timestamp" in rows.columns else out.withColumn("timestamp", (F.col(FRAME) / F.lit(float(fps))).cast("float"))


def numbered(frames: DataFrame, fps: float) -> DataFrame:
    """index, timestamp and task_index for frames that have EPISODE, FRAME and task."""
    out = edits.renumbered(frames)
    if "timestamp" not in frames.columns:
        out = out.withColumn("timestamp", (F.col(FRAME) / F.lit(float(fps))).cast("float"))
    tasks = edits.first_seen_tasks([out])
    return out.join(tasks, "task")


def create(spark: SparkSession, root: str, info: Info) -> EpisodeDataset:
    """An empty dataset: info.json alone. Raises if there is one, or if a feature takes a default's name."""
    if exists(spark, f"{root}/meta/info.json"):
        raise FileExistsError(root)
    if taken := sorted(set(info.features) & set(DEFAULTS)):
        raise ValueError(f"default features: {taken}")
    schema_of(info.features)
    done = replace(info, features=info.features | DEFAULTS, splits={})
    write_text(spark, f"{root}/meta/info.json", done.to_json())
    return EpisodeDataset(spark, root, done)


def violations(frames: DataFrame, features: dict[str, Feature]) -> DataFrame:
    """One row: for each feature the number of values that are null or have another length than declared; missing or
    extra columns raise."""
    want = {k for k, f in features.items() if f.spark_type() is not None}
    if absent := sorted(want - set(frames.columns)):
        raise ValueError(f"missing features: {absent}")
    if extra := sorted(set(frames.columns) - want - {"task"}):
        raise ValueError(f"extra features: {extra}")
    schema = schema_of(features)
    if wrong := [f"{f.name}: {frames.schema[f.name].dataType.simpleString()} for {f.dataType.simpleString()}" for f in schema if frames.schema[f.name].dataType.simpleString() != f.dataType.simpleString()]:
        raise ValueError(f"types: {wrong}")
    bad = []
    for name in sorted(want):
        c, f = F.col(f"`{name}`"), features[name]
        wrong = c.isNull()
        if isinstance(schema[name].dataType, T.ArrayType):
            wrong = wrong | (F.size(c) != f.shape[0])
        bad.append(F.sum(wrong.cast("long")).alias(name))
    return frames.agg(*bad)


def _counted(features: dict[str, Feature]) -> list[str]:
    """Features that have statistics."""
    return [k for k, f in features.items() if f.dtype not in ("string", "image", "video", "bool") and len(f.shape) == 1]


def _cells_of(name: str, scalar: bool):
    """A feature's value as an array of (feature, dim, value)."""
    own = F.col(f"`{name}`")
    cell = lambda x, dim: F.struct(F.lit(name).alias("feature"), dim.cast("int").alias("dim"), x.cast("double").alias("value"))
    return F.array(cell(own, F.lit(0))) if scalar else F.transform(F.coalesce(own, F.array()), cell)


def feature_cells(frames: DataFrame, features: dict[str, Feature], by: Sequence[str] = (EPISODE,)) -> DataFrame:
    """Long values of all features that have statistics: by, feature, dim, value; one scan."""
    return frames.select(*by, F.inline(F.concat(*[_cells_of(name, features[name].shape == (1,)) for name in _counted(features)])))


def feature_statistics(frames: DataFrame, features: dict[str, Feature], by: Sequence[str] = (EPISODE,), quantiles: Sequence[float] = stats.QUANTILES) -> DataFrame:
    """Long statistics: by, feature, dim, and min .. q99; strings, images and videos are left out. All features are read in one scan; by
    episode, scalar ones in one of their own, in which a frame stays one row."""
    names = ["feature", "dim", "min", "max", "mean", "std", "count", *[stats.quantile_name(q) for q in quantiles]]
    counted = _counted(features)
    flat = [k for k in counted if features[k].shape == (1,)] if EPISODE in by else []
    parts = []
    if flat:
        x = [F.col(f"`{k}`").cast("double") for k in flat]
        wide = frames.groupBy(*by).agg(*[F.struct(*stats.aggregates(c, quantiles)).alias(f"_f{i}") for i, c in enumerate(x)])
        cells = [F.struct(F.lit(k).alias("feature"), F.lit(0).alias("dim"), F.col(f"_f{i}").alias("of")) for i, k in enumerate(flat)]
        long = wide.select(*by, F.inline(F.array(*cells))).select(*by, "feature", "dim", "of.*")
        parts.append(stats.split_quantiles(long, quantiles).select(*by, *names))
    if rest := {k: features[k] for k in counted if k not in flat}:
        parts.append(stats.feature_stats(feature_cells(frames, rest, by), "value", [*by, "feature", "dim"], quantiles).select(*by, *names))
    return reduce(DataFrame.unionByName, parts)


def _in_order(stat: str):
    """The values of all dimensions as one array."""
    return F.transform(F.array_sort(F.collect_list(F.struct("dim", stat))), lambda x: x[stat])


STATS = ("min", "max", "mean", "std", "count", "q01", "q10", "q50", "q90", "q99")


def episode_rows(rows: DataFrame) -> DataFrame:
    """length, dataset_from_index, dataset_to_index and the sorted task texts of each episode; one scan of rows with task."""
    parts = rows.groupBy(EPISODE, "task").agg(F.count(F.lit(1)).alias("n"), F.min("index").alias("first"), F.max("index").alias("last"))
    return parts.groupBy(EPISODE).agg(F.sum("n").alias("length"), F.min("first").alias("dataset_from_index"), (F.max("last") + 1).alias("dataset_to_index"), F.sort_array(F.collect_set("task")).alias("tasks"))


def wide_statistics(per_stats: DataFrame, features: dict[str, Feature], names: Sequence[str] = STATS) -> DataFrame:
    """feature_statistics by episode as one row an episode: stats/<feature>/<stat>, an array over the dimensions."""
    wide = per_stats.groupBy(EPISODE, "feature").agg(*[_in_order(s).alias(s) for s in names if s != "count"], *[F.array(F.max("count")).alias("count")] * ("count" in names))
    return wide.groupBy(EPISODE).agg(*[F.max(F.when(F.col("feature") == k, F.col(s))).alias(f"stats/{k}/{s}") for k in _counted(features) for s in names])


def statistics_tree(pooled: DataFrame) -> dict:
    """Pooled statistics (a row a dimension) as nested lists, as stats.json has them."""
    tree: dict = {}
    for r in pooled.orderBy("feature", "dim").collect():
        own = tree.setdefault(r["feature"], {})
        for s in STATS:
            if s == "count":
                own["count"] = [r["count"]]
            else:
                own.setdefault(s, []).append(r[s])
    return tree


def write(frames: DataFrame, root: str, info: Info, mb_per_frame: float = 0.001) -> EpisodeDataset:
    """Write recorded frames (episode_index, frame_index, task, features) as a dataset: files by size, episodes with
    their ranges and statistics, tasks, info and pooled statistics. Episodes and statistics are made from the staged rows, which are
    the written ones in few files: the data files, many and small under a small cap, aren't opened again."""
    spark = frames.sparkSession
    features = info.features | DEFAULTS
    schema = schema_of(features)
    made = f"{root}/_made"
    _drop(spark, made)
    rows = edits.renumbered(frames)
    if "timestamp" not in frames.columns:
        rows = rows.withColumn("timestamp", (F.col(FRAME) / F.lit(float(info.fps))).cast("float"))
    rows = kept(rows.select("task", *[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema if f.name != "task_index"]), f"{made}/rows")
    edits.first_seen_tasks([rows]).select("task", F.col("task_index").cast("long").alias("task_index")).coalesce(1).sortWithinPartitions("task_index").write.mode("overwrite").parquet(f"{root}/meta/tasks.parquet")
    tasks = spark.read.parquet(f"{root}/meta/tasks.parquet")
    per = rows.groupBy(EPISODE).agg(F.count(F.lit(1)).alias("length"))
    binned = kept(edits.file_bins(per.withColumn("_mb", F.col("length") * mb_per_frame), "_mb", info.data_files_size_in_mb, info.chunks_size).select(EPISODE, "chunk_index", "file_index"), f"{made}/bins").withColumnsRenamed({"chunk_index": "data/chunk_index", "file_index": "data/file_index"})
    names = F.format_string("chunk-%03d", F.col("`data/chunk_index`")), F.format_string("file-%03d", F.col("`data/file_index`"))
    whole = rows.join(tasks, "task").select("task", *schema.names)
    placed = whole.drop("task").join(binned.select(EPISODE, names[0].alias("_chunk"), names[1].alias("_file")), EPISODE)
    files = binned.select("data/chunk_index", "data/file_index").distinct().count()
    dealt(placed, files, "_chunk", "_file", "index").write.mode("overwrite").options(**PLACED_BY_TASKS).partitionBy("_chunk", "_file").parquet(f"{root}/_data")
    _settle(spark, f"{root}/_data", f"{root}/data")
    counted = {k: f for k, f in features.items() if k not in ("index", "task_index")}
    per_stats = kept(feature_statistics(whole, counted), f"{made}/stats")
    #: Episode rows go to files of EPISODES_PER_FILE episodes, by number.
    file = F.floor(F.col(EPISODE) / EPISODES_PER_FILE)
    episodes = episode_rows(whole).join(binned, EPISODE).join(wide_statistics(per_stats, counted), EPISODE).withColumn("meta/episodes/chunk_index", F.floor(file / info.chunks_size)).withColumn("meta/episodes/file_index", file % info.chunks_size)
    where = F.format_string("chunk-%03d", F.col("`meta/episodes/chunk_index`")), F.format_string("file-%03d", F.col("`meta/episodes/file_index`"))
    placed = episodes.withColumn("_chunk", where[0]).withColumn("_file", where[1])
    placed.repartition("_chunk", "_file").sortWithinPartitions("_chunk", "_file", EPISODE).write.mode("overwrite").options(**PLACED_BY_TASKS).partitionBy("_chunk", "_file").parquet(f"{root}/meta/_episodes")
    _settle(spark, f"{root}/meta/_episodes", f"{root}/meta/episodes")
    write_text(spark, f"{root}/meta/stats.json", json.dumps(statistics_tree(stats.pooled_stats(per_stats, ["feature", "dim"])), indent=4))
    written = spark.read.parquet(f"{root}/meta/episodes/*")
    totals = written.agg(F.count(F.lit(1)).alias("e"), F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()
    done = replace(info, features=features, total_episodes=totals["e"], total_frames=totals["n"], total_tasks=tasks.count(), splits={"train": f"0:{totals['e']}"})
    _drop(spark, made)
    write_text(spark, f"{root}/meta/info.json", done.to_json())
    return EpisodeDataset(spark, root, done)


def _drop(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def _settle(spark: SparkSession, made: str, to: str) -> None:
    """Spark's partition folders as <chunk>/<file>.parquet."""
    _drop(spark, to)
    pairs, before = [], None
    for path, _ in listed(spark, made):
        chunk, file = (x.split("=", 1)[1] for x in path.split("/")[-3:-1])
        i = i + 1 if (chunk, file) == before else 0  # parts of one file follow each other
        before = chunk, file
        pairs.append((path, f"{to}/{chunk}/{file}{f'-{i}' if i else ''}.parquet"))
    moved(spark, pairs)
    _drop(spark, made)


def read_legacy(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The older layout's JSON lines: episodes, tasks and, where there, episode statistics, sorted by id."""
    out = {}
    for name, key in (("episodes", EPISODE), ("tasks", "task_index"), ("episodes_stats", EPISODE)):
        path = f"{root}/meta/{name}.jsonl"
        if exists(spark, path):
            out[name] = spark.read.json(path).orderBy(key)
    return out


def convert_legacy(spark: SparkSession, root: str, to: str) -> EpisodeDataset:
    """One file an episode with JSON lines to size-bounded files. An episode's file is the one that its data goes to."""
    raw = json.loads(read_text(spark, f"{root}/meta/info.json"))
    info = Info.from_json(json.dumps(raw | {"codebase_version": VERSION}))
    tasks = read_legacy(spark, root)["tasks"].select("task", F.col("task_index").cast("long").alias("task_index"))
    frames = spark.read.parquet(f"{root}/data/*").join(tasks, "task_index").drop("task_index", "index", "timestamp")
    return write(frames, to, replace(info, features={k: f for k, f in info.features.items() if k not in DEFAULTS}))


def safe_shard(df: DataFrame, n: int, i: int, key: str = "index") -> DataFrame:
    """Rows of shard i of n; i is clamped to the last shard."""
    return df.where(F.pmod(F.col(key), F.lit(n)) == min(i, n - 1))
