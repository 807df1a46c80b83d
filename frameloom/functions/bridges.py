"""Between names and vectors, nested and flat observations, and the forms that policies, robots and viewers take."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import features as X


def kept(name: str, patterns: Sequence[str] | None) -> bool:
    """Whether a name is wanted: no patterns want all, else one must be found in it."""
    return patterns is None or any(re.search(p, name) for p in patterns)


def stripped(name: str, prefixes: Sequence[str]) -> str:
    """The name without the first prefix that it has."""
    return next((name[len(p) :] for p in prefixes if name.startswith(p)), name)


#: Heads of feature names, in full and short.
PREFIXES = ("action.", "action.", "observation.state.", "state.", "observation.images.", "images.")


def is_image(name: str, shape) -> bool:
    return isinstance(shape, tuple) and len(shape) == 3 or name.startswith(("observation.images.", "images.")) or ".images." in name


def dataset_schema(actions: dict, observations: dict, patterns: Sequence[str] | None = None, images: bool = True) -> dict[str, dict]:
    """Features of a dataset from what steps give: scalars (a type) are gathered in ``action`` and ``observation.state``, shapes of
    three are cameras. Patterns choose scalars, not cameras."""
    out: dict[str, dict] = {}
    for to, group in (("action", actions), ("observation.state", observations)):
        flat = {stripped(k, PREFIXES): (v, to != "action" and is_image(k, v)) for k, v in group.items() if (to != "action" and is_image(k, v)) or kept(k, patterns)}
        names = tuple(k for k, (v, image) in flat.items() if not image)
        if names:
            out[to] = {"dtype": "float32", "shape": (len(names),), "names": names}
        if images:
            out |= {f"observation.images.{k}": {"dtype": "video", "shape": v, "names": ("height", "width", "channels")} for k, (v, image) in flat.items() if image}
    return out


def gathered(names: Sequence[str], kind: str = "float") -> Column:
    """Named scalars as one vector."""
    return F.array(*[F.col(f"`{n}`").cast(kind) for n in names])


def spread(vector: str, names: Sequence[str], prefix: str = "") -> list[Column]:
    """A vector as named scalars."""
    return [F.col(vector)[i].alias(f"{prefix}{n}") for i, n in enumerate(names)]


def leaves(schema: T.StructType, head: str = "") -> list[str]:
    """Paths of a nested schema's leaves, in order."""
    out = []
    for f in schema.fields:
        out += leaves(f.dataType, f"{head}{f.name}.") if isinstance(f.dataType, T.StructType) else [f"{head}{f.name}"]
    return out


def flat_state(df: DataFrame, column: str, keys: Sequence[str] | None = None) -> Column:
    """The leaves below a struct column (or those of ``keys``, in their order, where they are) as one float vector; lists of
    lists are flattened, scalars are lists of one."""
    struct = df.schema[column].dataType
    paths = [p for k in keys for p in leaves(struct) if p == k or p.startswith(f"{k}.")] if keys is not None else leaves(struct)

    def vector(path: str) -> Column:
        kind = struct
        for step in path.split("."):
            kind = kind[step].dataType
        c = F.col(f"`{column}`")
        for step in path.split("."):
            c = c[step]
        while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
            c, kind = F.flatten(c), kind.elementType
        return (c if isinstance(kind, T.ArrayType) else F.array(c)).cast("array<float>")

    return F.concat(*[vector(p) for p in paths])


def robot_state(position: Column, quaternion: Column, gripper: Column) -> Column:
    """End-effector position, its orientation as axis and angle, and the gripper's joints, as one vector."""
    return F.concat(position, X.quaternion_to_axis_angle(quaternion), gripper).cast("array<float>")


def policy_observation(df: DataFrame) -> DataFrame:
    """An environment's observation columns under the names that policies know; nested structs stay as they are."""
    names = {"agent_pos": "observation.state", "environment_state": "observation.environment_state", "robot_state": "observation.robot_state", "policy": "observation.policy", "camera_obs": "observation.camera_obs"}
    out = df
    if "pixels" in df.columns:
        if isinstance(df.schema["pixels"].dataType, T.StructType) and "bytes" not in df.schema["pixels"].dataType.names:
            cameras = df.schema["pixels"].dataType.names
            out = out.withColumns({f"observation.images.{c}": F.col("pixels")[c] for c in cameras}).drop("pixels")
        else:
            out = out.withColumnRenamed("pixels", "observation.image")
    floats = [c for c in ("agent_pos", "environment_state") if c in df.columns]
    return out.withColumns({c: F.col(c).cast("array<float>") for c in floats}).withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def inference_frame(df: DataFrame, names: dict[str, Sequence[str]], task: str | None = None, robot: str | None = None) -> DataFrame:
    """Vectors of the named scalars of a raw observation, with task and robot_type (empty if there is none); the rest goes."""
    return df.select(*[gathered(own).alias(to) for to, own in names.items()], F.lit(task or "").alias("task"), F.lit(robot or "").alias("robot_type"))


def phone_action(enabled: Column, position: Column, rotation: Column, ios: bool, inputs: Column) -> dict[str, Column]:
    """A phone's pose as a robot's target: axes are swapped and turned, nothing moves while it isn't enabled; the gripper
    follows its button all the same. rotation: a rotation vector; inputs: a map."""
    axis = lambda v, i, sign: F.when(enabled, sign * v[i]).otherwise(F.lit(0.0))
    button = lambda k: F.coalesce(F.try_element_at(inputs, F.lit(k)).cast("double"), F.lit(0.0))
    out = {"enabled": enabled}
    out |= {f"target_{a}": axis(v, i, s) for a, v, i, s in (("x", position, 1, -1), ("y", position, 0, 1), ("z", position, 2, 1), ("wx", rotation, 1, 1), ("wy", rotation, 0, 1), ("wz", rotation, 2, -1))}
    return out | {"gripper_vel": button("a3") if ios else button("reservedButtonA") - button("reservedButtonB")}


def with_domain(df: DataFrame, domain: int, column: str = "domain_id") -> DataFrame:
    """A constant domain number for each row."""
    return df.withColumn(column, F.lit(domain).cast("long"))


def state_prompt(task: Column, bins: Column) -> Column:
    """The task and the state's bins, without a word of an action."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(task), "_", " "), "\n", " ")
    return F.concat(F.lit("Task: "), clean, F.lit(", State: "), F.array_join(bins.cast("array<string>"), " "), F.lit(";\n"))


def series(df: DataFrame, vectors: dict[str, str], scalars: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """A row for each dimension of each vector (column: name) and for each scalar: keys, entity, value; null values give none."""
    dims = lambda c, n: F.transform(F.col(f"`{c}`"), lambda x, i: F.struct(F.concat(F.lit(f"{n}/"), i.cast("string")).alias("entity"), x.cast("double").alias("value")))
    cells = [dims(c, n) for c, n in vectors.items()]
    cells += [F.array(F.struct(F.lit(c).alias("entity"), F.col(f"`{c}`").cast("double").alias("value"))) for c in scalars]
    empty = F.array().cast("array<struct<entity:string,value:double>>")
    return df.select(*keys, F.inline(F.concat(*[F.coalesce(c, empty) for c in cells]))).where("value is not null")


def offsets_in_seconds(features: Sequence[str], fps: float, reward: Sequence[int] | None = None, action: Sequence[int] | None = None, observation: Sequence[int] | None = None) -> dict[str, list[float]] | None:
    """A policy's frame offsets as seconds by feature: rewards, actions and all observations have their own; None if there are none."""
    of = lambda f: reward if f == "next.reward" else action if f == "action" else observation if f.startswith("observation.") else None
    return {f: [i / fps for i in of(f)] for f in features if of(f) is not None} or None


def clamped_times(time: Column, offsets: Sequence[int], fps: float, start: Column, end: Column) -> tuple[Column, Column]:
    """Query times at offsets from a time, clamped to an episode's stretch of its video, and whether each lay outside."""
    raw = F.array(*[time + F.lit(k / fps) for k in offsets])
    return F.transform(raw, lambda t: F.greatest(start, F.least(end, t))), F.transform(raw, lambda t: (t < start) | (t > end))


#: Heads of the names under which older checkpoints hold statistics; the first that fits counts.
STAT_HEADS = (
    "normalize_inputs.buffer_", "unnormalize_outputs.buffer_", "normalize_targets.buffer_", "normalize.", "unnormalize.", "input_normalizer.",
    "output_normalizer.", "normalalize_inputs.", "unnormalize_outputs.", "normalize_targets.", "unnormalize_targets.",
)


def checkpoint_stats(state: dict[str, list]) -> dict[str, dict]:
    """Statistics by feature out of a checkpoint's flat names (<head><feature with _ for .>.<statistic>)."""
    out: dict[str, dict] = {}
    for key, value in state.items():
        head = next((h for h in STAT_HEADS if key.startswith(h)), None)
        feature, dot, stat = key[len(head) :].rpartition(".") if head else ("", "", "")
        if dot:
            out.setdefault(feature.replace("_", "."), {})[stat] = value
    return out


def kinds_and_modes(stats: dict[str, dict], shapes: dict[str, tuple] | None = None, modes: dict[str, str] | None = None) -> tuple[dict[str, str], dict[str, str]]:
    """VISUAL, STATE or ACTION for each feature by words in its name, and a mode for each kind: from the statistics that
    are there, else MEAN_STD, or MIN_MAX for STATE. With ``shapes`` the features are its, by fewer words."""
    visual, state = (("image", "visual"), ("state",)) if shapes else (("image", "visual", "pixels"), ("state", "joint", "position"))

    def kind(name: str) -> str:
        if any(w in name for w in visual):
            return "VISUAL"
        return "ACTION" if "action" in name and not any(w in name for w in state) else "STATE"

    kinds = {name: kind(name) for name in shapes or stats}
    found = dict(modes or {})
    for name, own in () if found else stats.items():
        mode = "MEAN_STD" if {"mean", "std"} <= own.keys() else "MIN_MAX" if {"min", "max"} <= own.keys() else None
        if mode and name in kinds:
            found.setdefault(kinds[name], mode)
    return kinds, {"VISUAL": "MEAN_STD", "STATE": "MIN_MAX", "ACTION": "MEAN_STD"} | found


def check_features(given: Sequence[str], wanted: Sequence[str]) -> None:
    """Raise unless the names are the same, and say which are missing and which too many."""
    missing, extra = sorted(set(wanted) - set(given)), sorted(set(given) - set(wanted))
    if missing or extra:
        raise ValueError(f"features differ: missing {missing}, extra {extra}")


def check_cameras(given: Sequence[str], wanted: Sequence[str]) -> None:
    """Raise unless the cameras of one side are among those of the other."""
    if not (set(given) <= set(wanted) or set(wanted) <= set(given)):
        check_features(given, wanted)


def shaped_stats(flat: dict[str, list], image: bool) -> dict[str, list]:
    """Statistics as a dataset's file holds them: an image's channels as (3, 1, 1), a scalar's as one value, counts as they are."""
    return {k: v if k == "count" else [[[x]] for x in v] if image else list(v) if isinstance(v, (list, tuple)) else [v] for k, v in flat.items()}
