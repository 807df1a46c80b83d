"""Steps: named, configurable DataFrame transforms with a static schema, composed and saved as JSON."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, is_dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import features as X
from ..operators import windows as W


class Registry:
    """Step classes by name."""

    def __init__(self):
        self._steps: dict[str, type] = {}

    def register(self, name: str | None = None) -> Callable[[type], type]:
        def add(cls: type) -> type:
            own = name or cls.__name__
            if own in self._steps:
                raise ValueError(f"step {own} is registered")
            cls.registry_name = own
            self._steps[own] = cls
            return cls

        return add

    def get(self, name: str) -> type:
        if name not in self._steps:
            raise KeyError(f"no step {name}; there are {self.names()}")
        return self._steps[name]

    def unregister(self, name: str) -> None:
        self._steps.pop(name, None)

    def names(self) -> list[str]:
        return sorted(self._steps)


STEPS = Registry()


@dataclass
class Step:
    """A transform of a DataFrame; its output schema is static, like all of Spark's.

    ``config`` is what a saved pipeline holds, ``state`` what was learnt (numbers, saved apart), ``reset`` forgets what a step
    remembers between episodes."""

    def __call__(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def config(self) -> dict:
        return asdict(self) if is_dataclass(self) else {}

    def state(self) -> dict:
        return {}

    def load_state(self, state: dict) -> None:
        if state:
            raise ValueError(f"{type(self).__name__} has no state")

    def reset(self) -> None:
        pass

    def schema(self, given: T.StructType) -> T.StructType:
        """The schema that the step makes of a given one, from an empty DataFrame: nothing runs."""
        spark = SparkSession.active()
        return self(spark.createDataFrame([], given)).schema


class ColumnStep(Step):
    """A step on some columns; a subclass says which (``concerns``) and what becomes of each (``cell``). The rest stays."""

    def concerns(self, name: str) -> bool:
        raise NotImplementedError

    def cell(self, c: Column, name: str) -> Column:
        raise NotImplementedError

    def __call__(self, df):
        found = [c for c in df.columns if self.concerns(c)]
        if not found and self.needed:
            raise ValueError(f"{type(self).__name__}: no column for it in {df.columns}")
        return df.withColumns({c: self.cell(F.col(f"`{c}`"), c) for c in found})

    needed = True


class ObservationStep(ColumnStep):
    def concerns(self, name):
        return name.startswith("observation")


class ActionStep(ColumnStep):
    def concerns(self, name):
        return name == "action"


class PolicyActionStep(ActionStep):
    """An action as a policy gives it: one vector."""

    def __call__(self, df):
        if "action" in df.columns and not isinstance(df.schema["action"].dataType, T.ArrayType):
            raise TypeError("the action is no vector")
        return super().__call__(df)


class RobotActionStep(ColumnStep):
    """An action as a robot takes it: a column for each motor."""

    def concerns(self, name):
        return name.startswith("action.")


def _one(column: str) -> type:
    class Own(ColumnStep):
        def concerns(self, name):
            return name == column

    return Own


class RewardStep(_one("reward")):
    pass


class DoneStep(_one("done")):
    pass


class TruncatedStep(_one("truncated")):
    pass


class InfoStep(_one("info")):
    pass


class ComplementaryStep(ColumnStep):
    needed = False

    def concerns(self, name):
        return is_complementary(name)


#: Columns that accompany a transition, besides pad flags.
COMPLEMENTARY = ("task", "subtask", "index", "task_index", "episode_index")


def is_complementary(name: str) -> bool:
    return "_is_pad" in name or name in COMPLEMENTARY


@STEPS.register("identity")
@dataclass
class Identity(Step):
    def __call__(self, df):
        return df


@STEPS.register("rename")
@dataclass
class Rename(Step):
    names: dict[str, str] = field(default_factory=dict)

    def __call__(self, df):
        return df.withColumnsRenamed(self.names)

    def stats(self, given: dict[str, dict]) -> dict[str, dict]:
        """Statistics under the new names; each feature's are a copy."""
        return {self.names.get(k, k): dict(v) for k, v in given.items()}


@STEPS.register("normalizer")
@dataclass
class Normalize(Step):
    """modes: column to mode; stats: column to its statistics; an array column has an array for each statistic."""

    modes: dict[str, str] = field(default_factory=dict)
    stats: dict[str, dict] = field(default_factory=dict)
    inverse: bool = False

    def config(self):
        return {"modes": self.modes, "inverse": self.inverse}

    def state(self):
        return {f"{name}.{stat}": value for name, own in self.stats.items() for stat, value in own.items()}

    def load_state(self, state):
        self.stats = {}
        for key, value in state.items():
            name, stat = key.rsplit(".", 1)
            self.stats.setdefault(name, {})[stat] = value

    def _cell(self, mode, names):
        return lambda z: X.normalize(z["x"], mode, {k: z[k] for k in names}, self.inverse)

    def __call__(self, df):
        out = {}
        for name, mode in self.modes.items():
            own = self.stats.get(name)
            if not own or mode == "IDENTITY":
                continue
            if any(isinstance(v, list) for v in own.values()):
                fields = [F.array(*[F.lit(float(x)) for x in v]).alias(k) for k, v in own.items() if k != "count"]
                zipped = F.arrays_zip(F.col(name).alias("x"), *fields)
                out[name] = F.transform(zipped, self._cell(mode, [k for k in own if k != "count"]))
            else:
                out[name] = X.normalize(F.col(name), mode, {k: F.lit(float(v)) for k, v in own.items()}, self.inverse)
        return df.withColumns(out) if out else df


@STEPS.register("delta_window")
@dataclass
class DeltaWindow(Step):
    windows: dict[str, list[int]] = field(default_factory=dict)

    def __call__(self, df):
        return W.delta_window(df, self.windows)


@STEPS.register("velocity")
@dataclass
class Velocity(Step):
    column: str = "observation.state"
    dt: float = 0.1
    to: str = "velocity"

    def __call__(self, df):
        return df.withColumn(self.to, W.vector_velocity(self.column, self.dt))


@STEPS.register("time_limit")
@dataclass
class TimeLimit(Step):
    limit: int = 100

    def __call__(self, df):
        return df.withColumn("truncated", W.time_limit(self.limit, F.coalesce(F.col("truncated"), F.lit(False)) if "truncated" in df.columns else F.lit(False)))


@STEPS.register("intervention")
@dataclass
class Intervention(Step):
    """The teleoperator's action where it steps in; success is reward and, with the flag, ends the episode."""

    terminate_on_success: bool = True

    def __call__(self, df):
        done = F.col("terminate") | (F.lit(self.terminate_on_success) & F.col("success"))
        return df.withColumn("action", X.intervened(F.col("action"), F.col("teleop_action"), F.col("is_intervention"))).withColumn("done", done).withColumn("reward", F.col("success").cast("double"))


@STEPS.register("gripper_penalty")
@dataclass
class GripperPenalty(Step):
    most: float = 30.0
    penalty: float = -0.01

    def __call__(self, df):
        return df.withColumn("discrete_penalty", X.gripper_penalty(F.col("gripper_position"), F.element_at("action", -1), self.most, self.penalty))


@STEPS.register("transition")
@dataclass
class ToTransition(Step):
    """Flat columns as one transition struct; reward 0, done and truncated False where absent; pad flags are complementary."""

    def __call__(self, df):
        named = lambda p: [F.col(f"`{c}`").alias(c) for c in df.columns if p(c)]
        obs, extra = named(lambda c: c.startswith("observation") and "_is_pad" not in c), named(is_complementary)
        pick = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in df.columns else F.lit(d)
        fields = [F.struct(*obs).alias("observation")] if obs else []
        fields += [F.col("action")] if "action" in df.columns else []
        fields += [pick("next.reward", 0.0).alias("reward") if "next.reward" not in df.columns else F.coalesce(F.col("`next.reward`"), F.lit(0.0)).alias("reward"), pick("done", False).alias("done"), pick("truncated", False).alias("truncated")]
        fields += [F.struct(*extra).alias("complementary")] if extra else []
        return df.withColumn("transition", F.struct(*fields))


@STEPS.register("from_transition")
@dataclass
class FromTransition(Step):
    """A transition struct as flat columns again: observations and what accompanies them under their own names, reward as
    next.reward, done and truncated as next.done and next.truncated. Other columns of the row stay."""

    def __call__(self, df):
        inner = df.schema["transition"].dataType
        cells = {}
        for group in ("observation", "complementary"):
            if group in inner.names:
                cells |= {c: F.col("transition")[group][c] for c in inner[group].dataType.names}
        cells |= {"action": F.col("transition.action")} if "action" in inner.names else {}
        cells |= {"next.reward": F.col("transition.reward"), "next.done": F.col("transition.done"), "next.truncated": F.col("transition.truncated")}
        return df.select(*[F.col(f"`{c}`") for c in df.columns if c != "transition" and c not in cells], *[v.alias(k) for k, v in cells.items()])


class Pipeline:
    """Steps one after another; hooks see (place, frame) before and after each."""

    def __init__(self, steps: list[Step], name: str = "pipeline"):
        self.steps, self.name = list(steps), name
        self.before: list[Callable] = []
        self.after: list[Callable] = []

    def step_through(self, df: DataFrame) -> Iterator[DataFrame]:
        yield df
        for i, step in enumerate(self.steps):
            for h in self.before:
                h(i, df)
            df = step(df)
            for h in self.after:
                h(i, df)
            yield df

    def __call__(self, df: DataFrame) -> DataFrame:
        for df in self.step_through(df):
            pass
        return df

    def __len__(self) -> int:
        return len(self.steps)

    def __getitem__(self, at):
        return Pipeline(self.steps[at], self.name) if isinstance(at, slice) else self.steps[at]

    def schema(self, given: T.StructType) -> T.StructType:
        for step in self.steps:
            given = step.schema(given)
        return given

    def reset(self) -> None:
        for step in self.steps:
            step.reset()

    def state(self) -> dict[str, dict]:
        """What the steps have learnt, by their places."""
        return {str(i): own for i, s in enumerate(self.steps) if (own := s.state())}

    def load_state(self, state: dict[str, dict]) -> None:
        for i, own in state.items():
            self.steps[int(i)].load_state(own)

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "steps": [{"registry_name": s.registry_name, "config": s.config()} for s in self.steps], "state": self.state()}, indent=2)

    @staticmethod
    def from_json(text: str, overrides: dict[str, dict] | None = None) -> Pipeline:
        raw, left = json.loads(text), dict(overrides or {})
        steps = []
        for s in raw["steps"]:
            cls = STEPS.get(s["registry_name"])
            own = left.pop(s["registry_name"], {})
            if unknown := set(own) - set(inspect.signature(cls).parameters):
                raise ValueError(f"{s['registry_name']} has no {sorted(unknown)}")
            steps.append(cls(**(s["config"] | own)))
        if left:
            raise KeyError(f"overrides for no step: {sorted(left)}")
        out = Pipeline(steps, raw["name"])
        given = {i: v for i, v in raw.get("state", {}).items() if "stats" not in (overrides or {}).get(raw["steps"][int(i)]["registry_name"], {})}
        out.load_state(given)
        return out


def hot_swap(pipeline: Pipeline, stats: dict[str, dict]) -> Pipeline:
    """The pipeline with other statistics in its normalisers."""
    return Pipeline([Normalize(s.modes, stats, s.inverse) if isinstance(s, Normalize) else s for s in pipeline.steps], pipeline.name)
