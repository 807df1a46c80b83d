"""Column functions over features: normalisation, vectors, text, progress, geometry, units."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def _lit(x):
    return x if isinstance(x, Column) else F.lit(x)


# Normalisation


def mean_std(x: Column, mean, std, eps: float = EPS) -> Column:
    return (x - _lit(mean)) / (_lit(std) + F.lit(eps))


def mean_std_inverse(x: Column, mean, std) -> Column:
    return x * _lit(std) + _lit(mean)


def _range(low, high, eps: float) -> Column:
    d = _lit(high) - _lit(low)
    return F.when(d == 0, F.lit(eps)).otherwise(d)


def min_max(x: Column, low, high, eps: float = EPS) -> Column:
    """To [-1, 1]; also for quantile modes, with the quantiles as bounds and no clipping."""
    return F.lit(2.0) * (x - _lit(low)) / _range(low, high, eps) - 1


def min_max_inverse(x: Column, low, high, eps: float = EPS) -> Column:
    return (x + 1) / 2 * _range(low, high, eps) + _lit(low)


def normalize(x: Column, mode: str, stats: dict[str, Column], inverse: bool = False) -> Column:
    """By mode: MEAN_STD, MIN_MAX, QUANTILES (q01, q99), QUANTILE10 (q10, q90), IDENTITY; without statistics unchanged."""
    bounds = {"MIN_MAX": ("min", "max"), "QUANTILES": ("q01", "q99"), "QUANTILE10": ("q10", "q90")}
    if mode == "IDENTITY" or not stats:
        return x
    if mode == "MEAN_STD":
        return mean_std_inverse(x, stats["mean"], stats["std"]) if inverse else mean_std(x, stats["mean"], stats["std"])
    low, high = (stats[k] for k in bounds[mode])
    return min_max_inverse(x, low, high) if inverse else min_max(x, low, high)


def tokenizer_normalize(x: Column, mode: str, stats: dict[str, Column], eps: float = EPS) -> Column:
    """The tokenizer's variants: deviations and ranges are at least eps, and quantile modes clip first."""
    if mode == "MEAN_STD":
        return (x - stats["mean"]) / F.greatest(stats["std"], F.lit(eps))
    low, high = {"MIN_MAX": ("min", "max"), "QUANTILES": ("q01", "q99"), "QUANTILE10": ("q10", "q90")}[mode]
    low, high = stats[low], stats[high]
    v = x if mode == "MIN_MAX" else F.greatest(F.least(x, high), low)
    return F.lit(2.0) * (v - low) / F.greatest(high - low, F.lit(eps)) - 1


def packed_min_max(x: Column, low, high, inverse: bool = False) -> Column:
    """A constant dimension gives 0, and its minimum back."""
    d = _lit(high) - _lit(low)
    return F.when(d == 0, _lit(low)).otherwise((x + 1) / 2 * d + _lit(low)) if inverse else F.when(d == 0, F.lit(0.0)).otherwise(F.lit(2.0) * (x - _lit(low)) / F.nullif(d, F.lit(0.0)) - 1)


# Vectors


def delta(action: str, state: str, dims: Sequence[bool]) -> Column:
    """Selected dimensions of an action relative to the state."""
    mask = F.array(*[F.lit(bool(d)) for d in dims])
    pairs = F.arrays_zip(F.col(action).alias("a"), F.col(state).alias("s"), mask.alias("m"))
    return F.transform(pairs, lambda p: F.when(p["m"], p["a"] - p["s"]).otherwise(p["a"]))


def pad_vector(v: str, n: int, truncate: bool = False) -> Column:
    padded = F.concat(F.col(v), F.array_repeat(F.lit(0.0), F.greatest(F.lit(n) - F.size(v), F.lit(0))))
    return F.slice(padded, 1, n) if truncate else padded


def discretize(x: Column, bins: int = 256) -> Column:
    """The bin of x among ``bins`` equal ones over [-1, 1): -1 below, the last bin from there on."""
    return F.when(x < -1, F.lit(-1)).otherwise(F.least(F.floor((x + 1) * (bins / 2)), F.lit(bins - 1))).cast("long")


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def similar(a: Column, b: Column, tolerance: float = 1.0) -> Column:
    return distance(a, b) < tolerance


def has_nan(v: Column) -> Column:
    return F.coalesce(F.exists(v, lambda x: F.isnan(x)), F.lit(False))


def float_position(v: Column, x: float, tolerance: float = 1e-6) -> Column:
    """The first place (from 0) within the tolerance of x; -1 if there is none."""
    return F.array_position(F.transform(v, lambda e: F.abs(e - x) < tolerance), True).cast("long") - 1


def named(v: str, names: Sequence[str]) -> list[Column]:
    return [F.col(v)[i].alias(n) for i, n in enumerate(names)]


# Text


def prompt(task: Column, bins: Column) -> Column:
    """Task with underscores and newlines as spaces, trimmed, and the state's bins."""
    clean = F.trim(F.translate(task, "_\n", "  "))
    return F.concat(F.lit("Task: "), clean, F.lit(", State: "), F.concat_ws(" ", F.transform(bins, lambda b: b.cast("string"))), F.lit(";\nAction: "))


def with_newline(task: Column) -> Column:
    return F.when(task.endswith("\n"), task).otherwise(F.concat(task, F.lit("\n")))


def formal(task: Column, default: str = "Perform the task.") -> Column:
    """Lower case, letters, digits and white space only; the default for an empty task."""
    return F.when(F.coalesce(task, F.lit("")) == "", F.lit(default)).otherwise(F.regexp_replace(F.lower(task), r"[^\p{L}\p{N}_\s]", ""))


def with_stop(task: Column, default: str = "Execute the robot action.") -> Column:
    own = F.coalesce(F.nullif(F.trim(task), F.lit("")), F.lit(default))
    return F.when(own.endswith("."), own).otherwise(F.concat(own, F.lit(".")))


def clock_seconds(text: Column) -> Column:
    """MM:SS or SS as seconds."""
    parts = F.split(text, ":")
    return F.when(F.size(parts) == 2, parts[0].cast("long") * 60 + F.try_element_at(parts, F.lit(2)).cast("long")).otherwise(parts[0].cast("long"))


def frame_of(seconds: Column, fps: float) -> Column:
    return (seconds * fps).cast("long")


def big_number(n: Column, decimals: int = 0) -> Column:
    """With a suffix for thousands: 1500 is 2K, 2500000 is 2M (or with decimals)."""
    out = None
    for i, suffix in enumerate(["", "K", "M", "B", "T", "Q"]):
        text = F.format_string(f"%.{decimals}f{suffix}", n / float(1000**i))
        hit = F.abs(n) < float(1000 ** (i + 1))
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out


def file_path(chunk: Column, file: Column, template: str = "data/chunk-%03d/file-%03d.parquet") -> Column:
    return F.format_string(template, chunk, file)


# Progress


def tau(t: Column, start: Column, end: Column) -> Column:
    """Progress inside [start, end], clipped; 1 if it has no duration."""
    return F.when(end <= start, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (t - start) / F.nullif(end - start, F.lit(0)))))


def stage_and_tau(frame: Column, stages: Column, count: int) -> tuple[Column, Column]:
    """Stage and tau of a frame. stages: array of (stage, start, end) in order, stage from 0. Before the first: 0, 0; in a gap: the
    stage before, 1; after the last: the last stage of all, 0.999."""
    hit = F.filter(stages, lambda s: (s["start"] <= frame) & (frame <= s["end"]))
    gap = F.filter(F.transform(stages, lambda s, i: F.struct(s["stage"].alias("stage"), s["end"].alias("end"), F.try_element_at(stages, i + 2)["start"].alias("next"))), lambda s: (s["end"] < frame) & (frame < s["next"]))
    first, last = F.try_element_at(stages, F.lit(1)), F.try_element_at(stages, F.lit(-1))
    none, one = F.size(F.coalesce(stages, F.array())) == 0, F.size(hit) > 0
    h, g = F.try_element_at(hit, F.lit(1)), F.try_element_at(gap, F.lit(1))
    stage = F.when(none | (frame < first["start"]), F.lit(0)).when(frame > last["end"], F.lit(count - 1)).when(one, h["stage"]).when(F.size(gap) > 0, g["stage"]).otherwise(F.lit(0))
    t = F.when(none | (frame < first["start"]), F.lit(0.0)).when(frame > last["end"], F.lit(0.999)).when(one, tau(frame, h["start"], h["end"])).when(F.size(gap) > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return stage.cast("long"), t


def breakpoints(proportions: Sequence[float]) -> list[float]:
    total = sum(proportions)
    if total > 0 and abs(total - 1) > 1e-6:
        proportions = [p / total for p in proportions]
    out = [0.0]
    for p in proportions:
        out.append(out[-1] + p)
    out[-1] = 1.0
    return out


def overall_progress(x: Column, points: Sequence[float]) -> Column:
    """Stage + tau to [0, 1], linear between the breakpoints."""
    out = F.when(x < 0, F.lit(0.0)).when(x >= len(points) - 1, F.lit(1.0))
    for i in range(len(points) - 1):
        out = out.when(x < i + 1, F.lit(points[i]) + (x - i) * (points[i + 1] - points[i]))
    return out


def advantage_weight(d: Column, mean, std, kappa: float, fallback: float = 1.0, eps: float = 1e-6) -> Column:
    """1 above kappa, a soft ramp over mean +- 2 std from 0 to kappa, 0 below 0, the fallback where unknown."""
    soft = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (d - (_lit(mean) - 2 * _lit(std))) / (4 * _lit(std) + F.lit(eps))))
    return F.when(d.isNull() | F.isnan(d), F.lit(fallback)).when(d > kappa, F.lit(1.0)).when(d >= 0, soft).otherwise(F.lit(0.0))


# Geometry and units


def quaternion_to_axis_angle(q: Column) -> Column:
    """(x, y, z, w) to an axis times an angle; zeros for no rotation."""
    w = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q[3]))
    den = F.sqrt(F.greatest(1 - w * w, F.lit(0.0)))
    angle = F.lit(2.0) * F.acos(w)
    return F.array(*[F.when(den > 1e-10, q[i] / den * angle).otherwise(F.lit(0.0)) for i in range(3)])


def rotvec_to_quaternion(v: Column) -> Column:
    angle = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    k = F.when(angle < 1e-8, F.lit(0.5) - angle * angle / 48).otherwise(F.sin(angle / 2) / F.nullif(angle, F.lit(0.0)))
    return F.array(v[0] * k, v[1] * k, v[2] * k, F.cos(angle / 2))


def quaternion_to_matrix(q: Column) -> Column:
    x, y, z, w = (q[i] for i in range(4))
    rows = [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]
    return F.array(*[F.array(*r) for r in rows])


def quaternion_multiply(a: Column, b: Column) -> Column:
    """The rotation b, then a."""
    ax, ay, az, aw, bx, by, bz, bw = *(a[i] for i in range(4)), *(b[i] for i in range(4))
    return F.array(aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz)


def quaternion_inverse(q: Column) -> Column:
    return F.array(-q[0], -q[1], -q[2], q[3])


def rotate(m: Column, v: Column) -> Column:
    return F.transform(m, lambda r: r[0] * v[0] + r[1] * v[1] + r[2] * v[2])


def six_d_to_matrix(v: Column) -> Column:
    """Two 3-vectors to an orthonormal basis (as columns) by Gram-Schmidt."""
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    unit = lambda a: [x / (F.sqrt(dot(a, a)) + 1e-6) for x in a]
    a, b = [v[i] for i in range(3)], [v[i + 3] for i in range(3)]
    x = unit(a)
    d = dot(x, b)
    y = unit([b[i] - d * x[i] for i in range(3)])
    z = [x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0]]
    return F.array(*[F.array(x[i], y[i], z[i]) for i in range(3)])


def matrix_to_quaternion(m: Column) -> Column:
    """(x, y, z, w) of a rotation matrix, from the largest of the four sums on its diagonal, so that no root is of a small number."""
    c = lambda i, j: m[i][j]
    sums = [c(0, 0) - c(1, 1) - c(2, 2), c(1, 1) - c(0, 0) - c(2, 2), c(2, 2) - c(0, 0) - c(1, 1), c(0, 0) + c(1, 1) + c(2, 2)]
    #: Products of the quaternion's parts, four times each: q q' from sums and differences across the diagonal.
    pair = {(0, 1): c(0, 1) + c(1, 0), (0, 2): c(0, 2) + c(2, 0), (1, 2): c(1, 2) + c(2, 1), (0, 3): c(2, 1) - c(1, 2), (1, 3): c(0, 2) - c(2, 0), (2, 3): c(1, 0) - c(0, 1)}
    out, top = None, F.greatest(*sums)
    for k in range(4):
        s = F.sqrt(F.greatest(sums[k] + 1, F.lit(0.0))) * 2
        own = F.array(*[s / 4 if i == k else pair[min(i, k), max(i, k)] / F.nullif(s, F.lit(0.0)) for i in range(4)])
        out = F.when(sums[k] == top, own) if out is None else out.when(sums[k] == top, own)
    return out


def matrix_multiply(a: Column, b: Column) -> Column:
    return F.array(*[F.array(*[a[i][0] * b[0][j] + a[i][1] * b[1][j] + a[i][2] * b[2][j] for j in range(3)]) for i in range(3)])


def matrix_inverse(m: Column) -> Column:
    """A rotation's inverse is its transpose."""
    return F.array(*[F.array(*[m[j][i] for j in range(3)]) for i in range(3)])


def _let(c: Column, then: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once."""
    return F.transform(F.array(c), then)[0]


def six_d_action(action: Column) -> Column:
    """Position, rotation by two 3-vectors and gripper as position, axis times angle, and a gripper of -1 or 1."""
    turn = _let(_let(_let(F.slice(action, 4, 6), six_d_to_matrix), matrix_to_quaternion), quaternion_to_axis_angle)
    return F.concat(F.slice(action, 1, 3), turn, F.array(F.when(action[9] > 0.5, F.lit(1.0)).otherwise(F.lit(-1.0))))


def delta_action(delta: Column, gripper: Column, scale: float, threshold: float) -> dict[str, Column]:
    """A teleoperator's step as a robot's target: scaled, without rotation; enabled if it is longer than the noise."""
    out = {"enabled": delta_enabled(delta, threshold)} | {f"target_{a}": delta[i] * F.lit(float(scale)) for i, a in enumerate("xyz")}
    return out | {f"target_w{a}": F.lit(0.0) for a in "xyz"} | {"gripper_vel": gripper.cast("double")}


def gripper_penalty(state: Column, action: Column, most: float, penalty: float) -> Column:
    s, a = state / most, action / most
    return F.when(((s < 0.5) & (a > 0.5)) | ((s > 0.75) & (a < 0.5)), F.lit(penalty)).otherwise(F.lit(0.0))


def gripper_position(last: Column, speed: Column, factor: float, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), last + speed * factor))


def clipped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def delta_enabled(v: Column, threshold: float) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)) > threshold


def unit_value(x: Column, low: Column, high: Column, mode: str, flip: Column | None = None, resolution: int = 4096, inverse: bool = False) -> Column:
    """Raw readings to -100..100, 0..100 or degrees, and back (truncated); flip reverses the direction, degrees don't clamp or flip."""
    flip = flip if flip is not None else F.lit(False)
    if mode == "DEGREES":
        mid = (low + high) / 2
        return (x * (resolution - 1) / 360 + mid).cast("long") if inverse else (x - mid) * 360 / (resolution - 1)
    bound = F.least(high, F.greatest(low, x))
    if mode == "RANGE_M100_100":
        if inverse:
            v = F.greatest(F.lit(-100.0), F.least(F.lit(100.0), F.when(flip, -x).otherwise(x)))
            return ((v + 100) / 200 * (high - low) + low).cast("long")
        n = (bound - low) / (high - low) * 200 - 100
        return F.when(flip, -n).otherwise(n)
    if inverse:
        v = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.when(flip, 100 - x).otherwise(x)))
        return (v / 100 * (high - low) + low).cast("long")
    n = (bound - low) / (high - low) * 100
    return F.when(flip, 100 - n).otherwise(n)


def intervened(action: Column, teleop: Column, is_intervention: Column) -> Column:
    return F.when(is_intervention, teleop).otherwise(action)
