"""Token columns: ids and masks of texts by a tokenizer file, and action tokens framed and padded."""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(text: Column, path: str) -> Column:
    """Ids of a text by a tokenizer file that every executor has."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([e.ids for e in _tokenizer(path).encode_batch(texts.fillna("").tolist(), add_special_tokens=False)])

    return run(text)


def padded_ids(ids: Column, length: int, pad: int = 0, side: str = "right") -> tuple[Column, Column]:
    """Ids cut and padded to a length, and the mask of real ones."""
    cut = F.slice(ids, 1, length)
    gap = F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    fill, real, none = F.array_repeat(F.lit(pad), gap), F.array_repeat(F.lit(True), F.size(cut)), F.array_repeat(F.lit(False), gap)
    return (F.concat(cut, fill), F.concat(real, none)) if side == "right" else (F.concat(fill, cut), F.concat(none, real))


def framed_action(tokens: Column, offset: int, head: list[int], tail: list[int]) -> Column:
    """Action tokens mapped to the end of a vocabulary (offset - token), between fixed head and tail ids."""
    return F.concat(F.array(*[F.lit(i) for i in head]), F.transform(tokens, lambda t: F.lit(offset) - t), F.array(*[F.lit(i) for i in tail]))


def cosine_matrix(steps: int) -> list[list[float]]:
    """The orthonormal DCT-II of ``steps`` values as a matrix; its transpose is the inverse."""
    return [[math.sqrt((1 if k == 0 else 2) / steps) * math.cos(math.pi * (t + 0.5) * k / steps) for t in range(steps)] for k in range(steps)]


def _literal(matrix: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(x) for x in row]) for row in matrix])


def _dot(row: Column, values: Column) -> Column:
    return F.aggregate(F.zip_with(row, values, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)


def action_tokens(chunk: Column, steps: int, dims: int, scale: float = 10.0) -> Column:
    """A chunk of actions (an array of ``steps`` arrays of ``dims`` values, normalised) as whole numbers: the cosine transform
    over time as a matrix product, times ``scale``, rounded to even. Low frequencies come first, of each all dimensions, so
    the small high ones stand together at the end."""
    of = lambda d: F.transform(chunk, lambda a: F.element_at(a, d).cast("double"))
    cell = lambda row: F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda d: F.rint(F.lit(scale) * _dot(row, of(d))).cast("int"))
    return F.flatten(F.transform(_literal(cosine_matrix(steps)), cell))


def actions_of(tokens: Column, steps: int, dims: int, scale: float = 10.0) -> Column:
    """The chunk that action tokens stand for: each value is off by at most sqrt(steps) / (2 * scale)."""
    back = [list(c) for c in zip(*cosine_matrix(steps))]
    of = lambda d: F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.element_at(tokens, k * dims + d) / F.lit(scale))
    return F.transform(_literal(back), lambda row: F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda d: _dot(row, of(d))))
