"""Connected components of a table of edges by alternating stars; nothing is collected."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import checkpointed


def _forest(batches):
    """Edges of one partition as stars: a union-find over them, each node linked with the least of its part."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"], pdf["b"]):
            ra, rb = root(bytes(a)), root(bytes(b))
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        if len(parent) > 400_000:  # the stars so far stand for their edges; memory stays bounded
            yield _stars(parent, root)
            parent.clear()
    if parent:
        yield _stars(parent, root)


def _stars(parent: dict, root) -> pd.DataFrame:
    rows = [(x, r) for x in list(parent) if (r := root(x)) != x]
    return pd.DataFrame(rows, columns=["a", "b"])


def _closed(batches):
    """All edges at once: every node with its component's least node."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"], pdf["b"]):
            ra, rb = root(bytes(a)), root(bytes(b))
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    if parent:
        yield pd.DataFrame({"node": list(parent), "label": [root(x) for x in list(parent)]})


#: So many edges (about 50 MB of nodes) are closed in one task; more by rounds of stars over all.
FEW = 150_000


def components(edges: DataFrame, limit: int = 64, few: int = FEW) -> DataFrame:
    """edges: a, b (binary). Returns node, label: the least node of its component; only nodes that have edges. Checkpointed."""
    now = checkpointed(edges.select("a", "b").where("a <> b").mapInPandas(_forest, "a binary, b binary").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    if now.count() <= few:
        return checkpointed(now.coalesce(1).mapInPandas(_closed, "node binary, label binary"))
    now = checkpointed(now.distinct())
    for _ in range(limit):
        #: Large star: a node's larger neighbours move to the least of it and its neighbours.
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        #: Small star: a node and its smaller neighbours move to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        after = checkpointed(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct())
        #: Done when every node has one link and no link's target has one: all are stars.
        moving = after.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a").union(after.select(F.col("b").alias("a")).join(after.select("a"), "a", "left_semi").select("a"))
        now = after
        if moving.isEmpty():
            return checkpointed(now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()))
    raise RuntimeError("components did not settle")
