"""Similarity join on sets of word n-grams, size-aware: light sets by subsets of fixed size, heavy ones by inverted lists.

1. A pass over whole texts gives the set of distinct n-grams (64-bit hashes), its size, a 128-bit hash of the set, its ``BOTTOM``
   least values, and of a set that may be light all of them. Documents with equal sets
   form a class; copies cost nothing from here on.
2. Two sets of sizes n and m link if they share c(n, m) values or more. A light set, of fewer values than the boundary, enumerates
   its subsets of each size c that it may need with a partner. Those that hold one subset are linked with the smallest of them, and
   that is enough: what any two of them have in common, each has with the smallest. The boundary is where the rows of
   all enumerations and of the lists of the rest are fewest, by the histogram of small sizes.
3. Heavy sets, and light ones within reach of the boundary, go through inverted lists. First those that share a least value and
   nearly the size are compared with one pivot each, on full sets; links found make components. That is done in ``TURNS`` turns
   with other pivots, each of another component.
4. Lists are then read for values that sets of two components hold. In a slice of the hash range (below ``SLICE`` percent), a set whose own component alone holds as many
   values as its prefix has (n - ceil(percent * n / 100) + 1) can have no link outside: any partner must share a value of
   any such prefix. The sets left, with all their values, meet in lists of their prefixes (``_prefix``), rare values
   first and no component with itself. Where two meet, the parity maps of their sets bound how many values they differ
   in; pairs that differ in too many go no further. First each list is sorted by a part of the maps, which near sets have
   alike, and a set meets only the few before it (``LIST_TURNS`` times): its nearest few are confirmed and components are joined, so that
   a crowd is nearly one component before all its pairs would meet. Then all pairs between components meet; they are confirmed on full sets, in ``PAIR_TURNS`` turns:
   of all pairs first the nearest few of each set. A turn joins components, and pairs inside one are not needed any more: so a crowd that is one component is confirmed by a few
   pairs a set, and only pairs between components are all confirmed.
5. Connected components of all links.

So a crowd of near copies costs a pair for each member in 3 and pairs between components in 4, and no link is lost.

Defined cases: a null text, or one without words, has no n-grams and is linked with nothing; fewer than n words count as one
n-gram; a null key counts as no smallest id (a component of null keys only has a null id); repeated rows stay repeated; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frames import checkpointed, let_go, map_text, shuffle_partitions
from ._prefix import nearest, pairs_of, prefixes
from ._text import mix64, slices, text_buffers
from .components import components
from .lsh_forest import _joined, confirmed, own_texts, shingle_sets

SHINGLE = 4
PERCENT = 85
BOTTOM = 8
SLICE = 20
#: Sets up to this size may be light.
LIGHT = 20
#: So often are pivots drawn; it only makes the lists of 4 shorter.
TURNS = 2
#: So often do sets meet their neighbours in sorted lists, and this many of them; it only makes the pairs of 4 fewer.
LIST_TURNS = 1
REACH = 4
#: So often are the nearest pairs of each set confirmed before others; it only makes the rest fewer.
PAIR_TURNS = 2
#: So many classes' keys (about 20 MB) are broadcast to look texts up; more are joined by shuffle.
LOOKUP = 300_000


def shared_needed(n: int, m: int, percent: int = PERCENT) -> int:
    """The least number of common values of linked sets of these sizes."""
    return -(-percent * (n + m) // (100 + percent))


def subset_sizes(n: int, percent: int = PERCENT) -> list[int]:
    """The sizes of subsets that a light set of n values enumerates: what it needs with each size of partner."""
    partners = range(-(-percent * n // 100), 100 * n // percent + 1)
    return sorted({c for m in partners if (c := shared_needed(n, m, percent)) <= min(n, m)})


def boundary(sizes: dict[int, int], heavy_values: int, percent: int = PERCENT) -> int:
    """Sets of fewer values than this are light. sizes: how many sets there are of each size up to LIGHT;
    heavy_values: the values of all larger sets, which lists hold in any case."""

    def cost(x: int) -> int:
        least = -(-percent * x // 100)
        return sum(k * sum(comb(n, c) for c in subset_sizes(n, percent)) for n, k in sizes.items() if n < x) + sum(k * n for n, k in sizes.items() if n >= least) + heavy_values

    return min(range(1, LIGHT + 2), key=lambda x: (cost(x), x))


#: The values below this are the slice; it is less than 2^63, so they are the same as signed numbers.
SLICE_END = (1 << 64) * SLICE // 100


def _digest(n: int):
    def kernel(column: pa.Array) -> list[pa.Array]:
        raw, off = text_buffers(column)
        sizes, prints, part_n, few, all_ = [], [], [], [], []
        for i, j in slices(off):
            values, first = shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], n)
            marks = set_hashes(values, first)
            for k in range(j - i):
                own = values[first[k] : first[k + 1]]  # they rise
                sizes.append(len(own))
                prints.append(marks[k])
                part_n.append(int(np.searchsorted(own, np.uint64(SLICE_END))))
                few.append(own[:BOTTOM].view(np.int64) if len(own) else None)
                all_.append(own.view(np.int64) if 0 < len(own) <= LIGHT else None)
        return [pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(part_n, pa.int64()), pa.array(few, pa.list_(pa.int64())), pa.array(all_, pa.list_(pa.int64()))]

    return kernel


_DIGEST = [T.StructField("n", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("part_n", T.LongType()), T.StructField("few", T.ArrayType(T.LongType())), T.StructField("all", T.ArrayType(T.LongType()))]


def set_hashes(values: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """128 bits of each set, None for an empty one."""
    other = mix64(values + np.uint64(0x632BE59BD9B4E019))
    out = []
    with np.errstate(over="ignore"):
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            out.append(int(values[lo:hi].sum()).to_bytes(8, "big") + int(other[lo:hi].sum()).to_bytes(8, "big") if hi > lo else None)
    return out


def _slices(n: int):
    """The set's hash and its values in the slice."""

    def kernel(column: pa.Array) -> list[pa.Array]:
        raw, off = text_buffers(column)
        prints, part = [], []
        for i, j in slices(off):
            values, first = shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], n)
            prints += set_hashes(values, first)
            for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
                part.append(values[lo : lo + int(np.searchsorted(values[lo:hi], np.uint64(SLICE_END)))].view(np.int64))
        return [pa.array(prints, pa.binary()), pa.array(part, pa.list_(pa.int64()))]

    return kernel


_SLICES = [T.StructField("cls", T.BinaryType()), T.StructField("part", T.ArrayType(T.LongType()))]


def _subsets(percent: int):
    def run(batches):
        for batch in batches:
            cls, size, key = [], [], []
            for c, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mixed = mix64(np.array(values, np.int64).view(np.uint64))
                for k in subset_sizes(len(values), percent):
                    picks = np.array(list(combinations(range(len(values)), k)), np.int64)
                    with np.errstate(over="ignore"):
                        found = mix64(mixed[picks].sum(1, dtype=np.uint64) + np.uint64(k)).view(np.int64)
                    cls += [c] * len(found)
                    size += [k] * len(found)
                    key.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(size, pa.int64()), pa.array(np.concatenate(key) if key else [], pa.int64())], names=["cls", "k", "subset"])

    return run


def light_links(light: DataFrame, percent: int = PERCENT) -> DataFrame:
    """light: cls, n, all (their values). Returns a, b: links that join every two light sets that link, if only by others."""
    held = light.select("cls", "all").mapInArrow(_subsets(percent), "cls binary, k long, subset long").join(light.select("cls", "n"), "cls")
    least = held.groupBy("k", "subset").agg(F.min(F.struct("n", "cls")).alias("least"), F.count(F.lit(1)).alias("times")).where("times > 1")
    need = lambda x, y: F.ceil(F.lit(percent) * (x + y) / F.lit(100 + percent))
    met = held.join(least, ["k", "subset"]).where((F.col("cls") != F.col("least.cls")) & (need(F.col("n"), F.col("least.n")) <= F.col("k"))).select("cls", F.col("least.cls").alias("other")).distinct()
    both = met.join(light.select("cls", F.col("all").alias("p")), "cls").join(light.select(F.col("cls").alias("other"), F.col("all").alias("q")), "other")
    common = F.size(F.array_intersect("p", "q"))
    return both.where(100 * common >= percent * (F.size("p") + F.size("q") - common)).select(F.col("cls").alias("a"), F.col("other").alias("b"))


def pivots(heavy: DataFrame, label: DataFrame | None, turn: int, percent: int = PERCENT) -> DataFrame:
    """heavy: cls, n, few; label: node, label of the links so far. Returns a, b: each set with the one, of nearly its size and
    not of its component, that most of its least values lead to, if half of them do. Each turn draws other pivots."""
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(percent / 100.0) if percent < 100 else 1.0))
    rows = heavy.select("cls", "n", step.alias("step"), F.explode("few").alias("s"))
    if label is not None:
        rows = rows.join(_by_key(label, "node").select(F.col("node").alias("cls"), "label"), "cls", "left").withColumn("of", F.coalesce("label", "cls")).drop("label")
    else:
        rows = rows.withColumn("of", F.col("cls"))
    #: Two pivots a list: where the first is of a set's own component, the second may not be.
    drawn = F.struct(F.xxhash64(F.lit(turn), "cls"), F.struct("cls", "of").alias("p"))
    ends = rows.groupBy("s", "step").agg(F.min(drawn)["p"].alias("p0"), F.max(drawn)["p"].alias("p1"), F.min("of").alias("of0"), F.max("of").alias("of1")).where("of0 <> of1").select("s", "step", "p0", "p1")
    pivot = F.when(F.col("p0.of") != F.col("of"), F.col("p0.cls")).when(F.col("p1.of") != F.col("of"), F.col("p1.cls"))
    votes = rows.join(ends, ["s", "step"]).withColumn("pivot", pivot).where("pivot is not null").groupBy("cls", "pivot").agg(F.count(F.lit(1)).alias("votes"), F.first("n").alias("n")).where(f"2 * votes >= least(n, {BOTTOM})")
    return votes.groupBy("cls").agg(F.min(F.struct((-F.col("votes")).alias("minus"), F.xxhash64(F.lit(turn), "pivot").alias("drawn"), "pivot")).alias("best")).select(F.col("cls").alias("a"), F.col("best.pivot").alias("b"))


def open_sets(own: DataFrame, classes: DataFrame, label: DataFrame, percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """The classes that may have a link outside their component, by the slice. own: text; classes: cls, n, copies, part_n;
    label: node, label."""
    named = _by_key(label, "node").select(F.col("node").alias("cls"), "label")
    part = map_text(own.select("text"), _slices(n), _SLICES, drop=["text"]).where("cls is not null").join(named, "cls", "left")
    #: A class without a link so far is its own component: both have one hash.
    rows = part.select(F.xxhash64(F.coalesce("label", "cls")).alias("l"), F.when(F.col("label").isNotNull(), F.xxhash64("cls")).alias("id"), F.explode("part").alias("s"))
    holders = rows.groupBy("s").agg(F.min("l").alias("l0"), F.max("l").alias("l1"), F.max(F.col("id").isNotNull()).alias("linked"))
    #: One reading tells both how many values each component holds alone and which values of linked classes others hold too.
    both = holders.select(F.when(F.expr("l0 = l1"), F.col("l0")).alias("l"), F.when(F.expr("l0 <> l1 and linked"), F.col("s")).alias("s")).where("l is not null or s is not null")
    told = checkpointed(both.groupBy("l", "s").agg(F.count(F.lit(1)).alias("alone")))
    alone = told.where("l is not null").select("l", "alone")
    #: What a class in a component shares with others must be told from what it shares in it.
    outside = rows.where("id is not null").select("id", "s").join(told.where("s is not null").select("s"), "s").groupBy("id").agg(F.count(F.lit(1)).alias("outside"))
    prefix = F.expr(f"n - (n * {percent} + 99) div 100 + 1")
    each = classes.join(named, "cls", "left").select("cls", "n", "copies", "part_n", prefix.alias("prefix"), F.coalesce("label", "cls").alias("of"), F.col("label").isNotNull().alias("linked")).withColumns({"l": F.xxhash64("of"), "id": F.xxhash64("cls")})
    #: Components whose hashes are equal by chance stay open, and so do classes; small sets too, whose slice tells little.
    twins = each.groupBy("l").agg(F.min("of").alias("of0"), F.max("of").alias("of1")).where("of0 <> of1").select("l", F.lit(True).alias("twin"))
    same = each.where("linked").groupBy("id").agg(F.count(F.lit(1)).alias("same")).where("same > 1")
    rated = each.join(alone, "l", "left").join(outside, "id", "left").join(twins, "l", "left").join(same, "id", "left")
    shut = F.when(F.col("linked"), F.coalesce("outside", F.lit(0)) <= F.col("copies") * (F.col("part_n") - F.col("prefix"))).otherwise(F.coalesce("alone", F.lit(0)) >= F.col("prefix"))
    return rated.where(~shut | (F.col("n") <= LIGHT) | F.col("twin").isNotNull() | F.col("same").isNotNull()).select("cls")


def _by_key(df: DataFrame, key: str) -> DataFrame:
    return F.broadcast(df) if df.count() <= LOOKUP else df


#: Bits of a set's parity map.
BITS = 512


def parity_map(values: np.ndarray) -> np.ndarray:
    """For each of BITS classes of the values' hashes, whether an odd number of the set's values is in it; as longs."""
    odd = np.bincount(((values >> np.uint64(13)) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _apart(percent: int) -> Column:
    """How many more bits two sets' parity maps differ in than values may in linked sets of their sizes. Maps differ in no more bits than the sets
    do in values; so above 0 pairs that can't link are told, and none that can."""
    differ = F.lit(0)
    for k in range(BITS // 64):
        differ = differ + F.bit_count(F.col("map_x")[k].bitwiseXOR(F.col("map_y")[k]))
    return differ - F.expr(f"n_x + n_y - 2 * (((n_x + n_y) * {percent} + {99 + percent}) div {100 + percent})")


def _before(percent: int):
    """Rows in the order of the lists: of each, the nearest of the ``REACH`` before it that are in its list and of another component."""

    def run(batches):
        kept = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = [batch.column(c).to_numpy() for c in ("s", "l", "id", "n")]
            rows.append(batch.column(4).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, BITS // 64))
            new = 0 if kept is None else len(kept[0])
            if new:
                rows = [np.concatenate(both) for both in zip(kept, rows)]
            kept = [r[-REACH:].copy() for r in rows]
            s, l, key, n, maps = rows
            least, at = np.ones(len(s), np.int64), np.zeros(len(s), np.int64)
            for back in range(1, min(REACH, len(s) - 1) + 1):
                i = np.flatnonzero((s[back:] == s[:-back]) & (l[back:] != l[:-back])) + back
                both = n[i] + n[i - back]
                apart = np.bitwise_count(maps[i] ^ maps[i - back]).sum(1, dtype=np.int64) - both + 2 * ((both * percent + 99 + percent) // (100 + percent))
                nearer = apart < least[i]
                least[i[nearer]], at[i[nearer]] = apart[nearer], i[nearer] - back
            i = np.flatnonzero(least <= 0)
            i = i[i >= new]
            yield pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(key[at[i]]), pa.array(least[i])], names=["id_x", "id_y", "apart"])

    return run


def neighbours(first: DataFrame, percent: int = PERCENT) -> DataFrame:
    """first: id, l, n, s, map. Returns id_x, id_y, apart: pairs of sets of two components that lie near each other in a list and may
    be alike. Lists are sorted by words of the maps, other ones in each list; they are dealt by range, so that a long list is cut."""
    word, more, turn = F.expr(f"map[pmod(s, {BITS // 64})]"), F.expr(f"map[pmod(s + 1, {BITS // 64})]"), "cast(pmod(shiftright(s, 8), 64) as int)"
    turned = F.expr(f"shiftleft(w, {turn}) | shiftrightunsigned(w, 64 - {turn})")
    rows = first.select("s", "l", "id", "n", "map", word.alias("w"), more.alias("v")).withColumn("w", turned)
    order = ["s", "w", "v", "id"]
    met = rows.repartitionByRange(shuffle_partitions(first.sparkSession), *order).sortWithinPartitions(*order).select("s", "l", "id", "n", "map").mapInArrow(_before(percent), "id_x long, id_y long, apart long")
    return met.select(F.least("id_x", "id_y").alias("id_x"), F.greatest("id_x", "id_y").alias("id_y"), "apart").distinct()


def _all_values(n: int):
    def kernel(column: pa.Array) -> list[pa.Array]:
        raw, off = text_buffers(column)
        parts = [shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], n) for i, j in slices(off)]
        first = np.cumsum(np.concatenate([[0], *[np.diff(f) for _, f in parts]]))
        values = np.concatenate([v for v, _ in parts]) if parts else np.zeros(0, np.uint64)
        maps = [parity_map(values[lo:hi]) for lo, hi in zip(first[:-1].tolist(), first[1:].tolist())]
        return [pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), pa.array(values.view(np.int64))).cast(pa.list_(pa.int64())), pa.array(maps, pa.list_(pa.int64()))]

    return kernel


def links(own: DataFrame, digest: DataFrame, percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """node, label: the component of each class that has a link. own: doc_id, text, text_hash; digest: doc_id, text_hash, n, cls, part_n, few, all."""
    full = digest.where("cls is not null")
    classes = checkpointed(full.groupBy("cls").agg(F.first("n").alias("n"), F.first("part_n").alias("part_n"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "text_hash")).alias("of")))
    counts = classes.where(F.col("n") <= LIGHT).groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()
    rest = classes.where(F.col("n") > LIGHT).agg(F.sum("n")).first()[0] or 0
    x = boundary({r["n"]: r["k"] for r in counts}, rest, percent)
    light = checkpointed(full.where(F.col("n") < x).groupBy("cls").agg(F.first("n").alias("n"), F.first("all").alias("all")))
    heavy = F.col("n") >= -(-percent * x // 100)

    def texts(keys: DataFrame) -> DataFrame:
        want = _by_key(classes.join(keys.distinct(), "cls", "left_semi").select("cls", F.col("of.doc_id").alias("of_key"), F.col("of.text_hash").alias("of_hash")), "cls")
        found = own.join(want, F.col("of_key").eqNullSafe(F.col("doc_id")) & (F.col("text_hash") == F.col("of_hash")))
        return checkpointed(found.groupBy("cls").agg(F.first("text").alias("text")))

    label = components(light_links(light, percent))
    few = checkpointed(full.where(heavy).groupBy("cls").agg(F.first("n").alias("n"), F.first("few").alias("few")))
    for turn in range(TURNS):
        first = checkpointed(pivots(few, label, turn, percent))
        if first.isEmpty():
            break
        bodies = texts(first.select(F.col("a").alias("cls")).union(first.select(F.col("b").alias("cls"))))
        label = _joined(label, checkpointed(confirmed(first, bodies, percent, n)))
        bodies = None
        let_go(own.sparkSession)
    open_ = checkpointed(open_sets(own, classes.where(heavy), label, percent, n))
    if open_.isEmpty():
        return label
    bodies = texts(open_)
    let_go(own.sparkSession)
    ids = checkpointed(bodies.select("cls", F.monotonically_increasing_id().alias("id")))

    def named(label: DataFrame) -> DataFrame:
        """id, l: the open sets' components."""
        return ids.join(_by_key(label, "node").select(F.col("node").alias("cls"), "label"), "cls", "left").select("id", F.xxhash64(F.coalesce("label", "cls")).alias("l"))

    def found(met: DataFrame) -> DataFrame:
        """The links among pairs id_x, id_y."""
        of = _by_key(ids, "id")
        pairs = met.join(of.select(F.col("id").alias("id_x"), F.col("cls").alias("a")), "id_x").join(of.select(F.col("id").alias("id_y"), F.col("cls").alias("b")), "id_y").select("a", "b")
        ends = pairs.select(F.col("a").alias("cls")).union(pairs.select("b"))
        some = bodies.join(F.broadcast(ends), "cls", "left_semi") if met.count() <= LOOKUP // 2 else bodies
        return checkpointed(confirmed(pairs, some, percent, n))

    #: The sets are built anew wherever they are read: their values take more room than the texts.
    sets = map_text(bodies.join(_by_key(ids, "cls"), "cls").select("id", "text"), _all_values(n), [T.StructField("all", T.ArrayType(T.LongType())), T.StructField("map", T.ArrayType(T.LongType()))], drop=["text"]).withColumn("n", F.size("all").cast("long"))
    marks = checkpointed(sets.select("id", "n", "map"))
    first = prefixes(sets.drop("map").join(named(label), "id"), marks, percent)
    let_go(own.sparkSession)
    for _ in range(LIST_TURNS):
        more = found(checkpointed(nearest(neighbours(first, percent))))
        if more.isEmpty():
            break
        label = _joined(label, more)
        first = first.drop("l").join(_by_key(named(label), "id"), "id")
    left = checkpointed(pairs_of(first, percent, lambda: _apart(percent)))
    if left.isEmpty():
        return label
    for _ in range(PAIR_TURNS):
        few = checkpointed(nearest(left))
        more = found(few)
        if more.isEmpty():
            break
        label = _joined(label, more)
        of = _by_key(named(label), "id")
        left = left.join(few, ["id_x", "id_y"], "left_anti").join(of.select(F.col("id").alias("id_x"), F.col("l").alias("l_x")), "id_x").join(of.select(F.col("id").alias("id_y"), F.col("l").alias("l_y")), "id_y")
        left = checkpointed(left.where("l_x <> l_y").select("id_x", "id_y", "apart"))
        if left.isEmpty():
            return label
    return _joined(label, found(left.select("id_x", "id_y")))


def similar(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """One row for each of df's: key, n_shingles, component_id."""
    own = own_texts(df, key, text)
    digest = checkpointed(map_text(own.select("doc_id", "text_hash", "text"), _digest(n), _DIGEST, drop=["text"]))
    label = links(own, digest, percent, n)
    classes = digest.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least")).join(label.select(F.col("node").alias("cls"), "label"), "cls", "left").select("cls", "least", F.coalesce("label", "cls").alias("label"))
    of_class = classes.join(classes.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("cls", "component_id")
    joined = digest.select("doc_id", "n", "cls").join(of_class, "cls", "left")
    return joined.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
