"""MinHash near-dedup by an LSH forest, links confirmed on full shingle sets.

1. A pass over whole texts gives the set of distinct five-word shingles (64-bit hashes), its size, a 128-bit hash of
   the set, and a signature of ``HASHES`` one-byte MinHash values. Documents with equal sets form a class.
2. Each of ``TREES`` trees sorts the classes by the signature, read from another place on. In the sorted order a class
   meets its region: the rows that share its prefix, at the least depth at which no more than ``REACH`` rows share it.
   Depth so grows where signatures crowd and is small where they don't. A row whose prefix soon is its own amid a crowd
   also meets its longest-common-prefix neighbours, the ``REACH`` rows to either side, of which the ``BEST`` likeliest
   become candidates. Ranges of the order are handled apart, and what lies at their ends meets in a second small pass.
3. Pairs whose signatures agree in fewer than ``AGREE`` places are dropped (a pair at the threshold falls below with a
   chance of about 1e-6). Of the others, each class first confirms its likeliest link; pairs that these links already join
   are settled, and all the rest are confirmed too. To confirm is to build both full sets again from whole texts.
4. A region is crowded if more rows than it may hold share as many first values as tell that number of classes apart
   (``crowd_depth``). For the classes of crowded regions the links between the components so far are found without a cap
   (``across``): an index on the prefixes of the sets, in which any pair at the threshold must meet. Signatures are compared
   where the pair meets, before it is written anywhere.
5. Connected components by alternating stars, over what the components so far leave open.

So a crowd of m near copies gives at most ``TREES * (REACH + 2 * BEST)`` pairs for each in 2, not m * m; 4 has no pair inside
a component, and of those across only the ones that share a shingle of both prefixes.

Defined cases: a null text, or one without words, has no shingles and is linked with nothing; fewer than five words
count as one shingle; a null doc_id counts as no smallest id (a component of null ids only has a null id); rows that
are repeated, or have one key and different texts, are joined to their texts by key and text, so they stay in proportion; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frames import checkpointed, fresh, map_text, row_key, shuffle_partitions
from ._text import Words, mix64, ngram_hashes, ngram_starts, slices, text_buffers, _splitmix
from .components import components

SHINGLE = 5
PERCENT = 85
HASHES = 64
TREES = 16
REACH = 32
BEST = 4
AGREE = 39
LOOKUP = 300_000
BLOCK = 512

_A = (_splitmix(HASHES, 101) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (_splitmix(HASHES, 202) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(raw: np.ndarray, off: np.ndarray, n: int = SHINGLE):
    """Sorted distinct shingle hashes of each text, as flat values and offsets."""
    words = Words(raw, off)
    w = words.hashes(fold=True)
    at, counts = ngram_starts(words.first, n)
    grams = ngram_hashes(w, n)[at] if len(at) else np.zeros(0, np.uint64)
    few = np.flatnonzero((words.counts > 0) & (words.counts < n))
    doc = np.repeat(np.arange(len(counts)), counts)
    if len(few):  # the whole sequence as one shingle
        extra = np.zeros(len(few), np.uint64)
        for k in range(1, n):
            some = words.counts[few] == k
            if some.any():
                extra[some] = ngram_hashes(w, k)[words.first[few[some]]]
        grams, doc = np.concatenate([grams, mix64(extra + np.uint64(1))]), np.concatenate([doc, few])
        back = np.argsort(doc, kind="stable")
        grams, doc = grams[back], doc[back]
    first = np.searchsorted(doc, np.arange(len(off)))
    values, sizes = [], np.zeros(len(off) - 1, np.int64)
    for i in range(len(off) - 1):
        if first[i] < first[i + 1]:
            s = np.sort(grams[first[i] : first[i + 1]])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s
            values.append(s)
            sizes[i] = len(s)
    return (np.concatenate(values) if values else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def signature(values: np.ndarray) -> np.ndarray:
    """HASHES one-byte MinHash values of one set."""
    low = (values >> np.uint64(32)).astype(np.uint32)
    least = np.empty(HASHES, np.uint32)
    for k in range(HASHES):
        least[k] = (low * _A[k] + _B[k]).min()
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def _digest(column: pa.Array) -> list[pa.Array]:
    raw, off = text_buffers(column)
    sizes, prints, marks = [], [], []
    for i, j in slices(off):
        values, first = shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i])
        other = mix64(values + np.uint64(0x632BE59BD9B4E019))
        for k in range(j - i):
            own = values[first[k] : first[k + 1]]
            sizes.append(len(own))
            if len(own):
                mark = signature(own).tobytes()
                marks.append(mark)
                with np.errstate(over="ignore"):
                    prints.append(int(own.sum()).to_bytes(8, "big") + int(other[first[k] : first[k + 1]].sum()).to_bytes(8, "big"))
            else:
                marks.append(None)
                prints.append(None)
    return [pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(marks, pa.binary())]


_DIGEST = [T.StructField("n_shingles", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("mark", T.BinaryType())]


def digests(df: DataFrame, text: str = "text", keep: list[str] = ()) -> DataFrame:
    """keep, n_shingles, cls (hash of the set), mark (signature) for each row of df."""
    return map_text(df.select(*keep, F.col(text).alias("text")), _digest, _DIGEST, drop=["text"])


def crowd_depth(classes: int) -> int:
    """How many one-byte values tell so many classes apart, 3 at least."""
    return max(3, -(-max(classes, 1).bit_length() // 8))


def _pairs(keys: np.ndarray, ids: np.ndarray, heads: int | None = None, reach: int = REACH, agree: int = AGREE, best: int = BEST) -> pd.DataFrame:
    """Candidate links among sorted rows of one tree. heads: only pairs that cross from before that row to it or later."""
    n = len(ids)
    none = pd.DataFrame({"a": [], "b": [], "agree": []})
    if n < 2:
        return none
    lcp = np.full(n, 0, np.int64)  # with the row before
    differ = keys[1:] != keys[:-1]
    lcp[1:] = np.where(differ.any(1), differ.argmax(1), HASHES)
    #: depth: the least d at which the run of rows that share d values with row i has at most ``reach`` rows.
    depth = np.full(n, HASHES, np.int64)
    open_ = np.ones(n, bool)
    for d in range(1, HASHES):
        run = np.cumsum(lcp < d)
        size = np.bincount(run)[run]
        now = open_ & (size <= reach)
        depth[now] = d
        open_ &= ~now
        if not open_.any():
            break
    reach = min(reach, n - 1)
    like = np.zeros((n, 2 * reach), np.uint8)  # agreement with the s-th row after, and before
    whole = np.zeros((n, reach), bool)  # both in one region
    shared = np.full(n, HASHES, np.int64)
    for s in range(1, reach + 1):
        shared = np.minimum(shared[: n - s], lcp[s:])
        i = np.flatnonzero(shared >= 1)
        if not len(i):
            break
        if heads is not None:
            i = i[(i < heads) & (i + s >= heads)]
        for k in range(0, len(i), 50_000):
            some = i[k : k + 50_000]
            same = (keys[some] == keys[some + s]).sum(1)
            same[same < agree] = 0
            like[some, s - 1] = same
            like[some + s, reach + s - 1] = same
            whole[some, s - 1] = (shared[some] >= np.minimum(depth[some], depth[some + s])) & (same > 0)
    row, col = np.nonzero(whole)
    out_a, out_b, out_n = [row], [row + col + 1], [like[row, col]]
    for _ in range(best):
        top = like.argmax(1)
        row = np.flatnonzero(like[np.arange(n), top])
        if not len(row):
            break
        col = top[row]
        out_a.append(row)
        out_b.append(np.where(col < reach, row + col + 1, row - (col - reach) - 1))
        out_n.append(like[row, col])
        like[row, col] = 0
    a, b, m = np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_n)
    if not len(a):
        return none
    a, b, m = np.minimum(a, b), np.maximum(a, b), m
    _, once = np.unique(a.astype(np.int64) * n + b, return_index=True)
    a, b, m = ids[a[once]], ids[b[once]], m[once]
    swap = a > b
    return pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b), "agree": m})


def _crowded(keys: np.ndarray, depth: int) -> np.ndarray:
    """Flags of sorted rows whose first ``depth`` values more rows share than a region surely holds (half of REACH: a run may lie across two ranges)."""
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:, :depth] != keys[:-1, :depth]).any(1)
    run = np.cumsum(new)
    return np.bincount(run)[run] > REACH // 2


_CHUNK = 100_000


def _walk(batches, depth: int):
    """Candidates inside one sorted range, its rows in crowded regions, and the rows at its ends."""
    part = TaskContext.get().partitionId()
    held: pd.DataFrame | None = None

    def links(pdf):
        for tree, own in pdf.groupby("tree", sort=False):
            keys = np.frombuffer(b"".join(own["key"]), np.uint8).reshape(-1, HASHES)
            found = _pairs(keys, own["cls"].to_numpy(), None)
            if len(found):
                yield found.drop_duplicates(["a", "b"]).assign(part=None, tree=None, key=None, side=None)
            crowd = own["cls"][_crowded(keys, depth)]
            if len(crowd):
                yield pd.DataFrame({"a": crowd, "b": None, "agree": 0, "part": part, "tree": tree, "key": None, "side": "crowd"})

    def ends(pdf, side):
        return pd.DataFrame({"a": pdf["cls"], "b": None, "agree": 0, "part": part, "tree": pdf["tree"], "key": pdf["key"], "side": side})

    for pdf in batches:
        for i in range(0, len(pdf), _CHUNK):
            piece = pdf.iloc[i : i + _CHUNK]
            if held is None:
                yield ends(piece.head(REACH), "head")
                missing = REACH - len(piece)
            elif missing > 0:
                yield ends(piece.head(missing), "head")
                missing -= len(piece)
            joined = piece if held is None else pd.concat([held, piece], ignore_index=True)
            yield from links(joined)
            held = joined.tail(2 * REACH)
    if held is not None:
        yield ends(held.tail(REACH), "tail")


_WALK = "a binary, b binary, agree int, part int, tree int, key binary, side string"


def _seams(key, pdf):
    """Links across the end of a range: its last rows and the first of the next."""
    pdf = pdf.assign(order=(pdf["side"] == "head").astype(int)).sort_values(["order", "tree", "key", "a"])
    out = []
    for _, own in pdf.groupby("tree", sort=False):
        keys = np.frombuffer(b"".join(own["key"]), np.uint8).reshape(-1, HASHES)
        found = _pairs(keys, own["a"].to_numpy(), int((own["order"] == 0).sum()))
        out.append(found)
    return pd.concat(out)[["a", "b", "agree"]] if out else pd.DataFrame({"a": [], "b": [], "agree": []})


def candidates(classes: DataFrame) -> DataFrame:
    """classes: cls, mark. Returns a < b, agree: pairs of classes that meet in a tree."""
    return _met(classes)[0]


def _met(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The candidates, and cls of the classes that lie in a crowded region of any tree."""
    spark = classes.sparkSession
    depth = crowd_depth(classes.count())
    step = HASHES // TREES
    turned = F.transform(F.array(*[F.lit(t) for t in range(TREES)]), lambda t: F.struct(t.alias("tree"), F.concat(F.expr("mark").substr(t * step + 1, F.lit(HASHES)), F.expr("mark").substr(F.lit(1), t * step)).alias("key")))
    rows = classes.select("cls", F.inline(turned))
    n = shuffle_partitions(spark)
    walked = checkpointed(rows.repartitionByRange(n, "tree", "key", "cls").sortWithinPartitions("tree", "key", "cls").mapInPandas(lambda batches: _walk(batches, depth), _WALK))
    inner = walked.where("side is null").select("a", "b", "agree")
    ends = walked.where("side in ('head', 'tail')")
    #: The range that follows in the order, among those that have rows; one row for each range.
    parts = ends.select("part").distinct().select(F.col("part").alias("head_of"), F.lag("part").over(_by_part()).alias("seam"))
    seams = ends.where("side = 'tail'").withColumn("seam", F.col("part")).unionByName(ends.where("side = 'head'").join(parts, F.col("part") == F.col("head_of")).drop("head_of").where("seam is not null"))
    across = seams.groupBy("seam").applyInPandas(_seams, "a binary, b binary, agree int")
    return inner.union(across).groupBy("a", "b").agg(F.max("agree").alias("agree")), walked.where("side = 'crowd'").select(F.col("a").alias("cls")).distinct()


def _by_part():
    return Window.orderBy("part")


def _confirm(percent: int, n: int = SHINGLE):
    def run(batches):
        cache: dict[bytes, np.ndarray] = {}

        def sets(texts, names):
            new = [i for i, c in enumerate(names) if c not in cache]
            for at in range(0, len(new), 200):
                some = new[at : at + 200]
                raw, off = text_buffers(pa.array([texts[i] for i in some], pa.large_string()))
                values, first = shingle_sets(raw, off, n)
                for k, i in enumerate(some):
                    cache[names[i]] = values[first[k] : first[k + 1]]

        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                a, b = list(map(bytes, part["a"])), list(map(bytes, part["b"]))
                sets(part["text_a"].tolist(), a)
                sets(part["text_b"].tolist(), b)
                keep = []
                for x, y in zip(a, b):
                    s, t = cache[x], cache[y]
                    small, large = (s, t) if len(s) <= len(t) else (t, s)
                    if 100 * len(small) < percent * len(large):
                        keep.append(False)
                        continue
                    at_ = np.searchsorted(large, small)
                    at_[at_ == len(large)] = 0
                    both = int((large[at_] == small).sum())
                    keep.append(100 * both >= percent * (len(s) + len(t) - both))
                yield part.loc[keep, ["a", "b"]]
                if sum(map(len, cache.values())) > 8_000_000:
                    cache.clear()

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) whose full sets are alike; texts: cls, text, a row for each class."""
    with_a = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
    with_both = with_a.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return with_both.mapInPandas(_confirm(percent, n), "a binary, b binary")


def own_texts(df: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """doc_id, text, a hash of the text, and more of df's columns."""
    body = F.col(f"`{text}`").cast("string")
    return df.select(F.col(f"`{key}`").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("text_hash"), *more)


def _joined(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components (node, label) after more links; those so far are stars already."""
    if label is None:
        return components(links)
    if links.isEmpty():
        return label
    return components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a <> b").union(links.select("a", "b")))


def _by_label(label: DataFrame) -> DataFrame:
    """The labels for a lookup: broadcast up to LOOKUP nodes (about 20 MB), else joined by shuffle."""
    return F.broadcast(label) if label.count() <= LOOKUP else label


def labels(own: DataFrame, digest: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node, label: the component of each class of equal sets that is linked with another. own: doc_id, text, text_hash;
    digest: those keys, cls, mark and n_shingles, a row for each of own's."""
    classes = digest.where("cls is not null").groupBy("cls").agg(F.first("mark").alias("mark"), F.min(F.struct("doc_id", "text_hash")).alias("of"))
    classes = checkpointed(classes)
    found, crowd = _met(classes.select("cls", "mark"))
    found, crowd = checkpointed(found), checkpointed(crowd)
    #: A text for each class that has a candidate or lies in a crowd: that of its least row.
    busy = found.select(F.col("a").alias("cls")).union(found.select(F.col("b").alias("cls"))).union(crowd).distinct()
    want = classes.select("cls", "mark", F.col("of.doc_id").alias("of_key"), F.col("of.text_hash").alias("text_hash")).join(busy, "cls", "left_semi")
    texts = own.join(want, (F.col("of_key").eqNullSafe(F.col("doc_id"))) & (own["text_hash"] == want["text_hash"])).groupBy("cls").agg(F.first("text").alias("text"), F.first("mark").alias("mark"))
    texts = checkpointed(texts)
    bodies = texts.select("cls", "text")
    #: First each class with its likeliest partner, then every pair that isn't joined yet.
    ends = found.select(F.col("a").alias("x"), F.col("b").alias("y"), "agree").union(found.select(F.col("b").alias("x"), F.col("a").alias("y"), "agree"))
    best = ends.groupBy("x").agg(F.max(F.struct("agree", "y")).alias("m")).select(F.least("x", "m.y").alias("a"), F.greatest("x", "m.y").alias("b")).distinct()
    label = _joined(None, confirmed(best, bodies, percent))
    named = _by_label(label)
    left = found.join(named.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(named.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    rest = left.where("la is null or lb is null or la <> lb").select("a", "b").join(best, ["a", "b"], "left_anti")
    label = _joined(label, checkpointed(confirmed(rest, bodies, percent)))
    if crowd.isEmpty():
        return label
    more = across(texts.join(crowd, "cls", "left_semi"), label, percent).join(found.select("a", "b"), ["a", "b"], "left_anti")
    return _joined(label, checkpointed(confirmed(more, bodies, percent)))


def _whole(column: pa.Array) -> list[pa.Array]:
    """The size and the shingles of each text's set."""
    raw, off = text_buffers(column)
    parts = [shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in slices(off)]
    sizes = np.concatenate([[0], *[np.diff(first) for _, first in parts]])
    values = np.concatenate([v for v, _ in parts]) if parts else np.zeros(0, np.uint64)
    return [pa.array(sizes[1:], pa.int64()), pa.LargeListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int64()), pa.array(values.view(np.int64))).cast(pa.list_(pa.int64()))]


def _lanes(mark: str) -> Column:
    """A signature as longs of eight values each."""
    return F.array(*[F.conv(F.hex(F.expr(f"substring({mark}, {8 * k + 1}, 7)")), 16, 10).cast("long").bitwiseXOR(F.shiftleft(F.conv(F.hex(F.expr(f"substring({mark}, {8 * k + 8}, 1)")), 16, 10).cast("long"), 56)) for k in range(HASHES // 8)])


def _alike(x: str, y: str) -> Column:
    """Whether two signatures, as longs, agree in ``AGREE`` values: of their difference, the bytes that are not 0 are counted."""
    differ = F.lit(0)
    for k in range(HASHES // 8):
        d = F.col(x)[k].bitwiseXOR(F.col(y)[k])
        for shift in (4, 2, 1):
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
        differ = differ + F.bit_count(d.bitwiseAND(F.lit(0x0101010101010101)))
    return F.lit(HASHES) - differ >= AGREE


def across(texts: DataFrame, label: DataFrame, percent: int = PERCENT) -> DataFrame:
    """texts: cls, text, mark, distinct; label: node, label. Pairs (a, b) of classes in two components among which every pair at the threshold is.

    Sets of n and more shingles that are alike share one of the first n - ceil(percent * n / 100) + 1 of each, in any order
    that is the same for all. The order here: shingles of one component only, then the others from rare to common. So shingles
    that tell a component from the rest fill the prefixes, and they make no pair."""
    fields = [T.StructField("n", T.LongType()), T.StructField("all", T.ArrayType(T.LongType()))]
    named = texts.select("cls", "text", _lanes("mark").alias("lanes")).join(_by_label(label).select(F.col("node").alias("cls"), "label"), "cls", "left").select(F.xxhash64("cls").alias("id"), F.xxhash64(F.coalesce("label", "cls")).alias("l"), "lanes", "text")
    sets = checkpointed(map_text(named, _whole, fields, drop=["text"]))
    rows = sets.select("id", "l", "n", F.explode("all").alias("s"))
    several = rows.groupBy("s").agg(F.count(F.lit(1)).alias("held"), F.min("l").alias("l0"), F.max("l").alias("l1")).where("l0 <> l1").select("s", "held")
    of_class = Window.partitionBy("id")
    ranked = rows.join(several, "s").withColumn("place", F.row_number().over(of_class.orderBy("held", "s")) + F.col("n") - F.count(F.lit(1)).over(of_class))
    first = ranked.where(f"place <= n - (n * {percent} + 99) div 100 + 1").select("id", "l", "n", "s", "place")
    #: A shingle that many prefixes hold is met by blocks: one side is cut in blocks of about BLOCK rows, the other is in all of them.
    blocks = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("s")) / BLOCK).cast("int")
    first = checkpointed(first.join(sets.select("id", "lanes"), "id").withColumn("blocks", blocks))
    cells = [F.col(c) for c in ("id", "l", "n", "place", "lanes")]
    x = first.select("s", F.pmod(F.col("id"), F.col("blocks")).cast("int").alias("block"), *[c.alias(f"{n}_x") for c, n in zip(cells, ("id", "l", "n", "place", "lanes"))])
    y = first.select("s", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *[c.alias(f"{n}_y") for c, n in zip(cells, ("id", "l", "n", "place", "lanes"))])
    #: The first shingle that both have leaves room for the common ones that the pair needs.
    need = f"{percent} * (n_x + n_y)"
    met = x.join(y, ["s", "block"]).where("l_x < l_y").where(f"{100 + percent} * (n_x - place_x + 1) >= {need} and {100 + percent} * (n_y - place_y + 1) >= {need}").where(_alike("lanes_x", "lanes_y"))
    pairs = met.select("id_x", "id_y").distinct()
    ids = texts.select(F.xxhash64("cls").alias("id"), "cls")
    both = pairs.join(ids.select(F.col("id").alias("id_x"), F.col("cls").alias("x")), "id_x").join(ids.select(F.col("id").alias("id_y"), F.col("cls").alias("y")), "id_y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row for each of df's: key, n_shingles, component_id, kept, and cls."""
    own = own_texts(df, key, text)
    digest = checkpointed(digests(own, "text", ["doc_id", "text_hash"]))
    label = labels(own, digest, percent)
    classes = digest.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    named = classes.join(label.select(F.col("node").alias("cls"), "label"), "cls", "left").select("cls", "least", F.coalesce("label", "cls").alias("label"))
    of_label = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = named.join(of_label, "label").select("cls", "component_id")
    joined = digest.drop("mark").join(of_class, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select(F.col("doc_id").alias(key), "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "cls")


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """df without near copies: of each component one row, that of the least key; rows without words all stay."""
    h1, h2, n = fresh(df, "h1", "h2", "n_shingles")
    own = own_texts(df, key, text, row_key(df, 1).alias("h1"), row_key(df, 2).alias("h2"))
    digest = checkpointed(digests(own, "text", ["doc_id", "text_hash", "h1", "h2"]))
    label = labels(own, digest, percent)
    marked = digest.where("cls is not null").join(label.select(F.col("node").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    best = marked.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h1", "h2")).alias("m")).select(F.col("m.h1").alias(h1), F.col("m.h2").alias(h2), F.lit(True).alias(n))
    bare = digest.where("cls is null").select(F.col("h1").alias(h1), F.col("h2").alias(h2), F.lit(False).alias(n)).distinct()
    keep = best.union(bare)
    rows = df.withColumn(h1, row_key(df, 1)).withColumn(h2, row_key(df, 2)).join(keep, [h1, h2])
    columns = [f"`{c}`" for c in df.columns]
    one = rows.where(n).groupBy(h1, h2).agg(*[F.first(c).alias(name) for c, name in zip(columns, df.columns)])
    return one.select(*columns).union(rows.where(f"not `{n}`").select(*columns))
