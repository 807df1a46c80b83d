"""The n-gram join against all pairs, and its parts."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from frameloom.llm import _prefix, lsh_forest, ngram_join

SCHEMA = "doc_id long, text string, cls string, n long, part string, label int"


def _texts():
    rng = random.Random(21)
    vocab = [f"w{i}" for i in range(500)]
    body = lambda n: [rng.choice(vocab) for _ in range(n)]
    out = []
    for n in [*range(1, 45), 60, 120]:  # small sets and their edits, on either side of every boundary
        base = body(n)
        out += [base, base[:-1], base + body(1), base + body(2), base[1:]]
        for _ in range(4):
            w = list(base)
            w[rng.randrange(n)] = rng.choice(vocab)
            out.append(w)
    crowd = body(150)
    for _ in range(60):  # pairs around the threshold
        w = list(crowd)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(w)
    passage = body(60)
    out += [body(30) + passage + body(rng.randint(1, 80)) for _ in range(25)]
    low = ["x", "y"]
    out += [[rng.choice(low) for _ in range(rng.randint(3, 12))] for _ in range(60)]  # many equal and nearly equal small sets
    rng.shuffle(out)
    return [" ".join(w) for w in out] + ["", "  \n", "One TWO three", "one two THREE", "a b c d", "A B c d e"]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "c", 1, "p", 0) for i, t in enumerate(_texts())]
    return [*out, out[3], out[3], (5_000, out[7][1], None, None, None, None), (3, out[9][1], "", 0, "", 0), (5_001, None, "", 0, "", 0), (None, "a lone text without any key at all " * 3, "", 0, "", 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def _set(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))) if w else frozenset()


def _truth(rows, percent, n=4):
    sets = [_set(t, n) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (key, *_) in enumerate(rows):
        r = root(i)
        least[r] = key if r not in least else min((k for k in (least[r], key) if k is not None), default=None)
    return sorted(((key, len(s), key if not s else least[root(i)]) for i, ((key, *_), s) in enumerate(zip(rows, sets))), key=str)


@pytest.mark.parametrize("percent,n", [(85, 4), (70, 3)])
def test_components(docs, rows, percent, n):
    assert sorted(map(tuple, ngram_join.similar(docs, percent=percent, n=n).collect()), key=str) == _truth(rows, percent, n)


@pytest.mark.parametrize("light,block", [(1, 3), (12, 512)])
def test_components_at_other_boundaries(docs, rows, light, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "boundary", lambda *_: light)
    monkeypatch.setattr(_prefix, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "LOOKUP", 0)
    assert sorted(map(tuple, ngram_join.similar(docs).collect()), key=str) == _truth(rows, 85)


def test_every_link_without_the_first_round(docs, rows, monkeypatch):
    """Lists alone find all: pivots only make them shorter."""
    monkeypatch.setattr(ngram_join, "TURNS", 0)
    assert sorted(map(tuple, ngram_join.similar(docs).collect()), key=str) == _truth(rows, 85)


@pytest.mark.parametrize("pairs", [0, 1])
def test_every_link_in_other_turns(docs, rows, pairs, monkeypatch):
    monkeypatch.setattr(ngram_join, "TURNS", 0)
    monkeypatch.setattr(ngram_join, "PAIR_TURNS", pairs)
    assert sorted(map(tuple, ngram_join.similar(docs).collect()), key=str) == _truth(rows, 85)


def test_a_crowd_is_confirmed_by_a_few_pairs_a_set(spark, monkeypatch):
    """A crowd that no pivot has joined has as many pairs as the square of its sets; a few for each set are confirmed."""
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(500)]
    crowd = [rng.choice(vocab) for _ in range(150)]
    rows = []
    for i in range(120):
        w = list(crowd)
        for _ in range(rng.randint(1, 2)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    seen, real = [], ngram_join.confirmed

    def counted(pairs, *more):
        seen.append(pairs.count())
        return real(pairs, *more)

    monkeypatch.setattr(ngram_join, "confirmed", counted)
    monkeypatch.setattr(ngram_join, "TURNS", 0)
    got = ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == _truth(rows, 85) and {r[2] for r in got} == {0}
    assert sum(seen) <= 6 * len(rows)


def test_a_crowd_meets_few_pairs_in_lists(spark, monkeypatch):
    """Neighbours in sorted lists join a crowd before all its pairs meet: the join of the lists doesn't grow with the square."""
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(500)]
    crowd = [rng.choice(vocab) for _ in range(150)]
    rows = []
    for i in range(160):
        w = list(crowd)
        for _ in range(rng.randint(1, 2)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    seen, real = [], ngram_join.pairs_of

    def counted(*given):
        out = real(*given)
        seen.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "pairs_of", counted)
    monkeypatch.setattr(ngram_join, "TURNS", 0)
    got = ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == _truth(rows, 85) and {r[2] for r in got} == {0}
    assert sum(seen) <= 2 * len(rows)


@pytest.mark.parametrize("pairs", [0, 2])
def test_every_link_without_neighbours(docs, rows, pairs, monkeypatch):
    monkeypatch.setattr(ngram_join, "TURNS", 0)
    monkeypatch.setattr(ngram_join, "LIST_TURNS", 0)
    monkeypatch.setattr(ngram_join, "PAIR_TURNS", pairs)
    assert sorted(map(tuple, ngram_join.similar(docs).collect()), key=str) == _truth(rows, 85)


def test_neighbours_over_batches():
    """However rows are cut in batches, a row meets those before it in its list, of other components and near enough."""
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(100)]
    sets = [sorted({*rng.sample(base, 100 - i % 12), *(rng.getrandbits(64) for _ in range(i % 5))}) for i in range(40)]
    maps = [ngram_join.parity_map(np.array(s, np.uint64)).tolist() for s in sets]
    rows = [(i // 9, i % 3, i, len(s), m) for i, (s, m) in enumerate(zip(sets, maps))]

    def met(size):
        fields = [("s", pa.int64()), ("l", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("map", pa.list_(pa.int64()))]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows[at : at + size]), fields)], names=[f for f, _ in fields]) for at in range(0, len(rows), size)]
        return [tuple(r.values()) for b in ngram_join._before(85)(batches) for r in b.to_pylist()]

    whole = met(len(rows))
    assert whole and all(met(size) == whole for size in (1, 3, 7))
    bits = lambda i, j: sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(maps[i], maps[j]))
    for i, j, apart in whole:
        assert i - ngram_join.REACH <= j < i and i // 9 == j // 9 and i % 3 != j % 3
        both = len(sets[i]) + len(sets[j])
        assert apart == bits(i, j) - (both - 2 * -(-85 * both // 185)) <= 0


def test_parity_maps_bound_the_difference():
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(400)]
    for _ in range(200):
        x, y = (set(rng.sample(values, rng.randint(1, 400))) for _ in range(2))
        maps = [ngram_join.parity_map(np.array(sorted(s), np.uint64)).view(np.uint64).tolist() for s in (x, y)]
        assert sum((a ^ b).bit_count() for a, b in zip(*maps)) <= len(x ^ y)


def test_subset_sizes():
    for n in range(1, 21):
        for m in range(1, 30):
            if 100 * min(n, m) >= 85 * max(n, m):
                c = next(c for c in range(0, n + m) if 100 * c >= 85 * (n + m - c))
                assert ngram_join.shared_needed(n, m) == c and (c > min(n, m) or c in ngram_join.subset_sizes(n))


def test_boundary_follows_the_cost():
    assert ngram_join.boundary({}, 0) == 1
    assert ngram_join.boundary({5: 1_000}, 10) == 6
    assert ngram_join.boundary({5: 10, 20: 1_000}, 10) <= 20


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ngram_join.similar(empty).collect() == []
    assert [tuple(r) for r in ngram_join.similar(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 1)]
