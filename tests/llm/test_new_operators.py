"""Spelling variants and importance resampling against brute force, and their defined cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import importance, spelling
from frameloom.llm import _text

SCHEMA = "doc_id long, text string, word string, n long, score long, rank string"
FOLD = {c: c + 32 for c in range(65, 91)}


def _texts():
    rng = random.Random(11)
    stems = ["".join(rng.choice("aábcÀ×") for _ in range(rng.randint(3, 9))) for _ in range(60)] + ["W" * 70, "W" * 71, "abc" * 30, "x" + "abc" * 30]
    out = []
    for _ in range(150):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(stems)
            if rng.random() < 0.4 and w:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", rng.choice("abÀ"), w[k] + rng.choice("abc")]) + w[k + 1 :]
            words.append(w)
        out.append(rng.choice([" ", "-", ", ", "9", "\n"]).join(words))
    return [*out, None, "", "   ", "ＡＢＣＤＥＦ ãöü 日本語テキスト", "ĀāĂăĄą", "Straße STRASSE straße", "abcab " * 20_000, "z" * 300_000, "qwert " * 3 + "qwerty " * 7 + "qwertyu " * 20 + "qwertyui " * 50]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "w", 1, 2, "r") for i, t in enumerate(_texts())]
    return [*out, out[3], out[3], (3, out[5][1], None, None, None, None), (None, "abcab abcab " + (out[4][1] or ""), "", 0, 0, "")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_crc_of_spans():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 256, 5_000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 4_000, 400))
    ends = starts + rng.integers(0, 990, 400)
    before = rng.integers(0, 1 << 32, 400).astype(np.uint32)
    want = [zlib.crc32(raw[s:e].tobytes(), int(b)) for s, e, b in zip(starts, ends, before)]
    assert _text.span_crc32(raw, starts, ends, before).tolist() == want
    assert _text.span_crc32(raw, starts, ends).tolist() == [zlib.crc32(raw[s:e].tobytes()) for s, e in zip(starts, ends)]


def _vocabulary(rows, least):
    n = collections.Counter()
    for key, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 5:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= least}


def _one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else (a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :])


@pytest.mark.parametrize("block", [3, 20_000])
def test_spelling(docs, rows, block, monkeypatch):
    monkeypatch.setattr(spelling.neighbours, "__defaults__", (block,))
    n = _vocabulary(rows, 3)
    want = {}
    for w in n:
        near = [u for u in n if _one_edit(w, u)]
        best = min(near, key=lambda u: (-n[u], u), default=None)
        want[w] = (best if near and n[best] >= 2 * n[w] else None, len(near))
    got = spelling.variants(docs).collect()
    assert len(got) == len(n) and any(r["form"] for r in got) and any(r["root"] != r["form"] and r["form"] for r in got)
    for r in got:
        root = r["word"]
        while want[root][0]:
            root = want[root][0]
        assert (r["form"], r["n_near"]) == want[r["word"]] and r["root"] == root and r["n"] == n[r["word"]] and r["form_n"] == (n[r["form"]] if r["form"] else None)


def test_spelling_hands_on_counts(docs, rows, monkeypatch):
    counts = spelling._Counts()
    monkeypatch.setattr(spelling, "HELD", 5)
    low = np.frombuffer(b"aaaaa bbbbb aaaaa ccccc ddddd eeeee fffff", np.uint8)
    w = _text.Words(low, np.array([0, len(low)]))
    counts.add(low, w.starts, w.ends)
    assert counts.full() and dict(zip(*counts.rows().to_pydict().values())) == {"aaaaa": 2, "bbbbb": 1, "ccccc": 1, "ddddd": 1, "eeeee": 1, "fffff": 1}


def test_spelling_of_nothing(empty):
    assert spelling.variants(empty).collect() == []


def _features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("longest,percent", [(1, 10), (2, 35), (1, 100)])
def test_importance(spark, docs, rows, longest, percent):
    goal = ["abcab wwww", None, "", "straße 42 日本語テキスト " * 5]
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = collections.Counter(), collections.Counter()
    for _, text, *_ in rows:
        s.update(map(bucket, _features(text, longest)[1]))
    for text in goal:
        t.update(map(bucket, _features(text, longest)[1]))
    big, small = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big + 10_000) / ((s[b] + 1) * (small + 10_000))))
    scored = []
    for key, text, *_ in rows:
        words, f = _features(text, longest)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        scored.append((key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20))
    able = sorted((x for x in scored if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = able[: len(able) * percent // 100]
    want = sorted([(*x[:4], i + 1) for i, x in enumerate(drawn)] + [(*x[:4], None) for x in able[len(drawn) :] + [x for x in scored if not x[4]]], key=str)
    target = spark.createDataFrame([(t, 1) for t in goal], "text string, doc_id int")
    got = importance.resample(docs, target, longest=longest, percent=percent).drop("n_words").collect()
    assert sorted(map(tuple, got), key=str) == want


@pytest.mark.parametrize("keys", ["small", "wide", "tied"])
def test_radix_selection(spark, keys):
    rng = random.Random(5)
    span = {"small": (0, 50), "wide": (-(1 << 63), (1 << 63) - 1), "tied": (7, 7)}[keys]
    values = [(rng.randint(*((-3, 3) if keys != "wide" else span)), rng.randint(*span)) for _ in range(700)]
    df = spark.createDataFrame(values, "a long, b long").cache()
    top = F.lit(importance._TOP)
    parts = [F.bitwise_not(F.col("a").bitwiseXOR(top)), F.col("b").bitwiseXOR(top)]
    order = sorted(values, key=lambda v: (-v[0], v[1]))
    for k in (1, 2, 69, 350, 699, 700):
        chosen = sorted(map(tuple, df.where(importance._upto(parts, importance.kth(df, parts, k))).collect()), key=lambda v: (-v[0], v[1]))
        assert len(chosen) >= k and chosen[:k] == order[:k] and all(v == order[k - 1] for v in chosen[k:])


def test_importance_of_nothing(spark, empty, docs):
    target = spark.createDataFrame([], "text string")
    assert importance.resample(empty, target).collect() == []
    got = importance.resample(docs.where("doc_id < 3"), target, least_words=10_000).collect()
    assert len(got) == 3 and all(r["rank"] is None for r in got)
