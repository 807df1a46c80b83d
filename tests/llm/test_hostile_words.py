"""Words that a polynomial hash modulo 2^64 can't tell apart: Thue-Morse words and their complements."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import language_id, lm_scoring, lsh_forest, packing, quality_ledger, spotsigs
from frameloom.llm import _text

SIZES = (512, 1024, 2048, 4096, 8192)
PAIRS = ("ab", "xz", "09")


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


def _words():
    return [thue_morse(n, p[::turn]) for n in SIZES for p in PAIRS for turn in (1, -1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, w) for i, w in enumerate(_words())], "doc_id long, text string").coalesce(1)


def test_hashes():
    raw = np.frombuffer(" ".join(_words()).encode(), np.uint8)
    w = _text.Words(raw, np.array([0, len(raw)]))
    assert len(set(w.hashes().tolist())) == len(_words())


def test_near_duplicates(docs):
    got = lsh_forest.near_duplicates(docs).collect()
    assert len({bytes(r["cls"]) for r in got}) == len(_words()) and all(r["kept"] for r in got)


def test_packing(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    tokenizer.encode_special_tokens = True
    pieces = collections.defaultdict(dict)
    for r in packing.pieces(docs).collect():
        pieces[r["row_key"]][r["start"]] = r["ids_crc32"]
    for i, w in enumerate(_words()):
        ids = np.array([*tokenizer.encode(w, add_special_tokens=False).ids, 0], "<u4")
        assert pieces[i] == {k: zlib.crc32(ids[k : k + 1024].tobytes()) for k in range(0, len(ids), 1024)}


def test_fingerprints(docs):
    lines = docs.select("doc_id", F.concat(F.lit("the "), "text", F.lit(" a "), "text", F.lit(" of "), "text").alias("text"))
    got = spotsigs.fingerprint_with_next(lines).collect()
    assert len({r["fingerprint"] for r in got}) == len(_words()) and max(r["near_next"] for r in got) < 1


def test_language_memo():
    model = language_id.Model(["a", "b"], 8, 1)
    raw = np.frombuffer(" ".join(_words()).encode(), np.uint8)
    starts, ends, _ = language_id.stretches(_text.Words(raw, np.array([0, len(raw)])))
    assert np.allclose(language_id._Memo(model).of(raw, starts, ends), model.pooled(raw, starts, ends), atol=1e-5)


def test_quality(spark):
    text = "\n".join(_words())
    row = quality_ledger.ledger(spark.createDataFrame([(1, text), (2, text + "\n" + _words()[7])], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["n_dup_lines"] for r in row] == [0, 1] and [r["n_repeat_words"] for r in row] == [0, 0]


def test_lm_counts(docs):
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, F.col("doc_id") % 2 == 0).collect()}
    n, v = 2 * len(_words()) // 2, len(_words()) // 2 + 1
    for i in range(len(_words())):
        known = i % 2 == 0
        base = math.log10((1 + known) / (n + 1 * (v + 1))) + math.log10((v - 1 + 1) / (n + 1 * (v + 1)))
        assert got[i]["n_known"] == 1 + known and math.isclose(got[i]["base_score"], base, rel_tol=1e-6)
