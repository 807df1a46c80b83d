"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger holds the measurements and one long in which bit i says that
rule i failed. A policy is a version name with the mask of the rules that reject, so a verdict is ``failed & mask = 0``,
and a new policy, or an ablation of one, needs no second look at the texts: ``ablation`` counts, from the ledger alone,
what each policy keeps, what each of its rules rejects, what it alone rejects, and what would be kept without it.

Defined cases: a null text has no words, like an empty one, and fails ``few_words``; ratios of a text without words are
0; lines and words are compared whole and as they are written; an empty table gives an empty ledger; columns of any
name stay in ``annotate`` and ``keep``, and the ledger's own columns give way to them (see ``fresh``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frames import fresh, map_text
from ._text import WORD_BYTE, Words, ngram_hashes, ngram_starts, segment_sum, slices, span_hashes, text_buffers

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_exclaims", "n_alpha_words", "n_abuse", "n_insults")

#: Abusive words that the rule ``abusive`` counts (lower case, whole words without edge punctuation).
ABUSE = ("scum", "idiot", "worthless", "pathetic")
#: The same for the rule ``toxic``: insults in the four languages of the corpus.
INSULTS = tuple(
    "scum idiot idiots idiotic worthless pathetic moron morons moronic stupid trash clown clowns loser losers disgusting dumb dumbass imbecile imbeciles "
    "cretin jerk bastard bastards bitch asshole assholes fuck fucking shit bullshit scumbag dirtbag lowlife vermin filth retard retarded slut whore "
    "idioten dummkopf vollidiot arschloch scheiße abschaum versager drecksau wichser hurensohn connard connasse salaud salope imbécile abruti ordure "
    "crétin débile merde idiota idiotas imbécil estúpido estúpida gilipollas cabrón mierda puta escoria basura".split()
)


@dataclass(frozen=True)
class Rule:
    """``fails``: a SQL condition over the measurements."""

    name: str
    fails: str


#: The place of a rule is its bit: new rules go to the end.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("shouting", "n_letters > 0 and 100 * n_upper > 50 * n_letters"),
    Rule("exclamations", "100 * n_exclaims > 30 * n_words"),
    Rule("few_letters", "100 * n_alpha_words < 50 * n_words"),
    Rule("long_words", "word_chars > 25 * n_words"),
    Rule("abusive", "100 * n_abuse > 1 * n_words"),
    Rule("toxic", "n_insults >= 2"),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
POLICIES = {
    "base": BASE,
    "web-1": BASE | BIT["symbols"] | BIT["duplicate_lines"],
    "web-2": BASE | BIT["symbols"] | BIT["duplicate_lines"] | BIT["shouting"] | BIT["exclamations"] | BIT["few_letters"] | BIT["long_words"],
    "web-3": BASE | BIT["symbols"] | BIT["duplicate_lines"] | BIT["shouting"] | BIT["exclamations"] | BIT["few_letters"] | BIT["long_words"] | BIT["toxic"],
    "mild-1": BASE | BIT["symbols"] | BIT["abusive"],
}
POLICY = "web-3"

_CONT = (np.arange(256) & 0xC0) == 0x80
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ASCII = _UPPER.copy()
_ASCII[97:123] = True
_LETTER = _ASCII | (np.arange(256) >= 0xC0)
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return segment_sum(flags, off)


def _word_hashes(words: tuple[str, ...]) -> np.ndarray:
    sizes = np.array([len(w.encode()) for w in words])
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum(sizes)
    return np.sort(span_hashes(raw, ends - sizes, ends, True))


def _dup_within(values: np.ndarray, doc: np.ndarray, n_docs: int, all_of_them: bool) -> np.ndarray:
    """Flags of values that occur in the same text before (or, with all_of_them, at any other place)."""
    order = np.lexsort((np.arange(len(values)), values, doc))
    v, d = values[order], doc[order]
    same = np.zeros(len(v), bool)
    same[1:] = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
    if all_of_them:
        same[:-1] |= same[1:].copy()
    out = np.zeros(len(v), bool)
    out[order] = same
    return out


def measure(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """All measurements of a run of whole texts."""
    n = len(off) - 1
    words = Words(raw, off)
    solid = WORD_BYTE[raw]
    out = {"n_words": words.counts, "word_chars": _per_text(solid & ~_CONT[raw], off), "n_symbols": _per_text(_SYMBOL[raw], off)}
    lines = Words(raw, off, _NOT_NEWLINE)  # \n-split lines that aren't empty
    blank = np.concatenate([[0], np.cumsum(solid)])
    real = blank[lines.ends] > blank[lines.starts]
    starts, ends, line_doc = lines.starts[real], lines.ends[real], lines.doc[real]
    line_hash = span_hashes(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    again = _dup_within(line_hash, line_doc, n, False)
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n)
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    hashes = words.hashes()
    at, counts = ngram_starts(words.first, 3)
    covered = np.zeros(len(hashes) + 3, np.int64)
    if len(at):
        twice = at[_dup_within(ngram_hashes(hashes, 3)[at], np.repeat(np.arange(n), counts), n, True)]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + 3, -1)
    out["n_repeat_words"] = segment_sum(np.cumsum(covered)[: len(hashes)] > 0, words.first)
    out["n_upper"] = _per_text(_UPPER[raw], off)
    out["n_letters"] = _per_text(_ASCII[raw], off)
    out["n_exclaims"] = _per_text(raw == 33, off)
    letters = np.concatenate([[0], np.cumsum(_LETTER[raw])])
    out["n_alpha_words"] = segment_sum(letters[words.ends] > letters[words.starts], words.first)
    #: Words without edge punctuation: the ASCII letters of a word, if they stand together.
    core = Words(raw, off, _LETTER | (np.arange(256) >= 0x80))
    h = core.hashes(fold=True)
    out["n_abuse"] = segment_sum(np.isin(h, _word_hashes(ABUSE)), core.first)
    out["n_insults"] = segment_sum(np.isin(h, _word_hashes(INSULTS)), core.first)
    return out


def _kernel(column: pa.Array) -> list[pa.Array]:
    raw, off = text_buffers(column)
    parts = [measure(raw[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in slices(off)]
    return [pa.array(np.concatenate([np.asarray(p[k], np.int64) for p in parts]) if parts else [], pa.int64()) for k in MEASURES]


def failed(measures: dict[str, str] | None = None, rules=RULES) -> Column:
    """The bits of the rules that fail, over the measurement columns (renamed by ``measures``)."""
    out = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        sql = rule.fails
        for m in sorted(MEASURES, key=len, reverse=True):
            if measures and measures[m] != m:
                sql = sql.replace(m, f"`{measures[m]}`") if f"`{measures[m]}`" not in sql else sql
        out = out.bitwiseOR(F.when(F.expr(sql), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return out


def ledger(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each of df's: key, the measurements, failed (long, bit i: rule i failed)."""
    own = df.select(F.col(key).alias("row_key"), F.col(text).alias("text"))
    return map_text(own, _kernel, [T.StructField(m, T.LongType()) for m in MEASURES], drop=["text"]).withColumn("failed", failed()).withColumnRenamed("row_key", key)


def verdict(policy: str = POLICY, bits: str = "failed") -> Column:
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def keep(df: DataFrame, policy: str = POLICY, text: str = "text") -> DataFrame:
    """df's rows that pass the policy, with df's columns; no shuffle."""
    names = dict(zip(MEASURES, fresh(df, *MEASURES)))
    noted = map_text(df, _kernel, [T.StructField(names[m], T.LongType()) for m in MEASURES], text=text)
    (bits,) = fresh(noted, "failed")
    return noted.withColumn(bits, failed(names)).where(verdict(policy, f"`{bits}`")).select(*[f"`{c}`" for c in df.columns])


def ablation(rows: DataFrame, policies: dict[str, int] = POLICIES, rules=RULES) -> DataFrame:
    """From a ledger: for each policy and each of its rules, the rows that it rejects, that it alone rejects, and those
    that the policy keeps with it and without it. One aggregation over (failed), pre-counted by its few values."""
    counts = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    cases = [(p, r.name, mask, 1 << i) for p, mask in policies.items() for i, r in enumerate(rules) if mask >> i & 1]
    each = F.inline(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit")) for p, r, m, b in cases]))
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).alias
    return counts.select("failed", "n", each).groupBy("policy", "rule").agg(
        total(hit.bitwiseAND(F.col("bit")) != 0)("rejected"), total(hit == F.col("bit"))("rejected_alone"), total(hit == 0)("kept"), total((hit == 0) | (hit == F.col("bit")))("kept_without")
    )
