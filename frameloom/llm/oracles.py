"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .quality_ledger import INSULTS


def _crc_entry(c: int) -> int:
    """One entry of the table of CRC-32 (reflected polynomial 0xEDB88320)."""
    for _ in range(8):
        c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
    return c


_CRC = f"""
WITH hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (
  SELECT doc_id, length(h) // 2 + 16 AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda k: ('0x' || k)::BIGINT)),
      lambda c, b: xor(c >> 8, list_extract({[_crc_entry(i) for i in range(256)]}, (xor(c, b) & 255) + 1)))) AS text_crc32
  FROM hexed)
"""

OP1 = (
    _CRC
    + """,
placed AS (
  SELECT doc_id, size, text_crc32, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM sized),
cut AS (SELECT doc_id, size, text_crc32, (((2 * before + size) * 40) // (2 * total))::INT AS shard, before FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY before) - 1 AS slot, NULL::INT AS grown_shard FROM cut
"""
)

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
grams AS (
  SELECT doc_id, i, w[i + 1] AS a, w[i + 2] AS b, w[i + 3] AS c FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 2, 0))) AS i FROM d)),
counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM grams),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM counted WHERE n > 1) GROUP BY doc_id),
alpha AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM d) WHERE regexp_matches(x, '[A-Za-z\\x{{C0}}-\\x{{10FFFF}}]') GROUP BY doc_id),
abuse AS (
  SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS x FROM d) WHERE x IN ('scum', 'idiot', 'worthless', 'pathetic') GROUP BY doc_id),
insults AS (
  SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS x FROM d) WHERE x IN {INSULTS} GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(lines, lambda x: regexp_matches(x, '{r"[^\x20\x09-\x0D]"}'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '{r"[^\x20\x09-\x0D]"}')))) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words,
    len(list_filter(lines, lambda x: regexp_matches(x, '{r"[^\x20\x09-\x0D]"}'))) AS n_lines,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
    length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS n_letters,
    length(text) - length(replace(text, '!', '')) AS n_exclaims,
    coalesce(alpha.n, 0) AS n_alpha_words, coalesce(abuse.n, 0) AS n_abuse, coalesce(insults.n, 0) AS n_insults
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN alpha USING (doc_id) LEFT JOIN abuse USING (doc_id) LEFT JOIN insults USING (doc_id)),
f AS (
  SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END + CASE WHEN n_letters > 0 AND 100 * n_upper > 50 * n_letters THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_exclaims > 30 * n_words THEN 32 ELSE 0 END + CASE WHEN 100 * n_alpha_words < 50 * n_words THEN 64 ELSE 0 END
    + CASE WHEN word_chars > 25 * n_words THEN 128 ELSE 0 END + CASE WHEN 100 * n_abuse > n_words THEN 256 ELSE 0 END + CASE WHEN n_insults >= 2 THEN 512 ELSE 0 END AS failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  failed & 3 <> 0 AS base_failed, failed & 767 = 0 AS kept, failed::BIGINT AS failed FROM f
"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 1 ELSE 0 END AS no_source, coalesce(source, '') AS source_name, len({_WORDS}) AS size FROM documents),
s0 AS (SELECT no_source, source_name, sum(size)::BIGINT AS source_size FROM d GROUP BY no_source, source_name),
s AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY no_source, source_name) - 1) % 3 + 1] AS weight FROM s0),
ranked AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, no_source, source_name) AS k FROM s),
step AS (
  SELECT a.k, ((SELECT sum(source_size) FROM s) - coalesce(sum(3 * b.source_size) FILTER (b.k < a.k), 0)) / sum(b.weight) FILTER (b.k >= a.k) AS level, a.weight, a.source_size
  FROM ranked a, ranked b GROUP BY a.k, a.weight, a.source_size),
level AS (SELECT arg_min(level, k) AS level FROM step WHERE level * weight <= 3 * source_size),
t AS (
  SELECT no_source, source_name, source_size, least(3 * source_size, coalesce(level.level * weight, 0))::DOUBLE AS target,
    ('0x' || md5('mix-1:' || no_source || source_name)[1:8])::BIGINT / 4294967296.0::DOUBLE AS u FROM s, level),
e AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each FROM t),
r AS (SELECT d.*, row_number() OVER (PARTITION BY no_source, source_name ORDER BY size, doc_id) - 1 AS r FROM d),
c AS (SELECT doc_id, size::BIGINT AS size, source_size, target, (floor((r + 1)::DOUBLE * each + u) - floor(r::DOUBLE * each + u))::BIGINT AS copies FROM r JOIN e USING (no_source, source_name))
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{r"[^\x20\x09-\x0D]+"}') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i + 1, i + 5), ' ')) AS s FROM (SELECT doc_id, w, unnest(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 4, 1) END)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
edges AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT reach.u, edges.v FROM reach JOIN edges ON reach.v = edges.u),
least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN least ON least.u = d.doc_id
"""


OP12 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{r"[^\x20\x09-\x0D]+"}') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i + 1, i + 4), ' ')) AS s FROM (SELECT doc_id, w, unnest(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 3, 1) END)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
edges AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT reach.u, edges.v FROM reach JOIN edges ON reach.v = edges.u),
least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN least ON least.u = d.doc_id
"""


def _crc_of(name: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({name})), '..'), lambda k: ('0x' || k)::BIGINT)),
      lambda c, b: xor(c >> 8, list_extract({[_crc_entry(i) for i in range(256)]}, (xor(c, b) & 255) + 1))))"""


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, f, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all({_LOW}, '{r"[A-Za-z\x{C0}-\x{FF}]+"}')) AS f FROM documents) GROUP BY ALL),
h AS (SELECT f, k, {_crc_of("doc_id || ':' || f")} AS h FROM r),
c AS (SELECT CASE WHEN h % 97 = 0 THEN f[:(h % length(f))] || f[(h % length(f)) + 2:] ELSE f END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM c WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS (SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
near AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT cut.word, v.word FROM cut JOIN v ON cut.rest = v.word
  UNION SELECT v.word, cut.word FROM cut JOIN v ON cut.rest = v.word),
best AS (
  SELECT a AS word, count(*) AS n_near, arg_min(b, (-v.n, hex(encode(b)))) AS b, max(v.n) AS b_n FROM near JOIN v ON v.word = b GROUP BY a),
w AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN b_n >= 2 * v.n THEN b END AS form, CASE WHEN b_n >= 2 * v.n THEN b_n END AS form_n FROM v LEFT JOIN best USING (word)),
path AS (SELECT word, word AS here, 0 AS step FROM w UNION ALL SELECT path.word, w.form, step + 1 FROM path JOIN w ON w.word = path.here WHERE w.form IS NOT NULL)
SELECT w.word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM w JOIN (SELECT word, arg_max(here, step) AS root FROM path GROUP BY word) USING (word)
"""

OP13 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOW}, '{r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"}') AS w FROM documents),
d AS (SELECT doc_id, unnest(w) AS f FROM w),
b AS (SELECT unnest(regexp_extract_all({_LOW}, '{r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"}')) AS f FROM benchmark),
v AS (SELECT f, ({_crc_of("f")} % 10000)::INT AS bucket FROM (SELECT f FROM d UNION SELECT f FROM b)),
s AS (SELECT bucket, count(*) AS s FROM d JOIN v USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN v USING (f) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM d JOIN v USING (f) JOIN g USING (bucket) GROUP BY doc_id),
x AS (
  SELECT w.doc_id, len(w.w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || w.doc_id)[1:8])::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score FROM w LEFT JOIN m USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT 10 * count(*) // 100 FROM r) THEN r END::BIGINT AS rank FROM x LEFT JOIN r USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": OP1, "op5_quality_ledger": OP5, "op6_mixing": OP6, "op9_lsh_forest": OP9, "op11_spelling": OP11, "op12_ngram_join": OP12, "op13_importance": OP13}
