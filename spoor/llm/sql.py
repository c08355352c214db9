"""The operators' results in DuckDB SQL, where SQL can express them.

Grades, toxicity, languages, packing and the pipeline fit models or pack, which SQL does
not express; tests hold them against brute force, round trips and held-out accuracy.
"""

from __future__ import annotations

from spoor.llm import common, licenses, quality_rules, resampling, sharding, trie

SPACED = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _plain(column: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{common.UPPER}', '{common.LOWER}'), '{PLAIN}')"


def _spaced(column: str) -> str:
    return f"regexp_extract_all(coalesce({column}, ''), '{SPACED}')"


def license_sql() -> str:
    rules = ",\n".join(f"({i}, '{w}', '^(?:{r}) ', {p}, '{x}')" for i, (w, r, p, x) in enumerate(licenses.rules()))
    base = ", ".join(f"('{p.split(' ')[0]}', '{p} ', '{x}')" for p, x in licenses.BASE.items())
    return rf"""
WITH rules(i, w, r, p, x) AS (VALUES {rules}), base(w, phrase, x) AS (VALUES {base}),
t AS (SELECT row_number() OVER () AS k, doc_id, {_plain('text')} AS ws FROM documents),
pos AS (SELECT k, s, ws[s + 1] AS w, array_to_string(ws[s + 1:s + {licenses.CONTEXT}], ' ') || ' ' AS c
  FROM (SELECT k, ws, unnest(range(len(ws))) AS s FROM t) WHERE ws[s + 1] IN (SELECT w FROM rules)),
hit AS (SELECT k, s, s + len(string_split(rtrim(regexp_extract(c, r)), ' ')) AS e, p, i, x FROM pos JOIN rules USING (w) WHERE regexp_matches(c, r)),
kept AS (SELECT * FROM hit a WHERE NOT EXISTS (SELECT 1 FROM hit b WHERE b.k = a.k AND b.s <= a.s AND b.e >= a.e AND b.p >= a.p
  AND b.i <> a.i AND (b.s < a.s OR b.e > a.e OR b.p > a.p OR b.i < a.i))),
based AS (SELECT k, s, x FROM pos JOIN base USING (w) WHERE starts_with(c, phrase)),
b AS (SELECT k, COUNT(*) AS n, MIN(s) AS lo, MAX(s) AS hi, string_agg(DISTINCT x, ',' ORDER BY x) AS xs FROM based GROUP BY k),
l AS (SELECT k, string_agg(DISTINCT x, ',' ORDER BY x) AS xs FROM (SELECT k, x FROM kept UNION ALL SELECT k, x FROM based) GROUP BY k),
m AS (SELECT k, MAX(p) AS p FROM (SELECT k, p FROM kept UNION ALL SELECT k, 1 FROM based) GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, COALESCE(b.n, 0) AS n_base, b.lo AS first_word, b.hi AS last_word,
  COALESCE(b.xs, '') AS base_labels, COALESCE(l.xs, '') AS labels, COALESCE(m.p, 0) / 3.0::DOUBLE AS score
FROM t LEFT JOIN b USING (k) LEFT JOIN l USING (k) LEFT JOIN m USING (k)
"""


def quality_sql() -> str:
    q, n = quality_rules, len(quality_rules.RULES)
    share = lambda a, b: f"CAST(least({q.TOP}, 100 * {a} // greatest({b}, 1)) AS INT)"
    values = [share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), f"CAST(least({q.TOP}, word_chars // greatest(n_words, 1)) AS INT)"]
    p = q.ALPHA / n
    tail = (f"CASE WHEN k >= n * {p} THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln({1 - p}))) "
            "FROM (SELECT unnest(range(CAST(k AS BIGINT) + 1)) AS j)) END")
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS s, coalesce(text, '') AS t, {_spaced('text')} AS ws FROM documents),
win AS (SELECT r, i, array_to_string(ws[i:i + {q.WINDOW - 1}], ' ') AS key FROM (SELECT r, ws, unnest(range(1, len(ws) - {q.WINDOW - 2})) AS i FROM t)),
twice AS (SELECT r, i FROM (SELECT r, i, COUNT(*) OVER (PARTITION BY r, key) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, COUNT(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + {q.WINDOW})) AS j FROM twice) GROUP BY r),
lines AS (SELECT r, COUNT(*) AS n, COUNT(*) - COUNT(DISTINCT line) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '{SPACED}') GROUP BY r),
f AS (SELECT t.r, doc_id, s, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, COALESCE(lines.dup, 0) AS n_dup_lines,
  COALESCE(rep.n, 0) AS n_repeat_words, COALESCE(lines.n, 0) AS n_lines FROM t LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)),
v AS (SELECT *, [{', '.join(values)}] AS vals FROM f),
lab AS (SELECT doc_id, MAX(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
bins AS (SELECT s, rule, vals[rule + 1] AS value, SUM(good) AS good, SUM(1 - good) AS bad
  FROM (SELECT s, vals, good, unnest(range({n})) AS rule FROM v JOIN lab USING (doc_id)) GROUP BY ALL),
cut AS (SELECT s, rule, value, SUM(good) OVER d AS k, SUM(bad) OVER d AS hits, SUM(good) OVER (PARTITION BY s, rule) AS n,
  (SELECT COUNT(DISTINCT s) FROM bins) AS strata FROM bins WINDOW d AS (PARTITION BY s, rule ORDER BY value DESC)),
best AS (SELECT s, rule, arg_max(value, (hits - {q.WORTH} * k) * 1000 + value) AS value FROM cut
  WHERE value > 0 AND hits - {q.WORTH} * k > 0 AND ({tail}) <= {q.DELTA} / (strata * {n}) GROUP BY s, rule),
bad AS (SELECT DISTINCT r FROM (SELECT r, s, vals, unnest(range({n})) AS rule FROM v) JOIN best USING (s, rule) WHERE vals[rule + 1] >= value)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND bad.r IS NULL AS kept
FROM (SELECT *, n_words < {q.BASE_FEW} OR 100 * n_repeat_words > {q.BASE_REPEAT} * n_words AS failed FROM v) v LEFT JOIN bad USING (r)
"""


def substring_sql(window: int = 20) -> str:
    return rf"""
WITH t AS (SELECT doc_id, {_spaced('text')} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {window - 1}], ' ')) AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {window - 2})) AS i FROM t)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS i FROM later),
w AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM t)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, COUNT(*) AS n FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - COALESCE(n, 0) AS BIGINT) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)
"""


def jaccard_sql() -> str:
    return rf"""
WITH RECURSIVE t AS (SELECT doc_id, {_spaced('text')} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [1] ELSE range(1, len(ws) - 3) END) AS i FROM t)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
reach(a, b) AS (SELECT doc_id, doc_id FROM t UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT t.doc_id, COALESCE(n.n, 0) AS n_shingles, c.component_id
FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, MIN(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""


def shard_sql() -> str:
    """The jumps one after the other; after ``shards`` + 1 of them all have ended."""
    n = sharding.SHARDS
    draw = "(CAST('0x' || substr(md5(key || ':' || CAST({b} AS VARCHAR)), 1, 8) AS BIGINT) >> 1)"
    t = (f"t AS (SELECT doc_id, key, size, {crc_sql('x')} AS text_crc32 FROM (SELECT doc_id, COALESCE(CAST(doc_id AS VARCHAR), '') AS key, "
         "octet_length(encode(COALESCE(text, ''))) + 1 AS size, hex(encode(COALESCE(text, ''))) AS x FROM documents), crc)")
    steps, last = [f"crc AS (SELECT {crc_table()} AS t)", t, "j0 AS (SELECT *, 0::BIGINT AS a, 0::BIGINT AS nx, 0::BIGINT AS g, 0::BIGINT AS gx FROM t)"], "j0"
    for i in range(1, n + 2):
        to = lambda b: f"CAST(floor(({b} + 1)::DOUBLE * (2147483648.0::DOUBLE / ({draw.format(b=b)} + 1)::DOUBLE)) AS BIGINT)"
        steps.append(
            f"j{i} AS (SELECT key, doc_id, size, text_crc32, CASE WHEN nx < {n} THEN nx ELSE a END AS a, CASE WHEN nx < {n} THEN {to('nx')} ELSE nx END AS nx, "
            f"CASE WHEN gx < {n + 1} THEN gx ELSE g END AS g, CASE WHEN gx < {n + 1} THEN {to('gx')} ELSE gx END AS gx FROM {last})")
        last = f"j{i}"
    return (f"WITH {', '.join(steps)} SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(a AS INT) AS shard, "
            f"row_number() OVER (PARTITION BY a ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(g AS INT) AS grown_shard FROM {last}")


def crc_table() -> str:
    """The table of CRC-32, by its rule, as a list."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (resampling.POLYNOMIAL if c & 1 else 0)
        out.append(c)
    return f"[{', '.join(map(str, out))}]::BIGINT[]"


def crc_sql(hexed: str, table: str = "crc") -> str:
    """CRC-32 of the bytes that ``hexed`` spells; ``table``, joined to its row, has ``crc_table`` as t."""
    byte = f"list_transform(range(len({hexed}) // 2), lambda i: CAST('0x' || substr({hexed}, 2 * i + 1, 2) AS BIGINT))"
    step = f"lambda c, b: xor(c >> 8, {table}.t[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), {step}), 4294967295)"


def copies_sql() -> str:
    return f"""
WITH t AS (SELECT doc_id, encode(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}')) AS raw FROM documents),
r AS (SELECT doc_id, raw, row_number() OVER (PARTITION BY raw ORDER BY doc_id DESC NULLS LAST) AS k FROM t),
g AS (SELECT raw, MAX(doc_id) AS keep_id, COUNT(*) AS n FROM t GROUP BY raw)
SELECT doc_id, keep_id, n AS group_size, k = 1 AS kept, sha256(raw) AS text_sha256 FROM r JOIN g USING (raw)
"""


def resampling_sql() -> str:
    q = resampling
    return f"""
WITH crc AS (SELECT {crc_table()} AS t),
d AS (SELECT row_number() OVER () AS k, doc_id, {_plain('text')} AS ws FROM documents),
dw AS (SELECT k, unnest(ws) AS word FROM d), bw AS (SELECT unnest({_plain('text')}) AS word FROM benchmark),
v AS (SELECT word, {crc_sql("x")} % {q.BUCKETS} AS bucket FROM (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)), crc),
s AS (SELECT bucket, COUNT(*) AS s FROM dw JOIN v USING (word) GROUP BY bucket), t AS (SELECT bucket, COUNT(*) AS t FROM bw JOIN v USING (word) GROUP BY bucket),
n AS (SELECT (SELECT COUNT(*) FROM dw) AS s, (SELECT COUNT(*) FROM bw) AS t),
g AS (SELECT bucket, CAST(floor(1000e0 * ln((COALESCE(t.t, 0) + 1)::DOUBLE * (n.s + {q.BUCKETS})::DOUBLE / ((COALESCE(s.s, 0) + 1)::DOUBLE * (n.t + {q.BUCKETS})::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM v) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), n),
w AS (SELECT k, CAST(SUM(gain) AS BIGINT) AS weight FROM dw JOIN v USING (word) JOIN g USING (bucket) GROUP BY k),
h AS (SELECT d.k, doc_id, CAST(len(ws) AS BIGINT) AS n_features, COALESCE(weight, 0) AS weight,
  CAST('0x' || substr(sha256('{q.SEED}:' || COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)::DOUBLE AS h FROM d LEFT JOIN w USING (k)),
f AS (SELECT k, doc_id, n_features, weight, weight + CAST(floor(-1000e0 * ln(-ln((h + 0.5e0) / 4294967296e0))) AS BIGINT) AS score FROM h),
o AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS r, COUNT(*) OVER () AS n FROM f WHERE n_features >= {q.FEW_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= n * {q.PERCENT} // 100 THEN r END AS rank FROM f LEFT JOIN o USING (k)
"""


def trie_sql() -> str:
    return f"""
WITH crc AS (SELECT {crc_table()} AS t),
t AS (SELECT conv_id, r, x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(strlen(r), ':', r, x))) - 1 AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, {crc_sql("k")} % {trie.HEAD + 1} AS h FROM (SELECT DISTINCT conv_id, hex(encode(CAST(conv_id AS VARCHAR))) AS k FROM t), crc),
r AS (SELECT t.conv_id, 1 AS own, pos, r, x FROM t JOIN c USING (conv_id) WHERE pos >= h
  UNION ALL SELECT c.conv_id, 0, pos, r, x FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % {trie.BLOCK} AND pos < h),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, strlen(x) AS size, md5(concat(strlen(r), ':', r, x)) AS g FROM r),
l AS (SELECT conv_id, list(g ORDER BY depth) AS gs FROM o GROUP BY conv_id),
p AS (SELECT conv_id, depth, size, md5(array_to_string(gs[1:depth], '')) AS key, md5(array_to_string(gs[1:depth - 1], '')) AS parent, depth = len(gs) AS final
    FROM o JOIN l USING (conv_id)
  UNION ALL SELECT conv_id, 0, 0, md5(''), NULL, l.gs IS NULL FROM c LEFT JOIN l USING (conv_id)),
u AS (SELECT key, depth, parent, MIN(conv_id) AS conv_id, MAX(size) AS size, COUNT(*) AS n,
  COALESCE(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE final), '') AS ends FROM p GROUP BY key, depth, parent),
k AS (SELECT parent AS key, COUNT(*) AS kids FROM u WHERE parent IS NOT NULL GROUP BY parent),
v AS (SELECT u.*, COALESCE(kids, 0) AS kids FROM u LEFT JOIN k USING (key)),
s AS (SELECT p.key, SUM((v.n - 1) * v.size) AS saved, COUNT_IF(kids = 0) AS leaves FROM v JOIN p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY p.key)
SELECT v.conv_id, v.depth, w.conv_id AS parent_conv_id, v.n AS n_convs, v.kids AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN s USING (key) LEFT JOIN u w ON w.key = v.parent
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_trie": trie_sql(),
        "op12_copies": copies_sql(), "op13_resampling": resampling_sql(),
        "op1_licenses": license_sql(), "op2_quality_rules": quality_sql(), "op3_substrings": substring_sql(),
        "op5_jaccard": jaccard_sql(), "op8_sharding": shard_sql(), "op10_contamination": contamination_sql(),
    }


def contamination_sql() -> str:
    return rf"""
WITH d AS (SELECT doc_id, {_plain('text')} AS ws FROM documents),
it AS (SELECT CAST(item_id AS VARCHAR) AS item, {_plain('text')} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item, m, md5(array_to_string(ws[i:i + m - 1], ' ')) AS key
  FROM (SELECT item, ws, least(10, len(ws)) AS m, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM it WHERE len(ws) > 0)),
dw AS (SELECT doc_id, m, i, md5(array_to_string(ws[i:i + m - 1], ' ')) AS key
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM iw))),
hits AS (SELECT doc_id, i, m, item FROM dw JOIN iw USING (m, key)),
n AS (SELECT doc_id, COUNT(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM hits) GROUP BY doc_id),
f AS (SELECT doc_id, COUNT(DISTINCT item) AS k, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, COALESCE(n.n, 0) AS n_hit, COALESCE(f.k, 0) AS n_items, sha256(COALESCE(f.items, '')) AS items_sha256,
  COALESCE(n.n, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN f USING (doc_id)
"""
