"""The same results as SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

from epochwise.llm import lines, quality

_SPACE = r"[\x20\x09-\x0D]"


def _rule(rule: quality.Rule) -> str:
    sign = {"above": ">", "below": "<"}[rule.direction]
    return f"coalesce(n_words >= {rule.at_least} AND {rule.numerator}::DOUBLE / nullif({rule.denominator}, 0) {sign} {rule.bound}, false)"


def quality_sql(source: str = "documents") -> str:
    """Counts and verdicts per row of ``source``; ids must be unique."""
    stops = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    symbols = "".join(quality.SYMBOLS)
    fails = " OR ".join(_rule(r) for r in quality.RULES)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM {source}),
split AS (
  SELECT doc_id, t,
         list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM texts),
starts AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM split WHERE len(ws) >= 5),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS w FROM starts),
again AS (SELECT doc_id, w FROM windows GROUP BY ALL HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM windows JOIN again USING (doc_id, w), range(5) AS r(k) GROUP BY doc_id),
counts AS (
  SELECT s.doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '{symbols}', '')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(ls) AS n_lines,
         len(list_filter(ws, lambda x: length(x) < 6 AND lower(x) IN ({stops}))) AS n_stop_words,
         len(list_filter(ws, lambda x: x LIKE '%!!')) AS n_shouts
  FROM split s LEFT JOIN covered c ON c.doc_id = s.doc_id),
base AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR {fails}) AS kept
FROM base"""


EXACT_SQL = f"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g') AS bare
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY bare ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY bare) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY bare ORDER BY n DESC, doc_id) AS kept,
       sha256(bare) AS text_sha256
FROM texts"""


_TRIM = "trim({}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

LINES_SQL = f"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS site, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
every AS (SELECT site, {_TRIM.format('l')} AS line FROM (SELECT site, unnest(ls) AS l FROM texts)),
bad AS (
  SELECT line FROM every WHERE line <> ''
  GROUP BY line HAVING count(DISTINCT site) >= {lines.MIN_SITES}),
placed AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM texts)
SELECT doc_id, count(*) AS n_lines, count(bad.line) AS n_removed,
       coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (bad.line IS NULL), '') AS text
FROM placed LEFT JOIN bad ON {_TRIM.format('l')} = bad.line
GROUP BY doc_id"""


def jaccard_sql(n: int, num: int, den: int) -> str:
    """Components of similar shingle sets; all pairs, so for small tables."""
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}+'), lambda x: x <> '') AS ws
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + {n - 1}], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {n - 1}, 1) + 1)) AS i FROM words WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING {den} * count(*) >= {num} * (x.n + y.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM words
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT w.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM words w JOIN reach r ON r.a = w.doc_id LEFT JOIN sizes z ON z.doc_id = w.doc_id
GROUP BY w.doc_id, z.n"""


# The 256 steps of CRC-32, and its value over the bytes of a text.
_CRC_STEPS = """crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, _:
           CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps)"""


def _crc32(text: str) -> str:
    """CRC-32 of a text; the statement joins ``crc``."""
    bytes_ = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}),
      lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"""


RESAMPLING_SQL = f"""
WITH {_CRC_STEPS},
texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
words AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM texts),
placed AS (SELECT side, id, ws, unnest(range(1, len(ws) + 1)) AS i FROM words WHERE len(ws) > 0),
runs AS (
  SELECT side, id, array_to_string(ws[i:i + n - 1], ' ') AS f
  FROM placed, (VALUES (1), (2), (3)) AS r(n) WHERE i + n - 1 <= len(ws)),
counted AS (SELECT side, id, f, count(*) AS k FROM runs GROUP BY ALL),
buckets AS (
  SELECT f, {_crc32("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM counted), crc),
sums AS (
  SELECT bucket, coalesce(sum(k) FILTER (side = 'd'), 0) AS s, coalesce(sum(k) FILTER (side = 't'), 0) AS t
  FROM counted JOIN buckets USING (f) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
                                 / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
  FROM sums),
weights AS (
  SELECT id AS doc_id, sum(k) AS n_features, sum(k * gain) AS weight
  FROM counted JOIN buckets USING (f) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
scores AS (
  SELECT w.id AS doc_id, len(w.ws) AS n_words, coalesce(x.n_features, 0)::BIGINT AS n_features,
         coalesce(x.weight, 0)::BIGINT AS weight,
         (coalesce(x.weight, 0) + floor(-1000 * ln(-ln(
            (('0x' || substr(sha256('42:' || w.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM words w LEFT JOIN weights x ON x.doc_id = w.id WHERE w.side = 'd'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) OVER (PARTITION BY n_words >= 20) AS n
  FROM scores)
SELECT doc_id, n_words::BIGINT AS n_words, n_features, weight, score,
       CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank
FROM ranked"""


# Levels of a tree that the statement unrolls: enough for 3 ** 10 leaves of a source.
_SQL_LEVELS = 10


def _tree(name: str) -> str:
    """Levels of the trees over ``{name}_0`` (grp, i, h): a group with one node is not hashed again."""
    levels = [
        f"""{name}_{k + 1} AS (
  SELECT grp, i // 3 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h
  FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {name}_{k}) GROUP BY grp, i // 3)"""
        for k in range(_SQL_LEVELS)
    ]
    return ",\n".join(levels)


def _siblings(name: str, leaves: str) -> str:
    """(leaf, level, l, r): what stands left and right of the path from each row of ``leaves`` (leaf, grp, i)."""
    parts = [
        f"""SELECT x.leaf, {k} AS level, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < x.i // {3**k}), '') AS l,
         coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > x.i // {3**k}), '') AS r
  FROM {leaves} x JOIN {name}_{k} s ON s.grp = x.grp AND s.i // 3 = x.i // {3 ** (k + 1)}
  WHERE (SELECT count(*) FROM {name}_{k} c WHERE c.grp = x.grp) > 1 GROUP BY x.leaf"""
        for k in range(_SQL_LEVELS)
    ]
    return "\n  UNION ALL ".join(parts)


def _leaf(text: str) -> str:
    fields = [f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)]
    return f"sha256({' || '.join(fields)})"


MANIFEST_SQL = f"""
WITH {_CRC_STEPS},
leaves AS (
  SELECT doc_id AS leaf, coalesce('=' || source, '') AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i,
         {_leaf("text")} AS h, {_leaf("replace(text, chr(10), '')")} AS changed
  FROM documents),
src_0 AS (SELECT grp, i, h FROM leaves),
{_tree("src")},
top_0 AS (SELECT 'all' AS grp, row_number() OVER (ORDER BY encode(grp)) - 1 AS i, h, grp AS member FROM src_{_SQL_LEVELS}),
{_tree("top")},
members AS (SELECT member AS leaf, grp, i FROM top_0),
below AS ({_siblings("src", "leaves")}),
above AS ({_siblings("top", "members")}),
path AS (
  SELECT leaf, level, l, r FROM below
  UNION ALL SELECT x.leaf, {_SQL_LEVELS} + a.level, a.l, a.r FROM leaves x JOIN above a ON a.leaf = x.grp),
proofs AS (
  SELECT leaf, string_agg(l || r, '' ORDER BY level) AS told, list(l ORDER BY level) AS ls, list(r ORDER BY level) AS rs
  FROM path GROUP BY leaf),
folds AS (
  SELECT x.leaf AS doc_id, x.h AS leaf, s.h AS subroot, t.h AS root, sha256(coalesce(p.told, '')) AS proof_sha256,
         list_reduce(list_prepend(CASE WHEN {_crc32("x.leaf::VARCHAR")} % 2 = 0 THEN x.changed ELSE x.h END,
                                  list_transform(range(coalesce(len(p.ls), 0)), lambda k: k::VARCHAR)),
                     lambda node, k: sha256(p.ls[k::BIGINT + 1] || node || p.rs[k::BIGINT + 1])) AS folded_root
  FROM crc, leaves x JOIN src_{_SQL_LEVELS} s ON s.grp = x.grp JOIN top_{_SQL_LEVELS} t ON true
  LEFT JOIN proofs p ON p.leaf = x.leaf)
SELECT *, folded_root = root AS verified FROM folds"""


STATEMENTS = {
    "op2_exact_duplicates": EXACT_SQL,
    "op3_line_spread": LINES_SQL,
    "op9_quality_rules": quality_sql(),
    "op10_ngram_jaccard": jaccard_sql(3, 90, 100),
    "op11_importance_resampling": RESAMPLING_SQL,
    "op12_merkle_manifest": MANIFEST_SQL,
}
