"""DuckDB SQL that the queries of this package must agree with."""

from __future__ import annotations

from kveil.llm.quality import COMMON_WORDS, REFERENCES, Limits
from kveil.llm.urls import DEFAULT_VERDICT, RULES

WS = r"[\x20\x09-\x0D]+"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

EXACT = f"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{WS}', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""

SUBSTRINGS = f"""
WITH t AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t WHERE len(w) >= 50),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS words FROM starts),
owned AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY words) AS first FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM owned WHERE first < doc_id),
cuts AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM t),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS body FROM words
    WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = words.doc_id AND gone.p = words.p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM t LEFT JOIN cuts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

# CRC-32 of a decimal number, bit by bit: the reflected polynomial is a fixed value.
CRC = """xor(4294967295, list_reduce(
    list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda b: CAST(ascii(b) AS BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda a, z: xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END)), 4294967295))"""

TRIE = f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (
    SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS turns
    FROM t GROUP BY conv_id),
hs AS (SELECT conv_id, turns, CAST({CRC.format("conv_id")} % 9 AS BIGINT) AS h FROM o),
built AS (
    SELECT a.conv_id, list_concat(coalesce(g.turns[1 : a.h], []), a.turns[a.h + 1 :]) AS turns
    FROM hs a LEFT JOIN o g ON g.conv_id = a.conv_id - a.conv_id % 5),
prefixes AS (
    SELECT conv_id, d, turns[1 : d] AS node, d = len(turns) AS ends
    FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM built)),
nodes AS (
    SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
           coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends
    FROM prefixes GROUP BY node, d),
children AS (SELECT node[1 : d - 1] AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
above AS (
    SELECT n.node[1 : a] AS node, sum(n.saved) AS saved, count(*) FILTER (WHERE n.leaf) AS leaves
    FROM (SELECT m.node, m.d, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(m.node[d].text) END AS saved,
                 c.n IS NULL AS leaf, unnest(range(0, d + 1)) AS a
          FROM nodes m LEFT JOIN children c ON c.node = m.node) n GROUP BY 1)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
       a.leaves AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN above a ON a.node = n.node LEFT JOIN children c ON c.node = n.node
LEFT JOIN nodes p ON n.d > 0 AND p.node = n.node[1 : n.d - 1]
"""

NEGATIVES = """
WITH t AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
           CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM t a JOIN t r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
    SELECT anchor_id, id, score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
negatives AS (
    SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS r
    FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    WHERE 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE r <= 3
"""


def urls() -> str:
    """Rules in order of length, so the first that fits is the longest."""
    fits = {
        f"{host}{path}": (
            f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')",
            action,
        )
        for host, path, action in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    }
    rule = " ".join(f"WHEN {test} THEN '{name}'" for name, (test, _) in fits.items())
    verdict = " ".join(f"WHEN {test} THEN '{action}'" for test, action in fits.values())
    return f"""
WITH t AS (
    SELECT page_id,
           translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), '{LETTERS}', '{LETTERS.lower()}') AS host,
           coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE '{DEFAULT_VERDICT}' END AS verdict FROM t
"""


def quality(limits: Limits = Limits()) -> str:
    pairs = ", ".join(f"('{lang}', '{w}')" for lang, ws in COMMON_WORDS.items() for w in ws)
    langs = REFERENCES.items()
    classes = ", ".join(f"('{lang}', {i}, {q!r})" for lang, r in langs for i, q in enumerate(r["classes"]))
    words = ", ".join(f"('{lang}', '{w}', {q!r})" for lang, r in langs for w, q in r["words"].items())
    return f"""
WITH t AS (
    SELECT doc_id, lang, coalesce(text, '') AS text,
           list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}'), lambda x: x <> '') AS w FROM documents),
m AS (
    SELECT doc_id, lang, w, text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
           length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS upper,
           length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS digit,
           length(text) - length(regexp_replace(text, '[.,;:!?''"()-]', '', 'g')) AS mark FROM t),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
dups AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM starts),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS p FROM grams WHERE n > 1),
repeats AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
common(lang, word) AS (VALUES {pairs}),
bins AS (
    SELECT doc_id, lang, unnest([length(text) - word_chars, n_symbols, upper, digit, mark,
                                 word_chars - n_symbols - upper - digit - mark]) AS n,
           unnest(range(6)) AS bin, length(text) AS total FROM m),
used AS (SELECT doc_id, lang, unnest(w) AS word FROM m),
found AS (SELECT doc_id, lang, word, count(*) AS n FROM used JOIN common USING (lang, word) GROUP BY ALL),
totals AS (SELECT lang, sum(n_words) AS n FROM m GROUP BY lang),
class_fit AS (SELECT lang, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM bins
              WHERE lang IN (SELECT lang FROM common) GROUP BY lang, bin),
word_fit AS (
    SELECT c.lang, c.word, coalesce(sum(f.n), 0) / any_value(t.n) AS q FROM common c
    JOIN totals t ON t.lang = c.lang LEFT JOIN found f ON f.lang = c.lang AND f.word = c.word GROUP BY c.lang, c.word),
class_fixed(lang, bin, q) AS (VALUES {classes}),
word_fixed(lang, word, q) AS (VALUES {words}),
class_ref AS (
    SELECT 'fit' AS ref, lang, bin, CAST(q AS DOUBLE) AS q FROM class_fit
    UNION ALL SELECT 'fixed', lang, bin, CAST(q AS DOUBLE) FROM class_fixed),
word_ref AS (
    SELECT 'fit' AS ref, lang, word, CAST(q AS DOUBLE) AS q FROM word_fit
    UNION ALL SELECT 'fixed', lang, word, CAST(q AS DOUBLE) FROM word_fixed),
class_js AS (
    SELECT ref, doc_id, sqrt(greatest(sum(
        CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
        + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS d
    FROM (SELECT ref, doc_id, n / greatest(total, 1) AS p, q FROM bins JOIN class_ref USING (lang, bin)) GROUP BY ref, doc_id),
pairs AS (
    SELECT r.ref, m.doc_id, coalesce(f.n, 0) / greatest(m.n_words, 1) AS p, r.q FROM m JOIN word_ref r ON r.lang = m.lang
    LEFT JOIN found f ON f.doc_id = m.doc_id AND f.word = r.word),
with_rest AS (
    SELECT ref, doc_id, p, q FROM pairs
    UNION ALL SELECT ref, doc_id, greatest(1 - sum(p), 0), 1 - sum(q) FROM pairs GROUP BY ref, doc_id),
word_js AS (
    SELECT ref, doc_id, sqrt(greatest(sum(
        CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
        + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS d FROM with_rest GROUP BY ref, doc_id),
far AS (
    SELECT ref, doc_id, coalesce(length(text) >= {limits.min_class_chars} AND c.d > {limits.max_class_distance}, false)
           OR coalesce(n_words >= {limits.min_word_words} AND j.d > {limits.max_word_distance}, false) AS far
    FROM m JOIN class_js c USING (doc_id) JOIN word_js j USING (ref, doc_id)),
judged AS (
    SELECT m.doc_id, n_words, word_chars, n_symbols, coalesce(dups.n, 0) AS n_dup_lines,
           coalesce(repeats.n, 0) AS n_repeat_words,
           n_words < {limits.min_words} OR 100 * coalesce(repeats.n, 0) > {limits.max_repeat_percent} * n_words AS base_failed,
           coalesce(a.far, false) AS far, coalesce(b.far, false) AS far_by_table
    FROM m LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id)
    LEFT JOIN far a ON a.doc_id = m.doc_id AND a.ref = 'fixed' LEFT JOIN far b ON b.doc_id = m.doc_id AND b.ref = 'fit')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT far AS kept,
       NOT base_failed AND NOT far_by_table AS kept_by_table
FROM judged
"""
