"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from anchorkit.llm import licences, quality_rules as rules


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _states_holder() -> str:
    """Whether a line ``l`` in lower case states who holds the rights: the rule of the scan, told by the parts of a line."""
    letters = licences.LETTERS
    after = lambda mark: f"regexp_extract(l, {quoted(f'^[^a-z0-9]*{mark}(.*)$')}, 1)"
    begins = lambda rest, words: f"regexp_matches({rest}, {quoted(f'^[^{letters}]*({words})([^{letters}]|$)')})"
    body = "|".join(licences._BODY)
    word, sign = after("copyright(?:s|ed)?"), after(r"\(c\)")
    plain = quoted("^[^a-z0-9]*copyright(s|ed)?([^a-z0-9]|$)")
    return (
        f"(regexp_matches(l, '^[^a-z0-9]*(©|all rights reserved)')"
        f" OR (regexp_matches(l, {plain}) AND regexp_matches({word}, {quoted(f'[©{letters}]')}) AND NOT {begins(word, body)})"
        f" OR (regexp_matches(l, {quoted('^[^a-z0-9]*' + chr(92) + '(c' + chr(92) + ')')}) AND (regexp_matches({sign}, '(19|20)[0-9]{{2}}([^0-9]|$)')"
        f" OR (regexp_matches({sign}, {quoted(f'[{letters}]')}) AND NOT {begins(sign, body)} AND NOT {begins(sign, '|'.join(licences._ITEM))}))))")


def _canonical(text: str) -> str:
    low = f"lower(coalesce({text}, ''))"
    lines = f"array_to_string(list_filter(string_split({low}, chr(10)), lambda l: NOT {_states_holder()}), chr(10))"
    wide = f"regexp_replace({lines}, {quoted(f'[^{licences.LETTERS}]+')}, '  ', 'g')"
    wide = f"' ' || trim({wide}, ' ') || ' '"
    for other, word in licences.SPELLINGS:
        wide = f"replace({wide}, {quoted(' ' + '  '.join(other.split()) + ' ')}, {quoted(' ' + '  '.join(word.split()) + ' ')})"
    return f"trim({wide}, ' ')"


LICENCES = f"""
WITH texts(licence, t) AS (VALUES {", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in licences.KNOWN)}),
known AS (SELECT sha256({_canonical("t")}) AS digest, min(licence) AS licence FROM texts GROUP BY 1),
whole AS (SELECT doc_id, sha256({_canonical("text")}) AS text_digest FROM documents),
lines AS (SELECT doc_id, sha256({_canonical("line")}) AS digest
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> ''),
notices AS (SELECT doc_id, string_agg(DISTINCT licence, ';' ORDER BY licence) AS notices, count(*) AS n
            FROM lines JOIN known USING (digest) GROUP BY doc_id)
SELECT w.doc_id, k.digest, licence, notices, coalesce(n, 0) AS n_notices
FROM whole w LEFT JOIN known k ON text_digest = k.digest LEFT JOIN notices s ON w.doc_id = s.doc_id
"""

_SIGNALS = {
    "symbol_ratio": "coalesce(n_symbols::DOUBLE / nullif(word_chars, 0), 0)",
    "dup_line_ratio": "coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0)",
    "repeat_ratio": "coalesce(n_repeat_words::DOUBLE / nullif(n_words, 0), 0)",
    "word_length": "coalesce(word_chars::DOUBLE / nullif(n_words, 0), 0)",
}
_RATE = rules.ALLOWED / len(_SIGNALS)

QUALITY_RULES = f"""
WITH docs AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM docs WHERE len(w) >= 3),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM places),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM windows),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1) GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id),
signals AS (SELECT doc_id, lang, unnest([{", ".join(f"{{'s': '{s}', 'v': {e}}}" for s, e in _SIGNALS.items())}]) AS x FROM counts),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1),
cuts(s, c) AS (VALUES {", ".join(f"('{s}', {c!r}::DOUBLE)" for s, cs in rules.CANDIDATES.items() for c in cs)}),
tallies AS (
  SELECT lang, cuts.s, c, count(*) AS n, count(*) FILTER (x.v > c) AS k
  FROM signals JOIN good USING (doc_id) JOIN cuts ON x.s = cuts.s GROUP BY ALL),
tests AS (
  SELECT *, (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_RATE!r}) + (n - j) * ln(1 - {_RATE!r})))
             FROM generate_series(0, k) AS g(j)) AS p FROM tallies),
failed AS (
  SELECT lang, s, c, p > {rules.LEVEL!r} / (4 * (SELECT count(DISTINCT coalesce(lang, '-null-')) FROM tallies)) AS bad FROM tests),
cutoffs AS (
  SELECT lang, s, min(c) FILTER (c > worst) AS cutoff
  FROM (SELECT *, coalesce(max(c) FILTER (bad) OVER (PARTITION BY lang, s), -1) AS worst FROM failed) GROUP BY lang, s),
over AS (
  SELECT doc_id, bool_or(coalesce(x.v > cutoff, false)) AS over
  FROM signals LEFT JOIN cutoffs c ON signals.lang IS NOT DISTINCT FROM c.lang AND x.s = c.s GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND NOT over AS kept
FROM counts JOIN over USING (doc_id)
"""

_STEP = "list_reduce(list_prepend(x, [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))"
_CRC32 = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda d: ord(d)::BIGINT)), " \
         "lambda c, d: " + _STEP.replace("x, [", "xor(c, d), [") + "), 4294967295)"

CONVERSATION_TRIE = f"""
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, {_CRC32.format("c::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT c FROM own)),
parts AS (
  SELECT x.c, 0 AS k, p, r, t FROM convs x JOIN own o ON o.c = x.c - x.c % 100 AND p <= h
  UNION ALL SELECT x.c, 1, p, r, t FROM convs x JOIN own o ON o.c = x.c AND p > h),
paths AS (
  SELECT c, row_number() OVER w AS d, t, string_agg(sha256(length(r) || ':' || r || t), '') OVER w AS path
  FROM parts WINDOW w AS (PARTITION BY c ORDER BY k, p ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT c, 0, '', '' FROM convs),
ends AS (SELECT c, max(path) AS path FROM (SELECT c, path, d = max(d) OVER (PARTITION BY c) AS last FROM paths) WHERE last GROUP BY c),
nodes AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, max(length(t)) AS size FROM paths GROUP BY path, d),
kids AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT a.*, coalesce(n, 0) AS n_children FROM nodes a LEFT JOIN kids k ON a.path = k.path),
below AS (
  SELECT a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.size) AS saved
  FROM full_nodes a JOIN full_nodes b ON starts_with(b.path, a.path) GROUP BY a.path),
lists AS (SELECT path, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM ends GROUP BY path)
SELECT a.conv_id, a.d::BIGINT AS depth, u.conv_id AS parent_conv_id, a.n_convs, a.n_children, n_leaves, saved::BIGINT AS saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM full_nodes a JOIN below b ON a.path = b.path LEFT JOIN lists l ON a.path = l.path
LEFT JOIN nodes u ON a.d > 0 AND u.path = left(a.path, length(a.path) - 64)
"""

REPEATED_WINDOWS = """
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
words AS (SELECT doc_id, len(w) AS n, w, unnest(range(1, len(w) + 1)) AS p FROM docs),
windows AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS x FROM words WHERE p + 19 <= n),
firsts AS (SELECT doc_id, p, (doc_id, p) > min((doc_id, p)) OVER (PARTITION BY x) AS later FROM windows),
marked AS (
  SELECT a.doc_id, a.p, w[a.p] AS word,
         bool_or(coalesce(later, false)) OVER (PARTITION BY a.doc_id ORDER BY a.p ROWS 19 PRECEDING) AS gone
  FROM words a LEFT JOIN firsts f ON a.doc_id = f.doc_id AND a.p = f.p),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS t FROM marked GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def _vector_codes() -> str:
    dist = "(" + " + ".join(f"(x.c[{i}] - b.c[{i}]) * (x.c[{i}] - b.c[{i}])" for i in range(1, 5)) + ")"

    def near(number: int, book: str) -> str:
        return f"""
near{number} AS (
  SELECT v, vec_id, label, p, any_value(c) AS c, arg_min(e, (dist, e)) AS e, min(dist) AS dist
  FROM (SELECT x.*, b.e, {dist} AS dist FROM cut x JOIN {book} b ON x.p = b.p) GROUP BY v, vec_id, label, p)"""

    def moved(number: int, book: str) -> str:
        middle = ", ".join(f"sum(c[{i}]) // count(*) - (sum(c[{i}]) % count(*) < 0)::INT" for i in range(1, 5))
        return f"""
book{number} AS (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c
  FROM {book} b LEFT JOIN (SELECT p, e, [{middle}] AS c FROM near{number} GROUP BY p, e) m ON b.p = m.p AND b.e = m.e)"""

    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS v, vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (SELECT v, vec_id, label, p, w[4 * p + 1:4 * p + 4] AS c FROM kept, range(16) AS g(p)),
book0 AS (SELECT p, v - 1 AS e, c FROM cut WHERE v <= 64),{near(1, "book0")},{moved(1, "book0")},{near(2, "book1")},{moved(2, "book1")},{near(3, "book2")},
codes AS (SELECT v, vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error FROM near3 GROUP BY v, vec_id, label),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS d FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, d AS codebooks_sha256 FROM codes, digest
"""


VECTOR_CODES = _vector_codes()
