"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import divergence as D

_QUOTED = ", ".join(f"'{w}'" for w in D.COMMON_WORDS)
_SOLID = r"regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')"

DIVERGENCE = rf"""
WITH base AS (
  SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT doc_id, lang, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, {_SOLID} AS solid,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM base),
trigrams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) >= 3)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (
      SELECT doc_id, i FROM trigrams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1))
  GROUP BY doc_id),
counts AS (
  SELECT s.doc_id, lang, len(w) AS n_words, length(solid) AS word_chars,
    length(regexp_replace(solid, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    length(regexp_replace(solid, '\P{{Ll}}+', '', 'g')) AS b_lower, length(regexp_replace(solid, '\P{{Lu}}+', '', 'g')) AS b_upper,
    length(regexp_replace(solid, '\P{{Nd}}+', '', 'g')) AS b_digit,
    length(regexp_replace(regexp_replace(solid, '[#*$%&|<>]+', '', 'g'), '\P{{P}}+', '', 'g')) AS b_punct
  FROM split s LEFT JOIN covered c USING (doc_id)),
plain AS (
  SELECT doc_id, regexp_replace(lower(unnest(w)), '[.,;:!?]+$', '') AS t FROM split),
frequent AS (
  SELECT doc_id, t, count(*) AS c FROM plain WHERE t IN ({_QUOTED}) GROUP BY doc_id, t),
histogram AS (
  SELECT doc_id, lang, 'class' AS kind, unnest(['lower', 'upper', 'digit', 'symbol', 'punct', 'other']) AS bin,
    unnest([b_lower, b_upper, b_digit, n_symbols, b_punct,
      word_chars - b_lower - b_upper - b_digit - n_symbols - b_punct]) AS c FROM counts
  UNION ALL
  SELECT doc_id, lang, 'word', bin, coalesce(f.c, 0) FROM counts CROSS JOIN (SELECT unnest([{_QUOTED}]) AS bin)
    LEFT JOIN (SELECT doc_id, t AS bin, c FROM frequent) f USING (doc_id, bin)
  UNION ALL
  SELECT doc_id, lang, 'word', ' other', n_words - coalesce(f.c, 0) FROM counts
    LEFT JOIN (SELECT doc_id, sum(c) AS c FROM frequent GROUP BY doc_id) f USING (doc_id)),
sums AS (SELECT lang, kind, bin, sum(c) AS s FROM histogram GROUP BY lang, kind, bin),
lang_words AS (SELECT lang, sum(n_words) AS w FROM counts GROUP BY lang),
held AS (
  SELECT h.doc_id AS doc_id, h.kind AS kind, h.bin AS bin, h.c AS c,
    CASE WHEN lw.w - k.n_words >= {D.MIN_REFERENCE_WORDS} THEN s.s - h.c
      WHEN h.kind = 'class' AND (SELECT sum(w) FROM lang_words) - k.n_words >= {D.MIN_REFERENCE_WORDS} THEN a.s - h.c END AS r
  FROM histogram h JOIN counts k ON k.doc_id = h.doc_id LEFT JOIN lang_words lw ON lw.lang = h.lang
    LEFT JOIN sums s ON s.lang = h.lang AND s.kind = h.kind AND s.bin = h.bin
    LEFT JOIN (SELECT kind, bin, sum(s) AS s FROM sums GROUP BY kind, bin) a ON a.kind = h.kind AND a.bin = h.bin),
shares AS (
  SELECT doc_id, kind, c / greatest(sum(c) OVER (PARTITION BY doc_id, kind), 1) AS p,
    r / greatest(sum(r) OVER (PARTITION BY doc_id, kind), 1) AS q FROM held WHERE r IS NOT NULL),
distances AS (
  SELECT doc_id, kind, sqrt(greatest(sum(
    (CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2), 0)) AS d
  FROM shares GROUP BY doc_id, kind),
least_distance AS (
  SELECT doc_id, min(d) FILTER (kind = 'class') AS class_d, min(d) FILTER (kind = 'word') AS word_d FROM distances GROUP BY doc_id),
judged AS (
  SELECT *, n_words < {D.MIN_WORDS} OR 100 * n_repeat_words > {D.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM counts LEFT JOIN least_distance USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (word_chars < {D.MIN_CHARS} OR coalesce(class_d, 0) <= {D.MAX_CLASS_DISTANCE})
    AND (n_words < {D.MIN_HISTOGRAM_WORDS} OR coalesce(word_d, 0) <= {D.MAX_WORD_DISTANCE}) AS kept
FROM judged
"""

#: A weighted Jaccard join over five-word shingles, and classes by walking its links.
NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
bags AS (
  SELECT doc_id, g, count(*) AS c FROM (
    SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0))
  GROUP BY doc_id, g),
sizes AS (SELECT doc_id, sum(c) AS n FROM bags GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS s FROM bags a JOIN bags b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE s >= 0.8 * (x.n + y.n - s)),
walk AS (
  SELECT doc_id, doc_id AS seen FROM words
  UNION
  SELECT doc_id, b FROM walk JOIN links ON seen = a)
SELECT doc_id, min(seen) AS class_id FROM walk GROUP BY doc_id
"""

#: Every order of five filters over masks, the fifth by the least id of each text.
FILTER_AUDIT = r"""
WITH RECURSIVE letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT '' AS o UNION ALL SELECT o || f FROM orders, letters WHERE len(o) < 5 AND NOT contains(o, f)),
steps AS (
  SELECT o AS filter_order, s AS step, o[s] AS f, o[1:s - 1] AS earlier FROM orders, unnest(range(1, 6)) AS r(s) WHERE len(o) = 5),
words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
fails AS (
  SELECT part, g.doc_id IS NOT NULL AS good, x.doc_id IS NOT NULL AS toxic,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * len(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN words.doc_id > min(words.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS m
  FROM words LEFT JOIN good g ON g.doc_id = words.doc_id LEFT JOIN toxic x ON x.doc_id = words.doc_id),
masks AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM fails GROUP BY part, m),
judged AS (
  SELECT part, filter_order, step, f, n, g, x, contains(m, f) AS failed, m = f AS only_this,
    earlier <> '' AND translate(m, earlier, '') <> m AS gone
  FROM masks, steps),
counted AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT failed AND NOT gone), 0) AS kept,
    coalesce(sum(n) FILTER (failed AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (failed AND gone), 0) AS redundant,
    coalesce(sum(n) FILTER (only_this), 0) AS unique_fails, coalesce(sum(g) FILTER (failed AND NOT gone), 0) AS good_lost,
    coalesce(sum(x) FILTER (failed AND NOT gone), 0) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""

#: Term counts by plain grouping.
SOURCE_AUDIT = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
hits AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM hits GROUP BY lang, term HAVING count(*) >= 30),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, sum(h.n) AS n FROM hits h JOIN kept k USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
shares AS (
  SELECT g.lang AS lang, g.source AS source, k.term AS term, coalesce(c.n, 0) AS n,
    1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // CAST(g.total + 5 * s.v AS HUGEINT) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (k.n + 5) // CAST(s.total + 5 * s.v AS HUGEINT) AS q
  FROM totals g JOIN kept k ON g.lang = k.lang JOIN sizes s ON s.lang = g.lang
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
gaps AS (
  SELECT a.lang AS lang, a.source AS source, b.source AS item, sum(abs(a.p - b.p)) AS f
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows_ AS (
  SELECT a.lang AS lang, a.source AS source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN gaps ON gaps.lang = a.lang AND gaps.source = a.source AND gaps.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows_)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

#: The same queues and finish times by windows over whole sources.
MIXING = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')) AS shuffled FROM documents),
sources AS (
  SELECT *, [5, 2, 1][(number - 1) % 3 + 1] AS weight FROM (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS number FROM d GROUP BY source)),
levels AS (SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS level FROM sources),
shares AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY level, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY level, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS share FROM levels),
level AS (SELECT share AS best FROM shares WHERE share <= level ORDER BY level, number LIMIT 1),
targets AS (SELECT source, number, source_size, coalesce(least(CAST(3 * source_size AS DOUBLE), (SELECT best FROM level) * weight), 0.0) AS target FROM sources),
queued AS (
  SELECT r, doc_id, size, number, source_size, target,
    coalesce(sum(size) OVER (PARTITION BY number ORDER BY shuffled, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN targets ON d.source IS NOT DISTINCT FROM targets.source),
copies AS (
  SELECT r, number, size, target, before + e * source_size AS start FROM queued, (SELECT unnest([0, 1, 2]) AS e)
  WHERE size > 0 AND before + e * source_size < ceil(target)),
served AS (
  SELECT r, number, start, CAST(start + size AS DOUBLE) / target AS finish, least(size, CAST(ceil(target) AS BIGINT) - start) AS served FROM copies),
cut AS (
  SELECT r, greatest(0, least(served, (SELECT sum(size) FROM d) - coalesce(sum(served) OVER (
    ORDER BY finish, number, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS taken FROM served)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM queued LEFT JOIN (SELECT r, sum(taken) AS taken FROM cut GROUP BY r) USING (r)
"""

ORACLES = {
    "op1_bag_minhash": NEAR_DUPLICATES,
    "op2_divergence_rules": DIVERGENCE,
    "op11_retraction_audit": FILTER_AUDIT,
    "op12_pointer_sort_audit": SOURCE_AUDIT,
    "op13_fair_queueing": MIXING,
}
