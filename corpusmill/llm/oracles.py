"""SQL counterparts, for DuckDB, of the operators that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op2_jaccard_forest": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * k >= 4 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a AS a, link.b AS b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id AS doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = d.doc_id), d.doc_id)) AS class_id,
  coalesce((SELECT count(*) FROM link WHERE link.a = d.doc_id), 0) AS n_links
FROM d LEFT JOIN n USING (doc_id)
""",
    "op3_quality_cascade": f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents
),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 7], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS p FROM d WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, p FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM twice) GROUP BY doc_id),
m AS (
  SELECT d.doc_id AS doc_id, t, ws, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    length(regexp_replace(t, '\\P{{L}}+', '', 'g')) AS letters, length(regexp_replace(t, '\\P{{Lu}}+', '', 'g')) AS upper_letters,
    length(regexp_replace(t, '[^.!?。！？]', '', 'g')) AS stops, len(list_distinct(list_transform(ws, lambda w: lower(w)))) AS n_distinct,
    len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_same
  FROM d LEFT JOIN rep USING (doc_id)
),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols > 0.1 * n_words OR word_chars < 2.5 * n_words OR word_chars > 12 * n_words OR 2 * n_dup_lines > n_lines
    OR letters < 0.7 * word_chars OR 2 * upper_letters > letters OR stops > 0.5 * n_words OR (10 * n_distinct < n_words AND n_distinct * n_distinct < 10 * n_words) OR n_same > 0.3 * n_words) AS kept
FROM j
""",
    "op4_golden_mix": f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)
),
l AS (
  SELECT *, row_number() OVER o AS nth, 3 * source_size / weight AS per_weight,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY 3 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM s WINDOW o AS (ORDER BY 3 * source_size / weight, rank)
),
free AS (SELECT min(nth) AS nth, arg_min(level, nth) AS level FROM l WHERE per_weight > level),
t AS (
  SELECT l.source AS source, l.source_size AS source_size,
    CASE WHEN free.nth IS NULL OR l.nth < free.nth THEN CAST(3 * l.source_size AS DOUBLE) ELSE free.level * l.weight END AS target
  FROM l, free
),
p AS (
  SELECT d.doc_id AS doc_id, d.source AS source, size, source_size, target, CAST(round(target) AS BIGINT) AS goal, pass,
    md5('1:' || pass || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, (SELECT unnest(range(0, 3)) AS pass)
),
r AS (SELECT *, pass * source_size + sum(size) OVER (PARTITION BY source, pass ORDER BY key, size, doc_id ROWS UNBOUNDED PRECEDING) AS stop FROM p)
SELECT doc_id, size, source_size, target, CAST(sum(greatest(0, least(stop, goal) - (stop - size))) AS BIGINT) AS taken
FROM r GROUP BY doc_id, size, source_size, target
""",
    "op6_previous_factors": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, substring(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first FROM w) WHERE first < doc_id),
gap AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM hit),
run AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM gap),
span AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY doc_id, r),
piece AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM span),
kept AS (
  SELECT doc_id, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substring(any_value(h), 2 * max(b) + 1) AS h,
    sum(b - a) AS n_removed, count(*) AS n_spans
  FROM piece JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id AS doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op8_wu_manber": f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS ws FROM documents),
i AS (SELECT item_id, {_ITEM_WORDS} AS ws FROM benchmark),
pats AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(ws), 10) AS k, array_to_string(ws[p:p + least(len(ws), 10) - 1], ' ') AS pat
  FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS p FROM i WHERE len(ws) > 0)
),
dw AS (
  SELECT doc_id, k, p, array_to_string(ws[p:p + k - 1], ' ') AS pat
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM pats) WHERE len(ws) >= k)
),
hit AS (SELECT doc_id, p, dw.k AS k, item FROM dw JOIN pats ON dw.pat = pats.pat AND dw.k = pats.k),
spots AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id AS doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op12_rollup_phrases": rf"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
),
g AS (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(ws) >= m) GROUP BY ALL
),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE m >= 2 AND f >= 30),
cut AS (SELECT lang, m, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
best AS (
  SELECT cut.lang AS lang, cut.phrase AS phrase, a, h.f AS l, t.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (h.f + t.f) AS BIGINT) AS score
  FROM cut JOIN g h ON h.lang = cut.lang AND h.phrase = cut.head JOIN g t ON t.lang = cut.lang AND t.phrase = cut.tail
  QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY score, k) = 1
),
part AS (SELECT lang, ws, a, m, unnest(range(2, m)) AS j FROM c WHERE m > 2),
inside AS (SELECT lang, array_to_string(ws[i:i + j - 1], ' ') AS phrase, max(a) AS around FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM part) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE around IS NULL OR 100 * around < 80 * a)
SELECT kept.lang AS lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
""",
    "op13_filter_audit": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, doc_id, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
    regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS fails
  FROM d
),
cell AS (SELECT part, fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 3, 4, 5]) AS i),
grown AS (SELECT '' AS o UNION ALL SELECT o || c FROM grown, letter WHERE NOT contains(o, c)),
spot AS (SELECT o, step, substring(o, step, 1) AS c, ord(substring(o, step, 1)) - 64 AS i FROM grown, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE length(o) = 5),
judged AS (
  SELECT part, o, step, c, n, good, toxic, fails[i] AS failed, len(list_filter(range(1, step), lambda k: fails[ord(substring(o, k, 1)) - 64])) > 0 AS gone,
    len(list_filter(fails, lambda x: x)) = 1 AS alone
  FROM cell, spot
),
r AS (
  SELECT part, o AS filter_order, step, c, CAST(sum(CASE WHEN NOT gone AND NOT failed THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN failed AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN failed AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN failed AND alone THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN failed AND NOT gone THEN n * good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN failed AND NOT gone THEN n * toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM judged GROUP BY part, o, step, c
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley
FROM r
""",
}
