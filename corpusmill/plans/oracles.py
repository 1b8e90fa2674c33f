"""The same results in plain SQL over the given tables, written without the operators' own rules where possible."""

from __future__ import annotations

from corpusmill.sources import derived

TOKENS = r"greatest(len(regexp_extract_all({t}, '\p{{L}}+|\p{{N}}+|[^\s\p{{L}}\p{{N}}]')), least(strlen({t}), 1))"


def tokens(text: str) -> str:
    return TOKENS.format(t=text)


def lines(text: str) -> str:
    return (
        f"(length({text}) - length(replace({text}, chr(10), ''))"
        f" + CASE WHEN length({text}) > 0 AND NOT suffix({text}, chr(10)) THEN 1 ELSE 0 END)"
    )


def sha16(text: str) -> str:
    return f"substr(sha256({text}), 1, 16)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _filled(template: str) -> str:
    return f"replace(replace({quoted(template)}, '{{k}}', k::VARCHAR), '{{m}}', (k % 20)::VARCHAR)"


def _code_cte() -> str:
    content, path = [], []
    for lang, (head, method, tail) in derived.CODE_TEMPLATES.items():
        body = (
            "array_to_string(list_transform(range(n), lambda i: "
            f"replace(replace({quoted(method)}, '{{i}}', i::VARCHAR), '{{k}}', k::VARCHAR)), '')"
        )
        content.append(f"WHEN '{lang}' THEN {_filled(head)} || {body} || {_filled(tail)}")
        path.append(f"WHEN '{lang}' THEN {_filled(derived.CODE_PATHS[lang])}")
    langs = ", ".join(quoted(x) for x in derived.CODE_LANGUAGES)
    return (
        f"code AS (SELECT k, n, lang, CASE lang {' '.join(path)} END AS relative_path,"
        f" CASE lang {' '.join(content)} END AS content FROM ("
        f"SELECT o_orderkey AS k, (o_custkey % {derived.METHODS_PER_FILE} + 1)::INT AS n,"
        f" [{langs}][(o_orderkey % 5 + 1)::INT] AS lang FROM orders))"
    )


CODE = _code_cte()
DOCS = (
    "docs AS (SELECT doc_id, text AS content, source || '/' || lang || '/doc_' || doc_id || '.txt' AS relative_path,"
    " strlen(text) AS size_bytes FROM documents)"
)
SUFFIXES = ", ".join(quoted(s) for s in derived.ROUTED_SUFFIXES)
ROUTED = f"""
raw AS (
  SELECT doc_id, source || '/' || CASE WHEN doc_id % 17 = 0 THEN 'build/' ELSE '' END || lang || '/doc_' || doc_id
         || [{SUFFIXES}][(doc_id % 10 + 1)::INT] AS relative_path,
    CASE WHEN doc_id % 13 = 0 THEN '// Code Generated By a tool' || chr(10) ELSE '' END
    || CASE WHEN doc_id % 19 = 0 THEN repeat(chr(1), 2000) ELSE '' END
    || CASE WHEN doc_id % 7 = 0 THEN replace(text, chr(10), ' ') ELSE text END AS content
  FROM documents),
sized AS (SELECT *, strlen(content) AS size_bytes, {lines('content')} AS line_count FROM raw),
routed AS (
  SELECT *, CASE doc_id % 10 WHEN 0 THEN 'java' WHEN 1 THEN 'python' WHEN 9 THEN 'javascript' ELSE 'unknown' END AS language,
    CASE WHEN doc_id % 10 IN (5, 6) THEN 'skip_extension'
         WHEN doc_id % 10 = 8 THEN 'skip_filename'
         WHEN doc_id % 13 = 0 THEN 'generated'
         WHEN line_count < 5 AND size_bytes > 5000 THEN 'minified'
         WHEN doc_id % 19 = 0 THEN 'binary_content' END AS skip_reason
  FROM sized),
categorised AS (
  SELECT *, CASE WHEN skip_reason IS NOT NULL THEN 'skipped'
                 WHEN doc_id % 10 IN (0, 1, 9) THEN 'source' ELSE 'config' END AS category
  FROM routed)"""


def _dirty(text: str, key: str) -> str:
    run = f"repeat(chr(10), ({key} % 7)::INT)"
    inner = (
        f"replace({text}, chr(10), CASE WHEN {key} % 3 = 0 THEN ' ' || chr(9) || ' ' ELSE '' END || chr(10) || {run})"
    )
    return f"{run} || {inner} || CASE WHEN {key} % 5 = 0 THEN '  ' ELSE '' END || {run}"


# Cleaning restated over a list of lines: number the blank lines of each run, keep the first two.
CLEANED = f"""
dirty AS (SELECT doc_id, source, {_dirty('text', 'doc_id')} AS content FROM documents),
numbered AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS i, rtrim(unnest(parts), ' ' || chr(9)) AS line
  FROM (SELECT doc_id, string_split(content, chr(10)) AS parts FROM dirty)),
runs AS (SELECT *, sum((line <> '')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM numbered),
ranked AS (
  SELECT *, sum((line = '')::INT) OVER (PARTITION BY doc_id, island ORDER BY i) AS blank_no FROM runs),
clean AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text
  FROM ranked WHERE line <> '' OR blank_no <= 2 GROUP BY doc_id)"""

# The files of types in types.
NESTED = """
nested AS (
  SELECT *, CASE lang WHEN 'java' THEN 'src/main/java/com/shop/n' || m || '/Part' || k || '.java' WHEN 'python' THEN 'app' || m || '/python/shop/parts/part' || k || '.py'
    WHEN 'go' THEN 'pkg/parts' || m || '/part' || k || '.go' ELSE 'web/lib/n' || m || '/part' || k || '.ts' END AS relative_path
  FROM (SELECT p_partkey AS k, p_partkey % 20 AS m, p_size % 5 + 1 AS n, ['java', 'python', 'go', 'typescript'][p_partkey % 4 + 1] AS lang FROM part))"""
_n = "' || chr(10) || '"
_java_notes = f"""'@Service|@RequestMapping({_n}    value = "/parts#",{_n}    produces = {{"text/plain", "a;b"}}{_n})'"""
_python_notes = f"""'@register({_n}    "part#",{_n}    kinds=["a", "b"],{_n})'"""
_ts_notes = f"""'@Component({{{_n}  selector: ''part'', items: [''a;'', ''}}''],{_n}}})'"""


ORACLES: dict[str, str] = {
    "file_inventory": f"""
WITH {CODE}, {DOCS}, both_ AS (
  SELECT relative_path, CASE WHEN lang IS NULL THEN 'unknown' ELSE lang END AS language, content
  FROM (SELECT relative_path, NULL AS lang, content FROM docs UNION ALL SELECT relative_path, lang, content FROM code))
SELECT relative_path, language, {sha16('content')} AS content_hash, strlen(content) AS size_bytes,
       {lines('content')} AS line_count FROM both_""",
    "dir_and_size_filter": f"""
WITH {ROUTED} SELECT relative_path, size_bytes FROM sized
WHERE doc_id % 17 <> 0 AND size_bytes BETWEEN 1000 AND 20000""",
    "text_validity": f"""
SELECT doc_id, strlen(text) + CASE WHEN doc_id % 2 = 0 THEN length(text) - length(replace(text, chr(10), '')) ELSE 0 END AS size_bytes,
       {sha16('text')} AS content_hash, {lines('text')} AS line_count
FROM documents WHERE doc_id % 9 <> 0""",
    "distinct_paths": f"WITH {DOCS} SELECT relative_path, {sha16('content')} AS content_hash, size_bytes FROM docs",
    "relative_paths": "SELECT page_id, regexp_replace(url, '^https?://', '') AS relative_path FROM pages",
    "routed_files": f"WITH {ROUTED} SELECT relative_path, language, category, skip_reason FROM categorised",
    "skip_reasons": f"""
WITH {ROUTED} SELECT skip_reason, count(*) AS files FROM categorised WHERE skip_reason IS NOT NULL GROUP BY 1""",
    "category_totals": f"""
WITH {ROUTED} SELECT coalesce(category, 'total') AS category, count(*) AS files, sum(line_count) AS lines,
       sum(size_bytes) AS bytes FROM categorised GROUP BY ROLLUP (category)""",
    "language_counts": f"""
WITH {ROUTED} SELECT language, count(*) AS files FROM categorised WHERE category = 'source' GROUP BY 1""",
    "clean_text": f"""
WITH {CLEANED} SELECT doc_id, sha256(text) AS clean_sha, {lines('text')} AS line_count FROM clean""",
    "cleaned_files": f"""
WITH {CLEANED}, joined AS (
  SELECT d.doc_id, d.source || '/doc_' || d.doc_id || CASE WHEN d.doc_id % 2 = 0 THEN '.py' ELSE '.md' END AS relative_path,
         d.content AS raw, c.text AS clean, {lines('d.content')} AS raw_lines, strlen(d.content) AS size_bytes
  FROM dirty d JOIN clean c USING (doc_id)),
kinds AS (
  SELECT *, CASE WHEN raw_lines < 5 AND size_bytes > 5000 THEN 'skipped' WHEN doc_id % 2 = 0 THEN 'source' ELSE 'config' END AS category
  FROM joined)
SELECT relative_path, category, {sha16('raw')} AS content_hash,
       CASE WHEN category = 'source' THEN {sha16('clean')} END AS clean_hash, size_bytes,
       CASE WHEN category = 'source' THEN {lines('clean')} ELSE raw_lines END AS line_count
FROM kinds""",
    "token_stats": f"""
SELECT count(*) AS chunks, (sum(t) // count(*))::BIGINT AS avg_tokens, max(t)::BIGINT AS max_tokens
FROM (SELECT {tokens('text')} AS t FROM documents)""",
    "token_counts": f"SELECT doc_id, ({tokens('text')})::INT AS tokens FROM documents",
    "duplicate_groups": f"""
WITH {DOCS} SELECT {sha16('any_value(content)')} AS content_hash, count(*) AS copies, min(relative_path) AS first_path
FROM docs GROUP BY sha256(content) HAVING count(*) > 1""",
    "largest_files": f"""
WITH {DOCS} SELECT relative_path, {lines('content')} AS line_count FROM docs ORDER BY 2 DESC, 1 LIMIT 20""",
    "guess_package": f"""
WITH {CODE} SELECT relative_path, CASE lang
  WHEN 'java' THEN 'com.shop.o' || k % 20 WHEN 'python' THEN 'shop.orders' WHEN 'go' THEN 'orders' || k % 20
  ELSE 'orders' || k % 20 END AS package FROM code""",
    "class_names": f"""
WITH {CODE}, named AS (SELECT relative_path, CASE lang
  WHEN 'java' THEN 'Order' || k || 'Controller,of'
  WHEN 'python' THEN 'Order' || k || ',of' WHEN 'go' THEN 'Order' || k || ',Reader' || k
  ELSE 'Order' || k END AS names FROM code)
SELECT relative_path, names, len(string_split(names, ','))::INT AS n FROM named""",
    "display_names": f"""
WITH {DOCS} SELECT relative_path, 'doc_' || doc_id || '.txt' AS name, '.txt' AS ext, md5(substr(content, 1, 80)) AS head_md5, md5(substr(content, 81)) AS rest_md5 FROM docs""",
}


def _line_walk(limit: int, source: str) -> str:
    """CTEs: every line with its cost, and a recursive walk that numbers the bins of each file."""
    return f"""
split_ AS (SELECT relative_path, generate_subscripts(parts, 1) AS i, unnest(parts) AS line
           FROM (SELECT relative_path, string_split(content, chr(10)) AS parts FROM {source})),
cost_ AS MATERIALIZED (SELECT *, {tokens("(line || chr(10))")} AS c FROM split_),
walk AS (
  SELECT relative_path, i, c::BIGINT AS s, 0 AS bin FROM cost_ WHERE i = 1
  UNION ALL
  SELECT n.relative_path, n.i, CASE WHEN w.s + n.c > {limit} THEN n.c ELSE w.s + n.c END,
         CASE WHEN w.s + n.c > {limit} THEN w.bin + 1 ELSE w.bin END
  FROM walk w JOIN cost_ n ON n.relative_path = w.relative_path AND n.i = w.i + 1),
line_chunks AS MATERIALIZED (
  SELECT relative_path, bin, sum(c)::BIGINT AS token_count, string_agg(line, chr(10) ORDER BY i) AS content
  FROM walk JOIN cost_ USING (relative_path, i) GROUP BY ALL)"""


def _document_chunks(limit: int) -> str:
    return f"""
{DOCS}, counted AS MATERIALIZED (SELECT *, {tokens("content")} AS t FROM docs),
long_ AS (SELECT * FROM counted WHERE t > {limit}), {_line_walk(limit, "long_")},
chunks AS MATERIALIZED (
  SELECT relative_path, 0 AS ordinal, relative_path || ':full' AS chunk_id, t AS token_count, content FROM counted WHERE t <= {limit}
  UNION ALL
  SELECT relative_path, bin, relative_path || ':lc' || bin, token_count, content FROM line_chunks)"""


def _pack_walk(limit: int, group: str) -> str:
    """A recursive walk over all chunks in order: the reference packing, one row at a time."""
    return f"""
seq AS MATERIALIZED (SELECT *, {group} AS g, token_count > {limit // 2} AS big,
        row_number() OVER (PARTITION BY {group} ORDER BY relative_path, ordinal) AS i FROM chunks),
pack AS (
  SELECT g, i, token_count AS s, big, 0 AS p FROM seq WHERE i = 1
  UNION ALL
  SELECT n.g, n.i, CASE WHEN n.big OR w.big OR w.s + greatest(n.token_count, 1) > {limit} THEN n.token_count ELSE w.s + greatest(n.token_count, 1) END,
         n.big, CASE WHEN n.big OR w.big OR w.s + greatest(n.token_count, 1) > {limit} THEN w.p + 1 ELSE w.p END
  FROM pack w JOIN seq n ON n.g = w.g AND n.i = w.i + 1),
packed AS (SELECT seq.*, p FROM seq JOIN pack USING (g, i))"""


ORACLES |= {
    "file_order": f"WITH {DOCS} SELECT relative_path, row_number() OVER (ORDER BY relative_path) - 1 AS ordinal FROM docs",
    "whole_file_chunks": f"""
WITH {CODE}, counted AS (SELECT *, {tokens("content")} AS t FROM code)
SELECT relative_path || ':full' AS chunk_id, t AS token_count, sha256(content) AS sha, CASE lang
  WHEN 'java' THEN 'Order' || k || 'Controller,of' WHEN 'python' THEN 'Order' || k || ',of'
  WHEN 'go' THEN 'Order' || k || ',Reader' || k ELSE 'Order' || k END AS names
FROM counted WHERE t <= 300""",
    "line_chunks": f"""
WITH RECURSIVE {DOCS}, {_line_walk(200, "docs")}
SELECT relative_path || ':lc' || bin AS chunk_id, bin AS ordinal, token_count, sha256(content) AS sha FROM line_chunks""",
    "chunk_stats": f"""
WITH RECURSIVE {DOCS}, {_line_walk(200, "docs")}
SELECT count(*) AS chunks, (sum(token_count) // count(*))::BIGINT AS avg_tokens, max(token_count) AS max_tokens FROM line_chunks""",
    "batch_packs": f"""
WITH RECURSIVE {_document_chunks(1000)}, {_pack_walk(1000, "split_part(relative_path, '/', 1)")}
SELECT chunk_id, first_value(chunk_id) OVER (PARTITION BY g, p ORDER BY i) AS first_chunk FROM packed""",
    "batch_packs_one_sequence": f"""
WITH RECURSIVE {_document_chunks(1000)}, {_pack_walk(1000, "0")}
SELECT min_by(chunk_id, i) AS first_chunk, count(*) AS chunks, sum(token_count) AS tokens FROM packed GROUP BY p""",
    "merged_batches": f"""
WITH RECURSIVE {_document_chunks(1000)}, {_pack_walk(1000, "0")},
merged AS (
  SELECT p, bool_or(big) AS big, min_by(chunk_id, i) AS first_id, count(*) AS members, max(token_count) AS t,
    CASE WHEN bool_or(big) THEN max(content)
         ELSE string_agg('### File: ' || relative_path || chr(10) || '### Language: unknown' || chr(10) || '---' || chr(10) || content,
                         chr(10) || chr(10) ORDER BY i) END AS content,
    array_to_string(list_distinct(list(relative_path)), ',') AS files
  FROM packed GROUP BY p),
ordered AS (SELECT p, string_agg(relative_path, ',' ORDER BY i) AS source_files FROM (SELECT p, relative_path, min(i) AS i FROM packed GROUP BY ALL) GROUP BY p)
SELECT CASE WHEN big THEN first_id ELSE 'batch_' || first_id END AS chunk_id,
       CASE WHEN big THEN t ELSE {tokens("content")} END AS token_count, members, sha256(content) AS sha, source_files
FROM merged JOIN ordered USING (p)""",
}

CHUNKED = """
ch AS (SELECT doc_id, source, lang, n_chars, text AS content, source || '/doc_' || doc_id || '.txt' AS path,
              source || '/doc_' || doc_id || '.txt:full' AS chunk_id, ceil(n_chars / 4)::BIGINT AS tokens FROM documents)"""
HIT = "(doc_id % 3 = 0 AND doc_id % 30 <> 0 AND doc_id % 21 <> 0)"
USER = """('Files: ' || path || chr(10) || 'Language: ' || lang || chr(10)
  || 'Classes: ' || CASE WHEN doc_id % 2 = 0 THEN 'A, B' ELSE 'N/A' END || chr(10)
  || 'Functions: ' || array_to_string(list_transform(range(doc_id % 20 + 1), lambda i: 'f' || i), ', ')
  || chr(10) || chr(10) || content || chr(10) || chr(10)
  || 'Describe this code as JSON with the keys file_path, summary, purpose, key_methods (name, signature, description, complexity),'
  || ' dependencies, complexity_score (1 to 10) and complexity_notes.')"""
SYSTEM = "('You read ' || lang || ' source code and answer with one JSON object and nothing else.')"
NO_ANSWER, NO_OBJECT = "doc_id % 11 = 0", "doc_id % 8 >= 6"
RUN = f"""
{CHUNKED},
missing AS (SELECT *, {tokens("(" + SYSTEM + " || " + USER + ")")} AS est FROM ch WHERE NOT {HIT}),
decided AS (SELECT *, sum(est * 0.00000015::DECIMAL(18,10)) OVER (ORDER BY path, doc_id) < 0.03 AS admitted FROM missing),
results AS (
  SELECT chunk_id, doc_id, 'cached' AS status, NULL AS error, (doc_id % 10 + 1)::VARCHAR AS score FROM ch WHERE {HIT}
  UNION ALL
  SELECT chunk_id, doc_id, CASE WHEN NOT admitted OR {NO_ANSWER} OR {NO_OBJECT} THEN 'error' ELSE 'fresh' END,
    CASE WHEN NOT admitted THEN 'budget exceeded' WHEN {NO_ANSWER} THEN 'no answer' WHEN {NO_OBJECT} THEN 'parse failed' END,
    CASE WHEN admitted AND NOT ({NO_ANSWER}) AND NOT ({NO_OBJECT}) THEN json_extract_string(props, '$.k') END
  FROM decided LEFT JOIN events ON event_id = doc_id)"""
SECOND = f"""
{RUN},
left_ AS (SELECT m.* FROM missing m JOIN results r USING (chunk_id) WHERE r.status = 'error'),
again AS (SELECT *, sum(est * 0.00000015::DECIMAL(18,10)) OVER (ORDER BY path, doc_id) < 0.03 AS ok FROM left_),
second_ AS (
  SELECT 'cached' AS status, NULL AS error FROM results WHERE status <> 'error'
  UNION ALL
  SELECT CASE WHEN NOT ok OR {NO_ANSWER} OR {NO_OBJECT} THEN 'error' ELSE 'fresh' END,
    CASE WHEN NOT ok THEN 'budget exceeded' WHEN {NO_ANSWER} THEN 'no answer' WHEN {NO_OBJECT} THEN 'parse failed' END
  FROM again)"""
TYPED = """
typed AS (
  SELECT d.doc_id, source || '/' || d.doc_id AS file_path, CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE lang END AS summary, '' AS purpose,
    CASE WHEN d.doc_id % 3 = 0 THEN 0 ELSE 1 END AS methods,
    CASE WHEN d.doc_id % 3 <> 0 THEN n_chars % 10 END AS first_complexity,
    source || ',' || lang AS dependencies, source, lang,
    CASE d.doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN n_chars % 10 + 1 WHEN 2 THEN 0 ELSE coalesce(quality, 3) END AS complexity_score,
    d.doc_id % 4 = 2 AS _corrupt
  FROM documents d LEFT JOIN labels USING (doc_id))"""

ORACLES |= {
    "cache_keys": f"""
WITH {CHUNKED} SELECT chunk_id, {sha16("content")} AS chunk_hash,
  substr(sha256({sha16("content")} || ':' || chunk_id), 1, 32) AS cache_key FROM ch""",
    "cache_hits": f"WITH {CHUNKED} SELECT chunk_id, (doc_id % 10 + 1)::VARCHAR AS score FROM ch WHERE {HIT}",
    "cache_misses": f"WITH {CHUNKED} SELECT chunk_id FROM ch WHERE NOT {HIT}",
    "cache_stats": f"""
SELECT sum({HIT}::INT) AS hits, sum((NOT {HIT})::INT) AS misses,
  round_even(100.0 * sum({HIT}::INT) / count(*), 0)::INT || '%' AS hit_rate FROM documents""",
    "request_texts": f"""
WITH {CHUNKED} SELECT chunk_id, {tokens("(" + SYSTEM + " || " + USER + ")")} AS est_tokens, sha256({SYSTEM} || {USER}) AS sha FROM ch""",
    "prompt_texts": f"""
WITH {CHUNKED} SELECT chunk_id, sha256('### File: ' || path || chr(10) || '### Language: ' || lang || chr(10)
  || CASE WHEN doc_id % 2 = 0 THEN '### Classes: A, B' || chr(10) ELSE '' END
  || '### Functions: ' || array_to_string(list_transform(range(doc_id % 20 + 1), lambda i: 'f' || i), ', ') || chr(10)
  || '---' || chr(10) || content) AS sha FROM ch""",
    "budget_admission": f"""
WITH {CHUNKED} SELECT source, doc_id,
  sum(tokens * 0.00000015::DECIMAL(18,10)) OVER (ORDER BY source, doc_id) < 0.04 AS admitted FROM ch""",
    "budget_by_source": f"""
WITH {CHUNKED}, c AS (SELECT *, CASE source WHEN 'src0' THEN 0.01 WHEN 'src1' THEN NULL ELSE 0.002 END AS ceiling FROM ch)
SELECT source, doc_id, ceiling IS NULL OR sum(tokens * 0.00000015::DECIMAL(18,10)) OVER (PARTITION BY source ORDER BY doc_id) < ceiling AS admitted FROM c""",
    "usage_report": f"""
WITH {CHUNKED} SELECT sum(tokens) AS input_tokens, sum(n_chars % 100) AS output_tokens, count(*) AS calls,
  round(sum(tokens * 0.00000015::DECIMAL(18,10) + (n_chars % 100) * 0.0000006::DECIMAL(18,10)), 6) AS cost_usd
FROM ch WHERE doc_id % 7 <> 0""",
    "inference_results": f"""
SELECT doc_id, CASE WHEN {NO_ANSWER} OR {NO_OBJECT} THEN 'error' ELSE 'fresh' END AS status,
  CASE WHEN {NO_ANSWER} THEN 'no answer' WHEN {NO_OBJECT} THEN 'parse failed' END AS error,
  CASE WHEN NOT ({NO_ANSWER}) AND NOT ({NO_OBJECT}) THEN json_extract_string(props, '$.k') END AS k
FROM documents LEFT JOIN events ON event_id = doc_id""",
    "prompt_version_miss": """
SELECT 'v1' AS version, count(*) FILTER (doc_id % 3 = 0) AS hits, count(*) AS chunks FROM documents
UNION ALL SELECT 'v2', 0, count(*) FROM documents""",
    "analysis_results": f"WITH {RUN} SELECT chunk_id, status, error, score FROM results",
    "analysis_second_run": f"WITH {SECOND} SELECT status, error, count(*) AS chunks FROM second_ GROUP BY ALL",
    "json_repair": """
SELECT event_id, CASE WHEN event_id % 8 < 6 THEN json_extract_string(props, '$.k') END AS k FROM events""",
    "typed_analysis": f"""
WITH {TYPED} SELECT doc_id, file_path, summary, purpose, methods, first_complexity, dependencies, complexity_score, _corrupt FROM typed""",
    "context_numbers": """
SELECT source, doc_id, ((s - n_chars - 1) // 80000)::BIGINT AS first_context, ((s - 1) // 80000)::BIGINT AS last_context FROM (
  SELECT *, sum(n_chars + 1) OVER (ORDER BY source, doc_id) AS s FROM documents)""",
    "branch_scores": f"""
WITH {CODE}, b AS (SELECT relative_path, CASE lang WHEN 'javascript' THEN 2 * n ELSE n END AS branches FROM code)
SELECT relative_path, branches, 1 + branches // 3 AS score FROM b""",
    "dependency_degree": f"""
WITH {TYPED} SELECT dependency, count(DISTINCT file_path) AS files FROM (
  SELECT file_path, source AS dependency FROM typed UNION ALL SELECT file_path, lang FROM typed) GROUP BY 1""",
    "most_complex_files": f"""
WITH {TYPED} SELECT file_path, complexity_score AS score, '' AS notes FROM typed ORDER BY 2 DESC, 1 LIMIT 25""",
    "key_methods": f"""
WITH {TYPED} SELECT file_path, 'm' || doc_id AS name, first_complexity AS complexity FROM typed WHERE methods = 1
ORDER BY 3 DESC, 1, 2 LIMIT 20""",
    "average_complexity": f"WITH {TYPED} SELECT avg(complexity_score) AS average_complexity FROM typed",
    "top_files_per_source": """
SELECT source, doc_id, n_chars, rank FROM (
  SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents)
WHERE rank <= 3""",
}


# Where the templates put every declaration, by arithmetic on the number of methods.
_I = "CROSS JOIN LATERAL (SELECT unnest(range(n)) AS i)"
SPANS = f"""
{CODE},
types_ AS (
  SELECT relative_path, lang, k, n, 0 AS type_no, 'Order' || k || 'Controller' AS name, 'class' AS kind, 'com.shop.o' || k % 20 AS package,
    'BaseOrder' AS superclass, 'Readable|Comparable<Order' || k || 'Controller>' AS interfaces,
    '@RestController|@RequestMapping("/orders' || k || '")' AS decorators, 9 AS s, 25 + 10 * n AS e FROM code WHERE lang = 'java'
  UNION ALL SELECT relative_path, lang, k, n, 0, 'Order' || k, 'class', 'shop.orders', 'Base', 'Mixin', '@dataclass', 9, 18 + 10 * n FROM code WHERE lang = 'python'
  UNION ALL SELECT relative_path, lang, k, n, 0, 'Order' || k, 'struct', 'orders' || k % 20, '', '', '', 9, 12 FROM code WHERE lang = 'go'
  UNION ALL SELECT relative_path, lang, k, n, 1, 'Reader' || k, 'interface', 'orders' || k % 20, '', '', '', 14, 16 FROM code WHERE lang = 'go'
  UNION ALL SELECT relative_path, lang, k, n, 2, 'helper', 'function', 'orders' || k % 20, '', '', '', 21 + 8 * n, 21 + 8 * n FROM code WHERE lang = 'go'
  UNION ALL SELECT relative_path, lang, k, n, 0, 'Order' || k, 'class', 'orders' || k % 20, 'BaseOrder', '', '', 5, 11 + 8 * n FROM code WHERE lang = 'javascript'
  UNION ALL SELECT relative_path, lang, k, n, 0, 'Line' || k, 'interface', 'orders' || k % 20, '', '', '', 3, 5 FROM code WHERE lang = 'typescript'
  UNION ALL SELECT relative_path, lang, k, n, 1, 'Order' || k, 'class', 'orders' || k % 20, 'BaseOrder', 'Readable', '', 7, 11 + 7 * n FROM code WHERE lang = 'typescript'),
fns_ AS (
  SELECT relative_path, 0 AS type_no, 0 AS fn, 'Order' || k || 'Controller' AS owner, 'Order' || k || 'Controller' AS name, 'void' AS ret,
    'int total' AS params, '' AS deco, true AS pub, 17 AS s, 19 AS e FROM code WHERE lang = 'java'
  UNION ALL SELECT relative_path, 0, i + 1, 'Order' || k || 'Controller', 'line' || i, 'long', '@Param("q") int quantity|List<String> tags',
    '@GetMapping("/lines/' || i || '")', true, 21 + 10 * i, 29 + 10 * i FROM code {_I} WHERE lang = 'java'
  UNION ALL SELECT relative_path, 0, n + 1, 'Order' || k || 'Controller', 'close', 'void', '', '', false, 21 + 10 * n, 24 + 10 * n FROM code WHERE lang = 'java'
  UNION ALL SELECT relative_path, 0, 0, 'Order' || k, '__init__', '', 'self|total', '', false, 15, 16 FROM code WHERE lang = 'python'
  UNION ALL SELECT relative_path, 0, i + 1, 'Order' || k, 'line' || i, 'int', 'self|quantity: int|tags=None', '@cached', true, 19 + 10 * i, 26 + 10 * i FROM code {_I} WHERE lang = 'python'
  UNION ALL SELECT relative_path, 0, n + 1, 'Order' || k, '_close', '', 'self', '', false, 18 + 10 * n, 18 + 10 * n FROM code WHERE lang = 'python'
  UNION ALL SELECT relative_path, 0, i, 'Order' || k, 'Line' || i, '', 'quantity int|tags []string', '', true, 18 + 8 * i, 24 + 8 * i FROM code {_I} WHERE lang = 'go'
  UNION ALL SELECT relative_path, 2, 0, 'helper', 'helper', '', 'n int', '', false, 21 + 8 * n, 21 + 8 * n FROM code WHERE lang = 'go'
  UNION ALL SELECT relative_path, 0, 0, 'Order' || k, 'constructor', '', 'total', '', true, 6, 8 FROM code WHERE lang = 'javascript'
  UNION ALL SELECT relative_path, 0, i + 1, 'Order' || k, 'line' || i, '', 'quantity|tags', '', true, 10 + 8 * i, 16 + 8 * i FROM code {_I} WHERE lang = 'javascript'
  UNION ALL SELECT relative_path, 0, n + 1, 'Order' || k, 'close', '', '', '', true, 10 + 8 * n, 10 + 8 * n FROM code WHERE lang = 'javascript'
  UNION ALL SELECT relative_path, 1, 0, 'Order' || k, 'constructor', '', 'private total: number', '', true, 8, 9 FROM code WHERE lang = 'typescript'
  UNION ALL SELECT relative_path, 1, i + 1, 'Order' || k, 'line' || i, 'number', 'quantity: number|tags: string[]', '', true, 11 + 7 * i, 16 + 7 * i FROM code {_I} WHERE lang = 'typescript')"""


def _script_cte() -> str:
    langs = ", ".join(quoted(x) for x in derived.SCRIPT_PATHS)
    paths = " ".join(f"WHEN '{x}' THEN {_filled(p)}" for x, p in derived.SCRIPT_PATHS.items())
    content = " ".join(
        f"WHEN '{x}' THEN {_filled(head)} || array_to_string(list_transform(range(n), lambda i:"
        f" replace(replace({quoted(method)}, '{{i}}', i::VARCHAR), '{{k}}', k::VARCHAR)), '') || {_filled(tail)}"
        for x, (head, method, tail) in derived.SCRIPT_TEMPLATES.items()
    )
    return (
        f"scripts AS (SELECT k, n, lang, CASE lang {paths} END AS relative_path, CASE lang {content} END AS content"
        f" FROM (SELECT p_partkey AS k, (p_size % 5 + 1)::INT AS n, [{langs}][(p_partkey % 4 + 1)::INT] AS lang FROM part))"
    )


SCRIPTS = _script_cte()


def _typed_walk(limit: int) -> str:
    """All chunks below the whole file, from the known spans: slices, next-fit over functions, then over lines."""
    return f"""
{SPANS},
big AS MATERIALIZED (SELECT relative_path, string_split(content, chr(10)) AS ls FROM code WHERE {tokens("content")} > {limit}),
tt AS MATERIALIZED (SELECT *, {tokens("body")} AS t FROM (
  SELECT t.*, ls, array_to_string(ls[s:e], chr(10)) AS body FROM types_ t JOIN big USING (relative_path))),
ff AS MATERIALIZED (SELECT *, {tokens("body")} AS t,
    row_number() OVER (PARTITION BY relative_path, type_no ORDER BY fn) AS pos FROM (
  SELECT f.*, tt.ls, array_to_string(tt.ls[f.s:f.e], chr(10)) AS body FROM fns_ f JOIN tt USING (relative_path, type_no) WHERE tt.t > {limit})),
heads AS (SELECT tt.relative_path, tt.name, tt.s, coalesce(f.s, tt.e) - 1 AS e, array_to_string(tt.ls[tt.s:coalesce(f.s, tt.e) - 1], chr(10)) AS body
  FROM tt LEFT JOIN ff f ON f.relative_path = tt.relative_path AND f.type_no = tt.type_no AND f.pos = 1 WHERE tt.t > {limit}),
fw AS (
  SELECT relative_path, type_no, pos, t AS w, t > {limit} AS alone, 0 AS g FROM ff WHERE pos = 1
  UNION ALL
  SELECT f.relative_path, f.type_no, f.pos, CASE WHEN f.t > {limit} OR x.alone OR x.w + f.t > {limit} THEN f.t ELSE x.w + f.t END, f.t > {limit},
    CASE WHEN f.t > {limit} OR x.alone OR x.w + f.t > {limit} THEN x.g + 1 ELSE x.g END
  FROM fw x JOIN ff f ON f.relative_path = x.relative_path AND f.type_no = x.type_no AND f.pos = x.pos + 1),
gg AS (SELECT relative_path, type_no, g, any_value(ff.owner) AS owner, min_by(ff.name, pos) AS first_name, max_by(ff.name, pos) AS last_name,
    string_agg(ff.name, ',' ORDER BY pos) AS names, array_to_string(any_value(ff.ls)[min(ff.s):max(ff.e)], chr(10)) AS body
  FROM fw JOIN ff USING (relative_path, type_no, pos) WHERE NOT alone GROUP BY relative_path, type_no, g),
fl AS MATERIALIZED (SELECT relative_path, owner, name, j, line, {tokens("(line || chr(10))")} AS c FROM (
  SELECT relative_path, owner, name, generate_subscripts(string_split(body, chr(10)), 1) AS j, unnest(string_split(body, chr(10))) AS line FROM ff WHERE t > {limit})),
lw AS (
  SELECT relative_path, name, j, c::BIGINT AS w, 0 AS b FROM fl WHERE j = 1
  UNION ALL
  SELECT n.relative_path, n.name, n.j, CASE WHEN w.w + n.c > {limit} THEN n.c ELSE w.w + n.c END, CASE WHEN w.w + n.c > {limit} THEN w.b + 1 ELSE w.b END
  FROM lw w JOIN fl n ON n.relative_path = w.relative_path AND n.name = w.name AND n.j = w.j + 1),
parts AS (SELECT relative_path, name, b, any_value(owner) AS owner, sum(c)::BIGINT AS t, string_agg(line, chr(10) ORDER BY j) AS body
  FROM lw JOIN fl USING (relative_path, name, j) GROUP BY ALL),
taken AS (SELECT DISTINCT relative_path, unnest(range(s, e + 1)) AS l FROM (
  SELECT relative_path, s, e FROM tt WHERE t <= {limit}
  UNION ALL SELECT relative_path, s, e FROM heads WHERE {tokens("body")} > 50
  UNION ALL SELECT relative_path, s, e FROM ff WHERE t > {limit}
  UNION ALL SELECT relative_path, min(ff.s), max(ff.e) FROM fw JOIN ff USING (relative_path, type_no, pos) WHERE NOT alone GROUP BY relative_path, type_no, g)),
free_ AS (SELECT relative_path, l, line, l - row_number() OVER (PARTITION BY relative_path ORDER BY l) AS island FROM (
  SELECT relative_path, generate_subscripts(ls, 1) AS l, unnest(ls) AS line FROM big) ANTI JOIN taken USING (relative_path, l)),
rests AS MATERIALIZED (SELECT relative_path || ':rest' || min(l) AS relative_path, string_agg(line, chr(10) ORDER BY l) AS content
  FROM free_ GROUP BY free_.relative_path, island HAVING bool_or(regexp_matches(line, '\\S'))),
{_line_walk(limit, "rests")},
levels AS (
  SELECT relative_path || ':' || name AS chunk_id, 'type' AS level, t AS token_count, sha256(body) AS sha, name AS class_names,
    coalesce((SELECT string_agg(f.name, ',' ORDER BY fn) FROM fns_ f WHERE f.relative_path = tt.relative_path AND f.type_no = tt.type_no), '') AS function_names
  FROM tt WHERE t <= {limit}
  UNION ALL SELECT relative_path || ':' || name || ':header', 'header', {tokens("body")}, sha256(body), name, '' FROM heads WHERE {tokens("body")} > 50
  UNION ALL SELECT relative_path || ':' || owner || ':' || first_name || '-' || last_name, 'functions', {tokens("body")}, sha256(body), owner, names FROM gg
  UNION ALL SELECT relative_path || ':' || owner || ':' || name || ':f' || b, 'function_part', t, sha256(body), owner, name FROM parts
  UNION ALL SELECT relative_path || '-' || bin, 'rest', token_count, sha256(content), '', '' FROM line_chunks)"""


def _level(limit: int, level: str) -> str:
    return f"WITH RECURSIVE {_typed_walk(limit)} SELECT * FROM levels WHERE level = '{level}'"


ORACLES |= {
    "exploded_lines": f"""
WITH {CODE} SELECT relative_path, len(string_split(content, chr(10))) AS lines,
  length(replace(content, chr(10), '')) AS raw_chars, length(replace(content, chr(10), '')) AS code_chars,
  len(string_split(content, chr(10))) * (len(string_split(content, chr(10))) + 1) // 2 AS line_no_sum FROM code""",
    "declared_types": f"""
WITH {SPANS} SELECT relative_path, name, kind, package || '.' || name AS fqn, superclass, interfaces, decorators, s AS start_line, e AS end_line FROM types_""",
    "docstrings": f"""
WITH {SPANS} SELECT relative_path, name, CASE lang WHEN 'java' THEN 'Lines of one order.' WHEN 'go' THEN 'Order holds lines.'
  ELSE 'Lines of one order.' || chr(10) || chr(10) || '  class of text' END AS docstring
FROM types_ WHERE type_no = 0 AND lang IN ('java', 'python', 'go')""",
    "declared_functions": f"""
WITH {SPANS} SELECT relative_path, owner, name, ret AS return_type, params AS parameters, deco AS decorators, pub AS is_public,
  s AS start_line, e AS end_line FROM fns_""",
    "methods_per_class": f"""
WITH {SPANS} SELECT relative_path, owner, count(*) AS methods FROM fns_ GROUP BY ALL""",
    "imports_by_file": f"""
WITH {CODE} SELECT relative_path, line_no, import_text FROM code JOIN (VALUES
  ('java', 3, 'java.util.List'), ('java', 4, 'static java.lang.Math.max'), ('python', 1, 'import os'),
  ('python', 2, 'from typing import (' || chr(10) || '    List,' || chr(10) || '    Dict,' || chr(10) || ')'),
  ('go', 4, 'fmt'), ('go', 5, 'log "std/log'), ('javascript', 1, 'import {{ a,' || chr(10) || '  b }} from ''shop'';'),
  ('javascript', 3, 'import c from "cart";'), ('typescript', 1, 'import {{ a }} from ''shop'';')) v(lang, line_no, import_text) USING (lang)""",
    "fields_table": f"""
WITH {CODE} SELECT relative_path, CASE lang WHEN 'java' THEN 'Order' || k || 'Controller' ELSE 'Order' || k END AS owner, name, type, line_no
FROM code JOIN (VALUES ('java', 'total', 'int', 13), ('java', 'names', 'List<String>', 14), ('go', 'ID', 'int', 10), ('go', 'Names', '[]string', 11))
  v(lang, name, type, line_no) USING (lang)""",
    "regex_literals": """
SELECT 'lib/scan' || p_partkey || '.js' AS relative_path, owner || p_partkey AS owner, name, s AS start_line, e AS end_line
FROM part, (VALUES ('Scan', '', 1, 8), ('Next', '', 9, 10), ('Scan', 'quotes', 2, 2), ('Scan', 'braces', 3, 6), ('Scan', 'last', 7, 7)) v(owner, name, s, e)""",
    "module_and_generic_types": f"""
WITH {SCRIPTS} SELECT relative_path, CASE lang WHEN 'ruby' THEN 'User' || k WHEN 'javascript' THEN 'tools' ELSE 'module' END AS name,
  CASE lang WHEN 'ruby' THEN 'class' ELSE 'module' END AS kind, CASE lang WHEN 'javascript' THEN 'tools' ELSE '' END AS package,
  CASE lang WHEN 'ruby' THEN 2 ELSE 1 END AS start_line,
  CASE lang WHEN 'ruby' THEN 2 WHEN 'python' THEN 4 * n + 2 ELSE 3 * n + 1 END AS end_line FROM scripts""",
    "module_and_generic_functions": f"""
WITH {SCRIPTS}, placed AS (SELECT *, CASE lang WHEN 'python' THEN 4 * i + 1 WHEN 'ruby' THEN 3 * i + 3 ELSE 3 * i + 1 END AS s FROM scripts {_I})
SELECT relative_path, CASE lang WHEN 'ruby' THEN 'User' || k WHEN 'javascript' THEN 'tools' ELSE 'module' END AS owner,
  CASE lang WHEN 'ruby' THEN 'm' WHEN 'rust' THEN 'calc' ELSE 'f' END || i AS name, s AS start_line,
  s + CASE lang WHEN 'python' THEN 1 WHEN 'javascript' THEN 2 ELSE 0 END AS end_line FROM placed
UNION ALL SELECT relative_path, 'User' || k, 'ready', s + 1, s + 1 FROM placed WHERE lang = 'ruby'""",
    "nested_types": f"""
WITH {NESTED} SELECT relative_path, replace(name, '#', k::VARCHAR) AS name, kind, CASE WHEN inner_ THEN 'Part' || k ELSE '' END AS outer,
  CASE lang WHEN 'java' THEN 'com.shop.n' || m || '.' WHEN 'python' THEN 'shop.parts.' WHEN 'go' THEN 'parts' || m || '.' ELSE 'n' || m || '.' END
    || replace(name, '#', k::VARCHAR) AS fqn,
  docstring, replace(decorators, '#', k::VARCHAR) AS decorators, CASE WHEN lang = 'java' AND NOT inner_ THEN 'service' ELSE '' END AS role, s + sn * n AS start_line, e + en * n AS end_line
FROM nested JOIN (VALUES
  ('java', 'Part#', 'class', false, 'Lots of one part.', {_java_notes}, 6, 0, 17, 4), ('java', 'Lot', 'class', true, '', '', 13, 0, 13, 0),
  ('java', 'State', 'enum', true, '', '', 15, 0, 15, 0), ('python', 'Part#', 'class', false, 'Lots of one part.', {_python_notes}, 5, 0, 11, 5),
  ('python', 'Lot', 'class', true, '', '', 7, 0, 11, 0), ('go', 'Part#', 'struct', false, 'Part is one of them.', '', 6, 0, 9, 0),
  ('go', 'Lister#', 'interface', false, '', '', 10, 0, 10, 0), ('go', 'Count#', 'struct', false, '', '', 11, 0, 11, 0),
  ('go', 'free#', 'function', false, '', '', 14, 1, 14, 1), ('typescript', 'Part#', 'class', false, '', {_ts_notes}, 4, 0, 7, 2)
) v(lang, name, kind, inner_, docstring, decorators, s, sn, e, en) USING (lang)""",
    "nested_functions": f"""
WITH {NESTED}, fixed AS (
  SELECT relative_path, replace(owner, '#', k::VARCHAR) AS owner, replace(name, '#', k::VARCHAR) AS name, ret AS return_type, params AS parameters, '' AS decorators,
    s + sn * n AS start_line, s + el + sn * n AS end_line
  FROM nested JOIN (VALUES ('java', 'Part#', 'reset', 'void', '', 11, 0, 0), ('java', 'Lot', 'id', 'long', '', 13, 0, 0), ('java', 'State', 'open', 'boolean', '', 15, 0, 0),
    ('python', 'Lot', 'size', '', 'self', 8, 0, 0), ('python', 'Lot', 'name', '', 'self', 10, 0, 1), ('go', 'free#', 'free#', '', '', 14, 1, 0),
    ('typescript', 'Part#', 'size', '', '', 4, 0, 0), ('typescript', 'Part#', 'constructor', '', 'private n: number', 5, 0, 0)
  ) v(lang, owner, name, ret, params, s, sn, el) USING (lang))
SELECT * FROM fixed UNION ALL
SELECT relative_path, 'Part' || k, CASE lang WHEN 'go' THEN 'Lot' ELSE 'lot' END || i, CASE lang WHEN 'java' THEN 'String' WHEN 'typescript' THEN 'string' ELSE '' END,
  CASE lang WHEN 'java' THEN '@Param("q") String q' WHEN 'python' THEN 'self|q=(1, 2)' WHEN 'typescript' THEN 'q: string' ELSE '' END,
  CASE lang WHEN 'java' THEN '@GetMapping(' || chr(10) || '        path = "/lots/' || i || '",' || chr(10) || '        params = {{"x", "y"}})'
    WHEN 'python' THEN '@cached(' || chr(10) || '        ttl=' || i || ',' || chr(10) || '    )' WHEN 'typescript' THEN '@Input()' ELSE '' END,
  CASE lang WHEN 'java' THEN 17 + 4 * i WHEN 'python' THEN 16 + 5 * i WHEN 'go' THEN 14 + i ELSE 8 + 2 * i END,
  CASE lang WHEN 'java' THEN 20 + 4 * i WHEN 'python' THEN 16 + 5 * i WHEN 'go' THEN 14 + i ELSE 8 + 2 * i END
FROM nested {_I}""",
    "nested_fields": f"""
WITH {NESTED} SELECT relative_path, replace(owner, '#', k::VARCHAR) AS owner, name, type, line_no FROM nested JOIN (VALUES
  ('java', 'Part#', 'low', 'int', 11), ('java', 'Part#', 'high', 'int', 11), ('java', 'Part#', 'top', 'int', 11), ('java', 'Lot', 'id', 'long', 13),
  ('go', 'Part#', 'ID', 'int', 7), ('go', 'Part#', 'Size', 'int', 7), ('go', 'Part#', 'Names', '[]string', 8)) v(lang, owner, name, type, line_no) USING (lang)""",
    "nested_endpoints": f"""
WITH {NESTED} SELECT relative_path, 'com.shop.n' || m AS package, 'GET' AS method, '/parts' || k || '/lots/' || i AS path, 'Part' || k || '.lot' || i AS handler
FROM nested {_I} WHERE lang = 'java'""",
    "service_pages": f"""
WITH {NESTED}, t AS (
  SELECT relative_path, CASE lang WHEN 'java' THEN 'com.shop.n' || m WHEN 'python' THEN 'shop.parts' WHEN 'go' THEN 'parts' || m ELSE 'n' || m END AS package,
    replace(name, '#', k::VARCHAR) AS name
  FROM nested JOIN (VALUES ('java', 'Part#'), ('java', 'Lot'), ('java', 'State'), ('python', 'Part#'), ('python', 'Lot'), ('go', 'Part#'), ('go', 'Lister#'),
    ('go', 'Count#'), ('go', 'free#'), ('typescript', 'Part#')) v(lang, name) USING (lang)),
members AS (
  SELECT string_split(package, '.')[-1] AS service_name, 'type' AS member, relative_path, package || '.' || name AS item FROM t
  UNION ALL SELECT 'n' || m, 'endpoint', relative_path, 'GET /parts' || k || '/lots/' || i || ' Part' || k || '.lot' || i FROM nested {_I} WHERE lang = 'java')
SELECT service_name, CAST((row_number() OVER (PARTITION BY service_name ORDER BY member, relative_path, item) - 1) // 25 AS BIGINT) AS page, member, relative_path, item
FROM members""",
    "long_docstrings": """
SELECT 'app/python/supplier' || s_suppkey || '.py' AS relative_path, 'Supplier' || s_suppkey AS name, 2500 AS lines,
  sha256('First.' || repeat(chr(10) || '    A line of it.', 2499)) AS sha, '@known' AS decorators, 14 AS start_line, 2516 AS end_line FROM supplier""",
    "type_chunks": _level(110, "type"),
    "header_chunks": _level(110, "header"),
    "function_groups": _level(110, "functions"),
    "split_functions": _level(40, "function_part"),
    "rest_chunks": _level(110, "rest"),
    "chunk_coverage": f"""
WITH {CODE}, l AS (SELECT relative_path, unnest(string_split(content, chr(10))) AS line FROM code)
SELECT relative_path, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM l WHERE regexp_matches(line, '\\S') GROUP BY 1""",
    "chunk_pipeline": f"""
WITH RECURSIVE {_typed_walk(200)}
SELECT c.lang AS language, level, count(*) AS chunks, sum(token_count)::BIGINT AS tokens
FROM levels l JOIN code c ON starts_with(l.chunk_id, c.relative_path) GROUP BY ALL
UNION ALL SELECT lang, 'file', count(*), sum({tokens("content")})::BIGINT FROM code WHERE {tokens("content")} <= 200 GROUP BY ALL""",
}

WORDS = "'if', 'elif', 'for', 'while', 'case', 'catch', 'except', 'switch'"


def branches(t: str) -> str:
    return (
        f"(len(list_filter(regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ({WORDS})))"
        f" + (length({t}) - length(replace({t}, '&&', ''))) // 2 + (length({t}) - length(replace({t}, '||', ''))) // 2)"
    )


# All files of the whole job. None holds blank runs or trailing blanks, so cleaning changes nothing that is compared.
WHOLE = f"""
{SCRIPTS}, {ROUTED},
all_files AS MATERIALIZED (
  SELECT relative_path, content, language, category, skip_reason, line_count FROM categorised WHERE doc_id % 17 <> 0
  UNION ALL
  SELECT relative_path, content, CASE WHEN lang IN ('python', 'javascript') THEN lang ELSE 'unknown' END,
    CASE WHEN lang IN ('python', 'javascript') THEN 'source' ELSE 'config' END, NULL, {lines('content')} FROM scripts)"""


def _whole_chunks(limit: int, files: str) -> str:
    """Chunks of the source files, of which those above the limit have no declarations."""
    return f"""
docs AS MATERIALIZED (SELECT relative_path, content, {tokens("content")} AS t FROM {files} WHERE category = 'source'),
long_ AS (SELECT * FROM docs WHERE t > {limit}), {_line_walk(limit, "long_")},
chunks AS MATERIALIZED (
  SELECT relative_path, 0 AS ordinal, relative_path || ':full' AS chunk_id, t AS token_count FROM docs WHERE t <= {limit}
  UNION ALL SELECT relative_path, bin, relative_path || ':lc' || bin, token_count FROM line_chunks)"""


def _summary(files: str) -> str:
    """Numbers of a run that asks nothing."""
    return f"""
  (SELECT count(*) FROM {files}) AS total_discovered, (SELECT count(*) FROM {files} WHERE category = 'source') AS source_files,
  (SELECT count(*) FROM {files} WHERE category = 'config') AS config_files, (SELECT count(*) FROM {files} WHERE category = 'skipped') AS skipped,
  (SELECT sum(line_count) FROM {files} WHERE category = 'source')::BIGINT AS total_lines,
  (SELECT count(*) FROM chunks) AS chunks, (SELECT sum(token_count) FROM chunks)::BIGINT AS chunk_tokens,
  0 AS input_tokens, 0 AS output_tokens, 0 AS calls, 0 AS cost_usd, 0 AS hits, '0%' AS hit_rate, 0 AS tokens_per_call,
  (SELECT string_agg(language || ':' || n, ',' ORDER BY language) FROM (
    SELECT language, count(*) AS n FROM {files} WHERE category = 'source' GROUP BY 1)) AS languages,
  (SELECT coalesce(string_agg(skip_reason || ':' || n, ',' ORDER BY skip_reason), '') FROM (
    SELECT skip_reason, count(*) AS n FROM {files} WHERE skip_reason IS NOT NULL GROUP BY 1)) AS skip_reasons"""


def _metrics(files: str) -> str:
    return f"""
  (SELECT count(*) FROM {files} WHERE category = 'source') AS total_files, (SELECT count(*) FROM {files} WHERE category = 'source') AS scored_files,
  (SELECT count(*) FROM types_) + (SELECT count(*) FROM scripts WHERE lang IN ('python', 'javascript')) AS total_classes,
  (SELECT count(*) FROM fns_) + (SELECT sum(n) FROM scripts WHERE lang IN ('python', 'javascript'))::BIGINT AS total_functions,
  (SELECT avg(1 + {branches('content')} // 3) FROM {files} WHERE category = 'source') AS avg_complexity_score"""


EVERY = f"""
{SPANS}, {WHOLE},
every_file AS MATERIALIZED (
  SELECT relative_path, content, language, category, skip_reason, line_count FROM all_files
  UNION ALL SELECT relative_path, content, lang, 'source', NULL, {lines('content')} FROM code)"""
REPORT = f"""
{SPANS}, {SCRIPTS},
f AS MATERIALIZED (
  SELECT relative_path, content, lang, string_split(content, chr(10)) AS ls, {lines('content')} AS line_count FROM code
  UNION ALL SELECT relative_path, content, CASE WHEN lang IN ('python', 'javascript') THEN lang END, string_split(content, chr(10)), {lines('content')} FROM scripts),
ty AS MATERIALIZED (
  SELECT relative_path, type_no, name, package, lang, s, e FROM types_
  UNION ALL SELECT relative_path, 0, CASE lang WHEN 'javascript' THEN 'tools' ELSE 'module' END, CASE lang WHEN 'javascript' THEN 'tools' ELSE '' END, 'script', 1,
    CASE lang WHEN 'python' THEN 4 * n + 2 ELSE 3 * n + 1 END FROM scripts WHERE lang IN ('python', 'javascript')),
fu AS MATERIALIZED (
  SELECT relative_path, type_no, fn, owner, name, s, e FROM fns_
  UNION ALL SELECT relative_path, 0, i, CASE lang WHEN 'javascript' THEN 'tools' ELSE 'module' END, 'f' || i,
    CASE lang WHEN 'python' THEN 4 * i + 1 ELSE 3 * i + 1 END, CASE lang WHEN 'python' THEN 4 * i + 2 ELSE 3 * i + 3 END
  FROM scripts {_I} WHERE lang IN ('python', 'javascript')),
eps AS (SELECT '/orders' || k || '/lines/' || i AS path, 'Order' || k || 'Controller.line' || i AS handler, 'o' || k % 20 AS service_name FROM code {_I} WHERE lang = 'java'),
key_classes AS (SELECT relative_path, ty.name AS name, count(fn) AS n, type_no FROM ty LEFT JOIN fu USING (relative_path, type_no) GROUP BY relative_path, type_no, ty.name ORDER BY n DESC, relative_path, type_no LIMIT 20),
key_methods AS (SELECT relative_path, name, s, {branches("array_to_string(ls[s:e], chr(10))")} AS n FROM fu JOIN f USING (relative_path) ORDER BY n DESC, relative_path, s, name LIMIT 20),
complex_files AS (SELECT relative_path, 1 + {branches('content')} // 3 AS n FROM f WHERE lang IS NOT NULL ORDER BY n DESC, relative_path LIMIT 20),
complex_classes AS (SELECT relative_path, type_no, name, {branches("array_to_string(ls[s:e], chr(10))")} AS n FROM ty JOIN f USING (relative_path) ORDER BY n DESC, relative_path, type_no LIMIT 20),
largest AS (SELECT relative_path, line_count AS n FROM f ORDER BY n DESC, relative_path LIMIT 20),
sv AS (SELECT service_name, classes, coalesce(endpoints, 0) AS endpoints FROM (
  SELECT string_split(package, '.')[-1] AS service_name, count(*) AS classes FROM ty GROUP BY 1) LEFT JOIN (SELECT service_name, count(*) AS endpoints FROM eps GROUP BY 1) USING (service_name)
  ORDER BY classes DESC, service_name LIMIT 20),
ep AS (SELECT path, handler FROM eps ORDER BY path, handler LIMIT 20),
dep AS (SELECT dependency, files FROM (SELECT lang, count(*) AS files FROM code GROUP BY 1) JOIN (VALUES
  ('java', 'java.util.List'), ('java', 'static java.lang.Math.max'), ('python', 'import os'),
  ('python', 'from typing import (' || chr(10) || '    List,' || chr(10) || '    Dict,' || chr(10) || ')'),
  ('go', 'fmt'), ('go', 'log "std/log'), ('javascript', 'import {{ a,' || chr(10) || '  b }} from ''shop'';'),
  ('javascript', 'import c from "cart";'), ('typescript', 'import {{ a }} from ''shop'';')) v(lang, dependency) USING (lang) ORDER BY files DESC, dependency LIMIT 20),
ro AS (SELECT CASE WHEN lang = 'java' THEN 'controller' ELSE '' END AS role, count(*) AS n FROM ty GROUP BY 1)"""

ORACLES |= {
    "type_roles": f"""
WITH {SPANS} SELECT CASE WHEN lang = 'java' THEN 'controller' ELSE '' END AS role, count(*) AS types FROM types_ GROUP BY 1""",
    "endpoint_table": f"""
WITH {CODE} SELECT relative_path, 'GET' AS method, '/orders' || k || '/lines/' || i AS path,
  'Order' || k || 'Controller.line' || i AS handler FROM code {_I} WHERE lang = 'java'""",
    "services": f"""
WITH {SPANS}, e AS (SELECT 'o' || k % 20 AS service_name, sum(n) AS endpoints FROM code WHERE lang = 'java' GROUP BY 1)
SELECT service_name, count(*) AS classes, coalesce(any_value(endpoints), 0) AS endpoints
FROM (SELECT string_split(package, '.')[-1] AS service_name FROM types_) LEFT JOIN e USING (service_name) GROUP BY 1""",
    "key_classes": f"""
WITH {SPANS}, m AS (SELECT relative_path, type_no, count(*) AS n_methods, string_agg(name, ',' ORDER BY fn) AS methods FROM fns_ GROUP BY ALL)
SELECT relative_path, name, CASE WHEN lang = 'java' THEN 'controller' ELSE '' END AS role, n_methods, methods
FROM types_ JOIN m USING (relative_path, type_no) ORDER BY n_methods DESC, relative_path, type_no LIMIT 8""",
    "complexity_metrics": f"""
WITH {SPANS}, b AS (SELECT 1 + (CASE lang WHEN 'javascript' THEN 2 * n ELSE n END) // 3 AS score FROM code),
c AS (SELECT (SELECT count(*) FROM code) AS total_files, (SELECT sum({lines("content")}) FROM code) AS total_lines,
  (SELECT count(*) FROM types_) AS total_classes, (SELECT count(*) FROM fns_) AS total_functions,
  (SELECT count(*) FROM b) AS scored_files, (SELECT avg(score) FROM b) AS avg_complexity_score)
SELECT *, total_functions / total_classes AS avg_methods_per_class FROM c""",
    "complex_types": f"""
WITH {SPANS} SELECT relative_path, name, {branches("array_to_string(string_split(content, chr(10))[s:e], chr(10))")} AS branches
FROM types_ JOIN code USING (relative_path) ORDER BY branches DESC, relative_path, type_no LIMIT 25""",
    "complex_functions": f"""
WITH {SPANS} SELECT relative_path, owner, name, s AS start_line, {branches("array_to_string(string_split(content, chr(10))[s:e], chr(10))")} AS branches
FROM fns_ JOIN code USING (relative_path) ORDER BY branches DESC, relative_path, s, name LIMIT 25""",
    "repeated_paths": f"""
WITH {DOCS}, both_ AS (SELECT relative_path, content FROM docs UNION ALL SELECT relative_path, 'again ' || content FROM docs),
one AS (SELECT relative_path, min_by(content, sha256(content)) AS content FROM both_ GROUP BY 1)
SELECT relative_path, true AS once, sha256(content) AS sha FROM one WHERE {tokens("content")} <= 1000""",
    "scan_directory": f"""
SELECT 'lang=' || lang AS top, sum(length(text) - length(replace(text, chr(10), '')) + 1) AS lines, sum(strlen(text) + 1) AS bytes
FROM documents GROUP BY 1""",
    "run_summary": f"""
WITH RECURSIVE {WHOLE}, {_whole_chunks(1000, "all_files")}, {_pack_walk(1000, "0")}
SELECT {_summary("all_files")}, (SELECT count(DISTINCT p) FROM packed) AS batches, (SELECT count(DISTINCT p) FROM packed) AS misses""",
    "corpus_analysis": f"""
WITH RECURSIVE {EVERY}, {_whole_chunks(4000, "every_file")},
c AS (SELECT {_summary("every_file")}, {_metrics("every_file")})
SELECT *, total_functions / total_classes AS avg_methods_per_class FROM c""",
    "report_document": f"""
WITH {REPORT}
SELECT (SELECT count(*) FROM f) AS total_discovered, (SELECT count(*) FROM f WHERE lang = 'java') AS java_files,
  (SELECT count(*) FROM f WHERE lang IS NOT NULL) AS total_files, (SELECT count(*) FROM f WHERE lang IS NOT NULL) AS scored_files, 'measured' AS mode,
  (SELECT string_agg(relative_path || '|' || name || '|' || n, ';' ORDER BY n DESC, relative_path, type_no) FROM key_classes) AS key_classes,
  (SELECT string_agg(relative_path || '|' || name || '|' || n, ';' ORDER BY n DESC, relative_path, s, name) FROM key_methods) AS key_methods,
  (SELECT string_agg(relative_path || '|' || n, ';' ORDER BY n DESC, relative_path) FROM complex_files) AS complex_files,
  (SELECT string_agg(relative_path || '|' || name || '|' || n, ';' ORDER BY n DESC, relative_path, type_no) FROM complex_classes) AS complex_classes,
  (SELECT string_agg(relative_path || '|' || n, ';' ORDER BY n DESC, relative_path) FROM largest) AS largest_files,
  (SELECT string_agg(service_name || '|' || classes || '|' || endpoints, ';' ORDER BY classes DESC, service_name) FROM sv) AS services,
  (SELECT string_agg(path || '|' || handler, ';' ORDER BY path, handler) FROM ep) AS endpoints,
  (SELECT string_agg(dependency || '|' || files, ';' ORDER BY files DESC, dependency) FROM dep) AS dependencies,
  (SELECT string_agg(role || '|' || n, ';' ORDER BY n DESC, role) FROM ro) AS roles""",
}
