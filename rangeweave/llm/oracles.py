"""The queries that SQL can express on whole tables, for DuckDB."""

from __future__ import annotations

from .quality_rules import BASE, POLICIES

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM w, unnest(range(1, greatest(len(w) - 3, 2))) t(i) WHERE len(w) > 0),
k AS (SELECT doc_id, shingle, CAST(floor(sqrt(strlen(shingle))) AS BIGINT) AS w FROM s),
n AS (SELECT doc_id, sum(w) AS n FROM k GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.w) AS c FROM k a JOIN k b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
both_ AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS class_id FROM documents UNION SELECT both_.b, r.class_id FROM r JOIN both_ ON both_.a = r.node)
SELECT node AS doc_id, min(class_id) AS class_id FROM r GROUP BY node
"""

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM w, unnest(range(1, len(w) - 11)) t(i)),
again AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS m FROM win) WHERE doc_id > m),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM again, range(13) r(j)),
word AS (SELECT doc_id, i, w[i] AS word FROM w, unnest(range(1, len(w) + 1)) t(i)),
kept AS (SELECT doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone.i IS NULL) AS kept FROM word LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""

FAILURES = {0: "n_words < 20", 1: "100 * n_repeat_words > 30 * n_words", 2: "5 * n_symbols > n_words AND n_symbols >= 10", 3: "10 * n_dup_lines > 3 * n_lines AND n_dup_lines >= 3", 4: "word_chars < 2 * n_words", 5: "word_chars > 20 * n_words", 6: "2 * n_digits > word_chars", 7: "2 * n_stutters > n_words"}

RULES = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM w, unnest(range(1, len(w) - 6)) t(i)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range(8) r(j) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(regexp_extract_all(text, '[0-9]')) AS BIGINT) AS n_digits, CAST(len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS BIGINT) AS n_stutters
    FROM w LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, CAST({' + '.join(f'CASE WHEN {sql} THEN {1 << bit} ELSE 0 END' for bit, sql in FAILURES.items())} AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {BASE} <> 0 AS base_failed, failed & {POLICIES['v1']} = 0 AS kept, n_lines, n_digits, n_stutters, failed FROM f
"""

ORACLES = {"op1_probminhash": NEAR_DUPLICATES, "op3_substrings": SUBSTRINGS, "op4_warc": WARC, "op9_quality_rules": RULES}
