"""DuckDB SQL for the operators that SQL can express, written from their rules."""

from __future__ import annotations

_ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"'[^\x20\x09-\x0D]+'"

DEDUP = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), {_ALPHABET}) AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d"""

#: ratio: (count, total, unit), as in the quality rules
_RATIOS = {"symbols": ("n_symbols", "n_words", 1), "dup_lines": ("n_dup_lines", "n_lines", 1), "repeats": ("n_repeat_words", "n_words", 10)}
_NAMES = ["word_length", *_RATIOS]
_GOOD = " AND ".join(f"{c} <= f_{n} * {t} + 3 * sqrt({u} * (f_{n} * {t}) + {u * u})" for n, (c, t, u) in _RATIOS.items())
QUALITY = f"""
WITH w AS (
    SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, {_WORDS})) AS ls
    FROM documents),
g AS (SELECT doc_id, i, hash(ws[i:i + 4]) AS h FROM w, unnest(range(1, len(ws) - 3)) u(i)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) u(k) GROUP BY 1),
m AS (
    SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
           CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
           CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
    FROM w LEFT JOIN covered c USING (doc_id)),
k AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
r AS (
    SELECT *, word_chars / n_words AS r_word_length, n_symbols / n_words AS r_symbols, n_dup_lines / n_lines AS r_dup_lines, n_repeat_words / n_words AS r_repeats
    FROM k WHERE NOT base_failed),
p AS (SELECT lang, source, unnest([{', '.join(f"'{n}'" for n in _NAMES)}]) AS ratio, unnest([{', '.join(f'r_{n}' for n in _NAMES)}]) AS x FROM r),
b AS (SELECT lang, source, ratio, CASE WHEN x > 0 THEN CAST(ceil(ln(x) / ln(1.02)) AS INTEGER) ELSE -10000 END AS bin, count(*) AS n FROM p GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM b),
bl AS (SELECT lang, ratio, bin, CAST(sum(n) AS BIGINT) AS n, CAST(sum(sum(n)) OVER (PARTITION BY lang, ratio) AS BIGINT) AS total FROM b GROUP BY lang, ratio, bin),
ba AS (SELECT ratio, bin, CAST(sum(n) * 100000 AS BIGINT) // CAST(sum(sum(n)) OVER (PARTITION BY ratio) AS BIGINT) AS n FROM b GROUP BY ratio, bin),
wide AS (
    SELECT lang, ratio, bin, n * 100000 // (total + 100) AS n FROM bl
    UNION ALL SELECT lang, ratio, bin, n * 100 // (total + 100) FROM (SELECT DISTINCT lang, total FROM bl), ba),
pool AS (
    SELECT lang, source, ratio, bin, sum(n) AS n FROM (
        SELECT lang, source, ratio, bin, n * 1000 AS n FROM b
        UNION ALL SELECT g.lang, g.source, ratio, bin, n FROM grp g JOIN wide w ON w.lang IS NOT DISTINCT FROM g.lang) GROUP BY ALL),
c AS (
    SELECT *, sum(n) OVER (PARTITION BY lang, source, ratio) AS total, sum(n) OVER (PARTITION BY lang, source, ratio ORDER BY bin) AS upto,
           CASE WHEN bin = -10000 THEN 0 ELSE pow(1.02, bin) * (2 / 2.02) END AS v
    FROM pool),
q AS (
    SELECT lang, source, ratio, min(v) FILTER (upto >= total * 0.25) AS q1, min(v) FILTER (upto >= total * 0.5) AS q2,
           min(v) FILTER (upto >= total * 0.75) AS q3, min(v) FILTER (upto >= total * 0.9) AS high
    FROM c GROUP BY ALL),
t AS (
    SELECT lang, source, max(q1 / pow(greatest(1.03, q2 / q1, q3 / q2), 6)) FILTER (ratio = 'word_length') AS low,
           max(q3 * pow(greatest(1.03, q2 / q1, q3 / q2), 6)) FILTER (ratio = 'word_length') AS high,
           {', '.join(f"max(high + 3 * (high - q2)) FILTER (ratio = '{n}') AS f_{n}" for n in _RATIOS)}
    FROM q GROUP BY ALL)
SELECT k.doc_id, k.n_words, k.word_chars, k.n_symbols, k.n_lines, k.n_dup_lines, k.n_repeat_words, base_failed,
       NOT base_failed AND coalesce(word_chars / n_words >= low AND word_chars / n_words <= high AND {_GOOD}, false) AS kept
FROM k LEFT JOIN t ON t.lang IS NOT DISTINCT FROM k.lang AND t.source IS NOT DISTINCT FROM k.source"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ALPHABET}), {_WORDS}) AS ws FROM documents),
s AS (
    SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
                        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS g
    FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.g"""

SUFFIXES = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
x AS (SELECT doc_id, i, hash(ws[i:i + 49]) AS h FROM w, unnest(range(1, len(ws) - 48)) u(i)),
twice AS (SELECT h FROM x GROUP BY h HAVING count(DISTINCT doc_id) > 1),
y AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -99) + 50 AS fresh FROM x SEMI JOIN twice USING (h)),
z AS (SELECT doc_id, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM y)
SELECT doc_id, min(i) - 1 AS start_word, max(i) + 49 AS end_word, max(i) + 50 - min(i) AS n_words FROM z GROUP BY doc_id, island"""

WARC = r"""
            WITH p AS (
                SELECT *, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['host', 'path', 'query']) AS u,
                       '"' || md5(html) || '"' AS tag, strftime(make_timestamp((1700000000 + page_id) * 1000000), '%Y-%m-%dT%H:%M:%S') AS date
                FROM pages),
            k AS (
                SELECT *, list_sort(list_filter(string_split(u.query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))) AS q
                FROM p),
            c AS (
                SELECT *, regexp_replace(regexp_replace(lower(u.host), '^([^@]*@)?(www\.|m\.)?', ''), ':(80|443)?$', '')
                       || regexp_replace(u.path, '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS key
                FROM k),
            v AS (
                SELECT page_id, url, key, CASE WHEN page_id % 17 = 3 THEN 2 * page_id ELSE 2 * page_id + 2 * (37 * page_id % 101) - 99 END AS at,
                       CASE WHEN page_id % 13 = 5 OR page_id % 11 = 4 THEN NULL WHEN page_id % 7 = 3 THEN '"other"' ELSE tag END AS etag,
                       CASE WHEN page_id % 13 <> 5 AND page_id % 11 = 4 THEN date END AS modified
                FROM c),
            j AS (
                SELECT v.page_id, v.url, v.etag, v.modified, r.page_id AS rid, r.tag, r.date, strlen(r.html) AS size,
                       CASE WHEN r.page_id IS NULL THEN 'no_response' WHEN v.etag IS NOT NULL THEN CASE WHEN v.etag = r.tag THEN 'resolved' ELSE 'mismatch' END
                            WHEN v.modified IS NOT NULL THEN CASE WHEN v.modified = r.date THEN 'resolved' ELSE 'mismatch' END ELSE 'no_validator' END AS verdict
                FROM v ASOF LEFT JOIN (SELECT *, 2 * page_id AS at FROM c) r ON v.key = r.key AND v.at > r.at)
            SELECT page_id, url, rid AS response_page_id, verdict,
                   CASE WHEN verdict = 'resolved' THEN
                       'cache-control: max-age=600' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10)
                       || 'etag: ' || CASE WHEN etag IS NULL THEN tag ELSE 'W/' || etag END || chr(10) || 'last-modified: ' || date || chr(10) || 'x-cache: hit' END AS headers
            FROM j"""


#: Linked documents share one of their first n - ceil(0.8 n) + 1 shingles, rare ones first.
NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ALPHABET}), {_WORDS}) AS ws FROM documents),
s AS (
    SELECT doc_id, CASE WHEN len(ws) >= 2 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: hash(ws[i] || ' ' || ws[i + 1])))
                        WHEN len(ws) > 0 THEN [hash(ws[1])] ELSE [] END AS g
    FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
f AS (SELECT *, count(*) OVER (PARTITION BY x) AS df FROM e),
p AS (SELECT doc_id, n, x FROM f WHERE df > 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY df, x) <= n - CAST(ceil(0.8 * n) AS BIGINT) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
k AS (SELECT c.a, c.b, len(list_intersect(x.g, y.g)) AS n, len(x.g) + len(y.g) AS total FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b),
half AS (SELECT a, b FROM k WHERE 100 * n >= 80 * (total - n)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id,
       s.doc_id = least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS kept
FROM s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.g"""

#: A run's words but its last period, six at least, stand again one period on: equal runs of six words at the same distance.
RUNS = f"""
WITH crc AS (
    SELECT doc_id, xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
        lambda h, x: list_reduce([xor(h, x)] || list_transform(range(8), lambda z: CAST(0 AS BIGINT)), lambda y, z: xor(y >> 1, (y & 1) * 3988292384)))) AS h
    FROM documents),
w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws, h, h // 10 AS g FROM documents JOIN crc USING (doc_id)),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN g % len(ws) END AS a FROM w),
p AS (SELECT *, 1 + (len(ws) - a) // (3 + g % 8) AS p FROM a),
d AS (SELECT doc_id, CASE WHEN a IS NULL THEN ws ELSE ws[:a] || list_transform(range(0, len(ws) - a), lambda i: ws[1 + a + i % p]) END AS ws FROM p),
x AS (SELECT doc_id, i, hash(ws[i + 1:i + 6]) AS x FROM d, unnest(range(0, len(ws) - 5)) u(i)),
y AS (SELECT doc_id, i, x FROM x QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
e AS (SELECT b.doc_id, b.i, c.i - b.i AS p FROM y b JOIN y c ON b.doc_id = c.doc_id AND b.x = c.x AND b.i < c.i),
k AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM e),
m AS (SELECT doc_id, p, min(i) AS s, max(i) - min(i) + 6 + p AS l FROM k GROUP BY doc_id, p, island),
r AS (SELECT doc_id, s, l, min(p) AS p FROM m WHERE l >= 12 AND l >= 2 * p GROUP BY doc_id, s, l),
n AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS runs, list({{'l': -l, 's': s, 'p': p}} ORDER BY l DESC, s, p)[1] AS top
    FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, i FROM r, unnest(range(s + p, s + l)) u(i)),
away AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, -top.l AS length, top.p AS period, -1000 * top.l // top.p AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_filter(range(0, len(ws)), lambda i: NOT list_contains(gone, i)), lambda i: ws[i + 1]) END, ' ')) AS collapsed_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN away USING (doc_id)"""
