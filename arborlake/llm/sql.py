"""DuckDB SQL for the queries that SQL can express."""

_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

OP3 = r"""
WITH RECURSIVE lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents),
runs AS (
    SELECT doc_id, p, 1 AS n, md5(line) AS h, count(*) OVER (PARTITION BY line) AS places,
           row_number() OVER (PARTITION BY line ORDER BY doc_id, p) AS nth FROM lines
    UNION ALL
    SELECT doc_id, p, n, h, count(*) OVER (PARTITION BY h), row_number() OVER (PARTITION BY h ORDER BY doc_id, p)
    FROM (SELECT r.doc_id, r.p, r.n + 1 AS n, md5(r.h || l.line) AS h
          FROM runs AS r JOIN lines AS l ON l.doc_id = r.doc_id AND l.p = r.p + r.n WHERE r.places > 1)),
late AS (SELECT doc_id, p, max(p + n) AS until FROM runs WHERE nth > 1 GROUP BY doc_id, p),
parted AS (SELECT *, CASE WHEN p < max(until) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                     THEN 0 ELSE 1 END AS begins FROM late),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM parted),
maximal AS (SELECT doc_id, min(p) AS first, max(until) AS until FROM numbered GROUP BY doc_id, run),
gone AS (SELECT doc_id, unnest(range(first, until)) AS p FROM (
    SELECT m.doc_id, first, until, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS words
    FROM maximal AS m JOIN lines AS l ON l.doc_id = m.doc_id AND l.p >= m.first AND l.p < m.until GROUP BY ALL) WHERE words >= 5)
SELECT l.doc_id, count(*) AS n_lines, count(g.p) AS n_removed,
       sha256(coalesce(string_agg(CASE WHEN g.p IS NULL THEN line END, chr(10) ORDER BY l.p), '')) AS kept_sha256
FROM lines AS l LEFT JOIN gone AS g ON l.doc_id = g.doc_id AND l.p = g.p GROUP BY l.doc_id
"""

OP5 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT cast(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, dw.n, p, item FROM dw JOIN bw USING (win, n)),
hit_words AS (SELECT doc_id, count(DISTINCT q) AS n_hit
              FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS words
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
late AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY words) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM late),
n AS (SELECT doc_id, count(*) AS n_removed, list(q) AS qs FROM gone GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(CASE WHEN n_removed IS NULL THEN array_to_string(w, ' ') ELSE
           (SELECT string_agg(u.x, ' ' ORDER BY u.q) FROM (SELECT unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q) AS u
            WHERE NOT list_contains(qs, u.q)) END, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id)
"""

OP7 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_STRENGTH = """
  coalesce(greatest(1.0, least(1.0 / greatest((spread - noise * (k - 1)) / nullif(noise * (n - nn / n - (k - 1)), 0), 1e-9) - 1, k - 1, 200.0)), 1.0)
  FROM (SELECT p * (1 - p) AS noise, s - n * p * p AS spread, n, nn, k
        FROM (SELECT sum(bad) / sum(n) AS p, sum(bad * bad / n) AS s, cast(sum(n) AS DOUBLE) AS n,
                     cast(sum(n * n) AS DOUBLE) AS nn, cast(count(*) AS DOUBLE) AS k FROM {level} WHERE n > 0))
"""
_POSTERIOR = "(bad + k * m) / (n + k) AS r, r * (1 - r) / (n + k + 1) + k * k / ((n + k) * (n + k)) * v AS s"

OP9 = rf"""
WITH cut AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM cut),
rules(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS told
    FROM parsed JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
judged AS (SELECT parsed.*, rule, told FROM parsed LEFT JOIN fits USING (page_id)),
h AS (SELECT host, array_to_string(string_split(host, '.')[(CASE WHEN two THEN -3 ELSE -2 END):], '.') AS domain,
    array_to_string(string_split(host, '.')[(CASE WHEN two THEN -2 ELSE -1 END):], '.') AS suffix, cast(count(told) AS DOUBLE) AS n,
    cast(count(*) FILTER (WHERE told = 'block') AS DOUBLE) AS bad
    FROM (SELECT *, regexp_matches(host, '(^|\.)(ac|co|com|edu|gov|net|org)\.[a-z][a-z]$') AS two FROM judged) GROUP BY host, two),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
kh(k) AS (SELECT {_STRENGTH.format(level="h")}), kd(k) AS (SELECT {_STRENGTH.format(level="d")}), ks(k) AS (SELECT {_STRENGTH.format(level="s")}),
ed AS (SELECT domain, suffix, sum(n * (k + 1) / (n + k)) AS n, sum(bad * (k + 1) / (n + k)) AS bad FROM h, kh GROUP BY ALL),
es AS (SELECT suffix, sum(n * (k + 1) / (n + k)) AS n, sum(bad * (k + 1) / (n + k)) AS bad FROM ed, kd GROUP BY ALL),
root AS (SELECT (sum(bad * (k + 1) / (n + k)) + 1) / (sum(n * (k + 1) / (n + k)) + 2) AS m,
    m * (1 - m) / (sum(n * (k + 1) / (n + k)) + 3) AS v FROM es, ks),
ms AS (SELECT suffix, r AS m, s AS v FROM (SELECT suffix, {_POSTERIOR} FROM es, ks, root)),
md AS (SELECT domain, r AS m, s AS v FROM (SELECT domain, {_POSTERIOR} FROM ed JOIN ms USING (suffix), kd)),
low AS (SELECT host, greatest(0.0, r - 1.64 * sqrt(s)) AS low FROM (SELECT host, {_POSTERIOR} FROM h JOIN md USING (domain), kh))
SELECT page_id, host, path, rule, coalesce(told, CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM judged JOIN low USING (host)
"""

OP11 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)),
sets AS MATERIALIZED (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY k) AS rep
    FROM (SELECT doc_id, count(*) AS n, sha256(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id)),
r AS MATERIALIZED (SELECT doc_id, g, n FROM s JOIN sets USING (doc_id) WHERE doc_id = rep),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS m, b.n AS n, count(*) AS c FROM r AS a JOIN r AS b USING (g)
    WHERE a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (m + n - c)),
ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT DISTINCT a, a FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.b),
named AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, rep, d.doc_id) AS component_id,
       d.doc_id = coalesce(component_id, rep, d.doc_id) AS kept
FROM d LEFT JOIN sets USING (doc_id) LEFT JOIN named USING (rep)
"""

_ASSIGN = """
a{r} AS MATERIALIZED (SELECT vec_id, part, x, arg_min(entry, d * 16 + entry) AS entry, min(d) AS d
    FROM (SELECT vec_id, v.part, v.x, entry, list_sum(list_transform(list_zip(v.x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
          FROM v JOIN b{r} USING (part)) GROUP BY ALL)"""
_UPDATE = """
b{s} AS MATERIALIZED (SELECT part, entry, coalesce(mean, c) AS c FROM b{r} LEFT JOIN (
    SELECT part, entry, list(cast(t // n - CASE WHEN t % n < 0 THEN 1 ELSE 0 END AS BIGINT) ORDER BY k) AS mean
    FROM (SELECT part, entry, k, sum(y) AS t, count(*) AS n
          FROM (SELECT part, entry, unnest(x) AS y, unnest(range(len(x))) AS k FROM a{r}) GROUP BY part, entry, k)
    GROUP BY part, entry) USING (part, entry))"""

OP12 = (
    """
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS (SELECT max(len(x)) // 8 AS w FROM kept),
v AS MATERIALIZED (SELECT vec_id, part, x[1 + part * w:(part + 1) * w] AS x FROM kept, width, range(8) AS parts(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c
    FROM v WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16)),"""
    + ",".join(_ASSIGN.format(r=r) + "," + _UPDATE.format(r=r, s=r + 1) for r in range(6))
    + ","
    + _ASSIGN.format(r=6)
    + """,
coded AS (SELECT vec_id, string_agg(printf('%02x', cast(entry AS INTEGER)), '' ORDER BY part) AS code, cast(sum(d) AS BIGINT) AS error FROM a6 GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b6)
SELECT vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (vec_id), book
"""
)

_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(cast(conv_id AS VARCHAR), ''),
    lambda s: cast(ascii(s) AS BIGINT))), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""

OP13 = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS first, {_CRC32} % 6 AS h FROM t WHERE pos = 1),
r AS (SELECT c.conv_id, t.pos, role, text FROM c JOIN t ON t.conv_id = c.first AND t.pos <= h
    UNION ALL SELECT t.conv_id, t.pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > h),
seq AS (SELECT conv_id, list(sha256(strlen(role) || ':' || role || text) ORDER BY pos) AS path, list(length(text) ORDER BY pos) AS points
    FROM r GROUP BY conv_id
    UNION ALL SELECT conv_id, [], [] FROM c WHERE conv_id NOT IN (SELECT conv_id FROM r)),
prefixes AS (SELECT conv_id, array_to_string(path[1:d], '') AS p, d, points[d] AS n_points, d = len(path) AS ends
    FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM seq)),
node AS MATERIALIZED (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_points) AS n_points,
    sha256(coalesce(string_agg(cast(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM prefixes GROUP BY p, d),
kids AS (SELECT p[1:64 * (d - 1)] AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
told AS (SELECT node.*, coalesce(n_children, 0) AS n_children, coalesce((n_convs - 1) * n_points, 0) AS saved FROM node LEFT JOIN kids USING (p)),
below AS (SELECT p[1:64 * a] AS p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
    FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM told) GROUP BY ALL)
SELECT told.conv_id, told.d AS depth, parent.conv_id AS parent_conv_id, told.n_convs, n_children,
    cast(n_leaves AS BIGINT) AS n_leaves, cast(saved_tokens AS BIGINT) AS saved_tokens, told.ends_sha256
FROM told JOIN below USING (p) LEFT JOIN node AS parent ON told.d > 0 AND parent.p = told.p[1:64 * (told.d - 1)]
"""

ORACLE_SQL = {
    "op3_line_dedup": OP3,
    "op5_benchmark_decontamination": OP5,
    "op6_substring_dedup": OP6,
    "op7_exact_dedup": OP7,
    "op9_url_filters": OP9,
    "op11_sketch_duplicates": OP11,
    "op12_vector_codes": OP12,
    "op13_conversation_trie": OP13,
}
