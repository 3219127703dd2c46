"""DuckDB statements for the queries that SQL can express over whole tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
g AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
cover AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (
  SELECT t.r, doc_id, text, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN cover ON t.r = cover.r),
f AS (
  SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR 100 * n_symbols > 10 * n_words
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 100 * length(regexp_replace(text, '[^!?]', '', 'g')) > 50 * n_words
    OR 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 50 * word_chars
    OR 100 * (word_chars - length(regexp_replace(text, '[^\p{{L}}\p{{M}}]', '', 'g'))) > 40 * word_chars
    OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * len(lines))) AS kept
FROM f
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS root, doc_id AS d FROM documents UNION SELECT root, b FROM reach JOIN links ON d = a),
least AS (SELECT root, min(d) AS component_id FROM reach GROUP BY root)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, t.doc_id = component_id AS kept
FROM t LEFT JOIN n ON t.doc_id = n.doc_id JOIN least ON root = t.doc_id
"""

FIXITY = r"""
WITH r AS (
  SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS k,
    encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:girder:page:' || page_id
      || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
      || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS content
  FROM pages),
cut AS (SELECT page_id, k // 4096 AS shard, k % 4096 AS record, CAST(octet_length(content) AS BIGINT) AS length, sha256(content) AS sha256 FROM r),
leaf AS (SELECT *, CAST(sum(length) OVER (PARTITION BY shard ORDER BY record) - length AS BIGINT) AS start FROM cut),
one AS (SELECT *, start - min(start) OVER (PARTITION BY shard, record // 16) AS off FROM leaf),
one_up AS (SELECT shard, record // 16 AS i, min(start) AS start, CAST(sum(length) AS BIGINT) AS length, sha256(string_agg(record || ':' || off || ':' || length || ':' || sha256, ',' ORDER BY record)) AS h FROM one GROUP BY ALL),
two AS (SELECT *, start - min(start) OVER (PARTITION BY shard, i // 16) AS off FROM one_up),
two_up AS (SELECT shard, i // 16 AS j, min(start) AS start, CAST(sum(length) AS BIGINT) AS length, sha256(string_agg(i || ':' || off || ':' || length || ':' || h, ',' ORDER BY i)) AS h FROM two GROUP BY ALL),
three AS (SELECT *, start - min(start) OVER (PARTITION BY shard) AS off FROM two_up),
root AS (SELECT shard, sha256(string_agg(j || ':' || off || ':' || length || ':' || h, ',' ORDER BY j)) AS shard_root FROM three GROUP BY ALL)
SELECT page_id, CAST(leaf.shard AS BIGINT) AS shard, CAST(record AS BIGINT) AS record, start AS "at", length, sha256,
  CASE WHEN page_id % 89 = 0 THEN 'missing' WHEN page_id % 97 = 0 THEN 'corrupt' ELSE 'intact' END AS status, shard_root
FROM leaf JOIN root ON leaf.shard = root.shard
"""

PASSAGES = rf"""
WITH t AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, i - 1 AS s, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t WHERE len(w) >= 50)),
hit AS (
  SELECT doc_id, s FROM win JOIN (SELECT h FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)) USING (h)),
marked AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marked)
SELECT doc_id, CAST(min(s) AS BIGINT) AS start_word, CAST(max(s) + 50 AS BIGINT) AS end_word FROM runs GROUP BY doc_id, run
"""

TRIE = r"""
WITH turns AS (
  SELECT conv_id AS c, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS e,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({'e': e, 'words': words} ORDER BY turn NULLS FIRST, e) AS t FROM turns GROUP BY c),
hashed AS (
  SELECT c, t, c - c % 20 AS head, crc32_of.h % 4 AS h
  FROM own JOIN (
    SELECT c AS k, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(CAST(c AS VARCHAR)[i])::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, _: xor(x >> 1, (x & 1) * 3988292384::BIGINT))) AS raw, xor(raw, 4294967295::BIGINT) AS h
    FROM own) AS crc32_of ON c = k),
made AS (
  SELECT x.c, coalesce(y.t[1:x.h], []) || x.t[x.h + 1:] AS t FROM hashed x LEFT JOIN own y ON y.c = x.head),
prefixes AS (
  SELECT c, d, len(t) AS whole, CASE WHEN d > 0 THEN t[d].words ELSE 0 END AS words,
    list_transform(t[1:d], lambda x: x.e) AS p, list_transform(t[1:d - 1], lambda x: x.e) AS up
  FROM (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM made)),
nodes AS (
  SELECT p, d, any_value(CASE WHEN d > 0 THEN up END) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (whole = d), '')) AS ends_sha256
  FROM prefixes GROUP BY p, d),
children AS (SELECT up, count(*) AS n FROM nodes WHERE d > 0 GROUP BY up),
counted AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children ON nodes.p = children.up),
sums AS (
  SELECT p[1:k] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM counted) GROUP BY ALL)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, x.n_convs, x.n_children, sums.n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, x.ends_sha256
FROM counted x JOIN sums ON sums.p = x.p LEFT JOIN nodes parent ON parent.p = x.up
"""

LINES = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT r, doc_id, i, l[i] AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM t)),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
f AS (SELECT *, length(key) >= 10 AND doc_id <> min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY r
"""


def clusters_sql(rounds: int = 3) -> str:
    """Every round as three statements: nearest centroid, sums by component, next centroids."""
    near = """
a{k} AS (
  SELECT r, min({{'distance': list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))), 'cluster': cluster}}) AS m
  FROM vectors, c{k} GROUP BY r)"""
    move = """
s{k} AS (
  SELECT m.cluster AS cluster, i, CAST(sum(v[i]) AS BIGINT) AS total, count(*) AS n
  FROM (SELECT vectors.r, v, unnest(range(1, 65)) AS i FROM vectors) x JOIN a{k} ON x.r = a{k}.r GROUP BY ALL),
m{k} AS (SELECT cluster, list((total - (total % n + n) % n) // n ORDER BY i) AS c FROM s{k} GROUP BY cluster),
c{next} AS (SELECT c{k}.cluster, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} ON c{k}.cluster = m{k}.cluster)"""
    steps = [t.format(k=k, next=k + 1) for k in range(rounds) for t in (near, move)] + [near.format(k=rounds)]
    return f"""
WITH vectors AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, v AS c
  FROM (SELECT sha256('1:' || vec_id) AS h, v FROM vectors ORDER BY h LIMIT 16)),{",".join(steps)},
t AS (SELECT m.cluster AS cluster, sum(m.distance) AS total FROM a{rounds} GROUP BY ALL)
SELECT vec_id, CAST(m.cluster AS INTEGER) AS cluster, CAST(m.distance AS BIGINT) AS distance, CAST(t.total AS BIGINT) AS cluster_inertia,
  CAST((SELECT sum(total) FROM t) AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN vectors USING (r) JOIN t ON t.cluster = m.cluster JOIN c{rounds} ON c{rounds}.cluster = m.cluster
"""


STATEMENTS: dict[str, str] = {
    "op4_quality_rules": QUALITY,
    "op6_near_duplicates": NEAR_DUPLICATES,
    "op8_warc_fixity": FIXITY,
    "op10_repeated_passages": PASSAGES,
    "op11_prefix_trie": TRIE,
    "op12_line_dedup": LINES,
    "op13_centroids": clusters_sql(),
}
