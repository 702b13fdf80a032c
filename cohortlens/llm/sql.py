"""Reference SQL (DuckDB) of the queries that SQL can express; everything is spelled out here."""

OP2 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
k AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""

OP5 = r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM s),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
r AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.*, coalesce(k.doc_id > r.first, false) AS dropped FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


OP1 = r"""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 800)) AS k FROM (SELECT *, unnest(range(0, n - 399)) AS p FROM d WHERE n >= 400)),
twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, p FROM w WHERE k IN (SELECT k FROM twice)),
mark AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER o <= 400 THEN 0 ELSE 1 END AS fresh FROM hit
  WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
run AS (SELECT doc_id, min(p) AS s, max(p) + 400 AS e
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM mark) GROUP BY doc_id, g),
cut AS (SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS b FROM run),
part AS (
  SELECT doc_id, s AS pos, substr(h, 2 * b + 1, 2 * (s - b)) AS x FROM cut JOIN d USING (doc_id)
  UNION ALL
  SELECT doc_id, n AS pos, substr(h, 2 * coalesce(last, 0) + 1) AS x
  FROM d LEFT JOIN (SELECT doc_id, max(e) AS last FROM run GROUP BY 1) USING (doc_id)),
kept AS (SELECT doc_id, string_agg(x, '' ORDER BY pos) AS x FROM part GROUP BY doc_id),
gone AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans FROM run GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(x)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""

# smallest vertex reachable over ``link`` (x, y in both directions)
_REACH = """
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach AS r JOIN link AS l ON r.y = l.x),
least AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
"""

OP6 = rf"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
    AND isfinite(list_sum(CAST(embedding AS DOUBLE[]))) AND list_max(embedding) - list_min(embedding) + abs(list_max(embedding)) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v AS a JOIN v AS b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
{_REACH}, degree AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
  vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN degree ON vec_id = degree.x LEFT JOIN least ON vec_id = least.x
"""

OP10 = rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
pair AS (SELECT x, y FROM shared JOIN n AS a ON x = a.doc_id JOIN n AS b ON y = b.doc_id WHERE 100 * c >= 80 * (a.n + b.n - c)),
link AS (SELECT x, y FROM pair UNION ALL SELECT y, x FROM pair),
{_REACH}
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
  doc_id <= coalesce(m, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least ON doc_id = least.x
"""


OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
p AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(x, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(pieces) AS x FROM d)),
word AS (SELECT lang, piece, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM p),
near AS (SELECT lang, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM word WINDOW o AS (PARTITION BY piece ORDER BY i)),
f AS (
  SELECT lang, 1 AS size, a AS phrase, count(*) AS f FROM near GROUP BY ALL
  UNION ALL SELECT lang, 2, a || ' ' || b AS phrase, count(*) FROM near WHERE b IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c AS phrase, count(*) FROM near WHERE c IS NOT NULL GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
cut AS (
  SELECT lang, size, phrase, f, 1 AS k, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM cand
  UNION ALL
  SELECT lang, size, phrase, f, 2, w[1] || ' ' || w[2], w[3] FROM cand WHERE size = 3),
scored AS (
  SELECT cut.lang, cut.size, cut.phrase, cut.f AS a, k, b.f AS l, c.f AS r,
    1000000 * CAST(cut.f AS HUGEINT) * cut.f // (CAST(b.f AS HUGEINT) * c.f) AS score
  FROM cut JOIN f AS b ON b.lang = cut.lang AND b.phrase = x JOIN f AS c ON c.lang = cut.lang AND c.phrase = y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
  SELECT lang, phrase, max(f) AS longer
  FROM (SELECT lang, w[1] || ' ' || w[2] AS phrase, f FROM cand WHERE size = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], f FROM cand WHERE size = 3)
  GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN around ON around.lang = best.lang AND around.phrase = best.phrase
  WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

OP12 = r"""
WITH t AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
q AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
total AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM t WHERE len(w) > 0),
d AS (SELECT row, doc_id, 25 + (75 * len(w) * docs) // terms AS m FROM t, total WHERE len(w) > 0),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM t) GROUP BY ALL),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
score AS (
  SELECT item_id, row, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN weight USING (term) JOIN tf USING (term) JOIN d USING (row) GROUP BY ALL),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM score JOIN d USING (row) WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": OP1, "op2_exact_dedup": OP2, "op5_line_dedup": OP5, "op6_embedding_near_dedup": OP6,
        "op10_minhash_near_dedup": OP10, "op11_phrase_collocations": OP11, "op12_lexical_search": OP12,
    }
