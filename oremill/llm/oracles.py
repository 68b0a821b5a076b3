"""DuckDB SQL with the rows of the corpus queries, where SQL can express them."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"

#: Classes of a symmetric link table (a, b) among nodes (id), as reachable pairs.
_CLASSES = "reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a), classes AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY 1)"

OP1 = rf"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS s
         FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE doc_id IS NOT NULL),
places AS (SELECT doc_id, size, p, array_to_string(w[p : p + size - 1], ' ') AS s
           FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS p FROM docs, (SELECT DISTINCT size FROM wins))),
hits AS (SELECT doc_id, p, size, item FROM places JOIN wins USING (size, s)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + size - 1)) AS k FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP3 = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + least(len(w), 3) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS p FROM docs WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), nodes AS (SELECT doc_id AS id FROM docs), {_CLASSES}
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM docs JOIN classes ON id = doc_id LEFT JOIN n USING (doc_id)
"""

OP6 = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL),
good AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.95),
nodes AS (SELECT vec_id AS id FROM v), {_CLASSES}, c AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN classes ON id = vec_id LEFT JOIN c USING (vec_id)
"""

OP9 = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents WHERE doc_id IS NOT NULL),
bytes AS (SELECT doc_id, p, substr(h, CAST(2 * p - 1 AS BIGINT), 2) AS b, CASE WHEN p <= length(h) // 2 - 99 THEN md5(substr(h, CAST(2 * p - 1 AS BIGINT), 200)) END AS s
          FROM (SELECT doc_id, h, unnest(generate_series(1, length(h) // 2)) AS p FROM docs)),
late AS (SELECT doc_id, p, b, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1 AS late FROM bytes),
cut AS (SELECT doc_id, p, b, max(CASE WHEN late THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM late),
runs AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), 0) = 0 AS begins FROM cut),
sums AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (WHERE gone = 1) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans, coalesce(string_agg(b, '' ORDER BY p) FILTER (WHERE gone = 0), '') AS kept FROM runs GROUP BY 1)
SELECT doc_id, CAST(coalesce(n_bytes, 0) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM docs LEFT JOIN sums USING (doc_id)
"""

OP10 = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
wins AS (SELECT doc_id, p, md5(array_to_string(w[p : p + 34], ' ')) AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS p FROM docs)),
dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY s) AS c FROM wins) WHERE c > 1),
words AS (SELECT doc_id, w[k] AS word, k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS k FROM docs)),
cut AS (SELECT w.doc_id AS doc_id, k, word, max(CASE WHEN d.p IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY w.doc_id ORDER BY k ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM words w LEFT JOIN dup d ON d.doc_id = w.doc_id AND d.p = w.k),
sums AS (SELECT doc_id, count(*) FILTER (WHERE gone = 1) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY k) FILTER (WHERE gone = 0), '') AS kept FROM cut GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN sums USING (doc_id)
"""
