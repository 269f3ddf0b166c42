"""The SQL, for DuckDB, that the queries of this subpackage must agree with where SQL can express them."""

SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), r AS (
  SELECT vec_id AS node, vec_id AS component FROM v UNION SELECT l.a, r.component FROM r JOIN l ON l.b = r.node
)
SELECT vec_id, CAST((SELECT count(*) FROM l WHERE l.a = vec_id) AS BIGINT) n_links,
  coalesce((SELECT min(component) FROM r WHERE r.node = vec_id), vec_id) component_id,
  coalesce((SELECT min(component) FROM r WHERE r.node = vec_id), vec_id) = vec_id kept
FROM embeddings
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, row_number() OVER () rid, {SPACED} w FROM documents),
p AS (SELECT doc_id, rid, w, unnest(range(1, len(w) - 48)) pos FROM d WHERE len(w) >= 50),
win AS (SELECT doc_id, rid, pos, md5(array_to_string(list_slice(w, pos, pos + 49), ' ')) k FROM p),
first AS (SELECT k, min(doc_id) lowest FROM win GROUP BY k),
gone AS (SELECT DISTINCT rid, unnest(range(pos, pos + 50)) pos FROM win JOIN first USING (k) WHERE doc_id > lowest),
word AS (SELECT rid, unnest(w) word, unnest(range(1, len(w) + 1)) pos FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY pos) t FROM word ANTI JOIN gone USING (rid, pos) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST((SELECT count(*) FROM gone WHERE gone.rid = d.rid) AS BIGINT) n_removed, sha256(coalesce(t, '')) kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () rid, {ALNUM} w FROM documents),
i AS (SELECT item_id, {ALNUM} w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) n, array_to_string(list_slice(w, pos, pos + least(len(w), 10) - 1), ' ') k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) pos FROM i WHERE len(w) > 0)),
size AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT rid, pos, n, array_to_string(list_slice(w, pos, pos + n - 1), ' ') k FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) pos FROM d, size WHERE len(w) >= n)),
hit AS (SELECT rid, pos, n, item_id FROM dw JOIN iw USING (n, k)),
words AS (SELECT rid, count(*) n_hit FROM (SELECT DISTINCT rid, unnest(range(pos, pos + n)) p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) n_items, string_agg(item, ',' ORDER BY item) items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

MINHASH = f"""
WITH RECURSIVE d AS (SELECT doc_id, {SPACED} w FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT row_number() OVER (ORDER BY min(doc_id)) node, w, min(doc_id) lowest FROM d WHERE len(w) > 0 GROUP BY w),
total AS (SELECT count(*) n FROM d),
df AS (SELECT word, count(*) n FROM (SELECT DISTINCT rid, word FROM (SELECT rid, unnest(w) word FROM (SELECT row_number() OVER () rid, w FROM d))) GROUP BY word),
spot AS (SELECT node, least(len(w), 5) size, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) pos FROM t),
shingle AS (SELECT node, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') k, count(*) tf FROM spot GROUP BY ALL),
part AS (SELECT DISTINCT k, size, unnest(string_split(k, ' ')) word, unnest(range(size)) p FROM shingle),
idf AS (SELECT k, size, sum(ln(1 + (SELECT n FROM total) / df.n)) / size idf FROM part JOIN df USING (word) GROUP BY k, size),
f AS (SELECT node, k, size, tf * idf x FROM shingle JOIN idf USING (k, size)),
sums AS (SELECT node, sum(x) s FROM f GROUP BY node),
common AS (SELECT a.node a, b.node b, sum(least(a.x, b.x)) m FROM f a JOIN f b ON a.k = b.k AND a.size = b.size AND a.node < b.node GROUP BY a.node, b.node),
l AS (SELECT a, b FROM common JOIN sums sa ON sa.node = a JOIN sums sb ON sb.node = b WHERE m / (sa.s + sb.s - m) >= 0.8),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT node, node AS component FROM t UNION SELECT e.a, r.component FROM r JOIN e ON e.b = r.node),
class AS (SELECT node, min(component) component FROM r GROUP BY node)
SELECT doc_id, coalesce(c.lowest, doc_id) class_id, coalesce(c.lowest, doc_id) = doc_id kept
FROM d LEFT JOIN t USING (w) LEFT JOIN class USING (node) LEFT JOIN t c ON c.node = class.component
"""

SQL = {
    "op2_embedding_near_dedup": VECTORS,
    "op3_substring_dedup": SUBSTRINGS,
    "op8_benchmark_decontamination": DECONTAMINATE,
    "op10_minhash_near_dedup": MINHASH,
}
