"""DuckDB SQL for those queries that SQL can express."""

MIX = r"""
WITH d AS (
  SELECT doc_id, coalesce('a' || source, 'b') AS k, md5(coalesce(doc_id::VARCHAR, '')) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
r AS (
  SELECT k, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY k) - 1 AS i FROM d GROUP BY k),
w AS (
  SELECT k, source_size, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[i % 3 + 1] AS w,
         ([0.5::DOUBLE, 0.0::DOUBLE, (-0.5)::DOUBLE])[i % 3 + 1] AS slope,
         source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total
  FROM r),
f AS (
  SELECT *, cap / w <= (total - (sum(cap) OVER (ORDER BY cap / w, k) - cap))
                       / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_full
  FROM w),
t AS (
  SELECT k, source_size, slope,
         round(CASE WHEN is_full THEN cap ELSE w * (total - sum(CASE WHEN is_full THEN cap ELSE 0.0::DOUBLE END) OVER ())
               / sum(CASE WHEN is_full THEN 0.0::DOUBLE ELSE w END) OVER () END, 6) AS target
  FROM f),
p AS (
  SELECT doc_id, size, source_size, target, slope, round(target)::BIGINT AS due,
         (sum(size) OVER (PARTITION BY k ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM d JOIN t USING (k)),
n AS (
  SELECT *, least(due // greatest(source_size, 1), 2) AS passes FROM p),
x AS (
  SELECT *, (passes * size + least(greatest(due - passes * source_size - start, 0), size))::BIGINT AS taken,
         least((start + size / 2.0::DOUBLE) / nullif(target, 0), 1.0::DOUBLE) AS u1,
         least((source_size + (start + size / 2.0::DOUBLE)) / nullif(target, 0), 1.0::DOUBLE) AS u2
  FROM n)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN round(CASE WHEN slope = 0 THEN u1 ELSE ((1 + slope)
    - sqrt(greatest((1 + slope) * (1 + slope) - 4 * slope * u1, 0.0::DOUBLE))) / (2 * slope) END, 9) END AS position,
  CASE WHEN taken > size THEN round(CASE WHEN slope = 0 THEN u2 ELSE ((1 + slope)
    - sqrt(greatest((1 + slope) * (1 + slope) - 4 * slope * u2, 0.0::DOUBLE))) / (2 * slope) END, 9) END AS again_position
FROM x
"""

WINNOWING = r"""
WITH lowered AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n,
         unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 9), ' '))) AS s
  FROM items WHERE len(w) > 0),
places AS (
  SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS i,
         unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' '))) AS s
  FROM lowered, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
hits AS (SELECT rid, i, n, item FROM places JOIN windows USING (n, s)),
words AS (
  SELECT rid, count(*)::BIGINT AS n_hit FROM (
    SELECT DISTINCT rid, unnest(range(i, i + n)) AS at FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid),
found AS (
  SELECT rid, count(DISTINCT item)::BIGINT AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256 FROM hits GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN words USING (rid) LEFT JOIN found USING (rid)
"""


def _vector_codes() -> str:
    """Lloyd's rounds as one query: codebooks c0 to c4 and the assignments to them."""
    assigned = """
a{k} AS MATERIALIZED (
  SELECT vid, p, x, j, d FROM (
    SELECT vid, v.p, v.x, j, list_sum(list_transform(list_zip(v.x, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d,
           row_number() OVER (PARTITION BY vid, v.p ORDER BY d, j) AS r
    FROM parts v JOIN c{k} c ON v.p = c.p) WHERE r = 1)"""
    moved = """
c{n} AS MATERIALIZED (
  SELECT p, j, coalesce(n.e, c.e) AS e FROM c{k} c LEFT JOIN (
    SELECT p, j, list(floor(s / n)::BIGINT ORDER BY i) AS e FROM (
      SELECT p, j, i, sum(v)::DOUBLE AS s, count(*) AS n FROM (
        SELECT p, j, unnest(x) AS v, unnest(range(len(x))) AS i FROM a{k}) GROUP BY p, j, i) GROUP BY p, j) n USING (p, j))"""
    start = """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vid, vec_id, label, list_transform(embedding, lambda v: floor(v::DOUBLE * 1024)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
parts AS MATERIALIZED (
  SELECT vid, p, list_slice(x, p * len(x) // 4 + 1, (p + 1) * len(x) // 4) AS x FROM kept, (SELECT unnest(range(4)) AS p)),
c0 AS (SELECT p, vid AS j, x AS e FROM parts WHERE vid < 256)"""
    rounds = "".join("," + assigned.format(k=k) + "," + moved.format(k=k, n=k + 1) for k in range(4))
    return (
        start + rounds + "," + assigned.format(k=4) + """,
coded AS (SELECT vid, string_agg(lower(printf('%02x', j)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY vid),
books AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, j)) AS h FROM c4)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (vid), books
"""
    )


ORACLES = {"op2_curriculum_mix": MIX, "op11_winnowing": WINNOWING, "op12_vector_codes": _vector_codes()}
