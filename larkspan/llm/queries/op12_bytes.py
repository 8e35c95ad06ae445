"""op12: 200-byte strings that stand anywhere else too, removed."""

from larkspan.llm import byte_dedup
from larkspan.llm.registry import query
from larkspan.llm.shared import documents

SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) x FROM documents),
s AS (SELECT doc_id, unnest(range(0, len(x) // 2 - 199)) p, unnest(list_transform(range(0, len(x) // 2 - 199), lambda p: md5(substr(x, 2 * p + 1, 400)))) h FROM d WHERE len(x) >= 400),
f AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
g AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) q FROM s JOIN f USING (h)),
j AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) i FROM g),
r AS (SELECT doc_id, i, min(p) lo, max(p) + 200 hi FROM j GROUP BY ALL),
t AS (SELECT doc_id, count(*) n, sum(hi - lo) m, list(lo ORDER BY lo) ls, list(hi ORDER BY lo) hs FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) n_bytes, CAST(coalesce(m, 0) AS BIGINT) n_removed, CAST(coalesce(n, 0) AS BIGINT) n_spans,
sha256(unhex(CASE WHEN n IS NULL THEN x ELSE array_to_string(list_transform(range(1, n + 2), lambda i: substr(x, CASE WHEN i = 1 THEN 1 ELSE 2 * hs[i - 1] + 1 END, CASE WHEN i = n + 1 THEN len(x) ELSE 2 * ls[i] END - CASE WHEN i = 1 THEN 0 ELSE 2 * hs[i - 1] END)), '') END)) kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""


@query("op12_suffix_sort", SQL)
def op12_suffix_sort(spark, sf_dir):
    return byte_dedup.dedup(documents(spark, sf_dir))
