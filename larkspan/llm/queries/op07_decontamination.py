"""op7: which documents share ten words in a row with a benchmark item."""

from larkspan.llm import winnowing
from larkspan.llm.registry import query
from larkspan.llm.shared import documents

SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
bi AS (SELECT item_id, least(10, len(w)) l, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) s FROM bw WHERE len(w) > 0),
ls AS (SELECT DISTINCT l FROM bi),
di AS (SELECT doc_id, l, unnest(range(1, len(w) - l + 2)) i, unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i + l - 1], ' '))) s FROM dw, ls),
h AS (SELECT DISTINCT doc_id, i, l, item_id FROM di JOIN bi USING (l, s)),
c AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) p FROM (SELECT DISTINCT doc_id, i, l FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) n_items, string_agg(s, ',' ORDER BY s) x FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) s FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items, sha256(coalesce(x, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM dw LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op7_winnowing", SQL)
def op7_winnowing(spark, sf_dir):
    return winnowing.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
