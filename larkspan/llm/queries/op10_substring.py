"""op10: passages of fifty words that an earlier document has, removed."""

from larkspan.llm import substring_dedup
from larkspan.llm.registry import query
from larkspan.llm.shared import documents

SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) i, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) h FROM d WHERE len(w) >= 50),
f AS (SELECT h, min(doc_id) m FROM s GROUP BY h HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) p FROM s JOIN f USING (h) WHERE doc_id > m),
r AS (SELECT doc_id, list(p) ps FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(len(coalesce(ps, [])) AS BIGINT) n_removed,
sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""


@query("op10_fm_index", SQL)
def op10_fm_index(spark, sf_dir):
    return substring_dedup.dedup(documents(spark, sf_dir))
