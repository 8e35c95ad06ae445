"""op11: what five filters remove in each of their 120 orders."""

from larkspan.llm import filter_audit
from larkspan.llm.registry import query
from larkspan.llm.shared import documents

SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') part, coalesce(text, '') x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) toxic FROM labels GROUP BY doc_id),
f AS (SELECT x, min(doc_id) m FROM t GROUP BY x),
d AS (SELECT part, coalesce(good, 0) good, coalesce(toxic, 0) toxic,
  CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN t.doc_id > m THEN 'E' ELSE '' END fails
  FROM t JOIN f USING (x) LEFT JOIN l ON l.doc_id = t.doc_id),
c AS (SELECT part, good, toxic, fails, count(*) n FROM d GROUP BY ALL),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) a),
o AS (SELECT p.a || q.a || r.a || s.a || u.a o FROM a p, a q, a r, a s, a u WHERE q.a <> p.a AND r.a NOT IN (p.a, q.a) AND s.a NOT IN (p.a, q.a, r.a) AND u.a NOT IN (p.a, q.a, r.a, s.a)),
e AS (SELECT part, o, k, n, good, toxic, fails, contains(fails, o[k]) hit, len(regexp_extract_all(fails, '[' || o[1:k] || ']')) - CASE WHEN contains(fails, o[k]) THEN 1 ELSE 0 END earlier
  FROM c, o, (SELECT unnest(range(1, 6)) k)),
r AS (SELECT part, o, k, o[k] a, sum(CASE WHEN NOT hit AND earlier = 0 THEN n ELSE 0 END) kept, sum(CASE WHEN hit AND earlier = 0 THEN n ELSE 0 END) removed,
  sum(CASE WHEN hit AND earlier > 0 THEN n ELSE 0 END) redundant, sum(CASE WHEN fails = o[k] THEN n ELSE 0 END) unique_fails,
  sum(CASE WHEN hit AND earlier = 0 THEN n * good ELSE 0 END) good_lost, sum(CASE WHEN hit AND earlier = 0 THEN n * toxic ELSE 0 END) toxic_lost FROM e GROUP BY ALL),
s AS (SELECT part, a, sum(removed) shapley FROM r GROUP BY ALL)
SELECT part, o filter_order, CAST(k AS INTEGER) step, CAST(kept AS BIGINT) kept, CAST(removed AS BIGINT) removed, CAST(redundant AS BIGINT) redundant, CAST(unique_fails AS BIGINT) unique_fails,
CAST(good_lost AS BIGINT) good_lost, CAST(toxic_lost AS BIGINT) toxic_lost, CAST(shapley AS BIGINT) shapley FROM r JOIN s USING (part, a)
"""


@query("op11_walsh_audit", SQL)
def op11_walsh_audit(spark, sf_dir):
    masked = filter_audit.masks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return filter_audit.audit(masked, list("ABCDE"))
