"""op13: each language's phrases whose words stand together most."""

from larkspan.llm import collocations
from larkspan.llm.registry import query
from larkspan.llm.shared import documents

SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') w FROM p),
g AS (SELECT lang, 1 k, unnest(w) s FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w WHERE len(w) > 2),
f AS (SELECT lang, k, s, count(*) f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, s, f a, string_split(s, ' ') w FROM f WHERE k > 1 AND f >= 10),
x AS (SELECT lang, s, k, a, 1 j, w[1] h, array_to_string(w[2:], ' ') t FROM c UNION ALL SELECT lang, s, k, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE k = 3),
y AS (SELECT x.lang, x.s, x.k, a, j, h.f l, t.f r, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) score
  FROM x JOIN f h ON h.lang = x.lang AND h.s = x.h AND h.k = j JOIN f t ON t.lang = x.lang AND t.s = x.t AND t.k = x.k - j),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, j) = 1),
e AS (SELECT lang, w[1] || ' ' || w[2] s, a FROM c WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE k = 3),
m AS (SELECT lang, s, max(a) most FROM e GROUP BY ALL),
q AS (SELECT z.*, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, z.s) i FROM z LEFT JOIN m ON m.lang = z.lang AND m.s = z.s WHERE most IS NULL OR 100 * most < 50 * a)
SELECT q.lang, i "rank", s phrase, a, l, r, CAST(n AS BIGINT) n, score FROM q JOIN n ON n.lang = q.lang WHERE i <= 2000
"""


@query("op13_collocations", SQL)
def op13_collocations(spark, sf_dir):
    return collocations.mine(documents(spark, sf_dir))
