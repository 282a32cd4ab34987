"""Query op13_divergence and its SQL."""

from emberframe.llm.common import Scratch, table
from emberframe.llm.divergence import audit


def op13_divergence(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents").select("lang", "source", "text"), Scratch(spark))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT lang, source, k, unnest(ts) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS df FROM t GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY ALL HAVING sum(df) >= 10),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT c.lang, c.source, CAST(sum(c.n) AS HUGEINT) AS total FROM c JOIN kept USING (lang, term) GROUP BY ALL),
full_ AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.total, 0) + 2 * l.v) AS p,
  1 + 1000000000::HUGEINT * (kept.n + 2) // (l.total + 2 * l.v) AS q
  FROM g JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM full_ a JOIN full_ b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM full_ WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""

QUERIES = {"op13_divergence": op13_divergence}
ORACLES = {"op13_divergence": OP13_SQL}
