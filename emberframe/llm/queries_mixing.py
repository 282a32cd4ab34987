"""Query op8_mixing and its SQL."""

from pyspark.sql import functions as F

from emberframe.llm.common import Scratch, table
from emberframe.llm.mixing import mix


def op8_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, Scratch(spark)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, text, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
k AS (SELECT *, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, [5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight FROM s),
o AS (SELECT *, row_number() OVER q AS rn, sum(cap) OVER q - cap AS caps, sum(weight) OVER (ORDER BY cap / weight DESC, source DESC NULLS FIRST) AS rest, sum(source_size) OVER () AS total
      FROM w WINDOW q AS (ORDER BY cap / weight, source ASC NULLS LAST)),
l AS (SELECT CAST(total - caps AS DOUBLE) / rest AS level FROM o WHERE weight * (CAST(total - caps AS DOUBLE) / rest) <= cap ORDER BY rn LIMIT 1),
t AS (SELECT source, source_size, least(weight * level, CAST(cap AS DOUBLE)) AS target FROM w, l),
p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM t),
r AS (SELECT *, target - whole * source_size AS part FROM p),
c AS (SELECT source, key, count(*) AS tied, any_value(size) AS size FROM k GROUP BY source, key),
u AS (SELECT *, sum(tied * size) OVER (PARTITION BY source ORDER BY key) AS upto FROM c),
x AS (SELECT u.source, arg_min(u.key, u.key) AS cut, arg_min(coalesce(CAST(floor((part - upto + tied * size) / nullif(size, 0) + 0.5) AS BIGINT), 0), u.key) AS some
      FROM u JOIN r ON u.source IS NOT DISTINCT FROM r.source WHERE upto >= part GROUP BY u.source),
n AS (SELECT *, row_number() OVER (PARTITION BY source, key) AS turn FROM k)
SELECT n.doc_id, n.size, r.source_size, r.target, CAST(n.size * (r.whole + CASE WHEN n.key < x.cut OR (n.key = x.cut AND n.turn <= x.some) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM n JOIN r ON n.source IS NOT DISTINCT FROM r.source JOIN x ON n.source IS NOT DISTINCT FROM x.source
"""

QUERIES = {"op8_mixing": op8_mixing}
ORACLES = {"op8_mixing": OP8_SQL}
