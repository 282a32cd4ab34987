"""Query op12_trie and its SQL."""

from emberframe.llm.common import Scratch, table
from emberframe.llm.trie import prefix_trie


def op12_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"), Scratch(spark))


OP12_SQL = r"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS own, conv_id - conv_id % 20 AS base, CAST(conv_id AS VARCHAR) AS s FROM o GROUP BY 1),
h AS (SELECT conv_id, own, base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT))),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 4 AS h FROM c),
lent AS (SELECT h.conv_id, o.n AS pos, o.role, o.text FROM h JOIN o ON o.conv_id = h.base AND o.n <= h.h),
k AS (SELECT conv_id, count(*) AS m FROM lent GROUP BY 1),
r AS (SELECT * FROM lent UNION ALL SELECT o.conv_id, o.n - h.h + coalesce(k.m, 0), role, text FROM o JOIN h ON o.conv_id = h.conv_id LEFT JOIN k ON k.conv_id = o.conv_id WHERE o.n > h.h),
p AS (SELECT conv_id, pos AS depth, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY pos) AS path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r),
q AS (SELECT conv_id, depth, path, path[1:depth - 1] AS up, words FROM p
      UNION ALL SELECT conv_id, 0, CAST([] AS STRUCT(r VARCHAR, t VARCHAR)[]), NULL, 0 FROM h),
e AS (SELECT conv_id, arg_max(path, depth) AS path FROM q GROUP BY 1),
d AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM e GROUP BY 1),
n AS (SELECT path, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM q GROUP BY 1),
ch AS (SELECT up, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY 1),
f AS (SELECT n.*, u.conv_id AS parent_conv_id, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN n u ON u.path = n.up LEFT JOIN ch ON ch.up = n.path),
t AS (SELECT a.path, b.path AS sub FROM (SELECT DISTINCT a.path, b.path AS p2 FROM q a JOIN q b ON a.conv_id = b.conv_id AND a.depth <= b.depth) a JOIN f b ON b.path = a.p2),
w AS (SELECT t.path, CAST(sum(CAST(b.n_children = 0 AS BIGINT)) AS BIGINT) AS n_leaves, CAST(sum((b.n_convs - 1) * b.words) AS BIGINT) AS saved_tokens FROM t JOIN f b ON b.path = t.sub GROUP BY 1)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM f JOIN w ON w.path = f.path LEFT JOIN d ON d.path = f.path
"""

QUERIES = {"op12_trie": op12_trie}
ORACLES = {"op12_trie": OP12_SQL}
