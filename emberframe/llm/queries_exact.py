"""Query op11_exact_dedup and its SQL."""

import uuid

from pyspark.sql import functions as F

from emberframe.llm.common import Scratch, table
from emberframe.llm.exact import DigestIndex, digests, label


def op11_exact_dedup(spark, sf_dir):
    """Two arrivals, of even and of other ids, enter one index; then every row is labelled."""
    scratch = Scratch(spark)
    rows = scratch.put(digests(table(spark, sf_dir, "documents")), "digests")
    kind = rows.schema["doc_id"].dataType.simpleString()
    index = DigestIndex(spark, f"{scratch.root}/index", f"digests_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions")), kind)
    early = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    index.add(rows.where(early))
    index.add(rows.where(~early))
    out = scratch.put(label(rows, index, scratch), "labelled")
    index.forget()
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP11_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT *, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) AS turn FROM d WINDOW w AS (PARTITION BY text_sha256))
SELECT doc_id, keep_id, group_size, turn = 1 AS kept, text_sha256 FROM g
"""

QUERIES = {"op11_exact_dedup": op11_exact_dedup}
ORACLES = {"op11_exact_dedup": OP11_SQL}
