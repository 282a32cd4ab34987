"""Query op4_bpe; the merges have no SQL form, so tests hold them against a plain encoder."""

import public_tokenizers
from pyspark.sql import functions as F

from emberframe.llm.bpe import encode_texts
from emberframe.llm.common import table


def op4_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op4_bpe": op4_bpe}
ORACLES: dict = {}
