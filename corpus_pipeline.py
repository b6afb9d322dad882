"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Quality rules reject documents, near-duplicates leave one document of each group, documents that
hold a benchmark passage go, secrets are redacted, and what is left is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from branchspark.llm import bpe_codec, contamination, near_dup, quality, secret_scan
from branchspark.llm.common import cut, table


def bpe_stage(spark, docs, sf_dir):
    """doc_id, lang, source, n_tokens, token_ids (little-endian unsigned 32-bit integers) and
    the text decoded from them."""
    coded = bpe_codec.encode_decode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "lang", "source", F.floor(F.octet_length("token_ids") / 4).alias("n_tokens"), "token_ids", "decoded")


STAGES = [
    ("quality_rules", quality.stage),
    ("near_duplicates", near_dup.stage),
    ("decontamination", contamination.stage),
    ("secret_scan", secret_scan.stage),
    ("bpe_codec", bpe_stage),
]
#: Rows of whole texts that cross to Python at once: what the JVM and a Python worker hold of them, twice an executor's cores.
BATCH_ROWS = 1_000
#: SQL can't express the encoding; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage, each stage having worked on all that the one before kept. The session
    is left with Arrow batches of at most BATCH_ROWS rows, as the last stage is yet to run."""
    batches = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(batches)) <= BATCH_ROWS:
        spark.conf.set(batches, str(BATCH_ROWS))
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
