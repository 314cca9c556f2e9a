"""Corpus pipeline: language ID, line dedup, near-duplicate removal, benchmark decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the shared folder and read
again as the next stage's docs. All but the last return the columns of documents.

Defined results: documents with a null or empty text are rejected by the first stage; a copy that loses all its lines to an
earlier document goes with the second (so that the third sees fewer of the near copies: what they share with an earlier
document is gone from them by then); of each group of near duplicates the least doc_id stays; rows that repeat a
doc_id pass or go together in the third stage; a null doc_id passes the second and third; a very long text is treated whole
in every stage; columns beside doc_id, text and lang, of whatever name, pass through untouched, but that
n_chars follows the text; an empty table gives an empty table. The last stage has doc_id, ids and n_tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, decontam, jaccard, langid, linedup
from tessella.llm.textvec import written

STAGES = [
    ("language_id", langid.stage),
    ("line_dedup", linedup.stage),
    ("ngram_jaccard", jaccard.stage),
    ("decontamination", decontam.stage),
    ("bpe", bpe.stage),
]

ORACLE_SQL = None  # SQL can't express language ID, patience diff or BPE; tests/llm/test_pipeline.py has brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
