"""From raw documents to training text in five stages.

Each stage takes what its predecessor kept, and its decisions take effect:

1. quality: documents that the classifier rejects (form or civility) go;
2. near_dedup: one document of each group of near copies stays;
3. decontamination: spans shared with benchmark items are cut out of the text, and a
   document of which they are more than half goes;
4. pii: personal data are replaced by surrogates;
5. byte_bpe: texts are encoded, and decoded again into ``text``.

Stages 1 to 4 return the columns of documents (``n_chars`` follows the text); the last
adds ``n_tokens``, ``token_ids`` and the digest of the ids.  No stage can be expressed in
SQL as a whole, so ``ORACLE_SQL`` is None and the tests use brute force instead.

Edge cases: documents without words (null, empty, blank) don't pass the first stage, so no later stage
gets them from ``run``, but each takes them; rows of one id count as one document in the second, which
leaves one of them, and rows without an id all stay; very long texts go through whole; of equal texts
the smallest id stays; a document of which all is cut or dropped leaves no empty row behind; an empty
table gives an empty result; further columns stay as they are, whatever their names, and the last stage
puts underscores before names of its own that are taken; empty benchmark or labels tables are allowed.

Each stage is written to the shared folder and what it was read from is deleted then, so the folder holds
the rows of two stages at most; those of the last but one stay for whoever reads the result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logradex.llm import bpe, common, decontam, neardup, pii, quality


def _sized(docs: DataFrame) -> DataFrame:
    """With ``n_chars`` brought up to date."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", n)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs, words=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark")))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(pii.with_surrogates(docs, key=pii.checked_key(docs, pii.session_key(spark))))


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenised(docs, *bpe.public_vocabulary())


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("byte_bpe", byte_bpe_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        at = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            common.remove(spark, before)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
