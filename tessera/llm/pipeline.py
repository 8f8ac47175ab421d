"""A corpus pipeline of five stages; each reads what the one before it wrote.

Documents that the quality rules reject go, one document of each group of near copies stays,
secrets are replaced by a mark, the sources are mixed to their target weights (a document
may come back twice, in the passages drawn, or go), and what is left is encoded.

Null or empty texts fail the quality rules, so they go first; a stage by itself keeps them
(redaction, near copies) or takes no word of them (mixture). Rows without an id and rows that
share one are documents like others. An empty table gives an empty one. Columns are packed or
numbered on the way, so names may be any. A text is worked on whole, however long.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.bpe import encode_documents
from tessera.llm.fertility import keep_good
from tessera.llm.jaccard import keep_one
from tessera.llm.mixing import mixed
from tessera.llm.secrets import redact
from tessera.runtime import ensure_checkpoint_dir, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("secrets", secrets), ("mixture", mixture), ("tokens", tokens)]
#: The stages decode vocabularies, hash shingles and permute blocks: SQL can't express them.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage writes lies in the shared folder until the next
    one has written; what the last one reads stays, as the result is read from it."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        if k:
            _delete(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
