"""Cleaning of a document corpus in five stages, from raw rows to token ids.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. ``run`` applies them in order and writes each result to
the folder in ``spark.checkpoint.dir``, from which the next stage reads, so a
lost executor costs a re-read and no stage is computed twice. All stages but
the last return the columns of documents; extra columns are dropped at once.

Null and empty texts pass through as they are: the classifier judges them by the
statistics of the empty text, near-dedup keeps one of them, and they have no ids.
Repeated rows are near copies of each other, so one stays; among copies the row
with the smallest id does. Very long texts are treated whole in every stage. Empty
tables give no rows; without labels of both classes the classifier keeps all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oddsloom.llm import bpe_tree, decontaminate, quality_qda, secret_ledger, simhash_gray
from oddsloom.llm.common import DOCUMENT_COLUMNS, read, tokenizer_path
from oddsloom.session import materialize, scratch_path, ship_package


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled ones among ``docs``."""
    ship_package(spark)
    docs = docs.select(*DOCUMENT_COLUMNS)
    training = quality_qda.with_statistics(docs, skip_held_out=True)
    model = quality_qda.fit(training, read(spark, sf_dir, "labels"), "quality")
    return quality_qda.keep_good(docs, model)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    ship_package(spark)
    return simhash_gray.keep_one(docs.select(*DOCUMENT_COLUMNS))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a test item."""
    ship_package(spark)
    return decontaminate.drop_contaminated(docs.select(*DOCUMENT_COLUMNS), read(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in a text replaced by a mark."""
    ship_package(spark)
    scanned = secret_ledger.scan(docs.select(*DOCUMENT_COLUMNS), scratch_path(spark, "ledger"), "0")
    return secret_ledger.redact(scanned, DOCUMENT_COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document."""
    ship_package(spark)
    # The encoder works on 512 texts at a time; larger batches only wait in memory, in the JVM and in each worker.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 512)
    return bpe_tree.encode(docs, tokenizer_path())


STAGES = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", distinct_documents),
    ("benchmark decontamination", without_benchmarks),
    ("secret scans", without_secrets),
    ("bpe encoding", token_ids),
]

#: Neither the classifier nor the alignment nor the tokenizer can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
