"""From raw documents to packed training sequences, in five stages.

Every stage takes what its predecessor kept, written as Parquet and read again.  All stages but
the last return the columns of ``documents``.  Null, empty, repeated and very long texts, null ids
and further columns, whatever their names, are handled as the operators' docstrings say; rows are
told apart by their place in the table, so repeated ids are no obstacle, and an empty table stays
empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import decontaminate, exact_dedup, packing, simhash, toxicity
from holdfast.llm.shared import ROW, as_table, documents, free, keyed, named, spill

#: For the near-duplicate stage: words in a shingle, differing bits of two fingerprints that make
#: them a candidate, and the share of common shingles that makes them near copies.
SHINGLE = 5
MAX_DIFF = 12
SIMILARITY = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, model)


def _keep(table: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The rows of ``table``, its own columns, whose place is (``left_semi``) or is not (``left_anti``) in ``rows``."""
    key = free(table, ROW)
    return keyed(table, key).join(rows.withColumnRenamed(rows.columns[0], key), key, how).select(*named(table.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    table, path = as_table(docs)
    kept = exact_dedup.exact_dedup(spark, path).filter("kept")
    return _keep(table, kept.select(F.struct("file", "row").alias(ROW)), "left_semi")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id (then the first in the table)."""
    table, _ = as_table(docs)
    key = free(table, ROW)
    groups = simhash.near_groups(keyed(table, key), size=SHINGLE, max_diff=MAX_DIFF, similarity=SIMILARITY, row_col=key, every=True)
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")
    kept = groups.groupBy("root").agg(F.min(rank).alias("first")).select(F.col("first.row_key").alias(ROW))
    return _keep(table, kept, "left_semi")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    table, _ = as_table(docs)
    key = free(table, ROW)
    found = decontaminate.matches(keyed(table, key), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), row_col=key)
    found, _ = spill(found.select(F.col("row_key").alias(ROW)).distinct(), "leaks")
    return _keep(table, found, "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.digest(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are a table in the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs, _ = spill(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: Trained models, latent vectors and fingerprint components have no SQL form.
ORACLE_SQL = None
