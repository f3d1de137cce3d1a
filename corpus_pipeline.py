"""Corpus cleaning as a chain of stages, each written as Parquet and read again before the next.

Quality rejects go; of each group of near copies one document stays;
contaminated documents go; personal data is replaced in the texts; the rest is
mixed to target weights. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blobsearch.llm import decontaminate, jaccard, mixing, pii, quality
from blobsearch.llm.store import settle, table

STAGES = [
    ("quality", quality.keep_good),
    ("near copies", jaccard.keep_one_of_each),
    ("decontaminate", decontaminate.keep_uncontaminated),
    ("personal data", pii.without_pii),
    ("mix", mixing.mixed),
]

#: The classifier's and the network's decisions are outside SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
