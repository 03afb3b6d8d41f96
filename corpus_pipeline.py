"""Corpus pipeline: each stage is written as Parquet in the shared folder and reread as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagstream.llm.common import documents, remove, staged
from tagstream.llm.jaccard import jaccard_stage
from tagstream.llm.mixing import mixing_stage
from tagstream.llm.packing import packing_stage
from tagstream.llm.templates import templates_stage
from tagstream.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", templates_stage),
    ("near_duplicates", jaccard_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Hashed splitting trees, tokenizers and trained classifiers have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's output is deleted once the next one's is written, but for the last stage's input."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs, path = staged(spark, stage, docs, sf_dir, name)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
