"""The training-data pipeline: five operators in a row over ``documents``.

Each stage works on all that the one before kept and is written as Parquet
before the next reads it.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from llm.decontaminate import decontamination_stage
from llm.mixture import mixing_stage
from llm.ngram_join import jaccard_stage
from llm.quality import quality_stage
from llm.scratch import save
from llm.token_output import token_stage

STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", token_stage),
]

#: SQL cannot express the fitted classifier or the tokenizer; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
