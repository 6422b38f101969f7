"""A corpus pipeline: language ID, near-duplicates, benchmark decontamination, personal data, mixing.

Each stage's rows are written as Parquet to the shared folder and read again, so that a stage never recomputes
its predecessors and a lost executor costs no more than its own tasks.  A stage's rows are deleted once the next one's
are written; the last one's stay for whoever reads the result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from conjunx.llm.common import discard, shared_dir
from conjunx.llm.stages import STAGES

#: Language models, fingerprints and reliabilities are not for SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            discard(spark, f"{folder}/{k - 1}")
    return docs
