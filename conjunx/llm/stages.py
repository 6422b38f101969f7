"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns what the next one works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conjunx.llm import decontaminate, language_id, mixing, pii, simhash
from conjunx.llm.common import table

#: A document of which no language has this share of the letters is rejected.
LEAST_SHARE = 0.4


def _sized(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars as its text now has, if there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one identifiable language: no letters (also a null text), or no language with two fifths of the
    letters, is rejected.  The model learns from the labelled documents of ``docs``; where none is labelled, only
    texts without letters are rejected.  Rows are judged each by its own text, whatever their ids; no rows in, no rows out."""
    if (model := language_id.train(docs)) is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(docs, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SHARE)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by a similarity of 0.8 or more of their
    shingles of five words.  Rows with equal or null ids are told apart by their texts; equal rows are a group.  Texts
    without words stay."""
    return simhash.drop_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark cut out; those with more than half of their words in such go.  Null and
    empty texts have none, an empty benchmark changes nothing; rows are judged each by itself, whatever their ids."""
    return _sized(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind: of every row that of its own text, whatever its id.  Null and empty
    texts stay as they are."""
    return _sized(pii.redact(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that a shard draws a document, with the document's columns and those of ``mix``.  Null
    and empty texts are never drawn; a null source is a source; rows with equal ids are drawn each by itself."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", languages),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
]
