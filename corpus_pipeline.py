"""A training corpus from raw documents: five stages, each over all that its
predecessor kept.  Every stage but the last returns the columns of documents.

Any column may be null; further columns, of any names, come back as they were;
an empty table gives an empty one; rows may repeat.  What a stage does with null
and empty texts, ties and repeated rows its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblink.llm.common import cut, table
from biblink.llm.decontaminate import decontaminate
from biblink.llm.mixing import mix
from biblink.llm.quality import keep_good
from biblink.llm.secrets import redact
from biblink.llm.simhash import keep_one_of_each


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of texts that may have changed."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go: null and empty texts are judged as texts
    without words, repeated rows alike, and a score at the threshold stays."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest id.  Null, empty and
    blank texts are one group; of rows with equal id and text one stays; rows without
    an id are told apart by their texts."""
    return keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark passages go; a null text stays null, and every row stays."""
    return _recounted(decontaminate(docs, table(spark, sf_dir, "benchmark")))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a tag; a null text stays null, every row stays, repeated rows are
    cleaned alike."""
    return _recounted(redact(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The order in which the documents of each source are read, and how often.  Texts without
    words are never dealt, a null source is one of its own, repeated rows are dealt
    one by one."""
    return mix(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scan", secrets_stage),
    ("source mixing", mixing_stage),
]

#: The classifier and the fingerprints can't be told in SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = cut(docs, f"stage-{number}")
    return docs
