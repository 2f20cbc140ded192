"""A training corpus from documents: five stages, each written and read again by the next."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusgauge.llm import lines, packing, secrets, simhash, toxicity
from corpusgauge.llm.common import table, written
from corpusgauge.llm.queries import vocabulary


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"))
    return scored.filter(F.col("predicted") == 0).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that another document keeps."""
    kept = lines.deduplicated(docs).withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept")))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.one_of_each(docs).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with live-looking secrets replaced."""
    clean = secrets.redact(docs, repository=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' ids in their sequences."""
    return packing.digest(packing.pack(docs, vocabulary()))


STAGES = [
    ("toxicity", without_toxic), ("line_dedup", without_repeated_lines), ("simhash_near_dedup", without_near_copies),
    ("secret_scan", without_secrets), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs


#: Classifier, fingerprints and tokenizer have no SQL.
ORACLE_SQL = None
