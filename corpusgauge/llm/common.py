"""Helpers shared by the operators of this subpackage."""

from pyspark.sql import DataFrame, SparkSession

from corpusgauge.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the folder in spark.checkpoint.dir and read again.

    Cuts the lineage: what follows neither computes df twice nor depends on an executor that made it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
