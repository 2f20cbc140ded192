"""Run outputs: findings, scores, details documents, run registry, exports."""

from pyspark.sql import DataFrame, functions as F

from ..functions.text import content_hash, size_bytes, text_metrics
from ..model import DETAILS, FINDING_COLUMNS
from ..operators.unnest import KEY
from ..plans.checks import counted_metrics

FILE = ["job_id", "path"]
SALTS = 32


def _write(df: DataFrame, path: str) -> None:
    """Write by job and language; the rows of one folder come from at most as many tasks as there are salts."""
    salt = F.pmod(F.hash("path"), F.lit(SALTS))
    (df.repartition("job_id", "language", salt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("job_id", "language").parquet(path))


def write_findings(findings: DataFrame, path: str) -> None:
    """Replace the (job_id, language) partitions that the findings hold, keep the others."""
    _write(findings, path)


def write_scores(scores: DataFrame, path: str) -> None:
    _write(scores, path)


def write_results(scanned: DataFrame, path: str) -> None:
    """Scores with their findings nested, from one pass over the texts: scores and findings are both read from it."""
    _write(scanned, path)


def findings_of(scanned: DataFrame) -> DataFrame:
    """The findings of a table of nested results."""
    return scanned.select(*KEY, F.inline("hits")).select(*FINDING_COLUMNS)


def file_records(files: DataFrame, created_at) -> DataFrame:
    """The registry of a run's files: hash, size and arrival time next to the text."""
    return files.select(
        "job_id", "path", "language", content_hash("text").alias("sha256"), size_bytes("text").alias("size_bytes"),
        "text", created_at.cast("timestamp").alias("created_at"))


def file_metrics(files: DataFrame) -> DataFrame:
    return files.select(*KEY, text_metrics("text").alias("metrics"))


def to_details_json(scores: DataFrame, findings: DataFrame, metrics: DataFrame) -> DataFrame:
    """One JSON document per file with its findings and metrics; a group holds one file's findings."""
    item = F.struct("rule", "severity", "score_impact", "message", "line")
    nested = findings.groupBy(*FILE).agg(F.array_sort(F.collect_list(item)).alias("found"))
    rows = scores.join(metrics.select(*FILE, "metrics"), FILE).join(nested, FILE, "left")
    empty = F.array().cast(DETAILS["findings"].dataType)
    document = F.struct(
        "language", F.col("path").alias("file_path"), F.concat("language", F.lit("_analyzer")).alias("analyzer_name"),
        "score", F.coalesce("found", empty).alias("findings"), counted_metrics("metrics", F.coalesce("found", empty)).alias("metrics"))
    return rows.select(*KEY, "score", F.to_json(document).alias("details"))


def from_details_json(documents: DataFrame) -> DataFrame:
    """Documents back as typed rows: one per finding."""
    parsed = documents.select("job_id", F.from_json("details", DETAILS).alias("d"))
    return parsed.select(
        "job_id", F.col("d.file_path").alias("path"), F.col("d.language").alias("language"),
        F.col("d.score").alias("score"), F.inline("d.findings"))


def register_run(runs: DataFrame, new: DataFrame) -> DataFrame:
    """One row per job, the newest wins; a maximum, so rows of a job are combined before the shuffle."""
    newest = F.max(F.struct("created_at", "original_name")).alias("r")
    return runs.unionByName(new).groupBy("job_id").agg(newest).select("job_id", "r.original_name", "r.created_at")


#: Folders that a keyed table is dealt over.
BUCKETS = 64


def upsert(new: DataFrame, path: str, key: tuple, newest: str, buckets: int = BUCKETS) -> None:
    """Merge rows into a keyed table on disk: of rows with equal keys the one with the largest `newest` stays, ties to the
    largest of the other columns.

    The table is partitioned by a hash of the key. Only the buckets that new rows fall into are read and written; a dynamic
    overwrite swaps them when all tasks are done, so a job that fails before leaves the table as it was. Null keys are one key.
    """
    spark, columns = new.sparkSession, new.columns
    rows = new.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most `buckets` numbers
    if not touched:
        return
    old = current(spark, path)
    if old is not None:
        rows = rows.unionByName(old.where(F.col("bucket").isin(*touched)))
    rest = [c for c in columns if c not in key and c != newest]
    best = F.max(F.struct(newest, *rest)).alias("r")
    merged = rows.groupBy("bucket", *key).agg(best).select(
        *[F.col(c) if c in key else F.col(f"r.{c}").alias(c) for c in columns], "bucket")
    (merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))


def current(spark, path: str) -> DataFrame | None:
    """A keyed table with its bucket; None if nothing was written yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder) else None


def upsert_runs(new: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Register runs in the registry at a path: one row per job, the newest wins; other jobs' buckets aren't touched."""
    upsert(new.select("job_id", "original_name", "created_at"), path, ("job_id",), "created_at", buckets)


def export_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a report table as csv with header, or as JSON lines."""
    if fmt == "csv":
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
