"""The same rules over files that keep arriving."""

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..plans.rules import Rule
from ..plans.scan import rule_scan, scored_files


def scan_stream(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings of newly arrived files; stateless, so rows can be appended."""
    return rule_scan(files, rules)


def summary_stream(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """Running count, total and mean score per language; for update or complete mode."""
    return scored_files(files, rules).groupBy("language").agg(
        F.count("*").alias("files"), F.sum("score").alias("total"),
        F.bround(F.avg("score"), 2).alias("average_score"))


CHANGES = "language string, files long, total long"


def score_changes(scores: DataFrame, arrived: str = "created_at") -> DataFrame:
    """Rows (language, files, total) by which each arrival changes the summary of a stream of scores.

    A file, known by job_id and path, counts with its newest score only: when it arrives again its old score is taken out and
    the new one put in. Of arrivals of one time the larger language and score stays. One small row per file is kept as state.
    """
    def changed(key, batches, state):
        old, best = state.getOption, None
        for rows in batches:
            for row in rows[["at", "language", "score"]].itertuples(index=False, name=None):
                best = row if best is None or row > best else best
        if best is None or (old is not None and best <= tuple(old)):
            return
        out = [] if old is None else [(old[1], -1, -old[2])]
        state.update(tuple(best))
        yield pd.DataFrame([*out, (best[1], 1, best[2])], columns=["language", "files", "total"])

    rows = scores.select("job_id", "path", F.col(arrived).cast("timestamp").cast("double").alias("at"), "language", F.col("score").cast("long").alias("score"))
    rows = rows.where("at is not null and language is not null and score is not null")
    return rows.groupBy("job_id", "path").applyInPandasWithState(
        changed, CHANGES, "at double, language string, score long", "append", GroupStateTimeout.NoTimeout)


def summary_of(changes: DataFrame) -> DataFrame:
    """Count, total and mean score per language from what score_changes has given so far."""
    sums = changes.groupBy("language").agg(F.sum("files").alias("files"), F.sum("total").alias("total")).where("files > 0")
    return sums.select("language", "files", "total", F.bround(F.col("total") / F.col("files"), 2).alias("average_score"))


def findings_per_window(findings: DataFrame, time: str = "created_at", size: str = "1 hour",
                        late: str = "2 hours") -> DataFrame:
    """Findings by severity in tumbling windows of arrival time; rows later than `late` are dropped."""
    return (
        findings.withWatermark(time, late)
        .groupBy(F.window(time, size).alias("w"), "severity").agg(F.count("*").alias("findings"))
        .select(F.col("w.start").alias("window_start"), "severity", "findings")
    )


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", key: tuple = ()) -> None:
    """Process what has arrived into parquet files and stop.

    Complete mode replaces the output with the result table of each batch. Update mode tells only the rows that changed, so
    it needs their `key`: rows of the output with other keys stay. Each batch then writes a new folder below path, named by its
    number; the one with the largest number is the output (see latest).
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    elif mode == "complete":
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    elif not key:
        raise ValueError("update mode needs the key of the rows")
    else:
        def merge(batch, number):
            before = latest(batch.sparkSession, path, number)
            whole = batch if before is None else batch.unionByName(before.join(batch, list(key), "left_anti"))
            whole.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

        query = writer.foreachBatch(merge).start()
    query.awaitTermination()


def latest(spark, path: str, under: int | None = None) -> DataFrame | None:
    """The output of update mode after its last batch, or its last batch below a number; None if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    numbers = sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))
    numbers = [n for n in numbers if under is None or n < under]
    return spark.read.parquet(f"{path}/batch={numbers[-1]:012d}") if numbers else None
