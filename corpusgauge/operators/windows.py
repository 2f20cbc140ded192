"""Running and ranked operators. Windows over a file's rows are bounded by that file's text."""

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.events import VOID_TAGS, block_array, line_array, py_line_array, stack_walk, tag_array
from .unnest import KEY

PER_FILE = ["job_id", "path"]
SO_FAR = (W.unboundedPreceding, 0)


def max_tag_depth(events: DataFrame, tag: str = "div") -> DataFrame:
    """Deepest nesting of a tag per file; surplus closes do not go below zero."""
    step = F.when(F.col("is_close"), -1).otherwise(1)
    rows = events.where(F.col("tag") == tag).withColumn("step", step)
    w = W.partitionBy(*PER_FILE).orderBy("pos").rowsBetween(*SO_FAR)
    rows = rows.withColumn("run", F.sum("step").over(w))
    rows = rows.withColumn("floor", F.least(F.min("run").over(w), F.lit(0)))
    return rows.groupBy(*KEY).agg(F.max(F.col("run") - F.col("floor")).cast("int").alias("depth"))


def tag_balance(events: DataFrame) -> DataFrame:
    """Per tag name: closes without an open before them, and opens left over. Order across tags is ignored."""
    step = F.when(F.col("is_close"), -1).otherwise(1)
    rows = events.where(~F.col("tag").isin(*VOID_TAGS) & (F.col("is_close") | ~F.col("is_void")))
    w = W.partitionBy(*PER_FILE, "tag").orderBy("pos").rowsBetween(*SO_FAR)
    rows = rows.withColumn("run", F.sum(step).over(w))
    return rows.groupBy(*KEY, "tag").agg(
        F.greatest(-F.min("run"), F.lit(0)).cast("int").alias("unexpected"),
        (F.sum(step) + F.greatest(-F.min("run"), F.lit(0))).cast("int").alias("unclosed"))


def tag_stack(files: DataFrame, skip_scripts: bool = False) -> DataFrame:
    """Exact nesting per page: array `errors` of (kind, tag) and the tags left open, in order."""
    walked = stack_walk(tag_array("text", skip_scripts))
    return files.select(*KEY, walked.alias("s")).select(*KEY, "s.errors", F.col("s.stack").alias("unclosed"))


def first_per_rule(findings: DataFrame, *order) -> DataFrame:
    """Only the first finding of every rule in a file."""
    order = order or ("line", "message")
    w = W.partitionBy("job_id", "path", "rule_id").orderBy(*order)
    return findings.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def indent_spans(files: DataFrame, header: str, python: bool = True) -> DataFrame:
    """Blocks by indentation: rows (line_no, indent, end_no) of the lines like `header`, found in the file's row.

    `end_no` is the next non-blank line indented no deeper, null at the end of the file. In Python texts, comments
    and strings are blanked first.
    """
    lines = py_line_array("text") if python else line_array("text")
    return files.select(*KEY, F.inline(block_array(lines, header)))


def run_trend(scores: DataFrame, runs: DataFrame) -> DataFrame:
    """Score change of a path against the run before; with original_name in runs, the run before of the same project."""
    project = [c for c in ("original_name",) if c in runs.columns]
    w = W.partitionBy(*project, "path").orderBy("created_at", "job_id")
    return (
        scores.join(runs.select("job_id", "created_at", *project), "job_id")
        .withColumn("previous", F.lag("score").over(w))
        .withColumn("change", F.col("score") - F.col("previous"))
        .select("job_id", "path", "score", "previous", "change")
    )


SALTS = 64


def worst_files(scores: DataFrame, k: int) -> DataFrame:
    """The k lowest scores per language.

    Ranked first within salted parts of a language, so that no task ranks all files of a hot one; the final
    rank sees at most k rows of each part.
    """
    order = ("score", "path")
    part = W.partitionBy("language", F.pmod(F.hash("path"), F.lit(SALTS))).orderBy(*order)
    firsts = scores.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k).drop("rank")
    whole = W.partitionBy("language").orderBy(*order)
    return firsts.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)
