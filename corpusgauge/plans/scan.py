"""Apply rule packs to files."""

from pyspark.sql import DataFrame, functions as F

from ..functions.text import clamp_score, text_metrics
from ..model import FINDING_COLUMNS
from .checks import counted_metrics, none_found
from .rules import Rule, findings_array, rules_from_table, with_features


def rule_scan(files: DataFrame, rules: list[Rule], *keep: str, checks=()) -> DataFrame:
    """All findings of the rules and in-row checks of each file's language: one pass, nothing shuffled.

    `keep` names further file columns to carry along.
    """
    languages = {r.language for r in rules} | {l for c in checks for l in c.languages}
    marked = with_features(files.where(F.col("language").isin(*sorted(languages))), rules, checks)
    return (
        marked.select("job_id", "path", "language", *keep, F.inline(findings_array(rules, checks)))
        .select(*FINDING_COLUMNS, *keep)
    )


def scan_joined(files: DataFrame, rules: DataFrame, chunk: int = 500) -> DataFrame:
    """Findings of the enabled rules of a rule table.

    The rules are compiled like built-in ones, `chunk` to an array, over one read of the files: the patterns are literals,
    compiled once per task, and the text is neither joined nor shuffled.
    """
    compiled = rules_from_table(rules.where("enabled"))
    languages = sorted({r.language for r in compiled})
    marked = with_features(files.where(F.col("language").isin(*languages)), compiled, ())
    parts = [F.coalesce(findings_array(compiled[i : i + chunk], ()), none_found()) for i in range(0, len(compiled), chunk)]
    return marked.select("job_id", "path", "language", F.inline(F.concat(none_found(), *parts))).select(*FINDING_COLUMNS)


def detailed_files(files: DataFrame, rules: list[Rule], checks=()) -> DataFrame:
    """One JSON document per file with score, findings and metrics, written inside the file's row."""
    item = lambda f: F.struct(*[f[n].alias(n) for n in ("rule", "severity", "score_impact", "message", "line")])
    marked = with_features(files, rules, checks)
    rows = marked.select(
        "job_id", "path", "language", text_metrics("text").alias("metrics"),
        F.coalesce(findings_array(rules, checks), none_found()).alias("hits"))
    penalty = F.aggregate("hits", F.lit(0), lambda n, f: n + f["score_impact"])
    rows = rows.withColumn("score", clamp_score(100 - penalty))
    document = F.struct(
        "language", F.col("path").alias("file_path"), F.concat("language", F.lit("_analyzer")).alias("analyzer_name"),
        "score", F.array_sort(F.transform("hits", item)).alias("findings"), counted_metrics("metrics", F.col("hits")).alias("metrics"))
    return rows.select("job_id", "path", "language", "score", F.to_json(document).alias("details"))


def scanned_files(files: DataFrame, rules: list[Rule], checks=(), keep=()) -> DataFrame:
    """Score and findings (array `hits`) of every file in one pass; `keep` names file columns to carry along.

    The sums leave the row by a generator of one row: a test of the score is put above it, where it finds them, and not into
    the scan below, where it would run all rules and their features a second time.
    """
    marked = with_features(files, rules, checks)
    # The findings are a column of their own: sum and count read them, and they are computed once.
    rows = marked.select("job_id", "path", "language", *keep, F.coalesce(findings_array(rules, checks), none_found()).alias("hits"))
    penalty = F.aggregate("hits", F.lit(0), lambda n, f: n + f["score_impact"])
    sums = F.struct(penalty.alias("penalty"), F.size("hits").alias("findings"))
    return (
        rows.select("job_id", "path", "language", *keep, F.inline(F.array(sums)), "hits")
        .withColumn("score", clamp_score(100 - F.col("penalty")))
    )


def scored_files(files: DataFrame, rules: list[Rule], checks=(), keep=()) -> DataFrame:
    """Score of every file straight from the rule projection, without exploding or shuffling."""
    return scanned_files(files, rules, checks, keep).drop("hits")
