"""Scores, counts, summaries and repetition checks. Sums and counts are combined before every shuffle."""

from pyspark.sql import DataFrame, functions as F

from ..functions.events import repeated_counts, trimmed_lines
from ..functions.sheets import signature
from ..functions.text import clamp_score, content_hash, extract_all, squeeze
from ..plans.features import ID, URL
from .unnest import KEY, css_rules

FILE = ["job_id", "path"]


def file_scores(files: DataFrame, findings: DataFrame) -> DataFrame:
    """100 minus the impacts, kept within 0..100; only keys of files are shuffled, not their text."""
    penalty = findings.groupBy(*FILE).agg(
        F.sum("score_impact").alias("penalty"), F.count("*").alias("findings"))
    return (
        files.select(*KEY).join(penalty, FILE, "left")
        .select(*KEY,
                F.coalesce("penalty", F.lit(0)).cast("long").alias("penalty"),
                F.coalesce("findings", F.lit(0)).cast("long").alias("findings"))
        .withColumn("score", clamp_score(100 - F.col("penalty")))
    )


def finding_counts(findings: DataFrame) -> DataFrame:
    """Per file: total and maps of counts by severity and by category.

    Counted per (severity, category) first, so a map is built from a handful of rows.
    """
    cells = findings.groupBy(*FILE, "severity", "rule").agg(F.count("*").alias("n"))

    def counts(name):
        per = cells.groupBy(*FILE, name).agg(F.sum("n").alias("n"))
        entries = F.array_sort(F.collect_list(F.struct(name, "n")))
        return per.groupBy(*FILE).agg(F.map_from_entries(entries).alias(f"{name}_counts"))

    total = cells.groupBy(*FILE).agg(F.sum("n").alias("finding_count"))
    return (
        total.join(counts("severity"), FILE).join(counts("rule"), FILE)
        .withColumnRenamed("rule_counts", "category_counts")
    )


def language_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("language").agg(
        F.count("*").alias("files"), F.sum("score").alias("total"),
        F.bround(F.avg("score"), 2).alias("average_score"))


def overall_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count("*").alias("files"), F.count_distinct("language").alias("languages"),
        F.bround(F.avg("score"), 1).alias("average_score"), F.sum("findings").alias("findings"))


def summary_rollup(scores: DataFrame) -> DataFrame:
    """Per language and overall; language is null and level 1 in the grand total."""
    return scores.rollup("language").agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("files"),
        F.bround(F.avg("score"), 2).alias("average_score"), F.sum("findings").alias("findings"))


def category_scores(findings: DataFrame) -> DataFrame:
    return (
        findings.groupBy(*KEY, F.col("rule").alias("category"))
        .agg(F.sum("score_impact").alias("penalty"), F.count("*").alias("findings"))
        .withColumn("score", clamp_score(100 - F.col("penalty")))
    )


def folder_rollup(scores: DataFrame) -> DataFrame:
    """Files, findings and mean score of every ancestor folder; the root is the empty name.

    Files are summed per direct folder first, so one folder row, not every file, goes up to its ancestors.
    """
    parts = F.split("path", "/")
    folder = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    direct = scores.groupBy("job_id", folder.alias("own")).agg(
        F.count("*").alias("files"), F.sum("findings").alias("findings"), F.sum("score").alias("total"))
    steps = F.filter(F.split("own", "/"), lambda s: s != "")
    ancestors = F.transform(
        F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    return (
        direct.select("job_id", F.explode(ancestors).alias("folder"), "files", "findings", "total")
        .groupBy("job_id", "folder").agg(
            F.sum("files").alias("files"), F.sum("findings").alias("findings"), F.sum("total").alias("total"))
        .withColumn("average_score", F.bround(F.col("total") / F.col("files"), 2))
        .drop("total")
    )


# Ids, lines and addresses repeat within one file, so they are counted in its row and no text is shuffled.


def duplicate_ids(files: DataFrame) -> DataFrame:
    """Id values used more than once in a page."""
    return files.select(*KEY, F.inline(repeated_counts(extract_all("text", ID, 1), 2, "id")))


def repeated_lines(files: DataFrame, min_count: int = 4, longer_than: int = 12, text="text") -> DataFrame:
    """Trimmed lines of some length that a file repeats."""
    return files.select(*KEY, F.inline(repeated_counts(trimmed_lines(text, longer_than), min_count, "line")))


def repeated_urls(files: DataFrame, min_count: int = 3) -> DataFrame:
    return files.select(*KEY, F.inline(repeated_counts(extract_all("text", URL), min_count, "url")))


def rule_signatures(sheets: DataFrame) -> DataFrame:
    """Rows (rule_no, selector, signature): the sorted declarations of each rule body."""
    rows = css_rules(sheets).where(F.size("d") > 0)
    return rows.select(*KEY, "rule_no", "selector", signature(F.struct("d")).alias("signature"))


def duplicate_rule_bodies(sheets: DataFrame, min_count: int = 2, *by) -> DataFrame:
    """Equal rule bodies, within a file or, with `by` given as no file key, over the whole corpus."""
    keys = list(by) or [*KEY, "signature"]
    return rule_signatures(sheets).groupBy(*keys).agg(F.count("*").alias("uses")).where(F.col("uses") >= min_count)


def repeated_declarations(declarations: DataFrame, min_count: int = 4, value: str = "raw") -> DataFrame:
    return (
        declarations.groupBy(*KEY, "prop", F.col(value).alias("value"))
        .agg(F.count("*").alias("uses")).where(F.col("uses") >= min_count)
    )


def duplicate_selectors(rules: DataFrame) -> DataFrame:
    """Selectors defined more than once under the same blocks, with the number of different bodies."""
    return (
        rules.where("selector != ''").groupBy(*KEY, "context", "selector")
        .agg(F.count("*").alias("uses"), F.count_distinct(F.trim(squeeze("body"))).alias("bodies"))
        .where("uses > 1")
    )


def conflicting_declarations(declarations: DataFrame) -> DataFrame:
    """Properties repeated inside one rule, with the number of different values."""
    return (
        declarations.groupBy(*KEY, "rule_no", "selector", "context", "prop")
        .agg(F.count("*").alias("uses"), F.count_distinct("value").alias("different"))
        .where("uses > 1")
    )


def conflicting_utilities(tokens: DataFrame) -> DataFrame:
    """Tokens of one utility group under one set of variants on one element."""
    variants = F.array_join(F.array_sort(F.filter("variants", lambda v: v != "")), ":")
    return (
        tokens.where("utility_group != 'other'")
        .groupBy(*KEY, "element_no", variants.alias("variants"), "utility_group")
        .agg(F.array_sort(F.collect_set("token")).alias("tokens"))  # tokens of one attribute
        .where(F.size("tokens") > 1)
    )


def class_bundles(lists: DataFrame) -> DataFrame:
    """Equal token sets per file: (bundle, size, uses)."""
    bundle = F.array_sort(F.array_distinct("tokens"))
    return (
        lists.where(F.size("tokens") > 0)
        .groupBy(*KEY, F.array_join(bundle, " ").alias("bundle"), F.size(bundle).alias("size"))
        .agg(F.count("*").alias("uses"))
    )


def repeated_bundles(lists: DataFrame, more_than: int = 4) -> DataFrame:
    return class_bundles(lists).where((F.col("uses") > more_than) & (F.col("size") > more_than))


def token_drift(tokens: DataFrame) -> DataFrame:
    """Distinct arbitrary values per file."""
    return (
        tokens.where(F.col("base").contains("[") & (F.col("surplus") == 0)).groupBy(*KEY)
        .agg(F.count_distinct("base").alias("arbitrary_values"))
    )


def duplicate_files(files: DataFrame) -> DataFrame:
    """Contents that occur more than once: hash, copies and the first path."""
    return (
        files.select(content_hash("text").alias("sha256"), "path").groupBy("sha256")
        .agg(F.count("*").alias("copies"), F.min("path").alias("first_path")).where("copies > 1")
    )


def top_value(declarations: DataFrame) -> DataFrame:
    """Most common declaration of a file, ties by text."""
    pair = F.concat("prop", F.lit(":"), "value")
    uses = declarations.groupBy(*KEY, pair.alias("pair")).agg(F.count("*").alias("uses"))
    best = uses.groupBy(*KEY).agg(F.min(F.struct((-F.col("uses")).alias("o"), F.col("pair"))).alias("b"))
    return best.select(*KEY, F.col("b.pair").alias("pair"), (-F.col("b.o")).alias("uses"))
