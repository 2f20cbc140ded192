"""Orders and set operations over findings and results."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..model import FINDING_COLUMNS


def all_findings(*packs: DataFrame) -> DataFrame:
    """Bag union."""
    return reduce(lambda a, b: a.unionByName(b), [p.select(*FINDING_COLUMNS) for p in packs])


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """One of the findings of a file that are told in the same words of the same place: the one with the first rule id.

    Told are severity, message, line, snippet, confidence and fix; equal messages on other lines stay.
    """
    told = ["severity", "message", "line", "snippet", "confidence", "fix"]
    kept = F.min(F.struct("rule_id", "rule", "score_impact"))
    return (
        findings.groupBy("job_id", "path", "language", *told).agg(kept.alias("k"))
        .select("job_id", "path", "language", *told, "k.*").select(*FINDING_COLUMNS)
    )


def set_minus(a: DataFrame, b: DataFrame, on) -> DataFrame:
    """Distinct keys of a that are not in b."""
    return a.select(*on).distinct().join(b.select(*on), on, "left_anti")


def order_results(results: DataFrame) -> DataFrame:
    return results.orderBy("path")


def order_summary(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.lower("language"))
