"""Findings of checks that need more than a condition on the text.

A built-in check looks at one file, so it is an array of findings computed inside the file's row from the
derived features: a scan shuffles nothing and a file, however large a share of the findings it has, is one row.
Checks across files, and checks users add, are functions of a table instead (`flag`).
"""

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.events import repeated_counts
from ..functions.text import col, let, line_at, render_message, sql_text
from ..model import FINDING, FINDING_COLUMNS, METRICS


@dataclass(frozen=True)
class Spec:
    rule_id: str
    category: str
    severity: str
    impact: int
    message: str
    confidence: float | None = None
    fix: str | None = None


@dataclass(frozen=True)
class RowCheck:
    languages: tuple
    needs: tuple
    build: Callable[[], Column]


def constant_finding(rule_id, category, severity, impact, message, confidence, fix) -> Column:
    """A finding of constants, as one SQL literal: a pack holds hundreds of them."""
    fields = {
        "rule_id": sql_text(rule_id), "rule": sql_text(category), "severity": sql_text(severity),
        "score_impact": f"int({impact})", "message": sql_text(message), "line": "int(null)",
        "snippet": "string(null)", "confidence": f"double({sql_text(confidence)})", "fix": f"string({sql_text(fix)})",
    }
    return F.expr("named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")")


def finding_struct(spec: Spec, /, severity=None, impact=None, **values) -> Column:
    out = constant_finding(
        spec.rule_id, spec.category, spec.severity, spec.impact, spec.message, spec.confidence, spec.fix)
    if values:
        out = out.withField("message", render_message(spec.message, **values))
        if spec.fix and "{" in spec.fix:
            out = out.withField("fix", render_message(spec.fix, **values))
    if severity is not None:
        out = out.withField("severity", severity)
    if impact is not None:
        out = out.withField("score_impact", impact.cast("int"))
    return out


def _hits(tests) -> Column:
    """A test is (spec, condition) or (spec, condition, {name: column})."""
    return F.array_compact(F.array(*[
        F.when(t[1], finding_struct(t[0], **(t[2] if len(t) > 2 else {}))) for t in tests]))


def none_found() -> Column:
    return F.array().cast(T.ArrayType(FINDING))


def on_line(findings, line) -> Column:
    return F.transform(findings, lambda f: f.withField("line", line.cast("int")))


def once(*tests, line=None) -> Column:
    """Findings of a whole file."""
    return _hits(tests) if line is None else on_line(_hits(tests), F.lit(line))


def each(items, tests, located: bool = False) -> Column:
    """Findings of the tests that `tests` gives for every element of an array; those of located elements have their line."""
    hits = lambda x: on_line(_hits(tests(x)), x["line"]) if located else _hits(tests(x))
    return F.coalesce(F.flatten(F.transform(col(items), hits)), none_found())


def with_snippets(findings, lines="text_lines") -> Column:
    """Findings with the text of their lines."""
    return F.transform(findings, lambda f: f.withField("snippet", line_at(col(lines), f["line"])))


def counted_metrics(metrics, findings) -> Column:
    """A file's metrics with the number of its findings and those of each severity and category."""
    def counts(field):
        each = repeated_counts(F.transform(findings, lambda f: f[field]), 1, "name")
        return F.map_from_entries(F.transform(each, lambda c: F.struct(c["name"], c["uses"])))

    metrics = col(metrics)
    return F.struct(
        *[metrics[n].alias(n) for n in METRICS.fieldNames()], F.size(findings).cast("long").alias("finding_count"),
        counts("severity").alias("severity_counts"), counts("rule").alias("category_counts"))


TOLD = ("severity", "message", "line", "snippet", "confidence", "fix")


def told_once(findings) -> Column:
    """One of the findings that are told in the same words of the same place: the one with the first rule id."""
    ranked = F.transform(findings, lambda f: F.struct(
        F.struct(*[f[n].alias(n) for n in TOLD]).alias("told"), f["rule_id"].alias("rule_id"), f.alias("f")))

    def firsts(v):
        first = lambda x, i: (i == 0) | ~x["told"].eqNullSafe(F.get(v, i - 1)["told"])
        return F.transform(F.filter(v, first), lambda x: x["f"])

    return let(F.array_sort(ranked), firsts)


def flag(rows: DataFrame, *tests) -> DataFrame:
    """Findings of several tests over the same rows in one pass; rows carry job_id, path and language."""
    return rows.select("job_id", "path", "language", F.inline(_hits(tests))).select(*FINDING_COLUMNS)
