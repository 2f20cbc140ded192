"""Named packs and checks; users add their own at run time."""

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.sets import all_findings
from . import checks_code, checks_css, checks_html
from .checks import RowCheck
from .packs import PACKS as BUILT_IN
from .rules import Rule, rules_from_table, rules_table
from .scan import rule_scan, scored_files

PACKS: dict[str, list[Rule]] = dict(BUILT_IN)
CHECKS: dict = {**checks_html.CHECKS, **checks_code.CHECKS, **checks_css.CHECKS}


def register_pack(name: str, rules) -> None:
    """Add a pack: a list of rules, or a table of them."""
    PACKS[name] = rules_from_table(rules) if isinstance(rules, DataFrame) else list(rules)


def register_check(name: str, languages, check: Callable[[DataFrame], DataFrame]) -> None:
    """Add a check: a function of files that returns findings."""
    CHECKS[name] = ([languages] if isinstance(languages, str) else list(languages), check)


def use_compat(on: bool = True) -> None:
    """Checks that look at a window of text, as wide as in the tool whose rules these are, instead of at whole blocks."""
    CHECKS.update(checks_code.COMPAT_CHECKS if on else {n: checks_code.CHECKS[n] for n in checks_code.COMPAT_CHECKS})


def _named(entries, names):
    return {n: e for n, e in entries.items() if not names or any(n == p or n.startswith(p + ".") for p in names)}


def rules_named(*names) -> list[Rule]:
    return [r for pack in _named(PACKS, names).values() for r in pack]


def checks_named(*names) -> list[RowCheck]:
    """Built-in checks, evaluated inside the file's row."""
    return [c for c in _named(CHECKS, names).values() if isinstance(c, RowCheck)]


def table_checks(files: DataFrame, *names) -> list[DataFrame]:
    """Findings of the checks that users registered as functions of a table."""
    out = []
    for check in _named(CHECKS, names).values():
        if not isinstance(check, RowCheck):
            languages, fn = check
            out.append(fn(files.where(F.col("language").isin(*languages))))
    return out


def scan(files: DataFrame, *names) -> DataFrame:
    """Findings of the named packs and checks, of all when none is named.

    Packs and built-in checks read every text once, in one projection.
    """
    rules, checks = rules_named(*names), checks_named(*names)
    parts = [rule_scan(files, rules, checks=checks)] if rules or checks else []
    return all_findings(*parts, *table_checks(files, *names))


def scan_scores(files: DataFrame, *names) -> DataFrame:
    """Scores by the named packs and built-in checks, without a shuffle."""
    return scored_files(files, rules_named(*names), checks_named(*names))


# Profiles -----------------------------------------------------------------------------------------------------

def save_profile(spark: SparkSession, path: str, rules, overrides: DataFrame | None = None) -> None:
    """Write rules as a table.

    Overrides (rule_id, impact, severity, enabled) replace what they hold that is not null.
    """
    table = rules_table(spark, rules)
    if overrides is not None:
        o = overrides.select("rule_id", *[F.col(c).alias("o_" + c) for c in ("impact", "severity", "enabled")])
        table = table.join(o, "rule_id", "left")
        for c in ("impact", "severity", "enabled"):
            table = table.withColumn(c, F.coalesce("o_" + c, c))
        table = table.drop("o_impact", "o_severity", "o_enabled")
    table.write.mode("overwrite").parquet(path)


def load_profile(spark: SparkSession, path: str) -> list[Rule]:
    return rules_from_table(spark.read.parquet(path))
