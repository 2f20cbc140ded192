"""All registered queries: name to (function of spark and folder, function that gives the SQL or None)."""

from corpusgauge.operators.aggregates import language_summary
from corpusgauge.plans.registry import rules_named
from corpusgauge.plans.scan import scored_files
from . import queries_core, queries_packs, queries_tables
from .corpora import page_files

ALL = {**queries_core.QUERIES, **queries_tables.QUERIES, **queries_packs.QUERIES}


def flagship(spark, sf_dir):
    return language_summary(scored_files(page_files(spark, sf_dir), rules_named("html.structure")))
