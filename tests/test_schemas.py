"""Tables that operators hand on have the declared columns and types."""

from pyspark.sql import functions as F

from corpusgauge.model import FILES, FINDING, FINDING_COLUMNS, RUNS
from corpusgauge.plans.registry import rules_named, scan
from corpusgauge.plans.scan import detailed_files, scored_files
from corpusgauge.sources import results
from workload.corpora import page_files


def shape(schema):
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def test_findings(spark, sf):
    df = scan(page_files(spark, sf))
    assert df.columns == FINDING_COLUMNS
    assert shape(df.schema)[3:] == shape(FINDING)


def test_files_and_runs(spark, sf):
    records = results.file_records(page_files(spark, sf), F.lit("2024-01-01"))
    assert shape(records.schema) == shape(FILES)
    runs = spark.sql("select 'a' as job_id, 'x' as original_name, timestamp '2024-01-01' as created_at")
    assert shape(results.register_run(runs, runs).schema) == shape(RUNS)


def test_joined_and_one_pass_documents_are_equal(spark, sf):
    files, rules = page_files(spark, sf), rules_named("html.structure", "html.security")
    from corpusgauge.plans.scan import rule_scan

    joined = results.to_details_json(scored_files(files, rules), rule_scan(files, rules), results.file_metrics(files))
    one_pass = detailed_files(files, rules)
    assert joined.exceptAll(one_pass).count() == 0 and one_pass.exceptAll(joined).count() == 0
