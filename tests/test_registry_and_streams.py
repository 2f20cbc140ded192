"""Extensions, profiles, rule tables and streams."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from corpusgauge.plans.checks import Spec, flag
from corpusgauge.plans.registry import (
    CHECKS, PACKS, load_profile, register_check, register_pack, rules_named, save_profile, scan,
)
from corpusgauge.plans.rules import Clause, Rule, clause_column, has, rules_from_table, rules_table
from corpusgauge.plans.scan import rule_scan, scan_joined
from corpusgauge.streaming import streams
from workload.corpora import code_files, page_files


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def test_rules_survive_the_table(spark):
    rules = rules_named()
    assert rules_from_table(rules_table(spark, rules)) == sorted(rules, key=lambda r: r.rule_id)


def test_unknown_test_is_refused():
    with pytest.raises(ValueError):
        clause_column(Clause("guess"))


def test_joined_scan_equals_compiled_scan(spark, sf):
    files, rules = page_files(spark, sf), rules_named("html")
    want = rows(rule_scan(files, rules), "path", "rule_id")
    for chunk in (500, 7):
        assert rows(scan_joined(files, rules_table(spark, rules), chunk), "path", "rule_id") == want


def test_update_mode_keeps_other_groups(spark, tmp_path):
    schema = "language string, score int"
    into, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    stream = lambda: spark.readStream.schema(schema).parquet(into).groupBy("language").agg(F.sum("score").alias("total"))
    for batch in ([("html", 1), ("python", 2)], [("python", 5)]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(into)
        streams.drain(stream(), out, state, "update", ("language",))
    assert rows(streams.latest(spark, out), "language", "total") == [("html", 1), ("python", 7)]
    with pytest.raises(ValueError):
        streams.drain(stream(), out, state, "update")


def test_needles_only_save_time(spark, sf):
    files, rules = code_files(spark, sf), rules_named()
    bare = [replace(r, all_of=tuple(replace(c, needles=()) for c in r.all_of),
                    any_of=tuple(replace(c, needles=()) for c in r.any_of)) for r in rules]
    assert rows(rule_scan(files, rules), "path", "rule_id") == rows(rule_scan(files, bare), "path", "rule_id")


def test_own_pack_and_check(spark, make_files):
    files = make_files(("a.sql", "sql", "SELECT *"), ("b.sql", "sql", "SELECT 1"))
    register_pack("sql.style", [Rule("sql.star", "sql", "style", "low", 2, "No star.", (has(r"\*"),))])
    spec = Spec("sql.short", "style", "info", 1, "Only {n} characters.")
    register_check("sql.size", "sql", lambda f: flag(f, (spec, F.length("text") < 9, {"n": F.length("text")})))
    try:
        got = rows(scan(files, "sql"), "path", "rule_id", "message")
    finally:
        PACKS.pop("sql.style")
        CHECKS.pop("sql.size")
    assert got == [("a.sql", "sql.short", "Only 8 characters."), ("a.sql", "sql.star", "No star."),
                   ("b.sql", "sql.short", "Only 8 characters.")]


def test_profile_overrides(spark, tmp_path):
    overrides = spark.createDataFrame(
        [("html.structure.viewport", 1, "info", None), ("html.structure.title", None, None, False)],
        "rule_id string, impact int, severity string, enabled boolean")
    save_profile(spark, str(tmp_path / "p"), rules_named("html.structure"), overrides)
    by_id = {r.rule_id: r for r in load_profile(spark, str(tmp_path / "p"))}
    assert (by_id["html.structure.viewport"].impact, by_id["html.structure.viewport"].severity) == (1, "info")
    assert not by_id["html.structure.title"].enabled and by_id["html.structure.charset"].enabled


def arriving(spark, files, folder, batches=3):
    """Files written as several parquet files and read as a stream, one file a batch."""
    files.repartition(batches).write.parquet(folder)
    return spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_equals_batch(spark, sf, tmp_path):
    files, rules = page_files(spark, sf), rules_named("html")
    stream = streams.scan_stream(arriving(spark, files, str(tmp_path / "in")), rules)
    streams.drain(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got, "path", "rule_id", "message") == rows(rule_scan(files, rules), "path", "rule_id", "message")
    # A second run over the same checkpoint finds nothing new.
    again = streams.scan_stream(
        spark.readStream.schema(files.schema).parquet(str(tmp_path / "in")), rules)
    streams.drain(again, str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == got.count()


def test_running_summary(spark, sf, tmp_path):
    files, rules = page_files(spark, sf), rules_named("html.structure")
    stream = streams.summary_stream(arriving(spark, files, str(tmp_path / "in")), rules)
    streams.drain(stream, str(tmp_path / "out"), str(tmp_path / "check"), "complete")
    assert rows(spark.read.parquet(str(tmp_path / "out")), "language", "files") == [("html", 50)]


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "severity string, created_at timestamp"
    # The late row comes two batches after the watermark has passed it.
    batches = [[("low", "2024-01-01 00:10:00")], [("low", "2024-01-01 09:00:00")], [("low", "2024-01-01 09:10:00")],
               [("low", "2024-01-01 00:20:00"), ("high", "2024-01-01 08:30:00")], [("low", "2024-01-01 20:00:00")]]
    folder = str(tmp_path / "in")
    for i, batch in enumerate(batches):
        df = spark.createDataFrame(batch, "severity string, t string").select("severity", F.to_timestamp("t").alias("created_at"))
        df.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = streams.findings_per_window(stream)
    streams.drain(out, str(tmp_path / "out"), str(tmp_path / "check"))
    got = rows(spark.read.parquet(str(tmp_path / "out")).select(
        F.hour("window_start").alias("h"), "severity", "findings"), "h", "severity", "findings")
    assert got == [(0, "low", 1), (8, "high", 1), (9, "low", 2)]
