"""Runs compared by place, keyed tables on disk, summaries of files that arrive again."""

import random

import pytest
from pyspark.sql import functions as F

from corpusgauge.functions.versions import line_hashes, moved_lines
from corpusgauge.operators import joins as jo
from corpusgauge.plans.registry import rules_named, scan
from corpusgauge.plans.scan import scored_files
from corpusgauge.sources import results
from corpusgauge.streaming import streams


def moves(old, new):
    """The definition, line by line."""
    anchors = {i: new.index(l) - i for i, l in enumerate(old) if old.count(l) == 1 and new.count(l) == 1}
    out = []
    for i, line in enumerate(old):
        above = [anchors[j] for j in range(i, -1, -1) if j in anchors][:1]
        below = [anchors[j] for j in range(i, len(old)) if j in anchors][:1]
        fits = [i + s for s in above + below if 0 <= i + s < len(new) and new[i + s] == line]
        out.append(fits[0] + 1 if fits else None)
    return out


def test_lines_are_aligned(spark):
    rng = random.Random(4)
    pairs = [([""], [""]), (["a"], ["b"]), (["a", "a"], ["a"]), (["a", "x"], ["x", "a"])]
    for _ in range(60):
        old = [rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 30))]
        new = [l for l in old if rng.random() < 0.8]
        for _ in range(rng.randrange(4)):
            new.insert(rng.randrange(len(new) + 1), rng.choice("abxyz"))
        pairs.append((old, new or [""]))
    rows = spark.createDataFrame([(i, "\n".join(a), "\n".join(b)) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = rows.select("i", moved_lines(line_hashes("a"), line_hashes("b")).alias("m")).collect()
    assert {r["i"]: r["m"] for r in got} == {i: moves(a, b) for i, (a, b) in enumerate(pairs)}


def test_moved_findings_are_unchanged(spark, make_files):
    sheet = "".join(f".a{i}:has(.b) {{ margin: 0; }}\n" for i in range(4))
    before = make_files(("a.css", "css", sheet), ("b.css", "css", ".x { colr: red }"), ("gone.css", "css", ".x { colr: red }"))
    after = make_files(
        ("a.css", "css", "\n" * 10 + sheet), ("b.css", "css", ".x { color: red }\n.y { widht: 0; paddin: 0 }"))
    got = jo.compare_places(scan(before, "css"), scan(after, "css"), jo.line_moves(before, after)).collect()
    assert [(r["line_before"], r["line_after"], r["state"]) for r in sorted(got, key=lambda r: r["line_before"] or 0) if r["path"] == "a.css"] == [
        (i + 1, i + 11, "unchanged") for i in range(4)]
    assert sorted((r["path"], r["rule_id"], r["state"]) for r in got if r["path"] != "a.css") == [
        ("b.css", "css.style.misspelt_property", "added"), ("b.css", "css.style.misspelt_property", "fixed"),
        ("b.css", "css.style.unknown_property", "added"), ("gone.css", "css.style.misspelt_property", "fixed")]


RUNS = "job_id string, original_name string, created_at timestamp"


def run_rows(spark, *rows):
    return spark.createDataFrame(rows, "job_id string, original_name string, t long").select(
        "job_id", "original_name", F.timestamp_seconds("t").alias("created_at"))


def registry(spark, path):
    return {r["job_id"]: r["original_name"] for r in results.current(spark, path).collect()}


def test_upsert_touches_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "runs")
    results.upsert_runs(run_rows(spark), path)
    assert results.current(spark, path) is None
    results.upsert_runs(run_rows(spark, *[(f"j{i}", "old", i) for i in range(300)], (None, "none", 1)), path)
    files = {str(f) for f in (tmp_path / "runs").rglob("*.parquet")}
    results.upsert_runs(run_rows(spark, ("j7", "new", 10), ("j7", "older", 2), ("j8", "late", 1), ("k", "first", 1), (None, "null", 2)), path)
    rows = registry(spark, path)
    assert len(rows) == 302 and (rows["j7"], rows["j8"], rows["k"], rows[None]) == ("new", "old", "first", "null")
    left = files & {str(f) for f in (tmp_path / "runs").rglob("*.parquet")}
    assert len(files) - len(left) <= 4 and len(left) > 50


def test_failed_upsert_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "runs")
    results.upsert_runs(run_rows(spark, *[(f"j{i}", "old", i) for i in range(50)]), path)
    bad = run_rows(spark, *[(f"j{i}", "new", 99) for i in range(50)]).withColumn(
        "original_name", F.when(F.col("job_id") == "j49", F.raise_error(F.lit("lost"))).otherwise(F.col("original_name")))
    with pytest.raises(Exception, match="lost"):
        results.upsert_runs(bad, path)
    assert set(registry(spark, path).values()) == {"old"} and len(registry(spark, path)) == 50


def test_files_that_arrive_again_count_once(spark, tmp_path, make_files):
    """Two batches, with a file twice in one and again in the next, give the summary of the newest versions."""
    schema = "job_id string, path string, language string, text string, created_at timestamp"
    rule = rules_named("html")

    def batch(n, *rows):
        at = [(j, p, l, t) for j, p, l, t, _ in rows]
        df = spark.createDataFrame([(*r, s) for r, (*_, s) in zip(at, rows)], "job_id string, path string, language string, text string, s long")
        df.withColumn("created_at", F.timestamp_seconds("s")).drop("s").write.parquet(str(tmp_path / "in" / f"b{n}"))

    def drain():
        files = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        changes = streams.score_changes(scored_files(files, rule, keep=("created_at",)))
        streams.drain(changes, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        return {r["language"]: (r["files"], r["total"]) for r in streams.summary_of(spark.read.parquet(str(tmp_path / "out"))).collect()}

    def expected(*rows):
        scores = scored_files(spark.createDataFrame([r[:4] for r in rows], "job_id string, path string, language string, text string"), rule)
        return {r["language"]: (r["n"], r["t"]) for r in scores.groupBy("language").agg(F.count("*").alias("n"), F.sum("score").alias("t")).collect()}

    first = [("j", "a", "html", "<p>x</p>", 1), ("j", "a", "html", "<html lang='en'></html>", 2), ("j", "b", "html", "<b>", 1)]
    batch(1, *first)
    assert drain() == expected(*first[1:])
    second = [("j", "a", "text", "plain", 3), ("j", "b", "html", "<i onclick='x'>", 0), ("k", "a", "html", "", 5)]
    batch(2, *second)
    assert drain() == expected(second[0], first[2], second[2])
    assert drain() == expected(second[0], first[2], second[2])
