"""What the physical plans must and must not hold."""

from pyspark.sql import functions as F

from corpusgauge.functions import text as ft
from corpusgauge.operators import aggregates as ag, windows as wi
from corpusgauge.plans.registry import rules_named, scan, scan_scores
from corpusgauge.plans.rules import rare_end
from corpusgauge.plans.scan import rule_scan
from workload.corpora import document_files, page_files, table
import __spark_entry__ as entry

SCANNING = ("pck_", "joi_", "agg_", "win_", "unn_", "sca_", "prj_", "srt_", "set_")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_is_one_pass_without_shuffle_or_python(spark, sf):
    files = spark.read.parquet(f"{sf}/pages.parquet").select(
        F.lit("j").alias("job_id"), F.col("url").alias("path"), F.lit("html").alias("language"),
        F.col("html").alias("text"))
    for df in (scan(files, "html"), rule_scan(files, rules_named("html")), scan_scores(files, "html")):
        text = plan(df)
        assert "Exchange" not in text and "EvalPython" not in text and "MapInPandas" not in text
        assert text.count("FileScan parquet") == 1
        assert "page_id" not in text.split("ReadSchema:")[1].split("\n")[0]


def test_no_query_has_a_cross_join_or_python_rows(spark, sf):
    for key, fn in entry.queries().items():
        if not key.startswith(SCANNING):
            continue
        text = plan(fn(spark, sf))
        assert "CartesianProduct" not in text, key
        assert "BroadcastNestedLoopJoin" not in text, key
        assert "EvalPython" not in text and "InPandas" not in text, key


def test_top_k_is_cut_before_the_shuffle(spark, sf):
    scores = scan_scores(document_files(spark, sf, "python"), "python.style")
    text = plan(wi.worst_files(scores, 3))
    partial = text.rindex("WindowGroupLimit")
    assert text.rindex("Exchange hashpartitioning") < partial < text.rindex("FileScan")


def test_text_does_not_reach_the_score_join(spark, sf):
    files = page_files(spark, sf)
    text = plan(ag.file_scores(files, rule_scan(files, rules_named("html.structure"))))
    for line in text.split("\n"):
        if "Exchange hashpartitioning" in line:
            assert "text" not in line and "html#" not in line.split("hashpartitioning")[0]


def test_metadata_queries_do_not_read_text(spark, sf):
    text = plan(page_files(spark, sf).select("path"))
    assert "html:string" not in text


def test_language_filter_prunes_partitions(spark, sf, tmp_path):
    from corpusgauge.operators.detect import filter_results
    from corpusgauge.sources.results import write_scores

    scores = scan_scores(page_files(spark, sf), "html.structure").unionByName(
        scan_scores(document_files(spark, sf, "python"), "python.style"))
    write_scores(scores, str(tmp_path / "scores"))
    read = filter_results(spark.read.parquet(str(tmp_path / "scores")), "html", 0, 50)
    text = plan(read)
    assert "PartitionFilters: [isnotnull(language" in text and "PushedFilters: [IsNotNull(score)" in text
    assert {r["language"] for r in read.select("language").distinct().collect()} <= {"html"}


def test_writing_again_replaces_only_its_partitions(spark, sf, tmp_path):
    from corpusgauge.sources.results import write_scores

    path = str(tmp_path / "scores")
    pages = scan_scores(page_files(spark, sf), "html.structure")
    docs = scan_scores(document_files(spark, sf, "python"), "python.style")
    write_scores(pages, path)
    write_scores(docs, path)
    write_scores(docs, path)
    counts = {r["language"]: r["n"] for r in spark.read.parquet(path).groupBy("language").agg(F.count("*").alias("n")).collect()}
    assert counts == {"html": 50, "python": 200}


def test_documents_table_is_read_once_per_use(spark, sf):
    assert plan(table(spark, sf, "documents").select("doc_id")).count("FileScan") == 1


def test_what_rules_share_is_looked_for_once(spark, make_files):
    spark.conf.set("spark.sql.debug.maxToStringFields", 100_000)
    found = rule_scan(make_files(("a", "html", "x")), rules_named("html", "python.security"))
    text = found._jdf.queryExecution().optimizedPlan().toString()
    for block in ("<script", "<div", "innerhtml", "secret"):
        assert text.count(f", {block})") == 1, block


def test_quick_searches_find_the_same(spark):
    texts = ["", "x" * 88, "x" * 89, "a\n" + "y" * 89, "z" * 60 + "\r" + "z" * 60, "\x85" + "q" * 89 + "\n", "ü" * 88 + "\u2028ab"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select(
        "text", ft.has_longer_line("text", 88).alias("long"), ft.lines_over("text", 88).alias("n")).collect()
    assert [(r["long"], r["n"]) for r in rows] == [
        (any(n > 88 for n in map(len, r["text"].splitlines())), sum(n > 88 for n in map(len, r["text"].splitlines()))) for r in rows]
    assert ft.longer_line_width(ft.longer_line(88)) == 88 and ft.longer_line_width(r"x{3}") is None
    assert ft.led(r"(?i)\b(?:key|token)\s*=") == r"(?i)(?=[kt])\b(?:key|token)\s*="
    for same in (r"\b(?:a|b)?c", r"\ba*b", r"\b(?:a?b|c)", r"\b(x(y)|z)", r"\b\w+", r"a\b"):
        assert ft.led(same) == same
    assert [rare_end(n) for n in ("secret", "print(", "def", "<img", ".execute(")] == ["cret", "print(", "def", "<img", "xecute("]
