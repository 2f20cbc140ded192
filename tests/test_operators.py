"""Table operators against plain Python, on pages and on small made cases."""

import re
from collections import Counter

from pyspark.sql import functions as F

from corpusgauge.functions.events import NOT_IN_PARAGRAPH, VOID_TAGS
from corpusgauge.operators import aggregates as ag, joins as jo, sets as st, unnest as u, windows as wi
from workload.corpora import page_files

MARKUP = re.compile(r"<!--.*?-->|<[^>]+>", re.S)
TAG = re.compile(r"<\s*(/?)\s*([a-zA-Z](?:[\w:-]*\w)?)", re.S)


def python_stack(text):
    stack, errors = [], []
    for raw in MARKUP.findall(text):
        m = TAG.match(raw)
        if not m:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if tag not in stack:
                errors.append(("unexpected_close", tag))
                continue
            if stack[-1] != tag:
                errors.append(("out_of_order", tag))
            while stack.pop() != tag:
                pass
            continue
        if stack and stack[-1] == "p" and tag in NOT_IN_PARAGRAPH:
            errors.append(("invalid_child", tag))
        if tag not in VOID_TAGS and not raw.endswith("/>"):
            stack.append(tag)
    return errors, stack


def test_tag_stack_like_python(spark, sf):
    files = page_files(spark, sf)
    texts = {r["path"]: r["text"] for r in files.collect()}
    rows = wi.tag_stack(files).collect()
    assert len(rows) == len(texts) == 50
    for r in rows:
        errors, stack = python_stack(texts[r["path"]])
        assert [(e["kind"], e["tag"]) for e in r["errors"]] == errors
        assert list(r["unclosed"]) == stack


def test_depth_ignores_surplus_closes(make_files):
    files = make_files(("a", "html", "</div></div><div><div></div></div></div><div>"), ("b", "html", "<div>" * 7))
    got = {r["path"]: r["depth"] for r in wi.max_tag_depth(u.tag_events(files)).collect()}
    assert got == {"a": 2, "b": 7}


def test_balance(make_files):
    files = make_files(("a", "html", "</b><b><b></b><br><i/>"),)
    got = {r["tag"]: (r["unexpected"], r["unclosed"]) for r in wi.tag_balance(u.tag_events(files)).collect()}
    assert got == {"b": (1, 1)}


CODE = """def a():
    for x in y:
        if x:
            z()

        w()
    return 1
while True:
    pass"""


def brute_end(lines, i):
    indent = lambda l: len(l) - len(l.lstrip())
    for j in range(i + 1, len(lines)):
        if lines[j].strip() and indent(lines[j]) <= indent(lines[i]):
            return j + 1
    return None


def test_indent_spans_like_brute_force(make_files):
    rows = wi.indent_spans(make_files(("a", "python", CODE),), r":\s*$", python=False).collect()
    lines = CODE.split("\n")
    assert {r["line_no"]: r["end_no"] for r in rows} == {
        i + 1: brute_end(lines, i) for i, l in enumerate(lines) if l.endswith(":")}


def test_inside_span_counts_blocks(make_files):
    rows = jo.py_blocks(make_files(("a", "python", CODE),)).collect()
    assert {r["line_no"]: r["loops"] for r in rows} == {1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 1, 7: 0, 8: 0, 9: 1}


def test_repetition_like_counter(spark, sf):
    files = page_files(spark, sf)
    texts = {r["path"]: r["text"] for r in files.collect()}
    want = {}
    for path, text in texts.items():
        for line, n in Counter(l.strip(" ") for l in text.split("\n")).items():
            if n >= 4 and len(line) > 12:
                want[path, line] = n
    got = {(r["path"], r["line"]): r["uses"] for r in ag.repeated_lines(files).collect()}
    assert got == want


def test_folders(spark):
    scores = spark.createDataFrame(
        [("j", "a/b/x", "l", 80, 1), ("j", "a/y", "l", 60, 2), ("j", "z", "l", 40, 0)],
        "job_id string, path string, language string, score int, findings long")
    got = {r["folder"]: (r["files"], r["findings"], r["average_score"]) for r in ag.folder_rollup(scores).collect()}
    assert got == {"": (3, 3, 60.0), "a": (2, 3, 70.0), "a/b": (1, 1, 80.0)}


def test_compare_runs(spark):
    schema = "path string, rule_id string, message string"
    a = spark.createDataFrame([("f", "r1", "m"), ("f", "r2", "m"), ("f", "r3", "m"), ("f", "r3", "m")], schema)
    b = spark.createDataFrame([("f", "r1", "m"), ("f", "r3", "m"), ("g", "r2", "m")], schema)
    got = {(r["path"], r["rule_id"]): r["state"] for r in jo.compare_runs(a, b).collect()}
    assert got == {("f", "r1"): "unchanged", ("f", "r2"): "fixed", ("f", "r3"): "changed", ("g", "r2"): "added"}


def test_dedupe_and_first(spark):
    row = lambda rule, sev, msg, line: ("j", "f", "css", rule, "c", sev, 1, msg, line, "s", None, None)
    schema = ("job_id string, path string, language string, rule_id string, rule string, severity string, "
              "score_impact int, message string, line int, snippet string, confidence double, fix string")
    df = spark.createDataFrame(
        [row("b", "low", "m", 2), row("a", "low", "m", 5), row("a", "high", "m", 1), row("a", "low", "n", 9)], schema)
    again = df.unionByName(spark.createDataFrame([row("c", "low", "m", 5), row("b", "low", "m", None), row("a", "low", "m", None)], schema))
    assert sorted((r["rule_id"], r["severity"], r["message"], r["line"] or 0) for r in st.dedupe_findings(again).collect()) == [
        ("a", "high", "m", 1), ("a", "low", "m", 0), ("a", "low", "m", 5), ("a", "low", "n", 9), ("b", "low", "m", 2)]
    assert sorted((r["rule_id"], r["line"]) for r in wi.first_per_rule(df).collect()) == [("a", 1), ("b", 2)]


def test_hot_language_top_k_and_summary(spark):
    """One language holds most rows: results stay whole."""
    df = spark.range(20_000).select(
        F.lit("j").alias("job_id"), F.concat(F.lit("p"), F.lpad("id", 6, "0")).alias("path"),
        F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("language"),
        (F.col("id") * 7919 % 101).cast("int").alias("score"), F.lit(1).cast("long").alias("findings"))
    rows = df.collect()
    for language in ("hot", "cold"):
        own = sorted((r["score"], r["path"]) for r in rows if r["language"] == language)[:5]
        got = wi.worst_files(df, 5).where(F.col("language") == language).orderBy("rank").collect()
        assert [(r["score"], r["path"]) for r in got] == own
    summary = {r["language"]: (r["files"], r["total"]) for r in ag.language_summary(df).collect()}
    assert summary["hot"] == (18_000, sum(r["score"] for r in rows if r["language"] == "hot"))
