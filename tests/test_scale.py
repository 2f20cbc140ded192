"""Work that has to be done once per file and stay in its row."""

import io
import zipfile

from pyspark.sql import functions as F

from corpusgauge.operators import joins as jo
from corpusgauge.operators.detect import filter_results
from corpusgauge.plans.registry import rules_named
from corpusgauge.plans.scan import scored_files
from corpusgauge.sources import corpus


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_unused_imports_stay_in_the_row(make_files):
    files = make_files(
        ("a.py", "python", "import os, re as r\nfrom a import (b,\n  c)\nprint(os, c)\nx = 'r'\n"),
        ("b.py", "python", "important = 1\nreimport = 2\n"), ("c.py", "python", "'a'import z\n"), ("d.py", "python", None),
        ("e.py", "python", "import\\\n  y\n"))
    rows = jo.unused_imports(files)
    assert {(r["path"], r["name"]) for r in rows.collect()} == {("a.py", "r"), ("a.py", "b"), ("c.py", "z"), ("e.py", "y")}
    text = optimized(rows)
    assert "Join" not in text and "Aggregate" not in text


def test_members_leave_in_blocks(spark):
    def packed(k):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(f"{k}.txt", b"x" * 3_000_000 if k == 7 else str(k))
            z.writestr(f"../{k}.txt", "outside")
        return out.getvalue()

    import pandas as pd
    batch = pd.DataFrame({"path": [f"{k}.zip" for k in range(600)] + ["bad.zip"], "content": [packed(k) for k in range(600)] + [b"no"]})
    blocks = list(corpus._members([batch[:300], batch[300:]]))
    assert len(blocks) == 2 and sum(map(len, blocks)) == 1201
    assert [len(b) for b in corpus._members([batch[7:8]] * 5)] == [5, 5]
    whole = pd.concat(blocks)
    assert whole["error"].notna().sum() == 1 and whole["path"].nunique() == 1200


def test_a_test_of_scores_runs_the_rules_once(make_files):
    files = make_files(("a.html", "html", "<p>no title</p>"), ("b.html", "html", "<title>t</title>"))
    scores = scored_files(files, rules_named("html"))
    every = {r["path"]: r["score"] for r in scores.collect()}
    for df in (filter_results(scores, "html", 0, 100), scores.where("score is not null"), scores.where(F.col("penalty") >= 0)):
        assert {r["path"]: r["score"] for r in df.collect()} == every
        text = optimized(df.select("path", "score"))
        assert text.count("html.structure.title") == 1
        assert text.count("AS css_text") == 1


def test_searches_find_what_the_patterns_find(spark):
    from corpusgauge.functions import code as fc, events as ev
    from corpusgauge.functions.text import extract_all, replace_regex

    texts = ["<p CLASS='a' xclass='b' :class=\"c\" [x.class]='d' vclass='e' V-BIND:class={f} ngClass=`g`\nclassName = 'h'>", "", None,
             "a 'b' \"c\" # d\n'''e\n#f''' `g` // h\n/* i */ / j 'k\\'l' m'n"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        F.transform(ev.class_list_array("text"), lambda l: l["value"]).alias("got"), extract_all("text", ev.CLASS_ATTRIBUTE, 1).alias("quoted"),
        fc.blank_code("text").alias("code"), replace_regex("text", fc.BLANKED, " ").alias("code_by"),
        fc.blank_python("text").alias("python"), replace_regex("text", fc.PY_BLANKED, " ").alias("python_by")).collect()
    for r in rows:
        assert r["got"] == (None if r["quoted"] is None else [q[1:-1] for q in r["quoted"]])
        assert r["code"] == r["code_by"] and r["python"] == r["python_by"]
    assert len(rows[0]["got"]) >= 5
    searched = ev.class_list_array("text")._jc.toString()
    assert searched.count("ngClass") == searched.count("[cnv:")
