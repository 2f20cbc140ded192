"""Scalar functions and sources against plain Python on small inputs."""

import io
import os
import tempfile
import zipfile

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusgauge.functions import code as fc, css, events as ev, text as ft, utility
from corpusgauge.operators.detect import detect_language
from corpusgauge.sources import corpus as src, results


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


TEXTS = ["", "\n", "a", "a\n", "a\n\nb", "todo TODO ToDo", "x\n  \n\ty\n", "é\nüü", " \n", "line one\nline two\nthree"]


def test_text_metrics_like_python(spark):
    for text, m in zip(TEXTS, column(spark, TEXTS, ft.text_metrics)):
        lines = text.split("\n")[:-1] if text.endswith("\n") else text.split("\n") if text else []
        mean = round(sum(map(len, lines)) / len(lines), 2) if lines else 0
        assert (m["lines"], m["non_empty_lines"], m["avg_line_length"], m["todo_count"]) == (
            len(lines), sum(1 for l in lines if l.strip()), mean, text.lower().count("todo"))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="aAbtodé \n", max_size=40), min_size=1, max_size=20))
def test_counts_like_python(spark, values):
    assert column(spark, values, lambda v: ft.count_substr(v, "to")) == [v.count("to") for v in values]
    assert column(spark, values, ft.line_count) == [
        v.count("\n") + (1 if v and not v.endswith("\n") else 0) for v in values]


def test_clamp_rounds_half_to_even(spark):
    assert column(spark, [2.5, 3.5, -4.0, 100.5, 250.0], ft.clamp_score, "double") == [2, 4, 0, 100, 100]


def test_bands_and_severities(spark):
    assert column(spark, [100, 85, 84, 70, 50, 49], ft.score_band, "int") == [
        "Good", "Good", "Fair", "Fair", "Weak", "Poor"]
    assert column(spark, [80, 79, 50, 49], lambda v: ft.score_band(v, ft.PAGE_BANDS), "int") == [
        "good", "warn", "warn", "bad"]
    assert column(spark, ["high", " MEDIUM ", "", None, "error"], ft.severity_label) == [
        "High", "Medium", "Info", "Info", "Error"]
    assert column(spark, ["critical", "error", "warning", "low", None], ft.severity_level) == [
        "high", "high", "medium", "low", "info"]


def test_message_tail(spark):
    df = spark.createDataFrame([("m", 3, "code", 0.5, "do it"), ("m", None, "", None, None)],
                               "m string, l int, s string, c double, f string")
    got = [r[0] for r in df.select(ft.with_details("m", "l", "s", "c", "f")).collect()]
    assert got == ["m (line 3; snippet: code; confidence 0.50; fix: do it)", "m"]


def test_extensions(spark):
    paths = ["a/b.PY", ".bashrc", "x/.hidden", "a.tar.gz", "dir.d/file", "end.", "a.b/.c.js"]
    assert column(spark, paths, fc.file_ext) == [".py", "", "", ".gz", "", "", ".js"]


def test_relative_path(spark):
    assert column(spark, ["C:\\w\\a\\b.py", "/other/x"], lambda v: fc.relative_path(v, "C:\\w")) == ["a/b.py", "/other/x"]


def test_strip_code(spark):
    got = column(spark, ["a /* x\ny */ b // c\n'd\\'e' \"f\" `g`"], fc.strip_code)
    assert got == ["a  b \n'' \"\" ``"]
    long = "'" + "x" * 200_000 + "' y"
    assert column(spark, [long], fc.blank_code) == ["  y"]


def test_language_of_files(spark, make_files):
    files = make_files(
        ("a.py", "", "x"), ("b.js", "", "let a = 1"), ("c.js", "", "import React from 'react'"), ("d.json", "", "db.x"),
        ("e.json", "", "{}"), ("f/package.json", "", "{}"), ("g.tsx", "", ""), ("h.txt", "", "x"), ("i.HTM", "", ""))
    got = {r["path"]: r["language"] for r in detect_language(files).collect()}
    assert got == {"a.py": "python", "b.js": "javascript", "c.js": "react", "d.json": "mongodb",
                   "f/package.json": "manifest", "g.tsx": "react", "i.HTM": "html"}
    compat = {r["path"]: r["language"] for r in detect_language(files, compat=True).collect()}
    assert compat == {"a.py": "python", "b.js": "javascript", "c.js": "javascript", "d.json": "mongodb", "i.HTM": "html"}


def test_colours(spark):
    values = ["#fff", "#12345678", "rgb(1, 2, 3)", "rgba(50%, 0%, 300, 0.5)", "hsl(120, 100%, 50%)",
              "hsla(200deg, 40%, 30%, 50%)", "red", "rgb(a, b, c)", "hsl(1, 2)", "rgb(1 2 3)"]
    got = [tuple(c) if c else None for c in column(spark, values, css.css_rgb)]
    assert got[:6] == [(255, 255, 255, 1.0), (18, 52, 86, 120 / 255), (1, 2, 3, 1.0), (128, 0, 255, 0.5),
                       (0, 255, 0, 1.0), (46, 87, 107, 0.5)]
    assert got[6:] == [None] * 4


def test_contrast(spark):
    df = spark.createDataFrame([("#000", "#fff"), ("#777", "#fff"), ("#777", "#fff8")], "f string, b string")
    got = [r[0] for r in df.select(css.contrast_ratio(css.css_rgb("f"), css.css_rgb("b"))).collect()]
    assert got[0] == 21.0 and round(got[1], 2) == 4.48 and got[2] is None


def test_lengths_and_selectors(spark):
    assert [tuple(x) if x else None for x in column(spark, ["10px", "-.5EM", "50%", "1px 2px", "auto"], css.css_length)] == [
        (10.0, "px"), (-0.5, "em"), (50.0, "%"), None, None]
    w = column(spark, ["#a .b[c] > d:hover"], css.selector_specificity)[0]
    assert (w["ids"], w["classes"], w["elements"]) == (1, 3, 1)


def test_closest_property(spark):
    assert column(spark, ["colr", "paddin", "backgroud", "widht", "zzz"], css.closest_property) == [
        "color", "padding", "background", None, None]


def test_known_properties():
    known = css.known_properties()
    assert len(known) == len(set(known)) and {"border-top-left-radius", "z-index", "font", "inset-inline-end"} <= set(known)
    assert "src" not in known and "colr" not in known


def test_utility_tokens(spark):
    got = column(spark, ["!md:hover:bg-[url(a:b)]", "p-4", "sm:", "[a:b]:c"], utility.utility_parts)
    assert [(u["important"], list(u["variants"]), u["base"], u["utility_group"]) for u in got] == [
        (True, ["md", "hover"], "bg-[url(a:b)]", "color"), (False, [], "p-4", "spacing"), (False, ["sm"], "", "other"),
        (False, ["[a:b]"], "c", "other")]


def test_version_risk(spark):
    specs = ["*", " latest ", "git+x", "^0.1", "~0.2", ">=1 <2", "0.1 <1", "1.2.3"]
    assert [list(x) for x in column(spark, specs, fc.version_risk)] == [
        ["unpinned"], ["unpinned"], ["non_registry"], ["zero_major"], ["zero_major"], ["range"],
        ["zero_major", "range"], []]


def test_repeated(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c", "b", "a"],)], "v array<string>")
    assert [list(r) for r in df.select(ev.repeated("v", 2), ev.repeated("v", 3), ev.repeated("v", 4)).collect()] == [
        [["a", "b"], ["a"], []]]


def test_decoding(spark):
    long = "a" * 600_000 + "é"
    values = [b"plain", "é".encode(), "é".encode("latin-1"), long.encode(), b"\xef\xbb\xbfx", None]
    got = column(spark, values, src.decode_text, "binary")
    assert got == ["plain", "é", "é", long, "\ufeffx", None]


def test_directories_and_archives(spark):
    folder = tempfile.mkdtemp(prefix="corpusgauge-")
    os.makedirs(folder + "/in/deep")
    for name, data in (("in/a.py", b"x = 1"), ("in/deep/b.js", b"let a"), ("in/big.txt", b"z" * 600_000)):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    rows = src.read_corpus(spark, folder + "/in").select("path", "size_bytes").collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["size_bytes"]) for r in rows) == [
        ("a.py", 5), ("b.js", 5), ("big.txt", 600_000)]
    text = src.read_corpus(spark, folder + "/in").select(F.length(src.decode_text("content")).alias("n"))
    assert text.agg(F.max("n")).first()[0] == 600_000

    os.makedirs(folder + "/zip")
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for name in ("ok/a.py", "/abs.py", "../up.py", "x/../y.py", "ok/..b.py"):
            z.writestr(name, name)
    for name, data in (("a.zip", packed.getvalue()), ("broken.zip", b"not a zip")):
        with open(f"{folder}/zip/{name}", "wb") as f:
            f.write(data)
    members = src.read_archives(spark, folder + "/zip/*.zip").collect()
    assert sorted(r["path"] for r in members if r["error"] is None) == ["ok/..b.py", "ok/a.py"]
    assert [r["archive"].rsplit("/", 1)[1] for r in members if r["error"]] == ["broken.zip"]


def test_register_run_keeps_the_newest(spark):
    old = spark.sql("select 'a' as job_id, 'x' as original_name, timestamp '2024-01-01' as created_at")
    new = spark.sql("select 'a' as job_id, 'y' as original_name, timestamp '2024-02-01' as created_at "
                    "union all select 'b', 'z', timestamp '2023-01-01'")
    got = {r["job_id"]: r["original_name"] for r in results.register_run(old, new).collect()}
    assert got == {"a": "y", "b": "z"}


def test_logical_lines(spark):
    """Statements over several lines are one; an unclosed bracket ends at the next word that starts a statement."""
    code = ("from a import (\n    b,\n    c as d)\nx = f(1,\n  [2,\n  3]) + \\\n  y\nif z:\n    g(\n\n)\n"
            "h(u(\ndef k(a,\n      b):\n    return a\\\n\n)\nw")
    got = spark.createDataFrame([(code,), ("",), (None,)], "text string").select(ev.statement_array("text").alias("s")).collect()
    assert [(s["line_no"], s["indent"], " ".join(s["line"].split())) for s in got[0]["s"]] == [
        (1, 0, "from a import ( b, c as d)"), (4, 0, "x = f(1, [2, 3]) + y"), (8, 0, "if z:"), (9, 4, "g( )"),
        (12, 0, "h(u("), (13, 0, "def k(a, b):"), (15, 4, "return a"), (17, 0, ")"), (18, 0, "w")]
    assert got[1]["s"] == [] and got[2]["s"] in (None, [])


def test_calls_and_imports_over_several_lines(spark, make_files):
    from corpusgauge.operators import joins as jo, unnest as un

    code = "from os import (path,\n    sep as s)\nname = input(\n  )\nopen(\n    name)\nprint(path)\n"
    files = make_files(("a.py", "python", code))
    symbols = {(r["kind"], r["name"], r["line_no"]) for r in un.py_symbols(files).collect()}
    assert {("import", "path", 1), ("import", "s", 1), ("assign", "name", 3), ("call", "open", 5)} <= symbols
    assert [r["name"] for r in jo.unused_imports(files).collect()] == ["s"]
