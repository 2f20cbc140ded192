"""Lines that end in other ways than a newline, against Python's splitlines."""

from pyspark.sql import functions as F

from corpusgauge.functions import text as ft
from corpusgauge.operators import unnest as u
from corpusgauge.plans.registry import scan

TEXTS = ["ab\r\ncd\r\n", "a\rb", "one\x0btwo\x0c\n", "x\x85y z ", " \r\n\t\r\nq", "\r\n", "", "a\n\nb\n", "\r", "é\x1cü\x1d"]


def test_lines_like_splitlines(make_files):
    rows = u.lines(make_files(*[(str(i), "text", t) for i, t in enumerate(TEXTS)])).collect()
    for i, text in enumerate(TEXTS):
        own = sorted((r["line_no"], r["line"]) for r in rows if r["path"] == str(i))
        assert own == [(n + 1, l) for n, l in enumerate(text.splitlines())], repr(text)


def test_metrics_like_splitlines(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    for r in df.select("text", ft.text_metrics("text").alias("m"), ft.lines_over("text", 1).alias("long")).collect():
        lines = r["text"].splitlines()
        assert r["m"]["avg_line_length"] == (round(sum(map(len, lines)) / len(lines), 2) if lines else 0)
        assert r["m"]["non_empty_lines"] == sum(bool(l.strip()) for l in lines)
        assert r["long"] == sum(len(l) > 1 for l in lines)


def test_a_return_is_no_character_of_a_line(make_files):
    files = make_files(*[(f"{n}.py", "python", "x" * n + "\r\n") for n in (88, 89)])
    hits = scan(files, "python.style").where(F.col("rule_id").endswith("long_line")).collect()
    assert [r["path"] for r in hits] == ["89.py"]
