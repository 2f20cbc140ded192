"""Texts built to exhaust the stack or the time of a task."""

import random
import re
import time

from pyspark.sql import functions as F

from corpusgauge.functions import events as ev
from corpusgauge.functions.events import NOT_IN_PARAGRAPH, VOID_TAGS
from corpusgauge.operators import joins as jo, windows as wi
from corpusgauge.plans.registry import scan_scores

HOSTILE = [
    ("escapes.js", "javascript", 'x = "' + "\\n" * 50_000 + '"\n'),
    ("escapes.py", "python", "x = '" + "\\n" * 50_000 + "'\n"),
    ("names.py", "python", ", ".join(f"a{i}" for i in range(20_000)) + " = input()\n"),
    ("dots.py", "python", ".".join(["a"] * 20_000) + "(x)\n"),
    ("loops.js", "javascript", "for (" + ";" * 20_000),
    ("tags.html", "html", "<i>" * 2_000 + '<b class="' + "[a]" * 20_000 + '">x</b>'),
    ("open.css", "css", ".a{" + "top:0;" * 20_000),
    ("quotes.jsx", "react", "useEffect(() => {" + "'" * 20_001 + "}, []);"),
]


def test_hostile_texts_are_scanned(spark, make_files):
    scores = {r["path"]: r["score"] for r in scan_scores(make_files(*HOSTILE)).collect()}
    assert set(scores) == {name for name, _, _ in HOSTILE}
    assert all(0 <= s <= 100 for s in scores.values())


def test_null_and_empty_texts(spark, make_files):
    files = make_files(*[(f"{l}{i}", l, t) for i, t in enumerate(("", None))
                         for l in ("html", "javascript", "python", "mongodb", "react", "css", "manifest")])
    scores = {r["path"]: r["score"] for r in scan_scores(files).collect()}
    assert len(scores) == 14 and all(s is not None for s in scores.values())


def test_nesting_and_blocks_like_brute_force(spark, make_files):
    """Random tags and indents, deeper than one block of the stack, against plain loops."""
    rng = random.Random(7)
    names = ["a", "b", "i", "p", "div", "br"]
    pages = []
    for n in range(6):
        tags = [(rng.choice(names), rng.random() < (0.5 if n % 2 else 0.2)) for _ in range(1500)]
        pages.append("".join(f"</{t}>" if c else f"<{t}>" for t, c in tags))
    rows = wi.tag_stack(make_files(*[(str(i), "html", p) for i, p in enumerate(pages)])).collect()
    for r in rows:
        stack, errors = [], []
        for close, tag in re.findall(r"<(/?)(\w+)>", pages[int(r["path"])]):
            if not close:
                if stack and stack[-1] == "p" and tag in NOT_IN_PARAGRAPH:
                    errors.append(("invalid_child", tag))
                if tag not in VOID_TAGS:
                    stack.append(tag)
            elif tag not in stack:
                errors.append(("unexpected_close", tag))
            else:
                at = len(stack) - 1 - stack[::-1].index(tag)
                if at < len(stack) - 1:
                    errors.append(("out_of_order", tag))
                stack = stack[:at]
        assert r["unclosed"] == stack and [tuple(e) for e in r["errors"]] == errors

    code = "\n".join(rng.choice(["", "  "]) if rng.random() < 0.1 else " " * rng.randrange(6) + rng.choice(
        ["for x in y:", "z = 1", "async def f():", "raise E", "except E:"]) for _ in range(1200))
    lines = code.split("\n")
    indent = lambda l: len(l) - len(l.lstrip(" "))
    spans = {}
    for i, line in enumerate(lines):
        if line.strip():
            later = [j for j in range(i + 1, len(lines)) if lines[j].strip() and indent(lines[j]) <= indent(line)]
            spans[i] = later[0] if later else len(lines)
    around = lambda i, word: sum(word in lines[h] and h < i < end for h, end in spans.items())
    files = make_files(("a.py", "python", code))
    got = {r["line_no"] - 1: (r["loops"], r["asyncs"]) for r in jo.py_blocks(files).collect()}
    assert got == {i: (around(i, "for "), around(i, "async ")) for i in got} and len(got) >= len(lines) - 1
    within = files.select(F.transform(ev.lines_within(ev.line_array("text"), ev.LOOP), lambda l: l["line_no"]).alias("v"))
    assert within.head()["v"] == [i + 1 for i in sorted(got) if got[i][0]]
    silent = files.select(F.size(ev.blocks_without(ev.line_array("text"), ev.HANDLER, r"\braise\b")).alias("n")).head()["n"]
    assert silent == sum(
        "except" in lines[h] and not any("raise" in l for l in lines[h + 1:end]) for h, end in spans.items())


def test_work_grows_with_the_text(make_files):
    """Twice the text takes no more than about twice the time; before, four times."""
    small = "for a in b:\n    c = d\n"
    cases = [
        ("python.efficiency", "python", small), ("python.correctness", "python", "try:\n    a\nexcept X:\n    pass\n"),
        ("html.structure", "html", "</b>"), ("html.structure", "html", "<i>"), ("html.structure", "html", "<i></b>")]
    for pack, language, piece in cases:
        took = []
        for size in (100_000, 100_000, 400_000):
            files = make_files((f"a.{language}", language, piece * (size // len(piece))))
            start = time.time()
            scan_scores(files, pack).collect()
            took.append(time.time() - start)
        assert took[2] < 8 * max(took[1], 0.5), (pack, piece, took)


def test_work_grows_with_rules_lists_and_blanks(make_files):
    """Four times the rules, tokens or blanks take no more than about four times the time."""
    lists = lambda n: '<i class="' + " ".join(f"hover:p-{i} w-{i}" for i in range(n)) + '">'
    cases = [
        ("css.maintenance", "css", lambda n: "".join(f".a{i} {{ top: 0; left: 0 }}\n.a{i} {{ top: 0 }}\n" for i in range(n)), 1_000),
        ("css.style", "css", lambda n: "".join(f".a{i} {{ color: red; color: red }}\n" for i in range(n)), 1_000),
        ("css.performance", "css", lambda n: ".a {" + "top: 0;\n" * n + "}", 5_000),
        ("python.security", "python", lambda n: "".join(f"a{i} = input()\nos.system(a{i})\n" for i in range(n)), 1_000),
        ("react.hooks", "react", lambda n: "useEffect(() => { f(a); }, [a]);\n" * n, 500),
        ("mongodb.style", "mongodb", lambda n: " " * n + "x", 25_000), ("python.style", "python", lambda n: " " * n + "x", 25_000),
        ("utility", "html", lists, 400), ("html.style", "html", lambda n: "<style>" + "".join(f".a{i} {{ top: {i} }}\n" for i in range(n)) + "</style>", 1_000)]
    for pack, language, build, n in cases:
        took = []
        for size in (n, n, 4 * n):
            files = make_files((f"a.{language}", language, build(size)))
            start = time.time()
            scan_scores(files, pack).collect()
            took.append(time.time() - start)
        assert took[2] < 6 * max(took[1], 0.5), (pack, took)
