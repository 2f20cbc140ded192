"""Style sheets: blocks and their places, findings with line and snippet, nearest names."""

import random
from difflib import get_close_matches

from pyspark.sql import functions as F

from corpusgauge.functions import css, sheets, text as ft
from corpusgauge.operators import aggregates as ag, unnest as u
from corpusgauge.plans.registry import scan, scan_scores


def rules_of(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, css string")
    return [r["r"] for r in rows.select("i", sheets.rule_array("css").alias("r")).orderBy("i").collect()]


def plain_rules(text):
    """(selector, line, context, declarations) of each rule, by a stack and one letter at a time."""
    out, stack, i, line = [], [], 0, 1
    # What is gathered since the last brace or semicolon: letters without comments, and the line of the first that counts.
    piece, first = "", None

    def declare():
        nonlocal piece, first
        name, colon, value = piece.partition(":")
        if stack and colon and name.strip().replace("-", "a").isalnum() and value.strip():
            stack[-1]["d"].append((name.strip().lower(), " ".join(value.split()), first))
        piece, first = "", None

    def close():
        nonlocal piece, first
        declare()
        block = stack.pop()
        kept = not block["head"].startswith(("@media", "@supports", "@keyframes"))
        if kept and (block["leaf"] or not block["head"].startswith("@")):
            out.append((block["at"], (block["head"], block["line"], [b["head"] for b in stack], block["d"])))

    while i < len(text):
        c = text[i]
        end = i + 1
        if text.startswith("/*", i):
            end = text.find("*/", i + 2)
            end = len(text) if end < 0 else end + 2
        elif c in "\"'":
            while end < len(text) and text[end] not in (c, "\n"):
                end += 2 if text[end] == "\\" else 1
            end = min(len(text), end + (end < len(text) and text[end] == c))
            first = first or line
            piece += text[i:end]
        elif c == "{":
            head = " ".join(piece.split())
            if stack:
                stack[-1]["leaf"] = False
            stack.append({"at": i, "head": head, "line": first or line, "d": [], "leaf": True})
            piece, first = "", None
        elif c == "}":
            if stack:
                close()
            piece, first = "", None
        elif c == ";":
            declare()
        else:
            if not c.isspace():
                first = first or line
            piece += c
        line += text.count("\n", i, end)
        i = end
    while stack:
        close()
    return [r for _, r in sorted(out)]


def test_rules_like_a_plain_parser(spark):
    rng = random.Random(3)
    words = [".a", "#b", "@media (x)", "@keyframes k", "@font-face", "@foo", "{", "}", "}", "\n", " ", ": ", ";", "color", "red", "top:1px;",
             "/* ; { } \" */", '"} ; {"', "'\\'}'", "/*\n*/", "{ top: 1px }", "\n\n", "a:hover"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(150)]
    got = rules_of(spark, *texts)
    for text, rules in zip(texts, got):
        expected = plain_rules(text)
        assert [(r["selector"], r["context"]) for r in rules] == [(s, c) for s, _, c, _ in expected], text
        assert [[(d["prop"], d["raw"], d["line"]) for d in r["d"]] for r in rules] == [d for *_, d in expected], text
        assert [r["line"] for r, e in zip(rules, expected) if e[0]] == [e[1] for e in expected if e[0]], text
        assert [[d["decl_no"] for d in r["d"]] for r in rules] == [list(range(1, len(d) + 1)) for *_, d in expected]


def test_opaque_parts(spark):
    rules = rules_of(spark, None, "", 'a { background: url(data:x;y,{z}); top: 1 } .sm\\:w-1\\/2\\{ { left: 0 }', "/* open { ", 'b { content: "\n; c { d: e }')
    assert rules[0] is None or rules[0] == []
    assert rules[1] == [] and rules[3] == []
    assert [(r["selector"], [d["prop"] for d in r["d"]]) for r in rules[2]] == [("a", ["background", "top"]), (".sm\\:w-1\\/2\\{", ["left"])]


def test_each_place_is_told(spark, make_files):
    sheet = "".join(f".a{i}:has(.b) {{ margin: 0; }}\n" for i in range(6))
    files = make_files(("six.css", "css", sheet))
    got = scan(files, "css").collect()
    assert sorted((r["line"], r["snippet"]) for r in got) == [(i + 1, f".a{i}:has(.b) {{ margin: 0; }}") for i in range(6)]
    assert scan_scores(files, "css").head()["score"] == 46  # 100 - 6 * 9


def test_told_alike_is_told_once(spark, make_files):
    """Two equal rules on one line are one finding, on two lines two; declarations have their own lines."""
    files = make_files(
        ("a.css", "css", ".a { transition: all 1s; } .b { transition: all 1s; }\r\n.c { transition: all 1s; }"),
        ("b.css", "css", "@media print {\n  .a {\n    font-size: 9px;\n\n    colr: red;\n    colr: red\n  }\n}"))
    got = {(r["path"], r["rule_id"], r["line"], r["snippet"]) for r in scan(files, "css").collect()}
    assert {(p, l) for p, r, l, _ in got if r == "css.performance.transition_all"} == {("a.css", 1), ("a.css", 2)}
    assert ("b.css", "css.style.font_size", 3, "font-size: 9px;") in got
    assert {(l, s) for _, r, l, s in got if r == "css.style.misspelt_property"} == {(5, "colr: red;"), (6, "colr: red")}
    assert ("b.css", "css.style.repeated_declaration", 2, ".a {") in got


def test_contexts_keep_selectors_apart(spark, make_files):
    sheet = ".a { top: 0 }\n@media print { .a { top: 1px } }\n@media screen { .a { top: 2px } .a { top: 2px } }\n" \
            "@keyframes x { from { top: 0 } }\n@keyframes y { from { top: 1px } }"
    files = make_files(("a.css", "css", sheet))
    got = ag.duplicate_selectors(u.css_rules(u.css_source(files))).collect()
    assert [(r["context"], r["selector"], r["uses"], r["bodies"]) for r in got] == [(["@media screen"], ".a", 2, 1)]
    found = {(r["rule_id"], r["line"]) for r in scan(files, "css.maintenance").collect()}
    assert ("css.maintenance.duplicate_selector", 3) in found and not any(r == "css.maintenance.redefined_selector" for r, _ in found)


def test_class_lists_have_lines(spark, make_files):
    page = '<p\nclass="hover:x-1\n  y">\n<b class="a"></b><i class="outline-none"></i>'
    rows = u.class_lists(make_files(("a.html", "html", page))).collect()
    assert [(r["element_no"], r["line"]) for r in rows] == [(1, 2), (2, 4), (3, 4)]
    found = {(r["rule_id"], r["line"], r["snippet"]) for r in scan(make_files(("a.html", "html", page)), "utility").collect()}
    assert ("utility.hover_only", 2, 'class="hover:x-1') in found
    assert ("utility.focus_ring", 4, '<b class="a"></b><i class="outline-none"></i>') in found


def test_lines_by_any_line_end(spark):
    text = "a\r\nb x\rc x\n x"
    row = spark.createDataFrame([(text,)], "text string").select(
        ft.match_lines("text", "x").alias("each"), ft.line_of("text", ft.first_position("text", "x")).alias("first"),
        ft.snippet_of("text", F.lit(3)).alias("third"), ft.snippet_of("text", F.lit(9)).alias("none")).head()
    assert (row["each"], row["first"], row["third"], row["none"]) == ([2, 3, 5], 2, "c x", None)


def test_nearest_name_as_difflib_finds_it(spark):
    rng, known = random.Random(5), css.known_properties()
    names = ["colr", "paddin", "backgroud", "widht", "zzz", "", "x" * 300]
    for _ in range(250):
        name = list(rng.choice(known))
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(name))
            kind = rng.randrange(4)
            if kind == 0:
                del name[at]
            elif kind == 1:
                name.insert(at, rng.choice("abcdefgh-"))
            elif kind == 2:
                name[at] = rng.choice("aeiou")
            else:
                other = rng.randrange(len(name))
                name[at], name[other] = name[other], name[at]
            name = name or ["q"]
        names.append("".join(name))
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", css.closest_property("n").alias("k")).collect()
    expected = {n: (get_close_matches(n, known, n=1, cutoff=0.86) or [None])[0] for n in names}
    assert {r["n"]: r["k"] for r in rows} == expected and sum(v is not None for v in expected.values()) > 100
