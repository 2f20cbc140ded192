"""Hand-worked findings of the snippets, and one firing and one silent file for every rule."""

import pytest

from corpusgauge.plans import checks_code, checks_css, checks_html
from corpusgauge.plans.checks import Spec
from corpusgauge.plans.registry import CHECKS, PACKS, rules_named, scan, scan_scores
from workload.snippets import SNIPPETS

# Rules about size fire on files made here instead of on a snippet.
LARGE = {
    "html.maintenance.large_file": ("html", "<p>\n" * 701),
    "javascript.maintenance.large_file": ("javascript", "x;\n" * 351),
    "mongodb.performance.large_file": ("mongodb", "x\n" * 201),
    "mongodb.maintenance.large_file": ("mongodb", "x\n" * 201),
    "mongodb.maintenance.large_and_heavy": ("mongodb", "db.a.find(" + "y" * 40 + ")\n" + ("z" * 45 + "\n") * 301),
    "mongodb.maintenance.comment_density": ("mongodb", "// x\n" * 41),
    "python.maintenance.large_file": ("python", "x\n" * 401),
    "react.performance.large_file": ("react", "x\n" * 401),
    "react.performance.memo": ("react", "a.map(b)\n" + "x\n" * 251),
    "react.maintenance.large_file": ("react", "x\n" * 451),
    "react.maintenance.many_states": ("react", "useState(1);\n" * 9),
    "react.maintenance.many_effects": ("react", "useState(1);\n" + "useEffect(f, []);\n" * 6),
    "css.maintenance.large_file": ("css", ".a { top: 0; }\n" * 301),
    "html.structure.generic_markup": ("html", "<div></div>" * 18),
    "html.structure.unclosed": ("html", "<div><b><i><u>"),
    "html.structure.inline_handler": ("html", '<a onclick="go()">x</a>'),
    "html.script.scattered_wiring": (
        "html", "<script>" + "document.querySelector('a').addEventListener('x', f);\n" * 8 + "</script>"),
    "html.script.markup_coupling": (
        "html", "<script>" + "document.querySelector('a').style.top = 1;\n" * 4 + "</script>"),
    "html.script.reads_in_loops": (
        "html", "<script>for (;;) { document.querySelector('a'); document.querySelector('b').offsetWidth; }</script>"),
    "html.script.delegation": (
        "html", "<script>document.querySelectorAll('a');" + "e.addEventListener('x', f);\n" * 8 + "</script>"),
    "html.script.unhandled_async": ("html", "<script>fetch('/a')</script>"),
    "html.script.blocking_scripts": ("html", "<head><script>" + "x = 1;\n" * 200 + "</script></head>"),
    "html.maintenance.many_scripts": ("html", "<script>a</script><script>b</script>"),
    "html.maintenance.large_inline": ("html", "<script>" + "x" * 2600 + "</script>"),
    "html.maintenance.much_logic": ("html", "<script>" + "const a = 1;\n" * 15 + "y" * 2000 + "</script>"),
    "html.performance.data_uri": ("html", '<img src="data:image/png;base64,' + "A" * 200 + '">'),
    "html.performance.large_script": ("html", "<script>" + "x" * 2001 + "</script>"),
    "html.performance.large_style": ("html", "<style>" + "x" * 2001 + "</style>"),
    "html.performance.listeners": ("html", "<script>" + "e.addEventListener('x', f);\n" * 8 + "</script>"),
    "html.performance.layout_thrash": ("html", "<script>a.offsetWidth; a.style.top = 1;</script>"),
    "html.accessibility.weak_aria": ("html", '<i aria-live="polite">x</i>'),
    "html.style.fixed_sizes": ("html", "<style>" + "a { margin: 1px 2px; }" * 5 + "</style>"),
    "html.style.heavy_blocks": ("html", "<style>a{}</style><style>b{}</style>"),
    "html.compatibility.modules": ("html", '<script type="module">x</script>'),
    "html.compatibility.has_selector": ("html", "<style>a:has(b) { top: 0; }</style>"),
    "html.compatibility.clamp": ("html", "<style>a { top: clamp(1px, 2px, 3px); }</style>"),
    "html.compatibility.backdrop": ("html", "<style>a { backdrop-filter: none; }</style>"),
    "html.compatibility.scroll_snap": ("html", "<style>a { scroll-snap-type: x; }</style>"),
    "html.security.unsafe_href": ("html", '<a href="javascript:go()">x</a>'),
    "react.security.document_write": ("react", "document.write(x)"),
    "react.security.dynamic_code": ("react", "eval(x)"),
    "react.hooks.stale_rebuild": ("react", "const [a, setA] = useState(1);\nsetA([...a, 1]);"),
    "utility.no_base": ("html", '<b class="sm:">x</b>'),
    "utility.bad_value": ("html", '<b class="w-[]">x</b>'),
    "html.maintenance.mixed_concerns": ("html", "<style>a{}</style><script>b</script>" + "x" * 1500),
    "react.accessibility.icon_button": ("react", "<button><svg /></button>"),
    "react.props.numeric_text": ("react", "<i title={5} />"),
    "python.efficiency.many_queries": ("python", "db.execute(q)\n" * 6),
    "javascript.security.untrusted_flow": ("javascript", "x.innerHTML = location.hash"),
}


def all_ids():
    ids = {r.rule_id: r.language for r in rules_named()}
    for module, language in ((checks_html, None), (checks_code, None), (checks_css, None)):
        for value in vars(module).values():
            if isinstance(value, Spec):
                ids[value.rule_id] = language
    return ids


@pytest.fixture(scope="module")
def fired(spark, make_files):
    rows = [(f"s{i}/{name}", language, text) for i, name, language, text in SNIPPETS]
    rows += [(f"large/{rule}/x", language, text) for rule, (language, text) in LARGE.items()]
    return scan(make_files(*rows)).select("path", "rule_id", "message", "severity", "score_impact", "line").collect()


def test_every_rule_fires_somewhere(fired):
    assert set(all_ids()) - {r["rule_id"] for r in fired} == set()


def test_every_rule_is_silent_somewhere(fired):
    paths = {}
    for r in fired:
        paths.setdefault(r["rule_id"], set()).add(r["path"])
    n = len(SNIPPETS) + len(LARGE)
    assert all(len(p) < n for p in paths.values())


def messages(fired, path):
    return sorted((r["rule_id"], r["message"]) for r in fired if r["path"] == path)


def test_clean_files_are_silent(fired):
    quiet = {"s6/clean.py", "s36/Clean.jsx", "s42/clean.css", "s18/package.json"}
    assert [r for r in fired if r["path"] in quiet] == []


def test_taint(fired):
    got = [rule for rule, _ in messages(fired, "s2/taint.py") if "tainted" in rule]
    assert got == [
        "python.security.tainted_log", "python.security.tainted_log", "python.security.tainted_path",
        "python.security.tainted_query", "python.security.tainted_request", "python.security.tainted_shell"]


def test_each_and_once(fired):
    rules = [rule for rule, _ in messages(fired, "s10/sinks.js")]
    assert rules.count("javascript.security.eval") == 2
    assert rules.count("javascript.security.set_attribute") == 1


def test_use_before_declaration(fired):
    got = [m for rule, m in messages(fired, "s11/order.js") if rule == "javascript.correctness.early_use"]
    assert [m.split("'")[1] for m in got] == ["$cash", "later", "total"]


def test_hooks(fired):
    got = dict(messages(fired, "s29/Hooks.jsx"))
    assert got["react.hooks.no_deps"] == "useEffect is missing a dependency array."
    assert got["react.hooks.missing_deps"] in (
        "useCallback dependency array may be missing: size.", "useEffect dependency array may be missing: name, size.")


def test_line_of_a_finding(fired):
    line = [r["line"] for r in fired if r["rule_id"] == "utility.config.purge"]
    assert line == [3]


def test_style_sheet_messages_count_once(fired):
    own = [(r["severity"], r["message"]) for r in fired if r["path"].startswith("s40/")]
    assert len(own) == len(set(own))


def test_scaled_impact(make_files):
    files = make_files(("a.mongo", "mongodb", "TODO\n"), ("b.mongo", "mongodb", "TODO\n" * 9))
    rows = {r["path"]: r for r in scan(files, "mongodb.style").where("rule_id = 'mongodb.style.todo'").collect()}
    assert (rows["a.mongo"]["score_impact"], rows["a.mongo"]["severity"]) == (3, "low")
    assert (rows["b.mongo"]["score_impact"], rows["b.mongo"]["severity"]) == (8, "medium")
    assert rows["b.mongo"]["message"].startswith("Found 9 TODO-style")


def test_scores_follow_findings(spark, make_files, fired):
    rows = [(f"s{i}/{name}", language, text) for i, name, language, text in SNIPPETS]
    scores = {r["path"]: r for r in scan_scores(make_files(*rows)).collect()}
    for path, row in scores.items():
        penalty = sum(r["score_impact"] for r in fired if r["path"] == path)
        assert row["penalty"] == penalty
        assert row["score"] == max(0, 100 - penalty)


def test_union_of_packs_is_the_scan(make_files, fired):
    rows = [(f"s{i}/{name}", language, text) for i, name, language, text in SNIPPETS if language != "css"]
    files, parts = make_files(*rows), []
    for name in sorted({*PACKS, *CHECKS}):
        if not name.startswith("css") and name != "utility.config":
            exact = scan(files, name)
            parts += [(r["path"], r["rule_id"], r["message"]) for r in exact.collect()]
    whole = [(r["path"], r["rule_id"], r["message"]) for r in fired
             if not r["path"].startswith("large") and not r["path"].endswith(".css")]
    assert sorted(parts) == sorted(whole)
