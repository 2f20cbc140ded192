"""UNN, JOI, AGG, WIN, SRT, SET, STR and UDX: event tables, joins, summaries, windows, sets, streams, extensions."""

from pyspark.sql import functions as F

from corpusgauge.functions import events as ev
from corpusgauge.functions.text import capped_list
from corpusgauge.operators import aggregates as ag, joins as jo, sets as st, unnest as u, windows as wi
from corpusgauge.plans import checks_code as cc
from corpusgauge.plans.checks import Spec, flag
from corpusgauge.plans.registry import (
    CHECKS, PACKS, load_profile, register_check, register_pack, rules_named, save_profile, scan, scan_scores,
)
from corpusgauge.plans.rules import Rule, has, reaches, rules_table
from corpusgauge.plans.scan import rule_scan, scan_joined, scored_files
from corpusgauge.session import shared_folder
from corpusgauge.streaming import streams
from . import queries_packs
from .corpora import JOB, SQL, corpus, document_files, page_files, quote as q
from .queries_core import SCORES, STRUCTURE, findings_sql, on_findings, sql
from .queries_packs import (
    BLOCKS, CLASSES, DEAD_SELECTORS, DECLARED, DEPENDENCIES, DEPTH, EARLY, IDS, JSX, KEY, NULLISH, REQUIRED, SEGMENTS,
    SIGNATURES, STACK, STALE, TAINT, UNKNOWN, UNLABELLED, UNUSED, URLS, found, in_list, spans,
)
from .sql import (
    CSS_RULES, DECLS, FOLDED, LINES, PY_LINES, SELECTORS, SHEETS, TAGS, counted, every, fire, forced_corpus, has as like, part,
    rules_sql, squeeze, unnested, with_corpus,
)

HTML = "language = 'html'"
STYLED = "language in ('css', 'html')"
BOTH = ("pages", "code")
ALL = ("pages", "documents:python", "code")


def of(names, fn, where=None):
    """Query that applies fn to the files of a corpus."""
    def run(spark, sf):
        files = corpus(*names)(spark, sf)
        return fn(files.where(where) if where else files)

    return run


# Event tables -------------------------------------------------------------------------------------------------

def unn_4(files):
    rows = u.embedded_blocks(files)
    return rows.select("path", "kind", "block_no", F.trim("attrs").alias("attrs"), "body")


BLOCK_ROWS = f"""blocks_of AS (
  SELECT path, 'script' AS kind, i AS block_no, b AS raw FROM ({unnested(every('text', r'(?is)<script\b[^>]*>.*?</script>'), 'i', 'b', f'files WHERE {HTML}')})
  UNION ALL SELECT path, 'style', i, b FROM ({unnested(every('text', r'(?is)<style\b[^>]*>.*?</style>'), 'i', 'b', f'files WHERE {HTML}')})),
attrs_of AS (SELECT path, 'style-attr' AS kind, i AS block_no, '' AS attrs, regexp_replace(regexp_replace(b, '(?is)^\\sstyle\\s*=\\s*["'']', ''), '["'']$', '') AS body
  FROM ({unnested(every('text', '''(?is)\\sstyle\\s*=\\s*(?:"[^"]*"|'[^']*')'''), 'i', 'b', f'files WHERE {HTML}')}))"""

ATTR = r"""([a-zA-Z_:@][\w:.-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
ATTRS = f"""attrs AS (SELECT path, pos, tag, attr_no, lower({part('p', ATTR, 1)}) AS attr,
  {part('p', ATTR, 2)} || {part('p', ATTR, 3)} || {part('p', ATTR, 4)} AS value FROM (
  {unnested(every('raw', ATTR), 'attr_no', 'p', 'tags WHERE NOT is_close', 'path, pos, tag')}))"""

NAME = r"[A-Za-z_]\w*"
DOTTED = r"(?:^|[^\w.])([A-Za-z_]\w*(?:[.][A-Za-z_]\w*)*)\s*\("
PY_SYMBOLS = f"""symbols AS (
  SELECT path, line_no, 'import' AS kind, CASE WHEN {like('p', r'[ ]as[ ]')} THEN {part('p', r'[ ]as[ ]+([A-Za-z_]\w*)', 1)} ELSE {part('p', r'^[ ]*([A-Za-z_]\w*)', 1)} END AS name
    FROM (SELECT path, line_no, unnest(string_split({part('line', ev.PY_IMPORT, 1)}, ',')) AS p FROM py_lines WHERE {like('line', ev.PY_IMPORT)}
      UNION ALL SELECT path, line_no, unnest(string_split({part('line', ev.PY_FROM, 1)}, ',')) FROM py_lines WHERE {like('line', ev.PY_FROM)})
  UNION ALL SELECT path, line_no, 'assign', unnest({every(part('line', r'^\s*([A-Za-z0-9_, ]+)', 1), NAME)}) FROM py_lines
    WHERE {like('line', r'^\s*[A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*\s*(?::[^=]+)?=[^=]')}
  UNION ALL SELECT path, line_no, 'call', unnest({every('line', DOTTED, 1)}) FROM py_lines
  UNION ALL SELECT path, line_no, 'function', unnest({every('line', r'^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)', 1)}) FROM py_lines
  UNION ALL SELECT path, line_no, 'class', unnest({every('line', r'^\s*class\s+([A-Za-z_]\w*)', 1)}) FROM py_lines)"""
NOT_CALLS = in_list(("if", "while", "for", "return", "def", "class", "and", "or", "not", "in", "print_function"))


def unn_5(files):
    rows = u.css_declarations(u.css_source(files))
    return rows.select(
        "path", "rule_no", "selector", F.array_join("context", " / ").alias("context"), "decl_no", "prop", "raw", "value", "important", "line")


def unn_6(files):
    rows = u.selectors(u.css_rules(u.css_source(files)))
    return rows.groupBy("path", "rule_no").agg(
        F.count("*").alias("selectors"), F.max("ids").alias("ids"), F.max("classes").alias("classes"),
        F.max("elements").alias("elements"))


def unn_7(files):
    rows = u.class_lists(files)
    return rows.select("path", "element_no", "value", F.array_join("tokens", " ").alias("tokens"))


def unn_10(files):
    rows = u.manifest_dependencies(files)
    return rows.select("path", "section", "package", "spec")


def unn_12(files):
    return u.hook_segments(files).select("path", "seg_no", "hook", "prefix", "callback", "deps", "controlled")


UNN = {
    "unn_1_lines": (
        of(("documents", "conversations", "code"), lambda f: u.lines(f).select("path", "line_no", "line", "indent")),
        sql(("documents", "conversations", "code"), "SELECT path, line_no, line, indent FROM lines", LINES)),
    "unn_2_tag_events": (
        of(BOTH, lambda f: u.tag_events(f).select("path", "pos", "tag", "is_close", "is_void", "raw"), HTML),
        sql(BOTH, "SELECT path, pos, tag, is_close, is_void, raw FROM tags", TAGS)),
    "unn_2b_tag_events_without_scripts": (
        of(BOTH, lambda f: u.tag_events(f, skip_scripts=True).select("path", "pos", "tag", "is_close"), HTML),
        lambda: with_corpus(BOTH, "SELECT path, pos, tag, is_close FROM tags", TAGS.replace(
            "FROM files WHERE language = 'html'",
            "FROM (SELECT * REPLACE (regexp_replace(text, '(?is)(<script\\b[^>]*>).*?(</script>)', '\\1\\2', 'g') AS text) FROM files) "
            "WHERE language = 'html'"))),
    "unn_3_attributes": (
        of(BOTH, lambda f: u.attributes(u.tag_events(f)).select("path", "pos", "tag", "attr_no", "attr", "value"), HTML),
        sql(BOTH, "SELECT path, pos, tag, attr_no, attr, value FROM attrs", TAGS, ATTRS)),
    "unn_4_embedded_blocks": (
        of(BOTH, unn_4, HTML),
        sql(BOTH, f"""SELECT path, kind, block_no, trim(regexp_replace(regexp_replace(raw, '(?s)^<[a-zA-Z]+\\s*([^>]*)>.*$', '\\1'), '^\\s+', '')) AS attrs,
          regexp_replace(regexp_replace(raw, '(?i)^<[^>]*>', ''), '(?i)</(?:script|style)>$', '') AS body FROM blocks_of
          UNION ALL SELECT * FROM attrs_of""", BLOCK_ROWS)),
    "unn_5_css_declarations": (
        of(BOTH, unn_5, STYLED),
        sql(BOTH, "SELECT path, rule_no, selector, context, decl_no, prop, raw, value, important, line FROM decls", SHEETS, CSS_RULES, DECLS)),
    "unn_6_selectors": (
        of(BOTH, unn_6, STYLED),
        sql(BOTH, """SELECT path, rule_no, count(*) AS selectors, max(ids) AS ids, max(classes) AS classes, max(elements) AS elements
          FROM weights GROUP BY path, rule_no""", SHEETS, CSS_RULES, SELECTORS)),
    "unn_7_class_tokens": (
        of(BOTH, unn_7, "language in ('html', 'react')"),
        sql(BOTH, "SELECT path, element_no, value, array_to_string(tokens, ' ') AS tokens FROM class_lists", CLASSES)),
    "unn_8_js_declarations": (
        of(("code",), lambda f: u.js_declarations(f).select("path", "name", "kind", "line_no"), "language = 'javascript'"),
        sql(("code",), "SELECT path, name, kind, line_no FROM declared", LINES, DECLARED)),
    "unn_9_jsx_tags": (
        of(("code",), lambda f: u.jsx_tags(f).select("path", "pos", "tag", "attrs"), "language = 'react'"),
        sql(("code",), "SELECT path, pos, tag, attrs FROM jsx", JSX)),
    "unn_10_manifest_dependencies": (
        of(("code",), unn_10, "language = 'manifest'"),
        sql(("code",), "SELECT path, section, package, spec FROM deps", DEPENDENCIES)),
    "unn_11_py_symbols": (
        of(("code", "documents:python"), lambda f: u.py_symbols(f).select("path", "line_no", "kind", "name"), "language = 'python'"),
        sql(("code", "documents:python"), f"SELECT * FROM symbols WHERE name <> '' AND NOT (kind = 'call' AND name IN {NOT_CALLS})",
            PY_LINES, PY_SYMBOLS)),
    "unn_12_hook_segments": (
        of(("code",), unn_12, "language = 'react'"),
        sql(("code",), "SELECT path, seg_no, hook, prefix, callback, deps, controlled FROM segments", SEGMENTS)),
}


# Joins --------------------------------------------------------------------------------------------------------

def joi_1(spark, sf):
    return found(rule_scan(corpus(*ALL)(spark, sf), rules_named()))


def joi_1b(spark, sf):
    rules = rules_table(spark, rules_named())
    return found(scan_joined(corpus(*ALL)(spark, sf), rules))


def joi_2(spark, sf):
    files = page_files(spark, sf)
    metrics = files.select("job_id", "path", "language", F.length("text").alias("chars"))
    scores = scored_files(files, rules_named(*STRUCTURE))
    return jo.job_results(metrics, scores).select("job_id", "path", "language", "chars", "score")


def joi_4(files):
    weights = u.selectors(u.css_rules(u.css_source(files)))
    return jo.dead_selectors(weights, files).select("path", "rule_no", "selector")


def joi_10(files):
    return jo.stale_state_updates(files).select("path", "state", "setter", "shift", "step", "toggle", "rebuild")


def joi_12(files):
    return jo.py_blocks(files).select("path", "line_no", "loops", "asyncs")


def joi_14(files):
    rows = jo.unknown_properties(u.css_declarations(u.css_source(files)))
    return rows.select("path", "rule_no", "decl_no", "prop", "suggestion")


def without_scripts(files):
    return files.withColumn("text", F.regexp_replace("text", r"(?is)<script\b[^>]*>.*?</script>", ""))


def joi_15(spark, sf):
    """Pages against the same pages without their scripts."""
    files, rules = page_files(spark, sf), rules_named("html")
    return jo.compare_runs(rule_scan(files, rules), rule_scan(without_scripts(files), rules))


def joi_15b(spark, sf):
    """Style sheets and pages with class lists against versions with three lines on top and without lines of a length."""
    files = corpus("code", "pages")(spark, sf).where("language in ('css', 'html', 'react')")
    kept = F.filter(F.split("text", "\n"), lambda l: F.length(l) % 11 != 5)
    after = files.withColumn("text", F.concat(F.lit("\n\n\n"), F.array_join(kept, "\n")))
    names = ("css", "utility")
    rows = jo.compare_places(scan(files, *names), scan(after, *names), jo.line_moves(files, after))
    return rows.groupBy("path", "state").agg(F.count("*").alias("findings"), F.sum(F.col("line_after") - F.col("line_before")).alias("moved"))


def joi_15c(spark, sf):
    """Where the lines of documents go if three lines come on top and lines of a length go."""
    files = corpus("documents")(spark, sf)
    kept = F.filter(F.split("text", "\n"), lambda l: F.length(l) % 11 != 5)
    after = files.withColumn("text", F.concat(F.lit("\n\n\n"), F.array_join(kept, "\n")))
    rows = jo.line_moves(files, after).select("path", F.posexplode("moves").alias("n", "to"))
    return rows.select("path", (F.col("n") + 1).alias("line"), "to")


def moves_sql():
    """Anchors by counts of lines; the nearest above and below by windows."""
    return with_corpus(("documents",), """SELECT o.path, o.line, coalesce(
        CASE WHEN d.text = o.text THEN o.line + o.down END, CASE WHEN u.text = o.text THEN o.line + o.up END)::INT AS to
      FROM shifted o LEFT JOIN new_lines d ON d.path = o.path AND d.line = o.line + o.down LEFT JOIN new_lines u ON u.path = o.path AND u.line = o.line + o.up""",
      "old_texts AS (SELECT path, string_split(text, chr(10)) AS l FROM files)",
      "new_texts AS (SELECT path, list_concat(['', '', ''], CASE WHEN len(list_filter(l, lambda x: length(x) % 11 <> 5)) = 0 THEN [''] ELSE list_filter(l, lambda x: length(x) % 11 <> 5) END) AS l FROM old_texts)",
      "old_lines AS MATERIALIZED (SELECT path, unnest(l) AS text, unnest(range(1, len(l) + 1))::INT AS line FROM old_texts)",
      "new_lines AS MATERIALIZED (SELECT path, unnest(l) AS text, unnest(range(1, len(l) + 1))::INT AS line FROM new_texts)",
      """anchors AS (SELECT path, text, a.line AS line, b.line - a.line AS shift FROM
        (SELECT path, text, min(line) AS line FROM old_lines GROUP BY ALL HAVING count(*) = 1) a JOIN
        (SELECT path, text, min(line) AS line FROM new_lines GROUP BY ALL HAVING count(*) = 1) b USING (path, text))""",
      """shifted AS MATERIALIZED (SELECT o.path, o.line, o.text, last_value(shift IGNORE NULLS) OVER (PARTITION BY o.path ORDER BY o.line) AS down,
        first_value(shift IGNORE NULLS) OVER (PARTITION BY o.path ORDER BY o.line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS up
        FROM old_lines o LEFT JOIN anchors a ON a.path = o.path AND a.line = o.line)""")


def compare_sql():
    stripped = ("(SELECT * REPLACE (regexp_replace(text, '(?is)<script\\b[^>]*>.*?</script>', '', 'g') AS text) FROM "
                "(SELECT * REPLACE (regexp_replace(text, '[À-ÖØ-öø-ÿ]', 'x', 'g') AS text) FROM files))")
    grouped = lambda rows: f"SELECT path, rule_id, message, CAST(sum(n) AS BIGINT) AS n FROM ({rows}) GROUP BY ALL"
    return with_corpus(("pages",), """SELECT path, rule_id, message, coalesce(a.n, 0) AS n_before, coalesce(b.n, 0) AS n_after,
      CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'fixed' WHEN a.n = b.n THEN 'unchanged' ELSE 'changed' END AS state
      FROM before a FULL JOIN after b USING (path, rule_id, message)""",
      f"before AS ({grouped(rules_sql(rules_named('html')))})", f"after AS ({grouped(rules_sql(rules_named('html'), stripped))})")


RELEASES = "[" + ", ".join(f"{{'a': {q(a)}, 'r': {q(r)}}}" for a, r in cc.RESOURCES) + "]"
JOI = {
    "joi_1_rule_scan": (joi_1, lambda: with_corpus(ALL, counted(rules_sql(rules_named())))),
    "joi_1b_scan_joined": (joi_1b, lambda: with_corpus(ALL, counted(rules_sql(rules_named())))),
    "joi_2_job_results": (joi_2, on_findings(
        f"SELECT '{JOB}' AS job_id, path, s.language, CAST(length(text) AS INT) AS chars, score FROM files f JOIN scores s USING (path)", SCORES)),
    "joi_3_unlabelled_inputs": (
        of(BOTH, lambda f: jo.unlabelled_inputs(f).select("path", "pos", "tag"), HTML),
        sql(BOTH, "SELECT path, pos, tag FROM unlabelled", UNLABELLED)),
    "joi_4_dead_selectors": (of(BOTH, joi_4, HTML), sql(
        BOTH, f"SELECT path, rule_no, selector FROM dead WHERE {HTML}", SHEETS, CSS_RULES, SELECTORS, DEAD_SELECTORS)),
    "joi_5_unused_imports": (
        of(("code", "documents:python"), lambda f: jo.unused_imports(f).select("path", "name"), "language = 'python'"),
        sql(("code", "documents:python"), "SELECT path, name FROM unused", PY_LINES, UNUSED)),
    "joi_6_taint_flow": (
        of(("code", "documents:python"), lambda f: jo.taint_flow(f).select("path", "line_no", "call", "sink", "name"), "language = 'python'"),
        sql(("code", "documents:python"), "SELECT path, line_no, call, sink, name FROM flows", PY_LINES, TAINT)),
    "joi_7_use_before_declaration": (
        of(("code",), lambda f: jo.use_before_declaration(f).select("path", "name", "kind", "line_no", "first_use"), "language = 'javascript'"),
        sql(("code",), "SELECT path, name, kind, line_no, first_use FROM early", LINES, DECLARED, EARLY)),
    "joi_8_nullish_access": (
        of(("code",), lambda f: jo.nullish_access(f).select("path", "name"), "language = 'javascript'"),
        sql(("code",), "SELECT path, name FROM nullish", NULLISH)),
    "joi_9_missing_required_props": (
        of(("code",), lambda f: jo.missing_required_props(f).select("path", "component", "pos", "prop"), "language = 'react'"),
        sql(("code",), "SELECT path, component, pos, prop FROM lacking", JSX, REQUIRED)),
    "joi_10_stale_state_updates": (of(("code",), joi_10, "language = 'react'"), sql(
        ("code",), "SELECT path, state, setter, shift, step, toggle, rebuild FROM updates WHERE shift OR step OR toggle OR rebuild", STALE)),
    "joi_11_missing_hook_deps": (
        of(("code",), lambda f: jo.missing_hook_deps(f).select("path", "seg_no", "hook", "n_missing", "listed"), "language = 'react'"),
        sql(("code",), f"""SELECT path, seg_no, hook, CAST(len(missing) AS INT) AS n_missing, array_to_string(missing[1:5], ', ') AS listed
          FROM reads WHERE deps IS NOT NULL AND len(missing) > 0 AND hook IN {in_list(ev.HOOKS_WITH_DEPS)}""", SEGMENTS)),
    "joi_12_inside_span": (of(("code", "documents:python"), joi_12, "language = 'python'"), sql(
        ("code", "documents:python"), "SELECT path, line_no, CAST(loops AS INT) AS loops, CAST(asyncs AS INT) AS asyncs FROM blocks", PY_LINES, BLOCKS)),
    "joi_13_unreleased_resources": (
        of(("code", "documents"), lambda f: jo.unreleased_resources(f).select("path", "resource", "release")),
        sql(("code", "documents"), f"""SELECT path, p.a AS resource, p.r AS release FROM (SELECT path, text, unnest({RELEASES}) AS p FROM files)
          WHERE contains(text, p.a) AND NOT contains(text, p.r)""")),
    "joi_14_unknown_properties": (of(BOTH, joi_14, STYLED), sql(
        BOTH, "SELECT path, rule_no, decl_no, prop, suggestion FROM odd_near", SHEETS, CSS_RULES, DECLS, UNKNOWN)),
    "joi_15_compare_runs": (joi_15, compare_sql),
    "joi_15b_compare_places": (joi_15b, None),
    "joi_15c_line_moves": (joi_15c, moves_sql),
}


# Aggregates ---------------------------------------------------------------------------------------------------

def scanned(fn, names=ALL):
    """Query over the file scores of all rules."""
    def run(spark, sf):
        return fn(scored_files(corpus(*names)(spark, sf), rules_named()))

    return run


def over_findings(fn, names=ALL):
    def run(spark, sf):
        return fn(rule_scan(corpus(*names)(spark, sf), rules_named()))

    return run


def all_rules(body, *ctes, corpora=ALL):
    return on_findings(body, *ctes, names=(), corpora=corpora)


def agg_1(spark, sf):
    files = corpus(*ALL)(spark, sf)
    return ag.file_scores(files, rule_scan(files, rules_named())).select("path", "language", "penalty", "findings", "score")


def entries(name):
    return F.array_join(F.transform(F.map_entries(name), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias(name)


def agg_2(findings):
    return ag.finding_counts(findings).select("path", "finding_count", entries("severity_counts"), entries("category_counts"))


def agg_11(files):
    return ag.duplicate_rule_bodies(u.css_source(files), 2, "signature")


def agg_11b(files):
    rows = ag.repeated_declarations(u.css_declarations(u.css_source(files)), 4)
    return rows.select("path", "prop", "value", "uses")


def agg_18(spark, sf):
    rows = u.tag_events(corpus(*BOTH)(spark, sf).where(HTML)).where("not is_close")
    return rows.groupBy("path").agg(capped_list(F.collect_set("tag"), 5).alias("tags"))  # tag names of one page


def agg_14(files):
    rows = ag.conflicting_utilities(u.class_tokens(files))
    return rows.select("path", "element_no", "variants", "utility_group", F.array_join("tokens", " ").alias("tokens"))


def folder_sql():
    return """SELECT job_id, folder, CAST(count(*) AS BIGINT) AS files, CAST(sum(findings) AS BIGINT) AS findings, round_even(avg(score), 2) AS average_score
      FROM (SELECT s.*, f.job_id, unnest(list_transform(range(0, len(string_split(path, '/'))), lambda n: array_to_string(
        list_filter(string_split(path, '/')[1:n], lambda p: p <> ''), '/'))) AS folder FROM scores s JOIN files f USING (path)) GROUP BY job_id, folder"""


AGG = {
    "agg_1_file_scores": (agg_1, all_rules("SELECT path, language, penalty, findings, score FROM scores", SCORES)),
    "agg_1b_scored_files": (
        scanned(lambda s: s.select("path", "language", F.col("penalty").cast("long").alias("penalty"),
                                   F.col("findings").cast("long").alias("findings"), "score")),
        all_rules("SELECT path, language, penalty, findings, score FROM scores", SCORES)),
    "agg_2_finding_counts": (over_findings(agg_2), all_rules("""SELECT path, finding_count, severity_counts, category_counts FROM
      (SELECT path, CAST(sum(n) AS BIGINT) AS finding_count FROM findings GROUP BY path)
      JOIN (SELECT path, string_agg(severity || ':' || n, ',' ORDER BY severity) AS severity_counts FROM (SELECT path, severity, sum(n) AS n FROM findings GROUP BY ALL) GROUP BY path) USING (path)
      JOIN (SELECT path, string_agg(rule || ':' || n, ',' ORDER BY rule) AS category_counts FROM (SELECT path, rule, sum(n) AS n FROM findings GROUP BY ALL) GROUP BY path) USING (path)""")),
    "agg_3_language_summary": (scanned(ag.language_summary), all_rules(
        "SELECT language, count(*) AS files, CAST(sum(score) AS BIGINT) AS total, round_even(avg(score), 2) AS average_score FROM scores GROUP BY language", SCORES)),
    "agg_4_overall_summary": (
        scanned(lambda s: ag.overall_summary(s.withColumn("findings", F.col("findings").cast("long")))),
        all_rules("""SELECT count(*) AS files, count(DISTINCT language) AS languages, round_even(avg(score), 1) AS average_score,
          CAST(sum(findings) AS BIGINT) AS findings FROM scores""", SCORES)),
    "agg_5_summary_rollup": (scanned(ag.summary_rollup), all_rules("""SELECT language, CAST(grouping(language) AS INT) AS level, count(*) AS files,
      round_even(avg(score), 2) AS average_score, CAST(sum(findings) AS BIGINT) AS findings FROM scores GROUP BY ROLLUP (language)""", SCORES)),
    "agg_6_category_scores": (
        over_findings(lambda f: ag.category_scores(f).select("path", "category", "penalty", "findings", "score")),
        all_rules("""SELECT path, rule AS category, CAST(sum(score_impact * n) AS BIGINT) AS penalty, CAST(sum(n) AS BIGINT) AS findings,
          CAST(greatest(0, least(100, 100 - sum(score_impact * n))) AS INT) AS score FROM findings GROUP BY path, rule""")),
    "agg_7_folder_rollup": (scanned(ag.folder_rollup), all_rules(folder_sql(), SCORES)),
    "agg_8_duplicate_ids": (
        of(BOTH, lambda f: ag.duplicate_ids(f).select("path", "id", "uses"), HTML),
        sql(BOTH, "SELECT path, id, uses FROM ids", IDS)),
    "agg_9_repeated_lines": (
        of(("pages", "documents", "conversations"), lambda f: ag.repeated_lines(f).select("path", "line", "uses")),
        sql(("pages", "documents", "conversations"), """SELECT path, trim(line) AS line, count(*) AS uses FROM lines WHERE length(trim(line)) > 12
          GROUP BY path, trim(line) HAVING count(*) >= 4""", LINES)),
    "agg_10_repeated_urls": (
        of(BOTH, lambda f: ag.repeated_urls(f).select("path", "url", "uses"), HTML),
        sql(BOTH, "SELECT path, url, uses FROM urls", URLS)),
    "agg_11_duplicate_rule_bodies": (of(BOTH, agg_11, STYLED), sql(
        BOTH, "SELECT signature, count(*) AS uses FROM signatures GROUP BY signature HAVING count(*) >= 2", SHEETS, CSS_RULES, DECLS, SIGNATURES)),
    "agg_11b_repeated_declarations": (of(BOTH, agg_11b, STYLED), sql(
        BOTH, "SELECT path, prop, raw AS value, count(*) AS uses FROM decls GROUP BY path, prop, raw HAVING count(*) >= 4", SHEETS, CSS_RULES, DECLS)),
    "agg_12_duplicate_selectors": (
        of(BOTH, lambda f: ag.duplicate_selectors(u.css_rules(u.css_source(f))).select(
            "path", F.array_join("context", " / ").alias("context"), "selector", "uses", "bodies"), STYLED),
        sql(BOTH, f"""SELECT path, context, selector, count(*) AS uses, count(DISTINCT {squeeze('body')}) AS bodies FROM css_rules WHERE selector <> ''
          GROUP BY path, context, selector HAVING count(*) > 1""",
            SHEETS, CSS_RULES)),
    "agg_13_conflicting_declarations": (
        of(BOTH, lambda f: ag.conflicting_declarations(u.css_declarations(u.css_source(f))).select(
            "path", "rule_no", "selector", F.array_join("context", " / ").alias("context"), "prop", "uses", "different"), STYLED),
        sql(BOTH, """SELECT path, rule_no, selector, context, prop, count(*) AS uses, count(DISTINCT value) AS different FROM decls
          GROUP BY ALL HAVING count(*) > 1""", SHEETS, CSS_RULES, DECLS)),
    "agg_14_conflicting_utilities": (of(BOTH, agg_14, "language in ('html', 'react')"), sql(BOTH, """
      SELECT path, element_no, v AS variants, utility_group, array_to_string(list_sort(list_distinct(list(token))), ' ') AS tokens FROM (
        SELECT *, array_to_string(list_sort(list_filter(variants, lambda x: x <> '')), ':') AS v FROM class_tokens WHERE utility_group <> 'other')
      GROUP BY path, element_no, v, utility_group HAVING count(DISTINCT token) > 1""", CLASSES)),
    "agg_15_repeated_bundles": (
        of(BOTH, lambda f: ag.repeated_bundles(u.class_lists(f)).select("path", "bundle", "uses"), "language in ('html', 'react')"),
        sql(BOTH, """SELECT path, array_to_string(b, ' ') AS bundle, count(*) AS uses FROM (SELECT path, list_sort(list_distinct(tokens)) AS b FROM class_lists)
          GROUP BY path, b HAVING count(*) > 4 AND len(b) > 4""", CLASSES)),
    "agg_15b_token_drift": (
        of(BOTH, lambda f: ag.token_drift(u.class_tokens(f)).select("path", "arbitrary_values"), "language in ('html', 'react')"),
        sql(BOTH, "SELECT path, count(DISTINCT base) AS arbitrary_values FROM class_tokens WHERE contains(base, '[') AND surplus = 0 GROUP BY path", CLASSES)),
    "agg_16_duplicate_files": (
        of(("documents", "conversations"), ag.duplicate_files),
        sql(("documents", "conversations"), "SELECT sha256(text) AS sha256, count(*) AS copies, min(path) AS first_path FROM files GROUP BY 1 HAVING count(*) > 1")),
    "agg_17_top_value": (
        of(BOTH, lambda f: ag.top_value(u.css_declarations(u.css_source(f))).select("path", "pair", "uses"), STYLED),
        sql(BOTH, """SELECT path, pair, uses FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY uses DESC, pair) AS k FROM (
          SELECT path, prop || ':' || value AS pair, count(*) AS uses FROM decls GROUP BY ALL)) WHERE k = 1""", SHEETS, CSS_RULES, DECLS)),
    "agg_18_capped_list": (agg_18, sql(
        BOTH, "SELECT path, array_to_string(list_sort(list_distinct(list(tag)))[1:5], ', ') AS tags FROM tags WHERE NOT is_close GROUP BY path", TAGS)),
}


# Windows, orders and sets -------------------------------------------------------------------------------------

def win_3(files):
    rows = wi.tag_stack(files)
    shown = F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["kind"], e["tag"])), ",")
    return rows.select("path", shown.alias("errors"), F.array_join("unclosed", ",").alias("unclosed"))


def win_4(findings):
    """The first finding of a rule stands for all of them."""
    return wi.first_per_rule(findings).select("path", "rule_id", "message")


def win_5(files):
    rows = wi.indent_spans(files, r":\s*$")
    return rows.select("path", "line_no", "indent", "end_no")


def two_runs(spark, sf):
    first, rules = page_files(spark, sf), rules_named("html")
    second = without_scripts(first).withColumn("job_id", F.lit("job-2"))
    return scored_files(first, rules).unionByName(scored_files(second, rules))


def win_6(spark, sf):
    runs = spark.sql(f"select '{JOB}' as job_id, timestamp '2024-01-01' as created_at union all select 'job-2', timestamp '2024-01-02'")
    return wi.run_trend(two_runs(spark, sf), runs)


def trend_sql():
    stripped = ("(SELECT * REPLACE (regexp_replace(text, '(?is)<script\\b[^>]*>.*?</script>', '', 'g') AS text) FROM "
                "(SELECT * REPLACE (regexp_replace(text, '[À-ÖØ-öø-ÿ]', 'x', 'g') AS text) FROM files))")
    score = lambda rows: (f"SELECT path, CAST(greatest(0, least(100, 100 - coalesce(sum(p.score_impact * p.n), 0))) AS INT) AS score "
                          f"FROM files LEFT JOIN ({rows}) p USING (path) GROUP BY path")
    return with_corpus(("pages",), f"""SELECT '{JOB}' AS job_id, path, score, CAST(NULL AS INT) AS previous, CAST(NULL AS INT) AS change FROM a
      UNION ALL SELECT 'job-2', path, b.score, a.score, b.score - a.score FROM a JOIN b USING (path)""",
      f"a AS ({score(rules_sql(rules_named('html')))})", f"b AS ({score(rules_sql(rules_named('html'), stripped))})")


def srt_1(spark, sf):
    return st.order_results(joi_2(spark, sf)).select("path", "language", "score")


PLAIN_TABLES = {
    "win_1_max_tag_depth": (
        of(BOTH, lambda f: wi.max_tag_depth(u.tag_events(f)).select("path", "depth"), HTML), sql(BOTH, "SELECT path, depth FROM depth", TAGS, DEPTH)),
    "win_2_tag_balance": (
        of(BOTH, lambda f: wi.tag_balance(u.tag_events(f)).select("path", "tag", "unexpected", "unclosed"), HTML),
        sql(BOTH, """SELECT path, tag, CAST(greatest(-min(run), 0) AS INT) AS unexpected, CAST(arg_max(run, pos) + greatest(-min(run), 0) AS INT) AS unclosed FROM (
          SELECT path, tag, pos, sum(CASE WHEN is_close THEN -1 ELSE 1 END) OVER (PARTITION BY path, tag ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run
          FROM tags WHERE is_close AND tag NOT IN ('area','base','br','col','embed','hr','img','input','link','meta','source','track','wbr','param') OR NOT is_void)
          GROUP BY path, tag""", TAGS)),
    "win_3_tag_stack": (
        of(BOTH, win_3, HTML),
        lambda: with_corpus(BOTH, """SELECT f.path, coalesce(e.errors, '') AS errors, coalesce(array_to_string(l.stack, ','), '') AS unclosed
          FROM files f LEFT JOIN (SELECT path, string_agg(kind || ':' || tag, ',' ORDER BY i) AS errors FROM walk WHERE kind <> '' GROUP BY path) e USING (path)
          LEFT JOIN left_open l USING (path) WHERE f.language = 'html'""", TAGS, STACK, recursive=True)),
    "win_4_first_per_rule": (over_findings(win_4), all_rules("SELECT path, rule_id, min(message) AS message FROM findings GROUP BY path, rule_id")),
    "win_5_indent_spans": (of(("code", "documents:python"), win_5, "language = 'python'"), sql(
        ("code", "documents:python"), """SELECT s.path, s.line_no, l.indent, CAST(end_no AS INT) AS end_no FROM spans s JOIN py_lines l ON l.path = s.path AND l.line_no = s.line_no""",
        PY_LINES, spans("spans", r":\s*$"))),
    "win_6_run_trend": (win_6, trend_sql),
    "srt_1_results_order": (srt_1, on_findings("SELECT path, language, score FROM scores ORDER BY path", SCORES)),
    "srt_2_summary_order": (
        scanned(lambda s: st.order_summary(ag.language_summary(s))),
        all_rules("SELECT language, count(*) AS files, CAST(sum(score) AS BIGINT) AS total, round_even(avg(score), 2) AS average_score FROM scores GROUP BY language ORDER BY lower(language)", SCORES)),
    "srt_3_worst_files": (
        scanned(lambda s: wi.worst_files(s, 10).select("language", "path", "score", "rank")),
        all_rules("""SELECT language, path, score, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY score, path) AS k FROM scores)
          WHERE k <= 10""", SCORES)),
    "set_1_all_findings": (
        lambda spark, sf: found(st.all_findings(*[rule_scan(corpus(*BOTH)(spark, sf), rules_named(p)) for p in ("html.structure", "html.security", "react.state")])),
        lambda: with_corpus(BOTH, counted(rules_sql(rules_named("html.structure", "html.security", "react.state"))))),
    "set_2_dedupe_findings": (
        over_findings(lambda f: st.dedupe_findings(f).select("path", "severity", "message", "line", "rule_id")),
        all_rules("SELECT path, severity, message, line, min(rule_id) AS rule_id FROM findings GROUP BY path, severity, message, line")),
    "set_3_set_minus": (
        of(("code",), lambda f: st.set_minus(u.py_symbols(f).where("kind = 'import'"), u.py_symbols(f).where("kind = 'call'"), ["path", "name"]), "language = 'python'"),
        sql(("code",), f"""SELECT path, name FROM symbols WHERE kind = 'import' AND name <> '' EXCEPT
          SELECT path, name FROM symbols WHERE kind = 'call' AND name NOT IN {NOT_CALLS}""", PY_LINES, PY_SYMBOLS)),
}


# Streams ------------------------------------------------------------------------------------------------------

def arriving(spark, sf, name):
    """A table's file as a stream; the glob lets the table be one file or a folder of files."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parquet*")


def stream_pages(spark, sf):
    pages = arriving(spark, sf, "pages")
    path = F.concat(F.regexp_replace("url", "^https?://", ""), F.lit("~"), F.col("page_id"), F.lit(".html"))
    return pages.select(F.lit(JOB).alias("job_id"), path.alias("path"), F.lit("html").alias("language"), F.col("html").alias("text"))


def drained(spark, stream, mode="append"):
    folder = shared_folder(spark)
    streams.drain(stream, folder + "/out", folder + "/checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(folder + "/out")


def str_1(spark, sf):
    return found(drained(spark, streams.scan_stream(stream_pages(spark, sf), rules_named("html"))))


def str_2(spark, sf):
    return drained(spark, streams.summary_stream(stream_pages(spark, sf), rules_named("html")), "complete")


def str_2b(spark, sf):
    """Each page arrives without its scripts; every third one comes again, as it is."""
    def arriving_at(second, text, which):
        pages = arriving(spark, sf, "pages").where(which)
        path = F.concat(F.regexp_replace("url", "^https?://", ""), F.lit("~"), F.col("page_id"), F.lit(".html"))
        return pages.select(F.lit(JOB).alias("job_id"), path.alias("path"), F.lit("html").alias("language"), F.col("html").alias("text"),
                            F.timestamp_seconds(F.lit(second)).alias("created_at")).transform(text)

    files = arriving_at(1, without_scripts, F.lit(True)).unionByName(arriving_at(2, lambda f: f, F.col("page_id") % 3 == 0))
    changes = streams.score_changes(scored_files(files, rules_named("html"), keep=("created_at",)))
    return streams.summary_of(drained(spark, changes))


def str_2b_sql():
    newest = SQL["pages"].replace("html AS text", "CASE WHEN page_id % 3 = 0 THEN html ELSE regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', '', 'g') END AS text")
    return f"""WITH files AS MATERIALIZED ({newest}), findings AS MATERIALIZED (SELECT * FROM ({rules_sql(rules_named("html"))})), {SCORES}
      SELECT language, count(*) AS files, CAST(sum(score) AS BIGINT) AS total, round_even(avg(score), 2) AS average_score FROM scores GROUP BY language"""


def str_3(spark, sf):
    """Documents arrive one a minute; windows close two hours behind the newest finding."""
    docs = arriving(spark, sf, "documents")
    files = docs.select(
        F.lit(JOB).alias("job_id"), F.concat("source", F.lit("/doc_"), F.col("doc_id"), F.lit(".txt")).alias("path"),
        F.lit("python").alias("language"), "text", F.timestamp_seconds(F.col("doc_id") * 60).alias("created_at"))
    found_at = rule_scan(files, rules_named("python"), "created_at")
    out = drained(spark, streams.findings_per_window(found_at))
    return out.select(F.unix_timestamp("window_start").alias("window_start"), "severity", "findings")


def str_3_sql():
    return "WITH " + findings_sql("python", corpora=("documents:python",)) + """,
timed AS (SELECT severity, n, CAST(regexp_extract(path, 'doc_(\\d+)', 1) AS BIGINT) * 60 AS t FROM findings)
SELECT (t // 3600) * 3600 AS window_start, severity, CAST(sum(n) AS BIGINT) AS findings FROM timed
WHERE (t // 3600) * 3600 + 3600 <= (SELECT max(t) FROM timed) - 7200 GROUP BY ALL"""


def full_scan_scores(spark, sf):
    """Scores by all packs and checks over pages, documents and code, with the language summary on top."""
    scores = scan_scores(corpus(*ALL)(spark, sf))
    return ag.language_summary(scores)


def full_scan_sql():
    """All pack queries over one corpus, summed per file."""
    forced_corpus.append(ALL)
    try:
        packs = [build() for _, build in queries_packs.QUERIES.values()]
    finally:
        forced_corpus.pop()
    union = "\nUNION ALL\n".join(f"SELECT path, score_impact, n FROM ({p})" for p in packs)
    return with_corpus(ALL, f"""SELECT language, count(*) AS files, CAST(sum(score) AS BIGINT) AS total, round_even(avg(score), 2) AS average_score FROM (
      SELECT f.language, CAST(greatest(0, least(100, 100 - coalesce(p.penalty, 0))) AS INT) AS score FROM files f
      LEFT JOIN (SELECT path, sum(score_impact * n) AS penalty FROM ({union}) GROUP BY path) p USING (path)) GROUP BY language""")


# Extensions ---------------------------------------------------------------------------------------------------

HYGIENE = [
    Rule("text.hygiene.license", "text", "license", "low", 3, "License or copyright line found.",
         (has(r"(?i)\b(?:license|copyright)\b"),)),
    Rule("text.hygiene.long", "text", "size", "medium", 5, "Text of {n} lines is long.",
         (reaches("line_count", 40),), measure="line_count", div=20, cap=5, step=100, severity_above="high"),
    Rule("text.hygiene.mail", "text", "privacy", "high", 12, "Mail address found.",
         (has(r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}"),), emit="each"),
]


def udx_1(spark, sf):
    """A language of its own, registered from a table of rules."""
    register_pack("text.hygiene", rules_table(spark, HYGIENE))
    try:
        return found(scan(document_files(spark, sf), "text.hygiene"))
    finally:
        PACKS.pop("text.hygiene")


REPEATS = Spec("text.repeats", "repetition", "low", 4, "Line repeated {n} times.")


def udx_2(spark, sf):
    def repeats(files):
        return flag(ag.repeated_lines(files, 3, 8), (REPEATS, F.lit(True), {"n": F.col("uses")}))

    register_check("text.repeats", "text", repeats)
    try:
        return found(scan(document_files(spark, sf), "text.repeats"))
    finally:
        CHECKS.pop("text.repeats")


def udx_3(spark, sf):
    """A profile that turns one rule off, re-weights one and makes one an error."""
    overrides = spark.createDataFrame(
        [("html.structure.viewport", None, None, False), ("html.structure.description", 9, None, None),
         ("html.security.inline_code", None, "error", None)],
        "rule_id string, impact int, severity string, enabled boolean")
    path = shared_folder(spark) + "/profile"
    save_profile(spark, path, rules_named(*STRUCTURE), overrides)
    return found(rule_scan(page_files(spark, sf), load_profile(spark, path)))


OTHERS = {
    "str_1_scan_stream": (str_1, lambda: with_corpus(("pages",), counted(rules_sql(rules_named("html"))))),
    "str_2_summary_stream": (str_2, on_findings(
        "SELECT language, count(*) AS files, CAST(sum(score) AS BIGINT) AS total, round_even(avg(score), 2) AS average_score FROM scores GROUP BY language",
        SCORES, names=("html",))),
    "str_2b_summary_of_latest": (str_2b, str_2b_sql),
    "str_3_findings_per_window": (str_3, str_3_sql),
    "full_scan_scores": (full_scan_scores, full_scan_sql),
    "udx_1_register_pack": (udx_1, lambda: with_corpus(("documents",), counted(rules_sql(HYGIENE)))),
    "udx_2_register_check": (udx_2, lambda: with_corpus(("documents",), counted(fire(
        REPEATS, f"(SELECT {KEY}, trim(line) AS l, count(*) AS uses FROM lines WHERE length(trim(line)) > 8 GROUP BY ALL HAVING count(*) >= 3)", n="uses")), LINES)),
    "udx_3_profiles": (udx_3, lambda: "WITH " + findings_sql(*STRUCTURE) + """
SELECT path, rule_id, rule, CASE WHEN rule_id = 'html.security.inline_code' THEN 'error' ELSE severity END AS severity,
  CAST(CASE WHEN rule_id = 'html.structure.description' THEN 9 ELSE score_impact END AS INT) AS score_impact, message, n
FROM findings WHERE rule_id <> 'html.structure.viewport'"""),
}

QUERIES = {**UNN, **JOI, **AGG, **PLAIN_TABLES, **OTHERS}
