"""PCK: one query per rule pack, with its checks."""

from pyspark.sql import functions as F

from corpusgauge.functions.css import LENGTH, known_properties
from corpusgauge.functions.utility import BREAKPOINTS, GROUPS, KNOWN_BASE, KNOWN_PREFIX, PART, VARIANTS, VARIANT_FAMILIES
from corpusgauge.functions import events as u, spans as sp
from corpusgauge.functions.events import NOT_IN_PARAGRAPH
from corpusgauge.plans import checks_code as cc, checks_css as cs, checks_html as ch, features as f
from corpusgauge.plans.registry import rules_named, scan
from .corpora import corpus, quote as q
from .sql import (
    CSS_RULES, DECLS, LINES, PY_LINES, SELECTORS, SHEETS, STRIPPED, TAGS, count, counted, every, fire, has,
    joined, lines_of, located, newlines, part, rules_sql, squeeze, sub, unnested, with_corpus,
)

KEY = "job_id, path, language"


def found(findings, *more):
    """Equal findings of a file with their number."""
    return findings.groupBy("path", "rule_id", "rule", "severity", "score_impact", "message", *more).agg(
        F.count("*").alias("n"))


def in_list(names):
    return "(" + ", ".join(q(n) for n in names) + ")"


# Pages --------------------------------------------------------------------------------------------------------

STACK = f"""walk AS (
  SELECT DISTINCT {KEY}, 0 AS i, CAST([] AS VARCHAR[]) AS stack, '' AS kind, '' AS tag FROM tags
  UNION ALL
  SELECT w.job_id, w.path, w.language, t.pos,
    CASE WHEN NOT t.is_close THEN CASE WHEN t.is_void THEN w.stack ELSE list_append(w.stack, t.tag) END
      WHEN list_contains(w.stack, t.tag) THEN w.stack[1:len(w.stack) - list_position(list_reverse(w.stack), t.tag)]
      ELSE w.stack END,
    CASE WHEN NOT t.is_close THEN
        CASE WHEN w.stack[-1] = 'p' AND t.tag IN {in_list(NOT_IN_PARAGRAPH)} THEN 'invalid_child' ELSE '' END
      WHEN w.stack[-1] = t.tag THEN '' WHEN list_contains(w.stack, t.tag) THEN 'out_of_order'
      ELSE 'unexpected_close' END,
    t.tag
  FROM walk w JOIN tags t ON t.path = w.path AND t.pos = w.i + 1),
left_open AS (SELECT w.* FROM walk w JOIN (SELECT path, max(pos) AS last FROM tags GROUP BY path) m
  ON w.path = m.path AND w.i = m.last WHERE len(w.stack) > 0)"""

DEPTH = f"""depth AS (SELECT {KEY}, CAST(max(run - least(low, 0)) AS INT) AS depth FROM (
  SELECT *, min(run) OVER (PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING) AS low FROM (
    SELECT *, sum(CASE WHEN is_close THEN -1 ELSE 1 END) OVER (PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run
    FROM tags WHERE tag = 'div')) GROUP BY ALL)"""

IDS = f"""ids AS (SELECT {KEY}, id, count(*) AS uses FROM (SELECT {KEY}, unnest({every('text', '''(?i)\\bid\\s*=\\s*["']([^"']+)["']''', 1)}) AS id
  FROM files WHERE language = 'html') GROUP BY ALL HAVING count(*) > 1)"""
URLS = f"""urls AS (SELECT {KEY}, url, count(*) AS uses FROM (SELECT {KEY}, unnest({every('text', '''(?i)https?://[^\\s"'>)]+''')}) AS url
  FROM files WHERE language = 'html') GROUP BY ALL HAVING count(*) >= 3)"""


def html_structure():
    kind = lambda spec, name: fire(spec, "walk", f"kind = '{name}'", tag="tag")
    plain = f"path IN (SELECT path FROM files WHERE NOT {has('text', ch.TEMPLATE_MARKERS)})"
    body = counted(
        rules_sql(rules_named("html.structure")),
        kind(ch.OUT_OF_ORDER, "out_of_order"), kind(ch.UNEXPECTED, "unexpected_close"),
        kind(ch.INVALID_CHILD, "invalid_child"),
        fire(ch.UNCLOSED, "left_open", tags="array_to_string(stack[-3:], ', ')"),
        fire(ch.DUPLICATE_ID, f"(SELECT {KEY}, list_sort(list(id)) AS l FROM ids GROUP BY ALL)",
             ids="array_to_string(l[1:3], ', ')"),
        fire(ch.DEEP, "depth", "depth >= 6", n="depth"),
        fire(ch.REPEATED_URL, f"(SELECT DISTINCT {KEY} FROM urls)"),
        fire(ch.REPEATED_LINE, f"""(SELECT DISTINCT {KEY} FROM (SELECT {KEY}, trim(line) AS l FROM lines
          WHERE language = 'html' AND {plain} GROUP BY ALL HAVING count(*) >= 4 AND length(trim(line)) > 12))"""))
    return with_corpus(("pages", "code"), body, TAGS, STACK, DEPTH, IDS, URLS, LINES, recursive=True)


SIGNATURES = f"""signatures AS (SELECT {KEY}, rule_no, selector, string_agg(prop || ':' || raw, '|' ORDER BY prop || ':' || raw) AS signature
  FROM decls GROUP BY ALL)"""
DEAD_SELECTORS = f"""used AS (SELECT DISTINCT path, unnest(regexp_split_to_array(names, '\\s+')) AS token FROM (
  SELECT path, unnest({every('text', '''(?i)\\b(?:id|class)\\s*=\\s*["']([^"']+)["']''', 1)}) AS names FROM files)),
dead AS (SELECT {KEY}, rule_no, selector FROM (SELECT DISTINCT {KEY}, rule_no, selector FROM weights
    WHERE {has('selector', '[#.][a-zA-Z0-9_-]')} AND length(selector) - length(replace(selector, ' ', '')) <= 2
      AND length(selector) - length(replace(selector, '>', '')) <= 1) w
  WHERE NOT EXISTS (SELECT 1 FROM used WHERE used.path = w.path
    AND list_contains({every('w.selector', r'[#.]([\w-]+)', 1)}, used.token)))"""


def html_style():
    html = "language = 'html'"
    once = lambda spec, source: fire(spec, f"(SELECT DISTINCT {KEY} FROM {source})")
    body = counted(
        rules_sql(rules_named("html.style")),
        once(ch.DUPLICATE_BODY, f"(SELECT {KEY} FROM signatures WHERE {html} GROUP BY {KEY}, signature HAVING count(*) >= 2)"),
        once(ch.REPEATED_DECL, f"(SELECT {KEY} FROM decls WHERE {html} GROUP BY {KEY}, prop, raw HAVING count(*) >= 4)"),
        once(ch.COMPLEX, f"(SELECT {KEY} FROM weights WHERE {html} AND (ids >= 2 OR classes >= 4 OR elements >= 4 OR combinators >= 4))"),
        once(ch.DEAD, f"(SELECT {KEY} FROM dead WHERE {html})"))
    return with_corpus(("pages", "code"), body, SHEETS, CSS_RULES, DECLS, SELECTORS, SIGNATURES, DEAD_SELECTORS)


def html_script():
    scripts = f"(SELECT {KEY}, {joined('text', f.SCRIPT)} AS s FROM files WHERE language = 'html')"
    variables = every("s", ch.DOM_VARIABLE, 1)
    bare = (f"list_filter({variables}, lambda v: list_contains({every('s', ch.DOM_USE, 1)}, v) "
            f"AND NOT list_contains({every('s', ch.DOM_GUARD, 1)}, v))")
    rows = f"(SELECT {KEY}, list_sort(list_distinct({every('s', ch.GLOBAL_ASSIGN, 1)})) AS g, {bare} AS b FROM {scripts})"
    repeated = f"""(SELECT DISTINCT {KEY} FROM (SELECT {KEY}, trim(l) AS l FROM (SELECT {KEY}, unnest({lines_of('s')}) AS l FROM {scripts})
      GROUP BY ALL HAVING count(*) >= 4 AND length(trim(l)) > 20))"""
    body = counted(
        rules_sql(rules_named("html.script")),
        fire(ch.GLOBALS, rows, "len(g) > 0", names="array_to_string(g[1:3], ', ')"),
        fire(ch.NULL_CHECK, rows, "len(b) > 0", name="b[1]"), fire(ch.REPEATED_JS, repeated))
    return with_corpus(("pages", "code"), body)


def html_security():
    hits = f"""list_filter([CASE WHEN {has('text', ch.SECRET)} THEN 'possible secret/token label' END,
      CASE WHEN {has('text', ch.AWS_KEY)} THEN 'AWS access key pattern' END,
      CASE WHEN {has('text', ch.TOKEN_WORD)} AND {has('text', ch.LONG_TOKEN)} THEN 'token-like value' END], lambda h: h IS NOT NULL)"""
    link = f"list_filter({every('text', ch.HREF, 1)}, lambda h: {has('h', ch.UNSAFE_SCHEME)} OR {has('h', ch.REDIRECT_PARAM)})[1]"
    rows = f"(SELECT {KEY}, {hits} AS hits, {link} AS link FROM files WHERE language = 'html')"
    body = counted(
        rules_sql(rules_named("html.security")),
        fire(ch.SENSITIVE, rows, "len(hits) > 0", hits="array_to_string(hits, ', ')"),
        fire(ch.UNSAFE_HREF, rows, has("link", ch.UNSAFE_SCHEME)),
        fire(ch.REDIRECT, rows, f"NOT {has('link', ch.UNSAFE_SCHEME)}"))
    return with_corpus(("pages", "code"), body)


UNLABELLED = f"""controls AS (SELECT {KEY}, pos, {part('raw', '^<([a-zA-Z0-9_]+)', 1)} AS tag, {part('raw', ch.CONTROL_ID, 1)} AS id FROM (
  {unnested(every('text', ch.CONTROL), 'pos', 'raw', "files WHERE language = 'html'")})
  WHERE NOT {has('raw', ch.SKIPPED_INPUT)} AND NOT {has('raw', r'(?i)aria-label(?:ledby)?[ ]*=|[^a-z0-9_]placeholder[ ]*=')}),
labels AS (SELECT path, unnest({every('text', ch.LABEL, 1)}) AS id FROM files WHERE language = 'html'),
unlabelled AS (SELECT * FROM controls c WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.path = c.path AND l.id = c.id))"""


def html_accessibility():
    first = f"(SELECT {KEY}, arg_min(tag, pos) AS tag FROM unlabelled GROUP BY ALL)"
    return with_corpus(("pages", "code"), counted(
        rules_sql(rules_named("html.accessibility")), fire(ch.UNLABELLED, first, tag="tag")), UNLABELLED)


def rules_only(corpora, *names):
    return with_corpus(corpora, counted(rules_sql(rules_named(*names))))


# Scripts ------------------------------------------------------------------------------------------------------

JS = "language = 'javascript'"


def javascript_async():
    loose = f"""(SELECT {KEY}, min(line_no) AS n FROM lines WHERE {JS} AND {has('line', cc.PROMISE_CALL)}
      AND NOT {has('line', cc.HANDLED)} GROUP BY ALL)"""
    chains = f"""(SELECT DISTINCT {KEY} FROM (SELECT {KEY}, segs, unnest(range(2, len(segs) + 1)) AS i FROM (
      SELECT {KEY}, string_split({sub('text', '([.]then[ ]*[(])', chr(1) + chr(92) + '1')}, chr(1)) AS segs FROM files WHERE {JS}))
      WHERE NOT {has("left(array_to_string(segs[i:], ''), 350)", r'[.]catch[(]|[.]finally[(]')})"""
    return with_corpus(("code",), counted(
        rules_sql(rules_named("javascript.async")), fire(cc.MISSING_AWAIT, loose, n="n"), fire(cc.NO_CATCH, chains)), LINES)


DECLARED = f"""declared AS (SELECT {KEY}, name, arg_min(kind, line_no * 1000000 + late * 500000 + nth) AS kind, CAST(min(line_no) AS INT) AS line_no FROM (
  SELECT {KEY}, line_no, u.nth, u.late, {part('u.d', r'^(let|const|var|function)', 1)} AS kind,
    {part('u.d', r'^[a-z]+\s+([A-Za-z_$][\w$]*)', 1)} AS name FROM (
    SELECT {KEY}, line_no, unnest(list_concat(
      list_transform({every('line', r'\b(?:let|const|var)\s+[A-Za-z_$][\w$]*')}, lambda d, i: {{'d': d, 'nth': i, 'late': 0}}),
      list_transform({every('line', r'\bfunction\s+[A-Za-z_$][\w$]*\s*\(')}, lambda d, i: {{'d': d, 'nth': i, 'late': 1}}))) AS u
    FROM lines WHERE {JS})) GROUP BY ALL)"""
EARLY = f"""named AS (SELECT path, name, min(line_no) AS first_use FROM (
  SELECT path, line_no, unnest({every('line', r'(?:^|[^.\w$])([A-Za-z_$][\w$]*)', 1)}) AS name FROM lines WHERE {JS}) GROUP BY ALL),
early AS (SELECT d.*, CAST(first_use AS INT) AS first_use FROM declared d JOIN named n ON d.path = n.path AND d.name = n.name
  WHERE first_use < line_no AND kind <> 'function' AND d.name NOT IN {in_list(cc.JS_KEYWORDS + cc.JS_GLOBALS)})"""
NULLISH = f"""code AS (SELECT {KEY}, {STRIPPED} AS code FROM files WHERE {JS}),
nullish AS (SELECT DISTINCT {KEY}, name FROM (SELECT {KEY}, code, unnest({every('code', r'([A-Za-z_$][\w$]*)\s*=\s*(?:null|undefined)\b', 1)}) AS name FROM code)
  WHERE list_contains({every('code', r'([?]?[A-Za-z_$][\w$]*)[.]', 1)}, name))"""


def javascript_correctness():
    return with_corpus(("code",), counted(
        rules_sql(rules_named("javascript.correctness")),
        fire(cc.EARLY_USE, "early", severity="CASE WHEN kind = 'var' THEN 'low' ELSE 'medium' END",
             impact="CASE WHEN kind = 'var' THEN 6 ELSE 9 END", name="name"),
        fire(cc.NULLISH, "nullish", name="name")), LINES, DECLARED, EARLY, NULLISH)


def javascript_efficiency():
    files = "files"
    return with_corpus(("code",), counted(
        rules_sql(rules_named("javascript.efficiency")),
        fire(cc.INTERVAL, files, f"{JS} AND text LIKE '%setInterval(%' AND text NOT LIKE '%clearInterval(%'"),
        fire(cc.LISTENERS, files, f"{JS} AND {has('text', r'addEventListener[ ]*[(]')} AND text NOT LIKE '%removeEventListener(%'")))


SECTIONS = in_list(u.MANIFEST_SECTIONS)
DEPENDENCIES = f"""manifests AS MATERIALIZED (SELECT {KEY}, json_valid(text) AS valid, text FROM files WHERE path LIKE '%/package.json'),
deps AS (SELECT {KEY}, section, package, json_extract_string(block, '$."' || package || '"') AS spec FROM (
  SELECT {KEY}, section, block, unnest(json_keys(block)) AS package FROM (
    SELECT {KEY}, section, json_extract(text, '$.' || section) AS block FROM (SELECT *, unnest({'[' + SECTIONS[1:-1] + ']'}) AS section FROM manifests WHERE valid))
  WHERE block IS NOT NULL))"""
UNPINNED = "trim(spec) IN ('*', 'latest')"
NON_REGISTRY = has("trim(spec)", r"^(?:file:|link:|git[+]|github:|https?://)")


def dependencies():
    loose = f"NOT ({UNPINNED}) AND NOT {NON_REGISTRY} AND "
    return with_corpus(("code",), counted(
        rules_sql(rules_named("dependencies")),
        fire(cc.UNPINNED, "deps", UNPINNED, name="package", spec="trim(spec)"),
        fire(cc.NON_REGISTRY, "deps", NON_REGISTRY, name="package"),
        fire(cc.ZERO_MAJOR, "deps", loose + has("trim(spec)", r"^[~^]?0[.]"), name="package"),
        fire(cc.RANGE, "deps", loose + has("spec", "[<>]"), name="package"),
        fire(cc.INVALID, "manifests", "NOT valid"),
        fire(cc.NO_MANAGER, "manifests",
             "CASE WHEN valid THEN coalesce(json_extract_string(text, '$.packageManager'), '') = '' ELSE false END")), DEPENDENCIES)


# Python -------------------------------------------------------------------------------------------------------

NAME = r"[A-Za-z_]\w*"
TAINT = f"""tainted AS (SELECT path, name, min(line_no) AS tainted_at FROM (SELECT path, line_no, unnest({every(part('line', cc.TAINTED, 1), NAME)}) AS name
  FROM py_lines WHERE {has('line', cc.TAINTED)}) GROUP BY ALL),
calls AS (SELECT {KEY}, line_no, call_no, {part('c', cc.CALL, 1)} AS call, {part('c', cc.CALL, 2)} AS args FROM (
  {unnested(every('line', cc.CALL), 'call_no', 'c', 'py_lines', KEY + ', line_no')})),
sinks AS (SELECT *, CASE {' '.join(f"WHEN {has('call', p)} THEN '{n}'" for n, p, _ in cc.SINKS)} END AS sink FROM calls),
flows AS (SELECT {KEY}, CAST(line_no AS INT) AS line_no, call_no, call, sink, min(t.name) AS name FROM (
    SELECT s.* EXCLUDE (args), unnest({every("CASE WHEN sink IN ('shell', 'path') THEN split_part(args, ',', 1) ELSE args END", '(?:^|[^.a-zA-Z0-9_])([A-Za-z_][a-zA-Z0-9_]*)', 1)}) AS arg
    FROM sinks s WHERE sink IS NOT NULL) a JOIN tainted t USING (path)
  WHERE t.name = arg AND tainted_at < line_no GROUP BY ALL)"""


def python_security():
    return with_corpus(("code", "documents:python"), counted(
        rules_sql(rules_named("python.security")),
        *[fire(spec, "flows", f"sink = '{sink}'") for sink, spec in cc.TAINT.items()]), PY_LINES, TAINT)


def spans(name, pattern):
    return f"""{name} AS (SELECT h.path, h.line_no, (SELECT min(l.line_no) FROM py_lines l WHERE l.path = h.path AND l.line_no > h.line_no
    AND trim(l.line) <> '' AND l.indent <= h.indent) AS end_no FROM py_lines h WHERE {has('h.line', pattern)})"""


def around(name):
    return (f"(SELECT count(*) FROM {name} s WHERE s.path = l.path AND s.line_no < l.line_no "
            "AND (s.end_no IS NULL OR l.line_no < s.end_no))")


BLOCKS = ",\n".join([
    spans("loops", u.LOOP), spans("waits", u.ASYNC),
    f"blocks AS MATERIALIZED (SELECT l.*, {around('loops')} AS loops, {around('waits')} AS asyncs FROM py_lines l)"])


def each(pattern, where):
    return f"(SELECT {KEY}, unnest({every('line', pattern, 1)}) AS name FROM blocks WHERE {where})"


def python_efficiency():
    return with_corpus(("code",), counted(
        rules_sql(rules_named("python.efficiency")),
        fire(cc.NESTED, "blocks", f"loops > 0 AND {has('line', u.FOR_LOOP)}"),
        fire(cc.GROWTH, "blocks", "loops > 0 AND contains(line, '+=')"),
        fire(cc.CONCAT, "blocks", "loops > 0 AND " + has("line", r"""[\w\])'"]\s*\+\s*[\w\[('"]""")),
        fire(cc.LOOP_CALL, each(cc.HEAVY, "loops > 0")),
        fire(cc.LOOP_QUERY, each(r"([\w\])]\.execute)\s*\(", "loops > 0")),
        fire(cc.ASYNC_CALL, each(cc.BLOCKING, "asyncs > 0"), name="name")), PY_LINES, BLOCKS)


UNUSED = f"""imports AS (SELECT DISTINCT {KEY}, {part('p', r'([A-Za-z_]\w*)\s*$', 1)} AS alias, {part('p', r'^\s*([A-Za-z_]\w*)', 1)} AS head,
  {has('p', r'\sas\s')} AS aliased FROM (SELECT {KEY}, unnest(string_split(CASE WHEN {has('line', u.PY_IMPORT)}
    THEN {part('line', u.PY_IMPORT, 1)} ELSE {part('line', u.PY_FROM, 1)} END, ',')) AS p
  FROM py_lines WHERE {has('line', u.PY_IMPORT)} OR {has('line', u.PY_FROM)})),
imported AS (SELECT DISTINCT {KEY}, CASE WHEN aliased THEN alias ELSE head END AS name FROM imports WHERE head <> ''),
unused AS (SELECT * FROM imported i WHERE NOT EXISTS (SELECT 1 FROM py_lines l WHERE l.path = i.path
  AND NOT {has('l.line', r'^\s*(?:import|from)\s')} AND regexp_matches(l.line, '(?:^|[^.a-zA-Z0-9_])\\Q' || i.name || '\\E(?:[^a-zA-Z0-9_]|$)')))"""
SWALLOWED = spans("handlers", u.HANDLER) + f""",
swallowed AS (SELECT h.*, l.job_id, l.language FROM handlers h JOIN py_lines l ON l.path = h.path AND l.line_no = h.line_no
  WHERE NOT EXISTS (SELECT 1 FROM py_lines r WHERE r.path = h.path AND r.line_no > h.line_no
    AND (h.end_no IS NULL OR r.line_no < h.end_no) AND {has('r.line', r'[^a-zA-Z0-9_]raise[^a-zA-Z0-9_]|^raise\b|[^a-zA-Z0-9_]raise$')}))"""


def python_correctness():
    return with_corpus(("code",), counted(
        rules_sql(rules_named("python.correctness")),
        fire(cc.ASYNC_BLOCK, each(cc.BLOCKING_OR_SHELL, "asyncs > 0"), name="name"),
        fire(cc.UNUSED, "unused", name="name"), fire(cc.SWALLOWED, "swallowed")), PY_LINES, BLOCKS, UNUSED, SWALLOWED)


def python_maintenance():
    names = lambda p: f"(SELECT {KEY}, unnest({every('line', p, 1)}) AS name FROM py_lines)"
    return with_corpus(("code", "documents:python"), counted(
        rules_sql(rules_named("python.maintenance", "python.style")),
        fire(cc.NOT_SNAKE, names(r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)"), has("name", "[A-Z]"), name="name"),
        fire(cc.NOT_PASCAL, names(r"^\s*class\s+([A-Za-z_]\w*)"), f"NOT {has('name', '^[A-Z][A-Za-z0-9]+$')}", name="name")), PY_LINES)


# Components ---------------------------------------------------------------------------------------------------

REACT = "language = 'react'"
JSN = r"[A-Za-z_$][\w$]*"
PAIRS = f"list_transform({every('text', u.STATE_PAIR)}, lambda p: {{'state': {part('p', u.STATE_PAIR, 1)}, 'setter': {part('p', u.STATE_PAIR, 2)}}})"
STALE = f"""updates AS (SELECT {KEY}, state, setter,
  regexp_matches(text, call || own || '\\s*[+-]\\s*\\d+') AS shift, regexp_matches(text, call || own || '\\s*[+-]\\s*1\\s*\\)') AS step,
  regexp_matches(text, call || '!\\s*' || own || '\\s*\\)') AS toggle, regexp_matches(text, call || '[\\[{{](?s:.*)\\b' || own || '\\b') AS rebuild
  FROM (SELECT {KEY}, text, p.state, p.setter, '\\b\\Q' || p.setter || '\\E\\s*\\(\\s*' AS call, '\\Q' || p.state || '\\E' AS own
    FROM (SELECT {KEY}, text, unnest({PAIRS}) AS p FROM files WHERE {REACT})))"""
PROP_NAMES = f"""list_filter(list_transform(flatten(list_transform({every('text', u.PROP_LISTS, 1)}, lambda l: string_split(l, ','))),
  lambda p: trim({sub('p', '(?s)[=:].*$')})), lambda p: {has('p', '^[A-Za-z_$][a-zA-Z0-9_$]*$')})"""
NAMES = f"""list_concat(list_sort(list_distinct(list_transform({PAIRS}, lambda p: p.state))), list_sort(list_distinct({PROP_NAMES})))"""
HOOK = "(" + "|".join(u.HOOKS) + ")$"
SCRIPT_BEFORE = "PARTITION BY path ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
SCRIPT_STOP = "(SELECT min(c.place) FROM script c WHERE c.path = o.path AND c.level = o.level + 1 AND c.mark IN (')', ']', '}') AND c.place > o.place)"
ARGUMENT = lambda a, b: f"""(SELECT trim(regexp_replace(string_agg(p, '' ORDER BY place), '\\s*[,)]$', ''), ' ' || chr(9) || chr(10) || chr(13))
  FROM script s WHERE s.path = h.path AND s.place > {a} AND s.place <= {b})"""
SEGMENTS = f"""script_cut AS (SELECT *, CASE WHEN right(p, 1) IN ('(', ')', '[', ']', '{{', '}}', ',') THEN right(p, 1) ELSE '' END AS mark
  FROM ({unnested(every('text', sp.SCRIPT_PIECE), 'place', 'p', f'files WHERE {REACT}')})),
script_run AS (SELECT *, left(p, length(p) - length(mark)) AS t, coalesce(sum(CASE WHEN mark IN ('(', '[', '{{') THEN 1 WHEN mark IN (')', ']', '}}') THEN -1 ELSE 0 END)
  OVER ({SCRIPT_BEFORE}), 0) AS run FROM script_cut),
script AS MATERIALIZED (SELECT *, run - least(0, min(run) OVER (PARTITION BY path ORDER BY place ROWS UNBOUNDED PRECEDING)) AS level FROM script_run),
openers AS MATERIALIZED (SELECT o.*, {SCRIPT_STOP} AS stop, regexp_replace(o.t, '{HOOK}', '') AS ahead,
  (SELECT arg_max(c.mark || chr(1) || c.t, c.place) FROM script c WHERE c.path = o.path AND c.level = o.level AND c.place < o.place) AS previous
  FROM script o WHERE o.mark IN ('(', '[', '{{')),
controls AS MATERIALIZED (SELECT *, coalesce((previous[1] = '(' AND {has("previous[3:]", sp.CONTROL)} AND trim(translate(ahead, chr(10) || chr(9) || chr(13), '   ')) = ''), false)
  OR {has('ahead', sp.CONTROL_WORD)} AS here FROM openers),
hook_calls AS MATERIALIZED (SELECT h.*, {part('t', HOOK, 1)} AS hook,
  coalesce((SELECT min(c.place) FROM script c WHERE c.path = h.path AND c.level = h.level + 1 AND c.mark = ',' AND c.place > h.place AND c.place < h.stop), h.stop) AS comma
  FROM controls h WHERE mark = '(' AND {has('t', HOOK)} AND EXISTS (SELECT 1 FROM script c WHERE c.path = h.path AND c.place = h.stop AND c.mark = ')')),
segments AS MATERIALIZED (SELECT job_id, path, language, names, CAST(row_number() OVER (PARTITION BY path ORDER BY place) AS INT) AS seg_no, hook,
  right(coalesce((SELECT string_agg(p, '' ORDER BY place) FROM script s WHERE s.path = h.path AND s.place < h.place), '') || ahead, 180) AS prefix,
  {ARGUMENT('h.place', 'h.comma')} AS callback,
  nullif({ARGUMENT('h.comma', "coalesce((SELECT min(c.place) FROM script c WHERE c.path = h.path AND c.level = h.level + 1 AND c.mark = ',' AND c.place > h.comma AND c.place < h.stop), h.stop)")}, '') AS deps,
  here OR EXISTS (SELECT 1 FROM controls c WHERE c.path = h.path AND c.here AND c.place < h.place AND (c.stop IS NULL OR c.stop > h.place)) AS controlled
  FROM hook_calls h JOIN (SELECT path, {NAMES} AS names FROM files WHERE {REACT}) USING (path)),
reads AS (SELECT *, list_filter(names, lambda n: list_contains({every('callback', JSN)}, n)
  AND NOT list_contains({every("coalesce(deps, '')", JSN)}, n)) AS missing FROM segments)"""


def react_hooks():
    deps_hooks = f"hook IN {in_list(u.HOOKS_WITH_DEPS)}"
    stale = has("callback", r"\b(props[.]|useState|useReducer|useRef|set[A-Z][A-Za-z0-9_]*)")
    return with_corpus(("code",), counted(
        rules_sql(rules_named("react.hooks", "react.state")),
        fire(cc.CONTROL_FLOW, f"(SELECT DISTINCT {KEY}, hook FROM reads WHERE controlled)", hook="hook"),
        fire(cc.NO_DEPS, "reads", f"{deps_hooks} AND deps IS NULL", hook="hook"),
        fire(cc.PROPS_DEPS, "reads", f"{deps_hooks} AND contains(callback, 'props.') AND NOT contains(deps, 'props.')", hook="hook"),
        fire(cc.MISSING_DEPS, "reads", f"{deps_hooks} AND deps IS NOT NULL AND len(missing) > 0", hook="hook",
             names="array_to_string(missing[1:5], ', ')"),
        fire(cc.EMPTY_DEPS, "reads", f"{deps_hooks} AND deps = '[]' AND {stale}", hook="hook"),
        *[fire(spec, "updates", test, state="state", setter="setter") for spec, test in (
            (cc.SHIFTED, "shift"), (cc.REBUILT, "rebuild"), (cc.STEPPED, "step"), (cc.TOGGLED, "toggle"))]),
        STALE, SEGMENTS)


def react_lifecycle():
    cleanup = has("callback", r"\breturn\s*\(\s*\)\s*=>|\breturn\s+function\b")
    effects = "(SELECT * FROM segments WHERE hook = 'useEffect')"
    checks = [fire(cc.ASYNC_EFFECT, effects, has("callback", r"\basync\s*\(|\basync\s+\w"))]
    for resource, release in cc.RESOURCES:
        used = f"contains(callback, '{resource}')"
        shown = {"resource": q(resource.rstrip("(")), "release": q(release)}
        checks.append(fire(cc.NO_CLEANUP, effects, f"{used} AND NOT {cleanup}", **shown))
        checks.append(fire(cc.OTHER_CLEANUP, effects, f"{used} AND {cleanup} AND NOT contains(callback, '{release}')", **shown))
    return with_corpus(("code",), counted(rules_sql(rules_named("react.lifecycle")), *checks), SEGMENTS)


JSX = f"""jsx AS (SELECT {KEY}, pos, {part('raw', '^<([A-Za-z][a-zA-Z0-9_]*)', 1)} AS tag, {sub('raw', r'^<[A-Za-z][\w.]*|/?>$')} AS attrs FROM (
  {unnested(every('text', u.JSX_TAG), 'pos', 'raw', f'files WHERE {REACT}')}))"""
REQUIRED = f"""required AS (SELECT DISTINCT path, {part('b', cc.PROP_TYPES, 1)} AS component, unnest({every(part('b', cc.PROP_TYPES, 2), cc.REQUIRED, 1)}) AS prop
  FROM (SELECT path, unnest({every('text', cc.PROP_TYPES)}) AS b FROM files WHERE {REACT})),
lacking AS (SELECT {KEY}, component, pos, prop FROM jsx JOIN required USING (path) WHERE tag = component AND NOT contains(attrs, '...')
  AND NOT regexp_matches(attrs, '(?:^|[^a-zA-Z0-9_$])\\Q' || prop || '\\E\\s*='))"""


def react_props():
    a = lambda p: has("attrs", p)
    click = a(r"\bonClick\s*=")
    keyboard = a(r"""\brole\s*=\s*['"]""") + " AND " + a(r"\bon(KeyDown|KeyUp|KeyPress)\s*=") + " AND " + a(r"\btabIndex\s*=")
    return with_corpus(("code",), counted(
        rules_sql(rules_named("react.props", "react.accessibility")),
        fire(cc.REQUIRED_PROP, "lacking", component="component", prop="prop"),
        fire(cc.CONTROLLED, "jsx", f"tag IN ('input', 'textarea', 'select') AND {a(r'(value|checked)[ ]*=[ ]*[{]')} AND NOT {a('onChange[ ]*=')} AND NOT {a('readOnly[ ]*=')}", tag="tag"),
        fire(cc.IMAGE_ALT, "jsx", f"lower(tag) = 'img' AND NOT {a(r'(?i)[^a-z0-9_]alt[ ]*=')}"),
        fire(cc.CONTROL_LABEL, "jsx", f"lower(tag) IN ('input', 'textarea', 'select') AND NOT {a(r'(?i)(aria-label|aria-labelledby|title)[ ]*=')} AND NOT {a(r'(?i)[^a-z0-9_]id[ ]*=')}", tag="lower(tag)"),
        fire(cc.CLICKABLE, "jsx", f"lower(tag) IN ('div', 'span', 'li', 'section', 'article', 'p') AND {click} AND NOT ({keyboard})", tag="lower(tag)"),
        fire(cc.ANCHOR, "jsx", f"lower(tag) = 'a' AND {click} AND NOT {a('href[ ]*=')}")), JSX, REQUIRED)


# Styles -------------------------------------------------------------------------------------------------------

def css_security():
    c = lambda spec, test: fire(spec, "css_rules", f"language = 'css' AND {test}", at="line")
    body = lambda p: has("body", p)
    shadow = f"lower({squeeze(part('body', '(?i)box-shadow[ ]*:[ ]*([^;]+)', 1))})"
    moves = "(contains(lower(body), 'transition:') OR contains(lower(body), 'animation:'))"
    bare = sub(sub("selector", r"\[[^\]]*\]"), r"\([^)]*\)")
    return with_corpus(("code",), located(
        rules_sql(rules_named("css.security", "css.performance")),
        c(cs.EXPRESSION, body(r"(?i)\bexpression\s*\(")),
        c(cs.UNSAFE_URL, "(" + body(r"""(?i)url\s*\(\s*['"]?\s*(?:javascript|vbscript)\s*:""") + " OR " + body(r"""(?i)url\s*\(\s*['"]?\s*data\s*:\s*text/html""") + ")"),
        c(cs.BINDING, "(" + body(r"(?i)-moz-binding\s*:") + " OR " + body(r"(?i)\bbehavior\s*:") + ")"),
        c(cs.SCRIPT_URL, "contains(lower(body), 'url(') AND contains(lower(body), 'javascript:')"),
        c(cs.UNIVERSAL, has("selector", r"(?:^|[,\s>+~])\*(?:$|[,\s>+~.:#\[])")),
        c(cs.HAS, "contains(lower(selector), ':has(')"), c(cs.DEEP_CHAIN, f"{count(bare, r'[ ]+|[>+~]')} > 4"),
        c(cs.FILTER, body(r"(?i)filter\s*:")), c(cs.TRANSITION_ALL, body(r"(?i)transition(?:-property)?\s*:\s*all\b")),
        c(cs.WILL_CHANGE, body(r"(?i)will-change\s*:\s*[^;]+")),
        c(cs.SHADOWS, f"length({shadow}) - length(replace({shadow}, ',', '')) >= 2"),
        c(cs.BLUR, f"{has(shadow, '[0-9]+(px|rem|em)[ ]+[0-9]+(px|rem|em)[ ]+[0-9]+(px|rem|em)')} AND CAST({every(shadow, '([0-9]+(?:[.][0-9]+)?)px', 1)}[3] AS DOUBLE) >= 32"),
        c(cs.LAYOUT_ANIMATION, f"{moves} AND {body(cs.LAYOUT_PROPERTY)}"), once=True), SHEETS, CSS_RULES)


HEXD = lambda s: f"CAST('0x' || {s} AS INT)"
HSL_AT = lambda n: (f"round_even(255 * (l - s * least(l, 1 - l) * greatest(-1, least(((({n}) + h / 30) % 12) - 3, "
                    f"9 - ((({n}) + h / 30) % 12), 1))), 0)")
COLORS = f"""raw_colors AS (SELECT DISTINCT value AS v, lower(trim(value)) AS t FROM decls),
hex AS (SELECT v, {part('t', '^#([0-9a-f]{3,8})$', 1)} AS x FROM raw_colors),
rgb AS (SELECT v, list_filter(list_transform(string_split(translate({part('t', '^rgba?[(][ ]*([^)]+)[ ]*[)]$', 1)}, '/', ','), ','), lambda p: trim(p)), lambda p: p <> '') AS p FROM raw_colors),
hsl AS (SELECT v, p, CAST(replace(p[1], 'deg', '') AS DOUBLE) % 360 AS h, CAST(replace(p[2], '%', '') AS DOUBLE) / 100 AS s, CAST(replace(p[3], '%', '') AS DOUBLE) / 100 AS l FROM (
  SELECT v, list_filter(list_transform(string_split(translate({part('t', '^hsla?[(][ ]*([^)]+)[ ]*[)]$', 1)}, '/', ','), ','), lambda p: trim(p)), lambda p: p <> '') AS p FROM raw_colors) WHERE len(p) IN (3, 4)),
colors AS (
  SELECT v, {HEXD('x[1] || x[1]')} AS r, {HEXD('x[2] || x[2]')} AS g, {HEXD('x[3] || x[3]')} AS b, CASE WHEN length(x) = 4 THEN {HEXD('x[4] || x[4]')} / 255.0 ELSE 1.0 END AS a
    FROM hex WHERE length(x) IN (3, 4)
  UNION ALL SELECT v, {HEXD('x[1:2]')}, {HEXD('x[3:4]')}, {HEXD('x[5:6]')}, CASE WHEN length(x) = 8 THEN {HEXD('x[7:8]')} / 255.0 ELSE 1.0 END FROM hex WHERE length(x) IN (6, 8)
  UNION ALL SELECT v, c[1], c[2], c[3], CASE WHEN len(p) = 3 THEN 1.0 ELSE CAST(replace(p[4], '%', '') AS DOUBLE) / CASE WHEN CAST(replace(p[4], '%', '') AS DOUBLE) > 1 THEN 100 ELSE 1 END END
    FROM (SELECT v, p, list_transform(p[1:3], lambda q: CASE WHEN q LIKE '%\\%' ESCAPE '\\' THEN round_even(CAST(replace(q, '%', '') AS DOUBLE) / 100 * 255, 0) ELSE CAST(q AS DOUBLE) END) AS c FROM rgb WHERE len(p) IN (3, 4))
  UNION ALL SELECT v, {HSL_AT(0)}, {HSL_AT(8)}, {HSL_AT(4)}, CASE WHEN len(p) = 3 THEN 1.0 ELSE CAST(replace(p[4], '%', '') AS DOUBLE) / CASE WHEN CAST(replace(p[4], '%', '') AS DOUBLE) > 1 THEN 100 ELSE 1 END END FROM hsl),
lights AS (SELECT v, a, list_sum(list_transform([[r / 255.0, 0.2126], [g / 255.0, 0.7152], [b / 255.0, 0.0722]],
  lambda c: c[2] * CASE WHEN c[1] <= 0.03928 THEN c[1] / 12.92 ELSE pow((c[1] + 0.055) / 1.055, 2.4) END)) AS light FROM colors),
contrasts AS (SELECT d.*, (greatest(f.light, k.light) + 0.05) / (least(f.light, k.light) + 0.05) AS ratio FROM (
  SELECT {KEY}, rule_no, selector, rule_line, arg_max(value, decl_no) FILTER (prop = 'color') AS fg,
    coalesce(arg_max(value, decl_no) FILTER (prop = 'background-color'), arg_max(value, decl_no) FILTER (prop = 'background')) AS bg
  FROM decls GROUP BY ALL) d JOIN lights f ON f.v = fg JOIN lights k ON k.v = bg WHERE f.a >= 1 AND k.a >= 1)"""
KNOWN = in_list(known_properties())
UNKNOWN = f"""known AS (SELECT unnest({'[' + KNOWN[1:-1] + ']'}) AS k),
odd AS (SELECT * FROM decls WHERE prop NOT IN {KNOWN} AND NOT {has('prop', cs.VENDOR)}),
near AS (SELECT prop, arg_min(k, k) AS suggestion FROM (SELECT prop, k, share, min(share) OVER (PARTITION BY prop) AS best FROM (
  SELECT prop, k, (2 * levenshtein(prop, k) - abs(length(prop) - length(k))) / (length(prop) + length(k)) AS share
  FROM (SELECT DISTINCT prop FROM odd), known)) WHERE share = best AND share <= 1 - 0.86 GROUP BY prop),
odd_near AS (SELECT o.*, n.suggestion FROM odd o LEFT JOIN near n USING (prop))"""
LISTS = f"""plain_rules AS (SELECT * FROM css_rules WHERE selector <> '' AND NOT starts_with(selector, '@')),
lists AS (SELECT {KEY}, rule_no, list, context, line, NOT regexp_matches(context, '(?i)(?:^| / )@(?:-[a-z]+-)?keyframes') AS outside,
    bool_or(ids > 1 OR (ids > 0 AND classes > 3)) AS heavy, max(combinators) AS combinators
  FROM weights WHERE NOT starts_with(list, '@') GROUP BY ALL)"""


def css_style():
    css = "language = 'css' AND "
    d = lambda spec, test, **v: fire(spec, "decls", css + test, at="line", **v)
    px = f"(lower({part('value', LENGTH, 2)}) = 'px' AND CAST({part('value', LENGTH, 1)} AS DOUBLE)"
    width = "prop IN ('width', 'min-width', 'max-width')"
    shown = {"name": "prop", "value": "value"}
    off = r"(?i)outline\s*:\s*(none|0)\b|outline-style\s*:\s*none\b|box-shadow\s*:\s*none\b"
    bang = f"(SELECT {KEY}, rule_no, rule_line, count(*) AS n FROM decls WHERE important AND {css[:-5]} GROUP BY ALL)"
    repeats = f"(SELECT {KEY}, rule_no, rule_line, prop, count(*) AS uses, count(DISTINCT value) AS different FROM decls WHERE {css[:-5]} GROUP BY ALL HAVING count(*) > 1)"
    blocks = f"""(SELECT {KEY}, arg_min(selector, rule_no) AS selector FROM (SELECT {KEY}, selector, signature, min(rule_no) AS rule_no
      FROM signatures WHERE {css[:-5]} GROUP BY {KEY}, selector, signature HAVING count(*) > 8) GROUP BY ALL)"""
    literal = has("value", cs.LITERAL)
    first = f"""SELECT {KEY}, rule_no, prop, arg_min(value, decl_no) AS v FROM decls WHERE prop IN {in_list(cs.COLOR_PROPERTIES)} GROUP BY ALL"""
    totals = f"""(SELECT d.job_id, d.path, d.language, d.n + coalesce(c.n, 0) AS literals, uses_var, important FROM (
        SELECT {KEY}, count(*) FILTER ({literal}) AS n, bool_or(contains(value, 'var(')) AS uses_var, count(*) FILTER (important) AS important
        FROM decls WHERE {css[:-5]} GROUP BY ALL) d
      LEFT JOIN (SELECT path, count(*) AS n FROM ({first}) WHERE {has('v', cs.LITERAL)} GROUP BY path) c USING (path))"""
    defined = f"(SELECT {KEY}, context, selector, arg_max(line, rule_no) AS line, count(*) AS uses, count(DISTINCT {squeeze('body')}) AS bodies FROM plain_rules WHERE {css[:-5]} GROUP BY ALL HAVING count(*) > 1)"
    top = f"""(SELECT {KEY}, pair, uses FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY uses DESC, pair) AS k FROM (
        SELECT {KEY}, prop || ':' || value AS pair, count(*) AS uses FROM decls WHERE {css[:-5]} GROUP BY ALL)) WHERE k = 1)"""
    sel = {"selector": "selector"}
    wars = f"(SELECT {KEY}, context, list, arg_max(line, rule_no) AS line FROM lists WHERE {css} outside AND heavy GROUP BY ALL)"
    body = located(
        rules_sql(rules_named("css.style", "css.maintenance")),
        d(cs.FONT_SIZE, f"prop = 'font-size' AND CASE WHEN {has('value', LENGTH)} THEN {px} < 14) ELSE false END", **shown),
        d(cs.LINE_HEIGHT, f"prop = 'line-height' AND CASE WHEN {has('value', '^[0-9]*[.]?[0-9]+$')} THEN CAST(value AS DOUBLE) < 1.2 ELSE false END", **shown),
        d(cs.FIXED_WIDTH, f"{width} AND CASE WHEN {has('value', LENGTH)} THEN {px} >= 600) ELSE false END", **shown),
        d(cs.VIEWPORT_WIDTH, f"{width} AND contains(value, '100vw')", **shown),
        d(cs.VIEWPORT_HEIGHT, "prop = 'height' AND contains(value, '100vh')"),
        d(cs.ROOT_OVERFLOW, f"prop IN ('overflow', 'overflow-x') AND contains(value, 'hidden') AND {has('lower(selector)', 'html|body|#app|#root')}", **shown),
        d(cs.OUTLINE, "prop = 'outline' AND (contains(value, 'none') OR value = '0')"),
        d(cs.MUTED_FOCUS, "prop = 'box-shadow' AND value = 'none' AND contains(lower(selector), ':focus')"),
        fire(cs.EMPTY_SELECTOR, "css_rules", css + "selector = ''", at="line"), fire(cs.RULE_IMPORTANT, bang, "n >= 3", n="n", at="rule_line"),
        fire(cs.FOCUS_REMOVED, "css_rules", css + f"contains(lower(selector), ':focus') AND {has('body', off)}", at="line"),
        fire(cs.CONTRAST, "contrasts", css + "ratio < 4.5", ratio="printf('%.2f', ratio)", at="rule_line"),
        fire(cs.MISSPELT, "odd_near", css + "suggestion IS NOT NULL", name="prop", close="suggestion", at="line"),
        fire(cs.UNRECOGNIZED, "odd_near", css + "suggestion IS NULL", name="prop", at="line"),
        fire(cs.CONFLICT, repeats, "different > 1", prop="prop", at="rule_line"), fire(cs.REPEATED, repeats, "different = 1", prop="prop", at="rule_line"),
        fire(cs.SPECIFIC, "lists", css + "outside AND heavy", selector="list", at="line"),
        fire(cs.CHAIN, "lists", css + "outside AND combinators > 4", selector="list", at="line"),
        fire(cs.REDEFINED, defined, "bodies > 1", at="line", **sel), fire(cs.DUPLICATED, defined, "bodies = 1", at="line", **sel),
        fire(cs.REPEATED_BLOCK, blocks, at="1", **sel), fire(cs.IMPORTANT, totals, "important >= 8", n="important", at="1"),
        fire(cs.HARDCODED, totals, "literals >= 10 AND NOT uses_var", at="1"),
        fire(cs.REPEATED_VALUE, top, "uses > 10", top="pair", at="1"),
        fire(cs.OVERRIDE_WARS, wars, selector="list", at="line"), once=True)
    return with_corpus(("code",), body, SHEETS, CSS_RULES, DECLS, SELECTORS, SIGNATURES, COLORS, UNKNOWN, LISTS)


STATIC = f"translate({sub(sub('value', '[$][{][^}]*[}]', ' '), '[{][{][^}]*[}][}]', ' ')}, '+', ' ')"
GROUP_CASE = "CASE " + " ".join(f"WHEN {has('core', p)} THEN '{n}'" for n, p in GROUPS) + " ELSE 'other' END"
BALANCE = lambda s, a, b: f"length(replace({s}, '{a}', '')) = length(replace({s}, '{b}', ''))"
CLASSES = f"""found_lists AS (SELECT {KEY}, unnest(range(1, len(quoted) + 1)) AS element_no, quoted, whole, between
  FROM (SELECT {KEY}, {every('text', u.CLASS_ATTRIBUTE, 1)} AS quoted, {every('text', u.CLASS_ATTRIBUTE)} AS whole,
    regexp_split_to_array(text, {q(u.CLASS_ATTRIBUTE)}) AS between FROM files WHERE language IN ('html', 'react'))),
class_values AS MATERIALIZED (SELECT {KEY}, CAST(element_no AS INT) AS element_no, quoted[element_no][2:length(quoted[element_no]) - 1] AS value,
  CAST(1 + {newlines("array_to_string(between[1:element_no], '')")} + {newlines("array_to_string(whole[1:element_no - 1], '')")} AS INT) AS line FROM found_lists),
class_lists AS MATERIALIZED (SELECT *, list_filter(string_split(trim({sub(STATIC, '[ ' + chr(9) + chr(10) + chr(13) + ']+', ' ')}), ' '), lambda t: t <> '') AS tokens FROM class_values),
class_tokens AS MATERIALIZED (SELECT * EXCLUDE (core), {GROUP_CASE} AS utility_group FROM (
  SELECT *, split_part({sub('base', '^!+')}, '/', 1) AS core FROM (
  SELECT *, starts_with(token, '!') AS important, coalesce(parts[-1], '') AS base, parts[1:len(parts) - 1] AS variants,
    CAST(length(replace(token, ']', '')) - length(replace(token, '[', '')) AS INT) AS surplus FROM (
    SELECT *, {every("regexp_replace(token, '^!', '') || ':'", PART, 1)} AS parts FROM (
      {unnested('tokens', 'token_no', 'token', 'class_lists', KEY + ', element_no, line')}))))),
parsed AS MATERIALIZED (SELECT *, CASE WHEN surplus <> 0 THEN 'unbalanced' WHEN base = '' THEN 'no_base'
  WHEN {has("regexp_replace(token, '^!', '')", '^:|::|:$')} THEN 'bad_variant'
  WHEN NOT ({BALANCE('base', '[', ']')} AND (NOT contains(base, '[') OR (trim(inner_value) <> '' AND NOT {has('inner_value', '[$][{]|[{][{]|[}][}]')} AND {BALANCE('inner_value', '(', ')')})))
  THEN 'bad_value' END AS state FROM (SELECT *, {part('base', r'\[(.*)\]', 1)} AS inner_value FROM class_tokens))"""


def utility():
    lists = "class_lists"
    dynamic = "(" + has("value", r"[$][{]|[{][{]|[}][}]") + " OR " + has("value", r"clsx\(|cn\(|(?i:classnames\()") + ")"
    ok = "state IS NULL"
    per = lambda test: f"(SELECT {KEY}, element_no, line FROM parsed WHERE {ok} GROUP BY ALL HAVING {test})"
    has_variant = lambda *v: "bool_or(" + " OR ".join(f"list_contains(variants, '{x}')" for x in v) + ")"
    tok = lambda spec, test, **v: fire(spec, "parsed", test, at="line", **(v or {"token": "token"}))
    here = lambda spec, source, test="true", **v: fire(spec, source, test, at="line", **v)
    motion = f"""(SELECT p.* FROM parsed p WHERE {ok} AND (starts_with(base, 'animate-') OR base = 'transition-all') AND NOT EXISTS (
      SELECT 1 FROM parsed r WHERE r.path = p.path AND r.element_no = p.element_no AND r.state IS NULL AND r.token_no <= p.token_no
      AND list_contains(r.variants, 'motion-reduce')))"""
    conflicts = f"""(SELECT {KEY}, element_no, line, utility_group, list_sort(list_distinct(list(token))) AS l FROM (
        SELECT *, array_to_string(list_sort(list_filter(variants, lambda v: v <> '')), ':') AS v FROM parsed WHERE {ok} AND utility_group <> 'other')
      GROUP BY {KEY}, element_no, line, v, utility_group HAVING count(DISTINCT token) > 1)"""
    bundles = f"""(SELECT DISTINCT {KEY} FROM (SELECT {KEY}, list_sort(list_distinct(tokens)) AS b FROM class_lists) GROUP BY {KEY}, b
      HAVING count(*) > 4 AND len(b) > 4)"""
    counted_lists = f"(SELECT {KEY}, count(*) AS n FROM class_lists WHERE {dynamic} GROUP BY ALL)"
    drift = f"(SELECT {KEY}, count(DISTINCT base) AS n FROM parsed WHERE {ok} AND (contains(base, '[') OR contains(base, ']')) GROUP BY ALL)"
    variants = f"(SELECT {KEY}, line, unnest(variants) AS variant FROM parsed WHERE {ok})"
    bracketed = "len(list_filter(tokens, lambda t: contains(t, '[') AND contains(t, ']')))"
    return with_corpus(("pages", "code"), located(
        rules_sql(rules_named("utility.config")),
        here(cs.DYNAMIC_CLASS, lists, dynamic), here(cs.INTERPOLATED, lists, has("value", "[$][{]|[{][{]|[}][}]")),
        here(cs.LONG_LIST, lists, "len(tokens) >= 18"), here(cs.MANY_ARBITRARY, lists, f"{bracketed} >= 4"),
        here(cs.HOVER_ONLY, per(f"{has_variant('hover')} AND NOT {has_variant('focus', 'focus-visible')}")),
        here(cs.HIDDEN, per(f"bool_or(base = 'hidden') AND {has_variant(*BREAKPOINTS)}")),
        here(cs.RING, per("bool_or(base = 'outline-none')")),
        tok(cs.UNBALANCED, "state = 'unbalanced'"), tok(cs.NO_BASE, "state = 'no_base'"),
        tok(cs.BAD_VARIANT, "state = 'bad_variant'"), tok(cs.BAD_VALUE, "state = 'bad_value'"),
        tok(cs.IMPORTANT_UTILITY, f"{ok} AND important"),
        tok(cs.ARBITRARY, f"{ok} AND (contains(base, '[') OR contains(base, ']'))"),
        tok(cs.UNKNOWN_BASE, f"{ok} AND NOT {has('base', KNOWN_BASE)} AND NOT {has('base', KNOWN_PREFIX)} AND NOT starts_with(base, '[')", base="base"),
        tok(cs.SMALL_TEXT, f"{ok} AND {has('base', r'^text-(?:xs|sm|[[].*[]])$')}"),
        here(cs.MOTION, motion, token="token"),
        here(cs.UNKNOWN_VARIANT, variants, f"variant NOT IN {in_list(VARIANTS)} AND NOT {has('variant', VARIANT_FAMILIES)}", variant="variant"),
        here(cs.GROUP_CONFLICT, conflicts, group="utility_group", tokens="array_to_string(l[1:3], ', ')"),
        fire(cs.BUNDLE, bundles, at="1"), fire(cs.DRIFT, drift, "n >= 6", at="1"),
        fire(cs.MANY_DYNAMIC, counted_lists, "n >= 3", at="1")), CLASSES)


# Registry -----------------------------------------------------------------------------------------------------

PAGES = ("pages", "code")
CODE = ("code",)
PACK_QUERIES = {
    "pck_01_html_structure": (PAGES, ("html.structure",), html_structure),
    "pck_02_html_style": (PAGES, ("html.style",), html_style),
    "pck_03_html_script": (PAGES, ("html.script",), html_script),
    "pck_04_html_security": (PAGES, ("html.security",), html_security),
    "pck_05_html_accessibility": (PAGES, ("html.accessibility",), html_accessibility),
    "pck_06_html_maintenance": (PAGES, ("html.maintenance",), None),
    "pck_07_html_performance": (PAGES, ("html.performance",), None),
    "pck_08_html_compatibility": (PAGES, ("html.compatibility",), None),
    "pck_09_javascript_async": (CODE, ("javascript.async",), javascript_async),
    "pck_10_javascript_correctness": (CODE, ("javascript.correctness",), javascript_correctness),
    "pck_11_javascript_security": (CODE, ("javascript.security",), None),
    "pck_12_javascript_efficiency": (CODE, ("javascript.efficiency",), javascript_efficiency),
    "pck_13_javascript_maintenance_style": (CODE, ("javascript.maintenance", "javascript.style"), None),
    "pck_14_dependencies": (CODE, ("dependencies",), dependencies),
    "pck_15_mongodb_security": (CODE, ("mongodb.security",), None),
    "pck_16_mongodb_performance": (CODE, ("mongodb.performance",), None),
    "pck_17_mongodb_maintenance": (("code", "documents:mongodb"), ("mongodb.maintenance",), None),
    "pck_18_mongodb_style": (("code", "documents:mongodb"), ("mongodb.style",), None),
    "pck_19_python_security": (("code", "documents:python"), ("python.security",), python_security),
    "pck_20_python_efficiency": (CODE, ("python.efficiency",), python_efficiency),
    "pck_21_python_maintenance_style": (
        ("code", "documents:python"), ("python.maintenance", "python.style"), python_maintenance),
    "pck_22_python_correctness": (CODE, ("python.correctness",), python_correctness),
    "pck_23_react_hooks_state": (CODE, ("react.hooks", "react.state"), react_hooks),
    "pck_24_react_lifecycle": (CODE, ("react.lifecycle",), react_lifecycle),
    "pck_25_react_props_accessibility": (CODE, ("react.props", "react.accessibility"), react_props),
    "pck_26_react_security_performance_style": (
        CODE, ("react.security", "react.performance", "react.maintenance", "react.style"), None),
    "pck_27_css_security_performance": (CODE, ("css.security", "css.performance"), css_security),
    "pck_28_css_style_maintenance": (CODE, ("css.style", "css.maintenance"), css_style),
    "pck_29_utility_classes": (PAGES, ("utility",), utility),
}


def _query(corpora, names):
    place = ("line", "snippet") if names[0].startswith(("css", "utility")) else ()
    return lambda spark, sf_dir: found(scan(corpus(*corpora)(spark, sf_dir), *names), *place)


QUERIES = {
    key: (_query(corpora, names), (sql or (lambda c=corpora, n=names: rules_only(c, *n))))
    for key, (corpora, names, sql) in PACK_QUERIES.items()
}
