"""DuckDB text of rules and of pieces that several oracles share."""

from corpusgauge.functions import events as ev, sheets as sh
from corpusgauge.functions.text import LINE_START
from corpusgauge.plans import features as f
from corpusgauge.plans.rules import by_language
from .corpora import corpus_sql, quote as q


def rx(p):
    """A pattern without possessive repetitions and starts of lines, which DuckDB does not know and need not: it never
    backtracks."""
    return q(p.replace("*+", "*").replace("++", "+").replace(LINE_START, ""))


def has(s, p):
    return f"regexp_matches({s}, {rx(p)})"


def every(s, p, group=0):
    return f"regexp_extract_all({s}, {rx(p)}, {group})"


def count(s, p):
    return f"len({every(s, p)})"


def part(s, p, group=0):
    return f"regexp_extract({s}, {rx(p)}, {group})"


def sub(s, p, by=""):
    return f"regexp_replace({s}, {rx(p)}, {q(by)}, 'g')"


def joined(s, p, group=1):
    return f"array_to_string({every(s, p, group)}, chr(10))"


def literals(s, *needles):
    return "(" + " + ".join(
        f"((length({s}) - length(replace({s}, {q(n)}, ''))) // {len(n)})" for n in needles) + ")"


def newlines(s):
    return f"(length({s}) - length(replace({s}, chr(10), '')))"


def squeeze(s):
    return f"trim({sub(s, chr(92) + 's+', ' ')})"


def lines_of(s):
    """Lines without the piece after a final newline."""
    return f"string_split(CASE WHEN right({s}, 1) = chr(10) THEN left({s}, length({s}) - 1) ELSE {s} END, chr(10))"


LINE_COUNT = "(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND right(text, 1) <> chr(10) THEN 1 ELSE 0 END)"
STYLE_ATTRS = (
    f"list_transform({every('text', f.STYLE_ATTR)}, lambda a: "
    + r"""regexp_replace(regexp_replace(a, '(?is)^\sstyle\s*=\s*["'']', ''), '["'']$', ''))"""
)
PAGE_CSS = f"array_to_string(list_concat({every('text', f.STYLE, 1)}, {STYLE_ATTRS}), chr(10))"
# Characters that end a number are doubled, so that every number has its own ones.
DOUBLED = r"regexp_replace(text, '([^\w.])', '\1\1', 'g')"
BLOCK, LINE, HASH = r"/\*[\s\S]*?\*/", r"//[^\n]*", r"#[^\n]*"
S1, S2, S3 = r"'(?:\\[\s\S]|[^'\\])*'", r'"(?:\\[\s\S]|[^"\\])*"', r"`(?:\\[\s\S]|[^`\\])*`"
STRIPPED = sub(sub(sub(sub(sub("text", BLOCK), LINE), S1, "''"), S2, '""'), S3, "``")
BLANKED = sub("text", "|".join([LINE, BLOCK, S1, S2, S3]), " ")
PY_CODE = sub("text", "|".join([HASH, r'"""[\s\S]*?"""', r"'''[\s\S]*?'''", S1, S2]), " ")

FEATURES = {
    "file_name": "lower(regexp_extract(path, '[^/]*$'))",
    "line_count": LINE_COUNT,
    "newlines": "(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' THEN 1 ELSE 0 END)",
    "script_text": joined("text", f.SCRIPT),
    "script_tags": joined("text", f.SCRIPT_TAG),
    "script_blocks": count("text", f.SCRIPT),
    "style_text": joined("text", f.STYLE),
    "style_blocks": count("text", f.STYLE),
    "style_chars": f"coalesce(list_sum(list_transform({every('text', f.STYLE, 1)}, lambda b: length(b))), 0)",
    "style_attributes": count("text", f.STYLE_ATTR),
    "inline_chars": f"(length(array_to_string({every('text', f.SCRIPT)}, '')) + length(array_to_string({every('text', f.STYLE)}, '')))",
    "css_text": PAGE_CSS,
    "layout_systems": " + ".join(f"CASE WHEN {has('css_text', p)} THEN 1 ELSE 0 END" for p in f.LAYOUTS),
    "code": STRIPPED,
    "blanked": BLANKED,
    "py_code": PY_CODE,
    "stages": literals("text", *f.STAGES),
    "query_calls": literals("text", *f.QUERY_CALLS),
    "branches": literals("lower(text)", *f.BRANCHES),
    "markers": literals("text", *f.MARKERS),
    "magic_numbers": "(" + " + ".join(count(DOUBLED, p) for p in (
        r"(?:^|[^\w.])\d{3,}(?:[^\w.]|$)", r"(?:^|[^\w.])\d+\.\d+(?:[^\w.]|$)",
        r"(?i)(?:^|[^\w.])\d+\s*ms\b", r"(?i)(?:^|[^\w.])\d+\s*s\b")) + ")",
    "lines_over_120": f"len(list_filter(string_split(text, chr(10)), lambda l: length(l) > 120))",
    "comment_lines": count("text", r"(?m)^[ \t]*(?:#|//|/\*|\*)"),
    "comment_share": "CASE WHEN line_count > 0 THEN comment_lines / line_count ELSE 0 END",
    "todo_words": count("text", f.TODO_WORDS),
    "tabs": literals("text", "\t"),
    "trailing_blanks": count("text", r"(?m)[ \t]+$"),
    "commented_code": count("text", f.COMMENTED_CODE),
    "ternary_lines": "len(list_filter(string_split(text, chr(10)), lambda l: contains(l, ':') AND length(l) - length(replace(l, '?', '')) >= 2))",
    "before_return": "split_part(text, 'return', 1)",
}


def clause(c) -> str:
    s, t = c.subject, c.test
    n = int(c.threshold) if float(c.threshold).is_integer() else c.threshold
    held = lambda m: " AND ".join(
        ([has(m, c.present)] if c.present else []) + ([f"NOT {has(m, c.missing)}"] if c.missing else [])) or "true"
    return {
        "match": lambda: has(s, c.pattern),
        "absent": lambda: f"NOT {has(s, c.pattern)}",
        "contains": lambda: f"contains({s}, {q(c.pattern)})",
        "omits": lambda: f"NOT contains({s}, {q(c.pattern)})",
        "at_least": lambda: f"{count(s, c.pattern)} >= {n}",
        "at_most": lambda: f"{count(s, c.pattern)} <= {n}",
        "chars_over": lambda: f"length({s}) > {n}",
        "reaches": lambda: f"{s} >= {n}",
        "exceeds": lambda: f"{s} > {n}",
        "some": lambda: f"len(list_filter({every(s, c.pattern)}, lambda m: {held('m')})) > 0",
        "first": lambda: f"({part(s, c.pattern)} <> '' AND {held(part(s, c.pattern))})",
        "uneven": lambda: f"{literals(s, c.pattern)} <> {literals(s, c.present)}",
    }[t]()


def condition(rule) -> str:
    parts = [clause(c) for c in rule.all_of]
    if rule.any_of:
        parts.append("(" + " OR ".join(clause(c) for c in rule.any_of) + ")")
    return " AND ".join(parts)


def rule_struct(rule) -> str:
    impact, severity, message = str(rule.impact), q(rule.severity), q(rule.message)
    if rule.measure:
        message = f"replace({message}, '{{n}}', CAST({rule.measure} AS VARCHAR))"
        if rule.cap is not None:
            impact += f" + least({rule.measure} // {rule.div}, {rule.cap})"
        if rule.step is not None:
            severity = f"CASE WHEN {rule.measure} >= {rule.step} THEN {q(rule.severity_above)} ELSE {severity} END"
    n, line = "1", "NULL"
    if rule.locate:
        before = "''" if rule.locate == "^" else f"regexp_split_to_array(text, {rx(rule.locate)})[1]"
        line = f"1 + {newlines(before)}"
    if rule.emit == "each":
        n = count(rule.all_of[0].subject, rule.all_of[0].pattern)
    return (f"{{'rule_id': {q(rule.rule_id)}, 'rule': {q(rule.category)}, 'severity': {severity}, "
            f"'score_impact': CAST({impact} AS INT), 'message': {message}, 'n': CAST({n} AS BIGINT), 'line': CAST({line} AS INT)}}")


FINDING = "job_id, path, language, rule_id, rule, severity, score_impact, message, n, line"


# Letters beyond ASCII are word characters to the rules but not to DuckDB's regular expressions.
FOLDED = "(SELECT * REPLACE (regexp_replace(text, '[À-ÖØ-öø-ÿ]', 'x', 'g') AS text) FROM files)"


def rules_sql(rules, files=FOLDED) -> str:
    """SELECT of FINDING rows of the rules, n counting equal findings of a file."""
    out = []
    for language, group in by_language(rules).items():
        used = {c.subject for r in group for c in (*r.all_of, *r.any_of)} | {r.measure for r in group}
        if "comment_share" in used:
            used |= {"comment_lines", "line_count"}
        if "layout_systems" in used:
            used.add("css_text")
        late = {"comment_share", "layout_systems"}
        first = [n for n in FEATURES if n in used and n not in late]
        second = [n for n in FEATURES if n in used and n in late]
        cols = "".join(f", {FEATURES[n]} AS {n}" for n in first)
        more = "".join(f", {FEATURES[n]} AS {n}" for n in second)
        hits = ",\n".join(f"CASE WHEN {condition(r)} THEN {rule_struct(r)} END" for r in group)
        out.append(f"""SELECT job_id, path, language, h.* FROM (
  SELECT job_id, path, language, unnest(list_filter([{hits}], lambda x: x IS NOT NULL)) AS h FROM (
    SELECT *{more} FROM (SELECT *{cols} FROM {files} WHERE language = '{language}')))""")
    return "\nUNION ALL\n".join(out)


def fire(spec, source, where="true", /, severity=None, impact=None, at="NULL", **values) -> str:
    """SELECT of FINDING rows of a check over rows with job_id, path and language; equal rows are counted."""
    message = q(spec.message)
    for name, expr in values.items():
        message = f"replace({message}, '{{{name}}}', CAST({expr} AS VARCHAR))"
    return (f"SELECT job_id, path, language, {q(spec.rule_id)} AS rule_id, {q(spec.category)} AS rule, "
            f"{severity or q(spec.severity)} AS severity, CAST({impact or spec.impact} AS INT) AS score_impact, "
            f"{message} AS message, CAST(1 AS BIGINT) AS n, CAST({at} AS INT) AS line FROM {source} WHERE {where}")


def counted(*selects) -> str:
    """Findings with equal rows summed: what a pack query returns."""
    union = "\nUNION ALL\n".join(selects)
    return (f"SELECT path, rule_id, rule, severity, score_impact, message, CAST(sum(n) AS BIGINT) AS n "
            f"FROM ({union}) GROUP BY ALL")


SNIPPET = r"trim(string_split(text, chr(10))[line], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS snippet"


def located(*selects, once=False) -> str:
    """Findings with their lines and the texts there, equal rows summed. once: those told alike count once, the first rule
    id standing for all."""
    union = "\nUNION ALL\n".join(selects)
    if once:
        union = (f"SELECT path, arg_min(rule_id, rule_id) AS rule_id, arg_min(rule, rule_id) AS rule, severity, "
                 f"arg_min(score_impact, rule_id) AS score_impact, message, 1 AS n, line FROM ({union}) GROUP BY path, severity, message, line")
    return (f"SELECT path, rule_id, rule, severity, score_impact, message, line, {SNIPPET}, CAST(sum(n) AS BIGINT) AS n "
            f"FROM ({union}) JOIN (SELECT path, text FROM files) USING (path) GROUP BY ALL")


# A larger query sets this to have the packs inside it read one corpus.
forced_corpus: list = []


def with_corpus(names, body, *ctes, recursive=False) -> str:
    names = forced_corpus[-1] if forced_corpus else names
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join([corpus_sql(*names), *ctes]) + "\n" + body


# Event tables -------------------------------------------------------------------------------------------------

def unnested(array, pos, item, source="files", keep="job_id, path, language") -> str:
    """SELECT of one row per list element with its 1-based position."""
    return (f"SELECT {keep}, u.i AS {pos}, u.x AS {item} FROM (SELECT {keep}, unnest(list_transform({array}, "
            f"lambda v, k: {{'x': v, 'i': CAST(k AS INT)}})) AS u FROM {source})")


LINES = f"""lines AS MATERIALIZED (SELECT *, CAST(length(line) - length(regexp_replace(line, '^[ \\t]+', '')) AS INT) AS indent FROM (
{unnested(lines_of('text'), 'line_no', 'line', "files WHERE text <> ''")}))"""

PY_OPEN = "length(translate(line, ')]}', '')) - length(translate(line, '([{', ''))"
PY_LINES = f"""py_physical AS (SELECT *, CAST(length(line) - length(regexp_replace(line, '^[ \\t]+', '')) AS INT) AS indent, {has('line', ev.PY_STARTS)} AS starts,
  {has('line', ev.CONTINUED)} AS goes FROM ({unnested(lines_of('code'), 'line_no', 'line', f"(SELECT job_id, path, language, {PY_CODE} AS code FROM files WHERE language = 'python') WHERE code <> ''")})),
py_parts AS (SELECT *, sum(starts::INT) OVER (PARTITION BY path ORDER BY line_no) AS part, lag(goes, 1, false) OVER (PARTITION BY path ORDER BY line_no) AS behind FROM py_physical),
py_sums AS (SELECT *, sum({PY_OPEN}) OVER (PARTITION BY path, part ORDER BY line_no) AS run FROM py_parts),
py_depths AS (SELECT *, run - least(0, min(run) OVER (PARTITION BY path, part ORDER BY line_no)) AS depth FROM py_sums),
py_groups AS (SELECT *, sum(CASE WHEN NOT starts AND (behind OR coalesce(before, 0) > 0) THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY line_no) AS g
  FROM (SELECT *, lag(depth) OVER (PARTITION BY path, part ORDER BY line_no) AS before FROM py_depths)),
py_lines AS MATERIALIZED (SELECT job_id, path, language, min(line_no) AS line_no, arg_min(indent, line_no) AS indent,
  string_agg(regexp_replace(line, {q(ev.CONTINUED)}, ''), ' ' ORDER BY line_no) AS line FROM py_groups GROUP BY job_id, path, language, g)"""

TAG = r"(?s)^<\s*(/?)\s*([a-zA-Z](?:[\w:-]*\w)?)"
VOID = "('area','base','br','col','embed','hr','img','input','link','meta','source','track','wbr','param')"
TAGS = f"""tags AS MATERIALIZED (SELECT job_id, path, language, CAST(row_number() OVER (PARTITION BY path ORDER BY p) AS INT) AS pos,
  lower({part('raw', TAG, 2)}) AS tag, {part('raw', TAG, 1)} = '/' AS is_close,
  right(raw, 2) = '/>' OR lower({part('raw', TAG, 2)}) IN {VOID} AS is_void, raw
  FROM ({unnested(every('text', r'(?s)<!--.*?-->|<[^>]+>'), 'p', 'raw', "files WHERE language = 'html'")}) WHERE {has('raw', TAG)})"""

SHEETS = (f"sheets AS MATERIALIZED (SELECT job_id, path, language, CASE WHEN language = 'html' THEN {PAGE_CSS} ELSE text END AS css "
          "FROM files WHERE language IN ('html', 'css'))")
BARE = lambda s: f"regexp_replace({s}, {rx('(' + sh.STRINGS + ')|' + sh.COMMENT)}, '\\1', 'g')"
OWN = lambda s: f"array_to_string(list_filter({every(s, sh.PART)}, lambda x: right(x, 1) = ';'), '')"
BEFORE = "PARTITION BY path ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
# The pieces between braces with their level; a block is a piece that opens it and what stands one level deeper up to its end.
CSS_RULES = f"""cut AS (SELECT *, CASE WHEN right(p, 1) IN ('{{', '}}') THEN right(p, 1) ELSE '' END AS brace
  FROM ({unnested(every('css', sh.PIECE), 'place', 'p', 'sheets')})),
summed AS (SELECT job_id, path, language, place, brace, left(p, length(p) - length(brace)) AS t,
  CAST(1 + coalesce(sum({newlines('p')}) OVER ({BEFORE}), 0) AS INT) AS line,
  coalesce(sum(CASE brace WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER ({BEFORE}), 0) AS run FROM cut),
pieces AS MATERIALIZED (SELECT *, run - least(0, min(run) OVER (PARTITION BY path ORDER BY place ROWS UNBOUNDED PRECEDING)) AS level FROM summed),
opened AS MATERIALIZED (SELECT *, {squeeze(BARE('raw'))} AS head, CAST(line + {newlines('own')} + {newlines(part('raw', sh.LEAD))} AS INT) AS head_line FROM (
  SELECT *, substr(t, length(own) + 1) AS raw FROM (
    SELECT o.*, {OWN('t')} AS own, (SELECT min(c.place) FROM pieces c WHERE c.path = o.path AND c.brace = '}}' AND c.level = o.level + 1 AND c.place > o.place) AS stop
    FROM pieces o WHERE brace = '{{'))),
blocks AS MATERIALIZED (SELECT o.*,
  coalesce((SELECT string_agg(c.head, ' / ' ORDER BY c.place) FROM opened c WHERE c.path = o.path AND c.place < o.place AND (c.stop IS NULL OR c.stop > o.place)), '') AS context,
  NOT EXISTS (SELECT 1 FROM opened c WHERE c.path = o.path AND c.place > o.place AND (o.stop IS NULL OR c.place < o.stop)) AS leaf FROM opened o),
parts AS MATERIALIZED (SELECT r.*, p.place AS part_at, p.line AS part_line, CASE WHEN p.brace = '{{' THEN {OWN('p.t')} ELSE p.t END AS part FROM (
    SELECT job_id, path, language, place, level, stop, head AS selector, head_line AS line, context, CAST(row_number() OVER (PARTITION BY path ORDER BY place) AS INT) AS rule_no
    FROM blocks WHERE NOT {has('head', sh.NESTING)} AND (leaf OR NOT starts_with(head, '@'))) r
  LEFT JOIN pieces p ON p.path = r.path AND p.level = r.level + 1 AND p.place > r.place AND (r.stop IS NULL OR p.place <= r.stop)),
css_rules AS MATERIALIZED (SELECT job_id, path, language, rule_no, selector, line, context, coalesce(string_agg({BARE('part')}, '' ORDER BY part_at), '') AS body
  FROM parts GROUP BY ALL)"""
DECL = r"(?s)^\s*([-\w]+)\s*:\s*(.*\S)\s*$"
BANG = r"(?i)\s*!\s*important\s*$"
DECLS = f"""decls AS MATERIALIZED (SELECT job_id, path, language, rule_no, selector, context, rule_line, line,
  CAST(row_number() OVER (PARTITION BY path, rule_no ORDER BY part_at, i) AS INT) AS decl_no, prop, raw,
  lower(regexp_replace(raw, '{BANG}', '')) AS value, {has('raw', BANG)} AS important FROM (
  SELECT *, lower({part('d', DECL, 1)}) AS prop, {squeeze(part('d', DECL, 2))} AS raw FROM (
    SELECT *, regexp_replace({BARE('x')}, ';$', '') AS d, CAST(part_line + {newlines(part('x', sh.LEAD))} + coalesce(sum({newlines('x')}) OVER (
      PARTITION BY path, rule_no, part_at ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS line FROM (
    {unnested(every('part', sh.PART), 'i', 'x', 'parts', 'job_id, path, language, rule_no, selector, context, line AS rule_line, part_at, part_line').replace('SELECT job_id, path, language, rule_no, selector, context, line AS rule_line, part_at, part_line, u.i', 'SELECT job_id, path, language, rule_no, selector, context, rule_line, part_at, part_line, u.i')}))
  WHERE {has('d', DECL)}))"""
TOKEN = r"(?:[#.][\w-]+|\[[^\]]+\]|::?[\w-]+|[a-zA-Z][\w-]*)"
SELECTORS = f"""weights AS MATERIALIZED (SELECT *, CAST({count('selector', r'#[\w-]+')} AS INT) AS ids,
  CAST({count('selector', r'[.][\w-]+|[[][^]]+[]]|:[\w-]+')} AS INT) AS classes,
  CAST(len(list_filter({every('selector', TOKEN)}, lambda t: NOT {has('t', r'^[#.[:]')})) AS INT) AS elements,
  CAST({count('selector', r'\s+|>|[+]|~')} AS INT) AS combinators,
  CAST({count(sub(sub('selector', r'\[[^\]]*\]'), r'\([^)]*\)'), r'\s+|[>+~]')} AS INT) AS depth
  FROM (SELECT job_id, path, language, rule_no, list, context, line, unnest(list_filter(regexp_split_to_array(list, '\\s*,\\s*'), lambda s: s <> '')) AS selector
        FROM (SELECT *, selector AS list FROM css_rules)))"""
