"""Rule packs for query files. Patterns, thresholds, impacts and messages are fixed values."""

from ..rules import Rule, chars_over, contains, exceeds, has, lacks, reaches

LANG = "mongodb"


def _pack(pack):
    return lambda name, severity, impact, message, *all_of, **more: Rule(
        f"mongodb.{pack}.{name}", LANG, pack, severity, impact, message, tuple(all_of), **more)


r = _pack("security")
SECURITY = [
    r("where", "high", 25, "$where can be unsafe and slow. Replace it with structured predicates.",
      has(r"(?i)\$where\b", needs="$where")),
    r("empty_find", "medium", 10, "Unfiltered find() query can expose too much data or scan large collections.",
      has(r"(?i)\.(?:find|findOne|findMany)\s*\(\s*\{\s*\}\s*\)", needs=".find")),
    r("empty_delete", "high", 22,
      "Destructive operation appears to target an empty filter. That is a serious data-loss risk.",
      has(r"(?i)\.(?:deleteOne|deleteMany|remove|removeOne)\s*\(\s*\{\s*\}\s*\)", needs=(".delete", ".remove"))),
    r("empty_update", "high", 20,
      "Update operation appears to use an empty filter. That can modify far more data than intended.",
      has(r"(?i)\.(?:updateOne|updateMany|replaceOne|update)\s*\(\s*\{\s*\}\s*,", needs=(".update", ".replaceone"))),
    r("dynamic_code", "high", 24,
      "Dynamic code execution detected. That is a major security risk in query-adjacent code.",
      has(r"(?i)\b(?:eval|Function|new\s+Function)\s*\(", needs=("eval", "function"))),
    r("regex_input", "medium", 12,
      "Regex appears to be built from user-controlled input. Sanitize or escape it before use.",
      has(r"(?is)\$regex\b.{0,120}\b(?:req|request|body|query|params|input|user|data|payload)\b", needs="$regex")),
    r("interpolation", "medium", 11,
      "String interpolation or concatenation appears near query logic. That can invite injection bugs.",
      has(r"""(?i)(\+\s*[\w.]+\s*\+|f['"]|format\s*\()""", needs=("+", "f'", 'f"', "format")),
      any_of=(contains("find("), contains("aggregate("), contains("$where"))),
]

FIND = has(r"(?i)\bfind(?:One|Many)?\s*\(", needs="find")
AGGREGATE = has(r"(?i)aggregate\s*\(\s*\[", needs="aggregate")
NO_LIMIT = lacks(r"(?i)\.limit\s*\(", needs=".limit")
NO_INDEX = lacks(r"(?i)\b(?:createIndex|create_index|ensureIndex|ensure_index|index(?:es)?)\b", needs="index")

r = _pack("performance")
PERFORMANCE = [
    r("late_match", "medium", 8,
      "Aggregation pipeline has heavy stages but no visible $match filter. Filter early to cut work.",
      AGGREGATE,
      has(r"(?i)\$(?:sort|group|lookup|unwind|facet|bucket|bucketAuto|graphLookup|setWindowFields)\b", needs="$"),
      lacks(r"(?i)\$match\b", needs="$match")),
    r("sort_index", "medium", 7, "Sort logic has no obvious index support. Unindexed sorts get expensive fast.",
      has(r"(?i)\.sort\s*\(", needs=".sort"), NO_INDEX),
    r("find_limit", "low", 4,
      "find() appears without limit(). Bound reads when possible to reduce work and response size.", FIND, NO_LIMIT),
    r("skip_limit", "medium", 6, "skip() appears without limit(). Large-offset paging is usually inefficient.",
      has(r"(?i)\.skip\s*\(", needs=".skip"), NO_LIMIT),
    r("regex_prefix", "high", 9,
      "Regex pattern appears to use a leading wildcard or broad match. That can trigger collection scans.",
      has(r"(?i)\$regex\b", needs="$regex"), has(r"""(?i)\.\*\S*|\^\.\*|\$regex\s*:\s*['"][^'"]*\.\*""")),
    r("no_index", "low", 3,
      "No indexing signal found near query logic. Repeated scans may become a bottleneck.",
      NO_INDEX, any_of=(FIND, AGGREGATE)),
    r("large_file", "medium", 3,
      "Large file detected ({n} lines). Split query logic before it becomes maintenance debt.",
      exceeds("newlines", 200), measure="newlines", div=100, cap=7, step=501, severity_above="high"),
]

QUERY = has(
    r"(?i)(?:find\(|find_one\(|findMany\(|aggregate\(|update\(|update_one\(|update_many\(|delete\(|delete_one\("
    r"|delete_many\()", needs=("find", "aggregate(", "update", "delete"))

r = _pack("maintenance")
MAINTENANCE = [
    r("no_index", "high", 9, "Query-heavy code with no obvious indexing path. This will age badly as data grows.",
      QUERY, lacks(r"(?i)(?:createIndex\(|create_index\(|ensureIndex\(|ensure_index\(|indexes|index\()",
                   needs=("index(", "indexes"))),
    r("stages", "medium", 6,
      "Aggregation pipeline is complex ({n} stage hints). Break it into smaller, named steps.",
      reaches("stages", 4), measure="stages", div=1, cap=4, step=8, severity_above="high"),
    r("large_file", "medium", 3, "Large file ({n} lines) reduces readability and increases refactor risk.",
      exceeds("line_count", 200), measure="line_count", div=100, cap=7, step=501, severity_above="high"),
    r("long_lines", "medium", 4, "Found {n} long lines. The code is harder to scan and maintain.",
      reaches("lines_over_120", 5), measure="lines_over_120", div=3, cap=5, step=15, severity_above="high"),
    r("magic_numbers", "low", 2, "Multiple hardcoded numeric literals ({n}) reduce intent clarity.",
      reaches("magic_numbers", 3), measure="magic_numbers", div=2, cap=5, step=8, severity_above="medium"),
    r("repeated_queries", "medium", 5,
      "Repeated query operations suggest duplicated data-access logic. Extract shared helpers.",
      reaches("query_calls", 6), measure="query_calls", div=3, cap=4, step=12, severity_above="high"),
    r("no_projection", "low", 3,
      "No projection/filtering hint found near queries. Returning too much data can make code noisy and fragile.",
      QUERY, lacks(r"project\(|\.only\(|\.values\(|\.select\(|\$project",
                   needs=("project", ".only(", ".values(", ".select("))),
    r("branches", "medium", 4,
      "High branching density detected ({n} branch markers). Consider smaller functions.",
      reaches("branches", 12), measure="branches", div=4, cap=6, step=25, severity_above="high"),
    r("markers", "low", 2, "Maintenance markers found ({n}). Track and eliminate them before the code fossilizes.",
      reaches("markers", 1), measure="markers", div=1, cap=6, step=4, severity_above="medium"),
    r("large_and_heavy", "high", 10,
      "This is a large, query-heavy file with elevated maintenance risk. Split domain logic, query building, "
      "and validation.",
      QUERY, exceeds("line_count", 300), chars_over(12000)),
    r("comment_density", "low", 2,
      "Comment density is high. Too many comments can indicate the code is doing too much.",
      exceeds("comment_lines", 40), exceeds("comment_share", 0.25)),
    r("unstructured", "low", 2,
      "Query logic appears unstructured. Wrapping it in explicit helpers will make future changes safer.",
      QUERY, lacks(r"def |class |async def |try:|except |with ", needs=("def ", "class ", "try:", "except ", "with "))),
]

r = _pack("style")
STYLE = [
    r("todo", "low", 2, "Found {n} TODO-style marker(s). Clean them up before the code spreads.",
      reaches("todo_words", 1), measure="todo_words", div=1, cap=6, step=4, severity_above="medium"),
    r("tabs", "low", 2, "Tabs detected ({n}). Keep indentation consistent for cleaner reviews.",
      reaches("tabs", 1), measure="tabs", div=2, cap=6, step=10, severity_above="medium"),
    r("trailing_blanks", "low", 2, "Trailing whitespace found on {n} line(s). It adds noise to diffs.",
      reaches("trailing_blanks", 1), measure="trailing_blanks", div=2, cap=5, step=5, severity_above="medium"),
    r("long_lines", "low", 3, "{n} long line(s) detected. Break dense statements for readability.",
      reaches("lines_over_120", 1), measure="lines_over_120", div=2, cap=6, step=8, severity_above="medium"),
    r("commented_code", "low", 2,
      "Commented-out code found ({n} line(s)). Remove dead code instead of parking it.",
      reaches("commented_code", 1), measure="commented_code", div=1, cap=5, step=3, severity_above="medium"),
    r("blank_runs", "low", 2,
      "Excessive blank-line runs detected. Tighten spacing so the file stays easier to scan.", has(r"\n{4,}", needs="\n\n\n\n")),
]

PACKS = {
    "mongodb.security": SECURITY,
    "mongodb.performance": PERFORMANCE,
    "mongodb.maintenance": MAINTENANCE,
    "mongodb.style": STYLE,
}
