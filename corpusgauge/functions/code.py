"""Source-text helpers: stripping comments and strings, language marks, manifest version specs."""

from pyspark.sql import Column, functions as F

from .text import col, count_regex, matches, replace_regex

# File extensions and their languages.
EXTENSIONS = {
    ".py": "python",
    ".html": "html",
    ".htm": "html",
    ".css": "css",
    ".js": "javascript",
    ".jsx": "react",
    ".tsx": "react",
    ".mjs": "javascript",
    ".mongo": "mongodb",
    ".mongodb": "mongodb",
    ".json": "mongodb",
}

# Marks of React text and of MongoDB text.
REACT_IMPORT = (
    r"""(?m)^\s*(?:import\s+.*\bfrom\s+['"]react['"]|import\s+['"]react['"]"""
    r"""|(?:const|let|var)\s+.*=\s*require\(['"]react['"]\))"""
)
REACT_RUNTIME = r"\b(?:jsx|jsxs|jsxDEV|Fragment)\b|\b(?:React\.createElement|createRoot|hydrateRoot)\b"
REACT_HOOK = (
    r"\buse(?:State|Effect|Memo|Callback|Ref|Reducer|Context|LayoutEffect"
    r"|ImperativeHandle|Transition|DeferredValue|Id)\b"
)
REACT_FRAGMENT = r"<>|</>"
REACT_TAG = r"<[A-Za-z][A-Za-z0-9_]*\b[^>]*>"
REACT_RETURN = r"\breturn\s*\("
MONGO_WORDS = (
    "$match", "$group", "db.", "collection", "aggregate", "find(", "insertOne", "updateOne", "createIndex",
)

# Possessive repetitions (`*+`) run as loops: a string of many escapes must not exhaust a task's stack.
BLOCK_COMMENT = r"/\*[\s\S]*?\*/"
LINE_COMMENT = r"//[^\n]*"
HASH_COMMENT = r"#[^\n]*"
SINGLE = r"'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'"
DOUBLE = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"'
BACKTICK = r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"
TRIPLE = r'"""[\s\S]*?"""' + r"|'''[\s\S]*?'''"

BLANKED = "|".join([LINE_COMMENT, BLOCK_COMMENT, SINGLE, DOUBLE, BACKTICK])
PY_BLANKED = "|".join([HASH_COMMENT, TRIPLE, SINGLE, DOUBLE])

# The same matches; a character that starts none of them is passed with one look.
BLANKED_SEARCH = r"""(?=[/'"`])(?:%s)""" % BLANKED
PY_BLANKED_SEARCH = r"""(?=[#'"])(?:%s)""" % PY_BLANKED


def blank_code(text) -> Column:
    """Comments, strings and template literals of brace languages become one blank, in one pass."""
    return replace_regex(text, BLANKED_SEARCH, " ")


def blank_python(text) -> Column:
    """Comments and strings of Python text become one blank."""
    return replace_regex(text, PY_BLANKED_SEARCH, " ")


def strip_code(text) -> Column:
    """Drop comments, keep the quotes of emptied strings."""
    out = replace_regex(text, BLOCK_COMMENT, "")
    out = replace_regex(out, LINE_COMMENT, "")
    out = replace_regex(out, SINGLE, "''")
    out = replace_regex(out, DOUBLE, '""')
    return replace_regex(out, BACKTICK, "``")


def looks_like_react(text, compat: bool = False) -> Column:
    """Hooks, runtime names, fragments, two tags, or a tag with `return (`.

    Imports are looked for in the raw text; `compat` looks for them after strings are blanked.
    """
    text = col(text)
    code = blank_code(text)
    tags = count_regex(code, REACT_TAG)
    return (
        matches(code if compat else text, REACT_IMPORT)
        | matches(code, REACT_RUNTIME)
        | matches(code, REACT_HOOK)
        | matches(code, REACT_FRAGMENT)
        | (tags >= 2)
        | ((tags >= 1) & matches(code, REACT_RETURN))
    )


def looks_like_mongo(text) -> Column:
    text = col(text)
    out = F.lit(False)
    for word in MONGO_WORDS:
        out = out | text.contains(word)
    return out


def file_ext(path) -> Column:
    """Lower-case last suffix with its dot; dotfiles have none."""
    return F.lower(F.regexp_extract(col(path), r"[^/](\.[^./]+)$", 1))


def normalize_path(path) -> Column:
    return F.translate(col(path), "\\", "/")


def relative_path(path, root: str) -> Column:
    """Path below the root, with forward slashes."""
    path = normalize_path(path)
    root = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path)


# How manifest version specs are read.
UNPINNED = ("*", "latest")
NON_REGISTRY = r"^(?:file:|link:|git\+|github:|http://|https://)"
ZERO_MAJOR = r"^(?:0\.|\^0\.|~0\.)"
RANGE = r"[<>]=?"


def version_risk(spec) -> Column:
    """Risks of a version spec: unpinned or non_registry alone, else zero_major and range."""
    v = F.trim(col(spec))
    return (
        F.when(v.isin(*UNPINNED), F.array(F.lit("unpinned")))
        .when(v.rlike(NON_REGISTRY), F.array(F.lit("non_registry")))
        .otherwise(F.array_compact(F.array(
            F.when(v.rlike(ZERO_MAJOR), "zero_major"), F.when(v.rlike(RANGE), "range"))))
    )
