"""Text to event tables: lines, tags, attributes, blocks, declarations, class tokens, symbols.

Event rows carry the file key and their own piece of text, never the whole text.
"""

from pyspark.sql import DataFrame, functions as F

from ..functions import events as ev, sheets as sh
from ..functions.events import JS_NAME, PY_NAME
from ..functions.text import extract_all
from ..functions.utility import bracket_surplus, utility_parts
from ..plans.features import SCRIPT, SCRIPT_TAG, STYLE, page_css, style_attribute_bodies

KEY = ["job_id", "path", "language"]


def lines(files: DataFrame, text="text") -> DataFrame:
    """Rows (line_no, line, indent)."""
    return files.select(*KEY, F.inline(ev.line_array(text)))


def tag_events(files: DataFrame, skip_scripts: bool = False) -> DataFrame:
    """Rows (pos, tag, is_close, is_void, raw)."""
    return files.select(*KEY, F.inline(ev.tag_array("text", skip_scripts)))


ATTRIBUTE = r"""([a-zA-Z_:@][\w:.-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def attributes(events: DataFrame) -> DataFrame:
    """Rows (pos, tag, attr_no, attr, value) of opening tags."""
    opened = events.where(~F.col("is_close") & F.col("raw").contains("="))
    rows = opened.select(*KEY, "pos", "tag", F.posexplode(extract_all("raw", ATTRIBUTE)).alias("attr_no", "pair"))
    value = F.regexp_replace("pair", r"^[^=]*=\s*", "")
    bare = F.when(value.rlike("""^["']"""), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    return rows.select(
        *KEY, "pos", "tag", (F.col("attr_no") + 1).alias("attr_no"),
        F.lower(F.regexp_extract("pair", ATTRIBUTE, 1)).alias("attr"), bare.alias("value"))


def embedded_blocks(files: DataFrame) -> DataFrame:
    """Rows (kind, block_no, attrs, body) of script blocks, style blocks and style attributes."""
    def kind(name, bodies, tags=None):
        tags = tags if tags is not None else F.transform(bodies, lambda b: F.lit(""))
        return F.transform(
            F.arrays_zip(tags.alias("a"), bodies.alias("b")),
            lambda z, i: F.struct(
                F.lit(name).alias("kind"), (i + 1).alias("block_no"),
                F.regexp_replace(z["a"], r"(?i)^<\w+\s*|>$", "").alias("attrs"), z["b"].alias("body")))

    blocks = F.concat(
        kind("script", extract_all("text", SCRIPT, 1), extract_all("text", SCRIPT_TAG, 1)),
        kind("style", extract_all("text", STYLE, 1), extract_all("text", r"(?is)(<style\b[^>]*>).*?</style>", 1)),
        kind("style-attr", style_attribute_bodies("text")),
    )
    return files.select(*KEY, F.inline(blocks))


def css_source(files: DataFrame) -> DataFrame:
    """Sheets as they are, pages by their style blocks and attributes (column css)."""
    css = F.when(F.col("language") == "html", page_css("text")).otherwise(F.col("text"))
    return files.select(*KEY, css.alias("css"))


def css_rules(sheets: DataFrame, css: str = "css") -> DataFrame:
    """Rows (rule_no, selector, body, d, line, context); d holds the declarations, context the heads of the blocks around."""
    return sheets.select(*KEY, F.inline(sh.rule_array(css)))


def css_declarations(sheets: DataFrame, css: str = "css") -> DataFrame:
    """Rows (rule_no, selector, context, decl_no, prop, raw, value, important, line)."""
    return css_rules(sheets, css).select(*KEY, "rule_no", "selector", "context", F.inline("d"))


def selectors(rules: DataFrame) -> DataFrame:
    """One row per comma-separated selector with its weight."""
    one = F.array(F.struct("rule_no", "selector"))
    return rules.select(*KEY, F.inline(sh.selector_array(one)))


def class_lists(files: DataFrame) -> DataFrame:
    """Rows (element_no, value, tokens, line) of class attributes."""
    return files.select(*KEY, F.inline(ev.class_list_array("text")))


def class_tokens(files: DataFrame) -> DataFrame:
    """Rows (element_no, token_no, token, surplus, important, variants, base, utility_group)."""
    rows = class_lists(files).select(*KEY, "element_no", F.posexplode("tokens").alias("n", "token"))
    return rows.withColumn("u", utility_parts("token")).select(
        *KEY, "element_no", (F.col("n") + 1).alias("token_no"), "token",
        bracket_surplus("token").alias("surplus"), "u.*")


def js_declarations(files: DataFrame) -> DataFrame:
    """First declaration of every name: (name, kind, line_no)."""
    pattern = r"\b(?:(?:let|const|var)\s+%s|function\s+%s\s*\()" % (JS_NAME, JS_NAME)
    rows = lines(files).select(*KEY, "line_no", F.posexplode(extract_all("line", pattern)).alias("at", "d"))
    kind = F.regexp_extract("d", r"^(\w+)", 1)
    name = F.regexp_extract("d", r"^\w+\s+(%s)" % JS_NAME, 1)
    # Within a line, variables come before functions.
    order = F.struct(F.col("line_no"), (kind == "function").alias("late"), F.col("at"))
    return (
        rows.select(*KEY, name.alias("name"), kind.alias("kind"), "line_no", order.alias("o"))
        .groupBy(*KEY, "name").agg(F.min_by("kind", "o").alias("kind"), F.min("line_no").alias("line_no"))
    )


def js_names(files: DataFrame) -> DataFrame:
    """Names a line mentions, member names excluded: first line of each (name, line_no)."""
    found = extract_all("line", r"(?:^|[^.\w$])(%s)" % JS_NAME, 1)
    rows = lines(files).select(*KEY, "line_no", F.explode(F.array_distinct(found)).alias("name"))
    return rows.groupBy(*KEY, "name").agg(F.min("line_no").alias("line_no"))


def jsx_tags(files: DataFrame) -> DataFrame:
    """Rows (pos, tag, attrs) of component and element tags."""
    return files.select(*KEY, F.inline(ev.jsx_array("text")))


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """Rows (section, package, spec) of package.json files that are JSON."""
    name = F.lower(F.substring_index("path", "/", -1))
    rows = files.where(name == "package.json").select(*KEY, ev.manifest().alias("m"))
    return rows.where("m._bad is null").select(*KEY, F.inline(ev.dependency_array(F.col("m"))))


def py_lines(files: DataFrame) -> DataFrame:
    """Logical lines of Python text with comments and strings blanked."""
    return files.select(*KEY, F.inline(ev.py_line_array("text")))


# Words that stand before a parenthesis without being a call.
NOT_CALLS = ("if", "while", "for", "return", "def", "class", "and", "or", "not", "in", "print_function")


def py_symbols(files: DataFrame) -> DataFrame:
    """Rows (line_no, kind, name) of imports, assignments, calls, functions and classes.

    Logical lines, not a syntax tree: tuple targets inside calls are missed.
    """
    line = F.col("line")
    targets = F.when(
        line.rlike(r"^\s*%s(?:\s*,\s*%s)*+\s*(?::[^=]+)?=[^=]" % (PY_NAME, PY_NAME)),
        extract_all(F.regexp_extract("line", r"^\s*([\w\s,]+)", 1), PY_NAME))
    calls = extract_all("line", r"(?:^|[^\w.])(%s(?:\.%s)*+)\s*\(" % (PY_NAME, PY_NAME), 1)
    functions = extract_all("line", r"^\s*(?:async\s+)?def\s+(%s)" % PY_NAME, 1)
    classes = extract_all("line", r"^\s*class\s+(%s)" % PY_NAME, 1)

    def tagged(kind, names):
        return F.transform(F.coalesce(names, ev.strings()), lambda n: F.struct(
            F.lit(kind).alias("kind"), n.alias("name")))

    rows = py_lines(files).select(*KEY, "line_no", F.inline(F.concat(
        tagged("import", ev.imported_names(line)), tagged("assign", targets), tagged("call", calls),
        tagged("function", functions), tagged("class", classes))))
    return rows.where((F.col("name") != "") & ~((F.col("kind") == "call") & F.col("name").isin(*NOT_CALLS)))


def hook_segments(files: DataFrame) -> DataFrame:
    """Closed hook calls: (seg_no, hook, prefix, callback, deps, controlled); callbacks and dependencies are whole."""
    return files.select(*KEY, F.inline(ev.hook_array("text")))
