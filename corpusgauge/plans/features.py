"""Values derived once per file and read by several rules."""

from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import Callable

from pyspark.sql import Column, functions as F

from ..functions import events as ev, sheets
from ..functions.code import blank_code, blank_python, strip_code
from ..functions.text import (
    LINE_END, count_regex, count_substr, count_substrs, extract_all, line_count, lines_over, matches, regex,
)

# Blocks of a page.
SCRIPT = r"(?is)<script\b[^>]*>(.*?)</script>"
SCRIPT_TAG = r"(?is)(<script\b[^>]*>).*?</script>"
STYLE = r"(?is)<style\b[^>]*>(.*?)</style>"
STYLE_ATTR = r"""(?is)\sstyle\s*=\s*(?:"[^"]*"|'[^']*')"""

# Layout systems mixed in one page.
LAYOUTS = (
    r"(?i)\bfloat\s*:",
    r"(?i)\bdisplay\s*:\s*flex\b|\bflex-(?:direction|wrap|grow|shrink|basis)\s*:",
    r"(?i)\bdisplay\s*:\s*grid\b|\bgrid-(?:template|auto|area|column|row)\s*:",
    r"(?i)\bposition\s*:\s*absolute\b",
)

# Literals counted in query code.
STAGES = (
    "$match", "$group", "$sort", "$lookup", "$unwind", "$project", "$addFields", "$set", "$limit", "$skip",
    "$facet", "$count", "$replaceRoot", "$replaceWith", "$bucket", "$bucketAuto", "$graphLookup", "$setWindowFields",
)
QUERY_CALLS = ("find(", "aggregate(", "update(", "delete(", ".find(", ".aggregate(")
BRANCHES = ("if ", "elif ", "else:", "switch", "case ")
MARKERS = ("TODO", "FIXME", "HACK", "XXX", "TEMP", "temporary", "workaround", "compatibility")
MAGIC_NUMBERS = (
    r"(?=\d)(?<![\w.])\d{3,}(?![\w.])",
    r"(?=\d)(?<![\w.])\d+\.\d+(?![\w.])",
    r"(?i)(?=\d)(?<![\w.])\d+\s*ms\b",
    r"(?i)(?=\d)(?<![\w.])\d+\s*s\b",
)
COMMENT_LINE = r"(?m)^[^\S\n]*(?:#|//|/\*|\*)"
TODO = ("TODO", "FIXME", "HACK", "XXX", "TEMP")
TODO_WORDS = r"\b(?:%s)\b" % "|".join(TODO)
TRAILING = r"(?m)(?<![ \t])[ \t]++$"
COMMENTED_CODE = (
    r"(?m)^\s*#\s*(?:if|for|while|def|class|return|import|from|try|except|with|else|elif|switch|case)\b"
)

# Names, classes and addresses in pages.
ID = r"""(?i)\bid\s*=\s*["']([^"']+)["']"""
ID_OR_CLASS = r"""(?i)\b(?:id|class)\s*=\s*["']([^"']+)["']"""
URL = r"""(?i)https?://[^\s"'>)]+"""


@dataclass(frozen=True)
class Feature:
    column: Callable[[], Column]
    needs: tuple = ()


def _matches_of(pattern, held) -> Column:
    """All matches of a pattern; a page that doesn't hold its literal has none."""
    none = F.array().cast("array<string>")
    return F.when(~F.col(f"`{held}`"), none).otherwise(extract_all("text", pattern))


def _parts(blocks, pattern) -> Column:
    """The first group of blocks that the same pattern, or one that begins alike, has found."""
    return F.transform(blocks, lambda b: F.regexp_extract(b, regex(pattern), 1))


def _chars(texts) -> Column:
    return F.aggregate(texts, F.lit(0), lambda n, b: n + F.length(b))


def _unquoted(attributes) -> Column:
    return F.transform(
        attributes, lambda a: F.regexp_replace(F.regexp_replace(a, r"""(?is)^\sstyle\s*=\s*["']""", ""), r"""["']$""", ""))


def style_attribute_bodies(text="text") -> Column:
    """Values of all style attributes, without their quotes."""
    return _unquoted(extract_all(text, STYLE_ATTR))


def page_css(text="text") -> Column:
    return F.array_join(F.concat(extract_all(text, STYLE, 1), style_attribute_bodies(text)), "\n")


def _ternary_lines() -> Column:
    return F.size(F.filter(F.split("text", "\n"), lambda l: l.contains(":") & l.rlike(r"\?.*\?")))


FEATURES: dict[str, Feature] = {
    "lower_text": Feature(lambda: F.lower("text")),
    "file_name": Feature(lambda: F.lower(F.substring_index("path", "/", -1))),
    "line_count": Feature(lambda: line_count("text")),
    "newlines": Feature(lambda: count_substr("text", "\n") + (F.col("text") != "").cast("int")),
    # Blocks of a page are looked for once; what rules read of them comes from the blocks.
    "script_pieces": Feature(lambda: _matches_of(SCRIPT, "lower_text holds <script"), ("lower_text holds <script",)),
    "style_pieces": Feature(lambda: _matches_of(STYLE, "lower_text holds <style"), ("lower_text holds <style",)),
    "style_attribute_pieces": Feature(lambda: _matches_of(STYLE_ATTR, "lower_text holds style"), ("lower_text holds style",)),
    "script_text": Feature(lambda: F.array_join(_parts("script_pieces", SCRIPT), "\n"), ("script_pieces",)),
    "script_tags": Feature(lambda: F.array_join(_parts("script_pieces", SCRIPT_TAG), "\n"), ("script_pieces",)),
    "script_blocks": Feature(lambda: F.array_size("script_pieces"), ("script_pieces",)),
    "style_text": Feature(lambda: F.array_join(_parts("style_pieces", STYLE), "\n"), ("style_pieces",)),
    "style_blocks": Feature(lambda: F.array_size("style_pieces"), ("style_pieces",)),
    "style_chars": Feature(lambda: _chars(_parts("style_pieces", STYLE)), ("style_pieces",)),
    "style_attributes": Feature(lambda: F.array_size("style_attribute_pieces"), ("style_attribute_pieces",)),
    "inline_chars": Feature(
        lambda: _chars(F.col("script_pieces")) + _chars(F.col("style_pieces")), ("script_pieces", "style_pieces")),
    "css_text": Feature(
        lambda: F.array_join(F.concat(_parts("style_pieces", STYLE), _unquoted("style_attribute_pieces")), "\n"),
        ("style_pieces", "style_attribute_pieces")),
    "layout_systems": Feature(
        lambda: sum((matches("css_text", p).cast("int") for p in LAYOUTS), F.lit(0)), ("css_text",)),
    "code": Feature(lambda: strip_code("text")),
    "blanked": Feature(lambda: blank_code("text")),
    "py_code": Feature(lambda: blank_python("text")),
    "stages": Feature(lambda: count_substrs("text", STAGES)),
    "query_calls": Feature(lambda: count_substrs("text", QUERY_CALLS)),
    "branches": Feature(lambda: count_substrs("lower_text", BRANCHES), ("lower_text",)),
    "markers": Feature(lambda: count_substrs("text", MARKERS)),
    "magic_numbers": Feature(lambda: sum((count_regex("text", p) for p in MAGIC_NUMBERS), F.lit(0))),
    "lines_over_120": Feature(lambda: lines_over("text", 120)),
    "comment_lines": Feature(lambda: count_regex("text", COMMENT_LINE)),
    "comment_share": Feature(
        lambda: F.when(F.col("line_count") > 0, F.col("comment_lines") / F.col("line_count")).otherwise(0.0),
        ("comment_lines", "line_count")),
    "todo_words": Feature(lambda: F.when(
        ~reduce(or_, [F.col("text").contains(w) for w in TODO]), 0).otherwise(count_regex("text", TODO_WORDS))),
    "tabs": Feature(lambda: count_substrs("text", ("\t",))),
    "trailing_blanks": Feature(lambda: count_regex("text", TRAILING)),
    "commented_code": Feature(lambda: count_regex("text", COMMENTED_CODE)),
    "ternary_lines": Feature(_ternary_lines),
    "before_return": Feature(lambda: F.substring_index("text", "return", 1)),
    # Events of a file that several checks read.
    "tags": Feature(lambda: ev.tag_array("text")),
    "walk": Feature(lambda: ev.stack_walk("tags"), ("tags",)),
    "div_depth": Feature(lambda: ev.tag_depth("tags"), ("tags",)),
    "id_repeats": Feature(lambda: ev.repeated(extract_all("text", ID, 1), 2)),
    "url_repeats": Feature(lambda: ev.repeated(extract_all("text", URL), 3)),
    "line_repeats": Feature(lambda: ev.repeated(ev.trimmed_lines("text", 12), 4)),
    "script_line_repeats": Feature(lambda: ev.repeated(ev.trimmed_lines("script_text", 20), 4), ("script_text",)),
    "page_names": Feature(lambda: F.flatten(F.transform(
        extract_all("text", ID_OR_CLASS, 1), lambda names: F.split(names, r"\s+")))),
    "page_rules": Feature(lambda: sheets.rule_array("css_text"), ("css_text",)),
    "page_weights": Feature(lambda: sheets.selector_array("page_rules"), ("page_rules",)),
    "sheet_rules": Feature(lambda: sheets.rule_array("text")),
    "sheet_declarations": Feature(lambda: F.flatten(F.transform("sheet_rules", lambda r: F.transform(
        r["d"], lambda d: F.struct(
            F.lower(r["selector"]).alias("selector"), *[d[n].alias(n) for n in ("prop", "value", "important", "line")])))),
        ("sheet_rules",)),
    "class_lists": Feature(lambda: F.transform(ev.class_list_array("text"), lambda l: F.struct(
        l["value"].alias("value"), l["tokens"].alias("tokens"), l["line"].alias("line"),
        F.transform(l["tokens"], lambda t: ev.parsed_token(t)).alias("parts")))),
    "text_lines": Feature(lambda: F.split("text", LINE_END)),
    "lines": Feature(lambda: ev.line_array("text")),
    "py_lines": Feature(lambda: ev.statement_array("py_code"), ("py_code",)),
    "loop_lines": Feature(lambda: ev.lines_within(F.col("py_lines"), ev.LOOP), ("py_lines",)),
    "async_lines": Feature(lambda: ev.lines_within(F.col("py_lines"), ev.ASYNC), ("py_lines",)),
    "manifest": Feature(lambda: F.when(F.col("file_name") == "package.json", ev.manifest()), ("file_name",)),
    "dependencies": Feature(
        lambda: F.when(F.col("manifest._bad").isNull(), ev.dependency_array(F.col("manifest"))), ("manifest",)),
    "hooks": Feature(lambda: ev.hook_array("text")),
    "watched": Feature(lambda: ev.watched_names("text")),
    "stale": Feature(lambda: ev.stale_update_array("text")),
    "jsx": Feature(lambda: ev.jsx_array("text")),
}

# Literals that several rules of a language look for, alone or within longer ones. Each is looked for once.
SOUGHT = {
    "lower_text": (
        "secret", "token", "passw", "key", "api", "print", "logg", "<script", "<div", "<span", "<img", "<style", "style", "role",
        "innerhtml", "outerhtml", "insertadjacenthtml", "find", "aggregate", "update", "delete", "index", ".limit", "$regex"),
    "text": (
        "useState", "props.", "style", "true", "false", "async", "setInterval", "innerHTML", "outerHTML", "insertAdjacentHTML",
        "document.write", "import", "except"),
}


def sought(subject: str, needle: str) -> list[str]:
    """The features that tell whether a subject holds the parts of a literal that are looked for once."""
    return [f"{subject} holds {word}" for word in SOUGHT.get(subject, ()) if word in needle]


def _holds(subject, word):
    return Feature(lambda: F.col(subject).contains(word), (subject,) if subject in FEATURES else ())


FEATURES |= {f"{subject} holds {word}": _holds(subject, word) for subject, words in SOUGHT.items() for word in words}
