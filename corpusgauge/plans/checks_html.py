"""Page checks that need tags, blocks, names or counts. Impacts and messages are fixed values."""

from pyspark.sql import Column, functions as F

from ..functions.text import capped_list, count_regex, extract_all, matches, regex
from .checks import RowCheck, Spec, each, once

C = F.col

OUT_OF_ORDER = Spec("html.structure.out_of_order", "structure", "medium", 10,
                    "Tag <{tag}> closes out of order or invalid nesting is likely present.")
UNEXPECTED = Spec("html.structure.unexpected_close", "structure", "medium", 10, "Unexpected closing tag </{tag}> found.")
INVALID_CHILD = Spec("html.structure.invalid_child", "structure", "medium", 10,
                     "Invalid child <{tag}> inside <p> can break layout and semantics.")
UNCLOSED = Spec("html.structure.unclosed", "structure", "high", 14, "Unclosed tags detected: {tags}.")
DUPLICATE_ID = Spec("html.structure.duplicate_id", "structure", "high", 18, "Duplicate id values found: {ids}.")
DEEP = Spec("html.structure.deep_nesting", "structure", "medium", 8,
            "Deep div nesting detected (depth {n}). This usually signals layout soup.")
REPEATED_URL = Spec("html.structure.repeated_url", "structure", "low", 4,
                    "Repeated hardcoded URLs suggest duplicated content instead of reuse.")
REPEATED_LINE = Spec("html.structure.repeated_block", "structure", "low", 4,
                     "Repeated hardcoded blocks appear throughout the page.")
DUPLICATE_BODY = Spec("html.style.duplicate_body", "style", "medium", 8, "Duplicate CSS rule bodies were found.")
REPEATED_DECL = Spec(
    "html.style.repeated_declaration", "style", "low", 4,
    "Repeated CSS property/value pairs suggest missing variables or shared utility classes.")
COMPLEX = Spec("html.style.complex_selector", "style", "medium", 8,
               "Overly specific selectors make overrides and refactors brittle.")
DEAD = Spec("html.style.dead_selector", "style", "low", 4,
            "Some CSS selectors do not appear to match any HTML ids/classes in this file.")
GLOBALS = Spec("html.script.globals", "script", "medium", 8, "Global state is leaking onto the page: {names}.")
REPEATED_JS = Spec("html.script.repeated_statement", "script", "low", 4,
                   "Repeated JavaScript statements suggest missing helper functions.")
NULL_CHECK = Spec("html.script.null_check", "script", "medium", 10,
                  "Possible missing null check before using '{name}'.")
SENSITIVE = Spec("html.security.sensitive_data", "security", "high", 24, "Possible sensitive data detected: {hits}.")
UNSAFE_HREF = Spec("html.security.unsafe_href", "security", "high", 20,
                   "Unsafe href value can trigger script execution or dangerous navigation.")
REDIRECT = Spec("html.security.open_redirect", "security", "medium", 8,
                "Possible open-redirect style link parameter detected.")
UNLABELLED = Spec("html.accessibility.unlabelled", "accessibility", "high", 16,
                  "<{tag}> appears to lack an accessible label.")

TEMPLATE_MARKERS = r"(?s)\{\{.*?\}\}|\$\{.*?\}|<%.*?%>"


def structure() -> Column:
    nesting = each("walk.errors", lambda e: (
        (OUT_OF_ORDER, e["kind"] == "out_of_order", {"tag": e["tag"]}),
        (UNEXPECTED, e["kind"] == "unexpected_close", {"tag": e["tag"]}),
        (INVALID_CHILD, e["kind"] == "invalid_child", {"tag": e["tag"]})))
    left = C("walk.stack")
    last = F.slice(left, F.greatest(F.size(left) - 2, F.lit(1)), F.lit(3))
    return F.concat(nesting, once(
        (UNCLOSED, F.size(left) > 0, {"tags": F.array_join(last, ", ")}),
        (DUPLICATE_ID, F.size("id_repeats") > 0, {"ids": F.array_join(F.slice("id_repeats", 1, 3), ", ")}),
        (DEEP, C("div_depth") >= 6, {"n": C("div_depth")}),
        (REPEATED_URL, F.size("url_repeats") > 0),
        (REPEATED_LINE, (F.size("line_repeats") > 0) & ~matches("text", TEMPLATE_MARKERS))))


def _dead(s) -> Column:
    """All id and class names of a shallow selector miss in the page."""
    names = extract_all(s["selector"], r"[#.]([\w-]+)", 1)
    shallow = (count_regex(s["selector"], " ") <= 2) & (count_regex(s["selector"], ">") <= 1)
    return shallow & (F.size(names) > 0) & ~F.arrays_overlap(names, C("page_names"))


def style() -> Column:
    from ..functions.events import repeated
    from ..functions.sheets import signature

    filled = F.filter("page_rules", lambda r: F.size(r["d"]) > 0)
    bodies = F.transform(filled, lambda r: signature(r))
    pairs = F.flatten(F.transform("page_rules", lambda r: F.transform(
        r["d"], lambda d: F.struct(d["prop"].alias("p"), d["raw"].alias("v")))))
    heavy = lambda s: (s["ids"] >= 2) | (s["classes"] >= 4) | (s["elements"] >= 4) | (s["combinators"] >= 4)
    return once(
        (DUPLICATE_BODY, F.size(repeated(bodies, 2)) > 0),
        (REPEATED_DECL, F.size(repeated(pairs, 4)) > 0),
        (COMPLEX, F.exists("page_weights", heavy)),
        (DEAD, F.exists("page_weights", _dead)))


GLOBAL_ASSIGN = r"\b(?:window|globalThis|self)\s*\.\s*([A-Za-z_$][\w$]*)\s*="
DOM_VARIABLE = (
    r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:document\.querySelector(?:All)?|document\.getElementById"
    r"|document\.getElementsByClassName|document\.getElementsByTagName)\s*\("
)
DOM_USE = (
    r"(?:^|[^\w$])([A-Za-z_$][\w$]*+)\s*+\.\s*(?:addEventListener|classList|style|value|textContent|innerHTML"
    r"|setAttribute)\b"
)
DOM_GUARD = r"\bif\s*\(\s*([A-Za-z_$][\w$]*)\s*\)"


def _unguarded() -> Column:
    """The first element variable, if any, that is used without a guard."""
    names, used, guarded = (extract_all("script_text", p, 1) for p in (DOM_VARIABLE, DOM_USE, DOM_GUARD))
    return F.slice(F.array_except(F.array_intersect(names, used), guarded), 1, 1)


def script() -> Column:
    names = extract_all("script_text", GLOBAL_ASSIGN, 1)
    bare = each(_unguarded(), lambda name: ((NULL_CHECK, F.lit(True), {"name": name}),))
    return F.concat(bare, once(
        (GLOBALS, F.size(names) > 0, {"names": capped_list(names, 3)}),
        (REPEATED_JS, F.size("script_line_repeats") > 0)))


SECRET = (
    r"""(?i)\b(?:api[_-]?key|secret|token|bearer|password|passwd|private[_-]?key|client[_-]?secret)\b"""
    r"""[^<>\n]{0,80}(?:["'][A-Za-z0-9_\-./=]{16,}["']|:[^<>\n]{8,})"""
)
AWS_KEY = r"\bAKIA[0-9A-Z]{16}\b"
LONG_TOKEN = r"\b[A-Za-z0-9+/]{32,}={0,2}\b"
TOKEN_WORD = r"(?i)\b(?:secret|token|key|bearer)\b"
HREF = r"""(?i)<a\b[^>]*href\s*=\s*["']([^"']+)["'][^>]*>"""
UNSAFE_SCHEME = r"(?i)^(?:javascript:|data:text/html|vbscript:)"
REDIRECT_PARAM = r"(?i)[?&](?:redirect|returnurl|next|url|return|target)="


def security() -> Column:
    hits = F.array_join(F.array_compact(F.array(
        F.when(matches("text", SECRET), "possible secret/token label"),
        F.when(matches("text", AWS_KEY), "AWS access key pattern"),
        F.when(matches("text", TOKEN_WORD) & matches("text", LONG_TOKEN), "token-like value"))), ", ")
    links = F.filter(
        extract_all("text", HREF, 1), lambda h: h.rlike(regex(UNSAFE_SCHEME)) | h.rlike(regex(REDIRECT_PARAM)))
    first = each(F.slice(links, 1, 1), lambda h: (
        (UNSAFE_HREF, h.rlike(UNSAFE_SCHEME)), (REDIRECT, ~h.rlike(UNSAFE_SCHEME))))
    sensitive = each(F.array(hits), lambda h: ((SENSITIVE, h != "", {"hits": h}),))
    return F.concat(sensitive, first)


CONTROL = r"(?i)<(?:input|textarea|select)\b[^>]*>"
SKIPPED_INPUT = r"""(?i)^<input\b[^>]*\btype\s*=\s*["'](?:hidden|submit|button|reset|image)["']"""
SELF_LABELLED = r"(?i)\b(?:aria-label|aria-labelledby|placeholder)\s*="
CONTROL_ID = r"""(?i)\bid\s*=\s*["']([^"']+)["']"""
LABEL = r"""(?i)<label\b[^>]*\bfor\s*=\s*["']([^"']+)["']"""


def accessibility() -> Column:
    """Only the first unlabelled control of a page counts."""
    labels = extract_all("text", LABEL, 1)
    bare = F.filter(extract_all("text", CONTROL), lambda c: (
        ~c.rlike(regex(SKIPPED_INPUT)) & ~c.rlike(regex(SELF_LABELLED))
        & ~F.array_contains(labels, F.regexp_extract(c, regex(CONTROL_ID), 1))))
    return each(F.slice(bare, 1, 1), lambda c: ((UNLABELLED, F.lit(True), {"tag": F.regexp_extract(c, r"^<(\w+)", 1)}),))


HTML = ("html",)
CHECKS = {
    "html.structure": RowCheck(
        HTML, ("tags", "walk", "div_depth", "id_repeats", "url_repeats", "line_repeats"), structure),
    "html.style": RowCheck(HTML, ("css_text", "page_rules", "page_weights", "page_names"), style),
    "html.script": RowCheck(HTML, ("script_text", "script_line_repeats"), script),
    "html.security": RowCheck(HTML, (), security),
    "html.accessibility": RowCheck(HTML, (), accessibility),
}
