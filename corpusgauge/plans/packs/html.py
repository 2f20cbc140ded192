"""Rule packs for pages. Patterns, thresholds, impacts and messages are fixed values."""

from ..features import SCRIPT, STYLE, STYLE_ATTR
from ..rules import Rule, at_least, at_most, chars_over, exceeds, first, has, lacks, reaches, some

LANG = "html"


def _r(pack, category, name, severity, impact, message, *all_of, **more):
    return Rule(f"html.{pack}.{name}", LANG, category, severity, impact, message, tuple(all_of), **more)


def _pack(pack, category=None):
    return lambda name, severity, impact, message, *all_of, category=category or pack, **more: _r(
        pack, category, name, severity, impact, message, *all_of, **more)


SEMANTIC = r"(?i)<(?:header|main|nav|section|article|aside|footer|form|button|label|figure|figcaption)\b"

r = _pack("structure")
STRUCTURE = [
    r("generic_markup", "medium", 8,
      "Markup relies heavily on generic div/span tags instead of semantic structure.",
      at_least(r"(?i)<(?:div|span)\b", 18, needs=("<div", "<span")), at_most(SEMANTIC, 2)),
    r("lang", "medium", 8, "HTML root should declare a lang attribute.",
      first(r"(?i)<html\b[^>]*>", missing=r"(?i)\blang\s*=")),
    r("charset", "medium", 8, "Missing meta charset declaration.", lacks(r"(?i)<meta\b[^>]*charset\s*=", needs="charset")),
    r("viewport", "medium", 8, "Missing viewport meta tag for responsive layout support.",
      lacks(r"""(?i)<meta\b[^>]*name\s*=\s*["']viewport["']""", needs="viewport")),
    r("title", "high", 14, "Missing <title> element.", lacks(r"(?is)<title\b[^>]*>.*?</title>", needs="<title")),
    r("description", "low", 4, "Meta description is missing on a non-trivial page.",
      chars_over(300), lacks(r"""(?i)<meta\b[^>]*name\s*=\s*["']description["']""", needs="description")),
    r("inline_handler", "medium", 10,
      "Inline event handlers keep behavior inside markup and are hard to maintain.",
      has(r"""(?i)\son\w+\s*=\s*["']""")),
]

CSS = "css_text"
CSS_PRESENT = chars_over(0, CSS)
NO_VARIABLES = lacks(r"--[\w-]+\s*:", CSS)
NO_MEDIA = lacks(r"(?i)@media\b", CSS)

r = _pack("style")
STYLE_PACK = [
    r("heavy_blocks", "medium", 8, "Heavy inline <style> usage makes the file harder to maintain.",
      CSS_PRESENT, any_of=(reaches("style_blocks", 2), exceeds("style_chars", 1200))),
    r("style_attributes", "medium", 8, "Too many inline style attributes reduce reuse and consistency.",
      reaches("style_attributes", 6)),
    r("important", "medium", 8, "Excessive !important usage usually signals a specificity war.",
      at_least(r"(?i)!\s*important\b", 3, CSS)),
    r("fixed_sizes", "medium", 8, "CSS leans too much on fixed pixel sizes instead of responsive units.",
      at_least(r"(?i)\b\d+(?:\.\d+)?(?:px|pt|cm|mm|in|pc)\b", 10, CSS),
      at_most(r"(?i)\b\d+(?:\.\d+)?(?:rem|em|%|vw|vh|vmin|vmax|ch)\b|\bclamp\s*\(", 2, CSS)),
    r("mixed_layouts", "medium", 8,
      "Mixed layout systems are fighting each other (float/flex/grid/absolute).", reaches("layout_systems", 3)),
    r("magic_colors", "low", 4, "Repeated magic colors without CSS variables reduce consistency.",
      at_least(r"(?:#[0-9a-fA-F]{3,8}\b|rgba?\([^)]+\)|hsla?\([^)]+\))", 6, CSS), NO_VARIABLES),
    r("spacing_values", "low", 4, "Repeated spacing values suggest the design system is not centralized.",
      at_least(r"(?i)\b(?:margin|padding|gap)\s*:\s*[^;]+", 8, CSS), NO_VARIABLES),
    r("fixed_width", "medium", 8,
      "Fixed-width CSS without media queries is likely to break on smaller screens.",
      at_least(r"(?i)\b(?:width|max-width|min-width|height|min-height|max-height)\s*:\s*\d+px\b", 4, CSS), NO_MEDIA),
    r("overflow", "low", 4, "Overflow handling looks brittle for responsive layouts.",
      at_least(r"(?i)\boverflow(?:-x|-y)?\s*:\s*(?:hidden|scroll)\b", 2, CSS), NO_MEDIA),
    r("focus_styles", "low", 4, "No visible focus styles were detected for interactive controls.",
      CSS_PRESENT, lacks(r"(?i):focus(?:-visible)?\b", CSS), has(r"(?i)\b(?:button|a|input|select|textarea)\b"),
      category="accessibility"),
]

JS = "script_text"
SCRIPT_PRESENT = reaches("script_blocks", 1)
DOM_QUERY = (
    r"\b(?:document\.querySelector(?:All)?|getElementById|getElementsByClassName|getElementsByTagName)\s*\("
)
LISTENER = r"\.addEventListener\s*\("
SCRIPT_OPEN = r"(?i)<script\b[^>]*"
DEFERRED = r"""(?i)\bdefer\b|\basync\b|\btype\s*=\s*["']module["']"""

r = _pack("script")
SCRIPT_PACK = [
    r("large_inline", "medium", 8, "Inline scripts are large enough to deserve real module boundaries.",
      SCRIPT_PRESENT, any_of=(reaches("script_blocks", 2), chars_over(3000, JS))),
    r("scattered_wiring", "medium", 8,
      "DOM querying and listener wiring are scattered instead of being centralized.",
      at_least(DOM_QUERY, 8, JS), at_least(LISTENER, 4, JS)),
    r("markup_coupling", "low", 4,
      "JavaScript is tightly coupled to specific markup and presentation details.",
      at_least(DOM_QUERY, 4, JS), has(r"\.(?:style|classList|dataset)\b", JS)),
    r("dom_insertion", "high", 22,
      "Unsafe DOM insertion detected through innerHTML/document.write/insertAdjacentHTML.",
      has(r"\b(?:innerHTML|outerHTML|insertAdjacentHTML|document\.write)\b", JS), category="security"),
    r("blocking", "high", 16, "Synchronous or endless blocking logic can freeze the UI.",
      SCRIPT_PRESENT, category="performance",
      any_of=(has(r"\bXMLHttpRequest\s*\([^)]*,\s*false\s*\)", JS), has(r"\bwhile\s*\(\s*true\s*\)", JS))),
    r("reads_in_loops", "medium", 8, "DOM reads inside loops can trigger unnecessary reflow/repaint work.",
      has(r"\b(for|while)\s*\(", JS), at_least(DOM_QUERY, 2, JS),
      has(r"\bgetBoundingClientRect|offsetWidth|offsetHeight|clientWidth|clientHeight\b", JS), category="performance"),
    r("unhandled_async", "medium", 8,
      "Async logic lacks visible error handling around fetch/parsing/event flow.",
      has(r"\bfetch\s*\(|\basync\s+function\b|\basync\s*\(", JS),
      lacks(r"\bcatch\b", JS), lacks(r"\btry\s*\{", JS), category="maintenance"),
    r("blocking_scripts", "medium", 8, "Large blocking scripts appear to run before the DOM is ready.",
      SCRIPT_PRESENT, chars_over(1000, JS), has(r"(?i)<head\b", needs="<head"), some(SCRIPT_OPEN, missing=DEFERRED, needs="<script"),
      category="performance"),
    r("delegation", "low", 4, "Many individual event listeners could likely be replaced by delegation.",
      at_least(LISTENER, 8, JS), has(r"\bquerySelectorAll\s*\(", JS), category="performance"),
]

r = _pack("security")
SECURITY = [
    r("dom_insertion", "high", 24,
      "Unsafe DOM insertion can create XSS risk, especially with user-controlled data.",
      has(r"(?i)\b(?:innerHTML|outerHTML|insertAdjacentHTML|document\.write)\b", needs=("innerhtml", "outerhtml", "insertadjacenthtml", "document.write"))),
    r("tainted_insertion", "high", 24,
      "User-controlled input appears to flow into DOM insertion without escaping or sanitization.",
      has(r"(?i)\b(?:innerHTML|outerHTML|insertAdjacentHTML)\s*=\s*[^;\n]*(?:location\.|searchParams\.get"
          r"|document\.cookie|localStorage\.|sessionStorage\.|\.value\b|prompt\s*\()",
          needs=("innerhtml", "outerhtml", "insertadjacenthtml"))),
    r("inline_code", "medium", 10, "Inline scripts or styles make a strong CSP much harder to adopt.",
      any_of=(has(SCRIPT, needs="<script"), has(STYLE, needs="<style"), has(STYLE_ATTR, needs="style"))),
    r("blank_target", "medium", 10, 'Links using target="_blank" should include rel="noopener noreferrer".',
      has(r"""(?i)<a\b[^>]*target\s*=\s*["']_blank["'][^>]*>""", needs="_blank"),
      lacks(r"""(?i)\brel\s*=\s*["'][^"']*\bnoopener\b[^"']*["']""", needs="noopener")),
    r("script_integrity", "medium", 10, "External script is missing integrity metadata or trust control.",
      some(r"""(?i)<script\b[^>]*\bsrc\s*=\s*["']https?://[^"']*["'][^>]*>""", missing=r"(?i)integrity=",
           on="script_tags")),
    r("form_validation", "low", 6,
      "Form inputs have little visible client-side validation. Do not rely on frontend checks alone.",
      some(r"(?is)<form\b[^>]*>.*?</form>", needs="<form",
           present=r"(?i)<(?:input|textarea|select|button)\b[^>]*>",
           missing=r"""(?i)<(?:input|textarea|select|button)\b[^>]*\b(?:required|pattern|minlength|maxlength"""
                   r"""|type\s*=\s*["'](?:email|url|number|tel|password)["'])""")),
]

INTERACTIVE = r"""(?i)<(?:div|span)\b[^>]*\bon\w+\s*=\s*["'][^"']+["'][^>]*>"""
ROLE_BUTTON = r"""(?i)\brole\s*=\s*["']button["']"""

r = _pack("accessibility")
ACCESSIBILITY = [
    r("image_alt", "high", 16, "Image tag missing meaningful alt text.",
      some(r"(?i)<img\b[^>]*>", needs="<img", missing=r"""(?i)\balt\s*=\s*["'][^"']*[^"'\s][^"']*["']""")),
    r("clickable_generic", "medium", 10, "Clickable div/span patterns hurt keyboard and screen-reader support.",
      has(INTERACTIVE, needs=("<div", "<span"))),
    r("script_only", "medium", 10,
      "JS-only interactions on generic elements need keyboard support and proper roles.",
      has(INTERACTIVE, needs=("<div", "<span")), lacks(r"(?i)\bon(?:keydown|keyup|keypress)\s*=", needs=("onkeydown", "onkeyup", "onkeypress")),
      lacks(ROLE_BUTTON, needs="role")),
    r("weak_aria", "low", 4, "ARIA attributes are present, but usable labeling/role context is weak.",
      has(r"(?i)\baria-[\w-]+\s*=", needs="aria-"), lacks(r"(?i)\b(role|aria-label|aria-labelledby|aria-describedby)\s*=", needs=("role", "aria-label", "aria-describedby"))),
    r("focus_visible", "low", 4, "No focus-visible styling was detected for interactive elements.",
      has(r"(?i)<button\b|<a\b|<input\b|<select\b|<textarea\b"), lacks(r"(?i):focus(?:-visible)?\b", needs=":focus")),
    r("clickable_div", "medium", 10, "Use a real <button> instead of a clickable <div>.",
      has(r"(?i)<div\b[^>]*\bonclick\s*=", needs="onclick"), lacks(ROLE_BUTTON, needs="role")),
]

r = _pack("maintenance")
MAINTENANCE = [
    r("mixed_concerns", "medium", 8, "This file is mixing markup, style, and behavior in one place.",
      SCRIPT_PRESENT, reaches("style_blocks", 1), chars_over(1500)),
    r("many_scripts", "medium", 8, "Multiple inline scripts make reuse and testing harder.",
      reaches("script_blocks", 2)),
    r("many_styles", "medium", 8, "Multiple inline style blocks make design changes harder to manage.",
      reaches("style_blocks", 2)),
    r("large_inline", "medium", 8, "Large inline code blocks suggest the page should be split into modules.",
      exceeds("inline_chars", 2500)),
    r("large_file", "medium", 8, "Very large HTML files are difficult to maintain safely.",
      exceeds("line_count", 700)),
    r("commented_todo", "low", 4, "Commented-out TODO/FIXME/HACK blocks should be cleaned up.",
      has(r"(?s)<!--.*?-->", needs="<!--"), has(r"(?i)<!--\s*(?:TODO|FIXME|HACK)\b", needs=("todo", "fixme", "hack"))),
    r("vague_names", "low", 4, "Naming looks vague in places; descriptive names scale better.",
      has(r"(?i)\b(?:box1|box2|temp\d+|newDiv|data1|item1|stuff|test\d*)\b",
          needs=("box", "temp", "newdiv", "data1", "item1", "stuff", "test"))),
    r("much_logic", "medium", 8, "This file contains a lot of logic and should be split into smaller units.",
      at_least(r"\b(?:function|const|let|var)\b", 15), chars_over(2000)),
]

PERF_QUERY = r"\b(?:querySelector(?:All)?|getElementById|getElementsByClassName|getElementsByTagName)\s*\("

r = _pack("performance")
PERFORMANCE = [
    r("data_uri", "medium", 8, "Large base64 assets are embedded directly in the page.",
      has(r"""(?i)data:[^"']+;base64,[A-Za-z0-9+/=]{200,}""", needs=";base64,")),
    r("large_script", "medium", 8, "Large inline JavaScript increases initial load cost.", chars_over(2000, JS)),
    r("large_style", "medium", 8, "Large inline CSS increases initial load cost.", chars_over(2000, "style_text")),
    r("queries_in_loops", "medium", 8, "DOM queries inside loops can create unnecessary work and reflows.",
      has(PERF_QUERY, JS), has(r"\b(for|while)\s*\(", JS)),
    r("listeners", "low", 4, "Many per-element listeners may be better handled with delegation.",
      at_least(LISTENER, 8, JS)),
    r("layout_thrash", "medium", 8,
      "Mixed layout reads and writes can trigger repeated reflow/repaint cycles.",
      has(r"\b(?:offsetWidth|offsetHeight|clientWidth|clientHeight|getBoundingClientRect|scrollWidth|scrollHeight)\b",
          JS),
      has(r"\b(?:style\.[A-Za-z_$][\w$]*\s*=|classList\.(?:add|remove|toggle))", JS)),
    r("render_blocking", "medium", 8, "Render-blocking scripts are present in the document head.",
      has(r"(?is)<head\b.*?<script\b", needs="<script"),
      some(r"""(?i)<script\b[^>]*src\s*=\s*["'][^"']+["'][^>]*>""", missing=DEFERRED, needs="<script")),
    r("lazy_images", "low", 4, "Consider lazy-loading images to reduce initial page cost.",
      has(r"(?i)<img\b[^>]*>", needs="<img"), lacks(r"""(?i)\bloading\s*=\s*["']lazy["']""", needs="lazy"), at_least(r"(?i)<img\b", 3)),
]

r = _pack("compatibility")
COMPATIBILITY = [
    r("optional_chaining", "low", 4, "Optional chaining may not be supported on older targets.", has(r"\?\.", needs="?.")),
    r("nullish", "low", 4, "Nullish coalescing may not be supported on older targets.", has(r"\?\?", needs="??")),
    r("modern_api", "low", 4, "Modern JavaScript APIs were detected and may need fallbacks.",
      has(r"\b(?:fetch|Promise\.allSettled|queueMicrotask|IntersectionObserver|ResizeObserver|AbortController"
          r"|crypto\.randomUUID|structuredClone|at)\b")),
    r("modules", "low", 4, "ES modules require modern browser support.",
      has(r"""(?i)\btype\s*=\s*["']module["']""", needs="module")),
    r("has_selector", "low", 4, ":has() is still not safe to assume across all target browsers.",
      has(r":has\(", CSS)),
    r("clamp", "low", 4, "clamp() may need fallback handling for older browsers.", has(r"\bclamp\s*\(", CSS)),
    r("backdrop", "low", 4, "backdrop-filter can be inconsistent across browsers.",
      has(r"(?i)\bbackdrop-filter\b", CSS)),
    r("aspect_ratio", "low", 4, "aspect-ratio may need fallback layout rules.", has(r"(?i)\baspect-ratio\b", CSS)),
    r("scroll_snap", "low", 4, "scroll-snap behavior can vary across engines and needs testing.",
      has(r"(?i)\bscroll-snap-type\b", CSS)),
    r("sticky", "low", 4, "Sticky positioning should be tested carefully across target browsers.",
      has(r"(?i)\bposition\s*:\s*sticky\b", CSS)),
    r("viewport_height", "low", 4, "100vh can behave differently on mobile browser chrome; test carefully.",
      has(r"(?i)100vh", CSS)),
    r("vendor_prefix", "low", 4, "Vendor-prefixed CSS is present; verify standard fallbacks exist.",
      has(r"(?i)-(webkit|moz|ms)-", CSS)),
]

PACKS = {
    "html.structure": STRUCTURE,
    "html.style": STYLE_PACK,
    "html.script": SCRIPT_PACK,
    "html.security": SECURITY,
    "html.accessibility": ACCESSIBILITY,
    "html.maintenance": MAINTENANCE,
    "html.performance": PERFORMANCE,
    "html.compatibility": COMPATIBILITY,
}
