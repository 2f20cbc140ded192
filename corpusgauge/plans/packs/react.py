"""Rule packs for component files. Patterns, thresholds, impacts and messages are fixed values."""

from ...functions.text import longer_line
from ..rules import Rule, at_least, exceeds, has, lacks, reaches

LANG = "react"


def _pack(pack):
    return lambda name, severity, impact, message, *all_of, category=pack, **more: Rule(
        f"react.{pack}.{name}", LANG, category, severity, impact, message, tuple(all_of), **more)


SET_STATE = r"\bset[A-Z][A-Za-z0-9_]*\s*\("

r = _pack("state")
STATE = [
    r("derived", "medium", 10,
      "State looks derived from props or computed data. Derived state often causes sync bugs.",
      any_of=(has(r"useState\s*\(\s*props\.[^)]+\)", needs="props."),
              has(r"(?s)useState\s*\(\s*.*\b(?:filter|map|reduce|sort|slice)\s*\(", needs="useState"),
              has(r"(?s)useState\s*\(\s*.*\bJSON\.stringify\s*\(", needs="JSON.stringify"))),
    r("from_props", "high", 14, "State is initialized directly from props. That can drift out of sync.",
      has(r"const\s*\[\s*[A-Za-z_$][\w$]*\s*,\s*[A-Za-z_$][\w$]*\s*\]\s*=\s*useState\s*\(\s*props\.", needs="props.")),
    r("before_return", "low", 6,
      "State update appears before render return. Check for render-loop or unnecessary rerender risk.",
      has(r"return\s*\(", needs="return"), has(SET_STATE, "before_return")),
]

r = _pack("lifecycle")
LIFECYCLE = [
    r("interval", "high", 16, "setInterval is used without clearInterval. That is a memory leak risk.",
      has(r"\bsetInterval\s*\(", needs="setInterval"), lacks(r"\bclearInterval\s*\(", needs="clearInterval")),
    r("listener", "high", 16, "addEventListener is used without removeEventListener. That can leak listeners.",
      has(r"\baddEventListener\s*\(", needs="addEventListener"),
      lacks(r"\bremoveEventListener\s*\(", needs="removeEventListener")),
    r("fetch_abort", "low", 6,
      "Fetch calls in effects should usually support abort/cleanup to avoid stale updates.",
      has(r"\bfetch\s*\(", needs="fetch"), lacks(r"\bAbortController\b", needs="AbortController")),
]

r = _pack("props")
TEXT_PROPS = r"\b(title|alt|placeholder|aria-label|aria-labelledby|name|id|className)\s*=\s*\{\s*"
PROPS = [
    r("boolean_text", "low", 5,
      "A boolean value is being passed to a text-like prop. Double-check the JSX prop type.",
      has(TEXT_PROPS + r"(true|false)\s*\}", needs=("true", "false"))),
    r("numeric_text", "low", 5,
      "A numeric value is being passed to a text-like prop. Double-check the JSX prop type.",
      lacks(TEXT_PROPS + r"(true|false)\s*\}", needs=("true", "false")), has(TEXT_PROPS + r"\d+(?:\.\d+)?\s*\}")),
    r("literal_text", "low", 4,
      "A text-like prop receives an object or array literal. That is probably the wrong type.",
      has(r"<[A-Z][A-Za-z0-9_]*\b[^>]*\b(className|id|name|title|alt|placeholder)\s*=\s*\{\s*(\{|\[)\s*")),
]

r = _pack("accessibility")
ACCESSIBILITY = [
    r("icon_button", "medium", 10, "Icon-only buttons should have an accessible label.",
      has(r"(?i)<button\b[^>]*>\s*<svg\b", needs="<svg"), lacks(r"(?i)\baria-label\s*=", needs="aria-label")),
]

r = _pack("security")
SECURITY = [
    r("dangerous_html", "high", 25, "dangerouslySetInnerHTML can expose XSS risk.",
      has(r"\bdangerouslySetInnerHTML\b", needs="dangerouslySetInnerHTML")),
    r("direct_html", "high", 22, "Direct HTML injection through innerHTML/outerHTML is unsafe.",
      has(r"(?:^|[^\w$])(?:innerHTML|outerHTML)\s*=", needs=("innerHTML", "outerHTML"))),
    r("document_write", "high", 18, "document.write is unsafe in modern React apps.",
      has(r"\bdocument\.write\s*\(", needs="document.write")),
    r("dynamic_code", "high", 20, "Dynamic code execution is unsafe here.",
      has(r"\beval\s*\(|\bnew\s+Function\s*\(", needs=("eval", "Function"))),
]

r = _pack("performance")
PERFORMANCE = [
    r("index_key", "medium", 10,
      "Using an index as a list key can break reconciliation and cause extra rerenders.",
      has(r"\.map\s*\([\s\S]{0,400}?\bkey\s*=\s*\{\s*(index|i|idx)\s*\}", needs=".map")),
    r("memo", "low", 6,
      "This render looks large and expensive. Memoization may help if the component rerenders often.",
      has(r"\.(?:map|filter|reduce)\s*\(", needs=(".map", ".filter", ".reduce")),
      lacks(r"\bReact\.memo\b|\bmemo\s*\(|\buseMemo\s*\(|\buseCallback\s*\(", needs=("memo", "useMemo", "useCallback")),
      any_of=(exceeds("line_count", 250), at_least(r"<[A-Z][A-Za-z0-9_]*\b", 21))),
    r("inline_props", "low", 5, "Inline object or function props can trigger extra rerenders in child components.",
      any_of=(has(r"\bstyle\s*=\s*\{\s*\{", needs="style"), has(r"(?s)\bon[A-Z][A-Za-z0-9_]*\s*=\s*\{\s*\(?.*?=>", needs="=>"))),
    r("large_file", "medium", 8, "Very large React files often hide expensive renders and repeated work.",
      exceeds("line_count", 400)),
]

r = _pack("maintenance")
MAINTENANCE = [
    r("many_states", "medium", 8, "Too many local states may indicate component sprawl.",
      at_least(r"\buseState\s*\(", 9, needs="useState")),
    r("dom_access", "medium", 8, "Direct DOM access fights React's model.",
      has(r"\bdocument\.(querySelector|getElementById|getElementsByClassName|getElementsByTagName)\b",
          needs="document.")),
    r("large_file", "medium", 8, "Very large React components are hard to maintain.", exceeds("line_count", 450)),
    r("many_effects", "low", 5,
      "This component has many effects and states together. Consider splitting responsibilities.",
      has(r"\buseState\s*\(", needs="useState"), at_least(r"\buseEffect\s*\(", 6, needs="useEffect")),
]

r = _pack("style")
STYLE = [
    r("console", "low", 3, "console.log left in production code.", has(r"\bconsole\.log\s*\(", needs="console.log")),
    r("nested_ternary", "low", 4, "Nested ternary logic hurts readability.", reaches("ternary_lines", 1)),
    r("inline_style", "low", 4, "Heavy inline styling makes JSX harder to maintain.",
      at_least(r"\bstyle\s*=\s*\{\s*\{", 4, needs="style")),
    r("long_lines", "low", 3, "Some lines are very long. Split them for readability.", has(longer_line(160))),
]

PACKS = {
    "react.state": STATE,
    "react.lifecycle": LIFECYCLE,
    "react.props": PROPS,
    "react.accessibility": ACCESSIBILITY,
    "react.security": SECURITY,
    "react.performance": PERFORMANCE,
    "react.maintenance": MAINTENANCE,
    "react.style": STYLE,
}
