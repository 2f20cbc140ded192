"""Style sheet and utility-class checks. Messages, impacts, confidences and fixes are fixed values."""

from pyspark.sql import Column, functions as F

from ..functions.css import closest_property, contrast_ratio, css_length, css_rgb, known_properties
from ..functions.events import DYNAMIC, repeated, repeated_counts, runs
from ..functions.sheets import in_keyframes, selector_array, signature
from ..functions.text import extract_all, let, one_of, replace_regex, squeeze
from ..functions.utility import BREAKPOINTS, known_base, known_variant
from .checks import RowCheck, Spec, each, on_line, once, with_snippets

C = F.col

# Security
EXPRESSION = Spec("css.security.expression", "security", "error", 20,
                  "Legacy CSS `expression()` is unsafe and obsolete.", 0.99,
                  "Remove `expression()` and replace it with safe CSS or JavaScript logic.")
UNSAFE_URL = Spec("css.security.unsafe_url", "security", "error", 20, "Unsafe URL scheme detected in CSS.", 0.98,
                  "Remove `javascript:` or `data:text/html` URLs from CSS.")
BINDING = Spec("css.security.binding", "security", "warning", 12,
               "Legacy browser binding behavior can be abused or break compatibility.", 0.93,
               "Remove obsolete browser-specific behavior rules.")
SCRIPT_URL = Spec("css.security.script_url", "security", "error", 20,
                  "Potential JavaScript URL injection inside `url()`.", 0.98,
                  "Sanitize any user-controlled URL inputs before they reach CSS.")

# Performance
UNIVERSAL = Spec("css.performance.universal", "performance", "low", 4,
                 "Universal selector can be expensive on large DOMs.", 0.9,
                 "Target a narrower selector when possible.")
HAS = Spec("css.performance.has", "performance", "warning", 9, "`:has()` selectors can be expensive.", 0.88,
           "Use `:has()` sparingly and only where the payoff is clear.")
DEEP_CHAIN = Spec("css.performance.deep_chain", "performance", "warning", 9,
                  "Deep selector chains can slow matching and make styles brittle.", 0.88,
                  "Flatten the selector structure and favor component-scoped classes.")
FILTER = Spec("css.performance.filter", "performance", "warning", 10,
              "Filter/backdrop-filter can be expensive to render.", 0.91,
              "Avoid large blurred or backdrop-filtered surfaces unless necessary.")
TRANSITION_ALL = Spec("css.performance.transition_all", "performance", "warning", 8,
                      "`transition: all` can trigger extra repaints and make intent unclear.", 0.93,
                      "Animate only the properties that need to change.")
WILL_CHANGE = Spec("css.performance.will_change", "performance", "info", 4,
                   "`will-change` should be used sparingly.", 0.88,
                   "Remove `will-change` unless it is measured and temporary.")
SHADOWS = Spec("css.performance.stacked_shadows", "performance", "low", 4,
               "Stacked box-shadows can be expensive to paint.", 0.84,
               "Reduce the number and blur radius of shadows.")
BLUR = Spec("css.performance.large_blur", "performance", "info", 4, "Large blur radii can increase paint cost.", 0.78,
            "Use smaller blur radii where the design allows.")
LAYOUT_ANIMATION = Spec("css.performance.layout_animation", "performance", "warning", 9,
                        "Animating layout-affecting properties can force reflow.", 0.89,
                        "Animate transform and opacity instead of geometry when possible.")

# Style
MISSPELT = Spec("css.style.misspelt_property", "style", "warning", 10,
                "Possible invalid CSS property `{name}`; did you mean `{close}`?", 0.91,
                "Rename `{name}` to `{close}`.")
UNRECOGNIZED = Spec("css.style.unknown_property", "style", "info", 4, "Unrecognized CSS property `{name}`.", 0.68)
FONT_SIZE = Spec("css.style.font_size", "accessibility", "warning", 9,
                 "Font size `{value}` may be too small for comfortable reading.", 0.86,
                 "Use at least 14px for body text or use a responsive scale.")
LINE_HEIGHT = Spec("css.style.line_height", "accessibility", "warning", 8, "Line height `{value}` is very tight.",
                   0.82, "Increase line-height to around 1.4–1.6 for body text.")
FIXED_WIDTH = Spec("css.style.fixed_width", "layout", "warning", 10,
                   "Fixed width `{value}` can trap responsive layouts.", 0.84,
                   "Use fluid units, max-width, or responsive breakpoints.")
VIEWPORT_WIDTH = Spec("css.style.viewport_width", "layout", "warning", 8,
                      "`{name}: {value}` can cause horizontal overflow on mobile.", 0.81,
                      "Prefer `width: 100%` with appropriate max-width and box sizing.")
VIEWPORT_HEIGHT = Spec("css.style.viewport_height", "layout", "info", 5,
                       "`100vh` can behave badly on mobile browser chrome.", 0.75,
                       "Consider `100dvh` or a safer responsive container height.")
ROOT_OVERFLOW = Spec("css.style.root_overflow", "layout", "warning", 8,
                     "`{name}: hidden` on a root container can clip content.", 0.84,
                     "Use overflow clipping only where the clipping is intentional.")
OUTLINE = Spec("css.style.outline_removed", "accessibility", "error", 15,
               "Focus outline is removed without a visible replacement.", 0.96,
               "Add a visible focus style using `:focus-visible` or an accessible outline.")
MUTED_FOCUS = Spec("css.style.muted_focus", "accessibility", "warning", 8, "Focus state appears visually muted.", 0.82,
                   "Add a clear focus ring or outline for keyboard users.")
CONFLICT = Spec("css.style.conflicting_declaration", "maintenance", "warning", 9,
                "Duplicate declaration `{prop}` with conflicting values in the same rule.", 0.92,
                "Keep one declaration per property unless the override is deliberate.")
REPEATED = Spec("css.style.repeated_declaration", "maintenance", "info", 3,
                "Duplicate declaration `{prop}` repeated in the same rule.", 0.88, "Remove the duplicate declaration.")
RULE_IMPORTANT = Spec("css.style.rule_important", "maintenance", "warning", 9,
                      "`!important` appears {n} times in one rule.", 0.88,
                      "Reduce `!important` usage and refactor specificity instead.")
FOCUS_REMOVED = Spec("css.style.focus_removed", "accessibility", "error", 15,
                     "Focusable element removes visible focus styling.", 0.97,
                     "Keep a clear `:focus-visible` treatment with outline or ring.")
CONTRAST = Spec("css.style.contrast", "accessibility", "warning", 12, "Low contrast risk detected ({ratio}:1).", 0.91,
                "Increase the contrast ratio to at least 4.5:1 for normal text.")
EMPTY_SELECTOR = Spec("css.style.empty_selector", "style", "error", 18, "Empty selector block.", 0.98,
                      "Add a valid selector before the opening brace.")
SPECIFIC = Spec("css.style.specificity", "maintenance", "warning", 10,
                "High specificity selector `{selector}` may cause override wars.", 0.9,
                "Prefer lower-specificity selectors or component scoping.")
CHAIN = Spec("css.style.deep_chain", "performance", "warning", 9, "Deep selector chain detected in `{selector}`.",
             0.87, "Flatten the selector structure where possible.")

# Maintenance
REDEFINED = Spec("css.maintenance.redefined_selector", "maintenance", "warning", 10,
                 "Selector `{selector}` is defined multiple times with different declarations.", 0.93,
                 "Merge the rules or make the override intentional and obvious.")
DUPLICATED = Spec("css.maintenance.duplicate_selector", "maintenance", "info", 4,
                  "Selector `{selector}` is duplicated.", 0.9, "Remove repeated copies of the same rule.")
REPEATED_BLOCK = Spec("css.maintenance.repeated_block", "maintenance", "info", 4,
                      "Repeated style block detected for `{selector}`.", 0.8,
                      "Extract shared styles into reusable classes or tokens.")
IMPORTANT = Spec("css.maintenance.important", "maintenance", "warning", 9,
                 "`!important` is used {n} times across the stylesheet.", 0.9,
                 "Reduce `!important` usage and refactor specificity or structure.")
HARDCODED = Spec("css.maintenance.hardcoded", "maintenance", "warning", 10,
                 "Hardcoded colors and sizes dominate this stylesheet.", 0.89,
                 "Move repeated values into CSS custom properties or design tokens.")
REPEATED_VALUE = Spec("css.maintenance.repeated_value", "maintenance", "info", 4,
                      "Repeated declaration value pattern: `{top}`.", 0.78,
                      "Consider tokenizing repeated values or abstracting a component class.")
OVERRIDE_WARS = Spec("css.maintenance.specificity", "maintenance", "warning", 10,
                     "High specificity selector `{selector}` can lead to override wars.", 0.9,
                     "Prefer lower-specificity selectors and component-scoped styling.")


VENDOR = r"^(?:--|-webkit-|-moz-|-ms-|-o-)"
LITERAL = r"(?i)#[0-9a-f]{3,8}\b|\brgba?\([^)]+\)"
COLOR_PROPERTIES = ("color", "background", "background-color", "border-color", "outline-color")
LAYOUT_PROPERTY = (
    r"(?i)\b(?:top|left|right|bottom|width|height|margin|padding|inset|font-size|line-height)\b"
)
UNSAFE_URL_VALUE = r"""(?i)url\s*\(\s*['"]?\s*(?:(?:javascript|vbscript)\s*:|data\s*:\s*text/html)"""
FOCUS_OFF = r"(?i)outline\s*:\s*(none|0)\b|outline-style\s*:\s*none\b|box-shadow\s*:\s*none\b"


def security() -> Column:
    def tests(r):
        body, low = r["body"], F.lower(r["body"])
        return (
            (EXPRESSION, body.rlike(r"(?i)\bexpression\s*\(")),
            (UNSAFE_URL, body.rlike(UNSAFE_URL_VALUE)),
            (BINDING, body.rlike(r"(?i)-moz-binding\s*:|\bbehavior\s*:")),
            (SCRIPT_URL, low.contains("url(") & low.contains("javascript:")))

    return with_snippets(each("sheet_rules", tests, located=True))


def performance() -> Column:
    def tests(r):
        selector, body = r["selector"], r["body"]
        bare = replace_regex(replace_regex(selector, r"\[[^\]]*\]", ""), r"\([^)]*\)", "")
        depth = F.size(extract_all(bare, r"\s+|[>+~]"))
        shadow = F.lower(squeeze(F.regexp_extract(body, r"(?i)box-shadow\s*:\s*([^;]+)", 1)))
        pixels = extract_all(shadow, r"(\d+(?:\.\d+)?)px", 1)
        blurred = shadow.rlike(r"(\d+)(px|rem|em)\s+(\d+)(px|rem|em)\s+(\d+)(px|rem|em)")
        moves = F.lower(body).contains("transition:") | F.lower(body).contains("animation:")
        return (
            (UNIVERSAL, selector.rlike(r"(?:^|[,\s>+~])\*(?:$|[,\s>+~.:#\[])")),
            (HAS, F.lower(selector).contains(":has(")),
            (DEEP_CHAIN, depth > 4),
            (FILTER, body.rlike(r"(?i)(backdrop-filter|filter)\s*:")),
            (TRANSITION_ALL, body.rlike(r"(?i)transition(?:-property)?\s*:\s*all\b")),
            (WILL_CHANGE, body.rlike(r"(?i)will-change\s*:\s*[^;]+")),
            (SHADOWS, F.size(extract_all(shadow, ",")) >= 2),
            (BLUR, blurred & (F.get(pixels, 2).cast("double") >= 32)),
            (LAYOUT_ANIMATION, moves & body.rlike(LAYOUT_PROPERTY)))

    return with_snippets(each("sheet_rules", tests, located=True))


def _declaration_tests(d) -> list:
    prop, value, selector = d["prop"], d["value"], d["selector"]
    length = css_length(value)
    pixels = F.when(length["unit"] == "px", length["number"])
    shown = {"name": prop, "value": value}
    width = prop.isin("width", "min-width", "max-width")
    plain_number = F.when(value.rlike(r"^\d*\.?\d+$"), value.try_cast("double"))
    return [
        (FONT_SIZE, (prop == "font-size") & (pixels < 14), shown),
        (LINE_HEIGHT, (prop == "line-height") & (plain_number < 1.2), shown),
        (FIXED_WIDTH, width & (pixels >= 600), shown),
        (VIEWPORT_WIDTH, width & value.contains("100vw"), shown),
        (VIEWPORT_HEIGHT, (prop == "height") & value.contains("100vh")),
        (ROOT_OVERFLOW, prop.isin("overflow", "overflow-x") & value.contains("hidden")
         & selector.rlike("html|body|#app|#root"), shown),
        (OUTLINE, (prop == "outline") & (value.contains("none") | (value == "0"))),
        (MUTED_FOCUS, (prop == "box-shadow") & (value == "none") & selector.contains(":focus"))]


def _last_value(declarations, *props) -> Column:
    own = F.filter(declarations, lambda d: d["prop"].isin(*props))
    return F.get(own, F.size(own) - 1)["value"]


def rule_contrast(declarations) -> Column:
    """Contrast of the last text and background colours of a rule."""
    back = F.coalesce(_last_value(declarations, "background-color"), _last_value(declarations, "background"))
    both = F.array(_last_value(declarations, "color"), back)
    return let(F.transform(both, lambda v: css_rgb(v)), lambda c: contrast_ratio(F.get(c, 0), F.get(c, 1)))


def _weight(rule) -> Column:
    """Struct (named, heavy, deep) of a rule: whether one of its selectors is too heavy or too deep."""
    return let(selector_array(F.array(rule)), lambda w: F.struct(
        ((rule["selector"] != "") & ~rule["selector"].startswith("@") & ~in_keyframes(rule["context"])).alias("named"),
        F.exists(w, lambda s: (s["ids"] > 1) | ((s["ids"] > 0) & (s["classes"] > 3))).alias("heavy"),
        F.exists(w, lambda s: s["combinators"] > 4).alias("deep")))


def _doubles(rule) -> Column:
    """Struct (prop, same, line) of properties that a rule sets more than once, on the rule's line."""
    def doubles(v):
        return F.transform(F.filter(runs(v, lambda d: d["prop"]), lambda r: r["n"] > 1), lambda r: F.struct(
            F.get(v, r["at"])["prop"].alias("prop"),
            (F.get(v, r["at"])["value"] == F.get(v, r["at"] + r["n"] - 1)["value"]).alias("same"), rule["line"].alias("line")))

    pairs = F.transform(rule["d"], lambda d: F.struct(d["prop"].alias("prop"), d["value"].alias("value")))
    return let(F.array_sort(pairs), doubles)


def style() -> Column:
    read = F.transform("sheet_rules", lambda r: let(_weight(r), lambda w: F.struct(
        r["selector"].alias("selector"), r["body"].alias("body"), w.alias("w"), r["line"].alias("line"),
        F.size(F.filter(r["d"], lambda d: d["important"])).alias("important"),
        rule_contrast(r["d"]).alias("ratio"))))

    def rules(r):
        shown = {"selector": r["selector"]}
        return (
            (EMPTY_SELECTOR, r["selector"] == ""),
            (RULE_IMPORTANT, r["important"] >= 3, {"n": r["important"]}),
            (FOCUS_REMOVED, F.lower(r["selector"]).contains(":focus") & r["body"].rlike(FOCUS_OFF)),
            (CONTRAST, r["ratio"] < 4.5, {"ratio": F.format_string("%.2f", r["ratio"])}),
            (SPECIFIC, r["w"]["named"] & r["w"]["heavy"], shown),
            (CHAIN, r["w"]["named"] & r["w"]["deep"], shown))

    known = known_properties()
    odd = F.filter("sheet_declarations", lambda d: ~d["prop"].rlike(VENDOR) & ~one_of(d["prop"], known))
    near = F.transform(odd, lambda d: F.struct(
        d["prop"].alias("prop"), closest_property(d["prop"], known).alias("close"), d["line"].alias("line")))

    def names(n):
        shown = {"name": n["prop"], "close": F.coalesce(n["close"], F.lit(""))}
        return (MISSPELT, n["close"].isNotNull(), shown), (UNRECOGNIZED, n["close"].isNull(), shown)

    doubles = F.flatten(F.transform("sheet_rules", _doubles))
    return with_snippets(F.concat(
        each("sheet_declarations", _declaration_tests, located=True), each(read, rules, located=True), each(near, names, located=True),
        each(doubles, lambda d: (
            (CONFLICT, ~d["same"], {"prop": d["prop"]}), (REPEATED, d["same"], {"prop": d["prop"]})), located=True)))


def _literals(rule) -> Column:
    """Hard-coded colours of a rule; colour properties count their first value once more."""
    def first_is_literal(prop):
        first = F.get(F.filter(rule["d"], lambda d: d["prop"] == prop), 0)["value"]
        return F.coalesce(first.rlike(LITERAL).cast("int"), F.lit(0))

    every = F.size(F.filter(rule["d"], lambda d: d["value"].rlike(LITERAL)))
    return sum((first_is_literal(p) for p in COLOR_PROPERTIES), every)


def _top_pair(pairs) -> Column:
    """The most common of the texts that occur more than ten times, ties by text."""
    counted = F.transform(repeated_counts(pairs, 11, "p"), lambda r: F.struct((-r["uses"]).alias("n"), r["p"]))
    return F.array_min(counted)["p"]


def _selector_groups(rules) -> Column:
    """Struct (selector, uses, same, heavy, line) of the selectors under the same blocks: whether all bodies are equal, whether
    the selector is too heavy, and the line of the last use."""
    def entry(v, r):
        own = F.slice(v, r["at"] + 1, r["n"])
        bodies = F.transform(own, lambda x: x["body"])
        return F.struct(
            F.get(own, 0)["selector"].alias("selector"), r["n"].alias("uses"), (F.array_min(bodies) == F.array_max(bodies)).alias("same"),
            F.get(own, 0)["heavy"].alias("heavy"), F.get(own, r["n"] - 1)["line"].alias("line"))

    keyed = F.transform(rules, lambda r: F.struct(
        r["context"].alias("context"), r["selector"].alias("selector"), r["rule_no"].alias("rule_no"), r["line"].alias("line"),
        squeeze(r["body"]).alias("body"), _weight(r)["heavy"].alias("heavy")))
    group = lambda x: F.struct(x["context"].alias("context"), x["selector"].alias("selector"))
    return let(F.array_sort(keyed), lambda v: F.transform(runs(v, group), lambda r: entry(v, r)))


def _first_block(rules) -> Column:
    """The selector of the first rule that stands more than eight times, as an array of at most one."""
    blocks = F.transform(F.filter(rules, lambda r: F.size(r["d"]) > 0), lambda r: F.struct(
        r["selector"].alias("selector"), signature(r).alias("signature"), r["rule_no"].alias("rule_no")))
    group = lambda x: F.struct(x["selector"].alias("selector"), x["signature"].alias("signature"))
    often = let(F.array_sort(blocks), lambda v: F.transform(
        F.filter(runs(v, group), lambda r: r["n"] > 8), lambda r: F.struct(
            F.get(v, r["at"])["rule_no"].alias("rule_no"), F.get(v, r["at"])["selector"].alias("selector"))))
    return F.array_compact(F.array(F.array_min(often)["selector"]))


def maintenance() -> Column:
    plain = F.filter("sheet_rules", lambda r: (r["selector"] != "") & ~r["selector"].startswith("@"))
    pairs = F.transform("sheet_declarations", lambda d: F.concat(d["prop"], F.lit(":"), d["value"]))
    totals = F.array(F.struct(
        F.aggregate(F.transform("sheet_rules", _literals), F.lit(0), lambda n, x: n + x).alias("literals"),
        F.exists("sheet_declarations", lambda d: d["value"].contains("var(")).alias("uses_var"),
        F.size(F.filter("sheet_declarations", lambda d: d["important"])).alias("important"),
        let(pairs, _top_pair).alias("top")))
    shown = lambda r: {"selector": r["selector"]}
    return with_snippets(F.concat(
        each(_selector_groups(plain), lambda g: (
            (REDEFINED, (g["uses"] > 1) & ~g["same"], shown(g)), (DUPLICATED, (g["uses"] > 1) & g["same"], shown(g)),
            (OVERRIDE_WARS, g["heavy"], shown(g))), located=True),
        on_line(each(_first_block(F.col("sheet_rules")), lambda s: ((REPEATED_BLOCK, F.lit(True), {"selector": s}),)), F.lit(1)),
        on_line(each(totals, lambda t: (
            (IMPORTANT, t["important"] >= 8, {"n": t["important"]}),
            (HARDCODED, (t["literals"] >= 10) & ~t["uses_var"]),
            (REPEATED_VALUE, t["top"].isNotNull(), {"top": t["top"]}))), F.lit(1))))


# Utility classes
DYNAMIC_CLASS = Spec("utility.dynamic", "security", "warning", 10,
                     "Dynamic class construction can hide user-controlled styling.", 0.9,
                     "Constrain class inputs to a safe allowlist instead of concatenating raw user input.")
INTERPOLATED = Spec("utility.interpolated", "framework", "warning", 8,
                    "Template interpolation appears inside a class string.", 0.88,
                    "Keep class strings static where possible, or precompute class names safely.")
LONG_LIST = Spec("utility.long_list", "maintainability", "info", 4, "Very long utility string.", 0.86,
                 "Extract a component class or reusable variant bundle.")
UNBALANCED = Spec("utility.unbalanced", "syntax", "error", 18, "Malformed arbitrary value in `{token}`.", 0.98,
                  "Balance the square brackets and keep the arbitrary value syntax valid.")
NO_BASE = Spec("utility.no_base", "syntax", "error", 18, "Broken variant chain in `{token}`.", 0.98,
               "Add a real utility after the variant chain, for example `sm:hover:bg-blue-500`.")
BAD_VARIANT = Spec("utility.bad_variant", "syntax", "error", 18, "Broken variant syntax in `{token}`.", 0.98,
                   "Remove the trailing colon or malformed separator.")
BAD_VALUE = Spec("utility.bad_value", "syntax", "error", 18, "Malformed arbitrary value in `{token}`.", 0.98,
                 "Fix the bracketed value, quotes, and parentheses.")
UNKNOWN_VARIANT = Spec("utility.unknown_variant", "config", "info", 4,
                       "Unknown or custom variant `{variant}`; verify Tailwind config support.", 0.76,
                       "Check whether the breakpoint, plugin variant, or screen name is defined in your Tailwind "
                       "config.")
IMPORTANT_UTILITY = Spec("utility.important", "maintainability", "info", 4,
                         "Important utility `{token}` reduces clarity.", 0.86,
                         "Avoid `!` utilities unless they are truly the last resort.")
ARBITRARY = Spec("utility.arbitrary", "design-system", "info", 4,
                 "Arbitrary value utility `{token}` may drift from design tokens.", 0.84,
                 "Prefer approved design tokens or extend the Tailwind theme.")
UNKNOWN_BASE = Spec("utility.unknown_base", "config", "info", 3,
                    "Unknown or custom utility `{base}`; verify it exists in Tailwind config.", 0.7,
                    "Confirm that this utility comes from core Tailwind, a plugin, or your theme extensions.")
SMALL_TEXT = Spec("utility.small_text", "accessibility", "warning", 8,
                  "Small text utility `{token}` may be hard to read.", 0.82,
                  "Use a larger text size or a better responsive scale.")
MOTION = Spec("utility.motion", "accessibility", "info", 4,
              "Motion-heavy utility `{token}` should have a reduced-motion fallback.", 0.79,
              "Add `motion-reduce:` alternatives for users who prefer less motion.")
GROUP_CONFLICT = Spec("utility.conflict", "conflict", "warning", 9,
                      "Conflicting `{group}` utilities in the same class list: {tokens}.", 0.92,
                      "Keep only the utility that expresses the final intent for that state/breakpoint.")
HOVER_ONLY = Spec("utility.hover_only", "accessibility", "info", 4,
                  "Hover styling exists without a focus counterpart.", 0.82,
                  "Add `focus:` or `focus-visible:` styles for keyboard users.")
HIDDEN = Spec("utility.hidden", "responsive", "info", 4,
              "Content is hidden by default and only revealed at breakpoints.", 0.8,
              "Verify that the mobile experience still exposes the needed content or controls.")
RING = Spec("utility.focus_ring", "accessibility", "warning", 10, "Focus ring removal detected.", 0.93,
            "Replace the removed ring with a visible, accessible focus treatment.")
MANY_ARBITRARY = Spec("utility.many_arbitrary", "performance", "info", 4,
                      "Many arbitrary utilities reduce reuse and can bloat styling patterns.", 0.81,
                      "Promote repeated arbitrary values into theme tokens.")
BUNDLE = Spec("utility.repeated_bundle", "maintenance", "info", 4,
              "Repeated utility bundle found across multiple elements.", 0.78,
              "Extract a reusable component or class recipe.")
MANY_DYNAMIC = Spec("utility.many_dynamic", "security", "warning", 10,
                    "Multiple dynamic class expressions were detected.", 0.84,
                    "Constrain dynamic style inputs to safe presets instead of free-form strings.")
DRIFT = Spec("utility.token_drift", "design-system", "warning", 9,
             "Excessive arbitrary value usage suggests token drift.", 0.9,
             "Move those values into the Tailwind theme or a shared design token set.")

DYNAMIC_CALL = r"clsx\(|cn\(|(?i:classnames\()"


def _sound(parts) -> Column:
    return F.filter(parts, lambda p: p["state"].isNull())


def _list_tests(l) -> list:
    parts = l["sound"]
    with_variant = lambda *names: F.exists(parts, lambda p: F.exists(p["variants"], lambda v: v.isin(*names)))
    with_base = lambda base: F.exists(parts, lambda p: p["base"] == base)
    bracketed = F.size(F.filter(l["tokens"], lambda t: t.contains("[") & t.contains("]")))
    return [
        (DYNAMIC_CLASS, l["dynamic"]), (INTERPOLATED, l["value"].rlike(DYNAMIC)),
        (LONG_LIST, F.size(l["tokens"]) >= 18),
        (HOVER_ONLY, with_variant("hover") & ~with_variant("focus", "focus-visible")),
        (HIDDEN, with_base("hidden") & with_variant(*BREAKPOINTS)),
        (RING, with_base("outline-none")),
        (MANY_ARBITRARY, bracketed >= 4)]


def _token_tests(t) -> list:
    state, base, ok = t["state"], t["base"], t["state"].isNull()
    shown = {"token": t["token"], "base": base}
    motion = base.startswith("animate-") | (base == "transition-all")
    return [
        (UNBALANCED, state == "unbalanced", shown), (NO_BASE, state == "no_base", shown),
        (BAD_VARIANT, state == "bad_variant", shown), (BAD_VALUE, state == "bad_value", shown),
        (IMPORTANT_UTILITY, ok & t["important"], shown),
        (ARBITRARY, ok & base.rlike(r"[\[\]]"), shown),
        (UNKNOWN_BASE, ok & ~known_base(base) & ~base.startswith("["), shown),
        (SMALL_TEXT, ok & base.rlike(r"^text-(?:xs|sm|\[.*\])$"), shown),
        (MOTION, ok & motion & ~t["reduced"], shown)]


def _list_tokens(l) -> Column:
    """Tokens of a list, each with whether a reduced-motion variant stands up to it."""
    reduced = F.transform(l["parts"], lambda p: F.coalesce(
        F.array_contains(p["variants"], "motion-reduce") & p["state"].isNull(), F.lit(False)))
    return let(F.array_position(reduced, True), lambda at: F.transform(l["parts"], lambda p, i: F.struct(
        *[p[n].alias(n) for n in ("token", "state", "base", "important")],
        ((at > 0) & (at <= i + 1)).alias("reduced"), l["line"].alias("line"))))


def _list_conflicts(l) -> Column:
    """Struct (group, tokens, line): different tokens of one group under one set of variants in a list."""
    keyed = F.transform(
        F.filter(l["sound"], lambda p: p["utility_group"] != "other"), lambda p: F.struct(
            F.array_sort(F.filter(p["variants"], lambda v: v != "")).alias("v"), p["utility_group"].alias("g"),
            p["token"].alias("t")))
    group = lambda p: F.struct(p["v"].alias("v"), p["g"].alias("g"))

    def conflicts(v):
        def entry(r):
            tokens = F.array_distinct(F.transform(F.slice(v, r["at"] + 1, r["n"]), lambda p: p["t"]))
            return F.struct(F.get(v, r["at"])["g"].alias("group"), tokens.alias("tokens"), l["line"].alias("line"))

        several = F.filter(runs(v, group), lambda r: r["n"] > 1)
        return F.filter(F.transform(several, entry), lambda c: F.size(c["tokens"]) > 1)

    return let(F.array_sort(keyed), conflicts)


def utility() -> Column:
    """Class lists of pages and component files."""
    lists = F.transform("class_lists", lambda l: F.struct(
        *[l[n].alias(n) for n in ("value", "tokens", "parts", "line")], _sound(l["parts"]).alias("sound"),
        (l["value"].rlike(DYNAMIC) | l["value"].rlike(DYNAMIC_CALL)).alias("dynamic")))

    def read(v):
        flat = lambda items: F.flatten(F.transform(v, items))
        variants = flat(lambda l: F.transform(F.flatten(F.transform(l["sound"], lambda p: p["variants"])), lambda x: F.struct(
            x.alias("variant"), l["line"].alias("line"))))
        bundles = F.filter(
            F.transform(v, lambda l: F.array_sort(F.array_distinct(l["tokens"]))), lambda b: F.size(b) > 4)
        bases = F.filter(
            flat(lambda l: F.transform(l["sound"], lambda p: p["base"])), lambda b: b.rlike(r"[\[\]]"))
        return F.concat(
            each(v, _list_tests, located=True), each(flat(_list_tokens), _token_tests, located=True),
            each(variants, lambda x: ((UNKNOWN_VARIANT, ~known_variant(x["variant"]), {"variant": x["variant"]}),), located=True),
            each(flat(_list_conflicts), lambda c: ((GROUP_CONFLICT, F.lit(True), {
                "group": c["group"], "tokens": F.array_join(F.slice(c["tokens"], 1, 3), ", ")}),), located=True),
            once(
                (BUNDLE, F.size(repeated(bundles, 5)) > 0),
                (DRIFT, F.size(F.array_distinct(bases)) >= 6),
                (MANY_DYNAMIC, F.size(F.filter(v, lambda l: l["dynamic"])) >= 3), line=1))

    return with_snippets(let(lists, read))


CSS = ("css",)
CHECKS = {
    "css.security": RowCheck(CSS, ("sheet_rules", "text_lines"), security),
    "css.performance": RowCheck(CSS, ("sheet_rules", "text_lines"), performance),
    "css.style": RowCheck(CSS, ("sheet_rules", "sheet_declarations", "text_lines"), style),
    "css.maintenance": RowCheck(CSS, ("sheet_rules", "sheet_declarations", "text_lines"), maintenance),
    "utility": RowCheck(("html", "react"), ("class_lists", "text_lines"), utility),
}
