"""Rule packs for style sheets and utility-class configuration. All texts and numbers are fixed values."""

from ..rules import Rule, at_least, contains, exceeds, has

LANG = "css"


def _r(rule_id, lang, category, severity, impact, message, *all_of, **more):
    return Rule(rule_id, lang, category, severity, impact, message, tuple(all_of), **more)


CSS = [
    _r("css.maintenance.large_file", LANG, "maintenance", "warning", 8,
       "Very large CSS files become harder to maintain and review.", exceeds("line_count", 300),
       locate=r"^", confidence=0.95, fix="Split the stylesheet into smaller component-scoped files."),
    _r("css.security.remote_import", LANG, "security", "warning", 12,
       "Remote `@import` can create performance and supply-chain risk.",
       has(r"""(?i)@import\s+(?:url\()?\s*['"]?(?:https?:)?//"""),
       locate=r"(?i)@import", confidence=0.9, fix="Prefer local bundling or explicit trusted sources."),
    _r("css.security.external_import", LANG, "security", "warning", 10,
       "External stylesheet imports can expand the attack surface.",
       has(r"""(?i)@import\s+url\(\s*['"]?https?://"""),
       locate=r"(?i)@import", confidence=0.86, fix="Bundle trusted CSS locally whenever possible."),
    _r("css.style.tabs", LANG, "style", "low", 2, "Tabs are used in CSS indentation.", contains("\t"),
       locate=r"\t", confidence=0.9, fix="Use spaces for consistent indentation."),
]

CONFIG_NAME = has(r"^tailwind\.config\.(?:js|cjs|mjs|ts)$", "file_name")
PURGE, JIT, SAFELIST = r"(?i)\bpurge\s*:", r"""(?i)\bmode\s*:\s*['"]jit['"]""", r"(?i)\bsafelist\s*:\s*\["

CONFIG = [
    _r("utility.config.purge", "javascript", "tailwind-config", "warning", 10,
       "`purge:` is deprecated in modern Tailwind config.", CONFIG_NAME, has(PURGE),
       locate=PURGE, confidence=0.97, fix="Replace `purge:` with `content:`."),
    _r("utility.config.jit", "javascript", "tailwind-config", "info", 3,
       "Explicit `mode: 'jit'` is obsolete in Tailwind v3+.", CONFIG_NAME, has(JIT),
       locate=JIT, confidence=0.95, fix="Remove the `mode: 'jit'` setting unless you are on an older stack."),
    _r("utility.config.safelist", "javascript", "performance", "info", 4,
       "Large safelists can inflate generated CSS.", CONFIG_NAME, has(SAFELIST), at_least(r"safelist", 2),
       locate=SAFELIST, confidence=0.84, fix="Keep the safelist narrow and intentional."),
]

PACKS = {
    **{f"css.{pack}": [r for r in CSS if r.rule_id.startswith(f"css.{pack}.")]
       for pack in ("security", "style", "maintenance")},
    "utility.config": CONFIG,
}
