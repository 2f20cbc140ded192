"""Rule packs for Python text. Patterns, thresholds, impacts and messages are fixed values.

Call-shaped rules look at text with comments and strings blanked. They read lines, not a syntax tree: calls
spread over several lines and aliased imports are missed.
"""

from ...functions.text import longer_line
from ..rules import Rule, at_least, contains, exceeds, has

LANG = "python"
CODE = "py_code"
START = r"(?:^|[^\w.])"


def _pack(pack, category=None):
    return lambda name, severity, impact, message, *all_of, category=category or pack, **more: Rule(
        f"python.{pack}.{name}", LANG, category, severity, impact, message, tuple(all_of), **more)


SHELL = r"(?:os\.system|subprocess\.(?:run|call|Popen))"

r = _pack("security")
SECURITY = [
    r("secret_value", "medium", 18, "Possible secret exposure in source code.",
      has(r"""(?i)\b(api[_-]?key|secret|token|password|passwd|pwd|private[_-]?key)\s*=\s*['"][^'"]{8,}['"]""",
          needs=("key", "secret", "token", "passw", "pwd"))),
    r("private_key", "high", 30, "Possible secret exposure in source code.",
      has(r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", needs="PRIVATE KEY-----")),
    r("logged_secret", "medium", 12, "Sensitive values may be logged or printed.",
      has(r"(?i)\b(password|secret|token|api[_-]?key)\b.*\b(print|logger\.)", needs=("print", "logger."))),
    r("eval", "high", 30, "Use of eval can execute arbitrary code.", has(START + r"eval\s*\(", CODE, "eval"), emit="each"),
    r("exec", "high", 30, "Use of exec can execute arbitrary code.", has(START + r"exec\s*\(", CODE, "exec"), emit="each"),
    r("pickle", "high", 25, "Unsafe pickle deserialization can lead to code execution.",
      has(START + r"pickle\.loads?\s*\(", CODE, "pickle.load"), emit="each"),
    r("yaml_load", "high", 20, "yaml.load without SafeLoader is risky.",
      has(START + r"yaml\.load\s*\(", CODE, "yaml.load"), emit="each"),
    r("shell_true", "high", 35, "shell=True or os.system can enable command injection.",
      has(START + r"(?:os\.system\s*\(|subprocess\.(?:run|call|Popen)\s*\([^\n]*\bshell\s*=\s*True\b)", CODE,
          ("os.system", "subprocess.")),
      emit="each"),
    r("shell_string", "medium", 16, "Suspicious shell command string detected.",
      has(r"\b" + SHELL + r"""\s*\(\s*["'][^"'\n]*(?:;|&&|\||`|\$\(|>|<)""",
          needs=("os.system", "subprocess.")), emit="each"),
    r("sensitive_log", "medium", 12, "Sensitive data may be logged or printed.",
      has(r"(?i)(?:^|[^\w.])(?:print|logging\.(?:debug|info|warning|error|critical)|logger\.\w+)\s*\([^\n]*"
          r"\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b", needs=("print", "logging.", "logger.")), emit="each"),
    r("interpolated", "low", 4, "Sensitive-looking value may be interpolated into a string.",
      has(r"""(?i)\bf(?:"[^"\n]*\b(?:password|secret|token|api[_-]?key)\b"""
          r"""|'[^'\n]*\b(?:password|secret|token|api[_-]?key)\b)""",
          needs=("password", "secret", "token", "api")), emit="each"),
    r("credential_access", "low", 4, "Sensitive-looking credential access found in code.",
      has(r"(?i)\b\w+\.(?:password|secret|token|api_?key)\b|\b(?:password|secret|token|api_?key)\.\w+", CODE,
          (".password", ".secret", ".token", ".api", "password.", "secret.", "token.", "key.")),
      emit="each"),
    r("path_join", "high", 20, "Unsafe path join may allow path traversal.",
      has(r"\b(?:os\.path\.join|Path\.joinpath)\s*\([^\n]*(?:\.\.|input|request|argv|form|json)",
          needs=("os.path.join", "Path.joinpath")), emit="each"),
]

r = _pack("efficiency")
EFFICIENCY = [
    r("many_opens", "low", 5, "Repeated file opening may hurt performance.", at_least(r"open\(", 4, needs="open(")),
    r("many_queries", "medium", 10, "Many DB calls may indicate an N+1 query pattern.",
      at_least(r"\.execute\(", 6, needs=".execute(")),
    r("many_sleeps", "medium", 8, "Multiple sleep calls can throttle throughput.",
      at_least(r"time\.sleep\(", 2, needs="time.sleep(")),
]

WILDCARD = has(r"\bimport\s+\*", needs="import")
WILDCARD_MESSAGE = "Wildcard imports reduce clarity and can cause namespace collisions."

r = _pack("maintenance")
MAINTENANCE = [
    r("large_file", "medium", 8, "Large Python files are harder to maintain.", exceeds("line_count", 400)),
    r("print", "low", 4, "Debug print statements should be removed or logged properly.", contains("print(")),
    r("bare_except", "medium", 10, "Bare except blocks make debugging and recovery harder.",
      has(r"(?m)^\s*except\s*:\s*$", needs="except")),
    r("wildcard", "medium", 8, WILDCARD_MESSAGE, WILDCARD),
]

r = _pack("style")
STYLE = [
    r("long_line", "low", 2, "Line exceeds 88 characters.", has(longer_line(88))),
    r("wildcard", "medium", 8, WILDCARD_MESSAGE, WILDCARD),
    r("trailing_blanks", "low", 1, "Trailing whitespace detected.", has(r"(?m)[ \t]$")),
]

r = _pack("correctness")
CORRECTNESS = [
    r("wildcard", "medium", 8, "Wildcard imports reduce clarity and safety.",
      has(r"(?m)^\s*from\s+[\w.]+\s+import\s+\*", CODE, "import"), emit="each", category="style"),
    r("none_equality", "low", 3, "Use 'is None' or 'is not None' instead of '== None'.",
      has(r"(?:==|!=)\s*None\b", CODE, "None"), emit="each"),
    r("broad_except", "high", 20, "Broad exception handling can hide real bugs.",
      has(r"(?m)^\s*except\s*(?:\(?\s*(?:Exception|BaseException)\s*\)?(?:\s+as\s+\w+)?\s*)?:", CODE, "except"),
      emit="each"),
    r("assert", "low", 4, "assert is not a runtime validation strategy.",
      has(r"(?m)^\s*assert\b", CODE, "assert"), emit="each"),
    r("mutable_default", "high", 18, "Mutable default argument can cause shared-state bugs.",
      has(r"(?m)^\s*(?:async\s+)?def\s+\w+\s*\([^\n]*=\s*(?:\[|\{|(?:list|dict|set)\s*\()", CODE, "def"), emit="each"),
]

PACKS = {
    "python.security": SECURITY,
    "python.efficiency": EFFICIENCY,
    "python.maintenance": MAINTENANCE,
    "python.style": STYLE,
    "python.correctness": CORRECTNESS,
}
