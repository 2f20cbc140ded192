"""Rules as data, and their compilation into one projection.

A rule fires when all clauses of `all_of` hold and, if given, one of `any_of`. A clause tests a subject:
the file text or a derived feature. Rules become literal patterns inside one array expression per
language, so every text is read once and no shuffle or Python evaluation is needed.
"""

from dataclasses import asdict, dataclass, fields
from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import (
    count_regex, count_substr, extract_all, first_position, has_longer_line, let, line_of, longer_line_width, matches,
    regex, render_message, scaled_impact, scaled_severity, snippet_of,
)
from ..model import RULES
from .checks import constant_finding, told_once
from .features import FEATURES, SOUGHT, sought


@dataclass(frozen=True)
class Clause:
    test: str
    subject: str = "text"
    pattern: str = ""
    present: str = ""
    missing: str = ""
    threshold: float = 0.0
    needles: tuple = ()


def _words(needs) -> tuple:
    return (needs,) if isinstance(needs, str) else tuple(needs)


def has(pattern, on="text", needs=()):
    """The pattern matches. `needs` names literals of which every match holds one: a text without them is not
    put to the costlier pattern. They are lower-case where the pattern ignores case."""
    return Clause("match", on, pattern, needles=_words(needs))


def lacks(pattern, on="text", needs=()):
    return Clause("absent", on, pattern, needles=_words(needs))


def contains(literal, on="text"):
    return Clause("contains", on, literal)


def omits(literal, on="text"):
    return Clause("omits", on, literal)


def at_least(pattern, n, on="text", needs=()):
    return Clause("at_least", on, pattern, threshold=n, needles=_words(needs))


def at_most(pattern, n, on="text"):
    return Clause("at_most", on, pattern, threshold=n)


def chars_over(n, on="text"):
    return Clause("chars_over", on, threshold=n)


def reaches(feature, n):
    """A numeric feature is at least n."""
    return Clause("reaches", feature, threshold=n)


def exceeds(feature, n):
    return Clause("exceeds", feature, threshold=n)


def some(pattern, present="", missing="", on="text", needs=()):
    """One of the matches contains `present` and does not contain `missing`."""
    return Clause("some", on, pattern, present, missing, needles=_words(needs))


def first(pattern, present="", missing="", on="text"):
    """The first match contains `present` and does not contain `missing`."""
    return Clause("first", on, pattern, present, missing)


def uneven(left, right, on="text"):
    """Two literals occur a different number of times."""
    return Clause("uneven", on, left, right)


@dataclass(frozen=True)
class Rule:
    rule_id: str
    language: str
    category: str
    severity: str
    impact: int
    message: str
    all_of: tuple = ()
    any_of: tuple = ()
    emit: str = "once"
    measure: str | None = None
    div: int | None = None
    cap: int | None = None
    step: int | None = None
    severity_above: str | None = None
    locate: str | None = None
    confidence: float | None = None
    fix: str | None = None
    enabled: bool = True


def _held(piece, clause) -> Column:
    out = F.lit(True)
    if clause.present:
        out = out & piece.rlike(regex(clause.present))
    if clause.missing:
        out = out & ~piece.rlike(regex(clause.missing))
    return out


def ignores_case(c: Clause) -> bool:
    return c.pattern.startswith(("(?i", "(?si", "(?mi"))


#: Characters of texts in several languages and of code from the commonest on; all others are rarer.
COMMON = " etanirsoldhucmgpfbvwykz.,x()jq"


def rare_end(needle: str) -> str:
    """The end of a literal, of three characters at least, that starts with its rarest character.

    A search looks closer at every place with the first character, so it is faster with a rare one.
    """
    rank = lambda ch: COMMON.index(ch) if ch in COMMON else len(COMMON)
    return needle[max(range(max(len(needle) - 2, 1)), key=lambda i: (rank(needle[i]), -i)):]


def holds(subject: str, needle: str) -> Column:
    """Whether a subject holds a literal: the parts that others look for too, then its end, then all of it."""
    known, text, end = sought(subject, needle), F.col(subject), rare_end(needle)
    parts = [F.col(f"`{name}`") for name in known]
    if needle not in SOUGHT.get(subject, ()):
        parts += [text.contains(n) for n in dict.fromkeys((end, needle))]
    return reduce(lambda a, b: a & b, parts)


def _searched(c: Clause) -> str:
    """The subject in which the needles of a clause are looked for."""
    return "lower_text" if ignores_case(c) else c.subject


def _with_needle(c: Clause, test: Column) -> Column:
    """The cheap search for a literal before the pattern; `and` stops at the first that fails."""
    if not c.needles:
        return test
    return reduce(lambda a, b: a | b, [holds(_searched(c), n) for n in c.needles]) & test


def clause_column(c: Clause) -> Column:
    s = F.col(c.subject)
    if c.test == "match":
        width = longer_line_width(c.pattern)
        return _with_needle(c, matches(s, c.pattern) if width is None else has_longer_line(s, width))
    if c.test == "absent":
        return ~_with_needle(c, matches(s, c.pattern))
    if c.test == "contains":
        return s.contains(c.pattern)
    if c.test == "omits":
        return ~s.contains(c.pattern)
    if c.test == "at_least":
        return _with_needle(c, count_regex(s, c.pattern) >= int(c.threshold))
    if c.test == "at_most":
        return count_regex(s, c.pattern) <= int(c.threshold)
    if c.test == "chars_over":
        return F.length(s) > int(c.threshold)
    if c.test == "reaches":
        return s >= c.threshold
    if c.test == "exceeds":
        return s > c.threshold
    if c.test == "some":
        return _with_needle(c, F.exists(extract_all(s, c.pattern), lambda m: _held(m, c)))
    if c.test == "first":
        found = F.regexp_extract(s, regex(c.pattern), 0)
        return (found != "") & _held(found, c)
    if c.test == "uneven":
        return count_substr(s, c.pattern) != count_substr(s, c.present)
    raise ValueError(f"unknown test {c.test!r}")


QUICK = ("contains", "omits", "chars_over", "reaches", "exceeds")


def _cheap_first(clauses) -> list[Clause]:
    """Clauses by their cost: literals and numbers, patterns behind a literal, other patterns. `and` and `or` stop early."""
    return sorted(clauses, key=lambda c: 0 if c.test in QUICK else 1 if c.needles else 2)


def condition(rule: Rule) -> Column:
    parts = [clause_column(c) for c in _cheap_first(rule.all_of)]
    if rule.any_of:
        parts.append(reduce(lambda a, b: a | b, [clause_column(c) for c in _cheap_first(rule.any_of)]))
    return reduce(lambda a, b: a & b, parts)


def _finding(rule: Rule) -> Column:
    out = constant_finding(
        rule.rule_id, rule.category, rule.severity, rule.impact, rule.message, rule.confidence, rule.fix)
    if rule.measure:
        count = F.col(rule.measure)
        if "{n}" in rule.message:
            out = out.withField("message", render_message(rule.message, n=count))
        if rule.cap is not None:
            out = out.withField("score_impact", scaled_impact(count, rule.impact, rule.div, rule.cap))
        if rule.step is not None:
            out = out.withField("severity", scaled_severity(count, rule.severity, rule.step, rule.severity_above))
    if rule.locate:
        line = line_of("text", first_position("text", rule.locate))
        out = let(line, lambda n: out.withField("line", n).withField("snippet", snippet_of("text", n)))
    return out


#: Columns of rules, checks and features as built: thousands of calls to the JVM that are the same for every scan.
_BUILT: dict = {}
MOST_BUILT = 4_096


def built(key, build) -> Column:
    """The column that `build` gives for a key, built once per JVM."""
    key = (id(SparkContext._gateway), key)
    if key not in _BUILT:
        if len(_BUILT) >= MOST_BUILT:
            _BUILT.clear()
        _BUILT[key] = build()
    return _BUILT[key]


def _emitted(rule: Rule) -> Column:
    """Array of the rule's findings in this file, null when it does not fire."""
    return built(rule, lambda: _emitted_now(rule))


def _emitted_now(rule: Rule) -> Column:
    if rule.emit == "each":
        hits = count_regex(F.col(rule.all_of[0].subject), rule.all_of[0].pattern)
        return F.when(condition(rule), F.array_repeat(_finding(rule), hits))
    return F.when(condition(rule), F.array(_finding(rule)))


def by_language(rules) -> dict[str, list[Rule]]:
    out: dict[str, list[Rule]] = {}
    for rule in rules:
        if rule.enabled:
            out.setdefault(rule.language, []).append(rule)
    return out


def _needs(rules, checks) -> dict[str, set]:
    """Features with the languages whose rules or checks read them."""
    needs: dict[str, set] = {}

    def add(name, language):
        if name in FEATURES:
            needs.setdefault(name, set()).add(language)
            for n in FEATURES[name].needs:
                add(n, language)

    for language, group in by_language(rules).items():
        for rule in group:
            for clause in (*rule.all_of, *rule.any_of):
                add(clause.subject, language)
                for needle in clause.needles:
                    add(_searched(clause), language)
                    for name in sought(_searched(clause), needle):
                        add(name, language)
            add(rule.measure, language)
    for check in checks:
        for language in check.languages:
            for name in check.needs:
                add(name, language)
    return needs


def with_features(files: DataFrame, rules, checks=()) -> DataFrame:
    """Derive the features some rule or check reads, each only in the languages that read it.

    Features that need others come one projection later, so nothing is computed twice.
    """
    needs, done = _needs(rules, checks), set()
    while len(done) < len(needs):
        ready = [n for n in needs if n not in done and all(d in done for d in FEATURES[n].needs)]
        files = files.withColumns({
            n: F.when(F.col("language").isin(*sorted(needs[n])), built(n, FEATURES[n].column)) for n in ready})
        done.update(ready)
    return files


def findings_array(rules, checks=()) -> Column:
    """All findings of a file's language as one array; of a style sheet one of those told alike."""
    groups = by_language(rules)
    for check in checks:
        for language in check.languages:
            groups.setdefault(language, [])
    columns = [(check.languages, built(check, check.build)) for check in checks]
    out = F
    for language, group in groups.items():
        found = [F.flatten(F.array_compact(F.array(*[_emitted(r) for r in group])))] if group else []
        found += [column for languages, column in columns if language in languages]
        whole = F.concat(*found)
        out = out.when(F.col("language") == language, told_once(whole) if language == "css" else whole)
    return out


# Rules as a table ---------------------------------------------------------------------------------------------

def rules_table(spark: SparkSession, rules) -> DataFrame:
    rows = []
    for rule in rules:
        row = asdict(rule)
        for key in ("all_of", "any_of"):
            row[key] = [{**c, "threshold": float(c["threshold"])} for c in row[key]]
        rows.append(tuple(row[f.name] for f in RULES.fields))
    return spark.createDataFrame(rows, RULES)


def rules_from_table(table: DataFrame) -> list[Rule]:
    """Read a rule table to the driver, where rules become expressions; its size is that of the rules, not of the data."""
    rows = table.collect()
    names = [f.name for f in fields(Rule)]
    out = []
    for row in rows:
        values = {n: row[n] for n in names}
        for key in ("all_of", "any_of"):
            values[key] = tuple(Clause(**{**c.asDict(), "needles": tuple(c["needles"])}) for c in row[key] or [])
        out.append(Rule(**values))
    return sorted(out, key=lambda r: r.rule_id)
