"""Text metrics, hashes, scores, bands, counts and message rendering."""

import re
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, functions as F

# Score bands of the printed report and of the result page, highest first.
REPORT_BANDS = ((85, "Good"), (70, "Fair"), (50, "Weak"), (0, "Poor"))
PAGE_BANDS = ((80, "good"), (50, "warn"), (0, "bad"))

# The characters that end a line, as in Python's splitlines; a newline behind a return belongs to it.
ENDS = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
LINE_END = r"\r\n|[%s]" % ENDS
ENDS_BUT_NEWLINE = r"[%s&&[^\n]]" % ENDS
#: The same characters, to be searched for one by one.
OTHER_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def col(c):
    return F.col(c) if isinstance(c, str) else c


def sql_text(value) -> str:
    """A Python value as a SQL literal."""
    if value is None:
        return "null"
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    return str(value)


def one_of(value, names) -> Column:
    """Membership in a list of constants, as one SQL literal."""
    return F.array_contains(constants(names), col(value))


def constants(names) -> Column:
    return F.expr("array(" + ", ".join(sql_text(n) for n in names) + ")")


def let(value, body) -> Column:
    """Bind a value to a name inside an expression, so that a long expression is not repeated at every use."""
    return F.get(F.transform(F.array(value), body), 0)


#: A pattern that starts with a word's bound and a letter, or a group of alternatives without groups in it.
LEADING = re.compile(
    r"(?P<flags>(?:\(\?[a-z]+\))?)"
    r"(?P<rest>\\b(?:(?P<one>\w(?![*?{]))|\((?:\?:)?(?P<several>(?:[^()\\]|\\.)*)\)(?![*?{])).*)", re.S)


def led(pattern: str) -> str:
    """The same pattern with a look at the first letter in front of the word's bound, which takes longer to tell."""
    found = LEADING.fullmatch(pattern)
    words = [found["one"]] if found and found["one"] else found["several"].split("|") if found else []
    if not words or not all(re.match(r"[A-Za-z0-9_](?![*?{])", w) for w in words):
        return pattern
    return f"{found['flags']}(?=[{''.join(sorted({w[0] for w in words}))}]){found['rest']}"


def regex(pattern: str) -> str:
    """Make `.`, `^` and `$` know only the newline as line end, as in Python."""
    return "(?d)" + led(pattern)


def matches(text, pattern: str) -> Column:
    return col(text).rlike(regex(pattern))


def extract_all(text, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(text), F.lit(regex(pattern)), group)


def count_regex(text, pattern: str) -> Column:
    return F.regexp_count(col(text), F.lit(regex(pattern)))


def replace_regex(text, pattern: str, by: str) -> Column:
    return F.regexp_replace(col(text), regex(pattern), by)


def count_substr(text, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    text = col(text)
    shorter = F.octet_length(F.replace(text, F.lit(needle), F.lit("")))
    return F.floor((F.octet_length(text) - shorter) / F.lit(len(needle.encode()))).cast("int")


def count_substrs(text, needles) -> Column:
    """Sum of the counts of several literals; overlapping literals count each on their own.

    Most are not there: searching for one is cheaper than replacing it.
    """
    text = col(text)
    return reduce(add, [F.when(~text.contains(n), 0).otherwise(count_substr(text, n)) for n in needles])


def line_ends(text) -> Column:
    """Number of line ends; most texts know only newlines, which are counted without the wide class."""
    text = col(text)
    return F.when(text.rlike(ENDS_BUT_NEWLINE), count_regex(text, LINE_END)).otherwise(count_substr(text, "\n"))


def strip(text) -> Column:
    return F.btrim(col(text), F.lit(" \t\n\r\x0b\x0c"))


def line_count(text) -> Column:
    text = col(text)
    open_end = (text != "") & ~text.endswith("\n")
    return count_substr(text, "\n") + open_end.cast("int")


#: In front of a line's first character; without it a search tries again from every character of a short line.
LINE_START = r"(?<![^%s])" % ENDS


def longer_line(width: int) -> str:
    """Pattern of the start of a line of more than `width` characters."""
    return LINE_START + "[^%s]{%d}" % (ENDS, width + 1)


def longer_line_width(pattern: str) -> int | None:
    """The width of which `longer_line` gives the pattern, null for all others."""
    width = re.search(r"\{(\d+)\}\Z", pattern)
    return int(width[1]) - 1 if width and pattern == longer_line(int(width[1]) - 1) else None


def _odd_ends(text) -> Column:
    """Whether a text has other line ends than newlines; literals are found faster in a long text than their class."""
    return reduce(or_, [text.contains(c) for c in OTHER_ENDS])


def _longer_pieces(text, width: int) -> Column:
    """What stands between newlines, where it is longer: only there can a line be."""
    return F.filter(F.split(text, "\n"), lambda piece: F.length(piece) > width)


def has_longer_line(text, width: int) -> Column:
    """Whether `longer_line` matches."""
    longer = lambda piece: ~_odd_ends(piece) | matches(piece, longer_line(width))
    return F.exists(F.split(col(text), "\n"), lambda piece: (F.length(piece) > width) & longer(piece))


def lines_over(text, width: int) -> Column:
    longer = lambda piece: F.when(_odd_ends(piece), count_regex(piece, longer_line(width))).otherwise(1)
    return F.aggregate(_longer_pieces(col(text), width), F.lit(0), lambda n, piece: n + longer(piece))


def text_metrics(text) -> Column:
    """Struct of line count, non-empty lines, mean line length and todo marks, without splitting.

    `lines` counts newlines; the mean is over lines however they end, and leaves their ends out.
    """
    text = col(text)
    open_end = (text != "") & ~text.rlike(r"[%s]\z" % ENDS)

    def counts(split, chars, non_empty):
        return F.struct(split.alias("split"), chars.alias("chars"), non_empty.alias("non_empty"))

    # Most texts know only newlines, which are counted without the wide class.
    found = F.when(text.rlike(ENDS_BUT_NEWLINE), counts(
        count_regex(text, LINE_END) + open_end.cast("int"), F.length(replace_regex(text, "[%s]++" % ENDS, "")),
        count_regex(text, r"[^\s%s][^%s]*+" % (ENDS, ENDS)))
    ).otherwise(counts(
        line_count(text), F.length(text) - count_substr(text, "\n"), count_regex(text, r"\S[^\n]*+")))
    mean = lambda n: F.when(n["split"] > 0, F.rint(n["chars"] / n["split"] * 100) / 100).otherwise(F.lit(0.0))
    return let(found, lambda n: F.struct(
        line_count(text).cast("long").alias("lines"),
        n["non_empty"].cast("long").alias("non_empty_lines"),
        mean(n).alias("avg_line_length"),
        count_substr(F.lower(text), "todo").cast("long").alias("todo_count"),
    ))


def content_hash(text) -> Column:
    return F.sha2(F.encode(col(text), "UTF-8"), 256)


def size_bytes(text) -> Column:
    return F.octet_length(col(text)).cast("long")


def clamp_score(x) -> Column:
    return F.least(F.greatest(F.bround(col(x).cast("double"), 0), F.lit(0.0)), F.lit(100.0)).cast("int")


def score_band(score, bands=REPORT_BANDS) -> Column:
    score = col(score)
    *upper, (_, lowest) = bands
    out = F
    for floor, label in upper:
        out = out.when(score >= floor, label)
    return out.otherwise(lowest)


def severity_label(severity) -> Column:
    s = F.lower(F.trim(F.coalesce(col(severity), F.lit(""))))
    return F.when(s == "", "Info").otherwise(F.initcap(s))


def severity_level(severity) -> Column:
    """One vocabulary for both: error counts as high, warning as medium."""
    s = F.lower(F.trim(F.coalesce(col(severity), F.lit(""))))
    return (F.when(s.isin("critical", "high", "error"), "high")
            .when(s.isin("medium", "warning"), "medium")
            .when(s == "low", "low").otherwise("info"))


def scaled_impact(count, base: int, div: int, cap: int) -> Column:
    return F.lit(base) + F.least(F.floor(col(count) / F.lit(div)), F.lit(cap)).cast("int")


def scaled_severity(count, below: str, step, above: str) -> Column:
    return F.when(col(count) >= step, above).otherwise(below)


def render_message(template: str, /, **values) -> Column:
    """Fill `{name}` placeholders from columns."""
    out = F.lit(template)
    for name, value in values.items():
        if "{%s}" % name in template:
            out = F.replace(out, F.lit("{%s}" % name), col(value).cast("string"))
    return out


def with_details(message, line=None, snippet=None, confidence=None, fix=None) -> Column:
    """Message with a `(line n; snippet: s; confidence c; fix: f)` tail of whatever is not null."""
    parts = []
    if line is not None:
        parts.append(F.concat(F.lit("line "), col(line).cast("string")))
    if snippet is not None:
        parts.append(F.concat(F.lit("snippet: "), F.nullif(col(snippet), F.lit(""))))
    if confidence is not None:
        shown = F.format_string("confidence %.2f", col(confidence).cast("double"))
        parts.append(F.when(col(confidence).isNotNull(), shown))
    if fix is not None:
        parts.append(F.concat(F.lit("fix: "), F.nullif(col(fix), F.lit(""))))
    tail = F.concat_ws("; ", *parts)
    return F.when(tail == "", col(message)).otherwise(F.concat(col(message), F.lit(" ("), tail, F.lit(")")))


def line_of(text, pos) -> Column:
    """1-based line of the 1-based character position, by any line end; null where there is no match."""
    head = F.substring(col(text), F.lit(1), col(pos) - 1)
    return F.when(col(pos) > 0, line_ends(head) + 1).cast("int")


def match_lines(text, pattern: str, whole: bool = False) -> Column:
    """1-based lines of all matches of a pattern: the text between and inside the matches is counted once.

    `whole` gives struct (matches, lines).
    """
    from .events import running

    text = col(text)

    def counted(matches):
        def step(line, p):
            return F.struct((line + p["between"] + p["inside"]).alias("state"), (line + p["between"]).alias("out"))

        between = F.slice(F.split(text, regex(pattern), -1), F.lit(1), F.size(matches))
        parts = F.zip_with(between, matches, lambda b, m: F.struct(line_ends(b).alias("between"), line_ends(m).alias("inside")))
        lines = F.when(F.size(matches) > 0, running(parts, F.lit(1), step, "int")["out"]).otherwise(F.array().cast("array<int>"))
        return F.struct(matches.alias("matches"), lines.alias("lines")) if whole else lines

    return let(extract_all(text, pattern), counted)


def first_position(text, pattern: str) -> Column:
    return F.regexp_instr(col(text), F.lit(regex(pattern)))


def snippet_of(text, line) -> Column:
    """A line of a text without blanks around it; null where there is no line."""
    return line_at(F.split(col(text), LINE_END), line)


def line_at(lines, line) -> Column:
    return strip(F.get(lines, col(line) - 1))


def capped_list(values, n: int) -> Column:
    """The first n distinct members in order, joined by comma; `values` holds one file's names."""
    return F.array_join(F.slice(F.array_sort(F.array_distinct(values)), 1, n), ", ")


def squeeze(text) -> Column:
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))
