"""Style sheets as a tree of blocks: rules with their line, their enclosing blocks and their declarations.

The text is cut at braces that stand outside comments, strings and addresses, and blocks are balanced spans of the pieces.
Only the list of the blocks around a block grows with its depth.
"""

from pyspark.sql import Column, functions as F

from .css import selector_specificity
from .spans import marked, owners_of, runs_of, walked
from .text import LINE_END, col, extract_all, let, line_ends, regex, replace_regex, squeeze

# What holds braces and semicolons that mean nothing: comments, strings, addresses without quotes, escaped characters.
COMMENT = r"/\*[\s\S]*?(?:\*/|\z)"
STRINGS = r""""(?:[^"\\\n]|\\[\s\S])*+"?|'(?:[^'\\\n]|\\[\s\S])*+'?"""
OPAQUE = COMMENT + "|" + STRINGS + r"""|(?:[uU][rR][lL])\(\s*+[^"'\s)][^)]*+\)?|\\[\s\S]"""
# A piece up to a brace; a part up to a semicolon; the parts of a piece that semicolons close.
PIECE = r"(?:%s|[^{}\"'/\\uU]++|[/\\uU])++[{}]?|[{}]" % OPAQUE
PART = r"(?:%s|[^;\"'/\\uU]++|[/\\uU])++;?|;" % OPAQUE
CLOSED_PARTS = r"^(?:(?:%s|[^;\"'/\\uU]++|[/\\uU])*+;)*+" % OPAQUE
LEAD = r"^(?:\s|%s)*+" % COMMENT
#: Blocks that only hold rules.
NESTING = r"(?i)^@(?:media|supports|layer|container|document|scope|starting-style|(?:-\w+-)?keyframes)\b"
KEYFRAMES = r"(?i)^@(?:-\w+-)?keyframes\b"

BETWEEN = "\x1f"

DECLARATION = r"(?s)^\s*([-\w]+)\s*:\s*(.*\S)\s*$"
IMPORTANT = r"(?i)\s*!\s*important\s*$"

def without_comments(text) -> Column:
    """Comments go, also where they stand between strings that look like some."""
    text = col(text)
    return F.when(text.contains("/*"), replace_regex(text, "(%s)|%s" % (STRINGS, COMMENT), "$1")).otherwise(text)


def _walked(css) -> Column:
    """Struct (level, at, mark, text, line) of the pieces of a sheet: how many blocks are open before, where it starts."""
    from .events import running

    def step(line, p):
        return F.struct((line + line_ends(p["text"])).alias("state"), line.alias("out"))

    def with_lines(pieces):
        return let(running(pieces, F.lit(1), step, "int")["out"], lambda lines: F.transform(
            pieces, lambda p, i: p.withField("line", F.get(lines, i))))

    return let(walked(marked(css, PIECE, "{}"), "{", "}"), with_lines)


def _head(piece) -> Column:
    """Struct (head, line) of the block that a piece opens."""
    def read(own):
        text = F.substring(piece["text"], F.length(own) + 1, F.length(piece["text"]))
        lead = F.regexp_extract(text, LEAD, 0)
        return F.struct(squeeze(without_comments(text)).alias("head"), (piece["line"] + line_ends(own) + line_ends(lead)).alias("line"))

    return let(F.regexp_extract(piece["text"], CLOSED_PARTS, 0), read)


def block_array(css="css") -> Column:
    """Struct (at, line, head, leaf, own, context) of all blocks in the order of their heads.

    `line` is where the head starts. `own` has the text and line of each stretch of the block outside of blocks in it;
    `context` has the heads of the blocks around it, outermost first. A closing brace without a block is skipped; blocks
    open at the end are closed there.
    """
    def read(pieces):
        return let(runs_of(pieces, "}"), lambda runs: let(owners_of(runs), lambda owner: nested(pieces, runs, owner)))

    def nested(pieces, runs, owner):
        # A block for every run, also for those outside of all, so that numbers stay.
        opened = F.transform(runs, lambda r: let(_head(F.get(pieces, F.get(r, 0)["at"] - 1)), lambda h: F.struct(
            (F.get(r, 0)["at"] - 1).alias("at"), h["line"].alias("line"), h["head"].alias("head"),
            (~F.exists(r, lambda p: p["mark"] == "{")).alias("leaf"),
            F.transform(r, lambda p: F.struct(
                F.when(p["mark"] == "{", F.regexp_extract(p["text"], CLOSED_PARTS, 0)).otherwise(p["text"]).alias("text"),
                p["line"].alias("line"))).alias("own"),
            F.get(r, 0)["level"].alias("level"))))
        return let(opened, lambda blocks: F.array_sort(F.transform(F.filter(blocks, lambda b: b["level"] > 0), lambda b: F.struct(
            *[b[n].alias(n) for n in ("at", "line", "head", "leaf", "own")], around(b, blocks, owner).alias("context")))))

    def around(b, blocks, owner):
        # Heads are gathered as one text: a list would be copied whole at every step.
        def step(acc, _):
            return let(F.get(blocks, F.get(owner, acc["at"])), lambda o: F.struct(
                o["at"].alias("at"), F.concat(F.translate(o["head"], BETWEEN, " "), F.lit(BETWEEN), acc["path"]).alias("path")))

        climbed = F.aggregate(F.sequence(F.lit(2), b["level"]), F.struct(b["at"].alias("at"), F.lit("").alias("path")), step)
        return F.when(b["level"] > 1, F.slice(F.split(climbed["path"], BETWEEN), F.lit(1), b["level"] - 1)).otherwise(
            F.array().cast("array<string>"))

    return let(_walked(css), read)


def declaration_array(text, line=None) -> Column:
    """Struct (decl_no, prop, raw, value, important, line) of the declarations in a text that starts on a line."""
    from .events import running

    line = F.lit(1) if line is None else line

    def placed(parts):
        def step(at, part):
            first = at + line_ends(F.regexp_extract(part, LEAD, 0))
            return F.struct((at + line_ends(part)).cast("int").alias("state"), F.struct(part.alias("part"), first.cast("int").alias("line")).alias("out"))

        one = F.transform(parts, lambda p: F.struct(p.alias("part"), line.cast("int").alias("line")))
        several = F.exists(parts, lambda p: p.rlike(LINE_END))
        return F.when(several, running(parts, line.cast("int"), step, "struct<part:string,line:int>")["out"]).otherwise(one)

    def stripped(part):
        return F.struct(F.regexp_replace(without_comments(part["part"]), ";$", "").alias("text"), part["line"].alias("line"))

    parts = F.transform(let(extract_all(text, PART), placed), stripped)
    return F.transform(F.filter(parts, lambda d: d["text"].rlike(regex(DECLARATION))), _declaration)


def _declaration(d, i) -> Column:
    text = d["text"]
    return let(squeeze(F.regexp_extract(text, regex(DECLARATION), 2)), lambda raw: F.struct(
        (i + 1).alias("decl_no"), F.lower(F.regexp_extract(text, regex(DECLARATION), 1)).alias("prop"),
        raw.alias("raw"), F.lower(F.regexp_replace(raw, IMPORTANT, "")).alias("value"),
        raw.rlike(IMPORTANT).alias("important"), d["line"].alias("line")))


def _numbered(d) -> Column:
    return F.transform(d, lambda x, i: x.withField("decl_no", i + 1))


def rule_array(css="css") -> Column:
    """Struct (rule_no, selector, body, d, line, context) of a sheet's rules; an empty selector stays empty.

    Blocks that only hold rules, such as @media, are no rules but stand in the `context` of theirs; a rule around other
    rules has its own declarations. At-rules with declarations, such as @font-face, are rules under their own name.
    """
    def is_rule(b):
        return ~b["head"].rlike(NESTING) & (b["leaf"] | ~b["head"].startswith("@"))

    def read(b, i):
        declared = F.flatten(F.transform(b["own"], lambda p: declaration_array(p["text"], p["line"])))
        return F.struct(
            (i + 1).alias("rule_no"), b["head"].alias("selector"),
            F.array_join(F.transform(b["own"], lambda p: without_comments(p["text"])), "").alias("body"),
            F.when(b["leaf"], declared).otherwise(_numbered(declared)).alias("d"), b["line"].alias("line"), b["context"].alias("context"))

    return F.transform(F.filter(block_array(css), is_rule), read)


def in_keyframes(context) -> Column:
    return F.exists(context, lambda c: c.rlike(KEYFRAMES))


def selector_array(rules) -> Column:
    """Struct (rule_no, selector, ids, classes, elements, combinators, depth) of every single selector."""
    def weighed(rule):
        each = F.filter(F.split(rule["selector"], r"\s*,\s*"), lambda s: s != "")
        return F.transform(each, lambda s: let(selector_specificity(s), lambda w: F.struct(
            rule["rule_no"].alias("rule_no"), s.alias("selector"),
            *[w[n].alias(n) for n in ("ids", "classes", "elements", "combinators", "depth")])))

    return F.flatten(F.transform(col(rules), weighed))


def signature(rule) -> Column:
    """The sorted declarations of a rule as one text."""
    pairs = F.transform(rule["d"], lambda d: F.concat(d["prop"], F.lit(":"), d["raw"]))
    return F.array_join(F.array_sort(pairs), "|")
