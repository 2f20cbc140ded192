"""Balanced spans: brackets of a text matched to one another, whatever stands inside them.

A text is cut into pieces that each end with at most one mark, and one walk gives each piece the number of spans open before
it. Ordered by that level, the pieces of a span stand side by side and end with the one that closes it, so spans are runs of
that order; the piece in front of a span's first one, in the order of the text, is the one that opens it. Work is that of a
sort, however many spans there are.
"""

from pyspark.sql import Column, functions as F

from .text import col, extract_all, let

# What holds brackets that mean nothing in scripts: comments, strings, templates.
SCRIPT_OPAQUE = (
    r"""//[^\n]*|/\*[\s\S]*?(?:\*/|\z)|"(?:[^"\\\n]|\\[\s\S])*+"?|'(?:[^'\\\n]|\\[\s\S])*+'?|`(?:[^`\\]|\\[\s\S])*+`?"""
)
#: A piece of a script up to a bracket or comma.
SCRIPT_PIECE = r"(?:%s|[^()\[\]{},\"'`/]++|/)++[()\[\]{},]?|[()\[\]{},]" % SCRIPT_OPAQUE


def marked(text, pattern: str, marks: str) -> Column:
    """Struct (mark, text) of the pieces of a text; the last one is empty, for spans that are open there."""
    def read(piece):
        last = F.right(piece, F.lit(1))
        mark = F.when(F.instr(F.lit(marks), last) > 0, last).otherwise("")
        return let(F.when(piece == "", F.lit("")).otherwise(mark), lambda m: F.struct(
            m.alias("mark"), F.substring(piece, F.lit(1), F.length(piece) - F.length(m)).alias("text")))

    return F.transform(F.concat(extract_all(text, pattern), F.array(F.lit(""))), read)


def walked(pieces, opening: str, closing: str) -> Column:
    """Struct (level, at, mark, text, ...) of pieces (mark, text) in order: how many spans are open before each."""
    from .events import running

    def step(level, p):
        is_in = lambda marks: (p["mark"] != "") & (F.instr(F.lit(marks), p["mark"]) > 0)
        after = F.when(is_in(opening), level + 1).when(is_in(closing), F.greatest(level - 1, F.lit(0))).otherwise(level)
        return F.struct(after.alias("state"), level.alias("out"))

    def placed(p):
        return let(running(p, F.lit(0), step, "int")["out"], lambda levels: F.transform(p, lambda x, i: F.struct(
            F.get(levels, i).alias("level"), i.alias("at"), x["mark"].alias("mark"), x["text"].alias("text"))))

    return let(pieces, placed)


def runs_of(pieces, closing: str) -> Column:
    """The pieces of each span and, at level 0, those outside of all: arrays in the order of level and place.

    A stray closing mark at level 0 ends nothing but its own run.
    """
    def cut(v):
        ends = lambda p: (p["mark"] != "") & (F.instr(F.lit(closing), p["mark"]) > 0)
        new = lambda i: (i == 0) | (F.get(v, i)["level"] != F.get(v, i - 1)["level"]) | ends(F.get(v, i - 1))
        starts = F.when(F.size(v) > 0, F.filter(F.sequence(F.lit(0), F.size(v) - 1), new))
        return let(F.coalesce(starts, F.array().cast("array<int>")), lambda s: F.transform(s, lambda at, k: F.slice(
            v, at + 1, F.coalesce(F.get(s, k + 1), F.size(v)) - at)))

    return let(F.array_sort(pieces), cut)


def owners_of(runs) -> Column:
    """The number of the run that holds each piece, by the piece's place."""
    held = F.flatten(F.transform(runs, lambda r, k: F.transform(r, lambda p: F.struct(p["at"].alias("at"), k.alias("k")))))
    return F.transform(F.array_sort(held), lambda o: o["k"])


def joined(pieces, first, last) -> Column:
    """The text of the pieces from one place to another."""
    return F.array_join(F.transform(F.slice(pieces, first + 1, last - first + 1), lambda p: F.concat(p["text"], p["mark"])), "")


# Calls in scripts ---------------------------------------------------------------------------------------------

CONTROL = r"\b(?:if|for|while|switch|catch)\s*$"
CONTROL_WORD = r"\b(?:try|else|do|finally)\s*$"


def call_array(text, names) -> Column:
    """Struct (at, name, args, before, controlled) of the closed calls of the named functions, in order.

    `args` has the arguments between commas that stand in no brackets of their own, trimmed; `before` is the text of up to 180
    characters in front of the call; `controlled` tells whether the call stands in the block, or is the statement, of an if, a
    loop, a switch or a try.
    """
    named = "(%s)$" % "|".join(names)

    def read(pieces):
        return let(runs_of(pieces, ")]}"), lambda runs: let(owners_of(runs), lambda owner: calls(pieces, runs, owner)))

    def calls(pieces, runs, owner):
        opener = lambda r: F.get(pieces, F.get(r, 0)["at"] - 1)
        closed = lambda r: F.get(r, F.size(r) - 1)["mark"] == ")"
        wanted = F.filter(runs, lambda r: (F.get(r, 0)["level"] > 0) & closed(r) & (opener(r)["mark"] == "(") & opener(r)["text"].rlike(named))
        found = F.transform(wanted, lambda r: let(opener(r), lambda o: F.struct(
            o["at"].alias("at"), F.regexp_extract(o["text"], named, 1).alias("name"), arguments(pieces, r).alias("args"),
            before(pieces, o).alias("before"), controlled(pieces, runs, owner, o).alias("controlled"))))
        return F.array_sort(found)

    def arguments(pieces, r):
        ends = F.transform(F.filter(r, lambda p: (p["mark"] == ",") | (p["mark"] == ")")), lambda p: p["at"])
        text = lambda first, last: F.regexp_replace(joined(pieces, first, last), r"^\s+|\s*[,)]$", "")
        args = let(ends, lambda e: F.transform(e, lambda last, i: F.trim(text(
            F.when(i == 0, F.get(r, 0)["at"]).otherwise(F.get(e, i - 1) + 1), last))))
        return F.transform(args, lambda a: F.regexp_replace(a, r"\s+$", ""))

    def before(pieces, o):
        first = F.greatest(o["at"] - REACH, F.lit(0))
        text = F.regexp_replace(joined(pieces, first, o["at"]), named[:-1] + r"\($", "")
        return let(text, lambda t: F.right(t, F.lit(REACH)))

    def controlled(pieces, runs, owner, o):
        def step(acc, _):
            own = F.get(runs, F.get(owner, acc["at"]))
            at = F.greatest(acc["at"], F.lit(0))
            place = F.array_position(F.transform(own, lambda p: p["at"]), at).cast("int")
            # What stands in front of the block or call: blanks behind a closed head, or a word.
            ahead = F.get(own, place - 2)
            text = F.regexp_replace(F.get(pieces, at)["text"], "(?:%s)$" % "|".join(names), "")
            here = ((ahead["mark"] == "(") & ahead["text"].rlike(CONTROL) & (F.trim(F.translate(text, "\n\t\r", "   ")) == "")) | text.rlike(CONTROL_WORD)
            return F.struct((F.get(own, 0)["at"] - 1).alias("at"), (acc["found"] | F.coalesce(here, F.lit(False))).alias("found"))

        start = F.struct(o["at"].alias("at"), F.lit(False).alias("found"))
        return F.aggregate(F.sequence(F.lit(0), o["level"]), start, step, lambda acc: acc["found"])

    return let(walked(marked(text, SCRIPT_PIECE, "()[]{},"), "([{", ")]}"), read)


#: Characters in front of a call that are told with it.
REACH = 180
