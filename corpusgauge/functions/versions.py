"""Two versions of a text aligned by their lines.

A line that stands once in each version is an anchor. Any other line keeps its distance from the anchor above it, or from the
one below where the text there is another, and is the same line only if its text is. Lines are compared by hash.
"""

from pyspark.sql import Column, functions as F

from .text import LINE_END, col, let


def line_hashes(text="text") -> Column:
    """A hash of each line of a text."""
    return F.transform(F.split(col(text), LINE_END), lambda l: F.xxhash64(l))


def moved_lines(before, after) -> Column:
    """For each line of `before` (hashes of lines) its 1-based line in `after`, null if it has none."""
    from .events import running, runs

    def side(hashes, n):
        return F.transform(hashes, lambda h, i: F.struct(h.alias("h"), F.lit(n).alias("side"), (i + 1).alias("line")))

    def anchors(v):
        """For each line of `before` in order: its line in `after` if it is an anchor."""
        def lines(r):
            own = F.slice(v, r["at"] + 1, r["n"])
            once = (r["n"] == 2) & (F.get(own, 0)["side"] == 0) & (F.get(own, 1)["side"] == 1)
            return F.transform(F.filter(own, lambda x: x["side"] == 0), lambda x: F.struct(
                x["line"].alias("line"), F.when(once, F.get(own, 1)["line"]).alias("to")))

        each = F.flatten(F.transform(runs(v, lambda x: x["h"]), lines))
        return F.transform(F.array_sort(each), lambda x: F.struct(x["line"].alias("line"), (x["to"] - x["line"]).alias("shift")))

    def shifts(found):
        def step(shift, x):
            return let(F.coalesce(x["shift"], shift), lambda s: F.struct(s.alias("state"), s.alias("out")))

        none = F.lit(None).cast("int")
        down = running(found, none, step, "int")["out"]
        up = F.reverse(running(F.reverse(found), none, step, "int")["out"])
        return F.zip_with(down, up, lambda d, u: F.struct(d.alias("down"), u.alias("up")))

    def placed(s):
        def same(h, line):
            return F.when((line > 0) & (F.get(col(after), line - 1) == h), line)

        return F.transform(col(before), lambda h, i: F.coalesce(
            same(h, i + 1 + F.get(s, i)["down"]), same(h, i + 1 + F.get(s, i)["up"])).cast("int"))

    every = F.concat(side(col(before), 0), side(col(after), 1))
    return let(F.array_sort(every), lambda v: let(anchors(v), lambda found: let(shifts(found), placed)))
