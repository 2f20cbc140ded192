"""Arrays of events in a file's text: lines, tags, rules, class lists, hook calls.

Each function gives one array per file. The table operators explode them; checks read them inside the row, so a
file is settled without a shuffle. An array is bounded by its own file's text.
"""

from pyspark.sql import Column, functions as F

from .code import blank_python
from .spans import call_array
from .text import LINE_END, col, extract_all, let, match_lines, one_of, regex, replace_regex, squeeze
from .utility import bracket_surplus, utility_parts, valid_arbitrary


def strings() -> Column:
    return F.array().cast("array<string>")


def repeated(values, times: int) -> Column:
    """Distinct values that occur at least `times` times, in order."""
    return let(F.array_sort(values), lambda v: F.transform(
        F.filter(runs(v), lambda r: r["n"] >= times), lambda r: F.get(v, r["at"])))


def runs(v, key=lambda x: x) -> Column:
    """Struct (at, n) of the runs of elements with equal keys in a sorted array."""
    new = lambda i: (i == 0) | (key(F.get(v, i)) != key(F.get(v, i - 1)))
    starts = F.when(F.size(v) > 0, F.filter(F.sequence(F.lit(0), F.size(v) - 1), new))
    return let(F.coalesce(starts, F.array().cast("array<int>")), lambda s: F.transform(s, lambda at, k: F.struct(
        at.alias("at"), (F.coalesce(F.get(s, k + 1), F.size(v)) - at).alias("n"))))


def repeated_counts(values, times: int, name: str) -> Column:
    """Struct (name, uses) of the values that occur at least `times` times, in order."""
    def counted(v):
        return F.transform(F.filter(runs(v), lambda r: r["n"] >= times), lambda r: F.struct(
            F.get(v, r["at"]).alias(name), r["n"].cast("long").alias("uses")))

    return let(F.array_sort(values), counted)


GATHERED = 256
#: Open tags of a page that are kept as one text.
STACKED = 256


def running(items, start, step, kind: str) -> Column:
    """Struct (state, out) of a walk over an array: the last state, and what the step gives for every element.

    `step` takes the state and an element and gives struct (state, out); `kind` is the type of its `out`. What it gives
    is gathered in blocks of 256, so that appending to the result doesn't copy all of it.
    """
    def appended(acc, r):
        return let(r, lambda r: F.struct(
            r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def walked(v):
        def block(acc, at):
            begin = F.struct(acc["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
            return appended(acc, F.aggregate(
                F.slice(v, at, F.lit(GATHERED)), begin, lambda inner, x: appended(inner, step(inner["state"], x))))

        starts = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(GATHERED)))
        begin = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.aggregate(
            F.coalesce(starts, F.array().cast("array<int>")), begin, block,
            lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["out"]).alias("out")))

    return let(items, walked)


# Lines --------------------------------------------------------------------------------------------------------

def line_array(text="text") -> Column:
    """Struct (line_no, line, indent); a final empty piece is no line."""
    text = col(text)
    pieces = F.when(text != "", F.split(F.regexp_replace(text, r"(?:%s)\z" % LINE_END, ""), LINE_END)).otherwise(strings())
    return F.transform(pieces, lambda l, i: F.struct(
        (i + 1).alias("line_no"), l.alias("line"),
        (F.length(l) - F.length(F.regexp_replace(l, r"^[ \t]+", ""))).alias("indent")))


def trimmed_lines(text, longer_than: int) -> Column:
    trimmed = F.transform(F.split(col(text), LINE_END), lambda l: F.trim(l))
    return F.filter(trimmed, lambda l: F.length(l) > longer_than)


# Tags ---------------------------------------------------------------------------------------------------------

# Tags without content, and tags that may not stand inside a paragraph.
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param",
)
NOT_IN_PARAGRAPH = (
    "div", "section", "article", "header", "footer", "main", "nav", "aside", "form", "ul", "ol", "table",
)
MARKUP = r"(?s)<!--.*?-->|<[^>]+>"
TAG = r"(?s)^<\s*(/?)\s*([a-zA-Z](?:[\w:-]*\w)?)"


def tag_array(text="text", skip_scripts: bool = False) -> Column:
    """Struct (pos, tag, is_close, is_void, raw) of a page's tags in order."""
    text = col(text)
    if skip_scripts:
        text = replace_regex(text, r"(?is)(<script\b[^>]*>).*?(</script>)", "$1$2")
    tags = F.filter(extract_all(text, MARKUP), lambda t: t.rlike(regex(TAG)))

    def parsed(t, i):
        return let(F.lower(F.regexp_extract(t, regex(TAG), 2)), lambda name: F.struct(
            (i + 1).alias("pos"),
            name.alias("tag"),
            t.rlike(r"^<\s*/").alias("is_close"),
            (t.endswith("/>") | one_of(name, VOID_TAGS)).alias("is_void"),
            t.alias("raw"),
        ))

    return F.transform(tags, parsed)


def stack_walk(tags) -> Column:
    """Walk the tags of a page over a stack of open tags: struct (stack, errors of (kind, tag)).

    A fold copies its state at every step, so a deep stack is kept as few values: full blocks as one text each (`low`,
    with their distinct names to search in) and the tags on top of them (`top`), which is empty only where the stack is.
    """
    def spaced(names):
        return F.concat(F.lit(" "), F.array_join(names, " "), F.lit(" "))

    def tags_of(block):
        return F.split(F.trim(block["tags"]), " ")

    def state(low, top):
        refill = (F.size(top) == 0) & (F.size(low) > 0)
        return F.struct(
            F.when(refill, F.slice(low, F.lit(1), F.size(low) - 1)).otherwise(low).alias("low"),
            F.when(refill, tags_of(F.get(low, F.size(low) - 1))).otherwise(top).alias("top"))

    def up_to(block, from_top):
        return F.slice(block, F.lit(1), F.size(block) - from_top)

    def last_at(block, tag):
        return F.array_position(F.reverse(block), tag).cast("int")

    def step(acc, t):
        low, top, tag = acc["low"], acc["top"], t["tag"]

        def after(now, kind):
            error = F.when(kind.isNotNull(), F.struct(kind.alias("kind"), tag.alias("tag")))
            return F.struct(now.alias("state"), error.alias("out"))

        def closed_below(holding):
            at = F.get(holding, F.size(holding) - 1)
            block = tags_of(F.get(low, at))
            found = state(F.slice(low, F.lit(1), at), up_to(block, last_at(block, tag)))
            return F.when(at.isNull(), after(acc, F.lit("unexpected_close"))).otherwise(
                after(found, F.lit("out_of_order")))

        def closed(from_top):
            below = F.filter(F.sequence(F.lit(0), F.size(low)), lambda i: F.contains(
                F.get(low, i)["names"], F.concat(F.lit(" "), tag, F.lit(" "))))
            return F.when(from_top > 0, after(
                state(low, up_to(top, from_top)), F.when(from_top > 1, "out_of_order"))
            ).otherwise(let(below, closed_below))

        full = F.size(top) >= STACKED
        block = F.struct(spaced(top).alias("tags"), spaced(F.array_distinct(top)).alias("names"))
        pushed = F.struct(
            F.when(full, F.concat(low, F.array(block))).otherwise(low).alias("low"),
            F.when(full, F.array(tag)).otherwise(F.concat(top, F.array(tag))).alias("top"))
        misplaced = (F.get(top, F.size(top) - 1) == "p") & one_of(tag, NOT_IN_PARAGRAPH)
        opened = after(F.when(t["is_void"], acc).otherwise(pushed), F.when(misplaced, "invalid_child"))
        return F.when(t["is_close"], let(last_at(top, tag), closed)).otherwise(opened)

    start = F.struct(
        F.array().cast("array<struct<tags:string,names:string>>").alias("low"), strings().alias("top"))
    return let(running(col(tags), start, step, "struct<kind:string,tag:string>"), lambda r: F.struct(
        F.concat(F.flatten(F.transform(r["state"]["low"], tags_of)), r["state"]["top"]).alias("stack"),
        F.filter(r["out"], lambda e: e.isNotNull()).alias("errors")))


def tag_depth(tags, tag: str = "div") -> Column:
    """Deepest nesting of a tag; surplus closes do not go below zero."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc, t):
        now = F.when(t["is_close"], F.greatest(acc["now"] - 1, F.lit(0))).otherwise(acc["now"] + 1)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.filter(col(tags), lambda t: t["tag"] == tag), start, step, lambda acc: acc["most"])


# Class lists --------------------------------------------------------------------------------------------------

# Attributes that hold class lists.
CLASS_ATTRIBUTE = (
    r"""(?i)(?:\bclassName\b|\bclass\b|\bngClass\b|\bclass:list\b|\bclass:\w+\b|\[[^\]]*class[^\]]*\]"""
    r"""|:class\b|\bv-bind:class\b)\s*=\s*("[^"]*"|'[^']*'|`[^`]*`|\{[^{}]*\})"""
)
DYNAMIC = r"\$\{|\{\{|\}\}"
#: The same matches; a place that none of the names can start at costs one look at its character.
CLASS_SEARCH = CLASS_ATTRIBUTE.replace("(?i)", r"(?i)(?=[cnv:\[])", 1)


def class_list_array(text="text") -> Column:
    """Struct (element_no, value, tokens, line) of class attributes; dynamic parts are cut from the tokens."""
    def parsed(quoted, i, lines):
        value = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
        static = F.translate(
            replace_regex(replace_regex(value, r"\$\{[^}]*\}", " "), r"\{\{[^}]*\}\}", " "), "+", " ")
        tokens = F.filter(F.split(F.trim(replace_regex(static, r"\s+", " ")), " "), lambda t: t != "")
        return F.struct((i + 1).alias("element_no"), value.alias("value"), tokens.alias("tokens"), F.get(lines, i).alias("line"))

    # The lines need every match whole; what is quoted is read from the match, not from the text again.
    return let(match_lines(text, CLASS_SEARCH, whole=True), lambda found: F.transform(
        found["matches"], lambda m, i: parsed(F.regexp_extract(m, regex(CLASS_SEARCH), 1), i, found["lines"])))


def parsed_token(token) -> Column:
    """Struct (token, state, variants, base, utility_group, important); state is null for a sound token."""
    def read(u):
        bare = F.regexp_replace(token, "^!", "")
        state = (
            F.when(bracket_surplus(token) != 0, "unbalanced")
            .when(u["base"] == "", "no_base")
            .when(bare.rlike("^:|::|:$"), "bad_variant")
            .when(~valid_arbitrary(u["base"]), "bad_value")
        )
        return F.struct(token.alias("token"), state.alias("state"), u["variants"].alias("variants"),
                        u["base"].alias("base"), u["utility_group"].alias("utility_group"),
                        u["important"].alias("important"))

    return let(utility_parts(token), read)


# Components ---------------------------------------------------------------------------------------------------

def _braced(depth: int) -> str:
    """Pattern of a brace with braces, strings and templates inside."""
    inner = "|" + _braced(depth - 1) if depth else ""
    return r"""\{(?:[^{}"'`]++|"[^"]*+"|'[^']*+'|`[^`]*+`%s)*+\}""" % inner


# Attribute values are strings or braces, up to eight deep.
JSX_TAG = r"""<[A-Za-z][\w.]*\b(?:[^<>{}"'`]++|"[^"]*+"|'[^']*+'|%s)*+>""" % _braced(8)
HOOKS = ("useState", "useReducer", "useEffect", "useLayoutEffect", "useMemo", "useCallback", "useRef", "useContext")
HOOKS_WITH_DEPS = ("useEffect", "useLayoutEffect", "useMemo", "useCallback")
def jsx_array(text="text") -> Column:
    """Struct (pos, tag, attrs) of tags; attribute values may hold anything between their quotes or braces."""
    return F.transform(extract_all(text, JSX_TAG), lambda raw, i: F.struct(
        (i + 1).alias("pos"), F.regexp_extract(raw, r"^<([A-Za-z]\w*)", 1).alias("tag"),
        F.regexp_replace(raw, r"^<[A-Za-z][\w.]*|/?>$", "").alias("attrs")))


def hook_array(text="text") -> Column:
    """Struct (seg_no, hook, prefix, callback, deps, controlled) of closed hook calls.

    `callback` is the first argument, whole, and `deps` the second, null where there is none. `prefix` is the text of 180
    characters before the call, `controlled` whether the call stands in control flow.
    """
    return F.transform(call_array(text, HOOKS), lambda c, i: F.struct(
        (i + 1).alias("seg_no"), c["name"].alias("hook"), c["before"].alias("prefix"), F.get(c["args"], 0).alias("callback"),
        F.nullif(F.get(c["args"], 1), F.lit("")).alias("deps"), c["controlled"].alias("controlled")))


JS_NAME = r"[A-Za-z_$][\w$]*"
STATE_PAIR = r"\bconst\s*\[\s*(%s)\s*,\s*(%s)\s*\]\s*=\s*useState\s*\(" % (JS_NAME, JS_NAME)
PROP_LISTS = (
    r"(?:function\s+[A-Z][A-Za-z0-9_]*|const\s+[A-Z][A-Za-z0-9_]*\s*=)\s*\(\s*\{([^}]*)\}\s*\)"
)


def state_pairs(text="text") -> Column:
    """Struct (state, setter) of a file's state declarations."""
    return F.transform(extract_all(text, STATE_PAIR), lambda p: F.struct(
        F.regexp_extract(p, regex(STATE_PAIR), 1).alias("state"),
        F.regexp_extract(p, regex(STATE_PAIR), 2).alias("setter")))


def stale_update_array(text="text") -> Column:
    """Struct (state, setter, shift, step, toggle, rebuild) of setters and how they use their own state.

    The patterns are built from the file's own names inside its row, so the text is not joined.
    """
    text = col(text)

    def tested(p):
        call = F.concat(F.lit(r"(?d)\b\Q"), p["setter"], F.lit(r"\E\s*\(\s*"))
        own = F.concat(F.lit(r"\Q"), p["state"], F.lit(r"\E"))
        like = lambda *parts: F.regexp_like(text, F.concat(*parts))
        return F.struct(
            p["state"].alias("state"), p["setter"].alias("setter"),
            like(call, own, F.lit(r"\s*[+\-]\s*\d+")).alias("shift"),
            like(call, own, F.lit(r"\s*[+\-]\s*1\s*\)")).alias("step"),
            like(call, F.lit(r"!\s*"), own, F.lit(r"\s*\)")).alias("toggle"),
            like(call, F.lit(r"[\[{][\s\S]*\b"), own, F.lit(r"\b")).alias("rebuild"))

    return F.transform(state_pairs(text), tested)


def watched_names(text="text") -> Column:
    """State names in order, then destructured prop names in order."""
    state = F.array_sort(F.array_distinct(F.transform(state_pairs(text), lambda p: p["state"])))
    listed = F.flatten(F.transform(extract_all(text, PROP_LISTS, 1), lambda l: F.split(l, ",")))
    props = F.transform(listed, lambda p: F.trim(F.regexp_replace(p, r"(?s)[=:].*$", "")))
    props = F.filter(props, lambda p: p.rlike(r"^[A-Za-z_$][\w$]*$"))
    return F.concat(state, F.array_sort(F.array_distinct(props)))


def missing_names(names, callback, deps) -> Column:
    """Names a callback reads that its dependency array leaves out."""
    def read(v):
        return F.filter(names, lambda n: F.array_contains(v["reads"], n) & ~F.array_contains(v["listed"], n))

    return let(F.struct(
        F.array_distinct(extract_all(callback, JS_NAME)).alias("reads"),
        extract_all(F.coalesce(deps, F.lit("")), JS_NAME).alias("listed")), read)


MANIFEST_SECTIONS = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")
MANIFEST_SCHEMA = (
    "packageManager string, " + ", ".join(f"{s} map<string,string>" for s in MANIFEST_SECTIONS) + ", _bad string")


def manifest(text="text") -> Column:
    """A package manifest as a struct; `_bad` holds the text where it is not JSON."""
    return F.from_json(text, MANIFEST_SCHEMA, {"columnNameOfCorruptRecord": "_bad"})


def dependency_array(m) -> Column:
    """Struct (section, package, spec) of a parsed manifest."""
    def section(name):
        pairs = F.map_entries(F.coalesce(m[name], F.create_map().cast("map<string,string>")))
        return F.transform(pairs, lambda e: F.struct(
            F.lit(name).alias("section"), e["key"].alias("package"), e["value"].alias("spec")))

    return F.filter(F.concat(*[section(n) for n in MANIFEST_SECTIONS]), lambda d: d["spec"].isNotNull())


# Python -------------------------------------------------------------------------------------------------------

PY_NAME = r"[A-Za-z_]\w*"
PY_IMPORT = r"^\s*import\s+(.+)$"
PY_FROM = r"^\s*from\s+[\w.]+\s+import\s+\(?([^()]*)\)?\s*$"


# Words that start a statement and stand nowhere else: an open bracket in front of them was never closed.
PY_STARTS = r"^\s*(?:async\s+def|def|class|import|return|while|try|except|finally|raise|pass|break|continue|global|nonlocal)\b"
CONTINUED = r"\\\s*$"


def statement_array(code="text") -> Column:
    """Struct (line_no, line, indent) of the logical lines of Python text without strings and comments.

    Lines in open brackets and behind a backslash belong to the one they go on from, whose number and indent they take. A word
    that can only start a statement ends whatever is open.
    """
    def placed(lines):
        def step(state, l):
            text = l["line"]
            before = F.when(text.rlike(PY_STARTS), F.lit(0)).otherwise(state["depth"])
            goes_on = (before > 0) | (state["open"] & ~text.rlike(PY_STARTS))
            after = F.greatest(before + F.length(F.translate(text, ")]}", "")) - F.length(F.translate(text, "([{", "")), F.lit(0))
            return F.struct(
                F.struct(after.alias("depth"), text.rlike(CONTINUED).alias("open")).alias("state"), goes_on.alias("out"))

        start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("open"))
        return let(running(lines, start, step, "boolean")["out"], lambda on: cut(lines, on))

    def cut(lines, on):
        first = F.when(F.size(lines) > 0, F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: ~F.get(on, i)))

        def whole(at, end):
            own = F.slice(lines, at + 1, end - at)
            text = F.array_join(F.transform(own, lambda l: F.regexp_replace(l["line"], CONTINUED, "")), " ")
            return F.struct(F.get(own, 0)["line_no"].alias("line_no"), text.alias("line"), F.get(own, 0)["indent"].alias("indent"))

        return let(F.coalesce(first, F.array().cast("array<int>")), lambda s: F.transform(
            s, lambda at, k: whole(at, F.coalesce(F.get(s, k + 1), F.size(lines)))))

    # Without an open bracket or a backslash every line stands alone and there is nothing to walk.
    return F.when(col(code).rlike(r"[(\[{\\]"), let(line_array(code), placed)).otherwise(line_array(code))


def py_line_array(text="text") -> Column:
    """Logical lines of Python text with comments and strings blanked."""
    return let(blank_python(text), statement_array)


def imported_names(line) -> Column:
    """Names an import line binds."""
    def bound(part):
        return F.when(part.rlike(r"\sas\s"), F.regexp_extract(part, r"\sas\s+(%s)" % PY_NAME, 1)).otherwise(
            F.regexp_extract(part, r"^\s*(%s)" % PY_NAME, 1))

    whole = F.when(line.rlike(PY_IMPORT), F.regexp_extract(line, PY_IMPORT, 1)).when(
        line.rlike(PY_FROM), F.regexp_extract(line, PY_FROM, 1))
    names = F.transform(F.split(whole, ","), bound)
    return F.filter(F.coalesce(names, strings()), lambda n: n != "")


# Block headers.
LOOP = r"^\s*(?:async\s+)?(?:for|while)\b.*:\s*$"
FOR_LOOP = r"^\s*(?:async\s+)?for\b.*:\s*$"
ASYNC = r"^\s*async\s+def\b"
HANDLER = r"^\s*except\b.*:"



# Blocks are found in one walk over a file's lines with the blocks that are open there. Open blocks are indented ever
# deeper, so their number stays below the root of twice the text's length.


def block_array(lines, header: str) -> Column:
    """Struct (line_no, indent, end_no) of the indented blocks under header lines.

    `end_no` is the next non-blank line indented no deeper, null at the end of the file. Lines are walked from the
    last one; the state holds the first line of each smaller indent behind.
    """
    def step(behind, l):
        def settled(outer):
            end_no = F.get(outer, F.size(outer) - 1)["line_no"]
            here = F.array(F.struct(l["indent"].alias("indent"), l["line_no"].alias("line_no")))
            block = F.struct(l["line_no"].alias("line_no"), l["indent"].alias("indent"), end_no.alias("end_no"))
            return F.struct(
                F.concat(F.filter(outer, lambda o: o["indent"] < l["indent"]), here).alias("state"),
                F.when(l["line"].rlike(header), block).alias("out"))

        return let(F.filter(behind, lambda o: o["indent"] <= l["indent"]), settled)

    start = F.array().cast("array<struct<indent:int,line_no:int>>")
    walk = running(_backward(lines), start, step, "struct<line_no:int,indent:int,end_no:int>")
    return F.reverse(F.filter(walk["out"], lambda b: b.isNotNull()))


def _backward(lines) -> Column:
    return F.reverse(F.filter(lines, lambda l: F.trim(l["line"]) != ""))


def blocks_without(lines, header: str, mark: str) -> Column:
    """A true for every block under a header that no line like `mark` stands in."""
    def step(behind, l):
        def settled(inner):
            equal = F.exists(behind, lambda o: (o["indent"] == l["indent"]) & o["marked"])
            here = F.array(F.struct(
                l["indent"].alias("indent"), (inner | equal | l["line"].rlike(mark)).alias("marked")))
            return F.struct(
                F.concat(F.filter(behind, lambda o: o["indent"] < l["indent"]), here).alias("state"),
                (l["line"].rlike(header) & ~inner).alias("out"))

        return let(F.exists(behind, lambda o: (o["indent"] > l["indent"]) & o["marked"]), settled)

    start = F.array().cast("array<struct<indent:int,marked:boolean>>")
    return F.filter(running(_backward(lines), start, step, "boolean")["out"], lambda silent: silent)


def depth_array(lines, header: str) -> Column:
    """The number of blocks under a header around each line."""
    def step(around, l):
        still = F.when(F.trim(l["line"]) == "", around).otherwise(F.filter(around, lambda i: i < l["indent"]))
        return let(still, lambda s: F.struct(
            F.when(l["line"].rlike(header), F.concat(s, F.array(l["indent"]))).otherwise(s).alias("state"),
            F.size(s).alias("out")))

    return running(lines, F.array().cast("array<int>"), step, "int")["out"]


def lines_within(lines, header: str) -> Column:
    """Lines inside some block under a header."""
    def step(outermost, l):
        # The indent of the outermost open block; null outside of all.
        still = F.when((F.trim(l["line"]) == "") | (l["indent"] > outermost), outermost)
        return let(still, lambda s: F.struct(
            F.coalesce(s, F.when(l["line"].rlike(header), l["indent"])).alias("state"), s.isNotNull().alias("out")))

    def within(v):
        flags = running(v, F.lit(None).cast("int"), step, "boolean")["out"]
        held = let(flags, lambda f: F.filter(v, lambda l, i: F.get(f, i)))
        return F.when(F.exists(v, lambda l: l["line"].rlike(header)), held)

    return let(lines, within)
