"""Checks that are joins in disguise. Every join is an equi join on the file key and a name."""

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import events as ev
from ..functions.code import strip_code
from ..functions.css import closest_property, known_properties
from ..functions.events import ASYNC, HOOKS_WITH_DEPS, LOOP
from ..functions.text import count_regex, extract_all, let, one_of, regex
from ..functions.versions import line_hashes, moved_lines
from ..plans.checks_code import (
    GIVEN, JS_GLOBALS, JS_KEYWORDS, MEMBER, NULL_ASSIGNED, PROP_TYPES, REQUIRED, RESOURCES, flow_array, unused_array,
)
from ..plans.checks_css import VENDOR
from ..plans.checks_html import CONTROL, CONTROL_ID, LABEL, SELF_LABELLED, SKIPPED_INPUT
from .unnest import KEY, js_declarations, js_names, jsx_tags

FILE = ["job_id", "path"]


def job_results(files: DataFrame, scores: DataFrame) -> DataFrame:
    """File and score rows of a run; one score per file, so no key repeats."""
    return files.join(scores.drop("language"), FILE)


# Pages --------------------------------------------------------------------------------------------------------

def unlabelled_inputs(files: DataFrame) -> DataFrame:
    """Form controls (pos, tag) without aria label, placeholder or a label for their id."""
    controls = files.select(*KEY, F.posexplode(extract_all("text", CONTROL)).alias("pos", "raw")).where(
        ~F.col("raw").rlike(regex(SKIPPED_INPUT)) & ~F.col("raw").rlike(regex(SELF_LABELLED)))
    controls = controls.select(
        *KEY, (F.col("pos") + 1).alias("pos"), F.regexp_extract("raw", r"^<(\w+)", 1).alias("tag"),
        F.regexp_extract("raw", regex(CONTROL_ID), 1).alias("id"))
    labels = files.select(*FILE, F.explode(extract_all("text", LABEL, 1)).alias("id"))
    return controls.join(labels, [*FILE, "id"], "left_anti")


def dead_selectors(selectors: DataFrame, files: DataFrame) -> DataFrame:
    """Selectors whose id and class names all miss in the page."""
    used = files.select(*FILE, F.explode(extract_all(
        "text", r"""(?i)\b(?:id|class)\s*=\s*["']([^"']+)["']""", 1)).alias("names"))
    used = used.select(*FILE, F.explode(F.split("names", r"\s+")).alias("token")).distinct()
    shallow = (count_regex("selector", " ") <= 2) & (count_regex("selector", ">") <= 1)
    wanted = selectors.where(shallow).select(
        *KEY, "rule_no", "selector", F.explode(extract_all("selector", r"[#.]([\w-]+)", 1)).alias("token"))
    hit = wanted.join(used.withColumn("hit", F.lit(1)), [*FILE, "token"], "left")
    return (
        hit.groupBy(*KEY, "rule_no", "selector").agg(F.max("hit").alias("hit")).where("hit is null").drop("hit")
    )


# Scripts ------------------------------------------------------------------------------------------------------

def use_before_declaration(files: DataFrame) -> DataFrame:
    """Variables named on a line before their declaration: (name, kind, line_no, first_use)."""
    declared = js_declarations(files).where(
        (F.col("kind") != "function") & ~one_of("name", JS_KEYWORDS + JS_GLOBALS))
    used = js_names(files).select(*FILE, "name", F.col("line_no").alias("first_use"))
    return declared.join(used, [*FILE, "name"]).where("first_use < line_no").select(
        *KEY, "name", "kind", "line_no", "first_use")


def nullish_access(files: DataFrame) -> DataFrame:
    """Names set to null or undefined and then read with a plain member access."""
    code = files.select(*KEY, strip_code("text").alias("code"))
    empty = extract_all("code", NULL_ASSIGNED, 1)
    empty = code.select(*KEY, F.explode(F.array_distinct(empty)).alias("name"))
    member = F.filter(extract_all("code", MEMBER, 1), lambda n: ~n.startswith("?"))
    member = code.select(*FILE, F.explode(F.array_distinct(member)).alias("name"))
    return empty.join(member, [*FILE, "name"], "left_semi")


def unreleased_resources(files: DataFrame, pairs=RESOURCES) -> DataFrame:
    """Resources a file acquires without ever naming their release; the pairs are literals, no join is needed."""
    entries = F.array(*[
        F.when(F.col("text").contains(a) & ~F.col("text").contains(r),
               F.struct(F.lit(a).alias("resource"), F.lit(r).alias("release")))
        for a, r in pairs])
    return files.select(*KEY, F.inline(F.array_compact(entries)))


# Components ---------------------------------------------------------------------------------------------------

def missing_required_props(files: DataFrame) -> DataFrame:
    """Uses (component, pos, prop) that leave out a required prop; tags that spread props are trusted."""
    blocks = files.select(*KEY, F.explode(extract_all("text", PROP_TYPES)).alias("b"))
    required = blocks.select(
        *FILE, F.regexp_extract("b", regex(PROP_TYPES), 1).alias("tag"),
        F.explode(extract_all(F.regexp_extract("b", regex(PROP_TYPES), 2), REQUIRED, 1)).alias("prop")).distinct()
    given = extract_all("attrs", GIVEN, 1)
    uses = jsx_tags(files).where(F.col("tag").rlike("^[A-Z]") & ~F.col("attrs").contains("..."))
    uses = uses.select(*KEY, "pos", "tag", given.alias("given"))
    return (
        uses.join(required, [*FILE, "tag"]).where(~F.array_contains("given", F.col("prop")))
        .select(*KEY, F.col("tag").alias("component"), "pos", "prop")
    )


def stale_state_updates(files: DataFrame) -> DataFrame:
    """Setters fed their own captured state: (state, setter, shift, step, toggle, rebuild)."""
    rows = files.select(*KEY, F.inline(ev.stale_update_array("text")))
    return rows.where("shift or step or toggle or rebuild")


def missing_hook_deps(files: DataFrame, most: int = 5) -> DataFrame:
    """Names a callback reads that its dependency array leaves out; `listed` names the first `most` of them."""
    rows = files.select(*KEY, ev.watched_names("text").alias("names"), F.inline(ev.hook_array("text")))
    rows = rows.where(F.col("hook").isin(*HOOKS_WITH_DEPS) & F.col("deps").isNotNull())
    rows = rows.withColumn("missing", ev.missing_names(F.col("names"), F.col("callback"), F.col("deps")))
    return rows.where(F.size("missing") > 0).select(
        *KEY, "seg_no", "hook", F.size("missing").alias("n_missing"),
        F.array_join(F.slice("missing", 1, most), ", ").alias("listed"))


# Python -------------------------------------------------------------------------------------------------------


def unused_imports(files: DataFrame) -> DataFrame:
    """Imported names that no other line names, found in the file's row: no name is shuffled.

    An import needs the word; a text without it is not cut into lines.
    """
    text = F.col("text")
    imports = text.contains("import") & text.rlike(r"(?<!\w)import(?!\w)")
    return files.select(*KEY, F.explode(F.when(imports, let(ev.py_line_array("text"), unused_array))).alias("name"))


def taint_flow(files: DataFrame) -> DataFrame:
    """Calls (line_no, call_no, call, sink, name) that get a name assigned from an input on an earlier line, found in the row."""
    return files.select(*KEY, F.inline(let(ev.py_line_array("text"), flow_array)))


def inside_span(files: DataFrame, **headers: str) -> DataFrame:
    """Lines (line_no, line, indent) of Python texts with the number of blocks under each kind of header around them.

    One walk over the lines in the file's row for each kind; no line is paired with the blocks around it.
    """
    def counted(lines):
        depths = F.struct(*[ev.depth_array(lines, header).alias(name) for name, header in headers.items()])
        return let(depths, lambda d: F.transform(lines, lambda l, i: F.struct(
            l["line_no"].alias("line_no"), l["line"].alias("line"), l["indent"].alias("indent"),
            *[F.get(d[name], i).alias(name) for name in headers])))

    return files.select(*KEY, F.inline(let(ev.py_line_array("text"), counted)))


def py_blocks(files: DataFrame) -> DataFrame:
    """Python lines with the number of loops and async functions around them."""
    return inside_span(files, loops=LOOP, asyncs=ASYNC)


# Styles -------------------------------------------------------------------------------------------------------

def unknown_properties(declarations: DataFrame, known=None) -> DataFrame:
    """Declarations of unknown properties and the nearest known name, if one is near, found inside the row."""
    known = known or known_properties()
    odd = declarations.where(~F.col("prop").rlike(VENDOR) & ~one_of("prop", known))
    return odd.select(*KEY, "rule_no", "decl_no", "prop", closest_property("prop", known).alias("suggestion"))


# Runs ---------------------------------------------------------------------------------------------------------


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings counted per (path, rule_id, message) in two runs, with their state; per project too, where both name it."""
    project = [c for c in ("original_name",) if c in before.columns and c in after.columns]
    key = [*project, "path", "rule_id", "message"]
    a = before.groupBy(*key).agg(F.count("*").alias("n_before"))
    b = after.groupBy(*key).agg(F.count("*").alias("n_after"))
    n, m = F.coalesce("n_before", F.lit(0)), F.coalesce("n_after", F.lit(0))
    state = F.when(n == 0, "added").when(m == 0, "fixed").when(n == m, "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(*key, n.alias("n_before"), m.alias("n_after"), state.alias("state"))


def line_moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (job_id, path, moves) of the files in two versions: for each old line its new one, null if it has none.

    What is joined are hashes of lines, not texts. Files of one version have no row.
    """
    old = before.select(*FILE, line_hashes("text").alias("old"))
    new = after.select(*FILE, line_hashes("text").alias("new"))
    return old.join(new, FILE).select(*FILE, moved_lines("old", "new").alias("moves"))


def compare_places(before: DataFrame, after: DataFrame, moves: DataFrame) -> DataFrame:
    """Findings of two versions by their places: (path, rule_id, message, line_before, line_after, n_before, n_after, state).

    A finding whose line has only moved is unchanged; one on a line that is gone is fixed, one on a new line added. Findings
    without a line are compared by rule and message, as in compare_runs.
    """
    key, place = [*FILE, "rule_id", "message"], F.coalesce("line", F.lit(0)).alias("line")
    a = before.groupBy(*key, place).agg(F.count("*").alias("n_before"))
    a = a.join(moves, FILE, "left").withColumn(
        "at", F.when(F.col("line") == 0, 0).otherwise(F.coalesce(F.get("moves", F.col("line") - 1), -F.col("line"))))
    a = a.select(*key, F.col("line").alias("line_before"), "at", "n_before")
    b = after.groupBy(*key, place).agg(F.count("*").alias("n_after")).withColumnRenamed("line", "at").withColumn("line_after", F.col("at"))
    n, m = F.coalesce("n_before", F.lit(0)), F.coalesce("n_after", F.lit(0))
    state = F.when(n == 0, "added").when(m == 0, "fixed").when(n == m, "unchanged").otherwise("changed")
    shown = lambda c: F.when(F.col(c) > 0, F.col(c)).alias(c)
    return a.join(b, [*key, "at"], "full").select(
        *key, shown("line_before"), shown("line_after"), n.alias("n_before"), m.alias("n_after"), state.alias("state"))
