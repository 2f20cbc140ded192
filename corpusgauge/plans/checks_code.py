"""Checks of scripts, manifests, Python text and components. Impacts and messages are fixed values."""

from pyspark.sql import Column, functions as F

from ..functions.code import version_risk
from ..functions.events import (
    FOR_LOOP, HANDLER, HOOKS_WITH_DEPS, JS_NAME, PY_NAME, blocks_without, imported_names, missing_names, running, runs,
)
from ..functions.text import extract_all, let, one_of, regex
from .checks import RowCheck, Spec, each, once

C = F.col

# Scripts
MISSING_AWAIT = Spec("javascript.async.missing_await", "async", "medium", 9,
                     "Promise-like call on line {n} may be missing await or return.")
NO_CATCH = Spec("javascript.async.no_catch", "async", "medium", 10,
                "Promise chain appears to be missing a catch handler; rejections may go unhandled.")
EARLY_USE = Spec("javascript.correctness.early_use", "correctness", "medium", 9,
                 "'{name}' appears before its declaration; check for scope or initialization bugs.")
NULLISH = Spec("javascript.correctness.nullish", "correctness", "medium", 8,
               "'{name}' may be null or undefined before property access.")
INTERVAL = Spec("javascript.efficiency.interval", "efficiency", "medium", 7,
                "setInterval is used without a visible clearInterval cleanup.")
LISTENERS = Spec("javascript.efficiency.listeners", "efficiency", "medium", 8,
                 "Event listeners are added without a visible cleanup path.")

PROMISE_CALL = (
    r"\b(?:fetch|axios(?:\.[A-Za-z_$][\w$]*)?|Promise\.(?:all|allSettled|race|any)|new\s+Promise)\s*\("
)
HANDLED = r"\bawait\b|\breturn\b|\.then\(|\.catch\(|\.finally\("
THEN_REACH = 350
NULL_ASSIGNED = r"(%s)\s*=\s*(?:null|undefined)\b" % JS_NAME
MEMBER = r"(\??%s)\." % JS_NAME

# Names that are never declarations to look for.
JS_KEYWORDS = (
    "break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete", "do", "else", "export",
    "extends", "false", "finally", "for", "function", "if", "import", "in", "instanceof", "let", "new", "null",
    "return", "super", "switch", "this", "throw", "true", "try", "typeof", "var", "void", "while", "with", "yield",
    "async", "await",
)
JS_GLOBALS = (
    "Array", "ArrayBuffer", "Boolean", "Date", "Error", "EvalError", "Function", "Infinity", "JSON", "Map", "Math",
    "NaN", "Number", "Object", "Promise", "Proxy", "RangeError", "ReferenceError", "Reflect", "RegExp", "Set",
    "String", "Symbol", "SyntaxError", "TypeError", "URIError", "WeakMap", "WeakSet", "console", "document",
    "window", "globalThis", "navigator", "location", "history", "localStorage", "sessionStorage", "fetch", "URL",
    "URLSearchParams", "setTimeout", "setInterval", "clearTimeout", "clearInterval", "setImmediate",
    "clearImmediate", "queueMicrotask",
)


def first_by_name(items) -> Column:
    """Of structs (name, line_no, ...) the first of every name."""
    def firsts(v):
        return F.filter(v, lambda x, i: (i == 0) | (x["name"] != F.get(v, i - 1)["name"]))

    return let(F.array_sort(items), firsts)


def javascript_async() -> Column:
    loose = F.filter("lines", lambda l: l["line"].rlike(PROMISE_CALL) & ~l["line"].rlike(HANDLED))
    # Text cut behind each `.then(`; a cut shorter than the reach goes on with the next ones.
    span = THEN_REACH // 6 + 1

    def bare(segs):
        chain = lambda i: F.substring(F.array_join(F.slice(segs, i, F.lit(span)), ""), 1, THEN_REACH)
        starts = F.filter(F.sequence(F.lit(1), F.size(segs)), lambda i: i > 1)
        return F.exists(starts, lambda i: ~chain(i).rlike(r"\.catch\(|\.finally\("))

    segments = F.split(F.regexp_replace("text", r"\.then\s*\(", "\x01$0"), "\x01")
    return F.concat(
        each(F.slice(loose, 1, 1), lambda l: ((MISSING_AWAIT, F.lit(True), {"n": l["line_no"]}),)),
        once((NO_CATCH, C("text").contains(".then") & let(segments, bare))))


def _early_uses() -> Column:
    """Variables named on a line before their declaration: struct (name, kind)."""
    pattern = r"\b(?:(?:let|const|var)\s+%s|function\s+%s\s*\()" % (JS_NAME, JS_NAME)

    def declared(l):
        # Within a line, variables come before functions.
        return F.transform(extract_all(l["line"], pattern), lambda d, i: let(
            F.regexp_extract(d, r"^(\w+)", 1), lambda kind: F.struct(
                F.regexp_extract(d, r"^\w+\s+(%s)" % JS_NAME, 1).alias("name"), l["line_no"].alias("line_no"),
                (kind == "function").alias("late"), i.alias("at"), kind.alias("kind"))))

    def named(l):
        names = F.array_distinct(extract_all(l["line"], r"(?:^|[^.\w$])(%s)" % JS_NAME, 1))
        return F.transform(names, lambda n: F.struct(n.alias("name"), l["line_no"].alias("line_no")))

    def entry(source, x, kind):
        return F.struct(x["name"].alias("name"), F.lit(source).alias("source"), x["line_no"].alias("line_no"),
                        kind.alias("kind"))

    # Sorted together, a variable stands right before the first line that names it.
    def early(v):
        def is_early(d, i):
            return let(F.get(v, i + 1), lambda n: (d["source"] == 0) & (n["source"] == 1) & (
                n["name"] == d["name"]) & (n["line_no"] < d["line_no"]))

        return F.filter(v, is_early)

    first_declared = first_by_name(F.flatten(F.transform("lines", declared)))
    variables = F.filter(
        first_declared, lambda d: (d["kind"] != "function") & ~one_of(d["name"], JS_KEYWORDS + JS_GLOBALS))
    first_named = first_by_name(F.flatten(F.transform("lines", named)))
    return let(F.array_sort(F.concat(
        F.transform(variables, lambda d: entry(0, d, d["kind"])),
        F.transform(first_named, lambda n: entry(1, n, F.lit(None).cast("string"))))), early)


def _nullish() -> Column:
    """Names set to null or undefined and then read with a plain member access."""
    empty = extract_all("code", NULL_ASSIGNED, 1)
    members = F.filter(extract_all("code", MEMBER, 1), lambda n: ~n.startswith("?"))
    return F.array_intersect(empty, members)


def javascript_correctness() -> Column:
    def early(u):
        var = u["kind"] == "var"
        return ((EARLY_USE, F.lit(True), {
            "name": u["name"], "severity": F.when(var, "low").otherwise("medium"),
            "impact": F.when(var, 6).otherwise(9)}),)

    return F.concat(
        each(_early_uses(), early), each(_nullish(), lambda n: ((NULLISH, F.lit(True), {"name": n}),)))


def javascript_efficiency() -> Column:
    text = C("text")
    return once(
        (INTERVAL, text.contains("setInterval(") & ~text.contains("clearInterval(")),
        (LISTENERS, text.rlike(r"\baddEventListener\s*\(") & ~text.contains("removeEventListener(")))


# Manifests
UNPINNED = Spec("dependencies.unpinned", "dependency", "medium", 8,
                "'{name}' uses an unpinned version range ({spec}); this makes builds less predictable.")
NON_REGISTRY = Spec("dependencies.non_registry", "dependency", "medium", 9,
                    "'{name}' is sourced from a non-registry reference; review supply-chain risk.")
ZERO_MAJOR = Spec("dependencies.zero_major", "dependency", "low", 5,
                  "'{name}' is on a 0.x version line; verify maturity and compatibility carefully.")
RANGE = Spec("dependencies.range", "dependency", "medium", 7,
             "'{name}' uses a version constraint that may hide old or incompatible releases.")
NO_MANAGER = Spec("dependencies.package_manager", "dependency", "low", 3,
                  "No packageManager field found; pinning the package manager can reduce install drift.")
INVALID = Spec("dependencies.invalid_json", "dependency", "medium", 8,
               "package.json is not valid JSON, so dependency checks cannot be trusted.")


def dependencies() -> Column:
    def tests(d):
        risk = lambda name: F.array_contains(d["risks"], name)
        who = {"name": d["package"]}
        return (
            (UNPINNED, risk("unpinned"), {**who, "spec": F.trim(d["spec"])}),
            (NON_REGISTRY, risk("non_registry"), who), (ZERO_MAJOR, risk("zero_major"), who),
            (RANGE, risk("range"), who))

    specs = F.transform("dependencies", lambda d: F.struct(
        d["package"].alias("package"), d["spec"].alias("spec"), version_risk(d["spec"]).alias("risks")))
    valid = C("manifest._bad").isNull()
    return F.concat(each(specs, tests), once(
        (INVALID, C("manifest").isNotNull() & ~valid),
        (NO_MANAGER, C("manifest").isNotNull() & valid & (F.coalesce("manifest.packageManager", F.lit("")) == ""))))


# Python
TAINT = {
    "shell": Spec("python.security.tainted_shell", "security", "high", 28, "Tainted input reaches a shell command."),
    "path": Spec("python.security.tainted_path", "security", "high", 20,
                 "Untrusted file path used in file operation."),
    "database": Spec("python.security.tainted_query", "security", "high", 22,
                     "Tainted input reaches a database call without validation."),
    "network": Spec("python.security.tainted_request", "security", "medium", 16,
                    "Unvalidated input reaches a network call."),
    "log": Spec("python.security.tainted_log", "security", "low", 6,
                "Potentially sensitive user input is being logged."),
}
NESTED = Spec("python.efficiency.nested_loops", "efficiency", "medium", 12, "Nested loops may create quadratic cost.")
LOOP_CALL = Spec("python.efficiency.loop_call", "efficiency", "medium", 10,
                 "Repeated I/O or external calls inside a loop can be expensive.")
ASYNC_CALL = Spec("python.efficiency.async_call", "efficiency", "high", 16,
                  "Blocking call '{name}' inside async code can stall the event loop.")
LOOP_QUERY = Spec("python.efficiency.loop_query", "efficiency", "medium", 10,
                  "Repeated DB calls inside a loop can create an N+1 pattern.")
CONCAT = Spec("python.efficiency.concatenation", "efficiency", "medium", 10,
              "List/dict concatenation inside a loop can be slow; prefer append or extend.")
GROWTH = Spec("python.efficiency.growth", "efficiency", "low", 6,
              "Repeated collection growth in a loop may be inefficient.")
ASYNC_BLOCK = Spec("python.correctness.async_call", "correctness", "high", 18,
                   "Blocking call '{name}' inside async code can stall the event loop.")
UNUSED = Spec("python.correctness.unused_import", "correctness", "low", 3, "Imported name '{name}' appears unused.")
SWALLOWED = Spec("python.correctness.swallowed", "correctness", "medium", 10,
                 "Exception appears to be swallowed silently.")
NOT_SNAKE = Spec("python.maintenance.function_name", "maintenance", "low", 6,
                 "Function name '{name}' is not snake_case.")
NOT_PASCAL = Spec("python.maintenance.class_name", "maintenance", "low", 5,
                  "Class name '{name}' should use PascalCase.")

HEAVY = (
    r"(?:^|[^\w.])(open|time\.sleep|subprocess\.(?:run|call|Popen)|requests\.(?:get|post|put|delete|request))\s*\("
)
BLOCKING = r"(?:^|[^\w.])(time\.sleep|open|subprocess\.(?:run|call|Popen))\s*\("
BLOCKING_OR_SHELL = r"(?:^|[^\w.])(time\.sleep|open|os\.system|subprocess\.(?:run|call|Popen))\s*\("


TAINTED = (
    r"^\s*(%s(?:\s*,\s*%s)*+)\s*(?::[^=]+)?=\s*(?:input\s*\(|sys\.argv\b|os\.environ\b"
    r"|request\.(?:get_json|json|form\.get|args\.get|headers\.get)\s*\(|request\.[\w.]+\[)" % (PY_NAME, PY_NAME)
)
CALL = r"(?:^|[^\w.])(%s(?:\.%s)*+)\s*\(([^()]*)" % (PY_NAME, PY_NAME)
ARGUMENT_NAME = r"(?:^|[^.\w])(%s)" % PY_NAME

# Calls tainted names must not reach, and whether only their first argument counts.
SINKS = (
    ("shell", r"^(?:os\.system|subprocess\.(?:run|call|Popen))$", True),
    ("path", r"^open$|\.(?:write_text|write_bytes|unlink|rename|replace)$", True),
    ("database", r"\.(?:execute|executemany|query)$", False),
    ("network", r"^requests\.|^urllib\.request\.urlopen$|^http\.client\.HTTPConnection\.request$", False),
    ("log", r"^(?:print|logging\.(?:debug|info|warning|error|critical))$|^logger\.", False),
)


def call_sink(call) -> Column:
    out = F
    for name, pattern, _ in SINKS:
        out = out.when(call.rlike(pattern), name)
    return out.otherwise(None)


def sink_arguments(sink, args) -> Column:
    """Names among the arguments that count for a sink."""
    first = sink.isin(*[name for name, _, first_only in SINKS if first_only])
    counted = F.when(first, F.substring_index(args, ",", 1)).otherwise(args)
    return extract_all(counted, ARGUMENT_NAME, 1)


def _flat(array, items) -> Column:
    return F.flatten(F.transform(array, items))


FLOW = "struct<line_no:int,call_no:int,call:string,sink:string,name:string>"


def flow_array(lines) -> Column:
    """Struct (line_no, call_no, call, sink, name) of the calls that get a name assigned from an input on an earlier line.

    Direct assignments only; arguments are read up to the first nested parenthesis of the call. Names and uses are sorted
    together and walked once, so that work doesn't grow with names times calls; of several names a call gets the first.
    """
    def sources(l):
        return F.transform(extract_all(F.regexp_extract(l["line"], TAINTED, 1), PY_NAME), lambda n: F.struct(
            n.alias("name"), l["line_no"].alias("line_no")))

    def event(name, line_no, call_no=F.lit(-1), call=F.lit(None).cast("string"), sink=F.lit(None).cast("string")):
        return F.struct(name.alias("name"), (call_no >= 0).alias("is_use"), line_no.alias("line_no"), call_no.alias("call_no"), call.alias("call"), sink.alias("sink"))

    def uses(l):
        def read(c, i):
            call = F.regexp_extract(c, CALL, 1)
            return let(call_sink(call), lambda sink: F.when(sink.isNotNull(), F.transform(
                F.array_distinct(sink_arguments(sink, F.regexp_extract(c, CALL, 2))), lambda n: event(n, l["line_no"], i, call, sink))))

        return F.flatten(F.array_compact(F.transform(extract_all(l["line"], CALL), read)))

    def flows(names):
        def step(state, e):
            hit = (state["name"] == e["name"]) & (state["line_no"] < e["line_no"])
            flow = F.struct(*[e[n].alias(n) for n in ("line_no", "call_no", "call", "sink", "name")])
            mine = F.struct(e["name"].alias("name"), e["line_no"].alias("line_no"))
            return F.struct(F.when(e["is_use"], state).otherwise(mine).alias("state"), F.when(e["is_use"] & hit, flow).alias("out"))

        events = F.array_sort(F.concat(F.transform(names, lambda n: event(n["name"], n["line_no"])), _flat(lines, uses)))
        start = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("line_no"))
        hits = F.array_sort(F.filter(running(events, start, step, FLOW)["out"], lambda f: f.isNotNull()))
        one = let(hits, lambda v: F.transform(runs(v, lambda f: F.struct(
            f["line_no"].alias("line_no"), f["call_no"].alias("call_no"))), lambda r: F.get(v, r["at"])))
        return F.when(F.size(names) > 0, one)

    return let(first_by_name(_flat(F.filter(lines, lambda l: l["line"].rlike(TAINTED)), sources)), flows)


def python_security() -> Column:
    return each(let(C("py_lines"), flow_array), lambda f: [(spec, f["sink"] == sink) for sink, spec in TAINT.items()])


QUERY_CALL = r"([\w\])]\.execute)\s*\("
CONCATENATION = r"[\w\])'\"]\s*\+\s*[\w\[('\"]"


def _calls(lines, pattern) -> Column:
    return _flat(lines, lambda l: extract_all(l["line"], pattern, 1))


def python_efficiency() -> Column:
    """Loops and async functions by indentation; calls over several lines and one-line loops are missed."""
    per_line = lambda l: (
        (NESTED, l["line"].rlike(FOR_LOOP)), (GROWTH, l["line"].contains("+=")),
        (CONCAT, l["line"].rlike(CONCATENATION)))
    return F.concat(
        each("loop_lines", per_line),
        each(_calls(C("loop_lines"), HEAVY), lambda c: ((LOOP_CALL, F.lit(True)),)),
        each(_calls(C("loop_lines"), QUERY_CALL), lambda c: ((LOOP_QUERY, F.lit(True)),)),
        each(_calls(C("async_lines"), BLOCKING), lambda c: ((ASYNC_CALL, F.lit(True), {"name": c}),)))


def unused_array(lines="py_lines") -> Column:
    """Imported names that no other line names; lines are read for names only where a name is imported."""
    statement = lambda l: l["line"].rlike(r"^\s*(?:import|from)\s")
    imported = F.array_distinct(_flat(F.filter(lines, statement), lambda l: imported_names(l["line"])))
    used = _calls(F.filter(lines, lambda l: ~statement(l)), ARGUMENT_NAME)
    return let(imported, lambda names: F.when(F.size(names) > 0, F.array_except(names, used)).otherwise(names))


def _swallowed() -> Column:
    """A true for every exception handler whose block never raises."""
    return blocks_without(C("py_lines"), HANDLER, r"\braise\b")


def python_correctness() -> Column:
    return F.concat(
        each(_calls(C("async_lines"), BLOCKING_OR_SHELL), lambda c: ((ASYNC_BLOCK, F.lit(True), {"name": c}),)),
        each(unused_array(), lambda n: ((UNUSED, F.lit(True), {"name": n}),)),
        each(_swallowed(), lambda b: ((SWALLOWED, F.lit(True)),)))


def python_maintenance() -> Column:
    functions = _calls(C("py_lines"), r"^\s*(?:async\s+)?def\s+(%s)" % PY_NAME)
    classes = _calls(C("py_lines"), r"^\s*class\s+(%s)" % PY_NAME)
    return F.concat(
        each(functions, lambda n: ((NOT_SNAKE, n.rlike("[A-Z-]"), {"name": n}),)),
        each(classes, lambda n: ((NOT_PASCAL, ~n.rlike("^[A-Z][A-Za-z0-9]+$"), {"name": n}),)))


# Components
CONTROL_FLOW = Spec("react.hooks.control_flow", "hooks", "high", 18,
                    "{hook} appears inside control flow. Hooks must keep a stable call order.")
NO_DEPS = Spec("react.hooks.no_deps", "hooks", "medium", 10, "{hook} is missing a dependency array.")
PROPS_DEPS = Spec("react.hooks.props_deps", "hooks", "medium", 12,
                  "{hook} reads props but the dependency array looks incomplete.")
MISSING_DEPS = Spec("react.hooks.missing_deps", "hooks", "medium", 12,
                    "{hook} dependency array may be missing: {names}.")
EMPTY_DEPS = Spec("react.hooks.empty_deps", "hooks", "low", 5,
                  "Empty dependency array in {hook} may be stale if it reads props or state.")
SHIFTED = Spec("react.hooks.stale_shift", "state", "medium", 12,
               "{setter} uses {state} directly; prefer functional updates to avoid stale state.")
REBUILT = Spec("react.hooks.stale_rebuild", "state", "low", 6,
               "{setter} appears to rebuild from captured {state}; check for stale closure risk.")
STEPPED = Spec("react.state.captured_step", "state", "medium", 12,
               "{setter} updates {state} from a captured value. Use a functional update instead.")
TOGGLED = Spec("react.state.captured_toggle", "state", "low", 5,
               "{setter} toggles {state} directly. Confirm it is not stale inside async logic.")
ASYNC_EFFECT = Spec("react.lifecycle.async_effect", "lifecycle", "medium", 12,
                    "Avoid async useEffect callbacks. Use an inner async function with cleanup/abort logic.")
NO_CLEANUP = Spec("react.lifecycle.no_cleanup", "lifecycle", "high", 18,
                  "useEffect uses {resource} without an obvious cleanup. That can leak resources.")
OTHER_CLEANUP = Spec("react.lifecycle.other_cleanup", "lifecycle", "medium", 10,
                     "useEffect uses {resource}. Check that cleanup via {release} is implemented.")
REQUIRED_PROP = Spec("react.props.missing_required", "props", "medium", 10,
                     "<{component}> is missing required prop '{prop}'.")
CONTROLLED = Spec("react.props.controlled", "props", "medium", 10,
                  "<{tag}> looks controlled but has no onChange or readOnly handler.")
IMAGE_ALT = Spec("react.accessibility.image_alt", "accessibility", "medium", 8,
                 "Image elements should include alt text.")
CONTROL_LABEL = Spec("react.accessibility.control_label", "accessibility", "medium", 8,
                     "<{tag}> may be missing an accessible label.")
CLICKABLE = Spec("react.accessibility.clickable", "accessibility", "high", 14,
                 "<{tag}> is clickable but lacks keyboard and role support.")
ANCHOR = Spec("react.accessibility.anchor", "accessibility", "medium", 10,
              "<a> with onClick but no href is not accessible by default.")


# Resources and their release.
RESOURCES = (
    ("setInterval", "clearInterval"),
    ("setTimeout", "clearTimeout"),
    ("addEventListener", "removeEventListener"),
    ("subscribe", "unsubscribe"),
    ("fetch(", "AbortController"),
    ("new WebSocket", "close"),
)
IN_CONTROL_FLOW = r"(?i)\b(if|for|while|switch|catch|try)\b"
STALE_READ = r"\b(props\.|useState|useReducer|useRef|set[A-Z][A-Za-z0-9_]*)"


def react_hooks(compat: bool = False) -> Column:
    """compat: a hook is in control flow if one of its words stands within 180 characters before it."""
    astray = F.filter("hooks", lambda h: h["prefix"].rlike(IN_CONTROL_FLOW) if compat else h["controlled"])
    astray = F.array_distinct(F.transform(astray, lambda h: h["hook"]))
    watching = F.transform(F.filter("hooks", lambda h: h["hook"].isin(*HOOKS_WITH_DEPS)), lambda h: F.struct(
        h["hook"].alias("hook"), h["callback"].alias("callback"), F.coalesce(h["deps"], F.lit("")).alias("deps"),
        missing_names(C("watched"), h["callback"], h["deps"]).alias("missing")))

    def tests(h):
        hook, listed = {"hook": h["hook"]}, h["deps"] != ""
        names = F.array_join(F.slice(h["missing"], 1, 5), ", ")
        return (
            (NO_DEPS, ~listed, hook),
            (PROPS_DEPS, listed & h["callback"].contains("props.") & ~h["deps"].contains("props."), hook),
            (MISSING_DEPS, listed & (F.size(h["missing"]) > 0), {**hook, "names": names}),
            (EMPTY_DEPS, (h["deps"] == "[]") & h["callback"].rlike(STALE_READ), hook))

    def updates(u):
        pair = {"state": u["state"], "setter": u["setter"]}
        return (SHIFTED, u["shift"], pair), (REBUILT, u["rebuild"], pair)

    return F.concat(
        each(astray, lambda h: ((CONTROL_FLOW, F.lit(True), {"hook": h}),)), each(watching, tests),
        each("stale", updates))


def react_state() -> Column:
    def updates(u):
        pair = {"state": u["state"], "setter": u["setter"]}
        return (STEPPED, u["step"], pair), (TOGGLED, u["toggle"], pair)

    return each("stale", updates)


def react_lifecycle() -> Column:
    def tests(h):
        body = h["callback"]
        cleanup = body.rlike(r"\breturn\s*\(\s*\)\s*=>|\breturn\s+function\b")
        out = [(ASYNC_EFFECT, body.rlike(r"\basync\s*\(|\basync\s+(?:\w+|\()"))]
        for resource, release in RESOURCES:
            shown = {"resource": F.lit(resource.rstrip("(")), "release": F.lit(release)}
            used = body.contains(resource)
            out.append((NO_CLEANUP, used & ~cleanup, shown))
            out.append((OTHER_CLEANUP, used & cleanup & ~body.contains(release), shown))
        return out

    return each(F.filter("hooks", lambda h: h["hook"] == "useEffect"), tests)


PROP_TYPES = r"\b([A-Z][A-Za-z0-9_]*)\.propTypes\s*=\s*\{([^{}]*)\}"
REQUIRED = r"\b(%s)\s*:\s*[^,\n]+?\.isRequired\b" % JS_NAME
GIVEN = r"(%s)\s*=" % JS_NAME


def _lacking() -> Column:
    """Uses (component, prop) that leave out a required prop; tags that spread props are trusted."""
    def wanted(block):
        props = extract_all(F.regexp_extract(block, regex(PROP_TYPES), 2), REQUIRED, 1)
        return F.transform(F.array_distinct(props), lambda p: F.struct(
            F.regexp_extract(block, regex(PROP_TYPES), 1).alias("component"), p.alias("prop")))

    def lacking(required):
        uses = F.filter("jsx", lambda t: t["tag"].rlike("^[A-Z]") & ~t["attrs"].contains("..."))
        return F.when(F.size(required) > 0, _flat(uses, lambda t: F.filter(required, lambda r: (
            r["component"] == t["tag"]) & ~F.array_contains(extract_all(t["attrs"], GIVEN, 1), r["prop"]))))

    return let(F.array_distinct(_flat(extract_all("text", PROP_TYPES), wanted)), lacking)


def react_props() -> Column:
    def control(t):
        attrs = t["attrs"]
        loose = (
            t["tag"].isin("input", "textarea", "select") & attrs.rlike(r"\b(value|checked)\s*=\s*\{")
            & ~attrs.rlike(r"\bonChange\s*=") & ~attrs.rlike(r"\breadOnly\s*="))
        return ((CONTROLLED, loose, {"tag": t["tag"]}),)

    required = lambda r: ((REQUIRED_PROP, F.lit(True), {"component": r["component"], "prop": r["prop"]}),)
    return F.concat(each(_lacking(), required), each("jsx", control))


def react_accessibility() -> Column:
    def tests(t):
        attrs, tag = t["attrs"], F.lower(t["tag"])
        click = attrs.rlike(r"\bonClick\s*=")
        keyboard = (
            attrs.rlike(r"""\brole\s*=\s*['"]""") & attrs.rlike(r"\bon(KeyDown|KeyUp|KeyPress)\s*=")
            & attrs.rlike(r"\btabIndex\s*="))
        label = attrs.rlike(r"(?i)\b(aria-label|aria-labelledby|title)\s*=") | attrs.rlike(r"(?i)\bid\s*=")
        return (
            (IMAGE_ALT, (tag == "img") & ~attrs.rlike(r"(?i)\balt\s*=")),
            (CONTROL_LABEL, tag.isin("input", "textarea", "select") & ~label, {"tag": tag}),
            (CLICKABLE, tag.isin("div", "span", "li", "section", "article", "p") & click & ~keyboard, {"tag": tag}),
            (ANCHOR, (tag == "a") & click & ~attrs.rlike(r"\bhref\s*=")))

    return each("jsx", tests)


JS, PYTHON, REACT = ("javascript",), ("python",), ("react",)
HOOK_CHECK = RowCheck(REACT, ("hooks", "watched", "stale"), react_hooks)
COMPAT_CHECKS = {"react.hooks": RowCheck(HOOK_CHECK.languages, HOOK_CHECK.needs, lambda: react_hooks(compat=True))}
CHECKS = {
    "javascript.async": RowCheck(JS, ("lines",), javascript_async),
    "javascript.correctness": RowCheck(JS, ("lines", "code"), javascript_correctness),
    "javascript.efficiency": RowCheck(JS, (), javascript_efficiency),
    "dependencies": RowCheck(("manifest",), ("manifest", "dependencies"), dependencies),
    "python.security": RowCheck(PYTHON, ("py_lines",), python_security),
    "python.efficiency": RowCheck(PYTHON, ("loop_lines", "async_lines"), python_efficiency),
    "python.correctness": RowCheck(PYTHON, ("py_lines", "async_lines"), python_correctness),
    "python.maintenance": RowCheck(PYTHON, ("py_lines",), python_maintenance),
    "react.hooks": HOOK_CHECK,
    "react.state": RowCheck(REACT, ("stale",), react_state),
    "react.lifecycle": RowCheck(REACT, ("hooks",), react_lifecycle),
    "react.props": RowCheck(REACT, ("jsx",), react_props),
    "react.accessibility": RowCheck(REACT, ("jsx",), react_accessibility),
}
