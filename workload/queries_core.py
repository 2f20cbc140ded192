"""SRC, PRJ and SCA: sources, detection and scalar functions."""

import io
import zipfile

from pyspark.sql import functions as F

from corpusgauge.functions import code as fc, css as fcss, text as ft
from corpusgauge.operators import detect, unnest as u
from corpusgauge.plans import checks_css as cs
from corpusgauge.plans.registry import rules_named
from corpusgauge.model import DETAILS
from corpusgauge.plans.scan import detailed_files, rule_scan, scanned_files, scored_files
from corpusgauge.session import shared_folder
from corpusgauge.sources import corpus as src, results
from .corpora import (
    JOB, code_files, corpus, corpus_sql, document_files, page_files, quote as q, table,
)
from .queries_packs import CLASSES, COLORS
from .sql import (
    BLANKED, CSS_RULES, DECLS, LINE_COUNT, SELECTORS, SHEETS, STRIPPED, count, has, lines_of, literals, part,
    rules_sql, with_corpus,
)

ALL_TEXT = ("pages", "documents", "conversations")
STRUCTURE = ("html.structure", "html.security")


def findings_sql(*names, corpora=("pages",)):
    """Corpus and findings CTEs of rule packs."""
    return corpus_sql(*corpora) + f",\nfindings AS MATERIALIZED (SELECT * FROM ({rules_sql(rules_named(*names))}))"


# Sources ------------------------------------------------------------------------------------------------------

RUNS_SQL = """SELECT 'conv-' || conv_id AS job_id, arg_max(role || '-' || turn, turn) AS original_name,
  max(turn) * 3600 AS created FROM conversations GROUP BY conv_id"""


def src_1(spark, sf):
    """Document texts written as files below a folder per source, read back as a directory: lines and bytes per folder."""
    folder = shared_folder(spark) + "/corpus"
    docs = table(spark, sf, "documents").where("text is not null")
    docs.select("source", F.translate("text", "\r\n", "  ").alias("value")).write.option("maxRecordsPerFile", 20_000).partitionBy("source").text(folder)
    files = src.read_corpus(spark, folder).where(F.col("path").endswith(".txt"))
    lines = F.length(F.regexp_replace(src.decode_text("content"), r"[^\n]++", ""))
    return files.groupBy(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source")).agg(
        F.sum("size_bytes").alias("bytes"), F.sum(lines).cast("long").alias("lines"))


def src_2(spark, sf):
    """French documents arrive as Latin-1 bytes, the others as UTF-8."""
    docs = table(spark, sf, "documents")
    raw = F.when(F.col("lang") == "fr", F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    text = docs.select("doc_id", raw.alias("content")).select("doc_id", src.decode_text("content").alias("text"))
    return text.select("doc_id", F.length("text").alias("chars"), ft.content_hash("text").alias("sha256"))


def src_3(spark, sf):
    files = corpus(*ALL_TEXT)(spark, sf)
    return files.select("job_id", "path", "language", F.length("text").alias("chars"))


def _zipped(batches):
    import pandas as pd

    for batch in batches:
        out = []
        for doc, text in zip(batch["doc_id"], batch["text"]):
            packed = io.BytesIO()
            with zipfile.ZipFile(packed, "w") as z:
                z.writestr(f"docs/{doc}.txt", text)
                z.writestr(f"../up/{doc}.txt", "outside")
                z.writestr(f"/abs/{doc}.txt", "outside")
            out.append((f"{doc}.zip", packed.getvalue()))
        yield pd.DataFrame(out, columns=["path", "content"])


def src_4(spark, sf):
    """Every document in a ZIP of its own, next to two members with unsafe names."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    members = src.expand_archives(docs.mapInPandas(_zipped, "path string, content binary"))
    return members.select("archive", "path", ft.content_hash(src.decode_text("content")).alias("sha256"))


def _raw_paths(files):
    """Addresses with a leading slash or a parent step, as archives may hold."""
    path = F.when(F.col("path").startswith("m."), F.concat(F.lit("/"), "path")).when(
        F.col("path").contains("/de/"), F.replace("path", F.lit("/de/"), F.lit("/../"))).otherwise(F.col("path"))
    return files.withColumn("path", path)


def src_5(spark, sf):
    return src.safe_paths(_raw_paths(page_files(spark, sf))).select("path")


def src_6(spark, sf):
    """Scores and their findings written in one pass over the texts, then read back per partition."""
    folder = shared_folder(spark)
    results.write_results(scanned_files(page_files(spark, sf), rules_named(*STRUCTURE)), folder + "/results")
    found = results.findings_of(spark.read.parquet(folder + "/results")).groupBy("job_id", "language", "rule_id").agg(
        F.count("*").alias("rows"), F.sum("score_impact").alias("total"))
    scored = spark.read.parquet(folder + "/results").groupBy("job_id", "language").agg(
        F.lit("score").alias("rule_id"), F.count("*").alias("rows"), F.sum("score").alias("total"))
    return found.unionByName(scored)


def _documents(spark, sf):
    files, rules = page_files(spark, sf), rules_named(*STRUCTURE)
    return results.to_details_json(scored_files(files, rules), rule_scan(files, rules), results.file_metrics(files))


def src_7(spark, sf):
    return _documents(spark, sf).select(
        "path", F.get_json_object("details", "$.analyzer_name").alias("analyzer_name"),
        F.get_json_object("details", "$.score").cast("int").alias("score"),
        F.get_json_object("details", "$.findings[0].message").alias("first_message"),
        F.get_json_object("details", "$.metrics.lines").cast("long").alias("lines"))


def src_7b(spark, sf):
    """The same documents made in one pass; equal to the joined ones."""
    rows = detailed_files(page_files(spark, sf), rules_named(*STRUCTURE)).withColumn("d", F.from_json("details", DETAILS))
    listed = lambda counts: F.array_join(F.array_sort(F.transform(F.map_entries(counts), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))), ",")
    return rows.select(
        "path", "score", F.get_json_object("details", "$.findings[0].message").alias("first_message"), F.size("d.findings").alias("findings"),
        listed(F.col("d.metrics.severity_counts")).alias("severities"), listed(F.col("d.metrics.category_counts")).alias("categories"))


def src_8(spark, sf):
    return results.from_details_json(_documents(spark, sf)).select(
        "path", "language", "score", "rule", "severity", "score_impact", "message")


def _turns(spark, sf, which):
    turns = table(spark, sf, "conversations").where(which)
    return turns.select(
        F.concat(F.lit("conv-"), "conv_id").alias("job_id"), F.concat("role", F.lit("-"), "turn").alias("original_name"),
        F.timestamp_seconds(F.col("turn") * 3600).alias("created_at"))


def src_9(spark, sf):
    """Runs named by conversations: the user turns registered first, then those of all other roles, in a table on disk."""
    users, path = F.coalesce(F.col("role") == "user", F.lit(False)), shared_folder(spark) + "/runs"
    results.upsert_runs(_turns(spark, sf, users), path)
    results.upsert_runs(_turns(spark, sf, ~users), path)
    return results.current(spark, path).select("job_id", "original_name", F.unix_timestamp("created_at").alias("created"))


def src_9b(spark, sf):
    """The same registry without a table on disk."""
    users = F.coalesce(F.col("role") == "user", F.lit(False))
    runs = results.register_run(_turns(spark, sf, users), _turns(spark, sf, ~users))
    return runs.select("job_id", "original_name", F.unix_timestamp("created_at").alias("created"))


def src_10(spark, sf):
    """Scores exported as csv and as json, read back."""
    folder = shared_folder(spark)
    scores = scored_files(page_files(spark, sf), rules_named(*STRUCTURE)).select("path", "language", "score")
    results.export_report(scores, folder + "/csv", "csv")
    results.export_report(scores, folder + "/json", "json")
    schema = "path string, language string, score int"
    csv = spark.read.schema(schema).option("header", True).option("escape", '"').csv(folder + "/csv")
    json = spark.read.schema(schema).json(folder + "/json")
    return csv.withColumn("format", F.lit("csv")).unionByName(json.withColumn("format", F.lit("json")))


SCORES = f"""scores AS (SELECT f.path, f.language, CAST(coalesce(p.penalty, 0) AS BIGINT) AS penalty, CAST(coalesce(p.n, 0) AS BIGINT) AS findings,
  CAST(greatest(0, least(100, 100 - coalesce(p.penalty, 0))) AS INT) AS score FROM files f
  LEFT JOIN (SELECT path, sum(score_impact * n) AS penalty, sum(n) AS n FROM findings GROUP BY path) p USING (path))"""
METRICS = f"""metrics AS (SELECT path, language, CAST({LINE_COUNT} AS BIGINT) AS lines,
  CAST(len(list_filter(string_split(text, chr(10)), lambda l: {has('l', '[^ ' + chr(92) + 's]')})) AS BIGINT) AS non_empty_lines,
  CASE WHEN {LINE_COUNT} = 0 THEN 0.0 ELSE round_even(CAST(list_sum(list_transform({lines_of('text')}, lambda l: length(l))) AS DOUBLE) / {LINE_COUNT}, 2) END AS avg_line_length,
  CAST({literals('lower(text)', 'todo')} AS BIGINT) AS todo_count FROM files)"""


def on_findings(body, *ctes, names=STRUCTURE, corpora=("pages",)):
    return lambda: "WITH " + ",\n".join([findings_sql(*names, corpora=corpora), *ctes]) + "\n" + body


def sql(names, body, *ctes):
    return lambda: with_corpus(names, body, *ctes)


# Detection ----------------------------------------------------------------------------------------------------

PATHS = """paths AS (SELECT path, regexp_extract(path, '[^/]*$') AS name FROM files),
exts AS (SELECT *, CASE WHEN position('.' IN name[2:]) > 0 AND right(name, 1) <> '.' THEN lower('.' || split_part(name, '.', -1)) ELSE '' END AS ext FROM paths)"""
EXT_CASE = "CASE ext " + " ".join(f"WHEN '{e}' THEN '{l}'" for e, l in fc.EXTENSIONS.items()) + " END"


def prj_1(spark, sf):
    return corpus("code", "pages")(spark, sf).select("path", fc.file_ext("path").alias("ext"))


def prj_2(spark, sf):
    return detect.ext_language(code_files(spark, sf)).select("path", "ext", "ext_language")


def prj_3(spark, sf):
    files = code_files(spark, sf)
    return files.select("path", fc.looks_like_react("text").alias("react"),
                        fc.looks_like_react("text", compat=True).alias("react_compat"))


B = "blanked"
REACT_CODE = f"({has(B, fc.REACT_RUNTIME)} OR {has(B, fc.REACT_HOOK)} OR {has(B, fc.REACT_FRAGMENT)} OR {count(B, fc.REACT_TAG)} >= 2 OR ({count(B, fc.REACT_TAG)} >= 1 AND {has(B, fc.REACT_RETURN)}))"
REACT_SQL = f"""react AS (SELECT path, language, {has('text', fc.REACT_IMPORT)} OR {REACT_CODE} AS react, {has(B, fc.REACT_IMPORT)} OR {REACT_CODE} AS react_compat,
  {' OR '.join(f"contains(text, {q(w)})" for w in fc.MONGO_WORDS)} AS mongo FROM (SELECT *, {BLANKED} AS blanked FROM files))"""


def prj_4(spark, sf):
    return corpus("code", "documents")(spark, sf).select("path", fc.looks_like_mongo("text").alias("mongo"))


def prj_5(spark, sf):
    files = corpus("code", "pages")(spark, sf)
    both = detect.detect_language(files).select("path", "language", F.lit("default").alias("mode"))
    return both.unionByName(
        detect.detect_language(files, compat=True).select("path", "language", F.lit("compat").alias("mode")))


def prj_6(spark, sf):
    scores = scored_files(corpus("code", "pages")(spark, sf), rules_named())
    return detect.filter_results(scores, "html", 40, 80).select("path", "language", "score")


def prj_7(spark, sf):
    files = code_files(spark, sf)
    absolute = F.concat(F.lit("C:\\work\\"), F.replace("path", F.lit("/"), F.lit("\\")))
    return files.select(absolute.alias("path")).select("path", fc.relative_path("path", "C:\\work").alias("relative"))


# Scalar functions ---------------------------------------------------------------------------------------------

def sca_1(spark, sf):
    files = corpus(*ALL_TEXT)(spark, sf)
    return files.select("path", ft.text_metrics("text").alias("m")).select("path", "m.*")


def sca_2(spark, sf):
    return corpus(*ALL_TEXT)(spark, sf).select(
        "path", ft.content_hash("text").alias("sha256"), ft.size_bytes("text").alias("size_bytes"))


def sca_3(spark, sf):
    return corpus("code", "pages")(spark, sf).select(
        "path", fc.strip_code("text").alias("stripped"), ft.content_hash(fc.blank_code("text")).alias("blanked"))


def sca_4(spark, sf):
    raw = table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") / 8 - 75).alias("raw"))
    return raw.select("p_partkey", ft.clamp_score("raw").alias("score"))


def sca_5(spark, sf):
    scores = scored_files(corpus("pages", "documents:python")(spark, sf), rules_named())
    return scores.select("path", "score", ft.score_band("score").alias("report_band"),
                         ft.score_band("score", ft.PAGE_BANDS).alias("page_band"))


def sca_6(spark, sf):
    found = rule_scan(corpus("code", "pages")(spark, sf), rules_named())
    return found.groupBy("severity").agg(F.count("*").alias("n")).select(
        "severity", ft.severity_label("severity").alias("label"), ft.severity_level("severity").alias("level"), "n")


def sca_7(spark, sf):
    long_lines = ft.lines_over("text", 120)
    rows = corpus("code", "documents")(spark, sf).select("path", long_lines.alias("n")).where("n > 0")
    return rows.select("path", "n", ft.scaled_impact("n", 3, 2, 6).alias("impact"),
                       ft.scaled_severity("n", "low", 8, "medium").alias("severity"))


def sca_8(spark, sf):
    return document_files(spark, sf).select(
        "path", ft.count_substr("text", "en").alias("en"), ft.count_substr("text", ". ").alias("stops"),
        ft.count_substr("text", "aa").alias("aa"))


def sca_9(spark, sf):
    links = ft.extract_all("text", r"(?i)<a\b[^>]*>")
    message = ft.render_message("{path} holds {n} links", path="path", n="n")
    rows = page_files(spark, sf).select("path", F.size(links).alias("n"), F.get(links, 0).alias("first"))
    line = F.when(F.col("n") > 0, F.col("n"))
    confidence = F.when(F.col("n") > 5, F.lit(0.9))
    return rows.select("path", ft.with_details(message, line, "first", confidence).alias("message"))


def sca_10(spark, sf):
    found = ft.line_of("text", ft.first_position("text", r"(?i)<h1\b"))
    rows = page_files(spark, sf).select("path", "text", found.alias("line"))
    return rows.select("path", "line", ft.snippet_of("text", "line").alias("snippet"))


def _declarations(spark, sf):
    files = corpus("code", "pages")(spark, sf).where("language in ('css', 'html')")
    return u.css_declarations(u.css_source(files))


def sca_11(spark, sf):
    length = fcss.css_length("value")
    return _declarations(spark, sf).select(
        "path", "rule_no", "decl_no", "value", length["number"].alias("number"), length["unit"].alias("unit"))


def sca_12(spark, sf):
    rows = _declarations(spark, sf).select("path", "rule_no", "decl_no", "value", fcss.css_rgb("value").alias("c"))
    return rows.where("c is not null").select(
        "path", "rule_no", "decl_no", "value", "c.r", "c.g", "c.b", F.bround("c.a", 6).alias("a"))


def sca_13(spark, sf):
    rules = u.css_rules(u.css_source(corpus("code", "pages")(spark, sf).where("language in ('css', 'html')")))
    rows = rules.withColumn("ratio", cs.rule_contrast("d"))
    return rows.where("ratio is not null").select("path", "rule_no", F.bround("ratio", 6).alias("ratio"))


def sca_14(spark, sf):
    rows = u.selectors(u.css_rules(u.css_source(corpus("code", "pages")(spark, sf).where("language in ('css', 'html')"))))
    return rows.select("path", "rule_no", "selector", "ids", "classes", "elements", "combinators", "depth")


def sca_15(spark, sf):
    files = corpus("code", "pages")(spark, sf).where("language in ('html', 'react')")
    return u.class_tokens(files).select(
        "path", "element_no", "token_no", "token", "important", F.array_join("variants", "|").alias("variants"),
        "base", "utility_group")


def sca_16(spark, sf):
    """Version specs made of part sizes and prices."""
    spec = F.concat(
        F.element_at(F.array(*[F.lit(m) for m in SPEC_MARKS]), F.col("p_size").cast("int") % len(SPEC_MARKS) + 1),
        (F.col("p_retailprice").cast("int") % 3).cast("string"), F.lit("."), F.col("p_size").cast("string"))
    rows = table(spark, sf, "part").select("p_partkey", spec.alias("spec"))
    return rows.select("p_partkey", "spec", F.array_join(fc.version_risk("spec"), ",").alias("risks"))


SPEC_MARKS = ("", "^", "~", ">=", "file:", "github:", "https://x/", "<")
SPECS = f"""specs AS (SELECT p_partkey, {'[' + ', '.join(q(m) for m in SPEC_MARKS) + ']'}[CAST(p_size AS INT) % {len(SPEC_MARKS)} + 1]
  || (CAST(trunc(p_retailprice) AS INT) % 3) || '.' || p_size AS spec FROM part)"""


def _src_sql():
    return f"""SELECT job_id, language, rule_id, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n * score_impact) AS BIGINT) AS total FROM findings GROUP BY ALL
UNION ALL SELECT '{JOB}', 'html', 'score', count(*), CAST(sum(score) AS BIGINT) FROM scores"""


QUERIES = {
    "src_1_read_corpus": (src_1, lambda: """SELECT source, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, count(*) AS lines
        FROM documents WHERE text IS NOT NULL GROUP BY source"""),
    "src_2_decode_text": (src_2, lambda: "SELECT doc_id, CAST(length(text) AS INT) AS chars, sha256(text) AS sha256 FROM documents"),
    "src_3_corpus_from_table": (src_3, sql(ALL_TEXT, "SELECT job_id, path, language, CAST(length(text) AS INT) AS chars FROM files")),
    "src_4_read_archives": (src_4, lambda: "SELECT doc_id || '.zip' AS archive, 'docs/' || doc_id || '.txt' AS path, sha256(text) AS sha256 FROM documents"),
    "src_5_safe_paths": (src_5, sql(("pages",), "SELECT path FROM files WHERE path NOT LIKE 'm.%' AND path NOT LIKE '%/de/%'")),
    "src_6_write_results": (src_6, on_findings(_src_sql(), SCORES)),
    "src_7_to_details_json": (src_7, on_findings(
        """SELECT s.path, 'html_analyzer' AS analyzer_name, s.score, f.first_message, m.lines FROM scores s JOIN metrics m USING (path)
        LEFT JOIN (SELECT path, arg_min(message, rule || severity || lpad(CAST(score_impact AS VARCHAR), 3, '0') || message) AS first_message
          FROM findings GROUP BY path) f USING (path)""", SCORES, METRICS)),
    "src_7b_detailed_files": (src_7b, on_findings(
        """SELECT s.path, s.score, f.first_message, CAST(s.findings AS INT) AS findings,
          coalesce(c.severities, '') AS severities, coalesce(k.categories, '') AS categories FROM scores s
        LEFT JOIN (SELECT path, string_agg(severity || ':' || n, ',' ORDER BY severity || ':' || n) AS severities
          FROM (SELECT path, severity, CAST(sum(n) AS BIGINT) AS n FROM findings GROUP BY ALL) GROUP BY path) c USING (path)
        LEFT JOIN (SELECT path, string_agg(rule || ':' || n, ',' ORDER BY rule || ':' || n) AS categories
          FROM (SELECT path, rule, CAST(sum(n) AS BIGINT) AS n FROM findings GROUP BY ALL) GROUP BY path) k USING (path)
        LEFT JOIN (SELECT path, arg_min(message, rule || severity || lpad(CAST(score_impact AS VARCHAR), 3, '0') || message) AS first_message
          FROM findings GROUP BY path) f USING (path)""", SCORES)),
    "src_8_from_details_json": (src_8, on_findings(
        "SELECT f.path, f.language, s.score, rule, severity, score_impact, message FROM findings f JOIN scores s USING (path)", SCORES)),
    "src_9b_register_run_in_memory": (src_9b, lambda: RUNS_SQL),
    "src_9_register_run": (src_9, lambda: RUNS_SQL),
    "src_10_export_report": (src_10, on_findings(
        "SELECT path, language, score, format FROM scores, (VALUES ('csv'), ('json')) v(format)", SCORES)),
    "prj_1_file_ext": (prj_1, sql(("code", "pages"), "SELECT path, ext FROM exts", PATHS)),
    "prj_2_ext_language": (prj_2, sql(("code",), f"SELECT path, ext, {EXT_CASE} AS ext_language FROM exts", PATHS)),
    "prj_3_looks_like_react": (prj_3, sql(("code",), "SELECT path, react, react_compat FROM react", REACT_SQL)),
    "prj_4_looks_like_mongo": (prj_4, sql(("code", "documents"), "SELECT path, mongo FROM react", REACT_SQL)),
    # The snippets carry the language that detection has to find; the JSON marks decide alone in compat mode.
    "prj_5_detect_language": (prj_5, sql(("code", "pages"), """SELECT path, language, 'default' AS mode FROM files WHERE language <> 'none'
        UNION ALL SELECT path, CASE WHEN ext = '.json' THEN 'mongodb' WHEN ext = '.js' THEN CASE WHEN react_compat THEN 'react' ELSE 'javascript' END ELSE language END, 'compat'
        FROM react JOIN exts USING (path) WHERE language <> 'none' AND ext <> '.tsx' AND (ext <> '.json' OR mongo)""", PATHS, REACT_SQL)),
    "prj_6_filter_results": (prj_6, on_findings(
        "SELECT path, language, score FROM scores WHERE language = 'html' AND score BETWEEN 40 AND 80", SCORES, names=(), corpora=("code", "pages"))),
    "prj_7_relative_path": (prj_7, sql(("code",), "SELECT 'C:\\work\\' || replace(path, '/', '\\') AS path, path AS relative FROM files")),
    "sca_1_text_metrics": (sca_1, sql(ALL_TEXT, "SELECT path, lines, non_empty_lines, avg_line_length, todo_count FROM metrics", METRICS)),
    "sca_2_content_hash": (sca_2, sql(ALL_TEXT, "SELECT path, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size_bytes FROM files")),
    "sca_3_strip_code": (sca_3, sql(("code", "pages"), f"SELECT path, {STRIPPED} AS stripped, sha256({BLANKED}) AS blanked FROM files")),
    "sca_4_clamp_score": (sca_4, lambda: "SELECT p_partkey, CAST(greatest(0, least(100, round_even(p_retailprice / 8 - 75, 0))) AS INT) AS score FROM part"),
    "sca_5_score_band": (sca_5, on_findings(
        """SELECT path, score, CASE WHEN score >= 85 THEN 'Good' WHEN score >= 70 THEN 'Fair' WHEN score >= 50 THEN 'Weak' ELSE 'Poor' END AS report_band,
        CASE WHEN score >= 80 THEN 'good' WHEN score >= 50 THEN 'warn' ELSE 'bad' END AS page_band FROM scores""", SCORES,
        names=(), corpora=("pages", "documents:python"))),
    "sca_6_severity_label": (sca_6, on_findings(
        """SELECT severity, upper(severity[1]) || severity[2:] AS label, CASE severity WHEN 'error' THEN 'high' WHEN 'warning' THEN 'medium' ELSE severity END AS level,
        CAST(sum(n) AS BIGINT) AS n FROM findings GROUP BY severity""", names=(), corpora=("code", "pages"))),
    "sca_7_scaled_impact": (sca_7, sql(("code", "documents"), """SELECT path, n, CAST(3 + least(n // 2, 6) AS INT) AS impact, CASE WHEN n >= 8 THEN 'medium' ELSE 'low' END AS severity
        FROM (SELECT path, CAST(len(list_filter(string_split(text, chr(10)), lambda l: length(l) > 120)) AS INT) AS n FROM files) WHERE n > 0""")),
    "sca_8_count_substr": (sca_8, sql(("documents",), f"""SELECT path, CAST({count('text', 'en')} AS INT) AS en, CAST({count('text', '[.] ')} AS INT) AS stops,
        CAST({count('text', 'aa')} AS INT) AS aa FROM files""")),
    "sca_9_render_message": (sca_9, sql(("pages",), """SELECT path, path || ' holds ' || n || ' links' || CASE WHEN n = 0 THEN '' ELSE
        ' (line ' || n || '; snippet: ' || l[1] || CASE WHEN n > 5 THEN '; confidence 0.90' ELSE '' END || ')' END AS message
        FROM (SELECT path, l, len(l) AS n FROM (SELECT path, regexp_extract_all(text, '(?i)<a\\b[^>]*>') AS l FROM files))""")),
    "sca_10_line_of": (sca_10, sql(("pages",), """SELECT path, line, trim(string_split(text, chr(10))[line]) AS snippet FROM (
        SELECT path, text, CASE WHEN head = text THEN NULL ELSE CAST(length(head) - length(replace(head, chr(10), '')) + 1 AS INT) END AS line
        FROM (SELECT path, text, regexp_replace(text, '(?is)<h1\\b.*$', '') AS head FROM files))""")),
    "sca_11_css_length": (sca_11, sql(("code", "pages"), f"""SELECT path, rule_no, decl_no, value,
        CAST(nullif({part('value', fcss.LENGTH, 1)}, '') AS DOUBLE) AS number, lower(nullif({part('value', fcss.LENGTH, 2)}, '')) AS unit FROM decls""",
        SHEETS, CSS_RULES, DECLS)),
    "sca_12_css_rgb": (sca_12, sql(("code", "pages"), """SELECT path, rule_no, decl_no, value, CAST(r AS INT) AS r, CAST(g AS INT) AS g, CAST(b AS INT) AS b, round_even(a, 6) AS a
        FROM decls JOIN colors ON v = value""", SHEETS, CSS_RULES, DECLS, COLORS)),
    "sca_13_contrast_ratio": (sca_13, sql(("code", "pages"), "SELECT path, rule_no, round_even(ratio, 6) AS ratio FROM contrasts",
                                          SHEETS, CSS_RULES, DECLS, COLORS)),
    "sca_14_selector_specificity": (sca_14, sql(
        ("code", "pages"), "SELECT path, rule_no, selector, ids, classes, elements, combinators, depth FROM weights",
        SHEETS, CSS_RULES, SELECTORS)),
    "sca_15_utility_parts": (sca_15, sql(("code", "pages"), """SELECT path, element_no, token_no, token, important,
        array_to_string(variants, '|') AS variants, base, utility_group FROM class_tokens""", CLASSES)),
    "sca_16_version_risk": (sca_16, lambda: f"""WITH {SPECS} SELECT p_partkey, spec, CASE WHEN {has('spec', '^(?:file:|github:|https://)')} THEN 'non_registry'
        ELSE array_to_string(list_filter([CASE WHEN {has('spec', '^[~^]?0[.]')} THEN 'zero_major' END, CASE WHEN {has('spec', '[<>]')} THEN 'range' END],
          lambda r: r IS NOT NULL), ',') END AS risks FROM specs"""),
}
