"""Input corpora of the registered queries, in Spark and as DuckDB CTEs."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusgauge.sources.corpus import corpus_from_table
from .snippets import SNIPPETS

JOB = "job-1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. A session that sets spark.corpusgauge.tasks wants its rows dealt over so many tasks."""
    rows, tasks = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.conf.get("spark.corpusgauge.tasks", None)
    return rows.repartition(int(tasks)) if tasks else rows


def page_files(spark, sf_dir) -> DataFrame:
    """Pages as html files; the path is the address without its scheme."""
    pages = table(spark, sf_dir, "pages")
    return corpus_from_table(
        pages, path=F.concat(F.regexp_replace("url", "^https?://", ""), F.lit("~"), F.col("page_id"), F.lit(".html")),
        text="html", language="html", job_id=JOB)


def document_files(spark, sf_dir, language="text") -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return corpus_from_table(
        docs, path=F.concat("source", F.lit("/doc_"), F.col("doc_id"), F.lit(".txt")), text="text",
        language=language, job_id=JOB)


def conversation_files(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return corpus_from_table(
        turns, path=F.concat(F.lit("conv_"), F.col("conv_id"), F.lit("/"), F.col("turn"), F.lit(".txt")), text="text",
        language="text", job_id=JOB)


ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def code_files(spark, sf_dir) -> DataFrame:
    """One source file per part: the snippet of the part's size with a document's whole text, as a comment behind it or,
    in JSON, as a string in front of the object's other values."""
    snippets = spark.createDataFrame(SNIPPETS, "snippet_id int, file_name string, language string, snippet string")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("p_partkey"), F.col("text").alias("body"))
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", F.col("p_size").cast("int").alias("snippet_id"))
    code = F.replace("snippet", F.lit("@PART@"), F.col("p_name"))
    as_lines = lambda mark: F.concat(F.lit("\n" + mark), F.replace("body", F.lit("\n"), F.lit("\n" + mark)))
    comment = (
        F.when(F.col("language") == "python", as_lines("# "))
        .when(F.col("language").isin("javascript", "react", "mongodb"), as_lines("// "))
        .when(F.col("language") == "css", F.concat(F.lit("\n/* "), "body", F.lit(" */")))
        .when(F.col("language") == "html", F.concat(F.lit("\n<!-- "), "body", F.lit(" -->")))
    )
    string = F.col("body")
    for raw, escaped in ESCAPES:
        string = F.replace(string, F.lit(raw), F.lit(escaped))
    as_value = F.concat(F.lit('{"about": "'), string, F.lit('", '), F.substr(code, F.lit(2)))
    is_object = (F.col("language") == "manifest") & code.startswith("{") & F.col("body").isNotNull()
    return (
        parts.join(F.broadcast(snippets), "snippet_id")  # 50 constant rows
        .join(docs, "p_partkey", "left")
        .select(
            F.lit(JOB).alias("job_id"),
            F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string"), "file_name").alias("path"),
            "language",
            F.when(is_object, as_value).otherwise(F.concat(code, F.coalesce(comment, F.lit("")))).alias("text"),
        )
    )


CORPORA = {"pages": page_files, "conversations": conversation_files, "code": code_files}


def corpus(*names):
    """A function of (spark, sf_dir) that unions the named corpora; `documents:x` gives documents language x."""
    def build(spark, sf_dir):
        frames = []
        for name in names:
            if name.startswith("documents"):
                frames.append(document_files(spark, sf_dir, name.partition(":")[2] or "text"))
            else:
                frames.append(CORPORA[name](spark, sf_dir))
        return reduce(lambda a, b: a.unionByName(b), frames)

    return build


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CODE_VALUES = ",\n".join(f"({i}, {quote(n)}, {quote(l)}, {quote(t)})" for i, n, l, t in SNIPPETS)

AS_STRING = reduce(lambda s, e: f"replace({s}, {quote(e[0])}, {quote(e[1])})", ESCAPES, "d.text")

SQL = {
    "pages": f"""SELECT '{JOB}' AS job_id, regexp_replace(url, '^https?://', '') || '~' || page_id || '.html' AS path,
  'html' AS language, html AS text FROM pages""",
    "conversations": f"""SELECT '{JOB}' AS job_id, 'conv_' || conv_id || '/' || turn || '.txt' AS path,
  'text' AS language, text FROM conversations""",
    "code": f"""SELECT '{JOB}' AS job_id, p_brand || '/' || p_partkey || '/' || file_name AS path, s.language,
  CASE WHEN s.language = 'manifest' AND starts_with(snippet, '{{') AND d.text IS NOT NULL
    THEN '{{"about": "' || {AS_STRING} || '", ' || replace(snippet, '@PART@', p_name)[2:]
    ELSE replace(snippet, '@PART@', p_name) || coalesce(CASE
    WHEN s.language = 'python' THEN chr(10) || '# ' || replace(d.text, chr(10), chr(10) || '# ')
    WHEN s.language IN ('javascript', 'react', 'mongodb') THEN chr(10) || '// ' || replace(d.text, chr(10), chr(10) || '// ')
    WHEN s.language = 'css' THEN chr(10) || '/* ' || d.text || ' */'
    WHEN s.language = 'html' THEN chr(10) || '<!-- ' || d.text || ' -->' END, '') END AS text
  FROM part JOIN snippets s ON p_size = snippet_id LEFT JOIN documents d ON doc_id = p_partkey""",
}


def corpus_sql(*names) -> str:
    """CTEs that end in `files`."""
    parts = []
    for name in names:
        if name.startswith("documents"):
            language = name.partition(":")[2] or "text"
            parts.append(f"SELECT '{JOB}' AS job_id, source || '/doc_' || doc_id || '.txt' AS path, "
                         f"'{language}' AS language, text FROM documents")
        else:
            parts.append(SQL[name])
    head = f"snippets(snippet_id, file_name, language, snippet) AS (VALUES {CODE_VALUES}),\n" if "code" in names else ""
    return head + "files AS MATERIALIZED (" + "\nUNION ALL ".join(parts) + ")"
