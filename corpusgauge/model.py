"""Schemas of the tables that flow between operators."""

from pyspark.sql import types as T

S, I, L, D, TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _struct(**fields):
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


FILES = _struct(
    job_id=S, path=S, language=S, sha256=S, size_bytes=L, text=S, created_at=TS
)

FINDING = _struct(
    rule_id=S, rule=S, severity=S, score_impact=I, message=S, line=I, snippet=S, confidence=D, fix=S
)
FINDING_COLUMNS = ["job_id", "path", "language", *FINDING.fieldNames()]

CLAUSE = _struct(
    test=S, subject=S, pattern=S, present=S, missing=S, threshold=D, needles=T.ArrayType(S)
)

RULES = T.StructType([
    T.StructField("rule_id", S), T.StructField("language", S), T.StructField("category", S),
    T.StructField("severity", S), T.StructField("impact", I), T.StructField("message", S),
    T.StructField("all_of", T.ArrayType(CLAUSE)), T.StructField("any_of", T.ArrayType(CLAUSE)),
    T.StructField("emit", S), T.StructField("measure", S),
    T.StructField("div", I), T.StructField("cap", I),
    T.StructField("step", I), T.StructField("severity_above", S),
    T.StructField("locate", S), T.StructField("confidence", D), T.StructField("fix", S),
    T.StructField("enabled", T.BooleanType()),
])

METRICS = _struct(lines=L, non_empty_lines=L, avg_line_length=D, todo_count=L)

DETAILS = T.StructType([
    T.StructField("language", S), T.StructField("file_path", S), T.StructField("analyzer_name", S),
    T.StructField("score", I),
    T.StructField("findings", T.ArrayType(_struct(
        rule=S, severity=S, score_impact=I, message=S, line=I))),
    T.StructField("metrics", T.StructType([
        *METRICS.fields, T.StructField("finding_count", L), T.StructField("severity_counts", T.MapType(S, L)),
        T.StructField("category_counts", T.MapType(S, L))])),
])

RUNS = _struct(job_id=S, original_name=S, created_at=TS)
