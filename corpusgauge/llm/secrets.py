"""Secret scan with corpus-wide ownership frequency.

Every text is searched for credentials: assignments to password-like names, access keys, runs of hex digits and, added by
this method, long tokens that mix small letters, capitals and digits. The hash of each candidate's value is counted over
the corpus by distinct repository and owner. A value that several owners hold, or one that stands in many repositories, is an
example copied around; a value of few owners and repositories looks like a live credential of theirs. Mixed tokens count as
secrets only if they look live.

The text is read once; what is found is written (ids, spans and hashes, no text) and all counting works on that. Counts go
from (value, owner, repository) over (value, owner) to value, each combined before its shuffle.
"""

from pyspark.sql import Column, DataFrame, functions as F

from corpusgauge.functions.events import runs
from corpusgauge.functions.text import let
from .common import written

# Kind, pattern, group of the value, its least length.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Added kind: tokens with a small letter, a capital and a digit.
OWNED = ("owned", r"[A-Za-z0-9+_=-]{24,}", 0, 24)
ORDER = [k[0] for k in (*KINDS, OWNED)]
BLOCK = 256
SPAN = "struct<start:int,rank:int,end:int,a:bigint,b:bigint>"


def running(lengths: Column) -> Column:
    """Sums up to each element of an array of int, block by block so that long arrays stay nearly linear."""
    add = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    sums = lambda xs: F.aggregate(xs, F.array(F.lit(0)), add)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(lengths) - 1, F.lit(0)).cast("int"), F.lit(BLOCK)),
                         lambda i: F.slice(lengths, i + 1, BLOCK))
    starts = sums(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x)))
    shifted = F.zip_with(blocks, starts, lambda b, s: F.when(b.isNotNull(), F.slice(F.transform(sums(b), lambda x: x + s), 2, BLOCK)))
    return F.flatten(F.filter(shifted, lambda b: b.isNotNull()))


def spans_of(docs: DataFrame, text: Column, kind: tuple, name: str) -> DataFrame:
    """docs with a column: array of (start, rank, end, a, b) of the kind's matches; a and b are hashes of the value.

    Offsets count code points. They come from the lengths of the matches and of the texts between them.
    """
    label, pattern, group, least = kind
    rank = ORDER.index(label)
    docs = docs.withColumn("_hits", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    some = F.size("_hits") > 0
    docs = docs.withColumn("_values", F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))) if group else F.col("_hits"))
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    docs = docs.withColumn("_lengths", F.when(some, F.flatten(F.zip_with(
        between, F.transform("_hits", lambda x: F.length(x)), lambda g, m: F.array(g, F.coalesce(m, F.lit(0)))))))
    docs = docs.withColumn("_ends", F.when(some, running(F.col("_lengths"))))
    span = lambda value, i: F.struct(
        F.element_at("_ends", 2 * i + 1).alias("start"), F.lit(rank).alias("rank"), F.element_at("_ends", 2 * i + 2).alias("end"),
        F.xxhash64(value).alias("a"), F.xxhash64(F.lit("secret"), value).alias("b"), value.alias("value"))
    fits = lambda s: F.length(s["value"]) >= least
    if label == "owned":
        fits = lambda s: s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[0-9]")
    found = F.transform(F.filter(F.transform("_values", span), fits), lambda s: s.dropFields("value"))
    return docs.withColumn(name, F.coalesce(F.when(some, found), F.array()).cast(f"array<{SPAN}>")).drop("_hits", "_values", "_lengths", "_ends")


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """Per row: doc_id, text_key (hash of the text), repository, owner and the spans of each kind. Null texts are empty."""
    whole = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(
        docs[key].alias("doc_id"), F.xxhash64(whole).alias("text_key"), F.coalesce(repository if repository is not None else F.lit(""), F.lit("")).alias("repository"),
        F.coalesce(owner if owner is not None else F.lit(""), F.lit("")).alias("owner"), whole.alias("_text"))
    for kind in (*KINDS, OWNED):
        rows = spans_of(rows, F.col("_text"), kind, kind[0])
    return rows.drop("_text")


def ownership(found: DataFrame) -> DataFrame:
    """Per value (a, b): n_docs, n_repositories and n_owners that hold it. A repository belongs to one owner."""
    # Each value once per row, by sorting: comparing structs pair by pair would take the square of the spans.
    values = F.array_sort(F.transform("spans", lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"))))
    distinct = let(values, lambda v: F.transform(runs(v), lambda r: F.get(v, r["at"])))
    held = found.select("owner", "repository", F.explode(distinct).alias("v"))
    by_repository = held.groupBy("v.a", "v.b", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("a", "b", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("r"))
    return by_owner.groupBy("a", "b").agg(
        F.sum("n").alias("n_docs"), F.sum("r").alias("n_repositories"), F.count("*").alias("n_owners"))


def classify(found: DataFrame, owners: int = 3, repositories: int = 12) -> DataFrame:
    """found (doc_id, text_key, row, spans) with spans judged: array of (start, rank, end, n_owners, n_repositories, live)."""
    parts = found.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    judged = parts.join(ownership(found), ["a", "b"]).select(
        "row", F.struct("start", "rank", "end", "n_owners", "n_repositories", (
            (F.col("n_owners") < owners) & (F.col("n_repositories") < repositories)).alias("live")).alias("s"))
    judged = judged.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("judged"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,n_owners:bigint,n_repositories:bigint,live:boolean>>")
    return found.join(judged, "row", "left").withColumn("judged", F.coalesce("judged", none))


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", repository: Column | None = None, owner: Column | None = None,
         owners: int = 3, repositories: int = 12) -> DataFrame:
    """Per row of docs: doc_id, text_key, base and judged spans.

    base: array of (start, rank, end) of the fixed kinds. judged: those and the mixed tokens that look live, each with the
    owners and repositories of its value and whether it looks live: fewer than `owners` owners hold it, and it stands in fewer
    than `repositories` repositories. A mixed token inside a base span isn't told again. Null texts are empty and hold nothing; a null owner or repository is one of its own; repeated
    rows give repeated rows. Other columns are left out.
    """
    rows = scan(docs, text, key, repository, owner)
    base = F.array_sort(F.concat(*[F.col(k[0]) for k in KINDS]))
    inside = lambda o: F.exists("base", lambda s: (s["start"] <= o["start"]) & (o["end"] <= s["end"]))
    rows = rows.withColumn("base", base).withColumn("spans", F.concat("base", F.filter("owned", lambda o: ~inside(o))))
    rows = rows.drop(*ORDER).withColumn("row", F.monotonically_increasing_id())
    judged = classify(written(rows, "secrets"), owners, repositories)
    told = F.filter("judged", lambda s: (s["rank"] < len(KINDS)) | s["live"])
    return judged.select("doc_id", "text_key", F.transform("base", lambda s: F.struct(s["start"], s["rank"], s["end"])).alias("base"), told.alias("judged"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts, hash and list of the spans that find() gives."""
    count = lambda r: F.size(F.filter("base", lambda s: s["rank"] == r)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k[0]}") for i, k in enumerate(KINDS)], F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("judged")).alias("spans"), F.size(F.filter("judged", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("judged", lambda s: ~s["live"])).cast("long").alias("n_example"))


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id", mark: str = "<secret>", **how) -> DataFrame:
    """docs with live-looking secrets replaced by the mark; examples that several owners hold stay."""
    found = find(docs, text, key, **how).select("doc_id", "text_key", F.filter("judged", lambda s: s["live"]).alias("_live"))
    found = found.filter(F.size("_live") > 0).groupBy("doc_id", "text_key").agg(F.first("_live").alias("_live")).withColumnsRenamed(
        {"doc_id": "_id", "text_key": "_key"})
    rows = docs.join(found.hint("shuffle_hash"), docs[key].eqNullSafe(found["_id"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == found["_key"]), "left")
    whole = docs[text]

    def step(acc, s):
        more = F.when(s["start"] >= acc["at"], F.concat(F.substring(whole, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], more).alias("out"))

    clean = F.aggregate("_live", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                        lambda acc: F.concat(acc["out"], F.substring(whole, acc["at"] + 1, F.length(whole))))
    return rows.withColumn(text, F.when(F.col("_live").isNull(), whole).otherwise(clean)).drop("_live", "_id", "_key")
