"""Registered queries of this subpackage: name to (function of spark and folder, function that gives the SQL or None)."""

from pyspark.sql import functions as F

from . import bpe, lexical, licenses, lines, negatives, neighbours, packing, sampling, secrets, sharding, simhash, sql, toxicity, urls
from .common import table


def vocabulary() -> str:
    """The vocabulary file that the queries use; operators take its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    shards = [f"shard-{i:03d}" for i in range(256)]
    return sharding.place(docs, F.col("doc_id"), shards).select("doc_id", "source", "n_chars", "slot", "shard")


def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op4_fingerprints(spark, sf_dir):
    return sampling.chain(table(spark, sf_dir, "documents"))


def op5_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = lambda step: F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * step % 366).cast("int"))
    host, n = urls.host_of(F.col("url")), F.col("page_id")
    domain = F.array_join(F.slice(F.split(host, r"\."), -2, 2), ".")
    first = F.concat_ws("/", host, F.element_at(F.split(urls.path_of(F.col("url")), "/+"), 1))
    changes = pages.select(
        F.concat(F.lit("list"), (n % 4).cast("string")).alias("list"),
        F.when(n % 3 == 0, "host").when(n % 3 == 1, "path").otherwise("domain").alias("kind"),
        F.when(n % 3 == 0, host).when(n % 3 == 1, first).otherwise(domain).alias("value"),
        day(104_729).alias("day"), (n % 5 < 2).alias("blocked"))
    return urls.evaluate(pages.withColumn("fetched", day(7_919)), changes)


def op6_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.find(docs, repository=F.concat_ws("/", "source", "lang"), owner=F.col("source")))


def op7_packing(spark, sf_dir):
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), vocabulary()))


def op8_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.deduplicated(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op9_bpe(spark, sf_dir):
    return bpe.digest(table(spark, sf_dir, "documents"), vocabulary())


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op11_lexical(spark, sf_dir):
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.withColumn("label", moved)
    return negatives.mine(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op13_licenses(spark, sf_dir):
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_sharding": (op1_sharding, None),
    "op2_simhash": (op2_simhash, None),
    "op3_neighbours": (op3_neighbours, None),
    "op4_fingerprints": (op4_fingerprints, None),
    "op5_url_filters": (op5_url_filters, lambda: sql.URL_FILTERS),
    "op6_secrets": (op6_secrets, lambda: sql.SECRETS),
    "op7_packing": (op7_packing, None),
    "op8_line_dedup": (op8_line_dedup, lambda: sql.LINE_DEDUP),
    "op9_bpe": (op9_bpe, None),
    "op10_toxicity": (op10_toxicity, None),
    "op11_lexical": (op11_lexical, lambda: sql.LEXICAL),
    "op12_negatives": (op12_negatives, lambda: sql.NEGATIVES),
    "op13_licenses": (op13_licenses, lambda: sql.LICENSES),
}
