"""Line deduplication with levelled sorted runs of line hashes.

A run holds one row per line key: its hash, the documents that hold it in the batch that brought it and the largest id among
them, bucketed and sorted by hash. Documents come in batches of descending ids. A batch's keys are merge-anti-joined with the
runs: keys that no run has are added as a run of level 0, so a key is in one run only, and its keeper is the largest id of
all; for the others the batch adds to their count. When a level holds two runs they are merged into one run of the next
level, bucket by bucket, so a key is rewritten once per level and not once per batch.

Only hashes, ids and places are shuffled, once per batch. Runs lie in the folder in spark.checkpoint.dir and go at the end.
"""

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpusgauge.functions.events import runs as runs_in
from corpusgauge.functions.text import let
from corpusgauge.session import shared_folder
from .common import written

#: Fixed value: what is stripped from both ends of a line.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The id that a null counts as: smaller than any other.
NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    line = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def text_lines(text: Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def long_keys(lines: Column, least: int) -> Column:
    """Struct (a, b, at) of the distinct keys of enough code points: 128 bits of hash and the places of their lines.

    Hashes are sorted, so that work grows with the lines and not with their square.
    """
    keyed = F.transform(F.filter(
        F.transform(lines, lambda l, i: F.struct(l.alias("l"), i.alias("i"))), lambda x: F.length(x["l"]) >= least),
        lambda x: F.struct(line_key(x["l"]).alias("k"), x["i"].alias("i")))
    hashed = F.transform(F.filter(keyed, lambda x: F.length(x["k"]) >= least), lambda x: F.struct(
        F.xxhash64(x["k"]).alias("a"), F.xxhash64(F.lit("line"), x["k"]).alias("b"), x["i"].alias("i")))
    return let(F.array_sort(hashed), lambda v: F.transform(
        runs_in(v, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))), lambda r: F.struct(
            F.get(v, r["at"])["a"].alias("a"), F.get(v, r["at"])["b"].alias("b"),
            F.transform(F.slice(v, r["at"] + 1, r["n"]), lambda x: x["i"]).alias("at"))))


class Runs:
    """Sorted runs (a, b, n_docs, keeper) in levels, no key in two of them; hits (a, b, n_docs) count keys seen again."""

    def __init__(self, spark):
        self.spark, self.levels, self.hits = spark, [], []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder, self.tables = shared_folder(spark), []

    def __enter__(self):
        return self

    def __exit__(self, *_):
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def bucketed(self, rows: DataFrame) -> DataFrame:
        """The rows as a table with a file per bucket, sorted: joins of such tables need no exchange."""
        name = f"line_run_{os.urandom(8).hex()}"
        rows.write.bucketBy(self.buckets, "a", "b").sortBy("a", "b").option("path", f"{self.folder}/{name}").saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, rows: DataFrame) -> None:
        """A batch's rows (a, b, doc_id), one per document and key; all ids are at most those of earlier batches."""
        keys = self.bucketed(rows.groupBy("a", "b").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")))
        older = self.all()
        if older:
            self.hits += [keys.join(run, ["a", "b"], "left_semi").drop("keeper") for run in older]
            keys = self.bucketed(reduce(lambda fresh, run: fresh.join(run, ["a", "b"], "left_anti"), older, keys))
        self._put(0, keys)

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == 2:
            one, two = self.levels[level]
            self.levels[level] = []
            self._put(level + 1, self.bucketed(merged(one, two)))

    def common(self, least_docs: int) -> DataFrame:
        """(a, b, keeper) of the keys that enough documents hold."""
        again = [written(h, "hits") for h in self.hits]
        parts = self.all()
        if again:
            more = reduce(DataFrame.unionByName, again).groupBy("a", "b").agg(F.sum("n_docs").alias("more"))
            more = self.bucketed(more)
            parts = [run.join(more, ["a", "b"], "left").withColumn("n_docs", F.col("n_docs") + F.coalesce("more", F.lit(0))) for run in parts]
        return reduce(DataFrame.unionByName, [p.filter(F.col("n_docs") >= least_docs).select("a", "b", "keeper") for p in parts])


def merged(one: DataFrame, two: DataFrame) -> DataFrame:
    """Two runs as one, by merging their buckets; their keys differ."""
    names = ("n_docs", "keeper")
    other = two.select("a", "b", *[F.col(n).alias(f"other_{n}") for n in names])
    return one.join(other, ["a", "b"], "full").select("a", "b", *[F.coalesce(n, f"other_{n}").alias(n) for n in names])


def repeated_in(docs: DataFrame, text: str = "text", key: str = "doc_id", least_chars: int = 20, least_docs: int = 3,
                batches: int = 6) -> DataFrame:
    """doc_id, text_key (hash of the text) and gone, the sorted places of the lines that the document loses; only documents
    that lose lines.

    A null doc_id is smaller than any other. Each row counts as a document; of rows with equal doc_id none loses a line
    to another.
    """
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(docs[key].cast("long"), F.lit(NO_ID)).alias("doc_id"), text_hash(docs[text]).alias("text_key"), docs[text].alias("text"))
    shares = [i / batches for i in range(1, batches)]
    bounds = sorted(set(map(int, ids.agg(F.percentile_approx("doc_id", shares, 1_000).alias("q")).first()["q"] or [])), reverse=True)
    batch = sum(((F.col("doc_id") <= b).cast("int") for b in bounds), F.lit(0))
    found = ids.select("doc_id", "text_key", batch.alias("batch"), F.inline(long_keys(text_lines(F.col("text")), least_chars)))
    found = written(found, "lines")
    with Runs(spark) as runs:
        for i in range(len(bounds) + 1):
            runs.add(found.filter(F.col("batch") == i).select("a", "b", "doc_id"))
        common = written(runs.common(least_docs), "common")
    lost = found.join(common, ["a", "b"]).filter(F.col("doc_id") < F.col("keeper"))
    return lost.groupBy("doc_id", "text_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("gone"))


def without(lines: Column, gone: Column) -> Column:
    """The lines but for those at the sorted places: the stretches between them, put together."""
    def stretch(j):
        first = F.when(j == 0, 0).otherwise(F.get(gone, j - 1) + 1)
        return F.slice(lines, first + 1, F.coalesce(F.get(gone, j), F.size(lines)) - first)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), stretch))


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", least_chars: int = 20, **how) -> DataFrame:
    """The columns of docs and n_lines, n_dropped, kept (the text of the lines that stay, joined by newlines).

    Keys of at least `least_chars` code points in at least `least_docs` documents stay in the largest id only. A null or
    empty text is one empty line. A text that loses all lines is empty. Columns of these names in docs are replaced, and none
    may begin with "_line_dedup_".
    """
    mine = {n: f"_line_dedup_{n}" for n in ("doc_id", "text_key", "gone")}
    gone = written(repeated_in(docs, text, key, least_chars, **how), "gone").withColumnsRenamed(mine)
    same = (F.coalesce(docs[key].cast("long"), F.lit(NO_ID)) == gone[mine["doc_id"]]) & (text_hash(docs[text]) == gone[mine["text_key"]])
    rows = docs.join(gone.hint("shuffle_hash"), same, "left")
    lines, places = "_line_dedup_lines", F.coalesce(F.col(mine["gone"]), F.array().cast("array<int>"))
    rows = rows.withColumn(lines, text_lines(docs[text]))
    return rows.withColumns({
        "n_lines": F.size(lines).cast("long"), "n_dropped": F.size(places).cast("long"),
        "kept": F.array_join(F.when(F.size(places) == 0, F.col(lines)).otherwise(without(F.col(lines), places)), "\n"),
    }).drop(lines, *mine.values())
