"""Document fingerprints by consistent weighted sampling.

A text's terms are its shingles, weighted by how often they occur. For each of SAMPLES draws every term gets two gamma(2, 1)
variates and a uniform one from its hash; with them a weight is rounded to a level that all weights near it share, and the
term with the least level-dependent key is drawn. Two texts draw the same term at the same level with a probability equal to
their generalised Jaccard similarity: the sum of smaller weights over the sum of larger ones.

`chain` compares each document with an edited text made of it and its successor by id. Rows are dealt to buckets of neighbouring
ids and sorted, so a task sees each document beside its successor; only the first document of each bucket is sent twice.
"""

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

SAMPLES = 64
WORDS = 5
#: Terms whose variates are drawn at once.
BLOCK = 1 << 10
#: The digits of a draw in a fingerprint: 16 bits.
DIGITS = 4


@functools.lru_cache(maxsize=1)
def gamma_table() -> np.ndarray:
    """65,536 equally likely values of a gamma(2, 1) variate: its distribution, 1 - (1 + x) exp(-x), inverted by bisection."""
    share = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros(1 << 16), np.full(1 << 16, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        under = 1 - (1 + mid) * np.exp(-mid) < share
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


@functools.lru_cache(maxsize=1)
def draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An odd multiplier per draw, the gamma values and their logarithms."""
    odd = np.array([xxhash.xxh64_intdigest(f"draw {k}") | 1 for k in range(SAMPLES)], np.uint64)
    return odd, gamma_table().astype(np.float32), np.log(gamma_table()).astype(np.float32)


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, count) of the distinct shingles; a text of fewer words is one shingle, one without words has none."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    n = min(WORDS, len(words))
    hashed = [xxhash.xxh64_intdigest(b" ".join(s), 7) for s in zip(*(words[i:] for i in range(n)))]
    return np.unique(np.array(hashed, np.uint64), return_counts=True)


def signature(text: str) -> np.ndarray:
    """One 16-bit value per draw; zeros for a text without words."""
    hashes, weights = terms(text)
    out = np.zeros(SAMPLES, np.uint16)
    if not len(hashes):
        return out
    odd, gamma, log_gamma = draws()
    best = np.full(SAMPLES, np.inf, np.float32)
    each = np.arange(SAMPLES)
    for start in range(0, len(hashes), BLOCK):
        h, s = hashes[start : start + BLOCK, None], weights[start : start + BLOCK]
        x = h * odd
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x9E3779B97F4A7C15)
        r = gamma[(x >> np.uint64(48)).astype(np.intp)]
        key = log_gamma[(x >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.intp)]
        rest = (x & np.uint64(0xFFFFFFFF)).astype(np.float32)
        rest *= np.float32(2.0**-32)
        # For weight 1 the level is floor(beta) = 0; ln of the key is ln c - r (level + 1 - beta).
        many = np.flatnonzero(s > 1)
        level = np.zeros((len(s), 1), np.float32) if not len(many) else np.zeros((len(s), SAMPLES), np.float32)
        if len(many):
            level[many] = np.floor(np.log(s[many, None]).astype(np.float32) / r[many] + rest[many])
        np.subtract(level + np.float32(1), rest, out=rest)
        rest *= r
        key -= rest
        at = key.argmin(axis=0)
        least = key[at, each]
        better = least < best
        best = np.where(better, least, best)
        picked = level[at, 0] if level.shape[1] == 1 else level[at, each]
        mixed = (h[at, 0] + picked.astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
        out = np.where(better, (mixed >> np.uint64(48)).astype(np.uint16), out)
    return out


def written_out(values: np.ndarray) -> str:
    return values.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal draws, an estimate of the generalised Jaccard similarity."""
    return float((a == b).mean())


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and fingerprint (hex digits, DIGITS per draw) per row. Null texts are empty."""
    def run(batches):
        for batch in batches:
            out = [written_out(signature(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["key", "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, fingerprint string").withColumnRenamed("key", key)


def likeness_of(a, b):
    """The likeness of two fingerprint columns."""
    at = F.sequence(F.lit(0), F.lit(SAMPLES - 1))
    part = lambda c, i: F.substring(c, i * DIGITS + 1, F.lit(DIGITS))
    return F.size(F.filter(at, lambda i: part(a, i) == part(b, i))) / F.lit(float(SAMPLES))


def chain(docs: DataFrame, text: str = "text", key: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the document with its last floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next document, by descending id; the first follows the last. Rows of equal id follow by text, rows without id come
    last. Null texts are empty. A single document is its own successor. Other columns are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(docs[key].cast("long"), F.lit(-(1 << 63))).alias("k"), F.coalesce(docs[text], F.lit("")).alias("text"))
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # At most `buckets` numbers reach the driver: the bounds, and the first id of each bucket.
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = np.array(sorted(set(rows.agg(F.percentile_approx("k", cuts, 10 * buckets)).first()[0] or [])), np.int64)
    ids = rows.select("k")

    def firsts(batches):
        top = {}
        for batch in batches:
            k = batch.column(0).to_numpy()
            b = np.searchsorted(bounds, k)
            for i in np.unique(b).tolist():
                top[i] = max(top.get(i, -(1 << 63)), int(k[b == i].max()))
        yield pa.RecordBatch.from_arrays([pa.array(top.keys(), pa.int32()), pa.array(top.values(), pa.int64())], ["bucket", "first"])

    heads = {r["bucket"]: r["first"] for r in ids.mapInArrow(firsts, "bucket int, first long").groupBy("bucket").agg(F.max("first").alias("first")).collect()}
    order = sorted(heads, reverse=True)
    # The bucket before a bucket, in descending order: its last document is followed by the first of this one.
    before = {b: order[i - 1] for i, b in enumerate(order)}

    def deal(batches):
        for batch in batches:
            k = batch.column(0).to_numpy()
            bucket = np.searchsorted(bounds, k).astype(np.int32)
            extra = [i for i, b in enumerate(bucket.tolist()) if heads[b] == k[i]]
            names = ["bucket", "later", "k", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.zeros(len(k), bool)), batch.column(0), batch.column(1)], names)
            if extra:
                again = batch.take(pa.array(extra))
                to = [before[b] for b in bucket[extra].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([True] * len(to)), again.column(0), again.column(1)], names)

    dealt = rows.mapInArrow(deal, "bucket int, later boolean, k long, text string")
    dealt = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "later", F.desc("k"), "text")
    schema = ("k long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

    def compare(batches):
        held = None
        for batch in batches:
            out = []
            for bucket, later, k, t in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0] == bucket and not held[1]:
                    own = signature(t) if t != held[3] else held[4]
                    out.append(compared(held, t, own))
                    held = (bucket, later, k, t, own)
                else:
                    held = (bucket, later, k, t, signature(t) if not later else None)
            for start in range(0, len(out), 4096):
                columns = zip(*out[start : start + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(columns, KINDS)], [f.split()[0] for f in schema.split(", ")])

    return dealt.mapInArrow(compare, schema).select(
        F.when(F.col("k") != -(1 << 63), F.col("k")).alias(key), *[f.split()[0] for f in schema.split(", ")[1:]])


def compared(held: tuple, after: str, following: np.ndarray) -> tuple:
    """A document's row; following: the next document's signature."""
    _, _, k, text, own = held
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    other = own if edited == text else signature(edited)
    return (k, len(text), hashlib.sha256(edited.encode()).hexdigest(), written_out(own), written_out(other), likeness(own, other), likeness(own, following))


KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
