"""Ranked lexical search with range-maximum sparse tables per posting list.

One pass reads the texts and writes, per document, its number of terms and how often each query term occurs in it. The
corpus counts come from that table. A second pass over it searches: the documents of a task are taken in blocks of some
MOST_POSTINGS postings, a block's postings are sorted by term and document, and a sparse table over them answers where a
term's largest impact lies between any two documents.

A query is answered best first over intervals of a block's documents. An interval's bound is the sum, over the query's
terms, of the weight times the largest impact of the term's postings there. The interval with the highest bound is split
at the document with the largest of these impacts: that document is scored, the two parts get bounds of their own. Narrow
intervals are scored whole. Intervals that can't reach the k best found so far are dropped unread; a task keeps its k best
from block to block. Documents of a block with equal terms and lengths are one entry with their k smallest ids, and
documents that share rare terms lie side by side, so that intervals of some documents have low bounds.

Queries go to all tasks, in blocks of at most QUERY_TERMS pairs of query and term (one query at least); each block of
queries has its own pass. Nothing else leaves its task but k rows per query and task.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import written

#: Pairs of query and term in one pass over the documents.
QUERY_TERMS = 1 << 18
#: Postings in a block of documents; a document isn't cut.
MOST_POSTINGS = 1 << 20
#: Intervals of at most so many documents are scored whole.
NARROW = 64
#: Cells of (interval, term) looked at in one step.
CELLS = 1 << 15

#: Bytes that end a term become blanks, A-Z small; digits and bytes from 0x80 on belong to terms.
SMALL = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in bytes(range(256)).lower())
POSTINGS = "doc_id long, n long, terms array<int>, tfs array<long>"
RESULT = "item_id long, rank int, doc_id long, score long"


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(SMALL).split()


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Queries:
    """Queries with numbered terms; a query is its item_id and the numbers of its distinct terms."""

    numbers: dict[bytes, int]
    items: list[tuple[int | None, list[int]]]


def query_blocks(items: DataFrame, key: str, text: str, most: int) -> Iterator[Queries]:
    """The queries in blocks; one partition of items is on the driver at a time."""
    block, pairs = Queries({}, []), 0
    for row in items.select(items[key].cast("long"), items[text].cast("binary")).toLocalIterator():
        terms = sorted(set(terms_of(bytes(row[1]) if row[1] is not None else None)))
        if block.items and pairs + len(terms) > most:
            yield block
            block, pairs = Queries({}, []), 0
        block.items.append((row[0], [block.numbers.setdefault(t, len(block.numbers)) for t in terms]))
        pairs += len(terms)
    if block.items:
        yield block


def postings(docs: DataFrame, numbers: dict[bytes, int], key: str, text: str) -> DataFrame:
    """Per document with a term: its id, number of terms, and the numbers and counts of the query terms in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, terms, tfs = [], [], [], []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(value.as_py())
                if words:
                    counts = Counter(words)
                    known = sorted((numbers[t], counts[t]) for t in counts.keys() & numbers.keys())
                    ids.append(doc_id)
                    sizes.append(len(words))
                    terms.append([t for t, _ in known])
                    tfs.append([c for _, c in known])
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("binary").alias("text"))
    return rows.filter("doc_id is not null").mapInArrow(run, POSTINGS)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start .. start + size - 1 of each pair, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)


class Block:
    """The postings of some documents, by term and document, with the sparse table over their impacts."""

    def __init__(self, ids: np.ndarray, norms: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, k: int):
        """ids, norms (m of the score) and sizes (postings) per document; terms and tfs of all documents in a row."""
        owner = np.repeat(np.arange(len(ids)), sizes)
        impact = 1_000_000_000 * tfs // (1000 * tfs + 8 * norms[owner])
        group = self._equal(sizes, terms, impact)
        # The k smallest ids of each group of equal documents.
        order = np.lexsort((ids, group))
        first = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0])
        kept = order[np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)])) < k]
        heads = order[first]
        # Documents in the order of their two weightiest terms.
        mass = weights[terms]
        by = np.lexsort((terms, -mass, owner))
        starts = np.cumsum(sizes) - sizes
        rare = terms[by[starts[heads]]]
        second = terms[by[starts[heads] + np.minimum(1, sizes[heads] - 1)]]
        place = np.argsort(np.lexsort((second, rare)))  # of each group
        self.n = len(heads)
        self.ids = ids[kept][np.argsort(place[group[kept]], kind="stable")]
        self.first_id = np.r_[0, np.cumsum(np.bincount(place[group[kept]], minlength=self.n))]
        at = ranges(starts[heads], sizes[heads])
        doc, term, self.impact = np.repeat(place, sizes[heads]), terms[at], impact[at]
        by = np.lexsort((doc, term))
        self.doc, term, self.impact = doc[by], term[by], self.impact[by]
        self.key = term.astype(np.int64) * self.n + self.doc
        bounds = np.flatnonzero(np.r_[True, np.diff(term) > 0, True]) if len(term) else np.zeros(1, np.int64)
        self.lists = {int(term[a]) for a in bounds[:-1]}
        self.table = [np.arange(len(term), dtype=np.int32)]
        longest, step = int(np.diff(bounds).max(initial=1)), 1
        while 2 * step <= longest:
            a = self.table[-1]
            b = np.r_[a[step:], a[len(a) - step :]]
            self.table.append(np.where(self.impact[a] >= self.impact[b], a, b))
            step *= 2
        self.table = np.stack(self.table)

    @staticmethod
    def _equal(sizes, terms, impact) -> np.ndarray:
        """A number for each document, equal where all terms and impacts are."""
        groups: dict[tuple, int] = {}
        ends = np.cumsum(sizes)
        return np.array([groups.setdefault((terms[e - s : e].tobytes(), impact[e - s : e].tobytes()), len(groups))
                         for s, e in zip(sizes.tolist(), ends.tolist())])

    def largest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where between low and high (exclusive) the largest impact is; -1 where there is nothing."""
        some = high > low
        length = np.where(some, high - low, 1)
        level = np.frexp(length)[1] - 1
        at = np.where(some, low, 0)
        a, b = self.table[level, at], self.table[level, at + length - (1 << level)]
        return np.where(some, np.where(self.impact[a] >= self.impact[b], a, b), -1)

    def search(self, terms: list[int], weights: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of best (scores, ids) and this block's documents: higher scores first, ties to smaller ids."""
        terms = np.array([t for t in terms if t in self.lists and weights[t] > 0], np.int64)
        if not len(terms):
            return best
        w, base = weights[terms], terms * self.n
        low, high, bound = np.zeros(1, np.int64), np.full(1, self.n), np.full(1, np.iinfo(np.int64).max)
        many = max(1, CELLS // len(terms))
        while len(low):
            floor_score = best[0][-1] if len(best[0]) >= k else 1
            open_ = bound >= floor_score
            low, high, bound = low[open_], high[open_], bound[open_]
            if not len(low):
                break
            pick = np.argpartition(-bound, many - 1)[:many] if len(low) > many else np.arange(len(low))
            rest = np.ones(len(low), bool)
            rest[pick] = False
            a, z = low[pick], high[pick]
            low, high, bound = low[rest], high[rest], bound[rest]
            narrow = z - a <= NARROW
            if narrow.any():
                best = self._better(best, *self._score(base, w, a[narrow], z[narrow]), k)
                a, z = a[~narrow], z[~narrow]
            if not len(a):
                continue
            from_, to = np.searchsorted(self.key, base + a[:, None]), np.searchsorted(self.key, base + z[:, None])
            top = self.largest(from_, to)
            gain = np.where(top >= 0, w * self.impact[top], 0)
            some = gain.max(axis=1) > 0
            a, z, from_, to, top, gain = (x[some] for x in (a, z, from_, to, top, gain))
            if not len(a):
                continue
            split = self.doc[top[np.arange(len(a)), gain.argmax(axis=1)]]
            middle = np.searchsorted(self.key, base + split[:, None])
            here = (middle < to) & (self.key[np.minimum(middle, len(self.key) - 1)] == base + split[:, None])
            best = self._better(best, split, np.where(here, w * self.impact[np.minimum(middle, len(self.key) - 1)], 0).sum(axis=1), k)
            for x, y, p, q in ((a, split, from_, middle), (split + 1, z, middle + here, to)):
                left = self.largest(p, q)
                low, high = np.r_[low, x], np.r_[high, y]
                bound = np.r_[bound, np.where(left >= 0, w * self.impact[left], 0).sum(axis=1)]
        return best

    def _score(self, base, w, a, z) -> tuple[np.ndarray, np.ndarray]:
        """The documents of narrow intervals and their scores."""
        from_ = np.searchsorted(self.key, base + a[:, None])
        sizes = np.searchsorted(self.key, base + z[:, None]) - from_
        at = ranges(from_.ravel(), sizes.ravel())
        docs, where = np.unique(self.doc[at], return_inverse=True)
        scores = np.zeros(len(docs), np.int64)
        np.add.at(scores, where, np.repeat(np.broadcast_to(w, sizes.shape).ravel(), sizes.ravel()) * self.impact[at])
        return docs, scores

    def _better(self, best, docs, scores, k) -> tuple[np.ndarray, np.ndarray]:
        keep = scores >= (best[0][-1] if len(best[0]) >= k else 1)
        docs, scores = docs[keep], scores[keep]
        if not len(docs):
            return best
        sizes = self.first_id[docs + 1] - self.first_id[docs]
        scores = np.r_[best[0], np.repeat(scores, sizes)]
        ids = np.r_[best[1], self.ids[ranges(self.first_id[docs], sizes)]]
        order = np.lexsort((ids, -scores))[:k]
        return scores[order], ids[order]


def flat(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def searched(rows: DataFrame, queries: Queries, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, doc_id, score): the k best of each task."""
    items = [terms for _, terms in queries.items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        best = [none] * len(items)

        def block(parts):
            ids, n, sizes, terms, tfs = (np.concatenate([p[i] for p in parts]) for i in range(5))
            made = Block(ids, 100 - 90 + 90 * n * n_docs // n_terms, sizes, terms, tfs, weights, k)
            for q, own in enumerate(items):
                best[q] = made.search(own, weights, best[q], k)

        parts, load = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sizes = np.diff(part.column(2).offsets.to_numpy())
                if sizes.sum():
                    some = sizes > 0
                    parts.append((part.column(0).to_numpy()[some], part.column(1).to_numpy()[some], sizes[some].astype(np.int64),
                                  flat(part.column(2)), flat(part.column(3))))
                    load += int(sizes.sum())
                if load >= MOST_POSTINGS:
                    block(parts)
                    parts, load = [], 0
        if parts:
            block(parts)
        for q, (scores, ids) in enumerate(best):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q, np.int32)), pa.array(ids), pa.array(scores)], ["query", "doc_id", "score"])

    return rows.mapInArrow(run, "query int, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
         item_text: str = "text", query_terms: int = QUERY_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k documents of highest score above 0 for each row of items.

    Terms are runs of letters, digits and characters outside ASCII, A-Z small. Equal scores are ranked by ascending
    doc_id. Documents without an id take no part, nor do those without a term; null texts have none. Repeated documents
    are documents of their own; repeated items are answered each. Without documents or terms there are no rows. Other
    columns are left out.
    """
    spark, found = docs.sparkSession, []
    for queries in query_blocks(items, item_key, item_text, query_terms):
        rows = written(postings(docs, queries.numbers, key, text), "postings")
        total = rows.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not total["docs"]:
            continue
        # One number per query term of the block.
        held = {r["t"]: r["count"] for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
        weights = np.array([weight(total["docs"], held.get(t, 0)) for t in range(len(queries.numbers))], np.int64)
        best = searched(rows, queries, weights, total["docs"], total["terms"], k)
        best = best.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(queries.items)], "query int, item_id long")
        found.append(best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], RESULT)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
