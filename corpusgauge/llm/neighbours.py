"""Approximate nearest neighbours by learned partitions.

The nearest neighbours of a bounded sample form a graph. It is cut into parts of equal size along few edges, by repeated
bisection: points are ordered by the slowest mode of diffusion over the graph, cut at the median, and points that have more
neighbours on the other side are exchanged in pairs. A small classifier learns from the sample in which parts a point's neighbours are.

Every vector is indexed under its most probable part, and a query is compared with all vectors of its most probable parts,
by exact distances. The sample (at most SAMPLE vectors) and the classifier are bounded; index and search run on Spark.
Large parts are split into blocks by hash, as are many queries, so a task holds a block of each whatever the data.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from .common import written

#: Most vectors that the partition and the classifier are fitted on.
SAMPLE = 8_192
DEGREE = 10
HIDDEN = 128
#: Vectors and queries of a block.
BLOCK = 4_096


def nearest(points: np.ndarray, degree: int) -> np.ndarray:
    """The places of each point's nearest other points."""
    square, out = (points**2).sum(axis=1), []
    for start in range(0, len(points), 128):
        part = points[start : start + 128]
        gap = square[start : start + 128, None] + square - 2 * part @ points.T
        gap[np.arange(len(part)), np.arange(start, start + len(part))] = np.inf
        out.append(np.argpartition(gap, degree - 1, axis=1)[:, :degree])
    return np.concatenate(out)


def halves(members: np.ndarray, links: np.ndarray, rng) -> np.ndarray:
    """Which members go to the second half; links: pairs (a, b) of places in members."""
    n = len(members)
    a, b = links[:, 0], links[:, 1]
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + 1.0
    x = rng.standard_normal(n)
    for _ in range(100):
        x -= (x * degree).sum() / degree.sum()
        x = (x + np.bincount(a, weights=x[b], minlength=n) + np.bincount(b, weights=x[a], minlength=n)) / degree / 2 + x / 2
        x /= np.abs(x).max() or 1
    side = np.zeros(n, bool)
    side[np.argsort(x, kind="stable")[n // 2 :]] = True
    for _ in range(10):
        across = side[a] != side[b]
        sign = np.where(across, 1, -1)
        gain = np.bincount(a, weights=sign, minlength=n) + np.bincount(b, weights=sign, minlength=n)
        left, right = (s[np.argsort(-gain[s], kind="stable")] for s in (np.flatnonzero(~side), np.flatnonzero(side)))
        m = min(len(left), len(right))
        swap = np.flatnonzero((gain[left[:m]] > 0) & (gain[right[:m]] > 0))[: max(1, n // 50)]
        if not len(swap):
            break
        side[left[swap]], side[right[swap]] = True, False
    return side


def partition(near: np.ndarray, parts: int) -> np.ndarray:
    """A part for each point, of equal sizes, from the neighbour lists; parts is a power of two."""
    rng, own = np.random.default_rng(0), np.zeros(len(near), np.int64)
    a, b = np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()
    while (own.max(initial=0) + 1) < parts:
        fresh = own * 2
        for p in range(own.max() + 1):
            members = np.flatnonzero(own == p)
            place = np.full(len(near), -1)
            place[members] = np.arange(len(members))
            inside = (own[a] == p) & (own[b] == p)
            fresh[members] += halves(members, np.stack([place[a[inside]], place[b[inside]]], axis=1), rng)
        own = fresh
    return own


@dataclass
class Router:
    """A classifier with one hidden layer: the probability of each part."""

    weights: list[np.ndarray]

    def probable(self, points: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        z = np.maximum(points @ w1 + b1, 0) @ w2 + b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(points: np.ndarray, target: np.ndarray, rounds: int = 40, rate: float = 0.003) -> Router:
    """A router fitted to target, the share of parts around each point."""
    rng, n = np.random.default_rng(1), len(points)
    w = [rng.standard_normal((points.shape[1], HIDDEN)) * (2 / points.shape[1]) ** 0.5, np.zeros(HIDDEN),
         rng.standard_normal((HIDDEN, target.shape[1])) * (1 / HIDDEN) ** 0.5, np.zeros(target.shape[1])]
    m, v, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    for _ in range(rounds):
        order = rng.permutation(n)
        for start in range(0, n, 256):
            pick = order[start : start + 256]
            hidden = np.maximum(points[pick] @ w[0] + w[1], 0)
            off = (Router(w).probable(points[pick]) - target[pick]) / len(pick)
            back = off @ w[2].T * (hidden > 0)
            t += 1
            for i, g in enumerate([points[pick].T @ back, back.sum(axis=0), hidden.T @ off, off.sum(axis=0)]):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(w)


def learn(points: np.ndarray, parts: int, recall: float = 0.95) -> tuple[Router, int]:
    """The router for so many parts of the sample, and how many parts to probe.

    An eighth of the sample is kept from the fit. The parts to probe are the fewest that hold the share `recall` of
    its nearest neighbours in the rest.
    """
    held, rest = points[: len(points) // 8], points[len(points) // 8 :]
    degree = min(DEGREE, len(rest) - 1)
    if parts == 1 or degree < 1 or not len(held):
        return Router([np.zeros((points.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)]), 1
    near = nearest(rest, degree)
    own = partition(near, parts)
    target = np.zeros((len(rest), parts))
    np.add.at(target, (np.repeat(np.arange(len(rest)), degree), own[near].ravel()), 1.0)
    target[np.arange(len(rest)), own] += 1
    router = train(rest, target / target.sum(axis=1, keepdims=True))
    indexed = router.probable(rest).argmax(axis=1)
    order = np.argsort(np.argsort(-router.probable(held), axis=1, kind="stable"), axis=1)
    depth = []
    for i, v in enumerate(held):
        gap = ((rest - v) ** 2).sum(axis=1)
        depth.append(order[i, indexed[np.argpartition(gap, degree - 1)[:degree]]])
    return router, int(np.quantile(np.concatenate(depth), recall, method="higher")) + 1


def valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part: not null or zero, without null or non-finite components."""
    v = vectors[vector].cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vectors.select(vectors[key].cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def routed(rows: DataFrame, router: Router, probes: int) -> DataFrame:
    """rows (id, v) once per probable part, with column part."""
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                p = router.probable(matrix(part.column(1)))
                top = np.argsort(-p, axis=1, kind="stable")[:, :probes]
                again = part.take(pa.array(np.repeat(np.arange(part.num_rows), top.shape[1])))
                yield pa.RecordBatch.from_arrays([again.column(0), again.column(1), pa.array(top.ravel().astype(np.int32))], ["id", "v", "part"])

    return rows.select("id", "v").mapInArrow(run, "id long, v array<double>, part int")


def block_search(key: tuple, queries: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of a block for each of its queries, ties to the smaller id."""
    out = []
    if len(queries) and len(block):
        block = block.sort_values("id", kind="stable")
        ids, points = block["id"].to_numpy(), np.stack(block["v"].to_numpy())
        for q, v in zip(queries["id"].to_numpy(), queries["v"]):
            gap = np.sqrt(((points - v) ** 2).sum(axis=1))
            gap[ids == q] = np.inf
            pick = np.argsort(gap, kind="stable")[:k] if len(gap) <= 4 * k else _least(gap, k)
            pick = pick[gap[pick] < np.inf]
            out.append(pd.DataFrame({"query_id": q, "vec_id": ids[pick], "score": gap[pick]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def _least(gap: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least, in order, ties by place."""
    bound = np.partition(gap, k - 1)[k - 1]
    near = np.flatnonzero(gap <= bound)
    return near[np.argsort(gap[near], kind="stable")][:k]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = 0.95, probes: int | None = None, sample: int = SAMPLE, part_rows: int = 1_024,
           parts: int | None = None, block: int = BLOCK, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of the k nearest found of each query, itself excluded.

    Vectors that are null, zero or hold null or non-finite components, and rows without id, take no part, as queries or
    candidates. Vectors are compared with those of equal length; each length has an index of its own. Ties go to the smaller
    id; rows of equal id are one another's own. There are about n / part_rows parts, a power of two that the sample can fill;
    without `probes`, so many are probed that the share `recall` of neighbours is found within the sample. Queries whose
    probed parts hold fewer than k candidates are searched in all parts, so fewer rows mean fewer candidates. Other columns
    are left out.
    """
    rows, asked = valid(vectors, key, vector), valid(queries, key, vector)
    # A few numbers: the lengths of vectors and how many of each there are.
    lengths = sorted((r["size"], r["count"]) for r in rows.groupBy(F.size("v").alias("size")).count().collect())
    found = [search_one(rows.filter(F.size("v") == size), asked.filter(F.size("v") == size), n, k, recall, probes, sample, part_rows, parts, block)
             for size, n in lengths]
    out = found[0] if found else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def search_one(rows: DataFrame, asked: DataFrame, n: int, k: int, recall: float, probes: int | None, sample: int, part_rows: int, parts: int | None, block: int) -> DataFrame:
    """The search among n vectors (id, v) of one length."""
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    points = matrix(some.column("v").combine_chunks())
    if parts is None:
        parts = 1 << max(0, min(int(np.log2(max(1, n / part_rows))), int(np.log2(max(1, len(points) / 64)))))
    router, enough = learn(points, parts, recall)
    index = written(routed(rows, router, 1), "index")
    # A few numbers per part: its vectors, and below its queries.
    sizes = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}

    def looked_up(asked: DataFrame, probes: int) -> DataFrame:
        probed = written(routed(asked, router, probes), "probes")
        loads = {r["part"]: r["count"] for r in probed.groupBy("part").count().collect()}
        blocks = F.array(*[F.lit(-(-sizes.get(p, 0) // block) or 1) for p in range(parts)])
        shares = F.array(*[F.lit(-(-loads.get(p, 0) // block) or 1) for p in range(parts)])
        of = lambda counts: F.element_at(counts, F.col("part") + 1)
        dealt = lambda counts: F.pmod(F.xxhash64("id"), of(counts)).cast("int")
        every = lambda counts: F.explode(F.sequence(F.lit(0), of(counts) - 1))
        right = index.withColumn("block", dealt(blocks)).select("*", every(shares).alias("share"))
        left = probed.withColumn("share", dealt(shares)).select("*", every(blocks).alias("block"))
        group = ["part", "block", "share"]
        found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(
            lambda key, q, b: block_search(key, q, b, k), "query_id long, vec_id long, score double")
        best = W.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    probes = min(probes or enough, parts)
    found = looked_up(asked, probes)
    if probes == parts:
        return found
    found = written(found, "found")
    full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = asked.join(full, "id", "left_anti")
    if n <= k or short.isEmpty():  # with k vectors or fewer no query can have more
        return found if short.isEmpty() else looked_up(asked, parts)
    again = written(short, "short")
    return found.join(again.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(looked_up(again, parts))
