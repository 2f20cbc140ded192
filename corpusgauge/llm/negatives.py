"""Hard negatives by cover trees over norm-augmented vectors.

Each candidate gets one more component, the root of M² - |x|², so that all candidates of a block have the norm M. A query
that has 0 there keeps its inner products, and a ball around a candidate c of radius r, measured with that component, holds
inner products of at most q·c + |q| r and at least q·c - |q| r.

A cover tree is built over each block of candidates: a node is a ball around one of its own points, its children's centres
are more than the level's radius apart and cover all its points, and a node keeps the largest distance to any of its points.
A query goes down best first, by the highest product a node can hold. Nodes that lie wholly outside the windows wanted, that
hold only labels that don't count, or that can't beat the worst of the best found are skipped; the points of leaves are
verified by exact integer products.

Trees are written once. Anchors are looked up in blocks of ANCHORS, each with one pass over the trees for its positives and
one for its negatives: the anchors go to the trees, no vector is moved. A task gives at most k rows per anchor and window.
"""

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import written

#: Candidates in a tree.
BLOCK = 8_192
#: Anchors in one pass over the trees.
ANCHORS = 8_192
#: Points of a node that isn't split further.
LEAF = 32
#: A level's radius as a share of the one above.
SHRINK = 0.85
#: Nodes opened in one step of a descent.
STEP = 256
#: Components beyond this are left out: inner products of vectors of up to 2,048 of them stay within 64 bits.
LARGEST = 1 << 26
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Tree:
    """Distinct points in the order of the tree, what stands at each, and the nodes level by level."""

    points: np.ndarray  # n x d, integers
    first: np.ndarray  # members of point i: first[i] to first[i + 1]
    ids: np.ndarray
    labels: np.ndarray
    centre: np.ndarray  # of each node: a place in points
    radius: np.ndarray
    low: np.ndarray  # points of the node: low to high
    high: np.ndarray
    child: np.ndarray  # its children: child to child + children; none for leaves
    children: np.ndarray
    label_range: np.ndarray  # smallest and largest label of each node

    @cached_property
    def doubles(self) -> np.ndarray:
        return self.points.astype(float)

    @cached_property
    def largest(self) -> int:
        return int(np.abs(self.points).max(initial=0))


def augmented(points: np.ndarray) -> np.ndarray:
    square = (points.astype(float) ** 2).sum(axis=1)
    return np.c_[points, np.sqrt(square.max(initial=0) - square)]


def cover_tree(points: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int) -> Tree:
    """The tree of vectors with their ids and labels; of equal vectors of one label the k + 1 smallest ids are kept."""
    distinct, owner = np.unique(points, axis=0, return_inverse=True)
    owner = owner.reshape(-1)
    by = np.lexsort((ids, labels, owner))
    owner, ids, labels = owner[by], ids[by], labels[by]
    fresh = np.r_[True, (np.diff(owner) != 0) | (np.diff(labels) != 0) | (np.diff(ids) != 0)]  # repeated rows count once
    owner, ids, labels = owner[fresh], ids[fresh], labels[fresh]
    starts = np.flatnonzero(np.r_[True, (np.diff(owner) != 0) | (np.diff(labels) != 0)])
    keep = np.arange(len(ids)) - np.repeat(starts, np.diff(np.r_[starts, len(ids)])) <= k
    owner, ids, labels = owner[keep], ids[keep], labels[keep]

    wide = augmented(distinct)
    order = np.arange(len(distinct))
    gap = lambda c, members: np.sqrt(((wide[members] - wide[c]) ** 2).sum(axis=1))
    centre, radius, low, high, child, children, cover = [0], [0.0], [0], [len(order)], [0], [0], []
    far = gap(0, order)
    radius[0] = far.max(initial=0)
    cover.append(radius[0])
    node = 0
    while node < len(centre):
        a, z, c = low[node], high[node], centre[node]
        if z - a > LEAF and radius[node] > 0:
            level, members = cover[node], order[a:z]
            far = gap(c, members)
            while (far <= level).all():  # levels on which the node is its only child
                level *= SHRINK
            parts, left = [], members
            while len(left):
                inside = far <= level
                parts.append((c, left[inside], far[inside].max()))
                left = left[~inside]
                if len(left):
                    c = left[0]
                    far = gap(c, left)
            child[node], children[node] = len(centre), len(parts)
            at = a
            for c, own, reach in parts:
                order[at : at + len(own)] = own
                for column, value in ((centre, c), (radius, reach), (low, at), (high, at + len(own)), (child, 0), (children, 0), (cover, level)):
                    column.append(value)
                at += len(own)
        node += 1

    place = np.argsort(order)
    owner = place[owner]
    by = np.lexsort((ids, owner))
    owner, ids, labels = owner[by], ids[by], labels[by]
    first = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(order)))]
    low, high = np.array(low), np.array(high)
    ranges = np.array([(labels[first[a] : first[z]].min(), labels[first[a] : first[z]].max()) for a, z in zip(low, high)])
    # The narrowest type that holds them: trees are written and read whole.
    small = distinct[order].astype(np.min_scalar_type(-int(np.abs(distinct).max(initial=0)) - 1))
    return Tree(small, first, ids, labels, place[np.array(centre)], np.array(radius), low, high, np.array(child), np.array(children), ranges)


class Best:
    """The k best (score, id) so far, higher scores first, ties to smaller ids."""

    def __init__(self, k: int):
        self.k, self.rows, self.floor = k, [], None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.floor is not None:
            some = scores >= self.floor
            scores, ids = scores[some], ids[some]
        if len(scores):
            order = np.lexsort((ids, -scores))
            scores, ids = -scores[order], ids[order]
            fresh = np.r_[True, (np.diff(scores) != 0) | (np.diff(ids) != 0)]
            self.rows = sorted({*self.rows, *zip(scores[fresh][: self.k].tolist(), ids[fresh][: self.k].tolist())})[: self.k]
            if len(self.rows) == self.k:
                self.floor = -self.rows[-1][0]


def descend(tree: Tree, q: np.ndarray, anchor: int, label: int, same: bool, windows: list[tuple[int, int]], best: list[Best]) -> None:
    """Adds to best, one per window (lowest and highest score), what the tree holds for the anchor."""
    # Products below 2^53 are exact in doubles.
    exact = tree.doubles if len(q) * int(np.abs(q).max(initial=0)) * tree.largest < 1 << 53 else tree.points.astype(np.int64)
    q = q.astype(exact.dtype)
    length = float(np.sqrt((q.astype(float) ** 2).sum()))

    def reach(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest product wanted that each node can hold; nodes of no use have False."""
        middle = (exact[tree.centre[nodes]] @ q).astype(float)
        slack = length * tree.radius[nodes] * (1 + 1e-9) + 1e-6
        top, bottom = middle + slack, middle - slack
        small, large = tree.label_range[nodes].T
        useful = (small <= label) & (label <= large) if same else (small != label) | (large != label)
        wanted, most = np.zeros(len(nodes), bool), np.full(len(nodes), -np.inf)
        for (lowest, highest), own in zip(windows, best):
            floor = lowest if own.floor is None else max(lowest, own.floor)
            fits = (top >= floor) & (bottom <= highest)
            wanted |= fits
            most = np.where(fits, np.maximum(most, np.minimum(top, highest)), most)
        return most, useful & wanted

    nodes = np.array([0])
    most, useful = reach(nodes)
    nodes, most = nodes[useful], most[useful]
    while len(nodes):
        least = min(w[0] if b.floor is None else max(w[0], b.floor) for w, b in zip(windows, best))
        open_ = most >= least
        nodes, most = nodes[open_], most[open_]
        pick = np.argpartition(-most, STEP - 1)[:STEP] if len(nodes) > STEP else np.arange(len(nodes))
        opened = nodes[pick]
        rest = np.ones(len(nodes), bool)
        rest[pick] = False
        nodes, most = nodes[rest], most[rest]
        leaves = opened[tree.children[opened] == 0]
        if len(leaves):
            at = np.concatenate([np.arange(a, z) for a, z in zip(tree.low[leaves], tree.high[leaves])])
            scores = (exact[at] @ q).astype(np.int64)
            inside = np.zeros(len(at), bool)
            for (lowest, highest), own in zip(windows, best):
                inside |= (scores >= (lowest if own.floor is None else max(lowest, own.floor))) & (scores <= highest)
            at, scores = at[inside], scores[inside]
            sizes = tree.first[at + 1] - tree.first[at]
            if len(at):
                rows = np.concatenate([np.arange(a, z) for a, z in zip(tree.first[at], tree.first[at + 1])])
                scores = np.repeat(scores, sizes)
                fits = (tree.ids[rows] != anchor) & ((tree.labels[rows] == label) == same)
                rows, scores = rows[fits], scores[fits]
                for (lowest, highest), own in zip(windows, best):
                    some = (scores >= lowest) & (scores <= highest)
                    own.add(scores[some], tree.ids[rows[some]])
        inner = opened[tree.children[opened] > 0]
        if len(inner):
            fresh = np.concatenate([np.arange(c, c + n) for c, n in zip(tree.child[inner], tree.children[inner])])
            reached, useful = reach(fresh)
            nodes, most = np.r_[nodes, fresh[useful]], np.r_[most, reached[useful]]


def valid(vectors: DataFrame, key: str, label: str, vector: str, scale: int) -> DataFrame:
    """(id, label, v): rows that take part, components as floor(scale * x)."""
    v = vectors[vector].cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(vectors[key].cast("long").alias("id"), vectors[label].cast("long").alias("label"), v.alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale)))
    return rows.filter(F.forall("v", lambda x: F.abs(x) <= LARGEST) & (F.size("v") <= 2_048))


def planted(rows: DataFrame, k: int, block: int) -> DataFrame:
    """A row (tree) per block of candidates of one length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def tree(size):
            ids, labels, points = (np.concatenate(x) for x in zip(*held.pop(size)))
            made = pickle.dumps(cover_tree(points, ids, labels, k), protocol=5)
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([made], pa.binary())], ["size", "tree"])

        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                for start in range(0, part.num_rows, block):
                    cut = part.slice(start, block)
                    held.setdefault(size, []).append((cut.column(0).to_numpy(), cut.column(1).to_numpy(), cut.column(2).flatten().to_numpy().reshape(cut.num_rows, size)))
                    if sum(len(x[0]) for x in held[size]) >= block:
                        yield tree(size)
        for size in list(held):
            yield tree(size)

    return rows.mapInArrow(run, "size int, tree binary")


def looked_up(trees: DataFrame, anchors: list[tuple[int, int, np.ndarray, list[tuple[int, int]]]], same: bool, k: int) -> DataFrame:
    """(anchor, window, id, score): the k best of each task; anchors: id, label, vector and windows of scores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[Best(k) for _ in windows] for *_, windows in anchors]
        for batch in batches:
            for size, made in zip(batch.column(0).to_pylist(), batch.column(1)):
                tree = pickle.loads(made.as_py())
                for (anchor, label, q, windows), own in zip(anchors, best):
                    if len(q) == size and windows:
                        descend(tree, q, anchor, label, same, windows, own)
        rows = [(a, w, i, -s) for a, own in enumerate(best) for w, b in enumerate(own) for s, i in b.rows]
        columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["anchor", "window", "id", "score"])

    found = trees.mapInArrow(run, "anchor int, window int, id long, score long").distinct()
    order = W.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def anchor_blocks(anchors: DataFrame, most: int) -> Iterator[list]:
    """Distinct anchors in blocks; one partition of them is on the driver at a time."""
    block = []
    for r in anchors.distinct().toLocalIterator():
        block.append((r["id"], r["label"], np.array(r["v"], np.int64)))
        if len(block) == most:
            yield block
            block = []
    if block:
        yield block


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256, block: int = BLOCK, most: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    anchors are rows like those of vectors. Components become floor(scale * x), scores are inner products. An anchor's
    positives are the other rows of its label with the highest scores, ties to smaller ids; a positive's negatives are the
    highest rows of other labels with low * positive <= 100 * score <= high * positive. Rows with a null id or label, a null
    vector or null or non-finite components take no part, nor do those with components beyond LARGEST or more than 2,048 of
    them. Vectors are compared with those of equal length; empty ones have score 0. Rows of equal id are one another's
    own; rows of equal id, label and vector count once, as anchors and as candidates. Without a negative there is no row. Other columns are left out.
    """
    spark, found = vectors.sparkSession, []
    rows = valid(vectors, key, label, vector, scale)
    trees = written(planted(rows, max(positives, negatives), block), "trees")
    all_scores = [(-(1 << 62), 1 << 62)]
    for part in anchor_blocks(valid(anchors, key, label, vector, scale), most):
        first = looked_up(trees, [(*a, all_scores) for a in part], True, positives).collect()  # positives x block of anchors
        first.sort(key=lambda r: (r["anchor"], r["rank"]))
        windows: list[dict] = [{} for _ in part]
        pairs = []
        for r in first:
            own = windows[r["anchor"]]
            bounds = (-(-low * r["score"] // 100), high * r["score"] // 100)
            if bounds[0] <= bounds[1]:
                pairs.append((r["anchor"], own.setdefault(bounds, len(own)), part[r["anchor"]][0], r["id"], r["score"]))
        if not pairs:
            continue
        near = looked_up(trees, [(*a, list(w)) for a, w in zip(part, windows)], False, negatives)
        pairs = F.broadcast(spark.createDataFrame(pairs, "anchor int, window int, anchor_id long, positive_id long, positive_score long"))
        found.append(near.join(pairs, ["anchor", "window"]).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    if not found:
        return spark.createDataFrame([], RESULT)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
