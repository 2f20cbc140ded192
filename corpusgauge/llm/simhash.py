"""Near-duplicates by SimHash, found by anchor-point covering.

A fingerprint has a bit set where over half of the text's shingle hashes have it. Anchors are the words of a covering
code: the product of two perfect binary Golay codes on bits 0-22 and 23-45 (radius 3 each), and of the code of one word on
the other 18 bits (radius 18). Every fingerprint has a nearest anchor within the covering radius, and flipping some bits
of the fingerprint leads to the anchors that are nearest to what is near it.

Two fingerprints within 3 bits have a point between them that is at most 1 bit from one and at most 2 from the other, and
the anchor of that point is within the covering radius and that many bits of each. So each fingerprint is replicated to
the anchors reached by 2 flips or fewer, marked where 1 is enough, and per anchor marked ones are compared with all. No pair is missed.

Only distinct fingerprints are replicated, copies meet before. The work per anchor gives a spanning forest of the links it
finds, not all pairs of a dense group; anchors with too many fingerprints are compared block by block in several tasks.
"""

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import written

#: Fixed value: generator polynomial of the binary Golay code of length 23, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101
WIDTH, CHECKS = 23, 11
#: Fingerprints of one anchor that are compared in one task.
MOST_PER_TASK = 1 << 14
#: Shingles hashed at once.
BLOCK = 1 << 15


# Fingerprints

def hashes(text: str | None, words: int, seed: int = 42):
    """Hashes of a text's shingles in blocks: of the whole sequence if it has fewer words, none if it has no words."""
    tokens = (text or "").encode().lower().split()
    if tokens and len(tokens) < words:
        tokens, words = [b" ".join(tokens)], 1
    for start in range(0, len(tokens) - words + 1 if tokens else 0, BLOCK):
        part = tokens[start : start + BLOCK + words - 1]
        rows = zip(*(part[i:] for i in range(words)))
        yield np.array([xxhash.xxh64_intdigest(b" ".join(row), seed) for row in rows], np.uint64)


def fingerprint(text: str | None, words: int, seed: int = 42) -> int:
    """The fingerprint of a text's shingles, as an unsigned 64-bit integer; 0 if it has no words."""
    n, counts = 0, np.zeros(64, np.int64)
    for block in hashes(text, words, seed):
        n += len(block)
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """id, text_key (hash of the text) and f (long)."""
    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["id", "text_key", "f"])

    rows = docs.select(docs[key].cast("long").alias("id"), text_hash(docs[text]).alias("text_key"), docs[text].alias("text"))
    return rows.mapInArrow(run, "id long, text_key long, f long")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# Anchors

def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of the words by the generator polynomial."""
    out = words.astype(np.int64)
    for bit in range(WIDTH - 1, CHECKS - 1, -1):
        out = np.where(out >> bit & 1, out ^ (GOLAY << (bit - CHECKS)), out)
    return out


@functools.lru_cache(maxsize=1)
def leaders() -> np.ndarray:
    """The error of weight 3 or less of each syndrome: the code is perfect, so there is exactly one."""
    bits = [0, *(1 << i for i in range(WIDTH))]
    errors = np.array(sorted({a | b | c for a in bits for b in bits for c in bits}), np.int64)
    table = np.zeros(1 << CHECKS, np.int64)
    table[syndromes(errors)] = errors
    return table


def ball(words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 0, 1 and 2 flips: (place in words, anchor) of the anchors that need just so many, each once."""
    table, own = leaders(), syndromes(words)
    units = [1 << i for i in range(WIDTH)]
    flips = [[0], units, [a | b for i, a in enumerate(units) for b in units[:i]]]
    seen, out = np.empty(0, np.int64), []
    for masks in flips:
        masks = np.array(masks, np.int64)
        # The syndrome is linear: that of a flipped word is the word's with the flip's added.
        anchors = (words[:, None] ^ masks) ^ table[own[:, None] ^ syndromes(masks)]
        pairs = np.unique((np.arange(len(words))[:, None] << 12 | anchors >> CHECKS).ravel())
        pairs = np.setdiff1d(pairs, seen, assume_unique=True)
        seen = np.concatenate([seen, pairs])
        out.append((pairs >> 12, pairs & 0xFFF))
    return out


def replicas(fps: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in fps, anchor, near) of the anchors within 2 flips, marked if within `near`. An anchor is its codes' 12 data bits each."""
    first, second = ball(fps & 0x7FFFFF), ball(fps >> 23 & 0x7FFFFF)
    found = []
    for i, j in ((0, 0), (0, 1), (1, 0), (1, 1), (0, 2), (2, 0)):
        (at, a), (to, b) = first[i], second[j]
        order = np.argsort(to, kind="stable")
        to, b = to[order], b[order]
        begin, end = np.searchsorted(to, at), np.searchsorted(to, at, "right")
        n = end - begin
        pick = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        found.append((np.repeat(at, n), np.repeat(a, n) << 12 | b[pick], np.full(n.sum(), i + j <= near)))
    return tuple(np.concatenate(x) for x in zip(*found))


def replicate(distinct: DataFrame, near: int) -> DataFrame:
    """(anchor, near, f) of distinct fingerprints f."""
    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for start in range(0, len(fps), 2048):
                part = fps[start : start + 2048]
                at, anchor, mark = replicas(part, near)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(mark), pa.array(part[at])], ["anchor", "near", "f"])

    return distinct.select("f").mapInArrow(run, "anchor int, near boolean, f long")


# Links

def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of differing bits of signed integers; unsigned, for numpy counts the bits of the absolute value."""
    return np.bitwise_count((x ^ y).view(np.uint64))


class Forest:
    """Union-find over integers."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether they were apart."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def compared(batches, bits: int):
    """Links (a, b) of fingerprints, from rows (group, near, f, side) sorted by group.

    Marked rows of side 0 or 2 are compared with all of side 1 or 2 of their group. Of the links found only those are given
    that join something new in this task: a dense group gives a forest and not its pairs.
    """
    forest = Forest()

    def links(near, f, side):
        left, right = f[near & (side != 1)], f[side != 0]
        for i in range(0, len(left), 256):
            x = left[i : i + 256]
            for j in range(0, len(right), 4096):
                y = right[j : j + 4096]
                # What is connected already needs no look at the pair.
                xr, yr = (np.array([forest.root(k) for k in z.tolist()]) for z in (x, y))
                at, to = np.nonzero((differing(x[:, None], y) <= bits) & (xr[:, None] != yr))
                for p, q in zip(x[at].tolist(), y[to].tolist()):
                    if forest.join(p, q):
                        yield p, q

    def emit(rows):
        """One batch with the links of whole groups."""
        groups, near, f, side = rows
        if not len(groups):
            return
        starts = np.concatenate([[0], np.flatnonzero(np.diff(groups)) + 1, [len(groups)]])
        sizes, found = np.diff(starts), []
        # Groups of two, most by far, are looked at together first.
        two = starts[:-1][sizes == 2]
        two = two[(differing(f[two], f[two + 1]) <= bits) & (near[two] | near[two + 1])]
        spans = [(i, i + 2) for i in two.tolist()]
        spans += [(s, s + n) for s, n in zip(starts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist())]
        for s, e in spans:
            found.extend(links(near[s:e], f[s:e], side[s:e]))
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    held = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        # The last group may go on in the next batch.
        whole = np.searchsorted(rows[0], rows[0][-1]) if len(rows[0]) else 0
        held = [c[whole:] for c in rows]
        yield from emit([c[:whole] for c in rows])
    if held is not None:
        yield from emit(held)


def linked(rows: DataFrame, bits: int, most: int = MOST_PER_TASK) -> DataFrame:
    """Links (a, b) that connect the fingerprints that replicas (anchor, near, f) at one anchor connect."""
    hot = rows.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    hot = written(hot.select("anchor", F.ceil(F.col("n") / most).cast("int").alias("parts")), "hot")
    # A hot anchor's rows are dealt into parts, and each pair of parts is a group: (i, j) compares i's marked with j's.
    dealt = rows.join(hot, "anchor").withColumn("part", F.pmod(F.xxhash64("f"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    as_left = F.transform(every, lambda j: F.struct(F.col("part").alias("i"), j.alias("j"), F.when(j == F.col("part"), 2).otherwise(0).alias("side")))
    as_right = F.transform(F.filter(every, lambda i: i != F.col("part")), lambda i: F.struct(i.alias("i"), F.col("part").alias("j"), F.lit(1).alias("side")))
    split = dealt.select("anchor", "near", "f", F.explode(F.concat(as_left, as_right)).alias("p")).select(
        F.xxhash64("anchor", "p.i", "p.j").alias("group"), "near", "f", F.col("p.side").cast("byte").alias("side"))
    plain = rows.join(hot, "anchor", "left_anti").select(
        F.col("anchor").cast("long").alias("group"), "near", "f", F.lit(2).cast("byte").alias("side"))
    groups = plain if hot.isEmpty() else plain.unionByName(split)
    groups = groups.repartition("group").sortWithinPartitions("group")
    return groups.mapInArrow(lambda batches: compared(batches, bits), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(v, root) of every vertex of the links (a, b); root is the smallest vertex connected with v.

    Each round points every vertex to its smallest neighbour, follows the pointers to their ends and contracts the links to
    these; the vertices at least halve, so rounds are few. All of it are joins and partial aggregates, written each round.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    edges, labels = written(both(links), "links"), None
    while not edges.isEmpty():
        up = written(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("to")), "up")
        while True:
            onward = up.select(F.col("v").alias("to"), F.col("to").alias("next"))
            up = written(up.join(onward, "to").select("v", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "up")
            if up.filter("moved").isEmpty():
                break
            up = up.drop("moved")
        up = up.drop("moved")
        if labels is None:
            labels = up.select("v", F.col("to").alias("root"))
        else:
            ends = up.select(F.col("v").alias("root"), "to")
            labels = written(labels.join(ends, "root", "left").select("v", F.coalesce("to", "root").alias("root")), "labels")
        one, two = up.toDF("a", "to_a"), up.toDF("b", "to_b")
        edges = written(edges.join(one, "a").join(two, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).filter("a <> b").distinct(), "links")
    if labels is None:
        return links.select(F.col("a").alias("v"), F.col("b").alias("root")).limit(0)
    # The ends of the pointers are the smallest of their neighbours, not yet of the component.
    least = labels.groupBy("root").agg(F.min("v").alias("least"))
    return labels.join(least, "root").select("v", F.col("least").alias("root"))


def connected(marked: DataFrame, bits: int, most: int = MOST_PER_TASK) -> DataFrame:
    """marked (id, ..., f) with component_id, the smallest id reachable over fingerprints f that differ in few bits."""
    if not 0 <= bits <= 3:
        raise ValueError("the replicas reach 3 bits")
    distinct = written(marked.groupBy("f").agg(F.min("id").alias("first")), "distinct")
    roots = written(components(linked(replicate(distinct, 1), bits, most)).withColumnRenamed("v", "f"), "roots")
    grouped = distinct.join(roots, "f").groupBy("root").agg(F.min("first").alias("least"))
    least = roots.join(grouped, "root").select("f", "least")
    ids = distinct.join(least, "f", "left").select("f", F.coalesce("least", "first").alias("component_id"))
    return marked.join(ids, "f")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3, bits: int = 3, most: int = MOST_PER_TASK) -> DataFrame:
    """Per row: key, fingerprint (16 hex digits) and component_id, the smallest key reachable over links, its own included.

    Fingerprints link at `bits` (3 at most) or fewer differing bits. Texts without words (null, empty, blank) have fingerprint
    zero and are linked like any other. A null key takes part, and a component of nothing but null keys has a null id.
    Repeated rows stay. Other columns are left out.
    """
    found = connected(written(fingerprints(docs, words, text, key), "fingerprints"), bits, most)
    return found.select(F.col("id").alias(key), hexadecimal(F.col("f")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3, bits: int = 3, most: int = MOST_PER_TASK) -> DataFrame:
    """docs with one row of each group of near duplicates: that of the smallest key; of repeated rows one stays.

    The groups are those of near_duplicates. Rows without a key stay if no text of their group has one, but for repeated rows.
    """
    found = connected(written(fingerprints(docs, words, text, key), "fingerprints"), bits, most)
    groups = written(found.select("id", "text_key", "component_id"), "groups")
    same = lambda one: docs_key.eqNullSafe(one["id"]) & (text_key == one["text_key"])
    lost = groups.filter(~F.col("id").eqNullSafe(F.col("component_id"))).select("id", "text_key").distinct()
    # Rows that share a kept key: of one group all but one go, by the order of their texts' hashes.
    kept = groups.filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("id", "component_id").agg(
        F.count("*").alias("n"), F.min("text_key").alias("text_key"), F.max("text_key").alias("other"))
    twice = kept.filter((F.col("n") > 1) & F.col("id").isNotNull()).select("id", "text_key")
    bare = kept.filter((F.col("n") > 1) & F.col("id").isNull()).select("id")
    docs_key, text_key = docs[key].cast("long"), text_hash(docs[text])
    rest = docs.join(lost, same(lost), "left_anti")
    again = twice.select("id").union(bare)
    if again.isEmpty():
        return rest
    once = rest.join(again, docs_key.eqNullSafe(again["id"]), "left_anti")
    first = rest.join(twice, same(twice), "left_semi").dropDuplicates([key])
    null = rest.join(bare, docs_key.eqNullSafe(bare["id"]), "left_semi").dropDuplicates([key, text])
    return once.unionByName(first).unionByName(null)
