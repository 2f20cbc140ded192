"""Ranked search, hard negatives and license scans against brute force, on odd rows and on empty tables."""

import math
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest

from corpusgauge.llm import lexical, licenses, negatives

DOCS = "doc_id long, text string, n long, terms array<int>, score double, row long, query int"
LONG = "word " * 200_000 + "needle"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd documents, with extra columns named like the operators' own."""
    texts = [(1, None), (2, ""), (3, "x needle"), (3, "x needle"), (None, "x needle"), (5, " \t\n "), (6, LONG), (7, "Needle ÉÀ é9 x_x"), (None, None)]
    return spark.createDataFrame([(i, t, 1, [1], 0.5, 2, 3) for i, t in texts], DOCS)


def ranked(docs, items, k=10):
    """Every document's score, as the contract words it; docs: (id, text)."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(i, Counter(terms(t))) for i, t in docs if i is not None]
    docs = [(i, c) for i, c in docs if c]
    n, total = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        own = sorted(set(terms(text)))
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in own}
        scores = []
        for i, c in docs:
            m = 100 - 90 + 90 * c.total() * n // total
            s = sum(weights[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                scores.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def test_lexical_on_odd_rows(spark, odd):
    items = [(1, "needle"), (1, "needle"), (None, "NEEDLE x"), (3, None), (4, "absent"), (5, "É é9 word"), (6, LONG)]
    got = lexical.rank(odd, spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id long"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == ranked([(r["doc_id"], r["text"]) for r in odd.collect()], items)
    assert lexical.rank(odd.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert lexical.rank(odd, spark.createDataFrame([], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("most, query_terms", [(1 << 20, 1 << 18), (300, 40)])
def test_lexical_with_copies_and_ties(spark, monkeypatch, most, query_terms):
    """A third of the documents are one text; blocks and query blocks of any size give the same rows."""
    monkeypatch.setattr(lexical, "MOST_POSTINGS", most)
    monkeypatch.setattr(lexical, "NARROW", 4)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    docs = [(int(i), " ".join(words[min(59, int(x))] for x in rng.exponential(9, rng.integers(1, 40)))) for i in rng.permutation(600)]
    docs = [(i, "w1 w2 w3 w50" if i % 3 == 0 else t) for i, t in docs]
    items = [(q, " ".join(rng.choice(words, 12))) for q in range(20)] + [(20, "w50"), (21, "w1")]
    got = lexical.rank(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), query_terms=query_terms)
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(docs, items)


def test_lexical_reads_few_intervals():
    """Bounds are kept: a query for a rare term scores the documents that hold it and few others."""
    rng = np.random.default_rng(8)
    n = 20_000
    terms = [np.unique(np.r_[rng.choice(20, 4), 20 + (i % 500)]) for i in range(n)]
    sizes = np.array([len(t) for t in terms])
    block = lexical.Block(np.arange(n), rng.integers(20, 200, n), sizes, np.concatenate(terms).astype(np.int32), np.ones(sizes.sum(), np.int64),
                          np.array([100] * 20 + [6000] * 500), 10)
    scored = []
    whole = lexical.Block._score
    block._score = lambda base, w, a, z: scored.append((z - a).sum()) or whole(block, base, w, a, z)
    best = block.search([0, 1, 2, 77], np.array([100] * 20 + [6000] * 500), (np.zeros(0, np.int64), np.zeros(0, np.int64)), 10)
    assert len(best[0]) == 10 and sum(scored) < n / 20


def mined(rows, anchors, positives=5, k=5):
    """The contract by all pairs; rows: (id, label, vector)."""
    fit = lambda r: r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])
    whole = lambda rs: list(dict.fromkeys((i, l, tuple(math.floor(256 * x) for x in v)) for i, l, v in filter(fit, rs)))
    rows, out = whole(rows), []
    for a, label, q in whole(anchors):
        others = sorted({(-sum(x * y for x, y in zip(q, v)), i, l == label) for i, l, v in rows if i != a and len(v) == len(q)})
        for s, p, _ in [o for o in others if o[2]][:positives]:
            fits = [o for o in dict.fromkeys((o[0], o[1]) for o in others if not o[2]) if 80 * -s <= 100 * -o[0] <= 100 * -s][:k]
            out += [(a, p, r, i, -s, -n) for r, (n, i) in enumerate(fits, 1)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<float>, id long, v int, rank int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, l, v, 1, 2, 3) for i, l, v in rows], VECTORS)


def test_negatives_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 1, [0.5, 0.5]), (3, 2, [0.9, 0.0]), (4, 2, [0.9, 0.0]), (5, 3, [1.0, 0.0]), (6, None, [1.0, 0.0]),
            (7, 2, None), (8, 2, [nan, 1.0]), (9, 2, [inf, 1.0]), (10, 2, [None, 1.0]), (None, 2, [1.0, 0.0]), (11, 2, [1.0]), (12, 1, [1.0]), (13, 1, [0.95]),
            (14, 2, []), (15, 1, []), (16, 1, []), (0, 1, [1.0, 0.0]), (3, 2, [0.9, 0.0]), (17, 1, [0.0, 0.0]), (18, 2, [-1.0, -1.0]), (19, 2, [3e38, 0.0]), (1, 2, [0.97, 0.0])]
    table = vectors_of(spark, rows)
    got = negatives.mine(table, table)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    small = [r for r in rows if r[0] != 19]
    assert sorted(map(tuple, got.collect())) == mined(small, small)
    assert negatives.mine(table.limit(0), table.limit(0)).count() == 0
    assert negatives.mine(table, table.limit(0)).count() == 0


@pytest.mark.parametrize("block, most", [(8_192, 8_192), (50, 7)])
def test_negatives_against_all_pairs(spark, block, most):
    """Clusters, a third of all rows equal to one vector, ties: trees and anchor blocks of any size give the same rows."""
    rng = np.random.default_rng(6)
    heads = rng.normal(0, 0.3, (6, 12))
    rows = [(i, int(rng.integers(0, 4)), (heads[i % 6] + rng.normal(0, 0.05, 12)).tolist() if i % 3 else heads[0].tolist()) for i in range(900)]
    rows = [(i, l, np.float32(v).tolist()) for i, l, v in rows]
    table = vectors_of(spark, rows).repartition(3)
    got = negatives.mine(table, table.filter("vec_id % 20 = 0"), block=block, most=most)
    expected = mined(rows, [r for r in rows if r[0] % 20 == 0])
    assert expected and sorted(map(tuple, got.collect())) == expected


def test_cover_tree():
    """Each node covers its points; children lie in their parent, apart from one another; every point is in one leaf."""
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.integers(-300, 300, (5, 8)).repeat(60, axis=0) + rng.integers(-9, 9, (300, 8)), rng.integers(-300, 300, (1, 8)).repeat(200, axis=0)])
    labels = rng.integers(0, 3, len(points))
    tree = negatives.cover_tree(points, np.arange(len(points)), labels, 5)
    wide = negatives.augmented(tree.points.astype(np.int64))
    inner = 0
    for node in range(len(tree.centre)):
        a, z, c = tree.low[node], tree.high[node], tree.centre[node]
        assert a <= c < z and np.sqrt(((wide[a:z] - wide[c]) ** 2).sum(axis=1)).max() <= tree.radius[node] + 1e-9
        if tree.children[node]:
            own = range(tree.child[node], tree.child[node] + tree.children[node])
            assert [tree.low[n] for n in own] + [z] == [a] + [tree.high[n] for n in own]
            assert c == tree.centre[own[0]]  # a centre stays one below
            inner += 1
            for x, y in product(own, own):
                reach = max(tree.radius[own[0]], tree.radius[x])
                assert x == y or np.sqrt(((wide[tree.centre[x]] - wide[tree.centre[y]]) ** 2).sum()) > reach * 0.99 or tree.radius[x] > tree.radius[own[0]]
    assert inner and len(tree.ids) < len(points)  # of the copies the smallest ids of each label


def test_licenses_on_odd_rows(spark, odd):
    got = licenses.digest(licenses.scan(odd)).collect()
    assert len(got) == 9 and all(r["n_base"] == 0 and r["first_word"] is None and r["labels"] == "" and r["score"] == 0 for r in got)
    assert sorted((r["doc_id"] or 0, r["n_words"]) for r in got) == sorted([(1, 0), (2, 0), (3, 2), (3, 2), (0, 2), (5, 0), (6, 200_001), (7, 5), (0, 0)])
    assert licenses.scan(odd.limit(0)).count() == 0


def test_licenses_in_place(spark):
    filler = "alpha beta gamma delta " * 3_000
    texts = ["Licensed under CC BY-NC 4.0.", "CC\nBY cc by", "the GNU General  Public-License, and general public licenses", "All rights reserved. ALL RIGHTS RESERVED",
             filler + licenses.TEMPLATES[3][1] + filler, filler + licenses.TEMPLATES[3][1].replace("granted", "given").replace("charge", "cost") + filler,
             " ".join(sorted(set(licenses.TEMPLATES[3][1].split()))[:12]), "all rights " * 50_000 + "reserved", "rights reserved all"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.digest(licenses.scan(docs)).collect()}
    assert (got[0]["base_labels"], got[0]["labels"], got[0]["first_word"], got[0]["score"]) == ("cc-by", "cc-by,cc-by-nc-4.0", 2, 1.0)
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (2, 0, 2)
    assert (got[2]["n_base"], got[2]["last_word"]) == (1, 2)
    assert (got[3]["n_base"], got[3]["last_word"]) == (2, 3)
    assert got[4]["labels"] == "mit" and got[4]["score"] == 1.0 and 0.9 <= got[5]["score"] < 1 and got[6]["labels"] == ""
    assert (got[7]["n_base"], got[7]["first_word"]) == (1, 99_998) and got[8]["labels"] == ""


@pytest.mark.parametrize("threshold", [0.5, 0.75, 0.9, 1.0])
def test_license_join_finds_every_pair(spark, threshold):
    """Prefix, length and positional filters lose no block that meets a template."""
    rng = np.random.default_rng(int(threshold * 100))
    words = [f"w{i}" for i in range(40)]
    templates = [(f"t{i}", " ".join(rng.choice(words, rng.integers(2, 25)))) for i in range(12)]
    docs = [(i, " ".join(words[min(39, int(x))] for x in rng.exponential(14, rng.integers(0, 90)))) for i in range(150)]
    docs += [(150 + i, " ".join(["x"] * int(rng.integers(0, 30)) + t.split()[: int(rng.integers(1, 30))])) for i, (_, t) in enumerate(templates)]
    expected = set()
    for i, text in docs:
        own = text.split()
        for label, t in templates:
            parts, scale = set(t.split()), 1 << max(2, (len(t.split()) - 1).bit_length())
            for start in range(0, len(own), scale):
                n = len(parts & set(own[start : start + 2 * scale]))
                if n >= max(1, math.ceil(threshold * len(parts) - 1e-9)):
                    expected.add((i, label, start, min(len(own), start + 2 * scale), n / len(parts)))
    got = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), templates=templates, threshold=threshold, phrases=())
    found = {(r["doc_id"], b["label"], b["start"], b["end"], b["score"]) for r in got.collect() for b in r["blocks"]}
    assert expected and found == expected


def test_templates_are_bounded():
    with pytest.raises(ValueError):
        licenses.Templates([("a", " ".join(f"w{i}" for i in range(licenses.MOST_WORDS + 1)))])
    with pytest.raises(ValueError):
        licenses.Templates(threshold=0)
