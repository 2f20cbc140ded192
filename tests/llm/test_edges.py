"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusgauge.llm import bpe, lines, neighbours, packing, sampling, secrets, sharding, simhash, toxicity, urls
from corpusgauge.llm.queries import vocabulary

LONG = "word " * 200_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, a string, id string"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with extra columns named like the operators' own."""
    texts = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "x"), (5, " \t\n "), (6, LONG), (7, "A\r\nb\n\nAKIA" + "Z" * 20), (None, None)]
    return spark.createDataFrame([(i, t, None, None, None, 0.5, 1, "a", "i") for i, t in texts], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(spark, odd, empty):
    got = sharding.place(odd, F.col("doc_id"), ["a", "b", "c"], 101)
    assert got.count() == 9 and got.filter("shard is null").count() == 0
    assert sharding.place(empty, F.col("doc_id"), ["a"], 11).count() == 0
    owners = sharding.slot_owners(["a", "b", "c"], 101)
    assert sorted(np.bincount(owners)) == [33, 34, 34]
    without = sharding.slot_owners(["a", "b"], 101)
    moved = sum(o != w for o, w in zip(owners, without) if o != 2)
    assert moved <= 101 / 4  # of the slots that could have stayed
    heavy = np.bincount(sharding.slot_owners(["a", "b"], 101, {"a": 3}))
    assert heavy[0] in (75, 76)
    for bad in ((["a", "a"], 11), ([], 11), (["a"], 10)):
        with pytest.raises(ValueError):
            sharding.slot_owners(*bad)


def test_sharding_by_turns():
    """The table again, turn by turn with each shard's whole preference list written out."""
    import hashlib

    shards, slots = [f"s{i}" for i in range(7)], 211
    number = lambda n, salt: int.from_bytes(hashlib.sha256(f"{salt}:{n}".encode()).digest()[:8], "big")
    lists = [[(number(s, "offset") + j * (number(s, "step") % (slots - 1) + 1)) % slots for j in range(slots)] for s in shards]
    assert all(sorted(x) == list(range(slots)) for x in lists)
    table, turn = {}, 0
    while len(table) < slots:
        i = turn % len(shards)
        table[next(s for s in lists[i] if s not in table)] = i
        turn += 1
    assert sharding.slot_owners(shards, slots) == [table[s] for s in range(slots)]


def test_simhash(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got}
    assert len(got) == 9
    assert {by[k] for k in by if k[1] == "0" * 16} == {1}  # null, empty and blank texts, with and without id
    x = f"{simhash.fingerprint('x', 3):016x}"
    assert by[3, x] == by[None, x] == 3
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(odd)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 6, 7] and kept.columns == odd.columns
    assert simhash.one_of_each(empty).count() == 0


def test_simhash_in_blocks(spark):
    """Dense groups give the same components when anchors are split into tiny parts."""
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63, 5)
    fps = []
    for b in base.tolist():
        for _ in range(60):
            x = b & (1 << 64) - 1
            for bit in rng.choice(64, rng.integers(0, 6), replace=False).tolist():
                x ^= 1 << bit
            fps.append(x)
        # Only the sign bit of the column differs.
        fps.append((b & (1 << 64) - 1) ^ 1 << 63)
    fps = sorted(x - (x >> 63 << 64) for x in set(fps))
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "id long, f long")
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    for most in (1 << 14, 5):
        got = simhash.connected(rows, 3, most)
        assert {r["id"]: r["component_id"] for r in got.collect()} == {i: find(i) for i in range(len(fps))}


def test_neighbours(spark, empty):
    v = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]),
         (7, [float("inf"), 1.0]), (8, [2.0, 0.0]), (None, [1.0, 1.0])]
    rows = spark.createDataFrame([(i, x, 1) for i, x in v], "vec_id long, embedding array<double>, part int")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(rows, rows, k=3).collect()]
    assert sorted(got) == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 8, 1.0), (1, 1, 0, 0.0), (1, 2, 2, 0.0), (1, 3, 8, 1.0),
                           (2, 1, 0, 0.0), (2, 2, 1, 0.0), (2, 3, 8, 1.0), (8, 1, 0, 1.0), (8, 2, 1, 1.0), (8, 3, 2, 1.0)]
    none = rows.limit(0)
    assert neighbours.search(none, none).count() == 0


def test_neighbours_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    queries = rows.filter(F.col("vec_id") % 20 == 0)
    table = rows.toPandas()
    ids, points = table["vec_id"].to_numpy(), np.stack(table["embedding"].to_numpy()).astype(float)
    got = {}
    for r in neighbours.search(rows, queries, parts=8, block=300).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = 0
    for q, found in got.items():
        gap = ((points - points[ids == q][0]) ** 2).sum(axis=1)
        gap[ids == q] = np.inf
        hits += len(set(found) & set(ids[np.argsort(gap)[:10]].tolist()))
    assert len(got) == 100 and hits / 1000 >= 0.9


def all_nearest(vectors, k):
    """(query, rank, id) by all pairs of equal length."""
    out = []
    for i, v in vectors:
        near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in vectors if j != i and len(w) == len(v))
        out += [(i, r, j) for r, (_, j) in enumerate(near[:k], 1)]
    return sorted(out)


def test_neighbours_of_each_length(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=2 + (i % 3 == 0)).tolist()) for i in range(80)] + [(80, [1.0])]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = neighbours.search(rows, rows, k=4)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()) == all_nearest(vectors, 4)


def test_neighbours_beyond_small_parts(spark):
    """Parts with fewer candidates than asked for: the other parts are searched, so all candidates come that there are."""
    rng = np.random.default_rng(5)
    vectors = [(i, (rng.normal(size=4) * 0.01 + (100 if i < 6 else 0)).tolist()) for i in range(260)]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = neighbours.search(rows, rows.filter("vec_id < 6 or vec_id % 50 = 0"), k=10, parts=4, probes=1).collect()
    each = {q: sorted(r["rank"] for r in got if r["query_id"] == q) for q in {r["query_id"] for r in got}}
    assert set(each) == {*range(6), 50, 100, 150, 200, 250} and all(v == list(range(1, 11)) for v in each.values())
    few = rows.limit(5)
    assert neighbours.search(few, few, k=10).count() == 20


def test_fingerprints(spark, odd, empty):
    got = sampling.chain(odd).collect()
    assert len(got) == 9 and sorted(r["n_chars"] for r in got) == sorted([0, 0, 1, 1, 1, 4, len(LONG), 30, 0])
    same = {r["fingerprint"] for r in got if r["doc_id"] == 3}
    assert len(same) == 1
    assert sampling.chain(empty).count() == 0
    one = sampling.chain(odd.filter("doc_id = 7")).collect()
    assert one[0]["near_next"] == 1.0
    assert sampling.fingerprints(odd).count() == 9
    pair = spark.createDataFrame([(1, "a b c d e f g h", "a b c d e f g h"), (2, "a b c d e", "z y x w v")], "k int, x string, y string")
    marks = sampling.fingerprints(pair, "x", "k").join(sampling.fingerprints(pair, "y", "k").withColumnRenamed("fingerprint", "other"), "k")
    like = {r["k"]: r["l"] for r in marks.select("k", sampling.likeness_of("fingerprint", "other").alias("l")).collect()}
    assert like == {1: 1.0, 2: 0.0}


def test_sampling_follows_weights():
    """The share of equal draws is near the generalised Jaccard similarity, repeats included."""
    rng, off = np.random.default_rng(2), []
    for _ in range(40):
        a = rng.choice(20, 300).tolist()
        b = a[:200] + rng.choice(20, 200).tolist()
        grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        ta, tb = a * 2, b  # every shingle of a at least twice
        ca, cb = ({g: grams(t).count(g) for g in set(grams(t))} for t in (ta, tb))
        both = set(ca) | set(cb)
        true = sum(min(ca.get(g, 0), cb.get(g, 0)) for g in both) / sum(max(ca.get(g, 0), cb.get(g, 0)) for g in both)
        text = lambda t: " ".join(f"w{x}" for x in t)
        off.append(sampling.likeness(sampling.signature(text(ta)), sampling.signature(text(tb))) - true)
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.1


def test_urls(spark):
    day = lambda d: datetime.date(2024, 1, d)
    changes = spark.createDataFrame([
        ("l", "host", "a.example.org", day(5), True), ("l", "host", "a.example.org", day(9), False), ("m", "domain", "example.org", day(8), True),
        ("l", "path", "b.org/x/y", day(1), True), ("l", "host", None, day(1), True), ("l", "host", "c.org", None, True),
        ("l", "host", "a.example.org", day(5), False)], "list string, kind string, value string, day date, blocked boolean")
    rows = [(1, "http://A.example.org:80/p", day(4)), (1, "http://A.example.org:80/p", day(5)), (2, "https://u@a.example.org", day(9)),
            (3, "http://b.org/x//y/z?q#f", day(2)), (3, "http://b.org/x//y/z?q#f", day(2)), (4, None, day(2)), (5, "no url", day(2)),
            (6, "http://c.org/", None), (None, "http://b.org/x", day(2))]
    captures = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, fetched date, value string")
    got = sorted((r["page_id"] or 0, str(r["fetched"]), r["n_entries"], r["lists"], r["blocked"]) for r in urls.evaluate(captures, changes).collect())
    assert got == [(0, "2024-01-02", 0, "", False), (1, "2024-01-04", 0, "", False), (1, "2024-01-05", 1, "l", True),
                   (2, "2024-01-09", 1, "m", True), (3, "2024-01-02", 1, "l", True), (3, "2024-01-02", 1, "l", True),
                   (4, "2024-01-02", 0, "", False), (5, "2024-01-02", 0, "", False), (6, "None", 0, "", False)]
    assert urls.evaluate(captures.limit(0), changes.limit(0)).count() == 0


def test_secrets(spark, odd, empty):
    got = secrets.digest(secrets.find(odd, repository=F.col("source"), owner=F.col("source"))).collect()
    assert len(got) == 9 and sum(r["n_access"] for r in got) == 1
    assert secrets.find(empty).count() == 0
    many = "é " + "token: short, " * 700 + "API_KEY='abcdefghijkl' " + "0123456789abcdef " * 600
    shared = "secret=mnopmnopmnopmnop"
    docs = spark.createDataFrame(
        [(1, many, "o1"), (2, shared, "o1"), (3, shared, "o2"), (4, "x " + shared, "o3"), (5, "Tok3nWith" + "aB1" * 8 + " end", "o1"),
         (5, "Tok3nWith" + "aB1" * 8 + " end", "o1")], "doc_id long, text string, source string")
    found = {r["doc_id"]: r for r in secrets.digest(secrets.find(docs, repository=F.col("source"), owner=F.col("source"))).collect()}
    at = many.index("API_KEY")
    assert f"assign:{at}:{at + 21}" in found[1]["spans"] and found[1]["n_hex"] == 600 and found[1]["n_assign"] == 1
    last = many.rindex("0123456789abcdef")
    assert found[1]["spans"].endswith(f"hex:{last}:{last + 16}")
    assert found[2]["n_example"] == 1 and found[2]["n_live"] == 0
    assert found[5]["spans"] == "owned:0:33"
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs, repository=F.col("source"), owner=F.col("source")).collect()}
    assert clean[2] == shared and clean[5] == "<secret> end" and "abcdefghijkl" not in clean[1] and clean[1].startswith("é token: short")
    assert secrets.redact(odd).count() == 9 and secrets.redact(odd).columns == odd.columns


def test_repositories_and_owners_both_decide(spark):
    """A value of one owner in a dozen repositories is an example; spans tell both counts."""
    one, two = "secret=mnopmnopmnopmnop", "secret=qrstqrstqrstqrst"
    docs = spark.createDataFrame(
        [(i, one, "o", f"r{i}") for i in range(12)] + [(20 + i, two, "o", f"r{i}") for i in range(11)], "doc_id long, text string, o string, r string")
    found = secrets.find(docs, repository=F.col("r"), owner=F.col("o")).collect()
    judged = {r["doc_id"]: [(s["n_owners"], s["n_repositories"], s["live"]) for s in r["judged"]] for r in found}
    assert all(v == [(1, 12, False)] for d, v in judged.items() if d < 20) and all(v == [(1, 11, True)] for d, v in judged.items() if d >= 20)


def test_packing(odd, empty):
    got = packing.pack(odd, vocabulary()).collect()
    assert sum(r["length"] for r in got) == sum(r["doc_tokens"] for r in got if r["start"] == 0)
    assert {r["doc_tokens"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert packing.pack(empty, vocabulary()).count() == 0
    small = packing.pack(odd, vocabulary(), tiers=(4, 8), step=16, buffer=64).collect()
    assert max(r["window"] for r in small) == 8 and sum(r["length"] for r in small) == sum(r["length"] for r in got)
    with pytest.raises(ValueError):
        packing.pack(odd, vocabulary(), tiers=(3,))


def test_white_space_beyond_the_patterns():
    text = " " * 3_000_000 + "a"
    ids = packing.token_ids(text, vocabulary(), 1)
    assert bpe.encoder(vocabulary()).decode(ids[:-1].tolist()) == text


def test_step_groups_are_balanced():
    packer, rng = packing.Packer(), np.random.default_rng(0)
    for i, n in enumerate(rng.pareto(1, 20_000) * 100 + 1):
        packer.add(i, int(min(n, 50_000)))
    windows = packer.flush()
    steps = np.array(packer.steps(windows))
    cost = np.array([sum(p[2] ** 2 for p in w[1]) for w in windows])
    size = np.array([w[0] for w in windows])
    for tier in packing.TIERS:
        totals = np.bincount(steps[size == tier] - steps[size == tier].min(), weights=cost[size == tier])
        assert totals.max() <= 1.5 * totals.mean()


def test_lines(spark, odd, empty):
    got = lines.deduplicated(odd)
    assert got.count() == 9 and {"n_lines", "n_dropped", "kept"} < set(got.columns)
    assert {r["n_lines"] for r in got.filter("doc_id in (1, 2)").collect()} == {1}
    assert lines.deduplicated(empty).count() == 0
    same = "This line is in several documents "
    docs = spark.createDataFrame([(1, same + "\nb"), (2, "\t" + same.upper()), (3, same), (None, same + "\n" + same), (3, same)], "doc_id long, text string")
    kept = sorted(((r["doc_id"] or 0), r["n_dropped"], r["kept"]) for r in lines.deduplicated(docs).collect())
    assert kept == [(0, 2, ""), (1, 1, "b"), (2, 1, ""), (3, 0, same), (3, 0, same)]


def test_runs_are_merged_and_anti_joined(spark):
    """A key is in one run, that of its largest id; runs are compacted and anti-joined without an exchange."""
    batches = [[(k, 20 - b) for k in range(b, 6)] + [(10 + b, 20 - b)] for b in range(5)]
    with lines.Runs(spark) as runs:
        for rows in batches:
            runs.add(spark.createDataFrame([(k, k, i) for k, i in rows], "a long, b long, doc_id long"))
        assert [len(level) for level in runs.levels] == [1, 0, 1]
        held = [{r["a"]: r["keeper"] for r in run.collect()} for run in runs.all()]
        assert sum(map(len, held)) == len(held[0] | held[1]) == 11
        every = [row for rows in batches for row in rows]
        expected = {k: (sum(x == k for x, _ in every), max(i for x, i in every if x == k)) for k in {k for k, _ in every}}
        for least in (1, 3, 5):
            assert {r["a"]: r["keeper"] for r in runs.common(least).collect()} == {k: i for k, (n, i) in expected.items() if n >= least}
        one, two = runs.all()
        for joined in (lines.merged(one, two), one.join(two.hint("merge"), ["a", "b"], "left_anti")):
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
        tables = list(runs.tables)
    assert tables and not any(spark.catalog.tableExists(t) for t in tables)


def test_lines_of_long_texts_and_names(spark):
    """Work grows with a document's lines; the operator's column names may be in the input."""
    import time

    took = []
    for n in (20_000, 20_000, 80_000):
        text = "\n".join(f"this is line number {i} of a long text" for i in range(n))
        docs = spark.createDataFrame([(i, text, 1, "k", [1], 2) for i in range(3)], "doc_id long, text string, n_lines int, kept string, gone array<int>, text_key int")
        start = time.time()
        got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["gone"], r["text_key"]) for r in lines.deduplicated(docs).collect()}
        took.append(time.time() - start)
        assert got == {0: (n, n, [1], 2), 1: (n, n, [1], 2), 2: (n, 0, [1], 2)}
    assert took[2] < 5 * took[1]


def test_repeated_ids_lose_their_own_lines(spark):
    line = "a line that stands in several texts"
    docs = spark.createDataFrame([(1, f"x\n{line}"), (1, f"{line}\ny\n{line.upper()}"), (2, line), (2, line)], "doc_id long, text string")
    kept = sorted((r["doc_id"], r["n_dropped"], r["kept"]) for r in lines.deduplicated(docs).collect())
    assert kept == [(1, 1, "x"), (1, 2, "y"), (2, 0, line), (2, 0, line)]


def test_bpe(odd, empty):
    got = bpe.encode_decode(odd, vocabulary()).collect()
    assert sorted(r["decoded"] for r in got) == sorted((r["text"] or "") for r in odd.collect())
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert bpe.digest(empty, vocabulary()).count() == 0


def test_bpe_on_every_code_point():
    import public_tokenizers
    from tokenizers import Tokenizer

    library, coder = Tokenizer.from_file(vocabulary()), bpe.encoder(vocabulary())
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} '{chr(c)}s  {chr(c)}1 " for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    texts += ["<|endoftext|>", " <|endoftext|>\n <|endoftext|", "a  \n b   ", "\t a", "a " * 3, "x" * 3000, "=-" * 700]
    for text, ids in zip(texts, coder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_toxicity(spark, odd, empty):
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, f"plain words number {i % 7}" + (" awful nasty" if i % 5 == 0 else "")) for i in range(200)], "doc_id long, text string")
    got = toxicity.score(docs, labels).collect()
    assert all(r["predicted"] == (r["doc_id"] % 5 == 0) for r in got)
    model = toxicity.train(docs, labels)
    assert odd.withColumn("score", toxicity.scores(odd, model)).filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(odd, labels.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity.score(empty, labels).count() == 0
    long = "fine " * 300_000 + "awful nasty"
    grams = toxicity.Grams()
    assert set(grams.distinct("abcdef")) == set(grams.hashed("abcdef")) and model.score(grams.distinct(long)) > model.score(grams.distinct("fine " * 300_000))


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "secret_scan", "packing"]
    rows, before = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = corpus_pipeline.written(stage(spark, rows, folder), name)
        assert rows.columns == docs.columns and 0 < rows.count() <= before
        before = rows.count()
    got = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} == {r["doc_id"] for r in rows.collect()}


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_on_odd_rows(spark, odd, empty, stage):
    folder, columns = "/root/testdata/sf0.001", ["doc_id", "text", "lang", "source", "n_chars"]
    step = corpus_pipeline.STAGES[stage][1]
    for rows in (odd.select(columns), empty.select(columns)):
        got = step(spark, rows, folder)
        got.collect()
        assert stage == 4 or got.columns == columns


def test_one_of_each_group_of_near_duplicates(spark):
    """The stage keeps the smallest id of each group that all pairs of fingerprints give, and one of repeated rows."""
    rng, texts = np.random.default_rng(9), []
    words = [f"w{i}" for i in range(5000)]
    for _ in range(60):
        base = rng.choice(words, 300).tolist()
        texts.append(" ".join(base))
        for n in (0, 1, 2, 6, 40):
            copy = list(base)
            for at in rng.choice(300, n, replace=False):
                copy[at] = f"edit{rng.integers(1 << 40)}"
            texts.append(" ".join(copy))
    fps, root = [simhash.fingerprint(str(t), 3) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    expected = sorted({find(i) for i in range(len(texts))})
    docs = spark.createDataFrame([(i, str(t)) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == expected and 60 < len(expected) < 250
    kept = corpus_pipeline.without_near_copies(spark, docs, None)
    assert sorted(r["doc_id"] for r in kept.collect()) == expected
