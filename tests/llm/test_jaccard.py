import random
import re
import time

import numpy as np
import pytest

from pyspark.sql import functions as F

from prismark.llm import jaccard, store

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_force(rows, num=80, den=100):
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.55 and rows:
            words = rng.choice(rows).split()
            for _ in range(rng.randrange(0, 4)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = rng.choices(vocabulary, k=rng.choice([0, 1, 3, 4, 5, 6, 40, 80, 200]))
            if kind > 0.8:
                words = passage + words
        rows.append(" ".join(words))
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(spark, seed, monkeypatch):
    rows = corpus(seed) + [(1000, None), (1001, "  \t "), (1002, "One TWO three"), (1003, "one two\nTHREE"), (1004, "é É x y z"), (1005, "É é x y z")]
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)  # large clusters take several blocks
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, key int, root string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(docs).collect()}
    assert got == brute_force(rows)


@pytest.mark.parametrize("seed", range(2))
def test_small_buckets_blocks_and_many_partitions(spark, seed, monkeypatch):
    for name, value in {"TASK_ENTRIES": 150, "BUCKET_ENTRIES": 100, "BLOCK_SETS": 4, "BLOCK_SHINGLES": 400, "LARGE_BLOCKS": 2, "BROADCAST_IDS": 3, "LOT": 4}.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus(50 + seed, 220)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3 + 2 * seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(docs).collect()}
    assert got == brute_force(rows)


def test_chain_between_sizes_of_another_partition(spark):
    # L and B have J = 0.80 and share one rare shingle; sets of other sizes beside L hold it too.
    def text(name, n, *more):
        return " ".join([*more, *(f"{name}{i}" for i in range(n))])

    shared = [f"s{i}" for i in range(84)]
    first = [(1, " ".join(shared) + " " + text("u", 20))] + [(10 + n, text(f"d{n}_", n - 1, *shared[:5])) for n in (60, 74, 90, 110, 130)]
    other = [(18, " ".join(shared))]
    filler = [(1000 + k, " ".join(shared[1:]) + " " + text(f"f{k}_", 300)) for k in range(6)]  # all shared shingles but one are common
    docs = spark.createDataFrame(spark.sparkContext.parallelize([first, other, filler], 3).flatMap(list), "doc_id long, text string")
    rows = first + other + filler
    want = brute_force(rows)
    assert want[18] == (80, 1)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(docs).collect()} == want


def test_a_very_long_text_and_its_copy(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(900_000)]  # longer than a slice
    rows = [(2, " ".join(words)), (5, " ".join(words[:-90_000])), (7, " ".join(words[:-200_000])), (9, "short text of five words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(docs).collect()}
    assert got == {2: (len({tuple(words[i : i + 5]) for i in range(len(words) - 4)}), 2), 5: (got[5][0], 2), 7: (got[7][0], 2), 9: (1, 9)}


def test_one_of_each_group(spark):
    text, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, text + " x"), (2, text), (2, other), (2, text), (3, other + " y"), (None, text), (4, None), (5, ""), (1, text + " x")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, key long").repartition(3)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, text + " x"), (1, text + " x"), (2, other), (0, text), (4, ""), (5, "")])
    assert jaccard.one_of_each(docs.limit(0)).count() == 0


def test_copies_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "a b c d e f") for i in range(9, 0, -1)], "doc_id long, text string")
    assert {(r.n_shingles, r.component_id) for r in jaccard.similarity_classes(docs).collect()} == {(2, 1)}
    assert jaccard.similarity_classes(docs.limit(0)).count() == 0
    text, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    odd = spark.createDataFrame([(1, text + " x"), (2, text), (2, other), (2, text), (3, other + " y"), (None, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.similarity_classes(odd).collect()) == [(1, 1), (2, 1), (2, 1), (2, 2), (3, 2)]


def test_sizes_inside_a_chain_of_another_task(spark):
    hot = [f"w{i}" for i in range(5)]
    tail = [f"w{i}" for i in range(5, 12)]
    fill = {n: [f"f{n}_{i}" for i in range(n - 1)] for n in (7, 8, 11, 12)}
    # Long texts make all shared shingles but the hot one common, so that prefixes hold only that.
    long = [sum((hot[1:] + f for f in [tail, *fill.values()]), []) + [f"u{k}_{i}" for i in range(200)] for k in range(12)]
    first = [hot + fill[7], hot + fill[8], hot + tail + ["x"], hot + fill[11], hot + fill[12]]
    parts, rows = [], []
    for part in (first, [hot + tail + ["y"]], long):
        parts.append([(len(rows) + i, " ".join(words)) for i, words in enumerate(part)])
        rows += parts[-1]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(parts, 3).flatMap(list), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(docs).collect()}
    assert got == brute_force(rows)
    assert got[5] == (9, 2)


@pytest.mark.parametrize("seed", range(5))
def test_kept_members_join_what_whole_chains_join(seed):
    rng = np.random.default_rng(seed)
    n = np.sort(np.exp(rng.uniform(0, 9, 240)).astype(np.int64) + 1)
    key, task = np.arange(240), rng.integers(0, 3, 240)

    def roots(edges):
        root = list(range(240))
        for a, b in edges:
            old, new = root[a], root[b]
            root = [new if r == old else r for r in root]
        return [root.index(r) for r in root]

    edges, rest = [], []
    for t in range(3):
        a, b, kept = jaccard._chain(np.ones((task == t).sum(), np.uint64), key[task == t], n[task == t], 80, 100)
        edges += zip(a, b)
        rest += key[task == t][kept].tolist()
    rest = np.sort(rest)
    edges += zip(*jaccard._chain(np.ones(len(rest), np.uint64), rest, n[rest], 80, 100)[:2])
    whole = zip(*jaccard._chain(np.ones(240, np.uint64), key, n, 80, 100)[:2])
    assert roots(edges) == roots(whole)


@pytest.mark.parametrize("seed", range(6))
def test_adaptive_prefixes_lose_no_link(seed):
    rng = np.random.default_rng(seed)
    base = np.unique(rng.integers(0, 2**52, 90).astype(np.uint64))
    sets = []
    for _ in range(60):
        keep = base[rng.random(len(base)) < rng.uniform(0.7, 1)]
        sets.append(np.unique(np.concatenate((keep, rng.integers(0, 2**52, rng.integers(0, 12)).astype(np.uint64)))))
    keys = np.arange(60)

    def roots(edges):
        root = list(range(60))
        for a, b in edges:
            old, new = root[a], root[b]
            root = [new if r == old else r for r in root]
        return [root.index(r) for r in root]

    pairs = [(a, b) for a in range(60) for b in range(a) if 100 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    assert roots(jaccard.link_sets(keys, sets, np.zeros(60, int), 80, 100)) == roots(pairs)
    side = np.arange(60) % 2
    crossing = [(a, b) for a, b in pairs if side[a] != side[b]]
    assert roots(jaccard.link_sets(keys, sets, side, 80, 100)) == roots(crossing)


def test_guests_that_meet_in_the_block_of_one_are_compared(spark):
    x, y = np.arange(100, dtype=np.uint64), np.arange(5, 105, dtype=np.uint64)
    rows = [(0, 7, 1, 1, jaccard._packed(x)), (0, 7, 1, 0, jaccard._packed(x)), (0, 7, 2, 1, jaccard._packed(y)), (0, 7, 3, 0, jaccard._packed(x + np.uint64(1000)))]
    for order in (rows, rows[::-1]):
        dealt = spark.createDataFrame(order, "block int, root long, node long, side long, hashes binary").coalesce(1)
        assert [tuple(r) for r in jaccard._compared(dealt, 80, 100, "block").collect()] == [(1, 2)]


def _edges(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3, "doc_id")
    with jaccard.Steps(spark) as steps:
        rows = jaccard.set_rows(docs).cache()
        keys = {r.key: r.doc_id for r in rows.filter("doc_id is not null").collect()}
        counters = spark.sparkContext.broadcast(jaccard.shingle_counters(steps, rows))
        return sorted(tuple(sorted((keys[r.a], keys[r.b]))) for r in jaccard.cluster_edges(docs, rows, counters, 80, 100).collect())


def test_texts_that_share_a_rare_shingle_by_chance_have_no_edge(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_cells", lambda hashes: np.zeros(len(hashes), np.int64))  # counters that tell nothing
    words = lambda i, n: [f"w{i}x{k}" for k in range(n)]
    # Text i shares five words with text i + 1, and so one shingle.
    texts = [" ".join([*(f"s{i}x{k}" for k in range(5)), *words(i, 3), *(f"s{i + 1}x{k}" for k in range(5))]) for i in range(40)]
    near = [" ".join(words("near", 60)), " ".join([*words("near", 59), "other"])]
    short = ["a b c d e f g h i j", "a b c d e f g h i j k"]
    assert _edges(spark, texts + near + short) == [(40, 41), (42, 43)]
    assert {tuple(r) for r in jaccard.similarity_classes(spark.createDataFrame(list(enumerate(texts + near + short)), "doc_id long, text string")).select("doc_id", "component_id").collect() if r[0] != r[1]} == {(41, 40), (43, 42)}


def test_only_sets_of_large_clusters_are_written(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    base = [f"b{k}" for k in range(200)]
    large = [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(24)]
    small = [" ".join(f"s{i // 2}y{k}" for k in range(100 + i % 2)) for i in range(20)]
    seen = {}

    def table(self, df, tag, kept=False, f=jaccard.Steps.table):
        out = f(self, df, tag, kept)
        seen[tag] = out.count()
        return out

    monkeypatch.setattr(jaccard.Steps, "table", table)
    got = jaccard.similarity_classes(spark.createDataFrame(list(enumerate(large + small)), "doc_id long, text string")).select("doc_id", "component_id").collect()
    assert {r.doc_id: r.component_id for r in got} == {i: 0 if i < 24 else i - i % 2 for i in range(44)}
    assert seen["cluster-sets"] == 24


def test_small_clusters_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 40)
    rows = corpus(71, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    dealt, compared = [], jaccard._compared
    monkeypatch.setattr(jaccard, "_compared", lambda sets, num, den, *by: dealt.append(by) or compared(sets, num, den, *by))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(docs).collect()} == brute_force(rows)
    assert dealt.count(("bin",)) > 1


def test_visits_in_rounds(spark, monkeypatch):
    for name, value in {"BLOCK_SETS": 4, "ROUND_SHINGLES": 1, "SMALL_ROUNDS": 1, "PIVOTS": 1, "ROUNDS": 1}.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus(72, 90)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    dealt, compared = [], jaccard._compared
    monkeypatch.setattr(jaccard, "_compared", lambda sets, num, den, *by: dealt.append(by) or compared(sets, num, den, *by))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(docs).collect()} == brute_force(rows)
    assert dealt.count(("root", "block", "lot")) > 1


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = files()
    table = store.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), str(tmp_path / "counts"))
    deadline = time.time() + 5
    while files() - before and time.time() < deadline:
        time.sleep(0.1)
    assert not files() - before
    assert table.agg(F.sum("count")).first()[0] == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
