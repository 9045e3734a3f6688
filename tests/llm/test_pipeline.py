import os
import random

import pytest

from prismark.llm.queries import QUERIES
from tests.llm.test_jaccard import brute_force

corpus_pipeline = pytest.importorskip("corpus_pipeline")
WORDS = {"xx": ["kal", "rom", "tis", "ven", "dol", "mir"], "yy": ["ooru", "iepa", "uulo", "aeki", "eeno", "oila"]}
STAGES = dict(corpus_pipeline.STAGES)


def corpus(seed=11, n=500):
    """(doc_id, text, lang), toxic labels: two languages, insults, near copies, and odd rows."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        words = [rng.choice(WORDS[lang]) + rng.choice(WORDS[lang]) for _ in range(rng.randint(20, 90))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(5):
                words.insert(rng.randrange(len(words)), rng.choice(["zzidiotix", "moronsky", "scumbagg"]))
        elif rows and rng.random() < 0.3:
            words = rows[rng.randrange(len(rows))][1].split()
            toxic = any(w in ("zzidiotix", "moronsky", "scumbagg") for w in words)
            if len(words) > 3:
                words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(toxic)))
    odd = [(9001, None, "xx"), (9002, "", None), (9003, "12 34 !!", None), (9004, "kalrom tisven " * 150_000, "xx"), (None, "kalrom venmir dol", "xx"), (3, rows[3][1], "xx"), (4, "oilaeeno uulo aekiooru iepa", "yy")]
    return rows + odd, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, labels = corpus()
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    # Columns whose names the stages use themselves.
    own = ["toxicity", "lang_pred", "lang_score", "key", "n", "root", "sequence_id", "piece"]
    docs = spark.createDataFrame([(*r, *[f"{c}{r[0]}" for c in own]) for r in rows], "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in own))
    docs.repartition(4).write.parquet(f"{folder}/documents.parquet")
    return str(folder), rows, dict(labels)


def _kept(spark, tables, name):
    folder, rows, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = STAGES[name](spark, docs, folder)
    assert out.columns == docs.columns and STAGES[name](spark, docs.limit(0), folder).count() == 0
    found = out.collect()
    assert all(r[c] == f"{c}{r.doc_id}" for r in found for c in docs.columns[3:])
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in found)


def test_toxicity_stage(spark, tables):
    kept = _kept(spark, tables, "toxicity")
    insults = {"zzidiotix", "moronsky", "scumbagg"}
    want = sorted((-1 if d is None else d, t or "") for d, t, _ in tables[1] if not insults & set((t or "").split()))
    assert len(set(kept) ^ set(want)) <= 0.02 * len(want) and len(kept) >= 0.98 * len(want)
    assert {(9001, ""), (9002, ""), (9003, "12 34 !!")} <= set(kept)


def test_language_stage(spark, tables):
    kept = _kept(spark, tables, "language")
    assert kept == sorted((-1 if d is None else d, t) for d, t, _ in tables[1] if t and any(c.isalpha() for c in t))


def test_near_duplicates_stage(spark, tables):
    kept = _kept(spark, tables, "near_duplicates")
    rows = [(d, t) for d, t, _ in tables[1]]
    classes = brute_force([(i, t) for i, (d, t) in enumerate(rows) if d is not None])
    least = {}
    for i, (_, root) in classes.items():
        least[root] = min(rows[i][0], least.get(root, 1 << 60))
    assert kept == sorted((-1 if d is None else d, t or "") for i, (d, t) in enumerate(rows) if d is None or least[classes[i][1]] == d)


def test_packing_stage(spark, tables):
    folder, rows, _ = tables
    packed = STAGES["packing"](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()
    ends, total = {}, 0
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
        total += r.length
    assert max(ends.values()) <= 1024 and len(ends) <= total / 1024 * 1.02 + 1
    assert sum(r.piece == 0 for r in packed) == len(rows)


def test_whole_run_equals_its_stages(spark, tables):
    folder, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
    want = sorted(((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in STAGES["packing"](spark, docs, folder).collect()))
    assert sorted(((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect())) == want


def test_every_dealt_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are absent")
def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, kept, sf).cache()
        assert kept.columns == docs.columns, name
        assert 0.6 * before.count() <= kept.count() <= before.count()
    assert kept.select("text").distinct().count() == kept.count()
    toxic = docs.join(spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1"), "doc_id")
    assert toxic.join(kept, "doc_id").count() <= 0.2 * toxic.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert packed.select("doc_id").distinct().count() == kept.count()
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name
        empty = docs.limit(0)
