import json
import zipfile

import pytest
from pyspark.sql import functions as F

from prismark.operators import alignment, allocation, audit, prompts, selection
from prismark.plans import selection_queries
from prismark.sources import packages, records
from prismark.streaming import scoring


def test_quotas():
    assert allocation.largest_remainder({"a": 1, "b": 1, "c": 0}, 3) == {"a": 2, "b": 1, "c": 0}
    assert allocation.capped_quotas({"a": 0.5, "b": 0.5}, 8, {"a": 2, "b": 10}) == {"a": 2, "b": 6}
    with pytest.raises(ValueError):
        allocation.capped_quotas({"a": 0.5, "b": 0.5}, 8, {"a": 2, "b": 10}, strict=True)
    with pytest.raises(ValueError):
        allocation.capped_quotas({"a": 1}, 5, {"a": 4})


def test_assignment_meets_quotas_or_says_why():
    options = {f"g{i}": ["a"] if i % 3 else ["a", "b", "c"] for i in range(12)}
    given = allocation.assign_one_each(options, {"a": 8, "b": 2, "c": 2}, "t")
    assert sorted(given) == sorted(options) and all(given[g] in options[g] for g in options)
    assert [list(given.values()).count(t) for t in "abc"] == [8, 2, 2]
    with pytest.raises(ValueError, match="no assignment"):
        allocation.assign_one_each(options, {"a": 7, "b": 3, "c": 2}, "t")


def test_greedy_and_panels():
    rows = [(f"r{i:02d}", "ab"[i % 2], f"c{i // 3}") for i in range(24)]
    ids = allocation.greedy_selection(rows, {"a": 6, "b": 6}, 2)
    chosen = [r for r in rows if r[0] in ids]
    assert len(set(ids)) == 12 and [sum(r[1] == t for r in chosen) for t in "ab"] == [6, 6]
    assert max([r[2] for r in chosen].count(c) for c in {r[2] for r in rows}) <= 2
    with pytest.raises(ValueError):
        allocation.greedy_selection(rows, {"a": 12, "b": 12}, 1)
    sizes = {f"g{i}": 1 + i % 4 for i in range(10)}
    assert sum(sizes[g] for g in allocation.exact_panel(sizes, 11)) == 11
    with pytest.raises(ValueError):
        allocation.exact_panel({"a": 2, "b": 2}, 3)


def test_nested_slots():
    options = {f"g{i}": ["a", "b", "c"] for i in range(9)}
    first, second = allocation.nested_slots(options, {"a": 1, "b": 1, "c": 1}, 2, "n")
    assert all(first[g] != second[g] for g in options) and sorted(first.values()).count("a") == 3


def test_allocators_take_all_records(spark, tmp_path):
    docs = [(i, "t", f"s{i % 13}", ["en", "de", "fr", "es"][i // 13 % 4], 1) for i in range(3000)]
    # Only one record offers a second task, and two are the only ones, of their entity.
    docs += [(3000, "t", "odd", "en", 1), (3001, "t", "odd", "de", 1)]
    sf = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    rows = [(str(d), lang, f"{source}_{lang}") for d, _, source, lang, _ in docs]
    assert {r.entity for r in selection_queries.flow_assignment(spark, sf).collect()} == {d[2] for d in docs}
    nested = [(r.task, r.slot) for r in selection_queries.nested_selection(spark, sf).collect() if r.entity == "odd"]
    assert {t for t, _ in nested} == {"en", "de"} and len(nested) == 2
    panels = selection_queries.disjoint_panels(spark, sf).collect()
    assert sorted(r.id for r in panels) == sorted(r[0] for r in rows) and sum(r.panel == 1 for r in panels) == len(rows) // 2
    assert len({(r.chart, r.panel) for r in panels}) == len({r.chart for r in panels})
    quotas = allocation.capped_quotas(dict.fromkeys(["de", "en", "es", "fr"], 1.0), 60, dict.fromkeys(["de", "en", "es", "fr"], 100))
    whole = allocation.greedy_selection(rows, quotas, 3)
    assert [r.id for r in selection_queries.greedy_selection(spark, sf).orderBy("position").collect()] == whole


def test_splits_cover_every_stratum(spark):
    rows = spark.range(60).select(F.col("id"), (F.col("id") % 4).alias("s"))
    split = selection.stratified_split(rows, ["s"], (0.8, 0.1), "t", "id")
    assert {r.s: r.n for r in split.groupBy("s").agg(F.countDistinct("split").alias("n")).collect()} == dict.fromkeys(range(4), 3)


def test_alignment(spark):
    a = spark.createDataFrame([(1, "x", "p"), (2, "y", "q")], "id int, ref string, out string")
    pairs = alignment.align(a, a.withColumn("out", F.lit("z")), "id", ["ref"]).collect()
    assert sorted((r.b.out, r.c.out) for r in pairs) == [("p", "z"), ("q", "z")]
    for other in (a.withColumn("ref", F.lit("no")), a.filter("id = 1"), a.unionByName(a)):
        with pytest.raises(ValueError):
            alignment.align(a, other, "id", ["ref"])
    done = spark.createDataFrame([(1,), (9,)], "id int")
    row = alignment.resume_prefix(a.withColumn("h", F.col("ref")), done, "id", "h").first()
    assert (row.n_done, row.prefix_length, row.n_unknown) == (1, 1, 1)


def test_decontamination(spark):
    train = spark.createDataFrame([(1, "k1"), (2, "k2"), (3, "k2"), (4, None)], "id int, k string")
    clean, removed = audit.decontaminate(train, spark.createDataFrame([("k2",), ("k2",)], "k string"), "k")
    assert sorted(r.id for r in clean.collect()) == [1, 4] and sorted(r.id for r in removed.collect()) == [2, 3]
    texts = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "say hello"), (3, "a b c d e f g h x"), (4, "")], "id int, t string")
    passages = spark.createDataFrame([(7, "b c d e f g h i"), (8, "hello"), (9, " ")], "item_id int, p string")
    assert sorted((r.id, r.item_id) for r in audit.contained_passages(texts, "t", passages, "p").collect()) == [(1, 7), (2, 8)]


def test_passages_glued_to_other_text(spark):
    needles = ["b c d e f g h i", "k l m n o p q r s t u", "x y z", "hello", "two words", "\u4f60\u597d", "q", "\nv w x y", "  pad  "]
    glue = ["", " ", "\u201c", "(", ".", ",", "\u4f60", "\n", "ab"]
    texts = [f"{g}{n}{h}" for n in needles for g in glue for h in glue] + [f"{n} cut"[1:] for n in needles] + ["", None, "  "]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    passages = spark.createDataFrame([*enumerate(needles), (90, " "), (91, None)], "item_id int, p string")
    want = {(i, k) for i, t in enumerate(texts) for k, n in enumerate(needles) if t and n.strip(" ") in t}
    got = [(r.id, r.item_id) for r in audit.contained_passages(rows, "t", passages, "p").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert audit.contained_passages(rows, "t", passages.limit(0), "p").count() == 0


def test_prompts(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "why?"), (2, 0, "user", None)], "conv_id int, turn int, role string, text string")
    got = {r.conv_id: r.prompt for r in prompts.flatten_conversation(turns).collect()}
    assert got == {1: "Conversation history:\nUser: hi\nAssistant: yes\n\nwhy?", 2: ""}


def test_sources(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": "a", "metadata": {"scenario": "s"}}\n\n{"id": "b"}\n', encoding="utf-8")
    rows = records.read_jsonl(spark, str(tmp_path / "r.jsonl"))
    assert [(r.id, r.metadata and r.metadata.scenario) for r in rows.orderBy("id").collect()] == [("a", "s"), ("b", None)]
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n[1]\nnope\n', encoding="utf-8")
    assert records.damaged_lines(spark, str(tmp_path / "bad.jsonl")).count() == 2
    (tmp_path / "t.tsv").write_text("﻿index\tanswer\n1\tx\n", encoding="utf-8")
    assert records.read_tsv(spark, str(tmp_path / "t.tsv"), ["index", "answer"]).collect()[0].answer == "x"
    with pytest.raises(ValueError):
        records.read_tsv(spark, str(tmp_path / "t.tsv"), ["index"])
    rows = spark.createDataFrame([("a", "train"), ("a", "val")], "id string, split string")
    with pytest.raises(ValueError):
        records.assert_contract(rows, key="id")
    both = records.union_sources([{"name": "x", "df": rows.dropDuplicates(["id"]), "key": "id", "repeat": 2}, {"name": "y", "df": rows, "key": "id", "max_rows": 1}])
    assert sorted(r.source_name for r in both.collect()) == ["x", "x", "y"]


def test_packages(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"a": {"x": 1, "y": [1]}, "b": 2}))
    (tmp_path / "top.json").write_text(json.dumps({"extends": "base.json", "a": {"y": [2]}}))
    config = packages.load_config(tmp_path / "top.json")
    assert config == {"a": {"x": 1, "y": [2]}, "b": 2} and packages.require(config, "a.x") == 1
    (tmp_path / "base.json").write_text(json.dumps({"extends": "top.json"}))
    with pytest.raises(ValueError):
        packages.load_config(tmp_path / "top.json")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("ok.txt", "1")
        z.writestr("../out.txt", "2")
    with pytest.raises(ValueError):
        packages.extract_zip(tmp_path / "bad.zip", tmp_path / "to")
    assert not (tmp_path / "to").exists() and not packages.safe_name("C:/x") and packages.safe_name("a/b.png")


def test_streams_score_each_id_once(spark, tmp_path):
    rows = spark.createDataFrame([("1", "5", "5"), ("2", "5", "5.1"), ("2", "5", "5.1")], "id string, answer string, prediction string")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        scoring.score_stream(spark, str(tmp_path / "in"), "id string, answer string, prediction string", str(tmp_path / "out"), str(tmp_path / f"check{_}")).awaitTermination()
    got = {r.id: (r.exact, r.relaxed) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"1": (1.0, 1.0), "2": (0.0, 1.0)} and spark.read.parquet(str(tmp_path / "out")).count() == 2
