import hashlib
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from prismark.functions.rewards import TRUTH
from prismark.operators import allocation, selection, subsets, validation
from prismark.operators.rollouts import array_hash
from prismark.sources import adapters, artifacts, packages

ROLLOUT = "rollout_key string, record_id string, prompt_token_ids_sha256 string, completion_token_ids_sha256 string, round int, rollout_index int, prompt_token_ids array<int>, completion_token_ids array<int>"


def test_class_flow():
    sizes = {("a", "b"): 5, ("b",): 3, ("a", "c"): 4}
    given = allocation.class_flow(sizes, {"a": 4, "b": 6, "c": 2})
    assert {c: sum(t.values()) for c, t in given.items()} == sizes
    assert {t: sum(g.get(t, 0) for g in given.values()) for t in "abc"} == {"a": 4, "b": 6, "c": 2}
    with pytest.raises(ValueError):
        allocation.class_flow(sizes, {"a": 10, "b": 2, "c": 0})
    with pytest.raises(ValueError):
        allocation.class_flow(sizes, {"a": 1})


def test_positions_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(selection, "RANGE_ROWS", 50)
    rows = spark.createDataFrame([(f"k{i:05d}",) for i in range(700)], "k string").repartition(7)
    assert sorted((r.k, r.at) for r in selection.positions(rows, "k").collect()) == [(f"k{i:05d}", i) for i in range(700)]
    assert selection.positions(rows.limit(0), "k").count() == 0


def test_small_sets_split_globally(spark):
    rows = spark.createDataFrame([(i,) for i in range(20)], "id int")
    counts = {r[0]: r[1] for r in selection.global_split(rows, (0.8, 0.1), "s", "id").groupBy("split").count().collect()}
    assert counts == {"train": 16, "val": 2, "test": 2}
    with pytest.raises(ValueError):
        selection.global_split(rows, (0.8, 0.1), "s", "id", small=20)


def test_too_few_rows_for_a_quota(spark):
    rows = spark.createDataFrame([("a", 1)], "task string, id int")
    with pytest.raises(ValueError):
        selection.task_quota_sample(rows, "task", spark.createDataFrame([("a", 2)], "task string, quota int"), "n", "id")


def test_panels_share_no_image(spark):
    rows = spark.createDataFrame([(f"r{i}", f"i{i // 3}") for i in range(12)], "id string, image string")
    first, second = subsets.disjoint_panels(rows, "image", 6)
    assert first.count() == 6 and subsets.no_overlap(first, second) == {"id": 0, "image": 0}
    with pytest.raises(ValueError):
        subsets.disjoint_panels(rows, "image", 5)
    with pytest.raises(ValueError):
        subsets.no_overlap(rows, first)


def test_adapters_refuse_damaged_rows(spark):
    schema = "source_index int, image string, image_sha256 string, Question array<string>, Answer array<string>, Year array<string>, `Question Type` string, Paragraph string"
    good = (1, "x.png", "ab" * 32, ["q1", " q2 "], ["a1", " a2"], ["no", "YES"], None, " p ")
    records, quality = adapters.list_answers(spark.createDataFrame([good], schema))
    made = adapters.checked(records).first()
    assert made.question == "Context: p\nQuestion: Conversation history:\nUser: q1\nAssistant: a1\nCurrent question: q2" and made.answer == "a2" and made.metadata.question_type == "unknown"
    assert quality.first().after_records == 1
    for bad in ((1, "x", "y", ["q"], ["a", "b"], ["NO"], None, None), (1, "x", "y", [], [], ["NO"], None, None), (1, "x", "y", ["q"], ["a"], ["MAYBE"], None, None), (1, "x", "y", ["q"], ["a"], [], None, None)):
        with pytest.raises(ValueError):
            adapters.list_answers(spark.createDataFrame([bad], schema))
    table = spark.createDataFrame([("0", "a.png", "t", "s", "c", "q", "a", None), ("2", "b.png", "t", "s", "c", "q", "a", None)], ", ".join(f"{c} string" for c in adapters.FINANCE_COLUMNS))
    lookup = spark.createDataFrame([("a.png", "i/a.png", "h"), ("b.png", "i/b.png", "h")], "suffix string, image string, sha256 string")
    with pytest.raises(ValueError):
        adapters.finance_answers(table, lookup, 2)
    paths = ["a/b.png", "/a", "../a", "a/../b", "C:\\x", "", "a..b"]
    assert [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(adapters.path_is_safe(F.col("p"))).collect()] == [True, False, False, False, False, False, True]


def test_public_truth(spark):
    rows = spark.createDataFrame([(["1,200%", "x"],), (["north"],)], "a array<string>").select(adapters.public_truth(F.col("a")).alias("t")).collect()
    assert rows[0].t.numeric_targets[0].value == 1200.0 and rows[0].t.numeric_targets[0].tolerance == 60.0 and rows[0].t.answer_aliases == ["1,200%", "x"]
    assert rows[1].t.numeric_targets == [] and rows[1].t.length_range == [1, 160]


def png(width=2, height=2, colour=2):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    samples = {0: 1, 2: 3}[colour]
    return validation.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (height * (1 + width * samples)))) + chunk(b"IEND", b"")


def test_images_and_checksums(spark):
    good, grey, cut = png(), png(colour=0), png()[:-30]
    files = spark.createDataFrame([("a", good), ("b", grey), ("c", cut)], "path string, content binary")
    records = spark.createDataFrame([(p,) for p in "abcd"], "image string")
    missing, found = validation.image_audit(records, files)
    facts = {r.path: r for r in found.collect()}
    assert [r[0] for r in missing.collect()] == ["d"] and (facts["a"].width, facts["a"].mode, facts["a"].error) == (2, "RGB", None) and facts["b"].mode == "L" and facts["c"].error
    issues = {(r.check, r.n) for r in validation.image_issues(records, files, (2, 3)).collect()}
    assert issues == {("image_referential_integrity", 1), ("image_decode", 2), ("image_shape", 2)}
    manifest = spark.createDataFrame([("a", "1"), ("b", "2"), ("e", "3")], "path string, sha256 string")
    assert {r.path for r in validation.checksum_errors(spark.createDataFrame([("a", "1"), ("b", "9")], "path string, sha256 string"), manifest).collect()} == {"b", "e"}
    up = validation.rolled_up(validation.file_issues(files.select("path", F.lit("x").alias("sha256")), manifest)).first()
    assert (up.status, up.critical) == ("failed", 1)


def test_targets_in_answers(spark):
    truth = json.dumps({"numeric_targets": [{"name": "x", "value": 1200.0, "tolerance": 0.5}, {"name": "y", "value": 7.0}]})
    rows = spark.createDataFrame([("a", "it is 1,200.3 now", truth)], "id string, answer string, ground_truth string").withColumn("gt", F.from_json("ground_truth", TRUTH))
    assert [r.name for r in validation.missing_targets(rows).collect()] == ["y"]


def test_rollout_files(spark, tmp_path):
    digest = spark.range(1).select(array_hash(F.array(F.lit(1), F.lit(2))).alias("h")).first().h
    rows = [{"rollout_key": f"k{i}", "record_id": "r", "prompt_token_ids_sha256": digest, "completion_token_ids_sha256": digest, "round": 1, "rollout_index": i, "prompt_token_ids": [1, 2], "completion_token_ids": [1, 2]} for i in range(3)]
    file, manifest = tmp_path / "rollouts.jsonl", tmp_path / "manifest.json"
    file.write_text("".join(json.dumps(r) + "\n" for r in rows))
    manifest.write_text(json.dumps({"rollouts": {"sha256": hashlib.sha256(file.read_bytes()).hexdigest()}}))
    assert artifacts.read_rollouts(spark, str(file), str(manifest), 3, ROLLOUT).count() == 3
    with pytest.raises(ValueError):
        artifacts.read_rollouts(spark, str(file), str(manifest), 4, ROLLOUT)
    file.write_text(file.read_text().replace("[1, 2]}", "[1, 3]}"))
    with pytest.raises(ValueError):
        artifacts.read_rollouts(spark, str(file), str(manifest), 3, ROLLOUT)
    manifest.write_text(json.dumps({"rollouts": {"sha256": hashlib.sha256(file.read_bytes()).hexdigest()}}))
    with pytest.raises(ValueError):
        artifacts.read_rollouts(spark, str(file), str(manifest), 3, ROLLOUT)


def test_score_shards(spark, tmp_path):
    shard, manifest = tmp_path / "shard.jsonl", tmp_path / "m.json"
    shard.write_text(json.dumps({"rollout_key": "k", "completion_token_ids": [4], "topk_token_ids": [[4, 5]], "topk_logprobs": [[-0.5, -2.0]]}) + "\n")
    document = {"gate": "G", "status": "passed", "shards": [{"path": "/elsewhere/shard.jsonl", "sha256": hashlib.sha256(shard.read_bytes()).hexdigest()}]}
    manifest.write_text(json.dumps(document))
    assert artifacts.read_scores(spark, str(manifest), 1, "G").first().rollout_key == "k"
    with pytest.raises(ValueError):
        artifacts.read_scores(spark, str(manifest), 1, "H")
    shard.write_text(shard.read_text() + " ")
    with pytest.raises(ValueError):
        artifacts.read_scores(spark, str(manifest), 1, "G")
    shard.unlink()
    with pytest.raises(FileNotFoundError):
        artifacts.read_scores(spark, str(manifest), 1, "G")


def test_resumed_jobs(spark):
    schema = "rollout_key string, record_id string, record_sha256 string, image string, round int, rollout_index int, rollout_seed long"
    row = lambda i, seed=0: (f"k{i}", "r", "h", "x", 1, i, seed)
    jobs = spark.createDataFrame([(*row(i), i) for i in range(4)], schema + ", at long")
    left = lambda done: [r.rollout_key for r in artifacts.resumed_jobs(jobs, spark.createDataFrame(done, schema)).orderBy("at").collect()]
    assert left([row(0), row(1)]) == ["k2", "k3"] and left([]) == ["k0", "k1", "k2", "k3"]
    for bad in ([row(1)], [row(0), row(1, 9)], [row(0), ("z", *row(1)[1:])]):
        with pytest.raises(ValueError):
            left(bad)


def test_model_folders(tmp_path):
    def folder(name, vocab):
        root = tmp_path / name
        root.mkdir()
        for file, value in {"tokenizer.json": {"model": {"type": "BPE", "vocab": vocab}}, "config.json": {"model_type": "m", "eos": 1}, "tokenizer_config.json": {"pad": 0}, "preprocessor_config.json": {"size": 2}, "model.safetensors.index.json": {"weight_map": {"a": "s1", "b": "s2"}}}.items():
            (root / file).write_text(json.dumps(value))
        head = json.dumps({"a": {}, "__metadata__": {}}).encode()
        for shard in ("s1", "s2"):
            (root / shard).write_bytes(len(head).to_bytes(8, "little") + head + b"00")
        return root

    a, b, c = folder("a", {"x": 1}), folder("b", {"x": 1}), folder("c", {"x": 2})
    same = artifacts.compare_interfaces(a, b, ["eos"], ["pad"], ["size"])
    other = artifacts.compare_interfaces(a, c, ["eos"], ["pad"], ["size"])
    assert same["status"] == "passed" and other["issues"] == ["the tokenizers mean different things"] and not other["tokenizer"]["matched"]
    whole = artifacts.audit_snapshot(a, shards=2, model_type="m", headers=True, hashes=True)
    assert whole["status"] == "passed" and whole["weights"]["shards"][0]["tensor_keys"] == 1
    (a / "s2").write_bytes(b"")
    (a / "x.incomplete").write_text("")
    broken = artifacts.audit_snapshot(a, shards=3, least_bytes=10**6, model_type="n")
    assert broken["status"] == "failed" and len(broken["issues"]) == 5
    (a / "adapter_model.safetensors").write_bytes(b"w")
    (a / "adapter_config.json").write_text("{}")
    assert artifacts.adapter_snapshot(a, hashlib.sha256(b"w").hexdigest())["weights_sha256"]
    with pytest.raises(ValueError):
        artifacts.adapter_snapshot(a, "0")
    (a / "run_manifest.json").write_text(json.dumps(artifacts.run_manifest("s", {"k": 1, "_path": 2}, {"base": "m"})))
    assert artifacts.resume_snapshot(a, {"stage": "s", "config": {"k": 1}, "model": {"base": "m"}})["packages"]["pyspark"]
    with pytest.raises(ValueError):
        artifacts.resume_snapshot(a, {"stage": "t"})


def test_budgets_and_settings(tmp_path, monkeypatch):
    assert artifacts.step_budget(64, 8, 8) == 8 and artifacts.batch_budget(2, 2, 4, 4) == 16 and artifacts.resume_boundary(50, 25, 100) == 50
    for bad in (lambda: artifacts.step_budget(65, 8, 8), lambda: artifacts.batch_budget(1, 1, 3, 2), lambda: artifacts.resume_boundary(100, 25, 100)):
        with pytest.raises(ValueError):
            bad()
    (tmp_path / "base.yaml").write_text("a: {b: 1, c: [1, 2]}\n")
    (tmp_path / "top.yaml").write_text("extends: base.yaml\na: {c: [3]}\n")
    config = packages.load_config(tmp_path / "top.yaml")
    assert config == {"a": {"b": 1, "c": [3]}}
    monkeypatch.setenv("MODEL", "from-env")
    assert [packages.resolved("a.b", config, "cli", "MODEL"), packages.resolved("a.b", config, None, "MODEL"), packages.resolved("a.b", config), packages.resolved("a.z", config)] == ["cli", "from-env", 1, None]


def test_charts(spark, tmp_path):
    from prismark.operators import charts, facts
    from prismark.sources import records

    entities = facts.synthetic_entities(spark, 6).withColumn("view_type", F.explode(F.array(*map(F.lit, charts.RENDERERS)))).withColumn("chart_id", F.concat_ws("_", "entity_id", "view_type"))
    drawn = charts.rendered(entities, 7).collect()
    again = {r.chart_id: r.content for r in charts.rendered(entities.repartition(5), 7).collect()}
    assert len(drawn) == 30 and all(again[r.chart_id] == r.content for r in drawn) and len({bytes(r.content) for r in drawn}) == 30
    table = spark.createDataFrame(drawn)
    found = table.select("chart_style", validation.image_facts("content").alias("f")).collect()
    assert all(r.f.error is None and r.f.mode == "RGB" and (r.f.width, r.f.height) == (r.chart_style.width_px, r.chart_style.height_px) for r in found)
    written = records.write_images(table.unionByName(table), f"file://{tmp_path}/images").collect()
    assert len(written) == 30 and all(hashlib.sha256((tmp_path / "images" / r.path.rsplit("/", 1)[1]).read_bytes()).hexdigest() == r.sha256 for r in written)
    b64 = spark.sql("select 'aGk=' a, cast('hi' as binary) b, array(104, 105) c, '!!' d")
    assert b64.select(records.image_bytes(F.col("a"), "string") == F.col("b"), records.image_bytes(F.col("c"), "array<int>") == F.col("b"), records.image_bytes(F.col("d"), "string").isNull()).first() == (True, True, True)


def test_sources_are_guarded(spark):
    from prismark.sources import records

    df = spark.createDataFrame([("a", "train"), ("b", "train")], "id string, split string")
    source = {"name": "s", "df": df, "key": "id"}
    out = records.union_sources([{**source, "rows": 2, "repeat": 2}], split="train", shuffle="x")
    assert out.count() == 4 and out.select("ord").distinct().count() == 4
    for bad in ([{**source, "rows": 3}], [{**source, "max_rows": 1, "quotas": df}], [{**source, "namespace": " ", "max_rows": 1}], []):
        with pytest.raises(ValueError):
            records.union_sources(bad, split="train")
    with pytest.raises(ValueError):
        records.union_sources([source], split="val")
    a, b = (records.contract_hashes(x).first() for x in (df, df.orderBy(F.desc("id"))))
    assert a == b and a.rows == 2 and records.contract_hashes(df.limit(1)).first().ids_sha256 != a.ids_sha256
