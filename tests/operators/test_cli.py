import json

import pytest

from prismark import cli


def prediction(key, answer, said, tokens=4):
    return {"id": key, "dataset": "charts", "split": "val", "image": "x.png", "question": "q", "answer": answer, "ground_truth": "{}", "metadata": {"scenario": "s"}, "prediction": said, "completion_tokens": tokens, "latency_seconds": 1.0, "task_type": "value_retrieval", "view_type": "financial"}


@pytest.fixture
def files(tmp_path):
    for name, said in (("baseline", ["1", "2"]), ("candidate", ["1", "1"])):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps(prediction(f"r{i}", "1", s)) + "\n" for i, s in enumerate(said)))

    def run(command, config, *more):
        path = tmp_path / f"{command}.json"
        path.write_text(json.dumps({"output": str(tmp_path / f"{command}-report.json"), **config}))
        code = cli.main([command, "--config", str(path), *more])
        report = tmp_path / f"{command}-report.json"
        return code, json.loads(report.read_text()) if report.is_file() else None

    return tmp_path, run


def test_reports(spark, files):
    folder, run = files
    both = {"inputs": {"baseline": str(folder / "baseline.jsonl"), "candidate": str(folder / "candidate.jsonl"), "expected_rows": 2, "expected_split": "val"}}
    code, report = run("evaluate", {"inputs": {"predictions": str(folder / "baseline.jsonl")}})
    assert code == 0 and report["metrics"]["overall"]["overall"]["exact_match"]["mean"] == 0.5 and report["efficiency"]["samples_per_second"] == 1.0
    code, report = run("compare", {**both, "bootstrap_samples": 50})
    assert code == 0 and report["overall"]["overall"]["exact_match"]["delta"] == 0.5
    with pytest.raises(FileExistsError):
        run("compare", both)
    assert run("compare", {**both, "bootstrap_samples": 50}, "--force")[0] == 0
    code, report = run("error-migration", {**both, "expected": {"paired_rows": 2}})
    assert code == 0 and report["groups"]["overall"]["overall"]["exact_match"]["gained"] == 1
    gate = {**both, "gates": {"required": {"exact_match": {"min_delta": 0.6}}}, "pass_gate": "P", "fail_gate": "N", "bootstrap_samples": 50}
    code, report = run("qualify", gate)
    assert code == 1 and report["gate"] == "N"
    code, report = run("gate", {"inputs": {"predictions": str(folder / "candidate.jsonl"), "expected_task_counts": {"value_retrieval": 2}}, "gates": {"minimum_overall": {"exact_match": 1.0}, "maximum_protocol_failures": 2}, "pass_gate": "P", "fail_gate": "N"})
    assert code == 0 and report["gate"] == "P"


def test_build(spark, files):
    folder, run = files
    code, _ = run("build", {"output": str(folder / "out"), "entities": 4})
    assert code == 0 and spark.read.parquet(str(folder / "out/charts")).count() == 8 and spark.read.json(str(folder / "out/records")).count() == 32
