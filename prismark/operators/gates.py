"""Gates: thresholds on observed values, and the protocol of tagged answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from prismark.functions.text import count_of, section_positions
from prismark.operators.comparison import STRUCTURED_MARKERS

#: A heading where a tag belongs: Markdown or numbered.
HEADING = r"(?m)^\s*(?:#{1,6}\s*|(?:\*\*|__)?[一二三四1234][、.．]\s*)(?:结论|数据依据|风险|建议)"


def minimum_checks(observed: DataFrame, minimum: float) -> DataFrame:
    """`observed` (scope, observed) with minimum and passed; a missing value fails."""
    return observed.withColumns({"minimum": F.lit(float(minimum)), "passed": F.coalesce(F.col("observed") >= minimum, F.lit(False))})


def protocol_issues(answer: Column, sections: list[str]) -> Column:
    """Issues of an answer that must be exactly these tagged sections, in order, as an array of names."""
    text, tags = F.trim(answer), [f"【{s}】" for s in sections]
    places = section_positions(text, sections)
    others = [t for t in STRUCTURED_MARKERS if t not in tags]
    found = [
        F.when(~F.startswith(text, F.lit(tags[0])), F.lit("start")),
        *(F.when(count_of(text, t) != 1, F.lit(f"count_{i}")) for i, t in enumerate(tags)),
        F.when(F.exists(places, lambda p: p < 0) | (F.array_sort(places) != places), F.lit("order")),
        F.when(F.lit(False) if not others else F.greatest(*(F.contains(text, F.lit(t)) for t in others)) if len(others) > 1 else F.contains(text, F.lit(others[0])), F.lit("unexpected")),
        F.when(text.rlike(HEADING), F.lit("heading")),
    ]
    return F.array_compact(F.array(*found))


def threshold_checks(observed: DataFrame, limits: dict[str, float], kind: str, scope: str, most: bool = False) -> DataFrame:
    """kind, scope, metric, observed, bound, passed of `limits` against `observed` (metric, observed); `most`: bounds are maximums. A missing value fails."""
    spark = observed.sparkSession
    bounds = spark.createDataFrame([(m, float(b)) for m, b in limits.items()], "metric string, bound double")
    met = (F.col("observed") <= F.col("bound")) if most else (F.col("observed") >= F.col("bound"))
    return bounds.join(observed.select("metric", "observed"), "metric", "left").select(F.lit(kind).alias("kind"), F.lit(scope).alias("scope"), "metric", "observed", "bound", F.coalesce(met, F.lit(False)).alias("passed"))


def paired_checks(summary: DataFrame, required: dict[str, tuple[float, float]], guardrails: dict[str, float], core: list[str], least_positive: int) -> DataFrame:
    """kind, metric, observed, bound, probability, least_probability, passed of a paired summary (metric, delta, p_positive).

    required: metric to (least difference, least probability); guardrails: metric to least difference; of the `core`
    metrics at least `least_positive` must have got better. A metric that the summary lacks is an error.
    """
    spark = summary.sparkSession
    rules = [("required", m, float(d), float(p)) for m, (d, p) in required.items()] + [("point_estimate_guardrail", m, float(d), None) for m, d in guardrails.items()]
    known = {r.metric for r in summary.select("metric").collect()}  # a row for each metric
    unknown = sorted(({m for _, m, _, _ in rules} | set(core)) - known)
    if unknown:
        raise ValueError(f"metrics {unknown} are not in the comparison")
    table = spark.createDataFrame(rules, "kind string, metric string, bound double, least_probability double").join(summary.select("metric", F.col("delta").alias("observed"), F.col("p_positive").alias("probability")), "metric")
    single = table.select("kind", "metric", "observed", "bound", F.when(F.col("least_probability").isNotNull(), F.col("probability")).alias("probability"), "least_probability",
                          ((F.col("observed") >= F.col("bound")) & (F.col("least_probability").isNull() | (F.col("probability") >= F.col("least_probability")))).alias("passed"))
    better = summary.filter(F.col("metric").isin(core)).agg(F.count_if(F.col("delta") > 0).cast("double").alias("observed"))
    count = better.select(F.lit("positive_core_count").alias("kind"), F.lit(",".join(core)).alias("metric"), "observed", F.lit(float(least_positive)).alias("bound"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("double").alias("least_probability"), (F.col("observed") >= least_positive).alias("passed"))
    return single.unionByName(count)


def gate_document(checks: DataFrame, passed: str, failed: str, **more) -> dict:
    """The report of a gate from its check rows, which are few."""
    rows = [r.asDict() for r in checks.collect()]
    issues = [f"{r['kind']} {r['metric']}: {r['observed']} against {r['bound']}" for r in rows if not r["passed"]]
    return {"status": "failed" if issues else "passed", "gate": failed if issues else passed, "gate_evaluation": {"passed": not issues, "checks": rows, "issues": issues}, **more}


def require_gate(report: dict, name: str) -> dict:
    """`report`, if it is of the gate `name` and has passed."""
    if report.get("status") != "passed" or report.get("gate") != name:
        raise ValueError(f"expected {name} passed, found {report.get('gate')} {report.get('status')}")
    return report


def candidate_contract(config: dict, read) -> None:
    """What a candidate must bring: a passed earlier gate, and a run manifest with the prompt profile that is asked for. `read` gives a path's document."""
    inputs = config.get("inputs", {})
    if inputs.get("prerequisite_gate") is not None:
        if not str(inputs.get("prerequisite_gate_name", "")).strip():
            raise ValueError("a prerequisite gate needs its name")
        require_gate(read(inputs["prerequisite_gate"]), inputs["prerequisite_gate_name"].strip())
    manifest, profile = inputs.get("candidate_manifest"), inputs.get("required_prompt_profile")
    if (manifest is None) != (profile is None):
        raise ValueError("a candidate manifest and a required prompt profile go together")
    if manifest is not None:
        found = read(manifest).get("config", {}).get("generation", {}).get("prompt_profile")
        if found != profile:
            raise ValueError(f"the candidate was run with prompt profile {found!r}, not {profile!r}")


def paired_gate(baseline: DataFrame, candidate: DataFrame, gates: dict, *, rows: int, passed: str, failed: str, split: str = "val", samples: int = 5000, exact: bool = False) -> dict:
    """The report of two scored prediction sets of one validation split: comparison, checks, verdict."""
    from prismark.operators.reports import comparison_report, nested
    from prismark.operators.scoring import METRICS
    from prismark.sources.records import assert_contract

    if split != "val":
        raise ValueError("a paired gate is for split val")
    for side in (baseline, candidate):
        assert_contract(side, key="id", rows=rows, split=split)
    report = comparison_report(baseline, candidate, METRICS, samples=samples, exact=exact)
    overall = report.filter("field = 'overall'")
    required = {m: (t.get("min_delta", float("-inf")), t.get("min_probability_positive", 0.0)) for m, t in gates["required"].items()}
    checks = paired_checks(overall, required, gates.get("point_estimate_guardrails", {}), gates.get("core_metrics", []), gates.get("minimum_positive_core_metrics", 0))
    return gate_document(checks, passed, failed, comparison=nested(report, ["field", "value", "metric"]))


def absolute_checks(scored: DataFrame, gates: dict, sections: Column | None = None) -> DataFrame:
    """Check rows of one scored prediction set: least scores overall and by task, greatest efficiency figures, protocol failures.

    gates: minimum_overall, minimum_task_metrics (task to metric to bound), maximum_efficiency, maximum_protocol_failures.
    `sections`: names of the tagged sections that each row must have; without it the protocol is not checked.
    """
    from prismark.operators.reports import efficiency_report, evaluation_report

    wanted = {m for limits in [gates.get("minimum_overall", {}), *gates.get("minimum_task_metrics", {}).values()] for m in limits}
    means = evaluation_report(scored, sorted(wanted), ["task_type"]).select("field", "value", "metric", F.col("mean").alias("observed"))
    parts = [threshold_checks(means.filter("field = 'overall'"), gates.get("minimum_overall", {}), "minimum_overall", "overall")]
    parts += [threshold_checks(means.filter((F.col("field") == "task_type") & (F.col("value") == t)), limits, "minimum_task_metric", f"task:{t}") for t, limits in gates.get("minimum_task_metrics", {}).items()]
    speed = efficiency_report(scored)
    parts.append(threshold_checks(speed.unpivot([], speed.columns, "metric", "observed"), gates.get("maximum_efficiency", {}), "maximum_efficiency", "efficiency", most=True))
    if sections is not None:
        broken = scored.agg(F.count_if(F.size(protocol_issues_of(F.coalesce("prediction", F.lit("")), sections)) > 0).cast("double").alias("observed"))
        parts.append(threshold_checks(broken.select(F.lit("protocol").alias("metric"), "observed"), {"protocol": gates.get("maximum_protocol_failures", 0)}, "protocol_failures", "rows", most=True))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def protocol_issues_of(answer: Column, sections: Column) -> Column:
    """protocol_issues with the section names of each row."""
    text, tags = F.trim(answer), F.transform(sections, lambda s: F.concat(F.lit("【"), s, F.lit("】")))
    places = F.transform(tags, lambda t: F.call_function("instr", text, t))
    times = lambda t: (F.char_length(text) - F.char_length(F.replace(text, t, F.lit("")))) / F.char_length(t)
    wrong = F.filter(tags, lambda t: times(t) != 1)
    spare = F.filter(F.array(*map(F.lit, STRUCTURED_MARKERS)), lambda m: ~F.array_contains(tags, m) & F.contains(text, m))
    return F.array_compact(F.array(
        F.when(~F.startswith(text, F.get(tags, F.lit(0))), F.lit("start")), F.when(F.size(wrong) > 0, F.concat(F.lit("count "), F.array_join(wrong, " "))),
        F.when(F.exists(places, lambda p: p == 0) | (F.array_sort(places) != places), F.lit("order")), F.when(F.size(spare) > 0, F.concat(F.lit("unexpected "), F.array_join(spare, " "))), F.when(text.rlike(HEADING), F.lit("heading"))))


def exact_counts(rows: DataFrame, field: str, expected: dict[str, int]) -> None:
    """Raise unless the rows of each value of `field` are as many as stated, and no other value occurs."""
    found = {str(r[0]): r[1] for r in rows.groupBy(field).count().collect()}  # a row for each task
    if found != expected:
        raise ValueError(f"rows by {field} are {dict(sorted(found.items()))}, not {dict(sorted(expected.items()))}")


def preflight_document(checks: list[tuple[str, str, str]]) -> dict:
    """A report of (severity, check, evidence): any critical one fails it."""
    rows = [dict(zip(("severity", "check", "evidence"), c)) for c in checks]
    return {"status": "failed" if any(r["severity"] == "critical" for r in rows) else "passed", "issues": rows}
