"""Reward components of a completion against a ground truth, and their weighted mean.

`truth` is a struct with the fields of TRUTH; a component is null where the
truth has nothing for it. REGISTRY names the builders that `overall` uses.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from prismark.functions.text import NUMBER_PLAIN, clauses, count_of, extract_numbers, let, section_positions

TRUTH = (
    "required_sections array<string>, evidence_keywords array<string>, risk_labels array<string>, answer_aliases array<string>, "
    "grpo_eligible boolean, length_range array<int>, evaluation_mode string, "
    "numeric_targets array<struct<name:string,value:double,unit:string,tolerance:double,terms:array<string>>>, "
    "numeric_support array<struct<value:double,tolerance:double>>, "
    "trend_targets array<struct<metric:string,label:string,terms:array<string>,opposites:array<string>>>"
)
#: Weights of the components, in order.
WEIGHTS = {"numeric": 0.35, "trend": 0.20, "format": 0.15, "evidence": 0.15, "risk": 0.10, "length": 0.05}
#: Phrases that state a risk label.
RISK_PHRASES = {
    "revenue_decline": ["收入下降", "收入下滑", "收入收缩"],
    "user_churn": ["用户流失", "用户下降", "用户减少"],
    "margin_pressure": ["利润率承压", "利润率下降", "盈利空间被压缩", "盈利空间受到挤压"],
    "loss_making": ["亏损", "利润为负", "无法覆盖成本"],
    "monetization_weakness": ["变现能力", "变现效率", "单用户价值", "用户增长未充分转化"],
    "acquisition_cost_pressure": ["获客成本上升", "CAC上升", "获客压力"],
    "product_concentration": ["产品集中", "单一产品", "集中度偏高"],
    "execution_volatility": ["波动", "不稳定", "执行风险"],
}
#: Characters on either side within which a number belongs to a term.
TERM_REACH = 12


def _has(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def _share(parts: Column, hit: Callable[[Column], Column]) -> Column:
    return F.when(F.size(parts) > 0, F.size(F.filter(parts, hit)) / F.size(parts))


def _tolerance(item: Column) -> Column:
    return F.coalesce(item["tolerance"], F.greatest(F.lit(0.2), F.abs(item["value"]) * 0.005))


@F.pandas_udf(ArrayType(DoubleType()))
def _recall_hits(texts: pd.Series, targets: pd.Series) -> pd.Series:
    """For each target 1 if a number within reach of one of its terms agrees, else 0."""
    pattern = re.compile(NUMBER_PLAIN)

    def hits(text: str, wanted) -> list[float]:
        lowered, plain = (text or "").lower(), text or ""
        spans = [(m.start(), m.end(), float(m.group())) for m in pattern.finditer(plain)]
        everything = [float(m.group()) for m in pattern.finditer(plain.replace(",", "").replace("，", ""))]
        out = []
        for target in wanted if wanted is not None else []:
            terms = [t.strip().lower() for t in (target["terms"] if target["terms"] is not None else []) if t and t.strip()]
            near = everything
            if terms:
                places = [(m.start(), m.end()) for t in terms for m in re.finditer(re.escape(t), lowered)]
                near = [v for s, e, v in spans if any(max(a - e, s - b, 0) <= TERM_REACH for a, b in places)]
            slack = target["tolerance"] if target["tolerance"] is not None and target["tolerance"] == target["tolerance"] else max(0.2, abs(target["value"]) * 0.005)
            out.append(float(any(abs(v - target["value"]) <= slack for v in near)))
        return out

    return pd.Series([hits(t, w) for t, w in zip(texts, targets)])


def numeric_parts(text: Column, truth: Column) -> Column:
    """Struct score, recall, precision: target numbers near their terms, and support of all stated numbers."""
    targets, support, stated = truth["numeric_targets"], truth["numeric_support"], extract_numbers(text)
    some = F.coalesce(F.size(targets) > 0, F.lit(False))
    hit = _recall_hits(text, targets)
    recall = F.when(some, F.aggregate(hit, F.lit(0.0), lambda s, x: s + x) / F.size(targets))
    known = F.size(F.filter(stated, lambda v: F.exists(support, lambda s: F.abs(v - s["value"]) <= _tolerance(s))))
    precision = F.when(some & (F.size(support) > 0), F.when(F.size(stated) > 0, known / F.size(stated)).otherwise(0.0))
    return F.struct(f1_or_recall(recall, precision).alias("score"), recall.alias("recall"), precision.alias("precision"))


def f1_or_recall(recall: Column, precision: Column) -> Column:
    return F.when(precision.isNull(), recall).when(precision + recall == 0, 0.0).otherwise(2.0 * precision * recall / F.nullif(precision + recall, F.lit(0.0)))


def trend(text: Column, truth: Column) -> Column:
    """Mean over targets: 1 if only expected terms appear where the metric is named, 0.5 with opposites too."""
    targets = truth["trend_targets"]

    def score(parts: Column, t: Column) -> Column:
        named = F.array_join(F.filter(parts, lambda c: F.contains(c, F.lower(t["metric"]))), "。")  # clauses are not blank

        def judged(where: Column) -> Column:
            expected, opposite = F.exists(t["terms"], lambda x: F.contains(where, F.lower(x))), F.coalesce(F.exists(t["opposites"], lambda x: F.contains(where, F.lower(x))), F.lit(False))
            return F.when(expected, F.when(opposite, 0.5).otherwise(1.0)).otherwise(0.0)

        return let(F.coalesce(F.nullif(named, F.lit("")), F.lower(text)), judged)

    total = let(F.transform(clauses(text), F.lower), lambda parts: F.aggregate(F.transform(targets, lambda t: score(parts, t)), F.lit(0.0), lambda s, x: s + x))
    return F.when(F.size(targets) > 0, total / F.size(targets))


def sections(text: Column, names: list[str]) -> Column:
    """Coverage, order and repetition of tagged sections."""
    if not names:
        return F.lit(None).cast("double")
    present = F.filter(section_positions(text, names), lambda p: p >= 0)
    ordered = (F.size(present) > 0) & (F.array_sort(present) == present)
    spare = sum((F.greatest(F.lit(0.0), count_of(text, f"【{s}】") - 1) for s in names), F.lit(0.0))
    score = 0.85 * F.size(present) / len(names) + F.when(ordered, 0.15).otherwise(0.0) - F.least(F.lit(0.25), spare * 0.08)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def sections_of(text: Column, truth: Column) -> Column:
    """`sections` with the names that each row's truth requires."""
    names = truth["required_sections"]
    places = F.transform(names, lambda s: F.call_function("instr", text, F.concat(F.lit("【"), s, F.lit("】"))) - 1)
    present = F.filter(places, lambda p: p >= 0)
    ordered = (F.size(present) > 0) & (F.array_sort(present) == present)

    def spare(s: Column) -> Column:
        tag = F.concat(F.lit("【"), s, F.lit("】"))
        times = (F.char_length(text) - F.char_length(F.replace(text, tag, F.lit("")))) / F.char_length(tag)
        return F.greatest(F.lit(0.0), times - 1)

    extra = F.aggregate(F.transform(names, spare), F.lit(0.0), lambda a, x: a + x)
    score = 0.85 * F.size(present) / F.size(names) + F.when(ordered, 0.15).otherwise(0.0) - F.least(F.lit(0.25), extra * 0.08)
    return F.when(F.size(names) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def evidence(text: Column, truth: Column) -> Column:
    return _share(truth["evidence_keywords"], lambda k: _has(text, k))


def risk(text: Column, truth: Column) -> Column:
    """Share of labels that one of their phrases states; an unknown label is its own phrase."""
    known = F.create_map(*(x for label, phrases in RISK_PHRASES.items() for x in (F.lit(label), F.array(*map(F.lit, phrases)))))
    return _share(truth["risk_labels"], lambda label: F.exists(F.coalesce(F.try_element_at(known, label), F.array(label)), lambda p: _has(text, p)))


def length(text: Column, truth: Column) -> Column:
    """1 within the range, falling linearly outside."""
    low, high = F.get(truth["length_range"], F.lit(0)), F.get(truth["length_range"], F.lit(1))
    return length_score(F.char_length(text), low, high, F.size(truth["length_range"]) == 2)


def length_score(n: Column, low: Column, high: Column, known: Column) -> Column:
    below, above = n / F.greatest(F.lit(1), low), 1.0 - (n - high) / F.greatest(F.lit(1), high)
    return F.when(known, F.when((n >= low) & (n <= high), 1.0).when(n < low, F.greatest(F.lit(0.0), below)).otherwise(F.greatest(F.lit(0.0), above)))


#: Component name to builder (text, truth) -> Column; replace or add entries to change the overall score.
REGISTRY: dict[str, Callable[[Column, Column], Column]] = {
    "numeric": lambda text, truth: numeric_parts(text, truth)["score"],
    "trend": trend,
    "format": sections_of,
    "evidence": evidence,
    "risk": risk,
    "length": length,
}


def weighted(parts: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted mean over the components that apply; NaN where none has weight."""
    top = sum((F.coalesce(c * weights.get(n, 0.0), F.lit(0.0)) for n, c in parts.items()), F.lit(0.0))
    bottom = sum((F.when(c.isNull(), 0.0).otherwise(weights.get(n, 0.0)) for n, c in parts.items()), F.lit(0.0))
    return F.when(bottom > 0, top / F.nullif(bottom, F.lit(0.0))).otherwise(float("nan"))


def score_completion(df, text: str, truth: str, weights: dict[str, float] = WEIGHTS):
    """`df` with a column for each component, numeric_recall, numeric_precision and overall."""
    parts = df.withColumn("_numeric", numeric_parts(F.trim(F.col(text)), F.col(truth)))
    built = {n: (F.col("_numeric.score") if n == "numeric" else b(F.trim(F.col(text)), F.col(truth))) for n, b in REGISTRY.items()}
    scored = parts.withColumns({**built, "numeric_recall": F.col("_numeric.recall"), "numeric_precision": F.col("_numeric.precision")})
    return scored.withColumn("overall", weighted({n: F.col(n) for n in REGISTRY}, weights)).drop("_numeric")
