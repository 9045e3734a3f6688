"""Records from entity facts: each view of an entity gives four questions with tagged answers and their ground truth.

A projection and an explode: no question needs another row. Answers state numbers beside
their terms, trends in clauses of their own, and risks by their phrases, so that a
reference answer gets 1 from every reward component that applies to it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from prismark.functions.rewards import RISK_PHRASES
from prismark.operators.facts import change_pct, cagr_pct, risk_labels, trend_label

#: Words of each trend, and what contradicts it.
TREND_TERMS = {
    "increase": (["增长", "上升", "扩大"], ["下降", "减少", "收缩"]),
    "decrease": (["下降", "减少", "收缩"], ["增长", "上升", "扩大"]),
    "stable": (["稳定", "平稳", "基本持平"], ["明显增长", "明显下降"]),
}
TREND_WORDS = {"increase": "增长", "decrease": "下降", "stable": "基本持平"}
#: Terms beside which a number of some name is looked for; the first name that is part of the target's counts.
NUMBER_TERMS = [("growth_gap", ["增速差"]), ("cagr", ["CAGR", "复合增长率"]), ("margin", ["利润率", "Margin"]), ("conversion", ["转化率", "Conversion"]), ("cac", ["CAC", "获客成本"]), ("arpu", ["ARPU", "单用户"]), ("user", ["用户", "User"]), ("cost", ["成本", "Cost"]), ("profit", ["利润", "Profit"]), ("revenue", ["收入", "Revenue"])]
ADVICE = {
    "revenue_decline": "先修复核心产品的需求", "user_churn": "分层召回离开的人群", "margin_pressure": "压低回报不足的投入", "loss_making": "分阶段回到盈亏平衡",
    "monetization_weakness": "改进付费设计与定价", "acquisition_cost_pressure": "把投放移向价值更高的渠道", "product_concentration": "培育另一条产品线", "execution_volatility": "按月核对偏差并校正",
}
_TARGET = "struct<name:string,value:double,unit:string,tolerance:double,terms:array<string>>"
_TREND = "struct<metric:string,label:string,terms:array<string>,opposites:array<string>>"


def default_terms(name: str) -> list[str]:
    """Terms of a numeric target by its name; changes and yearly growth are looked for by those words too."""
    name = name.lower()
    own = next((terms for part, terms in NUMBER_TERMS if part in name), [])
    if "growth_gap" in name or "cagr" in name:
        return own
    return own + ["变化"] * ("change" in name) + ["同比"] * ("yoy" in name)


def number(value: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f", value)


def numeric_target(name: str, value: Column, unit: str, terms: list[str] | None = None) -> Column:
    """A target rounded to four places, with half a percent or 0.2 of tolerance."""
    v = F.round(value, 4)
    words = default_terms(name) if terms is None else terms
    return F.struct(F.lit(name).alias("name"), v.alias("value"), F.lit(unit).alias("unit"), F.round(F.greatest(F.lit(0.2), F.abs(value) * 0.005), 4).alias("tolerance"), F.array(*map(F.lit, words)).cast("array<string>").alias("terms")).cast(_TARGET)


def year_target(name: str, year: Column, terms: list[str] | None = None) -> Column:
    """A target that only the year itself meets."""
    return F.struct(F.lit(name).alias("name"), year.cast("double").alias("value"), F.lit("year").alias("unit"), F.lit(0.0).alias("tolerance"), F.array(*map(F.lit, terms or ["年"])).alias("terms")).cast(_TARGET)


def _by_label(label: Column, options: dict) -> Column:
    return F.element_at(F.create_map(*(x for k, v in options.items() for x in (F.lit(k), v))), label)


def trend_target(metric: str, label: Column) -> Column:
    terms = {k: F.struct(F.array(*map(F.lit, t)).alias("terms"), F.array(*map(F.lit, o)).alias("opposites")) for k, (t, o) in TREND_TERMS.items()}
    words = _by_label(label, terms)
    return F.struct(F.lit(metric).alias("metric"), label.alias("label"), words["terms"].alias("terms"), words["opposites"].alias("opposites")).cast(_TREND)


def trend_phrase(metric: str, label: Column) -> Column:
    return F.concat(F.lit(f"{metric}整体"), _by_label(label, {k: F.lit(v) for k, v in TREND_WORDS.items()}))


def risk_text(labels: Column, most: int = 2) -> Column:
    """The first risks by their phrases, a clause each."""
    phrases = {k: F.lit(v[0]) for k, v in RISK_PHRASES.items()}
    return F.concat(F.array_join(F.transform(F.slice(labels, 1, most), lambda x: _by_label(x, phrases)), "；"), F.lit("。"))


def advice_text(labels: Column, most: int = 2) -> Column:
    advice = {k: F.lit(v) for k, v in ADVICE.items()}
    return F.concat(F.array_join(F.transform(F.slice(labels, 1, most), lambda x: _by_label(x, advice)), "；"), F.lit("。"))


def tagged_answer(conclusion: Column, evidence: Column, risk: Column | None = None, advice: Column | None = None) -> tuple[Column, list[str]]:
    """The answer's text, a line a section, and the names of its sections."""
    parts = {"结论": conclusion, "数据依据": evidence, "风险": risk, "建议": advice}
    given = {k: v for k, v in parts.items() if v is not None}
    return F.concat_ws("\n", *(F.concat(F.lit(f"【{k}】"), v) for k, v in given.items())), list(given)


@dataclass
class Question:
    """One question of a view; `risks` and `advises`: whether its answer has those sections."""

    suffix: str
    task: str
    level: str
    asks: str
    conclusion: Column
    evidence: Column
    targets: list[Column] = field(default_factory=list)
    trends: list[Column] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    risks: bool = False
    advises: bool = False
    rewarded: bool = True


def numeric_support(entity_values: list[Column], years: Column, targets: Column) -> Column:
    """Values that an answer may state, each once with its greatest tolerance: years exactly, others within half a percent or 0.2."""
    item = lambda v, t: F.struct(F.round(v, 4).alias("value"), F.round(t, 4).alias("tolerance"))
    loose = lambda v: F.greatest(F.lit(0.2), F.abs(v) * 0.005)
    known = F.filter(F.concat(*entity_values), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(known, lambda v: item(v, F.when((v == F.floor(v)) & v.between(2000, 2100), 0.0).otherwise(loose(v))))
    every = F.concat(F.transform(years, lambda y: item(y.cast("double"), F.lit(0.0))), whole, F.transform(targets, lambda t: item(t["value"], t["tolerance"])))
    values = F.array_sort(F.array_distinct(F.transform(every, lambda s: s["value"])))
    most = lambda v: F.array_max(F.transform(F.filter(every, lambda s: s["value"] == v), lambda s: s["tolerance"]))
    return F.transform(values, lambda v: F.struct(v.alias("value"), most(v).alias("tolerance")))


def _questions() -> dict[str, list[Question]]:
    """The questions of each view over the columns of `_facts`."""
    c = F.col
    said = lambda *x: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in x))
    year, begin = c("last_year").cast("string"), c("first_year").cast("string")
    revenue, users, margin, arpu, cac = (c(f"{n}_now") for n in ("revenue", "users", "margin", "arpu", "cac"))
    growth, user_growth, margin_change = c("revenue_change"), c("users_change"), c("margin_change")
    target = numeric_target
    moved = {"revenue": trend_target("收入", c("revenue_trend")), "users": trend_target("用户", c("users_trend")), "margin": trend_target("利润率", c("margin_trend"))}
    phrase = {"revenue": trend_phrase("收入", c("revenue_trend")), "users": trend_phrase("用户", c("users_trend")), "margin": trend_phrase("利润率", c("margin_trend"))}
    return {
        "financial": [
            Question("current_value", "value_retrieval", "easy", "最近一年的收入是多少？", said(year, "年收入为", number(revenue), "百万元。"), said("图中", year, "年收入为", number(revenue), "百万元。"), [target("revenue", revenue, "百万元")], keywords=["收入"]),
            Question("growth_math", "numerical_reasoning", "medium", "收入从首年到末年变化了多少？年复合增长率是多少？", said("收入变化", number(growth), "%，CAGR为", number(c("cagr")), "%。"), said(begin, "年收入", number(c("revenue_first")), "百万元，", year, "年收入", number(revenue), "百万元。"), [target("revenue_change", growth, "%"), target("revenue_cagr", c("cagr"), "%")], keywords=["收入", "CAGR"]),
            Question("relationship", "relationship_analysis", "medium", "收入与利润率怎样变化？有何风险？", said(phrase["revenue"], "；", phrase["margin"], "。"), said("收入变化", number(growth), "%；利润率变化", number(margin_change), "个百分点。"), [target("revenue_change", growth, "%"), target("margin_change", margin_change, "个百分点")], [moved["revenue"], moved["margin"]], ["收入", "利润率"], risks=True),
            Question("decision", "decision_support", "hard", "按风险给出经营建议。", said("应先处理已识别的风险；", phrase["revenue"], "。"), said("收入变化", number(growth), "%；利润率", number(margin), "%。"), [target("revenue_change", growth, "%")], [moved["revenue"]], ["收入"], risks=True, advises=True),
        ],
        "operations": [
            Question("current_value", "value_retrieval", "easy", "最近一年的活跃用户是多少？", said(year, "年用户为", number(users), "万。"), said("图中", year, "年用户为", number(users), "万。"), [target("active_users", users, "万")], keywords=["用户"]),
            Question("monetization", "relationship_analysis", "medium", "用户与单用户收入有何关系？", said(phrase["users"], "。ARPU为", number(arpu), "元。"), said("用户变化", number(user_growth), "%；ARPU为", number(arpu), "元。"), [target("users_change", user_growth, "%"), target("arpu", arpu, "元")], [moved["users"]], ["用户", "ARPU"]),
            Question("efficiency_risk", "risk_diagnosis", "hard", "获客效率有何风险？", said("CAC变化", number(c("cac_change")), "%。"), said("CAC为", number(cac), "元；转化率为", number(c("conversion_now")), "%。"), [target("cac_change", c("cac_change"), "%"), target("conversion", c("conversion_now"), "%")], keywords=["CAC", "转化率"], risks=True),
            Question("decision", "decision_support", "hard", "按运营数据给出建议。", said("应先处理已识别的风险；", phrase["users"], "。"), said("用户变化", number(user_growth), "%；CAC为", number(cac), "元。"), [target("users_change", user_growth, "%")], [moved["users"]], ["用户"], risks=True, advises=True),
        ],
        "growth": [
            Question("peak_growth", "value_retrieval", "easy", "收入同比最高的是哪一年？", said(c("peak_year").cast("string"), "年收入同比最高，为", number(c("peak")), "%。"), said("图中", c("peak_year").cast("string"), "年收入同比为", number(c("peak")), "%。"), [year_target("peak_year", c("peak_year")), target("revenue_yoy", c("peak"), "%")], keywords=["收入", "同比"]),
            Question("growth_gap", "numerical_reasoning", "medium", "用户与收入的增速相差多少？", said("增速差为", number(user_growth - growth), "个百分点。"), said("用户变化", number(user_growth), "%；收入变化", number(growth), "%。"), [target("growth_gap", user_growth - growth, "个百分点")], keywords=["增速差", "用户", "收入"]),
            Question("trend", "trend_analysis", "medium", "收入与利润率的走势如何？", said(phrase["revenue"], "；", phrase["margin"], "。"), said("收入变化", number(growth), "%；利润率变化", number(margin_change), "个百分点。"), [target("revenue_change", growth, "%")], [moved["revenue"], moved["margin"]], ["收入", "利润率"], risks=True),
            Question("decision", "decision_support", "hard", "按增长质量给出建议。", said("应先处理已识别的风险；", phrase["revenue"], "。"), said("收入变化", number(growth), "%；CAGR为", number(c("cagr")), "%。"), [target("revenue_cagr", c("cagr"), "%")], [moved["revenue"]], ["收入", "CAGR"], risks=True, advises=True),
        ],
        "composition": [
            Question("top_product", "value_retrieval", "easy", "占比最高的产品是什么？", said("占比最高的是", c("top_name"), "，占比", number(c("top_share")), "%。"), said("图中", c("top_name"), "占比", number(c("top_share")), "%。"), [target("top_share", c("top_share"), "%", ["占比"])], keywords=["占比"]),
            Question("top_two", "numerical_reasoning", "medium", "前两位产品合计占比多少？", said("合计占比", number(c("top_two")), "%。"), said(c("top_name"), "占比", number(c("top_share")), "%；", c("second_name"), "占比", number(c("second_share")), "%。"), [target("top_two_share", c("top_two"), "%", ["合计", "占比"])], keywords=["合计", "占比"]),
            Question("concentration", "risk_diagnosis", "medium", "产品结构是否集中？", said(F.when(c("top_share") >= 55, "结构集中。").otherwise("结构不集中。")), said("最高一项占比", number(c("top_share")), "%。"), [target("top_share", c("top_share"), "%", ["占比"])], keywords=["占比"], risks=True),
            Question("decision", "decision_support", "hard", "按产品结构给出建议。", said("应先处理已识别的风险。"), said("合计占比", number(c("top_two")), "%；收入变化", number(growth), "%。"), [target("top_two_share", c("top_two"), "%", ["合计", "占比"])], keywords=["占比"], risks=True, advises=True),
        ],
        "dashboard": [
            Question("snapshot", "value_retrieval", "easy", "给出最近一年的收入与用户。", said("收入为", number(revenue), "百万元；用户为", number(users), "万。"), said(year, "年收入为", number(revenue), "百万元；用户为", number(users), "万。"), [target("revenue", revenue, "百万元"), target("active_users", users, "万")], keywords=["收入", "用户"]),
            Question("multi_metric", "numerical_reasoning", "medium", "收入与用户各变化多少？", said("收入变化", number(growth), "%；用户变化", number(user_growth), "%。"), said("收入为", number(revenue), "百万元；用户为", number(users), "万。"), [target("revenue_change", growth, "%"), target("users_change", user_growth, "%")], keywords=["收入", "用户"]),
            Question("risk", "risk_diagnosis", "hard", "主要风险是什么？", said(phrase["margin"], "。"), said("利润率变化", number(margin_change), "个百分点；CAC变化", number(c("cac_change")), "%。"), [target("margin_change", margin_change, "个百分点")], [moved["margin"]], ["利润率", "CAC"], risks=True),
            Question("report", "comprehensive_report", "hard", "写一份简要的经营报告。", said(phrase["revenue"], "；", phrase["users"], "；", phrase["margin"], "。"), said("收入变化", number(growth), "%；用户变化", number(user_growth), "%；利润率变化", number(margin_change), "个百分点；CAGR为", number(c("cagr")), "%。"),
                     [target("revenue_change", growth, "%"), target("users_change", user_growth, "%"), target("margin_change", margin_change, "个百分点"), target("revenue_cagr", c("cagr"), "%")], [moved["revenue"], moved["users"], moved["margin"]], ["收入", "用户", "利润率", "CAGR"], risks=True, advises=True),
        ],
    }


#: Views and what their questions are built by; a caller may replace or add entries.
VIEWS = ["financial", "operations", "growth", "composition", "dashboard"]
SERIES = ["revenue", "cost", "profit", "margin", "users", "arpu", "conversion", "cac"]


def _facts(entities: DataFrame) -> DataFrame:
    """`entities` with the numbers that questions state, worked out once a row."""
    first, last = (lambda c: F.element_at(c, 1)), (lambda c: F.element_at(c, -1))
    rows = entities.withColumns({**{f"{c}_now": last(c) for c in SERIES}, **{f"{c}_first": first(c) for c in SERIES}, "last_year": last("years"), "first_year": first("years")})
    change = {c: F.round(change_pct(F.col(f"{c}_first"), F.col(f"{c}_now")), 1) for c in ("revenue", "users", "cac")}
    rows = rows.withColumns({**{f"{c}_change": v for c, v in change.items()}, "margin_change": F.round(F.col("margin_now") - F.col("margin_first"), 1), "cagr": F.round(cagr_pct(F.col("revenue_first"), F.col("revenue_now"), F.size("years") - 1), 1)})
    yearly = F.transform(F.sequence(F.lit(1), F.size("years") - 1), lambda i: F.round(change_pct(F.get("revenue", i - 1), F.get("revenue", i)), 1))
    parts = F.array_sort(F.map_entries("product_mix_pct"), lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).otherwise(0))  # ties keep their order
    rows = rows.withColumns({"yearly": yearly, "parts": parts})
    rows = rows.withColumns({
        "peak": F.array_max("yearly"), "top_name": F.get("parts", F.lit(0))["key"], "top_share": F.get("parts", F.lit(0))["value"], "second_name": F.get("parts", F.lit(1))["key"], "second_share": F.get("parts", F.lit(1))["value"],
        "revenue_trend": trend_label(F.col("revenue_change")), "users_trend": trend_label(F.col("users_change")), "margin_trend": trend_label(F.col("margin_change"), 2.0),
    })
    return rows.withColumns({
        "peak_year": F.get("years", F.array_position("yearly", F.col("peak")).cast("int")), "top_two": F.round(F.col("top_share") + F.coalesce("second_share", F.lit(0.0)), 1),  # the first of equal peaks
        "risks": risk_labels(F.col("revenue_change"), F.col("users_change"), F.col("margin_change"), F.exists("profit", lambda p: p < 0), F.col("cac_now") / F.col("cac_first"), F.col("top_share")),
    })


def entity_records(entities: DataFrame, dataset: str = "generated-v1", split: str = "train") -> DataFrame:
    """Records (see sources.records.RECORD, metadata: scenario alone) of synthetic_entities' rows: four a view."""
    texts = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    answers = {}
    for view, questions in _questions().items():
        rows = []
        for q in questions:
            answer, sections = tagged_answer(q.conclusion, q.evidence, risk_text(F.col("risks")) if q.risks else None, advice_text(F.col("risks")) if q.advises else None)
            truth = F.struct(
                texts(sections).alias("required_sections"), F.array(*q.targets).cast(f"array<{_TARGET}>").alias("numeric_targets"), F.array(*q.trends).cast(f"array<{_TREND}>").alias("trend_targets"), texts(q.keywords).alias("evidence_keywords"),
                (F.slice("risks", 1, 2) if q.risks else texts([])).alias("risk_labels"), F.lit(q.rewarded).alias("grpo_eligible"), F.array(F.lit(20), F.lit(420)).alias("length_range"))
            rows.append(F.struct(F.lit(q.suffix).alias("suffix"), F.lit(q.task).alias("task_type"), F.lit(q.level).alias("difficulty"), F.concat(F.col("entity_id"), F.lit("："), F.lit(q.asks)).alias("question"), answer.alias("answer"), truth.alias("truth")))
        answers[view] = F.array(*rows)
    by_view = None
    for view, rows in answers.items():
        by_view = F.when(F.col("view_type") == view, rows) if by_view is None else by_view.when(F.col("view_type") == view, rows)
    charts = _facts(entities).withColumn("view_type", F.explode("views")).withColumn("r", F.explode(by_view))
    values = [F.col(c) for c in SERIES] + [F.map_values("product_mix_pct"), F.array(*(F.col(c) for c in ("revenue_change", "users_change", "margin_change", "cac_change", "cagr", "top_two"))), F.col("yearly")]
    chart = F.concat_ws("_", "entity_id", "view_type")
    own = charts.select("*", F.col("r.truth").withField("numeric_support", numeric_support(values, F.col("years"), F.col("r.truth.numeric_targets"))).alias("truth"))
    return own.select(
        F.concat_ws("_", chart, F.col("r.suffix")).alias("id"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), "entity_id", chart.alias("chart_id"), F.concat(F.lit("images/"), chart, F.lit(".png")).alias("image"), "industry", "view_type",
        "r.task_type", "r.difficulty", "r.question", "r.answer", F.to_json("truth").alias("ground_truth"), F.struct("scenario").alias("metadata"))
