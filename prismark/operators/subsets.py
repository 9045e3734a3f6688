"""Training subsets from records: nested supervised sets, rewarded prompts, panels, and rounds of unseen prompts.

Quotas and flows are worked out on the driver from counts (of tasks, views, classes of charts);
which rows fill them is decided by hash order in plans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from prismark.functions.hashing import stable_hash
from prismark.functions.rewards import TRUTH
from prismark.lineage import cut_lineage
from prismark.operators import allocation, selection
from prismark.operators.audit import forbidden_overlap
from prismark.operators.protocol import annotated
from prismark.operators.rollouts import dual_rollouts


def _checked(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def with_scenario(records: DataFrame) -> DataFrame:
    return records.withColumn("scenario", F.coalesce("metadata.scenario", F.lit("unknown")))


def assign_tasks(groups: DataFrame, quotas: dict[str, int], namespace: str) -> DataFrame:
    """`groups` (group, tasks: sorted distinct array) with task: each one of its own, every task exactly its quota.

    Groups with the same tasks form a class; the flow decides counts by class, hash order which groups they are.
    """
    spark = groups.sparkSession
    sizes = {tuple(r.tasks): r.n for r in groups.groupBy("tasks").agg(F.count("*").alias("n")).collect()}  # at most 2^tasks
    given = allocation.class_flow(sizes, quotas)
    runs, start = [], 0
    for i, c in enumerate(sorted(sizes)):
        for task, n in sorted(given[c].items()):
            if n:
                runs.append((start, start + n, task))
                start += n
    number = spark.createDataFrame([(list(c), f"{i:06d}") for i, c in enumerate(sorted(sizes))], "tasks array<string>, class string")
    order = F.concat_ws("|", "class", stable_hash(namespace, F.col("group")), "group")
    placed = selection.positions(groups.join(F.broadcast(number), "tasks").withColumn("_order", order), "_order")
    bounds = F.broadcast(spark.createDataFrame(runs, "low long, high long, task string"))
    return placed.join(bounds, (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))).select("group", "tasks", "task")


def _one_of_each(records: DataFrame, chosen: DataFrame, group: str) -> DataFrame:
    """The rows of (group, task); of several rows of one task in a group the one with the greatest id."""
    last = records.groupBy(F.col(group).alias("group"), F.col("task_type").alias("task")).agg(F.max("id").alias("id"))
    return records.join(last.join(chosen.select("group", "task"), ["group", "task"]).select("id"), "id")


def nested_sets(records: DataFrame, screen: int, train: int, namespace: str = "sft") -> tuple[DataFrame, DataFrame]:
    """(screen, train): `train` rows of each chart of which `screen` are the smaller set; tasks keep their shares of all rows."""
    _checked(1 <= screen <= train, "rows a chart must satisfy 1 <= screen <= train")
    _checked(records.filter(~F.coalesce(F.col("split") == "train", F.lit(False))).isEmpty(), "records outside split train")
    charts = cut_lineage(records.groupBy(F.col("chart_id").alias("group")).agg(F.array_sort(F.collect_set("task_type")).alias("tasks")))
    facts = charts.agg(F.count("*").alias("n"), F.min(F.size("tasks")).alias("least")).first()
    _checked(bool(facts.n) and facts.least >= train, f"the smallest chart has {facts.least} tasks, fewer than {train}")
    weights = {r[0]: float(r[1]) for r in records.groupBy("task_type").count().collect()}
    totals, chosen, left, small = dict.fromkeys(weights, 0), [], charts, None
    for slot in range(train):
        goal = allocation.largest_remainder(weights, (slot + 1) * facts.n)
        want = {t: float(max(0, goal[t] - totals[t])) for t in goal}
        supply = {r[0]: r[1] for r in left.select(F.explode("tasks").alias("t")).groupBy("t").count().collect()}
        quotas = allocation.capped_quotas({t: max(n, 1e-9) for t, n in want.items()}, facts.n, supply)
        given = cut_lineage(assign_tasks(left, quotas, f"{namespace}:slot:{slot}"))  # read by every later slot
        chosen.append(given.select("group", "task"))
        for t, n in quotas.items():
            totals[t] += n
        left = given.select("group", F.array_except("tasks", F.array("task")).alias("tasks"))
        if slot + 1 == screen:
            small = reduce(DataFrame.unionByName, chosen)
    return _one_of_each(records, small, "chart_id"), _one_of_each(records, reduce(DataFrame.unionByName, chosen), "chart_id")


def covering_charts(records: DataFrame, prompts: int, namespace: str = "grpo") -> DataFrame:
    """chart_id of `prompts` charts: every entity at least one of its two (financial and another view), views in their shares, strata of industry and scenario alike."""
    charts = with_scenario(records).groupBy("chart_id").agg(*(F.min(c).alias(c) for c in ("entity_id", "view_type", "industry", "scenario")))
    is_financial = F.col("view_type") == "financial"
    entities = charts.groupBy("entity_id").agg(F.count("*").alias("n"), F.count_if(is_financial).alias("financial_charts"), F.max(F.when(is_financial, F.col("chart_id"))).alias("financial"), F.max(F.when(~is_financial, F.col("chart_id"))).alias("secondary"),
                                               F.max(F.when(~is_financial, F.col("view_type"))).alias("view"), F.max("industry").alias("industry"), F.max("scenario").alias("scenario"))
    entities = cut_lineage(entities)
    _checked(entities.filter((F.col("n") != 2) | (F.col("financial_charts") != 1)).isEmpty(), "every entity needs one financial and one other chart")
    n = entities.count()
    views = {r[0]: r[1] for r in charts.groupBy("view_type").count().collect()}
    _checked(n <= prompts <= sum(views.values()), f"prompts must be between {n} entities and {sum(views.values())} charts")
    base, final = (allocation.largest_remainder({v: float(k) for v, k in views.items()}, total) for total in (n, prompts))

    def take(df: DataFrame, total: int, name: str) -> DataFrame:
        return selection.stratified_sample(df, ["industry", "scenario"], total, f"{namespace}:{name}", "entity_id").select(*df.columns) if total else df.limit(0)

    first, more = [], []
    for view in sorted(v for v in views if v != "financial"):
        own = entities.filter(F.col("view") == view)
        chosen = cut_lineage(take(own, base[view], f"base:{view}"))
        first.append(chosen)
        more.append(take(own.join(chosen.select("entity_id"), "entity_id", "left_anti"), max(0, final[view] - base[view]), f"extra:{view}").select(F.col("secondary").alias("chart_id")))
    second = reduce(DataFrame.unionByName, first)
    financial = entities.join(second.select("entity_id"), "entity_id", "left_anti").select(F.col("financial").alias("chart_id"))
    extra = take(second, max(0, final["financial"] - base["financial"]), "extra:financial").select(F.col("financial").alias("chart_id"))
    return reduce(DataFrame.unionByName, [second.select(F.col("secondary").alias("chart_id")), financial, extra, *more])


def rewarded_prompts(records: DataFrame, prompts: int, weights: dict[str, float], namespace: str = "grpo") -> DataFrame:
    """One rewardable record of each covering chart, tasks by `weights`."""
    fine = F.coalesce((F.col("split") == "train") & F.from_json("ground_truth", TRUTH)["grpo_eligible"], F.lit(False))
    _checked(records.filter(~fine).isEmpty(), "a record is not in train, or may not be rewarded")
    rows = cut_lineage(records.join(covering_charts(records, prompts, namespace), "chart_id"))
    groups = rows.groupBy(F.col("chart_id").alias("group")).agg(F.array_sort(F.collect_set("task_type")).alias("tasks"))
    return _one_of_each(rows, assign_tasks(groups, allocation.largest_remainder(weights, prompts), f"{namespace}:tasks"), "chart_id")


def validation_panel(records: DataFrame, rows: int, namespace: str = "validation") -> DataFrame:
    """Rows by task, and within each task by industry, scenario, view and difficulty."""
    _checked(records.filter(~F.coalesce(F.col("split") == "val", F.lit(False))).isEmpty(), "records outside split val")
    return selection.two_level_quota(with_scenario(records), "task_type", ["industry", "scenario", "view_type", "difficulty"], rows, namespace, "id").select(*records.columns)


def training_subsets(train: DataFrame, rewarded: DataFrame, validation: DataFrame, *, screen: int, per_chart: int, prompts: int, weights: dict[str, float], panel: int) -> dict[str, DataFrame]:
    """sft_screen, sft_train, grpo_train and validation, with what must hold of them checked."""
    small, large = nested_sets(train, screen, per_chart)
    out = {"sft_screen": small, "sft_train": large, "grpo_train": rewarded_prompts(rewarded, prompts, weights), "validation": validation_panel(validation, panel)}
    out = {k: cut_lineage(df) for k, df in out.items()}
    charts = train.select("chart_id").distinct().count()
    facts = {k: df.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.countDistinct("chart_id").alias("charts"), F.countDistinct("entity_id").alias("entities")).first() for k, df in out.items()}
    sizes = {"sft_screen": screen * charts, "sft_train": per_chart * charts, "grpo_train": prompts, "validation": panel}
    _checked({k: f.n for k, f in facts.items()} == sizes, f"sizes are {facts}, not {sizes}")
    _checked(all(f.n == f.ids for f in facts.values()), "a subset repeats an id")
    _checked(facts["sft_screen"].charts == facts["sft_train"].charts == charts, "the supervised sets do not cover all charts")
    _checked(facts["grpo_train"].charts == prompts and facts["grpo_train"].entities == rewarded.select("entity_id").distinct().count(), "the prompts do not cover all entities, a chart each")
    _checked(small.select("id").join(large.select("id"), "id", "left_anti").isEmpty(), "the screening set is not within the training set")
    tasks = {r[0]: r[1] for r in out["grpo_train"].groupBy("task_type").count().collect()}
    _checked(tasks == {t: n for t, n in allocation.largest_remainder(weights, prompts).items() if n}, f"prompts by task are {tasks}")
    return out


def unseen_rounds(records: DataFrame, seen: DataFrame, rounds: tuple[int, int], weights: dict[str, float], per_chart: int, strict: bool = True, namespace: str = "opd") -> tuple[DataFrame, DataFrame]:
    """Two rounds of train records that are not in `seen`: the task furthest behind picks next, the least used chart first, `per_chart` rows of a chart at most."""
    _checked(min(rounds) > 0 and per_chart > 0, "rounds and rows a chart must be positive")
    _checked(records.groupBy("id").count().filter("count > 1").isEmpty(), "the source repeats an id")
    left = records.join(seen.select("id").distinct(), "id", "left_anti")
    _checked(left.filter(~F.coalesce(F.col("split") == "train", F.lit(False))).isEmpty(), "records outside split train")
    supply = {r[0]: r[1] for r in left.groupBy("task_type").count().collect()}
    quotas = allocation.capped_quotas(weights, sum(rounds), supply, strict)
    # A chart gives no more than its lowest hashes for a task; the driver needs only those.
    few = selection.lowest_of_each(left, ["task_type", "chart_id"], stable_hash(f"{namespace}:candidate", F.col("task_type"), F.col("id")), "id", per_chart)
    ids = allocation.greedy_selection([(r.id, r.task_type, r.chart_id) for r in few.select("id", "task_type", "chart_id").collect()], quotas, per_chart, namespace)
    chosen = records.join(F.broadcast(records.sparkSession.createDataFrame([(i,) for i in ids], "id string")), "id").select(*records.columns)
    first = selection.stratified_sample(with_scenario(chosen), ["task_type", "difficulty", "industry", "view_type", "scenario"], rounds[0], f"{namespace}:round1", "id").select("id")
    return chosen.join(first, "id", "left_semi"), chosen.join(first, "id", "left_anti")


def no_overlap(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("id", "image")) -> dict[str, int]:
    """Zero for each key, or an error: two sets that must not share ids, image paths or image contents."""
    found = {r.key: r.n_overlap for r in forbidden_overlap(left, right, [k for k in keys if k in left.columns and k in right.columns]).collect()}
    _checked(not any(found.values()), f"the sets overlap: {found}")
    return found


def disjoint_panels(records: DataFrame, identity: str, rows: int, namespace: str = "qualification-panel") -> tuple[DataFrame, DataFrame]:
    """Two panels, the first of exactly `rows` rows, that share no value of `identity` (an image's path or hash)."""
    sizes = {r[0]: r[1] for r in records.groupBy(identity).count().collect()}  # a panel's images
    first = records.sparkSession.createDataFrame([(i,) for i in sorted(allocation.exact_panel(sizes, rows, namespace))], f"{identity} string")
    return records.join(F.broadcast(first), identity, "left_semi"), records.join(F.broadcast(first), identity, "left_anti")


def unseen_build(train: DataFrame, seen: DataFrame, qualification: DataFrame, forbidden: DataFrame, *, rounds: tuple[int, int], weights: dict[str, float], per_chart: int, dual: float, panel: int, version: str, strict: bool = True, identity: str = "image") -> tuple[dict[str, DataFrame], dict]:
    """round_1, round_2, teacher_qualification and development, and the audit of what they must not share."""
    parts = [cut_lineage(p) for p in unseen_rounds(train, seen, rounds, weights, per_chart, strict)]
    out: dict[str, DataFrame] = {}
    for i, part in enumerate(parts, 1):
        twice = dual_rollouts(part, dual, f"opd:round{i}:rollouts", ["task_type", "view_type"]).filter("rollout_count = 2").select("id")
        out[f"round_{i}"] = cut_lineage(annotated(part, twice, i, version))
    everything = out["round_1"].unionByName(out["round_2"])
    first, second = disjoint_panels(qualification, identity, panel)
    out |= {"teacher_qualification": first, "development": second}
    audit = {"forbidden": no_overlap(everything, forbidden, ("id", identity)), "qualification": no_overlap(everything, qualification, ("id", identity)), "panels": no_overlap(first, second, ("id", identity))}
    sizes = {k: df.count() for k, df in out.items()}
    _checked((sizes["round_1"], sizes["round_2"]) == tuple(rounds), f"the rounds have {sizes} rows")
    return out, audit | {"rows": sizes}
