"""Public question sets as records: plain answers, list answers in conversations, and free answers to finance images.

Each adapter is a projection of a table of source rows; images are told by the
SHA-256 of their bytes, which the caller has read (see records.read_images).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from prismark.functions.text import FLOAT_SHAPE, strip
from prismark.operators.audit import record_checks, record_errors
from prismark.sources.records import METADATA, _FIELDS, with_truth

#: Allowed values of a record's closed fields.
SPLITS = ["train", "val", "test"]
TASKS = ["value_retrieval", "numerical_reasoning", "trend_analysis", "relationship_analysis", "risk_diagnosis", "decision_support", "comprehensive_report", "public_chartqa", "public_chartqapro", "public_mmefinance"]
LEVELS = ["easy", "medium", "hard"]
#: Columns of the finance table.
FINANCE_COLUMNS = ["index", "image_path", "image_type", "image_style", "task_category", "question", "answer", "background"]
_TARGETS = "array<struct<name:string,value:double,unit:string,tolerance:double,terms:array<string>>>"
_TRENDS = "array<struct<metric:string,label:string,terms:array<string>,opposites:array<string>>>"


def listify(value: Column, kind: str) -> Column:
    """A list of texts from a list, a single value or null (`kind`: the column's type)."""
    if kind.startswith("array"):
        return F.coalesce(value.cast("array<string>"), F.array().cast("array<string>"))
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value.cast("string")))


def numeric_answer(value: Column) -> Column:
    """The number of a public answer, or null: commas and a final percent sign are dropped, not applied."""
    bare = F.regexp_replace(F.replace(strip(value), F.lit(","), F.lit("")), "%+$", "")
    return F.when(F.lower(bare).rlike(FLOAT_SHAPE), F.replace(bare, F.lit("_"), F.lit("")).try_cast("double"))


def public_truth(answers: Column, longest: int = 160, mode: str | None = None) -> Column:
    """Ground truth of a public answer: its aliases, and a target within 5 % where the first one is a number."""
    number = numeric_answer(F.get(answers, F.lit(0)))
    target = F.struct(F.lit("public_answer").alias("name"), number.alias("value"), F.lit("").alias("unit"), F.round(F.greatest(F.lit(0.05), F.abs(number) * 0.05), 6).alias("tolerance"), F.lit(None).cast("array<string>").alias("terms"))
    none = F.array().cast("array<string>")
    fields = {
        "required_sections": none, "numeric_targets": F.when(number.isNotNull(), F.array(target)).otherwise(F.array().cast(_TARGETS)), "trend_targets": F.array().cast(_TRENDS), "evidence_keywords": none,
        "risk_labels": none, "answer_aliases": answers, "grpo_eligible": F.lit(False), "length_range": F.array(F.lit(1), F.lit(longest)),
    }
    if mode:
        fields["evaluation_mode"] = F.lit(mode)
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def make_records(rows: DataFrame, fields: dict[str, Column], truth: Column, metadata: dict[str, Column]) -> DataFrame:
    """Records with the fourteen columns of RECORD; ground truth as JSON text, metadata not given is null."""
    known = [f.split(":", 1)[0] for f in _top_level(METADATA)]
    kinds = {f.split(":", 1)[0]: f.split(":", 1)[1] for f in _top_level(METADATA)}
    meta = F.struct(*(metadata.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in known))
    return rows.select(*(fields[f].cast("string").alias(f) for f in _FIELDS if f != "ground_truth"), F.to_json(truth).alias("ground_truth"), meta.alias("metadata")).select(*_FIELDS, "metadata")


def _top_level(kind: str) -> list[str]:
    """The fields of a struct type's text."""
    out, depth, part = [], 0, ""
    for c in kind.removeprefix("struct<").removesuffix(">"):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


def checked(records: DataFrame) -> DataFrame:
    """`records`, if every row passes the record checks; the error names the first that does not."""
    bad = with_truth(records).withColumn("errors", record_errors(record_checks(splits=SPLITS, tasks=TASKS, levels=LEVELS))).filter(F.size("errors") > 0)
    first = bad.select("id", "errors").first()
    if first:
        raise ValueError(f"record {first.id}: {first.errors}")
    return records


def _common(dataset: str, split: Column, chart: Column, number: Column) -> dict[str, Column]:
    return {"id": F.concat_ws("_", F.lit(dataset), split, number), "dataset": F.lit(dataset), "split": split, "entity_id": chart, "chart_id": chart, "industry": F.lit("general"), "view_type": F.lit("public_chart"), "task_type": F.lit(f"public_{dataset}")}


def plain_answers(source: DataFrame, split: str, licence: str = "") -> DataFrame:
    """Records of (source_index, image, image_sha256, query, label, human_or_machine); rows without any label are left out."""
    answers = listify(F.col("label"), source.schema["label"].dataType.simpleString())
    rows = source.withColumn("_answers", answers).filter(F.size("_answers") > 0)
    chart = F.concat(F.lit("chartqa_"), F.substring("image_sha256", 1, 16))
    fields = _common("chartqa", F.lit(split), chart, F.lpad(F.col("source_index").cast("string"), 6, "0")) | {"image": F.col("image"), "difficulty": F.lit("medium"), "question": strip(F.col("query")), "answer": F.get("_answers", F.lit(0))}
    meta = {"source_index": F.col("source_index"), "image_sha256": F.col("image_sha256"), "human_or_machine": F.coalesce(F.col("human_or_machine").cast("int"), F.lit(-1)), "license": F.lit(licence)}
    return make_records(rows, fields, public_truth(F.col("_answers")), meta)


def conversation_errors() -> Column:
    """What is wrong with a row of Question, Answer and Year lists, as an array of names."""
    q, a, y = F.col("Question"), F.col("Answer"), F.col("Year")
    empty = lambda c: F.coalesce(F.size(c) == 0, F.lit(True))
    return record_errors({
        "no_turns": empty(q) | empty(a), "turns_differ": F.size(q) != F.size(a), "no_years": empty(y),
        "year_flags": F.coalesce(F.exists(y, lambda f: ~F.upper(F.trim(f)).isin("YES", "NO")), F.lit(False)),
    })


def conversation_prompt(questions: Column, answers: Column) -> Column:
    """The last question, after the turns before it as history."""
    n = F.size(questions) - 1
    turns = F.zip_with(F.slice(questions, F.lit(1), n), F.slice(answers, F.lit(1), n), lambda q, a: F.concat(F.lit("User: "), strip(q), F.lit("\nAssistant: "), strip(a)))
    current = strip(F.element_at(questions, -1))
    return F.when(n > 0, F.concat(F.lit("Conversation history:\n"), F.array_join(turns, "\n"), F.lit("\nCurrent question: "), current)).otherwise(current)


def list_answers(source: DataFrame, licence: str = "") -> tuple[DataFrame, DataFrame]:
    """(records, quality) of (source_index, image, image_sha256, Question, Answer, Year, Question Type, Paragraph).

    Rows whose last answer is blank are removed and not refilled; rows whose Year flags are not as many
    as their answers are counted and stay. `quality` is one row of these counts.
    """
    bad = source.withColumn("_bad", conversation_errors()).filter(F.size("_bad") > 0).select("source_index", "_bad").first()
    if bad:
        raise ValueError(f"source row {bad.source_index}: {bad._bad}")
    rows = source.withColumns({"_answer": strip(F.element_at("Answer", -1)), "_odd": F.size("Year") != F.size("Answer"), "_type": F.coalesce(F.col("Question Type"), F.lit("unknown"))})
    quality = rows.agg(F.count("*").alias("before_records"), F.count_if(F.col("_answer") != "").alias("after_records"), F.count_if(F.col("_answer") == "").alias("removed_empty_final_answer"),
                       F.count_if("_odd").alias("year_flag_length_mismatch"), F.count_if(F.col("_odd") & (F.col("_answer") != "")).alias("retained_year_flag_length_mismatch"))
    kept = rows.filter(F.col("_answer") != "")
    paragraph = strip(F.coalesce("Paragraph", F.lit("")))
    prompt = conversation_prompt(F.col("Question"), F.col("Answer"))
    question = F.when(paragraph != "", F.concat(F.lit("Context: "), paragraph, F.lit("\nQuestion: "), prompt)).otherwise(prompt)
    chart = F.concat(F.lit("chartqapro_"), F.substring("image_sha256", 1, 16))
    fields = _common("chartqapro", F.lit("test"), chart, F.lpad(F.col("source_index").cast("string"), 5, "0")) | {"image": F.col("image"), "difficulty": F.lit("hard"), "question": question, "answer": F.col("_answer")}
    meta = {"source_index": F.col("source_index"), "question_type": F.col("_type"), "year_flags": F.col("Year"), "answer_sequence": F.col("Answer"), "license": F.lit(licence)}
    return make_records(kept, fields, public_truth(F.array("_answer")), meta), quality


def path_is_safe(path: Column) -> Column:
    """Whether a relative path stays within its folder."""
    p = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    return F.coalesce((p != "") & ~p.startswith("/") & ~p.rlike(r"(^|/)\.\.(/|$)") & ~p.rlike("^[A-Za-z]:"), F.lit(False))


def finance_answers(source: DataFrame, lookup: DataFrame, rows: int, revision: str = "", licence: str = "") -> DataFrame:
    """Records of the finance table (FINANCE_COLUMNS); `lookup` has suffix, image, sha256 of each unambiguous image.

    Raises unless every required value is there, every path is safe and found, and the indices are exactly 0 .. rows - 1.
    """
    required = ["question", "answer", "image_type", "image_style", "task_category"]
    path = F.replace(F.trim("image_path"), F.lit("\\"), F.lit("/"))
    named = source.select(F.trim("index").try_cast("int").alias("source_index"), path.alias("suffix"), path_is_safe(F.col("image_path")).alias("_safe"), *(strip(F.col(c)).alias(c) for c in required), F.coalesce("background", F.lit("")).alias("background"))
    joined = named.join(lookup.select("suffix", "image", F.col("sha256").alias("image_sha256")), "suffix", "left")
    blank = F.lit(False)
    for c in required:
        blank = blank | F.coalesce(F.col(c) == "", F.lit(True))
    found = joined.agg(F.count("*").alias("n"), F.countDistinct("source_index").alias("indices"), F.min("source_index").alias("low"), F.max("source_index").alias("high"), F.count_if(~F.col("_safe")).alias("unsafe"), F.count_if(F.col("image").isNull()).alias("missing"), F.count_if(blank).alias("blank")).first()
    if (found.n, found.indices, found.low, found.high) != (rows, rows, 0, rows - 1) or found.unsafe or found.missing or found.blank:
        raise ValueError(f"the table is not the {rows} rows that it should be: {found.asDict()}")
    chart = F.concat(F.lit("mmefinance_"), F.substring("image_sha256", 1, 16))
    fields = _common("mmefinance", F.lit("test"), chart, F.lpad(F.col("source_index").cast("string"), 5, "0")) | {"industry": F.lit("finance"), "view_type": F.col("image_type"), "image": F.col("image"), "difficulty": F.lit("hard"), "question": F.col("question"), "answer": F.col("answer")}
    meta = {c: F.col(c) for c in ("source_index", "image_sha256", "image_type", "image_style", "task_category", "background")} | {"source_image_path": F.col("suffix"), "dataset_revision": F.lit(revision), "license": F.lit(licence)}
    return make_records(joined, fields, public_truth(F.array("answer"), 1024, "official_image_aware_judge_with_auditable_surrogates"), meta).orderBy("metadata.source_index")


def decontaminated(splits: dict[str, DataFrame], key: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """(clean splits, removed rows with `overlaps_with`): test stays as it is, val gives way to test, train to both; nothing is refilled."""
    test, val, train = (splits[s].withColumn("_key", key) for s in ("test", "val", "train"))
    held = test.select("_key").distinct()
    clean_val = val.join(held, "_key", "left_anti")
    has = held.withColumn("_test", F.lit(True)).join(clean_val.select("_key").distinct().withColumn("_val", F.lit(True)), "_key", "full")
    judged = train.join(has, "_key", "left")
    labels = F.array_compact(F.array(F.when(F.col("_val"), F.lit("val")), F.when(F.col("_test"), F.lit("test"))))
    clean_train = judged.filter(F.col("_val").isNull() & F.col("_test").isNull()).select(*splits["train"].columns)
    removed = val.join(held, "_key", "left_semi").select(F.lit("val").alias("split"), "id", F.col("_key").alias("key"), F.array(F.lit("test")).alias("overlaps_with")).unionByName(
        judged.filter(F.col("_val") | F.col("_test")).select(F.lit("train").alias("split"), "id", F.col("_key").alias("key"), labels.alias("overlaps_with")))
    return {"test": splits["test"], "val": clean_val.drop("_key"), "train": clean_train}, removed
