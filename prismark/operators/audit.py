"""Dataset audits: distributions, duplicates, leakage, decontamination, row validation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from prismark.functions.hashing import content_hash


def distributions(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, value, n: one-column distributions of several columns from one pass over the rows (grouping sets)."""
    named = df.select(*(F.col(f).cast("string").alias(f) for f in fields))
    grouped = named.groupingSets([[F.col(f)] for f in fields], *(F.col(f) for f in fields)).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    width = len(fields)
    which = F.element_at(F.create_map(*(x for i, f in enumerate(fields) for x in (F.lit((1 << width) - 1 - (1 << (width - 1 - i))), F.lit(f)))), F.col("g").cast("int"))
    return grouped.select(which.alias("field"), F.coalesce(*fields).alias("value"), "n")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has, with their number."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def leakage_matrix(df: DataFrame, split: str, keys: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """left_split, right_split, key, n_shared: values of each key that two splits share."""
    parts = []
    for key in keys:
        has = df.groupBy(key).agg(*(F.max(F.col(split) == s).alias(s) for s in sorted({s for p in pairs for s in p})))
        parts += [has.agg(F.coalesce(F.count_if(F.col(a) & F.col(b)), F.lit(0)).alias("n_shared")).select(F.lit(a).alias("left_split"), F.lit(b).alias("right_split"), F.lit(key).alias("key"), "n_shared") for a, b in pairs]
    return reduce(DataFrame.unionByName, parts)


def decontaminate(train: DataFrame, protected: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(clean rows, removed rows) of `train` by a content key that `protected` has too; nothing is refilled."""
    hits = protected.select(key).distinct()
    return train.join(hits, key, "left_anti"), train.join(hits, key, "left_semi")


def _run(i: Column, words: int) -> Column:
    """Hash of the words from i on, from their hashes in _hashes."""
    return F.xxhash64(*(F.get(F.col("_hashes"), i + k) for k in range(words)))


def _runs_of(words: int) -> Callable[[Column], Column]:
    return lambda i: _run(i, words)


#: Passages whose runs may be broadcast; more are joined by shuffle.
BROADCAST_PASSAGES = 200_000


def contained_passages(texts: DataFrame, text: str, passages: DataFrame, passage: str, words: int = 8) -> DataFrame:
    """Rows of `texts` with the passages that they contain (column `item_id`).

    Passages meet texts by runs of their inner words, which the text has as words of its
    own whatever stands before and after the passage: the longest of `words`, 3 or 1 that
    there are. Passages of one or two words are met by their first 8, 3 or 1 characters.
    Only (text key, run) pairs are compared; texts themselves are looked at where a run met.
    """
    def hashed(df: DataFrame, column: str, pattern: str) -> DataFrame:
        # Two projections, so that no array is made again for each element.
        split = df.withColumn("_words", F.split(F.trim(F.col(column)), pattern))
        return split.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))).drop("_words")

    needle = F.trim(F.col(passage))
    inner = F.size(F.split(needle, r"\s+")) - 2
    tiers = [(r"\s+", n, 1, inner >= n) for n in sorted({words, 3, 1}, reverse=True)] + [("", n, 0, F.char_length(needle) >= n) for n in (8, 3, 1)]
    keyed = passages.filter(needle != "").withColumn("_tier", F.coalesce(*(F.when(tier[3], i) for i, tier in enumerate(tiers))))
    found = {r[0]: r[1] for r in keyed.groupBy("_tier").count().collect()}  # texts are cut into runs only for these
    small = sum(found.values()) <= BROADCAST_PASSAGES
    bounded = F.broadcast if small else (lambda df: df)
    keys = texts.select(F.md5(F.col(text)).alias("_key"), F.col(text).alias("_text"))
    hits = []
    for i in sorted(found) or [0]:
        pattern, n, first, _ = tiers[i]
        part = hashed(keyed.filter(F.col("_tier") == i), passage, pattern).select(_run(F.lit(first), n).alias("_run"), "item_id")
        starts = F.sequence(F.lit(0), F.size("_hashes") - n)
        runs = hashed(keys, "_text", pattern).filter(F.size("_hashes") >= n).select("_key", F.explode(F.array_distinct(F.transform(starts, _runs_of(n)))).alias("_run"))
        hits.append(runs.join(bounded(part), "_run").select("_key", "item_id"))
    met = reduce(DataFrame.unionByName, hits).distinct().join(bounded(passages), "item_id")
    return texts.withColumn("_key", F.md5(F.col(text))).join(met, "_key").filter(F.contains(F.col(text), needle)).drop("_key")


def forbidden_overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """key, n_overlap: distinct values that both sides have, for each key."""
    parts = [left.select(k).distinct().join(right.select(k).distinct(), k, "left_semi").agg(F.count("*").alias("n_overlap")).select(F.lit(k).alias("key"), "n_overlap") for k in keys]
    return reduce(DataFrame.unionByName, parts)


def record_errors(fields: dict[str, Column]) -> Column:
    """Names of the failed checks (name to "is wrong") of a row, as an array."""
    return F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in fields.items())))


def record_checks(*, splits: list[str], tasks: list[str], levels: list[str]) -> dict[str, Column]:
    """Sixteen checks of a record with the columns of RECORD and its parsed ground_truth `gt`; the JSON text tells lists from other values."""
    path = F.col("image")
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    required = ["dataset", "entity_id", "chart_id", "industry", "view_type"]
    # Fields that must be lists, where the text has them at all.
    not_list = lambda f: F.coalesce(~F.get_json_object("ground_truth", f"$.{f}").startswith("["), F.lit(False))
    return {
        "required": reduce(Column.__or__, (F.col(c).isNull() for c in required)),
        "sections_list": not_list("required_sections"),
        "targets_list": not_list("numeric_targets"),
        "support_list": not_list("numeric_support"),
        "id": F.col("id").isNull() | ~F.col("id").rlike(r"^[a-z0-9][a-z0-9_.-]*$"),
        "split": ~F.coalesce(F.col("split").isin(splits), F.lit(False)),
        "task_type": ~F.coalesce(F.col("task_type").isin(tasks), F.lit(False)),
        "difficulty": ~F.coalesce(F.col("difficulty").isin(levels), F.lit(False)),
        "question": blank("question"),
        "answer": blank("answer"),
        "image": blank("image") | path.startswith("/") | path.contains("\\") | path.rlike(r"(^|/)\.\.(/|$)") | path.rlike("^[A-Za-z]:"),
        "ground_truth": F.col("gt").isNull(),
        "sections": F.coalesce(F.exists("gt.required_sections", lambda x: x.isNull()), F.lit(False)),
        "numeric_targets": F.coalesce(F.exists("gt.numeric_targets", lambda t: t["value"].isNull() | F.isnan(t["value"])), F.lit(False)),
        "terms": F.coalesce(F.exists("gt.numeric_targets", lambda t: F.exists(F.coalesce(t["terms"], F.array().cast("array<string>")), lambda x: F.trim(x) == "")), F.lit(False)),
        "numeric_support": F.coalesce(F.exists("gt.numeric_support", lambda s: s["value"].isNull() | s["tolerance"].isNull() | (s["tolerance"] < 0)), F.lit(False)),
    }


def with_content_hash(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("content_hash", content_hash(F.col(text)))
