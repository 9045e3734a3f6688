"""Sources, set operations, distributions, duplicates, leakage, alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from prismark.functions.hashing import content_hash, hash_number, ordered_hash, stable_hash
from prismark.operators import alignment, audit, prompts, rollouts
from prismark.operators.selection import hash_topk
from prismark.plans.registry import query
from prismark.plans.views import RECORDS, hashed_records, predictions, PREDICTIONS, records, series, SERIES, sql_hash, sql_number, table

PAIRS_OF_SPLITS = [("train", "val"), ("train", "test"), ("val", "test")]


@query(f"""
    with r as (select doc_id, lang, row_number() over (partition by lang order by {sql_hash('source', 'doc_id')}, doc_id) as k from documents where lang in ('en', 'de', 'fr'))
    select 'src_' || lang as source_name, doc_id, rep::bigint as repeat from r, (values (0), (1)) t(rep) where k <= 40 and (rep = 0 or lang = 'de')""")
def multi_source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources, the first 40 rows of each in hash order, one of them twice."""
    docs = table(spark, sf_dir, "documents")

    def source(lang: str, repeat: int) -> DataFrame:
        rows = hash_topk(docs.filter(F.col("lang") == lang).select("doc_id"), "source", "doc_id", 40)
        return rows.select(F.lit(f"src_{lang}").alias("source_name"), "doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(repeat - 1).cast("bigint"))).alias("repeat"))

    return reduce(DataFrame.unionByName, [source("en", 1), source("de", 2), source("fr", 1)])


@query("""
    with p as (select page_id, string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') as parts from pages),
    s as (select page_id, array_to_string(list_slice(parts, i, len(parts)), '/') as suffix from p, unnest(range(1, len(parts) + 1)) t(i))
    select suffix, min(page_id) as page_id from s where suffix <> '' group by suffix having count(*) = 1""")
def unique_suffix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffixes of url paths that lead to one page only."""
    parts = F.split(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), "/")
    rows = table(spark, sf_dir, "pages").select("page_id", parts.alias("parts"))
    suffixes = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", i, F.size("parts")), "/"))
    return rows.select("page_id", F.explode(suffixes).alias("suffix")).filter("suffix <> ''").groupBy("suffix").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n")).filter("n = 1").drop("n")


VIEWS = ["operations", "growth", "composition", "dashboard"]


@query(f"""
    with e as (select distinct entity from {SERIES}),
    v as (select entity, 'financial' as view from e union all
          select entity, list_extract({VIEWS}, ({sql_number('view', 'entity')} % 4 + 1)::int) from e)
    select entity, view, entity || '_' || view as chart from v""")
def explode_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's two views, the second picked by hash."""
    entities = series(spark, sf_dir).select("entity").distinct()
    second = F.element_at(F.array(*map(F.lit, VIEWS)), (hash_number("view", F.col("entity")) % 4 + 1).cast("int"))
    return entities.withColumn("view", F.explode(F.array(F.lit("financial"), second))).withColumn("chart", F.concat_ws("_", "entity", "view"))


@query("select event_id as id, user_id as user_name, coalesce(value, 0) as score, coalesce(props, '{}') as metadata from events where event_type = 'purchase'")
def filter_rename_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One kind of row under another's column names, with defaults."""
    return table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("user_name"), F.coalesce("value", F.lit(0.0)).alias("score"), F.coalesce("props", F.lit("{}")).alias("metadata"))


@query("""
    select event_type, count(*) as n, count(*) filter (props is null or not json_valid(props)) as bad, count(json_extract(case when json_valid(props) then props end, '$.k')) as with_k
    from events group by event_type""")
def json_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON text into typed columns: rows, failures, and rows with the field."""
    parsed = F.try_parse_json("props")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(parsed.isNull()).alias("bad"), F.count(F.try_variant_get(parsed, "$.k", "string")).alias("with_k"))


@query(f"""
    with r as (select id, case when {sql_number('break', 'id')} % 7 = 0 then 'Bad Id' else 'r' || id end as rid,
                      case when {sql_number('break', 'id')} % 11 = 0 then 'dev' else split end as split, task,
                      case when {sql_number('break', 'id')} % 13 = 0 then '../x.png' else 'img/' || id || '.png' end as image from {RECORDS}),
    e as (select unnest([case when not regexp_full_match(rid, '[a-z0-9][a-z0-9_.-]*') then 'id' end, case when split not in ('train', 'val', 'test') then 'split' end,
                         case when task not in ('en', 'de', 'fr') then 'task_type' end, case when image like '%..%' then 'image' end]) as error from r)
    select error, count(*) as n from e where error is not null group by error""")
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed checks by kind over rows of which some are broken by hash."""
    h = hash_number("break", F.col("id"))
    rows = records(spark, sf_dir).select(
        F.when(h % 7 == 0, "Bad Id").otherwise(F.concat(F.lit("r"), F.col("id"))).alias("id"), F.when(h % 11 == 0, "dev").otherwise(F.col("split")).alias("split"), F.col("task").alias("task_type"), "difficulty",
        F.lit("q").alias("question"), F.lit("a").alias("answer"), F.when(h % 13 == 0, "../x.png").otherwise(F.concat(F.lit("img/"), F.col("id"), F.lit(".png"))).alias("image"))
    checks = audit.record_checks(splits=["train", "val", "test"], tasks=["en", "de", "fr"], levels=["easy", "medium", "hard"])
    wanted = {k: v for k, v in checks.items() if k in ("id", "split", "task_type", "difficulty", "question", "answer", "image")}
    return rows.select(F.explode(audit.record_errors(wanted)).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


_TURNS = "(select conv_id, count(*) as n, arg_max(text, turn) as last_text, arg_max(role, turn) as last_role from conversations group by conv_id)"


@query("""
    with t as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn desc) as back, count(*) over (partition by conv_id) as n from conversations),
    g as (select conv_id, max(n) as n_turns, max(case when back = 1 then coalesce(text, '') end) as last,
                 string_agg(upper(role[1]) || lower(role[2:]) || ': ' || coalesce(text, ''), chr(10) order by turn) filter (back > 1) as history from t group by conv_id)
    select conv_id, n_turns, case when n_turns > 1 then 'Conversation history:' || chr(10) || history || chr(10) || chr(10) || last else last end as prompt from g""")
def conversation_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered turns as one prompt."""
    return prompts.flatten_conversation(table(spark, sf_dir, "conversations")).withColumn("n_turns", F.col("n_turns").cast("bigint"))


@query(f"""
    select count(*) as before, count(*) filter (last_role = 'assistant' and trim(last_text) <> '') as after,
           count(*) filter (not coalesce(last_role = 'assistant' and trim(last_text) <> '', false)) as removed from {_TURNS}""")
def quality_exclusion_no_refill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that end in a non-blank assistant turn; the others are removed without replacement."""
    last = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by(F.struct("role", "text"), "turn").alias("last"))
    good = F.coalesce((F.col("last.role") == "assistant") & (F.trim("last.text") != ""), F.lit(False))
    return last.agg(F.count("*").alias("before"), F.count_if(good).alias("after"), F.count_if(~good).alias("removed"))


@query("""
    select 'nation' as name, count(*) as n, min(n_nationkey)::bigint as lowest, max(n_nationkey)::bigint as highest, count(distinct n_nationkey) as n_distinct,
           count(*) = count(distinct n_nationkey) and min(n_nationkey) = 0 and max(n_nationkey) = count(*) - 1 as dense from nation
    union all select 'customer', count(*), min(c_custkey), max(c_custkey), count(distinct c_custkey), count(*) = count(distinct c_custkey) and min(c_custkey) = 0 and max(c_custkey) = count(*) - 1 from customer""")
def dense_index_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether keys are exactly 0 .. n - 1."""
    checks = [alignment.dense_index(table(spark, sf_dir, t), k).select(F.lit(t).alias("name"), "*") for t, k in (("nation", "n_nationkey"), ("customer", "c_custkey"))]
    return reduce(DataFrame.unionByName, checks)


@query("""
    select conv_id, turn, concat_ws(chr(10), case when role = 'user' then 'Answer the question.' else 'Continue the text.' end,
           case when turn > 0 then 'Background: turn ' || turn end, text) as prompt from conversations""")
def prompt_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A system part by role, a background where there is one, and the text."""
    system = F.when(F.col("role") == "user", "Answer the question.").otherwise("Continue the text.")
    background = F.when(F.col("turn") > 0, F.concat(F.lit("turn "), F.col("turn")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", prompts.instruction(system, background, F.col("text")).alias("prompt"))


@query("""
    select conv_id, count(*) as n_messages, string_agg(role, ',' order by turn) as roles, string_agg(length(coalesce(text, ''))::varchar, ',' order by turn) as lengths from conversations group by conv_id""")
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as an array of structs, told by roles and lengths."""
    rows = prompts.chat_messages(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), F.array_join(F.transform("messages", lambda m: F.char_length(F.coalesce(m["content"], F.lit(""))).cast("string")), ",").alias("lengths"))


@query(f"""
    with p as (select * from {PREDICTIONS}),
    b as (select id, answer, task from p where model = 'base' and {sql_number('dropb', 'id')} % 50 <> 0),
    c as (select id, case when {sql_number('alter', 'id')} % 40 = 0 then answer || '0' else answer end as answer, task from p where model = 'cand' and {sql_number('dropc', 'id')} % 60 <> 0)
    select count(*) filter (b.id is not null and c.id is not null) as matched, count(*) filter (c.id is null) as left_only, count(*) filter (b.id is null) as right_only,
           count(*) filter (b.id is not null and c.id is not null and (b.answer, b.task) is distinct from (c.answer, c.task)) as mismatched
    from b full join c on b.id = c.id""")
def paired_join_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two prediction sets, some rows dropped and some references altered by hash."""
    rows = predictions(spark, sf_dir)
    base = rows.filter((F.col("model") == "base") & (hash_number("dropb", F.col("id")) % 50 != 0))
    cand = rows.filter((F.col("model") == "cand") & (hash_number("dropc", F.col("id")) % 60 != 0)).withColumn("answer", F.when(hash_number("alter", F.col("id")) % 40 == 0, F.concat("answer", F.lit("0"))).otherwise(F.col("answer")))
    return alignment.paired_audit(base, cand, "id", ["answer", "task"])


@query(f"""
    with e as (select o_orderkey as id, {sql_hash('resume', 'o_orderkey')} as h, {sql_number('done', 'o_orderkey')} % 400 <> 0 as done from orders),
    s as (select min((h, id)) as stop from e where not done)
    select count(*) filter (done) as n_done, count(*) filter (done and (h, id) < (select stop from s)) as prefix_length, 0::bigint as n_unknown from e""")
def resume_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the work, in hash order, is done without a gap."""
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), stable_hash("resume", F.col("o_orderkey")).alias("h"))
    return alignment.resume_prefix(expected, expected.filter(hash_number("done", F.col("id")) % 400 != 0).select("id"), "id", "h")


@query(f"""
    select o_orderkey as id, {sql_number('lines', 'o_orderkey')} % 7 + 1 as expected, count(l_orderkey) as found from orders left join lineitem on o_orderkey = l_orderkey
    group by o_orderkey having expected <> found""")
def fk_cardinality_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose number of lines is not the one requested."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return alignment.foreign_key_counts(orders, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")), "id", hash_number("lines", F.col("id")) % 7 + 1)


@query("""
    select c_mktsegment as segment, count(*) as lines, count(distinct o_orderkey) as orders,
           (select count(*) from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)) as orders_without_lines,
           (select count(*) from lineitem where not exists (select 1 from orders where l_orderkey = o_orderkey)) as lines_without_orders
    from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey group by c_mktsegment""")
def three_way_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables joined, and what finds no partner."""
    customer, orders, lines = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    keys, line_keys = orders.select("o_orderkey", "o_custkey"), lines.select("l_orderkey")
    joined = customer.select("c_custkey", "c_mktsegment").join(keys, F.col("c_custkey") == F.col("o_custkey")).join(line_keys, F.col("l_orderkey") == F.col("o_orderkey"))
    bare = keys.join(line_keys, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").agg(F.count("*").alias("n"))
    stray = line_keys.join(keys, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").agg(F.count("*").alias("n"))
    grouped = joined.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("lines"), F.countDistinct("o_orderkey").alias("orders"))
    return grouped.withColumns({"orders_without_lines": bare.scalar(), "lines_without_orders": stray.scalar()})


@query(f"""
    with r as (select * from {RECORDS}), t as (select * from r where split = 'train'),
    h as (select distinct content_hash from r where split <> 'train'), b as (select distinct t.id from t join benchmark on contains(t.text, trim(benchmark.text)) where trim(benchmark.text) <> '')
    select t.id, case when h.content_hash is not null and b.id is not null then 'both' when h.content_hash is not null then 'copy' when b.id is not null then 'passage' else 'clean' end as status
    from t left join h using (content_hash) left join b using (id)""")
def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows against copies in the other splits and against benchmark passages."""
    rows = records(spark, sf_dir)
    train = audit.with_content_hash(rows.filter("split = 'train'"))
    held = audit.with_content_hash(rows.filter("split <> 'train'")).select("content_hash")
    _, copies = audit.decontaminate(train.select("id", "content_hash"), held, "content_hash")
    passages = audit.contained_passages(train.select("id", "text"), "text", table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage")), "passage")
    status = F.when(F.col("copy") & F.col("passage"), "both").when(F.col("copy"), "copy").when(F.col("passage"), "passage").otherwise("clean")
    flags = train.select("id").join(copies.select("id", F.lit(True).alias("copy")), "id", "left").join(passages.select("id").distinct().withColumn("passage", F.lit(True)), "id", "left")
    return flags.na.fill(False, ["copy", "passage"]).select("id", status.alias("status"))


@query(f"""
    with r as (select distinct split, content_hash from {RECORDS})
    select a.split as left_split, b.split as right_split, count(*) as n_shared from r a join r b using (content_hash) where (a.split, b.split) in (('train', 'val'), ('train', 'test'), ('val', 'test')) group by 1, 2""")
def pairwise_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content that two splits share, by pair."""
    matrix = audit.leakage_matrix(hashed_records(spark, sf_dir), "split", ["content_hash"], PAIRS_OF_SPLITS)
    return matrix.drop("key").filter("n_shared > 0")


@query(f"select id, task from {RECORDS} where {sql_number('seen', 'id')} % 10 >= 3")
def exclude_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that an earlier selection did not use."""
    rows = records(spark, sf_dir).select("id", "task")
    return rows.join(rows.filter(hash_number("seen", F.col("id")) % 10 < 3).select("id"), "id", "left_anti")


@query(f"""
    with r as (select * from {RECORDS}), t as (select * from r where split = 'train'), v as (select * from r where split <> 'train' or id % 97 = 0)
    select 'id' as key, count(*) as n_overlap from (select id from t intersect select id from v)
    union all select 'chart', count(*) from (select chart from t intersect select chart from v)
    union all select 'content_hash', count(*) from (select content_hash from t intersect select content_hash from v)""")
def forbidden_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two panels must not share, by id, chart and content."""
    rows = hashed_records(spark, sf_dir)
    return audit.forbidden_overlap(rows.filter("split = 'train'"), rows.filter("split <> 'train' or id % 97 = 0"), ["id", "chart", "content_hash"])


@query(f"select task, count(*) as n from {RECORDS} group by task")
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by task."""
    return records(spark, sf_dir).groupBy("task").agg(F.count("*").alias("n"))


_FIELDS = ["task", "entity", "chart", "difficulty", "split"]


@query(" union all ".join(f"select '{f}' as field, {f} as value, count(*) as n from {RECORDS} group by {f}" for f in _FIELDS))
def grouping_sets_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five distributions from one pass."""
    return audit.distributions(records(spark, sf_dir).drop("text"), _FIELDS)


@query(f"select count(*) as n_rows, count(distinct id) as n_ids, count(distinct entity) as n_entities, count(distinct chart) as n_charts, count(distinct content_hash) as n_contents from {RECORDS}")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct counts."""
    named = {"id": "n_ids", "entity": "n_entities", "chart": "n_charts", "content_hash": "n_contents"}
    return hashed_records(spark, sf_dir).agg(F.count("*").alias("n_rows"), *(F.countDistinct(c).alias(n) for c, n in named.items()))


@query(f"select content_hash, count(*) as n from {RECORDS} group by content_hash having count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that more than one record has."""
    return audit.duplicates(hashed_records(spark, sf_dir), "content_hash")


@query("select conv_id, count(*) as n from conversations group by conv_id having count(*) <> 4")
def group_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that do not have exactly four rows."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).filter("n <> 4")


@query("select conv_id, count(*) as n, count(distinct text) as n_distinct from conversations group by conv_id having count(distinct text) < count(*)")
def collapsed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in which a value repeats."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_distinct")).filter("n_distinct < n")


@query("select count(*) as n, count(distinct text) as n_distinct, round(count(distinct text) / count(*), 6) as ratio, count(distinct text) / count(*) < 0.8 as failed from documents")
def unique_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of distinct texts, against a least share."""
    counts = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.countDistinct(content_hash(F.col("text"))).alias("n_distinct"))
    ratio = F.col("n_distinct") / F.col("n")
    return counts.select("n", "n_distinct", F.round(ratio, 6).alias("ratio"), (ratio < 0.8).alias("failed"))


@query("with r as (select * from " + RECORDS + ") " + " union all ".join(
    f"select '{a}' as left_split, '{b}' as right_split, '{k}' as key, (select count(*) from (select {k} from r where split = '{a}' intersect select {k} from r where split = '{b}')) as n_shared"
    for a, b in PAIRS_OF_SPLITS for k in ("entity", "chart", "content_hash")))
def leakage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of three keys that splits share."""
    return audit.leakage_matrix(hashed_records(spark, sf_dir), "split", ["entity", "chart", "content_hash"], PAIRS_OF_SPLITS)


@query(f"select count(*) as n, count(*) filter (abs(revenue - cost - profit) > 0.11) as broken from {SERIES}")
def identity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """revenue - cost = profit, within rounding."""
    return series(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("revenue") - F.col("cost") - F.col("profit")) > 0.11).alias("broken"))


@query(f"""
    with r as (select * from {RECORDS}),
    c as (select 'duplicate_content' as check_name, 'high' as severity, (select count(*) from (select content_hash from r group by 1 having count(*) > 1)) as n
          union all select 'blank_text', 'critical', (select count(*) from r where trim(text) = '')
          union all select 'entity_leak', 'critical', (select count(*) from (select entity from r where split = 'train' intersect select entity from r where split = 'test'))
          union all select 'short_text', 'low', (select count(*) from r where n_chars < 50))
    select check_name, severity, n, n = 0 or severity = 'low' as passed from c""")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks by severity; only serious ones fail."""
    rows = records(spark, sf_dir).withColumn("blank", F.trim("text") == "")
    hashed = audit.with_content_hash(rows).drop("text")
    leak = audit.leakage_matrix(hashed, "split", ["entity"], [("train", "test")]).select(F.col("n_shared").alias("n"))
    parts = [
        ("duplicate_content", "high", audit.duplicates(hashed, "content_hash").agg(F.count("*").alias("n"))),
        ("blank_text", "critical", hashed.agg(F.count_if("blank").alias("n"))),
        ("entity_leak", "critical", leak),
        ("short_text", "low", hashed.agg(F.count_if(F.col("n_chars") < 50).alias("n"))),
    ]
    found = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("check_name"), F.lit(level).alias("severity"), "n") for name, level, df in parts])
    return found.withColumn("passed", (F.col("n") == 0) | (F.col("severity") == "low"))


@query(f"""
    with r as (select * from {RECORDS}), d as (select content_hash, count(*) as c from r group by 1)
    select split, count(*) as n, count(*) - count(distinct r.content_hash) as surplus, count(*) filter (trim(text) = '') as blank, min(id) as first_id from r group by split""")
def preflight_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, surplus copies, blanks and the first id of each source."""
    rows = audit.with_content_hash(records(spark, sf_dir).withColumn("is_blank", F.trim("text") == "")).drop("text")
    return rows.groupBy("split").agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("content_hash")).alias("surplus"), F.count_if("is_blank").alias("blank"), F.min("id").alias("first_id"))


@query(f"select id, split as origin from {RECORDS} where split = 'train' union all select id, split from {RECORDS} where split = 'val' union all select id, split from {RECORDS} where split = 'test'")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits put together, tagged."""
    rows = records(spark, sf_dir).drop("text")
    return reduce(DataFrame.unionByName, [rows.filter(F.col("split") == s).select("id", F.lit(s).alias("origin")) for s in ("train", "val", "test")])


@query("select o_custkey as id from orders where o_orderstatus = 'O' except all select o_custkey from orders where o_orderstatus = 'F'")
def except_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of one side that the other lacks, as multisets."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus")
    return orders.filter("o_orderstatus = 'O'").select("id").exceptAll(orders.filter("o_orderstatus = 'F'").select("id"))


@query("""
    select 'orders in customers' as test, (select count(*) from (select distinct o_custkey from orders where o_custkey not in (select c_custkey from customer))) as missing
    union all select 'customers in orders', (select count(*) from customer where c_custkey not in (select o_custkey from orders))""")
def subset_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one key set lies in another, both ways."""
    a, b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct(), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    test = lambda name, x, y: x.join(y, "k", "left_anti").agg(F.count("*").alias("missing")).select(F.lit(name).alias("test"), "missing")
    return test("orders in customers", a, b).unionByName(test("customers in orders", b, a))


@query("select n_regionkey as region, sha256(string_agg(n_name || chr(10), '' order by n_nationkey)) as digest from nation group by 1")
def ordered_hash_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash over names in order, by region."""
    return table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(ordered_hash(F.col("n_nationkey"), F.col("n_name")).alias("digest"))


@query(f"select n_nationkey as id, {sql_hash('nation', 'n_name')} as h, {sql_number('nation', 'n_name')} as number from nation")
def stable_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash and number of each name."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), stable_hash("nation", F.col("n_name")).alias("h"), hash_number("nation", F.col("n_name")).alias("number"))


@query("select doc_id, sha256(text) as content_hash from documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content identity of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("content_hash"))


@query("select conv_id, turn, (sum(length(coalesce(text, ''))) over (partition by conv_id order by turn) - length(coalesce(text, '')))::bigint as start from conversations")
def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each turn begins in its conversation's text."""
    rows = alignment.running_offsets(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.char_length(F.coalesce("text", F.lit(""))))
    return rows.select("conv_id", "turn", F.col("start").cast("bigint").alias("start"))


@query(f"""
    select n_nationkey as id, 'n_name' as field, n_name as left_value, upper(n_name) || '!' as right_value from nation where {sql_number('differ', 'n_nationkey')} % 3 = 0
    union all select n_nationkey, 'n_regionkey', n_regionkey::varchar, null from nation where {sql_number('differ', 'n_nationkey')} % 5 = 0""")
def null_safe_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that differ between two versions of a table."""
    left = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), "n_name", "n_regionkey")
    h = hash_number("differ", F.col("id"))
    right = left.withColumns({"n_name": F.when(h % 3 == 0, F.concat(F.upper("n_name"), F.lit("!"))).otherwise(F.col("n_name")), "n_regionkey": F.when(h % 5 != 0, F.col("n_regionkey"))})
    return alignment.null_safe_diff(left, right, "id", ["n_name", "n_regionkey"])


@query(f"""
    select id, rep::bigint as rollout_index, id || '_' || rep as rollout_key, {sql_number('rollout', 'id', 'rep')} % 2147483648 as seed
    from {RECORDS}, (values (0), (1)) t(rep) where rep = 0 or difficulty = 'hard'""")
def explode_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job a record, two for hard ones, each with its seed."""
    jobs = prompts.rollout_jobs(records(spark, sf_dir).drop("text"), "id", F.when(F.col("difficulty") == "hard", 2).otherwise(1), "rollout")
    return jobs.select("id", F.col("rollout_index").cast("bigint").alias("rollout_index"), "rollout_key", "seed")


@query("""
    select label, count(*) as n, count(*) filter (len(embedding) <> 64) as other_length, count(distinct len(embedding)) as lengths,
           count(*) filter (len(list_filter(embedding, lambda x: not isfinite(x))) > 0) as not_finite from embeddings group by label""")
def array_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and finite values of arrays."""
    wrong = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(
        F.count("*").alias("n"), F.count_if(F.size("embedding") != 64).alias("other_length"), F.countDistinct(F.size("embedding")).alias("lengths"), F.count_if(F.exists("embedding", wrong)).alias("not_finite"))


@query("""
    select label, sha256('[' || array_to_string(list_transform(embedding[1:4], lambda x: floor(x * 100)::int), ',') || ']') as digest, count(*) as n from embeddings group by 1, 2""")
def token_array_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of whole numbers by content."""
    ids = F.transform(F.slice("embedding", 1, 4), lambda x: F.floor(x * 100).cast("int"))
    return table(spark, sf_dir, "embeddings").groupBy("label", rollouts.array_hash(ids).alias("digest")).agg(F.count("*").alias("n"))


@query("""
    with t as (select label, unnest(list_transform(range(0, 4), lambda i: exp(-1 - abs(embedding[2 * i + 1]::double)) + exp(-1 - abs(embedding[2 * i + 2]::double)))) as m from embeddings)
    select label, count(*) as tokens, round(avg(m), 6) as mean_mass, round(min(m), 6) as least_mass from t group by label""")
def topk_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability mass of top entries by shard: four tokens of two entries each."""
    logs = F.transform(F.slice("embedding", 1, 8), lambda x: -1 - F.abs(x.cast("double")))
    rows = table(spark, sf_dir, "embeddings").select("label", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(logs, i * 2 + 1, 2)).alias("topk_logprobs"))
    return rollouts.mass_summary(rows, "label")


@query()
def dual_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the records twice, hard ones first."""
    return rollouts.dual_rollouts(records(spark, sf_dir).drop("text"), 0.25, "dual", ["task", "split"]).groupBy("difficulty", "rollout_count").agg(F.count("*").alias("n"))
