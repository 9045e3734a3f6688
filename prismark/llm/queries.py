"""The subpackage's queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from prismark.llm import archives, fingerprints, jaccard, language, media, packing, pieces, token_files, toxicity, url_lists
from prismark.llm.store import scratch, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(divisor: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model that never sees the held-out fifth's labels."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").filter(_fold(5) != 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts through token files and back."""
    folder = scratch(spark, "token-files")
    manifest = token_files.write_token_files(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), "dropped", 1)
    return token_files.read_token_files(manifest, folder, ids=False)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as stored images, read back."""
    table = media.media_table(_table(spark, sf_dir, "documents"), scratch(spark, "media-shards"))
    return table.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "shard", "offset")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by a model that never sees the held-out third's."""
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(_fold(3) != 1))
    found = language.detect(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (_fold(3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share most of their five-word shingles."""
    return jaccard.similarity_classes(_table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of at most 1024."""
    cut = packing.pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "joined", 2, 1024)
    return packing.packed_pieces(cut, 1024)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of all documents and of their edited texts."""
    return fingerprints.fingerprint_table(_table(spark, sf_dir, "documents"))


def op10_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through ZIP-packaged WARC files and back."""
    packages = written(archives.write_packages(_table(spark, sf_dir, "pages"), scratch(spark, "packages")), scratch(spark, "package-list"))
    return archives.read_packages(packages, payloads=False).drop("url")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts to piece ids and back."""
    return pieces.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def _hex_number(text: str, first: int, digits: int = 6) -> Column:
    return F.conv(F.substring(F.sha2(F.expr(text), 256), first, digits), 16, 10).cast("long")


def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All captures against list entries of their day.

    The tables have neither dates nor lists, so both come from hashes: a page is
    fetched on one of 365 days; each host, and each domain two labels long, may
    be added to a list, removed from it, and added again.
    """
    pages = _table(spark, sf_dir, "pages").select("page_id", "url").withColumn("day", (_hex_number("concat('day', page_id)", 1) % 365).cast("int"))
    hosts = pages.select(url_lists.host_of(F.col("url")).alias("domain")).filter("domain is not null").distinct()
    domains = hosts.select(F.lit("hosts").alias("list"), "domain").unionByName(hosts.select(F.lit("domains").alias("list"), F.substring_index("domain", ".", -2).alias("domain")).distinct())
    day, rest = _hex_number("concat(list, domain)", 1) % 300, _hex_number("concat(list, domain)", 7)
    entries = domains.filter(_hex_number("concat(list, domain)", 13) % 3 == 0).select("list", "domain", F.explode(F.array(
        F.struct(F.lit("add").alias("action"), day.cast("int").alias("day")),
        F.struct(F.when(rest % 2 == 0, "remove").otherwise("add").alias("action"), (day + 1 + rest % 40).cast("int").alias("day")),
        F.struct(F.lit("add").alias("action"), (day + 60 + rest % 90).cast("int").alias("day")),
    )).alias("e")).select("list", "domain", "e.action", "e.day")
    found = url_lists.evaluate(pages, url_lists.intervals(entries, "day"), "day")
    return found.select("page_id", "day", "host", F.size("lists").cast("long").alias("n_lists"), F.array_join("lists", ",").alias("lists"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op3_media_columns": op3_media_columns,
    "op4_language": op4_language,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_url_lists": op6_url_lists,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_fingerprints": op8_fingerprints,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_archives": op10_archives,
    "op2_token_files": op2_token_files,
}

#: Base32 of a SHA-1 in hexadecimal: five digits make four characters.
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(sha1(h), 5 * (i // 4) + 1, 5))::bigint) >> (15 - 5 * (i % 4))) & 31)::int, 1)), '')"

_DIGITS = "('0x' || substr(sha256({text}), {first}, 6))::bigint"

ORACLES: dict[str, str] = {
    "op6_url_lists": f"""
        with p as (select page_id, {_DIGITS.format(text="'day' || page_id", first=1)} % 365 as day,
                          nullif(rtrim(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.'), '') as host from pages),
        h as (select distinct host from p where host is not null),
        d as (select 'hosts' as list, host as domain from h union select 'domains', array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') from h),
        n as (select *, {_DIGITS.format(text="list || domain", first=1)} % 300 as day, {_DIGITS.format(text="list || domain", first=7)} as rest from d
              where {_DIGITS.format(text="list || domain", first=13)} % 3 = 0),
        e as (select list, domain, 'add' as action, day from n
              union all select list, domain, case when rest % 2 = 0 then 'remove' else 'add' end, day + 1 + rest % 40 from n
              union all select list, domain, 'add', day + 60 + rest % 90 from n),
        m as (select p.page_id, e.list, arg_max(e.action, e.day) as action from p join e
              on (p.host = e.domain or p.host like '%.' || e.domain) and e.day <= p.day group by p.page_id, e.list, e.domain),
        b as (select page_id, list_sort(list_distinct(list(list))) as lists from m where action = 'add' group by page_id)
        select p.page_id, p.day::int as day, p.host, coalesce(len(b.lists), 0)::bigint as n_lists, coalesce(array_to_string(b.lists, ','), '') as lists
        from p left join b using (page_id)""",
    "op10_archives": f"""
        with p as (select page_id, coalesce(html, '') as h from pages),
        k as (select page_id, strlen(h) as payload_bytes, {_BASE32} as payload_digest, min(page_id) over (partition by h) as first from p)
        select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
               case when page_id <> first then first end as refers_to
        from k""",
}
