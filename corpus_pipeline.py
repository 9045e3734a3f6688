"""From raw documents to packed training sequences, stage by stage.

Each stage works on all that the one before it kept. All but the last return
the columns of `documents`; the last returns the pieces and where they lie.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from prismark.llm import jaccard, language, packing, toxicity
from prismark.llm.store import scratch, written

#: From this score on a document is toxic.
TOXIC = 0.5
#: Share of its letters that a document's main language must have.
MAIN_LANGUAGE = 0.4
CAPACITY = 1024


def _judged(docs: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of `docs` whose text `keep` keeps; columns that clash with those it adds are set aside meanwhile."""
    clash = {c: f"_own_{c}" for c in docs.columns if c not in ("doc_id", "text")}
    kept = keep(docs.withColumnsRenamed(clash)).select(*(clash.get(c, c) for c in docs.columns))
    return kept.withColumnsRenamed({v: k for k, v in clash.items()})


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity stays below TOXIC.

    Cases: null and empty texts have no toxic feature and stay, as all documents
    do where no label is known; repeated rows are scored each; a very long text
    is scored whole; an empty table stays empty; columns of any name are passed
    through, a column `toxicity` as it was.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _judged(docs, lambda texts: toxicity.score(texts, model).filter(F.col("toxicity") < TOXIC))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are mainly in one known language.

    Cases: null and empty texts and those without a letter have no language and
    go; where nothing has a `lang`, nothing is known and all go; repeated rows
    are judged each; a very long text is judged whole; an empty table stays
    empty; columns of any name are passed through.
    """
    model = language.fit(docs)
    return _judged(docs, lambda texts: language.detect(texts, model).filter((F.col("lang_pred") != "und") & (F.col("lang_score") >= MAIN_LANGUAGE)))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the document with the least doc_id.

    Cases: null, empty and wordless texts have no copies and stay; rows repeated
    under one doc_id are one document, and where their texts differ each text is
    judged by itself; rows without a doc_id stay; very long texts are compared
    whole; an empty table stays empty; columns of any name are passed through.
    """
    return jaccard.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens in sequences of at most CAPACITY: a row for each piece, see packing.packed_pieces.

    Cases: a null or empty text is its end id alone; a very long one is many
    pieces; repeated rows and rows without a doc_id are documents of their own;
    an empty table gives no pieces; other columns are ignored.
    """
    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), "joined", 2, CAPACITY)
    return packing.packed_pieces(cut, CAPACITY)


STAGES = [
    ("toxicity", remove_toxic),
    ("language", keep_languages),
    ("near_duplicates", one_of_each_group),
    ("packing", pack),
]

#: The stages learn models and encode tokens, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), scratch(spark, f"stage-{name}"))
    return docs
