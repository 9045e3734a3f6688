"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon of words and word beginnings is learned from labelled rows; trees
then see densities, not words: of lexicon bands, of second-person words and
of lexicon words near them, of capitals, punctuation and obfuscation (letters
mixed with digits or signs, letters drawn out). All but the nearness are sums
over words, so each distinct word of a batch is looked at once.

Fitting uses at most `SAMPLE` labelled rows, chosen by a hash of doc_id within
each label; the lexicon that a training row is measured with is chosen and
weighted without that row's own fold. Scoring reads every text whole, a very
long one as a slice of its own.

Cases: null and empty texts have zero features and get the score of such a
row; labels that are null or belong to no row are ignored; a repeated row is
scored again; without any labelled row of each class every score is the share
of the label (0 where there is none); an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from prismark.llm.boosting import Boosted, Isotonic, fit_boosted, fit_isotonic
from prismark.llm.store import discard, scratch, small_batches, written
from prismark.llm.words import WordMemory, held_in_worker, plain_strings, release_worker, text_slices, whitespace_words

#: Labelled rows, at most, that a model is fitted on (half for each label).
SAMPLE = 16_000
#: Lexicon entries kept, at most, and the rows of label 1 that an entry must be in.
LEXICON = 4_000
LEAST_ROWS = 3
#: Lengths of word beginnings that may be lexicon entries.
BEGINNINGS = (4, 5, 6, 7)
FOLDS = 3
#: Bytes of text measured at a time; a word occurrence takes some 200 bytes meanwhile.
SLICE = 2 << 20
#: Words on either side within which a lexicon word counts as near a second-person word.
NEAR = 4
#: Second-person words.
SECOND_PERSON = ["you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "ti", "usted", "vos"]
#: General terms of abuse that hold before anything is learned.
GENERAL_TERMS = ["idiot", "moron", "stupid", "trash", "scum", "loser", "pathetic", "worthless", "disgusting", "clown", "dumb", "fool", "ugly", "hate", "kill", "shut", "dumm", "trottel", "abschaum", "imbécile", "crétin", "stupide", "idiota", "imbécil", "estúpido", "basura"]
#: Least log-odds (lower bound) of the lexicon's bands, strongest first.
BANDS = (2.2, 1.2, 0.6)
FEATURES = ["strong", "medium", "weak", "strong_log", "medium_log", "strong_distinct", "odds_mean", "odds_max", "general", "second_person", "near", "near_log", "shouted", "capitals", "punctuation", "exclaims", "obfuscated", "drawn_out", "word_length", "words_log"]


def hash_order(key: str = "doc_id") -> Column:
    """An order by key that has nothing to do with its size."""
    return F.xxhash64(F.lit("toxicity"), F.col(key))


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, text, label, fold of at most SAMPLE rows with label 0 or 1, up to half of them of each."""
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = None
    for value in (0, 1):
        part = known.filter(F.col("label") == value).orderBy(hash_order(), "doc_id").limit(SAMPLE // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most SAMPLE rows of two numbers.
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").withColumn("fold", F.pmod(hash_order(), F.lit(FOLDS)).cast("int"))


def label_counts(labels: DataFrame, label: str) -> dict[int, int]:
    return {r[0]: r[1] for r in labels.select(F.col(label).cast("int").alias("label")).filter("label in (0, 1)").groupBy("label").count().collect()}


def _terms(words: list[str]) -> list[tuple[str, ...]]:
    out = []
    for word in words:
        word = word.strip(".,;:!?\"'()|*%$&#").lower()
        out.append((word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)) if len(word) > 2 else ())
    return out


def _term_counts(sample: DataFrame) -> DataFrame:
    """term, fold, and rows that have it by label; counted within tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        counts: dict[tuple[int, int], Counter] = {}

        def flush():
            rows = [(t, f, n if label else 0, 0 if label else n) for (f, label), c in counts.items() for t, n in c.items()]
            counts.clear()
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(("term", "fold", "ones", "zeros"), r)) for r in rows], schema=pa.schema([("term", pa.string()), ("fold", pa.int32()), ("ones", pa.int64()), ("zeros", pa.int64())]))

        for batch in batches:
            for text, label, fold in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), batch.column("fold").to_pylist()):
                terms = {t for ts in _terms(list(set((text or "").split()))) for t in ts}
                counts.setdefault((fold, label), Counter()).update(terms)
            if sum(map(len, counts.values())) > 300_000:
                yield from flush()
        yield from flush()

    return sample.mapInArrow(count, "term string, fold int, ones long, zeros long")


def learn_lexicons(sample: DataFrame) -> list[dict[str, float]]:
    """term to lower bound of its log-odds: without fold 0, without fold 1, .., and from all rows."""
    size = {(r.fold, r.label): r["count"] for r in sample.groupBy("fold", "label").count().collect()}
    by_fold = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in range(FOLDS) for c in ("ones", "zeros")]
    folder = scratch(sample.sparkSession, "toxicity-terms")
    counted = written(_term_counts(sample).groupBy("term").agg(*by_fold), folder)
    out = []
    for left_out in range(FOLDS + 1):  # the last one leaves none out
        folds = [f for f in range(FOLDS) if f != left_out]
        n1, n0 = (sum(size.get((f, x), 0) for f in folds) for x in (1, 0))
        ones, zeros = (sum((F.col(f"{c}{f}") for f in folds), F.lit(0)) for c in ("ones", "zeros"))
        bound = F.log((ones + 0.5) / (n1 + 1.0)) - F.log((zeros + 0.5) / (n0 + 1.0)) - F.sqrt(1 / (ones + 0.5) + 1 / (zeros + 0.5))
        least = -(-LEAST_ROWS * len(folds) // FOLDS)  # as rare in these folds as LEAST_ROWS is in all
        best = counted.filter(ones >= least).select("term", bound.alias("bound")).filter(F.col("bound") >= BANDS[-1]).orderBy(F.desc("bound"), "term").limit(LEXICON)
        out.append({r.term: r.bound for r in best.collect()})
    discard(sample.sparkSession, folder)
    return out


class Measure:
    """Feature rows of texts under one lexicon."""

    UPPER, SIGNS = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[^\w\s]")
    MIXED, DRAWN = re.compile(r"[^\W\d_][\d@$*#]+[^\W\d_]"), re.compile(r"([^\W\d_])\1\1")

    def __init__(self, lexicon: dict[str, float], remembered: int = 500_000):
        self.lexicon = lexicon
        self.general, self.second = frozenset(GENERAL_TERMS), frozenset(SECOND_PERSON)
        self.width = 10
        self.memory = WordMemory(self._look, remembered, np.float32)

    def _look(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        get = self.lexicon.get
        rows = []
        for word, terms in zip(words, _terms(words)):
            capitals = len(self.UPPER.findall(word))
            core = terms[0] if terms else word.strip(".,;:!?").lower()
            rows.append((
                max((get(t, 0.0) for t in terms), default=0.0), core in self.general, core in self.second,
                capitals > 1 and word.upper() == word, capitals, len(self.SIGNS.findall(word)), word.count("!"),
                self.MIXED.search(word) is not None, self.DRAWN.search(word) is not None, len(word),
            ))
        return np.full(len(words), self.width), np.array(rows, np.float32).ravel()

    def rows(self, texts: pa.Array) -> np.ndarray:
        batch = whitespace_words(texts)
        starts, _, flat = self.memory.lists(batch.words)
        by_word = flat[starts[:, None] + np.arange(self.width)] if len(starts) else np.zeros((0, self.width), np.float32)
        odds = by_word[:, 0][batch.codes]
        n = batch.counts.astype(np.float64)
        many = np.maximum(n, 1)
        bands = [(odds >= low) & (odds < high) for low, high in zip(BANDS, (np.inf, *BANDS))]
        counts = [batch.per_text(b.astype(np.int64)) for b in bands]
        sums = batch.per_text(by_word[:, 1:][batch.codes].astype(np.float64))
        marked = np.flatnonzero(odds >= BANDS[1])
        owner = np.searchsorted(batch.offsets, marked, side="right") - 1
        second = np.concatenate(([0], np.cumsum(by_word[:, 2][batch.codes] > 0)))
        around = second[np.minimum(marked + NEAR + 1, batch.offsets[owner + 1])] - second[np.maximum(marked - NEAR, batch.offsets[owner])]
        near = np.bincount(owner[around > 0], minlength=len(n))
        pairs = np.unique(np.stack((owner, batch.codes[marked])), axis=1)
        distinct = np.bincount(pairs[0], minlength=len(n))
        highest = np.zeros(len(n))
        np.maximum.at(highest, owner, odds[marked])
        letters = np.maximum(sums[:, 8], 1)
        return np.stack([
            counts[0] / many, counts[1] / many, counts[2] / many, np.log1p(counts[0]), np.log1p(counts[1]), distinct, batch.per_text(odds.astype(np.float64)) / many, highest,
            sums[:, 0] / many, sums[:, 1] / many, near / many, np.log1p(near), sums[:, 2] / many, sums[:, 3] / letters, sums[:, 4] / letters, sums[:, 5] / letters,
            sums[:, 6] / many, sums[:, 7] / many, sums[:, 8] / many, np.log1p(n),
        ], axis=1)


@dataclass
class ToxicityModel:
    """What scoring needs; its size is bounded by LEXICON and the number of trees."""

    lexicon: dict[str, float] = field(default_factory=dict)
    trees: Boosted | None = None
    calibration: Isotonic | None = None
    share: float = 0.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)  # of this fit

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(features), self.share)
        raw = self.trees.predict(features)
        # The steps of the calibration tie many rows; a thousandth of the odds orders those.
        return np.clip(0.999 * self.calibration.predict(raw) + 0.001 / (1 + np.exp(-raw)), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> ToxicityModel:
    """A model from labelled rows (doc_id and `label` of `labels`); texts come from `docs`."""
    spark = docs.sparkSession
    totals = label_counts(labels, label)
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    if len(totals) < 2:
        return ToxicityModel(share=share)
    folder = scratch(spark, "toxicity-sample")
    sample = written(bounded_sample(docs, labels, label), folder)
    lexicons = learn_lexicons(sample)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        measures = [Measure(x, 150_000) for x in lexicons[:FOLDS]]
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                fold = part.column("fold").to_numpy()
                texts = plain_strings(part.column("text"))
                for f in range(FOLDS):
                    mine = pa.array(fold == f)
                    rows = measures[f].rows(texts.filter(mine))
                    kept = part.filter(mine)
                    yield pa.RecordBatch.from_arrays([kept.column("doc_id"), kept.column("label"), kept.column("fold"), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "label", "fold", "features"])

    # At most SAMPLE rows of a few numbers (documents repeated under one doc_id aside).
    rows = sample.repartition(8, "doc_id").mapInArrow(measure, "doc_id long, label int, fold int, features binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.features))
    discard(spark, folder)
    if len({r.label for r in rows}) < 2:
        return ToxicityModel(share=share)
    x = np.stack([np.frombuffer(r.features, np.float64) for r in rows])
    y, fold = np.array([r.label for r in rows], float), np.array([r.fold for r in rows])
    outside = np.zeros(len(y))
    for f in range(FOLDS):
        mine = fold == f
        if mine.any():
            outside[mine] = fit_boosted(x[~mine], y[~mine]).predict(x[mine]) if len(set(y[~mine])) == 2 else 0
    weight = np.where(y == 1, totals[1] / max(1, (y == 1).sum()), totals[0] / max(1, (y == 0).sum()))
    model = ToxicityModel(lexicons[FOLDS], fit_boosted(x, y), fit_isotonic(outside, y, weight), share)
    del rows, x, outside
    release_worker()
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """`docs` with toxicity, a double from 0 to 1, from each whole text."""
    held = small_batches(docs.sparkSession).sparkContext.broadcast(model)  # bounded, see ToxicityModel

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = held_in_worker(("toxicity", held.value.name), lambda: Measure(held.value.lexicon))
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                scores = held.value.score(measure.rows(plain_strings(part.column("text"))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*part.schema.names, "toxicity"])

    plain = docs.drop("toxicity").withColumn("text", F.col("text").cast("string"))
    return plain.mapInArrow(rate, StructType([*plain.schema.fields, StructField("toxicity", DoubleType())]))
