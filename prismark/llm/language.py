"""Language of whole texts, and of spans of mixed-language texts.

Script ranges narrow the languages a word may be in; character n-grams and
frequent words score it in each; Viterbi over a text's words, with a penalty
for switching, labels spans. A text's language is that of most of its letters.

Fitting uses about `PER_LANGUAGE` texts of each language, chosen by a hash of
doc_id, learns every language that occurs, and keeps `GRAMS` n-grams for each
language on average (`LEAST_GRAMS` at least, as many as make `CELLS` log-odds at
most), those with the greatest shares of their languages.

Viterbi runs over blocks of words side by side: each block first gets its best
scores between any two states, these are chained along each text, and then all
blocks are labelled at once. The labels are those of one long pass.

Cases: null texts and those without a letter are `und` with score 0; texts of
letters that no learned language has get the most frequent language and score 0;
empty tables give empty results; without any learned language all are `und`;
null languages teach nothing; repeated rows are each labelled; ties go to the
more frequent language, then by name; further columns are passed through
(lang_pred, lang_score and lang_spans are replaced).
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from prismark.llm.store import scratch, small_batches, written
from prismark.llm.words import SLICE_BYTES, WordMemory, held_in_worker, plain_strings, release_worker, text_slices, whitespace_words

PER_LANGUAGE = 2_500
#: n-grams kept for each language on average, and at least in all; numbers that a table of log-odds, or of scores between states, has at most.
GRAMS, LEAST_GRAMS, CELLS = 4_000, 60_000, 4_000_000
#: Log-odds that a change of language between two words costs.
SWITCH = 8.0
#: n-grams overlap, so their sum overstates the evidence.
WEIGHT = 0.35
#: Share of a language's letters from which a script is one of its own.
OWN_SCRIPT = 0.005
OUTSIDE = -20.0
BLOCK = 64
LETTERS = re.compile(r"[^\W\d_]+")
#: First code points of script ranges, and the scripts ("" where mixed or none).
SCRIPT_STARTS = [0x0000, 0x0041, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0980, 0x0B80, 0x0C00, 0x0E00, 0x0E80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x2C00, 0x3040, 0x30A0, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB50, 0xFF00, 0x20000, 0x30000]
SCRIPTS = ["", "Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "", "Devanagari", "Bengali", "Tamil", "", "Thai", "", "Georgian", "Hangul", "Ethiopic", "Latin", "Greek", "", "", "Hiragana", "Katakana", "", "Han", "", "Hangul", "", "Han", "Arabic", "", "Han", ""]


def script_of(letter: str) -> str:
    return SCRIPTS[bisect_right(SCRIPT_STARTS, ord(letter)) - 1]


def grams(word: str) -> list[str]:
    """The whole word, and its pieces of three characters, ends marked."""
    marked = f"^{word}$"
    return ["=" + word, *(marked[i : i + 3] for i in range(len(marked) - 2))]


@dataclass
class LanguageModel:
    """Log-odds of n-grams by language; bounded by CELLS."""

    languages: list[str] = field(default_factory=list)  # most frequent first
    index: dict[str, int] = field(default_factory=dict)
    odds: np.ndarray = field(default_factory=lambda: np.zeros((1, 0), np.float32))  # a row of zeros last
    scripts: dict[str, np.ndarray] = field(default_factory=dict)  # languages that use a script
    name: str = field(default_factory=lambda: uuid.uuid4().hex)  # of this fit


def fit(docs: DataFrame, lang: str = "lang") -> LanguageModel:
    """A model from texts with a language."""
    small_batches(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col(lang).cast("string").alias("lang")).filter("lang is not null and text is not null")
    totals = {r.lang: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}  # a row for each language
    if not totals:
        return LanguageModel()
    languages = list(totals)
    few = {lang: n for lang, n in totals.items() if n > PER_LANGUAGE}
    share = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for lang, n in few.items() for x in (lang, PER_LANGUAGE / n))), F.col("lang")), F.lit(1.0)) if few else F.lit(1.0)
    fraction = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = known.filter(fraction < share).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        rows: Counter = Counter()
        for lang, held in words.items():
            for word, n in held.items():
                for gram in grams(word):
                    rows[lang, gram] += n
                for letter in word:
                    rows[lang, "#" + script_of(letter)] += n
        keys = list(rows)
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in part]), pa.array([k[1] for k in part]), pa.array([rows[k] for k in part], pa.int64())], ["lang", "gram", "n"])

    counted = written(sample.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), scratch(docs.sparkSession, "language-grams"))
    number = {lang: i for i, lang in enumerate(languages)}
    is_script = F.col("gram").startswith("#")
    scripts = counted.filter(is_script).collect()  # one for each language and script
    mass = F.broadcast(counted.filter(~is_script).groupBy("lang").agg(F.sum("n").alias("all")))  # a row for each language
    most = min(max(LEAST_GRAMS, GRAMS * len(languages)), max(1, CELLS // len(languages)))
    kept = counted.filter(~is_script).join(mass, "lang").groupBy("gram").agg(F.sum(F.col("n") / F.col("all")).alias("share")).orderBy(F.desc("share"), "gram").limit(most).select("gram")
    # CELLS rows at most, as columns: rows of Python objects would take many times their size.
    top = counted.join(F.broadcast(kept), "gram").toArrow()
    if not top.num_rows:
        return LanguageModel(languages)
    names = pc.unique(top.column("gram")).sort()
    table = np.full((len(names), len(languages)), 0.5)
    at = pc.index_in(top.column("gram"), names).to_numpy(), pc.index_in(top.column("lang"), pa.array(languages)).to_numpy()
    table[at] += top.column("n").to_numpy()
    logs = np.log(table / table.sum(axis=0))
    odds = np.clip(logs - logs.mean(axis=1, keepdims=True), -6, 6) * WEIGHT
    by_script: dict[str, np.ndarray] = {}
    for r in scripts:
        by_script.setdefault(r.gram[1:], np.zeros(len(languages)))[number[r.lang]] = r.n
    letters = np.maximum(sum(by_script.values(), np.zeros(len(languages))), 1)
    index = dict(zip(names.to_pylist(), range(len(names))))
    del top, table, logs, at
    release_worker()
    return LanguageModel(languages, index, np.vstack([odds, np.zeros((1, len(languages)))]).astype(np.float32), {s: n / letters >= OWN_SCRIPT for s, n in by_script.items() if s})


class WordScores:
    """For distinct words: letters, and log-odds in each language."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.width = 1 + len(model.languages)
        self.memory = WordMemory(self._look, dtype=np.float32)

    def _look(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        get, none = self.model.index.get, len(self.model.index)
        places, starts, letters, scripts = [], [], [], []
        for word in words:
            starts.append(len(places))
            runs = LETTERS.findall(word.lower())
            number = sum(len(r) if r.isalpha() else sum(map(str.isalpha, r)) for r in runs)
            letters.append(number)
            places.append(none)
            for run in runs:
                places.extend([get(g, none) for g in grams(run)])
            scripts.append(script_of(next((c for c in runs[0] if c.isalpha()), "0")) if number else "")
        rows = np.zeros((len(words), self.width), np.float32)
        if words:
            rows[:, 1:] = np.add.reduceat(self.model.odds[np.array(places)], np.array(starts), axis=0)
            rows[:, 0] = letters
            for script in set(scripts):
                own = self.model.scripts.get(script)
                if own is not None and own.any() and not own.all():
                    at = np.array([s == script for s in scripts])
                    rows[np.ix_(at, np.concatenate(([False], ~own)))] = OUTSIDE
        return np.full(len(words), self.width), rows.ravel()

    def rows(self, words: pa.Array) -> np.ndarray:
        starts, _, flat = self.memory.lists(words)
        return flat[starts[:, None] + np.arange(self.width)] if len(starts) else np.zeros((0, self.width), np.float32)


def viterbi(scores: np.ndarray, offsets: np.ndarray, switch: float) -> np.ndarray:
    """Best state of each row of `scores` (rows of one text between `offsets`)."""
    n, states = scores.shape
    counts = np.diff(offsets)
    blocks = -(-counts // BLOCK)
    order = np.argsort(-blocks, kind="stable")
    blocks, starts = blocks[order], offsets[:-1][order]
    first = np.cumsum(blocks) - blocks
    many = int(blocks.sum())
    if not many:
        return np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(blocks)), blocks)
    at = starts[owner] + (np.arange(many) - first[owner]) * BLOCK
    stop = np.minimum(at + BLOCK, (starts + counts[order])[owner])
    index = at + np.arange(BLOCK)[:, None]
    index = np.where(index < stop, index, n)
    padded = np.vstack([scores, np.zeros((1, states), scores.dtype)])
    # Chain the blocks of each text; texts with more blocks come first.
    vector = np.tile(-1e-3 * np.arange(states, dtype=np.float32), (len(blocks), 1))
    before = np.zeros((many, states), np.float32)
    active = np.searchsorted(-blocks, -np.arange(int(blocks.max())), side="left")
    done = 0
    while done < len(active):
        stop_at = done + max(1, int(np.searchsorted(np.cumsum(active[done:]) * states**2, CELLS, side="right")))
        rows = np.concatenate([first[: active[k]] + k for k in range(done, stop_at)])
        # Best scores of a block between the state before it and its last state.
        between = np.full((len(rows), states, states), -1e9, np.float32)
        between[:, np.arange(states), np.arange(states)] = 0
        for t in range(BLOCK):
            np.maximum(between, between.max(axis=2, keepdims=True) - switch, out=between)
            between += padded[index[t][rows]][:, None, :]
        at = 0
        for k in range(done, stop_at):
            m = int(active[k])
            before[first[:m] + k] = vector[:m]
            vector[:m] = (vector[:m, :, None] + between[at : at + m]).max(axis=1)
            vector[:m] -= vector[:m].max(axis=1, keepdims=True)
            at += m
        done = stop_at
    # All blocks at once from their known start.
    now = before
    number = np.int8 if states < 128 else np.int32
    stay, source = np.zeros((BLOCK, many, states), bool), np.zeros((BLOCK, many), number)
    for t in range(BLOCK):
        best = now.max(axis=1, keepdims=True) - switch
        source[t] = now.argmax(axis=1)
        stay[t] = now >= best
        now = np.maximum(now, best) + padded[index[t]]
    label = np.zeros((BLOCK, many, states), number)
    state = np.tile(np.arange(states, dtype=number), (many, 1))
    for t in range(BLOCK - 1, -1, -1):
        label[t] = state
        kept = np.take_along_axis(stay[t], state.astype(np.int64), axis=1)
        state = np.where(kept, state, source[t][:, None])
    end = vector.argmax(axis=1)
    chosen = np.zeros(many, np.int64)
    for k in range(int(blocks.max()) - 1, -1, -1):
        m = int(active[k])
        row = first[:m] + k
        here = np.where(blocks[:m] - 1 == k, vector[:m].argmax(axis=1), end[:m])
        chosen[row] = here
        end[:m] = state[row, here]
    out = np.zeros(n + 1, np.int64)
    out[index] = label[:, np.arange(many), chosen]
    return out[:n]


def label_texts(texts: pa.Array, scores: WordScores) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(language or -1, score) of each text; (offsets, letters, languages) of its lettered words."""
    batch = whitespace_words(texts)
    rows = scores.rows(batch.words)
    lettered = rows[:, 0][batch.codes] > 0
    codes = batch.codes[lettered]
    offsets = np.concatenate(([0], np.cumsum(lettered)))[batch.offsets]
    letters, states = rows[codes, 0].astype(np.float64), scores.width - 1
    labels = viterbi(rows[codes, 1:], offsets, SWITCH) if states else np.zeros(len(codes), np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    mass = np.bincount(owner * max(states, 1) + labels, letters, len(texts) * max(states, 1)).reshape(len(texts), -1)
    evidence = np.bincount(owner, np.abs(rows[codes, 1:]).max(axis=1, initial=0), len(texts)) > 0
    total = mass.sum(axis=1)
    best = np.where((total > 0) & (states > 0), mass.argmax(axis=1), -1)
    return best, np.where(evidence, mass.max(axis=1) / np.maximum(total, 1), 0.0), offsets, letters, labels


def detect(docs: DataFrame, model: LanguageModel, spans: bool = False) -> DataFrame:
    """`docs` with lang_pred and lang_score (share of letters in it), of whole texts.

    spans: also lang_spans, the text's lettered words in runs of one language.
    """
    held = small_batches(docs.sparkSession).sparkContext.broadcast(model)  # bounded, see LanguageModel

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = held_in_worker(("language", held.value.name), lambda: WordScores(held.value))
        names = np.array([*held.value.languages, "und"], object)
        states = max(1, len(held.value.languages))
        rows = max(1, CELLS // states**2)  # as many texts as one step of the chains takes
        for batch in batches:
            for part in (p for i in range(0, batch.num_rows, rows) for p in text_slices(batch.slice(i, rows), limit=SLICE_BYTES * 32 // max(32, states))):
                best, score, offsets, letters, labels = label_texts(plain_strings(part.column("text")), scores)
                more = [pa.array(names[best], pa.string()), pa.array(score, pa.float64())]
                if spans:
                    found = []
                    for a, b in zip(offsets[:-1], offsets[1:]):
                        cuts = [*(a + np.flatnonzero(np.diff(labels[a:b], prepend=-1))), b]
                        found.append([{"lang": names[labels[i]], "words": int(j - i), "letters": int(letters[i:j].sum())} for i, j in zip(cuts[:-1], cuts[1:])])
                    more.append(pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64()), ("letters", pa.int64())]))))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, *(f.name for f in added)])

    added = [StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())]
    if spans:
        added.append(StructField("lang_spans", ArrayType(StructType([StructField("lang", StringType()), StructField("words", LongType()), StructField("letters", LongType())]))))
    plain = docs.drop("lang_pred", "lang_score", "lang_spans").withColumn("text", F.col("text").cast("string"))
    return plain.mapInArrow(label, StructType([*plain.schema.fields, *added]))
