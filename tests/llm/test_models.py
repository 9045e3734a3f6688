import random
import re

import numpy as np
import pyarrow as pa
import pytest

from prismark.llm import language, toxicity
from prismark.llm.boosting import fit_boosted, fit_isotonic

INSULTS = ["idiot", "moron", "zzkraxo"]


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "lorem", "ipsum"]) + rng.choice(["", "s", ","]) for _ in range(rng.randint(5, 60))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS) + rng.choice(["", "en", "ul"]))
        docs.append((i, " ".join(words), "extra"))
        labels.append((i, toxic))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string, toxicity string")
    model = toxicity.fit(frame, spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, toxic int"))
    scores = {r.doc_id: r.toxicity for r in toxicity.score(frame, model).collect()}
    held = [(scores[i], t) for i, t in labels if i % 3 == 0]
    assert sum((s >= 0.5) == t for s, t in held) / len(held) > 0.95
    assert all(0 <= s <= 1 for s in scores.values())


def plain_features(text, lexicon):
    """What Measure.rows gives, word by word."""
    words = [w for w in re.split(r"[ \t\n\v\f\r]+", text) if w]
    n = len(words)
    odds, sums, second = [], np.zeros(9), []
    for word in words:
        core = word.strip(".,;:!?\"'()|*%$&#").lower()
        terms = [core, *(core[:k] + "-" for k in toxicity.BEGINNINGS if len(core) > k)] if len(core) > 2 else []
        odds.append(np.float32(max((lexicon.get(t, 0.0) for t in terms), default=0.0)))
        named = core if terms else word.strip(".,;:!?").lower()
        capitals = sum(bool(re.match(r"[A-ZÀ-ÖØ-Þ]", c)) for c in word)
        second.append(named in toxicity.SECOND_PERSON)
        sums += [named in toxicity.GENERAL_TERMS, second[-1], capitals > 1 and word.upper() == word, capitals, len(re.findall(r"[^\w\s]", word)), word.count("!"),
                 bool(re.search(r"[^\W\d_][\d@$*#]+[^\W\d_]", word)), bool(re.search(r"([^\W\d_])\1\1", word)), len(word)]
    high, mid, low = toxicity.BANDS
    bands = [sum(o >= high for o in odds), sum(mid <= o < high for o in odds), sum(low <= o < mid for o in odds)]
    near = sum(o >= mid and any(second[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1]) for i, o in enumerate(odds))
    distinct = len({w for w, o in zip(words, odds) if o >= mid})
    many, letters = max(n, 1), max(sums[8], 1)
    highest = max((o for o in odds if o >= mid), default=0)
    return [*(b / many for b in bands), np.log1p(bands[0]), np.log1p(bands[1]), distinct, sum(map(float, odds)) / many, highest, sums[0] / many, sums[1] / many, near / many, np.log1p(near),
            sums[2] / many, sums[3] / letters, sums[4] / letters, sums[5] / letters, sums[6] / many, sums[7] / many, sums[8] / many, np.log1p(n)]


def test_features_equal_a_plain_count():
    rng = random.Random(4)
    parts = ["you", "YOU!!", "Idiot,", "idiots", "zzkraxo", "sooooo", "h4te", "alpha", "BETA", "(ur)", "é", "x", "12", "du", "gamma.", "kramp", "krampus!"]
    lexicon = {"idiot": 2.5, "idio-": 1.3, "zzkraxo": 3.0, "gamma": 0.7, "kramp-": 1.0}
    texts = [" ".join(rng.choices(parts, k=k)) for k in (0, 1, 2, 9, 40, 300)] + ["", " \t\n"]
    got = toxicity.Measure(lexicon).rows(pa.array(texts, pa.large_string()))
    assert np.allclose(got, [plain_features(t, lexicon) for t in texts], atol=1e-6)


def test_folds_choose_their_own_lexicon(spark):
    docs, labels = corpus(300)
    sample = toxicity.bounded_sample(spark.createDataFrame(docs, "doc_id long, text string, x string"), spark.createDataFrame(labels, "doc_id long, toxic int"), "toxic")
    rows = sample.collect()
    lexicons = toxicity.learn_lexicons(sample)
    for f, lexicon in enumerate(lexicons[: toxicity.FOLDS]):
        inside = {t for r in rows if r.fold != f and r.label for ts in toxicity._terms(r.text.split()) for t in ts}
        assert lexicon and set(lexicon) <= inside


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 5000), (3, "word " * 5000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    assert [r.toxicity for r in toxicity.score(docs, model).collect()] == [0.0] * 4
    one_class = toxicity.fit(docs, spark.createDataFrame([(1, 1), (2, None), (9, 1)], "doc_id long, toxic int"))
    assert {r.toxicity for r in toxicity.score(docs, one_class).collect()} == {1.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_boosting_and_calibration():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    raw = fit_boosted(x, y, trees=40).predict(x)
    assert ((raw > 0) == (y == 1)).mean() > 0.95
    rising = fit_isotonic(raw, y, np.ones(len(y))).predict(np.sort(raw))
    assert (np.diff(rising) >= -1e-12).all()
    step = fit_isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert step.predict(np.array([1.0, 2, 3, 4])).tolist() == [0, 0.5, 0.5, 1]


@pytest.mark.parametrize("states,length", [(2, 1), (3, 63), (3, 64), (4, 65), (4, 700)])
def test_viterbi_equals_one_long_pass(states, length):
    rng = np.random.default_rng(length)
    counts = [0, length, 3, 130]
    scores = rng.normal(scale=2, size=(sum(counts), states)).astype(np.float32)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    got = language.viterbi(scores, offsets, 3.0)
    for a, b in zip(offsets[:-1], offsets[1:]):
        value = -1e-3 * np.arange(states)
        for row in scores[a:b]:
            value = np.maximum(value, value.max() - 3.0) + row
        path = got[a:b]
        total = scores[np.arange(a, b), path].sum() - 3.0 * (np.diff(path) != 0).sum()
        assert b == a or total >= value.max() - 4.0  # the start may cost one switch


def test_language_spans_and_edges(spark):
    rng = random.Random(5)
    speak = {"xx": ["kal", "rom", "tis", "ven"], "yy": ["ooru", "iepa", "uulo", "aeki"], "ru": ["мир", "дом", "река", "лес"]}
    docs = [(i, " ".join(rng.choice(speak[l]) + rng.choice(speak[l]) for _ in range(40)), l) for i, l in enumerate(list(speak) * 60)]
    frame = spark.createDataFrame([*docs, (900, "no language", None), (901, None, "xx")], "doc_id long, text string, lang string")
    model = language.fit(frame)
    mixed = " ".join("kalrom" for _ in range(30)) + " " + " ".join("ooruiepa" for _ in range(20))
    cases = spark.createDataFrame([(1, mixed), (2, None), (3, ""), (4, "12 34 !!"), (5, "мирдом река"), (6, "日本語"), (7, "kalrom " * 9000)], "doc_id long, text string")
    got = {r.doc_id: r for r in language.detect(cases, model, spans=True).collect()}
    assert got[1].lang_pred == "xx" and [(s.lang, s.words) for s in got[1].lang_spans] == [("xx", 30), ("yy", 20)]
    assert [got[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and [got[i].lang_score for i in (2, 3, 4)] == [0] * 3
    assert got[5].lang_pred == "ru" and got[6].lang_pred in speak and got[7].lang_pred == "xx"
    held = language.detect(frame.limit(180), model).collect()
    assert sum(r.lang_pred == r.lang for r in held) > 175
    nothing = language.fit(frame.filter("lang is null"))
    assert {r.lang_pred for r in language.detect(cases, nothing).collect()} == {"und"}
    assert language.detect(cases.limit(0), model).count() == 0


def test_many_languages(spark):
    rng = random.Random(9)
    speak = {f"l{k:03d}": ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(6)] for k in range(140)}
    docs = [(i, " ".join(rng.choices(words, k=30)), name) for i, (name, words) in enumerate(list(speak.items()) * 4)]
    frame = spark.createDataFrame([*docs, (9999, " ".join(["rareword", "seldom"] * 20), "rare")], "doc_id long, text string, lang string")
    model = language.fit(frame)
    assert len(model.languages) == 141
    found = language.detect(frame, model).collect()
    assert sum(r.lang_pred == r.lang for r in found) > 0.98 * len(found) and any(r.lang_pred == "rare" for r in found)


def test_viterbi_in_small_steps(monkeypatch):
    rng = np.random.default_rng(1)
    scores = rng.normal(scale=2, size=(5000, 5)).astype(np.float32)
    offsets = np.array([0, 10, 10, 4000, 5000])
    whole = language.viterbi(scores, offsets, 3.0)
    monkeypatch.setattr(language, "CELLS", 60)
    assert (language.viterbi(scores, offsets, 3.0) == whole).all()


def test_a_text_longer_than_a_slice(spark):
    text = "kalrom tisven " * 200_000 + "ooru iepa " * 250_000  # 5.3 MB, more than half of its letters in xx
    docs = [(i, t * 20, l) for i, (t, l) in enumerate([("kalrom tisven ", "xx"), ("ooru iepa ", "yy")] * 20)]
    model = language.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    row = language.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert row.lang_pred == "xx" and abs(row.lang_score - 2_400_000 / 4_400_000) < 1e-3
    toxic = toxicity.Measure({"kalrom": 3.0})
    rows = toxic.rows(pa.array([text, "", None], pa.large_string()).fill_null(""))
    assert rows[0][0] == pytest.approx(200_000 / 900_000) and (rows[1] == rows[2]).all()


def test_scripts():
    assert [language.script_of(c) for c in "aéßЖ漢あ한א1 "] == ["Latin", "Latin", "Latin", "Cyrillic", "Han", "Hiragana", "Hangul", "Hebrew", "", ""]
