import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from prismark.llm import packing


def check_layout(rows, capacity):
    """Every sequence is gapless from 0 and no longer than the capacity."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("kind", ["uniform", "tiny", "equal", "large"])
def test_few_sequences(spark, kind):
    rng = random.Random(7)
    length = {"uniform": lambda: rng.randint(1, 100), "tiny": lambda: rng.randint(1, 9), "equal": lambda: 30, "large": lambda: rng.randint(51, 100)}[kind]
    items = [(i, length()) for i in range(700)]
    rows = packing.pack(spark.createDataFrame([(i, n, "x") for i, n in items], "id long, length long, gap string"), 100).collect()
    assert sorted((r.id, r.length) for r in rows) == items
    used, total = check_layout(rows, 100), sum(n for _, n in items)
    best = {"equal": -(-700 // 3), "large": 700}.get(kind, -(-total // 100))
    assert used <= best * 1.02 + 2


def test_best_fit_takes_the_smallest_gap_that_holds():
    where, offsets, free = packing.best_fit([40, 40, 40, 10], [(45, 7), (90, 8), (100, 9)], 100)
    assert list(zip(where, offsets)) == [(7, 55), (8, 10), (8, 50), (8, 90)] and free == [(5, 7), (100, 9)]
    assert packing.best_fit([60, 50, 40], [], 100)[0] == [None] * 3
    assert packing.best_fit([60, 50, 40], [], 100, 5)[:2] == ([5, 6, 5], [0, 0, 60])


def test_runs_go_to_the_nearest_range_and_its_smallest_gaps():
    left, held = packing.LEFT, packing.HELD
    told = [(0, left, 0, 0, 9), (0, held, 2, 900, 0), (0, held, 1, 2000, 2), (1, left, 5, 300, 4), (1, held, 1, 310, 0), (2, left, 9, 100, 0)]
    assert packing.flows(told) == [(1, 0, 5, 0, 0, 3), (2, 0, 3, 1, 0, 3), (2, 3, 6, 0, 2, 20)]


def plain_best_fit(items, capacity):
    """Sequences that best fit, longest first, opens."""
    gaps = []
    for n in sorted(items, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((capacity if fit is None else fit) - n)
    return len(gaps)


def test_one_task_is_best_fit(spark):
    rng = random.Random(3)
    items = [(i, rng.randint(1, 100)) for i in range(300)]
    rows = packing.pack(spark.createDataFrame(items, "id long, length long"), 100).collect()
    assert check_layout(rows, 100) == plain_best_fit([n for _, n in items], 100)


@pytest.mark.parametrize("kind", ["uniform", "tiny", "hot", "half"])
def test_many_ranges_come_near_best_fit(spark, monkeypatch, kind):
    monkeypatch.setattr(packing, "RANGE_ROWS", 60)
    rng = random.Random(5)
    length = {"uniform": lambda: rng.randint(1, 100), "tiny": lambda: rng.randint(1, 6), "hot": lambda: 37 if rng.random() < 0.4 else rng.randint(1, 60), "half": lambda: rng.choice([50, 51, 49])}[kind]
    items = [(i, length()) for i in range(900)]
    rows = packing.pack(spark.createDataFrame(items, "id long, length long"), 100).collect()
    assert sorted((r.id, r.length) for r in rows) == items
    assert check_layout(rows, 100) <= plain_best_fit([n for _, n in items], 100) * 1.05 + 2


def test_pieces_and_edge_cases(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = {1: "", 2: None, 3: "word " * 90, 4: "a  b\n\nc", 5: "x" * 400, 6: "word " * 90}
    docs = spark.createDataFrame([(d, t, 0) for d, t in texts.items()], "doc_id long, text string, piece int")
    rows = packing.packed_pieces(packing.pieces(docs, path, "joined", 2, 16), 16).collect()
    check_layout(rows, 16)
    for d, t in texts.items():
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        mine = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert [r.start for r in mine] == list(np.cumsum([0] + [r.length for r in mine])[:-1]) and sum(r.length for r in mine) == len(ids)
        assert all(r.length == 16 for r in mine[1:])
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (1, "word " * 40)], "doc_id long, text string")
    rows = packing.packed_pieces(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), "joined", 2, 16), 16).collect()
    check_layout(rows, 16)
    assert len(rows) == 3 + -(-42 // 16) and sum(r.doc_id is None for r in rows) == 1


def test_empty_and_too_long(spark):
    assert packing.pack(spark.createDataFrame([], "id long, length long"), 10).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 11)], "id long, length long"), 10)
    assert [r.length for r in packing.pack(spark.createDataFrame([(1, None), (2, 0)], "id long, length long"), 10).collect()] == [0, 0]
