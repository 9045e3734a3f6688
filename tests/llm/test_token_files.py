import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, strategies as st
from tokenizers import Tokenizer

from prismark.llm import token_files as tf
from prismark.llm.store import scratch
from prismark.llm.tokens import BatchEncoder

TEXTS = ["", " ", "It's Fine, really.", "a\n\nb", "a  b ", " lead", "tab\tx", "é́ ́a b", "a <|endoftext|> b", "x\n y", "nbsp x y", "word " * 3000, "語言 text 123 !!??"]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_ranks_round_trip(values):
    ranks = np.array(values, np.uint32)
    control, data = tf.encode_ranks(ranks)
    assert len(control) == -(-len(values) // 4)
    assert tf.decode_ranks(control, data, len(values)).tolist() == values


@pytest.mark.parametrize("name,blanks", [("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "joined")])
def test_ids_equal_those_of_whole_texts(name, blanks):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    ids, offsets = BatchEncoder(public_tokenizers.path(name), blanks).encode(pa.array(TEXTS, pa.large_string()), 7)
    for i, text in enumerate(TEXTS):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids + [7]


def test_files_give_back_the_ids(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    rows = [(i * 3, t, "x") for i, t in enumerate(TEXTS)] + [(1000, None, "y"), (6, TEXTS[2], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    folder = scratch(spark, "t")
    got = tf.read_token_files(tf.write_token_files(docs, folder, path, "dropped", 1), folder).orderBy("start").collect()
    at = 0
    for row, (doc_id, text, _) in zip(got, sorted(rows, key=lambda r: r[0]), strict=True):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert row.ids == ids
        at += len(ids)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = scratch(spark, "t")
    manifest = tf.write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"), "dropped", 1)
    assert tf.read_token_files(manifest, folder).count() == 0
