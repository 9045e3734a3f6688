import hashlib
import random
import tarfile
import time
import zipfile
import zlib

import public_tokenizers
import pytest
import sentencepiece

from prismark.llm import archives, media, pieces
from prismark.llm.store import RangeReader, scratch


def local(uri):
    return uri.removeprefix("file://")


def test_media_round_trip(spark):
    texts = [(1, "hello"), (2, None), (3, ""), (4, "hello"), (5, "é" * 5000), (4, "hello"), (6, "x" * 576)]
    docs = spark.createDataFrame([(d, t, "s", 9) for d, t in texts], "doc_id long, text string, shard string, offset int").repartition(3)
    folder = scratch(spark, "m")
    rows = media.media_table(docs, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d for d, _ in texts)
    for r in rows:
        raw = (dict(texts)[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        with RangeReader(f"{folder}/{r.shard}") as file:
            image = file.read(r.offset, r.length)
        assert media.from_png(image) == payload and (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        assert (r.width, r.height, r.bit_depth) == (24, len(payload) // 24, 8)
        with tarfile.open(local(f"{folder}/{r.shard}")) as tar:
            assert tar.extractfile(f"{r.digest}.png").read() == image
    assert len({(r.shard, r.offset) for r in rows}) == len({r.digest for r in rows})
    assert media.media_table(docs.limit(0), scratch(spark, "m")).count() == 0


def test_damaged_image():
    image = bytearray(media.to_png(media.padded(b"x")))
    image[50] ^= 1
    with pytest.raises(Exception):
        media.from_png(bytes(image))


@pytest.mark.parametrize("least", [0, 6])
def test_archives_round_trip(spark, least):
    pages = [(5, "http://a/", "same"), (2, "http://b/", "same"), (9, None, None), (4, "http://c/", ""), (7, "http://d/", "other é"), (8, "http://e/", "other é"), (10, "http://f/", "long " * 40000)]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    packages = archives.write_packages(frame, scratch(spark, "w"), least)
    listed = packages.collect()
    packages = spark.createDataFrame(listed, packages.schema)
    rows = {r.page_id: r for r in archives.read_packages(packages).collect()}
    first = {}
    for page, _, html in sorted(pages, key=lambda p: p[0]):
        payload = (html or "").encode()
        r = rows[page]
        original = first.setdefault(payload, page) if len(payload) >= least else page
        assert (r.payload_bytes, r.payload_digest) == (len(payload), archives.payload_digest(payload))
        assert (r.record_type, r.refers_to) == (("response", None) if original == page else ("revisit", original))
        assert r.payload == (payload if original == page else b"")
    for r in listed:
        with zipfile.ZipFile(local(r.path)) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {0} and len(z.namelist()) == 3
    assert archives.read_packages(archives.write_packages(frame.limit(0), scratch(spark, "w"))).count() == 0


def test_one_page_id_with_several_payloads(spark):
    rows = [(1, "A"), (5, "A"), (5, "B only here"), (5, "B only here"), (None, "A"), (7, "B only here")]
    pages = spark.createDataFrame([(i, None, h) for i, h in rows], "page_id long, url string, html string").repartition(3)
    packages = archives.write_packages(pages, scratch(spark, "w"))
    read = archives.read_packages(spark.createDataFrame(packages.collect(), packages.schema)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to or 0, r.payload) for r in read) == [
        (1, "response", 0, b"A"), (5, "response", 0, b"B only here"), (5, "response", 0, b"B only here"), (5, "revisit", 1, b""), (7, "revisit", 5, b"")]


@pytest.mark.parametrize("zip64", [True, False])
def test_packages_of_either_form(spark, zip64):
    uri = scratch(spark, "z") + "/p.wacz"
    writer = archives.PackageWriter(uri, zip64)
    writer.member("archive/a.warc.gz", [b"one", b"two"])
    writer.member("indexes/index.cdxj", [b""])
    writer.close()
    package = archives.Package(uri)
    assert package.read("archive/a.warc.gz") == b"onetwo" and package.read("indexes/index.cdxj") == b""


def test_foreign_zip_files(spark):
    folder = local(scratch(spark, "z"))
    import os

    os.makedirs(folder)
    with zipfile.ZipFile(f"{folder}/c.zip", "w") as z:
        z.writestr("a", b"x" * 100, zipfile.ZIP_STORED)
        z.writestr("b", b"x" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 in a comment"
    package = archives.Package(f"file://{folder}/c.zip")
    assert package.read("a") == b"x" * 100
    with pytest.raises(ValueError):
        package.read("b")
    with open(f"{folder}/d.zip", "wb") as f:
        f.write(b"not a zip")
    with pytest.raises(ValueError):
        archives.Package(f"file://{folder}/d.zip")


TEXTS = ["", " ", "  a", "a  b   c ", "x\ny", "語言 🙂 é", "a\0b c", "▁▁x y▁", "tab\t\x01 q", "123 45.6 $$$ <s> </s> <0x41>", "word" * 500, "The quick brown fox, jumped! over lazy dogs " * 50]


def test_pieces_equal_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.createDataFrame([(i, t, "p") for i, t in enumerate([*TEXTS, None, TEXTS[3]])], "doc_id long, text string, piece_ids string")
    for r in pieces.decode(pieces.encode(docs, path), path).collect():
        assert r.piece_ids == library.encode(r.text or "")
        assert r.piece_text == library.decode(r.piece_ids)
    same = {r.doc_id: r for r in pieces.round_trip(docs, path).collect()}
    assert same[11].restored and same[11].n_pieces == len(library.encode(TEXTS[11]))
    assert pieces.encode(docs.limit(0), path).count() == 0


def test_very_long_chunks():
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    model = pieces.PieceModel(path)
    rng = random.Random(2)
    letters = "".join(rng.choices("etaoinshrdlu", k=700_000))
    texts = [letters, "ab" * 5_000 + "\x01é漢" * 2_000, "a" * 9_000, "word  " * 900 + " " * 3_000 + "x", "\x01 \x01\x01"]
    for text in texts:
        chunks = pieces.CHUNK.findall(pieces.BLANK + text.replace(" ", pieces.BLANK))
        started = time.time()
        lengths, ids = model.encode_chunks(chunks)
        assert ids.tolist() == library.encode(text) and lengths.sum() == len(ids)
        assert time.time() - started < 30


def test_a_million_blanks():
    model = pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    started = time.time()
    ids = model.merge(pieces.BLANK * 1_000_000)
    assert sum(len(model.text[i]) for i in ids) == 1_000_000 and time.time() - started < 60


def test_suffix_array():
    import numpy as np

    codes = np.array([ord(c) for c in "banana$bandana$"])
    order = pieces.suffix_array(codes, 8)
    text = "banana$bandana$"
    assert [text[i : i + 8] for i in order] == sorted(text[i : i + 8] for i in range(len(text)))
