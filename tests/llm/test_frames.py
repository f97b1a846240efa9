"""Files of token frames: exact round trip, random access, checksums, and ids against the vocabulary's library."""

from __future__ import annotations

import io
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from corpusloom.llm import encoding, frames, queries
from tests.conftest import DATA
from tests.llm import fixtures

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [*"abcXYZ'stremvld019 .,;:!?éÉñßÿÀ×÷²½ªµº漢字Ωσςİſ", " ", "\u0085", " ", " ", "\t", "\n", "\x1c", "á"]
ODD += ["\x00", "<|endoftext|>", "<|startoftext|>", "'ll", "don't", "'RE"]


def plain_ids(path: str, text: str | None, end: int = 2) -> list[int]:
    return [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_ids_equal_the_library(path):
    library, ours, r = Tokenizer.from_file(path), encoding.encoder(path), random.Random(2)
    texts = [t for t in fixtures.texts() if t and len(t) < 10_000] + ["".join(r.choices(ODD, k=r.randint(0, 25))) for _ in range(3_000)]
    for t in texts:
        assert ours(t) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_every_word_of_the_vocabulary():
    """Merging by rank gives what the library gives also where a word is a token."""
    library, ours = Tokenizer.from_file(WORDS), encoding.encoder(WORDS)
    assert ours.words is not None
    words = [t.removesuffix("</w>") for t in library.get_vocab() if t.endswith("</w>") and t.isascii()]
    for word, found in zip(words, library.encode_batch(words, add_special_tokens=False), strict=True):
        assert ours(word) == np.array(found.ids, "<u4").tobytes()


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(encoding, "REMEMBERED_BYTES", 20_000)
    ours = encoding.WordEncoder(WORDS)
    for i in range(2_000):
        ours(f"word{'abcdefghij'[i % 10] * (i % 50)} {'x' * 200}{i}")
        assert ours.words.held < 22_000 and len(ours.words) < 110
    assert not any(len(p) > encoding.LONGEST for p in ours.words)


def test_long_texts_are_cut_at_blanks(monkeypatch):
    text = fixtures.prose(1, 300) + " 漢字 " + fixtures.prose(2, 300)
    whole = encoding.encoder(WORDS)(text)
    monkeypatch.setattr(encoding, "CHUNK", 40)
    assert encoding.encoder(WORDS)(text) == whole


def written(docs: list[tuple[int | None, list[int]]], frame: int = 64) -> bytes:
    out = io.BytesIO()
    writer = frames.FrameWriter(out, frame)
    for doc_id, ids in docs:
        writer.add(doc_id, np.array(ids, "<u4").tobytes())
    writer.close()
    return out.getvalue()


DOCS = [(1, [5] * 3), (2, []), (None, list(range(70_000, 70_100))), (-(2**63), [2**32 - 1]), (2**63 - 1, [1, 2]), (7, [9] * 16), (7, [8])]


def test_random_access():
    data = written(DOCS)
    reader = frames.FrameReader(io.BytesIO(data), len(data))
    assert len(reader.table) > 5
    for at in (3, 0, 2, 6, 1, 5, 4):
        assert np.frombuffer(reader.ids(at), "<u4").tolist() == DOCS[at][1]
    assert [None if x["null"] else x["id"] for x in reader.index] == [i for i, _ in DOCS]
    one = frames.FrameReader(io.BytesIO(data), len(data))
    one.ids(5)
    assert one.frames_read <= 2
    # other tools read the plain ids
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as plain:
        assert np.frombuffer(plain.read(), "<u4").tolist() == [x for _, ids in DOCS for x in ids]


@pytest.mark.parametrize("nothing", [[], [(1, [])]])
def test_files_without_ids(nothing):
    data = written(nothing)
    reader = frames.FrameReader(io.BytesIO(data), len(data))
    assert len(reader.table) == 0 and [reader.ids(i) for i in range(len(reader.index))] == [b"" for _ in nothing]


def test_damage_is_noticed():
    data = bytearray(written([(1, list(range(500))), (2, list(range(500, 1000)))], 2_000))
    whole = frames.FrameReader(io.BytesIO(data), len(data))
    table = len(data) - frames.FOOTER.size - len(whole.table) * frames.ENTRY.size
    data[table + 8] ^= 1  # the first frame's checksum
    with pytest.raises(ValueError, match="checksum"):
        frames.FrameReader(io.BytesIO(data), len(data)).ids(0)
    assert frames.FrameReader(io.BytesIO(data), len(data)).ids(1)[:4] == np.array([500], "<u4").tobytes()
    with pytest.raises(ValueError, match="seek table"):
        frames.FrameReader(io.BytesIO(data[:-1]), len(data) - 1)


def test_odd_rows(spark, tmp_path):
    docs = fixtures.frame(spark).repartition(6)
    path = str(tmp_path / "ids")
    frames.write(docs, path, WORDS, 2)
    rows = sorted(frames.read(spark, path).collect(), key=lambda r: r.start)
    want = sorted((r[0] is None, r[0] or 0, plain_ids(WORDS, r[1])) for r in fixtures.documents())
    assert sorted((r.doc_id is None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == want
    ids = [(r.doc_id is None, r.doc_id or 0) for r in rows]
    assert ids == sorted(ids)
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens


def test_only_wanted_documents(spark, tmp_path):
    path = str(tmp_path / "ids")
    docs = spark.createDataFrame([(i, fixtures.prose(i, 50)) for i in range(400)], "doc_id long, text string")
    frames.write(docs, path, WORDS, 2)
    files = json.load(open(f"{path}/{frames.MANIFEST}"))
    assert len(files) > 1 and sum(f["documents"] for f in files) == 400
    some = frames.read(spark, path).where("doc_id IN (3, 390) OR doc_id = 77")
    assert sorted(r.doc_id for r in some.collect()) == [3, 77, 390]
    one = frames.read(spark, path).where("doc_id = 77")
    assert "PushedFilters: [EqualTo" in one._jdf.queryExecution().toString() or one.rdd.getNumPartitions() == 1
    assert one.rdd.getNumPartitions() == 1 and [r.doc_id for r in one.collect()] == [77]
    assert frames.read(spark, path, "doc_id long, n_tokens long").where("doc_id < 0").collect() == []
    assert frames.read(spark, path, "n_tokens long").count() == 400


@pytest.mark.parametrize("least, greatest", [(5, 9), (None, None)])
def test_ranges(least, greatest):
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual, Not

    a = ("doc_id",)
    met = {EqualTo(a, 5): True, EqualTo(a, 4): False, In(a, (1, 9)): True, In(a, (1, 10)): False, LessThan(a, 5): False}
    met |= {LessThanOrEqual(a, 5): True, GreaterThan(a, 9): False, GreaterThanOrEqual(a, 9): True, Not(EqualTo(a, 5)): True}
    for f, truth in met.items():
        assert frames._in_range(f, least, greatest) is (truth or least is None)


def test_empty_table(spark):
    assert frames.round_trip(fixtures.frame(spark, []), WORDS, 2).collect() == []


def test_one_id_for_a_third_of_the_rows(spark):
    rows = [(5, fixtures.prose(i, 30)) for i in range(300)] + [(i, "a b") for i in range(100, 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parts = frames.encoded(df.repartition(4), WORDS, 2).rdd.mapPartitions(lambda it: [sum(r.doc_id == 5 for r in it)]).collect()
    assert sum(parts) == 300 and sum(n > 0 for n in parts) > 1


def test_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    found = sorted(map(tuple, queries.QUERIES["op13_token_frames"](spark, DATA).collect()))
    want, at = [], 0
    for r in sorted(docs, key=lambda r: r.doc_id):
        ids = np.array(plain_ids(WORDS, r.text), "<u4") if len(want) < 40 else np.frombuffer(encoding.encoder(WORDS)(r.text or "") + b"\2\0\0\0", "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert found == want
