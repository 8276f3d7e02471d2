import re

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from netlens.llm import pieces as pc

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pc.load_pieces(PATH)


def toy(strings):
    """Few pieces with many ties; one crosses spaces, so that texts are one unit."""
    table = {s: (k + 300, v * 1024) for k, (s, v) in enumerate(strings.items())}
    names = [bytes([k]) for k in range(256)] + [b""] * 44 + [s.replace("▁", " ").encode() for s in strings]
    return pc.Pieces(table, list(range(256)), names, -100 * 1024, max(map(len, strings)))


TIES = toy({"▁": -5, "a": -3, "b": -3, "aa": -6, "ab": -4, "ba": -4, "aba": -7, "bab": -6, "b▁a": -8, "aaaa": -9, "é": -4, "▁a": -6})
WORDS = toy({"▁": -5, "a": -3, "b": -3, "aa": -6, "ab": -4, "aba": -7, "▁a": -6, "▁ab": -7, "aaaa": -9})


def plain(model, text):
    """Viterbi over the whole text."""
    text = pc.escaped(text)
    score, back = [0] + [None] * len(text), [0] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for begin in range(max(0, end - model.longest), end):  # the longest last piece comes first
            piece = text[begin:end]
            s = model.table[piece][1] if piece in model.table else model.unknown if end - begin == 1 else None
            if s is not None and (score[end] is None or score[begin] + s > score[end]):
                score[end], back[end] = score[begin] + s, begin
    out, end = [], len(text)
    while end:
        piece = text[back[end] : end]
        out = ([model.table[piece][0]] if piece in model.table else [model.byte_ids[b] for b in piece.encode()]) + out
        end = back[end]
    return out


def run(spark, rows, model, chunk):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.token_ids, r.decoded) for r in pc.decode(pc.encode(docs, model, chunk_chars=chunk), model).collect()}


@pytest.mark.parametrize("model_name,chunk", [("ties", 5), ("ties", 16), ("words", 4), ("words", 9)])
def test_chunks_give_the_whole_text_result(spark, model_name, chunk, monkeypatch):
    monkeypatch.setattr(pc, "BLOCK", 3)
    m = {"ties": TIES, "words": WORDS}[model_name]
    rng = np.random.default_rng(1)
    rows = [(k, "".join(rng.choice(list("aabb é"), rng.integers(0, 90)))) for k in range(60)]
    rows += [(100, "a" * 70), (101, " " * 40), (102, "ab" * 40), (103, "é" * 33)]
    got = run(spark, rows, m, chunk)
    for k, text in rows:
        assert got[k] == (plain(m, text), text), text


def test_model_file_long_texts_and_round_trip(spark, model):
    rng = np.random.default_rng(2)
    words = ["the", "running", "Größe", "où", "tion", "12345", "x=y;", "日本語", "🙂", "\n", "\t", "  ", "antidisestablishment"]
    rows = [(k, " ".join(rng.choice(words, n))) for k, n in enumerate([1, 5, 50, 700])] + [(9, "nospaces" * 60), (10, "\n" * 300)]
    got = run(spark, rows, model, 100)
    for k, text in rows:
        assert got[k] == (plain(model, text), text)


def test_equals_the_library_as_unigram_model(model):
    """Scores of -1e9 are raised for the library, which adds single floats and then misses the best sum."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:
        piece.score = max(piece.score, -40_000.0)
    lib = SentencePieceProcessor(model_proto=proto.SerializeToString())
    units = pc.Units(model)
    text = open(pc.__file__).read()
    for line in re.findall(r"[^\n]+", text):
        if "  " not in line and "▁" not in line:
            assert np.frombuffer(pc.encode_text(units, line), "<i4").tolist() == lib.encode(line)


@pytest.mark.parametrize("model_name", ["ties", "words", "file"])
def test_units_together_equal_one_at_a_time(model, model_name, monkeypatch):
    monkeypatch.setattr(pc, "CACHE", 50)
    m = {"ties": TIES, "words": WORDS, "file": model}[model_name]
    rng = np.random.default_rng(5)
    units = ["▁" * int(rng.integers(0, 3)) + "".join(rng.choice(list("aabbé.s日Tthe"), rng.integers(1, 33))) for _ in range(3000)]
    one, many = pc.Units(m), pc.Units(m)
    for a in range(0, 3000, 700):
        many.learn(units[a : a + 700])
        assert [many[u] for u in units[a : a + 700]] == [one._encoded(u) for u in units[a : a + 700]]


def test_products_are_associative(model):
    rng = np.random.default_rng(3)
    a, b, c = (np.where(rng.random((4, 4)) < 0.3, pc.NEVER, rng.integers(-9, 0, (4, 4))) for _ in range(3))
    assert np.array_equal(pc.times(pc.times(a, b), c), pc.times(a, pc.times(b, c)))


def test_nulls_empty_texts_repeats_and_columns(spark, model):
    schema = "uid int, token_ids string, doc_id long, text string, k int"
    rows = [(1, "a", None, None, 1), (2, "b", 5, "", 1), (3, "c", 5, "some text " * 40, 1), (3, "c", 5, "some text " * 40, 1)]
    docs = spark.createDataFrame(rows, schema)
    got = pc.encode(docs, model, chunk_chars=64)
    assert got.columns == [*docs.columns, "_token_ids"]
    back = sorted((r.uid, r._token_ids is None, r.decoded) for r in pc.decode(got, model, ids="_token_ids").collect())
    assert back == [(1, True, None), (2, False, ""), (3, False, rows[2][3]), (3, False, rows[2][3])]
    assert pc.encode(docs.limit(0), model).count() == 0
    assert pc.encode(docs.where("uid = 3"), model, chunk_chars=64).count() == 2
