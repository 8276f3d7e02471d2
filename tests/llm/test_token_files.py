import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from netlens.llm import token_files as tf

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a    b\n\n c\t\td", "don't we'll 'tis I'm 's", "x²½ Ⅷ 日本語 🙂", "a<|endoftext|>b", "naïve Straße — «où»…", " \x1c\x85 z", "é" * 40,
       "tabs\tand\r\nlines \n  x", "12 345 6789 a1b2", "___ -- ''' \"q\"", "ǅungla ƻ ɏ", "word " * 3000]


def test_encoder_equals_the_library():
    lib, own = Tokenizer.from_file(PATH), tf.Encoder(PATH)
    texts = [*ODD, *(" ".join(ODD[:k]) for k in range(9)), open(tf.__file__).read()]
    for _ in range(2):
        got = [np.frombuffer(x, "<u2").tolist() for x in own.encode(texts)]
        assert got == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_random_plain_texts():
    lib, own = Tokenizer.from_file(PATH), tf.Encoder(PATH)
    rng = np.random.default_rng(0)
    alphabet = [*" aB9'é«…\n\t.", "'s", "'ll", "'re", "'d", "'t", "  ", "ve", "the"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 12))) for _ in range(4000)]
    got = [np.frombuffer(x, "<u2").tolist() for x in own.encode(texts)]
    assert got == [lib.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 127, 3000])
def test_index_is_minimal_and_refuses_strangers(n):
    high, low, prints = tf.key_hash([f"key {k}" for k in range(n)])
    records = np.zeros(n, tf.RECORD)
    records["print"], records["start"] = prints, np.arange(n)
    raw = tf.build_index(high, low, records)
    index = tf.IndexFile(raw)
    assert len(index.records) == n and sorted(index.records["start"]) == list(range(n))
    found, known = index.look_up(high, low, prints)
    assert known.all() and found["start"].tolist() == list(range(n))
    assert not index.look_up(*tf.key_hash([f"other {k}" for k in range(500)]))[1].any()


def test_same_hash_is_an_error():
    h = np.array([5, 5], np.uint64)
    with pytest.raises(ValueError):
        tf._pilots(h)


def rows_of(files, places):
    got = tf.read_back(files, places, lambda ids: (len(ids), zlib.crc32(ids.tobytes())), "n long, crc long")
    base = {r.file: r.base for r in tf.base_of(places.sparkSession, files.places).collect()}
    return sorted(((r.key, base[r.file] + r.start, r.n, r.crc) for r in got.collect()), key=repr)


def test_files_against_the_library(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "FILE_KEYS", 7)
    lib = Tokenizer.from_file(PATH)
    rows = [(k * 37 % 101 - 20, t) for k, t in enumerate([*ODD, *ODD[::-1], None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    files = tf.write(docs, PATH, f"file://{tmp_path}/a")
    want, start = [], 0
    for k, t in sorted(rows):
        raw = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        want.append((k, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    keys = files.places.select("key").union(spark.createDataFrame([(10_000 + k,) for k in range(50)], "key long"))
    assert files.index_files == 5 and rows_of(files, tf.look_up(files, keys)) == sorted(want, key=repr)
    stored = b"".join(p.read_bytes() for p in sorted((tmp_path / "a/data").glob("part-*")))
    assert len(stored) == 2 * start and not list((tmp_path / "a").rglob(".*"))


def test_nulls_repeats_empty_tables_and_two_texts(spark, tmp_path):
    schema = "file int, doc_id long, text string, start string"
    rows = [(1, None, "a", ""), (1, None, "a", ""), (1, 4, "b c", ""), (1, 4, "b c", ""), (1, 2, None, "")]
    files = tf.write(spark.createDataFrame(rows, schema), PATH, f"file://{tmp_path}/b")
    places = sorted(((r.key, r.length) for r in files.places.collect()), key=repr)
    assert places == [(2, 1), (4, 3), (None, 2), (None, 2)]
    assert sorted(r.key for r in tf.look_up(files, files.places.select("key").distinct()).collect()) == [2, 4]
    empty = tf.write(spark.createDataFrame([], schema), PATH, f"file://{tmp_path}/c")
    assert empty.places.count() == 0 and tf.look_up(empty, spark.createDataFrame([(1,)], "key long")).count() == 0
    with pytest.raises(Exception, match="two texts"):
        tf.write(spark.createDataFrame([(1, 4, "b", ""), (1, 4, "c", "")], schema), PATH, f"file://{tmp_path}/d")


def test_text_keys(spark, tmp_path):
    docs = spark.createDataFrame([("b", "one"), ("a", "two words")], "name string, body string")
    files = tf.write(docs, PATH, f"file://{tmp_path}/e", key="name", text="body")
    assert [(r.key, r.start) for r in tf.look_up(files, files.places.select("key")).orderBy("key").collect()] == [("a", 0), ("b", 3)]
