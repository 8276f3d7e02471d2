"""The pipeline's stages against brute-force versions of each, on the smallest tables."""

import duckdb
import numpy as np
import pytest

import corpus_pipeline as cp
from netlens.llm import decontaminate as dc
from netlens.llm import pieces as pc
from netlens.llm import simhash as sh
from netlens.llm.queries import SQL
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_pieces import plain
from tests.llm.test_simhash import brute_components, brute_links, brute_print

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    out.append(docs.toPandas())
    for k, (_, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        assert k == len(cp.STAGES) - 1 or docs.columns == COLUMNS
        out.append(docs.toPandas().sort_values("doc_id", ignore_index=True))
    return out


def test_toxic_documents_go(stages):
    before, after = stages[0], stages[1]
    labels = dict(duckdb.sql(f"select doc_id, toxic from '{SF_DIR}/labels.parquet'").fetchall())
    gone = set(before["doc_id"]) - set(after["doc_id"])
    assert sum(labels.get(i) == 0 for i in gone) <= 1 and sum(labels.get(i) == 1 for i in after["doc_id"]) <= 3


def test_repeated_lines_go(stages):
    before, after = stages[1], stages[2]
    want = brute_lines(list(zip(before["doc_id"].tolist(), before["text"], strict=True)))
    assert sorted(zip(after["doc_id"].tolist(), after["text"], strict=True), key=repr) == [x[:2] for x in want]
    assert (after["n_chars"] == after["text"].str.len()).all()


def test_one_of_each_group_stays(stages):
    before, after = stages[2], stages[3]
    prints = {i: brute_print(t) for i, t in zip(before["doc_id"].tolist(), before["text"], strict=True)}
    comp = brute_components(prints, brute_links(prints))
    assert after["doc_id"].tolist() == sorted(set(comp.values()))


def test_leaks_go(stages):
    before, after = stages[3], stages[4]
    items = duckdb.sql(f"select item_id, text from '{SF_DIR}/benchmark.parquet'").fetchall()
    rows = list(zip(before["doc_id"].tolist(), before["text"], strict=True))
    small = [(i, t) for i, t in rows if len(t) < 4000]  # the brute-force version is slow
    leaks = {d for d, *_ in brute_leaks(small, items, dc.Bm25Params())}
    kept = set(after["doc_id"].tolist())
    assert {i for i, _ in small} - kept == leaks


def test_ids(stages):
    after = stages[5]
    model = pc.load_pieces(cp.public_tokenizers.path("piece_bpe_32k.model"))
    assert after["round_trip"].all() and len(after) == len(stages[4])
    for text, ids, n in zip(after["text"], after["token_ids"], after["n_tokens"], strict=True):
        assert len(ids) == n
        if len(text) < 2000:
            assert list(ids) == plain(model, text)


def test_run_equals_the_stages(spark, stages):
    got = cp.run(spark, SF_DIR).toPandas().sort_values("doc_id", ignore_index=True)
    assert got["doc_id"].tolist() == stages[5]["doc_id"].tolist()
    assert all(np.array_equal(a, b) for a, b in zip(got["token_ids"], stages[5]["token_ids"], strict=True))


def test_odd_rows_pass(spark, tmp_path):
    import shutil

    for t in ("labels", "benchmark"):
        shutil.copy(f"{SF_DIR}/{t}.parquet", tmp_path / f"{t}.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, token_ids string, score int"
    rows = [(None, None, None, None, None, "a", 1), (1, None, "en", "s", 0, "a", 1), (1, None, "en", "s", 0, "a", 1), (2, "", None, "s", 0, "b", 1),
            (3, "one line of text\n" * 500, "xx", "s", 9, "c", 2), (4, "one line of text", "xx", "s", 9, "c", 2)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = cp.run(spark, str(tmp_path))
    assert got.columns[:7] == ["doc_id", "text", "lang", "source", "n_chars", "token_ids", "score"]
    assert sorted((r.doc_id for r in got.collect()), key=repr) == [1, 3, None]
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_registered_names(spark):
    import __spark_entry__ as registry

    names = list(registry.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert set(SQL) <= set(names) and sh.BITS == 2
