"""From raw documents to token ids: toxicity, line dedup, near duplicates, decontamination, piece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. Stages keep rows with null or empty texts
unless their own rule drops them (copies of empty texts are near duplicates of each
other). Empty tables pass through.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.functions.lineage import cut_lineage
from netlens.llm import decontaminate, line_dedup, pieces, simhash, toxicity
from netlens.llm.common import fresh, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold of their language; learned from the labelled ones."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rejected = fresh(docs, "rejected")
    scored = toxicity.score_toxicity(docs, model, score=fresh(docs, "score"), rejected=rejected)
    return scored.where(~F.col(rejected)).select(*(f"`{c}`" for c in docs.columns))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a document of a smaller id holds; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs).select(*(f"`{c}`" for c in docs.columns))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each SimHash group: three-word shingles, two bits at most."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of ``documents`` with ``token_ids``, their number, and whether they decode to the text."""
    model = pieces.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    ids, decoded = fresh(docs, "token_ids"), fresh(docs, "decoded")
    return pieces.encode(docs, model, ids=ids, decoded=decoded).select(
        *(f"`{c}`" for c in docs.columns),
        ids,
        F.size(ids).cast("long").alias(fresh(docs, "n_tokens")),
        F.equal_null(F.col(decoded), F.col("text")).alias(fresh(docs, "round_trip")),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash", drop_copies),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]
#: Trained scores and piece ids are beyond SQL; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written once for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else cut_lineage(docs), sf_dir)
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
