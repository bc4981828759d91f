"""A corpus pipeline: language, toxicity, near duplicates, benchmark passages, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``docs``. Its result is written as Parquet and read
again as the next stage's input.

* language: documents without a letter, or whose best language has a score
  under ``MIN_LANGUAGE``, go. The model learns from the stage's own rows.
* toxicity: documents with a score of at least 0.3 go. The model learns from
  the labels of the stage's own rows; documents without labels are scored alike.
* near duplicates: of each component of documents whose five-word shingle sets
  have a Jaccard similarity of at least 0.8 the one with the smallest id stays;
  of repeated rows with one id one stays; documents without words stay, as do
  those with a null id.
* decontamination: documents that hold ten consecutive words of a benchmark
  item (or all of a shorter one) go.
* tokens: ids and decoded text of every document.

A stage that gets an empty table returns one. Null texts have no letter and go
in the first stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import bpe, decontamination, language, signature_join, toxicity
from kinweave.llm.common import table, whole_row, with_results
from kinweave.session import materialize

MIN_LANGUAGE = 0.4
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ORACLE_SQL = None  # trained classifiers and BPE merges are not expressible in SQL


def _rows(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as one struct, so that results cannot clash with its columns."""
    return docs.select(whole_row(docs).alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("body"))


def _columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*with_results("row", docs.columns))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language.identify(_rows(docs), language.train_on_kept_in(docs), "body")
    return _columns(found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE)), docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train_on_kept_in(docs, table(spark, sf_dir, "labels"))
    return _columns(toxicity.score(_rows(docs), model, "body").filter("predicted = 0"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = signature_join.jaccard_components(docs, n=5, threshold=80)
    dropped = materialize(found.filter("component_id <> id").select("id").distinct(), "duplicates")
    kept = _rows(docs).join(dropped, "id", "left_anti")
    # rows that repeat an id hold one document; they are few, so only they are gathered
    repeated = materialize(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").select(F.col("doc_id").alias("id")), "repeated")
    single = kept.join(repeated, "id", "left_anti").select("row")
    first = kept.join(repeated, "id", "left_semi").groupBy("id").agg(F.min("row").alias("row")).select("row")
    return _columns(single.unionByName(first), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_rows(docs), table(spark, sf_dir, "benchmark"), text_col="body")
    return _columns(found.filter(~F.col("contaminated")), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # stored in between, so that a task has one Python worker with the tokenizer at a time and not two
    ids = materialize(bpe.encode(docs.select("doc_id", "text"), TOKENIZER).select("doc_id", "ids"), "ids")
    return bpe.decode(ids, TOKENIZER).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language ID", keep_known_language),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{uuid.uuid4().hex[:6]}")
    return STAGES[-1][1](spark, docs, sf_dir)
