import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__
from kinweave.llm import queries

SF = "/root/testdata/sf0.001"


def test_every_operator_has_one_registered_query():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(queries.ORACLES) <= set(queries.QUERIES)


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    extra = spark.createDataFrame(
        [
            (9000, None, "en", "x", 0), (9001, "", "en", "x", 0), (9002, "123", "en", "x", 0), (None, "The and of that was in the", None, None, None),
            (9003, "The and of in that was for the", "en", "x", 1), (9003, "The and of in that was for the", "en", "x", 1),
        ],
        docs.schema,
    )
    kept = corpus_pipeline.keep_known_language(spark, docs.unionByName(extra), SF)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and not {9000, 9001, 9002} & set(ids) and len(ids) >= 75
    calm = corpus_pipeline.drop_toxic(spark, docs.unionByName(extra), SF)
    assert calm.columns == docs.columns and 0 < calm.count() <= 86
    one_each = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs.unionByName(docs).unionByName(extra), SF).collect()]
    named = [i for i in one_each if i is not None]
    assert len(named) == len(set(named)) and 9003 in named and 9000 in named and None in one_each
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("text is not null").first().text
    planted = docs.filter("doc_id < 5").withColumn("text", F.concat(F.lit("ka lo mi "), F.lit(item), F.lit(" tu")))
    clean = corpus_pipeline.drop_contaminated(spark, planted.withColumn("doc_id", F.col("doc_id") + 5000).unionByName(extra), SF).collect()
    assert {r.doc_id for r in clean} >= {9000, 9003} and not any(r.doc_id and 5000 <= r.doc_id < 5005 for r in clean)


def test_a_task_has_one_tokenizer_at_a_time(spark):
    out = corpus_pipeline.tokenize(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(3), SF)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and all(len(r.ids) == r.n_tokens for r in out.collect())


def test_empty_documents_go_through_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0, name


def test_run_equals_the_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    expected = {(r.doc_id, r.n_tokens, r.decoded) for r in docs.collect()}
    assert {(r.doc_id, r.n_tokens, r.decoded) for r in corpus_pipeline.run(spark, SF).collect()} == expected


def test_near_copies_by_five_words_and_eighty_per_cent_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    rows = []
    for g in range(3):
        words = [f"g{g}w{i}" for i in range(100)]
        rows.append((10 * g, words, "en", "x", 0))
        # two words apart: 86 of 106 five-word shingles are shared (0.81), and 92 of 104 three-word ones (0.88)
        rows.append((10 * g + 1, words[:30] + ["other"] + words[31:70] + ["another"] + words[71:], "en", "x", 0))
        # another start and end: 91 of 127 (0.72)
        rows.append((10 * g + 2, ["a"] + words[5:] + [f"h{g}w{i}" for i in range(30)], "en", "x", 0))
    table = spark.createDataFrame([(i, " ".join(w), *rest) for i, w, *rest in rows], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, table, SF).collect()}
    assert kept == {0, 2, 10, 12, 20, 22}
