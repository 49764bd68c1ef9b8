"""The registered queries on the small tables: against SQL, or by accuracy on held-out rows."""

import pytest
from pyspark.sql import functions as F
from tests.compare import of_duck, of_spark
from tidemark.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, duck, sf):
    assert of_spark(QUERIES[name](spark, sf)) == of_duck(duck, SQL[name])


def test_language_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op3_language"](spark, sf).join(docs, "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() >= 0.95 * got.count()


def test_toxicity_of_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = QUERIES["op7_toxicity"](spark, sf).join(labels, "doc_id")
    toxic = got.where("toxic = 1").agg(F.avg("score")).first()[0]
    assert toxic > 0.4 > 0.2 > got.where("toxic = 0").agg(F.avg("score")).first()[0]


def test_pipeline_stages_keep_their_promises(spark):
    import corpus_pipeline
    from tidemark.llm.common import table, written

    sf = "/root/testdata/sf0.01"  # at sf0.001, nine toxic texts are too few to learn any toxic word for sure
    docs = table(spark, sf, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), f"test-{name}")
        counts.append(docs.count())
        if name != "tokens":
            assert docs.columns == columns
    assert counts[0] > counts[1] >= counts[2] > counts[3] and counts[5] == counts[4]


def test_pipeline_stages_take_odd_and_empty_tables(spark, sf):
    """Null ids, texts and sources, empty, one-word and long texts, repeated rows, one id with two texts, columns of the operators' own names."""
    import corpus_pipeline

    long = " ".join(f"word{i % 977}" for i in range(20_000))
    prose = " ".join(f"thing{i}" for i in range(60))
    rows = [(1, prose, "en", "a"), (1, prose, "en", "a"), (2, prose + " more", "en", None), (2, "another text of document two", "fr", "a"), (3, None, None, "a"), (4, "", "en", "b"), (5, " \n", "fr", "b"), (6, "Word", "fr", "b"), (None, prose, "en", "a"), (None, None, None, None), (7, long, "en", "b"), (8, "12 34 !!", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"n_chars": F.length("text").cast("long"), "score": F.lit("mine"), "kept": F.lit(7), "size": F.lit("x")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
        out = stage(spark, docs, sf)
        if name != "tokens":
            assert out.columns == docs.columns
        got = out.collect()
        ids = sorted((r.doc_id for r in got if r.doc_id is not None))
        if name == "near_dup":  # 2 is near to 1 by one of its texts
            assert ids == [1, 3, 4, 5, 6, 7, 8] and len(got) == 9
            assert sorted(map(str, got)) == sorted(map(str, stage(spark, docs.repartition(5), sf).collect()))
        elif name == "language":
            assert not {3, 4, 5, 8} & set(ids)
        elif name == "tokens":
            assert len(got) == len(rows) and all(r.score == "mine" for r in got)
        elif name == "mix":
            assert not {3, 4, 5} & set(ids) and all(r.text.split() for r in got)
