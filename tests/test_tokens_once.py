"""A search cuts the texts into tokens once, for the counts of the corpus and for the scores."""

from pyspark.sql import functions as F

from quarry.operators import retrieval

ROWS = [("a", "the cat sat", "Cat"), ("b", "a dog, a cat", None), ("c", None, "dog dog"), ("a", "the cat sat on", "x"), (None, "cat", "y"), ("d", "", "")]
ASKED = [(1, "cat dog"), (2, "the THE mat"), (3, "nothing here"), (4, None)]


def tables(spark):
    index = spark.createDataFrame(ROWS, "chunk_id string, chunk_text string, title string").coalesce(1)
    return index, spark.createDataFrame(ASKED, "query_id long, question string")


def test_each_text_is_read_once(spark):
    index, queries = tables(spark)
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    found = retrieval.bm25_search(index.withColumn("chunk_text", seen("chunk_text")), queries).collect()
    assert found
    assert read.value == len(ROWS)


def test_candidates_keep_the_scores_of_every_row(spark):
    index, queries = tables(spark)
    index = index.where("chunk_id is null or chunk_text <> 'the cat sat'")
    every = {(r["query_id"], r["chunk_id"]): round(r["score"], 9) for r in retrieval.bm25_match(index, queries).collect()}
    wanted = spark.createDataFrame([(1, "b"), (2, "c"), (9, "b")], "query_id long, chunk_id string")
    for also in (None, wanted):
        found = retrieval.bm25_candidates(index, queries, 10, also=also).collect()
        assert {(r["query_id"], r["chunk_id"]): round(r["score"], 9) for r in found} == every
        assert len(found) == len(every)
