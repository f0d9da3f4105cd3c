"""A first run looks up no document."""

from pyspark.sql import functions as F

from quarry.plans import batch as batch_plan


def test_first_run_looks_up_nothing(spark, tmp_path, monkeypatch):
    """All documents of an empty index are new: their contents are not joined with its ids (F11, F14)."""
    asked, skip = [], batch_plan.skip_indexed_docs
    monkeypatch.setattr(batch_plan, "skip_indexed_docs", lambda *a: asked.append(1) or skip(*a))
    docs = spark.createDataFrame([(f"{i}", f"Document {i} has a text that is long enough to be cut.") for i in range(5)], "id string, content string")
    for name in ("title", "url", "category", "doc_type", "agency", "published_date"):
        docs = docs.withColumn(name, F.lit(name))
    root = str(tmp_path / "index")
    assert batch_plan.rebuild(docs.where("id < '3'"), root, "first") == 3 and not asked
    assert batch_plan.rebuild(docs.where("id < '3'"), root, "first") == 3 and not asked
    assert batch_plan.rebuild(docs, root, "second") == 2 and asked
