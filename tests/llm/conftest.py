import pytest

from meterline.llm.scratch import Scratch

ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "the same words again and again here now"), (903, "the same words again and again here now"), (None, "no id at all " * 9), (904, "word " * 30000)]


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


@pytest.fixture(scope="session")
def docs(spark):
    """Test documents with nulls, empty and very long texts, repeats, and clashing names."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = rows.unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))
    return rows.selectExpr("doc_id", "text", "1 as n", "'x' as id", "'y' as key", "0 as score", "'z' as copy").cache()


@pytest.fixture(scope="session")
def plain_docs(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
