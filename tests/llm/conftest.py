import pytest

EXTRA = ["size", "score", "fp", "spans", "n_words", "kept", "evidence", "more", "rank", "target"]


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def edge_docs(spark, sf):
    """Documents with nulls, empty and long texts, repeated rows and columns named like results."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 80")
    schema = docs.schema
    first = docs.where("doc_id = 3").collect()[0]
    odd = [
        (9001, None, None, None, None), (9002, "", "en", "src0", 0), (None, "no id here.", "en", "src1", 11),
        (9003, "word " * 30000, "en", None, 150000), tuple(first), tuple(first), (9004, " \t\n ", "xx", "src2", 4),
        (9005, "\U0001f600 ünï cödé.", "de", "src2", 14), (None, None, None, None, None),
    ]
    rows = docs.unionByName(spark.createDataFrame(odd, schema))
    return rows.select("*", *[F.lit(f"x-{c}").alias(c) for c in EXTRA])
