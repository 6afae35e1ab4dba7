import pytest
from pyspark.sql import types as T

#: Names that operators use inside, as extra columns of the input.
EXTRA = "body salt size key label cid n block place line words content target weight number rank start kept group_size score spans __index".split()
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(x, T.StringType()) for x in EXTRA)])
PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), *(T.StructField(x, T.StringType()) for x in EXTRA)])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source]) with every extra column; lang and n_chars are null."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, *(["x"] * len(EXTRA))) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def make_pages(spark):
    def make(rows, partitions=3):
        return spark.createDataFrame([(*r, *(["x"] * len(EXTRA))) for r in rows], PAGES).repartition(partitions)

    return make
