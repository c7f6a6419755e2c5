import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture
def docs_of(spark):
    """Documents from (id, text), with extra columns named like the operators' own."""

    def make(rows, parts=3):
        df = spark.createDataFrame(rows, DOC).repartition(parts)
        from pyspark.sql import functions as F

        names = ("id", "mark", "node", "n", "score", "key", "removed_words", "start", "label", "y", "h", "t", "c0")
        return df.withColumns({c: F.lit(f"other {c}") for c in names})

    return make
