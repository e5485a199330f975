import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


@pytest.fixture
def make_docs(spark):
    """Documents of ``(doc_id, text[, source])`` rows, with columns whose names clash."""

    def make(rows, clash=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(3)
        if clash:
            for name in ("row", "count", "key", "bytes", "winner", "size", "uid", "bucket", "digest", "cell", "depth", "shard", "_id", "length"):
                df = df.selectExpr("*", f"doc_id AS {name}")
        return df

    return make
