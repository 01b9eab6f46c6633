import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(*texts, ids=None):
        """Rows (i, text, ...) with an extra column whose name clashes with an operator's own."""
        ids = list(range(len(texts))) if ids is None else ids
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], SCHEMA)
        from pyspark.sql import functions as F

        return df.withColumn("digest", F.lit("clash")).withColumn("kept", F.lit(7)).withColumn("score", F.lit(None).cast("double"))

    return make
