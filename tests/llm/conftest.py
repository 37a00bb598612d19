import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang, source) rows, with columns whose names clash with
    working columns of the operators."""
    from pyspark.sql import functions as F

    def make(rows):
        full = [(*r, "en", "src0", 0)[:2] + ((r[2], r[3]) if len(r) > 2 else ("en", "src0")) + (0,) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        extra = ("h", "norm", "row", "size", "words", "content", "a", "b", "u", "v", "component_id", "keep_id", "label")
        return df.withColumns({c: F.lit("clash") for c in extra}).repartition(3)

    return make


