import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def clashing(df):
    """Columns that the operators use themselves."""
    from pyspark.sql import functions as F

    for name in ("digest", "tie", "block", "key", "size", "words", "root", "id", "score", "gone_id", "u", "row"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, ids=None, sources=None, extra=False):
        ids = list(range(len(texts))) if ids is None else ids
        sources = ["web"] * len(texts) if sources is None else sources
        rows = [(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources, strict=True)]
        df = spark.createDataFrame(rows, DOCS)
        return clashing(df) if extra else df

    return make


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"
