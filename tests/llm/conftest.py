import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, score double, _row long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns whose names clash."""

    def build(rows):
        full = []
        for row in rows:
            doc_id, text, source = (*row, "s0")[:3]
            full.append((doc_id, text, "en", source, len(text or ""), -1, -1, -1.0, -1))
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def documents(spark, tables):
    return spark.read.parquet(f"{tables}/documents.parquet")
