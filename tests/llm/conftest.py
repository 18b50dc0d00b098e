import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (id, text) or (id, text, source)."""

    def make(*rows, extra=""):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None) for r in rows]
        frame = spark.createDataFrame(full, DOCS)
        for name in extra.split():  # columns whose names the operators use themselves
            frame = frame.selectExpr("*", f"'mine' AS {name}")
        return frame

    return make


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest driver tables."""
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
