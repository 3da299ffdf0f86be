import pytest


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, and clashing extra columns."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    texts = [None, "", "  \n\t", "one", "Two words", long, "a b c d e f g h", "a b c d e f g h", "ÄÖ\x1c x é", "#" * 50]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 3}", 0) for i, t in enumerate(texts)]
    rows += [(7, "a b c d e f g h", "en", "s1", 0), (None, "no id here", None, None, None), (None, None, None, None, None)]
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    extra = ["size", "taken", "pattern", "fp", "row", "label", "score", "id", "bucket", "rank", "order", "words", "copy", "k0", "body", "held_out", "n"]
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, cols).withColumns({c: F.lit(f"own {c}") for c in extra}).cache()


@pytest.fixture(scope="session")
def tables(spark):
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
