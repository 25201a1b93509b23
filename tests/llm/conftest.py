import pytest


def pytest_collection_modifyitems(items):
    for item in items:
        if "llm" in str(item.fspath):
            item.add_marker(pytest.mark.llm)


def pytest_configure(config):
    config.addinivalue_line("markers", "llm: operators of the training-data pipeline")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and white texts, ties, repeated rows, one very long text, clashing extra columns."""
    long = " ".join(f"w{i % 700}" for i in range(60_000))
    rows = [(1, "one two three four", "en"), (1, "one two three four", "en"), (2, None, "en"), (None, "one two three four", None),
            (None, None, None), (3, "", "de"), (4, " \n\t ", "de"), (5, long, "en"), (6, long, "en"),
            (7, "É'é 日本 😀 ▁x <|endoftext|> can't we'll\n\n", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    clash = {c: F.lit(f"own {c}") for c in ("n_words", "shard", "slot", "fingerprint", "row_no", "scores", "pieces", "lm", "n_tokens",
                                             "row", "key", "words_held", "notices", "digest", "kept", "cut_stratum", "hash", "ends")}
    return df.withColumns(clash)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
