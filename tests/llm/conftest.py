import pytest

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew strange tea near old stone bridges".split()


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, very long and repeated texts, ties, a null key and extra
    columns whose names operators use themselves."""
    long = " ".join(f"{w}{i % 997}" for i in range(1_800) for w in WORDS)
    plain = " ".join(WORDS)
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n ", "b"), (4, "word", None), (5, long, "a"), (6, plain, "a"), (6, plain, "a"), (7, plain.upper(), "b"),
        (8, plain + " end", "a"), (9, "straße ünï 世界 😀 " + plain, "b"), (None, "no key at all", "a"), (10, "x " * 500, None),
    ]
    extra = "_text _key fp n row count size bin_id keep_id lot block keys text_sha256 _hot_key key _row _term n_tokens".split()
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return table.selectExpr("*", *[f"'{c}' AS `{c}`" for c in extra])


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id = -1")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
