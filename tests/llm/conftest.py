import pytest

#: Documents that every operator must take: null and empty texts, white space, ties, repeated rows, a very long text, null and repeated ids.
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 40_000


def odd_rows():
    return [
        (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \n\t ", "en", None, 4), (4, "one", "en", "b", 3), (5, "one two three four", "en", "b", 18),
        (6, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf", "en", "a", 80),
        (7, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf", "en", "b", 80),
        (7, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf", "en", "b", 80),
        (8, LONG, None, "c", len(LONG)), (9, "x" * 300_000, "de", "c", 300_000), (10, "É̀ ▁a  b\n\n▁ <s> 😀\x00 end", "fr", "", 20), (None, "no id here but a text with some words", "en", "a", 10),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd documents with extra columns whose names operators might use."""
    df = spark.createDataFrame(odd_rows(), DOCS)
    return df.selectExpr("*", "1 AS size", "'x' AS id", "2 AS copies", "3 AS taken", "'y' AS _text", "4 AS count", "array(1) AS path", "5 AS in_0", "6 AS n", "7 AS bucket", "8 AS _id", "0.5D AS score", "1 AS predicted", "true AS contaminated", "9 AS n_hit", "10 AS n_words", "11 AS longest_hit", "'s' AS slot", "'t' AS shard", "12 AS fold", "13 AS toxic", "'v' AS spans", "14 AS n_tokens", "15 AS component_id", "true AS kept")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
