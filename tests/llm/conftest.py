import pytest

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows, and extra columns of clashing names."""
    rows = [
        (1, None, "a"), (2, "", "b"), (3, " \n\t ", "c"), (4, LONG, "d"), (5, "The quick brown fox jumps over the lazy dog again and again", "e"),
        (6, "The quick brown fox jumps over the lazy dog again and again", None), (6, "The quick brown fox jumps over the lazy dog again and again", None),
        (None, "no id here at all", "f"), (None, None, None), (7, "été ünïcode 中文 😢 ▁ <s> <|endoftext|>  two", "g"), (8, "x", "h"), (9, "a\n\nb \n c", "i"), (9, "another text of nine", "j"),
    ]
    schema = "doc_id bigint, text string, source string"
    df = spark.createDataFrame(rows, schema)
    for name in ("n", "node", "pos", "token", "words", "k_id", "runs", "block", "size", "kind", "shard", "__x"):
        df = df.selectExpr("*", f"cast(doc_id as string) as `{name}`")
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
