import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string, node int, kept string, probability string, n_exact string"


def rows():
    """Nulls in every column, empty and long texts, repeated rows, ties and names that clash."""
    base = "the quick brown fox jumps over the lazy dog near the river bank every single morning in may"
    long = " ".join(f"word{i % 977} filler{i % 31}" for i in range(40_000))
    texts = [base, base, base + " today", None, "", " \n\t ", "one", "one two", long, long + " end", base.upper(), "héllo wörld " * 30, "x" * 5000, "a\nb\nc", base + "\n" + base, "<|endoftext|> mixed <|endoftext|>", "mail bob.lee@mail.example.com or +1 (212) 555-0123 from 10.0.0.7"]
    out = [(i, t, ["en", None, "de"][i % 3], ["s0", "s1", None][i % 3] if i else "s0", len(t) if t else None, "a", "b", 1, "c", "d", "e") for i, t in enumerate(texts)]
    return [*out, out[0], out[0], (None, base, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
