import pytest


@pytest.fixture(scope="session")
def table_of(spark, tmp_path_factory):
    """Rows as a Parquet table of several files, read back."""

    def make(rows, schema, files=3):
        path = str(tmp_path_factory.mktemp("t") / "x")
        spark.createDataFrame(rows, schema).repartition(files).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty texts, a long one, repeats, odd white space, rare characters, control strings."""
    long = " ".join(f"word{k % 97} and more." for k in range(8000))
    return [None, "", " ", "a", "a b", " a", "a ", "a  b", "x\n y\n\n z", "a\tb\r\nc", "ünï cödé ñ", "日本 語 x", "😀 b\xff \x00c", "▁ a", "it's we'll 1 23 4.5!", "<|endoftext|> and <s>", "a\x1c b　 c", "same text twice", "same text twice", long, "no letters 123" * 3, "1 2 3"]
