import pytest

LONG = "word " * 3000 + " ".join(f"w{i}" for i in range(30_000))
EDGE = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away."), (2, None), (3, ""), (4, " \t\n \x0b"), (5, "one"), (6, "one two three"), (7, LONG),
    (8, "The quick brown fox jumps over the lazy dog and runs far away."), (8, "The quick brown fox jumps over the lazy dog and runs far away."), (9, "a b \x1c c <|endoftext|> d  e"), (None, "no id here at all"), (None, None),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, repeated rows and columns whose names clash with the operators' own."""
    extra = ("key", "n", "own", "kept", "rep", 1, "x")
    return spark.createDataFrame([(*r, "en", "s", 1, *extra) for r in EDGE], "doc_id long, text string, lang string, source string, n_chars long, key string, n string, own string, kept string, rep string, component int, anchor string")


@pytest.fixture(scope="session")
def none(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_50k.json")
