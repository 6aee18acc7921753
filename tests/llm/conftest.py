import pytest

DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHING = ("row", "id", "key", "kept", "size", "digest", "maybe", "fp", "label", "copies", "slice", "stats", "of", "kinds", "term", "place", "shard", "piece")

LONG = " ".join(f"word{i % 997}" for i in range(60_000))
TEXTS = [
    None, "", "   ", "a", "the same text of some words", "the same text of some words", "The Same Text Of Some Words", "x\x00y  z\n\n", LONG, LONG + " end",
    "call +1 (415) 555-7713 or 4111111111111111 now", "é é 你好 \U0001f600   nbsp", "\t\n\r", "!!! ### %%% $$$", "one two three four five six seven eight nine ten",
]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and clashing names."""
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[8], (None, "the same text of some words", None, None, None), (None, None, None, None, None), (4, "another text under a used id", "en", "s0", 28)]
    names = ", ".join(f"{n} string" for n in CLASHING)
    return spark.createDataFrame([(*r, *["own"] * len(CLASHING)) for r in rows], f"{COLUMNS}, {names}")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
