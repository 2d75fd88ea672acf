import pytest

#: Names that the operators use inside, as further columns of the input.
CLASHING = ["_row", "_words", "_rid", "_text", "_hash", "_id", "_plain", "score", "key", "u", "v", "n", "shard", "piece", "length", "n_shingles", "component_id"]


@pytest.fixture
def make_docs(spark):
    """Documents from (id, text) pairs, with further columns of clashing names and nulls in all of them."""

    def make(rows):
        schema = "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHING)
        return spark.createDataFrame([(i, t, None, *[None if k % 2 else "x" for k in range(len(CLASHING))]) for i, t in rows], schema)

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty and blank texts, a very long one, ties and repeated rows."""
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
    return [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, long), (None, "null id with some text in it"), (6, "a\n\n\nb\n\n\n\n"), (6, "another text under the same id")]
