import pytest

# names that operators use inside; a table may have them too
CLASH = ("n", "h", "rep", "t1", "t2", "piece", "length", "label", "score", "block", "prefix", "component", "row", "spans", "item_id")


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) pairs, with columns whose names clash."""

    def make(pairs):
        rows = [(i, t, "en", "web", len(t or ""), *("x" for _ in CLASH)) for i, t in pairs]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)).repartition(3)

    return make


@pytest.fixture(scope="session")
def labels_of(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


LONG = "word " * 60_000 + "end"
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "one two three four five six"), (6, LONG), (7, LONG), (8, "é中\x00   <|endoftext|>"), (9, "A b C d e f"), (10, "a B c D E F")]
