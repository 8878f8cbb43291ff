import pytest

LONG = " ".join(f"w{i % 977}" for i in range(30000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with clashing names."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (None, "a b c d e f g"), (5, LONG), (6, LONG + " end"), (7, "x" * 3000), (8, "Üb ß 😀 é"), (9, None)]
    return spark.createDataFrame([(i, t, 1.0, 2, "s", 3) for i, t in rows], "doc_id long, text string, score double, g int, sig string, n int")
