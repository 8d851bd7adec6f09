import pytest

#: Nulls, empty and blank texts, a long text, ties and repeated rows; the extra columns have names used inside.
ODD_ROWS = [
    (5, "one two three four five six"), (5, "one two three four five six"), (7, "one two three four five six"), (None, "one two three four five six"), (8, None), (9, ""),
    (10, " \n\t "), (11, "x"), (12, "word " * 30_000), (None, None), (13, "é ß İ 😀 \x00 <b>&amp;</b> 1,5."), (14, "a\nb\n\nb\n"), (-3, "ONE TWO three four five six"), (15, "line one two 1\n" * 3),
]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ODD_ROWS, "doc_id long, text string")
    for c in ("h", "sha", "salt", "score", "n", "word", "block", "key", "rep", "lang", "page_id", "s"):
        rows = rows.withColumn(c, F.lit("x"))
    return rows


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def odd_rows():
    return ODD_ROWS
