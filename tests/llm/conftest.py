"""Tables for the tests of this subpackage: small, and with every awkward row."""

import pytest

AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf today.", "en", "a", 5),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf today.", "en", "a", 5),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf today.", "en", "a", 5),
    (3, None, "en", "b", None),
    (4, "", None, None, 0),
    (5, " \t\n\x0b\x0c\r ", "de", "", 6),
    (6, "word", "en", "b", 4),
    (7, "two words", "en", None, 9),
    (8, "ÄÖÜ ß — 东京 \U0001f600 \x00 é   İ ς", "de", "c", 20),
    (9, "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000, "en", "a", 1),
    (None, "a row without an id that has its own text", "en", "a", 1),
    (None, None, None, None, None),
    (10, 'key token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here', "en", "a", 1),
    (11, "<|endoftext|> it's 'S 12 <|endoftext|>x</s>[INST] \\ \\\\", "en", "a", 1),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(awkward):
    """The same rows with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    for name in ("n", "node", "mark", "size", "ids", "score", "path", "kind", "url", "lang_pred", "media", "copies", "block", "h", "row", "_row", "_key", "_hash", "_copies", "_copy", "edge", "_whole", "_words", "_hits", "_near", "_found", "_secrets", "__lang_pred", "__row_a", "__row_b", "_kept"):
        awkward = awkward.withColumn(name, F.lit("x"))
    return awkward
