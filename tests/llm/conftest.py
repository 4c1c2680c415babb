import pytest

LONG = "word " * 30_000
#: id, text: NULLs, empty and blank texts, one word, ties, repeated rows, a very long text, control strings and other scripts.
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "One"), (5, "one"), (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
    (7, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (8, LONG), (9, "x" * 70_000), (10, "<|endoftext|> <|im_start|> ▁ \u0000 é 日本語 😀"), (11, "  two  blanks \n\n lines  "), (None, "no id at all here"), (12, "!!! 123 ???"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Odd documents, with columns whose names the operators use inside."""
    rows = [(i, t, "en" if k % 2 else None, 0.5, "x", "y") for k, (i, t) in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double, _text string, id string").repartition(3)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
