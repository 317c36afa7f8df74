import random

import pytest

SYLLABLES = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]
COMMON = ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for"]


def prose(rng, n):
    made = [rng.choice(COMMON) if rng.random() < 0.4 else "".join(rng.choices(SYLLABLES, k=rng.randint(2, 4))) for _ in range(n)]
    return " ".join(w.capitalize() + "." if i % 9 == 8 else w for i, w in enumerate(made))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, one id with two texts."""
    rng = random.Random(5)
    long = prose(rng, 60_000)
    same = prose(rng, 80)
    rows = [
        (1, same, "en", "a", None), (2, same, "en", "a", 3), (2, same, "en", "a", 3), (3, same + " more", None, None, 3),
        (4, None, "en", "b", 0), (5, "", None, "b", 0), (6, " \n\t ", "en", None, 3), (7, long, "en", "c", 9),
        (8, "One two", "xx", "c", 7), (9, "one TWO", "xx", "c", 7), (10, "x" * 5000, "en", "c", 5000),
        (None, prose(rng, 70), "en", "a", 1), (None, None, None, None, None),
        (11, "first text " + prose(rng, 60), "de", "a", 1), (11, "second text " + prose(rng, 60), "de", "a", 1),
        (12, "IT!! " * 70, "en", "a", 1), (13, "é ü 🙂\x1cñ  x  y\r\n\x0b\x0c z's they'll 'tis \x00", "fr", "ä", 1),
    ]
    rows += [(100 + i, prose(rng, rng.randint(1, 150)), rng.choice(["en", "de"]), rng.choice("abc"), i) for i in range(60)]
    return rows


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    """Those rows, with further columns whose names clash with columns of the operators."""
    df = spark.createDataFrame(edge_rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr(
        "*", "n_chars AS size", "lang AS row", "source AS kept", "n_chars AS quality_score", "text AS version", "doc_id AS b",
        "n_chars AS `odd name.x`",
    )


@pytest.fixture(scope="session")
def labels(spark, edge_rows):
    ids = sorted({r[0] for r in edge_rows if r[0] is not None})
    rows = [(i, 0 if i in (12, 10, 8) else 1, 0) for i in ids] + [(1, 1, 0), (None, 1, 0), (2, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
