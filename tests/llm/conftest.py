import random

import pytest

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          # columns whose names the operators use themselves
          "key string, score double, size int, word string, n long, words int, row string, copies string, _key int, _id int, held_out string")


@pytest.fixture(scope="session")
def make_docs(spark):
    """[(doc_id, text, lang, source)] -> documents with further columns of clashing names."""
    def make(rows):
        return spark.createDataFrame([(*r, len(r[1] or ""), "k", 1.5, 7, "w", 3, 9, "r", "c", 11, 12, "h") for r in rows], SCHEMA)
    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls everywhere, empty, blank and long texts, ties and repeated rows."""
    r = random.Random(5)
    prose = lambda n: " ".join(r.choice("the of and to house river stone light walk under green seven often bright".split()) for _ in range(n))
    same = prose(80)
    return make_docs([
        (1, prose(60), "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \t\n ", "en", "b"), (5, same, "en", "b"), (5, same, "en", "b"),
        (6, same, "de", "c"), (7, prose(30_000), "en", "a"), (None, prose(70), "en", "b"), (None, None, None, None), (8, "123 456 !!", "en", "a"),
        (9, "x" * 300_000, "en", "a"), (10, "ein Wort", None, "b"), (11, "\u0130 \u212a \U0001f600 \u00e9t\u00e9", "fr", "c")])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
