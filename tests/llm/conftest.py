import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, component_id long, n_words long, word string, c long, digest long, host string, key long, held boolean, spans string, start int, uid long, kept boolean"
LONG = "alpha beta gamma delta 12 " * 30_000


def rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows; columns whose names clash."""
    rest = ("x", 1, 2, "w", 3, 4, "h", 5, True, "s", 6, 7, False)
    none = (None,) * 13
    texts = [
        (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "a"),
        (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (None, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", None),
        (None, None, None, None),
        (4, " \n\t ", "de", "b"),
        (5, LONG, "en", "b"),
        (6, "Ärger über Öl, ça va? 你好 world x y 🎉", "de", "b"),
        (7, "<|endoftext|> don't  stop\n\n\nnow 'the !'s", "en", "a"),
        (8, "!!! 123 ???", None, "a"),
        (9, "x" * 100_000, "fr", "a"),
    ]
    return [(i, t, lang, s, len(t or ""), *(rest if k % 2 else none)) for k, (i, t, lang, s) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def bench(spark):
    items = [(1, "jumps over the lazy dog near the old river bank and more"), (2, "Quick BROWN"), (2, "quick brown"), (None, "lazy dog"), (3, None), (4, ""), (5, "nowhere to be found")]
    return spark.createDataFrame(items, "item_id long, text string")
