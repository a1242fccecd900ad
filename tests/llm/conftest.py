import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, __row string, __k string, d int, l int, size string, target int, __text int, name int, k int"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text, source, lang), with extra columns whose names clash with those inside the operators."""

    def build(rows):
        full = [(i, t, lang, s, None if t is None else len(t), "row", "key", 1, 2, "big", 3, 4, 5, 6) for i, t, s, lang in rows]
        return spark.createDataFrame(full, COLUMNS)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = "\n".join(f"line {i} of a very long text with some words {i * i}" for i in range(4000))
    same = "the same text of more than ten words stands in this table more than once, twice even"
    rows = [
        (1, "", "a", "en"), (2, None, None, None), (None, same, "a", "en"), (None, None, None, None), (3, same, "b", "en"), (3, same, "b", "en"), (3, "another text", "b", "de"),
        (4, long, "c", "en"), (5, long, None, None), (6, "\n\n \t\n", "é", "fr"), (7, "ein ganz kurzer deutscher Satz mit einigen Wörtern darin", "a", "de"), (8, "<|endoftext|> 1234", "z", "es"),
        (9, "123 456 !!!", "a", "und"), (10, "wort", "a", "de"), (11, "\U0001f600 émoji", "a", "fr"),
    ]
    return make(rows)


@pytest.fixture(scope="session")
def empty(make):
    return make([])
