import random

import pytest

#: Columns whose names are those that operators use or return.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, digest string, score double, spans string, _file string, _bm_hit int, rep long"


def rows(pairs):
    return [(i, t, lang, "s", len(t) if t is not None else None, True, "d", 0.5, "x", "f", 1, 7) for i, t, lang in pairs]


@pytest.fixture
def docs(spark):
    """Makes a documents table with extra columns of (doc_id, text, lang) rows."""
    return lambda pairs: spark.createDataFrame(rows(pairs), SCHEMA)


@pytest.fixture(scope="session")
def words():
    """Makes n pseudo-words."""
    rng = random.Random(5)
    syllables = "the on er an re in ti tion st nd or ly ea".split()

    def make(n, seed=None):
        r = random.Random(seed) if seed is not None else rng
        return ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n)]

    return make


@pytest.fixture
def odd(words):
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(words(30_000, seed=1))
    return [
        (1, "The cat sat on the mat and the dog ran off with the hat.", "en"),
        (2, "The cat sat on  the mat and the dog ran off with the hat.", "en"),
        (3, "the cat sat on the mat and the dog ran off with the hat.", "en"),
        (4, None, None),
        (5, "", "en"),
        (6, " \t\n", None),
        (7, long, "de"),
        (8, long + " end", "de"),
        (9, "word", "fr"),
        (9, "word", "fr"),
        (None, "word", "fr"),
        (None, None, None),
        (10, "😀 ünï cödé 漢字 token = 'abcdefghijklmnop'", "es"),
    ]
