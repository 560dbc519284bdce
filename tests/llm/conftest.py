import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SYLLABLES = ["ba", "ko", "re", "tu", "mi", "sa", "lo", "ne", "dra", "vi"]


def prose(seed, n_words):
    r = random.Random(seed)
    words = ["".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(n_words)]
    return " ".join(words)


@pytest.fixture
def docs(spark):
    """A documents table from ``(doc_id, text)`` or longer rows."""

    def make(rows):
        full = [
            (r[0], r[1], *(list(r[2:]) + ["en", "src0"][len(r) - 2 :]))
            for r in rows
        ]
        full = [(*r, None if r[1] is None else len(r[1])) for r in full]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def odd_docs(docs):
    """Nulls, empty and white texts, a very long text, ties and repeated rows."""
    long = prose(1, 60_000)
    return docs(
        [
            (1, None),
            (2, ""),
            (3, " \t\n\x0b "),
            (4, "one"),
            (5, "two words"),
            (6, long),
            (7, long),
            (8, prose(2, 80)),
            (8, prose(2, 80)),
            (9, "x y éÉ </s> <|endoftext|> tail."),
            (None, prose(2, 80)),
            (10, prose(3, 60), None, None),
        ]
    )
