import random

import pytest

WORDS = [a + b + c for a in "bdfgklmnp" for b in "aeiou" for c in ("n", "rt", "s", "lo", "mi", "que", "st", "ch")] + ["été", "straße", "наука", "中文", "the", "of"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    """Texts with exact and near copies, shared passages, odd white space, empty, blank and null ones, and a long one."""
    rng = random.Random(11)
    base = [prose(rng, rng.randint(20, 160)) for _ in range(25)]
    passage, texts = prose(rng, 30), list(base)
    for k in range(12):
        words = base[k % 5].split()
        words[rng.randrange(len(words))] = "edit" + "abcdefghijkl"[k]
        texts.append(" ".join(words))
    texts += base[:4] + [f"{prose(rng, 20)} {passage} {prose(rng, 9)}" for _ in range(8)]
    texts += ["", None, " \t\n ", "one", "one", "two words", "two words", "a a a a a a a a a a a a a a a a", "x" * 350, "line\nline\nother\nline", " lead and  gap \r\n tail ", "Ünï " * 40, prose(rng, 4000), passage]
    return texts


#: Rows (doc_id, text, and columns that clash with names used inside the operators).
ROWS = [(k, t, "src", -k, "kept") for k, t in enumerate(corpus(), 1)]
SCHEMA = "doc_id bigint, text string, source string, n_words bigint, `row` string"


@pytest.fixture(scope="session")
def docs(spark):
    rows = ROWS[:]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null and repeated keys, and repeated rows."""
    rng = random.Random(5)
    a, b = prose(rng, 60), prose(rng, 60)
    return spark.createDataFrame([(None, a), (None, a), (7, a), (7, a), (3, b), (None, b), (9, None), (None, None), (None, "lone " * 30)], "doc_id bigint, text string")
