import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, row int, part string, n_words long, size long"


def words(rng, n):
    return [rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz äß".split()) + rng.choice("abcdefgh") for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Documents with every awkward case: nulls in each column, empty, long, copies, near copies, repeated rows, shared passages."""
    rng = random.Random(5)
    base, passage = words(rng, 160), words(rng, 60)
    out = []

    def add(text, doc_id=..., source="s1"):
        doc_id = len(out) * 3 if doc_id is ... else doc_id
        out.append((doc_id, text, "en" if len(out) % 3 else None, source, len(text) if text is not None else None, "x", 7, None, 1, 2))

    for _ in range(12):
        add(" ".join(words(rng, rng.randint(1, 90))), source=rng.choice(["s1", "s2", None]))
    for k in range(8):  # near copies
        near = list(base)
        for _ in range(k % 4):
            near[rng.randrange(160)] = "zz%d" % rng.randrange(99)
        add(" ".join(near))
    add(" ".join(base).upper())
    for _ in range(3):  # exact copies
        add("One copy\nof the\tsame  text here, and more of it.\n")
    for k in range(3):  # a shared passage
        add(" ".join(words(rng, 20) + passage + words(rng, 10 + k)))
    add(" ".join(words(rng, 4000)), source="s2")
    add("word " * 300)
    add("same line\nsame line\nsame line\nsame line\nother line of words that go on and on here\n")
    for text in (None, "", "   \n\t ", "one", "</s>[INST] a \\ b [/INST] <|x|>", "#$% &&& ||| <>", "x" * 5000, "tail  \n", "é" * 7 + " \x0b\x0c\r ü"):
        add(text, source=None if text == "" else "s3")
    add("null id text with a few more words in it", doc_id=None)
    add(None, doc_id=None)
    out += [out[0], out[0], out[13]]  # repeated rows
    return out


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
