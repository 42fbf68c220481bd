import random

import pytest

#: id, text: nulls, empty and blank texts, ties and repeated rows, near copies, shared passages, personal data, a long text.
PASSAGE = " ".join(f"shared{i}" for i in range(30))


def make_rows():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    base = [word() for _ in range(120)]
    near = [*base]
    near[60] = "changed"
    rows = [
        (1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, "Intro " + PASSAGE + " one"), (5, "Other " + PASSAGE + " two"), (6, None), (7, ""), (8, " \n\t "), (9, "one"), (10, "one two"),
        (11, "mail a@b.cc or +1 (555) 123-4567, 4111 1111 1111 1111 at 10.0.0.1 and 300.1.1.1"), (12, "é𝒳 " + " ".join(word() for _ in range(40_000))), (13, "same same same same " * 30), (None, " ".join(base)), (15, "A" * 20_000), (16, "x\x1cy z"),
    ]
    return rows + [(100 + i, " ".join(word() for _ in range(r.randint(1, 200)))) for i in range(60)]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names clash with those that operators add."""
    data = [(i, t, "en" if k % 3 else None, f"s{k % 2}", len(t or ""), k, "x") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, n_words int, sequence_id string").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
