import random

import pytest

BASE = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = "chunk int, bucket int, size bigint, row string, place bigint, part int, n bigint, node bigint, comp bigint, ids binary, model string, probe bigint, copies bigint"


def messy_rows():
    """NULLs in every column, empty and blank texts, a very long text, ties, repeated rows, near and exact copies, shared passages."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeäé") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(40), prose(200).split()
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \t\n ", None, "a", 3), (4, "one two", "de", "b", 7), (5, "one  two", "de", "b", 8), (6, "ONE two", "en", "c", 7),
            (7, prose(30_000), "en", "a", None), (8, "x" * 300_000, "fr", "a", 1), (None, prose(50), "en", "a", 1), (None, passage, None, None, None), (9, "123 ... !!!", "en", "a", 1)]
    rows += [(10 + i, prose(20) + " " + passage + "\n" + prose(20), "de", "b", 1) for i in range(8)]
    for i in range(12):
        near = list(base)
        for _ in range(rng.choice((1, 2, 3, 5, 8))):
            near[rng.randrange(len(near))] = word()
        rows.append((30 + i, " ".join(near), "fr", f"s{i % 4}", 1))
    rows += [(50 + i, "the same text of nine words is found here " + passage, "en", "c", 1) for i in range(5)]
    rows += [rows[-1], rows[-1]]
    rows += [(60 + i, prose(rng.randint(1, 120)), rng.choice(("en", "de")), rng.choice(("a", "b", "c")), 1) for i in range(30)]
    rows += [(-5, passage + " " + prose(10), "en", "a", 1), (2**40, passage, "en", "a", 1)]
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    """The messy rows with extra columns whose names clash with those the operators use inside."""
    n = len(CLASH.split(", "))
    return spark.createDataFrame([(*r, *[None] * n) for r in messy_rows()], f"{BASE}, {CLASH}")


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.where("1 = 0")
