import pytest

PROSE = "the quick brown fox jumps over the lazy dog while many small birds sing in old trees near a quiet river and people walk slowly home".split()


def prose(n: int, seed: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(PROSE) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls, empty and long texts, copies, ties, repeated and null ids, and columns whose names the operators use themselves."""
    base, other = prose(300, 1), prose(400, 2)
    near = base.split()
    near[150] = "changed"
    texts = [
        (0, base), (1, None), (2, ""), (3, base), (4, " ".join(near)), (5, "  " + base.replace(" ", "\n") + "\t"), (6, other + " " + base), (7, "one two"), (8, "one two"), (9, "x"), (10, "ß Ä 漢字 " * 40),
        (11, "na " * 500), (12, prose(20000, 3)), (13, " \n\t "), (14, "General PUBLIC license; CC-BY 4.0. All rights reserved."), (15, other), (15, other), (None, base), (None, None), (16, "a" * 9000), (17, "a" * 8999 + "b"),
    ]
    rows = [(i, t, i, "x", 1, "y") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, ord long, hit string, row int, runs string")
