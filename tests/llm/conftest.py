import pytest

WORDS = ["river", "stone", "Élan", "under", "seven", "lamps", "quiet", "harbor", "train", "moss", "99", "and", "the", "of"]


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 50))
    return " ".join(out)


def corpus() -> list[tuple]:
    """Null, empty, blank, tiny, repeated, copied, near-copied and very long texts."""
    base = [prose(k, 120) for k in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, None), (21, ""), (22, " \n\t"), (23, "a"), (24, "one two three four"), (25, "!!!"), (26, "")]
    rows += [(30, base[3]), (31, base[3]), (32, base[4] + " extra tail words here"), (33, base[5].replace("moss", "mosses", 1))]
    rows += [(40, prose(77, 30000)), (41, "ab" * 400), (42, "x" * 250), (43, "é" * 200 + base[1][:160])]
    rows += [(44, base[6]), (44, base[6])]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus over several partitions, with extra columns of names that operators use themselves."""
    wide = [(i, t, "en", "src", 0.5, 1, 2, "z") for i, t in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, score double, slot int, n_words int, key string").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
