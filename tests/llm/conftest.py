import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def corpus(rng):
    """Rows with copies, near copies, shared passages, nulls, empty and long texts, ties and repeated rows."""
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = prose(70), prose(20)
    texts = [prose(rng.randint(1, 160)) for _ in range(40)]
    texts += [texts[3]] * 4 + [texts[5].upper()]
    base = prose(120).split()
    for _ in range(12):
        w = base.copy()
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [prose(30) + " " + passage + "\n" + prose(10) for _ in range(5)] + [line + "\n" + prose(40) for _ in range(4)]
    texts += ["", None, " \t\n ", "one", "a b c d", "a b c d", "be " * 300, prose(4000), "x" * 3000, "é ü ß 漢字 " * 60, "\0 nul \0", (prose(8) + " ") * 40]
    rows = [(i, t, rng.choice(["en", "de", None]), "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (3, "another text of an id that is there already", "en", "s", 1), (None, texts[4], "en", "s", 1), (None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    from pyspark.sql import functions as F

    return spark.createDataFrame(corpus, DOCS).withColumns({"body": F.lit("clash"), "t": F.lit(1), "h": F.lit("x"), "component": F.lit(2), "blob": F.lit("b")}).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
