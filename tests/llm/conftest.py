import random

import pytest


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Copies, near copies, shared passages and lines, blanks, nulls, a long text: (doc_id, text)."""
    rng = random.Random(3)
    rows = []
    passage = prose(rng, 30)
    line = "This very line is in many of the documents, word for word."
    base = prose(rng, 120)
    for _ in range(6):
        w = base.split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "x" + str(rng.randrange(99))
        rows.append(" ".join(w))
    rows += [base] * 4 + [base.upper()]
    for i in range(12):
        rows.append(f"{prose(rng, 25 + i)}\n{line if i % 2 else '  ' + line.upper()}\t\n{passage} {prose(rng, 15)}")
    rows += ["", None, "   \n\t", "one", "one", "One", "two words", "a b c d", "a b c d", "é\xa0ñ　ß", "\n\n\n", prose(rng, 3000, 60)]
    rows += [prose(rng, 20)] * 2 + [prose(rng, 19)] * 2
    out = list(enumerate(rows, start=5))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """With columns whose names operators use themselves."""
    rows = [(i, t, "n", 1, 2.0) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, component_id string, part long, n double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
