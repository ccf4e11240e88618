import random

import pytest

EXTRA = "doc_id long, text string, bucket string, n_words string, blob string, marks string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): prose, copies, near copies, shared passages, short, empty and null texts."""
    rng = random.Random(3)
    docs = [" ".join(words(rng, rng.choice((3, 20, 60, 120, 300)))) for _ in range(40)]
    passage = " ".join(words(rng, 70))
    docs += [" ".join(words(rng, k)) + " " + passage + "\n" + " ".join(words(rng, 9)) for k in (0, 7, 31)]
    for k in (2, 3, 4, 5, 2):
        near = docs[k].split()
        for at in range(len(near) // 40 + 1):
            near[rng.randrange(len(near))] = f"changed{at}"
        docs.append(" ".join(near))
    docs += [docs[4], docs[4].upper(), "one", "one", "", None, "  \n\t ", "é" * 3000, "aa bb cc dd ee", "AA BB cc DD ee"]
    return [(i, t) for i, t in enumerate(docs)]


@pytest.fixture(scope="session")
def corpus_df(spark, corpus):
    """The corpus with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "b", "n", "x", "m") for i, t in corpus], EXTRA).repartition(3)


@pytest.fixture(scope="session")
def empty_df(spark):
    return spark.createDataFrame([], EXTRA)
