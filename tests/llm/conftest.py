import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, repeats, nulls and odd characters; ids out of order."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = prose(70), prose(12)
    texts = [None, "", " \n\t ", "x", "aaaa " * 200, "a" * 400, passage, "\u00a0 \x1c<|endoftext|>'S É", line + "\n" + line]
    for _ in range(40):
        texts.append("\n".join(prose(rng.randint(5, 40)) for _ in range(rng.randint(1, 5))))
    for _ in range(12):
        texts.append(prose(30) + " " + passage + "\n" + prose(20))
    base = prose(120).split()
    for _ in range(15):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
    texts += [texts[12]] * 5 + [prose(3000)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [(i, t, rng.choice(["en", "fr"]), rng.choice(["a", "b", None]), len(t or "")) for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus, with extra columns whose names clash with those that operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus, COLUMNS)
    return df.withColumns({c: F.lit("clash") for c in ("rid", "batch", "h", "id", "host", "blob", "kind", "component", "ids", "label")}).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.filter("doc_id < 0")
