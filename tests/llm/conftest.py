import datetime
import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, spans int, n_lines int, label string, node int, __x int"


@pytest.fixture(scope="session")
def words():
    r = random.Random(5)
    syllables = "an the ou re tion ing ed st nd er ha wh ly ble é ß".split()
    return ["".join(r.choice(syllables) for _ in range(r.randrange(1, 5))) for _ in range(3000)]


@pytest.fixture(scope="session")
def corpus(words):
    """Texts with copies, near copies, shared passages and lines, odd characters, empty and null texts."""
    r = random.Random(6)
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts = ["\n".join(line(r.randrange(4, 30)) for _ in range(r.randrange(1, 8))) for _ in range(60)]
    texts += [texts[3], texts[3], texts[4] + " end", texts[5].replace(" ", "  ", 3)]
    passage, footer = line(60), "All of the rights are reserved 2024."
    texts += [line(20) + "\n" + passage + "\n" + line(15) for _ in range(4)]
    texts += [line(12) + "\n" + line(9) + "\n" + footer.replace("2024", str(2000 + k)) + "\n" + line(11) for k in range(12)]
    base = line(80).split(" ")
    for k in range(25):
        b = list(base)
        for _ in range(r.randrange(12)):
            b[r.randrange(len(b))] = r.choice(words)
        texts.append(" ".join(b))
    texts += [None, "", " ", "\n\n", "a", "one two", "one two", "x" * 3000, "é" * 700 + " " + "é" * 700, "\U0001f600 <|endoftext|> don't '&|%# \x00 \x85 ﬁ Å Σ", "the " * 300, "ab " * 5000]
    return texts


@pytest.fixture(scope="session")
def documents(spark, corpus):
    assert datetime.date.today()
    rows = [(i, t, "en", "s", len(t or ""), 0.5, 1, 2, "x", 3, 4) for i, t in enumerate(corpus)]
    return spark.createDataFrame([*rows, rows[2]], DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
