import random

import pytest

EDGE = [
    (1, None, "en", "s1"), (2, "", "en", "s1"), (3, "one", None, None), (4, "one two three four", "fr", "s2"), (5, "the cat sat on the mat and looked at the moon", "en", "s2"),
    (5, "the cat sat on the mat and looked at the moon", "en", "s2"), (6, "THE cat  sat on the mat\tand looked at the moon", "en", None), (None, "no key here at all", "de", "s3"), (7, "x" * 30_000, "en", "s3"),
    (8, "wort " * 6000, "de", "s3"), (9, "漢字 and ünïcode ́ tab\there\0nul", "fr", "s1"), (10, "12 34 !!", "en", "s1"), (11, "mail a.b@c.org or +49 30 1234567, 10.0.0.1 and 4111 1111 1111 1111.", "en", "s2"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows, and further columns whose names operators use themselves."""
    rows = [(i, t, lang, source, len(t or ""), "x", 1, 2.0, "y", 3) for i, t, lang, source in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, size int, n double, ids string, row int")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def corpus(spark):
    """Words at random with exact and near copies and a passage that many texts share."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(2, 5)))
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(160):
        w = [word() for _ in range(rnd.randint(1, 120))]
        if rnd.random() < 0.3:
            w += passage
        texts.append(w)
        for _ in range(rnd.choice([0, 0, 0, 1, 6])):
            v = list(w)
            for _ in range(rnd.randint(0, 1 + len(v) // 25)):
                v[rnd.randrange(len(v))] = word()
            texts.append(v)
    rnd.shuffle(texts)
    rows = [(k, " ".join(t), "en", f"s{k % 3}", 0) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
