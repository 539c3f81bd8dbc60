import random

import pytest


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text) rows with nulls, empty and blank texts, repeated rows, repeated and null ids, near copies, short
    and long texts, controls and other scripts."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 3)))
    texts = [None, "", " \n\t ", "a", "A", "a b", "b a", "!!!", "123", "日本語 текст", "x\0y", "it's <|endoftext|> </s>", "é" * 50, "z" * 4000, "no break\u0085here"]
    for _ in range(40):
        base = [word() for _ in range(rnd.choice([3, 4, 6, 8, 12, 15, 20, 25, 30, 45, 60, 90, 150]))]
        for _ in range(rnd.randint(1, 8)):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 40))):
                i = rnd.randrange(len(w))
                w[i : i + 1] = [word()] if rnd.random() < 0.7 else []
            texts.append(" ".join(w) if rnd.random() < 0.8 else "\n".join(w))
    texts.append(" ".join(word() for _ in range(20000)))
    rows = [(i if i % 40 else None, t) for i, t in enumerate(texts)]
    return rows + rows[20:25] + [(3, "again")]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The same with extra columns whose names clash with those the operators use."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, row long, n long, kept boolean, `a.b` int, rank int, hub long"
    return spark.createDataFrame([(i, t, "en" if t else None, None if n % 3 else "s", None, 0, 1, None, 2, 3, 4) for n, (i, t) in enumerate(odd_rows)], kinds)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
