"""Documents with every awkward case, and an empty table."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _key int, kept string, `a.b` int"


def awkward() -> list[tuple]:
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefé") for _ in range(r.randint(1, 7)))
    para = lambda n: " ".join(word() for _ in range(n))
    shared, noise = para(60), [para(r.randint(5, 80)) for _ in range(40)]
    texts = [None, "", " \n\t", "one", "two words", "x " * 30, shared, shared, f"{noise[0]} {shared} {noise[1]}", f"{noise[2]}\n{shared[10:]}", shared.upper(), para(3000), f"{shared} {shared}", "a\x00b   c　d"]
    texts += noise + [noise[5]] * 6 + [noise[6][:-3] + "zz", f"mail me at jo.doe@site.example.com or +1 (202) 555-0101, card 4111 1111 1111 1111, ip 10.0.0.300 and 10.0.0.30 {noise[7]}"]
    return [(i * 3 % 101 if i % 13 else None, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 4}", None if t is None else len(t), "clash", 1, "k", i) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
