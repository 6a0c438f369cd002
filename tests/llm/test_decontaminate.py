"""Leaks that are found whatever their frequency and however many items there are."""

import random

from codelake.llm import decontaminate


def _words(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choice("bcdfghjklmn") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(n)]


def test_items_that_leak_into_a_third_of_the_documents(spark):
    r = random.Random(6)
    vocabulary, common = _words(r, 3000), _words(random.Random(7), 30)
    text = lambda n: [r.choice(common if r.random() < 0.5 else vocabulary) for _ in range(n)]
    items = [[r.choice(vocabulary) for _ in range(r.randint(25, 50))] for _ in range(20)] + [[r.choice(common) for _ in range(25)] for _ in range(5)] + [[r.choice(vocabulary) for _ in range(n)] for n in (1, 2, 5, 8, 9)]
    rows, want = [], set()
    for i in range(300):
        body = text(r.randint(20, 200))
        if i % 3 == 0:
            leak, w = 0, list(items[0])
            if i % 2:  # a word in eight is another
                w = [r.choice(vocabulary) if k % 8 == 5 else x for k, x in enumerate(w)]
        else:
            leak = i % 30
            w = list(items[leak])
        at = r.randint(0, len(body))
        body[at:at] = w
        want.add((i, leak))
        rows.append((i, " ".join(body)))
    for k, x in enumerate(items):  # an item that occurs by chance is a leak as well
        want |= {(i, k) for i, t in rows if f" {' '.join(x)} " in f" {t} "}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w) + ".") for i, w in enumerate(items)], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(df, bench).collect()} == want


def test_verbatim_leaks_do_not_depend_on_the_rank(spark):
    r = random.Random(8)
    vocabulary = _words(r, 3000)
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [text(r.randint(20, 30)) for _ in range(100)]
    df = spark.createDataFrame([(i, " ".join(text(60) + w + text(60))) for i, w in enumerate(items)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(df, bench, rank=1).collect()} == {(i, i) for i in range(100)}


def test_more_items_than_the_rank(spark):
    r = random.Random(8)
    vocabulary = _words(r, 20_000)
    items = [[r.choice(vocabulary) for _ in range(r.randint(20, 30))] for _ in range(600)]
    rows = []
    for i in range(200):  # a foreign word after every two, so that no three words of an item stand in a row
        body = [x for k, w in enumerate(items[3 * i]) for x in ([w, r.choice(vocabulary)] if k % 2 else [w])]
        around = [r.choice(vocabulary) for _ in range(120)]
        rows.append((i, " ".join([*around[:60], *body, *around[60:]])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(df, bench, rank=16).collect()}
    assert got == {(i, 3 * i) for i in range(200)}
