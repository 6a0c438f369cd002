"""Operators 2, 5, 8 and 10."""

import hashlib
import re

import pytest

from codelake.llm import decontaminate, html_template, mixing, pii

PAGE = '<!DOCTYPE html><html><head><title>T</title></head><body><nav><a href="/x">Menu</a></nav><article><h1>Title &amp; more</h1><p>First <b>bold</b>\n text<p>Second{}</p></article><footer>Foot</footer></body></html>'


def test_mixing_against_its_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet')")
    assert sorted(map(tuple, mixing.op2(spark, d).collect())) == sorted(c.execute(mixing.SQL).fetchall())


def test_mixing_targets_and_limits(spark, docs, empty):
    rows = [(i, "w " * (1 + i % 7), "big") for i in range(3000)] + [(10_000 + i, "w " * 5, "small") for i in range(20)] + [(20_000 + i, "w w", None) for i in range(1500)] + [(99_999, None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    taken, target, size = {}, {}, {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        if r.size:
            s = source[r.doc_id]
            taken[s] = taken.get(s, 0) + r.taken
            target[s], size[s] = r.target, r.source_size
    total = sum(size.values())
    assert target["small"] == 3 * size["small"]  # capped: its share by weight would be more
    assert abs(sum(target.values()) - total) < 1e-6 and total - 7 <= sum(taken.values()) <= total
    for s in size:
        assert abs(taken[s] - target[s]) <= 8
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert mixing.mix(docs).count() == docs.count()
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == [*docs.columns, "copies", "finish"]
    odd = df.union(df.limit(40)).union(df.limit(1).selectExpr("cast(null as long)", "text", "source")).withColumn("copies", df.doc_id % 3)
    mixed = mixing.mixed(odd)
    assert mixed.columns == ["doc_id", "text", "source", "copies", "mix_copies", "finish"]
    taken = lambda x: sorted((r.doc_id is None, r.doc_id or 0, r[-2]) for r in x.collect())
    want = sorted((r.doc_id is None, r.doc_id or 0, r.copies) for r in mixing.mix(odd, more=(odd.copies,)).collect() if r.copies)
    assert taken(mixed) == want == taken(mixing.mixed(odd.repartition(5)))


def test_html_main_text(spark):
    furniture = '<div class="cookie-notice">Cookies</div><aside>Side</aside><form><p>Mail</p></form><div id="comments"><p>Nice</p></div><script>var a="</p>";</script><style>p{}</style><!-- x --><ul><li>one<li>two</ul>'
    rows = [
        (1, "https://a.org/1", PAGE.format(""), "Title & more\nFirst bold text\nSecond"),
        (2, "https://a.org/2", PAGE.format(furniture), "Title & more\nFirst bold text\nSecond\none\ntwo"),
        (3, None, None, ""), (4, "bad url", "", ""), (5, "https://b.org", "<p>no article<br>here<hr>after &lt;3", "no article here\nafter <3"),
        (6, "https://b.org", '<article><p title="a>b">cut off in the mid', "cut off in the mid"), (6, "https://b.org", "<nav>only</nav>", ""),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = sorted((r.page_id, r.text) for r in html_template.extract_main_text(df).collect())
    assert got == sorted((r[0], r[3]) for r in rows)
    assert html_template.extract_main_text(df.limit(0)).count() == 0


def test_html_templates_go_by_host(spark):
    box = "<section><h2>About us</h2><p>Same on every page of the site</p></section>"
    pages = [(i, f"https://t.org/{i}", f"<article><p>Text number {i}</p>{box}</article>") for i in range(12)] + [(100, "https://other.org/1", f"<article><p>Alone</p>{box}</article>")]
    pages += [(200 + i, f"https://copy.org/{i}", f"<article><p>The same page</p>{box}</article>") for i in range(12)]
    got = {r.page_id: r.text for r in html_template.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "Text number 3"
    assert got[100] == "Alone\nAbout us\nSame on every page of the site"
    assert got[205].startswith("The same page\nAbout us")  # copies of one page make no template


def test_html_templates_tell_what_nothing_else_does(spark):
    import random

    r = random.Random(1)
    para = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(12))
    menus, ends = [para() for _ in range(3)], [para() for _ in range(3)]
    main = [(f"<p>{(a := para())}</p><p>{(b := para())}</p>", f"{a}\n{b}") for _ in range(40)]
    pages = [(i, f"https://t.org/{i}", f"<body><div class=k{i}>{menus[i % 3]}</div><div class=body>{html}</div><div class=z>{ends[i % 3]}</div></body>") for i, (html, _) in enumerate(main)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for options in ({}, {"declared": False}, {"max_sent": 0}):  # lists known to all tasks, and the join by host
        got = {x.page_id: x.text for x in html_template.extract_main_text(df, **options).collect()}
        assert got == {i: text for i, (_, text) in enumerate(main)}
    without = {x.page_id: x.text for x in html_template.extract_main_text(df, min_pages=10**9).collect()}
    assert all(menus[i % 3] in t and ends[i % 3] in t for i, t in without.items())


def test_templates_change_pages_of_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    text = lambda **o: {x.page_id: x.text for x in html_template.extract_main_text(df, declared=False, **o).collect()}
    a, b = text(), text(min_pages=10**9)
    assert sum(a[i] != b[i] for i in a) > 0
    whole = {x.page_id: x.text for x in html_template.extract_main_text(df).collect()}
    assert all(t in b[i] for i, t in whole.items())  # main texts are runs of the pages' texts, and templates are not in them
    assert all(t in a[i] for i, t in whole.items())


def _main_text(html: str) -> str:
    """The test table's pages by a pattern of their own: the article's blocks."""
    import html as h

    article = re.search(r"<article>(.*?)(?:</article>|\Z)", html or "", re.S)
    blocks = re.split(r"</?(?:p|h1)>", article[1]) if article else []
    lines = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b))).split()) for b in blocks]
    return "\n".join(x for x in lines if x)


def test_html_against_brute_force_on_the_test_table(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in html_template.op5(spark, d).collect()}
    assert got == {i: ((t := _main_text(x)), len(t)) for i, x in rows.items()}


def test_class_names_of_furniture():
    page = lambda name, tag="div": html_template.Page(f"<body><{tag} class='{name}'>x</{tag}><p>y</p></body>").text()
    assert [page(x) for x in ("cookie-notice", "site-header", "ad", "related-posts", "comments2 x")] == ["y"] * 5
    assert [page(x) for x in ("article-header", "shared-lines", "notice-of-intent", "headers")] == ["x\ny"] * 4
    assert html_template.Page("<article><header class=header><h1>t</h1></header><p>y</p><div class=comments>c</div></article>").text() == "t\ny"


def test_html_and_personal_data_in_linear_time():
    import time

    judge = pii.Judge(0.95)
    n = 1_000_000
    # whatever the form of a text, a megabyte takes little more than ten times a tenth of it
    for make in (lambda k: "<a " * (k // 3) + '"', lambda k: "<div>x" * (k // 6), lambda k: "<b><hr>" * (k // 7), lambda k: "<p>" + "</i>" * (k // 4), lambda k: "<a '\"" * (k // 5)):
        times = []
        for k in (n // 10, n):
            at = time.process_time()
            page = html_template.Page(make(k))
            page.hashes(), page.text(frozenset([1]))
            times.append(time.process_time() - at)
        assert times[1] < 30 * times[0] + 1, make(30)
    for unit in ("a", "7", "a.", "1.", "7-", "key_", "+1 ", "a@", "A1", "1 ", "=a", "ab1", "(0"):
        times = []
        for k in (n // 20, n // 2):
            at = time.process_time()
            pii.spans_of(unit * (k // len(unit)), judge)
            times.append(time.process_time() - at)
        assert times[1] < 30 * times[0] + 1, (unit, times)


def test_decontamination_finds_copies_and_paraphrases(spark, docs, empty):
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("bcdfghjklmn") + r.choice("aeiou") for _ in range(r.randint(2, 4)))
    vocabulary = [word() for _ in range(3000)]
    para = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [para(r.randint(25, 70)) for _ in range(30)]
    bench = spark.createDataFrame([(i, " ".join(w) + ".") for i, w in enumerate(items)] + [(98, None), (99, "")], "item_id long, text string")
    rows, want = [], set()
    for i in range(300):
        body = para(r.randint(30, 300))
        if i % 10 == 0:
            w = list(items[i // 10])
            if i % 20 == 0:  # a paraphrase: a word in ten is another
                w = [r.choice(vocabulary) if k % 10 == 5 else x for k, x in enumerate(w)]
            at = r.randint(0, len(body))
            body[at:at] = [x.upper() if i % 30 == 0 else x + "," for x in w]
            want.add((i, i // 10))
        rows.append((i, " ".join(body)))
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(df, bench).collect()}
    assert got == want
    assert decontaminate.drop_leaks(df, bench).count() == df.count() - len(want)
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.drop_leaks(docs, bench).columns == docs.columns
    odd = docs.withColumn("doc_id", docs.doc_id * 0).withColumn("text", docs.text)  # ids all null or zero, clashing names
    leak = odd.limit(1).withColumn("text", bench.limit(1).select("text").head()[0] and __import__("pyspark").sql.functions.lit(bench.orderBy("item_id").head().text))
    kept = decontaminate.drop_leaks(odd.union(leak).union(leak), bench)
    assert sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))
    got = decontaminate.find_leaks(odd.union(leak).union(leak), bench).collect()
    assert len(got) == 2 and {r.item_id for r in got} == {0}
    with pytest.raises(ValueError):
        decontaminate.find_leaks(df, bench, max_items=3)


def test_lcs():
    masks = decontaminate.Item._masks([1, 2, 3, 2, 4])
    assert [decontaminate.lcs(masks, 5, w) for w in ([], [9], [1, 2, 3, 2, 4], [2, 4, 1], [4, 3, 2, 1], [1, 9, 3, 9, 4])] == [0, 0, 5, 2, 2, 3]


def _brute(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_pii_base_on_texts_of_marks():
    import random

    r = random.Random(3)
    for chars in ("a1.@", "1.2 ", "0.-+ 1(", "@.a-_ ", "12 -4"):
        for _ in range(400):
            text = "".join(r.choice(chars) for _ in range(r.randint(0, 60)))
            assert [(k, *s) for k, v in pii.base_spans(text).items() for s in v] == _brute(text), text


def test_pii_base_and_more(spark, docs, empty):
    got = {r.doc_id: r for r in pii.find_pii(docs.withColumn("doc_id", docs["`a.b`"])).collect()}
    rows = {r["a.b"]: r.text or "" for r in docs.collect()}
    assert got.keys() == rows.keys()
    for i, t in rows.items():
        base = _brute(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == x for k, _, _ in base) for x in pii.BASE]
        assert got[i].spans.startswith(text)
    assert pii.find_pii(empty).count() == 0
    texts = ['é token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" end', "write to jo.42 [at] site [dot] org please", "the version 10.2 of page 12, 3456 words and 2024-01-02", "nothing here", None]
    out = [r.text for r in pii.redact(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()]
    assert out == ['é token = "<secret>" end', "write to <spelt_email> please", texts[2], texts[3], None]


def test_pii_judge_on_examples_it_has_not_seen():
    judge = pii.Judge(0.95)
    for kind, (precision, recall) in judge.held_out.items():
        assert precision >= 0.92 and recall >= 0.9, (kind, precision, recall)
