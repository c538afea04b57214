"""Wrapper inference and extraction: alignment against brute force, and cases that only the wrapper decides."""

import random

from pyspark.sql import functions as F

from newsloom.llm import wrappers


def stream(text):
    return [wrappers.token(p, 1, i) for i, p in enumerate(text.split())]


def shape(nodes):
    return wrappers.expression(nodes).replace("=#text", "").replace("=1", "")


def brute_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_matches_are_longest():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        got = wrappers._matches(a, b)
        assert all(a[i] == b[j] for i, j in got) and len(got) == brute_lcs(a, b)
        assert all(x < y and p < q for (x, p), (y, q) in zip(got, got[1:], strict=False))


def test_halved_alignments_are_longest_too(monkeypatch):
    monkeypatch.setattr(wrappers, "TABLE_CELLS", 30)
    rng = random.Random(7)
    for _ in range(150):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))] for _ in range(2))
        got = wrappers._matches(a, b)
        assert all(a[i] == b[j] for i, j in got) and len(got) == brute_lcs(a, b)
        assert all(x < y and p < q for (x, p), (y, q) in zip(got, got[1:], strict=False))


def accepts(nodes, paths):
    """Whether the union-free expression accepts the stream, by brute force over places."""

    def ends(items, at):
        places = {at}
        for n in items:
            here = set()
            for p in places:
                once = (lambda q, n=n: ends(n[wrappers.INNER], q)) if n[wrappers.INNER] else (lambda q, n=n: {q + 1} if q < len(paths) and paths[q] == n[0] else set())
                got, new = set(), once(p)
                while new - got:
                    got |= new
                    new = {e for q in new for e in once(q)} if n[wrappers.REPEATED] else set()
                here |= got | ({p} if n[wrappers.OPTIONAL] else set())
            places = here
        return places

    return len(paths) in ends(nodes, 0)


def test_wrapper_accepts_its_pages():
    rng = random.Random(2)
    for _ in range(300):
        pages = []
        for _ in range(3):
            items = " ".join("i t" for _ in range(rng.randint(1, 4)))
            pages.append(f"h {'n ' * rng.randint(0, 1)}{'p ' * rng.randint(1, 5)}{items} {'c ' * rng.randint(0, 2)}f")
        nodes = wrappers.collapsed(stream(pages[0]))
        for p in pages[1:]:
            nodes = wrappers.aligned(nodes, wrappers.collapsed(stream(p)))
        assert all(accepts(nodes, p.split()) for p in pages), (pages, shape(nodes))


def test_groups():
    assert shape(wrappers.collapsed(stream("h p q p q p q f"))) == "h (p q)+ f"
    assert shape(wrappers.collapsed(stream("h a p p b a p b f"))) == "h (a (p)+ b)+ f"
    unit = " ".join(f"u{i}" for i in range(9))
    assert shape(wrappers.collapsed(stream(f"h {unit} {unit} f"))) == f"h ({unit})+ f"
    both = wrappers.collapsed(stream("h p q p q f")), wrappers.collapsed(stream("h p q f"))
    assert shape(wrappers.aligned(*both)) == shape(wrappers.aligned(*both[::-1])) == "h (p q)+ f"
    assert shape(wrappers.aligned(stream("h p f"), stream("h p x f"))) == "h p (x)? f"


PAGE = "<body class='has-sidebar'><div class=q>Site of all</div><article><h1>Title {0}</h1><div class=x7>Read our other site too</div><p>First {0}</p><p>Second {0}</p></article><div class=z>{0} people</div></body>"


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_only_the_wrapper_knows_constants(spark):
    pages = pages_of(spark, [(i, f"https://a.example/{i}", PAGE.format(i)) for i in range(9)] + [(9, "https://other.example", PAGE.format(9))])
    made = wrappers.infer(pages)
    by_host = {r["host"]: r for r in made.collect()}
    assert "article/div.x7=#text" not in by_host["a.example"]["expression"] and "article/h1=#text" in by_host["a.example"]["expression"]
    out = {r["page_id"]: r["text"] for r in wrappers.extract(pages, made, keep=["page_id"]).collect()}
    assert out[3] == "Title 3\nFirst 3\nSecond 3" != wrappers.main_text(PAGE.format(3), None)
    assert out[9] == "Title 9\nRead our other site too\nFirst 9\nSecond 9"  # one page tells no template apart


def test_copies_of_a_page_make_no_constants(spark):
    pages = pages_of(spark, [(i, "https://a.example/", PAGE.format(i // 8)) for i in range(16)])
    out = {r["text"] for r in wrappers.extract(pages, wrappers.infer(pages), keep=[]).collect()}
    assert out == {f"Title {k}\nRead our other site too\nFirst {k}\nSecond {k}" for k in range(2)}


def test_names_do_not_empty_an_article():
    for html in ('<body class="has-sidebar"><p>one text</p></body>', '<div id="search-page"><p>one text</p></div>', '<article class="post tags-news"><p>one text</p></article>'):
        assert wrappers.main_text(html, None) == "one text"
    html = "<div id=search-page><article><p>one text</p><div class=ad>buy</div></article><div class=comments><p>" + "much said " * 50 + "</p></div></div>"
    assert wrappers.main_text(html, None) == "one text"


def test_hosts_and_folds(spark):
    urls = ["https://u:p@Host.Example:8080/a", "//host.example/x", "http://[::1]:80/", None, "no url", "mailto:x@y"]
    hosts = [r[0] for r in pages_of(spark, [(i, u, "") for i, u in enumerate(urls)]).orderBy("page_id").select(wrappers.host_column(F.col("url"))).collect()]
    assert hosts == ["host.example", "host.example", "[::1]", "", "", ""]
    rng = random.Random(3)
    html = lambda i: f"<article><h1>T {i}</h1>" + "".join(f"<p>{i} {k}</p><h2>{k}</h2>" if rng.random() < 0.5 else f"<p>{i}.{k}</p>" for k in range(rng.randint(1, 12))) + "</article><footer>f</footer>"
    pages = pages_of(spark, [(i, "https://one.example/", html(i)) for i in range(60)])
    made = wrappers.infer(pages, fan_in=4)
    assert made.count() == 1 and made.first()["pages"] == 60
    out = {r["page_id"]: r["text"] for r in wrappers.extract(pages, made, keep=["page_id"]).collect()}
    assert out == {r["page_id"]: wrappers.main_text(r["html"], None) for r in pages.collect()}


def test_odd_pages(spark):
    rows = [(0, None, None), (1, "::bad", ""), (None, "u", "<p>x"), (2, "u", "plain"), (2, "u", "plain"), (3, "u", "<div>" * 500 + "deep"), (4, "u", "<p>" + "long " * 100000 + "</p>")]
    pages = pages_of(spark, rows).withColumn("text", F.lit("old")).withColumn("_host", F.lit("old"))
    out = wrappers.extract(pages, wrappers.infer(pages), keep=["page_id", "url"]).collect()
    found = {(r["page_id"], r["text"][:6], r["n_chars"]) for r in out}
    assert len(out) == 7 and found == {(0, "", 0), (1, "", 0), (None, "x", 1), (2, "plain", 5), (3, "deep", 4), (4, "long l", 499999)}
    assert wrappers.infer(pages.limit(0)).count() == 0 and wrappers.extract(pages.limit(0), wrappers.infer(pages.limit(0))).count() == 0


def brute_collapsed(keys):
    """Keys after repeats of period 1, then 2, ... are folded, from one again after a change."""
    period = 1
    while period * 2 <= len(keys):
        out, i = [], 0
        while i < len(keys):
            j = i + period
            while keys[j : j + period] == keys[i : i + period] and j + period <= len(keys):
                j += period
            unit = keys[i : i + period]
            if j > i + period:
                out += unit if period == 1 else ["(" + " ".join(unit) + ")"]
                i = j
            else:
                out.append(keys[i])
                i += 1
        changed, keys = len(out) < len(keys), out
        period = 1 if changed and period > 1 else period + 1
    return keys


def test_collapsed_as_by_brute_force():
    rng = random.Random(8)
    for _ in range(400):
        keys = "".join(rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(0, 6))) * rng.randint(1, 3) + rng.choice(("", "ab", "abab"))
        assert [n[wrappers.KEY] for n in wrappers.collapsed(stream(" ".join(keys)))] == brute_collapsed(list(keys))


def test_pages_of_any_length_keep_their_wrapper(spark):
    """The template line leaves pages of 2500 blocks as it leaves those of 100."""

    def page(i, blocks):
        body = "".join(f"<p class=b{chr(97 + k % 7)}{chr(97 + k // 7 % 26)}{chr(97 + k // 182)}>{i} {k}</p>" for k in range(blocks))
        return f"<article><h1>T {i}</h1><div class=x7>Subscribe to our paper today for free</div>{body}</article>"

    for blocks in (100, 2500):
        pages = pages_of(spark, [(i, "https://a.example/", page(i, blocks - i)) for i in range(8)])
        out = {r["page_id"]: r["text"].split("\n") for r in wrappers.extract(pages, wrappers.infer(pages), keep=["page_id"]).collect()}
        assert out == {i: [f"T {i}", *(f"{i} {k}" for k in range(blocks - i))] for i in range(8)}


def test_rare_tokens_are_judged_by_path(spark):
    html = lambda i: f"<article><h1>T {i}</h1><div class=x7>Read our other site</div><p>{i}</p>" + (f"<div class=only{chr(97 + i // 26)}{chr(97 + i % 26)}q>once {i}</div>" if i % 2 else "") + "</article>"
    pages = pages_of(spark, [(i, "https://a.example/", html(i)) for i in range(300)])
    made = wrappers.infer(pages)
    assert "only" not in made.first()["expression"]
    out = {r["page_id"]: r["text"] for r in wrappers.extract(pages, made, keep=["page_id"]).collect()}
    assert out == {i: f"T {i}\n{i}" + (f"\nonce {i}" if i % 2 else "") for i in range(300)}
