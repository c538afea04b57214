"""Operators against brute force on small fixtures, and their defined results on odd input."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.llm import decontaminate, hashing, jaccard, langid, licences, packing, pii, queries, tokens, topk, toxicity, warc, wrappers

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " \n\t ", "one two", "a\x00b 5", "word " * 3000, "x" * 20000]


def docs(spark, texts, extra=True):
    """Documents with extra columns whose names clash with outputs."""
    rows = [(i, t, "en", 0.5, "old") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, spans string")
    return df if extra else df.select("doc_id", "text")


# --- personal data -----------------------------------------------------------


def brute_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans():
    rng = random.Random(2)
    parts = ["a.b@c.de", "@", "1.2.3.4", "300.1.1.1", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 555-1234", "+", ".", " ", "-", "12", "x@y", "x@y.z@q.w", "١٢", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(text) == brute_base(text), text


def test_pii_skip_chain(spark):
    card = "4111111111111111"
    text = f"pay {card} 5500005555555559 now"
    (spans,) = pii.annotate([text])
    assert [s[:1] + s[3:] for s in spans] == [("card", False), ("card", False)] and text[spans[0][1] : spans[0][2]] == card
    out = pii.digest(pii.find_pii(docs(spark, [*TEXTS, text, text, "a@b.cd"]), keep=["doc_id"])).orderBy("doc_id").collect()
    assert [r["n_email"] for r in out] == [0] * 9 + [1] and out[0]["spans"] == "" and out[9]["spans"] == "email:0:6"
    masked = pii.redact(docs(spark, ["hi a@b.cd!", None])).orderBy("doc_id").collect()
    assert masked[0]["redacted"] == "hi [EMAIL]!" and masked[1]["redacted"] is None
    assert pii.find_pii(docs(spark, [])).count() == 0


# --- models ------------------------------------------------------------------


def test_language(spark):
    rng, samples = random.Random(3), []
    speech = {"aa": ["the", "and", "thing"], "bb": ["der", "und", "nicht"]}
    say = lambda lang, n: " ".join(rng.choice(speech[lang]) for _ in range(n))
    for _ in range(120):
        samples += [(lang, say(lang, 12).encode()) for lang in speech]
    model = langid.fit(samples)
    texts = [say("aa", 200), say("bb", 200)]
    assert [x for x, _ in langid.predict(model, texts)] == ["aa", "bb"]
    out = langid.identify(docs(spark, [*TEXTS, "123 456"]), model, keep=["doc_id"]).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in out][:3] == ["und"] * 3 and out[-1]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in out)
    assert langid.predict(langid.fit([]), ["abc"]) == [("und", 0.0)]


def test_windows_cover_whole_texts():
    for n in (1, 5, 96, 97, 188, 1000):
        data = bytes(range(1, 256)) * 4
        w = langid._windows(data[:n], 96, 5)
        seen = {(w[i, j : j + 5].tobytes()) for i in range(len(w)) for j in range(92)}
        assert all(data[i : i + 5] in seen for i in range(max(0, n - 4)))


def test_toxicity(spark):
    model = toxicity.Model(dict(toxicity.FIXED_LEXICON), set(toxicity.FIXED_EXCEPTIONS))
    auto = model.matcher()
    hit = lambda t: toxicity.measure(model, auto, t)[0] > 0
    assert all(map(hit, ["you idiot", "IDI0T!", "you 1d1ot", "іdiot", "a $cum", "moron$$$"]))
    assert not any(map(hit, ["idiotic", "put it in the trash can", "a clown fish", "", None, "oxymoron"]))
    out = toxicity.rate(docs(spark, [*TEXTS, "idiot moron scum"]), model, keep=["doc_id"]).orderBy("doc_id").collect()
    assert out[-1]["predicted"] == 1 and not any(r["predicted"] for r in out[:3]) and all(0 <= r["score"] <= 1 for r in out)
    none = spark.createDataFrame([], "text string, toxic int")
    assert toxicity.fit(none).lexicon == toxicity.FIXED_LEXICON


def test_licences(spark):
    texts = ["a\nReleased under the MIT License.\nb", "you need a driving license to rent", "Licensed under CC BY-NC 4.0.", *TEXTS]
    out = {(r["doc_id"], r["paragraph"], r["family"], r["confirmed"]) for r in licences.scan(docs(spark, texts)).collect()}
    assert out == {(0, 1, "MIT", True), (2, 0, "CC-BY-NC", True)}
    m = licences.fit()
    assert m.bias[0] == max(m.bias)


def test_toxicity_sample_keeps_both_classes(spark):
    few = toxicity.Settings(train_docs=40)
    rows = [(i % 40, f"{'zorgle vile' if i % 40 < 8 else 'calm'} text {i}") for i in range(400)] + [(20, "calm copy")] * 300
    held = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 8)) for i in range(40)], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(held, labels, few)
    found = sample.collect()
    assert len(found) == 40 and {r["toxic"] for r in found} == {0, 1} and sum(r["text"] == "calm copy" for r in found) <= 1
    # More rows than the bound, given to the fit directly: the toxic ones still shape the curve.
    every = held.join(labels, "doc_id").select("text", "toxic")
    model = toxicity.fit(every, few)
    assert toxicity.score(model, toxicity.measure(model, model.matcher(), "zorgle vile text")) > 0.5


def brute_licences(texts):
    """(doc, paragraph, family) of every paragraph, none skipped."""
    out, m = set(), licences.fit()
    at = dict(zip(m.vocabulary, m.weights, strict=True))
    for d, text in enumerate(texts):
        for i, line in enumerate(re.sub(licences.WRAP_PATTERN, " ", text or "").split("\n")):
            z = np.array(m.bias)
            for g in set(licences.ngrams(line)) & at.keys():
                z = z + np.array(at[g])
            if z.argmax():
                out.add((d, i, m.families[int(z.argmax())]))
    return out


def test_wrapped_lines_alike_in_spark_and_sql(spark):
    texts = ["a\nb\nc\nd", "Released under\nthe\nm\ni\nMIT License.\nMIT License\na\nb\n(c) all rights reserved", "x.\ny\nz\n\nq\n(r", *TEXTS]
    made = docs(spark, texts, extra=False)
    got = sorted(tuple(r) for r in licences.scan(made).collect())
    documents = made.toPandas()  # noqa: F841
    assert got == sorted(duckdb.sql(licences.scan_sql()).fetchall()) and got
    joined = made.select(F.regexp_replace("text", licences.WRAP_PATTERN, " ").alias("t"), "doc_id").orderBy("doc_id").collect()
    assert joined[0]["t"] == "a b c d"
    twice = f"regexp_replace(regexp_replace(text, '{licences.WRAP_GROUPS}', '\\1 \\2', 'g'), '{licences.WRAP_GROUPS}', '\\1 \\2', 'g')"
    assert [r["t"] for r in joined] == [r[0] for r in duckdb.sql(f"SELECT {twice} FROM documents ORDER BY doc_id").fetchall()]


def test_licences_scores_every_paragraph(spark):
    wrapped = "Permission is hereby granted, free of charge, to any person obtaining a copy of this\nsoftware and associated documentation files, to deal in the Software without\nrestriction"
    prose = "we went mit der Familie in die Stadt\nthe software is free to use for any person in the public\nThe Apache web server runs on GNU systems"
    texts = ["x\nCC BY-SA 4.0", "Distributed under the GNU GPL v3", wrapped, prose, "Released under the MIT License.", "GPLv3\nApache 2.0\nBSD-3-Clause", "All rights reserved.", "MIT License " * 500, *TEXTS]
    held = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60)
    texts += [r["text"] for r in held.select("text").collect()] + ["Released under the MIT License."]
    rng, m = random.Random(8), licences.fit()
    for _ in range(300):  # words of the vocabulary out of context
        texts.append(" ".join(rng.choice(rng.choice(m.vocabulary).split()) for _ in range(rng.randint(1, 9))))
    out = {(r["doc_id"], r["paragraph"], r["family"]) for r in licences.scan(docs(spark, texts)).collect()}
    assert {(0, 1, "CC-BY-SA"), (1, 0, "GPL-3.0"), (2, 0, "MIT"), (4, 0, "MIT"), (5, 0, "GPL-3.0"), (5, 1, "Apache-2.0"), (5, 2, "BSD"), (6, 0, "proprietary"), (7, 0, "MIT")} <= out
    assert not any(d == 3 for d, _, _ in out) and out == brute_licences(texts)
    assert licences.scan(docs(spark, [])).count() == 0


def test_licence_signals():
    """Without a signal word unknown wins, whatever else of the vocabulary a paragraph holds."""
    m = licences.fit()
    rest = [w for g, w in zip(m.vocabulary, m.weights, strict=True) if set(g.split()).isdisjoint(m.signals)]
    assert m.signals and all(m.bias[k] < m.bias[0] and all(w[k] <= w[0] for w in rest) for k in range(1, len(m.families)))
    right = [f == m.families[int(np.argmax(np.array(m.bias) + sum(np.array(w) for g, w in zip(m.vocabulary, m.weights, strict=True) if g in set(licences.ngrams(t)))))] for f, t in licences.HELD_OUT]
    assert np.mean(right) > 0.85 and not {t for _, t in licences.HELD_OUT} & {t for x in licences.TEMPLATES.values() for t in x}


# --- pages -------------------------------------------------------------------

PAGE = (
    "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=x>Menu</a></li></ul></nav><div class='cookie-notice'>We use cookies</div>"
    "<article><h1>Title {0}</h1><p>First &amp; {0}<p>Second\n line &eacute;</p><div class=ad>Buy</div></article><div id=comments><p>Nice {0}</p></div><footer>&copy; us</footer></body></html>"
)


def test_wrappers(spark):
    assert wrappers.main_text(PAGE.format(1), None) == "Title 1\nFirst & 1\nSecond line é"
    rows = [(i, f"http://h.example/{i}", PAGE.format(i)) for i in range(8)] + [(8, None, None), (9, "::bad", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old"))
    out = wrappers.extract(pages, wrappers.infer(pages), keep=["page_id", "url"]).orderBy("page_id").collect()
    assert [r["text"] for r in out] == [f"Title {i}\nFirst & {i}\nSecond line é" for i in range(8)] + ["", ""]
    assert wrappers.infer(pages.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    big = "x" * 300
    rows = [(3, "http://a/ü", big), (1, None, big), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", big), (1, "again", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(pages.coalesce(1), path)
    out = warc.read_archives(spark, path).collect()
    got = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in out)
    assert got == Counter([(3, "revisit", 1, 300), (None, "revisit", 1, 300), (2, "response", None, 5), (4, "response", None, 5), (5, "response", None, 0), (1, "response", None, 300), (1, "response", None, 300)])
    records = [warc._member(warc.record(i, "u", b"payload %d" % i * 9, __import__("hashlib").sha256(b"payload %d" % i * 9).hexdigest(), None, "d")) for i in range(4)]
    broken = records[0] + records[1][:-9] + b"junk" + records[2] + b"trail" + warc.record(9, None, b"bare", __import__("hashlib").sha256(b"bare").hexdigest(), None, "d") + records[3][:20]
    parts = list(warc.salvage(broken))
    # The cut member is a gap whose record is recovered; junk and the cut last member are gaps.
    assert [p[2] is None for p in parts] == [False, True, False, False, True, False, True]
    assert [p[2]["fields"]["warc-record-id"] for p in parts if p[2]] == ["<urn:page:0>", "<urn:page:1>", "<urn:page:2>", "<urn:page:9>"]
    assert sum(p[1] for p in parts) == len(broken) and list(warc.salvage(b"")) == []


# --- joins and search --------------------------------------------------------


def brute_components(texts, n=5):
    words = [re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    sets = [{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set() for w in words]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


def test_jaccard(spark):
    rng, texts = random.Random(4), list(TEXTS)
    base = [f"w{rng.randint(0, 400)}" for _ in range(60)]
    for _ in range(45):  # near copies at all distances, in chains
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 50)}"
        texts.append(" ".join(w).upper() if rng.random() < 0.5 else " ".join(w))
        if rng.random() < 0.3:
            base = w
    texts += ["one two", "a b c d", "A b C d", " ".join(f"z{i}" for i in range(30))] * 2
    got = sorted(tuple(r) for r in jaccard.cluster(docs(spark, texts)).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(texts)
    assert jaccard.cluster(docs(spark, [])).count() == 0
    nulls = spark.createDataFrame([(None, "p q r s t u"), (7, "p q r s t u"), (None, None)], "doc_id long, text string")
    assert Counter(tuple(r) for r in jaccard.cluster(nulls).collect()) == Counter([(None, 2, 7), (7, 2, 7), (None, 0, None)])


def thue_morse(letters):
    word = "a"
    while len(word) < letters:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_word_hashes_differ_as_words_do(spark):
    rng = random.Random(12)
    table = hashing.byte_table(separators=jaccard.SEPARATORS)
    made = [*thue_morse(1024), *thue_morse(4096), *("".join(rng.choice("aAbé") for _ in range(rng.randint(1, 9))) for _ in range(3000)), "a" * 70000, "a" * 70001]
    fold = str.maketrans("AB", "ab")
    owner, found = hashing.words_of([w.encode() for w in made], table, b"\n")
    assert owner.tolist() == list(range(len(made)))
    by_hash = dict(zip(found.tolist(), made, strict=True))
    assert all(by_hash[h].translate(fold) == w.translate(fold) for h, w in zip(found.tolist(), made, strict=True))
    assert len(by_hash) == len({w.translate(fold) for w in made})
    # The same word has the same hash wherever it stands.
    _, again = hashing.words_of([b"x  " + made[0].encode() + b" y"], table, b"\n")
    assert again[1] == found[0]
    got = {tuple(r) for r in jaccard.cluster(docs(spark, thue_morse(1024))).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == {(0, 1, 0), (1, 1, 1)}


def test_jaccard_cut_groups(spark):
    """Groups beyond a block, two clusters that share their n-grams, and links only across salts."""
    rng, texts = random.Random(14), []
    for seed in range(2):
        base = [f"s{i}" for i in range(12)] + [f"b{seed}x{i}" for i in range(30)]
        for k in range(60):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 30)}"
            texts.append(" ".join([*w, *(f"t{seed}x{j}" for j in range(k % 9))]))
    want = brute_components(texts)
    for block in (4, 16):
        got = sorted(tuple(r) for r in jaccard.cluster(docs(spark, texts), block=block).select("doc_id", "n_shingles", "component_id").collect())
        assert got == want


def test_first_partners_misses_none():
    """Rounds over one group, from cursor to cursor, give every pair that brute force links."""
    rng = random.Random(15)
    sets = []
    for _ in range(80):
        w = [f"a{i}" for i in range(120)]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(120)] = f"q{rng.randint(0, 20)}"
        sets.append(" ".join(w[: rng.randint(105, 120)]))
    sets = sorted(set(sets))
    ((_, owners, hashes),) = jaccard.ngram_sets(sets, 5)
    size, key = jaccard.keys_of(owners, hashes, len(sets))
    order = np.lexsort((key, size))
    maps = jaccard.bitmaps_of(owners, hashes, size)
    held = [set(hashes[owners == i].tolist()) for i in range(len(sets))]
    want = {(int(key[a]), int(key[b])) for x, a in enumerate(order) for b in order[:x] if 100 * (n := len(held[a] & held[b])) >= 75 * (len(held[a]) + len(held[b]) - n)}
    for most, each, few in ((1, 1, False), (3, 1, False), (3, 4, False), (3, 4, True)):
        got, start, label = set(), {int(k): (0, -(1 << 63)) for k in key}, key % 7
        for step in range(500):
            columns = {"key": key[order], "size": size[order], "label": label[order], "bitmap": [maps[i] for i in order]}
            columns["from_size"], columns["from_key"] = (np.array([start.get(int(k), (jaccard.NOWHERE, 0))[c] for k in key[order]]) for c in (0, 1))
            found = list(jaccard.first_partners(pa.table(columns), 75, most, each, jaccard.Spent(1 + step) if few else None))
            assert all(len(v) <= most and max(map(len, v.values()), default=0) <= each for _, v, _ in found)
            if few:
                handed = Counter(frozenset((k % 7, to)) for k, v, _ in found for to, places in v.items() for _ in places)
                assert max(handed.values()) <= 1 + step
            got |= {(k, p) for k, v, _ in found for places in v.values() for _, p in places}
            start = {k: r for k, _, r in found if r[0] < jaccard.NOWHERE}
            if not start:
                break
        assert not start and {(a, b) for a, b in want if a % 7 != b % 7} <= got and len(want) > 100


def test_keys_that_clash_are_told_apart():
    ((_, owners, hashes),) = jaccard.ngram_sets(["a b c d e f", "p q r s t u v", "a b c d e f"], 5)
    size, key = jaccard.keys_of(owners, hashes, 3)
    again = jaccard.keys_of(owners, hashes, 3, np.array([key[0]]))[1]
    assert key[0] == key[2] != key[1] and again[0] == again[2] == jaccard.checks_of(owners, hashes, size)[0] != key[0] and again[1] == key[1]


def test_tree_walk():
    rng = np.random.default_rng(5)
    for _ in range(60):
        pool = np.sort(rng.choice(2**40, 60, replace=False)).astype(np.uint64)
        probe = np.sort(rng.choice(pool, 40, replace=False))
        seqs = [np.sort(rng.choice(pool, rng.integers(20, 55), replace=False)) for _ in range(12)] + [probe.copy()]
        want = [i for i, s in enumerate(seqs) if 100 * (x := len(np.intersect1d(s, probe))) >= 75 * (len(s) + len(probe) - x)]
        assert sorted(jaccard.walk(probe, seqs, 75)) == want


def test_decontaminate(spark):
    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choice(["th", "er", "in", "an", "re"]) for _ in range(3)) for _ in range(n))
    bench = [f"{say(20)}. {say(8)}." for _ in range(30)]
    texts = [say(300) for _ in range(20)] + [f"{say(150)} {bench[k].upper()} {say(90)}" for k in range(10)] + TEXTS + [bench[3].split(".")[0]]
    items = spark.createDataFrame([*enumerate(bench), (99, None), (98, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(spark, texts), items).collect()}
    norm = lambda t: " ".join(re.findall("[a-z0-9]+", (t or "").lower()))
    assert got == {(i, j) for i, t in enumerate(texts) for j, b in enumerate(bench) if norm(b) in norm(t)}
    assert decontaminate.contaminated(docs(spark, texts), items.limit(0)).count() == 0


def test_decontaminate_long_items(spark):
    """Items beyond a shard's size are indexed as a whole, and apart from the short ones."""
    rng = random.Random(16)
    say = lambda n: " ".join("".join(rng.choice(["th", "er", "in", "an", "re"]) for _ in range(4)) for _ in range(n))
    bench = [f"{say(20)}. {say(8)}." for _ in range(12)] + [f"{say(4000)}. {say(12)}." for _ in range(2)]
    texts = [f"{say(50)} {b} {say(50)}" for b in bench] + [bench[12][:20000], say(6000)]
    items = spark.createDataFrame([*enumerate(bench)], "item_id long, text string")
    settings = decontaminate.Settings(shard_items=5, shard_chars=30000)
    held = list(decontaminate.shards(decontaminate._counted(items.toDF("i", "t"))[1], settings))
    assert sorted(r[0] for rows in held for r in rows) == list(range(14)) and [len(rows) for rows in held] == [5, 5, 2, 1, 1]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(spark, texts), items, settings=settings).collect()}
    assert got == {(i, i) for i in range(14)}  # a part without the item's end, its answer, is no match


def brute_bm25(bench, texts, s):
    """Every passage against every item by exhaustive BM25, then the n-gram check."""
    words = lambda t: re.findall("[a-z0-9]+", t.lower())
    items = [words(b) for b in bench]
    df = Counter(w for x in items for w in set(x))
    average, out = sum(map(len, items)) / len(items), {}
    idf = lambda w: np.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5))
    weight = lambda x, w: idf(w) * (f := x.count(w)) * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(x) / average))
    cuts = lambda x: {tuple(x[i : i + (m := min(s.gram, len(x)))]) for i in range(len(x) - min(s.gram, len(x)) + 1)} if x else set()
    for d, text in enumerate(texts):
        for i, x in enumerate(items):
            own, width = sum(weight(x, w) for w in set(x)), decontaminate.width_of(len(x))
            for a in range(0, max(1, len(words(text or ""))), width):
                passage = words(text or "")[a : a + 2 * width]
                score = sum(weight(x, w) for w in set(x) & set(passage)) / own
                all_cuts = {tuple(passage[k : k + m]) for m in range(1, s.gram + 1) for k in range(len(passage) - m + 1)}
                shares = [len(g & all_cuts) / len(g) if (g := cuts(words(t))) else 1.0 for t in decontaminate.parts(bench[i])]
                if score >= s.threshold and shares[0] >= s.question and shares[1] >= s.answer and score > out.get((d, i), 0):
                    out[d, i] = score
    return out


def test_decontaminate_against_exhaustive_bm25(spark):
    """Equal matches and scores, however the index is cut."""
    rng = random.Random(26)
    say = lambda n: " ".join("".join(rng.choice(["th", "er", "in", "an"]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    bench = [f"{say(rng.randint(5, 90))}. {say(6)}." for _ in range(25)] + ["yes"]
    torn = lambda b: " ".join(w for w in b.split() if rng.random() > 0.15)
    texts = [f"{say(rng.randint(0, 200))} {torn(rng.choice(bench))} {say(rng.randint(0, 100))}" for _ in range(40)] + [bench[0]] * 2 + [None, "", "?!", "yes"]
    items = spark.createDataFrame([*enumerate(bench)], "item_id long, text string")
    want = brute_bm25(bench, texts, decontaminate.Settings())
    assert 20 < len(want)
    for settings in (decontaminate.Settings(), decontaminate.Settings(shard_items=4, blocks=2), decontaminate.Settings(shard_chars=300, blocks=1)):
        rows = decontaminate.contaminated(docs(spark, texts), items, settings=settings).collect()
        assert {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in rows} == {k: round(float(v), 9) for k, v in want.items()} and len(rows) == len(want)


def test_topk(spark):
    rng = random.Random(7)
    rows = [(i, [float(rng.randint(-3, 3)) / 4 for _ in range(4)]) for i in range(150)] + [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (None, [1.0] * 4), (203, []), (220, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = defaultdict(list)
    for r in topk.top_k(df, df.where("vec_id % 20 = 0"), k=5, pivots=4, sample_rows=32).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    valid = {i: np.floor(64 * np.array(v)) for i, v in rows[:150]}
    for q in range(0, 150, 20):
        best = sorted(((-int(valid[q] @ x), i) for i, x in valid.items() if i != q))[:5]
        assert got[q] == [(i, -s) for s, i in best]
    assert len(got) == 8 and topk.top_k(df.limit(0), df.limit(0)).count() == 0


# --- packing -----------------------------------------------------------------


def test_encoder():
    e, rng = tokens.Encoder(), random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice("ab'sSTl 0²½ª\x85\xa0\x1cÉé×!?<|>\nİӜ語") for _ in range(rng.randint(0, 12)))
        assert np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() == e.encode(text)


def check_pieces(rows, texts, window=4096):
    e = tokens.Encoder()
    ids = {i: e.encode(t or "") + (2).to_bytes(4, "little") for i, t in enumerate(texts)}
    got = defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert zlib.crc32(part) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]]) // 4
        got[r["doc_id"]].append((r["start"], r["length"]))
    for i, x in ids.items():
        end = 0
        for start, length in sorted(got[i]):
            assert start == end
            end += length
        assert end == len(x) // 4
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    lengths = []
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= window
        lengths.append(end)
    total = sum(lengths)
    padding = sum(window - n for n in lengths if n & (n - 1))
    return padding / max(total, 1)


def test_packing(spark):
    rng = random.Random(9)
    texts = [*TEXTS, *[" ".join(rng.choice(["thorn", "blest", "of", "ing"]) for _ in range(rng.randint(1, 4000))) for _ in range(120)]]
    rows = packing.pack(docs(spark, texts).repartition(5), open_windows=4, fan_in=2).collect()
    assert check_pieces(rows, texts) < 0.02
    assert packing.pack(docs(spark, [])).count() == 0


def test_queries_have_unique_names():
    assert sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op5_topk", "op7_warc", "op8_licences", "op9_jaccard"])
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, (tuple(r[names.index(c)] for c in columns) for r in found.fetchall())))


def test_pipeline(spark):
    import corpus_pipeline

    kept = spark.read.parquet(f"{SF}/documents.parquet").select(corpus_pipeline.COLUMNS)
    before = kept.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == corpus_pipeline.COLUMNS
    rows = kept.collect()
    assert 0.7 * before < len(rows) < before
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in rows}
