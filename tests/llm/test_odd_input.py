"""Odd input for the fitted operators and the search: ties, repeats, nulls, clashing labels and names, empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import common, decontaminate, langid, topk, toxicity

SF = "/root/testdata/sf0.001"


def frame(spark, rows, shape="doc_id long, text string"):
    return spark.createDataFrame(rows, shape).withColumn("score", F.lit("old")).withColumn("rank", F.lit("old")).withColumn("i", F.lit("old"))


# --- language ----------------------------------------------------------------


def test_language_held_out_and_odd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = common.fold_of(F.col("doc_id"), 3) == 1
    learned = docs.where(~held)
    texts = langid.training_texts(learned, "text", "lang")
    assert len(texts) == len(set(texts)) <= 2000 and max(len(t) for _, t in texts) == max(len(r[0].encode()) for r in learned.where("lang is not null").select("text").collect() if r[0])
    model = langid.fit(texts)
    out = langid.identify(docs.where(held & F.col("lang").isNotNull()), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.9
    again = langid.fit(langid.training_texts(learned.unionByName(learned), "text", "lang"))
    assert all(np.array_equal(a, b) for a, b in ((model.filters, again.filters), (model.out, again.out)))  # repeats teach nothing new
    empty = docs.limit(0)
    assert langid.training_texts(empty, "text", "lang") == [] and langid.identify(empty, model).count() == 0
    odd = frame(spark, [(None, "word " * 40), (1, None), (2, ""), (2, "1 2 3"), (2, "1 2 3")])
    assert [r["lang_pred"] for r in langid.identify(odd, model, keep=["doc_id"]).collect()].count("und") == 4
    tie = langid.Model(model.settings, ["aa", "bb"], model.embedding, model.filters, model.bias, model.out[:, :2] * 0, np.zeros(2, np.float32))
    assert langid.predict(tie, ["some text"]) == [("aa", 0.5)]


def test_bounded_sample(spark):
    rows = spark.range(20000).select((F.col("id") % 5000).alias("k"), F.lit("x").alias("v"))
    out = [r["k"] for r in common.bounded_sample(rows, ["k"], 100).collect()]
    assert len(out) == len(set(out)) == 100 and out == [r["k"] for r in common.bounded_sample(rows.repartition(7), ["k"], 100).collect()]
    assert common.bounded_sample(rows.limit(0), ["k"], 5).count() == 0 and common.bounded_sample(rows.where("k = 1"), ["k"], 5).count() == 1


# --- toxicity ----------------------------------------------------------------


def naive(model, text):
    """The matcher without an automaton: every entry at every place."""
    if not text:
        return 0.0, 0, 0.0
    folded, total, most = toxicity.fold(text), 0.0, 0.0
    for start in range(len(folded)):
        if start and folded[start - 1].isalpha():
            continue
        for word in {e.rstrip("*") for e in model.lexicon}:
            end = start + len(word)
            if folded[start:end] != word:
                continue
            inside = end < len(folded) and folded[end].isalpha()
            weight = model.lexicon.get(word + "*") if inside else model.lexicon.get(word, model.lexicon.get(word + "*"))
            before, after = folded[:start].split(" "), folded[end:].split(" ")
            near = [f"{word} {w}" for w in after[1:2] if after[0] == "" and w.isalpha()] + [f"{w} {word}" for w in before[-2:-1] if before[-1] == "" and w.isalpha()]
            if weight is None or any(p in model.exceptions for p in near):
                continue
            total, most = total + weight, max(most, weight)
    return total, len(folded) // 6 + 1, most


def test_toxicity_against_naive_matcher():
    rng = random.Random(3)
    model = toxicity.Model({"vile": 2.0, "vile*": 1.0, "zorg*": 1.5, "ass": 3.0, "scum": 4.0}, {"vile weed", "kick ass", f"{'x' * 60} scum"})
    auto = model.matcher()
    words = ["vile", "VILELY", "v1le", "zorg", "zorgs", "ass", "a55", "455", "$cum", "scum", "weed", "kick", "x" * 60, "room", ",", "vіle", "class"]
    for _ in range(1500):
        text = rng.choice([" ", "  ", ""]).join(rng.choice(words) for _ in range(rng.randint(0, 8)))
        assert toxicity.measure(model, auto, text) == pytest.approx(naive(model, text)), text


def test_digits_fold_beside_letters_only():
    assert toxicity.fold("room 455, 1d10t b00b 2024 h4773r 9irl a55") == "room 455, idiot boob 2024 hatter girl ass"
    model = toxicity.Model({"ass": 3.0})
    assert toxicity.measure(model, model.matcher(), "room 455")[0] == 0


def test_toxicity_clashes_and_empty(spark):
    docs = frame(spark, [(1, "zorgle vile"), (1, "zorgle vile"), (2, "calm words"), (None, "no id"), (3, None), (4, "")])
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    assert {(r["text"], r["toxic"]) for r in toxicity.labelled_sample(docs, labels).collect()} == {("zorgle vile", 1), ("calm words", 0)}
    assert toxicity.labelled_sample(docs.limit(0), labels.limit(0)).count() == 0
    model = toxicity.fit(docs.limit(0).select("text", F.lit(1).alias("toxic")))
    out = toxicity.rate(docs, model).collect()
    assert len(out) == 6 and {r["predicted"] for r in out} == {0} and toxicity.rate(docs.limit(0), model).count() == 0


def test_toxicity_learns_more_than_a_fixed_number(spark):
    rng = random.Random(5)
    bad = ["z" + "".join(rng.choice("bcdfghjklmnp") for _ in range(9)) for _ in range(2300)]
    rows = [(" ".join(bad[i : i + 40]), 1) for i in range(0, 2300, 5)] + [(" ".join(rng.choice(["calm", "words", "here"]) for _ in range(30)) + f" {i}", 0) for i in range(460)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    assert len(set(bad) & set(model.lexicon)) > 2200


# --- search ------------------------------------------------------------------


def brute(rows, k):
    held = [(i, np.floor(64 * np.array(v, float))) for i, v in rows]
    return {(q, r, i, int(s)) for q, x in held if q % 20 == 0 for r, (s, i) in enumerate(sorted(((x @ y, j) for j, y in held if j != q), key=lambda t: (-t[0], t[1]))[:k], 1)}


def test_topk_ragged_ties_and_blocks(spark):
    rng = random.Random(9)
    good = [(i, [rng.choice([-0.5, 0.25, 0.5]) for _ in range(6)]) for i in range(130)]
    odd = [(i, [9.0] * n) for i, n in ((1000, 5), (1001, 7), (1020, 1), (1040, 0))] + [(1060, [float("inf")] + [0.0] * 5), (1080, [None] + [9.0] * 5), (1100, None), (None, [9.0] * 6)]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit("old")).withColumn("id", F.lit("old"))
    for options in ({}, {"block_rows": 2, "pivots": 3, "sample_rows": 10}):
        got = {tuple(r) for r in topk.top_k(df.repartition(5), df.where("vec_id % 20 = 0"), k=7, **options).collect()}
        assert got == brute(good, 7)  # equal scores everywhere: ties go to the smaller id
    only = df.where("vec_id >= 1060")
    assert topk.top_k(only, only).count() == 0


# --- decontamination ---------------------------------------------------------


def test_decontaminate_repeats_and_ties(spark):
    rng = random.Random(11)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    item = f"{say(20)}. {say(6)}."
    items = spark.createDataFrame([(1, item), (1, item), (2, item), (None, item), (3, None), (4, "")], "item_id long, text string").withColumn("n", F.lit("old")).withColumn("r", F.lit("old"))
    docs = frame(spark, [(7, item), (7, item), (None, f"{item} {say(500)} {item}"), (8, None), (9, "x" * 20000)])
    rows = decontaminate.contaminated(docs, items).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"], r["word"]) for r in rows) == sorted([(d, i, 0) for d in (0, 7, 7) for i in (1, 2)])
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
