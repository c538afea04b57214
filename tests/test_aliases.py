"""The one-pass finder against an expression for each alias."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.operators import aliases, normalize
from newsloom.operators.aliases import AliasFinder, guarded_aliases
from newsloom.operators.normalize import base_items, with_entities
from newsloom.vocabulary import CHAINS, Lexicon, read_overlay

PIECES = [
    "agent", "ai agent", "agents", "yield", "bond yield", "defi yield", "wallet", "sol", "solana", "Sol", "融资", "新融资轮", "pump.fun", "pumpxfun", "base chain", "token", "unlock", "token unlock",
    "series", "a", "l2", "op", "mainnet", "op mainnet", " ", "-", "_", "é", "X2", "BTC", "ordinals", "上线交易", "open interest", "\n",
]
RAW = "id string, title string, content string, tags array<struct<type:string,name:string,symbol:string>>"


def rows(seed, n):
    r = random.Random(seed)
    text = lambda k: None if r.random() < 0.05 else r.choice(["", " "]).join(r.choices(PIECES, k=r.randrange(k)))
    tag = lambda: (r.choice(["token", "Token", "x"]), r.choice(["Solana", "", "New"]), r.choice(["sol", "", "new"]))
    return [(f"i{i}", text(6), text(25), [tag() for _ in range(r.randrange(3))] or None) for i in range(n)]


@pytest.mark.parametrize("lexicon", [Lexicon(), Lexicon().overlaid({"entity_aliases": {"Base": ["L2", "agent"], "Neu": ["é", " X2 "]}, "topic_aliases": {"Odd": ["a-", "unlock token"]}}), Lexicon(projects={}, tokens={}, topics={}, chains=())], ids=["default", "overlaid", "empty"])
def test_one_pass_equals_expressions(spark, lexicon):
    items = base_items(spark.createDataFrame(rows(1, 400), RAW), F.lit(None).cast("timestamp"))
    shown = ["id", F.to_json("entities").alias("e"), F.to_json("entity_sources").alias("s"), F.to_json("entity_confidence").alias("c")]
    one, many = (with_entities(items, lexicon, one_pass=x).select(shown).collect() for x in (True, False))
    assert sorted(one) == sorted(many)


def test_aliases_across_title_and_body():
    rows = [("topics", "T", "token unlock", 0, 0), ("projects", "P", "token unlock", 0, 0)]
    finder = AliasFinder(rows, [])
    assert finder.evidence("the token", "unlock now", []) == {"projects": [], "tokens": [], "chains": [], "topics": [{"name": "T", "sources": []}]}
    assert finder.evidence("the xtoken", "unlock now", [])["topics"] == [] == finder.evidence("the token", "unlocked", [])["topics"]


def test_guarded_aliases_of_the_vocabulary():
    assert guarded_aliases(Lexicon()) == ["yield", "agent"] and CHAINS and read_overlay(None, None) == {}


def test_plan_does_not_grow_with_the_vocabulary(spark):
    items = base_items(spark.createDataFrame(rows(2, 5), RAW), F.lit(None).cast("timestamp"))
    size = lambda n: len(with_entities(items, Lexicon().overlaid({"entity_aliases": {f"N{i}": [f"name{i}"] for i in range(n)}}))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(10) - size(3000)) < 200


def test_hits_of_a_lexicon_table_shuffle_no_text(spark, monkeypatch):
    docs = spark.createDataFrame(rows(3, 200), RAW)
    lexicon = Lexicon().frame(spark)
    found = normalize.alias_hits(docs, lexicon)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    monkeypatch.setattr(normalize, "PART_CHARS", 100)
    want = sorted(map(tuple, found.collect()))
    assert want and sorted(map(tuple, normalize.alias_hits(docs, lexicon).collect())) == want


def test_evidence_of_a_batch_is_held_in_slices(monkeypatch):
    """The peak of Python objects is a slice's, whatever the batch; slices make the same rows."""
    import tracemalloc

    words = [f"w{i}" for i in range(300)]
    finder = aliases.AliasFinder([("projects", w, w, i, 0) for i, w in enumerate(words)], [])
    batch = lambda n: (pa.array(["w1 w2"] * n), pa.array([" ".join(words)] * n), pa.array([[]] * n, pa.list_(pa.list_(pa.bool_()))))

    def peak(n):
        tracemalloc.start()
        made = aliases.in_slices(finder, *batch(n))
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top, made

    monkeypatch.setattr(aliases, "SLICE_ROWS", 20)
    (small, _), (large, made) = peak(40), peak(400)
    assert large < 1.5 * small
    assert made.to_pylist() == [finder.evidence("w1 w2", " ".join(words), [])] * 400 and len(aliases.in_slices(finder, *batch(0))) == 0
