"""Hooks: blank input, tries, errors; batched recall against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import hooks, recall


def test_extraction_rules(spark, tmp_path):
    batches = spark.createDataFrame([(1, "good"), (2, None), (3, "  "), (4, "broken"), (5, "later"), (6, "never"), (7, "odd")], "batch_id long, prompt string")
    seen = str(tmp_path / "seen")

    def extract(prompt):
        from pathlib import Path

        if prompt == "broken":
            raise hooks.HookError("no key")
        if prompt == "never":
            raise hooks.HookError("busy", passing=True)
        if prompt == "later" and not Path(seen).exists():
            Path(seen).write_text("")
            raise hooks.HookError("busy", passing=True)
        if prompt == "odd":
            return {"not": "a list"}
        return [{"category": "topic", "canonical_name": prompt}, {"category": "topic", "canonical_name": " "}, {"canonical_name": "x"}, {"category": "token", "canonical_name": "t", "aliases": ["a"]}]

    got = {}
    for r in hooks.extracted(batches.coalesce(1), extract, wait=0.0).collect():
        got.setdefault(r["batch_id"], []).append((r["ord"], r["category"], r["canonical_name"], r["aliases"], r["error"]))
    assert got[1] == [(0, "topic", "good", [], None), (1, "token", "t", ["a"], None)] and got[5][0][2] == "later"
    assert got[4][0][-1] == "no key" and got[6][0][-1] == "busy" and "no list" in got[7][0][-1] and set(got) == {1, 4, 5, 6, 7}


def test_embedding_rules(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, " "), (4, "bcd"), (5, "ef")], "id long, text string").coalesce(1)
    made = hooks.embedded(rows, lambda texts: [[float(len(t))] for t in texts], at_once=2)
    assert {r["id"]: r["embedding"] for r in made.collect()} == {1: [1.0], 2: None, 3: None, 4: [3.0], 5: [2.0]}
    with pytest.raises(Exception, match="1 vectors for 2 texts"):
        hooks.embedded(rows, lambda texts: [[1.0]], at_once=2).collect()


@pytest.mark.parametrize("sizes", [(4096, 1024), (7, 3)])
def test_batched_recall_equals_numpy(spark, sizes):
    rng = np.random.default_rng(1)
    vectors = [[float(x) for x in rng.integers(-2, 3, 3)] for _ in range(60)] + [None, [], [1.0, 2.0]]
    pool = spark.createDataFrame([(f"i{i}", 100 - i, v) for i, v in enumerate(vectors)], "id string, ord long, embedding array<float>")
    asked = {f"u{i}": [float(x) for x in rng.integers(-2, 3, 3)] for i in range(9)} | {"none": None, "other": [2.0, 1.0]}
    got = {}
    for r in recall.top_similar_batch(spark.createDataFrame(list(asked.items()), "user_id string, vector array<float>"), pool, 8, *sizes).collect():
        got.setdefault(r["user_id"], []).append((r["rank"], r["id"], round(r["similarity"], 6)))

    def like(a, b):
        size = np.linalg.norm(a) * np.linalg.norm(b) if a and b and len(a) == len(b) else 0
        return round(float(np.dot(a, b) / size), 9) if size else 0.0

    for user, q in asked.items():
        best = sorted(((-like(q, v), 100 - i, f"i{i}") for i, v in enumerate(vectors)))[:8]
        assert sorted(got[user]) == [(n + 1, i, round(-s + 0.0, 6)) for n, (s, _, i) in enumerate(best)]
    none = pool.where(F.lit(False))
    assert recall.top_similar_batch(spark.createDataFrame([("u", [1.0])], "user_id string, vector array<float>"), none, 3).isEmpty()
