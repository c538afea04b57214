"""Every stage of the pipeline on odd input, and their decisions by brute force."""

import random

import pytest

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row_key long, _key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", None if t is None else len(t), 0.5, 1, "old") for i, t in rows], SCHEMA)


def base(rng):
    return " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 500)) for _ in range(60))


ODD = [(1, None), (None, None), (2, ""), (3, " \n"), (4, "x" * 20000), (5, "word " * 5000), (None, "short"), (6, "a\x00b")]


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_stage_on_odd_rows(spark, name, stage):
    out = stage(spark, frame(spark, ODD), SF)
    if name != "packing":
        assert out.columns == pipeline.COLUMNS
        assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(repr, ODD))
    else:
        assert sorted({(r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()}) == sorted({(i is None, i or 0) for i, _ in ODD})
    assert stage(spark, frame(spark, []), SF).count() == 0


def test_near_duplicates_by_row(spark):
    rng = random.Random(1)
    a, b, c, d = (base(rng) for _ in range(4))
    near = " ".join([*a.split(), "end"])
    rows = [(7, a), (3, near), (None, a), (9, a), (9, b), (9, c), (None, c), (None, d), (None, d + " x"), (20, b + " y"), (20, b + " y"), (30, None), (30, None)]
    kept = [(r["doc_id"], r["text"]) for r in pipeline.drop_near_duplicates(spark, frame(spark, rows), SF).collect()]
    assert kept.count((3, near)) == 1 and not any(t == a for _, t in kept)
    assert kept.count((9, b)) == kept.count((9, c)) == 1 and (20, b + " y") not in kept and (None, c) not in kept
    assert sum(i is None and t in (d, d + " x") for i, t in kept) == 1 and kept.count((30, None)) == 2 and len(kept) == 6


def test_equal_rows_stay_once(spark):
    rng = random.Random(2)
    a = base(rng)
    kept = pipeline.drop_near_duplicates(spark, frame(spark, [(5, a)] * 4 + [(6, base(rng))]), SF).collect()
    assert sorted(r["doc_id"] for r in kept) == [5, 6]


def shuffled_rows(plan):
    """Rows that the exchanges of an executed plan wrote."""
    own = plan.metrics().get("shuffleRecordsWritten")
    children = plan.children()
    return (own.get().value() if own.isDefined() else 0) + sum(shuffled_rows(children.apply(i)) for i in range(children.size()))


def test_rows_that_stay_are_not_shuffled(spark):
    docs = frame(spark, [*((i, f"text {i}") for i in range(3000)), (None, "text 0"), (None, "text 1"), (5, None)]).select(pipeline.COLUMNS)
    key = pipeline.row_key_of(pipeline.F.col("doc_id"), pipeline.F.col("text")).alias("row_key")
    gone = docs.where("doc_id % 100 = 0 or (doc_id is null and text = 'text 1') or text is null").select("doc_id", key)
    kept = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in kept}
    for k, v in kept.items():
        spark.conf.set(k, v)
    try:
        out = pipeline._without(docs, gone)
        rows = [(r["doc_id"], r["text"]) for r in out.collect()]
        assert sorted(map(repr, rows)) == sorted(map(repr, [*((i, f"text {i}") for i in range(3000) if i % 100), (None, "text 0")]))
        assert shuffled_rows(out._jdf.queryExecution().executedPlan()) < 600
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_leaks_by_row(spark):
    rng = random.Random(3)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(1, f"{base(rng)} {item} {base(rng)}"), (1, base(rng)), (None, item), (None, base(rng)), (2, None)]
    kept = [(r["doc_id"], r["text"]) for r in pipeline.drop_leaks(spark, frame(spark, rows), SF).collect()]
    assert sorted(map(repr, kept)) == sorted(map(repr, [rows[1], rows[3], rows[4]]))


def test_masking(spark):
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pipeline.mask_personal_data(spark, frame(spark, [(1, "to a@b.cd now"), (2, "none"), (3, None)]), SF).collect()}
    assert out == {1: ("to [EMAIL] now", 14), 2: ("none", 4), 3: (None, None)}


def test_run_leaves_no_stage_behind(spark):
    from newsloom.llm import common

    before = set(common._STAGED)
    pieces = pipeline.run(spark, SF)
    assert pieces.count() > 100
    left = [p for p in common._STAGED if p not in before]
    assert left and all("packed" in p for p in left)
