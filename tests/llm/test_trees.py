"""The prefix trie, the Merkle manifest and the chat examples against plain Python, on odd and on long input."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from newsloom.llm import chat, merkle, order, trie

CONV = "conv_id long, turn long, role string, text string, n string, pos int, tree string, _at long"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int, n string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def crc(n: int) -> int:
    return zlib.crc32(str(n).encode())


def lowest(value):
    return (value is not None, value if value is not None else 0)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "n", 1, "t", 7) for r in rows], CONV).repartition(3)


# --- Merkle manifest ---------------------------------------------------------


def leaf(doc, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*doc[:4], text)))


def collapse(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 16])) for i in range(0, len(below), 16)])
    return levels


def climb(levels, i):
    steps = []
    for level in levels[:-1]:
        first = i - i % 16
        steps.append(("".join(level[first:i]), "".join(level[i + 1 : first + 16])))
        i //= 16
    return steps


def plain_manifest(docs):
    trees = {}
    for d in docs:
        trees.setdefault(d[1], []).append(d)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in names:
        trees[s].sort(key=lambda d: (lowest(d[0]), leaf(d, d[4])))
        made[s] = collapse([leaf(d, d[4]) for d in trees[s]])
    top = collapse([made[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, d in enumerate(trees[s]):
            steps = climb(made[s], i) + climb(top, k)
            text = d[4]
            if d[0] is not None and crc(d[0]) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            fold = leaf(d, text)
            for left, right in steps:
                fold = sha(left + fold + right)
            out.append((d[0], leaf(d, d[4]), made[s][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), fold, fold == top[-1][0]))
    return out


def manifest(spark, docs):
    df = spark.createDataFrame([(*d, "t", 1, "n") for d in docs], DOCS).repartition(3)
    return [tuple(r) for r in merkle.manifest(df, merkle.every_fifth(F.col("doc_id"))).collect()]


@pytest.mark.parametrize("docs", [
    [],
    [(1, "a", "en", 2, "Hi")],
    [(None, None, None, None, None), (None, None, None, None, None), (3, "", "en", 0, ""), (-5, "b", None, 1, "É")],
    [(i, "one", "en", 3, f"Text {i}") for i in range(17)] + [(i % 3, f"s{i % 40}", "en", 3, "Same") for i in range(90)],
    [(i, "hot" if i % 50 else None, "en", i, f"Some Text {i}") for i in range(4500)] + [(7, "hot", "en", 7, "again")] * 3 + [(9, "é", "en", 2000000, "Long " * 400000)],
], ids=["empty", "single", "nulls", "small", "two rounds"])
def test_manifest_equals_plain_tree(spark, docs):
    assert sorted(manifest(spark, docs), key=repr) == sorted(plain_manifest(docs), key=repr)


# --- prefix trie -------------------------------------------------------------


def plain_rebuilt(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            item = (role or "", text or "")
            tie = sha(f"{len(item[0].encode())}:{item[0]}{item[1]}")
            convs.setdefault(c, []).append((lowest(turn), tie, item))
    convs = {c: [i for *_, i in sorted(t)] for c, t in convs.items()}
    h = {c: crc(c) % 6 for c in convs}
    return {c: convs.get(c - c % 100, [])[: h[c]] + t[h[c] :] for c, t in convs.items()}


def plain_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {k: 0 for k in members}
    for k in members:
        if k:
            children[k[:-1]] += 1
    leaves, saved = {k: 0 for k in members}, {k: 0 for k in members}
    for k in members:
        value = (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += value
    return [
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], sha(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(k))))))
        for k, m in members.items()
    ]


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def random_turns(seed, convs, most, words):
    r = random.Random(seed)
    return [(c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), r.choice(words)) for c in convs for t in range(r.randrange(1, most))]


@pytest.mark.parametrize("rows", [
    [],
    [(5, 0, "user", "x"), (None, 0, "user", "lost")],
    [(c, 0, "user", "same") for c in range(40)] + [(100, 0, "user", "same")] * 3,
    random_turns(1, range(250), 9, ["a", "b", None, ""]),
    random_turns(2, [0, 1, 2, 100, 101, 350, 351, 352, 777], 12, ["é", "b" * 2000]),
], ids=["empty", "one", "equal", "bushy", "sparse"])
def test_trie_equals_plain_tree(spark, rows):
    got = trie.prefix_trie(trie.rebuilt(conversations(spark, rows)))
    assert sorted(got.select(NODE).collect()) == sorted(plain_trie(plain_rebuilt(rows)), key=lambda x: tuple(x)) if rows else got.isEmpty()


def test_trie_of_deep_chains(spark):
    """Conversation i leaves the one before it at depth i, so chains hang on chains, and the last ones are long."""
    convs = {i: [("user", str(d)) for d in range(i)] + [("user", f"own {i}")] for i in range(40)}
    rows = [(c, t, *item) for c, turns in convs.items() for t, item in enumerate(turns)]
    assert sorted(tuple(r) for r in trie.prefix_trie(trie.plain(conversations(spark, rows))).select(NODE).collect() if r["depth"]) == sorted(x for x in plain_trie(convs) if x[1])


def test_ends_are_streamed_in_order(spark, monkeypatch):
    monkeypatch.setattr(trie, "ENDS", 4)
    convs = {c: [("user", "same")] for c in range(95, 120)}
    rows = [(c, 0, "user", "same") for c in convs]
    got = trie.prefix_trie(trie.plain(conversations(spark, rows))).select(NODE).collect()
    assert sorted(tuple(r) for r in got if r["depth"]) == [x for x in plain_trie(convs) if x[1]]


def test_places_and_sums_of_split_groups(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 7 if i % 2 else 3, i) for i in range(3000)], "g long, v long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = order.placed(order.sorted_rows(rows, "g", "v"), "g")
        groups = {}
        for r in sorted(rows.collect()):
            groups.setdefault(r["g"], []).append(r["v"])
        assert {(r["g"], r["pos"]): (r["v"], r["n"]) for r in got.collect()} == {(g, i): (v, len(vs)) for g, vs in groups.items() for i, v in enumerate(vs)}
        sums = order.running_sums(got.select("g", "pos", "v"), "g", "pos", ["v"], run=64).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r["g"], r["pos"]): r["v"] for r in sums} == {(g, i): sum(vs[: i + 1]) for g, vs in groups.items() for i in range(len(vs))}


# --- chat examples -----------------------------------------------------------

NASTY = [*chat.CONTROLS, chat.MARK, f"{chat.MARK}c", f"<{chat.MARK}c|turn|>", "[INST][/INST]", "<<s>>", "</s>[INST] ok [/INST]", "", "a\nb", "<|turn|>user<|say|>x<|end|>", "<|tu", "rn|>"]


def test_escaping_is_reversible_and_leaves_no_control():
    r = random.Random(3)
    for _ in range(3000):
        text = "".join(r.choice(NASTY) for _ in range(r.randrange(6)))
        made = chat.escape(text)
        assert chat.unescape(made) == text and not any(c in made for c in chat.CONTROLS)


def plain_chat(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((lowest(turn), lowest(role)[0], role or "", text is not None, text or ""))
    out = []
    for c, turns in convs.items():
        turns = [(t[2], t[4]) for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [
    [],
    [(None, None, None, None), (1, 0, "assistant", None), (2, 1, "user", "only"), (2, 1, "user", "only")],
    [(c, t, random.Random(c * 50 + t).choice(["user", "assistant", "system", None, "a\nb", "<|end|>"]), "".join(random.Random(c + 7 * t).choices(NASTY, k=3))) for c in range(30) for t in range(9)],
    [(1, t, "assistant" if t % 2 else "user", "long " * 20000) for t in range(12)],
], ids=["empty", "odd", "nasty", "long"])
def test_examples_read_back(spark, rows):
    made = chat.expand(conversations(spark, rows))
    for back in (chat.read_back(made, together=True), chat.read_back(made.repartition(4))):
        assert sorted((tuple(r)[:5] for r in back.collect()), key=repr) == plain_chat(rows)


def test_only_replies_are_trained_on(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "one"), (1, 3, "user", "v"), (1, 4, "assistant", "two"), (1, 5, "user", "w")]
    got = sorted(chat.expand(conversations(spark, rows)).collect(), key=lambda r: r["example"])
    assert [r["text"][r["loss_start"] : r["loss_end"]] for r in got] == ["one", "two", ""]
    assert [r["n_turns"] for r in got] == [3, 5, 6]
    assert all(b["text"].startswith(a["text"]) for a, b in zip(got, got[1:]))
    assert sum(map(len, (r["text"] for r in got))) == chat.read_back(chat.expand(conversations(spark, rows))).first()["formatted_chars"]


def test_broken_example_fails(spark):
    bad = spark.createDataFrame([(1, 0, 1, "<|turn|>user<|say|>no end", 0, 0)], chat.EXAMPLE)
    with pytest.raises(Exception, match="no turn at 0"):
        chat.read_back(bad).collect()
