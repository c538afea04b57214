"""Benchmark decontamination: BM25 over test items with block-max WAND.

The inverted index holds the test items.  Every passage of every document is a
query: windows of twice an item's width, each half overlapping the next, so an
item that occurs in a text lies in one passage as a whole.  The width follows
from the item's own length alone (``width_of``).  An item's scores are divided
by its score against itself, which makes one threshold fit items of any length.

Items are grouped in blocks with the largest impact of each term.  For each
passage the sum of its terms' block maxima bounds every score in the block (the
block-max WAND bound).  In a block that can reach the threshold, the pivot parts
the passage's terms: those whose maxima together stay below the threshold can't
carry an item alone, so only the posting lists of the others name candidates,
and only these are scored in full.  What is retrieved is then verified: the
item's last sentence counts as its answer, the rest as its question, and enough
word n-grams of both must occur in the passage.

Item counts, document frequencies and the average length are taken once over
all items, so a score depends on the item and the passage, not on how the index
is cut.  It goes to the tasks in shards of at most ``shard_items`` items and, a
single longer item aside, ``shard_chars`` characters: a broadcast is bounded
however large the benchmark is, and each shard reads the documents once.

Defined results: null or wordless texts and items match nothing, and null item
ids are not asked for; equal items each match; repeated document rows each give
their rows; a tie between passages goes to the first; columns other than the
named ones play no part; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key_of, small_batches, staged
from .hashing import blocks, byte_table, mixed, words_of

WORD_BYTES = bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_TABLE = byte_table(letters=WORD_BYTES)
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.55
    question: float = 0.5
    answer: float = 0.5
    gram: int = 3
    blocks: int = 32
    shard_items: int = 4096
    shard_chars: int = 2 << 20


def hashed_words(text: str) -> np.ndarray:
    return words_of([text.lower().encode("utf-8", "replace")], _TABLE, b" ")[1]


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the word n-grams, in order; of all words as one if there are fewer."""
    n = min(n, len(hashes))
    if not n:
        return hashes
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total = total * np.uint64(0x100000001B3) + hashes[k : len(hashes) - n + 1 + k]
    return mixed(total)


def parts(text: str) -> tuple[str, str]:
    """Question and answer: all but the last sentence, and the last; a single sentence is cut at two thirds."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s.strip()]
    if len(sentences) > 1:
        last = sentences[-1]
        return text[: text.rindex(last)], last
    words = text.split()
    cut = max(1, len(words) * 2 // 3)
    return " ".join(words[:cut]), " ".join(words[cut:])


def width_of(words: int) -> int:
    """Half a passage for an item of so many words: 64, 256, 1024 and so on."""
    width = 64
    while width < words:
        width *= 4
    return width


@dataclass(frozen=True)
class Corpus:
    """Counts over all items."""

    items: int
    average: float


class Lists:
    """Posting lists of a shard's items of one width, in blocks."""

    def __init__(self, width: int, rows: list[tuple[int, str, np.ndarray, np.ndarray, np.ndarray]], terms: np.ndarray, corpus: Corpus, settings: Settings):
        self.width = width
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.items = [tuple(np.unique(grams(hashed_words(x), settings.gram)) for x in parts(r[1])) for r in rows]
        self.size = max(1, -(-len(rows) // settings.blocks))
        held = []
        for i, (_, _, own, tf, df) in enumerate(rows):
            idf = np.log(1 + (corpus.items - df + 0.5) / (df + 0.5))
            w = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * tf.sum() / corpus.average))
            held.append((np.searchsorted(terms, own), np.full(len(own), i), w / w.sum()))
        term, item, impact = (np.concatenate(c) for c in zip(*held, strict=True))
        #: Row of each term of the shard here, or -1.
        mine, row = np.unique(term, return_inverse=True)
        self.row = np.full(len(terms), -1, np.int32)
        self.row[mine] = np.arange(len(mine))
        self.blocks = -(-len(rows) // self.size)
        self.block_max = np.zeros((len(mine), self.blocks), np.float32)
        np.maximum.at(self.block_max, (row, item // self.size), impact.astype(np.float32) * np.float32(1 + 1e-5))
        # A list for each block and term: postings between starts[k] and starts[k + 1].
        key = (item // self.size) * np.int64(len(mine)) + row
        order = np.lexsort((item, key))
        self.keys, at = np.unique(key[order], return_index=True)
        self.starts = np.append(at, len(key))
        self.item, self.impact = item[order].astype(np.int32), impact[order]

    def postings(self, rows: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Items, counted from the block's first, and impacts in the lists of ``rows``."""
        want = block * np.int64(len(self.block_max)) + rows
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        at = at[self.keys[at] == want]
        begin, n = self.starts[at], self.starts[at + 1] - self.starts[at]
        places = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.item[places] - block * self.size, self.impact[places]

    def above(self, rows: np.ndarray, block: int, threshold: float) -> list[tuple[int, float]]:
        """Items of the block, and their scores, that reach the threshold with the terms ``rows``."""
        most = self.block_max[rows, block]
        order = np.argsort(most, kind="stable")
        pivot = int(np.searchsorted(np.cumsum(most[order]), threshold))  # the terms before it can't reach it
        named = np.unique(self.postings(rows[order[pivot:]], block)[0])
        if not len(named):
            return []
        item, impact = self.postings(np.sort(rows), block)
        scores = np.bincount(item, impact, self.size)[named]
        return [(block * self.size + int(i), float(x)) for i, x in zip(named, scores, strict=True) if x >= threshold]


class Index:
    """BM25 impacts of a shard's items, as shares of each item's own score."""

    def __init__(self, rows: list[tuple[int, str, dict[int, int]]], corpus: Corpus, settings: Settings):
        """``rows``: item id, text, and for each of its terms the number of items that have it."""
        self.settings = settings
        by_width: dict[int, list] = {}
        for i, text, counts in rows:
            own, tf = np.unique(h := hashed_words(text), return_counts=True)
            if len(own):
                df = np.array([counts[t] for t in own.view(np.int64).tolist()])
                by_width.setdefault(width_of(len(h)), []).append((i, text, own, tf, df))
        self.terms = np.unique(np.concatenate([r[2] for rows in by_width.values() for r in rows])) if by_width else np.zeros(0, np.uint64)
        self.lists = [Lists(w, rows, self.terms, corpus, settings) for w, rows in sorted(by_width.items())]


def matches(index: Index, texts: list[str | None]) -> list[tuple[int, int, int, float, float, float]]:
    """(text, item, first word of the passage, score, question share, answer share) of verified matches."""
    out: dict[tuple[int, int], tuple] = {}
    if not index.lists:
        return []
    for first, held in blocks([(t or "").lower() for t in texts]):
        owner, hashes = words_of(held, _TABLE, b" ")
        if not len(hashes):
            continue
        term = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
        known = np.flatnonzero(index.terms[term] == hashes)
        count = np.bincount(owner, minlength=len(held))
        for lists in index.lists if len(known) else ():
            _match(lists, index.settings, first, owner, hashes, count, term, known, out)
    return [(d, i, *v) for (d, i), v in sorted(out.items())]


def _match(lists: Lists, s: Settings, first: int, owner, hashes, count, term, known, out: dict) -> None:
    width = lists.width
    begin = np.cumsum(count) - count
    halves = np.maximum(1, -(-count // width))
    half_begin = np.cumsum(halves) - halves
    row = lists.row[term[known]]
    known, row = known[row >= 0], row[row >= 0]
    if not len(known):
        return
    where = half_begin[owner[known]] + (known - begin[owner[known]]) // width
    key = np.unique(where * np.int64(len(lists.block_max)) + row)
    at, row = key // len(lists.block_max), key % len(lists.block_max)
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    bound = np.zeros((int(halves.sum()) + 1, lists.blocks), np.float32)
    bound[at[starts]] = np.add.reduceat(lists.block_max[row], starts)
    both = bound[:-1] + bound[1:] * (np.append(np.diff(np.repeat(np.arange(len(count)), halves)) == 0, False))[:, None]
    edges = np.searchsorted(at, np.arange(len(both) + 2))
    for h, b in zip(*np.nonzero(both >= s.threshold), strict=True):
        doc = int(np.searchsorted(half_begin, h, side="right") - 1)
        last = h + 1 < half_begin[doc] + halves[doc]
        passage = None
        for i, score in lists.above(np.unique(row[edges[h] : edges[h + 1 + last]]), int(b), s.threshold):
            if passage is None:
                a = begin[doc] + (h - half_begin[doc]) * width
                passage = np.unique(_all_grams(hashes[a : min(a + 2 * width, begin[doc] + count[doc])], s.gram))
            shares = [float(np.isin(g, passage).mean()) if len(g) else 1.0 for g in lists.items[i]]
            if shares[0] >= s.question and shares[1] >= s.answer:
                k = (first + doc, int(lists.ids[i]))
                if score > out.get(k, (0, -1.0))[1]:
                    out[k] = (int((h - half_begin[doc]) * width), score, *shares)


def _all_grams(passage: np.ndarray, n: int) -> np.ndarray:
    """n-grams of the passage and the shorter ones, as a short answer is one gram of all its words."""
    return np.concatenate([grams(passage, k) for k in range(1, n + 1)])


SCHEMA = "doc_id long, item_id long, word long, score double, question_overlap double, answer_overlap double, row_key long"


def _counted(items: DataFrame) -> tuple[Corpus, DataFrame]:
    """Counts over all items, and the items (i, t, n, terms) with the number of items that have each term."""
    items = staged(items.withColumn("r", F.monotonically_increasing_id()), "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = hashed_words(text)
                terms = np.unique(h).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), r, np.int64)), pa.array(terms), pa.array(np.full(len(terms), len(h), np.int64))], names=["r", "term", "words"])

    terms = staged(items.select("r", "t").mapInArrow(run, "r long, term long, words long"), "item-terms")
    n, average = terms.groupBy("r").agg(F.first("words").alias("words")).agg(F.count("*"), F.avg("words")).first()
    df = terms.groupBy("term").agg(F.count("*").alias("items"))
    own = terms.join(df, "term").groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct("term", "items"))).alias("terms"))
    return Corpus(n, average or 1.0), items.join(own, "r").select("i", "t", F.length("t").alias("n"), "terms")


def shards(items: DataFrame, settings: Settings) -> Iterator[list[tuple[int, str, dict[int, int]]]]:
    """The rows of one shard after another; the driver holds one sorted partition and the open shard."""
    held, chars = [], 0
    for row in items.orderBy("n", "i", "t").toLocalIterator():
        if held and (len(held) == settings.shard_items or chars + row["n"] > settings.shard_chars):
            yield held
            held, chars = [], 0
        held.append((row["i"], row["t"], row["terms"]))
        chars += row["n"]
    if held:
        yield held


def contaminated(
    df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    settings: Settings = Settings(), rows: bool = False,
) -> DataFrame:
    """A row for each document and test item that a passage of it repeats; with ``rows`` also the row's ``row_key_of``."""
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("row_key", row_key_of(F.col("doc_id"), F.col("text")))
    small_batches(spark)
    corpus, items = _counted(benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")))
    found: list[DataFrame] = []
    cut = shards(items, settings)
    here, following = next(cut, None), next(cut, None)
    while here is not None:
        index = spark.sparkContext.broadcast(Index(here, corpus, settings))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            for batch in batches:
                ids, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                hits = [(ids[d], *rest, keys[d]) for d, *rest in matches(index.value, batch.column(1).to_pylist())]
                if hits:
                    columns = list(zip(*hits, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        hits = docs.mapInArrow(run, SCHEMA)
        if found or following is not None:  # one shard's index at a time
            hits = staged(hits, "leaks")
            index.destroy()
        found.append(hits)
        here, following = following, next(cut, None)
    out = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], SCHEMA)
    return out if rows else out.drop("row_key")
