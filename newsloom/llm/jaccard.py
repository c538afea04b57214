"""Exact Jaccard join of word n-gram sets with prefix trees.

Two documents link when their n-gram sets have a Jaccard similarity of at least
``least`` percent.  The steps, each over all documents:

1. Each text's set is reduced to its size, a key (equal sets, equal keys) and a
   parity bitmap.  Documents with equal sets fall together here, so a hot group
   of copies is one set from now on.  The most frequent n-grams are counted.
2. All sets are ordered by one global order: n-grams by hash, then the counted
   frequent ones by rising count.  A pair that links shares an n-gram within
   the first |x| - ceil(t |x|) + 1 of both (prefix filter), so each set is filed
   under those only, in blocks of packed arrays instead of rows.
3. Sets filed under the same n-gram form a group; groups with the same members
   count once, and a group is cut where sizes differ too much to link.
4. Within a group, the parity bitmaps bound the symmetric difference from below
   and drop pairs that can't link.  Each member is paired with the first few
   smaller ones, over all its groups, that may link to it and are not yet known
   to be in its component; so a round's pairs grow with the sets, not with the
   groups' squares.  One partner of each component will do, as a link to it joins
   the rest; where it does not link, later rounds take ever more.  The first two rounds take small bitmaps; later ones, of the few
   sets still in question, wide ones that pass hardly any pair that does not link.
5. These pairs are put in prefix trees, one for each leader and up to about
   ``CHUNK`` partners: sequences in global order, shared beginnings stored once.
   The leader walks the tree; overlap with a shared beginning is counted once
   for all below it, and a subtree is left as soon as the overlap so far plus
   the remaining length can't reach the bound.  The count at a leaf is exact.
6. Star steps over the links label the sets, each label within one component.
   Rounds go on, from where each member first left a candidate out, over the
   groups that still have several labels, until no member has a candidate left:
   every pair of a group is then linked, refuted, or within one component.  Stars
   until nothing changes then give the components.

An n-gram with many sets is filed by salt, each n-gram with its own, so groups stay at about
``2 * block`` members; pairs across the salts of one n-gram come after the first
round, and only where labels differ: sets of its commonest label meet those of
other labels, not each other.

Broadcasts: the ``FREQUENT`` most frequent n-grams, and the wanted ids only if
they are at most ``WANTED_IDS``; beyond it they are joined.

n-grams are compared by 64-bit hashes, whole sets by 128 bits.  Defined results: texts that are null or
without words have size 0 and link with nothing; equal documents link; each
input row gives a row, repeated or not; a null id takes part and its component
is named by the smallest id that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key_of, small_batches, staged, unstage
from .hashing import blocks, byte_table, mixed, words_of

SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
_TABLE = byte_table(separators=SEPARATORS)
_NONE = -(1 << 63)  # stands for a null id inside

FREQUENT = 1 << 17
LEAST_BITS, MOST_BITS = 1 << 8, 1 << 16
WIDE = 8
BLOCK = 512
FIRST_PARTNERS, PARTNERS = 4, 4
NARROW_ROUNDS, MORE = 2, 8
OF_LABELS = 4
FIRST_STEPS, ROUND_STEPS = 4, 2
NOWHERE = 1 << 62  # a size beyond all
SPREAD = 4
CHUNK = 512
MOST_CLASHES = 10_000
WANTED_IDS = 1 << 19
FILED_PER_BLOCK = 400_000


# --- sets of texts -----------------------------------------------------------


def ngram_sets(texts: list[str | None], n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, number of each n-gram's text counted from there, n-gram hash): distinct and sorted."""
    factors = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) | 1) for k in range(n)]
    for first, held in blocks([t or "" for t in texts]):
        owner, h = words_of(held, _TABLE, b"\n")
        if not len(h):
            yield first, np.zeros(0, np.int64), np.zeros(0, np.uint64)
            continue
        count = np.bincount(owner, minlength=len(held))
        begin = np.cumsum(count) - count
        last = max(0, len(h) - n + 1)
        total = np.zeros(last, np.uint64)
        for k in range(n):
            total += h[k : last + k] * factors[k]
        inside = owner[:last] == owner[n - 1 :]
        owners, hashes = owner[:last][inside], mixed(total[inside])
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            whole = [sum((int(h[begin[i] + k]) * int(factors[k]) for k in range(count[i])), int(count[i])) & (2**64 - 1) for i in short]
            owners, hashes = np.append(owners, short), np.append(hashes, mixed(np.array(whole, np.uint64)))
        order = np.lexsort((hashes, owners))
        owners, hashes = owners[order], hashes[order]
        new = np.ones(len(owners), bool)
        new[1:] = (owners[1:] != owners[:-1]) | (hashes[1:] != hashes[:-1])
        yield first, owners[new], hashes[new]


def _key(owners: np.ndarray, hashes: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    sums = np.zeros(len(size), np.uint64)
    if len(owners):
        start = np.flatnonzero(np.diff(owners, prepend=-1))
        sums[owners[start]] = np.add.reduceat(mixed(hashes ^ np.uint64(seed)), start)
    return mixed(sums + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def checks_of(owners: np.ndarray, hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A second key, independent of the first."""
    return _key(owners, hashes, size, 0x3C6EF372FE94F82B)


def keys_of(owners: np.ndarray, hashes: np.ndarray, texts: int, clash: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Size of each text's set, and a key of its members that doesn't depend on order; the second one where the first is in ``clash``."""
    size = np.bincount(owners, minlength=texts)
    key = _key(owners, hashes, size, 0xA5A5A5A55A5A5A5A)
    if clash is not None and len(clash):
        key = np.where(np.isin(key, clash), checks_of(owners, hashes, size), key)
    return size, key


def bitmaps_of(owners: np.ndarray, hashes: np.ndarray, size: np.ndarray, times: int = 1) -> list[bytes]:
    """For each text the parity of its n-grams by class, packed; ``times`` about as many classes as n-grams, a power of two."""
    bits = np.clip(times * 2 ** np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), times * LEAST_BITS, times * MOST_BITS)
    edges = np.append(0, np.cumsum(bits))
    places = edges[owners] + ((hashes >> np.uint64(40)).astype(np.int64) & (bits[owners] - 1))
    packed = np.packbits((np.bincount(places, minlength=edges[-1]) & 1).astype(np.uint8)).tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


class Bitmaps:
    """Bitmaps of a group's members, folded to any smaller number of classes: a class modulo a power of two."""

    def __init__(self, raw: list[bytes]):
        self.raw = [np.frombuffer(x, np.uint64) for x in raw]
        self.words = np.array([len(x) for x in self.raw])
        self.folded: dict[int, np.ndarray] = {}

    def at(self, words: int) -> np.ndarray:
        """All members at ``words`` words; those with fewer are left zero."""
        if words not in self.folded:
            self.folded[words] = np.array([np.bitwise_xor.reduce(x.reshape(-1, words), axis=0) if len(x) >= words else np.zeros(words, np.uint64) for x in self.raw])
        return self.folded[words]


def ordered(hashes: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place in the global order: by hash, frequent ones last by their rank."""
    out = hashes >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        hit = frequent[at] == hashes
        out[hit] = np.uint64(1 << 63) + rank[at[hit]].astype(np.uint64)
    return out


def _summaries(df: DataFrame, n: int) -> DataFrame:
    """A row for each document (id, row, size, key, check, bitmap), and rows (ngram, times) of n-grams frequent in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, size = [], 0
        names = ["id", "row", "size", "key", "check", "bitmap", "ngram", "times"]

        def counted() -> pa.RecordBatch:
            grams, times = np.unique(np.concatenate(held), return_counts=True)
            keep = times >= 4
            grams, times = grams[keep].view(np.int64), times[keep]
            none = lambda t: pa.nulls(len(grams), t)
            return pa.RecordBatch.from_arrays([*[none(pa.int64())] * 5, none(pa.binary()), pa.array(grams), pa.array(times.astype(np.int64))], names=names)

        for batch in batches:
            texts, sizes, keys, checks, maps = batch.column(1).to_pylist(), [], [], [], []
            for first, owners, hashes in ngram_sets(texts, n):
                here = _texts_in(texts, first)
                s, k = keys_of(owners, hashes, here)
                sizes.append(s)
                keys.append(k)
                checks.append(checks_of(owners, hashes, s))
                maps += bitmaps_of(owners, hashes, s)
                new = np.zeros(here, bool)
                for i, x in enumerate(k.tolist()):
                    if x not in seen:
                        seen.add(x)
                        new[i] = True
                held.append(hashes[new[owners]] if len(owners) else hashes)
                size += len(held[-1])
            none = lambda t: pa.nulls(len(texts), t)  # noqa: E731, B023
            if texts:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(np.concatenate(sizes).astype(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(checks)), pa.array(maps, pa.binary()), none(pa.int64()), none(pa.int64())], names=names
                )
            if size > 2_000_000:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    return df.mapInArrow(run, "id long, row long, size long, key long, check long, bitmap binary, ngram long, times long")


def _texts_in(texts: list, first: int) -> int:
    """How many texts the block that begins at ``first`` has (the same cut as hashing.blocks)."""
    size = 0
    for i in range(first, len(texts)):
        n = len((texts[i] or "").encode("utf-8", "replace"))
        if i > first and size + n > 1 << 18:
            return i - first
        size += n + 1
    return len(texts) - first


# --- filing under prefix n-grams ---------------------------------------------


def _rows(columns: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    held = list(zip(*columns, strict=True)) if columns else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, kinds, strict=True)], names=names)


def _edges(*sorted_columns: np.ndarray) -> list[int]:
    """Where runs of equal values begin in columns sorted together, and the end."""
    new = np.ones(len(sorted_columns[0]), bool)
    new[1:] = False
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return [*np.flatnonzero(new).tolist(), len(new)]


def _narrowed(values: np.ndarray) -> bytes:
    """Numbers from 0 on in two bytes each if they fit, else in four; the last byte says which."""
    return values.astype(np.uint16).tobytes() + b"\2" if not len(values) or values.max() < 1 << 16 else values.astype(np.uint32).tobytes() + b"\4"


def _widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data[:-1], np.uint16 if data[-1] == 2 else np.uint32).astype(np.int64)


def _filed(df: DataFrame, n: int, least: int, frequent, clash: np.ndarray, parts: int, block: int) -> DataFrame:
    """Packed blocks (part, hot, salt, ngrams, owners, keys, sizes) of the sets under the n-grams of their prefixes.

    An n-gram counted more than ``2 * block`` times is dealt out by salt; ``hot`` is its number, else -1.
    """
    names = ["part", "hot", "salt", "ngrams", "owners", "keys", "sizes"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, rank, times = frequent.value
        seen: set[int] = set()
        tokens, owners_held, keys_held, sizes_held, sets, size = [], [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            t, o = np.concatenate(tokens), np.concatenate(owners_held)
            k, s = np.concatenate(keys_held), np.concatenate(sizes_held).astype(np.int32)
            rows = []
            if len(grams):
                at = np.minimum(np.searchsorted(grams, t), len(grams) - 1)
                hot = (grams[at] == t) & (times[at] > 2 * block)
                if hot.any():
                    h, owner = at[hot], o[hot]
                    salts = -(-times[h] // block)
                    salt = (mixed(k[owner].view(np.uint64) ^ mixed(t[hot])) % salts.astype(np.uint64)).astype(np.int64)
                    order = np.lexsort((salt, h))
                    h, salt, owner = h[order], salt[order], owner[order]
                    edges = _edges(h, salt)
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        part = int(mixed(np.array([int(h[a]) * 0x10001 + int(salt[a])], np.uint64))[0] % np.uint64(parts))
                        rows.append((part, int(h[a]), int(salt[a]), b"", b"", k[owner[a:b]].tobytes(), _narrowed(s[owner[a:b]])))
                    t, o = t[~hot], o[~hot]
            part = (t % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((o, part))
            t, o, part = t[order], o[order], part[order]
            edges = np.searchsorted(part, np.arange(parts + 1))
            for p in range(parts):
                a, b = edges[p], edges[p + 1]
                if a < b:
                    mine, local = np.unique(o[a:b], return_inverse=True)
                    rows.append((p, -1, 0, ((t[a:b] // np.uint64(parts)) & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), _narrowed(local), k[mine].tobytes(), _narrowed(s[mine])))
            return _rows(rows, kinds, names)

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, owners, hashes in ngram_sets(texts, n):
                here = _texts_in(texts, first)
                s, k = keys_of(owners, hashes, here, clash)
                new = np.zeros(here, bool)
                for i, x in enumerate(k.tolist()):
                    if s[i] and x not in seen:
                        seen.add(x)
                        new[i] = True
                if not new.any():
                    continue
                keep = new[owners]
                owners, place, raw = owners[keep], ordered(hashes[keep], grams, rank), hashes[keep]
                order = np.lexsort((place, owners))
                owners, raw = owners[order], raw[order]
                start = np.flatnonzero(np.diff(owners, prepend=-1))
                length = np.diff(np.append(start, len(owners)))
                within = np.arange(len(owners)) - np.repeat(start, length)
                prefix = length - -(-least * length // 100) + 1
                keep = within < np.repeat(prefix, length)
                tokens.append(raw[keep])
                owners_held.append(owners[keep] + sets)
                keys_held.append(k)
                sizes_held.append(s)
                sets += here
                size += int(keep.sum())
                if size > 1_000_000:
                    yield flush()
                    tokens, owners_held, keys_held, sizes_held, sets, size = [], [], [], [], 0, 0
        if size:
            yield flush()

    return df.mapInArrow(run, "part int, hot int, salt int, ngrams binary, owners binary, keys binary, sizes binary")


_GROUP = "signature long, family long, split boolean, keys array<long>, sizes array<long>"


def _groups(filed: DataFrame, least: int, parts: int, block: int) -> DataFrame:
    """Groups of sets that share an n-gram of their prefixes, each about ``2 * block`` members at most.

    Groups with the same members come once.  Blocks of one n-gram that was cut
    have ``split`` and a common ``family``; pairs across them are left to the
    last wave.
    """

    def group(table: pa.Table) -> pa.Table:
        ngrams, keys, sizes, hot, p = [], [], [], {}, 0
        for r in table.to_pylist():
            k, s, p = np.frombuffer(r["keys"], np.int64), _widened(r["sizes"]), r["part"]
            if r["hot"] >= 0:
                hot.setdefault((r["hot"], r["salt"]), []).append((k, s))
                continue
            local = _widened(r["owners"])
            ngrams.append(np.frombuffer(r["ngrams"], np.uint32))
            keys.append(k[local])
            sizes.append(s[local])
        rows, seen = [], set()

        def put(family: int, split: bool, k: np.ndarray, s: np.ndarray, salt: int) -> None:
            if len(k) > 2 * block:
                cut = -(-len(k) // block)
                where = (mixed(k.view(np.uint64) ^ mixed(np.array([family + 1], np.int64).view(np.uint64))) % np.uint64(cut)).astype(np.int64)
                for c in range(cut):
                    put(family, True, k[where == c], s[where == c], salt * 4096 + c + 1)
                return
            total = mixed(k.view(np.uint64)).sum(dtype=np.uint64)
            signature = int((mixed(np.array([family, salt], np.int64).view(np.uint64)).sum(dtype=np.uint64) if split else total).astype(np.int64))
            if len(k) and signature not in seen:
                seen.add(signature)
                rows.append((signature, family, split, k, s))

        for (h, salt), held in hot.items():
            k, at = np.unique(np.concatenate([a for a, _ in held]), return_index=True)
            put(-1 - h, True, k, np.concatenate([b for _, b in held])[at].astype(np.int64), salt)
        if ngrams:
            g, k, s = np.concatenate(ngrams), np.concatenate(keys), np.concatenate(sizes)
            # Only n-grams that come up again can matter.
            order = np.argsort(g, kind="stable")
            g = g[order]
            same = np.zeros(len(g) + 1, bool)
            same[1:-1] = g[1:] == g[:-1]
            keep = same[1:] | same[:-1]
            order, g = order[keep], g[keep]
            k, s = k[order], s[order].astype(np.int64)
            order = np.lexsort((k, s, g))
            g, k, s = g[order], k[order], s[order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
            g, k, s = g[new], k[new], s[new]
            first = np.ones(len(g), bool)
            first[1:] = (g[1:] != g[:-1]) | (100 * s[:-1] < least * s[1:])
            edges = [*np.flatnonzero(first).tolist(), len(g)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a > 1:
                    put((int(g[a]) * parts + p) * 64 + int(s[a]) % 64, False, k[a:b], s[a:b], 0)
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.Table.from_batches([_rows(rows, kinds, [c.split()[0] for c in _GROUP.split(", ")])])

    found = filed.groupBy("part").applyInArrow(group, _GROUP)
    return found.groupBy("signature").agg(*[f(c).alias(c) for c, f in (("family", F.first), ("split", F.max), ("keys", F.first), ("sizes", F.first))])


# --- candidates within groups ------------------------------------------------


def runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The rows of each group, one after the other, from batches sorted by ``by``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = [batch.schema.get_field_index(c) for c in by]
        edges = _edges(*[batch.column(i).to_numpy(zero_copy_only=False) for i in names])
        if held and any(held[-1].column(i)[-1].as_py() != batch.column(i)[0].as_py() for i in names):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def may_link(maps: Bitmaps, sizes: np.ndarray, x: int, others: np.ndarray, least: int) -> np.ndarray:
    """Which of ``others``, ascending and none larger than x, can link to x by size and by bitmap."""
    ok = 100 * sizes[others] >= least * sizes[x]
    near = others[ok]
    if len(near):
        table = maps.at(int(maps.words[near[0]]))
        apart = np.bitwise_count(table[near] ^ table[x]).sum(1, dtype=np.int64)
        ok[ok] = (100 + least) * apart <= (100 - least) * (sizes[x] + sizes[near])
    return ok


Place = tuple[int, int]  # size and key


class Spent:
    """How many pairs of two labels a task has handed on.  One that links joins all members of both, so a round hands on few of them."""

    def __init__(self, most: int):
        self.most = most
        self.pairs: dict[tuple[int, int], int] = {}
        self.closed: dict[int, list[int]] = {}  # for each label those it has no more pairs with

    def take(self, a: int, b: int) -> bool:
        """Whether one more pair of these labels may go on."""
        pair = (a, b) if a < b else (b, a)
        n = self.pairs.get(pair, 0) + 1
        if n <= self.most:
            self.pairs[pair] = n
        if n == self.most:
            self.closed.setdefault(a, []).append(b)
            self.closed.setdefault(b, []).append(a)
        return n <= self.most


def first_partners(table: pa.Table, least: int, most: int, each: int = 1, spent: Spent | None = None) -> Iterator[tuple[int, dict[int, list[Place]], Place]]:
    """For each member (key, partners, resume): the first ``each`` smaller members, by size and key, of each of up to ``most`` other labels
    that may link to it, from its own start on and as far as ``spent`` lets them, and the first candidate left out, from which it has to go on.
    """
    spent = spent or Spent(1 << 62)
    keys, sizes, labels = (table.column(c).to_numpy() for c in ("key", "size", "label"))
    from_size, from_key = table.column("from_size").to_numpy(), table.column("from_key").to_numpy()
    maps = Bitmaps(table.column("bitmap").to_pylist())
    low = np.searchsorted(100 * sizes, least * sizes)
    for x in range(1, len(keys)):
        if from_size[x] > sizes[x]:
            continue
        begin, step = max(int(low[x]), int(np.searchsorted(sizes, from_size[x]))), 32
        found: dict[int, list[Place]] = {}
        full: list[int] = []  # labels that have enough partners
        own = int(labels[x])
        closed = spent.closed.setdefault(own, [])
        resume = (NOWHERE, 0)
        while begin < x and (len(full) < most or resume[0] == NOWHERE):
            y = np.arange(begin, min(x, begin + step))
            begin, step = begin + step, step * 2
            y = y[(labels[y] != labels[x]) & ((sizes[y] > from_size[x]) | (keys[y] >= from_key[x]))]
            known = np.isin(labels[y], full + closed) if len(full) < most else np.ones(len(y), bool)
            if known.any():
                i = y[known][0]
                resume = min(resume, (int(sizes[i]), int(keys[i])))
                y = y[~known]
            if not len(y):
                continue
            for i in y[may_link(maps, sizes, x, y, least)].tolist():
                at, label = (int(sizes[i]), int(keys[i])), int(labels[i])
                mine = found.get(label, ())
                if len(mine) == each or (not mine and len(found) == most) or not spent.take(own, label):
                    resume = min(resume, at)
                    continue
                found.setdefault(label, []).append(at)
                if len(found[label]) == each:
                    full.append(label)
        if found or resume[0] < NOWHERE:
            yield int(keys[x]), found, resume


def _proposed(members: DataFrame, least: int, most: int, each: int = 1) -> DataFrame:
    """(key, found, resume): partners of each member over all its groups, ``each`` of up to ``most`` labels, and where it has to go on.

    ``members``: signature, key, size, label, bitmap, from_size, from_key, and ``anchor``, by which groups are dealt out.  Groups that
    share many pairs share one of ``SPREAD``, as of a pair that comes up again in a task one row goes on.
    """
    names, kinds = ["key", "label", "size", "partner", "rsize", "rkey"], [pa.int64()] * 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[dict[int, list[Place]], Place]] = {}
        spent = Spent(OF_LABELS * each)

        def out() -> pa.RecordBatch:
            rows = [(k, label, *at, *r) for k, (v, r) in held.items() for label, places in v.items() for at in places]
            return _rows(rows + [(k, None, None, None, *r) for k, (v, r) in held.items() if not v], kinds, names)

        for table in runs(batches, ["signature"]):
            if table.num_rows > 1:
                for k, found, resume in first_partners(table, least, most, each, spent):
                    mine, before = held.get(k, ({}, (NOWHERE, 0)))
                    resume = min(resume, before)
                    for label, places in found.items():
                        both = sorted({*mine.get(label, ()), *places})
                        mine[label] = both[:each]
                        resume = min([resume, *both[each : each + 1]])
                    held[k] = mine, resume
            if len(held) > 50_000:
                yield out()
                held, spent = {}, Spent(OF_LABELS * each)
        yield out()

    dealt = members.repartition("anchor").sortWithinPartitions("signature", "size", "key")
    made = dealt.mapInArrow(run, ", ".join(f"{n} long" for n in names))
    every = made.groupBy("key").agg(F.array_sort(F.collect_set(F.when(F.col("label").isNotNull(), F.struct("label", "size", "partner")))).alias("c"), F.min(F.struct("rsize", "rkey")).alias("r"))
    place = lambda e: F.struct(e["size"].alias("size"), e["partner"].alias("partner"))
    among_first = lambda e, i: (i < each) | (F.get("c", i - each)["label"] != e["label"])
    every = every.withColumn("f", F.array_sort(F.transform(F.filter("c", among_first), place)))
    left = F.concat(F.transform(F.filter("c", lambda e, i: ~among_first(e, i)), place), F.slice("f", most * each + 1, 1 << 30), F.array(F.struct(F.col("r.rsize").alias("size"), F.col("r.rkey").alias("partner"))))
    return every.select("key", F.slice("f", 1, most * each).alias("found"), F.array_min(left).alias("resume"))


# --- the prefix tree ---------------------------------------------------------


def walk(probe: np.ndarray, sequences: list[np.ndarray], least: int) -> list[int]:
    """Numbers of the sequences that link to ``probe``; all are ascending in the global order.

    Sorted sequences are the tree: a node is a run of them with a common
    beginning, a child a part of the run with the same next element.
    """
    order = sorted(range(len(sequences)), key=lambda i: sequences[i].astype(">u8").tobytes())
    seqs = [sequences[i] for i in order]
    lengths = np.array([len(s) for s in seqs])
    n = len(probe)
    needs = -(-least * (n + lengths) // (100 + least))
    found: list[int] = []

    def overlap(part: np.ndarray) -> int:
        at = np.searchsorted(probe, part)
        return int((probe[np.minimum(at, n - 1)] == part).sum())

    stack = [(0, len(seqs), 0, 0)]
    while stack:
        a, b, depth, shared = stack.pop()
        # The common beginning of a sorted run is that of its first and last.
        first, last = seqs[a], seqs[b - 1]
        common = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:common] != last[depth:common])
        end = depth + int(differ[0]) if len(differ) else common
        if end > depth:
            shared += overlap(first[depth:end])
        passed = int(np.searchsorted(probe, first[end - 1], side="right")) if end else 0
        rest = np.minimum(lengths[a:b] - end, n - passed)
        if not (shared + rest >= needs[a:b]).any():
            continue
        while a < b and len(seqs[a]) == end:
            if shared >= needs[a]:
                found.append(order[a])
            a += 1
        while a < b:
            c = a + 1
            while c < b and seqs[c][end] == seqs[a][end]:
                c += 1
            stack.append((a, c, end, shared))
            a = c
    return found


def _again(df: DataFrame, keys: DataFrame, sets: DataFrame, n: int, clash: np.ndarray, make, name: str) -> DataFrame:
    """(key, ``name``): what ``make`` gives for the sets of ``keys``, made anew from their texts."""
    wanted = staged(keys.distinct().join(sets.select("key", "id"), "key"), "wanted")
    few = wanted.limit(WANTED_IDS + 1).count() <= WANTED_IDS
    near = (F.broadcast(wanted) if few else wanted).select(F.col("id").alias("_id"), "key")
    rows = df.join(near, F.col("id") == F.col("_id")).select("id", "text", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, asked = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            keys, made = [], []
            for first, owners, hashes in ngram_sets(texts, n):
                here = _texts_in(texts, first)
                size, k = keys_of(owners, hashes, here, clash)
                for i, value in enumerate(make(owners, hashes, size)):
                    if k[i] == asked[first + i]:
                        keys.append(int(k[i]))
                        made.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(made, pa.binary())], names=["key", name])

    out = staged(rows.mapInArrow(run, f"key long, {name} binary").groupBy("key").agg(F.first(name).alias(name)), name)
    unstage(wanted)
    return out


def _sequences(df: DataFrame, keys: DataFrame, sets: DataFrame, n: int, clash: np.ndarray, frequent) -> DataFrame:
    """(key, sequence): the sets in the global order."""

    def make(owners: np.ndarray, hashes: np.ndarray, size: np.ndarray) -> Iterator[bytes]:
        grams, rank, _ = frequent.value
        place = ordered(hashes, grams, rank)
        place, edges = place[np.lexsort((place, owners))], np.append(0, np.cumsum(size))
        return (place[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))

    return _again(df, keys, sets, n, clash, make, "sequence")


def _wide(df: DataFrame, keys: DataFrame, sets: DataFrame, n: int, clash: np.ndarray) -> DataFrame:
    """(key, bitmap): wide bitmaps of the sets."""
    return _again(df, keys, sets, n, clash, lambda owners, hashes, size: bitmaps_of(owners, hashes, size, WIDE), "bitmap")


def _links(pairs: DataFrame, made: DataFrame, least: int) -> DataFrame:
    """(a, b) of the ``pairs`` (leader, partner) that link; a leader with many partners walks several trees."""
    many = pairs.groupBy("leader").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select("leader", F.ceil(F.col("n") / CHUNK).alias("trees"))
    pairs = pairs.join(many, "leader", "left").select("leader", "partner", F.pmod(F.xxhash64("partner"), F.coalesce("trees", F.lit(1))).alias("chunk"))
    partners = pairs.join(made.withColumnRenamed("key", "partner"), "partner").select("leader", "chunk", F.col("partner").alias("key"), F.lit(1).alias("role"), "sequence")
    heads = pairs.select("leader", "chunk").distinct().join(made.withColumnRenamed("key", "leader"), "leader").select("leader", "chunk", F.col("leader").alias("key"), F.lit(0).alias("role"), "sequence")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for table in runs(batches, ["leader", "chunk"]):
            keys, roles = table.column("key").to_pylist(), table.column("role").to_pylist()
            sequences = [np.frombuffer(x, np.uint64) for x in table.column("sequence").to_pylist()]
            if len(keys) > 1 and roles[0] == 0:
                hit = walk(sequences[0], sequences[1:], least)
                a += [keys[0]] * len(hit)
                b += [keys[1 + i] for i in hit]
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = partners.unionByName(heads).repartition("leader", "chunk").sortWithinPartitions("leader", "chunk", "role", "key")
    return dealt.mapInArrow(run, "a long, b long")


# --- components --------------------------------------------------------------


def _starred(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, after a large and a small star step; they join the same nodes."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    return large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def components(links: DataFrame, steps: int | None = None) -> DataFrame:
    """(node, root) of the nodes in ``links`` (a, b), by alternating stars until nothing changes.

    After a given number of steps, nodes of one root are in one component, but one component may have several roots.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before, done = None, 0
    while True:
        new = staged(_starred(edges), "edges")
        unstage(edges)
        edges, done = new, done + 1
        if done == steps:
            break
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) if steps is None else None
        if now is not None and now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")))
    return nodes.groupBy("node").agg(F.min("root").alias("root"))


def _relabelled(labels: DataFrame, links: DataFrame, steps: int | None) -> DataFrame:
    """``labels`` (node, root) after ``links`` (a, b): only the roots they join are worked on."""
    ends = links
    for end in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(end), F.col("root").alias("r")), end, "left").withColumn(end, F.coalesce("r", end)).drop("r")
    ends = staged(ends.where("a <> b").select("a", "b"), "ends")
    if ends.isEmpty():
        unstage(ends)
        return labels
    joined = staged(components(ends, steps), "roots")
    unstage(ends)
    old = labels.join(joined.select(F.col("node").alias("root"), F.col("root").alias("r")), "root", "left").select("node", F.coalesce("r", "root").alias("root"))
    out = staged(old.unionByName(joined.join(labels.select("node"), "node", "left_anti")), "labels")
    unstage(joined)
    unstage(labels)
    return out


# --- the join ----------------------------------------------------------------


def _members(groups: DataFrame) -> DataFrame:
    """(signature, family, split, key, size) of all members."""
    rows = groups.select("signature", "family", "split", F.explode(F.arrays_zip("keys", "sizes")).alias("m"))
    return rows.select("signature", "family", "split", F.col("m.keys").alias("key"), F.col("m.sizes").alias("size"))


def _open_members(rows: DataFrame) -> DataFrame:
    """Members of the groups with more than one label and a member that has to go on."""
    first = F.min(F.when(F.col("within_size").isNotNull(), F.col("key")))
    live = rows.groupBy("signature").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), first.alias("open")).where("lo <> hi and open is not null").select("signature", F.xxhash64("open", F.pmod("signature", F.lit(SPREAD))).alias("anchor"))
    return rows.join(live, "signature").select("signature", "anchor", "key", "size", "label", F.coalesce("within_size", F.lit(NOWHERE)).alias("from_size"), F.coalesce("within_key", F.lit(0)).alias("from_key"))


def _across(rows: DataFrame, block: int) -> DataFrame:
    """Members of cut families with more than one label and a member that has to go on, dealt out so that any two of different labels meet.

    Members of the commonest label meet all others, but not each other.
    """
    counts = rows.select("family", "key", "label", "across_size").distinct().groupBy("family", "label").agg(F.count("*").alias("n"), F.count("across_size").alias("open"))
    top = counts.groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.max("n").alias("most"), F.sum("n").alias("total"), F.count("*").alias("labels"), F.sum("open").alias("open")).where("labels > 1 and open > 0")
    blocks = top.select("family", "top", F.ceil(F.col("most") / block).cast("int").alias("big"), F.ceil((F.col("total") - F.col("most")) / block).cast("int").alias("small"))
    own = rows.join(blocks, "family").withColumn("common", F.col("label") == F.col("top"))
    own = own.withColumn("at", F.pmod(F.xxhash64("key"), F.when(F.col("common"), F.col("big")).otherwise(F.col("small"))).cast("int"))
    # Tasks (i, j): block i of the others with block j of the others (j <= i), or with block -1-j of the common label.
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    common = F.transform(F.sequence(F.lit(0), F.col("small") - 1), lambda i: pair(i, -1 - F.col("at")))
    other = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("big") - 1), lambda j: pair(F.col("at"), -1 - j)),
        F.transform(F.sequence(F.lit(0), F.col("small") - 1), lambda j: pair(F.greatest(F.col("at"), j), F.least(F.col("at"), j))),
    )
    met = own.withColumn("t", F.explode(F.when(F.col("common"), common).otherwise(other)))
    start = [F.coalesce("across_size", F.lit(NOWHERE)).alias("from_size"), F.coalesce("across_key", F.lit(0)).alias("from_key")]
    return met.select(F.xxhash64("family", "t.i", "t.j").alias("signature"), F.xxhash64("top", "t.i", "t.j", F.pmod("family", F.lit(SPREAD))).alias("anchor"), "key", "size", "label", *start).distinct()


def cluster(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, least: int = 75, block: int = BLOCK, rows: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``df``.

    With ``rows`` also ``row_key`` (``row_key_of`` the row) and ``group_key``, which names the component whatever its ids; null without words.
    """
    spark: SparkSession = df.sparkSession
    small_batches(spark)
    docs = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NONE)).alias("id"), F.col(text).cast("string").alias("text"))
    seen = staged(_summaries(docs.withColumn("row", row_key_of(F.when(F.col("id") != _NONE, F.col("id")), F.col("text"))), n), "summaries")
    each = seen.where("key is not null").select("id", "row", "size", "key", "check", "bitmap")
    clash = np.zeros(0, np.int64)
    while True:
        found = each.where("size > 0").groupBy("key").agg(
            F.min(F.when(F.col("id") != _NONE, F.col("id"))).alias("least_id"), F.min("id").alias("id"), F.first("size").alias("size"), F.first("bitmap").alias("bitmap"),
            F.min("check").alias("lo"), F.max("check").alias("hi"),
        )
        sets = staged(found, "sets")
        # Unequal sets with equal keys are told apart by their second hash; that is about one pair in 10^10 sets.
        clashing = [r["key"] for r in sets.where("lo <> hi").select("key").limit(MOST_CLASHES).collect()]
        if not clashing:
            break
        clash = np.union1d(clash, np.array(clashing, np.int64))
        each = each.withColumn("key", F.when(F.col("key").isin(clashing), F.col("check")).otherwise(F.col("key")))
        unstage(sets)
    counted = staged(seen.where("ngram is not null").groupBy("ngram").agg(F.sum("times").alias("times")), "ngrams")
    # The counts from which at most FREQUENT n-grams are left, so that tasks send no more than these.
    by_size = counted.groupBy(F.floor(F.log2("times")).alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect()
    kept = [r["size"] for r, total in zip(by_size, np.cumsum([r["n"] for r in by_size]), strict=True) if total <= FREQUENT]
    top = counted.where(F.floor(F.log2("times")) >= (kept[-1] if kept else 1 << 30)).orderBy(F.desc("times"), "ngram").toArrow()
    unstage(counted)
    grams, times = top.column("ngram").to_numpy().view(np.uint64), top.column("times").to_numpy()
    rank = np.arange(len(grams))[::-1]  # the most frequent last
    order = np.argsort(grams)
    frequent = spark.sparkContext.broadcast((grams[order], rank[order], times[order]))
    total = sets.agg(F.sum("size")).first()[0] or 0
    parts = max(8, -(-int(total) * (100 - least) // 100 // FILED_PER_BLOCK))

    groups = staged(_groups(_filed(docs, n, least, frequent, clash, parts, block), least, parts, block), "groups")
    labels = staged(spark.createDataFrame([], "node long, root long"), "labels")
    links: list[DataFrame] = []

    def verify(proposed: DataFrame) -> DataFrame:
        """``labels`` after the links among the proposed pairs."""
        if proposed.isEmpty():
            return labels
        pairs = proposed.select(F.explode("found.partner").alias("leader"), F.col("key").alias("partner"))
        made = _sequences(docs, pairs.select(F.col("leader").alias("key")).union(pairs.select("partner")), sets, n, clash, frequent)
        links.append(staged(_links(pairs, made, least), "links"))
        unstage(made)
        return _relabelled(labels, links[-1], ROUND_STEPS if len(links) > 1 else FIRST_STEPS)

    narrow = sets.select("key", "bitmap")
    first = _members(groups).withColumns({"anchor": F.col("signature"), "label": F.col("key"), "from_size": F.lit(0).cast("long"), "from_key": F.lit(0).cast("long")})
    proposed = staged(_proposed(first.join(narrow, "key"), least, FIRST_PARTNERS), "proposed")
    cut, wide, done = not groups.where("split").isEmpty(), None, 1
    # Where each member goes on, within its groups and across the salts of cut n-grams.
    go_on = proposed.where(F.col("resume.size") < NOWHERE).select("key", F.col("resume.size").alias("within_size"), F.col("resume.partner").alias("within_key"))
    cursor = staged(go_on.withColumns({"across_size": F.lit(0).cast("long"), "across_key": F.lit(0).cast("long")}), "cursor")
    within = members_before = None
    while not proposed.isEmpty() or (cut and done == 1):
        labels = verify(proposed)
        unstage(proposed)
        named, of_cut = labels.select(F.col("node").alias("key"), "root"), _members(groups.where("split"))
        with_label = lambda rows: rows.join(named, "key", "left").withColumn("label", F.coalesce("root", "key")).join(cursor, "key", "left")
        # Only groups that were open before can be open still.
        members = _open_members(with_label(_members(groups) if within is None else within)).withColumn("is_within", F.lit(True))
        if cut:
            start = {"across_size": F.lit(0).cast("long"), "across_key": F.lit(-(1 << 63)).cast("long")} if done == 1 else {}
            members = members.unionByName(_across(with_label(of_cut).withColumns(start), block).withColumn("is_within", F.lit(False)))
        members, before = staged(members, "members"), members_before
        if before is not None:
            unstage(before)
        members_before, within = members, members.where("is_within").select("signature", "key", "size")
        if members.isEmpty():
            break
        done += 1
        if done > NARROW_ROUNDS and wide is None:
            wide = _wide(docs, members.select("key"), sets, n, clash)
        grown = MORE ** max(0, done - NARROW_ROUNDS)
        proposed = staged(_proposed(members.join(wide if wide is not None else narrow, "key"), least, PARTNERS * max(1, grown // MORE), grown), "proposed")
        go_on = proposed.where(F.col("resume.size") < NOWHERE).select("key", F.col("resume.size").alias("rs"), F.col("resume.partner").alias("rk"))
        at = lambda kind: F.greatest(F.struct(F.col("rs").alias("s"), F.col("rk").alias("k")), F.struct(F.col(f"{kind}_size").alias("s"), F.col(f"{kind}_key").alias("k")))
        before = cursor
        later = go_on.join(before, "key", "left").withColumn("w", F.when(F.col("within_size").isNotNull(), at("within"))).withColumn("a", F.when(F.col("across_size").isNotNull(), at("across")).otherwise(F.struct(F.col("rs").alias("s"), F.col("rk").alias("k"))))
        cursor = staged(later.select("key", F.col("w.s").alias("within_size"), F.col("w.k").alias("within_key"), F.col("a.s").alias("across_size"), F.col("a.k").alias("across_key")), "cursor")
        unstage(before)
    unstage(cursor)
    if members_before is not None:
        unstage(members_before)
    if links:  # what the rounds' few steps left apart
        labels = _relabelled(labels, reduce(DataFrame.unionByName, links), None)
    for t in (groups, *links, *([wide] if wide is not None else [])):
        unstage(t)
    named = sets.join(labels, sets["key"] == labels["node"]).groupBy("root").agg(F.min("least_id").alias("component"))
    label = labels.join(named, "root").select(F.col("node").alias("key"), "component", "root")
    own = sets.select("key", "least_id").join(label, "key", "left").select("key", F.coalesce("component", "least_id").alias("component"), F.coalesce("root", "key").alias("root"))
    out = each.select("id", "row", "size", "key").join(own, "key", "left")
    id_out = F.when(F.col("id") != _NONE, F.col("id"))
    more = [F.col("row").alias("row_key"), F.when(F.col("size") > 0, F.col("root")).alias("group_key")] if rows else []
    return out.select(id_out.alias("doc_id"), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component")).otherwise(id_out).alias("component_id"), *more)
