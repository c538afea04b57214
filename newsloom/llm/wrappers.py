"""Main text of web pages by union-free wrappers inferred for each host.

Every page is a stream of tokens: the structural path of each text block.
Repeats next to each other, of any period, become a repeated group, groups
within groups included.  The streams of a host are aligned one after another
with its wrapper, a sequence without alternatives: what matches stays, a run
that spells out a group of the other side becomes that group, what only one
side has becomes optional, and what comes twice in a row becomes repeated.
Texts are part of the alignment: where they differ a token holds a slot
(``#text`` in the expression), where all pages agree the constant itself.

A page's text is read by aligning its stream with the host's wrapper.  Blocks
that fall on a slot of the article's container are text; those that fall on a
constant of the template are not.  The container is the wrapper's: the
``article`` or ``main`` element with most text over all pages, else the deepest
element that holds most of it.  Names such as ``ad`` or ``comments`` are a prior
on what lies inside the container, and on the choice of the container where
there are several; they never count on ``html`` and ``body`` nor on what the
container lies in.  Blocks that match no token are judged by their path, and a
page without any block in the container by itself.

Scale: per task and host, pages are reduced to distinct streams and to sums per
path, then by Spark's partial aggregation; a host's streams are folded in a tree
of at most ``fan_in`` each, so a hot host's streams never meet in one task.  After
each fold, tokens on fewer than one in ``RARE`` of its pages leave the wrapper and
are judged by their path, as all are that are not constant on half the pages; so a
wrapper is at most ``RARE`` times as long as a page.  Alignments are longest ones
at any length, in linear memory.  Wrappers reach the pages by a broadcast if they are small (their
size is measured), else by a join whose hot hosts adaptive execution splits.

Defined results: null or empty html has an empty text; a null or malformed url
counts as host ''; repeated rows are extracted one by one, and equal pages count
as one where constants are told from slots; columns of ``pages`` named like a
new one give way to it; ties between containers go to the shorter, then the
smaller path; an empty table has no wrappers and no rows.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, staged, unstage, unused, with_columns

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea|svg)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|</(?P<close>[a-zA-Z][^\s>/]*)[^>]*>"
    r"|<(?P<open>[a-zA-Z][^\s>/]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[a-zA-Z/!?][^<>]*\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")

#: Elements that make no block of their own. Fixed values.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img picture source label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes an open one of these. Fixed values.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "body": {"head"},
}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements, and words in class, id or role, that mark boilerplate. Fixed values.
BOILERPLATE_TAGS = frozenset("head nav header footer aside form button select dialog title".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies "
    "disqus discussion feedback footer footnav gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices popup promo "
    "promoted promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags "
    "toolbar widget widgets complementary".split()
)
CONTENT_WORDS = frozenset("article content entry main post story".split())


MARK = "!"  # ends a step that bears a boilerplate name
RARE = 64
TABLE_CELLS = 1 << 22  # a longer alignment is halved first


def host_column(url: Column) -> Column:
    """Lower-case host of a url, '' if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), F.lit(""))


def _step(tag: str, attrs: str) -> str:
    """A step of a path: tag, first name with numbers folded, and a mark if the names say boilerplate."""
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attrs)} if "=" in attrs else {}
    names = [*found.get("class", "").lower().split(), found.get("id", "").lower(), found.get("role", "").lower()]
    words = {w for n in names for w in _WORDS.findall(n)}
    name = re.sub(r"[0-9]+", "0", names[0] or names[-2] if len(names) > 1 else names[0]).replace("/", "-")
    marked = tag not in ("html", "body") and bool(words & BOILERPLATE_WORDS)
    return tag + ("." + name if name else "") + (MARK if marked else "")


def page_blocks(html: str | None) -> list[tuple[str, str, int]]:
    """(path, text, characters in links) of each block with text, in page order."""
    if not html:
        return []
    stack: list[tuple[str, str]] = []  # tag, step
    blocks, held, links, in_link = [], [], 0, 0

    def flush() -> None:
        nonlocal held, links
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                blocks.append(("/".join([s for _, s in stack]), text, links))
        held, links = [], 0

    def add(text: str) -> None:
        nonlocal links
        if text:
            held.append(text)
            if in_link:
                links += len(text.strip())

    def leave(tags: set | frozenset, within: frozenset = frozenset()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in within:
                return

    pos = 0
    for m in _TOKEN.finditer(html):
        if m.start() > pos:
            add(html[pos : m.start()])
        pos = m.end()
        if tag := m["open"]:
            tag = tag.lower()
            if tag in INLINE:
                in_link = 1 if tag == "a" else in_link
                if tag == "br":
                    add(" ")
                continue
            flush()
            in_link = 0
            if tag in _ENDS_P and any(t == "p" for t, _ in stack[-3:]):
                leave({"p"}, frozenset({"td", "th", "li", "div"}))
            if tag in CLOSES:
                leave(CLOSES[tag], frozenset({"ul", "ol", "dl", "table"}))
            if tag not in VOID and not m["attrs"].endswith("/"):
                stack.append((tag, _step(tag, m["attrs"])))
        elif tag := m["close"]:
            tag = tag.lower()
            if tag in INLINE:
                in_link = 0 if tag == "a" else in_link
                continue
            flush()
            in_link = 0
            leave({tag})
        elif m["raw"]:
            add(" ")
    if pos < len(html):
        add(html[pos:])
    flush()
    return blocks


# Nodes: [key, children or None, optional, repeated, texts, pages, sample].  A token's key is its path, a group's the
# keys of its children.  Of a token, ``texts`` is the hash of its constant or None for a slot, ``pages`` counts pages
# and ``sample`` holds the hashes of up to LEAST_PAGES different pages.
LEAST_PAGES = 5
KEY, INNER, OPTIONAL, REPEATED, TEXT, PAGES, SAMPLE = range(7)


def token(path: str, text: int | None = None, page: int = 0) -> list:
    return [path, None, False, False, text, 1, [page]]


def _group(children: list[list], repeated: bool) -> list:
    return ["(" + " ".join(c[KEY] for c in children) + ")", children, False, repeated, None, max(c[PAGES] for c in children), []]


def _merged(a: list, b: list, once: bool = False) -> list:
    """Node for two of equal keys; ``once``: both of the same page."""
    inner = [_merged(x, y, once) for x, y in zip(a[INNER], b[INNER], strict=True)] if a[INNER] else None
    pages = max(a[PAGES], b[PAGES]) if once else a[PAGES] + b[PAGES]
    return [a[KEY], inner, a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED], a[TEXT] if a[TEXT] == b[TEXT] else None, pages, sorted({*a[SAMPLE], *b[SAMPLE]})[:LEAST_PAGES]]


def collapsed(nodes: list[list]) -> list[list]:
    """Neighbouring repeats of any period as repeated groups, shorter periods first."""
    numbers: dict[str, int] = {}
    number = lambda: np.array([numbers.setdefault(n[KEY], len(numbers)) for n in nodes])
    ids, period = number(), 1
    while period * 2 <= len(nodes):
        same = ids[period:] == ids[:-period]
        if np.count_nonzero(same) < period:  # a repeat is a run of ``period`` equal places
            period += 1
            continue
        stops = np.append(np.flatnonzero(~same), len(same))
        length = np.diff(stops, prepend=-1)
        if length.max() <= period:
            period += 1
            continue
        run = (np.repeat(stops, length) - np.arange(len(same) + 1)).tolist()  # equal places from here on
        out, i = [], 0
        while i < len(nodes):
            j = i + period
            while j + period <= len(nodes) and run[j - period] >= period:
                j += period
            if j > i + period:
                unit = nodes[i : i + period]
                for k in range(i + period, j, period):
                    unit = [_merged(x, y, True) for x, y in zip(unit, nodes[k : k + period], strict=True)]
                if period == 1:
                    unit[0][REPEATED] = True
                    out += unit
                else:
                    out.append(_group(unit, True))
                i = j
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
        ids = number()
        period = 1 if period > 1 else 2
    return nodes


def _grouped(nodes: list[list], other: list[list]) -> list[list]:
    """``nodes`` with runs that spell out a group of ``other`` put into that group."""
    own = {n[KEY] for n in nodes}
    for key, inner in {n[KEY]: [c[KEY] for c in n[INNER]] for n in other if n[INNER] and n[KEY] not in own}.items():
        out, i = [], 0
        while i < len(nodes):
            if [n[KEY] for n in nodes[i : i + len(inner)]] == inner:
                made = _group(nodes[i : i + len(inner)], False)
                made[OPTIONAL] = all(n[OPTIONAL] for n in nodes[i : i + len(inner)])
                if out and out[-1][KEY] == key:
                    out[-1] = _merged(out[-1], made, True)
                    out[-1][REPEATED] = True
                else:
                    out.append(made)
                i += len(inner)
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def _matches(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places."""
    head = 0
    while head < min(len(left), len(right)) and left[head] == right[head]:
        head += 1
    tail = 0
    while tail < min(len(left), len(right)) - head and left[-1 - tail] == right[-1 - tail]:
        tail += 1
    a, b = left[head : len(left) - tail], right[head : len(right) - tail]
    middle: list[tuple[int, int]] = []
    if a and b:
        numbers: dict[str, int] = {}
        middle = _longest(*(np.array([numbers.setdefault(k, len(numbers)) for k in side]) for side in (a, b)))
    return [(k, k) for k in range(head)] + [(head + i, head + j) for i, j in middle] + [(len(left) - tail + k, len(right) - tail + k) for k in range(tail)]


def _longest(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """A longest common subsequence of numbers; a long one is cut at the middle of ``x``, where a longest one crosses."""
    if len(x) > 1 and len(x) * len(y) > TABLE_CELLS:
        half = len(x) // 2
        cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        return _longest(x[:half], y[:cut]) + [(half + i, cut + j) for i, j in _longest(x[half:], y[cut:])]
    table = np.zeros((len(x) + 1, len(y) + 1), np.int32)  # lengths for suffixes
    for i in range(len(x) - 1, -1, -1):
        row = np.where(y == x[i], table[i + 1, 1:] + 1, table[i + 1, :-1])
        table[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of a longest common subsequence of ``x`` and each beginning of ``y``."""
    row = np.zeros(len(y) + 1, np.int32)
    for v in x:
        row[1:] = np.maximum.accumulate(np.where(y == v, row[:-1] + 1, row[1:]))
    return row


def aligned(left: list[list], right: list[list]) -> list[list]:
    """The wrapper of both: common nodes merged, the rest optional, neighbours of equal keys repeated."""
    left, right = _grouped(left, right), _grouped(right, left)
    out, i, j = [], 0, 0
    for x, y in [*_matches([n[KEY] for n in left], [n[KEY] for n in right]), (len(left), len(right))]:
        for n in (*left[i:x], *right[j:y]):
            out.append([*n[:OPTIONAL], True, *n[REPEATED:]])
        if x < len(left):
            out.append(_merged(left[x], right[y]))
        i, j = x + 1, y + 1
    merged: list[list] = []
    for n in out:
        if merged and merged[-1][KEY] == n[KEY]:
            both = _merged(merged[-1], n, True)
            both[OPTIONAL], both[REPEATED] = merged[-1][OPTIONAL] and n[OPTIONAL], True
            merged[-1] = both
        else:
            merged.append(n)
    return merged


def expression(nodes: list[list]) -> str:
    """The wrapper as a regular expression over tokens: ``path=#text`` is a slot, ``path=hash`` a constant."""
    out = []
    for n in nodes:
        x = "(" + expression(n[INNER]) + ")" if n[INNER] else f"{n[KEY]}={'#text' if n[TEXT] is None else n[TEXT]}"
        out.append((f"({x})" if not n[INNER] and (n[OPTIONAL] or n[REPEATED]) else x) + "+" * n[REPEATED] + "?" * n[OPTIONAL])
    return " ".join(out)


def leaves(nodes: list[list]) -> list[list]:
    return [x for n in nodes for x in (leaves(n[INNER]) if n[INNER] else [n])]


def page_stream(blocks: list[tuple[str, str, int]]) -> list[list]:
    page = crc32("\n".join(t for _, t, _ in blocks).encode("utf-8", "replace"))
    return collapsed([token(p, crc32(t.encode("utf-8", "replace")), page) for p, t, _ in blocks])


def placed(paths: list[str], nodes: list[list]) -> list[int]:
    """For each block of a page the wrapper's leaf that its token falls on, or -1."""
    # The sample of a leaf begins with the first block it stands for; nodes cover the blocks in order.
    page = _grouped(collapsed([token(p, None, i) for i, p in enumerate(paths)]), nodes)
    # A group of the wrapper that the page spells out in part is matched by its children.
    have = {n[KEY] for n in page}
    flat: list[tuple[str, list[int]]] = []
    number = 0
    for n in nodes:
        inside = len(leaves([n]))
        if n[INNER] and n[KEY] not in have:
            for c in n[INNER]:
                m = len(leaves([c]))
                flat.append((c[KEY], list(range(number, number + m))))
                number += m
        else:
            flat.append((n[KEY], list(range(number, number + inside))))
            number += inside
    out = [-1] * len(paths)
    starts = [min(x[SAMPLE][0] for x in leaves([n])) for n in page] + [len(paths)]
    for i, j in _matches([n[KEY] for n in page], [k for k, _ in flat]):
        pattern, k = [x[KEY] for x in leaves([page[i]])], 0
        for b in range(starts[i], starts[i + 1]):
            while pattern[k] != paths[b]:  # the next leaf of that path, around the group
                k = (k + 1) % len(pattern)
            out[b] = flat[j][1][k]
            k = (k + 1) % len(pattern) if len(pattern) > 1 and b + 1 < len(paths) and paths[b + 1] != paths[b] else k
    return out


def _clean(steps: list[str], inside: bool) -> bool:
    """Whether no step is boilerplate; ``inside`` an article, a header may hold its title."""
    for s in steps:
        tag = s.rstrip(MARK).partition(".")[0]
        inside |= tag == "article"
        if s.endswith(MARK) or (tag in BOILERPLATE_TAGS and not (inside and tag == "header")):
            return False
    return True


def content_root(stats: dict[str, tuple[int, int]]) -> str | None:
    """The container of the article; ``stats``: path -> (characters, characters in links)."""
    for clean in (True, False):  # if names leave nothing, they are no help
        mass: Counter = Counter()
        named: dict[str, tuple[int, bool]] = {}
        total = 0
        for path, (chars, link_chars) in stats.items():
            steps = path.split("/")
            tags = [x.rstrip(MARK).partition(".")[0] for x in steps]
            if link_chars * 2 > chars or (clean and not _clean(steps, False)):
                # An article that lies in something with a boilerplate name is still one.
                if clean and link_chars * 2 <= chars and "article" in tags:
                    k = tags.index("article")
                    if not any(t in BOILERPLATE_TAGS for t in tags[:k]) and _clean(steps[k + 1 :], True):
                        prefix = "/".join(steps[: k + 1])
                        mass[prefix] += chars
                        named.setdefault(prefix, (0, True))
                continue
            if not clean and any(t in BOILERPLATE_TAGS for t in tags):
                continue
            total += chars
            for k in range(1, len(steps) + 1):
                prefix = "/".join(steps[:k])
                mass[prefix] += chars
                name = steps[k - 1].rstrip(MARK).partition(".")[2]
                if tags[k - 1] in ("article", "main"):
                    named[prefix] = (2, True)
                elif tags[k - 1] not in ("body", "html") and set(_WORDS.findall(name)) & CONTENT_WORDS:
                    named[prefix] = (1, False)
        good = [p for p, (rank, _) in named.items() if rank == 0 or mass[p] * 3 >= total]
        if good:
            return max(good, key=lambda p: (named[p][0] > 0, p.rpartition("/")[2].startswith("article"), mass[p] * max(1, named[p][0]), -len(p), p))
        blocks = ("p", "h1", "h2", "h3", "li", "td")
        deep = [p for p, c in mass.items() if c * 10 >= 6 * total and p.rpartition("/")[2].rstrip(MARK).partition(".")[0] not in blocks]
        if deep:
            return max(deep, key=lambda p: (p.count("/"), -len(p), p))
    return None


def _under(path: str, root: str | None) -> bool:
    """Whether the path lies in the container, with no boilerplate below it."""
    if root is None:
        return _clean(path.split("/"), False)
    if path != root and not path.startswith(root + "/"):
        return False
    return _clean(path[len(root) + 1 :].split("/"), "article" in root.rpartition("/")[2] or "/article" in root) if path != root else True


def wrapper_of(nodes: list[list], stats: dict[str, tuple[int, int]], pages: int) -> dict:
    """Nodes, container, and for each leaf whether it holds text of the article."""
    root = content_root(stats)
    all_leaves = leaves(nodes)
    inside = [_under(n[KEY], root) for n in all_leaves]
    constant = [n[TEXT] is not None and len(n[SAMPLE]) >= LEAST_PAGES and 2 * n[PAGES] >= pages for n in all_leaves]
    if not any(i and n[TEXT] is None for i, n in zip(inside, all_leaves, strict=True)):
        constant = [False] * len(constant)  # nothing in the article differs, so nothing tells the template apart
    return {"root": root, "nodes": nodes, "text": [i and not c for i, c in zip(inside, constant, strict=True)]}


def main_text(html: str | None, wrapper: dict | None, known: dict | None = None) -> str:
    """Text of the blocks that fall on the wrapper's article slots; ``known`` keeps places of streams seen before."""
    blocks = page_blocks(html)
    root = wrapper["root"] if wrapper else None
    if not wrapper or not any(_under(p, root) for p, _, _ in blocks):
        stats: dict[str, tuple[int, int]] = {}
        for p, t, n in blocks:
            a = stats.get(p, (0, 0))
            stats[p] = (a[0] + len(t), a[1] + n)
        root = content_root(stats)
        return "\n".join(t for p, t, _ in blocks if _under(p, root))
    paths = [p for p, _, _ in blocks]
    at = "\n".join(paths)
    places = known.get(at) if known is not None else None
    if places is None:
        places = placed(paths, wrapper["nodes"])
        if known is not None and len(known) < 10_000:
            known[at] = places
    return "\n".join(t for (p, t, _), k in zip(blocks, places, strict=True) if (wrapper["text"][k] if k >= 0 else _under(p, root)))


_SEEN = "host string, kind string, key string, nodes string, pages long, chars long, links long"
_SEEN_ARROW = pa.schema([
    ("host", pa.string()), ("kind", pa.string()), ("key", pa.string()), ("nodes", pa.string()), ("pages", pa.int64()), ("chars", pa.int64()), ("links", pa.int64()),
])


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and host: sums for each path, and distinct streams with their texts merged."""
    paths: dict[tuple, list] = {}
    streams: dict[tuple, list] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        made = [(h, "path", p, None, 0, *v) for (h, p), v in paths.items()]
        made += [(h, "stream", k, json.dumps(nodes), n, 0, 0) for (h, k), (nodes, n) in streams.items()]
        for i in range(0, len(made), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made[i : i + 2000], strict=True), _SEEN_ARROW, strict=True)], schema=_SEEN_ARROW)

    for batch in batches:
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            blocks = page_blocks(html)
            nodes = page_stream(blocks)
            key = host, expression([[n[KEY], None, False, False, 0] for n in nodes])
            old = streams.get(key)
            streams[key] = ([_merged(x, y) for x, y in zip(old[0], nodes, strict=True)] if old else nodes, old[1] + 1 if old else 1)
            for path, text, links in blocks:
                v = paths.setdefault((host, path), [0, 0])
                v[0] += len(text)
                v[1] += links
        if len(paths) + len(streams) > 20000:
            yield from rows()
            paths, streams = {}, {}
    yield from rows()


def infer(pages: DataFrame, url: str = "url", html: str = "html", fan_in: int = 64) -> DataFrame:
    """(host, pages, expression, wrapper as JSON): one wrapper for each host, staged."""
    small_batches(pages.sparkSession, 500)
    seen = staged(pages.select(host_column(F.col(url)).alias("host"), F.col(html).cast("string").alias("html")).mapInArrow(_observed, _SEEN), "streams")

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        nodes = None
        for _, text in sorted(zip(frame["key"], frame["nodes"], strict=True), key=lambda x: (len(x[0]), x)):
            mine = json.loads(text)
            nodes = mine if nodes is None else aligned(nodes, mine)
        first, pages = min(frame["key"]), int(frame["pages"].sum())
        nodes = [n for n in nodes if n[PAGES] * RARE >= pages]
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "key": [first], "nodes": [json.dumps(nodes)], "pages": [pages]})

    level = seen.where("kind = 'stream'").select("host", "key", "nodes", "pages")
    while True:
        counts = level.groupBy("host").agg(F.count("*").alias("n"))
        folded = level.join(counts, "host").withColumn("salt", F.pmod(F.xxhash64("key", "nodes"), F.ceil(F.col("n") / fan_in)))
        level = staged(folded.groupBy("host", "salt").applyInPandas(fold, "host string, key string, nodes string, pages long"), "wrappers")
        if level.groupBy("host").count().where("count > 1").isEmpty():
            break
    slots = (
        seen.where("kind = 'path'").groupBy("host", "key").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"))
        .groupBy("host").agg(F.collect_list(F.struct("key", "chars", "links")).alias("slots"))
    )

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                nodes = json.loads(r["nodes"])
                made = wrapper_of(nodes, {s["key"]: (s["chars"], s["links"]) for s in r["slots"] or []}, r["pages"])
                made["nodes"] = [_bare(n) for n in nodes]
                out.append((r["host"], r["pages"], expression(nodes), json.dumps(made)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["host", "pages", "expression", "wrapper"])

    made = staged(level.join(slots, "host", "left").mapInArrow(decide, "host string, pages long, expression string, wrapper string"), "wrappers")
    unstage(level)
    unstage(seen)
    return made


def _bare(n: list) -> list:
    """A node with what matching needs."""
    return [n[KEY], [_bare(c) for c in n[INNER]] if n[INNER] else None, n[OPTIONAL], n[REPEATED], None, 0, []]


FIELDS = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame, wrappers: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None, broadcast_bytes: int = 4 << 20) -> DataFrame:
    """The ``keep`` columns (all by default) with ``text`` and ``n_chars``."""
    keep = [c for c in (keep or pages.columns) if c not in FIELDS.names]
    h, w, body = unused(pages, "_host", "_wrapper", "_html")
    table = wrappers.select(F.col("host").alias(h), F.col("wrapper").alias(w))
    size = table.agg(F.sum(F.length(h) + F.length(w))).first()[0] or 0
    rows = pages.select(*keep, F.col(html).cast("string").alias(body), host_column(F.col(url)).alias(h))
    joined = rows.join(F.broadcast(table) if size <= broadcast_bytes else table, h, "left")

    def make(batches: Iterator[pa.RecordBatch]):
        parsed: dict[str, tuple[dict, dict]] = {}
        for batch in batches:
            texts = []
            for html_text, made in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (body, w)], strict=True):
                if made is not None and made not in parsed:
                    if len(parsed) > 500:
                        parsed.clear()
                    parsed[made] = (json.loads(made), {})
                texts.append(main_text(html_text, *(parsed[made] if made is not None else (None, None))))
            yield batch, {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    return with_columns(joined, make, FIELDS, keep)
