"""All aliases of a vocabulary in one pass over a text.

A vocabulary of thousands of promoted names cannot be one expression for each
alias: the plan would grow with it, and each text be read once for each.  Here
the aliases are one automaton, made once in each Python worker from the
broadcast vocabulary, and a text is read once whatever their number.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..vocabulary import GUARDED, Lexicon

BUCKETS = ("projects", "tokens", "chains", "topics")
FOUND = "struct<" + ",".join(f"{b}:array<struct<name:string,sources:array<string>>>" for b in BUCKETS) + ">"
_ARROW = pa.struct([(b, pa.list_(pa.struct([("name", pa.string()), ("sources", pa.list_(pa.string()))]))) for b in BUCKETS])
#: Characters of all aliases that may be broadcast.
MOST_CHARS = 64 << 20
#: The automaton a worker uses, by the name of its vocabulary.
_MADE: dict[str, AliasFinder] = {}
_LATIN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def _clean(alias: str) -> str:
    return alias.lower().strip()


def guarded_aliases(lexicon: Lexicon) -> list[str]:
    """Topic aliases that count in some contexts only, in the lexicon's order."""
    return list(dict.fromkeys(_clean(a) for aliases in lexicon.topics.values() for a in aliases if _clean(a) in GUARDED))


class AliasFinder:
    """Where the aliases of a vocabulary occur; one with a-z or 0-9 must not stand next to another such character."""

    def __init__(self, rows: list[tuple[str, str, str, int, int]], guarded: list[str]):
        import ahocorasick

        self.guarded = {a: i for i, a in enumerate(guarded)}
        self.rows = sorted(rows, key=lambda r: (BUCKETS.index(r[0]), r[3], r[4]))
        self.of: dict[str, list[int]] = {}
        for i, (bucket, _, alias, _, _) in enumerate(self.rows):
            if (text := _clean(alias)) and not (bucket == "topics" and text in self.guarded):
                self.of.setdefault(text, []).append(i)
        self.guards = [(i, self.guarded[_clean(r[2])]) for i, r in enumerate(self.rows) if r[0] == "topics" and _clean(r[2]) in self.guarded]
        self.longest = max(map(len, self.of), default=0)
        self.automaton = ahocorasick.Automaton()
        for text in self.of:
            self.automaton.add_word(text, (text, bool(re.search("[a-z0-9]", text))))
        if self.of:
            self.automaton.make_automaton()

    def within(self, text: str) -> set[str]:
        """Aliases in a lower-case text."""
        found: set[str] = set()
        if not self.of or not text:
            return found
        last = len(text) - 1
        for end, (alias, bounded) in self.automaton.iter(text):
            if alias in found:
                continue
            if bounded:
                start = end - len(alias)
                if (start >= 0 and text[start] in _LATIN) or (end < last and text[end + 1] in _LATIN):
                    continue
            found.add(alias)
        return found

    def across(self, title: str, body: str) -> set[str]:
        """Aliases that begin in the title and end in the body, with a blank between."""
        if not title or not body or not self.of:
            return set()
        left, right = title[-self.longest - 1 :], body[: self.longest + 1]
        joined, found = f"{left} {right}", set()
        for end, (alias, bounded) in self.automaton.iter(joined):
            start = end - len(alias) + 1
            if start < len(left) < end:
                inside = (start > 0 and joined[start - 1] in _LATIN) or (end + 1 < len(joined) and joined[end + 1] in _LATIN)
                if not (bounded and inside):
                    found.add(alias)
        return found

    def evidence(self, title: str, body: str, guards: list) -> dict[str, list[dict]]:
        """Names with their sources, by bucket, in the vocabulary's order; a topic may also lie across title and body."""
        in_title, in_body = self.within(title), self.within(body)
        hits: dict[int, tuple[bool, bool]] = {}
        for alias in in_title | in_body:
            for i in self.of[alias]:
                hits[i] = (alias in in_title, alias in in_body)
        for alias in self.across(title, body) - in_title - in_body:
            hits |= {i: (False, False) for i in self.of[alias] if self.rows[i][0] == "topics"}
        for i, g in self.guards:
            if guards[g][2]:
                hits[i] = (bool(guards[g][0]), bool(guards[g][1]))
        out: dict[str, list[dict]] = {b: [] for b in BUCKETS}
        last, sources = None, {}
        for i in sorted(hits):
            bucket, name, alias, place, _ = self.rows[i]
            if (bucket, place) != last:
                last, sources = (bucket, place), {}
                out[bucket].append({"name": name, "sources": sources})
            sources |= {f"{label}:{alias}": None for label, hit in zip(("title", "body"), hits[i], strict=True) if hit}
        return {b: [{"name": e["name"], "sources": list(e["sources"])} for e in found] for b, found in out.items()}


#: Texts whose evidence is held as Python objects at once, and about so many characters of them at most.
SLICE_ROWS, SLICE_CHARS = 256, 1 << 20


def in_slices(finder: AliasFinder, title: pa.Array, body: pa.Array, guards: pa.Array) -> pa.Array:
    """Evidence of a batch, made slice by slice: as Python objects it takes many times the texts' room, as Arrow little."""
    made, rows = [], []
    chars = 0
    for at in range(len(title)):
        t, b = title[at].as_py() or "", body[at].as_py() or ""
        rows.append(finder.evidence(t, b, guards[at].as_py()))
        chars += len(t) + len(b)
        if len(rows) >= SLICE_ROWS or chars >= SLICE_CHARS:
            made.append(pa.array(rows, _ARROW))
            rows, chars = [], 0
    made.append(pa.array(rows, _ARROW))
    return pa.concat_arrays(made)


def found_aliases(spark: SparkSession, lexicon: Lexicon) -> Callable:
    """A function of lower-case title, body, and the hits of guarded aliases: evidence by bucket."""
    rows, guarded = lexicon.rows(), guarded_aliases(lexicon)
    if sum(len(a) for _, _, a, _, _ in rows) > MOST_CHARS:
        raise ValueError(f"the vocabulary has more than {MOST_CHARS} characters")
    shared, name = spark.sparkContext.broadcast((rows, guarded)), uuid.uuid4().hex

    @F.arrow_udf(FOUND)
    def run(title: pa.Array, body: pa.Array, guards: pa.Array) -> pa.Array:
        if name not in _MADE:
            _MADE.clear()
            _MADE[name] = AliasFinder(*shared.value)
        return in_slices(_MADE[name], title, body, guards)

    return run
