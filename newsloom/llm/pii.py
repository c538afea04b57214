"""Personal data by rules and a skip-chain conditional random field.

Base rules find e-mail addresses, IPv4 addresses, card numbers and phone
numbers.  A rule match that fails its check is dropped as a whole, and some
mentions fit no rule; the random field gets these back:

* card numbers that stand side by side or beside other numbers, in one run of
  digit groups that fails as a whole (a run without any separator stays lost);
* addresses spelled with ``[at]`` and ``[dot]``;
* phone numbers without ``+``, where the same number occurs in a clear form
  elsewhere in the document, or where the form itself says enough.

Its nodes are the base spans, whose label is known, the other tokens with a
digit, an ``@`` or an ``at`` in brackets, and the groupings of failed runs that
could be a card.  Unary potentials score their shape, chain potentials link
neighbours, and skip potentials tie all nodes of a document with the same
digits, or the same spelling after folding, however far apart.  A clique is tied
through one hub node, so k copies cost k edges and not k * k.  The weights are
learned by pseudo-likelihood (``fit_field``) on documents made by rule, as there
are no labelled spans.  Damped loopy sum-product runs over all documents of an
Arrow batch at once; spans of probability above one half are kept, the likelier
first, where they overlap nothing.

Defined results: a null or empty text has no span; repeated rows are annotated
one by one; a null id stays null; ties go to the earlier span; a token of any
length is a node; columns of the input named like a new one give way to it.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_columns

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match can begin inside a digit run (a match takes a run to its end), so the
# lookbehind changes no result and keeps long digit runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]|[\[(]at[\])]", re.I)
_DIGITS = re.compile(r"[0-9]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_SPACE = re.compile(r"\s")
_EDGE = " \t\r\n.,;:!?\"'()[]{}<>|*#$&%=/\\"
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]+(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]+)+", re.I)
_AT = re.compile(r" ?(?:\[at\]|\(at\)) ?")
_DOT = re.compile(r" ?(?:\[dot\]|\(dot\)) ?")
_PLAIN = re.compile(r"\+?[0-9][0-9 ().-]*\Z")
_ISSUER = re.compile(r"4|5[1-5]|3[47]|6011|65")

FEATURES = ("bias", "spelled", "dotted", "luhn", "no luhn", "issuer", "plus", "zeros", "phone length", "letters", "grouping")
ITERATIONS = 8
DAMPING = 0.3
EVIDENCE = 12.0


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str, failed: list[tuple[int, int]] | None = None) -> list[tuple[str, int, int]]:
    """Rule matches that pass their checks, by start and then kind as listed; ``failed`` gets the digit runs too long or wrong for a card."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and len(d := _NOT_DIGIT.sub("", m.group())) >= 12:
                if len(d) <= 19 and luhn(d):
                    out.append(("card", *m.span()))
                elif failed is not None and len(d) < m.end() - m.start():
                    failed.append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def marked_tokens(text: str) -> list[tuple[int, int]]:
    """Tokens between white space that hold a digit or an ``@``, without edge punctuation."""
    out, pos = [], 0
    while m := _MARK.search(text, pos):
        start = m.start()
        while start > pos and not text[start - 1].isspace():
            start -= 1
        stop = _SPACE.search(text, m.end())
        pos = end = stop.start() if stop else len(text)
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        while start < end and text[start] in _EDGE:
            start += 1
        if end > start:
            out.append((start, end))
    return out


def groupings(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Neighbouring digit groups of a failed run that together could be a card number."""
    groups = [(start + m.start(), start + m.end()) for m in _DIGITS.finditer(text[start:end])]
    for i, (a, b) in enumerate(groups):
        if not _ISSUER.match(text, a, b + 4):
            continue
        digits = ""
        for c, d in groups[i:]:
            digits += text[c:d]
            if len(digits) > 19:
                break
            if len(digits) >= 12 and luhn(digits):
                yield a, d


def features(token: str, grouping: bool = False) -> np.ndarray:
    """Which of FEATURES a node's text has."""
    digits = _NOT_DIGIT.sub("", token)
    plain = bool(_PLAIN.match(token))
    parts = token.split(".")
    card = plain and "." not in token and not token.startswith("+") and 12 <= len(digits) <= 19
    return np.array([
        True, bool(_SPELLED.fullmatch(token)), len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts),
        card and luhn(digits), card and not luhn(digits), card and bool(_ISSUER.match(digits)), plain and token.startswith("+") and 9 <= len(digits) <= 15,
        plain and token.startswith("00") and 11 <= len(digits) <= 17, plain and 9 <= len(digits) <= 15, not plain, grouping,
    ], float)


def _key(token: str) -> str:
    """Equal for mentions of the same thing."""
    digits = _NOT_DIGIT.sub("", token)
    return "#" + digits[-9:] if len(digits) >= 9 else _DOT.sub(".", _AT.sub("@", token.lower()))


class Graph:
    """Nodes (text, start, end, known label or 0, features) of many texts, chain edges and cliques."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, int, int, int]] = []
        self.features: list[np.ndarray] = []
        self.chain: list[tuple[int, int]] = []
        self.hub_of: list[int] = []
        self.hubs = 0

    def add(self, number: int, text: str, base: list[tuple[str, int, int]], failed: list[tuple[int, int]]) -> None:
        found = {(s, e): KINDS.index(k) + 1 for k, s, e in reversed(base)}
        candidates: dict[tuple[int, int], bool] = {}
        for start, end in failed:
            candidates |= dict.fromkeys(groupings(text, start, end), True)
        low = text.lower()
        if "at]" in low or "at)" in low:
            candidates |= {m.span(): False for m in _SPELLED.finditer(text)}
        j = 0
        for start, end in marked_tokens(text):
            while j < len(base) and base[j][2] <= start:
                j += 1
            if not any(s < end and e > start for _, s, e in base[j : j + 8]):
                candidates.setdefault((start, end), False)
        if not candidates:
            return
        folded: dict[str, int] = {}
        last: dict[int, int] = {}  # end -> node
        for start, end in sorted({*found, *candidates}):
            token, here = text[start:end], len(self.nodes)
            self.nodes.append((number, start, end, found.get((start, end), 0)))
            self.features.append(features(token, candidates.get((start, end), False)))
            self.hub_of.append(folded.setdefault(_key(token), self.hubs + len(folded)))
            before = start
            while before and text[before - 1].isspace():
                before -= 1
            if before in last:
                self.chain.append((last[before], here))
            last[end] = here
        self.hubs += len(folded)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Features, known labels, chain edges, and the hub of each node or -1 where it is alone."""
        hub_of = np.array(self.hub_of, np.int64)
        hub_of[np.bincount(hub_of, minlength=self.hubs)[hub_of] < 2] = -1
        return np.array(self.features), np.array([n[3] for n in self.nodes]), np.array(self.chain, np.int64).reshape(-1, 2), hub_of


@lru_cache(maxsize=1)
def _made_documents(seed: int = 3, count: int = 600) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts made by rule with the spans of their personal data, clear and unclear, and of numbers that are none."""
    rng, out = random.Random(seed), []
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = rng.choice(("4", "51", "53", "37", "6011"))
        body += digits((14 if body == "37" else 15) - len(body))
        return body + next(c for c in "0123456789" if luhn(body + c))

    grouped = lambda c: rng.choice(" -").join(c[i : i + 4] for i in range(0, len(c), 4)) if rng.random() < 0.5 else c
    for _ in range(count):
        text, spans = "", []

        def say(piece: str, kind: str | None = None) -> None:
            nonlocal text
            if kind:
                spans.append((kind, len(text), len(text) + len(piece)))
            text += piece + " "

        plan = [rng.choice(("phone", "order", "cards", "spelled", "ip", "order twice", "table", "mail", "year")) for _ in range(rng.randint(1, 4))]
        later = []
        for kind in plan:
            say(" ".join(rng.choice(("call", "see", "the", "for", "of", "item", "by")) for _ in range(rng.randint(1, 6))))
            if kind == "phone":
                land, number = rng.choice(("1", "44", "49")), digits(9)
                say(f"+{land} ({number[:3]}) {number[3:6]}-{number[6:]}", "phone")
                for _ in range(rng.randint(0, 2)):
                    later.append((rng.choice((land + number, "00" + land + number, "0" + number, f"{number[:3]}-{number[3:6]}-{number[6:]}")), "phone"))
            elif kind in ("order", "order twice"):
                number = rng.choice((digits(10), digits(12), digits(16), f"{digits(3)}-{digits(3)}-{digits(4)}", f"A{digits(8)}"))
                later += [(number, None)] * (2 if kind == "order twice" else 1)
            elif kind == "cards":
                for c in [card() for _ in range(rng.randint(1, 3))]:
                    say(grouped(c), "card")
                if rng.random() < 0.5:
                    say(digits(rng.randint(2, 4)))
            elif kind == "spelled":
                name, host = rng.choice(("jane.doe", "j7", "bob")), rng.choice(("example", "mail-host"))
                say(rng.choice((f"{name}[at]{host}[dot]org", f"{name} (at) {host} (dot) org", f"{name}[at]{host}.org")), "email")
            elif kind == "ip":
                say(".".join(str(rng.randint(0, 255)) for _ in range(4)), "ip")
            elif kind == "table":
                say(" ".join(digits(rng.randint(1, 6)) for _ in range(rng.randint(4, 12))))
            elif kind == "mail":
                say(f"user{digits(2)}@example.com", "email")
            else:
                say(rng.choice(("2024-01-31", "v1.2.3", "12:30", "@home", "3.14159265358", "1999")))
        rng.shuffle(later)
        for piece, kind in later:
            say("and " * rng.randint(1, 5) + "also")
            say(piece, kind)
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def fit_field(steps: int = 400, rate: float = 0.5, ridge: float = 2e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unary, chain and skip weights by pseudo-likelihood: each node given its neighbours' and its hub's label."""
    graph, want = Graph(), []
    for i, (text, spans) in enumerate(_made_documents()):
        failed: list[tuple[int, int]] = []
        first = len(graph.nodes)
        graph.add(i, text, base_spans(text, failed), failed)
        of = {(s, e): KINDS.index(k) + 1 for k, s, e in spans}
        want += [known or of.get((s, e), 0) for _, s, e, known in graph.nodes[first:]]
    x, known, chain, hub_of = graph.arrays()
    y, k = np.array(want), len(LABELS)
    one = np.eye(k)[y]
    hub_label = np.zeros(graph.hubs, np.int64)
    tied = np.flatnonzero(hub_of >= 0)
    np.maximum.at(hub_label, hub_of[tied], y[tied])
    target = np.flatnonzero(known == 0)
    hub = np.zeros((len(y), k))
    hub[tied] = np.eye(k)[hub_label[hub_of[tied]]]
    left, right = np.zeros((len(y), k)), np.zeros((len(y), k))
    np.add.at(left, chain[:, 1], one[chain[:, 0]])
    np.add.at(right, chain[:, 0], one[chain[:, 1]])
    weights = [np.zeros((x.shape[1], k)), np.zeros((k, k)), np.zeros((k, k))]
    speed = [np.zeros_like(w) for w in weights]
    for _ in range(steps):
        w, c, s = weights
        z = x @ w + left @ c + right @ c.T + hub @ s
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = np.zeros_like(p)
        d[target] = (one - p)[target] / len(target)
        grad = [x.T @ d, left.T @ d + (right.T @ d).T, hub.T @ d]
        grad[2] = (grad[2] + grad[2].T) / 2
        for i, g in enumerate(grad):
            speed[i] = 0.9 * speed[i] + rate * (g - ridge * weights[i])
            weights[i] = weights[i] + speed[i]
    return tuple(weights)


def marginals(u: np.ndarray, chain: np.ndarray, hub_of: np.ndarray, hubs: int, chain_weights: np.ndarray, skip_weights: np.ndarray) -> np.ndarray:
    """Damped loopy sum-product; ``u``: unary scores; ``chain``: edges (left, right); ``hub_of``: -1 or hub."""
    n, k = u.shape
    a, b = chain[:, 0], chain[:, 1]
    right, left = np.zeros((len(chain), k)), np.zeros((len(chain), k))
    tied = np.flatnonzero(hub_of >= 0)
    up, down = np.zeros((len(tied), k)), np.zeros((len(tied), k))

    def passed(m: np.ndarray, pot: np.ndarray) -> np.ndarray:
        x = m[:, :, None] + pot[None]
        top = x.max(1)
        out = top + np.log(np.exp(x - top[:, None]).sum(1))
        return out - out.max(1, keepdims=True)

    def beliefs() -> np.ndarray:
        x = u.copy()
        np.add.at(x, b, right)
        np.add.at(x, a, left)
        x[tied] += down
        return x

    for _ in range(ITERATIONS):
        x = beliefs()
        if len(chain):
            new_right, new_left = passed(x[a] - left, chain_weights), passed(x[b] - right, chain_weights.T)
            right, left = DAMPING * right + (1 - DAMPING) * new_right, DAMPING * left + (1 - DAMPING) * new_left
        if len(tied):
            up = DAMPING * up + (1 - DAMPING) * passed(x[tied] - down, skip_weights)
            hub = np.zeros((hubs, k))
            np.add.at(hub, hub_of[tied], up)
            down = DAMPING * down + (1 - DAMPING) * passed(hub[hub_of[tied]] - up, skip_weights.T)
    x = beliefs()
    p = np.exp(x - x.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def annotate(texts: list[str | None], field: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> list[list[tuple[str, int, int, bool]]]:
    """For each text its spans (kind, start, end, whether a base rule found it)."""
    results: list[list[tuple[str, int, int, bool]]] = []
    graph = Graph()
    for i, text in enumerate(texts):
        failed: list[tuple[int, int]] = []
        base = base_spans(text or "", failed)
        results.append([(*s, True) for s in base])
        if text:
            graph.add(i, text, base, failed)
    if not graph.nodes:
        return results
    weights, chain_weights, skip_weights = field or fit_field()
    x, known, chain, hub_of = graph.arrays()
    u = x @ weights
    sure = np.flatnonzero(known)
    u[sure] = 0.0
    u[sure, known[sure]] = EVIDENCE
    p = marginals(u, chain, hub_of, graph.hubs, chain_weights, skip_weights)
    best, most = p.argmax(1), p.max(1)
    new = np.flatnonzero((known == 0) & (best > 0) & (most > 0.5))
    taken: dict[int, bytearray] = {}  # which places of a text lie in a span
    for n in new[np.argsort(-np.round(most[new], 6), kind="stable")]:
        i, start, end, _ = graph.nodes[n]
        if i not in taken:
            taken[i] = bytearray(len(texts[i]))
            for _, s, e, _ in results[i]:
                taken[i][s:e] = b"\1" * (e - s)
        if not any(taken[i][start:end]):
            taken[i][start:end] = b"\1" * (end - start)
            results[i].append((KINDS[best[n] - 1], start, end, False))
    return [sorted(r, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) for r in results]


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
    T.StructField("base", T.BooleanType()),
]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find_pii(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) and ``pii_spans``, an array of spans in code points."""
    field = fit_field()

    def make(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = annotate(batch.column(batch.schema.get_field_index(text)).to_pylist(), field)
            spans = [[{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in r] for r in found]
            yield batch, {"pii_spans": pa.array(spans, type=_ARROW_SPANS)}

    return with_columns(df, make, T.StructType([T.StructField("pii_spans", SPANS)]), keep or df.columns)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every span of ``text`` replaced by ``[KIND]``; overlapping spans become one mark."""
    field = fit_field()
    fields = T.StructType([T.StructField("redacted", T.StringType()), T.StructField("n_redacted", T.LongType())])

    def clean(value: str | None, spans: list[tuple[str, int, int, bool]]) -> str | None:
        if not spans:
            return value
        out, pos = [], 0
        for kind, start, end, _ in spans:
            if start >= pos:
                out += [value[pos:start], f"[{kind.upper()}]"]
            pos = max(pos, end)
        return "".join([*out, value[pos:]])

    def make(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found = annotate(texts, field)
            yield batch, {
                "redacted": pa.array([clean(t, s) for t, s in zip(texts, found, strict=True)], pa.string()),
                "n_redacted": pa.array([len(s) for s in found], pa.int64()),
            }

    return with_columns(df, make, fields, df.columns)


def _joined(spans):
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _count(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts and the hash of base spans, and all spans as text."""
    spans = F.col("pii_spans")
    base = F.filter(spans, lambda s: s["base"])
    return found.select(
        id_column,
        *[_count(base, k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )
