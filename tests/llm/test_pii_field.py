"""The random field: marginals against enumeration, and what only the skip edges find."""

import itertools
import random
import time

import numpy as np

from newsloom.llm import pii


def enumerated(u, chain, hub_of, hubs, c, s):
    """Exact marginals over all labellings, hubs included."""
    n, k = u.shape
    used = sorted({h for h in hub_of if h >= 0})
    total = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n + len(used)):
        z = sum(u[i, labels[i]] for i in range(n)) + sum(c[labels[a], labels[b]] for a, b in chain)
        z += sum(s[labels[i], labels[n + used.index(h)]] for i, h in enumerate(hub_of) if h >= 0)
        for i in range(n):
            total[i, labels[i]] += np.exp(z)
    return total / total.sum(1, keepdims=True)


def small(rng, n, edges, hub_of):
    u = rng.normal(0, 1.5, (n, 3))
    c, s = rng.normal(0, 0.7, (3, 3)), rng.normal(0, 0.7, (3, 3))
    s = (s + s.T) / 2
    args = u, np.array(edges, np.int64).reshape(-1, 2), np.array(hub_of), 2, c, s
    return pii.marginals(*args), enumerated(u, edges, hub_of, 2, c, s)


def test_marginals_are_exact_on_trees(monkeypatch):
    monkeypatch.setattr(pii, "ITERATIONS", 60)
    rng = np.random.default_rng(1)
    for n, edges, hub_of in [(3, [(0, 1), (1, 2)], [-1] * 3), (4, [(0, 1)], [-1, 0, 0, 0]), (2, [], [0, 0]), (5, [(0, 1), (3, 4)], [-1, 0, 0, 0, -1])]:
        for _ in range(5):
            got, want = small(rng, n, edges, hub_of)
            assert np.allclose(got, want, atol=1e-6)


def test_marginals_are_near_on_loops(monkeypatch):
    monkeypatch.setattr(pii, "ITERATIONS", 60)
    rng = np.random.default_rng(2)
    off = [np.abs(np.subtract(*small(rng, 4, [(0, 1), (1, 2), (2, 3)], [0, -1, 0, 0]))).max() for _ in range(20)]
    assert np.median(off) < 0.05


def found(text, field=None):
    return [(k, text[s:e]) for k, s, e, base in pii.annotate([text], field)[0] if not base]


def test_skip_edges_change_the_result():
    w, c, s = pii.fit_field()
    text = "call +1 (555) 555-1234 today, or see the list where 15555551234 is named, far from " + "the start " * 50 + "0015555551234"
    assert [x for _, x in found(text)] == ["15555551234", "0015555551234"] and {k for k, _ in found(text)} == {"phone"}
    assert not any(x == "15555551234" for _, x in found(text, (w, c, 0 * s)))
    assert found("order 15555551234 and again 15555551234") == []


def test_what_the_rules_lose():
    assert found("4111 1111 1111 1111 5500 0055 5555 5559") == [("card", "4111 1111 1111 1111"), ("card", "5500 0055 5555 5559")]
    assert found("4111 1111 1111 1111 2024") == [("card", "4111 1111 1111 1111")]
    assert found("jane[at]example[dot]com, or j7 (at) ex-1 (dot) org") == [("email", "jane[at]example[dot]com"), ("email", "j7 (at) ex-1 (dot) org")]
    assert found("") == found("٤١١١١١١١١١١١١١١١") == found("1 2 3 4 5 6 7 8 9 10 11 12 13 14 15") == found("x" * 5000 + "1" * 5000) == []
    assert found("name-" + "a" * 100 + "[at]example[dot]com")[0][0] == "email"


def test_learned_on_one_sample_right_on_another():
    docs = pii._made_documents(99, 200)
    hit = n = extra = 0
    for (_, gold), spans in zip(docs, pii.annotate([t for t, _ in docs]), strict=True):
        gold, spans = set(gold), {x[:3] for x in spans}
        hit, n, extra = hit + len(gold & spans), n + len(gold), extra + len(spans - gold)
    assert hit > 0.95 * n and extra < 0.08 * n


def test_base_spans_stay():
    rng = random.Random(4)
    parts = ["a.b@c.de", "1.2.3.4", "4111111111111111", "5500005555555559", "+1 (555) 555-1234", "15555551234", "x[at]y.de", "word", "2024"]
    for _ in range(500):
        text = " ".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        (spans,) = pii.annotate([text])
        assert [s[:3] for s in spans if s[3]] == pii.base_spans(text)
        new = [s for s in spans if not s[3]]
        assert not any(a[1] < b[2] and b[1] < a[2] for a in new for b in spans if a is not b)


def test_long_texts_take_time_by_their_length():
    piece = "call 15555551234 or +1 (555) 555-1234, card 4111 1111 1111 1111 2024, jane[at]example[dot]com 10.0.0.1 "
    pii.annotate([piece])

    def seconds(times):
        start = time.process_time()
        (spans,) = pii.annotate([piece * times])
        assert len(spans) >= 4 * times
        return time.process_time() - start

    short, long = seconds(500), seconds(4000)
    assert long < 8 * short * 2.5
