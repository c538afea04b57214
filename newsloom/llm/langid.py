"""Language identification by a byte convolutional network.

UTF-8 bytes are embedded, filters of several widths run over fixed-length
windows, each filter's maximum over a window is kept, and a softmax layer
scores the languages.  The network is trained in numpy on the driver, on a
bounded sample of labelled rows (``Settings.train_docs`` texts, whole ones):
every window of them is trained on, each epoch taking its share of a long text's
windows.  Prediction covers every window of every whole text and averages the
windows' log probabilities by their letters.

Defined results: a text that is null or has no letter is ``und`` with score 0;
without any labelled row every text is ``und``; repeated rows are scored one by
one, and learned from once; a tie goes to the language whose name comes first;
columns of the input named like a new one give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, with_columns


@dataclass(frozen=True)
class Settings:
    window: int = 96
    embed: int = 4
    widths: tuple[int, ...] = (2, 3, 4, 5)
    filters: int = 8
    train_docs: int = 2000
    epochs: int = 8
    least_windows: int = 60_000  # shown in training; a small sample is gone through again
    rate: float = 0.01
    batch: int = 128
    seed: int = 7


@dataclass
class Model:
    settings: Settings
    langs: list[str]
    embedding: np.ndarray  # 256 x embed; byte 0 pads and is all zero
    filters: np.ndarray  # max width * embed x all filters; a narrow filter's far part is zero
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def _windows(data: bytes, size: int, wide: int) -> np.ndarray:
    """``data`` in windows of ``size`` that overlap by ``wide`` - 1 bytes, so that no filter position is lost."""
    step = size - wide + 1
    count = max(1, -(-(len(data) - wide + 1) // step))
    buffer = np.zeros((count - 1) * step + size, dtype=np.uint8)
    buffer[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(buffer, size)[::step]


def _columns(model_embedding: np.ndarray, windows: np.ndarray, wide: int) -> np.ndarray:
    """im2col: a row for each window and position, the embedded bytes of ``wide`` places."""
    x = model_embedding[windows]  # n, size, embed
    n, size, e = x.shape
    view = np.lib.stride_tricks.sliding_window_view(x.reshape(n, size * e), wide * e, axis=1)[:, ::e]
    return np.ascontiguousarray(view).reshape(n * (size - wide + 1), wide * e)


def _letters(windows: np.ndarray) -> np.ndarray:
    low = windows | 0x20
    return (((low >= 97) & (low <= 122)) | (windows >= 0x80)).sum(1)


def log_probabilities(model: Model, windows: np.ndarray) -> np.ndarray:
    """Log softmax of each window, in blocks of bounded memory."""
    s, wide, out = model.settings, max(model.settings.widths), []
    positions = s.window - wide + 1
    for i in range(0, len(windows), 256):
        block = windows[i : i + 256]
        conv = _columns(model.embedding, block, wide) @ model.filters
        top = np.maximum(conv.reshape(len(block), positions, -1).max(1) + model.bias, 0)
        z = top @ model.out + model.out_bias
        z -= z.max(1, keepdims=True)
        out.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
    return np.concatenate(out)


def fit(samples: list[tuple[str, bytes]], settings: Settings = Settings()) -> Model:
    """Train on (language, bytes of a text) pairs with Adam; texts weigh less by the root of their windows."""
    s, rng, wide = settings, np.random.default_rng(settings.seed), max(settings.widths)
    langs = sorted({lang for lang, _ in samples})
    total = s.filters * len(s.widths)
    mask = np.zeros((wide * s.embed, total), dtype=np.float32)
    for k, w in enumerate(s.widths):
        mask[: w * s.embed, k * s.filters : (k + 1) * s.filters] = 1
    params = {
        "e": rng.normal(0, 0.5, (256, s.embed)).astype(np.float32),
        "f": (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32),
        "b": np.zeros(total, np.float32),
        "o": rng.normal(0, 0.2, (total, max(1, len(langs)))).astype(np.float32),
        "c": np.zeros(max(1, len(langs)), np.float32),
    }
    params["e"][0] = 0
    if len(langs) > 1:
        windows = [_windows(data, s.window, wide) for _, data in samples]
        x, owner = np.concatenate(windows), np.repeat(np.arange(len(samples)), [len(w) for w in windows])
        first = np.concatenate([np.arange(len(w)) for w in windows])
        y = np.array([langs.index(lang) for lang, _ in samples])[owner]
        share = np.bincount(y, minlength=len(langs)) / len(y)
        # A text of no more windows than epochs gives them all in each; a longer one a share.
        whole = np.bincount(owner)[owner] <= s.epochs
        weight = (1 / np.maximum(share, 1e-6) ** 0.5)[y] / np.maximum(1, np.bincount(owner) / s.epochs)[owner] ** 0.5
        weight = (weight / weight.mean()).astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in params.items()}
        v = {k: np.zeros_like(v) for k, v in params.items()}
        positions, step = s.window - wide + 1, 0
        shown = sum(int((whole | (first % s.epochs == e)).sum()) for e in range(s.epochs))
        epochs = s.epochs * max(1, min(32, s.least_windows // max(1, shown)))
        for epoch in range(epochs):
            order = rng.permutation(np.flatnonzero(whole | (first % s.epochs == epoch % s.epochs)))
            for i in range(0, len(order), s.batch):
                at = order[i : i + s.batch]
                n = len(at)
                cols = _columns(params["e"], x[at], wide)
                conv = (cols @ params["f"]).reshape(n, positions, total)
                where = conv.argmax(1)
                top = np.take_along_axis(conv, where[:, None], 1)[:, 0] + params["b"]
                hidden = np.maximum(top, 0)
                z = hidden @ params["o"] + params["c"]
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                d = p
                d[np.arange(n), y[at]] -= 1
                d *= weight[at, None] / n
                grad = {"o": hidden.T @ d, "c": d.sum(0)}
                dh = (d @ params["o"].T) * (top > 0)
                grad["b"] = dh.sum(0)
                # Only the position of each maximum takes part.
                picked = cols.reshape(n, positions, -1)[np.arange(n)[:, None], where]  # n, total, wide * embed
                grad["f"] = np.einsum("nt,ntk->kt", dh, picked) * mask
                back = dh[:, :, None] * params["f"].T[None]  # n, total, wide * embed
                places = where[:, :, None] + np.arange(wide)
                byte = x[at][np.arange(n)[:, None, None], places]
                ge = np.zeros_like(params["e"])
                np.add.at(ge, byte.ravel(), back.reshape(-1, s.embed))
                ge[0] = 0
                grad["e"] = ge
                step += 1
                rate = s.rate * (1 - 0.9 * epoch / epochs)
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    params[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(s, langs, params["e"], params["f"], params["b"], params["o"], params["c"])


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and its probability for each whole text."""
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    if not model.langs:
        return out
    wide = max(model.settings.widths)
    pending, owners, size = [], [], 0
    sums = np.zeros((len(texts), len(model.langs)))
    seen = np.zeros(len(texts))

    def flush() -> None:
        if pending:
            windows = np.concatenate(pending)
            weight = _letters(windows).astype(np.float64) + 1e-3
            who = np.repeat(owners, [len(w) for w in pending])
            np.add.at(sums, who, log_probabilities(model, windows) * weight[:, None])
            np.add.at(seen, who, weight)

    for i, text in enumerate(texts):
        if text and any(map(str.isalpha, text)):
            w = _windows(text.encode("utf-8", "replace"), model.settings.window, wide)
            pending.append(w)
            owners.append(i)
            size += len(w)
            if size >= 8192:
                flush()
                pending, owners, size = [], [], 0
    flush()
    for i in np.flatnonzero(seen > 0):
        z = sums[i] / seen[i]
        p = np.exp(z - z.max())
        p /= p.sum()
        out[i] = (model.langs[int(p.argmax())], float(p.max()))
    return out


def training_texts(labelled: DataFrame, text: str, lang: str, settings: Settings = Settings()) -> list[tuple[str, bytes]]:
    """A bounded sample of different labelled texts, whole: those that come first by hash."""
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and length(text) > 0")
    sample = bounded_sample(rows, ["text", "lang"], settings.train_docs).collect()
    return sorted((r["lang"], r["text"].encode("utf-8", "replace")) for r in sample if any(map(str.isalpha, r["text"])))


FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def identify(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) with ``lang_pred`` and ``score``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = predict(shared.value, batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield batch, {"lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([x for _, x in found], pa.float64())}

    return with_columns(df, make, FIELDS, keep or df.columns)
