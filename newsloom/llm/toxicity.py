"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton.

Texts are folded first: lower case, homoglyphs of other scripts to Latin
letters, then digits and signs in runs that touch a letter to the letters they
stand for.  The lexicon is learned from labelled rows as words (and word beginnings) whose
share among toxic texts is far above their share among the others, weighted by
smoothed log odds.  Exception phrases, the lexicon word with the word before
or after it, take a match back where the labels show them in clean texts only,
beside a few fixed ones.  The weights found in a whole text are summed and
normalised by its length; a logistic curve fitted on the sample turns both into
a score between 0 and 1.

Fitting uses a bounded sample of different labelled texts
(``Settings.train_docs``), which bounds the lexicon as well; all scoring covers
whole texts.  Defined results: a null or empty text has no match and gets the
score of a text without any; without labelled rows of both kinds the fixed
lexicon decides; repeated rows are scored one by one, and learned from once; an
id or a text with clashing labels counts as toxic; columns of the input named
like a new one give way to it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, staged, unstage, with_columns

#: Letters of other scripts that look like Latin ones. Fixed values.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ո": "n", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ν": "v", "ι": "i",
    "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ɡ": "g", "ı": "i", "ⅼ": "l",
}
#: Digits and signs that stand for letters. Fixed values.
DIGITS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}
#: Lexicon used before any label is seen, and phrases that are never meant badly. Fixed values.
FIXED_LEXICON = {w: 4.0 for w in ("idiot", "moron", "stupid", "scum", "trash", "worthless", "pathetic", "disgusting", "loser", "clown")}
FIXED_EXCEPTIONS = ("trash can", "trash bag", "clown fish", "clown nose", "sore loser bracket", "stupidity tax")

_TABLE = str.maketrans({**HOMOGLYPHS, "​": "", "‌": "", "‍": "", "­": ""})
_DIGIT_TABLE = str.maketrans(DIGITS)
_DIGIT = re.compile(r"(?<=[^\W\d_])[0-9]+|[0-9]+(?=[^\W\d_])")
_SIGN = re.compile(r"(?<=\w)[@$!|](?=\w)|(?<!\S)[@$](?=\w)")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    text = text.lower().translate(_TABLE)
    if any(s in text for s in SIGNS):
        text = _SIGN.sub(lambda m: SIGNS[m.group()], text)
    return _DIGIT.sub(lambda m: m.group().translate(_DIGIT_TABLE), text)


@dataclass(frozen=True)
class Settings:
    train_docs: int = 16000
    prefix: int = 5
    min_support: int = 3
    min_odds: float = 2.5


@dataclass
class Model:
    lexicon: dict[str, float]  # a word, or a word beginning with "*" at its end
    exceptions: set[str] = field(default_factory=set)
    curve: tuple[float, float, float, float] = (-3.0, 2.0, 0.5, 0.0)

    def matcher(self):
        import ahocorasick

        auto = ahocorasick.Automaton()
        for word in {entry.rstrip("*") for entry in self.lexicon}:
            whole, begins = self.lexicon.get(word), self.lexicon.get(word + "*")
            auto.add_word(word, (len(word), begins if whole is None else whole, begins))
        if len(auto):
            auto.make_automaton()
        return auto


def _beside(folded: str, start: int, end: int) -> tuple[str, str]:
    """The words before and after a match, if a single space parts them."""
    a, b = start - 1, end + 1
    if start and folded[a] == " ":
        while a and folded[a - 1].isalpha():
            a -= 1
    if folded[end : end + 1] == " ":
        while b < len(folded) and folded[b].isalpha():
            b += 1
    return folded[max(a, 0) : max(start - 1, 0)], folded[end + 1 : b]


def hits(model: Model, auto, folded: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, weight) of the entries found as words, or as beginnings of words."""
    size = len(folded)
    for last, (n, whole, begins) in auto.iter(folded):
        start, end = last - n + 1, last + 1
        if start and folded[start - 1].isalpha():
            continue
        weight = begins if end < size and folded[end].isalpha() else whole
        if weight is not None:
            yield start, end, weight


def _phrases(folded: str, start: int, end: int) -> list[str]:
    before, after = _beside(folded, start, end)
    word = folded[start:end]
    return [p for p in (f"{word} {after}" * bool(after), f"{before} {word}" * bool(before)) if p]


def measure(model: Model, auto, text: str | None) -> tuple[float, int, float]:
    """Sum of the weights matched in the whole text, its length in words of six characters, the largest weight."""
    if not text or not len(auto):
        return 0.0, 0, 0.0
    folded, total, most = fold(text), 0.0, 0.0
    for start, end, weight in hits(model, auto, folded):
        if model.exceptions and any(p in model.exceptions for p in _phrases(folded, start, end)):
            continue
        total += weight
        most = max(most, weight)
    return total, len(folded) // 6 + 1, most


def _inputs(total: float, words: int, most: float) -> tuple[float, float, float, float]:
    return 1.0, math.log1p(total), math.log1p(100 * total / max(words, 20)), min(most, 5.0)


def score(model: Model, measured: tuple[float, int, float]) -> float:
    z = sum(a * b for a, b in zip(model.curve, _inputs(*measured), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _features(text: str, prefix: int) -> tuple[set[str], set[str]]:
    words = set(_WORD.findall(fold(text)))
    begins = {w[:k] + "*" for w in words if len(w) > prefix for k in range(prefix, min(len(w), prefix + 4))}
    return words, begins


def _counted(sample: DataFrame, settings: Settings) -> DataFrame:
    """(feature, toxic texts, clean texts) over the sample, summed by Spark after each task has summed its own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, begins = _features(text, settings.prefix)
                counts[toxic].update(words)
                counts[toxic].update(begins)
        names = [*(counts[0].keys() | counts[1].keys())]
        for i in range(0, len(names), 20000):
            part = names[i : i + 20000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array([counts[1][n] for n in part], pa.int64()), pa.array([counts[0][n] for n in part], pa.int64())],
                names=["feature", "toxic", "clean"],
            )

    parts = sample.mapInArrow(count, "feature string, toxic long, clean long")
    return parts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _curve(rows: np.ndarray, labels: np.ndarray) -> tuple[float, float, float, float]:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(rows.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        g = rows.T @ (p - labels) + 0.1 * w
        h = (rows * (p * (1 - p))[:, None]).T @ rows + 0.1 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return tuple(float(x) for x in w)


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from ``labelled`` (text string, toxic int): a sample bounded by the caller, as ``labelled_sample``."""
    rows = labelled.where("text is not null and toxic is not null").select("text", F.col("toxic").cast("int").alias("toxic"))
    sample = staged(rows.groupBy("text").agg(F.max("toxic").alias("toxic")), "toxicity-sample")
    try:
        return _fit(sample, settings)
    finally:
        unstage(sample)


def _fit(sample: DataFrame, settings: Settings) -> Model:
    spark = sample.sparkSession
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not totals.get(1) or not totals.get(0):
        return Model(dict(FIXED_LEXICON), set(FIXED_EXCEPTIONS))
    bad, good = totals[1], totals[0]
    odds = F.log((F.col("toxic") + 0.1) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (good + 1))
    # What qualifies is bounded by the sample; a beginning counts only where no clean text has it.
    whole = F.col("feature").endswith("*") & ((F.col("clean") > 0) | (F.col("toxic") < 3 * settings.min_support))
    found = (
        _counted(sample, settings).where((F.col("toxic") >= settings.min_support) & ~whole)
        .select("feature", odds.alias("odds")).where(F.col("odds") >= settings.min_odds).orderBy("feature").collect()
    )
    words = {r["feature"]: r for r in found if not r["feature"].endswith("*")}
    begins = {r["feature"]: r for r in found if r["feature"].endswith("*")}
    # A beginning is worth an entry only if several words share it, else the word itself says as much.
    lexicon = {w: min(6.0, r["odds"]) for w, r in words.items()}
    shared_by = Counter(w[:k] + "*" for w in words for k in range(len(w) + 1))
    for b, r in begins.items():
        if shared_by[b] >= 3:
            lexicon[b] = 0.7 * min(6.0, r["odds"])
    for w, weight in FIXED_LEXICON.items():
        lexicon.setdefault(w, weight)
    model = Model(lexicon, set(FIXED_EXCEPTIONS))
    shared = spark.sparkContext.broadcast(model)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per text its measures; per task the phrases around matches, by label."""
        auto = shared.value.matcher()
        phrases = (Counter(), Counter())
        rows = []
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total, size, most = measure(shared.value, auto, text)
                rows.append(("", toxic, 1, total, size, most))
                seen, folded = set(), fold(text)
                for start, end, _ in hits(shared.value, auto, folded):
                    seen.update(_phrases(folded, start, end))
                phrases[toxic].update(seen)
        rows += [(p, t, c, 0.0, 0, 0.0) for t in (0, 1) for p, c in phrases[t].items()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["phrase", "toxic", "n", "total", "size", "most"])

    measured = sample.mapInArrow(learn, "phrase string, toxic int, n long, total double, size long, most double")
    measured = staged(measured, "toxicity-measures")
    harmless = (
        measured.where("phrase <> ''").groupBy("phrase")
        .agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"))
        .where("clean >= 3 and bad = 0")
    )
    model.exceptions |= {r["phrase"] for r in harmless.collect()}
    table = measured.where("phrase = ''").select("toxic", "total", "size", "most").orderBy("toxic", "total", "size", "most").collect()
    unstage(measured)
    model.curve = _curve(np.array([_inputs(r["total"], r["size"], r["most"]) for r in table]), np.array([r["toxic"] for r in table], dtype=float))
    return model


FIELDS = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def rate(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) with ``score`` and ``predicted``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(batches: Iterator[pa.RecordBatch]):
        auto = shared.value.matcher()
        for batch in batches:
            found = [score(shared.value, measure(shared.value, auto, t)) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield batch, {"score": pa.array(found, pa.float64()), "predicted": pa.array([int(x >= 0.5) for x in found], pa.int32())}

    return with_columns(df, make, FIELDS, keep or df.columns)


def labelled_sample(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(text, toxic) of at most ``train_docs`` different labelled texts, by hash.

    The labels are bounded first, which makes the broadcast safe, and then the texts, as a doc_id may repeat.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    few = bounded_sample(known, ["doc_id"], settings.train_docs)
    rows = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(few), "doc_id").select((-F.col("toxic")).alias("clean"), "text")
    return bounded_sample(rows, ["text"], settings.train_docs).select("text", (-F.col("clean")).alias("toxic"))  # toxic if any row is
