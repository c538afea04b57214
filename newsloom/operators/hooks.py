"""Functions from outside that turn batches into mentions, or texts into vectors.

What they are, a model's client or a rule, is the caller's; here is what holds
for all of them: nothing is asked for blank input, passing errors are tried
again, and a batch that fails for good is a row that says why, not a lost job.
Each call is one task's, so calls run side by side, and only rows come back.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MENTIONS = "batch_id long, ord long, category string, canonical_name string, aliases array<string>, evidence_title string, evidence_source string, error string"
_TEXTS = pa.list_(pa.string())
_MENTIONS = pa.schema([
    ("batch_id", pa.int64()), ("ord", pa.int64()), ("category", pa.string()), ("canonical_name", pa.string()), ("aliases", _TEXTS),
    ("evidence_title", pa.string()), ("evidence_source", pa.string()), ("error", pa.string()),
])


class HookError(RuntimeError):
    """A call that failed; one that is ``passing`` is tried again."""

    def __init__(self, message: str, passing: bool = False):
        super().__init__(message)
        self.passing = passing


def tried(call: Callable, value, retries: int, wait: float):
    """The call's answer; its last error after ``retries`` more tries, at once if it is no passing one."""
    for n in range(retries + 1):
        try:
            return call(value)
        except HookError as e:
            if not e.passing or n == retries:
                raise
            time.sleep(wait * 2**n)


def extracted(batches: DataFrame, extract: Callable[[str], list[dict]], retries: int = 2, wait: float = 0.1) -> DataFrame:
    """Mentions that ``extract`` finds in each batch's prompt, in its order; one row with ``error`` for a batch that fails.

    ``extract`` gives dicts with category and canonical_name, and aliases,
    evidence_title, evidence_source if known.  Mentions without a name or category
    are left out; so are batches with a null or blank prompt.
    """

    def rows_of(batch: int, prompt: str | None) -> list[dict]:
        if not prompt or not prompt.strip():
            return []
        try:
            found = tried(extract, prompt, retries, wait)
            if not isinstance(found, list) or not all(isinstance(m, dict) for m in found):
                raise HookError("the answer is no list of objects")
        except HookError as e:
            return [{"batch_id": batch, "error": str(e)}]
        named = [m for m in found if str(m.get("canonical_name") or "").strip() and m.get("category")]
        return [
            {"batch_id": batch, "ord": i, "category": m["category"], "canonical_name": m["canonical_name"], "aliases": list(m.get("aliases") or []), "evidence_title": m.get("evidence_title") or "", "evidence_source": m.get("evidence_source") or ""}
            for i, m in enumerate(named)
        ]

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in given:
            for batch, prompt in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if rows := rows_of(batch, prompt):
                    yield pa.RecordBatch.from_pylist(rows, schema=_MENTIONS)

    return batches.select(F.col("batch_id").cast("long"), F.col("prompt").cast("string")).mapInArrow(run, MENTIONS)


def embedded(items: DataFrame, embed: Callable[[list[str]], list[list[float]]], text: str = "text", at_once: int = 64, retries: int = 2, wait: float = 0.1) -> DataFrame:
    """``items`` with ``embedding`` of their ``text``, so many in one call; null where the text is null or blank.

    An answer of another length, or an error that lasts, fails the task: a vector that is missing would be taken for one that is not due.
    """
    schema = items.drop("embedding").withColumn("embedding", F.lit(None).cast("array<float>")).schema

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in given:
            texts = part.column(part.schema.get_field_index(text)).to_pylist()
            due = [i for i, t in enumerate(texts) if t and t.strip()]
            vectors: list = [None] * len(texts)
            for n in range(0, len(due), at_once):
                some = due[n : n + at_once]
                answer = tried(embed, [texts[i] for i in some], retries, wait)
                if len(answer) != len(some):
                    raise HookError(f"{len(answer)} vectors for {len(some)} texts")
                for i, v in zip(some, answer, strict=True):
                    vectors[i] = v
            kept = [c for c in part.schema.names if c != "embedding"]
            columns = [part.column(part.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*kept, "embedding"])

    return items.mapInArrow(run, schema)
