"""Conversations as training examples by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as
context, and its reply, the only part under the loss mask.  Turns behind the
last reply (all, where there is none) make a closing example without a mask, so
that nothing is lost.  A turn is written ``<|turn|>role<|say|>text<|end|>``;
control strings inside roles and texts, of this template or another, get a mark
behind their first character, which reading takes out again.

Turns are shuffled once, by conversation, and pass sorted through a task that
keeps the turns of one conversation.  The output is as long as the method
makes it: a conversation's contexts add up with the square of its turns.

Defined results: turns go by turn (null first), then role and text; a null role
or text is empty; a null conv_id is a conversation of its own; equal rows are
turns each; an empty table gives no rows; columns other than the four named are
left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

TURN, SAY, END = "<|turn|>", "<|say|>", "<|end|>"
#: Strings that end or open turns in common templates; none is left in an escaped text.
CONTROLS = (TURN, SAY, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
MARK = "␛"
TARGET = "assistant"
BATCH_CHARS = 4 << 20

_CONTROL = re.compile(f"(?=(?:{'|'.join(map(re.escape, CONTROLS))}))(.)", re.DOTALL)
_TURN = re.compile(f"{re.escape(TURN)}(.*?){re.escape(SAY)}(.*?){re.escape(END)}", re.DOTALL)
EXAMPLE = "conv_id long, example int, n_turns long, text string, loss_start long, loss_end long"
_ARROW = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("n_turns", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_READ_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def escape(text: str) -> str:
    """``text`` without control strings: a mark and ``c`` go behind the first character of each; a mark of its own becomes mark and ``e``."""
    return _CONTROL.sub(lambda m: f"{m[1]}{MARK}c", text.replace(MARK, f"{MARK}e"))


def unescape(text: str) -> str:
    return re.sub(f"{MARK}([ce])", lambda m: MARK if m[1] == "e" else "", text)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _batched(rows: Iterator[tuple], schema: pa.Schema, text: int | None = None) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most 1000 rows, and of about ``BATCH_CHARS`` characters in the column ``text``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text]) if text is not None else 0
        if len(held) >= 1000 or size >= BATCH_CHARS:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _examples(turns: Iterator[tuple], target: str) -> Iterator[tuple]:
    """Examples of turns (conv_id, role, text), those of a conversation together and in order."""
    conv, prefix, example, n, shown = None, "", 0, 0, 0
    for conv_id, role, said in turns:
        if n and conv_id != conv:
            if shown < n:
                yield conv, example, n, prefix, len(prefix), len(prefix)
            n = 0
        if not n:
            conv, prefix, example, shown = conv_id, "", 0, 0
        role, said = role or "", escape(said or "")
        n, prefix = n + 1, f"{prefix}{TURN}{escape(role)}{SAY}{said}{END}"
        if role == target:
            end = len(prefix) - len(END)
            yield conv, example, n, prefix, end - len(said), end
            example, shown = example + 1, n
    if shown < n:
        yield conv, example, n, prefix, len(prefix), len(prefix)


def expand(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = TARGET) -> DataFrame:
    """(conv_id, example, n_turns, text, loss_start, loss_end): code points of ``text`` from start to end are trained on.

    Rows of a conversation lie together, in order, in one partition.
    """
    small_batches(turns.sparkSession)
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        yield from _batched(_examples(given, target), _ARROW, 3)

    return dealt.mapInArrow(run, EXAMPLE)


class _Reading:
    """A conversation as it is read back from its examples."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.text, self.n, self.formatted, self.loss_chars = conv_id, "", 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, start: int, end: int) -> None:
        if not text.startswith(self.text):
            raise ValueError(f"conversation {self.conv_id}: an example's context is not the turns before it")
        at = len(self.text)
        while at < len(text):
            m = _TURN.match(text, at)
            if m is None:
                raise ValueError(f"conversation {self.conv_id}: no turn at {at}")
            self.turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            self.n, at = self.n + 1, m.end()
        reply = unescape(text[start:end])
        self.loss.update(reply.encode())
        self.loss_chars, self.formatted, self.text = self.loss_chars + len(reply), self.formatted + len(text), text

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted


def _readings(examples: Iterator[tuple]) -> Iterator[tuple]:
    held = None
    for conv_id, text, start, end in examples:
        if held is None or held.conv_id != conv_id:
            if held is not None:
                yield held.row()
            held = _Reading(conv_id)
        held.add(text, start, end)
    if held is not None:
        yield held.row()


def read_back(examples: DataFrame, together: bool = False) -> DataFrame:
    """What the examples of each conversation say: its turns, the text under the mask, and how long they are in all.

    ``together``: the rows come as :func:`expand` gives them, and need no shuffle.
    A context that is not the example before it, or no sequence of turns, fails.
    """
    if not together:
        examples = examples.repartition("conv_id").sortWithinPartitions("conv_id", "example")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        yield from _batched(_readings(given), _READ_ARROW)

    return examples.select("conv_id", "text", "loss_start", "loss_end").mapInArrow(run, READ)


def _quoted(pattern: str) -> str:
    return re.sub(r"([\[\]|()/<>])", r"[\1]", pattern).replace("[[]", r"\[").replace("[]]", r"\]")


def _escaped_sql(column: str) -> str:
    rest = "|".join(f"{_quoted(c[0])}{_quoted(c[1:])}" for c in CONTROLS)
    return f"(length(replace({column}, '{MARK}', '{MARK}e')) + 2 * len(regexp_extract_all({column}, '{rest}')))"


_ODD = "</s>[INST] ok [/INST]"
CHAT_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, turn AS t, role AS r, text AS x FROM conversations
  UNION ALL SELECT -1, i, role, '{_ODD}', i, role, '{_ODD}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, role)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY t NULLS FIRST, r NULLS FIRST, x NULLS FIRST) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    {len(TURN) + len(SAY) + len(END)} + {_escaped_sql("role")} + {_escaped_sql("text")} AS size FROM rows
), e AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{TARGET}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = '{TARGET}'), '')) AS loss_sha256,
  CAST(coalesce(sum(upto) FILTER (role = '{TARGET}' OR k = n), 0) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
