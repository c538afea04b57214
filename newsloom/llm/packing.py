"""Bounded-space online packing of documents into token sequences.

Each task keeps a fixed number of open windows.  A document that is longer than
a window first fills whole windows.  What remains goes best-fit into the open
window it leaves the least room in; if none has room, the fullest window is
emitted, topped up with a cut piece where its gap is worth one, and the rest is
placed anew.  Windows still open at a task's end are leftovers: they travel
with their ids to a merge that packs the leftovers of ``fan_in`` tasks by the
same rule, and so on until one task is left.  What is then still open is closed
up into full windows and, for the last one, sequences at powers of two, which
need no padding.

Defined results: a null or empty text is the end id alone; each row is packed
by itself, repeated or not; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged
from .tokens import Encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, place int, part long, ids binary"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("place", pa.int32()), ("part", pa.int64()), ("ids", pa.binary()),
])


class Packer:
    """Pieces are (doc_id, start, ids as bytes, doc_tokens)."""

    def __init__(self, first_id: int, window: int, open_windows: int, least_piece: int):
        self.next_id, self.window, self.most, self.least = first_id, window, open_windows, least_piece
        self.gaps: list[tuple[int, int]] = []  # (room left, number), sorted
        self.held: dict[int, list] = {}
        self.numbers = 0
        self.rows: list[tuple] = []

    def emit(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next_id, offset, None, None, None))
            offset += n
        self.next_id += 1

    def _put(self, at: int, piece: tuple) -> None:
        room, number = self.gaps.pop(at)
        self.held[number].append(piece)
        room -= len(piece[2]) // 4
        if room:
            insort(self.gaps, (room, number))
        else:
            self.emit(self.held.pop(number))

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        view = memoryview(ids)
        while len(view):
            n = len(view) // 4
            if n >= self.window:
                take = self.window
                self.emit([(doc, start, bytes(view[: 4 * take]), total)])
            else:
                at = bisect_left(self.gaps, (n, -1))
                if at < len(self.gaps):
                    take = n
                    self._put(at, (doc, start, bytes(view), total))
                elif len(self.gaps) < self.most:
                    take = n
                    self.held[self.numbers] = [(doc, start, bytes(view), total)]
                    insort(self.gaps, (self.window - n, self.numbers))
                    self.numbers += 1
                else:
                    room, number = self.gaps[0]  # the fullest
                    take = 0
                    if room >= self.least:
                        take = room
                        self._put(0, (doc, start, bytes(view[: 4 * take]), total))
                    else:
                        self.gaps.pop(0)
                        self.emit(self.held.pop(number))
            start += take
            view = view[4 * take :]

    def leftovers(self) -> Iterator[list]:
        for _, number in self.gaps:
            yield self.held[number]

    def close(self) -> None:
        """Full windows of what is open, then sequences at powers of two."""
        pieces = [p for held in self.leftovers() for p in held]
        self.gaps, self.held = [], {}
        left, at, used = sum(len(p[2]) // 4 for p in pieces), 0, 0
        while left:
            size = min(self.window, 1 << (left.bit_length() - 1))
            left -= size
            sequence = []
            while size:
                doc, start, ids, total = pieces[at]
                n = min(size, len(ids) // 4 - used)
                sequence.append((doc, start + used, ids[4 * used : 4 * (used + n)], total))
                size, used = size - n, used + n
                if used == len(ids) // 4:
                    at, used = at + 1, 0
            self.emit(sequence)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _drained(packer: Packer, part: int, last: bool) -> Iterator[pa.RecordBatch]:
    if last:
        packer.close()
    rows, place = packer.rows, 0
    if not last:
        for held in packer.leftovers():
            for doc, start, ids, total in held:
                rows.append((doc, start, None, None, total, None, None, place, part, ids))
                place += 1
    for i in range(0, len(rows), 5000):
        yield _batch(rows[i : i + 5000])
    packer.rows = []


def pack(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 2,
    window: int = 4096, open_windows: int = 32, least_piece: int = 16, fan_in: int = 32,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece."""
    small_batches(df.sparkSession)
    end = end_id.to_bytes(4, "little")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = Encoder(tokenizer)
        packer = Packer(part << 32, window, open_windows, least_piece)
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode(value or "") + end
                packer.add(doc, 0, ids, len(ids) // 4)
            if packer.rows:
                yield _batch(packer.rows)
                packer.rows = []
        yield from _drained(packer, part, False)

    done, level = [], 0
    stage = staged(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(first, SCHEMA), "packed")
    while True:
        done.append(stage.where("sequence_id is not null"))
        left = stage.where("sequence_id is null")
        most = left.agg(F.max("part")).first()[0]
        if most is None:
            break
        groups, level = most // fan_in + 1, level + 1

        def merge(batches: Iterator[pa.RecordBatch], last: bool = groups == 1, level: int = level) -> Iterator[pa.RecordBatch]:
            packer, group = None, 0
            for batch in batches:
                for row in batch.to_pylist():
                    if packer is None or row["part"] // fan_in != group:
                        if packer is not None:
                            yield from _drained(packer, group, last)
                        group = row["part"] // fan_in
                        packer = Packer(level << 56 | group << 32, window, open_windows, least_piece)
                    packer.add(row["doc_id"], row["start"], row["ids"], row["doc_tokens"])
            if packer is not None:
                yield from _drained(packer, group, last)

        dealt = left.repartition(groups, F.floor(F.col("part") / fan_in)).sortWithinPartitions("part", "place")
        stage = staged(dealt.mapInArrow(merge, SCHEMA), "packed")
    return reduce(DataFrame.unionByName, done).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
