"""Packing of tokenised documents into fixed-length sequences, online in bounded space.

Each input partition keeps ``open_windows`` windows. Full-length pieces of a document go out
at once; its remainder goes where it leaves least room (best fit). When it fits nowhere, the
fullest window is emitted and a new one opened. Pieces may be cut: a window that would be
emitted with room left is first filled from the head of the new remainder, so that it needs
no padding. What is still open when the partition ends is merged: the leftovers of up to
``MERGE`` partitions meet in one task, are laid end to end and cut into full sequences, and
only the last of each merge is shorter.

One pass over the texts, written once to the shared folder (the leftovers, less than
``open_windows`` sequences a partition, are shuffled). No step gathers more than
``MERGE * open_windows`` sequences.

Nulls and edge cases: a null or empty text still has its end id; a null id is kept as null;
repeated rows are packed each on their own; a text of any length is cut into pieces.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks, written
from .tokens import BLOCK, encoder

OPEN_WINDOWS = 64
MERGE = 64
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
_STAGED = _SCHEMA.append(pa.field("part", pa.int32()))


class Packer:
    """The open windows of one partition. A piece is [doc, start, length, doc tokens, sequence, offset, ids]."""

    def __init__(self, size: int, windows: int, first_sequence: int):
        self.size, self.windows, self.next = size, windows, first_sequence
        self.open: list[tuple[int, int]] = []  # (room, number), sorted
        self.held: dict[int, list[list]] = {}
        self.done: list[list] = []

    def _emit(self, pieces: list[list]) -> None:
        offset = 0
        for p in pieces:
            p[4], p[5] = self.next, offset
            offset += p[2]
        self.done += pieces
        self.next += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        at = 0
        while n - at >= self.size:
            self._emit([[doc, at, self.size, n, 0, 0, ids[4 * at : 4 * (at + self.size)]]])
            at += self.size
        while at < n:
            rest = n - at
            k = bisect_left(self.open, (rest, -1))
            if k < len(self.open):
                room, number = self.open.pop(k)
                take = rest
            elif len(self.open) < self.windows:
                room, number, take = self.size, self._number(), rest
                self.held[number] = []
            else:
                room, number = self.open.pop(0)  # the fullest, which is smaller than the rest
                take = room
            self.held[number].append([doc, at, take, n, 0, 0, ids[4 * at : 4 * (at + take)]])
            at += take
            if room == take:
                self._emit(self.held.pop(number))
            else:
                insort(self.open, (room - take, number))

    def _number(self) -> int:
        self._last = getattr(self, "_last", 0) + 1
        return self._last

    def flush(self) -> list[list]:
        """The pieces of the open windows, in order of opening."""
        return [p for number in sorted(self.held) for p in self.held[number]]


def _batch(pieces: list[list], schema: pa.Schema, part: int | None = None) -> pa.RecordBatch:
    columns = list(zip(*pieces)) if pieces else [[] for _ in _SCHEMA]
    arrays = [pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)]
    if len(schema) > len(_SCHEMA):
        arrays.append(pa.array([part] * len(pieces), pa.int32()))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian u32).

    ``tokenizer`` is the path of a tokenizers file; every document ends with ``end_id``.
    Sequence ids are unique, not gapless: the partition's number is in the upper bits.
    """

    def run(batches):
        encode, part = encoder(tokenizer).block, TaskContext.get().partitionId()
        packer = Packer(size, open_windows, part << 32)
        for rows, data, offsets in text_blocks(batches, "text", BLOCK):
            ids, cuts = encode(data, offsets, end_id)
            raw, cuts = ids.tobytes(), (4 * cuts).tolist()
            for doc, a, b in zip(rows.column(0).to_pylist(), cuts, cuts[1:]):
                packer.add(doc, raw[a:b])
            if packer.done:
                yield _batch(packer.done, _STAGED)
                packer.done = []
        left = packer.flush()
        if left:
            yield _batch(left, _STAGED, part)

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(_SCHEMA.names + ["part"]).to_pylist(), key=lambda r: (r["part"], r["doc_id"] is None, r["doc_id"] or 0, r["start"]))
        # sequences of a merge are numbered in the negative range of its first partition
        sequence, offset, out = -1 - (rows[0]["part"] << 32), 0, []
        for r in rows:
            at = 0
            while at < r["length"]:
                take = min(r["length"] - at, size - offset)
                out.append([r["doc_id"], r["start"] + at, take, r["doc_tokens"], sequence, offset, r["ids"][4 * at : 4 * (at + take)]])
                at, offset = at + take, offset + take
                if offset == size:
                    sequence, offset = sequence - 1, 0
        return pa.Table.from_batches([_batch(out, _SCHEMA)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    staged = written(rows.mapInArrow(run, PIECES + ", part int"), "pieces")
    merged = staged.filter("part is not null").groupBy(F.floor(F.col("part") / MERGE)).applyInArrow(merge, PIECES)
    return staged.filter("part is null").drop("part").unionByName(merged)
