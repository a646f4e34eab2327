"""Token-id files: blocks of ids transposed into byte planes, each compressed with zstandard.

A shard holds consecutive documents. Its ids are cut into blocks of ``BLOCK_IDS``; a block is
seen as a matrix of ids by bytes (or bits) and stored plane by plane, so that the nearly
constant high planes shrink to almost nothing. The file ends with a chunk index: for each
block the number of ids and the place and length of every plane, then the documents' ids and
lengths, so a reader can fetch any block alone.

    magic | planes of block 0 | planes of block 1 | ... | index (zstd) | index length u64 | magic

Documents are range-partitioned by id and sorted within a partition, so file order is
document order. A task writes under a name of its own attempt and renames at the end: a lost
or repeated task leaves the same bytes. The driver sees one row per shard.

Nulls and edge cases: a null or empty text has just its end id; null ids sort first; rows of
the same id follow one another in the order of their texts; an empty table has no shards.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_of, partitions_for, scratch_path, text_blocks, written
from .tokens import BLOCK, encoder

BLOCK_IDS = 1 << 16
SHARD_IDS = 1 << 26
MAGIC = b"LOOMIDS1"


def to_planes(ids: np.ndarray, bits: bool = False, level: int = 3) -> list[bytes]:
    """Compressed planes of little-endian u32 ids: 4 byte planes, or 32 bit planes."""
    import zstandard

    planes = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    if bits:
        planes = np.concatenate([np.packbits(np.unpackbits(p[:, None], axis=1, bitorder="little").T, axis=1) for p in planes])
    c = zstandard.ZstdCompressor(level=level)
    return [c.compress(np.ascontiguousarray(p).tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of :func:`to_planes`."""
    import zstandard

    d = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(d.decompress(p), np.uint8) for p in planes]
    if len(raw) == 32:
        raw = [np.packbits(np.stack([np.unpackbits(x, count=n) for x in raw[8 * k : 8 * k + 8]], 1), axis=1, bitorder="little").ravel() for k in range(4)]
    return np.stack(raw, 1).reshape(-1).view("<u4")


class ShardWriter:
    """Writes one shard; ids arrive document by document and leave block by block."""

    def __init__(self, uri: str, bits: bool = False):
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex[:8]}"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.temp)
        self.out.write(MAGIC)
        self.at, self.bits, self.waiting, self.n_waiting, self.n = len(MAGIC), bits, [], 0, 0
        self.blocks: list[list] = []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.docs.append(doc)
        self.lengths.append(n)
        self.waiting.append(ids)
        self.n_waiting += n
        self.n += n
        if self.n_waiting >= BLOCK_IDS:
            raw = b"".join(self.waiting)
            full = len(raw) // (4 * BLOCK_IDS) * 4 * BLOCK_IDS
            for lo in range(0, full, 4 * BLOCK_IDS):
                self._block(raw[lo : lo + 4 * BLOCK_IDS])
            self.waiting, self.n_waiting = [raw[full:]], (len(raw) - full) // 4

    def _block(self, raw: bytes) -> None:
        planes = to_planes(np.frombuffer(raw, "<u4"), self.bits)
        self.blocks.append([len(raw) // 4, self.at, [len(p) for p in planes]])
        for p in planes:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> int:
        import zstandard

        if self.n_waiting:
            self._block(b"".join(self.waiting))
        index = zstandard.compress(json.dumps({"blocks": self.blocks, "docs": self.docs, "lengths": self.lengths}).encode(), 3)
        self.out.write(index + len(index).to_bytes(8, "little") + MAGIC)
        self.out.close()
        self.fs.move(self.temp, self.path)
        return self.n


def read_shard(uri: str):
    """Yields (doc, ids as bytes) of a shard in order, holding one block and the open document."""
    import zstandard

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        size = f.size()
        tail = f.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is no token-id file")
        n = int.from_bytes(tail[:8], "little")
        index = json.loads(zstandard.decompress(f.read_at(n, size - 16 - n)))
        blocks, have, got = iter(index["blocks"]), b"", 0
        for doc, length in zip(index["docs"], index["lengths"]):
            parts, need = [], 4 * length
            while need:
                if got == len(have):
                    count, at, sizes = next(blocks)
                    raw = f.read_at(sum(sizes), at)
                    ends = np.cumsum(sizes)
                    have, got = from_planes([raw[e - s : e] for s, e in zip(sizes, ends)], count).tobytes(), 0
                take = min(need, len(have) - got)
                parts.append(have[got : got + take])
                got, need = got + take, need - take
            yield doc, b"".join(parts)


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS, bits: bool = False) -> DataFrame:
    """Tokenise and write shards under ``folder``; returns (part, shard, uri, n_ids), one row per shard, in file order."""
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("uri", pa.string()), ("n_ids", pa.int64())])

    def run(batches):
        encode, part = encoder(tokenizer).block, TaskContext.get().partitionId()
        writer, shard, made = None, 0, []

        def close():
            made.append((part, shard, uri, writer.close()))

        for rows, data, offsets in text_blocks(batches, "text", BLOCK):
            ids, cuts = encode(data, offsets, end_id)
            raw, cuts = ids.tobytes(), (4 * cuts).tolist()
            for doc, a, b in zip(rows.column(0).to_pylist(), cuts, cuts[1:]):
                if writer and writer.n >= shard_ids:
                    close()
                    writer, shard = None, shard + 1
                if writer is None:
                    uri = f"{folder}/part-{part:06d}-{shard:04d}.ids"
                    writer = ShardWriter(uri, bits)
                writer.add(doc, raw[a:b])
        if writer:
            close()
        yield batch_of(schema, **{f.name: list(c) for f, c in zip(schema, zip(*made) if made else [[]] * 4)})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = partitions_for(docs, 64 << 20)
    rows = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    return written(rows.mapInArrow(run, "part int, shard int, uri string, n_ids long"), "shards")


def read_ids(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files.

    ``start`` counts the ids of all earlier documents: a running sum over the shard rows
    (one each) plus the position in the file.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                for doc, ids in read_shard(uri):
                    rows.append((doc, start, len(ids) // 4, zlib.crc32(ids)))
                    start += len(ids) // 4
                    if len(rows) == 10_000:
                        yield batch_of(schema, **{f.name: list(c) for f, c in zip(schema, zip(*rows))})
                        rows = []
                if rows:
                    yield batch_of(schema, **{f.name: list(c) for f, c in zip(schema, zip(*rows))})

    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = written(shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("uri", "start"), "placed")
    spread = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "uri")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, **options) -> DataFrame:
    """Write ``docs`` to a new folder of the shared file system and read them back."""
    folder = scratch_path(docs.sparkSession, "ids")
    return read_ids(docs.sparkSession, write_ids(docs, folder, tokenizer, end_id, **options))
