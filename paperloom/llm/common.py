"""Shared pieces: the cluster's scratch folder, Arrow text access and numpy hashing.

Everything here is bounded: a task holds one Arrow batch and works on it in blocks of
``BLOCK_BYTES`` of text (a single longer text forms a block of its own).
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker expands at once.
BLOCK_BYTES = 1 << 20

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Where that is unset a temporary folder is used, in local mode only: on a cluster a
    folder of one machine would lose data, so that case is refused.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="paperloom-")
    return _own_dir[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/paperloom/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def removed(*tables: DataFrame | None) -> None:
    """Delete tables of :func:`written` that no later plan reads, and have the driver drop the shuffle files of finished jobs."""
    for df in tables:
        path = getattr(df, "_loom_path", None)
        if path:
            context = df.sparkSession.sparkContext
            p = context._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)
    if tables and tables[0] is not None:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def release() -> None:
    """Give freed memory back to the system; a worker would keep it until it ends."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df``: file sizes, without a scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, target: int) -> int:
    """Partitions of about ``target`` estimated bytes, at least as many as the session shuffles into.

    A plan of unknown size (of local rows or an RDD) is measured.
    """
    least, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), estimated_bytes(df)
    if size >= 1 << 60:
        texts = [c for c, kind in df.dtypes if kind in ("string", "binary")]
        size = int(df.agg(F.sum(sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in texts), F.lit(8)))).first()[0] or 0)
    return max(least, -(-size // target))


def text_blocks(
    batches: Iterator[pa.RecordBatch], text: str = "text", block_bytes: int = BLOCK_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Blocks of rows as (rows, UTF-8 bytes, offsets); a null text has no bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        col = pc.fill_null(col, b"")
        n = len(col)
        offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
        data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
        at = 0
        while at < n:
            end = int(np.searchsorted(offsets, offsets[at] + block_bytes, "right")) - 1
            end = min(n, max(at + 1, end))
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end
        del batch, col, data, offsets
        release()


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of ``schema`` from arrays or lists by name."""
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for f in schema for c in [columns[f.name]]]
    return pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, schema)], schema=schema)


ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Words of text: everything but space and the five control blanks.
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Words for comparison: ASCII digits and letters, and every byte beyond ASCII.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False


def words_of(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block and, by document, the index of its first word.

    ``gap`` marks the bytes between words. Words never cross documents.
    """
    inside = ~gap[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    here = np.zeros(len(data) + 1, bool)
    here[:-1] = inside
    starts = np.flatnonzero(here & (~before | first))
    ends = np.flatnonzero(before & (~here | first))
    return starts, ends, np.searchsorted(starts, offsets)


#: Odd multipliers; hashes to different ones are independent.
_BASES = [np.uint64(b) for b in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)]
_INVERSES = [np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES]
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[str(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on unsigned 64-bit integers that spreads every bit (murmur's finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix_hashes(data: np.ndarray, base: int = 0) -> np.ndarray:
    """Sums of (byte + 1) * base ** position before each position, modulo 2 ** 64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASES[base], len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans, equal for equal bytes wherever they lie."""
    return mix((prefix[ends] - prefix[starts]) * _power(_INVERSES[base], len(prefix))[starts] + (ends - starts).astype(np.uint64))


class Lookup:
    """Places of hashes in a sorted array of distinct hashes, by a table of their leading bits.

    Slots with several hashes, a few per cent, fall back to a binary search.
    """

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(8, len(keys).bit_length() + 4)
        self.shift = np.uint64(64 - bits)
        slot = (keys >> self.shift).astype(np.int64)
        self.first = np.full(1 << bits, -1, np.int32)
        self.first[slot[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        self.several = np.zeros(1 << bits, bool)
        self.several[slot[1:][slot[1:] == slot[:-1]]] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found) of each hash; the place of one not found is any."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        slot = (h >> self.shift).astype(np.int64)
        at = self.first[slot]
        hit = (at >= 0) & (self.keys[at] == h)
        more = np.flatnonzero(self.several[slot] & ~hit)
        if len(more):
            place = np.minimum(np.searchsorted(self.keys, h[more]), len(self.keys) - 1)
            at[more], hit[more] = place, self.keys[place] == h[more]
        return at, hit


def crc_of_ids(ids: np.ndarray) -> np.ndarray:
    """zlib's crc32 of the decimal text of each id, unsigned."""
    import zlib

    return np.fromiter((zlib.crc32(b"%d" % i) for i in ids.tolist()), np.uint32, len(ids))
