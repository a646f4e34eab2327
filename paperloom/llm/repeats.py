"""Repeated passages: every byte of a string of ``length`` bytes that also starts earlier goes.

The index is a run-compressed Burrows-Wheeler transform with samples at run ends. It is built
per shard, and shards are cut so that all occurrences of a string meet in one of them:

1. Every start of a ``length``-byte string belongs to one anchor, the first smallest of the
   hashes of its ``GRAM``-byte grams. Equal strings have equal anchors at equal places. The
   starts of one anchor form a segment, the bytes from its first to its last string. Anchors
   are sharded by hash; only (anchor hash, segment hash, place) travel.
2. In a shard, a segment that repeats an earlier one is marked whole. Where one anchor has
   several different segments, the first of each is asked for, and its bytes travel.
3. Their concatenation, in order of place, is the shard's text. Its suffixes are sorted by
   prefix doubling, the transform is cut into runs, and suffix and match length are kept at
   run ends alone. Streaming the text from one sample to the next gives every position's
   match with its neighbour in suffix order; neighbours with matches of ``length`` bytes or
   more form classes of equal strings, and all but the earliest of each class are marked.
4. An anchor with over ``HOT`` different segments, such as the edge of a passage that very many
   documents hold, would fill one task. Its strings are hashed to 128 bits each where they lie,
   and meet by hash in many shards; all but the earliest of each are marked.
5. Marks return to the documents' own part of the table and the rest is hashed.

Texts are copied once to the shared folder, one file a part, and parts are read where they are
needed: no step shuffles whole texts. Tasks are bounded by parts and shards, whose number
follows the input's size.

Nulls and edge cases: a null text is empty; texts shorter than ``length`` lose nothing; null
ids sort first; rows of equal id are ordered by their place in the input; a text longer than
``PIECE`` is read in pieces that overlap by one string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, mix, partitions_for, prefix_hashes, scratch_path, span_hashes, text_blocks, written

GRAM = 32
#: Different segments of one anchor beyond which its strings are compared one by one, in many tasks.
HOT = 1 << 14
PIECE = 1 << 24
_POS = np.uint64((1 << 26) - 1)


def _pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays of one length, byte planes of their differences, compressed."""
    import zstandard

    planes = [np.diff(a.astype(np.int64), prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes() if a.dtype != np.uint64 else a.view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays]
    return zstandard.compress(b"".join(planes), 1)


def _unpack(raw: bytes, kinds: str) -> list[np.ndarray]:
    """Arrays of :func:`_pack`; ``kinds`` has ``h`` for plain hashes and ``d`` for the others."""
    import zstandard

    data = np.frombuffer(zstandard.decompress(raw), np.uint8)
    each = data.reshape(len(kinds), 8, -1)
    out = []
    for kind, planes in zip(kinds, each):
        a = np.ascontiguousarray(planes.T)
        out.append(a.view(np.uint64).ravel() if kind == "h" else np.cumsum(a.view(np.int64).ravel()))
    return out


def _least(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of ``w`` values."""
    span = 1
    while span * 2 <= w:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    return np.minimum(a[: len(a) - (w - span)], a[w - span :]) if w > span else a


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(first start, last start, anchor hash, segment hash, text index) of a block's segments."""
    none = np.zeros(0, np.int64)
    m = len(data) - gram + 1
    if len(data) < length:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none
    prefix = prefix_hashes(data)
    at = np.arange(m)
    h = span_hashes(prefix, at, at + gram)
    low = _least((h & ~_POS) | at.astype(np.uint64), length - gram + 1)
    anchor = (low & _POS).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + length <= offsets[1:][doc])
    if not len(start):
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none
    a, d = anchor[start], doc[start]
    cut = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1) | (d[1:] != d[:-1])))
    first, last = start[cut], start[np.append(cut[1:], len(start)) - 1]
    return first, last, h[a[cut]], span_hashes(prefix, first, last + length), d[cut]


class RunIndex:
    """A run-compressed BWT of a text, with suffixes and match lengths sampled at run ends.

    Suffixes are sorted by prefix doubling; each round sorts only those that still tie.
    """

    def __init__(self, text: np.ndarray):
        n = len(text)
        if n >= np.iinfo(np.int32).max:
            raise OverflowError(f"{n} bytes are too many for one index")
        padded = np.append(text, np.zeros(8, np.uint8))
        key = np.zeros(n, np.uint64)
        for j in range(8):
            key = (key << np.uint64(8)) | padded[j : j + n]
        sa = np.argsort(key, kind="stable").astype(np.int32)
        # the rank of a suffix is the first slot of its class, from 1; past the end it is 0
        rank = np.zeros(n + 1, np.int32)
        slots, sorted_key, step = np.arange(n, dtype=np.int32), key[sa], 8
        while len(slots):
            new = np.append(True, (sorted_key[1:] != sorted_key[:-1]))
            rank[sa[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots), dtype=np.int32), 0))] + 1
            alone = new & np.append(new[1:], True)
            slots = slots[~alone]
            own = sa[slots]
            key = rank[own].astype(np.int64) << 32
            key |= rank[np.minimum(own + np.int32(step), np.int32(n))]
            order = np.argsort(key, kind="stable")
            sa[slots], sorted_key = own[order], key[order]
            del order
            step *= 2
        bwt = padded[sa - 1] if n else text
        # a run ends where the letter changes; the text's first suffix is a run of its own
        head = np.append(True, (bwt[1:] != bwt[:-1]) | (sa[1:] == 0) | (sa[:-1] == 0))
        self.n = n
        self.run_starts = np.flatnonzero(head)
        self.run_letters = bwt[self.run_starts]
        # samples: the first suffix of each run, the one before it in order, and their match
        self.sample = sa[self.run_starts]
        self.before = np.append(-1, sa[self.run_starts[1:] - 1])
        self.match = np.zeros(len(self.sample), np.int64)
        live, j = np.flatnonzero(self.before >= 0), 0
        while len(live):
            x, y = self.sample[live] + j, self.before[live] + j
            within = np.maximum(x, y) < n
            live, x, y = live[within], x[within], y[within]
            live = live[text[x] == text[y]]
            self.match[live] += 1
            j += 1
        order = np.argsort(self.sample)
        self.sample, self.before, self.match = self.sample[order], self.before[order], self.match[order]

    def matching(self) -> tuple[np.ndarray, np.ndarray]:
        """For each position in text order: its neighbour in suffix order and the match with it.

        Between samples both follow from the last one: the neighbour moves along, and the match
        shrinks by one.
        """
        last = np.zeros(self.n, np.int32)
        last[self.sample] = 1
        last = np.cumsum(last, dtype=np.int32) - 1
        gone = np.arange(self.n, dtype=np.int32) - self.sample.astype(np.int32)[last]
        before = self.before.astype(np.int32)[last]
        neighbour = np.where(before >= 0, before + gone, np.int32(-1))
        return neighbour, np.maximum(0, self.match.astype(np.int32)[last] - gone)


def later_strings(text: np.ndarray, length: int, whole: np.ndarray) -> np.ndarray:
    """Marks of the positions whose ``length``-byte string occurs earlier in ``text``.

    ``whole`` marks the positions where such a string lies within one segment.
    """
    index = RunIndex(text)
    neighbour, match = index.matching()
    link = np.flatnonzero((match >= length) & whole)
    # classes are chains of neighbours: pointer jumping finds each one's end
    node, to = np.unique(np.append(link, neighbour[link]), return_inverse=True)
    at, to = to[: len(link)], to[len(link) :]
    up = np.arange(len(node))
    up[at] = to
    while True:
        jump = up[up]
        if np.array_equal(jump, up):
            break
        up = jump
    first = np.full(len(node), len(text))
    np.minimum.at(first, up, node)
    out = np.zeros(len(text), bool)
    out[node[first[up] < node]] = True
    return out & whole


_PART = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("packed", pa.binary())])
_ASKED = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("kind", pa.int8()), ("n", pa.int64()), ("packed", pa.binary())])
_BYTES = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("packed", pa.binary()), ("bytes", pa.binary())])
_ASKED_DDL = "part long, shard long, kind byte, n long, packed binary"
_BYTES_DDL = "shard long, part long, n long, packed binary, bytes binary"


def _read(uri: str):
    """Batches (id, text) of one part."""
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        yield from pq.ParquetFile(f, pre_buffer=False).iter_batches(batch_size=1024, columns=["id", "text"])


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()


def _pieces(data, offsets, length):
    """A block as pieces of at most ``PIECE`` bytes: (data, offsets, bytes left out before)."""
    if len(data) <= PIECE:
        yield data, offsets, 0
        return
    for lo in range(0, len(data), PIECE):  # a block over PIECE is one text
        part = data[lo : lo + PIECE + length - 1]
        yield part, np.array([0, len(part)]), lo


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = GRAM, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans[, kept binary]) of every row.

    ``spans`` are the removed byte ranges (start, end), in order.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "texts")
    docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).write.parquet(path)
    system, folder = fs.FileSystem.from_uri(path)
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(folder)) if f.base_name.endswith(".parquet"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = partitions_for(docs, 8 << 20)
    files = spark.createDataFrame([(i, f"{path}/{n}") for i, n in enumerate(names)], "part long, uri string").repartition(max(width, len(names)), "part")

    def anchors(batches):
        for b in batches:
            for part, uri in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hold, size, base = [], 0, 0
                for rows, data, offsets in text_blocks(_read(uri), "text"):
                    ids = _ids(rows)
                    for piece, cuts, gone in _pieces(data, offsets, length):
                        first, last, ah, sh, doc = segments(piece, cuts, length, gram)
                        hold.append((ah, sh, ids[doc], base + doc, first - cuts[:-1][doc] + gone, last - first))
                        size += len(ah)
                    base += len(ids)
                    if size > 500_000:
                        yield from _sent(hold, part, shards)
                        hold, size = [], 0
                if size:
                    yield from _sent(hold, part, shards)

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        parts = np.repeat(table.column("part").to_numpy(), table.column("n").to_numpy())
        got = [_unpack(p, "hhdddd") for p in table.column("packed").to_pylist()]
        ah, sh, ids, rows, start, span = (np.concatenate([g[k] for g in got]) for k in range(6))
        _, group, size = np.unique(ah, return_inverse=True, return_counts=True)
        some = size[group] > 1
        ah, sh, ids, rows, start, span, parts = (x[some] for x in (ah, sh, ids, rows, start, span, parts))
        order = np.lexsort((start, rows, parts, ids, sh, ah))
        ah, sh, ids, rows, start, span, parts = (x[order] for x in (ah, sh, ids, rows, start, span, parts))
        if not len(ah):
            return _ASKED.empty_table()
        new_anchor = np.append(True, ah[1:] != ah[:-1])
        new = new_anchor | np.append(True, sh[1:] != sh[:-1])
        kinds = np.bincount(np.cumsum(new_anchor) - 1, new)
        own_kinds = kinds[np.cumsum(new_anchor) - 1]
        out = []
        # 0: marked whole; 1: bytes wanted; 2: hashes of strings wanted
        for kind, who in ((0, ~new), (1, new & (own_kinds > 1) & (own_kinds <= hot)), (2, new & (own_kinds > hot))):
            for p in np.unique(parts[who]).tolist():
                own = np.flatnonzero(who & (parts == p))
                own = own[np.lexsort((start[own], rows[own]))]
                out.append((p, shard, kind, len(own), _pack(rows[own], start[own], span[own])))
        return pa.Table.from_batches([batch_of(_ASKED, **{f.name: list(c) for f, c in zip(_ASKED, zip(*out))})]) if out else _ASKED.empty_table()

    def fetch(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        want = []
        for shard, packed in zip(table.column("shard").to_pylist(), table.column("packed").to_pylist()):
            rows, start, span = _unpack(packed, "ddd")
            want.append(np.stack([np.full(len(rows), shard), rows, start, span], 1))
        want = np.concatenate(want)
        want = want[np.argsort(want[:, 1], kind="stable")]
        base, found = 0, [[] for _ in range(6)]
        for rows, data, offsets in text_blocks(_read(f"{path}/{names[part]}"), "text"):
            n, ids = len(offsets) - 1, _ids(rows)
            lo, hi = np.searchsorted(want[:, 1], (base, base + n))
            w = want[lo:hi]
            if len(w):
                at, size = offsets[w[:, 1] - base] + w[:, 2], w[:, 3] + length
                take = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())
                for k, x in enumerate((w[:, 0], ids[w[:, 1] - base], w[:, 1], w[:, 2], w[:, 3], data[take])):
                    found[k].append(x)
            base += n
        shard, ids, rows, start, span, raw = (np.concatenate(f) for f in found)
        ends = np.cumsum(span + length)
        out = []
        for s in np.unique(shard).tolist():
            own = np.flatnonzero(shard == s)
            size = span[own] + length
            take = np.repeat(ends[own] - size - (np.cumsum(size) - size), size) + np.arange(size.sum())
            out.append((s, part, len(own), _pack(ids[own], rows[own], start[own], span[own]), raw[take].tobytes()))
        return pa.Table.from_batches([batch_of(_BYTES, **{f.name: list(c) for f, c in zip(_BYTES, zip(*out))})])

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        got = [_unpack(p, "dddd") for p in table.column("packed").to_pylist()]
        ids, rows, start, span = (np.concatenate([g[k] for g in got]) for k in range(4))
        parts = np.repeat(table.column("part").to_numpy(), table.column("n").to_numpy())
        raw = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8)
        size = span + length
        begin = np.cumsum(size) - size
        order = np.lexsort((start, rows, parts, ids))
        ids, rows, start, span, parts, size, begin = (x[order] for x in (ids, rows, start, span, parts, size, begin))
        # segments in order of place, each closed by a byte that UTF-8 never has
        place = np.cumsum(size + 1) - (size + 1)
        text = np.full(int((size + 1).sum()), 255, np.uint8)
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        text[np.repeat(place, size) + within] = raw[np.repeat(begin, size) + within]
        del within, raw
        owner = np.repeat(np.arange(len(size), dtype=np.int32), size + 1)
        inside = np.arange(len(text), dtype=np.int32) - place.astype(np.int32)[owner]
        again = later_strings(text, length, inside <= span[owner])
        at = np.flatnonzero(again)
        if not len(at):
            return _ASKED.empty_table()
        cut = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])))
        first, last = at[cut], at[np.append(cut[1:], len(at)) - 1]
        own = owner[first]
        p, r, s, e = parts[own], rows[own], start[own] + inside[first], last - first
        out = []
        for part in np.unique(p).tolist():
            w = p == part
            out.append((part, shard, 0, int(w.sum()), _pack(r[w], s[w], e[w])))
        return pa.Table.from_batches([batch_of(_ASKED, **{f.name: list(c) for f, c in zip(_ASKED, zip(*out))})])

    def strings(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = key[0].as_py()
        want = np.concatenate([np.stack(_unpack(p, "ddd"), 1) for b in batches for p in b.column("packed").to_pylist()])
        want = want[np.argsort(want[:, 0], kind="stable")]
        base, held, size = 0, [], 0
        for rows, data, offsets in text_blocks(_read(f"{path}/{names[part]}"), "text"):
            n, ids = len(offsets) - 1, _ids(rows)
            lo, hi = np.searchsorted(want[:, 0], (base, base + n))
            w = want[lo:hi]
            if len(w):
                each = w[:, 2] + 1
                start = np.repeat(w[:, 1], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                row = np.repeat(w[:, 0], each)
                at = offsets[row - base] + start
                held.append((*(span_hashes(prefix_hashes(data, k), at, at + length, k) for k in (0, 1)), ids[row - base], row, start))
                size += len(at)
                if size > 1_000_000:
                    yield from _spread(held, part, shards)
                    held, size = [], 0
            base += n
        if held:
            yield from _spread(held, part, shards)

    def settle(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = np.repeat(table.column("part").to_numpy(), table.column("n").to_numpy())
        got = [_unpack(p, "hhddd") for p in table.column("packed").to_pylist()]
        h, check, ids, rows, start = (np.concatenate([g[k] for g in got]) for k in range(5))
        order = np.lexsort((start, rows, parts, ids, check, h))
        again = order[1:][(h[order[1:]] == h[order[:-1]]) & (check[order[1:]] == check[order[:-1]])]
        out = []
        for p in np.unique(parts[again]).tolist():
            own = again[parts[again] == p]
            own = own[np.lexsort((start[own], rows[own]))]
            out.append((p, key[0].as_py(), 0, len(own), _pack(rows[own], start[own], np.zeros(len(own), np.int64))))
        return pa.Table.from_batches([batch_of(_ASKED, **{f.name: list(c) for f, c in zip(_ASKED, zip(*out))})]) if out else _ASKED.empty_table()

    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>" + ", kept binary" * with_text
    span_type = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(span_type))]
    schema = pa.schema(fields + [("kept", pa.binary())] * with_text)

    def remove(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part, marks = key[0].as_py(), [np.zeros((0, 3), np.int64)]
        for packed in table.column("packed").to_pylist():
            if packed:
                marks.append(np.stack(_unpack(packed, "ddd"), 1))
        marks = np.concatenate(marks)
        marks = marks[np.argsort(marks[:, 0], kind="stable")]
        base, out = 0, []
        for rows, data, offsets in text_blocks(_read(f"{path}/{names[part]}"), "text"):
            n = len(offsets) - 1
            lo, hi = np.searchsorted(marks[:, 0], (base, base + n))
            m = marks[lo:hi]
            depth = np.zeros(len(data) + 1, np.int32)
            at = offsets[m[:, 0] - base] + m[:, 1]
            np.add.at(depth, at, 1)
            np.add.at(depth, at + m[:, 2] + length, -1)
            gone = np.cumsum(depth[:-1]) > 0
            raw = data.tobytes()
            touched = set((m[:, 0] - base).tolist())
            ids = rows.column(0).to_pylist()
            for i in range(n):
                a, b = int(offsets[i]), int(offsets[i + 1])
                if i in touched:
                    g = gone[a:b]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(np.int8), [0]]))).reshape(-1, 2)
                    kept = data[a:b][~g].tobytes()
                    spans = [{"start": s, "end": e} for s, e in edge.tolist()]
                else:
                    kept, spans = raw[a:b], []
                row = (ids[i], b - a, b - a - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans)
                out.append(row + (kept,) * with_text)
            base += n
        return pa.Table.from_batches([batch_of(schema, **{f.name: list(c) for f, c in zip(schema, zip(*out))})]) if out else schema.empty_table()

    def by_part(df: DataFrame):
        """Rows by part, over as many tasks as there are parts: what a part's task reads of the texts is not in the shuffle's size."""
        return df.repartition(max(width, len(names)), "part").groupBy("part")

    met = written(files.mapInArrow(anchors, "shard long, part long, n long, packed binary").groupBy("shard").applyInArrow(meet, _ASKED_DDL), "anchors")
    texts = by_part(met.filter("kind = 1")).applyInArrow(fetch, _BYTES_DDL)
    found = texts.groupBy("shard").applyInArrow(compare, _ASKED_DDL)
    crowded = met.filter("kind = 2")
    if not crowded.isEmpty():
        spread = by_part(crowded).applyInArrow(strings, "shard long, part long, n long, packed binary")
        found = found.unionByName(spread.groupBy("shard").applyInArrow(settle, _ASKED_DDL))
    every = files.select("part", F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("byte").alias("kind"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("packed"))
    return by_part(met.filter("kind = 0").unionByName(found).unionByName(every)).applyInArrow(remove, result)


def _sent(hold, part: int, shards: int):
    """Rows of a part's anchors, one a shard."""
    ah, sh, ids, rows, start, span = (np.concatenate([h[k] for h in hold]) for k in range(6))
    yield from _by_shard((mix(ah) % np.uint64(shards)).astype(np.int64), (ah, sh, ids, rows, start, span), part)


def _spread(held, part: int, shards: int):
    """Rows of a part's strings, one a shard of their hash."""
    columns = [np.concatenate([h[k] for h in held]) for k in range(5)]
    yield from _by_shard((mix(columns[0]) % np.uint64(shards)).astype(np.int64), columns, part)


def _by_shard(to: np.ndarray, columns, part: int):
    order = np.argsort(to, kind="stable")
    met, cut = np.unique(to[order], return_index=True)
    for s, own in zip(met.tolist(), np.split(order, cut[1:])):
        yield batch_of(_PART, shard=[s], part=[part], n=[len(own)], packed=[_pack(*(c[own] for c in columns))])
