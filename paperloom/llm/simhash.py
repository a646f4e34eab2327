"""Near duplicates by SimHash and meet-in-the-middle ball hashing.

Two 64-bit fingerprints at distance ``radius`` or less have a point in common within half
that radius of both, so every distinct fingerprint emits all variants within ``radius / 2``
and those that share a variant meet. Shuffling 2,081 variants of each (radius 4) would move
far more than the input, so only their leading bits are shuffled: a fingerprint is sent to
every prefix that one of its variants has, and the task of that prefix makes the variants
below it, sorts them and links those that coincide. The variants are the same, each in
exactly one task, and a task holds a bounded number of them: the number of prefix bits grows
with the logarithm of the number of fingerprints, over the best balanced bit positions, and
a prefix that too many reach is shared by several tasks.

All members of one variant are within ``radius`` of one another. Each task finds the
components among its fingerprints and sends one link a member, so no pairs are listed.
Whole components follow from alternating large-star and small-star steps over tables in the
shared folder; nothing is collected on the driver but counts.

Nulls and edge cases: a null or blank text has fingerprint zero and links like any other;
texts of fewer words than a shingle count as one shingle; repeated rows share a fingerprint.
A row with a null id links others, but names no component: where all ids of a component are
null, so is its name. In :func:`similar_groups` rows with a null id are in no group. Extra
columns may have any name.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, IS_BLANK, batch_of, mix, prefix_hashes, release, removed, span_hashes, text_blocks, words_of, written

#: Fingerprints of one prefix, on average, and the fewest bits of a prefix, so that a small table has tasks enough.
GROUP = 1 << 14
LEAST_BITS = 6
#: Fingerprints that reach one prefix beyond which several tasks share it.
HOT = 1 << 18
#: Variants a task sorts at once; larger groups are split by further bits.
MAX_VARIANTS = 2_000_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Grouped rows that are broadcast, of 16 bytes each; more are joined by shuffle.
MAX_SENT = 1 << 20
#: The most bits of a set's marks.
MARKS = 1 << 17
#: Word-set fingerprints by which similar documents are paired.
TABLES = 4
#: Documents whose shingles are counted for the order of prefixes, and the most shingles kept of them.
SAMPLE = 1 << 12
MAX_FREQUENT = 1 << 18
#: Documents of one shingle beyond which not all their pairs are listed before some are linked.
CROWD = 256
#: Pairs a task lists at once.
MAX_PAIRS = 1 << 20


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """Unsigned 64-bit SimHash of each document of a block."""
    import xxhash

    low = ASCII_LOWER[data]
    starts, ends, first = words_of(low, offsets, IS_BLANK)
    blank = IS_BLANK[low]
    follows = np.zeros(len(low), bool)
    follows[starts[starts > 0] - 1] = True
    keep = ~blank | (blank & follows)
    low = np.where(blank, np.uint8(32), low)[keep]
    moved = np.cumsum(keep)
    starts, ends = moved[starts] - 1, moved[ends - 1]
    counts = np.diff(first)
    shingles = np.maximum(counts - shingle + 1, np.minimum(counts, 1))
    total = int(shingles.sum())
    out = np.zeros(len(counts), np.uint64)
    if not total:
        return out
    begin = np.cumsum(shingles) - shingles
    row = np.repeat(np.arange(len(counts)), shingles)
    at = first[:-1][row] + np.arange(total) - begin[row]
    until = np.minimum(at + shingle, first[1:][row]) - 1
    raw, digest = low.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[s:e], 42) for s, e in zip(starts[at].tolist(), ends[until].tolist())), np.uint64, total)
    some = np.flatnonzero(shingles)
    votes = np.zeros((len(counts), 64), np.int64)
    step = 1 << 17
    for lo in range(0, total, step):  # a long document may span several steps
        part = hashes[lo : lo + step]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rows = row[lo : lo + step]
        cut = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        votes[rows[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    ones = votes[some] * 2 > shingles[some, None]
    out[some] = np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp long) of every row: one pass over whole texts, no shuffle."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for rows, data, offsets in text_blocks(batches, "text"):
            yield batch_of(schema, id=rows.column(0), fp=fingerprints_of(data, offsets, shingle).view(np.int64))

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def _masks(bits: list[int], flips: int) -> np.ndarray:
    """All masks of at most ``flips`` of ``bits``."""
    return np.array([sum(1 << b for b in c) for k in range(flips + 1) for c in combinations(bits, k)], np.uint64)


def _places(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The chosen bits of each value, moved together."""
    out = np.zeros(len(values), np.uint64)
    for i, b in enumerate(bits):
        out |= ((values >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def _balanced(fp: np.ndarray, bits: list[int]) -> list[int]:
    """``bits`` in order of how evenly they part the fingerprints."""
    share = [abs(float(((fp >> np.uint64(b)) & np.uint64(1)).mean()) - 0.5) for b in bits]
    return [b for _, b in sorted(zip(share, bits))]


def _meetings(fp: np.ndarray, left: np.ndarray, free: list[int]):
    """Yields (members, members) that share a variant: of each variant the later ones with the one before.

    ``left`` flips of the ``free`` bits remain to each fingerprint. The members of a variant
    keep their order. A group with more than ``MAX_VARIANTS`` variants is split by its best
    balanced bit, and a member goes to each side where one of its variants can lie.
    """
    masks = [_masks(free, k) for k in range(int(left.max()) + 1)]
    size = sum(int((left == k).sum()) * len(m) for k, m in enumerate(masks))
    if size > MAX_VARIANTS and len(free) > 1:
        [bit, *_] = _balanced(fp, free)
        for side in (0, 1):
            flipped = ((fp >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) != side
            stay = np.flatnonzero(left >= flipped)
            if len(stay) > 1:
                for a, b in _meetings(fp[stay], (left - flipped)[stay], [x for x in free if x != bit]):
                    yield stay[a], stay[b]
        return
    every = np.uint64(sum(1 << b for b in free))
    own = [np.flatnonzero(left == k) for k in range(len(masks))]
    variant = np.concatenate([((fp[o] & every)[:, None] ^ m[None, :]).ravel() for o, m in zip(own, masks)])
    # most variants occur once: those that occur again are found by a plain sort, and only their rows are ordered
    plain = np.sort(variant)
    again = np.unique(plain[1:][plain[1:] == plain[:-1]])
    if not len(again):
        return
    table = np.zeros(1 << 20, bool)
    table[(again * _SPREAD >> np.uint64(44)).astype(np.int64)] = True
    row = np.flatnonzero(table[(variant * _SPREAD >> np.uint64(44)).astype(np.int64)])
    owner = np.concatenate([np.repeat(o, len(m)) for o, m in zip(own, masks)])[row]
    variant = variant[row]
    order = np.lexsort((owner, variant))
    variant, owner = variant[order], owner[order]
    same = np.flatnonzero(variant[1:] == variant[:-1])
    key = np.unique(owner[same] * len(fp) + owner[same + 1])
    yield key // len(fp), key % len(fp)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of ``n`` nodes reaches over the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _links(fp: np.ndarray, left: np.ndarray, free: list[int], radius: int, nearest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Links among the distinct fingerprints of one prefix, at most one a fingerprint.

    All that share a variant are connected: each is linked to the first of its component. With
    ``nearest`` each is linked to the nearest of those before it that it meets in some variant.
    """
    n = len(fp)
    root, best = np.arange(n), np.full(n, (radius + 1) * n)
    for a, b in _meetings(fp, left, free):
        apart = np.bitwise_count(fp[a] ^ fp[b]).astype(np.int64)
        near = apart <= radius
        a, b, apart = a[near], b[near], apart[near]
        if nearest:
            np.minimum.at(best, np.maximum(a, b), apart * n + np.minimum(a, b))
        else:
            root = _forest(n, np.concatenate([a, np.arange(n)]), np.concatenate([b, root]))
    linked = np.flatnonzero(best < (radius + 1) * n) if nearest else np.flatnonzero(root != np.arange(n))
    return fp[(best[linked] % n) if nearest else root[linked]], fp[linked]


def ball_links(distinct: DataFrame, radius: int = 4, group: int = GROUP, nearest: bool = False, hot: int = HOT) -> DataFrame:
    """Links (t, a, b) among distinct fingerprints (t, fp) of one or more tables t that connect all at ``radius`` or less; see :func:`_links`.

    A task sends the fingerprints of a prefix as one value. A prefix that more than ``hot``
    fingerprints reach goes to several tasks, each with the variants of one value of further
    bits, the best balanced ones of that prefix.
    """
    half = (radius + 1) // 2
    bits = [F.avg(F.expr(f"getbit(fp, {b})")).alias(f"b{b}") for b in range(64)]
    stats = {r["t"]: r for r in distinct.groupBy("t").agg(F.count("*").alias("n"), *bits).collect()}
    width = LEAST_BITS
    while width < 40 and group << width < max([r["n"] for r in stats.values()], default=0):
        width += 1
    prefix, free = {}, {}
    for t, r in stats.items():
        by_balance = sorted(range(64), key=lambda b: (abs(r[f"b{b}"] - 0.5), b))
        prefix[t], free[t] = sorted(by_balance[:width]), sorted(by_balance[width:])
    flips = _masks(list(range(width)), half)
    sent = pa.schema([("prefix", pa.int64()), ("fps", pa.binary())])
    linked = pa.schema([("t", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def emitted(t: int, fp: np.ndarray) -> pa.RecordBatch:
        to = (_places(fp, prefix[t])[:, None] ^ flips[None, :]).ravel()
        order = np.argsort(to, kind="stable")
        to, fp = to[order], fp[order // len(flips)]
        cut = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to))
        fps = pa.BinaryArray.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((8 * cut).astype(np.int32)), pa.py_buffer(fp)])
        return batch_of(sent, prefix=to[cut[:-1]].view(np.int64) + (t << 48), fps=fps)

    def send(batches):
        held: dict[int, list[np.ndarray]] = {t: [] for t in prefix}
        for b in batches:
            own, fp = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            for t, parts in held.items():
                parts.append(fp[own == t])
                if sum(map(len, parts)) * len(flips) > 1_000_000:
                    yield emitted(t, np.concatenate(parts))
                    parts.clear()
        for t, parts in held.items():
            if sum(map(len, parts)):
                yield emitted(t, np.concatenate(parts))

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own, part = (k.as_py() for k in key)
        t, own = own >> 48, own & ((1 << 48) - 1)
        more = table.column("bits")[0].as_py()
        fp = np.sort(np.frombuffer(b"".join(table.column("fps").to_pylist()), np.uint64))
        left, rest = half - np.bitwise_count(_places(fp, prefix[t]) ^ np.uint64(own)).astype(np.int64), free[t]
        if more:
            chosen = _balanced(fp, rest)[:more]
            rest = [b for b in rest if b not in chosen]
            left = left - np.bitwise_count(_places(fp, chosen) ^ np.uint64(part)).astype(np.int64)
            fp, left = fp[left >= 0], left[left >= 0]
        if len(fp) < 2:
            return linked.empty_table()
        a, b = _links(fp, left, rest, radius, nearest)
        release()
        return pa.table({"t": np.full(len(a), t, np.int32), "a": a.view(np.int64), "b": b.view(np.int64)}, schema=linked)

    rows = distinct.select(F.col("t").cast("int").alias("t"), "fp").mapInArrow(send, "prefix long, fps binary")
    sizes = rows.groupBy("prefix").agg((F.sum(F.length("fps")) / 8).alias("n")).filter(F.col("n") > hot)
    split = sizes.select("prefix", F.least(F.ceil(F.log2(F.col("n") / hot)), F.lit(16)).cast("int").alias("bits"))
    if split.isEmpty():
        rows = rows.withColumn("bits", F.lit(0)).withColumn("part", F.lit(0))
    else:
        rows = rows.join(split, "prefix", "left").withColumn("bits", F.coalesce("bits", F.lit(0))).withColumn("part", F.expr("explode(sequence(0, shiftleft(1, bits) - 1))"))
    return rows.groupBy("prefix", "part").applyInArrow(meet, "t int, a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches.

    Alternates large-star and small-star steps until the set of links is stable, however many
    it takes (about the square of the logarithm of the number of nodes). Hub nodes are reduced
    by partial aggregation; the join back splits them under adaptive execution.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
            .filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        )
        last, edges = edges, written(small, "links")
        removed(last)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(id, fp long, component) of every row: the smallest id that its fingerprint reaches."""
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("id").alias("node")), "distinct")
    found = components(ball_links(distinct.withColumn("t", F.lit(0)), radius))
    named = distinct.join(found.select(F.col("node").alias("fp"), F.col("component").alias("first")), "fp", "left").withColumn("first", F.coalesce("first", "fp"))
    least = named.groupBy("first").agg(F.min("node").alias("component"))
    return fps.join(named.select("fp", "first").join(least, "first").select("fp", "component"), "fp", "left").select("id", "fp", "component")


def summaries(docs: DataFrame, id_col: str, text_col: str, tables: int, shingle: int) -> DataFrame:
    """(id, fps array<long>, marks binary, n int) of each row, from one pass over whole texts.

    ``tables`` fingerprints of the set of lower-cased words; and of the set of word shingles its
    size and :func:`_marks`.
    """
    schema = pa.schema([("id", pa.int64()), ("fps", pa.list_(pa.int64())), ("marks", pa.binary()), ("n", pa.int32())])
    seeds = mix(np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches):
        for rows, data, offsets in text_blocks(batches, "text"):
            low, n = ASCII_LOWER[data], len(offsets) - 1
            starts, ends, first = words_of(low, offsets, IS_BLANK)
            words = span_hashes(prefix_hashes(low), starts, ends)
            sets = [_shingles(words[a:b], shingle) for a, b in zip(first.tolist(), first[1:].tolist())]
            doc = np.repeat(np.arange(n), np.diff(first))
            order = np.lexsort((words, doc))
            h, doc = words[order], doc[order]
            new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, bool)
            h, doc = h[new], doc[new]
            size = np.bincount(doc, minlength=n)
            fps = np.zeros((n, tables), np.uint64)
            for t, seed in enumerate(seeds):
                votes = np.zeros((n, 64), np.int64)
                for lo in range(0, len(h), 1 << 16):
                    part, own = mix(h[lo : lo + (1 << 16)] ^ seed), doc[lo : lo + (1 << 16)]
                    bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    cut = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    votes[own[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
                fps[:, t] = np.packbits(votes * 2 > size[:, None], axis=1, bitorder="little").view("<u8").ravel()
            flat = pa.array(fps.view(np.int64).ravel())
            yield batch_of(schema, id=rows.column(0), fps=pa.ListArray.from_arrays(np.arange(0, n * tables + 1, tables, dtype=np.int32), flat), marks=[_marks(g) for g in sets], n=[len(g) for g in sets])

    return _texts(docs, id_col, text_col).mapInArrow(run, "id long, fps array<long>, marks binary, n int")


def _marks(grams: np.ndarray) -> bytes:
    """The bits that a set's hashes hit, two to four for each element, 512 to ``MARKS`` in all."""
    bits = min(MARKS, 1 << max(9, (2 * len(grams)).bit_length()))
    hit = np.zeros(bits, bool)
    hit[(grams & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(hit).tobytes()


def _most_shared(x: bytes, y: bytes, n: int, m: int) -> int:
    """The most elements that two sets can share by their marks: one's mark that the other lacks is an element it lacks."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(a), len(b))
    a, b = (np.bitwise_or.reduce(c.reshape(-1, size), axis=0).view(np.uint64) for c in (a, b))
    both = int(np.bitwise_count(a & b).sum())
    return min(n - int(np.bitwise_count(a).sum()), m - int(np.bitwise_count(b).sum())) + both


def _shingles(words: np.ndarray, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``shingle`` words; of fewer words the whole is one."""
    k = min(shingle, len(words))
    if not k:
        return words[:0]
    g = words[: len(words) - k + 1].copy()
    for j in range(1, k):
        g = g * np.uint64(0xD6E8FEB86659FD93) + words[j : len(words) - k + 1 + j]
    return np.unique(mix(g))


def _shingle_sets(batches, shingle: int):
    """Yields (ids, sorted distinct 64-bit hashes of the word shingles of each text), a block of texts at a time."""
    for rows, data, offsets in text_blocks(batches, "text"):
        low = ASCII_LOWER[data]
        starts, ends, first = words_of(low, offsets, IS_BLANK)
        h = span_hashes(prefix_hashes(low), starts, ends)
        out = [_shingles(h[a:b], shingle) for a, b in zip(first.tolist(), first[1:].tolist())]
        yield rows.column(0), out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, grams binary): sorted distinct 64-bit hashes of the word shingles of each row."""
    schema = pa.schema([("id", pa.int64()), ("grams", pa.binary())])

    def run(batches):
        for ids, sets in _shingle_sets(batches, shingle):
            yield batch_of(schema, id=ids, grams=[g.tobytes() for g in sets])

    return _texts(docs, id_col, text_col).mapInArrow(run, "id long, grams binary")


def frequent_grams(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that a sample of about ``SAMPLE`` documents holds more than once, rarest first: (sorted hashes, their places).

    They only order the shingles of a set, so any sample gives complete prefixes; a good one gives short groups.
    """
    every = max(1, docs.count() // SAMPLE)
    schema = pa.schema([("gram", pa.int64())])

    def each(batches):
        for _, sets in _shingle_sets(batches, shingle):
            yield batch_of(schema, gram=np.concatenate(sets).view(np.int64))

    some = _texts(docs.filter(F.pmod(F.xxhash64(id_col), F.lit(every)) == 0), id_col, text_col).mapInArrow(each, "gram long")
    top = some.groupBy("gram").count().filter("count > 1").orderBy(F.desc("count"), "gram").limit(MAX_FREQUENT).toArrow()
    grams, count = top.column("gram").to_numpy().view(np.uint64), top.column("count").to_numpy()
    place = np.empty(len(grams), np.int64)
    place[np.lexsort((grams, count))] = np.arange(len(grams))
    order = np.argsort(grams)
    return grams[order], place[order]


def prefix_grams(docs: DataFrame, id_col: str, text_col: str, shingle: int, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> DataFrame:
    """(gram, id, size, place): of each row's set the rarest shingles, as many as let no pair of ``similarity`` escape.

    Of sets of n and m shingles with a Jaccard similarity of t, t * n are shared, so in one common order the first
    n - t * n + 1 of both have one in common. A set without shingles has gram 0 and size 0.
    """
    schema = pa.schema([("gram", pa.int64()), ("id", pa.int64()), ("size", pa.int32()), ("place", pa.int32())])
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        often, rank = shared.value
        for ids, sets in _shingle_sets(batches, shingle):
            out, length, sizes = [], [], []
            for g in sets:
                n = len(g)
                if len(often) and n:
                    at = np.minimum(np.searchsorted(often, g), len(often) - 1)
                    known = often[at] == g
                    g = np.concatenate([g[~known], g[known][np.argsort(rank[at[known]])]])
                first = g[: n - int(np.ceil(similarity * n - 1e-9)) + 1] if n else np.zeros(1, np.uint64)
                out.append(first)
                length.append(len(first))
                sizes.append(n)
            length = np.array(length, np.int64)
            place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            yield batch_of(schema, gram=np.concatenate(out).view(np.int64), id=np.repeat(ids.to_numpy(), length), size=np.repeat(np.array(sizes, np.int32), length), place=place.astype(np.int32))

    return _texts(docs, id_col, text_col).mapInArrow(run, "gram long, id long, size int, place int")


def _possible(size_a, place_a, size_b, place_b, similarity: float) -> np.ndarray:
    """Whether sets whose first shared shingle has these places can be as similar by size and by what follows."""
    least = _least_shared(size_a, size_b, similarity)
    return (np.minimum(size_a, size_b) >= similarity * np.maximum(size_a, size_b) - 1e-6) & (1 + np.minimum(size_a - place_a - 1, size_b - place_b - 1) >= least)


def _runs(batches):
    """Columns of an Arrow stream sorted by its first column, cut where that changes; a run is never split."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy() for c in b.columns]
        at = int(np.searchsorted(cols[0], cols[0][-1]))
        if at or (held and held[-1][0][-1] != cols[0][0]):
            held.append([c[:at] for c in cols])
            yield [np.concatenate(x) for x in zip(*held)]
            held = [[c[at:] for c in cols]]
        else:
            held.append(cols)
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def prefix_pairs(rows: DataFrame, similarity: float, crowd: int = 0) -> DataFrame:
    """Candidates (a, b) from (gram, id, size, place, component): all that share a gram, can be as similar and differ in component.

    Of a gram with over ``crowd`` members (0: never) only the pairs of one of them with the others are listed, and the row (gram, null).
    """
    linked = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def meet(batches):
        for gram, node, size, place, part in _runs(batches):
            edge = np.flatnonzero(np.append(gram[1:] != gram[:-1], True)) + 1
            count = np.diff(edge, prepend=0)
            own = np.flatnonzero(np.append((gram[1:] != gram[:-1]) | (part[1:] != part[:-1]), True)) + 1
            begin = np.repeat(own, np.diff(own, prepend=0))  # the first member behind one's own component
            after = np.repeat(edge, count) - begin
            full = count > crowd if crowd else np.zeros(len(count), bool)
            if full.any():
                lead = np.zeros(len(gram), bool)
                lead[(edge - count)[full]] = True
                after[np.repeat(full, count) & ~lead] = 0
                yield batch_of(linked, a=gram[edge[full] - 1], b=pa.nulls(int(full.sum()), pa.int64()))
            for lo, hi in _pieces(after):
                n = after[lo:hi]
                i = np.repeat(np.arange(lo, hi), n)
                j = np.repeat(begin[lo:hi], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                ok = _possible(size[i], place[i], size[j], place[j], similarity)
                i, j = node[i[ok]], node[j[ok]]
                yield batch_of(linked, a=np.minimum(i, j), b=np.maximum(i, j))

    return rows.select("gram", "id", "size", "place", "component").repartition("gram").sortWithinPartitions("gram", "component").mapInArrow(meet, "a long, b long").distinct()


def _pieces(n: np.ndarray):
    """Ranges of ``n`` whose sums stay near ``MAX_PAIRS``."""
    total, lo = np.cumsum(n), 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + MAX_PAIRS, "right")))
        if total[hi - 1] > (total[lo - 1] if lo else 0):
            yield lo, hi
        lo = hi


def _least_shared(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """The fewest shared elements that sets of these sizes need."""
    return similarity / (1 + similarity) * (n.astype(np.float64) + m) - 1e-6


def plausible(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) that sizes and marks do not rule out."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in (b.slice(lo, 4096) for b in batches for lo in range(0, b.num_rows, 4096)):
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in (3, 5))
            shared = np.array([_most_shared(*row) for row in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), n.tolist(), m.tolist())], np.int64)
            mask = pa.array(shared >= _least_shared(n, m, similarity))
            yield batch_of(schema, a=batch.column(0).filter(mask), b=batch.column(1).filter(mask))

    both = pairs
    for c, k, size in (("a", "x", "n"), ("b", "y", "m")):
        both = both.join(marks.select(F.col("id").alias(c), F.col("marks").alias(k), F.col("n").alias(size)), c)
    return both.select("a", "b", "x", "n", "y", "m").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) whose whole shingle sets have ``similarity`` or more."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(batches):
        for batch in (b.slice(lo, 512) for b in batches for lo in range(0, b.num_rows, 512)):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            release()
            mask = pa.array(keep, pa.bool_())
            yield batch_of(schema, a=batch.column(0).filter(mask), b=batch.column(1).filter(mask))

    return both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def word_set_links(fps: DataFrame, radius: int) -> DataFrame:
    """Candidates (a, b) of rows (id, fps) by ball hashing over each of their fingerprints, all tables at once.

    Each row is paired with the first of its fingerprint, and each fingerprint's first row with
    that of the nearest earlier fingerprint it meets: at most two pairs a row and table.
    """
    own = fps.select("id", F.posexplode("fps").alias("t", "fp"))
    distinct = written(own.groupBy("t", "fp").agg(F.min("id").alias("node")), "distinct")
    near = ball_links(distinct, radius, nearest=True).withColumnRenamed("b", "c")
    for old, new in (("a", "x"), ("c", "y")):
        near = near.join(distinct.select("t", F.col("fp").alias(old), F.col("node").alias(new)), ["t", old])
    equal = own.join(distinct, ["t", "fp"]).filter("id <> node").select(F.col("node").alias("x"), F.col("id").alias("y"))
    out = written(near.select("x", "y").unionByName(equal).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "candidates")
    removed(distinct)
    return out


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, tables: int = TABLES, radius: int = 4, crowd: int = CROWD) -> DataFrame:
    """(node, component) of ids linked by a Jaccard similarity of word shingles of ``similarity`` or more.

    At such a similarity the fingerprints of shingles differ in ten bits or so, beyond the
    reach of balls. The sets of distinct words differ less, so rows whose word-set fingerprints
    lie within ``radius`` in any of ``tables`` independent tables are paired by ball hashing,
    verified on whole shingle sets and joined into groups. An exact step completes them: every
    two rows that share one of their rarest shingles (:func:`prefix_grams`) and are not in one
    group yet are verified as well, which misses none of ``similarity``. A shingle with over
    ``crowd`` rows first links one of them to the others; then those pairs are listed that are
    still in different groups, so a crowd of copies costs its number and no pair is lost.
    Rows that share an id count as one document with several texts.
    """
    docs = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def few(df: DataFrame) -> DataFrame:
        """``df`` to be broadcast where its rows, of 16 bytes, are at most ``MAX_SENT``."""
        return F.broadcast(df) if df.count() <= MAX_SENT else df

    def similar(pairs: DataFrame) -> DataFrame:
        left = written(plausible(pairs, marks, similarity), "plausible")
        nodes = written(left.select(F.col("a").alias("id")).unionByName(left.select(F.col("b").alias("id"))).distinct(), "nodes")
        sets = written(shingle_sets(docs.join(few(nodes), "id", "left_semi"), "id", "text", shingle), "shingles")
        out = written(verified(left, sets, similarity), "similar")
        removed(sets, left, nodes)
        return out

    def grouped(links: DataFrame) -> DataFrame:
        return written(components(links), "components")

    def placed(rows: DataFrame, groups: DataFrame) -> DataFrame:
        return rows.join(few(groups.withColumnRenamed("node", "id")), "id", "left").withColumn("component", F.coalesce("component", "id"))

    summary = written(summaries(docs, "id", "text", tables, shingle), "summaries")
    marks = summary.select("id", "marks", "n")
    near = word_set_links(summary.select("id", "fps"), radius)
    linked = similar(near)
    groups = grouped(linked)
    removed(near)
    frequent = frequent_grams(docs, "id", "text", shingle)
    grams = prefix_grams(docs, "id", "text", shingle, frequent, similarity)
    pairs = written(prefix_pairs(placed(grams, groups), similarity, crowd), "candidates")
    removed(groups)
    more = similar(pairs.filter("b is not null"))
    linked = linked.unionByName(more)
    crowded = pairs.filter("b is null").select(F.col("a").alias("gram"))
    groups = grouped(linked)
    if not crowded.isEmpty():
        last = groups
        pairs = written(prefix_pairs(placed(grams.join(few(crowded), "gram"), groups), similarity), "candidates")
        if not pairs.isEmpty():
            groups = grouped(linked.unionByName(similar(pairs)))
            removed(last)
    removed(pairs, summary)
    return groups


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` less those whose group (see :func:`similar_groups`) has a smaller id; null ids stay."""
    gone = similar_groups(docs, id_col, text_col, **options).filter("node <> component").select(F.col("node").alias("__loom_gone"))
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__loom_gone"), "left_anti")
