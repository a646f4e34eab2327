"""Benchmark decontamination by winnowing.

A window of ``window`` words shared by a text and a benchmark item contains
``window - k + 1`` k-grams. Both sides keep the smallest k-gram hash of every run of that many
k-grams, so every shared span of ``window`` words or more has a kept k-gram in common. Kept
hashes are joined, each match is extended word by word to both sides, and a run of at least
``window`` equal words is a hit. Items shorter than a window have one phrase each, which is
looked up at every position. Words are compared as bytes after the hashes agree, so a hash
collision costs time only.

The benchmark is gathered in blocks of at most ``BLOCK`` bytes of text. A single block is
shipped to the tasks and the texts are read once, with no shuffle. A larger benchmark takes
one pass a block and the positions hit are united by document; results are the same.

Nulls and edge cases: null and empty texts have no words and no hits; an item without words
never occurs; items that repeat count by their distinct id, which may be a number or text; a
null item id is ignored; null document ids are kept, and repeated rows are judged alike; a
text of any length is read whole, and a shared span is compared once however long it is.
Extra columns may have any name.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, NOT_ALNUM, batch_of, mix, prefix_hashes, span_hashes, text_blocks, words_of, written

K = 6
BLOCK = 8 << 20
_STEP = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h = h * _STEP + words[j : j + n]
    return mix(h)


def winnowed(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest hash, ties included, of every run of ``w`` hashes."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = h[:n].copy()
    for j in range(1, w):
        np.minimum(low, h[j : j + n], out=low)
    chosen = np.zeros(len(h), bool)
    for j in range(w):
        chosen[j : j + n] |= h[j : j + n] == low
    return np.flatnonzero(chosen)


def split_words(data: np.ndarray, offsets: np.ndarray):
    """(lower-case bytes, word starts, word ends, first word of each text, word hashes)."""
    low = ASCII_LOWER[data]
    starts, ends, first = words_of(low, offsets, NOT_ALNUM)
    return low, starts, ends, first, span_hashes(prefix_hashes(low), starts, ends)


class Index:
    """Kept k-grams and short phrases of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, str]], window: int, k: int):
        self.window, self.k, self.items = window, k, []
        grams: dict[int, list[tuple[int, int]]] = {}
        self.short: dict[int, dict[int, list[int]]] = {}
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            low, starts, ends, _, hashes = split_words(raw, np.array([0, len(raw)]))
            if not len(starts) or item is None:
                continue
            number = len(self.items)
            raw = low.tobytes()
            self.items.append((item, [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]))
            if len(starts) < window:
                self.short.setdefault(len(starts), {}).setdefault(int(gram_hashes(hashes, len(starts))[0]), []).append(number)
                continue
            g = gram_hashes(hashes, k)
            for at in winnowed(g, window - k + 1).tolist():
                grams.setdefault(int(g[at]), []).append((number, at))
        self.hashes = np.array(sorted(grams), np.uint64)
        self.places = [grams[h] for h in self.hashes.tolist()]

    def hits(self, data: np.ndarray, offsets: np.ndarray):
        """(words of each text, {text: (positions hit, items, those of them with a whole window)})."""
        low, starts, ends, first, hashes = split_words(data, offsets)
        raw = low.tobytes()
        seen: dict[tuple[int, int, int], int] = {}  # how far a text and an item have been compared, by the distance of their words
        found: dict[int, tuple[set[int], set[str], set[str]]] = {}

        def word(i):
            return raw[starts[i] : ends[i]]

        def mark(doc, lo, hi, item, whole):
            positions, items, windows = found.setdefault(doc, (set(), set(), set()))
            positions.update(range(lo, hi))
            items.add(item)
            if whole:
                windows.add(item)

        g = gram_hashes(hashes, self.k)
        at = winnowed(g, self.window - self.k + 1)
        if len(self.hashes):
            place = np.minimum(np.searchsorted(self.hashes, g[at]), len(self.hashes) - 1)
            for i, p in zip(at[self.hashes[place] == g[at]].tolist(), place[self.hashes[place] == g[at]].tolist()):
                doc = int(np.searchsorted(first, i, "right")) - 1
                lo_end, hi_end = int(first[doc]), int(first[doc + 1])
                for number, q in self.places[p]:
                    item, words = self.items[number]
                    if i < seen.get((doc, number, i - q), 0):
                        continue
                    lo = hi = 0
                    while i + hi < hi_end and q + hi < len(words) and word(i + hi) == words[q + hi]:
                        hi += 1
                    while i - lo > lo_end and q - lo > 0 and word(i - lo - 1) == words[q - lo - 1]:
                        lo += 1
                    seen[doc, number, i - q] = i + hi
                    if lo + hi >= self.window:
                        mark(doc, i - lo, i + hi, item, True)
        for n, phrases in self.short.items():
            g = gram_hashes(hashes, n)
            for i in np.flatnonzero(np.isin(g, np.array(sorted(phrases), np.uint64))).tolist():
                doc = int(np.searchsorted(first, i, "right")) - 1
                if i + n <= first[doc + 1]:
                    for number in phrases[int(g[i])]:
                        item, words = self.items[number]
                        if all(word(i + j) == words[j] for j in range(n)):
                            mark(doc, i, i + n, item, False)
        return np.diff(first), found


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block: int):
    """Blocks of (item, text); the driver holds one block at a time."""
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).filter(F.col(text_col).isNotNull()).distinct()
    held, size = [], 0
    for item, text in rows.toLocalIterator():
        held.append((item, text))
        size += len(text)
        if size >= block:
            yield held
            held, size = [], 0
    if held:
        yield held


def _with_last(blocks):
    """Each block with whether it is the last; one block is held ahead."""
    held = next(blocks, None)
    while held is not None:
        ahead = next(blocks, None)
        yield held, ahead is None
        held = ahead


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, k: int = K, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items array<string>) of every row.

    A row is contaminated when it has a hit and at least one word in twenty is hit.
    """
    raw = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("n_words", pa.int64()), ("hit", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
    spark = docs.sparkSession

    def one(rows: DataFrame, items) -> DataFrame:
        index = spark.sparkContext.broadcast(Index(items, window, k))

        def run(batches):
            for b, data, offsets in text_blocks(batches, "text"):
                n, found = index.value.hits(data, offsets)
                yield batch_of(raw, doc_id=b.column(0), rid=b.column(1), n_words=n,
                               hit=[sorted(found[i][0]) if i in found else [] for i in range(len(n))],
                               items=[sorted(found[i][1]) if i in found else [] for i in range(len(n))])

        return rows.mapInArrow(run, "doc_id long, rid long, n_words long, hit array<long>, items array<string>")

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.col(text_col).alias("text"))
    out, more = None, []
    for items, last in _with_last(_blocks(benchmark, item_col, item_text, block)):
        if out is None:
            out = one(rows, items)  # the first pass gives every row
            out = out if last else written(out, "winnowed")
        else:  # of the others only rows with hits are kept; a pass ends before the next block is read
            more.append(written(one(rows, items).filter("size(items) > 0"), "winnowed"))
    out = out if out is not None else one(rows, [])
    if more:
        found = reduce(DataFrame.unionByName, more).groupBy("rid").agg(
            F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit2"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items2"))
        out = out.join(found, "rid", "left").select(
            "doc_id", "rid", "n_words", F.array_union("hit", F.coalesce("hit2", F.array().cast("array<long>"))).alias("hit"),
            F.array_sort(F.array_union("items", F.coalesce("items2", F.array().cast("array<string>")))).alias("items"))
    return out.select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.size("hit") > 0) & (F.size("hit") * 20 >= F.col("n_words"))).alias("contaminated"), "items")



def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, k: int = K, block: int = BLOCK, any_window: bool = False) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns, in one pass a block.

    With ``any_window`` a row that holds a whole window of an item goes too, however long its
    text. Phrases of items shorter than a window, which may be a common word, then still count
    by their share of words only.
    """
    spark, hits, names = docs.sparkSession, "__loom_hits", docs.columns
    rows = docs.withColumn(hits, F.array().cast("array<long>"))
    at = names.index(text_col)
    for items, last in _with_last(_blocks(benchmark, item_col, item_text, block)):
        index = spark.sparkContext.broadcast(Index(items, window, k))

        def run(batches, index=index, last=last):
            for b in batches:
                for part, data, offsets in text_blocks(iter([b.rename_columns([*(f"c{i}" for i in range(at)), "text", *(f"c{i}" for i in range(at + 1, b.num_columns))])]), "text"):
                    n, found = index.value.hits(data, offsets)
                    old = part.column(part.num_columns - 1).to_pylist()
                    new = [sorted(set(o).union(found[i][0])) if i in found else o for i, o in enumerate(old)]
                    part = pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(new, pa.list_(pa.int64()))], names=[*names, hits])
                    gone = [any_window and i in found and bool(found[i][2]) for i in range(len(new))]
                    if last:
                        gone = [g or bool(x and 20 * len(x) >= m) for g, x, m in zip(gone, new, n.tolist())]
                    part = part.filter(pa.array([not g for g in gone], pa.bool_()))
                    yield part

        rows = rows.mapInArrow(run, rows.schema)
        if not last:
            rows = written(rows, "winnowed")
    return rows.drop(hits)


__all__ = ["Index", "clean", "contaminated", "gram_hashes", "winnowed"]
