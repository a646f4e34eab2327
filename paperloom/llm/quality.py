"""Quality classifier: averaged subword embeddings under a softmax, trained by numpy SGD.

A text is the mean of learned vectors of its hashed features: its words, differences of
neighbouring words (equal neighbours share one bucket) and its character n-grams within and
at the borders of words. Two softmax outputs follow. As the mean and the output are linear
before the softmax, a trained model folds into one number per bucket, and scoring is a
lookup and a mean: one pass over whole texts, no shuffle, a table of ``BUCKETS`` floats
broadcast.

Training reads at most ``SAMPLE`` labelled rows, those with the smallest hash of their id;
their features are counted on the executors and at most ``SAMPLE`` sparse rows reach the
driver. Everything else covers all rows.

Nulls and edge cases: null and empty texts have no features and score the model's bias;
null labels and null ids are left out of training; an id with several labels counts as 1 if
any is 1, and rows that repeat an id train as one; a text of any length is read whole, in
blocks; without labels of both classes every score is the share of 1 (0.5 for none).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import IS_BLANK, batch_of, mix, prefix_hashes, release, span_hashes, text_blocks, words_of

BUCKETS = 1 << 17
GRAMS = (3, 4)
SAMPLE = 3000
DIM = 12
#: Bytes of text whose n-grams a worker expands at once.
BLOCK = 1 << 19
EPOCHS = 6
RATE = 0.6


def features(data: np.ndarray, offsets: np.ndarray):
    """Yields (text index, bucket) arrays, a family of features at a time; indexes ascend."""
    mask = np.uint64(BUCKETS - 1)
    starts, ends, first = words_of(data, offsets, IS_BLANK)
    prefix = prefix_hashes(np.where(IS_BLANK[data], np.uint8(32), data))
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    word = span_hashes(prefix, starts, ends)
    yield doc, (word & mask).astype(np.int64)
    both = np.flatnonzero(doc[1:] == doc[:-1])
    yield doc[both], (mix(word[both + 1] - word[both] + np.uint64(0x51)) & mask).astype(np.int64)
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    edge = np.append(chars, len(data))
    blank = np.cumsum(np.append(0, IS_BLANK[data[chars]]))
    owner = np.repeat(np.arange(n), np.diff(np.searchsorted(chars, offsets)))
    for k in GRAMS:
        at = np.arange(max(0, len(chars) - k + 1))
        # a blank may stand at either end of a gram, not inside
        at = at[(owner[at] == owner[at + k - 1]) & (blank[at + k - 1] == blank[at + 1])] if len(at) else at
        yield owner[at], (span_hashes(prefix, edge[at], edge[at + k]) & mask).astype(np.int64)


def counted(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their counts, by text."""
    n = len(offsets) - 1
    keys = np.concatenate([d * BUCKETS + b for d, b in features(data, offsets)] or [np.zeros(0, np.int64)])
    key, count = np.unique(keys, return_counts=True)
    cut = np.searchsorted(key, np.arange(n + 1) * BUCKETS)
    return [((key[a:b] % BUCKETS).astype(np.int32), count[a:b].astype(np.int32)) for a, b in zip(cut, cut[1:])]


@dataclass
class Model:
    """A folded model: the difference of the two outputs per bucket, and of their biases."""

    weights: np.ndarray
    bias: float

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total, count = np.zeros(n), np.zeros(n)
        for doc, bucket in features(data, offsets):
            total += np.bincount(doc, self.weights[bucket], n)
            count += np.bincount(doc, minlength=n)
        return total / np.maximum(count, 1) + self.bias

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(data, offsets), -500, 500)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """Train on (label, buckets, counts) by stochastic gradient descent, a text a step."""
    labels = np.array([r[0] for r in rows], np.int64)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    steps, step = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            rate = RATE * (1 - step / steps)
            step += 1
            _, bucket, count = rows[i]
            w = count / np.float32(count.sum())
            hidden = w @ vectors[bucket]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= rate * 0.1 * p
            # the step of a vector is its share of the text, scaled to the text's number of features
            vectors[bucket] -= rate * 20 * w[:, None] * back
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", where: Column | None = None, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows (of those that satisfy ``where``, over the labels' id column)."""
    rows = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.filter(where) if where is not None else rows
    chosen = (
        rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    schema = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("buckets", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for b, data, offsets in text_blocks(batches, "text", BLOCK):
            found = counted(data, offsets)
            yield batch_of(schema, id=b.column(0), label=b.column(1), buckets=[x.tobytes() for x, _ in found], counts=[c.tobytes() for _, c in found])

    # rows that repeat an id are one training row, the one with the greatest text
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id").agg(F.max("label").alias("label"), F.max("text").alias("text"))
    got = texts.select("id", "label", "text").mapInArrow(run, "id long, label int, buckets binary, counts binary").toArrow()
    ids, labels_of = (got.column(c).to_numpy() for c in ("id", "label"))
    raw = [_views(got.column(c), kind) for c, kind in (("buckets", np.int32), ("counts", np.int32))]
    order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(b"%d" % ids[i]), ids[i], len(raw[0][i]), raw[0][i].tobytes()[:64]))
    model = fit([(int(labels_of[i]), raw[0][i], raw[1][i]) for i in order if len(raw[0][i])])
    del got, raw  # the driver keeps nothing of the sample
    release()
    return model


def _views(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    """Arrays over the bytes of a binary column, without copies."""
    out = []
    for chunk in column.chunks:
        offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(chunk.buffers()[2] or b"", np.uint8)
        out += [np.frombuffer(data[a:b].data, kind) for a, b in zip(offsets, offsets[1:])]
    return out


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column of the probability of label 1, after all its own columns (names may clash)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            names = [*(f"c{i}" for i in range(at)), "text", *(f"c{i}" for i in range(at + 1, batch.num_columns))]
            for rows, data, offsets in text_blocks(iter([batch.rename_columns(names)]), "text", BLOCK):
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(shipped.value.probabilities(data, offsets))], [*docs_names, name])

    docs_names = docs.columns
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))
