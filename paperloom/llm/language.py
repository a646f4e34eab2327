"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

A token's probability is that of its class given the context, times its own within the class.

* Classes: the ``WORDS`` most frequent words are clustered by the words before them; all other
  words, unknown ones included, fall into classes by their spelling; the end of a text is a
  class of its own.
* P(class | context) is a maximum-entropy model over hashed features: the word before, the two
  words before, and two skips (the second and the third word before, alone). Its weights are
  trained by gradient steps over every training text: each task takes minibatch steps from the
  broadcast weights, and the sums of their steps are averaged block by block on the executors.
* P(word | class): for frequent words a maximum-entropy model on the class before, fitted to
  the gathered counts by gradient steps; for the others add-one over the class, so that
  unknown words have their share.

Counts of all training tokens are gathered by 64-bit hash and never held in one place: the
``HEAVY`` most frequent are broadcast (16 bytes each), the tail is joined by hash. Without
heavy keys the join has no skew.

Nulls and edge cases: null and empty texts are one token, the end; a null id counts as the text
``""`` for the fold; repeated rows are scored alike; with no training text every count is zero.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, IS_BLANK, Lookup, batch_of, mix, prefix_hashes, span_hashes, text_blocks, words_of, written

WORDS = 4096
CLUSTERS = 14
CONTEXTS = 64
HEAVY = 1 << 18
FEATURES = 1 << 13
STEP = 1 << 13
ROUNDS = 1
END = 0x1F3D5B79A2C4E687
#: Spelling classes: digit, beyond ASCII, closing mark.
SPELLINGS = 8
_MARK = np.zeros(256, bool)
_MARK[[33, 44, 46, 58, 59, 63, 34, 41]] = True


@dataclass
class Stream:
    """The tokens of a block in order: hash, spelling class, text, and place in the text."""

    h: np.ndarray
    spelling: np.ndarray
    doc: np.ndarray
    at: np.ndarray


def stream(data: np.ndarray, offsets: np.ndarray) -> Stream:
    low = ASCII_LOWER[data]
    starts, ends, first = words_of(low, offsets, IS_BLANK)
    docs, counts = len(offsets) - 1, np.diff(first)
    doc = np.repeat(np.arange(docs), counts)
    total = len(starts) + docs
    place = np.arange(len(starts)) + doc
    h = np.full(total, np.uint64(END))
    h[place] = span_hashes(prefix_hashes(low), starts, ends)
    digit = np.append(0, np.cumsum((low >= 48) & (low < 58), dtype=np.int32))
    far = np.append(0, np.cumsum(low >= 128, dtype=np.int32))
    spelling = np.zeros(total, np.int64)
    spelling[place] = (digit[ends] > digit[starts]) * 1 + (far[ends] > far[starts]) * 2 + _MARK[low[ends - 1]] * 4
    begin = first[:-1] + np.arange(docs)
    doc = np.repeat(np.arange(docs), counts + 1)
    return Stream(h, spelling, doc, np.arange(total) - begin[doc])


def _fold(ids: pa.Array, folds: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) % folds for i in ids.to_pylist()), np.int64, len(ids))


@dataclass
class Model:
    """Word lists, class statistics and weights; all sizes are constants."""

    words: np.ndarray  # sorted hashes of the frequent words
    word_class: np.ndarray
    weights: np.ndarray  # (4 * FEATURES, classes)
    bias: np.ndarray
    inside: np.ndarray  # (class before + 1, word): natural log of P(word | class, class before)
    spell_total: np.ndarray  # log10 of tokens + distinct + 1, by spelling class
    heavy: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    heavy_count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    cut: int = 0  # the lowest level of counts among the heavy

    def lookup(self, name: str) -> Lookup:
        """The table of ``words`` or ``heavy``, made once a worker."""
        made = self.__dict__.setdefault("_lookups", {})
        if name not in made:
            made[name] = Lookup(getattr(self, name))
        return made[name]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_lookups"}

    def ids(self, s: Stream) -> tuple[np.ndarray, np.ndarray]:
        """The number of each token (a frequent word's, else WORDS + spelling) and its class."""
        at, known = self.lookup("words").find(s.h)
        number = np.where(known, at, WORDS + s.spelling)
        cls = np.where(known, self.word_class[at] if len(self.words) else 0, CLUSTERS + 1 + s.spelling)
        cls[s.h == np.uint64(END)] = CLUSTERS
        return number, cls


CLASSES = CLUSTERS + 1 + SPELLINGS


def contexts(number: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Row of each of the four features in the weight table, by token: (4, tokens)."""
    before = []
    for back in (1, 2, 3):
        b = np.full(len(number), WORDS + SPELLINGS, np.int64)
        b[back:] = number[:-back]
        before.append(np.where(at >= back, b, WORDS + SPELLINGS))
    mask = np.uint64(FEATURES - 1)
    one, two, three = (b.astype(np.uint64) for b in before)
    keys = (one, one * np.uint64(65536) + two + np.uint64(1 << 40), two + np.uint64(1 << 41), three + np.uint64(1 << 42))
    return np.stack([(mix(k) & mask).astype(np.int64) + i * FEATURES for i, k in enumerate(keys)])


def _softmax(weights, bias, f):
    z = weights[f[0]]
    for row in f[1:]:
        z = z + weights[row]
    z += bias
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def local_steps(weights: np.ndarray, bias: np.ndarray, seen: np.ndarray, f: np.ndarray, cls: np.ndarray) -> None:
    """One minibatch step in place, with Adagrad's rates per row (``seen``)."""
    p = _softmax(weights, bias, f)
    p[np.arange(len(cls)), cls] -= 1
    bias -= 0.5 * p.mean(0)
    for row in f:
        order = np.argsort(row.astype(np.uint16), kind="stable")
        r = row[order]
        cut = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        g = np.add.reduceat(p[order], cut, axis=0)
        r = r[cut]
        size = np.diff(np.append(cut, len(row))).astype(np.float32)
        seen[r] += size
        # the mean gradient of a row, at a rate that falls with the times it was seen
        weights[r] -= g / size[:, None] * np.minimum(1.0, 1.2 * size / np.sqrt(seen[r] + 4))[:, None]


def _level() -> Column:
    """A count on a scale of sixteen steps an octave."""
    return F.floor(F.log2("c") * 16).cast("int")


def count_tokens(docs: DataFrame, id_col: str, text_col: str, folds: int, held: int) -> DataFrame:
    """(h, spelling, c): every token of the training texts with its count."""
    schema = pa.schema([("h", pa.int64()), ("spelling", pa.int8()), ("c", pa.int64())])

    def run(batches):
        hold, size = [], 0

        def merged():
            h, s, c = (np.concatenate([x[k] for x in hold]) for k in range(3))
            u, first, back = np.unique(h, return_index=True, return_inverse=True)
            return u, s[first], np.bincount(back, c, len(u)).astype(np.int64)

        for b, data, offsets in text_blocks(batches, "text"):
            s = stream(data, offsets)
            use = (_fold(b.column(0), folds) != held)[s.doc]
            u, first, c = np.unique(s.h[use], return_index=True, return_counts=True)
            hold.append((u, s.spelling[use][first], c))
            size += len(u)
            if size > 1_500_000:  # counts so far are brought together, and leave if still many
                hold = [merged()]
                size = len(hold[0][0])
                if size > 1_000_000:
                    yield batch_of(schema, h=hold[0][0].view(np.int64), spelling=hold[0][1], c=hold[0][2])
                    hold, size = [], 0
        if hold:
            u, s, c = merged()
            yield batch_of(schema, h=u.view(np.int64), spelling=s, c=c)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "h long, spelling byte, c long")
    return rows.groupBy("h").agg(F.first("spelling").alias("spelling"), F.sum("c").alias("c"))


def _cluster(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """k-means of the words' context profiles (square roots of shares), from spread-out frequent words."""
    x = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    centres = [x[0]]
    top = x[: min(len(x), 400)]
    for _ in range(min(CLUSTERS, len(x)) - 1):
        far = np.min([((top - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(top[int(far.argmax())])
    centres = np.array(centres)
    for _ in range(15):
        group = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)).argmin(1)
        for k in range(len(centres)):
            own = group == k
            if own.any():
                centres[k] = np.average(x[own], axis=0, weights=weight[own])
    return group


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, rounds: int = ROUNDS):
    """Train on all texts outside the held-out fold; returns (model, counts table, tokens, distinct)."""
    spark = docs.sparkSession
    counts = written(count_tokens(docs, id_col, text_col, folds, held), "counts")
    totals = counts.agg(F.sum("c"), F.count("*")).first()
    tokens, distinct = int(totals[0] or 0), int(totals[1])
    # heavy: all tokens from a level of counts up, the lowest level that leaves no more than HEAVY
    levels = sorted(((r["level"], r["n"]) for r in counts.groupBy(_level().alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    cut, held_n = 1 << 30, 0
    for level, n in levels:
        held_n += n
        if held_n > HEAVY:
            break
        cut = level
    heavy = counts.filter(_level() >= cut).toArrow()
    if not heavy.num_rows and distinct:  # the highest level alone is too large: the model's words are its first by hash, and all counts are joined
        heavy = counts.orderBy(F.desc("c"), "h").limit(WORDS + 1).toArrow()
    hh, hc = heavy.column("h").to_numpy().view(np.uint64), heavy.column("c").to_numpy()
    order = np.lexsort((hh, -hc))
    hh, hc = hh[order], hc[order]
    frequent = np.flatnonzero(hh != np.uint64(END))[:WORDS]
    by_hash = np.argsort(hh[frequent])
    words, word_count = hh[frequent][by_hash], hc[frequent][by_hash]
    model = Model(words, np.zeros(len(words), np.int64), np.zeros((4 * FEATURES, CLASSES), np.float32), np.zeros(CLASSES, np.float32), np.zeros((CLASSES + 1, WORDS), np.float32), np.zeros(SPELLINGS))
    leading = np.full(WORDS + SPELLINGS + 1, CONTEXTS - 1)
    leading[np.argsort(-word_count, kind="stable")[: CONTEXTS - 1]] = np.arange(min(CONTEXTS - 1, len(words)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pair = pa.schema([("a", pa.int64()), ("c", pa.int64())])

    def pairs(use_classes: bool):
        """Counts of (what comes before, frequent word), gathered sparsely."""
        shared = spark.sparkContext.broadcast(model)
        width = CLASSES + 1 if use_classes else CONTEXTS

        def run(batches):
            m, out = shared.value, np.zeros(width * WORDS, np.int64)
            for b, data, offsets in text_blocks(batches, "text"):
                s = stream(data, offsets)
                use = (_fold(b.column(0), folds) != held)[s.doc]
                number, cls = m.ids(s)
                before = np.append(0, cls[:-1] if use_classes else leading[number[:-1]])
                before[s.at == 0] = CLASSES if use_classes else CONTEXTS - 1
                use &= (number < WORDS) & (cls != CLUSTERS)
                out += np.bincount(before[use] * WORDS + number[use], minlength=len(out))
            some = np.flatnonzero(out)
            yield batch_of(pair, a=some, c=out[some])

        got = rows.mapInArrow(run, "a long, c long").groupBy("a").agg(F.sum("c").alias("c")).toArrow()
        out = np.zeros(width * WORDS, np.int64)
        out[got.column("a").to_numpy()] = got.column("c").to_numpy()
        return out.reshape(width, WORDS)[:, : len(words)]

    if len(words):
        model.word_class = _cluster(pairs(False).T.astype(float), word_count.astype(float))
    listed = set(words.view(np.int64).tolist()) | {END}
    spelled = counts.groupBy("spelling").agg(F.sum("c").alias("c"), F.count("*").alias("v")).toArrow().to_pylist()
    all_c, all_v = np.zeros(SPELLINGS), np.zeros(SPELLINGS)
    for r in spelled:
        all_c[r["spelling"]], all_v[r["spelling"]] = r["c"], r["v"]
    top = counts.join(F.broadcast(spark.createDataFrame([(h,) for h in listed], "h long")), "h").toArrow()
    spelling, c = top.column("spelling").to_numpy(), top.column("c").to_numpy()
    rest_c, rest_v = all_c - np.bincount(spelling, c, SPELLINGS), all_v - np.bincount(spelling, minlength=SPELLINGS)
    model.spell_total = np.log10(rest_c + rest_v + 1)
    # the bias begins at the classes' shares
    mass = np.bincount(model.word_class, word_count, CLASSES) if len(words) else np.zeros(CLASSES)
    mass[CLUSTERS] = hc[hh == np.uint64(END)].sum()
    mass[CLUSTERS + 1 :] = rest_c
    model.bias = np.log((mass + 1) / (mass + 1).sum()).astype(np.float32)
    if len(words):
        _fit_inside(model, pairs(True).astype(float), word_count.astype(float))
    for _ in range(rounds):
        _round(rows, model, folds, held)
    by = np.argsort(hh) if cut < 1 << 30 else np.zeros(0, np.int64)
    model.heavy, model.heavy_count, model.cut = hh[by], hc[by], cut
    return model, counts, tokens, distinct


def _fit_inside(model: Model, pairs: np.ndarray, word_count: np.ndarray, steps: int = 30) -> None:
    """Within-class softmax over bias + weight[class before, word], by gradient steps with a Gaussian prior."""
    n = pairs.shape[1]
    groups = [np.flatnonzero(model.word_class == k) for k in range(CLUSTERS)]
    bias = np.log(word_count + 1)
    theta = np.zeros_like(pairs)
    log_p = np.zeros_like(pairs)
    for step in range(steps + 1):
        for g in groups:
            if len(g):
                z = theta[:, g] + bias[g]
                z -= z.max(1, keepdims=True)
                log_p[:, g] = z - np.log(np.exp(z).sum(1, keepdims=True))
        if step == steps:
            break
        for g in groups:
            if len(g):
                p, seen = np.exp(log_p[:, g]), pairs[:, g]
                expected = seen.sum(1, keepdims=True) * p
                # a diagonal Newton step of at most 1, as a count far above what is expected would throw it; the prior has weight 2
                theta[:, g] += np.clip(0.5 * (seen - expected - 2 * theta[:, g]) / (expected + 2), -1, 1)
    model.inside[:, :n] = log_p


def _round(rows: DataFrame, model: Model, folds: int, held: int) -> None:
    """One pass of distributed gradient steps over all training texts; averages the tasks' weights in place."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    slices = 32
    size = 4 * FEATURES // slices
    schema = pa.schema([("slice", pa.int32()), ("part", pa.int32()), ("w", pa.binary()), ("seen", pa.binary())])

    def run(batches):
        m, part = shared.value, TaskContext.get().partitionId()
        weights, bias = m.weights.copy(), m.bias.copy()
        seen, n = np.zeros(len(weights), np.float32), 0
        for b, data, offsets in text_blocks(batches, "text"):
            s = stream(data, offsets)
            use = np.flatnonzero((_fold(b.column(0), folds) != held)[s.doc])
            number, cls = m.ids(s)
            f = contexts(number, s.at)
            for lo in range(0, len(use), STEP):
                own = use[lo : lo + STEP]
                local_steps(weights, bias, seen, f[:, own], cls[own])
                n += len(own)
        if n:
            delta = (weights - m.weights) * seen[:, None]
            for k in range(slices):
                yield batch_of(schema, slice=[k], part=[part], w=[delta[k * size : (k + 1) * size].astype("<f4").tobytes()], seen=[seen[k * size : (k + 1) * size].tobytes()])
            yield batch_of(schema, slice=[-1], part=[part], w=[((bias - m.bias) * n).astype("<f4").tobytes()], seen=[np.full(1, n, np.float32).tobytes()])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = weight = 0
        for b in batches:
            for w, s in zip(b.column("w").to_pylist(), b.column("seen").to_pylist()):
                seen = np.frombuffer(s, "<f4")
                total = total + np.frombuffer(w, "<f4").reshape(len(seen), -1)
                weight = weight + seen
        yield batch_of(schema, slice=[key[0].as_py()], part=[0], w=[total.astype("<f4").tobytes()], seen=[weight.astype("<f4").tobytes()])

    form = "slice int, part int, w binary, seen binary"
    sums = rows.mapInArrow(run, form).withColumn("part", F.col("part") % 64)  # summed in two levels
    got = sums.groupBy("slice", "part").applyInArrow(add, form).groupBy("slice").applyInArrow(add, form).toArrow()
    for k, w, s in zip(*(got.column(c).to_pylist() for c in ("slice", "w", "seen"))):
        step = np.frombuffer(w, "<f4").reshape(-1, CLASSES) / np.maximum(np.frombuffer(s, "<f4"), 1)[:, None]
        if k < 0:
            model.bias = model.bias + step[0]
        else:
            model.weights[k * size : (k + 1) * size] += step


def score(docs: DataFrame, model: Model, counts: DataFrame, tokens: int, distinct: int, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, in log10."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    part_schema = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("own", pa.float64()), ("base", pa.float64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])
    # base: log10(c + 1) of heavy tokens; logs: the same, of those in spelling classes; own: all else of the model's score

    def run(batches):
        m, rid = shared.value, TaskContext.get().partitionId() << 40
        for b, data, offsets in text_blocks(batches, "text"):
            s = stream(data, offsets)
            docs_n = len(offsets) - 1
            number, cls = m.ids(s)
            f = contexts(number, s.at)
            own = np.empty(len(cls))
            for lo in range(0, len(cls), STEP):
                c = cls[lo : lo + STEP]
                p = _softmax(m.weights, m.bias, f[:, lo : lo + STEP])
                own[lo : lo + STEP] = np.log10(p[np.arange(len(c)), c])
            before = np.append(CLASSES, cls[:-1])
            before[s.at == 0] = CLASSES
            frequent = cls < CLUSTERS
            own[frequent] += m.inside[before[frequent], number[frequent]] / np.log(10)
            spelled = cls > CLUSTERS
            own[spelled] -= m.spell_total[cls[spelled] - CLUSTERS - 1]
            at, hit = m.lookup("heavy").find(s.h)
            log = np.zeros(len(cls))
            log[hit] = np.log10(m.heavy_count[at[hit]] + 1.0)
            bins = lambda w: np.bincount(s.doc, w, docs_n)
            rest = np.flatnonzero(~hit)
            ro = np.lexsort((s.h[rest], s.doc[rest]))
            rh, rd = s.h[rest][ro], s.doc[rest][ro]
            cut = np.flatnonzero(np.append(True, (rh[1:] != rh[:-1]) | (rd[1:] != rd[:-1]))) if len(rh) else np.zeros(0, np.int64)
            lists = np.append(0, np.searchsorted(rd[cut], np.arange(docs_n), "right")).astype(np.int32)
            times = np.diff(np.append(cut, len(rh))).astype(np.int32)
            yield batch_of(
                part_schema, doc_id=b.column(0).cast(pa.int64()), rid=np.arange(rid, rid + docs_n), held_out=_fold(b.column(0), folds) == held,
                n_tokens=np.bincount(s.doc, minlength=docs_n), known=np.bincount(s.doc, hit, docs_n).astype(np.int64), base=bins(log), logs=bins(log * spelled), own=bins(own),
                rare=pa.ListArray.from_arrays(lists, pa.array(rh[cut].view(np.int64))), times=pa.ListArray.from_arrays(lists, pa.array(times)))
            rid += docs_n

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = written(rows.mapInArrow(run, "doc_id long, rid long, held_out boolean, n_tokens long, known long, logs double, own double, base double, rare array<long>, times array<int>"), "parts")
    tail = counts.filter(_level() < model.cut).select("h", "c")
    asked = parts.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("h"), F.col("x.times").alias("k"))
    found = asked.join(tail, "h").groupBy("rid").agg(F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("more"), F.sum("k").alias("seen"))
    whole = F.coalesce(F.col("more"), F.lit(0.0))
    denominator = float(np.log10(tokens + distinct + 1))
    return parts.drop("rare", "times").join(found, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + whole - F.col("n_tokens") * denominator).alias("base_score"), (F.col("own") + F.col("logs") + whole).alias("score"))
