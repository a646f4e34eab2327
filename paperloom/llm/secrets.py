"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

The patterns give the base spans (assignments to a password-like name, access keys, long
hexadecimal runs). The field tags every token as O, B or I from its shape, the hashed words
beside it and features of the whole text, and adds the spans that touch no base span, with
kind ``crf``. It is trained in numpy, by gradient steps on the exact log-likelihood.

No labels exist, so the base spans serve as labels, and the field would only learn the
patterns again. Each span is therefore also shown in forms that no pattern knows: without its
name, under another word of the text and another separator, in upper case, and as letters
and digits of both cases and of other lengths. Windows without secrets are taken at random,
around a text's longest token, and around paths, dates, addresses and numbers made of its own
words. Spans of digits alone teach nothing: the field leaves them to the patterns.

Training reads the texts with the smallest share of hashes, about ``TEXTS`` of them, chosen
before any text reaches Python, and keeps at most ``SAMPLE`` windows of either kind.

Decoding is exact. A token whose score for O leads by more than any change of its two
transitions could repay is O on every best path, so only the runs between such tokens go
through Viterbi, all runs of a block in step. One pass over whole texts, no shuffle.

Nulls and edge cases: null and empty texts have no spans; positions are code points; letter
case is that of ASCII; a text without tokens is skipped; a null id is kept; repeated rows are
scanned alike; a text of any length is read whole, one too long for a block in one piece; a
field that saw no span adds none. Extra columns are left out and may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, batch_of, mix, prefix_hashes, span_hashes, text_blocks

KINDS = ("assign", "access", "hex", "crf")
#: Texts that are read for training, about.
TEXTS = 20_000
#: Windows with secrets, and windows without.
SAMPLE = 3000
WINDOW = 48
#: Bytes on either side of a span in an example.
BESIDE = 240
ROUNDS = 60
#: Tokens of a run that is decoded on its own, and runs decoded together.
LONG = 512
TOGETHER = 1 << 14
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")

_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True
_DIGIT, _LOWER, _UPPER = (np.zeros(256, bool) for _ in range(3))
_DIGIT[48:58] = _LOWER[97:123] = _UPPER[65:91] = True
#: Class of a byte: 0 blank, 1 inside a word, 2 mark.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[128:] = 1
for _c in b"+/_.-":
    _CLASS[_c] = 1
_CLASS[_DIGIT | _LOWER | _UPPER] = 1


def base_spans(raw: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) in bytes, by start and kind."""
    out = []
    low = raw.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 18]
    return out


def hex_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal hexadecimal runs of 16 bytes or more, within texts."""
    inside = np.append(_HEX[data], False)
    before = np.append(False, inside[:-1])
    first = np.zeros(len(inside), bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (~before | first))
    ends = np.flatnonzero(before & (~inside | first))
    long = ends - starts >= 16
    return starts[long], ends[long]


@dataclass
class Tokens:
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    features: list[np.ndarray]


#: Sizes of the feature tables: shape, mix of digits and letters, words before, after, the file, and turns between kinds.
TABLES = (8 * 32, 64, 1024, 1024, 1024, 16 * 4, 8 * 32)
#: Kind of a byte for turns within a token.
_KIND = np.where(_DIGIT, 2, np.where(_UPPER, 1, np.where(_LOWER, 0, 3))).astype(np.int8)
_KIND[128:] = 0
_VOWEL = np.zeros(256, bool)
_VOWEL[list(b"aeiouyAEIOUY")] = True


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Tokens of a block and, for each, one index into each feature table."""
    kind = np.append(_CLASS[data], 0)
    before = np.append(0, kind[:-1])
    first = np.zeros(len(kind), bool)
    first[offsets] = True
    starts = np.flatnonzero((kind > 0) & ((kind != before) | first))
    ends = np.flatnonzero((before > 0) & ((kind != before) | first))
    n, docs = len(starts), len(offsets) - 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    if not n:
        return Tokens(starts, ends, doc, [np.zeros(0, np.int64)] * len(TABLES))

    def number(mask):
        c = np.zeros(len(data) + 1, np.int32)
        np.cumsum(mask, out=c[1:])
        return c[ends] - c[starts]

    size = ends - starts
    digits, lower, upper, hexa = number(_DIGIT[data]), number(_LOWER[data]), number(_UPPER[data]), number(_HEX[data])
    d = _DIGIT[data]
    turns = number(np.append(False, d[1:] != d[:-1])[: len(data)])
    length = np.searchsorted([4, 8, 12, 16, 24, 40, 80], size, "right")
    shape = length * 32 + (digits > 0) * 16 + (lower > 0) * 8 + (upper > 0) * 4 + (hexa == size) * 2 + (digits + lower + upper < size)
    kinds = _KIND[data]
    changes = number(np.append(False, kinds[1:] != kinds[:-1])[: len(data)])
    vowels = number(_VOWEL[data])
    texture = length * 32 + np.searchsorted([1, 2, 3, 4, 6, 9, 13], changes, "right") * 4 + np.minimum(3, vowels * 8 // np.maximum(1, lower + upper))
    ratio = np.minimum(3, digits * 4 // size)
    blend = ratio * 16 + np.minimum(3, (turns + 1) // 2) * 4 + np.minimum(3, (upper * 4) // size)
    word = span_hashes(prefix_hashes(ASCII_LOWER[data]), starts, ends)
    hashed = (mix(word + np.uint64(11)) & np.uint64(1023)).astype(np.int64)

    def beside(step):
        out = np.zeros(n, np.int64)
        if n > abs(step):
            a, b = (slice(step, None), slice(None, -step)) if step > 0 else (slice(None, step), slice(-step, None))
            same = doc[a] == doc[b]
            out[a] = np.where(same, hashed[b], 0)
        return out

    count = np.maximum(1, np.bincount(doc, minlength=docs))
    named = np.bincount(doc, digits >= 4, docs)
    file = np.minimum(3, np.log10(count).astype(np.int64)) * 4 + np.minimum(3, named.astype(np.int64))
    strong = (digits > 0) * 1 + (size >= 12) * 2
    return Tokens(starts, ends, doc, [shape, blend, beside(1), beside(2), beside(-1), file[doc] * 4 + strong, texture])


@dataclass
class Field:
    """Feature tables (rows x O, B, I), transitions and scores of the first label."""

    tables: list[np.ndarray]
    moves: np.ndarray
    start: np.ndarray

    def emissions(self, features: list[np.ndarray]) -> np.ndarray:
        return sum(t[f] for t, f in zip(self.tables, features))

    def decode(self, e: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The best labels of all texts of a block (tokens in order, texts by ``doc``)."""
        n = len(e)
        out = np.zeros(n, np.int8)
        if not n:
            return out
        new = np.append(True, doc[1:] != doc[:-1])
        allowed = self.moves[self.moves > -1e3]
        span = float(max(allowed.max(), self.start[:2].max()) - min(allowed.min(), self.start[:2].min()))
        repay = np.zeros(n)
        repay[:-1] = np.maximum(0, e[1:, 2] - e[1:, 1])
        sure = e[:, 0] - e[:, 1:].max(1) > 3 * span + repay
        at = np.flatnonzero(~sure)
        if not len(at):
            return out
        head = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | new[at[1:]]))
        lens = np.diff(np.append(head, len(at)))
        order = np.argsort(-lens, kind="stable")
        head, lens = at[head[order]], lens[order]
        closed = head + lens < n
        closed[closed] = ~new[head[closed] + lens[closed]]
        long = int(np.searchsorted(-lens, -LONG, "left"))
        for i in range(long):  # a very long run is decoded apart from the rest
            self._one(e, out, int(head[i]), int(lens[i]), bool(new[head[i]]), bool(closed[i]))
        for lo in range(long, len(head), TOGETHER):
            part = slice(lo, lo + TOGETHER)
            self._runs(e, out, head[part], lens[part], new[head[part]], closed[part])
        return out

    def _runs(self, e, out, head, lens, first, closed):
        """Viterbi over runs in step, the longest first."""
        back = np.zeros((int(lens[0]), len(head), 3), np.int8)
        best = np.where(first[:, None], self.start, self.moves[0]) + e[head]
        for t in range(1, int(lens[0])):
            live = int(np.searchsorted(-lens, -t, "left"))
            step = best[:live, :, None] + self.moves
            back[t, :live] = step.argmax(1)
            best[:live] = step.max(1) + e[head[:live] + t]
        label = (best + np.where(closed[:, None], self.moves[:, 0], 0)).argmax(1)
        for t in range(int(lens[0]) - 1, -1, -1):
            live = int(np.searchsorted(-lens, -t, "left"))
            out[head[:live] + t] = label[:live]
            if t:
                label[:live] = back[t, np.arange(live), label[:live]]

    def _one(self, e, out, head, n, first, closed):
        best = (self.start if first else self.moves[0]) + e[head]
        back = np.zeros((n, 3), np.int8)
        for t in range(1, n):
            step = best[:, None] + self.moves
            back[t] = step.argmax(0)
            best = step.max(0) + e[head + t]
        label = int((best + (self.moves[:, 0] if closed else 0)).argmax())
        for t in range(n - 1, -1, -1):
            out[head + t] = label
            label = int(back[t, label])


def _logsum(x, axis):
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def fit(windows: list[tuple[np.ndarray, np.ndarray]]) -> Field:
    """Train on windows of (features by table and token, labels), by Adagrad on the log-likelihood.

    Labels are 0 O, 1 B, 2 I; I never follows O or begins a text.
    """
    field = Field([np.zeros((n, 3)) for n in TABLES], np.zeros((3, 3)), np.zeros(3))
    field.moves[0, 2] = field.start[2] = -1e4
    if not any((y > 0).any() for _, y in windows):
        for t in field.tables[:1]:
            t[:, 0] = 50.0
        return field
    windows = sorted(windows, key=lambda w: -len(w[1]))
    m, longest = len(windows), len(windows[0][1])
    x = np.zeros((len(TABLES), m, longest), np.int64)
    y = np.zeros((m, longest), np.int64)
    lens = np.array([len(w[1]) for w in windows])
    for i, (f, l) in enumerate(windows):
        x[:, i, : len(l)] = f
        y[i, : len(l)] = l
    mask = np.arange(longest)[None] < lens[:, None]
    live = [int((lens > t).sum()) for t in range(longest)]
    sums = [np.zeros_like(t) for t in field.tables] + [np.zeros((3, 3)), np.zeros(3)]
    truth = np.eye(3)[y] * mask[..., None]
    free = np.ones((3, 3), bool)
    free[0, 2] = False
    for _ in range(ROUNDS):
        e = sum(t[x[k]] for k, t in enumerate(field.tables))
        a = np.zeros((longest, m, 3))
        a[0] = field.start + e[:, 0]
        for t in range(1, longest):
            k = live[t]
            a[t, :k] = _logsum(a[t - 1, :k, :, None] + field.moves, 1) + e[:k, t]
        b = np.zeros((longest, m, 3))
        for t in range(longest - 2, -1, -1):
            k = live[t + 1]
            b[t, :k] = _logsum(field.moves + (e[:k, t + 1] + b[t + 1, :k])[:, None, :], 2)
        z = _logsum(a[lens - 1, np.arange(m)], 1)
        p = np.exp(a + b - z[None, :, None]).transpose(1, 0, 2) * mask[..., None]
        move = np.zeros((3, 3))
        for t in range(1, longest):
            k = live[t]
            pair = np.exp(a[t - 1, :k, :, None] + field.moves + (e[:k, t] + b[t, :k])[:, None, :] - z[:k, None, None])
            move += pair.sum(0)
            np.subtract.at(move, (y[:k, t - 1], y[:k, t]), 1)
        wrong = p - truth
        grads = [np.stack([np.bincount(x[k].ravel(), wrong[..., c].ravel(), len(t)) for c in range(3)], 1) + 0.1 * t for k, t in enumerate(field.tables)]
        grads += [move * free, wrong[:, 0].sum(0) * np.array([1, 1, 0])]
        for w, g, s in zip([*field.tables, field.moves, field.start], grads, sums):
            s += g * g
            w -= 0.4 * g / np.sqrt(s + 1e-8)
    return field


def _labels(tok: Tokens, base: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Labels of tokens that lie inside the secret part of a base span (absolute bytes)."""
    y = np.zeros(len(tok.starts), np.int8)
    for _, _, end, secret in base:
        lo, hi = np.searchsorted(tok.starts, secret), np.searchsorted(tok.ends, end, "right")
        if lo < hi:
            y[lo:hi] = 2
            y[lo] = 1
    return y


def _block_base(data, offsets):
    """Base spans of each text, relative to it."""
    raw = data.tobytes()
    found = [base_spans(raw[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
    s, e = hex_runs(data, offsets)
    for a, b, i in zip(s.tolist(), e.tolist(), (np.searchsorted(offsets, s, "right") - 1).tolist()):
        o = int(offsets[i])
        found[i].append((a - o, 2, b - o, a - o))
    for f in found:
        f.sort()
    return found


_TOKENS = re.compile(rb"[A-Za-z\x80-\xff]+")
_SEPARATORS = (b": ", b"=", b" = ", b" ", b"' : '", b":")
_ALPHABETS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_/+", b"abcdefghijklmnopqrstuvwxyz0123456789", b"ABCDEF0123456789")


def _drawn(key: bytes, n: int) -> list[int]:
    """``n`` numbers that follow from ``key``."""
    return list(hashlib.shake_128(key).digest(n))


def _shown(raw: bytes, start: int, end: int, secret: int) -> list[tuple[bytes, int, int]]:
    """(text, start, end of the value) of the forms in which a span is shown."""
    left, right, value = raw[max(0, start - BESIDE) : start], raw[end : end + BESIDE], raw[secret:end]
    pick = _drawn(raw[start:end] + b"|%d" % start, 64)
    words = _TOKENS.findall(left + b" " + right) or [b"x"]
    name = words[pick[0] % len(words)][:20] + _SEPARATORS[pick[1] % len(_SEPARATORS)]
    out = [(left + raw[start:end] + right, secret - start, end - start)]
    for k, (cue, alphabet) in enumerate(((b"", None), (name, None), (name, _ALPHABETS[0]), (b"", _ALPHABETS[pick[2] % 4]), (name, _ALPHABETS[pick[3] % 4]))):
        v = value
        if alphabet:
            v = bytes(alphabet[i % len(alphabet)] for i in _drawn(value + b"%d" % k, 18 + pick[4 + k] % 30))
        elif k and not pick[9] % 2:
            v = value.upper()
        out.append((left + cue + v + right, len(cue), len(cue) + len(v)))
    return [(t, len(left) + a, len(left) + b) for t, a, b in out]


def _plain(raw: bytes) -> list[bytes]:
    """A text's words as a path, an address, a name of several parts, and beside a date and numbers."""
    words = _TOKENS.findall(raw[:4000])[:40]
    if len(words) < 8:
        return []
    d = _drawn(raw[:4000], 24)
    w = [words[i % len(words)] for i in d]
    made = (
        b"/" + b"/".join(w[:4]) + b"%d.%d/" % (d[0] % 4, d[1]) + w[4] + b".py", w[0] + b".%d@" % d[2] + w[1] + b"%d.example.org" % d[3], b"_".join(w[2:6]) + b"_%d" % d[4],
        b"20%02d-%02d-%02dT%02d:%02d:%02d.%03dZ" % (d[5] % 40, 1 + d[6] % 12, 1 + d[7] % 28, d[8] % 24, d[9] % 60, d[10] % 60, d[11]), b"%d%03d%03d%03d" % (1 + d[12], d[13], d[14], d[15]), w[6].capitalize() + w[7].capitalize() + w[8].capitalize() + b"%d" % (d[16] % 9), b"v%d.%d.%d-" % (d[17], d[18], d[19]) + w[9], w[10] + b"-" + w[11] + b"-%d" % d[20],
    )
    return [b" ".join([*words[:12], made[(d[21] + j) % len(made)], *words[12:24], made[(d[21] + j + 4) % len(made)], *words[24:]]) for j in range(2)]


def _window(tok: Tokens, y: np.ndarray, lo: int, hi: int, mid: int) -> tuple[bytes, bytes]:
    a = max(lo, min(mid - WINDOW // 2, hi - WINDOW))
    z = min(hi, a + WINDOW)
    return np.stack([x[a:z] for x in tok.features]).astype(np.int32).tobytes(), y[a:z].astype(np.int8).tobytes()


def examples(raw: bytes, base: list[tuple[int, int, int, int]]) -> list[tuple[bool, bytes, bytes]]:
    """(with a secret, features, labels) of the windows that one text gives."""
    out, taught = [], {}
    for start, _, end, secret in base:
        if not raw[secret:end].isdigit():
            taught.setdefault(secret, (start, end, secret))
    texts = [f for span in taught.values() for f in _shown(raw, *span)]
    texts += [(t, -1, -1) for t in _plain(raw)] + ([] if base else [(raw, -1, -1)])
    for lo in range(0, len(texts), 64):
        part = texts[lo : lo + 64]
        offsets = np.append(0, np.cumsum([len(t) for t, _, _ in part]))
        data = np.frombuffer(b"".join(t for t, _, _ in part), np.uint8)
        tok, found = tokens_of(data, offsets), _block_base(data, offsets)
        first = np.searchsorted(tok.doc, np.arange(len(part) + 1)).tolist()
        spans = [(s + int(offsets[i]), k, e + int(offsets[i]), v + int(offsets[i])) for i, f in enumerate(found) for s, k, e, v in f if not part[i][0][v:e].isdigit()]
        spans += [(a + int(offsets[i]), 0, b + int(offsets[i]), a + int(offsets[i])) for i, (_, a, b) in enumerate(part) if a >= 0]
        y = _labels(tok, spans)
        for i, (_, a, _) in enumerate(part):
            x, z = first[i], first[i + 1]
            if x == z:
                continue
            if a >= 0:
                out.append((True, *_window(tok, y, x, z, int(np.searchsorted(tok.starts, a + int(offsets[i]))))))
            else:
                size = (tok.ends - tok.starts)[x:z]
                for mid in {x + int(size.argmax()), x + (z - x) // 2}:
                    out.append((False, *_window(tok, y, x, z, mid)))
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, texts: int = TEXTS) -> Field:
    """Fit on at most ``sample`` windows with secrets and as many without, of about ``texts`` texts, by hash."""
    schema = pa.schema([("h", pa.int64()), ("some", pa.bool_()), ("f", pa.binary()), ("y", pa.binary())])

    def least(rows: list[tuple]) -> list[tuple]:
        """The ``sample`` rows of either kind with the smallest hash."""
        rows.sort(key=lambda r: (r[1], r[0], r[2]))
        with_spans = [r for r in rows if r[1]]
        return with_spans[:sample] + [r for r in rows if not r[1]][:sample]

    def emitted(rows: list[tuple]) -> pa.RecordBatch:
        return batch_of(schema, **{f.name: list(c) for f, c in zip(schema, zip(*rows) if rows else [[]] * 4)})

    def cut(batches):
        kept: list[tuple] = []
        for b, data, offsets in text_blocks(batches, "text"):
            raw, edge = data.tobytes(), offsets.tolist()
            for i, (h, base) in enumerate(zip(b.column(0).to_pylist(), _block_base(data, offsets))):
                for n, (some, f, y) in enumerate(examples(raw[edge[i] : edge[i + 1]], base)):
                    kept.append((int.from_bytes(hashlib.blake2b(b"%d:%d" % (h, n), digest_size=8).digest(), "little", signed=True), some, f, y))
                if len(kept) > 4 * sample:
                    kept = least(kept)
        yield emitted(least(kept))

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        for b in batches:
            kept = least(kept + list(zip(*(b.column(f.name).to_pylist() for f in schema))))
        yield emitted(kept)

    form = "h long, some boolean, f binary, y binary"
    every = max(1, docs.count() // texts)
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("id"), F.col(text_col).alias("text"))
    # rows that repeat id and text count once, so a hot row adds one text
    rows = rows.filter(F.pmod("id", F.lit(every)) == 0).distinct().mapInArrow(cut, form)
    some = rows.withColumn("part", F.spark_partition_id() % 32).groupBy("part").applyInArrow(merge, form).withColumn("part", F.lit(0)).groupBy("part").applyInArrow(merge, form)
    windows = []
    for r in sorted(some.toArrow().to_pylist(), key=lambda r: (r["h"], r["f"])):
        y = np.frombuffer(r["y"], np.int8).astype(np.int64)
        if y[0] == 2:
            y[0] = 1
        windows.append((np.frombuffer(r["f"], np.int32).reshape(len(TABLES), -1), y))
    return fit(windows)


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<start, kind, end>>) of every row, in code points, by start and kind."""
    shipped = docs.sparkSession.sparkContext.broadcast(field)
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])

    def run(batches):
        f = shipped.value
        for b, data, offsets in text_blocks(batches, "text"):
            tok, found = tokens_of(data, offsets), _block_base(data, offsets)
            y = f.decode(f.emissions(tok.features), tok.doc)
            heads = np.flatnonzero(y == 1)
            inside = np.append(y == 2, False)
            run_end = np.flatnonzero(~inside)  # the first token after each that is not I
            last = run_end[np.searchsorted(run_end, heads + 1)] - 1
            added = [[] for _ in found]
            for i, s, e in zip(tok.doc[heads].tolist(), tok.starts[heads].tolist(), tok.ends[last].tolist()):
                s, e = s - int(offsets[i]), e - int(offsets[i])
                if not any(x[0] < e and s < x[2] for x in found[i]):
                    added[i].append((s, 3, e))
            out = []
            for i, base in enumerate(found):
                spans = [(s, k, e) for s, k, e, _ in base] + added[i]
                if spans:
                    text = data[offsets[i] : offsets[i + 1]]
                    points = np.append(0, np.cumsum((text & 0xC0) != 0x80))
                    spans = sorted((int(points[s]), k, int(points[e])) for s, k, e in spans)
                out.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            yield batch_of(schema, doc_id=b.column(0), spans=out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<start:long,kind:int,end:long>>")
