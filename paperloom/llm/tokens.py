"""Token ids of whole texts, by a public tokenizer and a cache of its pieces.

Both vocabularies split a text before they merge. A block of texts is cut at points where
they always split: around blanks, between a letter and a mark that follows it and, for words,
around digits. So the ids of a text are those of its pieces in turn. Pieces repeat: a block's
distinct pieces are found on Arrow buffers, those met before are looked up, and the rest go
to the tokenizer many at a time: pieces of Latin letters alone to its merges, split at line
ends, and all others to the whole tokenizer, set apart by a mark that is one token of its own.

The cache of a worker is a sorted table of 128-bit hashes of pieces and their ids, about 40
bytes a piece. At ``KEPT`` pieces those not met since the last time go. No result depends on it.

Strings of special tokens in a text give their ids, as the library has it by default; pass
``specials=False`` to read them as ordinary text.
"""

from __future__ import annotations

import codecs
import re
from functools import cache

import numpy as np
import pyarrow as pa

from .common import prefix_hashes, span_hashes

#: Bytes of text that are tokenised at once.
BLOCK = 2 << 20
#: Pieces a worker keeps.
KEPT = 700_000
#: Longer pieces are not kept.
_LONGEST = 64
_JOINED = 1024
#: Letters below this one have no decompositions that stand alone and no case rules by context.
_LATIN = "\u0130"

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: Marks that never begin a contraction.
_MARK = np.zeros(256, bool)
for _c in b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~":
    _MARK[_c] = True
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def vocabulary(name: str) -> str:
    """Path of a vocabulary file of the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _blanks(data: np.ndarray) -> np.ndarray:
    """Marks of every byte of a white-space character, beyond ASCII as well."""
    out = _BLANK[data]
    for at in np.flatnonzero(_LEADS[data]).tolist() if _LEADS[data].any() else ():
        lead = int(data[at])
        size = 2 if lead == 0xC2 else 3
        char = bytes(data[at : at + size])
        if len(char) == size and char.decode("utf-8", "replace").isspace():
            out[at : at + size] = True
    return out


def _cuts(data: np.ndarray, offsets: np.ndarray, byte_level: bool) -> np.ndarray:
    """Starts of the pieces of a block: all texts' starts, and points where the tokenizer always splits."""
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    ascii_blank = _BLANK[data]

    def before(x):
        out = np.zeros(n, bool)
        out[1:] = x[:-1]
        return out

    letter = _LETTER[data]
    latin = np.zeros(n, bool)  # the last byte of a letter of Latin-1
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    cut = first[:n] | (_MARK[data] & before(letter | latin))
    if byte_level:
        blank = _blanks(data)
        after = np.zeros(n, bool)
        after[:-1] = ~blank[1:] & ~first[1:n]
        cut |= blank & ~before(blank)
        cut |= ascii_blank & after
        cut |= before(ascii_blank & (data != 32)) & ~blank
    else:
        digit, plain = _DIGIT[data], data < 128
        cut |= ascii_blank & ~before(ascii_blank)
        cut |= digit & before(plain)
        cut |= before(digit) & plain
    return np.flatnonzero(cut)


class Pieces:
    """The kept pieces, sorted by hash: a second hash to be sure, and where their ids lie."""

    def __init__(self):
        self._set(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, "<u4"))

    def _set(self, h, check, begin, size, ids):
        self.h, self.check, self.begin, self.size, self.ids, self.met = h, check, begin, size, ids, np.zeros(len(h), bool)

    def find(self, h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, size) of the ids of each piece; size -1 for those not kept."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.full(len(h), -1)
        order = np.argsort(h)  # in order, so that the search stays in the processor's cache
        at = np.empty(len(h), np.int64)
        at[order] = np.minimum(np.searchsorted(self.h, h[order]), len(self.h) - 1)
        hit = (self.h[at] == h) & (self.check[at] == check)
        self.met[at[hit]] = True
        return self.begin[at].astype(np.int64), np.where(hit, self.size[at].astype(np.int64), -1)

    def add(self, h, check, begin, size, ids) -> None:
        """Keep more pieces; ``ids`` holds the ids of all."""
        met = np.append(self.met, np.ones(len(h), bool))
        h, check = np.append(self.h, h), np.append(self.check, check)
        begin, size = np.append(self.begin, begin.astype(np.int32)), np.append(self.size, size.astype(np.int32))
        order = np.argsort(h, kind="stable")
        if len(h) > KEPT:
            order = order[met[order]]
            if len(order) > KEPT // 2:  # all in use: the later half of them by hash, as good as any
                order = order[len(order) // 2 :]
            length = size[order].astype(np.int64)
            to = np.cumsum(length) - length
            ids = ids[np.repeat(begin[order] - to, length) + np.arange(int(length.sum()))]
            self._set(h[order], check[order], to.astype(np.int32), size[order], ids)
            return
        self._set(h[order], check[order], begin[order], size[order], ids)
        self.met = met[order]


class Encoder:
    """A tokenizer file, loaded once a worker, with its cache of pieces."""

    def __init__(self, path: str, specials: bool = True):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not specials
        self.byte_level = type(self.tok.pre_tokenizer).__name__ == "ByteLevel"
        self.named = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()] if specials else []
        # a piece that may be joined to others: no blank but one before it, and not the mark that joins
        self.mark, self.joinable = ("\n", re.compile(r" ?\S+")) if self.byte_level else (" | ", re.compile(r"\s?[^\s|]+"))
        [self.mark_id] = self._plain(self.mark)
        # the merges alone, over letters that stand for bytes as the tokenizer has them
        self.merges = Tokenizer(self.tok.model)
        stand, letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), ["?"] * 256
        for char in map(chr, range(ord(_LATIN))):
            [(mapped, _)] = stand.pre_tokenize_str(char)
            for byte, letter in zip(char.encode(), mapped):
                letters[byte] = letter
        self.letters = "".join(letters)
        self.merges.pre_tokenizer = pre_tokenizers.Split(letters[10], "isolated")
        [self.line_end] = self.merges.encode(letters[10]).ids
        self.kept = Pieces()

    def _plain(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _joined(self, tok, texts: list[str], mark: int) -> list[bytes]:
        """The ids of joined texts, cut at the id that joins them."""
        out = []
        for e in tok.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(e.ids, "<u4")
            raw, ends = ids.tobytes(), (4 * np.flatnonzero(ids == mark)).tolist()
            out.append([raw[a:b] for a, b in zip([0, *(x + 4 for x in ends)], [*ends, len(raw)])])
        return out

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """The ids of new pieces, little-endian u32."""
        texts = [p.decode("utf-8", "replace") for p in new]
        out: list[bytes | None] = [None] * len(new)
        plain, fits = [], []
        for i, t in enumerate(texts):
            if t.isalpha() or t[1:].isalpha() and t[0] in (" " if self.byte_level else " \t\n\v\f\r"):
                (plain if max(t) < _LATIN else fits).append(i)
            elif self.joinable.fullmatch(t) and "<|" not in t:
                fits.append(i)
        for tok, mark, line, own in ((self.merges, self.line_end, "\n", plain), (self.tok, self.mark_id, self.mark, fits)):
            parts = [own[lo : lo + _JOINED] for lo in range(0, len(own), _JOINED)]
            if own is plain:
                words = [[texts[i] if self.byte_level else texts[i].strip().lower() for i in p] for p in parts]
                joined = [codecs.charmap_decode(line.join(w).encode(), "strict", self.letters)[0] for w in words]
            else:
                joined = [line.join([texts[i] for i in p]) for p in parts]
            for lo in range(0, len(parts), 8):
                for part, found in zip(parts[lo : lo + 8], self._joined(tok, joined[lo : lo + 8], mark)):
                    if len(found) == len(part):
                        for i, ids in zip(part, found):
                            out[i] = ids
        for i, found in enumerate(out):
            if found is None:
                out[i] = np.array(self._plain(texts[i]), "<u4").tobytes()
        return out

    def _values(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, size): the ids of distinct pieces, by the place and number of each."""
        edge = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        data = np.frombuffer(pieces.buffers()[2], np.uint8)[edge[0] : edge[-1]]
        edge = edge - edge[0]
        h, check = (span_hashes(prefix_hashes(data, base), edge[:-1], edge[1:], base) for base in (0, 1))
        begin, size = self.kept.find(h, check)
        new = np.flatnonzero(size < 0)
        if not len(new):
            return self.kept.ids, begin, size
        values = self._learn(pieces.take(pa.array(new)).to_pylist())
        ids = np.frombuffer(b"".join(values), "<u4")
        size[new] = np.fromiter(map(len, values), np.int64, len(values)) // 4
        own = np.cumsum(size[new]) - size[new]
        begin[new] = len(self.kept.ids) + own
        ids = np.concatenate([self.kept.ids, ids])
        short = np.diff(edge)[new] <= _LONGEST
        self.kept.add(h[new][short], check[new][short], begin[new][short], size[new][short], ids)
        return ids, begin, size

    def block(self, data: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids (u32) of a block of texts, each closed by ``end``, and the place where each text's begin."""
        docs = len(offsets) - 1
        starts = _cuts(data, offsets, self.byte_level)
        if self.named:
            raw = data.tobytes()
            for name in self.named:
                if name in raw:
                    starts = self._whole(raw, name, offsets, starts)
        m = len(starts)
        if m:
            bounds = np.append(starts, len(data)).astype(np.int64)
            found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), m, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
            number, (flat, begin, size) = found.indices.to_numpy(), self._values(found.dictionary)
        else:
            number, flat, begin, size = np.zeros(0, np.int64), np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        length = size[number]
        first = np.searchsorted(starts, offsets)
        total = np.append(0, np.cumsum(length))
        ids = flat[np.repeat((begin[number] - total[:-1]), length) + np.arange(int(total[-1]))]
        cuts = total[first]
        if end is None:
            return ids, cuts
        cuts = cuts + np.arange(docs + 1)
        out, own = np.full(int(cuts[-1]), end, "<u4"), np.ones(int(cuts[-1]), bool)
        own[cuts[1:] - 1] = False
        out[own] = ids
        return out, cuts

    def _whole(self, raw: bytes, name: bytes, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """``starts`` without those inside texts that hold the string of a special token."""
        at, inside = raw.find(name), set()
        while at >= 0:
            inside.add(int(np.searchsorted(offsets, at, "right")) - 1)
            at = raw.find(name, at + 1)
        gone = np.isin(np.searchsorted(offsets, starts, "right") - 1, list(inside)) & ~np.isin(starts, offsets)
        return starts[~gone]


@cache
def encoder(path: str, specials: bool = True) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    return Encoder(path, specials)
