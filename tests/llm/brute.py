"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import xxhash

LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def lower(text):
    return (text or "").translate(LOWER)


@lru_cache
def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ids(texts, path):
    tok = tokenizer(path)
    return [list(tok.encode(t or "", add_special_tokens=False).ids) for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def token_planes(rows, path, end):
    out, start = [], 0
    for doc, text in sorted(rows):
        x = ids([text], path)[0] + [end]
        out.append((doc, start, len(x), crc(x)))
        start += len(x)
    return out


def simhash(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius=4):
    """fps: {id: fingerprint}."""
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contaminated(docs, items, n=13):
    windows = {}
    for item, text in items:
        w = bench_words(text)
        if w and item is not None:
            for i in range(max(1, len(w) - n + 1)):
                windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = bench_words(text), set(), set()
        for i in range(len(w)):
            for s in sizes:
                got = windows.get(tuple(w[i : i + s])) if i + s <= len(w) else None
                if got:
                    hit |= set(range(i, i + s))
                    found |= got
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def repeats(docs, n=100):
    """docs: (id, bytes) in order. (id, bytes, removed, spans, sha256 of the rest)."""
    seen, out = set(), []
    for doc, b in docs:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            s = b[i : i + n]
            if s in seen:
                gone[i : i + n] = True
            seen.add(s)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        rest = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return out
