"""Encoders as Arrow functions: a model is made once per worker and called on batches.

A factory returns a function from a list of texts (or image bytes) to arrays. No model is
installed here; ``hashed_text`` is a deterministic stand-in for tests, not a measure of quality.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def single(factory: Callable[[], Callable[[list], np.ndarray]], batch: int = 64) -> Callable[[Column], Column]:
    """array<float> per item, of unit length; None where the model gave none or failed."""

    @F.pandas_udf("array<float>")
    def run(items: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for s in items:
            out = []
            for lo in range(0, len(s), batch):
                part = list(s.iloc[lo : lo + batch])
                try:
                    m = np.asarray(model(part), np.float64)
                    n = np.linalg.norm(m, axis=1, keepdims=True)
                    out += list((m / np.where(n == 0, 1, n)).astype(np.float32))
                except Exception:
                    out += [None] * len(part)
            yield pd.Series(out)

    return run


def multi(factory: Callable[[], Callable[[list], list[np.ndarray]]], dim: int = 128, batch: int = 4) -> Callable[[Column], Column]:
    """array<array<float>> per item; one zero vector where the model failed."""

    @F.pandas_udf("array<array<float>>")
    def run(items: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, blank = factory(), [[0.0] * dim]
        for s in items:
            out = []
            for lo in range(0, len(s), batch):
                part = list(s.iloc[lo : lo + batch])
                try:
                    out += [np.asarray(m, np.float32).tolist() for m in model(part)]
                except Exception:
                    out += [blank] * len(part)
            yield pd.Series(out)

    return run


def hashed_text(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A test double: signed counts of hashed words."""

    def run(texts):
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % dim] += 1 if h >> 63 else -1
        return out

    return run


def hashed_words(dim: int = 64) -> Callable[[list[str]], list[np.ndarray]]:
    """A test double of a multi-vector encoder: one vector a word."""
    one = hashed_text(dim)
    return lambda texts: [one((t or "").split() or [""]) for t in texts]
