"""The author and reviewer loop behind pluggable models.

A model is any object with ``chat(messages, temperature, image) -> str``; a factory makes it
once per worker. One figure's rounds run in one task, so no state leaves it, and a failing
row becomes a row with its error. The driver takes candidates in ordered batches until enough
are accepted, which gives the same rows as a serial run.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

ROUNDS = 3
AUTHOR = "You write one search query that a reader could use to find the described figure. Reply with a JSON object that has the field query."
REVIEWER = "You judge whether a search query fits the described figure without naming it. Reply with a JSON object with the fields verdict (ACCEPT or REJECT) and feedback."
UNREADABLE = "The last reply was no JSON object with a query field. Send only that object."


class ChatModel(Protocol):
    """What the loop asks of a model: greedy at temperature zero, else nucleus sampling."""

    def chat(self, messages: list[dict], temperature: float, image: bytes | None = None) -> str: ...


@dataclass
class ScriptedModel:
    """A test double that gives its replies in turn, the last one again and again."""

    replies: list[str]
    asked: list[list[dict]] = field(default_factory=list)

    def chat(self, messages, temperature, image=None):
        self.asked.append(messages)
        return self.replies[min(len(self.asked), len(self.replies)) - 1]


def typed(messages: list[dict], image: bytes | None = None) -> list[dict]:
    """Messages with content as typed parts; an image joins the first user turn."""
    out, placed = [], image is None
    for m in messages:
        parts = [{"type": "text", "text": m["content"]}] if isinstance(m["content"], str) else list(m["content"])
        if not placed and m["role"] == "user":
            parts, placed = [{"type": "image", "image": image}, *parts], True
        out.append({"role": m["role"], "content": parts})
    return out


def _ask(model: ChatModel, system: str, user: str, temperature: float, image: bytes | None = None) -> dict | None:
    raw = model.chat(typed([{"role": "system", "content": system}, {"role": "user", "content": user}], image), temperature, image)
    found = T.decode_first_object(raw)
    return json.loads(found) if found else None


def draft(model: ChatModel, context: str, image: bytes | None = None, prior: str | None = None, feedback: str | None = None) -> str | None:
    """The author's query, or None when the reply holds none."""
    ask = [f"Figure information:\n{context}\n"]
    if feedback:
        ask += [f'Previous query: "{prior}"'] * bool(prior) + [f"Feedback: {feedback}", "Improve the query accordingly."]
    reply = _ask(model, AUTHOR, "\n".join([*ask, "Send the JSON object now."]), 0.7, image)
    query = str((reply or {}).get("query") or "").strip()
    if not query or re.search(r"<[^>]{1,60}>", query):
        return None
    query = re.sub(r"(?i)\bfig(?:ure)?[.]?\s*[a-z\d]+\b", "", query)
    return " ".join(query.split()) or None


def review(model: ChatModel, context: str, query: str) -> tuple[str, str]:
    """(verdict, feedback) of the reviewer, who sees no image; what cannot be read rejects."""
    reply = _ask(model, REVIEWER, f'Figure information:\n{context}\n\nProposed query: "{query}"\n\nSend the JSON object now.', 0.0)
    if not reply or "verdict" not in reply:
        return "REJECT", "The review could not be read."
    verdict, feedback = str(reply["verdict"]).strip().upper(), str(reply.get("feedback") or "").strip()
    return (verdict, feedback) if verdict in ("ACCEPT", "REJECT") else ("REJECT", feedback or "The verdict was malformed.")


def rounds(model: ChatModel, context: str, image: bytes | None = None, most: int = ROUNDS) -> tuple[str | None, int]:
    """(accepted query or None, rounds used); an unreadable draft uses a round."""
    query = feedback = None
    for n in range(1, most + 1):
        query = draft(model, context, image, query, feedback)
        if query is None:
            feedback = UNREADABLE
            continue
        verdict, feedback = review(model, context, query)
        if verdict == "ACCEPT":
            return query, n
    return None, most


def queries_for(figures: DataFrame, factory: Callable[[], ChatModel], most: int = ROUNDS) -> DataFrame:
    """(paper_id, figure_id, sub_id, position, query, rounds, error) of figures with a ``position``."""
    schema = pa.schema([("paper_id", pa.string()), ("figure_id", pa.string()), ("sub_id", pa.string()), ("position", pa.int64()), ("query", pa.string()), ("rounds", pa.int32()), ("error", pa.string())])
    c = F.col
    context = T.context_block(c("title"), c("abstract"), c("categories"), c("figure_id"), c("sub_id"), c("caption"), c("sub_caption"), c("reference_text"))
    image = c("image") if "image" in figures.columns else F.lit(None).cast("binary")

    def run(batches: Iterator[pa.RecordBatch]):
        model = None
        for b in batches:
            rows = []
            for r in b.to_pylist():
                try:
                    model = model or factory()
                    query, used = rounds(model, r["context"], r["image"], most)
                    rows.append((r["paper_id"], r["figure_id"], r["sub_id"], r["position"], query, used, None))
                except Exception as x:  # a failed figure is skipped, with its error
                    rows.append((r["paper_id"], r["figure_id"], r["sub_id"], r["position"], None, None, f"{type(x).__name__}: {x}"))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    rows = figures.select("paper_id", c("figure_id").cast("string").alias("figure_id"), "sub_id", c("position").cast("long").alias("position"), context.alias("context"), image.alias("image"))
    return rows.mapInArrow(run, "paper_id string, figure_id string, sub_id string, position long, query string, rounds int, error string")


def generate(candidates: DataFrame, factory: Callable[[], ChatModel], target: int, path: str, batch: int | None = None, most: int = ROUNDS) -> int:
    """Run ordered batches until ``target`` queries are accepted, appending each batch to ``path``; returns the number written.

    Candidates already in ``path`` count towards the target and are skipped.
    """
    from ..sources.files import exists, read_tsv
    from ..sources.sinks import append_tsv
    from .curate import remaining

    spark, form = candidates.sparkSession, "paper_id string, figure_id string, sub_id string, query string"
    have = 0
    if exists(spark, path):
        done = read_tsv(spark, path, form)
        have = done.count()
        key = F.concat_ws("\u0001", "paper_id", "figure_id", T.blank(F.col("sub_id"))).alias("__key")
        candidates = remaining(candidates.withColumn("__key", key), done.select(key), "__key").drop("__key")
    last = candidates.agg(F.max("position")).first()[0] or 0
    at, size = 0, batch or max(8, target)
    while have < target and at < last:
        some = candidates.filter((F.col("position") > at) & (F.col("position") <= at + size))
        good = queries_for(some, factory, most).filter("query is not null").orderBy("position").limit(target - have)
        # written once and counted from the file, so a lost executor cannot make a model answer twice
        append_tsv(good.select("paper_id", "figure_id", T.blank(F.col("sub_id")).alias("sub_id"), T.one_line(F.col("query")).alias("query")), path)
        have = read_tsv(spark, path, form).count()
        at += size
    return have
