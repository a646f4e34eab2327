"""Exact search over single vectors and over multi-vectors (late interaction).

Up to ``BLOCK`` queries are gathered and shipped to the tasks. More are cut into blocks by
hash and the corpus into parts, and every block meets every part in one task, so nothing
that grows with the data passes the driver. A task works on its corpus batches in numpy and
keeps its own best k, or its counts, so pairs are never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions import vectors as V

#: Queries in one block; with 1,024 doubles each, 32 MB.
BLOCK = 4096
#: Corpus rows of one part, where queries are many.
PART = 1 << 16


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def _met(queries: DataFrame, corpus: DataFrame, work, schema: str, block: int, part: int = PART) -> DataFrame:
    """``work(queries, corpus batches)`` for every block of queries and part of the corpus; their rows together.

    The first column of either side is its id. ``work`` gets and yields Arrow data.
    """
    n = queries.count()
    if not n:
        return queries.sparkSession.createDataFrame([], schema)
    if n <= block:
        shared = queries.sparkSession.sparkContext.broadcast(queries.toArrow())
        return corpus.mapInArrow(lambda batches: work(shared.value, batches), schema)
    blocks, parts = -(-n // block), max(1, -(-corpus.count() // part))

    def cut(df: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
        df = df.select(*[F.col(c).alias(f"{own}{c}") for c in df.columns])  # both sides may come from one table
        place = F.pmod(F.xxhash64(df.columns[0]), F.lit(count)).cast("int")
        return df.withColumn(own, place).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        q, c = q.drop_columns(["__b", "__p"]), c.drop_columns(["__b", "__p"])
        return pa.Table.from_batches(list(work(q, iter(c.to_batches()))) if q.num_rows else [], empty)

    empty = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema)])
    both = (cut(queries, "__b", blocks, "__p", parts).groupBy("__b", "__p"), cut(corpus, "__p", parts, "__b", blocks).groupBy("__b", "__p"))
    return both[0].cogroup(both[1]).applyInArrow(meet, schema)


def _best(best, ids: np.ndarray, scores: np.ndarray, k: int):
    """The k best of each row: those kept so far and new ones, by score and then by id."""
    s, i = np.concatenate([best[0], scores], 1), np.concatenate([best[1], np.broadcast_to(ids, scores.shape)], 1)
    keep = np.lexsort((i, -s), axis=1)[:, :k]
    return np.take_along_axis(s, keep, 1), np.take_along_axis(i, keep, 1)


def _ranked(rows: DataFrame, k: int, item: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), item)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(queries: DataFrame, corpus: DataFrame, k: int, normalise: bool = True, exclude_self: bool = False, block: int = BLOCK) -> DataFrame:
    """(query_id, item_id, score, rank) of the k best items per query, by cosine; ties by item id.

    ``queries`` and ``corpus`` hold (id, embedding).
    """
    unit = _unit if normalise else (lambda m: m)

    def work(asked: pa.Table, batches):
        qid, q = asked.column(0).to_numpy(), unit(_matrix(asked.column(1).combine_chunks()))
        best = np.zeros((len(qid), 0)), np.zeros((len(qid), 0), np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                item = part.column(0).to_numpy()
                s = q @ unit(_matrix(part.column(1))).T
                if exclude_self:
                    s = np.where(qid[:, None] == item[None, :], -np.inf, s)
                best = _best(best, item, s, k)
        live = np.isfinite(best[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, live.sum(1))), pa.array(best[1][live]), pa.array(best[0][live])], names=["query_id", "item_id", "score"])

    q, c = (x.select(F.col("id").cast("long").alias("id"), "embedding").filter("embedding is not null") for x in (queries, corpus))
    return _ranked(_met(q, c, work, "query_id long, item_id long, score double", block), k, "item_id")


def target_ranks(queries: DataFrame, corpus: DataFrame, targets: DataFrame, decimals: int | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, target_id, rank): 1 + the number of items that score above the target, without sorting.

    ``targets`` holds (query_id, target_id); queries without a target in the corpus are left out.
    """
    items = corpus.select(F.col("id").cast("long").alias("id"), "embedding").filter("embedding is not null")
    wanted = queries.select(F.col("id").cast("long").alias("query_id"), "embedding").join(targets, "query_id")
    wanted = wanted.join(items.select(F.col("id").alias("target_id"), F.col("embedding").alias("target")), "target_id").select("query_id", "target_id", "embedding", "target")

    def work(asked: pa.Table, batches):
        q, t = (_unit(_matrix(asked.column(c).combine_chunks())) for c in (2, 3))
        own, goal = asked.column(0).to_numpy(), (q * t).sum(1)
        goal = np.round(goal, decimals) if decimals is not None else goal
        above = np.zeros(len(q), np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                s = q @ _unit(_matrix(part.column(1))).T
                s = np.round(s, decimals) if decimals is not None else s
                above += ((s > goal[:, None]) & (own[:, None] != part.column(0).to_numpy()[None, :])).sum(1)
        yield pa.RecordBatch.from_arrays([asked.column(0).combine_chunks(), asked.column(1).combine_chunks().cast(pa.int64()), pa.array(above)], names=["query_id", "target_id", "above"])

    met = _met(wanted.withColumn("target_id", F.col("target_id").cast("long")), items, work, "query_id long, target_id long, above long", block)
    return met.groupBy("query_id", "target_id").agg((F.sum("above") + 1).alias("rank"))


def max_sim(query: np.ndarray, patches: np.ndarray) -> float:
    """Sum over query tokens of the best dot product with a patch; not normalised."""
    return float((query.astype(np.float64) @ patches.astype(np.float64).T).max(1).sum())


def _bundles(column: pa.Array) -> list[np.ndarray]:
    return [np.array(x, np.float64) for x in column.to_pylist()]


def _sims(tokens: list[np.ndarray], patches: list[np.ndarray]) -> np.ndarray:
    """Scores of every query against every item of a slice."""
    if not tokens or not patches:
        return np.zeros((len(tokens), len(patches)))
    q, p = np.concatenate(tokens), np.concatenate(patches)
    into = np.cumsum([0, *map(len, patches[:-1])])
    best = np.maximum.reduceat(q @ p.T, into, axis=1)
    return np.add.reduceat(best, np.cumsum([0, *map(len, tokens[:-1])]), axis=0)


def max_sim_top_k(queries: DataFrame, items: DataFrame, k: int, block: int = 256) -> DataFrame:
    """(query_id, image_id, score, rank) of the k best items for (query_id, tokens) against (image_id, patches); ties by image id."""
    kinds = dict(queries.dtypes)["query_id"], dict(items.dtypes)["image_id"]
    schema = f"query_id {kinds[0]}, image_id {kinds[1]}, score double"

    def work(asked: pa.Table, batches):
        qid, tokens = asked.column(0).combine_chunks(), _bundles(asked.column(1))
        best = np.zeros((len(qid), 0)), np.zeros((len(qid), 0), object)
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                best = _best(best, np.array(part.column(0).to_pylist(), object), _sims(tokens, _bundles(part.column(1))), k)
        found = best[0].shape[1]
        rows = pa.array(np.repeat(np.arange(len(qid)), found))
        image = pa.array(best[1].ravel().tolist(), items_type)
        yield pa.RecordBatch.from_arrays([qid.take(rows), image, pa.array(best[0].ravel())], names=["query_id", "image_id", "score"])

    items_type = to_arrow_type(items.schema["image_id"].dataType)
    return _ranked(_met(queries.select("query_id", "tokens"), items.select("image_id", "patches"), work, schema, block), k, "image_id")


def max_sim_ranks(queries: DataFrame, items: DataFrame, targets: DataFrame, block: int = 256) -> DataFrame:
    """(query_id, rank): 1 + the number of items that score above the query's target (query_id, image_id)."""
    wanted = queries.select("query_id", "tokens").join(targets, "query_id").join(items.select("image_id", F.col("patches").alias("goal")), "image_id").select("query_id", "tokens", "goal")

    def work(asked: pa.Table, batches):
        tokens = _bundles(asked.column(1))
        goal = np.array([max_sim(q, p) for q, p in zip(tokens, _bundles(asked.column(2)))])
        above = np.zeros(len(tokens), np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                s = _sims(tokens, _bundles(b.slice(lo, 64).column(1)))
                above += (s > goal[:, None] + 1e-9).sum(1)  # equal scores share the best rank, whatever the order of sums
        yield pa.RecordBatch.from_arrays([asked.column(0).combine_chunks(), pa.array(above)], names=["query_id", "above"])

    met = _met(wanted, items.select("image_id", "patches"), work, f"query_id {dict(queries.dtypes)['query_id']}, above long", block)
    return met.groupBy("query_id").agg((F.sum("above") + 1).alias("rank"))


class MultiVectorIndex:
    """A searchable set of (image_id, patches) with figure columns, kept as Parquet."""

    def __init__(self, items: DataFrame):
        self.items = items

    @classmethod
    def at(cls, spark, path: str, build=None, factor: int = 1) -> MultiVectorIndex:
        """Load from ``path``, or build and store there when it is missing."""
        from ..sources.files import exists

        if not exists(spark, path):
            if build is None:
                raise FileNotFoundError(path)
            items = build().withColumn("patches", V.or_placeholder(F.col("patches")))
            if factor > 1:
                items = items.withColumn("patches", V.pooled_patches(factor)("patches"))
            items.write.parquet(path)
        return cls(spark.read.parquet(path))

    def search(self, queries: DataFrame, k: int = 3) -> DataFrame:
        """The k best per query with the figure's columns; placeholders are dropped after the cut, as fewer rows."""
        best = max_sim_top_k(queries, self.items, k)
        blank = F.forall("patches", lambda p: V.is_zero(p))
        rows = self.items.withColumn("__blank", blank).drop("patches")
        return best.join(rows, "image_id").filter("not __blank").drop("__blank")


def matched_targets(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """Queries (paper_id, fig_id, ...) with their item: by exact key, else by the figure without its panel letter."""
    last = V.last_by_key(keys.withColumn("__key", F.concat_ws("_", "paper_id", "fig_id")), "__key", "id", "id")
    exact = last.select(F.col("__key").alias("__a"), F.col("id").alias("__x"))
    plain = last.select(F.col("__key").alias("__b"), F.col("id").alias("__y"))
    q = queries.withColumn("__k", F.concat_ws("_", "paper_id", "fig_id")).withColumn("__s", F.concat_ws("_", "paper_id", T.without_letter(F.col("fig_id"))))
    rows = q.join(exact, F.col("__k") == F.col("__a"), "left").join(plain, F.col("__s") == F.col("__b"), "left")
    return rows.withColumn("target_id", F.coalesce("__x", "__y")).drop("__k", "__s", "__a", "__b", "__x", "__y")


def competition_rank(score: str, *by: str) -> Column:
    """1 + the number of higher scores in a group; ties share the best rank."""
    return F.rank().over(Window.partitionBy(*by).orderBy(F.desc(score)))


def metrics(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10), total: int | None = None) -> DataFrame:
    """One row: evaluated, no_match, recall_at_k for each distinct k, and mrr; zeros when nothing was evaluated."""
    columns = [F.coalesce(F.avg((F.col("rank") <= k).cast("double")), F.lit(0.0)).alias(f"recall_at_{k}") for k in sorted(set(ks))]
    n = F.count("rank")
    missing = (F.lit(total) if total is not None else F.count("*")) - n
    return ranks.agg(n.alias("evaluated"), missing.cast("long").alias("no_match"), *columns, F.coalesce(F.avg(1 / F.col("rank")), F.lit(0.0)).alias("mrr"))
