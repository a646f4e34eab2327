"""Reproducible samples: seeded order, Hamilton slots, stratified draws and round robin.

Random order is the order of ``md5(seed:key)``, the same in any engine and under any
partitioning. Where a window spans all rows it spans one row per category, never the data;
draws of n take the first n in seeded order by a top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .curate import category_rows, category_sizes

SEEDS = {"figures": 42, "tables": 42, "candidates": 13}


def seeded(seed: int, *keys: str | Column) -> Column:
    """The seeded order of a row."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def hamilton(sizes: DataFrame, n: int) -> DataFrame:
    """(category, size, slots): largest remainders with at least one slot; one each to the largest when that is too many.

    Integer arithmetic; ties go to the name. The windows run over one row per category.
    """
    whole = Window.partitionBy(F.lit(1))
    g = F.sum("size").over(whole)
    base = sizes.withColumn("g", g).withColumn("fl", F.greatest(F.lit(1).cast("long"), F.expr(f"{n}L * size div g"))).withColumn("rem", F.expr(f"{n}L * size % g"))
    base = base.withColumn("tot", F.sum("fl").over(whole)).withColumn("rn", F.row_number().over(whole.orderBy(F.desc("rem"), "category"))).withColumn("rs", F.row_number().over(whole.orderBy(F.desc("size"), "category")))
    slots = F.when(F.col("tot") > n, F.when(F.col("rs") <= n, 1).otherwise(0)).otherwise(F.col("fl") + F.when(F.col("rn") <= n - F.col("tot"), 1).otherwise(0))
    return base.select("category", "size", slots.cast("long").alias("slots"))


def stratified(items: DataFrame, key: str, n: int, seed: int = SEEDS["tables"], categories: str = "categories") -> DataFrame:
    """``n`` distinct keys: slots by category, then the gap from the rest; all keys when there are fewer."""
    rows = category_rows(items, key, categories)
    slots = hamilton(category_sizes(rows), n)
    order = Window.partitionBy("category").orderBy(seeded(seed, "category", key), key)
    # no category has more than n slots, so every task keeps no more of each
    drawn = rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n).join(slots, "category").filter("rn <= slots").select(key).distinct()
    rest = rows.select(key).distinct().join(drawn, key, "left_anti")
    pool = drawn.withColumn("phase", F.lit(1)).unionByName(rest.withColumn("phase", F.lit(2)))
    return pool.orderBy("phase", seeded(seed, key), key).limit(n).select(key)


def one_per_category(items: DataFrame, keys: list[str], n: int, seed: int = SEEDS["figures"], categories: str = "categories") -> DataFrame:
    """One item per category, distinct, then filled to ``n`` in seeded order; the label is the category drawn for, else the first."""
    parts = items.withColumn("__category", F.explode(T.category_list(F.col(categories)))).filter(F.col("__category") != T.UNCATEGORISED)
    pick = Window.partitionBy("__category").orderBy(seeded(seed, "__category", *keys), *keys)
    picked = parts.withColumn("__rn", F.row_number().over(pick)).filter("__rn = 1").groupBy(*keys).agg(F.min("__category").alias("sampling_category"))
    unique = items.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*[c for c in items.columns if c not in keys]))).filter("__rn = 1").drop("__rn")
    rows = unique.join(picked, keys, "left").withColumn("__phase", F.when(F.col("sampling_category").isNotNull(), 1).otherwise(2))
    rows = rows.withColumn("sampling_category", F.coalesce("sampling_category", T.first_category(F.col(categories))))
    return rows.orderBy("__phase", seeded(seed, *keys), *keys).limit(n).drop("__phase")


def diverse_order(figures: DataFrame, target: int, multiplier: int = 4, seed: int = SEEDS["candidates"]) -> DataFrame:
    """Candidates in order of trial: one figure a paper, categories in turn, lengths in turn within each; cut to target x multiplier.

    Adds ``position`` from 1. The last step is a top-k, not a full sort. No candidate stands
    behind more than the top-k's number in its category, so the windows keep no more of each:
    Spark cuts every task's groups before it shuffles them.
    """
    most = target * multiplier
    key = ["paper_id", "figure_id", "sub_id"]
    df = figures.withColumn("primary_category", T.first_category(F.col("categories"), "unknown")).withColumn("bucket", T.length_bucket(F.col("caption"), F.col("sub_caption")))
    df = df.withColumn("__h", seeded(seed, *[T.blank(F.col(k)) for k in key]))
    df = df.withColumn("__one", F.row_number().over(Window.partitionBy("paper_id").orderBy("__h", *key))).filter("__one = 1")
    place = F.array_position(F.array(*map(F.lit, ("short", "medium", "long"))), F.col("bucket"))
    df = df.withColumn("__q", F.row_number().over(Window.partitionBy("primary_category", "bucket").orderBy("__h", *key))).filter(F.col("__q") <= most).withColumn("__b", place)
    df = df.withColumn("__pos", F.row_number().over(Window.partitionBy("primary_category").orderBy("__q", "__b"))).filter(F.col("__pos") <= most)
    top = df.orderBy("__pos", seeded(seed, "primary_category"), "primary_category").limit(most)
    order = Window.partitionBy(F.lit(1)).orderBy("__pos", seeded(seed, "primary_category"), "primary_category")
    return top.withColumn("position", F.row_number().over(order)).drop("__h", "__one", "__q", "__b", "__pos")
