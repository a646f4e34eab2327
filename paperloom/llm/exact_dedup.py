"""Exact duplicates by two passes over a Bloom filter, in DataFrame operations alone.

Pass one hashes every text to ``PROBES`` slots of a bit array and keeps the slots that
were hit at least twice, as 64-bit words. Pass two lets a row through untouched unless all
its slots are among those; only the rest, which may have a twin, are shuffled and compared
by SHA-256.

Pass one shuffles slot numbers, counted before the shuffle: at most two of 16 bytes a row,
some 1% of a text of 3 KB, and never texts. At most ``MAX_WORDS`` kept words (24 bytes each)
are broadcast. More of them are joined by shuffle, on the word's number; words that very
many rows hit are broadcast even then, as there can be no more than ``HOT_GROUPS`` of them a
probe, so no hot text meets in one task. The same holds for hot groups of equal texts. The
filter itself is used at any size.

Nulls and edge cases: a null text counts as empty; a null id sorts below every id; rows
that repeat id and text count as members of the group, and exactly one of them is kept; a
text of any length is hashed whole. Equality is by SHA-256 of the UTF-8 bytes. Extra columns
are carried and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

PROBES = 2
BITS_PER_ROW = 16
MAX_BITS = 1 << 36
MAX_WORDS = 1 << 20
#: Of any table no more than so many texts, or slots of a probe, count as hot.
HOT_GROUPS = 1 << 16


def _hot(rows: int) -> int:
    """Rows beyond which a key is hot."""
    return max(1 << 14, -(-rows // HOT_GROUPS))


def _slot(h: Column, probe: int, bits: int) -> Column:
    """The ``probe``-th slot of a 64-bit hash."""
    return F.pmod(h if probe == 0 else F.xxhash64(h, F.lit(probe)), F.lit(bits))


def repeated_slots(hashes: DataFrame, h: str, rows: int) -> tuple[DataFrame, int, bool]:
    """Words (p, word, bits, n) of the slots hit twice or more, the array's size, and whether the words may be broadcast."""
    bits = 1 << 16
    while bits < min(rows * BITS_PER_ROW, MAX_BITS):
        bits *= 2
    slots = hashes.select(F.explode(F.array(*[F.struct(F.lit(p).alias("p"), _slot(F.col(h), p, bits).alias("s")) for p in range(PROBES)])).alias("x"))
    words = (
        slots.groupBy("x.p", "x.s").agg(F.count("*").alias("n")).filter("n > 1")
        .groupBy("p", F.shiftright("s", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits"), F.max("n").alias("n"))
    )
    words = written(words, "bloom")
    return words, bits, words.count() <= MAX_WORDS


def maybe_repeated(rows: DataFrame, h: str, words: DataFrame, bits: int, few: bool, hot: int, flag: str) -> DataFrame:
    """``rows`` with a boolean column: whether all slots of ``h`` were hit more than once."""
    hit = F.lit(True)
    for p in range(PROBES):
        s, named = f"{flag}_s{p}", []
        rows = rows.withColumn(s, _slot(F.col(h), p, bits))
        own = words.filter(F.col("p") == p)
        for kind, some in (("few", own),) if few else (("hot", own.filter(F.col("n") > hot)), ("rest", own.filter(F.col("n") <= hot))):
            w, b = f"{flag}_{kind}w{p}", f"{flag}_{kind}b{p}"
            side = some.select(F.col("word").alias(w), F.col("bits").alias(b))
            word = F.shiftright(s, 6)
            if kind == "rest":  # rows of hot words have met; spread over numbers that no word has
                word = F.when(F.col(named[0]).isNull(), word).otherwise(-1 - F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)))
            rows = rows.withColumn(f"{flag}_k{p}", word)
            rows = rows.join(side if kind == "rest" else F.broadcast(side), F.col(f"{flag}_k{p}") == F.col(w), "left")
            named.append(b)
        found = " | ".join(f"coalesce(`{b}`, 0L)" for b in named)
        hit = hit & F.expr(f"getbit({found}, cast(`{s}` & 63 as int)) = 1")
    return rows.withColumn(flag, hit)


def with_groups(some: DataFrame, groups: DataFrame, sha: str, key: str, n: str, hot: int) -> DataFrame:
    """Rows joined to the group of their digest; those of hot groups, a bounded number, by broadcast."""
    large, rest = groups.filter(F.col(n) > hot), groups.filter(F.col(n) <= hot)
    met = some.join(F.broadcast(large), F.col(sha) == F.col(key))
    others = some.join(F.broadcast(large.select(key)), F.col(sha) == F.col(key), "left_anti").join(rest, F.col(sha) == F.col(key))
    return met.unionByName(others)


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (lowercase hex).

    Of equal texts the row with the largest id stays. The text is read once: pass one also
    writes (id, hash, digest), 50 bytes a row, which the second pass reads.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = written(
        docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("rid"), F.xxhash64(text).alias("h"), F.unhex(F.sha2(text, 256)).alias("sha")),
        "digests",
    )
    n = base.count()
    words, bits, few = repeated_slots(base, "h", n)
    rows = maybe_repeated(base, "h", words, bits, few, _hot(n), "again")
    alone = rows.filter("not again").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    some = rows.filter("again").select("id", "rid", "sha")
    groups = some.groupBy(F.col("sha").alias("key")).agg(F.count("*").alias("n"), F.max(F.struct("id", "rid")).alias("top"))
    met = with_groups(some, groups, "sha", "key", "n", _hot(n))
    met = met.select("id", F.col("top.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("top.rid") == F.col("rid")).alias("kept"), "sha")
    return alone.unionByName(met).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that the filter clears keep their place. Of the others, those that are not the
    largest of their group go, and one row stays where id and text repeat as well.
    """
    columns = docs.columns
    h, sha, flag = "__loom_h", "__loom_sha", "__loom_again"
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashes = written(docs.select(F.xxhash64(text).alias(h)), "hashes")
    n = hashes.count()
    words, bits, few = repeated_slots(hashes, h, n)
    rows = maybe_repeated(docs.withColumn(h, F.xxhash64(text)), h, words, bits, few, _hot(n), flag)
    some = rows.filter(F.col(flag)).withColumn(sha, F.unhex(F.sha2(text, 256)))
    keys = some.select(F.col(id_col).alias("__loom_id"), sha).groupBy("__loom_id", sha).agg(F.count("*").alias("__loom_n"))
    stay = (
        keys.groupBy(F.col(sha).alias("__loom_key"))
        .agg(F.max(F.struct(F.col("__loom_id").alias("id"), F.col("__loom_n").alias("n"))).alias("__loom_top"), F.sum("__loom_n").alias("__loom_size"))
    )
    kept = with_groups(some, stay, sha, "__loom_key", "__loom_size", _hot(n)).filter(F.col(id_col).eqNullSafe(F.col("__loom_top.id")))
    once = kept.filter("__loom_top.n = 1").select(*columns)
    more = kept.filter("__loom_top.n > 1").dropDuplicates([id_col, sha]).select(*columns)
    return rows.filter(~F.col(flag)).select(*columns).unionByName(once).unionByName(more)

