"""Queries over the driver's tables, one per operator, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplanes, exact_dedup, language, packing, quality, repeats, secrets, simhash, url_lists, winnow
from .tokens import vocabulary


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files with byte planes: written, then read back."""
    return bitplanes.round_trip(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-fit packing in bounded space into sequences of 1024 tokens."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components within 4 bits, by ball hashing."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in documents, by winnowed 13-word windows."""
    return winnow.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that occur earlier, by a run-length index."""
    return repeats.without_repeats(_table(spark, sf_dir, "documents"), length=100).drop("spans")


def op8_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates behind a two-pass Bloom filter."""
    return exact_dedup.annotate(_table(spark, sf_dir, "documents"))


def _events(pages: DataFrame) -> DataFrame:
    """Dated list entries for the hosts, parent domains and language folders of the pages, spread by their md5."""
    host = url_lists.host_of(F.col("url"))
    parts = F.split(url_lists.path_of(F.col("url")), "/")
    named = F.array(
        F.struct(F.lit("spam").alias("list"), F.lit("host").alias("scope"), host.alias("pattern")),
        F.struct(F.lit("adult").alias("list"), F.lit("domain").alias("scope"), F.regexp_replace(host, r"^[^.]*\.", "").alias("pattern")),
        F.struct(F.lit("crawl").alias("list"), F.lit("prefix").alias("scope"), F.concat(host, F.lit("/"), F.try_element_at(parts, F.lit(2)), F.lit("/")).alias("pattern")),
    )
    names = pages.filter(host != "").select(F.explode(named).alias("x")).select("x.*").distinct().withColumn("m", F.md5(F.concat_ws("|", "list", "pattern")))

    def day(i: int):
        return F.instr(F.lit("0123456789abcdef"), F.substring("m", i, 1)) - 1

    steps = F.array(
        F.struct(F.lit("add").alias("action"), F.expr("make_date(2024, 1, 1)").alias("base"), (day(2) * 16).alias("off")),
        F.struct(F.lit("remove").alias("action"), F.expr("make_date(2024, 1, 1)").alias("base"), (day(2) * 16 + day(3) * 10 + 5).alias("off")),
        F.struct(F.lit("add").alias("action"), F.expr("make_date(2024, 1, 1)").alias("base"), (day(2) * 16 + day(3) * 10 + day(4) * 8 + 9).alias("off")),
    )
    events = names.filter(day(1) < 5).withColumn("e", F.explode(steps))
    return events.select("list", "scope", "pattern", F.col("e.action").alias("action"), F.date_add("e.base", F.col("e.off").cast("int")).alias("at"))


def op5_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched on a day that its id gives, against the list entries active on that day."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.expr("date_add(make_date(2024, 1, 1), cast(page_id * 37 % 366 as int))"))
    return url_lists.judged(captures, _events(pages))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores by averaged subword embeddings, trained outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents")
    fold = quality.fold_of("doc_id", 4)
    model = quality.train(docs, _table(spark, sf_dir, "labels"), where=fold != 2)
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of whole texts under the maximum-entropy model and the unigram base."""
    docs = _table(spark, sf_dir, "documents")
    model, counts, tokens, distinct = language.train(docs, folds=7, held=2)
    return language.score(docs, model, counts, tokens, distinct, folds=7, held=2)


def _listed(spans, kinds) -> Column:
    """Spans as kind:start:end, comma-joined; struct order is start, kind, end."""
    names = F.array(*[F.lit(k) for k in secrets.KINDS])
    own = F.filter(spans, lambda s: s["kind"] < kinds)
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by fixed patterns and a conditional random field."""
    docs = _table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs))
    spans = F.col("spans")
    count = [F.expr(f"cast(size(filter(spans, s -> s.kind = {k})) as long)").alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    return found.select("doc_id", *count, F.sha2(_listed(spans, 3), 256).alias("base_sha256"), _listed(spans, 9).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_token_planes, op2_packing, op3_simhash, op4_winnowing, op5_url_lists, op6_quality, op7_repeats, op8_bloom_dedup, op9_language_model, op10_secrets)}

ORACLE_SQL = {
    "op5_url_lists": r"""
        WITH p AS (
            SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS fetched,
                   lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.$', '')) AS host,
                   regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path
            FROM pages),
        names AS (
            SELECT DISTINCT 'spam' AS list, 'host' AS scope, host AS pattern FROM p WHERE host <> ''
            UNION SELECT DISTINCT 'adult', 'domain', regexp_replace(host, '^[^.]*\.', '') FROM p WHERE host <> ''
            UNION SELECT DISTINCT 'crawl', 'prefix', host || '/' || split_part(path, '/', 2) || '/' FROM p WHERE host <> '' AND path LIKE '%/%'),
        m AS (SELECT *, md5(list || '|' || pattern) AS m FROM names),
        d AS (SELECT *, instr('0123456789abcdef', substr(m, 1, 1)) - 1 AS d1, instr('0123456789abcdef', substr(m, 2, 1)) - 1 AS d2,
                     instr('0123456789abcdef', substr(m, 3, 1)) - 1 AS d3, instr('0123456789abcdef', substr(m, 4, 1)) - 1 AS d4 FROM m),
        events AS (
            SELECT list, scope, pattern, 'add' AS action, DATE '2024-01-01' + CAST(d2 * 16 AS INTEGER) AS moment FROM d WHERE d1 < 5
            UNION ALL SELECT list, scope, pattern, 'remove', DATE '2024-01-01' + CAST(d2 * 16 + d3 * 10 + 5 AS INTEGER) FROM d WHERE d1 < 5
            UNION ALL SELECT list, scope, pattern, 'add', DATE '2024-01-01' + CAST(d2 * 16 + d3 * 10 + d4 * 8 + 9 AS INTEGER) FROM d WHERE d1 < 5),
        met AS (
            SELECT p.page_id, p.fetched, e.* FROM p JOIN events e ON e.scope = 'host' AND p.host = e.pattern
            UNION ALL SELECT p.page_id, p.fetched, e.* FROM p JOIN events e ON e.scope = 'domain' AND (p.host = e.pattern OR ends_with(p.host, '.' || e.pattern))
            UNION ALL SELECT p.page_id, p.fetched, e.* FROM p JOIN events e ON e.scope = 'prefix' AND starts_with(p.host || p.path || '/', e.pattern)),
        met_last AS (
            SELECT * FROM met WHERE moment <= fetched
            QUALIFY row_number() OVER (PARTITION BY page_id, list, scope, pattern ORDER BY moment DESC, action) = 1),
        a AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, max(moment) AS latest FROM met_last WHERE action = 'add' GROUP BY page_id)
        SELECT p.page_id, p.url, p.fetched, coalesce(a.n, 0) AS n_active, coalesce(a.lists, '') AS lists, a.latest, a.n IS NOT NULL AS blocked
        FROM p LEFT JOIN a USING (page_id)""",
    "op8_bloom_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
