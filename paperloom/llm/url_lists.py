"""URL filters by dated lists: a temporal list join.

List entries are dated: an entry is added on one day and may be removed and added again
later. Per (list, scope, pattern) the events become disjoint validity intervals, each from an
addition to the next event. A capture is turned into the keys it could match: its whole URL,
its host with every leading part of its path, its host and every parent domain. An equi-join
on (scope, key) with the capture's time inside the interval is then the as-of join: each
capture meets exactly the entries active when it was fetched.

The lists are broadcast only when the session's own size threshold allows it. Otherwise both
sides shuffle on the key, where an over-full key of the captures (a host with a third of all
pages) is split by adaptive execution, as the intervals of one key are few.

Nulls and edge cases: a null or hostless URL, or a null time, matches nothing; events with a
null pattern, time or action are ignored; of events on the same instant an addition counts
(repeats are one event); hosts compare in lower case without user, port or trailing dot;
repeated captures are judged alike, and a URL of any length is read whole. Extra columns of
either side are left out, and columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPES = ("url", "prefix", "host", "domain")


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, empty where there is none."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), r"^.*@|:[0-9]*$|\.$", ""))


def path_of(url: Column) -> Column:
    """Path of a URL up to query and fragment."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """array<struct<scope, key>> of all that an entry could name for this URL."""
    host, parts = host_of(url), F.split(path_of(url), "/")
    labels = F.split(host, r"\.")

    def named(scope: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(scope).alias("scope"), k.alias("key")))

    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(host, F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    found = F.array_distinct(F.concat(named("url", F.array(url)), named("prefix", folders), named("host", F.array(host)), named("domain", parents)))
    return F.when(host != "", found)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, scope, pattern, valid_from, valid_to) from events (list, scope, pattern, action, at); valid_to is null while open."""
    events = (
        entries.filter("pattern is not null and at is not null and action is not null")
        .groupBy("list", "scope", "pattern", "at").agg(F.max(F.col("action") == "add").alias("adds"))
    )
    order = Window.partitionBy("list", "scope", "pattern").orderBy("at")
    return events.withColumn("valid_to", F.lead("at").over(order)).filter("adds").select("list", "scope", "pattern", F.col("at").alias("valid_from"), "valid_to")


def _asked(captures: DataFrame, id_col: str, url_col: str, time_col: str) -> DataFrame:
    return captures.select(F.col(id_col).alias("__loom_id"), F.col(url_col).alias("__loom_url"), F.col(time_col).alias("__loom_t"))


def active_matches(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, time_col: str) -> DataFrame:
    """(id, url, t, list, scope, pattern, valid_from) of every entry active for a distinct capture when it was fetched."""
    asked = _asked(captures, id_col, url_col, time_col).distinct().select("*", F.explode(keys_of(F.col("__loom_url"))).alias("k"))
    spans = intervals(entries)
    inside = (F.col("__loom_t") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("__loom_t") < F.col("valid_to")))
    met = asked.join(spans, (F.col("k.scope") == F.col("scope")) & (F.col("k.key") == F.col("pattern")) & inside)
    return met.select(F.col("__loom_id").alias("id"), F.col("__loom_url").alias("url"), F.col("__loom_t").alias("t"), "list", "scope", "pattern", "valid_from")


def judged(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """Each capture's (id, url, time) with n_active, the lists that name it, its latest entry and whether it is blocked.

    A row is judged by its id, URL and time together, so rows that share an id are told apart.
    """
    hits = active_matches(captures, entries, id_col, url_col, time_col)
    found = hits.groupBy(*[F.col(c).alias(f"__hit_{c}") for c in ("id", "url", "t")]).agg(F.count("*").alias("__hit_n"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("__hit_lists"), F.max("valid_from").alias("__hit_latest"))
    same = [F.col(f"__loom_{c}").eqNullSafe(F.col(f"__hit_{c}")) for c in ("id", "url", "t")]
    rows = _asked(captures, id_col, url_col, time_col).join(found, same, "left")
    return rows.select(
        F.col("__loom_id").alias(id_col), F.col("__loom_url").alias(url_col), F.col("__loom_t").alias(time_col), F.coalesce("__hit_n", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce("__hit_lists", F.lit("")).alias("lists"), F.col("__hit_latest").alias("latest"), F.coalesce(F.col("__hit_n") > 0, F.lit(False)).alias("blocked"))
