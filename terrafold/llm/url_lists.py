"""URL filters by dated lists, in DataFrame operations only.

Dated entries (a key is listed or delisted) become validity intervals, from each listing to the
key's next entry in that list. An as-of join holds every capture against the entries that were
active when it was fetched: by its host, the domains above it, and its host with the first path
segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and closing dot; empty if there is none."""
    return F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))


def keys_of(url: Column) -> Column:
    """The keys that may list a URL: its host, each domain above it of two labels or more, and
    host/segment. None without a host."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.array_join(F.slice(labels, i, n), "."))
    segment = F.regexp_extract(url, SEGMENT, 1)
    path = F.when(segment != "", F.array(F.concat_ws("/", host, segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.concat(domains, path)).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, since, until) of entries(list, key, dated, listed): active from since until
    before until, which is null where the entry still holds.

    Of entries of one list, key and date, a delisting counts. A listing of what is listed
    already begins a new interval. Entries with a null list, key, date or flag are not used.
    The window runs over one key of one list, whose entries are few.
    """
    entries = entries.where("list is not null and key is not null and dated is not null and listed is not null")
    daily = entries.groupBy("list", "key", "dated").agg(F.min("listed").alias("listed"))
    follows = F.lead("dated").over(Window.partitionBy("list", "key").orderBy("dated"))
    return daily.withColumn("until", follows).where("listed").select("list", "key", F.col("dated").alias("since"), "until")


def screen(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures(url, fetched, ...) plus n_active, lists and since.

    n_active is the number of entries that were active for the URL when it was fetched, lists
    their lists' names (sorted, distinct, joined by commas), since the latest date of such an
    entry's listing. A null URL or date, and a URL without a host, match nothing (0, '' and
    null). Each distinct URL and date is judged once and repeated rows share its verdict. The
    join is by key, so a key that many captures have is a large join partition, which adaptive
    execution splits. Other columns pass through, but for ones named as the results. Empty
    tables are fine on either side.
    """
    passed = [c for c in captures.columns if c not in ("n_active", "lists", "since")]
    captures = captures.select(*[f"`{c}`" for c in passed])
    asked = captures.where("url is not null and fetched is not null").select("url", "fetched").distinct()
    keyed = asked.withColumn("key", F.explode(F.array_distinct(keys_of(F.col("url")))))
    active = intervals(entries)
    met = keyed.join(active, "key").where((F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    verdict = met.groupBy("url", "fetched").agg(
        F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.max("since").alias("since")
    )
    return captures.join(verdict, ["url", "fetched"], "left").select(
        *[f"`{c}`" for c in passed], F.coalesce("n_active", F.lit(0)).alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"), "since"
    )
