"""URL filters whose lists change: entries active when a page was fetched decide.

A list is a table of dated changes (list, kind, value, day, blocked): from that day on the value is blocked or free again.
Changes become validity intervals per value, at most one change a day. A capture is looked up under its host, the
domains above it and the prefixes of its path, and each key's interval that holds the day of the fetch decides.

Intervals are gathered per value before the join: a value has at most one per day, so the array of a value is bounded by
the days the list covers, and a capture meets one row per key however often a value changed.
"""

from pyspark.sql import Column, DataFrame, functions as F, Window as W


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(F.length(host) > 0, host)


def path_of(url: Column) -> Column:
    """Path without query, fragment and slashes at its ends."""
    return F.regexp_replace(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"^/+|/+$", "")


def keys_of(url: Column) -> Column:
    """The keys of a URL, array of (kind, value): its host, every domain above it, host and path up to each segment."""
    host, labels = host_of(url), F.split(host_of(url), r"\.")
    segments = F.filter(F.split(path_of(url), "/+"), lambda s: s != "")
    upto = lambda n: F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    return F.when(host.isNull(), F.array().cast("array<struct<kind:string,value:string>>")).otherwise(F.concat(
        F.array(key("host", host)),
        F.transform(upto(F.size(labels) - 1), lambda i: key("domain", F.array_join(F.slice(labels, i, F.size(labels)), "."))),
        F.transform(upto(F.size(segments)), lambda i: key("path", F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/"))))))


def intervals(changes: DataFrame) -> DataFrame:
    """Validity intervals (list, kind, value, since, until, blocked); until is exclusive and null for the last.

    Of several changes of a value on one day blocking wins. Rows with a null in any column are left out.
    """
    daily = changes.dropna(subset=["list", "kind", "value", "day", "blocked"]).groupBy("list", "kind", "value", "day").agg(
        F.max("blocked").alias("blocked"))
    after = W.partitionBy("list", "kind", "value").orderBy("day")
    return daily.select("list", "kind", "value", F.col("day").alias("since"), F.lead("day").over(after).alias("until"), "blocked")


def evaluate(captures: DataFrame, changes: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """Per capture: key, url, fetched, n_entries (active entries that block it), lists (their lists, sorted), blocked.

    Captures without host or without fetch day match nothing and aren't blocked. Repeated rows give repeated rows. Other
    columns are left out.
    """
    rows = captures.select(captures[key].alias("_id"), captures[url].alias("_url"), captures[fetched].alias("_day")).groupBy(
        "_id", "_url", "_day").agg(F.count("*").cast("int").alias("_copies"))
    periods = intervals(changes).groupBy("kind", "value", "list").agg(F.collect_list(F.struct("since", "until", "blocked")).alias("periods"))
    active = lambda p: p["blocked"] & (p["since"] <= F.col("_day")) & (p["until"].isNull() | (F.col("_day") < p["until"]))
    looked = rows.select("*", F.explode(keys_of(F.col("_url"))).alias("_key")).select("*", "_key.kind", "_key.value")
    hits = looked.join(periods, ["kind", "value"]).filter(F.exists("periods", active))
    found = hits.groupBy("_id", "_url", "_day").agg(F.count("*").alias("_n"), F.array_sort(F.collect_set("list")).alias("_lists"))
    same = F.col("r._id").eqNullSafe(F.col("f._id")) & (F.col("r._url") == F.col("f._url")) & F.col("r._day").eqNullSafe(F.col("f._day"))
    n = F.coalesce("_n", F.lit(0)).cast("long")
    return rows.alias("r").join(found.alias("f"), same, "left").select(
        F.col("r._id").alias(key), F.col("r._url").alias("url"), F.col("r._day").alias("fetched"), n.alias("n_entries"),
        F.coalesce(F.array_join("_lists", ","), F.lit("")).alias("lists"), (n > 0).alias("blocked"),
        F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_copy")).drop("_copy")
