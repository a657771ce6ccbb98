"""URL filters as a temporal list join.

Dated list entries become validity intervals; every capture is judged by the entries that were valid when it was
fetched. Intervals are cut at bounds of fixed stretches of time, so that captures and intervals meet by key and stretch:
a hot host with a long history is spread over its stretches, and adaptive execution splits what is still skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Days per stretch.
STRETCH = 64


def intervals(entries: DataFrame, last: int) -> DataFrame:
    """(list, key, starts, ends): when an entry is valid (``ends`` is excluded), from rows (list, key, action, at).

    ``action`` is ``add`` or ``remove``, ``at`` a day number. An entry is valid from an add to the next row of its list
    and key; of rows of one day the remove counts last. Rows with a null in any of the four, and other actions, are
    ignored; repeated rows change nothing. ``last`` is the day after all captures.
    """
    known = entries.where("list IS NOT NULL AND key IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
    state = known.groupBy("list", "key", "at").agg(F.max("action").alias("action"))  # 'remove' is the larger
    following = F.lead("at").over(Window.partitionBy("list", "key").orderBy("at"))
    return (state.withColumn("ends", F.coalesce(following, F.lit(last))).where("action = 'add' AND ends > at")
            .select("list", "key", F.col("at").alias("starts"), "ends"))


def url_keys(url: Column | str) -> Column:
    """Keys under which lists can name a URL: its host, each parent domain, and the host with its first path step."""
    url = F.lower(F.col(url) if isinstance(url, str) else url)
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    step = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#]+(/[^/?#]+)", 1)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels) - i + 1)))
    keys = F.when(step != "", F.concat(parents, F.array(F.concat(host, step)))).otherwise(parents)
    return F.when(F.coalesce(host, F.lit("")) != "", F.array_distinct(keys))


def judged(captures: DataFrame, entries: DataFrame, last: int, stretch: int = STRETCH) -> DataFrame:
    """(page_id, fetched, n_block, n_allow, blocked) for every row (page_id, url, fetched) of ``captures``.

    Counts are of keys of the URL with a valid entry of the list ``block`` or ``allow`` on that day; a page is blocked if
    a block entry is valid and no allow entry is. Null or malformed URLs and null days match nothing. Rows are told
    apart by (page_id, url, fetched), and repeated ones are all returned. Other columns are not read.
    """
    rows = captures.select("page_id", "url", F.col("fetched").cast("int").alias("fetched"))
    span = intervals(entries, last)
    cut = span.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("starts") / stretch), F.floor((F.col("ends") - 1) / stretch))))
    asked = (rows.where("fetched IS NOT NULL").distinct().withColumn("key", F.explode(url_keys("url")))
             .withColumn("stretch", F.floor(F.col("fetched") / stretch)))
    met = asked.join(cut, ["key", "stretch"]).where("starts <= fetched AND fetched < ends")
    counts = met.groupBy("page_id", "url", "fetched").agg(
        F.sum((F.col("list") == "block").cast("long")).alias("b"), F.sum((F.col("list") == "allow").cast("long")).alias("a"))
    c = counts.toDF("_p", "_u", "_f", "b", "a")
    out = rows.join(c, rows["page_id"].eqNullSafe(c["_p"]) & (rows["url"] == c["_u"]) & (rows["fetched"] == c["_f"]), "left")
    block, allow = F.coalesce("b", F.lit(0)), F.coalesce("a", F.lit(0))
    return out.select("page_id", "fetched", block.cast("long").alias("n_block"), allow.cast("long").alias("n_allow"),
                      ((block > 0) & (allow == 0)).alias("blocked"))


def allowed(captures: DataFrame, entries: DataFrame, last: int) -> DataFrame:
    """The rows of ``captures`` that are not blocked on the day they were fetched."""
    bad = judged(captures, entries, last).where("blocked").select(F.col("page_id").alias("_p"), F.col("fetched").alias("_f")).distinct()
    return captures.join(bad, captures["page_id"].eqNullSafe(bad["_p"]) & (captures["fetched"].cast("int") == bad["_f"]), "left_anti")
