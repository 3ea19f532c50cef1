"""Line dedup by site-relative frequency. DataFrame functions only.

Per host, the pages that contain a line are divided by the host's pages; lines above a ratio are boilerplate and go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut

#: A line on more than this share of its host's pages is boilerplate ...
MAX_RATIO = 0.05
#: ... if it is on this many of them at least: on a small host chance, or two copies of a page, alone reach the ratio.
MIN_PAGES = 5
#: A host with fewer pages needs this share of them, and FEWEST pages at least.
SMALL_RATIO, FEWEST = 0.8, 3
#: Boilerplate lines of a host in one bin of its table, about.
BIN = 16
#: Boilerplate lines of all hosts up to which their table is broadcast (about 16 bytes each).
BROADCAST_LINES = 200_000
#: Parts into which a host's pages are dealt where the table is too large for that.
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _counted(line: Column) -> Column:
    """Blank lines are neither counted nor dropped."""
    return F.length(F.trim(line)) > 0


def boilerplate(docs: DataFrame, host: Column, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """(host, line hash) of all boilerplate lines. Counts cover all rows; with ``copies_once``, the rows of a host that
    have the same text are one page (a text, too, is known by two hashes then, and null is a text).

    A line counts once a page. It is known by two 64-bit hashes while it is counted; each task adds up what it has read
    before the shuffle, so a host or line with many pages is a few rows for the tasks that gather it.
    """
    page = [F.xxhash64("text").alias("__t"), F.xxhash64(F.lit(1), "text").alias("__t2")] if copies_once else []
    named = ["__t", "__t2"] if copies_once else []
    count = F.countDistinct(*named) if copies_once else F.count(F.lit(1))
    pages = docs.select(host.alias("__host"), *page, F.array_distinct(F.filter(_lines(F.col("text")), _counted)).alias("__lines"))
    totals = pages.groupBy("__host").agg(count.alias("__total"))
    found = (
        pages.select("__host", *named, F.explode("__lines").alias("__line"))
        .select("__host", *named, F.xxhash64("__line").alias("__h"), F.xxhash64(F.lit(1), "__line").alias("__h2"))
        .groupBy("__host", "__h", "__h2")
        .agg(count.alias("__n"))
        .where(F.col("__n") >= min(min_pages, FEWEST))
    )
    joined = found.join(totals, found["__host"].eqNullSafe(totals["__host"])).select(found["__host"], "__h", "__n", "__total")
    least = F.least(F.lit(min_pages), F.greatest(F.lit(FEWEST), F.ceil(F.col("__total") * SMALL_RATIO)))
    return joined.where((F.col("__n") > F.col("__total") * max_ratio) & (F.col("__n") >= least)).select("__host", "__h").distinct()


def bins(hashes: Column) -> Column:
    """The hashes dealt in bins by their remainder, about BIN in each, so that looking one up reads one bin."""
    n = F.ceil(F.size(hashes) / BIN).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.filter(hashes, lambda h: F.pmod(h, n) == k))


def holds(dealt: Column, h: Column) -> Column:
    """Whether a hash is in ``bins``; of a single bin, which most hosts have, without its remainder."""
    one = F.array_contains(F.get(dealt, F.lit(0)), h)
    return F.when(F.size(dealt) == 1, one).otherwise(F.array_contains(F.get(dealt, F.pmod(h, F.size(dealt)).cast("int")), h))


def drop_lines(
    docs: DataFrame, host: Column | None = None, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES,
    copies_once: bool = False,
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and the long columns n_lines and n_dropped.

    ``host`` defaults to the column source. Null hosts are one host. A null text stays null and has no lines; a text
    whose lines all go is empty; a very long text is many lines and one page; a line counts once a page; an empty table
    gives an empty result. Repeated rows are pages of their own, unless ``copies_once``: then a host's rows with the
    same text count as one page, so that an article's copies don't make its lines boilerplate. The other columns stay as they are, but
    for n_lines and n_dropped, which are replaced; names that begin with two underscores are the operator's.

    A host has at most (lines a page) / ``max_ratio`` boilerplate lines, so one row a host holds them. That table is
    broadcast if it is small, as counted; else pages and table are joined by host, each host's pages in SALTS parts.
    """
    host = F.col("source") if host is None else host
    frequent = cut(boilerplate(docs, host, max_ratio, min_pages, copies_once))
    by_host = frequent.groupBy("__host").agg(F.collect_set("__h").alias("__drop")).select(F.col("__host").alias("__at"), bins(F.col("__drop")).alias("__drop"))
    rows = docs.withColumn("__host", host)
    if frequent.count() <= broadcast_lines:
        joined = rows.join(F.broadcast(by_host), F.col("__host").eqNullSafe(F.col("__at")), "left")
    else:
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
        dealt = by_host.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = F.col("__host").eqNullSafe(F.col("__at")) & (F.col("__salt") == F.col("__part"))
        joined = rows.join(dealt, on, "left")
    lines = F.coalesce(_lines(F.col("text")), F.array().cast("array<string>"))
    kept = F.filter("__all", lambda x: ~(_counted(x) & holds(F.col("__drop"), F.xxhash64(x))))
    out = (
        joined.withColumn("__all", lines)
        .withColumn("__kept", F.when(F.col("__drop").isNull(), F.col("__all")).otherwise(kept))
        .withColumn("n_lines", F.size("__all").cast("long"))
        .withColumn("n_dropped", (F.size("__all") - F.size("__kept")).cast("long"))
        .withColumn("text", F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.array_join("__kept", "\n")))
    )
    return out.select(*(c for c in docs.columns if c not in ("n_lines", "n_dropped")), "n_lines", "n_dropped")
