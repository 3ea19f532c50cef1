"""Tables of contents: three normalizers and two comparisons with the headings. The normalizers need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.lines import let, map_regions, split_lines

#: Markers of a table of contents and of its end (fixed values).
MARKERS = ("## Table Of Contents", "# Table Of Contents", "Table Of Contents")
NOTE = "The Table of Contents will likely"
CONTENT_STARTS = ("Castles Zagyg:", "Foreword", "Part I", "Introduction")
FIRST_PART, BOOK_TITLE = "# Part I:", "Castles Zagyg: Yggsburgh"


def _numbered(x: Column) -> Column:
    return T.sub(T.sub(x, r"^(\d+)\.(\S)", "$1. $2"), r"^(\d+):\s*(\S)", "$1: $2")


def _dotted(title: Column, page: Column, width: int, least: int, most: int) -> Column:
    dots = F.least(F.lit(most), F.greatest(F.lit(least), F.lit(width) - F.length(title) - F.length(page) - 2))
    return F.concat(title, F.lit(" "), F.repeat(F.lit("."), dots), F.lit(" "), page)


def _first(lines: Column, test: "callable") -> Column:
    """The position (from 1) of the first line that passes; null if none does."""
    return F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(test(x), i + 1)), lambda i: i.isNotNull()))


def plain_toc(docs: DataFrame, width: int = 70) -> DataFrame:
    """``docs`` with the plain table of contents set in dotted lines, and n_changes. Without a marker or an end the text
    stays as it is."""
    df = docs.withColumn("ls", split_lines(F.col("text"), "splitlines"))
    exact = _first(F.col("ls"), lambda x: x.contains(MARKERS[-1]) & T.strip(x).isin(*MARKERS))
    loose = _first(F.col("ls"), lambda x: T.has(x, r"^\s*+[tT]") & (F.lower(T.strip(x)) == "table of contents"))
    df = df.withColumn("start", F.coalesce(exact, loose))
    after = F.slice("ls", F.col("start") + 1, F.size("ls"))
    df = df.withColumn("end", F.when(F.col("start").isNotNull(), F.col("start") + _first(after, lambda x: let(T.lstrip(x), lambda s: T.starts_with(s, NOTE, *CONTENT_STARTS)))))

    def entry(raw: Column) -> Column:
        s = T.strip(raw)
        flat = T.sub(s, r"\s+", " ")
        pattern = T.EXACT + r"^(.*?\S)\s+(\d{1,3})$"
        title = _numbered(T.strip(F.regexp_extract(flat, pattern, 1)))
        title = F.when(F.length(title) > width - 10, T.rstrip(F.substr(title, F.lit(1), F.lit(width - 10)))).otherwise(title)
        page = F.regexp_extract(flat, pattern, 2)
        made = F.when(page != "", _dotted(title, page, width, 5, 50)).otherwise(_numbered(flat))
        return F.struct(s.alias("was"), made.alias("now"))

    block = F.slice("ls", F.col("start") + 1, F.col("end") - F.col("start") - 1)
    entries = F.transform(F.filter(block, lambda x: ~T.blank(x) & ~T.has(T.strip(x), r"^\d{1,3}$")), entry)
    df = df.withColumn("es", F.when(F.col("end").isNotNull(), entries))
    whole = F.concat(
        F.slice("ls", 1, F.col("start") - 1), F.array(F.lit("## Table Of Contents")), F.transform("es", lambda e: e["now"]), F.array(F.lit("")), F.slice("ls", F.col("end"), F.size("ls"))
    )
    df = df.withColumn("n_changes", F.coalesce(F.size(F.filter("es", lambda e: e["was"] != e["now"])), F.lit(0)).cast("long"))
    df = df.withColumn("n_changes", F.when(F.col("end").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_changes")))
    return df.withColumn("text", F.when(F.col("end").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(whole, "\n"))).select(*docs.columns, "n_changes")


def _rewrite_region(docs: DataFrame, closes: "callable", change: "callable") -> DataFrame:
    """``change`` of the lines between the marker and a closing line; a line that becomes null goes."""
    opens = lambda x: T.strip(x) == MARKERS[0]
    out = map_regions(split_lines(F.col("text"), "readlines"), opens, closes, lambda x, inside: F.when(inside & ~opens(x), change(x)).otherwise(x))
    return docs.withColumn("text", F.array_join(F.filter(out, lambda x: x.isNotNull()), "\n"))


def dotted_toc(docs: DataFrame) -> DataFrame:
    """The first normalizer: dotted entries to a width of 80."""
    pattern = T.EXACT + r"^(.+?)\s+\.{3,}\s+(\d+)\s*$"

    def change(x: Column) -> Column:
        s = T.strip(x)
        title, page = T.strip(F.regexp_extract(s, pattern, 1)), F.regexp_extract(s, pattern, 2)
        seen = x.contains("." * 12) | T.has(s, "[0-9]$")
        return F.when(seen & (page != ""), _dotted(title, page, 80, 3, 60)).otherwise(x)

    return _rewrite_region(docs, lambda x: T.starts_with(T.strip(x), FIRST_PART) | (T.strip(x) == BOOK_TITLE), change)


def crowded_toc(docs: DataFrame) -> DataFrame:
    """The second one: a line with several dotted entries becomes a line for each, to a width of 70."""
    pattern = T.EXACT + r"([^.]+?)\.{3,}\s*(\d+)"

    def change(x: Column) -> Column:
        s = T.strip(x)
        titles = F.transform(F.regexp_extract_all(s, F.lit(pattern), 1), T.strip)
        pages = F.regexp_extract_all(s, F.lit(pattern), 2)
        pairs = F.filter(F.arrays_zip(titles.alias("t"), pages.alias("p")), lambda e: e["t"] != "")
        made = F.array_join(F.transform(pairs, lambda e: F.concat(_dotted(e["t"], e["p"], 70, 5, 50), F.lit("  "))), "\n")
        fits = x.contains("." * 18) & (F.size(titles) > 0)
        return F.when(fits & (F.size(pairs) == 0), F.lit(None)).when(fits, made).otherwise(x)

    return _rewrite_region(docs, lambda x: T.starts_with(T.strip(x), NOTE), change)


def _toc_and_headings(docs: DataFrame, clean: "callable") -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    toc = F.transform(F.regexp_extract_all(text, F.lit(r"(?dUm)^\[(.+?)\]\(\)"), 1), clean)
    heads = F.transform(F.regexp_extract_all(text, F.lit(r"(?dUm)^(#{1,6})\s+(.+)$"), 2), lambda h: clean(T.strip(h)))
    return docs.select("doc_id", toc.alias("toc"), heads.alias("heads"))


def _compared(df: DataFrame) -> DataFrame:
    seq = F.filter("toc", lambda t: F.array_contains(F.col("heads"), t))
    missing = F.filter("toc", lambda t: ~F.array_contains(F.col("heads"), t))
    df = df.withColumn("seq", seq).withColumn("missing", missing)
    return df.withColumn("order_mismatch", F.col("seq") != F.filter("heads", lambda h: F.array_contains(F.col("seq"), h)))


def toc_check(docs: DataFrame) -> DataFrame:
    """(doc_id, toc_count, headings_count, missing, order_mismatch); missing is joined by " | "."""
    df = _compared(_toc_and_headings(docs, lambda x: x))
    counts = [F.size(c).cast("long").alias(n) for c, n in (("toc", "toc_count"), ("heads", "headings_count"))]
    return df.select("doc_id", *counts, F.array_join("missing", " | ").alias("missing"), "order_mismatch")


def toc_vs_headings(docs: DataFrame, shown: int = 25) -> DataFrame:
    """As ``toc_check`` on titles with white space evened out; extra has the first ``shown`` headings that are not in the
    table but begin like an entry, numbering_warn tells of appendix letters out of order."""
    df = _compared(_toc_and_headings(docs, lambda x: T.strip(T.sub(x, r"\s+", " "))))
    stems = F.transform("toc", lambda t: F.substring_index(t, " [", 1))
    extra = F.filter("heads", lambda h: ~F.array_contains(F.col("toc"), h) & F.exists(stems, lambda s: h.startswith(s)))
    letters = F.filter(F.transform(F.filter("toc", lambda t: F.lower(t).startswith("appendix")), lambda t: F.regexp_extract(t, T.ANY_CASE + r"appendix\s+([A-Z])\b", 1)), lambda x: x != "")
    df = df.withColumn("letters", letters)
    counts = [F.size(c).cast("long").alias(n) for c, n in (("toc", "toc_entries"), ("heads", "heading_entries"))]
    return df.select(
        "doc_id", *counts, F.array_join("missing", " | ").alias("missing"), F.array_join(F.slice(extra, 1, shown), " | ").alias("extra"), "order_mismatch",
        (F.col("letters") != F.array_sort("letters")).alias("numbering_warn"),
    )
