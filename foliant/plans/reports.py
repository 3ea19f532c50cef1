"""Reports of the single steps, as text per document or as tables over all of them. Their wording is a fixed format."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import text as T
from foliant.operators import breaks, detect, headers, rewrite, spell
from foliant.operators.lines import beside, let, split_lines, to_lines

#: Entries that the reports show.
CHANGES_SHOWN, ISSUES_SHOWN, FIXES_SHOWN, WORDS_SHOWN, CONTEXTS_SHOWN, PREVIEW = 20, 20, 10, 50, 3, 100


def _text(*parts: Column) -> Column:
    """Lines, or arrays of lines, under each other."""
    return F.array_join(F.concat(*parts), "\n")


def _lines(*lines: Column | str) -> Column:
    return F.array(*(F.lit(x) if isinstance(x, str) else x for x in lines))


def _put(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))


def header_report(docs: DataFrame, max_depth: int = headers.MAX_DEPTH) -> DataFrame:
    """(doc_id, report): headings by level before the correction, those made bold, and the log of ``corrections``. Documents
    without headings have a report of zeros."""
    heads = headers.headers(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "level", "title"))).alias("hs"))
    log = headers.corrections(docs, max_depth).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "action", "original_level", "level"))).alias("log"))
    own = [F.coalesce(c, F.array().cast(k)).alias(c) for c, k in (("hs", "array<struct<line_no:bigint,level:bigint,title:string>>"), ("log", "array<struct<line_no:bigint,action:string,original_level:bigint,level:bigint>>"))]
    df = docs.select("doc_id").join(heads, "doc_id", "left").join(log, "doc_id", "left").select("doc_id", *own)

    def report(s: Column) -> Column:
        of = lambda kind: F.filter(s["log"], lambda x: x["action"] == kind)
        deep = F.filter(s["hs"], lambda h: h["level"] > max_depth)
        count = lambda k: F.size(F.filter(s["hs"], lambda h: h["level"] == k))
        levels = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), count(k).alias("n")) for k in range(1, 11))), lambda x: x["n"] > 0)
        shown = F.transform(levels, lambda x: _put("- H", x["k"], ": ", x["n"], " headers", F.when(x["k"] > max_depth, " (EXCESSIVE)").otherwise("")))
        top = F.coalesce(F.array_max(F.transform(s["hs"], lambda h: h["level"])), F.lit(0))
        head = _lines(
            "# Markdown Header Depth Correction Report", "", "## Summary", _put("- Total headers found: ", F.size(s["hs"])), _put("- Maximum depth found: H", top),
            _put("- Headers corrected: ", F.size(of("converted_to_bold"))), _put("- Hierarchy corrections: ", F.size(of("hierarchy_corrected"))), "",
            "## Header Depth Distribution (Before Correction)",
        )
        bold = F.when(F.size(deep) > 0, F.concat(_lines("", "## Excessive Headers Corrected"), F.transform(deep, lambda h: _put("- Line ", h["line_no"], ": H", h["level"], " '", h["title"], "'"))))
        logged = F.when(F.size(s["log"]) > 0, F.concat(_lines("", "## Detailed Transformation Log"), F.transform(s["log"], lambda x: _put("Line ", x["line_no"], ": H", x["original_level"], " → H", x["level"], " ", x["action"]))))
        none = F.array().cast("array<string>")
        return _text(head, shown, F.coalesce(bold, none), F.coalesce(logged, none))

    return df.select("doc_id", let(F.struct("hs", "log"), report).alias("report"))


def quote_changes(docs: DataFrame, shown: int = CHANGES_SHOWN) -> DataFrame:
    """(doc_id, n, line_no, before, after): the first ``shown`` lines of each document that lose a quote marker, and how
    many there are. No shuffle."""
    ls = split_lines(F.col("text"))
    after = lambda x: F.when(T.strip(x) == ">", "").otherwise(T.sub(x, r"^(\s*)>\s?", "$1"))
    found = F.filter(F.transform(ls, lambda x, i: F.when(rewrite.is_quote(x), F.struct((i + 1).cast("long").alias("line_no"), x.alias("before"), after(x).alias("after")))), lambda x: x.isNotNull())
    df = docs.select("doc_id", found.alias("found"))
    return df.select("doc_id", F.size("found").cast("long").alias("n"), F.explode(F.slice("found", 1, shown)).alias("s")).select("doc_id", "n", "s.*")


def cleanup_report(docs: DataFrame, issues: int = ISSUES_SHOWN, fixes: int = FIXES_SHOWN) -> DataFrame:
    """(doc_id, kind, line_no, current, next, fixed): the first lines of each document that belong to the line before
    (kind ``issue``), and the first that ``join_cleanup`` joins (``fix``)."""
    df = beside(docs).where(breaks.belongs_before(F.col("next"))).select("doc_id", F.lit("issue").alias("kind"), "line_no", F.col("line").alias("current"), "next", F.lit(None).cast("string").alias("fixed"))
    lines = to_lines(docs)
    w = Window.partitionBy("doc_id").orderBy("line_no")
    joined = breaks.join_cleanup(lines).where("head").select("doc_id", "line_no", F.col("line").alias("fixed"))
    both = lines.withColumn("next", F.lead("line").over(w)).join(joined, ["doc_id", "line_no"])
    made = both.select("doc_id", F.lit("fix").alias("kind"), "line_no", F.col("line").alias("current"), "next", "fixed")
    first = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("line_no"))
    most = F.when(F.col("kind") == "issue", issues).otherwise(fixes)
    return df.union(made).withColumn("rn", first).where(F.col("rn") <= most).drop("rn")


def long_line_report(docs: DataFrame, threshold: int = detect.THRESHOLD, preview: int = PREVIEW) -> DataFrame:
    """(doc_id, line_no, severity, length, n_breaks, reasons, preview): each long line with its suggested breaks."""
    df = detect.line_breaks(docs, threshold)
    shown = F.concat(F.substr("line", F.lit(1), F.lit(preview)), F.when(F.col("length") > preview, "...").otherwise(""))
    return df.select("doc_id", "line_no", "severity", "length", F.size("breaks").cast("long").alias("n_breaks"), F.array_join("reasons", ", ").alias("reasons"), shown.alias("preview"))


def spelling_report(docs: DataFrame, words: int = WORDS_SHOWN, contexts: int = CONTEXTS_SHOWN) -> DataFrame:
    """(rank, word, n, k, doc_id, line_no, context): the most frequent suspect words of all documents, each with the first
    lines that contain it and their neighbours. The words are a bounded table, joined to the lines without a shuffle of
    them; of each task only the first contexts of a word are sorted."""
    top = spell.spelling_candidates(docs, words)
    df = beside(docs).select("doc_id", "line_no", F.concat_ws("\n", "prev", "line", "next").alias("context"), F.lower("line").alias("l"))
    hits = df.join(F.broadcast(top), F.contains(F.col("l"), F.col("word"))).select("rank", "word", "n", "doc_id", "line_no", "context")
    k = F.row_number().over(Window.partitionBy("rank").orderBy("doc_id", "line_no"))
    return hits.withColumn("k", k.cast("long")).where(F.col("k") <= contexts).select("rank", "word", "n", "k", "doc_id", "line_no", "context")


def rule_report(docs: DataFrame, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """One row of a pass of pattern rules: patterns checked, patterns with matches, corrections, and characters before and
    after."""
    rules = list(rules)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    if rewrite.known_literals(rules):  # one pass
        before = F.length(F.coalesce("text", F.lit(""))).cast("long")
        rows = docs.select(before.alias("b"), rewrite.applied(F.col("text"), rules).alias("a"))
        first = F.struct(F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("n"), F.col("b").alias("b"), F.length("a.t").cast("long").alias("a"))
        none = F.lit(0).cast("long")
        rest = F.transform("a.c", lambda x: F.struct(x["k"].alias("k"), x["n"].alias("n"), none.alias("b"), none.alias("a")))
        sums = rows.select(F.inline(F.concat(F.array(first), rest))).groupBy("k").agg(*(F.sum(c).alias(c) for c in "nba"))
        matched = F.count_if(F.col("k") > 0).alias("n_matched")
        out = sums.agg(matched, total("n").alias("n_corrections"), total("b").alias("size_before"), total("a").alias("size_after"))
        return out.select(F.lit(len(rules)).cast("long").alias("n_checked"), "n_matched", "n_corrections", "size_before", "size_after")
    counts = rewrite.pattern_counts(docs, rules).agg(F.count(F.lit(1)).alias("n_matched"), total("n").alias("n_corrections"))
    size = lambda df, name: df.agg(total(F.length("text")).alias(name))
    sizes = size(docs, "size_before").crossJoin(size(rewrite.pattern_rules(docs, rules), "size_after"))  # single rows
    return counts.crossJoin(sizes).select(F.lit(len(rules)).cast("long").alias("n_checked"), "n_matched", "n_corrections", "size_before", "size_after")


def status_lines(summary: DataFrame) -> DataFrame:
    """(step, line): a line for each step of a summary (step, metric, n, and error where a step failed)."""
    error = F.max("error") if "error" in summary.columns else F.lit(None).cast("string")
    df = summary.groupBy("step").agg(error.alias("error"))
    return df.select("step", F.when(F.col("error").isNull(), _put("- ", F.col("step"), ": OK")).otherwise(_put("- ", F.col("step"), ": ERROR (error: ", F.col("error"), ")")).alias("line"))
