"""The whole clean-up of a book, in the order of its steps, with a summary of each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import vocab as V
from foliant.operators import breaks, detect, headers, rewrite, spell, tables, toc
from foliant.operators.lines import split_lines, to_docs, to_lines


@dataclass(frozen=True)
class BookConfig:
    """Settings of a run, as a ``[tool.book-pipeline]`` table may give them."""

    out_suffix: str = "-cleaned"
    max_header_depth: int = 4
    long_line_threshold: int = 150
    inline_tables: bool = False


def _relined(docs: DataFrame, *steps) -> DataFrame:
    """Runs line operators one after another: one shuffle by doc_id for all of them."""
    lines = to_lines(docs)
    for step in steps:
        lines = step(lines).select("doc_id", "line_no", "line")
    return to_docs(lines)


def fix_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): broken sentences, hyphens, sentences across blank lines."""
    return _relined(docs, breaks.join_broken_sentences, breaks.join_hyphens, breaks.join_across_blanks)


def clean_layout(docs: DataFrame, config: BookConfig = BookConfig()) -> DataFrame:
    """(doc_id, text): the steps of ``clean_book`` up to line starts, which mend the layout."""
    df = toc.plain_toc(docs.select("doc_id", "text")).drop("n_changes")
    df = rewrite.remove_quotes(rewrite.remove_images(df))
    df = detect.remove_page_numbers(df).drop("n_removed")
    df = headers.correct_depth(fix_paragraphs(df), config.max_header_depth)
    return _relined(df, breaks.join_cleanup)


def clean_book(docs: DataFrame, config: BookConfig = BookConfig()) -> DataFrame:
    """(doc_id, text): contents, images, quotes, page numbers, paragraphs, headings, line starts, prices, OCR mistakes,
    and, if asked for, tables as tab-separated text. Long lines are left as they are. Lazy, with one shuffle."""
    df = clean_layout(docs, config)
    df = tables.fix_prices(df).drop("n_changes")
    df = rewrite.pattern_rules(rewrite.literal_rules(df), rewrite.additional_rules())
    return tables.inline_tables(df).drop("n_tables") if config.inline_tables else df


def quality_report(docs: DataFrame, config: BookConfig = BookConfig()) -> DataFrame:
    """(step, metric, n): spelling candidates, long lines by severity, paragraph issues by rule, table and blank-line
    issues of the finished text."""

    def as_metrics(df: DataFrame, step: str, name: str) -> DataFrame:
        return df.select(F.lit(step).alias("step"), F.col(name).alias("metric"), F.col("n").cast("long").alias("n"))

    words = spell.spelling_candidates(docs, None).agg(F.count(F.lit(1)).alias("n")).withColumn("metric", F.lit("candidates"))
    out = as_metrics(words, "spell_check", "metric")
    out = out.union(as_metrics(detect.severity_counts(docs, config.long_line_threshold, ignore_headers=True, ignore_code=True), "long_lines", "severity"))
    issues = detect.paragraph_issues(docs).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    out = out.union(as_metrics(issues, "paragraph_breaks", "rule"))
    bad = detect.table_integrity(docs).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    out = out.union(as_metrics(bad, "validation", "rule"))
    runs = detect.blank_runs(docs).agg(F.count(F.lit(1)).alias("n")).withColumn("metric", F.lit("blank runs"))
    return out.union(as_metrics(runs, "validation", "metric"))


def step_summary(docs: DataFrame, config: BookConfig = BookConfig()) -> DataFrame:
    """(step, metric, n): what each step of ``clean_book`` changes, over all documents. Lazy, in one pass: each step leaves
    its count beside the text, and the counts are added up at the end."""
    # doc_id, text and counts by "step metric"
    df = toc.plain_toc(docs.select("doc_id", "text")).withColumnRenamed("n_changes", "1_toc n_changes")
    df = rewrite.remove_images(df.withColumn("2_images n_images", rewrite.n_images(F.col("text"))))
    quoted = F.size(F.filter(split_lines(F.col("text")), rewrite.is_quote)).cast("long")
    df = rewrite.remove_quotes(df.withColumn("3_quotes n_removed", quoted))
    df = detect.remove_page_numbers(df).withColumnRenamed("n_removed", "4_page_numbers n_removed")
    names = df.columns[2:]
    lines = to_lines(df, keep=names)
    own = Window.partitionBy("doc_id")
    # of the rows that share a doc_id, which are one document from here on, each has its counts on its first line
    lines = lines.withColumns({c: F.sum(F.when(F.col("line_no") == 1, F.col(c)).otherwise(0)).over(own) for c in names})

    def joined(lines: DataFrame, step: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
        names.append(f"{name} joins")
        # counted at once, as a later step may take a joined line into another
        return step(lines).withColumn(names[-1], F.sum(F.col("head").cast("long")).over(own)).drop("head")

    for name, step in (("sentences", breaks.join_broken_sentences), ("hyphens", breaks.join_hyphens), ("blanks", breaks.join_across_blanks)):
        lines = joined(lines, step, f"5_{name}")
    names.append("6_headers corrections")
    df = headers.n_corrections(to_docs(lines, names[:-1]), config.max_header_depth).withColumnRenamed("n_corrections", names[-1])
    lines = to_lines(headers.correct_depth(df, config.max_header_depth), keep=names)
    df = to_docs(joined(lines, breaks.join_cleanup, "8_cleanup"), names)
    df = tables.fix_prices_and_words(df, V.OCR_BASE, names)
    names += ["9_prices n_changes", "10a_ocr_base n", "10b_ocr_additional n"]
    found = F.aggregate(rewrite.applied(F.col("text"), rewrite.additional_rules())["c"], F.lit(0).cast("long"), lambda a, x: a + x["n"])
    df = df.withColumnsRenamed({"n_changes": names[-3], "n_replaced": names[-2]}).withColumn(names[-1], found)
    sums = df.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names))
    rows = F.array(*(F.struct(*(F.lit(x).alias(y) for x, y in zip(c.split(" "), ("step", "metric"))), F.col(f"`{c}`").alias("n")) for c in names))
    return sums.select(F.inline(rows))


def second_ocr_pass(docs: DataFrame) -> DataFrame:
    """Word breaks, stops, dashes, spaces, typos and headings, in this order."""
    df = rewrite.space_after_stops(rewrite.fix_word_breaks(docs))
    return rewrite.normalize_headings(rewrite.fix_typos(rewrite.collapse_spaces(rewrite.unify_dashes(df))))


def second_ocr_report(docs: DataFrame) -> DataFrame:
    """What the second pass ends with: the contents of the corrected texts against their headings."""
    return toc.toc_check(second_ocr_pass(docs))
