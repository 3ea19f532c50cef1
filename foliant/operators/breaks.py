"""Operators that join lines which a break has parted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import text as T
from foliant.functions import vocab as V
from foliant.operators.lines import join_pairs, split_lines, to_lines


def _structural(x: Column) -> Column:
    return T.starts_with(x, "#", "**", "|") | T.has(x, r"^\s*+[-*]")


def _by_letter(words: list[str]) -> str:
    """Any of the words, which are plain: those of a letter are tried only after it."""
    firsts = dict.fromkeys(w[0] for w in words)
    return T.one_of(*(f + T.one_of(*(w[1:] for w in words if w[0] == f)) for f in firsts))


def _ends(x: Column, words: list[str]) -> Column:
    """The last word is looked for in as many characters as can hold it and the one before it."""
    return T.has(F.right(T.rstrip(x), F.lit(max(map(len, words)) + 1)), rf"\b{_by_letter(words)}$", True)


def _begins(x: Column, words: list[str]) -> Column:
    return T.has(x, rf"^\s*{_by_letter(words)}\b", True)


def _hyphen(x: Column) -> Column:
    return x.contains("-") & T.rstrip(x).endswith("-")


def _spaced() -> Column:
    return F.concat(T.rstrip(F.col("line")), F.lit(" "), T.lstrip(F.col("next")))


def join_broken_sentences(lines: DataFrame) -> DataFrame:
    """Lines that end unfinished, or whose next line (blank ones aside) goes on with the sentence, take it in."""
    short = ~T.more_words(F.col("line"), 2) & ~T.rstrip(F.col("line")).endswith(":") & T.more_words(F.col("next"), 2)
    goes_on = _hyphen(F.col("line")) | _ends(F.col("line"), V.UNFINISHED_ENDINGS) | _begins(F.col("next"), V.CONTINUING_STARTS_1 + V.CONTINUING_STARTS_2) | short
    return join_pairs(lines, ~_structural(F.col("line")) & ~_structural(F.col("next")) & goes_on, _spaced(), "nonblank", drop_after_tail=True)


def join_hyphens(lines: DataFrame) -> DataFrame:
    """A line that ends with a hyphen takes in the next one, without a space; the hyphen stays."""
    pred = _hyphen(F.col("line")) & ~T.blank(F.col("next")) & ~T.starts_with(F.col("next"), "#", "**", "|")
    return join_pairs(lines, pred, F.concat(T.rstrip(F.col("line")), T.lstrip(F.col("next"))))


def join_across_blanks(lines: DataFrame) -> DataFrame:
    """A sentence that blank lines have parted is joined."""
    end = F.right(T.rstrip(F.col("line")), F.lit(1))
    opened = ~end.isin(*".!?:;,") & T.more_words(F.col("line"), 3)
    goes_on = T.has(F.col("next"), r"^\s*[a-z]") | _begins(F.col("next"), V.RESUMING_STARTS) | _ends(F.col("line"), V.MID_THOUGHT_ENDINGS)
    pred = (F.col("gap") > 0) & ~_structural(F.col("line")) & ~_structural(F.col("next")) & opened & goes_on
    return join_pairs(lines, pred, _spaced(), "nonblank")


#: Line ends and line starts that mark a broken paragraph (fixed values).
OPEN_ENDINGS = ("Thieves'", "(", ",", " the", " a", " an", " and", " or", " of", " in", " to", " for", " with", " from", " by", " as")
KNOWN_STARTS = ("Guild,", "Area ", "Street", "Avenue")


def join_paragraphs(lines: DataFrame) -> DataFrame:
    """The older paragraph joiner, on the next line only."""
    marks = ("#", "**", "*", "-", "|", ">", "```")
    now, then = T.rstrip(F.col("line")), T.strip(F.col("next"))
    ends = F.lit(False)
    for e in OPEN_ENDINGS:
        ends = ends | now.endswith(e)
    done = F.lit(False)
    for e in (".", "!", "?", ":", ";", ")"):
        done = done | now.endswith(e)
    small = T.has(then, r"^\p{Ll}") & ~T.starts_with(then, "see ", "area ")
    goes_on = ends | T.starts_with(then, *KNOWN_STARTS) | (~done & small & (T.word_count(now) > 3))
    pred = ~T.starts_with(now, *marks) & (now != "") & (then != "") & ~T.starts_with(T.rstrip(F.col("next")), *marks) & goes_on
    return join_pairs(lines, pred, F.concat(now, F.lit(" "), then))


#: Starts of lines that belong to the line before (fixed values).
CLEANUP_STARTS = (r"^\s*[,;.]\s+", r"^\s*(, or|, and|, but|, yet|, so|, nor)\s+", r"^\s*or\s+[a-z]", r"^\s*(or frame|and other|but also|yet still)\s+")


def _unquoted(x: Column) -> Column:
    return T.strip(F.substr(T.strip(x), F.lit(2)))


def belongs_before(x: Column) -> Column:
    s = T.strip(x)
    seen = F.when(s.startswith(">"), _unquoted(x)).otherwise(x)
    any_start = F.lit(False)
    for p in CLEANUP_STARTS:
        any_start = any_start | T.has(seen, p, True)
    return (s != "") & ~s.startswith("#") & any_start


def join_cleanup(lines: DataFrame) -> DataFrame:
    """Lines that begin with punctuation or go on with a list join the line before, without their quote marker."""
    taken = F.when(T.strip(F.col("next")).startswith(">"), _unquoted(F.col("next"))).otherwise(T.strip(F.col("next")))
    return join_pairs(lines, belongs_before(F.col("next")), F.concat(T.rstrip(F.col("line")), F.lit(" "), taken))


def cleanup_candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, n): what a dry run would report; lines are not used up."""
    later = F.slice(split_lines(F.col("text")), 2, F.greatest(F.lit(0), F.size(split_lines(F.col("text"))) - 1))
    return docs.select("doc_id", F.size(F.filter(later, belongs_before)).cast("long").alias("n"))


#: A value, and a multiplier (fixed patterns).
VALUE, MULTIPLIER = r"^[+\d.]+(\s*to\s*[+\d.]+)?%?$", r"^x\d+"


def parse_notes(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, category, section, descriptor, multiplier) from semi-structured notes. The first line names the
    category; a line of letters before one with "multiplier" opens a section; a line before a value is a row."""
    clean = docs.select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[\u200B-\u200D\uFEFF\u00A0_:]", "").alias("text"))
    lines = to_lines(clean, "splitlines").select("doc_id", "line_no", T.strip(F.col("line")).alias("line")).where("line <> ''")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    df = lines.withColumn("k", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("line").over(w), F.lit("")))
    df = df.withColumn("category", F.first("line").over(w)).where("k > 1")
    df = df.withColumn("opens", T.has(F.col("line"), r"^[\p{L} ]*\p{L}[\p{L} ]*$") & T.has(F.col("next"), "multiplier", True))
    df = df.withColumn("pred", F.col("opens") | T.has(F.col("next"), VALUE, True) | T.has(F.col("next"), MULTIPLIER, True))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    stop = F.coalesce(F.max(F.when(~F.col("pred"), F.col("k"))).over(so_far), F.lit(1))
    df = df.withColumn("head", F.col("pred") & ((F.col("k") - stop) % 2 == 1))
    section = F.coalesce(F.last(F.when(F.col("head") & F.col("opens"), F.col("line")), ignorenulls=True).over(so_far), F.lit(""))
    df = df.withColumn("section", section).where(F.col("head") & ~F.col("opens"))
    return df.select("doc_id", "line_no", "category", "section", F.col("line").alias("descriptor"), F.col("next").alias("multiplier"))
