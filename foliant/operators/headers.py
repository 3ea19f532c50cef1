"""Headings: depth, hierarchy, suggested levels, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import text as T
from foliant.operators.lines import beside, held, map_lines, map_regions, marked, scan, split_lines

MAX_DEPTH = 4
HEADER = r"^(#{1,10})\s+(.+)$"


def _level(x: Column) -> Column:
    """0 for other lines."""
    return F.length(F.regexp_extract(x, T.EXACT + HEADER, 1))


def _title(x: Column) -> Column:
    return T.strip(F.regexp_extract(x, T.EXACT + HEADER, 2))


def headers(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, level, title). No shuffle."""
    found = beside(docs).select("doc_id", "line_no", _level(F.col("line")).cast("long").alias("level"), _title(F.col("line")).alias("title"))
    return found.where("level > 0")


def level_histogram(docs: DataFrame) -> DataFrame:
    return headers(docs).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def depth_summary(docs: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(doc_id, total, excessive, deepest) of documents with headings; excessive counts levels as they stand."""
    over = F.count_if(F.col("level") > max_depth)
    return headers(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), over.alias("excessive"), F.max("level").alias("deepest"))


def _corrected(levels: Column, max_depth: int) -> Column:
    """Levels in order, none more than one below its predecessor's corrected level, unless that would pass the maximum."""

    def step(last: Column, level: Column) -> Column:
        return F.when((last > 0) & (level > last + 1) & (last < max_depth), last + 1).otherwise(level)

    return scan(levels, F.lit(0), step, "int")


def _with_levels(docs: DataFrame, max_depth: int, hierarchy: bool) -> DataFrame:
    """``docs`` with ls (lines), hs (headings: position ``at`` and level ``v``) and lv (their final levels)."""
    df = docs.withColumn("ls", split_lines(F.col("text")))
    df = df.withColumn("hs", marked(F.col("ls"), lambda x, _: F.when(_level(x) > 0, _level(x))))
    found = F.transform("hs", lambda h: h["v"])
    return df.withColumn("lv", _corrected(found, max_depth) if hierarchy else found)


def correct_depth(docs: DataFrame, max_depth: int = MAX_DEPTH, hierarchy: bool = True) -> DataFrame:
    """``docs`` with headings deeper than ``max_depth`` made bold, after hierarchy fixes. Every heading is spaced anew."""
    df = _with_levels(docs, max_depth, hierarchy)

    def change(x: Column, own: Column) -> Column:
        # the level of the last heading is held until the next one; only the heading itself takes it
        made = F.when(own > max_depth, F.concat(F.lit("**"), _title(x), F.lit("**"))).otherwise(F.concat(F.repeat(F.lit("#"), own), F.lit(" "), _title(x)))
        return F.when(_level(x) > 0, made).otherwise(x)

    final = F.zip_with("hs", "lv", lambda h, v: F.struct(h["at"].alias("at"), v.alias("v")))
    df = df.withColumn("text", F.array_join(F.zip_with("ls", held(final, F.size("ls"), F.lit(0)), change), "\n"))
    return df.select(*docs.columns)


def n_corrections(docs: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``docs`` with n_corrections: how many rows ``corrections`` has for it."""
    pairs = F.zip_with("hs", "lv", lambda h, v: (h["v"] != v).cast("long") + (v > max_depth).cast("long"))
    df = _with_levels(docs, max_depth, True).withColumn("n_corrections", F.aggregate(pairs, F.lit(0).cast("long"), lambda a, n: a + n))
    return df.select(*docs.columns, "n_corrections")


def corrections(docs: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(doc_id, line_no, original_level, level, action): what ``correct_depth`` logs; action is hierarchy_corrected or
    converted_to_bold."""
    df = _with_levels(docs, max_depth, True)
    rows = df.select("doc_id", F.explode(F.arrays_zip("hs", "lv")).alias("s"))
    rows = rows.select("doc_id", F.col("s.hs.at").cast("long").alias("line_no"), F.col("s.hs.v").cast("long").alias("original_level"), F.col("s.lv").cast("long").alias("level"))
    moved = rows.where("level <> original_level").withColumn("action", F.lit("hierarchy_corrected"))
    return moved.union(rows.where(F.col("level") > max_depth).withColumn("action", F.lit("converted_to_bold")))


def validate_hierarchy(docs: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(doc_id, line_no, prev_level, level): headings more than one level below the one before, both cut at the maximum."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    df = headers(docs).withColumn("level", F.least("level", F.lit(max_depth).cast("long")))
    return df.withColumn("prev_level", F.lag("level").over(w)).where("level > prev_level + 1").select("doc_id", "line_no", "prev_level", "level")


#: Lines that a page footer left behind, and the level that a heading's words call for (fixed patterns; first match counts).
FOOTERS = (r"^#{1,6}\s+Castles Zagyg:\s*Yggsburgh\s*$", r"^#{1,6}\s+Setting,\s*History\s*and\s*Culture\s*$", r"^#{1,6}\s+Part\s+[IVX]+\s*$")
LEVELS = (
    (r"^#{1,6}\s+(Part\s+[IVX]+:?\s*.+)$", 1),
    (r"^#{1,6}\s+(Chapter\s+\d+:?\s*.+)$", 1),
    (r"^#{1,6}\s+(Appendix\s+[A-Z]:?\s*.+)$", 1),
    (r"^#{1,6}\s+(Introduction|Background|Overview|History|Culture|Geography|Conclusion)(\s+.*)?$", 2),
    (r"^#{1,6}\s+(Foreword|Preface|Notes?\s+for\s+.+|Table\s+of\s+Contents)$", 2),
    (r"^#{1,6}\s+(Population|Social\s+Classes|Dress[,\s]+Style.+|Common\s+Names|Coin\s+of\s+.+|Town\s+Revenues)$", 3),
    (r"^#{1,6}\s+(The\s+Culture\s+of|Local\s+.+\s+Nobles|Elites\s+and\s+Administration)$", 2),
    (r"^#{1,6}\s+([A-Z][a-z]+\s+(Hills|Forest|River|Lake|Valley|Mountains?|Woods?))$", 3),
    (r"^#{1,6}\s+(Males?|Females?|Human\s+.+\s+Names|Demi-human\s+Names)$", 4),
)


def _issue(x: Column) -> Column:
    """A struct of the issue of a line, or null."""
    s = T.strip(x)
    level = F.length(F.regexp_extract(s, T.EXACT + r"^(#{1,6})\s+(.+)$", 1))
    title = F.regexp_extract(s, T.EXACT + r"^(#{1,6})\s+(.+)$", 2)
    footer = F.lit(False)
    for p in FOOTERS:
        footer = footer | T.has(s, p, True)
    own = F.length(F.regexp_extract(x, T.EXACT + r"^(#{1,6})\s+", 1))  # of the line as it is: an indented one has none
    wanted = F.when(own > 0, own).otherwise(2)
    for p, lv in reversed(LEVELS):
        wanted = F.when(T.has(s, p, True), lv).otherwise(wanted)
    made = lambda to, kind, sure: F.struct(s.alias("original"), to.alias("suggested"), F.lit(kind).alias("issue_type"), sure.alias("confidence"))
    fix = made(F.concat(F.repeat(F.lit("#"), wanted), F.lit(" "), title), "hierarchy_fix", F.when(F.abs(level - wanted) <= 2, "medium").otherwise("low"))
    return F.when(level > 0, F.when(footer, made(F.lit("[REMOVE - Footer artifact]"), "footer_artifact", F.lit("high"))).when(level != wanted, fix))


def header_issues(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, original, suggested, issue_type, confidence)."""
    found = beside(docs, "readlines").select("doc_id", "line_no", _issue(F.col("line")).alias("s")).where("s IS NOT NULL")
    return found.select("doc_id", "line_no", "s.*")


def issue_counts(docs: DataFrame) -> DataFrame:
    return header_issues(docs).groupBy("issue_type").agg(F.count(F.lit(1)).alias("n"))


def fix_headers(docs: DataFrame) -> DataFrame:
    """Footer lines go; suggestions of high or medium confidence are taken."""

    def change(x: Column) -> Column:
        issue = _issue(x)
        kind = issue["issue_type"]
        return F.when(kind == "footer_artifact", F.lit(None)).when((kind == "hierarchy_fix") & (issue["confidence"] == "medium"), issue["suggested"]).otherwise(x)

    return map_lines(docs, change, "readlines")


#: Section titles (fixed values).
TITLES = (
    r"^(Part [IVX]+|Appendix [A-Z]|Introduction|Foreword|Background|History|Setting, History and Culture|The Culture of Yggsburgh|"
    r"Local Palatine Nobles|Coin of the Realm|Town Revenues|The Outs|Population|Social Classes|Dress, Style, Appearance and Manners|"
    r"Common Names in Yggsburgh|Table Of Contents)$"
)


def is_section_title(x: Column) -> Column:
    """At most 80 characters, neither all capitals nor all small, and a known title or one with a capital at the start of
    each run of letters and only there, without a final stop."""
    s = T.strip(x)
    title_case = T.has(s, r"[\p{Lu}\p{Lt}]") & ~T.has(s, r"(?<![\p{L}])[\p{Ll}]") & ~T.has(s, r"(?<=[\p{L}])[\p{Lu}\p{Lt}]")
    mixed = T.has(s, r"[\p{Lu}\p{Lt}]") & T.has(s, r"\p{Ll}")
    neither = mixed | ~T.has(s, r"[\p{Lu}\p{Lt}\p{Ll}]")
    return (s != "") & (F.length(s) <= 80) & neither & ~T.has(s, r"^\d+$") & (T.has(s, TITLES) | (title_case & ~s.endswith(".")))


def promote_headers(docs: DataFrame) -> DataFrame:
    """Section titles become headings of level 2, but in tables of contents, which end at the first blank line."""
    starts = lambda x: F.lower(T.strip(x)) == "table of contents"

    def change(x: Column, inside: Column) -> Column:
        return F.when(~inside & is_section_title(x) & ~T.strip(x).startswith("#"), F.concat(F.lit("## "), T.strip(x))).otherwise(x)

    return docs.withColumn("text", F.array_join(map_regions(split_lines(F.col("text"), "readlines"), starts, T.blank, change), "\n"))


def tag_headings(docs: DataFrame) -> DataFrame:
    """Word tags before headings (second pass over a book of names): <ch>, <1>, <2> for levels 1, 2, and 3 or more; not
    inside the table of contents, which the first "# ...Introduction" after it ends."""
    opens = lambda x: T.strip(x) == "# Table of contents"
    closes = lambda x: T.strip(x).startswith("# ") & T.strip(x).contains("Introduction")

    def change(x: Column, inside: Column) -> Column:
        s = T.strip(x)
        tag = F.when(s.startswith("###"), "<2> ").when(s.startswith("##"), "<1> ").otherwise("<ch> ")
        plain = ~s.startswith("#") | (inside & ~opens(x))
        return F.when(plain, x).otherwise(F.concat(T.sub(x, r"#.*$", ""), tag, F.regexp_extract(x, T.EXACT + "(#.*)$", 1)))

    return docs.withColumn("text", F.array_join(map_regions(split_lines(F.col("text"), "readlines"), opens, closes, change), "\n"))
