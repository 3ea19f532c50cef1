"""Rewrites of whole texts and of single lines. None needs a shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions import vocab as V
from foliant.operators.lines import let, map_lines, map_text, split_lines

IMAGE, HTML_IMAGE = r"!\[.*?\]\([^)]*\)", r"<img[^>]*>"


#: Rules that matched, with the number of their matches.
COUNTS = "array<struct<k:bigint,n:bigint>>"


def remove_daggers(docs: DataFrame) -> DataFrame:
    """Adds n_removed."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("n_removed", (F.length(text) - F.length(F.replace(text, F.lit("†"), F.lit("")))).cast("long")).withColumn(
        "text", F.replace(text, F.lit("†"), F.lit(""))
    )


def remove_images(docs: DataFrame) -> DataFrame:
    """Images go, lines are stripped. A line that ends up empty stays only if it held something else than an image."""

    def change(x: Column) -> Column:
        bare = let(_without_images(x), lambda b: F.when(b.contains("<"), T.sub(b, HTML_IMAGE, "", True)).otherwise(b))
        out = T.strip(let(bare, lambda b: F.when(b.contains("  "), T.sub(b, " {2,}", " ")).otherwise(b)))
        return let(out, lambda o: F.when((o != "") | ((x != "") & ~T.has(x, r"^\s*" + IMAGE + r"\s*$")), o))

    return map_lines(docs, change)


def _without_images(x: Column) -> Column:
    return F.when(x.contains("!["), T.sub(x, IMAGE, "")).otherwise(x)


def n_images(text: Column) -> Column:
    """An image does not span lines."""
    none = F.lit(0).cast("long")
    per_line = lambda x: F.when(x.contains("!["), T.count(x, IMAGE)).otherwise(none) + F.when(x.contains("<"), T.count(_without_images(x), HTML_IMAGE, True)).otherwise(none)
    return F.aggregate(F.transform(split_lines(text), per_line), F.lit(0).cast("long"), lambda a, n: a + n)


def image_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_images)."""
    return docs.select("doc_id", n_images(F.col("text")).alias("n_images"))


def is_quote(x: Column) -> Column:
    return T.has(x, r"^\s*+>")


def remove_quotes(docs: DataFrame) -> DataFrame:
    """One level of quote markers goes; a lone marker leaves an empty line."""
    return map_lines(docs, lambda x: F.when(~is_quote(x), x).when(T.strip(x) == ">", "").otherwise(T.sub(x, r"^(\s*)>\s?", "$1")))


def quote_stats(docs: DataFrame) -> DataFrame:
    """One row: n_lines, n_removed, and pct of lines changed, to one decimal."""
    per = docs.select(F.size(split_lines(F.col("text"))).alias("n"), F.size(F.filter(split_lines(F.col("text")), is_quote)).alias("q"))
    out = per.agg(F.sum("n").cast("long").alias("n_lines"), F.sum("q").cast("long").alias("n_removed"))
    return out.withColumn("pct", F.round(F.col("n_removed") * 100.0 / F.col("n_lines"), 1))


def tags_to_headings(docs: DataFrame) -> DataFrame:
    """Lines that begin with <ch>, <1>, <2> or <3> become headings of level 1 to 4."""
    tag = r"^\s*<(ch|1|2|3)>\s*"

    def change(x: Column) -> Column:
        found = F.lower(F.regexp_extract(x, "(?iU)" + tag, 1))
        level = F.when(found == "ch", 1).otherwise(found.cast("int") + 1)
        return F.when(found == "", x).otherwise(F.concat(F.repeat(F.lit("#"), level), F.lit(" "), T.lstrip(T.sub(x, tag, "", True))))

    return map_lines(docs, change)


def literal_rules(docs: DataFrame, rules: Iterable[tuple[str, str]] = V.OCR_BASE) -> DataFrame:
    """Ordered literal replacements, wherever they occur."""

    return docs.withColumn("text", replaced(F.col("text"), rules)["t"])


def replaced(text: Column, rules: Iterable[tuple[str, str]] = V.OCR_BASE) -> Column:
    """As ``applied``, of literal replacements."""
    table = F.array(*(F.struct(F.lit(k + 1).cast("long").alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(rules)))
    start = F.struct(F.coalesce(text, F.lit("")).alias("t"), F.array().cast(COUNTS).alias("c"))

    def changed(acc: Column, r: Column) -> Column:
        n = (F.octet_length(acc["t"]) - F.octet_length(F.replace(acc["t"], r["a"], F.lit("")))).cast("long")
        own = F.struct(r["k"].alias("k"), F.floor(n / F.octet_length(r["a"])).alias("n"))
        return F.struct(F.replace(acc["t"], r["a"], r["b"]).alias("t"), F.concat(acc["c"], F.array(own)).alias("c"))

    return F.aggregate(table, start, lambda acc, r: F.when(F.contains(acc["t"], r["a"]), changed(acc, r)).otherwise(acc))


def literal_counts(docs: DataFrame, rules: Iterable[tuple[str, str]] = V.OCR_BASE) -> DataFrame:
    """(rule_no, rule, n): how often each rule matched, counted as its turn came, over all documents."""
    rules = list(rules)
    counts = docs.select(F.explode(replaced(F.col("text"), rules)["c"]).alias("s"))
    names = F.array(*(F.lit(a) for a, _ in rules))
    total = counts.groupBy("s.k").agg(F.sum("s.n").alias("n"))
    return total.select(F.col("k").alias("rule_no"), F.get(names, (F.col("k") - 1).cast("int")).alias("rule"), "n")


#: Rules that are tried together: where none of them matches, none is applied.
RULE_GROUP = 8


#: Letters that a pattern without regard to case takes for ASCII ones, though lower-casing a text may not make them so.
ODD_CASES = "[\u0130\u0131\u017F\u212A]"


def literal(pattern: str) -> str | None:
    """What a lower-cased text holds wherever the pattern matches, if it is plain words between word boundaries or one mark
    between white space; else None."""
    found = re.fullmatch(r"\\b((?:[A-Za-z0-9' -]|\\[' -])+)\\b|\\s\+([,;:]|\\\.)\\s\+", pattern)
    return re.sub(r"\\(.)", r"\1", found[1] or found[2]).lower() if found else None


def known_literals(rules: list[tuple[str, str]]) -> bool:
    return bool(rules) and all(literal(p) and "\\" not in to for p, to in rules)


def _near(pattern: str) -> str | None:
    """What a text holds besides wherever a mark's pattern matches; null for words."""
    mark = re.escape(literal(pattern))
    return None if pattern.startswith(r"\b") else rf"(?U){mark}(?<=\s{mark})\s"


def _quick(pattern: str) -> str:
    """The same pattern, which looks for its word's first letter before the boundary."""
    return T.ANY_CASE + (f"(?={re.escape(literal(pattern)[0])})" if pattern.startswith(r"\b") else "") + pattern


def applied(text: Column, rules: list[tuple[str, str]]) -> Column:
    """A struct of the text after all rules, in order and without regard to case (t), and of the rules that matched, with the
    number of their matches as their turn came (c: k from 1, n). All rules have a literal; where the text doesn't hold it as
    the rule's turn comes, the pattern isn't tried, as it couldn't match."""
    table = F.array(*(F.struct(F.lit(k + 1).cast("long").alias("k"), F.lit(literal(p)).alias("has"), F.lit(_near(p)).cast("string").alias("near"), F.lit(_quick(p)).alias("p"), F.lit(to).alias("to")) for k, (p, to) in enumerate(rules)))
    whole = F.coalesce(text, F.lit(""))
    start = F.struct(whole.alias("t"), F.lower(whole).alias("low"), whole.rlike(ODD_CASES).alias("odd"), F.array().cast(COUNTS).alias("c"))

    def changed(acc: Column, r: Column) -> Column:
        parts = F.split(acc["t"], r["p"], -1)  # what stands between the matches
        made = let(parts, lambda ps: F.struct((F.size(ps) - 1).cast("long").alias("n"), F.when(F.size(ps) > 1, F.call_function("array_join", ps, r["to"])).alias("t")))
        put = lambda m: F.struct(m["t"].alias("t"), F.lower(m["t"]).alias("low"), acc["odd"].alias("odd"), F.concat(acc["c"], F.array(F.struct(r["k"].alias("k"), m["n"].alias("n")))).alias("c"))
        return let(made, lambda m: F.when(m["n"] > 0, put(m)).otherwise(acc))

    def step(acc: Column, r: Column) -> Column:
        may = F.contains(acc["low"], r["has"]) & (r["near"].isNull() | F.rlike(acc["t"], r["near"]))
        return F.when(acc["odd"] | may, changed(acc, r)).otherwise(acc)

    return F.aggregate(table, start, step, lambda acc: F.struct(acc["t"].alias("t"), acc["c"].alias("c")))


def pattern_rules(docs: DataFrame, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """Ordered patterns, without regard to case; replacements are in Python's notation. A group of rules is applied, in
    order, only to texts in which one of them matches, as one look for all of them shows; to others it would do nothing."""
    rules = list(rules)
    if known_literals(rules):
        return docs.withColumn("text", applied(F.col("text"), rules)["t"])
    df, text = docs.withColumn("text", F.coalesce("text", F.lit(""))), F.col("text")
    for first in range(0, len(rules), RULE_GROUP):
        group, changed = rules[first : first + RULE_GROUP], text
        for pattern, to in group:
            changed = T.sub(changed, pattern, T.java_replacement(to), True)
        some = T.has(text, T.one_of(*(f"(?:{p})" for p, _ in group)), True)
        df = df.withColumn("text", F.when(some, changed).otherwise(text))
    return df


def pattern_counts(docs: DataFrame, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """(rule_no, n) over all documents, each counted as its turn came."""
    rules = list(rules)
    if known_literals(rules):
        rows = docs.select(F.explode(applied(F.col("text"), rules)["c"]).alias("s"))
        return rows.groupBy(F.col("s.k").alias("rule_no")).agg(F.sum("s.n").alias("n"))
    df = docs.select(F.coalesce("text", F.lit("")).alias("t0"))
    for first in range(0, len(rules), 15):  # a projection for every 15 rules; in it each refers to the text before
        columns = [F.col(c) for c in df.columns if c[0] == "n"]
        for k in range(first, min(first + 15, len(rules))):
            pattern, to = rules[k]
            columns.append(T.count(F.col(f"t{k}"), pattern, True).alias(f"n{k}"))
            columns.append(T.sub(F.col(f"t{k}"), pattern, T.java_replacement(to), True).alias(f"t{k + 1}"))
        df = df.select(*columns)
    counts = [F.struct(F.lit(k + 1).cast("long").alias("rule_no"), F.col(f"n{k}").alias("n")) for k in range(len(rules))]
    out = df.select(F.explode(F.array(*counts)).alias("s")).groupBy("s.rule_no").agg(F.sum("s.n").alias("n"))
    return out.where("n > 0")


def additional_rules(overrides: Iterable[tuple[str, str]] = V.OCR_OVERRIDES) -> list[tuple[str, str]]:
    return [*V.OCR_ADDITIONAL, *((rf"\b{re.escape(a)}\b", b) for a, b in overrides)]


def fix_final(docs: DataFrame) -> DataFrame:
    """The last pass, which ends by deleting zero-width characters and no-break spaces."""
    # Python's `$` also stands before a final line feed, as does Java's; `+` runs are greedy in both
    return map_text(pattern_rules(docs, V.OCR_FINAL), lambda t: F.regexp_replace(t, r"[\u200B-\u200D\uFEFF\u00A0]", ""))


def fix_typos(docs: DataFrame, rules: Iterable[tuple[str, str]] = V.TYPOS) -> DataFrame:
    """Whole words in their listed case. As a match has the case of the rule, so has its replacement: capitals throughout,
    a capital first, or as listed."""
    def cased(wrong: str, right: str) -> str:
        return right.upper() if wrong.isupper() else right[:1].upper() + right[1:] if wrong[:1].isupper() else right

    def change(text: Column) -> Column:
        for wrong, right in rules:
            text = T.sub(text, rf"(?<!\w){re.escape(wrong)}(?!\w)", T.java_replacement(cased(wrong, right)))
        return text

    return map_text(docs, change)


def fix_word_breaks(docs: DataFrame) -> DataFrame:
    """Joins hyphens at line ends, then line ends and spaces before words of one to three small letters."""

    def change(text: Column) -> Column:
        text = T.sub(text, r"(?<=\w)-\s*\n\s*(?=\w)", "")
        text = T.sub(text, r"(?<=\w)\s*\n\s*(?=[a-z]{1,3}\b)", "")
        return T.sub(text, r"(?<=\w) (?=[a-z]{1,3}\b)", "")

    return map_text(docs, change)


def space_after_stops(docs: DataFrame) -> DataFrame:
    """A space after . ! ? before a letter, unless a single capital stands before."""
    return map_text(docs, lambda t: T.sub(t, r"""(?<!\b[A-Z])([.!?])(?!\s|["')\]])(?=[A-Za-z])""", "$1 "))


def unify_dashes(docs: DataFrame) -> DataFrame:
    """Two or three hyphens and em dashes become spaced em dashes; runs of spaces become one."""

    def change(text: Column) -> Column:
        text = T.sub(T.sub(text, r"\s*---\s*", " — "), r"\s*--\s*|\s*—\s*", " — ")
        return T.sub(T.sub(text, r"\s*—\s*", " — "), " {2,}", " ")

    return map_text(docs, change)


def collapse_spaces(docs: DataFrame) -> DataFrame:
    """Runs of spaces become one, but for a space at the start of the text."""
    return map_text(docs, lambda t: T.sub(t, "(?<!^) {2,}", " "))


def normalize_headings(docs: DataFrame, rules: Iterable[tuple[str, str]] = V.HEADING_FIXES) -> DataFrame:
    """On lines that begin with #: trailing white space goes, known mistakes are corrected."""

    def change(x: Column) -> Column:
        new = T.rstrip(x)
        for wrong, right in rules:
            new = F.replace(new, F.lit(wrong), F.lit(right))
        return F.when(x.startswith("#"), new).otherwise(x)

    return map_lines(docs, change, "splitlines")


def spaces_to_tabs(docs: DataFrame) -> DataFrame:
    """Runs of spaces become tabs, white space at line ends goes."""
    return map_lines(docs, lambda x: T.sub(T.sub(x, " {2,}", "\t"), r"[ \t]+$", ""))


def remove_anchors(docs: DataFrame) -> DataFrame:
    return map_text(docs, lambda t: T.sub(t, r"\[\]\{[^}]*\}", ""))


def _rows(items: Column, per_row: int) -> Column:
    n = F.size(items)
    rows = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / per_row).cast("int"))), lambda i: F.array_join(F.slice(items, i * per_row + 1, per_row), "\t"))
    return F.array_join(rows, "\n")


def comma_columns(names: Column, per_row: int = 5) -> Column:
    """A list with commas as rows of ``per_row`` names with tabs between."""
    return _rows(F.filter(F.transform(F.split(names, ",", -1), T.strip), lambda x: x != ""), per_row)


def dice_columns(names: Column, per_row: int = 4) -> Column:
    """A list of numbered names as rows of ``per_row`` pairs (number, name) with tabs between; others are left out."""
    entries = F.filter(F.transform(F.split(names, ",", -1), T.strip), lambda x: T.has(x, r"^\d+\s+.+$"))
    return _rows(F.transform(entries, lambda x: T.sub(x, r"^(\d+)\s+(.+)$", "$1\t$2")), per_row)


NAME_LIST = rf"^(\*\*{T.one_of(*V.NAME_LABELS)}\*\*\s*(?:\([^)]+\))?\s*:\s*)(.+)$"


def name_lists(docs: DataFrame) -> DataFrame:
    """Long name lists become columns, after their label and an empty line."""

    def change(x: Column) -> Column:
        label, names = F.regexp_extract(x, T.EXACT + NAME_LIST, 1), F.regexp_extract(x, T.EXACT + NAME_LIST, 2)
        fits = (label != "") & (T.count(names, ",") >= 3) & (F.length(names) > 50)
        dice = (label.contains("(d") & label.contains(")")) | T.has(names, r"^\s*\d+\s+\w+")
        return F.when(fits, F.concat(label, F.lit("\n\n"), F.when(dice, dice_columns(names)).otherwise(comma_columns(names)))).otherwise(x)

    return map_lines(docs, change)


#: Lines of a number and three words at least: words of any letters, and of ASCII letters only (the third may begin with an
#: accented one), as the SQL of the query has it.
ROW_OF_WORDS = r"^\d+\s+\w+\s+\w+\s+\w+"
ROW_OF_ASCII_WORDS = r"^[0-9]+[ \t\n\f\r]+[0-9A-Za-z_]+[ \t\n\f\r]+[0-9A-Za-z_]+[ \t\n\f\r]+[0-9A-Za-z_À-ÖØ-öø-ɏ]"


def book_headings(docs: DataFrame, row: str = ROW_OF_WORDS) -> DataFrame:
    """Known bold headings become headings, table-like lines get tabs (first pass over a book of names). ``row``: what a
    stripped line begins with whose single spaces become tabs, too."""
    known = F.array(*(F.lit(h) for h in V.BOOK_HEADINGS))

    def change(x: Column) -> Column:
        s = T.strip(x)
        title = T.strip(F.regexp_extract(s, T.EXACT + r"^\*\*(.+?)\*\*$", 1))
        top = T.has(title, r"^\d+") | title.isin(*V.TOP_TITLES)
        low = title.isin(*V.LOW_TITLES)
        mark = F.when(top, "# ").when(low, "### ").otherwise("## ")
        many = T.has(s, row)
        pairs = (F.length(s) - F.length(F.replace(s, F.lit("  "), F.lit("")))) / 2
        table = T.has(s, r"^\d+–\d+") | T.has(s, "^D%") | T.has(s, r"^\d+-\d+") | ((pairs >= 2) & (T.word_count(s) >= 3))
        done = T.starts_with(s, "<ch>", "<1>", "<2>", "<3>", "#") | x.contains("\t")
        return (
            F.when(done, x)
            .when((title != "") & F.array_contains(known, title), F.concat(mark, title))
            .when(many, T.sub(x, " +", "\t"))
            .when(table, T.sub(x, " {2,}", "\t"))
            .otherwise(x)
        )

    return map_lines(docs, change, "readlines")
