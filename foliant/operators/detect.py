"""Detectors: each yields a table of issues and needs no shuffle, as every line is seen beside its neighbours."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import text as T
from foliant.functions import vocab as V
from foliant.operators.lines import beside, held, let, marked, scan, split_lines


def _last_word(x: Column) -> Column:
    """The last word of a line without its quote marker and punctuation; null without words."""
    body = F.when(x.startswith(">"), T.strip(F.substr(x, F.lit(2)))).otherwise(x)
    return F.try_element_at(T.words(F.regexp_replace(F.lower(body), r"(?U)[^\w\s]", "")), F.lit(-1))


def _bare(word: Column) -> Column:
    """Lower case, without stops around it."""
    return F.regexp_replace(F.lower(word), r"^[.,!?;:]+|[.,!?;:]+\z", "")


def _found(docs: DataFrame, *issues: Callable[[], Column]) -> DataFrame:
    """(doc_id, line_no, rule, detail) of several kinds of issue in one pass. Each looks at a stripped line that isn't
    blank, with its stripped neighbours, and gives a struct or null."""
    df = beside(docs, "readlines")
    df = df.select("doc_id", "line_no", "n_lines", *(T.strip(F.col(c)).alias(c) for c in ("line", "next", "next2"))).where("line <> ''")
    some = F.filter(F.array(*(issue() for issue in issues)), lambda s: s.isNotNull())
    return df.select("doc_id", "line_no", F.explode(some).alias("s")).select("doc_id", "line_no", "s.rule", "s.detail")


def _issue(fits: Column, rule: Column, detail: Column) -> Column:
    return F.when(fits & rule.isNotNull(), F.struct(rule.alias("rule"), detail.alias("detail")))


def _plain() -> Column:
    """Neither a heading nor a fence."""
    return ~T.starts_with(F.col("line"), "#", "```")


def _ending() -> Column:
    line = F.col("line")
    last = _last_word(line)
    kinds = (
        (V.END_CONJUNCTIONS, "conjunction"), (V.END_PREPOSITIONS, "preposition"), (V.END_ARTICLES, "article"),
        (V.END_DETERMINERS, "determiner"), (V.END_RELATIVE_PRONOUNS, "relative pronoun"), (V.INCOMPLETE_VERBS, "incomplete verb"),
    )
    out = F.when(F.lit(False), "")
    for words, kind in kinds:
        out = out.when(last.isin(*words), kind)
    acts = last.endswith("s") & (F.length(last) > 3) & F.substr(last, F.lit(1), F.length(last) - 1).isin(*V.ACTION_VERBS)
    return _issue(_plain(), out.when(acts, "incomplete action verb"), last)


def _comma() -> Column:
    line, then = F.col("line"), F.col("next")
    short = line.endswith(",") & (then != "") & (T.word_count(then) <= 3) & ~(T.has(then, r"^[\p{Lu}\p{Lt}]") & ~line.endswith(" ,"))
    return _issue(_plain() & short, F.lit("comma break"), then)


def _orphan() -> Column:
    line = F.col("line")
    alone = ~T.has(line, r"\s") & ~line.startswith(">") & _bare(line).isin(*V.ORPHANS)
    return _issue(_plain() & alone, F.lit("orphaned word"), line)


def _beginning() -> Column:
    first = _bare(F.try_element_at(T.words(F.col("line")), F.lit(1)))
    return _issue(_plain() & first.isin(*V.START_CONTINUATIONS), F.lit("continuation word"), first)


def _quote() -> Column:
    text = lambda c: T.strip(F.substr(F.col(c), F.lit(2)))
    last, follow = F.lower(F.try_element_at(T.words(text("line")), F.lit(-1))), T.word_count(text("next2"))
    fits = (F.col("line_no") < F.col("n_lines") - 1) & F.col("line").startswith(">") & (F.col("next") == ">") & F.col("next2").startswith(">") & (follow > 0)
    rule = (
        F.when(last.isin(*V.RELATIVE_WORDS), "relative clause")
        .when(last.isin(*V.OBJECT_VERBS), "verb and object")
        .when(last.isin(*V.POSSESSIVES, *V.DEMONSTRATIVES) | (last.endswith("s") & (F.length(last) > 3)), "incomplete phrase")
    )
    return _issue(fits, rule, last)


def mid_word(line: Column, then: Column) -> Column:
    """The word that a stripped line's last word and the first word of the next stripped line make if they look like two
    parts of it; else null."""
    marks = ("#", "```", "|")
    a = F.regexp_extract(line, r"(?U)(\S+)\z", 1)
    one = F.regexp_extract(then, r"(?U)^(\S+)", 1)
    second = F.regexp_extract(then, r"(?U)^\S+\s+(\S+)", 1)
    b = F.when(~one.startswith(">"), one).when((one == ">") & (second != ""), second).otherwise(F.substr(one, F.lit(2)))
    both = F.concat(a, b)
    fits = (line != "") & (then != "") & ~T.starts_with(line, *marks) & ~T.starts_with(then, *marks)
    fits = fits & (F.length(a) >= 3) & ~T.has(a, r"[.!?,:;-]\z") & (F.length(b) >= 2) & ~T.has(b, r"^[\p{Lu}\p{Lt}]")
    fits = fits & (F.length(both) > 6) & T.has(both, r"^\p{L}+\z") & ~a.isin("the", "and", "but", "for", "with", "from")
    return F.when(fits, both)


def _mid_word() -> Column:
    both = mid_word(F.col("line"), F.col("next"))
    return _issue(both.isNotNull(), F.lit("mid-word break"), both)


def mend_mid_words(docs: DataFrame) -> DataFrame:
    """``docs`` with words that ``mid_word_breaks`` finds joined on the first line, from the last line to the first. White
    space of both lines is evened out, a quote keeps its marker, and a line that loses its only word goes. Linear."""
    df = docs.withColumn("ls", split_lines(F.col("text"), "readlines"))
    flagged = lambda ls: F.transform(ls, lambda x, i: F.struct(x.alias("x"), mid_word(T.strip(x), T.strip(F.get(ls, (i + 1).cast("int")))).isNotNull().alias("hit")))

    def step(after: Column, item: Column) -> Column:
        """``now``: the line as it is so far; ``done``: what the line below it ends as, null if it goes."""
        def join(both: Column) -> Column:
            mine, below = both["mine"], both["below"]
            quoted = F.get(below, F.lit(0)).startswith(">")
            bare = T.strip(F.substr(F.get(below, F.lit(0)), F.lit(2)))
            lone = quoted & (bare == "") & (F.size(below) > 1)
            first = F.when(lone, F.get(below, F.lit(1))).when(quoted, bare).otherwise(F.get(below, F.lit(0)))
            rest = F.array_join(F.slice(below, F.when(lone, 3).otherwise(2), F.size(below) + 1), " ")
            joined = F.array_join(F.concat(F.slice(mine, 1, F.size(mine) - 1), F.array(F.concat(F.element_at(mine, -1), first))), " ")
            left = F.when(rest == "", F.lit(None)).otherwise(F.concat(F.when(quoted, "> ").otherwise(""), rest))
            return F.struct(joined.alias("now"), left.alias("done"))

        both = F.struct(T.words(item["x"]).alias("mine"), T.words(after["now"]).alias("below"))
        fits = F.coalesce(item["hit"] & ~T.blank(item["x"]) & ~T.blank(after["now"]), F.lit(False))
        return F.when(fits, let(both, join)).otherwise(F.struct(item["x"].alias("now"), after["now"].alias("done")))

    def mended(ls: Column) -> Column:
        start = F.struct(F.lit(None).cast("string").alias("now"), F.lit(None).cast("string").alias("done"))
        states = scan(F.reverse(flagged(ls)), start, step, "struct<now:string,done:string>")
        return let(states, lambda s: F.reverse(F.filter(F.concat(F.transform(s, lambda x: x["done"]), F.array(F.element_at(s, -1)["now"])), lambda x: x.isNotNull())))

    text = F.when(F.size("ls") == 0, "").otherwise(F.array_join(let(F.col("ls"), mended), "\n"))
    return df.withColumn("text", text).select(*docs.columns)


def places(text: Column, pattern: str) -> Column:
    """Matches of a pattern: characters before it, and what it matched."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    both = F.filter(F.zip_with(parts, found, lambda p, f: F.struct(p.alias("p"), f.alias("f"))), lambda s: s["f"].isNotNull())
    step = lambda s, x: F.struct((s["end"] + F.length(x["p"]) + F.length(x["f"])).alias("end"), x["f"].alias("f"))
    start = F.struct(F.lit(0).alias("end"), F.lit("").alias("f"))
    return F.transform(scan(both, start, step, "struct<end:int,f:string>"), lambda s: F.struct((s["end"] - F.length(s["f"])).alias("at"), s["f"].alias("found")))


#: Characters on both sides that an error list shows for its kinds (fixed values).
FIX_CONTEXT, SPACES_CONTEXT, CHARACTER_CONTEXT = 50, 30, 10


def error_list(docs: DataFrame, fixes: tuple[tuple[str, str], ...] = V.ERROR_FIXES) -> DataFrame:
    """(doc_id, line_no, at, rule, detail, context): possible fixes, runs of spaces and characters beyond ASCII, by line, with
    what stands around them: in the line for fixes, else in the lines before and after, too. ``at``: characters before it in
    its line."""
    line, before = F.col("line"), F.coalesce(F.length("prev") + 1, F.lit(0))

    def entries(pattern: str, rule: str, detail: str | None, text: str, ahead: Column, width: int) -> Column:
        def entry(m: Column) -> Column:
            at, n = m["at"] + ahead, F.length(m["found"])
            shown = F.substr(F.col(text), F.greatest(at - width, F.lit(0)) + 1, F.least(at, F.lit(width)) + n + width)
            named = m["found"] if detail is None else F.lit(detail)
            return F.struct(m["at"].cast("long").alias("at"), F.lit(rule).alias("rule"), named.alias("detail"), F.concat(F.lit("..."), shown, F.lit("...")).alias("context"))

        none = F.array().cast("array<struct<at:bigint,rule:string,detail:string,context:string>>")
        return F.when(line.rlike(pattern), F.transform(places(line, pattern), entry)).otherwise(none)

    every = [entries(re.escape(a), "possible fix", f"{a} → {b}", "line", F.lit(0), FIX_CONTEXT) for a, b in fixes]
    every.append(entries(" {2,}", "multiple spaces", None, "around", before, SPACES_CONTEXT))
    every.append(entries(r"[^\x00-\x7F]", "non-ASCII character", None, "around", before, CHARACTER_CONTEXT))
    df = beside(docs).withColumn("around", F.concat_ws("\n", "prev", "line", "next"))
    df = df.where(line.rlike(T.one_of(*(re.escape(a) for a, _ in fixes), " {2,}", r"[^\x00-\x7F]")))
    for k, found in enumerate(every):
        df = df.withColumn(f"e{k}", found)
    return df.select("doc_id", "line_no", F.explode(F.concat(*(f"e{k}" for k in range(len(every))))).alias("e")).select("doc_id", "line_no", "e.*")


def line_endings(docs: DataFrame) -> DataFrame:
    """Lines that end with a word which wants another; rule is the word's kind, detail the word."""
    return _found(docs, _ending)


def comma_breaks(docs: DataFrame) -> DataFrame:
    """Lines that end with a comma before a short line that isn't a new sentence."""
    return _found(docs, _comma)


def orphan_words(docs: DataFrame) -> DataFrame:
    """Lines of one small word."""
    return _found(docs, _orphan)


def line_beginnings(docs: DataFrame) -> DataFrame:
    """Lines that begin with a word which goes on with a sentence."""
    return _found(docs, _beginning)


def quote_breaks(docs: DataFrame) -> DataFrame:
    """Sentences in quotes that an empty quote line parts."""
    return _found(docs, _quote)


def mid_word_breaks(docs: DataFrame) -> DataFrame:
    """Lines whose last word looks like the front of the next line's first; detail is both together."""
    return _found(docs, _mid_word)


def paragraph_issues(docs: DataFrame) -> DataFrame:
    """All of the above, in one pass."""
    return _found(docs, _ending, _comma, _orphan, _beginning, _quote, _mid_word)


def issue_summary(docs: DataFrame, shown: int = 10) -> DataFrame:
    """(doc_id, rule, n, line_no, detail): the first ``shown`` issues of each rule in each document, and their number."""
    w = Window.partitionBy("doc_id", "rule")
    df = paragraph_issues(docs).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("rn", F.row_number().over(w.orderBy("line_no", "detail")))
    return df.where(F.col("rn") <= shown).select("doc_id", "rule", "n", "line_no", "detail")


SEPARATOR_ROW = r"^\s*\|(\s*:?-+:?\s*\|)+"


def table_integrity(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, rule, expected, found): pipe counts of separators and rows that differ from their table's head,
    and a head on the last line."""
    df = docs.select("doc_id", split_lines(F.col("text")).alias("ls"))
    row = lambda x: T.strip(x).startswith("|")
    pipes = lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))

    def turn(ls: Column) -> Callable[[Column, Column], Column]:
        """At the first line of a table its position, at the first line after one 0."""

        def value(x: Column, i: Column) -> Column:
            before = F.coalesce(row(F.get(ls, i - 1)), F.lit(False))
            return F.when(row(x) & ~before, i + 1).when(~row(x) & before, 0)

        return value

    # position of each line's table head; 0 outside tables
    df = df.withColumn("hs", let(F.col("ls"), lambda ls: held(marked(ls, turn(ls)), F.size(ls), F.lit(0))))
    every = lambda s: F.transform(s["ls"], lambda x, i: F.struct(x.alias("line"), F.get(s["hs"], i).alias("h"), F.get(s["ls"], F.get(s["hs"], i) - 1).alias("head"), F.get(s["ls"], (i + 1).cast("int")).alias("next")))
    seen = df.select("doc_id", F.size("ls").alias("n"), F.posexplode(let(F.struct("ls", "hs"), every)).alias("at", "s"))
    seen = seen.select("doc_id", "n", (F.col("at") + 1).alias("i"), "s.*").where("h > 0")
    head, line, then = pipes(F.col("head")).cast("long"), F.col("line"), F.col("next")
    first = F.col("h") == F.col("i")
    issue = lambda at, rule, found: F.struct(at.cast("long").alias("line_no"), F.lit(rule).alias("rule"), head.alias("expected"), found.cast("long").alias("found"))
    none = F.lit(None).cast("long")
    got = (
        F.when(first & (F.col("i") == F.col("n")), issue(F.col("i"), "no separator", none))
        .when(first & T.has(then, SEPARATOR_ROW) & (pipes(then) != head), issue(F.col("i") + 1, "separator", pipes(then)))
        .when(~first & ~T.has(line, SEPARATOR_ROW) & (pipes(line) != head), issue(F.col("i"), "row", pipes(line)))
    )
    return seen.select("doc_id", got.alias("g")).where("g IS NOT NULL").select("doc_id", "g.*")


def blank_runs(docs: DataFrame, most: int = 2) -> DataFrame:
    """(doc_id, line_no, n): runs of more than ``most`` blank lines."""
    df = beside(docs).where(T.blank(F.col("line"))).select("doc_id", "line_no")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    df = df.withColumn("run", F.col("line_no") - F.row_number().over(w))
    return df.groupBy("doc_id", "run").agg(F.min("line_no").alias("line_no"), F.count(F.lit(1)).alias("n")).where(F.col("n") > most).drop("run")


PAGE_NUMBER = r"^\s*[\-–—•*_~]*\s*(\d{1,4})\s*[\-–—•*_~]*\s*$"


def remove_page_numbers(docs: DataFrame) -> DataFrame:
    """``docs`` without lines of a page number alone between blank lines, and n_removed."""
    df = docs.withColumn("ls", split_lines(F.col("text"), "splitlines"))
    at = lambda i: F.coalesce(F.get(F.col("ls"), i.cast("int")), F.lit(""))
    kept = F.filter("ls", lambda x, i: ~(T.has(x, PAGE_NUMBER) & T.blank(at(i - 1)) & T.blank(at(i + 1))))
    df = df.withColumn("kept", kept).withColumn("n_removed", (F.size("ls") - F.size("kept")).cast("long"))
    return df.withColumn("text", F.array_join("kept", "\n")).select(*docs.columns, "n_removed")


THRESHOLD = 150


def long_lines(docs: DataFrame, threshold: int = THRESHOLD, ignore_headers: bool = False, ignore_code: bool = False) -> DataFrame:
    """(doc_id, line_no, length, severity, line): lines over ``threshold`` characters, but for fences, tables and rules."""
    df = beside(docs, "readlines").select("doc_id", "line_no", "line")
    fence = T.strip(F.col("line")).startswith("```")
    if ignore_code:
        w = Window.partitionBy("doc_id").orderBy("line_no")
        df = df.withColumn("open", F.sum(fence.cast("int")).over(w) % 2 == 1).where(~F.col("open"))
    s = T.strip(F.col("line"))
    df = df.where(~fence & ~T.has(s, r"^\|.*\|$") & ~T.has(s, r"^[-*_]{3,}$"))
    if ignore_headers:
        df = df.where(~T.has(s, r"^#{1,6}\s+"))
    df = df.withColumn("line", T.rstrip(F.col("line"))).withColumn("length", F.length("line").cast("long")).where(F.col("length") > threshold)
    severity = F.when(F.col("length") > 2 * threshold, "severe").when(F.col("length") > 1.5 * threshold, "moderate").otherwise("minor")
    return df.select("doc_id", "line_no", "length", severity.alias("severity"), "line")


def severity_counts(docs: DataFrame, threshold: int = THRESHOLD, ignore_headers: bool = False, ignore_code: bool = False) -> DataFrame:
    return long_lines(docs, threshold, ignore_headers, ignore_code).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


#: Where a long line may be parted (fixed patterns): after a sentence, before a clause, before a dash.
SENTENCE = r"(?<=[.!?])(?=\s+[A-Z])"
CLAUSE = r"(?=[,;]\s+(?:and|but|or|however|therefore|thus|hence|moreover|furthermore|nevertheless|nonetheless)\s+)"
DASH = r"(?=---\s)|(?<!-)(?=--\s)"


def _positions(line: Column, pattern: str, reason: str, least: int) -> Column:
    """Positions (characters before the break) of a pattern without width, over ``least``."""
    parts = F.transform(F.split(line, T.EXACT + pattern, -1), lambda p: F.length(p))
    inner = let(scan(parts, F.lit(0), lambda at, n: at + n, "int"), lambda ends: F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))))
    return F.transform(F.filter(inner, lambda p: p > least), lambda p: F.struct(p.alias("pos"), F.lit(reason).alias("reason")))


def line_breaks(docs: DataFrame, threshold: int = THRESHOLD, least: int = 40) -> DataFrame:
    """``long_lines`` with breaks array<int> and reasons array<string>: greedily the next good place past ``threshold``
    characters from the last; without any, word boundaries."""
    df = long_lines(docs, threshold)
    line = F.col("line")
    places = F.concat(_positions(line, SENTENCE, "sentence ending", least), _positions(line, CLAUSE, "clause break", least), _positions(line, DASH, "em-dash break", least))
    ordered = F.array_sort(places, lambda a, b: a["pos"] - b["pos"])

    def take(acc: Column, b: Column) -> Column:
        last = F.coalesce(F.try_element_at(acc, F.lit(-1))["pos"], F.lit(0))
        return F.when(b["pos"] - last > threshold, F.concat(acc, F.array(b))).otherwise(acc)

    kind = "array<struct<pos:int,reason:string>>"
    good = F.aggregate(ordered, F.array().cast(kind), take)

    def word_step(acc: Column, n: Column) -> Column:
        over = acc["run"] > threshold
        return F.struct(
            (F.when(over, 0).otherwise(acc["run"]) + n + 1).alias("run"),
            (acc["all"] + n + 1).alias("all"),
            F.when(over, F.concat(acc["out"], F.array(F.struct(acc["all"].alias("pos"), F.lit("word boundary").alias("reason"))))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("all"), F.array().cast(kind).alias("out"))
    fallback = F.aggregate(F.transform(T.words(line), F.length), start, word_step, lambda acc: acc["out"])
    df = df.withColumn("good", good).withColumn("b", F.when(F.size("good") > 0, F.col("good")).otherwise(fallback))
    return df.select("doc_id", "line_no", "length", "severity", "line", F.col("b.pos").alias("breaks"), F.col("b.reason").alias("reasons"))


def apply_breaks(broken: DataFrame) -> DataFrame:
    """``line_breaks`` with the line parted (new_line): parts are stripped and set apart by an empty line; in a quote each
    part keeps its marker."""
    line = F.col("line")
    quote = T.strip(line).startswith(">")
    lead = F.length(line) - F.length(T.lstrip(line))
    start = F.when(quote, F.length(F.regexp_extract(line, r"(?U)^(\s*> *)", 1))).otherwise(0)
    prefix = F.when(quote, F.concat(F.substr(line, F.lit(1), lead), F.lit("> "))).otherwise("")
    df = broken.withColumn("body", F.substr(line, start + 1)).withColumn("prefix", prefix)
    at = F.filter(F.transform("breaks", lambda p: p - start), lambda p: (p > 0) & (p < F.length("body")))
    df = df.withColumn("at", F.concat(F.array(F.lit(0)), at))
    part = lambda p, i: T.strip(F.substr(F.col("body"), p + 1, F.coalesce(F.get(F.col("at"), (i + 1).cast("int")), F.length("body")) - p))
    parts = F.filter(F.transform("at", part), lambda x: x != "")
    made = F.array_join(F.transform(parts, lambda x: F.concat(F.col("prefix"), x)), "\n\n")
    return df.withColumn("new_line", F.when(F.size("breaks") == 0, line).otherwise(made)).drop("body", "prefix", "at")


def odd_characters(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, rule, n): runs of spaces and characters beyond ASCII, by line."""
    df = beside(docs).select("doc_id", "line_no", T.count(F.col("line"), " {2,}").alias("a"), T.count(F.col("line"), r"[^\x00-\x7F]").alias("b"))
    both = F.explode(F.array(F.struct(F.lit("multiple spaces").alias("rule"), F.col("a").alias("n")), F.struct(F.lit("non-ASCII character").alias("rule"), F.col("b").alias("n"))))
    return df.select("doc_id", "line_no", both.alias("s")).select("doc_id", "line_no", "s.*").where("n > 0")
