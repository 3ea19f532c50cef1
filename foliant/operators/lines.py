"""Documents as lines, and back.

Operators that look at single lines work on the array of lines and need no shuffle; so do detectors, which see each line
beside its neighbours. Operators that join lines need windows over a document's lines: one shuffle by doc_id, which
regrouping the lines reuses.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import text as T

#: Line ends of ``str.splitlines``.
ANY_LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\u0085\u2028\u2029]"


def split_lines(text: Column, mode: str = "split") -> Column:
    """The array of lines. ``split``: at line feeds, keeping a last empty line. ``splitlines``: at any line end, without
    it. ``readlines``: at line feeds and carriage returns, without it. A null text is an empty one."""
    text = F.coalesce(text, F.lit(""))
    if mode == "split":
        return F.split(text, "\n", -1)
    lines = F.split(text, ANY_LINE_END if mode == "splitlines" else r"\r\n|\r|\n", -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once. A column that is used inside a lambda may be merged into it by the optimizer
    and then be evaluated for each element; an argument is not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def held(marks: Column, n: Column, first: Column) -> Column:
    """An array of ``n`` values: each mark's ``v`` from its position ``at`` (from 1, ascending) to the next mark, ``first``
    before all marks. Linear, where a fold that appends would copy its array for each line."""

    def build(s: Column) -> Column:
        until = lambda k: F.coalesce(F.get(s["m"], (k + 1).cast("int"))["at"], s["n"] + 1)
        lead = F.array_repeat(first, F.coalesce(F.get(s["m"], F.lit(0))["at"], s["n"] + 1) - 1)
        return F.flatten(F.concat(F.array(lead), F.transform(s["m"], lambda m, k: F.array_repeat(m["v"], until(k) - m["at"]))))

    return let(F.struct(marks.alias("m"), n.alias("n")), build)


def marked(lines: Column, value: Callable[[Column, Column], Column]) -> Column:
    """Marks for ``held``: position and ``value`` (of line and position from 0) where that isn't null."""
    found = F.transform(lines, lambda x, i: F.struct((i + 1).alias("at"), value(x, i).alias("v")))
    return F.filter(found, lambda m: m["v"].isNotNull())


def map_regions(lines: Column, opens: Callable[[Column], Column], closes: Callable[[Column], Column], change: Callable[[Column, Column], Column]) -> Column:
    """``change`` of each line and of whether it is in a region (its opening line is, its closing line isn't). Linear."""
    marks = lambda ls: marked(ls, lambda x, _: F.when(opens(x), True).when(closes(x), False))
    return let(lines, lambda ls: F.zip_with(ls, held(marks(ls), F.size(ls), F.lit(False)), change))


#: Results that ``scan`` gathers before it appends them, so that none is copied more often than that.
SCANNED = 256


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """All states of a left fold, one for each item: ``step`` of the state so far and the item. ``kind``: the state's type."""
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        return let(step(acc["s"], x), lambda s: F.struct(s.alias("s"), F.concat(acc["out"], F.array(s)).alias("out")))

    def many(acc: Column, part: Column) -> Column:
        return let(F.aggregate(part, F.struct(acc["s"].alias("s"), none.alias("out")), one), lambda r: F.struct(r["s"].alias("s"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def whole(xs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / SCANNED).cast("int")), lambda c: F.slice(xs, c * SCANNED + 1, SCANNED))
        empty = F.array().cast(f"array<array<{kind}>>")
        return F.when(F.size(xs) > 0, F.flatten(F.aggregate(parts, F.struct(start.cast(kind).alias("s"), empty.alias("out")), many, lambda acc: acc["out"]))).otherwise(none)

    return let(items, whole)


def map_text(docs: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """``docs`` with ``change`` applied to the whole text."""
    return docs.withColumn("text", change(F.coalesce("text", F.lit(""))))


def map_lines(docs: DataFrame, change: Callable[[Column], Column], mode: str = "split") -> DataFrame:
    """``docs`` with ``change`` applied to each line; a line that becomes null is dropped."""
    kept = F.filter(F.transform(split_lines(F.col("text"), mode), change), lambda x: x.isNotNull())
    return docs.withColumn("text", F.array_join(kept, "\n"))


def to_lines(docs: DataFrame, mode: str = "split", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, line_no, line), line numbers from 1, and the columns ``keep``."""
    found = docs.select("doc_id", *keep, F.posexplode(split_lines(F.col("text"), mode)).alias("at", "line"))
    return found.select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), "line", *keep)


def beside(docs: DataFrame, mode: str = "split", before: int = 1, after: int = 2) -> DataFrame:
    """``to_lines`` with prev, next and next2, null beyond the ends, and n_lines. No shuffle."""
    rows = docs.select("doc_id", split_lines(F.col("text"), mode).alias("ls"))
    at = lambda i: F.get(F.col("ls"), i.cast("int"))  # noqa: E731  null outside
    found = rows.select(
        "doc_id",
        F.size("ls").cast("long").alias("n_lines"),
        F.posexplode(
            F.transform(
                "ls",
                lambda x, i: F.struct(x.alias("line"), at(i - 1).alias("prev"), at(i + 1).alias("next"), at(i + 2).alias("next2")),
            )
        ).alias("at", "s"),
    )
    return found.select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), "s.line", "s.prev", "s.next", "s.next2", "n_lines")


def to_docs(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, text) from lines in order of line_no, and the columns ``keep``, which all lines of a document have alike."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    kept = [F.max(c).alias(c) for c in keep]
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"), *kept)


def join_pairs(lines: DataFrame, pred: Column, joined: Column, over: str = "all", drop_after_tail: bool = False) -> DataFrame:
    """Joins lines in pairs, left to right; a joined line is not looked at again.

    ``pred`` and ``joined`` may use line, next (the line to join) and gap (blank lines between). Within a run of lines for
    which ``pred`` holds, every second one, from the first, is a head. That is the closed form of the scan, so a window is
    enough. ``over``: next is the next line (``all``) or the next line that isn't blank (``nonblank``); then blank lines
    after a head are dropped, and with ``drop_after_tail`` those after the line it took, too.

    Adds ``head``: true where a pair was joined. Other columns are kept.
    """
    keep = [c for c in lines.columns if c not in ("doc_id", "line_no", "line", "head")]
    w = Window.partitionBy("doc_id").orderBy("line_no")
    back = Window.partitionBy("doc_id").orderBy(F.col("line_no").desc()).rowsBetween(Window.unboundedPreceding, -1)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    if over == "all":
        df = lines.withColumn("counts", F.lit(True)).withColumn("k", F.row_number().over(w))
        df = df.withColumn("next", F.lead("line").over(w)).withColumn("gap", F.lit(0))
    else:
        # places are counted anew: line numbers have gaps where an earlier operator dropped lines
        df = lines.withColumn("counts", ~T.blank(F.col("line"))).withColumn("place", F.row_number().over(w))
        df = df.withColumn("k", F.sum(F.col("counts").cast("int")).over(so_far))
        follow = F.last(F.when(F.col("counts"), F.struct("place", "line")), ignorenulls=True).over(back)
        df = df.withColumn("follow", follow).withColumn("next", F.col("follow.line"))
        df = df.withColumn("gap", F.col("follow.place") - F.col("place") - 1).drop("follow")
    df = df.withColumn("pred", F.col("counts") & F.col("next").isNotNull() & F.coalesce(pred, F.lit(False)))
    stop = F.coalesce(F.max(F.when(F.col("counts") & ~F.col("pred"), F.col("k"))).over(so_far), F.lit(0))
    df = df.withColumn("head", F.col("pred") & ((F.col("k") - stop) % 2 == 1))
    if over == "all":
        df = df.withColumn("tail", F.coalesce(F.lag("head").over(w), F.lit(False))).withColumn("gone", F.col("tail"))
    else:
        past = w.rowsBetween(Window.unboundedPreceding, -1)
        after_head = F.coalesce(F.last(F.when(F.col("counts"), F.col("head")), ignorenulls=True).over(past), F.lit(False))
        df = df.withColumn("after_head", after_head).withColumn("tail", F.col("counts") & F.col("after_head"))
        gone = F.col("after_head")
        if drop_after_tail:
            after_tail = F.coalesce(F.last(F.when(F.col("counts"), F.col("tail")), ignorenulls=True).over(past), F.lit(False))
            df = df.withColumn("after_tail", after_tail)
            gone = gone | (~F.col("counts") & F.col("after_tail"))
        df = df.withColumn("gone", gone)
    return df.where(~F.col("gone")).select("doc_id", "line_no", F.when(F.col("head"), joined).otherwise(F.col("line")).alias("line"), "head", *keep)
