"""Tables: price lines that a break has parted, and pipe tables as tab-separated text.

Both take a varying number of lines at a time, which windows cannot express; they scan each text once, in Arrow batches,
without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T

PRICE_END, PER_POINT = re.compile(r"\d+gp\s*$"), re.compile(r"^(point|per point)")
TWO_PRICES, TIME_UNIT = re.compile(r"\d+gp\s+\d+gp"), re.compile(r"(weeks?|days?|hours?)")
ANY_PRICE, ONLY_PRICES = re.compile(r"\d+gp"), re.compile(r"^\d+gp(?:\s+\d+gp)*\s*$")
ARMOR, PRICE_PER = re.compile(r"armor.*work\s*$", re.IGNORECASE), re.compile(r"^\d+gp.*per\s*$")
#: One item that is known to be parted in this way (fixed values).
KNOWN_ITEM, KNOWN_PRICE = "Armor, steel mail, (full chain mail), 10 weeks' work", "125gp 20gp per"


def _price_step(line: str, later: list[str]) -> tuple[str, int] | None:
    """The joined line and how many lines it takes; None if the line stands alone. ``later``: the next two, stripped."""
    if later and PRICE_END.search(line.strip()) and PER_POINT.search(later[0]):
        return f"{line.rstrip()} {later[0]}", 2
    item = line.strip() and not line.strip().startswith("**") and not ANY_PRICE.search(line)
    if later and item and ONLY_PRICES.search(later[0]):
        return f"{line.rstrip()} {later[0]}", 2
    if len(later) > 1:
        known = KNOWN_ITEM in line and later[0] == KNOWN_PRICE and later[1].startswith("point restored")
        if known or (ARMOR.search(line) and PRICE_PER.search(later[0]) and later[1].startswith("point")):
            return f"{line} {later[0]} {later[1]}", 3
    return None


def mend_prices(text: str) -> tuple[str, int]:
    """The text with parted price lines joined, and the number of joins and of lines to look at by hand."""
    if "gp" not in text:  # no price
        return text, 0
    lines, out, changes, at = text.split("\n"), [], 0, 0
    priced = ["gp" in x for x in lines] + [False]
    while at < len(lines):
        if not (priced[at] or priced[at + 1]):
            out.append(lines[at])
            at += 1
            continue
        line, later = lines[at], [x.strip() for x in lines[at + 1 : at + 3]]
        step = _price_step(line, later)
        first = later and PRICE_END.search(line.strip()) and PER_POINT.search(later[0])
        doubtful = TWO_PRICES.search(line) and not TIME_UNIT.search(line) and "\t" not in line
        changes += (step is not None) + bool(doubtful and not first)
        out.append(step[0] if step else line)
        at += step[1] if step else 1
    return "\n".join(out), changes


SEPARATOR = re.compile(r"^\s*\|?\s*(:?-{3,}:?)\s*(\|\s*(:?-{3,}:?)\s*)+\|?\s*$")
FENCE = re.compile(r"^\s*`{3,}")
CELL_END = re.compile(r"\\(.)|\\$|\|")


def is_row(line: str) -> bool:
    s = line.strip()
    return "|" in s and not s.startswith((">", "#", "-", "*"))


def cells(line: str) -> list[str]:
    """Cells between pipes; a backslash makes the next character ordinary and goes."""
    s = line.strip().removeprefix("|").removesuffix("|")
    found, past = [""], 0
    for m in CELL_END.finditer(s):
        found[-1] += s[past : m.start()] + (m[1] or "")
        past = m.end()
        if m[0] == "|":
            found.append("")
    found[-1] += s[past:]
    return [c.strip() for c in found]


def tables_to_tsv(text: str) -> tuple[str, int]:
    """The text with pipe tables as tab-separated lines, and how many there were. Fenced code stays as it is."""
    lines = text.splitlines()
    out, n, at, fenced = [], 0, 0, False
    while at < len(lines):
        if FENCE.match(lines[at]):
            fenced = not fenced
        elif not fenced and is_row(lines[at]) and at + 1 < len(lines) and SEPARATOR.match(lines[at + 1]):
            end = next((k for k in range(at + 2, len(lines)) if not is_row(lines[k])), len(lines))
            out += ["\t".join(cells(r)) for r in (lines[at], *lines[at + 2 : end])]
            if end < len(lines) and lines[end].strip():
                out.append("")
            n, at = n + 1, end
            continue
        out.append(lines[at])
        at += 1
    return "\n".join(out) + "\n" * text.endswith("\n"), n


def _scan(docs: DataFrame, change: Callable[[str], tuple], counts: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [change(t or "") for t in b.column("text").to_pylist()]
            own = [pa.array([m[k + 1] for m in made], pa.int64()) for k in range(len(counts))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([m[0] for m in made], pa.string()), *own, *map(b.column, keep)], ["doc_id", "text", *counts, *keep])

    rows = docs.select("doc_id", "text", *keep)
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(run, ", ".join([f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string", *(f"`{c}` long" for c in counts), *kinds]))


def fix_prices(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, text, n_changes), and the columns ``keep``."""
    return _scan(docs, mend_prices, ["n_changes"], keep)


def fix_prices_and_words(docs: DataFrame, rules: Sequence[tuple[str, str]], keep: Sequence[str] = ()) -> DataFrame:
    """``fix_prices``, then ordered literal replacements in the same pass: (doc_id, text, n_changes, n_replaced), and the
    columns ``keep``."""

    def change(text: str) -> tuple[str, int, int]:
        (text, changes), n = mend_prices(text), 0
        for wrong, right in rules:
            if wrong in text:
                n += text.count(wrong)
                text = text.replace(wrong, right)
        return text, changes, n

    return _scan(docs, change, ["n_changes", "n_replaced"], keep)


def inline_tables(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_tables)."""
    return _scan(docs, tables_to_tsv, ["n_tables"])


def needs_ocr(n_bytes: Column, pages: Column) -> Column:
    """Whether a scanned file holds too little text to go without OCR: under 100 bytes a page."""
    return F.ceil(n_bytes / F.greatest(pages, F.lit(1))) < 100


def notes_as_markdown(rows: DataFrame) -> DataFrame:
    """(doc_id, text): parsed notes as Markdown tables, one for each run of a section; a run without a section has no
    table head."""
    made = F.array_sort(F.collect_list(F.struct("line_no", "category", "section", "descriptor", "multiplier")))
    df = rows.groupBy("doc_id").agg(made.alias("rs"))

    def line(r: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(F.col("rs"), i - 1)["section"]).otherwise("")
        head = F.when(r["section"] != before, F.concat(F.lit("### "), r["section"], F.lit("\n\n| Descriptor | Multiplier |\n| :--- | :--- |\n"))).otherwise("")
        return F.concat(head, F.lit("| "), r["descriptor"], F.lit(" | "), r["multiplier"], F.lit(" |\n"))

    title = F.concat(F.lit("# "), F.get("rs", F.lit(0))["category"], F.lit("\n\n"))
    return df.select("doc_id", F.concat(title, F.array_join(F.transform("rs", line), "")).alias("text"))


def notes_as_tsv(rows: DataFrame) -> DataFrame:
    """(doc_id, text): parsed notes as tab-separated lines under a head."""
    line = F.concat_ws("\t", "category", "section", "descriptor", "multiplier")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("l")))), lambda x: x["l"])
    return rows.groupBy("doc_id").agg(F.concat(F.lit("Category\tSection\tDescriptor\tMultiplier\n"), F.array_join(ordered, "\n")).alias("text"))
