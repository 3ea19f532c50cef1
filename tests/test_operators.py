"""Operators on worked examples, and against sequential models in Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.operators import breaks, detect, headers, rewrite, tables, toc
from foliant.operators.lines import join_pairs, split_lines, to_docs, to_lines
from foliant.plans import book
from foliant.plans.fixture import damaged_book


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def texts(df):
    return [r["text"] for r in df.orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def damaged(spark):
    """Texts of the damaged book, as (frame, list of (doc_id, text))."""
    df = damaged_book(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).select("doc_id", "text").cache()
    return df, [(r["doc_id"], r["text"]) for r in df.collect()]


def check(df, rows, model, column="text"):
    got = {r["doc_id"]: r[column] for r in df.collect()}
    for doc_id, text in rows:
        assert got[doc_id] == model(text)


def test_line_splitters(spark):
    t = ["", "a", "a\n", "a\r\nb\x0bc d\n\n", "\n"]
    df = docs(spark, *t)
    for mode, model in (("split", lambda x: x.split("\n")), ("splitlines", str.splitlines), ("readlines", lambda x: re.split("\r\n|\r|\n", x)[: None if re.split("\r\n|\r|\n", x)[-1] else -1])):
        assert [r["ls"] for r in df.select("doc_id", split_lines(F.col("text"), mode).alias("ls")).orderBy("doc_id").collect()] == [model(x) for x in t]


@pytest.mark.parametrize("over", ["all", "nonblank"])
def test_join_pairs_is_the_scan(spark, over):
    r = random.Random(1)
    t = ["\n".join(r.choice(["p", "p", "x", ""]) + str(k) * r.randint(0, 1) if r.random() < 0.8 else "" for k in range(r.randint(1, 30))) for _ in range(60)]
    got = texts(to_docs(join_pairs(to_lines(docs(spark, *t)), F.col("line").startswith("p"), F.concat("line", F.lit("+"), "next"), over, over == "nonblank")))

    def scan(text):
        lines, out, at = text.split("\n"), [], 0
        while at < len(lines):
            then = at + 1
            while over == "nonblank" and then < len(lines) and not lines[then]:
                then += 1
            if lines[at].startswith("p") and then < len(lines):
                out.append(f"{lines[at]}+{lines[then]}")
                at = then + 1
                while over == "nonblank" and at < len(lines) and not lines[at]:
                    at += 1
            else:
                out.append(lines[at])
                at += 1
        return "\n".join(out)

    assert got == [scan(x) for x in t]


def test_header_example(spark):
    levels = [1, 2, 3, 4, 5, 6, 7, 2, 4, 5, 3, 4]
    df = docs(spark, "\n\n".join(f"{'#' * n} T{k}" for k, n in enumerate(levels)))
    out = texts(headers.correct_depth(df))[0].split("\n\n")
    assert [x.split(" ")[0] if x[0] == "#" else "bold" for x in out] == ["#", "##", "###", "####", "bold", "bold", "bold", "##", "###", "####", "###", "####"]
    log = headers.corrections(df)
    assert {r["action"]: r["count"] for r in log.groupBy("action").count().collect()} == {"hierarchy_corrected": 2, "converted_to_bold": 3}
    assert headers.depth_summary(df).select("total", "excessive", "deepest").first() == (12, 4, 7)
    once = headers.correct_depth(df)
    assert texts(headers.correct_depth(once)) == texts(once)


def test_page_numbers(spark):
    df = docs(spark, "a\n\n12\n\nb", "a\n12\n\nb", "— 7 —", "x\n\n12345\n", "1\n\n2")
    out = detect.remove_page_numbers(df)
    assert texts(out) == ["a\n\n\nb", "a\n12\n\nb", "", "x\n\n12345", ""]
    assert texts(detect.remove_page_numbers(out.drop("n_removed"))) == texts(out)


def test_joins_by_example(spark):
    df = to_lines(docs(spark, "heavy-\nhanded", "end of the\n\nroad here now\n\nnext", "He was quite sure it decided\n\nwas better", "swords, bows\n, and spears", "> a\n> , or b"))
    assert texts(to_docs(breaks.join_hyphens(df)))[0] == "heavy-handed"
    assert texts(to_docs(breaks.join_broken_sentences(df)))[:2] == ["heavy- handed", "end of the road here now\nnext"]
    assert texts(to_docs(breaks.join_across_blanks(df)))[2] == "He was quite sure it decided was better"
    assert texts(to_docs(breaks.join_cleanup(df)))[3:] == ["swords, bows , and spears", "> a , or b"]


def test_notes(spark):
    df = docs(spark, "Repair_Costs:\nMaterials\nMultiplier\nIron\nx2\nSteel\n1.5 to 3\nOrphan line\n")
    rows = breaks.parse_notes(df)
    assert [tuple(r)[2:] for r in rows.orderBy("line_no").collect()] == [("RepairCosts", "Materials", "Iron", "x2"), ("RepairCosts", "Materials", "Steel", "1.5 to 3")]
    assert texts(tables.notes_as_markdown(rows))[0] == "# RepairCosts\n\n### Materials\n\n| Descriptor | Multiplier |\n| :--- | :--- |\n| Iron | x2 |\n| Steel | 1.5 to 3 |\n"


def test_toc_is_a_fixed_point(spark):
    df = docs(spark, "x\nTable Of Contents\n1.Town   12\n7\n\nGate 3\nForeword\nText", "no contents\n")
    once = toc.plain_toc(df)
    assert texts(once)[0].split("\n")[2] == "1. Town " + "." * 50 + " 12" and texts(once)[1] == "no contents\n"
    assert [r["n_changes"] for r in once.orderBy("doc_id").collect()] == [2, 0]
    assert texts(toc.plain_toc(once.drop("n_changes")))[0].count("Town") == 1


def test_prices_by_example(spark):
    t = "Armor repair 125gp\nper point restored\nShield, small\n10gp 20gp\nChain armor, 3 weeks work\n125gp 20gp per\npoint restored\nA 1gp 2gp"
    row = tables.fix_prices(docs(spark, t, None)).orderBy("doc_id").collect()
    assert row[0]["text"].split("\n") == ["Armor repair 125gp per point restored", "Shield, small 10gp 20gp", "Chain armor, 3 weeks work 125gp 20gp per point restored", "A 1gp 2gp"]
    assert row[0]["n_changes"] == 4 and row[1]["text"] == ""


def test_tables_by_example():
    t = "| a \\| b | c |\n|---|:---:|\n| 1 | 2\nnext\n```\n| x | y |\n|---|---|\n```\n| one |\n|---|\n"
    assert tables.tables_to_tsv(t) == ("a | b\tc\n1\t2\n\nnext\n```\n| x | y |\n|---|---|\n```\n| one |\n|---|\n", 1)


def test_word_breaks(damaged):
    df, rows = damaged

    def model(t):
        t = re.sub(r"(?<=\w)-\s*\n\s*(?=\w)", "", t)
        t = re.sub(r"(?<=\w)\s*\n\s*(?=[a-z]{1,3}\b)", "", t)
        return re.sub(r"(?<=\w) (?=[a-z]{1,3}\b)", "", t)

    check(rewrite.fix_word_breaks(df), rows, model)


def test_stops(damaged):
    df, rows = damaged
    check(rewrite.space_after_stops(df), rows, lambda t: re.sub(r"""(?<!\b[A-Z])([.!?])(?!\s|["')\]])(?=[A-Za-z])""", r"\1 ", t))


def test_promoted_headers(spark):
    t = "Table of Contents\nThe Gate\n\nThe Gate\nThe gate\nTHE GATE\nPart IV\n# The Gate\nIt's A Trap\nThe Gate.\n12\nÉtat Major"
    want = "Table of Contents\nThe Gate\n\n## The Gate\nThe gate\nTHE GATE\n## Part IV\n# The Gate\nIt's A Trap\nThe Gate.\n12\n## État Major"
    assert texts(headers.promote_headers(docs(spark, t))) == [want]


def test_title_case_is_pythons(spark):
    r = random.Random(2)
    lines = ["".join(r.choice("aBé Éß1-'. ") for _ in range(r.randint(1, 9))) for _ in range(3000)]
    lines = [x for x in lines if x.strip() and not x.strip().isdigit()]
    got = spark.createDataFrame([(x,) for x in lines], "x string").select("x", headers.is_section_title(F.col("x")).alias("y")).collect()
    for row in got:
        s = row["x"].strip()
        assert row["y"] == (not (s.isupper() or s.islower()) and s.istitle() and not s.endswith(".")), s


def test_heading_tags(spark):
    t = "# Table of contents\n## In it\n# Introduction\n## Then\n### Deep\n#### Deeper\ntext\n<1> ## Done"
    assert texts(headers.tag_headings(docs(spark, t))) == ["<ch> # Table of contents\n## In it\n<ch> # Introduction\n<1> ## Then\n<2> ### Deep\n<2> #### Deeper\ntext\n<1> ## Done"]


def test_line_breaks_against_a_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    clause = re.compile(r"[,;]\s+(?:and|but|or|however|therefore|thus|hence|moreover|furthermore|nevertheless|nonetheless)\s+")

    def model(x):
        found = [(m.start() + 1, "sentence ending") for m in re.finditer(r"[.!?]\s+[A-Z]", x)]
        found += [(m.start(), "clause break") for m in clause.finditer(x)] + [(m.start(), "em-dash break") for m in re.finditer(r"---?\s+", x)]
        out, last = [], 0
        for p, why in sorted((f for f in found if f[0] > 40), key=lambda f: f[0]):
            if p - last > 150:
                out.append((p, why))
                last = p
        if not out:
            run, past = 0, 0
            for w in x.split():
                if run > 150:
                    out.append((past, "word boundary"))
                    run = 0
                run, past = run + len(w) + 1, past + len(w) + 1
        return out

    rows = detect.line_breaks(df).collect()
    assert len(rows) > 500
    for r in rows:
        assert list(zip(r["breaks"], r["reasons"])) == model(r["line"])


def test_break_application(spark):
    df = spark.createDataFrame([("> " + "a" * 5 + " bbb", [7]), ("abc def", [3]), ("abc", [])], "line string, breaks array<int>")
    assert [r["new_line"] for r in detect.apply_breaks(df).collect()] == ["> aaaaa\n\n> bbb", "abc\n\ndef", "abc"]


def test_book_is_its_steps(damaged):
    df, rows = damaged
    cleaned = {r["doc_id"]: r["text"] for r in book.clean_book(df, book.BookConfig(inline_tables=True)).collect()}
    assert set(cleaned) == {i for i, _ in rows}
    assert not any("†![" in t or "<img" in t or "\n> " in t for t in cleaned.values())


def test_ocr_gate(spark):
    rows = spark.createDataFrame([(99, 1), (100, 1), (101, 0), (250, 3)], "b long, p long")
    assert [r[0] for r in rows.select(tables.needs_ocr(F.col("b"), F.col("p"))).collect()] == [True, False, False, True]


KINDS = [
    "## Table Of Contents", "Table of Contents", "# Table of contents", "# Part I: X", "The Table of Contents will likely", "Gate .................... 12 Moat ................... 34",
    "Tower .................... 7", "Plain words 12", "", "# The Introduction", "### Deep", "######## deeper", "Population", "| a | b |", "| x |", "word " * 10,
]


def region_model(text, opens, closes, change):
    """``change`` of each line and of whether it is in a region, which its opening line belongs to."""
    out, inside = [], False
    for x in text.split("\n"):
        inside = True if opens(x) else False if closes(x) else inside
        out.append(change(x, inside))
    return "\n".join(x for x in out if x is not None)


def test_regions_and_levels_of_a_long_document(spark):
    """20,000 lines: work that grows with the square of a document's lines would not end in time."""
    r = random.Random(3)
    text = "\n".join(r.choice(KINDS) for _ in range(20_000)) + "\nend"
    df = docs(spark, text, "no marker\n" + text[:5000] + "end", "", None).cache()
    dots = lambda t, p, w, lo, hi: f"{t} {'.' * min(hi, max(lo, w - len(t) - len(p) - 2))} {p}"
    one = re.compile(r"^(.+?)\s+\.{3,}\s+(\d+)\s*$")

    def dotted(x, inside):
        m = one.match(x) if inside and x != KINDS[0] else None
        return dots(m[1].strip(), m[2], 80, 3, 60) if m else x

    def tagged(x, inside):
        if not x.startswith("#") or (inside and x != KINDS[2]):
            return x
        return ("<2> " if x.startswith("###") else "<1> " if x.startswith("##") else "<ch> ") + x

    def levels(text):
        out, last = [], 0
        for x in text.split("\n"):
            m = re.match(r"(#{1,10})\s+(.+)$", x)
            if m:
                n = len(m[1])
                last = last + 1 if last and n > last + 1 and last < 4 else n
                x = f"**{m[2].strip()}**" if last > 4 else f"{'#' * last} {m[2].strip()}"
            out.append(x)
        return "\n".join(out)

    models = (
        (toc.dotted_toc, lambda t: region_model(t, lambda x: x == KINDS[0], lambda x: x.startswith("# Part I:"), dotted)),
        (headers.tag_headings, lambda t: region_model(t, lambda x: x == KINDS[2], lambda x: x == "# The Introduction", tagged)),
        (headers.promote_headers, lambda t: region_model(t, lambda x: x == KINDS[1], lambda x: x == "", lambda x, inside: f"## {x}" if x.startswith(("Population", "Tower", "Gate")) and not inside else x)),
        (headers.correct_depth, levels),
    )
    for op, model in models:
        got = texts(op(df))
        assert got[0] == model(text) and got[1] == model("no marker\n" + text[:5000] + "end") and got[2:] == ["", ""]
    assert toc.crowded_toc(df).count() == 4
    got = detect.table_integrity(df).where("doc_id = 0").count()
    rows, bad = text.split("\n"), 0
    head = None
    for k, x in enumerate(rows):
        if not x.startswith("|"):
            head = None
        elif head is None:
            head = x.count("|")
        else:
            bad += x.count("|") != head
    assert got == bad


def test_mend_mid_words(spark):
    """From the last line to the first: a word in three parts, a quote's marker, a line that loses its only word."""
    t = ["He is socially con\nscious of\nit", "A lone exam\nple\nIt stays", "> some parag\n> raph follows", "con\n\nscious", "# heading abc\ndefgh", "long exam\npleswor\nldwide end", "", "one line"]
    assert texts(detect.mend_mid_words(docs(spark, *t))) == [
        "He is socially conscious\nof\nit", "A lone example\nIt stays", "> some paragraph\n> follows", "con\n\nscious", "# heading abc\ndefgh", "long examplesworldwide\nend", "", "one line",
    ]


def test_error_list(spark):
    got = detect.error_list(docs(spark, "a saltier is  here\nnext “x” line"))
    assert sorted((r["line_no"], r["at"], r["rule"], r["detail"]) for r in got.collect()) == [
        (1, 2, "possible fix", "saltier → saltire"), (1, 12, "multiple spaces", "  "), (1, 12, "possible fix", "   →  "),
        (2, 5, "non-ASCII character", "“"), (2, 5, "possible fix", '“ → "'), (2, 7, "non-ASCII character", "”"), (2, 7, "possible fix", '” → "'),
    ]
    assert {r["context"] for r in got.where("rule = 'multiple spaces'").collect()} == {"...a saltier is  here\nnext “x” line..."}


def test_rule_groups_change_nothing_else(spark, monkeypatch):
    """Rules tried in groups give what the chain of single rules gives, also where one rule makes another match."""
    rules = [("aa", "b"), ("bb", "c"), (r"\s+c", " d"), ("x(y)", r"\1"), ("dd", "aa")]
    t = ["aaaa", "AA bb", "xy xy", "d d", "q", "", None]
    single = docs(spark, *t)
    for rule in rules:
        single = rewrite.pattern_rules(single, [rule])
    for size in (1, 2, 8):
        monkeypatch.setattr(rewrite, "RULE_GROUP", size)
        assert texts(rewrite.pattern_rules(docs(spark, *t), rules)) == texts(single)


def test_status_lines(spark):
    from foliant.plans import reports

    df = spark.createDataFrame([("1_toc", "n", 3, None), ("2_images", "n", 0, "no such file"), ("1_toc", "m", 1, None)], "step string, metric string, n long, error string")
    assert {r["line"] for r in reports.status_lines(df).collect()} == {"- 1_toc: OK", "- 2_images: ERROR (error: no such file)"}
    assert {r["line"] for r in reports.status_lines(df.drop("error")).collect()} == {"- 1_toc: OK", "- 2_images: OK"}
