"""DuckDB SQL for scans, lists, reports and whole passes, from the pieces in ``foliant.plans.oracles``."""

from __future__ import annotations

from foliant.functions import vocab as V
from foliant.plans import oracles as O
from foliant.plans.fixture import DUCKDB
from foliant.plans.oracles import BOOK, NL, READ, group, has, lines, lstrip, pad, q, rstrip, starts, strip, sub, unpad, whole, words

RECURSIVE = BOOK.replace("WITH", "WITH RECURSIVE", 1)


def scans() -> dict[str, str]:
    """Scans that take a varying number of lines: each line's step is known beforehand, and a recursion visits lines."""
    s, a, b = strip("line"), strip("next"), strip("next2")
    known = f"contains(line, 'Armor, steel mail, (full chain mail), 10 weeks'' work') AND {a} = '125gp 20gp per' AND starts_with({b}, 'point restored')"
    armor = f"{has('line', r'(?i)armor.*work\s*$')} AND {has(a, r'^\d+gp.*per\s*$')} AND starts_with({b}, 'point')"
    point = f"(next IS NOT NULL AND {has(s, r'\d+gp\s*$')} AND {has(a, '^(point|per point)')})"
    item = f"(next IS NOT NULL AND {s} <> '' AND NOT starts_with({s}, '**') AND NOT {has('line', r'\d+gp')} AND {has(a, r'^\d+gp(?:\s+\d+gp)*\s*$')})"
    three = f"(next2 IS NOT NULL AND (({known}) OR ({armor})))"
    doubtful = f"{has('line', r'\d+gp\s+\d+gp')} AND NOT {has('line', '(weeks?|days?|hours?)')} AND NOT contains(line, chr(9)) AND NOT {point}"
    prices = f"""{RECURSIVE} {lines()}, st AS (SELECT doc_id, line_no, n_lines, CASE WHEN {point} OR {item} THEN 2 WHEN {three} THEN 3 ELSE 1 END AS step,
 CASE WHEN {point} OR {item} THEN {rstrip('line')} || ' ' || {a} WHEN {three} THEN line || ' ' || {a} || ' ' || {b} ELSE line END AS out,
 CASE WHEN {point} OR {item} OR {three} THEN 1 ELSE 0 END + CASE WHEN {doubtful} THEN 1 ELSE 0 END AS n FROM lines),
v AS (SELECT doc_id, CAST(1 AS BIGINT) AS pos FROM book UNION ALL SELECT v.doc_id, v.pos + st.step FROM v JOIN st ON st.doc_id = v.doc_id AND st.line_no = v.pos WHERE v.pos + st.step <= st.n_lines)
SELECT st.doc_id, string_agg(out, {NL} ORDER BY pos) AS text, CAST(sum(n) AS BIGINT) AS n_changes FROM v JOIN st ON st.doc_id = v.doc_id AND st.line_no = v.pos GROUP BY st.doc_id"""
    row = f"contains(line, '|') AND NOT {starts(s, '>', '#', '-', '*')}"
    bare = sub(sub(s, r"^\|", "", ""), r"\|$", "", "")
    cells = f"array_to_string(list_transform(string_split({bare}, '|'), lambda y: {strip('y')}), chr(9))"
    tables = f"""{RECURSIVE} {lines(READ)}, g AS (SELECT doc_id, line_no, line, next, n_lines, {has('line', r'^\s*`{3,}')} AS fence, {row} AS isrow, coalesce({has('next', O.SEPARATOR)}, false) AS ruled, {cells} AS cells FROM lines),
e AS (SELECT *, min(CASE WHEN NOT isrow THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop FROM g),
f AS (SELECT *, isrow AND ruled AS opens, coalesce(stop, n_lines + 1) AS past FROM e),
v AS (SELECT doc_id, CAST(1 AS BIGINT) AS pos, false AS fenced FROM book UNION ALL
 SELECT v.doc_id, CASE WHEN NOT f.fence AND NOT v.fenced AND f.opens THEN f.past ELSE v.pos + 1 END, CASE WHEN f.fence THEN NOT v.fenced ELSE v.fenced END FROM v JOIN f ON f.doc_id = v.doc_id AND f.line_no = v.pos),
t AS (SELECT f.doc_id, f.line_no, f.line, f.past, NOT f.fence AND NOT v.fenced AND f.opens AS opens FROM v JOIN f ON f.doc_id = v.doc_id AND f.line_no = v.pos),
o AS (SELECT doc_id, line_no, line AS out, 0 AS k FROM t WHERE NOT opens
 UNION ALL SELECT t.doc_id, f.line_no, f.cells, 0 FROM t JOIN f ON f.doc_id = t.doc_id AND f.line_no >= t.line_no AND f.line_no < t.past AND f.line_no <> t.line_no + 1 WHERE t.opens
 UNION ALL SELECT t.doc_id, t.past, '', -1 FROM t JOIN f ON f.doc_id = t.doc_id AND f.line_no = t.past WHERE t.opens AND {strip('f.line')} <> ''),
x AS (SELECT doc_id, string_agg(out, {NL} ORDER BY line_no, k) AS text FROM o GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM t WHERE opens GROUP BY doc_id)
SELECT book.doc_id, coalesce(x.text, '') || CASE WHEN ends_with(book.text, {NL}) THEN {NL} ELSE '' END AS text, coalesce(n.n, 0) AS n_tables FROM book LEFT JOIN x ON x.doc_id = book.doc_id LEFT JOIN n ON n.doc_id = book.doc_id"""
    mine, below, one = words("x"), words("now"), f"({words('now')})[1]"
    alone = strip(f"substr({one}, 2)")
    lone = f"(starts_with({one}, '>') AND {alone} = '' AND len({below}) > 1)"
    first = f"CASE WHEN {lone} THEN ({below})[2] WHEN starts_with({one}, '>') THEN {alone} ELSE {one} END"
    rest = f"array_to_string(({below})[(CASE WHEN {lone} THEN 3 ELSE 2 END):], ' ')"
    left = f"CASE WHEN {rest} = '' THEN NULL ELSE CASE WHEN starts_with({one}, '>') THEN '> ' ELSE '' END || {rest} END"
    fits = f"(hit AND len({mine}) > 0 AND len({below}) > 0)"
    made = f"array_to_string(list_append(({mine})[:-2], ({mine})[-1] || {first}), ' ')"
    mended = f"""{RECURSIVE} hit AS (SELECT doc_id, line_no FROM ({O._issues()['mid_word_breaks']})), {lines(READ)},
l AS (SELECT lines.doc_id, lines.line_no, line AS x, n_lines, hit.line_no IS NOT NULL AS hit FROM lines LEFT JOIN hit ON hit.doc_id = lines.doc_id AND hit.line_no = lines.line_no),
r AS (SELECT doc_id, line_no, x AS now, CAST(NULL AS VARCHAR) AS done FROM l WHERE line_no = n_lines
 UNION ALL SELECT l.doc_id, l.line_no, CASE WHEN {fits} THEN {made} ELSE x END, CASE WHEN {fits} THEN {left} ELSE now END FROM r JOIN l ON l.doc_id = r.doc_id AND l.line_no = r.line_no - 1)
SELECT doc_id, string_agg(out, {NL} ORDER BY pos) AS text FROM (SELECT doc_id, line_no + 1 AS pos, done AS out FROM r UNION ALL SELECT doc_id, 1, now FROM r WHERE line_no = 1) WHERE out IS NOT NULL GROUP BY doc_id"""
    return {"prices": prices, "tables_tsv": tables, "mended_words": mended}


def _matches(pattern: str, rule: str, detail: str, text: str, ahead: str, width: int) -> str:
    """Matches of a pattern in each line, from the pieces between them, with what stands around them in ``text``."""
    before = "coalesce(list_sum(list_transform(ps[1:i], lambda p: length(p))), 0) + coalesce(list_sum(list_transform(fs[1:i - 1], lambda p: length(p))), 0)"
    return f"""SELECT doc_id, line_no, pos AS "at", {q(rule)} AS rule, {detail} AS detail, '...' || substr(t, greatest(pos + h - {width}, 0) + 1, least(pos + h, {width}) + length(f) + {width}) || '...' AS context
FROM (SELECT *, fs[i] AS f, CAST({before} AS BIGINT) AS pos
 FROM (SELECT *, unnest(range(1, len(fs) + 1)) AS i FROM (SELECT *, {text} AS t, {ahead} AS h, regexp_split_to_array(line, {q(pattern)}) AS ps, regexp_extract_all(line, {q(pattern)}) AS fs FROM lines) WHERE len(fs) > 0))"""


def lists() -> dict[str, str]:
    around, ahead = f"concat_ws({NL}, prev, line, next)", "coalesce(length(prev) + 1, 0)"
    found = [_matches(a.replace(".", "[.]"), "possible fix", q(f"{a} → {b}"), "line", "0", 50) for a, b in V.ERROR_FIXES]
    found += [_matches(" {2,}", "multiple spaces", "f", around, ahead, 30), _matches(r"[^\x00-\x7F]", "non-ASCII character", "f", around, ahead, 10)]
    s = strip("line")
    after = f"CASE WHEN {s} = '>' THEN '' ELSE {sub('line', r'^(\s*)>\s?', r'\1', '')} END"
    changes = f"""{BOOK} {lines()}, c AS (SELECT doc_id, line_no, line AS before, {after} AS after, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k
 FROM lines WHERE starts_with({s}, '>')) SELECT doc_id, n, line_no, before, after FROM c WHERE k <= 20"""
    seen = strip("next")
    bare = strip(f"substr({seen}, 2)")
    clean = " OR ".join(has(f"(CASE WHEN starts_with({seen}, '>') THEN {bare} ELSE next END)", "(?i)" + p) for p in O.CLEANUP_STARTS)
    cleanup = f"""{BOOK} {lines()}, i AS (SELECT doc_id, 'issue' AS kind, line_no, line AS current, next, CAST(NULL AS VARCHAR) AS fixed FROM lines WHERE {seen} <> '' AND NOT starts_with({seen}, '#') AND ({clean})),
f AS (SELECT doc_id, 'fix' AS kind, line_no, line AS current, next, fixed FROM ({O._joins()['_cleanup_fixes']}))
SELECT * FROM (SELECT * FROM i UNION ALL SELECT * FROM f) QUALIFY row_number() OVER (PARTITION BY doc_id, kind ORDER BY line_no) <= CASE WHEN kind = 'issue' THEN 20 ELSE 10 END"""
    return {"error_list": f"{BOOK} {lines()} " + " UNION ALL ".join(found), "quote_changes": changes, "cleanup_report": cleanup, "header_report": _header_report()}


def _header_report() -> str:
    heads = O._headers()
    listed = heads["header_summary"].split(" SELECT doc_id, count(*)")[0]
    quoted = "'- Line ' || line_no || ': H' || level || chr(32) || chr(39) || title || chr(39)"
    logged = "'Line ' || line_no || ': H' || original_level || ' → H' || level || ' ' || action"
    level = "'- H' || level || ': ' || n || ' headers' || CASE WHEN level > 4 THEN ' (EXCESSIVE)' ELSE '' END"
    parts = [
        "'# Markdown Header Depth Correction Report'", "''", "'## Summary'", "'- Total headers found: ' || coalesce(hs.total, 0)", "'- Maximum depth found: H' || coalesce(hs.top, 0)",
        "'- Headers corrected: ' || coalesce(ls.b, 0)", "'- Hierarchy corrections: ' || coalesce(ls.c, 0)", "''", "'## Header Depth Distribution (Before Correction)'",
    ]
    more = f"coalesce({NL} || ds.t, '') || coalesce({NL} || {NL} || '## Excessive Headers Corrected' || {NL} || bs.t, '') || coalesce({NL} || {NL} || '## Detailed Transformation Log' || {NL} || ls.t, '')"
    return f"""{listed}, lg AS ({heads['header_corrections']}),
hs AS (SELECT doc_id, count(*) AS total, max(level) AS top FROM h GROUP BY doc_id),
ds AS (SELECT doc_id, string_agg({level}, {NL} ORDER BY level) AS t FROM (SELECT doc_id, level, count(*) AS n FROM h GROUP BY doc_id, level) GROUP BY doc_id),
bs AS (SELECT doc_id, string_agg({quoted}, {NL} ORDER BY line_no) AS t FROM h WHERE level > 4 GROUP BY doc_id),
ls AS (SELECT doc_id, count(*) FILTER (WHERE action = 'converted_to_bold') AS b, count(*) FILTER (WHERE action = 'hierarchy_corrected') AS c, string_agg({logged}, {NL} ORDER BY line_no, action) AS t FROM lg GROUP BY doc_id)
SELECT book.doc_id, {f' || {NL} || '.join(f'({p})' for p in parts)} || {more} AS report
FROM book LEFT JOIN hs ON hs.doc_id = book.doc_id LEFT JOIN ds ON ds.doc_id = book.doc_id LEFT JOIN bs ON bs.doc_id = book.doc_id LEFT JOIN ls ON ls.doc_id = book.doc_id"""


def breaks() -> dict[str, str]:
    """Lookarounds as captured neighbours. A removed break is chr(1) until its pattern is done, so that the words beside it
    keep their ends; a second pass finds matches that share a character with one of the first."""
    w = r"([\p{L}\p{N}_])"
    text = pad("text")
    for pattern in (w + r"-\s*\n\s*" + w, w + r"\s*\n\s*([a-z]{1,3}\b)", w + r" ([a-z]{1,3}\b)"):
        for _ in range(2):
            text = sub(text, pattern, r"\1" + "\x01" + r"\2")
        text = f"replace({text}, chr(1), '')"
    s = strip("line")
    case = f"{has(s, r'\p{Lu}')} AND NOT {has(s, r'(^|\P{L})\p{Ll}')} AND NOT {has(s, r'\p{L}\p{Lu}')}"
    neither = f"(({has(s, r'\p{Lu}')} AND {has(s, r'\p{Ll}')}) OR NOT {has(s, r'[\p{Lu}\p{Ll}]')})"
    title = f"({s} <> '' AND length({s}) <= 80 AND {neither} AND NOT {has(s, r'^\d+$')} AND ({has(s, O.TITLES)} OR ({case} AND NOT ends_with({s}, '.'))))"
    mark = f"CASE WHEN lower({s}) = 'table of contents' THEN 1 WHEN {s} = '' THEN 0 END"
    promoted = f"""{BOOK} {lines(READ)}, m AS (SELECT *, {mark} AS mark FROM lines),
r AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 0) AS toc FROM m)
SELECT doc_id, string_agg(CASE WHEN toc = 0 AND {title} AND NOT starts_with({s}, '#') THEN '## ' || {s} ELSE line END, {NL} ORDER BY line_no) AS text FROM r GROUP BY doc_id"""
    return {"word_breaks": whole(unpad(text)), "promoted_headers": promoted}


def _over(text: str, then: str) -> str:
    """``then`` over the texts that ``text`` yields."""
    for head in (BOOK.rstrip(", "), RECURSIVE.rstrip(", ")):
        if then.startswith(head):
            return f"{head[: head.index('book')]}book AS ({text})" + then[len(head) :]
    raise ValueError("this SQL doesn't begin with the book")


def passes(found: dict[str, str]) -> dict[str, str]:
    """Whole passes, from the SQL of their steps."""
    steps = {"1_toc": ("n_changes", f"SELECT sum(n_changes) AS n FROM ({found['toc_plain']})")}
    text = f"SELECT doc_id, text FROM ({found['toc_plain']})"
    of = lambda text, name, column: f"SELECT {column} AS n FROM ({_over(text, found[name])})"
    steps["2_images"] = ("n_images", of(text, "image_counts", "sum(n_images)"))
    text = _over(text, found["images"])
    steps["3_quotes"] = ("n_removed", of(text, "quote_stats", "n_removed"))
    text = _over(text, found["quotes"])
    steps["4_page_numbers"] = ("n_removed", of(text, "page_numbers", "sum(n_removed)"))
    text = f"SELECT doc_id, text FROM ({_over(text, found['page_numbers'])})"
    for name in ("sentences", "hyphens", "blanks"):
        # the SQL of several paragraph steps is nested; its innermost text is the book
        steps[f"5_{name}"] = ("joins", found[f"_n_{name}"].replace(DUCKDB, text, 1))
    text = found["paragraphs"].replace(DUCKDB, text, 1)
    steps["6_headers"] = ("corrections", of(text, "header_corrections", "count(*)"))
    text = _over(text, found["header_depth"])
    steps["8_cleanup"] = ("joins", _over(text, found["_n_cleanup"]))
    layout = _over(text, found["cleanup_joins"])
    steps["9_prices"] = ("n_changes", of(layout, "prices", "sum(n_changes)"))
    text = f"SELECT doc_id, text FROM ({_over(layout, found['prices'])})"
    steps["10a_ocr_base"] = ("n", of(text, "ocr_base_counts", "sum(n)"))
    text = _over(text, found["ocr_base"])
    steps["10b_ocr_additional"] = ("n", of(text, "ocr_additional_counts", "sum(n)"))
    second = found["word_breaks"]
    for name in ("stops", "dashes", "spaces", "typos", "heading_fixes"):
        second = _over(second, found[name])
    metric = lambda step, name, x: f"SELECT '{step}' AS step, {name} AS metric, CAST(coalesce(n, 0) AS BIGINT) AS n FROM ({x})"
    quality = (
        metric("spell_check", "'candidates'", O._words("book", BOOK)["_suspects"]), metric("long_lines", "severity", found["_text_severity"]),
        metric("paragraph_breaks", "rule", f"SELECT rule, sum(n) AS n FROM ({found['paragraph_issues']}) GROUP BY rule"),
        metric("validation", "rule", f"SELECT rule, count(*) AS n FROM ({found['table_integrity']}) GROUP BY rule"),
        metric("validation", "'blank runs'", f"SELECT count(*) AS n FROM ({found['blank_runs']})"),
    )
    size = lambda text, name: f"(SELECT CAST(sum(length(text)) AS BIGINT) AS {name} FROM ({text}))"

    def report(counts: str, after: str, n: int) -> str:
        sums = f"(SELECT count(*) AS n_matched, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_corrections FROM ({found[counts]}))"
        return f"SELECT CAST({n} AS BIGINT) AS n_checked, n_matched, n_corrections, size_before, size_after FROM {sums}, {size(DUCKDB, 'size_before')}, {size(after, 'size_after')}"

    return {
        "clean_layout": layout, "clean_book": _over(text, found["ocr_additional"]), "ocr_second_pass": second, "second_pass_toc": _over(second, found["toc_check"]),
        "book_steps": " UNION ALL ".join(metric(k, f"'{m}'", x) for k, (m, x) in steps.items()), "book_quality": " UNION ALL ".join(quality),
        "book_status": " UNION ALL ".join(f"SELECT '{k}' AS step, '- {k}: OK' AS line" for k in steps),
        "ocr_additional_report": report("ocr_additional_counts", found["ocr_additional"], len(O.additional_rules())),
        "ocr_final_report": report("ocr_final_counts", found["_ocr_final_rules"], len(V.OCR_FINAL)),
    }


def oracle_sql() -> dict[str, str]:
    found = O.oracle_sql() | scans() | lists() | breaks()
    return {k: v for k, v in (found | passes(found)).items() if not k.startswith("_")}
