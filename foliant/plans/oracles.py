"""DuckDB SQL for the queries of ``foliant.plans.queries``.

DuckDB's patterns know word characters of ASCII only. Where a pattern uses word boundaries, accented letters are set in
underscores first, which are word characters, and taken out again at the end.
"""

from __future__ import annotations

import re

from foliant.functions import vocab as V
from foliant.plans.fixture import DUCKDB

ACCENTED = "[À-ÖØ-öø-ɏ]"

#: Patterns and marks of single lines, spelt out here once more (fixed values), so that a slip in an operator shows. Word
#: lists and rules are shared.
HEADER = r"^(#{1,10})\s+(.+)$"
FOOTERS = (r"^#{1,6}\s+Castles Zagyg:\s*Yggsburgh\s*$", r"^#{1,6}\s+Setting,\s*History\s*and\s*Culture\s*$", r"^#{1,6}\s+Part\s+[IVX]+\s*$")
LEVELS = (
    (r"^#{1,6}\s+Part\s+[IVX]+:?\s*.+$", 1), (r"^#{1,6}\s+Chapter\s+\d+:?\s*.+$", 1), (r"^#{1,6}\s+Appendix\s+[A-Z]:?\s*.+$", 1),
    (r"^#{1,6}\s+(Introduction|Background|Overview|History|Culture|Geography|Conclusion)(\s+.*)?$", 2),
    (r"^#{1,6}\s+(Foreword|Preface|Notes?\s+for\s+.+|Table\s+of\s+Contents)$", 2),
    (r"^#{1,6}\s+(Population|Social\s+Classes|Dress[,\s]+Style.+|Common\s+Names|Coin\s+of\s+.+|Town\s+Revenues)$", 3),
    (r"^#{1,6}\s+(The\s+Culture\s+of|Local\s+.+\s+Nobles|Elites\s+and\s+Administration)$", 2),
    (r"^#{1,6}\s+([A-Z][a-z]+\s+(Hills|Forest|River|Lake|Valley|Mountains?|Woods?))$", 3),
    (r"^#{1,6}\s+(Males?|Females?|Human\s+.+\s+Names|Demi-human\s+Names)$", 4),
)
TITLES = (
    r"^(Part [IVX]+|Appendix [A-Z]|Introduction|Foreword|Background|History|Setting, History and Culture|The Culture of Yggsburgh|Local Palatine Nobles|Coin of the Realm|"
    r"Town Revenues|The Outs|Population|Social Classes|Dress, Style, Appearance and Manners|Common Names in Yggsburgh|Table Of Contents)$"
)
MARKERS, NOTE = ("## Table Of Contents", "# Table Of Contents", "Table Of Contents"), "The Table of Contents will likely"
CONTENT_STARTS, FIRST_PART, BOOK_TITLE = ("Castles Zagyg:", "Foreword", "Part I", "Introduction"), "# Part I:", "Castles Zagyg: Yggsburgh"
OPEN_ENDINGS = ("Thieves'", "(", ",", " the", " a", " an", " and", " or", " of", " in", " to", " for", " with", " from", " by", " as")
KNOWN_STARTS = ("Guild,", "Area ", "Street", "Avenue")
CLEANUP_STARTS = (r"^\s*[,;.]\s+", r"^\s*(, or|, and|, but|, yet|, so|, nor)\s+", r"^\s*or\s+[a-z]", r"^\s*(or frame|and other|but also|yet still)\s+")
VALUE, MULTIPLIER = r"^[+\d.]+(\s*to\s*[+\d.]+)?%?$", r"^x\d+"
MARKUP = (
    (r"\*\*([^*]+)\*\*", r"\1"), (r"\*([^*]+)\*", r"\1"), (r"`[^`]+`", ""), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"#{1,6}\s+", ""),
    (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""),
)
WORD = r"\b[a-zA-Z][a-zA-Z'-]*[a-zA-Z]\b|\b[a-zA-Z]\b"
NAME_LIST = r"^(\*\*(?:Standard|Other|Common|First common|Second common)\*\*\s*(?:\([^)]+\))?\s*:\s*)(.+)$"
SEPARATOR = r"^\s*\|?\s*(:?-{3,}:?)\s*(\|\s*(:?-{3,}:?)\s*)+\|?\s*$"


def additional_rules() -> list[tuple[str, str]]:
    return [*V.OCR_ADDITIONAL, *((r"\b" + re.escape(a) + r"\b", b) for a, b in V.OCR_OVERRIDES)]


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, '{flags}')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def group(x: str, pattern: str, k: int) -> str:
    return f"regexp_extract({x}, {q(pattern)}, {k})"


def pad(x: str) -> str:
    return sub(x, f"({ACCENTED})", r"_\1_")


def unpad(x: str) -> str:
    return sub(x, f"_({ACCENTED})_", r"\1")


def strip(x: str) -> str:
    return sub(x, r"^\s+|\s+$", "")


def rstrip(x: str) -> str:
    return sub(x, r"\s+$", "")


def lstrip(x: str) -> str:
    return sub(x, r"^\s+", "")


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def n_words(x: str) -> str:
    return f"len({words(x)})"


def starts(x: str, *prefixes: str) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {q(p)})" for p in prefixes) + ")"


def ends(x: str, *suffixes: str) -> str:
    return "(" + " OR ".join(f"ends_with({x}, {q(p)})" for p in suffixes) + ")"


def among(x: str, values: list[str]) -> str:
    return f"{x} IN ({', '.join(map(q, values))})"


def alternatives(values: list[str]) -> str:
    return "(?:" + "|".join(values) + ")"


NL = "chr(10)"
BOOK = f"WITH book AS ({DUCKDB}), "
SPLIT = f"string_split(text, {NL})"
READ = f"string_split({sub('text', r'\n\z', '', '')}, {NL})"


def lines(split: str = SPLIT, source: str = "book") -> str:
    """The CTE ``lines``: doc_id, line_no, line, and neighbours prev, next, next2, n_lines."""
    return f"""ls0 AS (SELECT doc_id, {split} AS ls FROM {source}),
lines AS (SELECT doc_id, i AS line_no, ls[i] AS line, CASE WHEN i > 1 THEN ls[i - 1] END AS prev, CASE WHEN i < len(ls) THEN ls[i + 1] END AS next,
 CASE WHEN i + 1 < len(ls) THEN ls[i + 2] END AS next2, len(ls) AS n_lines
 FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM ls0))"""


def per_line(change: str, split: str = SPLIT) -> str:
    """Whole texts with ``change`` (of x) applied to each line; nulls drop."""
    made = f"list_filter(list_transform({split}, lambda x: {change}), lambda x: x IS NOT NULL)"
    return BOOK.rstrip(", ") + f" SELECT doc_id, array_to_string({made}, {NL}) AS text FROM book"


def whole(change: str) -> str:
    return BOOK.rstrip(", ") + f" SELECT doc_id, {change} AS text FROM book"


def pairs(pred: str, joined: str, nonblank: bool = False, drop_after_tail: bool = False, split: str = SPLIT, start: str = BOOK, heads: str = "") -> str:
    """The closed form of a left-to-right pair join, rebuilt to texts. ``pred`` and ``joined``: of line, next and gap;
    ``start``: the CTE of the texts; ``heads``: SQL over ``a`` in place of the texts."""
    blank = f"{strip('line')} = ''"
    w = "(PARTITION BY doc_id ORDER BY line_no)"
    if nonblank:
        cand = f"SELECT *, lead(line) OVER {w} AS nx, lead(line_no) OVER {w} - line_no - 1 AS gap, row_number() OVER {w} AS k FROM l WHERE NOT {blank}"
    else:
        cand = f"SELECT *, lead(line) OVER {w} AS nx, 0 AS gap, row_number() OVER {w} AS k FROM l"
    gone_blank = "last_head" + (" OR last_tail" if drop_after_tail else "")
    return f"""{start} {lines(split)}, l AS (SELECT doc_id, line_no, line FROM lines),
c AS (SELECT doc_id, line_no, line, nx AS next, gap, k FROM ({cand})),
p AS (SELECT *, coalesce(next IS NOT NULL AND ({pred}), false) AS pred FROM c),
i AS (SELECT *, sum(CASE WHEN pred THEN 0 ELSE 1 END) OVER {w} AS isl FROM p),
h AS (SELECT *, pred AND (row_number() OVER (PARTITION BY doc_id, isl, pred ORDER BY line_no) - 1) % 2 = 0 AS head FROM i),
t AS (SELECT *, coalesce(lag(head) OVER {w}, false) AS tail FROM h),
a AS (SELECT l.doc_id, l.line_no, l.line, t.next, coalesce(t.head, false) AS head, t.tail,
 t.line_no IS NULL AS is_blank, coalesce(last_value(t.head IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.line_no ROWS UNBOUNDED PRECEDING), false) AS last_head,
 coalesce(last_value(t.tail IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.line_no ROWS UNBOUNDED PRECEDING), false) AS last_tail
 FROM l LEFT JOIN t ON t.doc_id = l.doc_id AND t.line_no = l.line_no)
{heads or f"""SELECT doc_id, string_agg(CASE WHEN head THEN {joined} ELSE line END, {NL} ORDER BY line_no) AS text
FROM a WHERE NOT (CASE WHEN is_blank THEN {gone_blank} ELSE tail END) GROUP BY doc_id"""}"""


def structural(x: str) -> str:
    return f"({starts(x, '#', '**', '|')} OR {starts(strip(x), '-', '*')})"


SPACED = f"{rstrip('line')} || ' ' || {lstrip('next')}"
PIPES = "length({0}) - length(replace({0}, '|', ''))"


def _joins() -> dict[str, str]:
    ending = lambda x, ws: has(pad(x), rf"(?i)\b{alternatives(ws)}\s*$")
    begin = lambda x, ws: has(pad(x), rf"(?i)^\s*{alternatives(ws)}\b")
    short = f"({n_words('line')} <= 2 AND NOT ends_with({strip('line')}, ':') AND {n_words('next')} > 2)"
    sentence = f"NOT {structural('line')} AND NOT {structural('next')} AND ({ending('line', V.UNFINISHED_ENDINGS)} OR {has('line', r'-\s*$')} OR {begin('next', V.CONTINUING_STARTS_1)} OR {begin('next', V.CONTINUING_STARTS_2)} OR {short})"
    hyphen = f"{has('line', r'-\s*$')} AND {strip('next')} <> '' AND NOT {starts('next', '#', '**', '|')}"
    across = f"NOT {structural('line')} AND NOT {structural('next')} AND NOT {has('line', r'[.!?:;]\s*$')} AND NOT ends_with({strip('line')}, ',') AND {n_words('line')} > 3 AND gap > 0 AND ({has('next', r'^\s*[a-z]')} OR {begin('next', V.RESUMING_STARTS)} OR {ending('line', V.MID_THOUGHT_ENDINGS)})"
    marks = ("#", "**", "*", "-", "|", ">", "```")
    now, then = rstrip("line"), strip("next")
    small = f"({has(then, r'^\p{Ll}')} AND NOT {starts(then, 'see ', 'area ')})"
    para = f"NOT {starts(now, *marks)} AND {now} <> '' AND {then} <> '' AND NOT {starts(rstrip('next'), *marks)} AND ({ends(now, *OPEN_ENDINGS)} OR {starts(then, *KNOWN_STARTS)} OR (NOT {ends(now, '.', '!', '?', ':', ';', ')')} AND {small} AND {n_words(now)} > 3))"
    bare = lambda x: strip(f"substr({strip(x)}, 2)")
    seen = lambda x: f"(CASE WHEN starts_with({strip(x)}, '>') THEN {bare(x)} ELSE {x} END)"
    clean = lambda x: f"({strip(x)} <> '' AND NOT starts_with({strip(x)}, '#') AND ({' OR '.join(has(seen(x), '(?i)' + p) for p in CLEANUP_STARTS)}))"
    taken = f"CASE WHEN starts_with({strip('next')}, '>') THEN {bare('next')} ELSE {strip('next')} END"
    count = "SELECT count(*) AS n FROM a WHERE head"
    glued = f"{rstrip('line')} || {lstrip('next')}"
    first = pairs(sentence, SPACED, True, True)
    second = pairs(hyphen, glued, start=f"WITH book AS ({first}), ")
    third = f"WITH book AS ({second}), "
    steps = pairs(across, SPACED, True, start=third)
    counts = {
        "n_sentences": pairs(sentence, SPACED, True, True, heads=count), "n_hyphens": pairs(hyphen, glued, start=f"WITH book AS ({first}), ", heads=count),
        "n_blanks": pairs(across, SPACED, True, start=third, heads=count), "n_cleanup": pairs(clean("next"), "NULL", heads=count),
        "cleanup_fixes": pairs(clean("next"), "NULL", heads=f"SELECT doc_id, line_no, line, next, {rstrip('line')} || ' ' || ({taken}) AS fixed FROM a WHERE head"),
    }
    return {
        "paragraphs": steps,
        "sentence_joins": pairs(sentence, SPACED, True, True),
        "hyphen_joins": pairs(hyphen, f"{rstrip('line')} || {lstrip('next')}"),
        "blank_line_joins": pairs(across, SPACED, True),
        "paragraph_joins": pairs(para, f"{now} || ' ' || {then}"),
        "cleanup_joins": pairs(clean("next"), f"{rstrip('line')} || ' ' || ({taken})"),
        **{f"_{k}": v for k, v in counts.items()},
        "cleanup_candidates": BOOK.rstrip(", ") + f" SELECT doc_id, len(list_filter({SPLIT}[2:], lambda x: {clean('x')})) AS n FROM book",
    }


def _issues() -> dict[str, str]:
    s, n, n2 = strip("line"), strip("next"), strip("next2")
    base = f"{BOOK} {lines(READ)}, s AS (SELECT doc_id, line_no, n_lines, {s} AS line, {n} AS next, {n2} AS next2 FROM lines), plain AS (SELECT * FROM s WHERE line <> '' AND NOT {starts('line', '#', '```')})"
    body = f"(CASE WHEN starts_with(line, '>') THEN {strip('substr(line, 2)')} ELSE line END)"
    last = f"{words(sub(f'lower({body})', r'[^\p{L}\p{N}_\s]', ''))}[-1]"
    kinds = (
        (V.END_CONJUNCTIONS, "conjunction"), (V.END_PREPOSITIONS, "preposition"), (V.END_ARTICLES, "article"), (V.END_DETERMINERS, "determiner"),
        (V.END_RELATIVE_PRONOUNS, "relative pronoun"), (V.INCOMPLETE_VERBS, "incomplete verb"),
    )
    case = "CASE " + " ".join(f"WHEN {among('w', ws)} THEN {q(k)}" for ws, k in kinds)
    case += f" WHEN ends_with(w, 's') AND length(w) > 3 AND {among('substr(w, 1, length(w) - 1)', V.ACTION_VERBS)} THEN 'incomplete action verb' END"
    bare = lambda x: sub(f"lower({x})", r"^[.,!?;:]+|[.,!?;:]+$", "")
    first = bare(f"{words('line')}[1]")
    quoted = f"lower({words(strip('substr(line, 2)'))}[-1])"
    rule = f"CASE WHEN {among('w', V.RELATIVE_WORDS)} THEN 'relative clause' WHEN {among('w', V.OBJECT_VERBS)} THEN 'verb and object' WHEN {among('w', V.POSSESSIVES + V.DEMONSTRATIVES)} OR (ends_with(w, 's') AND length(w) > 3) THEN 'incomplete phrase' END"
    found = {
        "line_endings": f"SELECT * FROM (SELECT doc_id, line_no, {case} AS rule, w AS detail FROM (SELECT doc_id, line_no, {last} AS w FROM plain)) WHERE rule IS NOT NULL",
        "comma_breaks": f"SELECT doc_id, line_no, 'comma break' AS rule, next AS detail FROM plain WHERE ends_with(line, ',') AND next <> '' AND {n_words('next')} <= 3 AND NOT ({has('next', r'^\p{Lu}')} AND NOT ends_with(line, ' ,'))",
        "orphan_words": f"SELECT doc_id, line_no, 'orphaned word' AS rule, line AS detail FROM plain WHERE {n_words('line')} = 1 AND NOT starts_with(line, '>') AND {among(bare('line'), V.ORPHANS)}",
        "line_beginnings": f"SELECT doc_id, line_no, 'continuation word' AS rule, {first} AS detail FROM plain WHERE {among(first, V.START_CONTINUATIONS)}",
        "quote_breaks": f"SELECT * FROM (SELECT doc_id, line_no, {rule} AS rule, w AS detail FROM (SELECT doc_id, line_no, {quoted} AS w FROM plain WHERE line_no < n_lines - 1 AND starts_with(line, '>') AND next = '>' AND starts_with(next2, '>') AND {n_words('substr(next2, 2)')} > 0)) WHERE rule IS NOT NULL",
        "mid_word_breaks": f"""SELECT doc_id, line_no, 'mid-word break' AS rule, a || b AS detail FROM (
 SELECT doc_id, line_no, {words('line')}[-1] AS a, CASE WHEN NOT starts_with(ws[1], '>') THEN ws[1] WHEN ws[1] = '>' AND len(ws) > 1 THEN ws[2] ELSE substr(ws[1], 2) END AS b
 FROM (SELECT *, {words('next')} AS ws FROM s WHERE line <> '' AND next <> '' AND NOT {starts('line', '#', '```', '|')} AND NOT {starts('next', '#', '```', '|')}))
WHERE length(a) >= 3 AND NOT {has('a', '[.!?,:;-]$')} AND length(b) >= 2 AND NOT {has('b', r'^\p{Lu}')} AND length(a || b) > 6 AND {has('a || b', r'^\p{L}+$')}
 AND a NOT IN ('the', 'and', 'but', 'for', 'with', 'from')""",
    }
    every = " UNION ALL ".join(f"({x})" for x in found.values())
    out = {k: f"{base} {v}" for k, v in found.items()}
    out["paragraph_issues"] = f"{base} SELECT doc_id, rule, count(*) AS n FROM ({every}) GROUP BY doc_id, rule"
    out["issue_summary"] = f"{base} SELECT doc_id, rule, n, line_no, detail FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, rule) AS n, row_number() OVER (PARTITION BY doc_id, rule ORDER BY line_no, detail) AS rn FROM ({every})) WHERE rn <= 10"
    row = f"starts_with({strip('line')}, '|')"
    sep = r"^\s*\|(\s*:?-+:?\s*\|)+"
    pipes = PIPES.format
    out["table_integrity"] = f"""{BOOK} {lines()}, g AS (SELECT *, {row} AS row, line_no - row_number() OVER (PARTITION BY doc_id, {row} ORDER BY line_no) AS isl FROM lines),
t AS (SELECT *, first_value(line) OVER w AS head, row_number() OVER w = 1 AS first FROM g WHERE row WINDOW w AS (PARTITION BY doc_id, isl ORDER BY line_no))
SELECT doc_id, line_no, 'no separator' AS rule, {pipes('head')} AS expected, NULL AS found FROM t WHERE first AND line_no = n_lines
UNION ALL SELECT doc_id, line_no + 1, 'separator', {pipes('head')}, {pipes('next')} FROM t WHERE first AND {has('next', sep)} AND {pipes('next')} <> {pipes('head')}
UNION ALL SELECT doc_id, line_no, 'row', {pipes('head')}, {pipes('line')} FROM t WHERE NOT first AND NOT {has('line', sep)} AND {pipes('line')} <> {pipes('head')}"""
    out["blank_runs"] = f"""{BOOK} {lines()}, b AS (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM lines WHERE {strip('line')} = '')
SELECT doc_id, min(line_no) AS line_no, count(*) AS n FROM b GROUP BY doc_id, run HAVING count(*) > 2"""
    counts = "len(regexp_extract_all(line, {}))".format
    out["odd_characters"] = f"""{BOOK} {lines()}, r AS (SELECT doc_id, line_no, 'multiple spaces' AS rule, {counts(q(' {2,}'))} AS n FROM lines
 UNION ALL SELECT doc_id, line_no, 'non-ASCII character', {counts(q(r'[^\x00-\x7F]'))} FROM lines) SELECT * FROM r WHERE n > 0"""
    page = r"^\s*[\-–—•*_~]*\s*(\d{1,4})\s*[\-–—•*_~]*\s*$"
    out["page_numbers"] = f"""{BOOK} {lines(READ)}, m AS (SELECT *, {has('line', page)} AND {strip("coalesce(prev, '')")} = '' AND {strip("coalesce(next, '')")} = '' AS gone FROM lines)
SELECT doc_id, coalesce(string_agg(line, {NL} ORDER BY line_no) FILTER (WHERE NOT gone), '') AS text, count(*) FILTER (WHERE gone) AS n_removed FROM m GROUP BY doc_id"""
    return out


BREAKS = f"""cand AS (SELECT doc_id, line_no, line, p AS pos,
  CASE WHEN contains('.!?', substr(line, p, 1)) AND {has('substr(line, p + 1)', r'^\s+[A-Z]')} THEN 'sentence ending'
   WHEN {has('substr(line, p + 1)', r'^[,;]\s+(?:and|but|or|however|therefore|thus|hence|moreover|furthermore|nevertheless|nonetheless)\s+')} THEN 'clause break'
   WHEN {has('substr(line, p + 1)', r'^---\s')} OR (substr(line, p, 1) <> '-' AND {has('substr(line, p + 1)', r'^--\s')}) THEN 'em-dash break' END AS reason
 FROM (SELECT doc_id, line_no, line, unnest(range(41, length(line))) AS p FROM long)),
places AS (SELECT doc_id, line_no, pos, reason, 1 AS kind FROM cand WHERE reason IS NOT NULL),
ws AS (SELECT doc_id, line_no, {words('line')} AS ws FROM long),
ends AS (SELECT doc_id, line_no, unnest(range(1, len(ws))) AS k, ws FROM ws),
every AS (SELECT * FROM places UNION ALL SELECT doc_id, line_no, CAST(list_sum(list_transform(ws[1:k], lambda w: length(w) + 1)) AS BIGINT), 'word boundary', 2 FROM ends),
taken AS (SELECT doc_id, line_no, kind, CAST(0 AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS reason FROM (SELECT DISTINCT doc_id, line_no, kind FROM every)
 UNION ALL SELECT t.doc_id, t.line_no, t.kind, min(b.pos), arg_min(b.reason, b.pos) FROM taken t JOIN every b ON b.doc_id = t.doc_id AND b.line_no = t.line_no AND b.kind = t.kind AND b.pos - t.pos > 150
  GROUP BY t.doc_id, t.line_no, t.kind, t.pos),
chosen AS (SELECT doc_id, line_no, kind, list(pos ORDER BY pos) AS breaks, list(reason ORDER BY pos) AS reasons FROM taken WHERE pos > 0 GROUP BY doc_id, line_no, kind),
best AS (SELECT doc_id, line_no, arg_min(breaks, kind) AS breaks, arg_min(reasons, kind) AS reasons FROM chosen GROUP BY doc_id, line_no),
broken AS (SELECT l.doc_id, l.line_no, l.length, l.severity, l.line, coalesce(b.breaks, []) AS breaks, coalesce(b.reasons, []) AS reasons FROM rated l LEFT JOIN best b ON b.doc_id = l.doc_id AND b.line_no = l.line_no)"""


def _long() -> dict[str, str]:
    s = strip("line")
    plain = f"NOT starts_with({s}, '```') AND NOT {has(s, r'^\|.*\|$')} AND NOT {has(s, '^[-*_]{3,}$')}"
    rating = "rated AS (SELECT *, CASE WHEN length > 300 THEN 'severe' WHEN length > 225 THEN 'moderate' ELSE 'minor' END AS severity FROM long)"
    text_only = f"""{BOOK} {lines(READ)}, coded AS (SELECT *, sum(CASE WHEN starts_with({s}, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 = 1 AS code FROM lines),
long AS (SELECT doc_id, line_no, length({rstrip('line')}) AS length FROM coded WHERE NOT code AND {plain} AND NOT {has(s, r'^#{1,6}\s+')} AND length({rstrip('line')}) > 150), {rating}"""
    whole = f"""WITH RECURSIVE {lines(READ, 'documents')}, long AS (SELECT doc_id, line_no, {rstrip('line')} AS line, length({rstrip('line')}) AS length FROM lines WHERE {plain} AND length({rstrip('line')}) > 150), {rating}, {BREAKS}"""
    quote = "starts_with({0}, '>')".format(s)
    start = f"CASE WHEN {quote} THEN length({group('line', r'^(\s*> *)', 1)}) ELSE 0 END"
    prefix = f"CASE WHEN {quote} THEN substr(line, 1, length(line) - length({lstrip('line')})) || '> ' ELSE '' END"
    part = strip("substr(body, ats[i] + 1, coalesce(ats[i + 1], length(body)) - ats[i])")
    fixes = f"""{whole}, b AS (SELECT doc_id, line_no, line, breaks, {start} AS st, {prefix} AS prefix FROM broken),
c AS (SELECT *, substr(line, st + 1) AS body FROM b),
d AS (SELECT *, list_concat([0::BIGINT], list_filter(list_transform(breaks, lambda p: p - st), lambda p: p > 0 AND p < length(body))) AS ats FROM c)
SELECT doc_id, line_no, CASE WHEN len(breaks) = 0 THEN line ELSE array_to_string(list_transform(list_filter(list_transform(range(1, len(ats) + 1), lambda i: {part}), lambda x: x <> ''), lambda x: prefix || x), {NL} || {NL}) END AS new_line FROM d"""
    base = f"""WITH {lines(READ, 'documents')}, long AS (SELECT doc_id, line_no, length({rstrip('line')}) AS length FROM lines
 WHERE NOT starts_with({s}, '```') AND NOT {has(s, r'^\|.*\|$')} AND NOT {has(s, '^[-*_]{3,}$')} AND length({rstrip('line')}) > 150),
rated AS (SELECT *, CASE WHEN length > 300 THEN 'severe' WHEN length > 225 THEN 'moderate' ELSE 'minor' END AS severity FROM long)"""
    ints = "list_transform(breaks, lambda p: CAST(p AS INTEGER))"
    return {
        "long_lines": f"{base} SELECT * FROM rated", "long_line_severity": f"{base} SELECT severity, count(*) AS n FROM rated GROUP BY severity",
        "long_lines_of_text": f"{text_only} SELECT * FROM rated",
        "_text_severity": f"{text_only} SELECT severity, count(*) AS n FROM rated GROUP BY severity",
        "long_line_breaks": f"{whole} SELECT doc_id, line_no, length, severity, {ints} AS breaks, reasons FROM broken",
        "long_line_fixes": fixes,
        "long_line_report": f"{whole} SELECT doc_id, line_no, severity, length, len(breaks) AS n_breaks, array_to_string(reasons, ', ') AS reasons, substr(line, 1, 100) || CASE WHEN length > 100 THEN '...' ELSE '' END AS preview FROM broken",
    }


def _words(source: str = "documents", head: str = "WITH ") -> dict[str, str]:
    text = pad("text")
    for pattern, to in MARKUP:
        text = sub(text, pattern, to)
    base = f"""{head}t AS (SELECT doc_id, regexp_extract_all(lower({text}), {q(WORD)}) AS ws FROM {source}),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM t),
c AS (SELECT word, count(*) AS n, min((doc_id, pos)) AS first FROM w GROUP BY word)"""
    same = "|".join(f"{x}{{4,}}" for x in "abcdefghijklmnopqrstuvwxyz'-")
    odd = f"length(word) > 2 AND ({has('word', '[aeiou]{3,}|[bcdfghjklmnpqrstvwxyz]{4,}|^[qxz]|[qxz]$|' + same)} OR length(word) > 12 OR {has('word', '|'.join(V.RARE_PAIRS))}) AND NOT {among('word', V.KNOWN_WORDS)}"
    shown = ["eau", "thth", "ción"]
    contexts = f"""WITH {lines(SPLIT, 'documents')}, f AS (SELECT k.word, doc_id, line_no, concat_ws({NL}, prev, line, next) AS context FROM lines
 JOIN (VALUES {', '.join(f'({q(w)})' for w in shown)}) k(word) ON contains(lower(line), k.word))
SELECT word, doc_id, line_no, context FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, word ORDER BY line_no) <= 3"""
    return {
        "word_total": f"{base} SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS distinct FROM c",
        "spell_top": f"{base} SELECT word, n, row_number() OVER (ORDER BY n DESC, first) AS rank FROM c WHERE {odd} ORDER BY n DESC, first LIMIT 100",
        "word_contexts": contexts,
        "_suspects": f"{base} SELECT count(*) AS n FROM c WHERE {odd}",
        "spelling_report": f"""{base}, top AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, first) AS rank FROM c WHERE {odd} ORDER BY n DESC, first LIMIT 50), {lines(SPLIT, source)},
hits AS (SELECT rank, word, n, doc_id, line_no, concat_ws({NL}, prev, line, next) AS context FROM lines JOIN top ON contains(lower(line), word))
SELECT rank, word, n, row_number() OVER (PARTITION BY rank ORDER BY doc_id, line_no) AS k, doc_id, line_no, context FROM hits QUALIFY k <= 3""",
    }


def _texts() -> dict[str, str]:
    base = "text"
    for wrong, right in V.OCR_BASE:
        base = f"replace({base}, {q(wrong)}, {q(right)})"
    stages, counted = [], []
    for k, (wrong, right) in enumerate(V.OCR_BASE):
        stages.append(f"b{k + 1} AS MATERIALIZED (SELECT replace(t, {q(wrong)}, {q(right)}) AS t, (length(t) - length(replace(t, {q(wrong)}, ''))) // {len(wrong)} AS n FROM b{k})")
        counted.append(f"SELECT {k + 1} AS rule_no, {q(wrong)} AS rule, CAST(sum(n) AS BIGINT) AS n FROM b{k + 1}")

    def chain(rules: list[tuple[str, str]], any_case: bool = True) -> str:
        out = pad("text")
        for pattern, to in rules:
            out = sub(out, ("(?i)" if any_case else "") + pattern, to)
        return out

    def chain_counts(rules: list[tuple[str, str]]) -> str:
        steps, sums = [f"a0 AS (SELECT {pad('text')} AS t FROM book)"], []
        for k, (pattern, to) in enumerate(rules):
            p = "(?i)" + pattern
            steps.append(f"a{k + 1} AS MATERIALIZED (SELECT {sub('t', p, to)} AS t, len(regexp_extract_all(t, {q(p)})) AS n FROM a{k})")
            sums.append(f"SELECT {k + 1} AS rule_no, CAST(sum(n) AS BIGINT) AS n FROM a{k + 1}")
        return f"{BOOK}{', '.join(steps)} SELECT * FROM ({' UNION ALL '.join(sums)}) WHERE n > 0"

    image, html = r"!\[.*?\]\([^)]*\)", r"(?i)<img[^>]*>"
    cleared = strip(sub(sub(sub("x", image, ""), html, ""), " {2,}", " "))
    label, names = group("x", NAME_LIST, 1), group("x", NAME_LIST, 2)
    items = f"list_filter(list_transform(string_split({names}, ','), lambda y: {strip('y')}), lambda y: y <> '')"
    dice = f"list_transform(list_filter({items}, lambda y: {has('y', r'^\d+\s+.+$')}), lambda y: {sub('y', r'^(\d+)\s+(.+)$', r'\1' + chr(9) + r'\2', '')})"
    rows = lambda xs, k: f"array_to_string(list_transform(range(0, greatest(1, (len({xs}) + {k - 1}) // {k})), lambda i: array_to_string(({xs})[i * {k} + 1:i * {k} + {k}], chr(9))), {NL})"
    fits = f"{label} <> '' AND length({names}) - length(replace({names}, ',', '')) >= 3 AND length({names}) > 50"
    is_dice = f"((contains({label}, '(d') AND contains({label}, ')')) OR {has(names, r'^\s*\d+\s+\w+')})"
    tag = r"(?i)^\s*<(ch|1|2|3)>\s*"
    kind = f"lower({group('x', tag, 1)})"
    cut = r"^\s*\*\*(.+?)\*\*\s*$"
    title = strip(group(strip("x"), cut, 1))
    s = strip("x")
    top = f"({has(title, r'^\d+')} OR {among(title, ['Appendices', 'Bibliography', 'Tables', 'Foreword', 'Outline'])})"
    low = among(title, ["Terminology", "Pronunciation", "People's names", "A nominal history"])
    twos = f"((length({s}) - length(replace({s}, '  ', ''))) / 2)"
    many = has(pad(s), r"^\d+\s+\w+\s+\w+\s+\w+")
    tabular = f"({has(s, r'^\d+[–-]\d+|^D%')} OR ({twos} >= 2 AND {n_words(s)} >= 3))"
    typos = [(rf"\b{re.escape(a)}\b", b.upper() if a.isupper() else b[:1].upper() + b[1:] if a[:1].isupper() else b) for a, b in V.TYPOS]
    fixed = rstrip("x")
    for wrong, right in V.HEADING_FIXES:
        fixed = f"replace({fixed}, {q(wrong)}, {q(right)})"
    dashes = sub(sub(sub(sub("text", r"\s*---\s*", " — "), r"\s*--\s*|\s*—\s*", " — "), r"\s*—\s*", " — "), " {2,}", " ")
    # single capitals before a stop are marked by chr(1); each pass may miss a match that shares a character with another
    single, stop = r"(^|[^\w])([A-Z])([.!?])", r"(^|[^\x01])([.!?])([A-Za-z])"
    marked = sub(sub(pad("text"), single, r"\1\2" + "\x01" + r"\3"), single, r"\1\2" + "\x01" + r"\3")
    stops = f"replace({unpad(sub(sub(marked, stop, chr(92) + '1' + chr(92) + '2 ' + chr(92) + '3'), stop, chr(92) + '1' + chr(92) + '2 ' + chr(92) + '3'))}, chr(1), '')"
    return {
        "stops": whole(stops),
        "daggers": BOOK.rstrip(", ") + " SELECT doc_id, replace(text, '†', '') AS text, length(text) - length(replace(text, '†', '')) AS n_removed FROM book",
        "images": per_line(f"CASE WHEN {cleared} <> '' OR (x <> '' AND NOT {has('x', r'^\s*' + image + r'\s*$')}) THEN {cleared} END"),
        "image_counts": BOOK.rstrip(", ") + f" SELECT doc_id, CAST(list_sum(list_transform({SPLIT}, lambda x: len(regexp_extract_all(x, {q(image)})) + len(regexp_extract_all({sub('x', image, '')}, {q(html)})))) AS BIGINT) AS n_images FROM book",
        "quotes": per_line(f"CASE WHEN NOT starts_with({s}, '>') THEN x WHEN {s} = '>' THEN '' ELSE {sub('x', r'^(\s*)>\s?', r'\1', '')} END"),
        "quote_stats": f"{BOOK} {lines()} SELECT count(*) AS n_lines, count(*) FILTER (WHERE starts_with({strip('line')}, '>')) AS n_removed, round(count(*) FILTER (WHERE starts_with({strip('line')}, '>')) * 100.0 / count(*), 1) AS pct FROM lines",
        "tags_to_headings": per_line(f"CASE WHEN {kind} = '' THEN x ELSE repeat('#', CASE WHEN {kind} = 'ch' THEN 1 ELSE CAST({kind} AS INTEGER) + 1 END) || ' ' || {lstrip(sub('x', tag, '', ''))} END".replace(f"CAST({kind} AS INTEGER)", f"TRY_CAST({kind} AS INTEGER)")),
        "name_lists": per_line(f"CASE WHEN {fits} THEN {label} || {NL} || {NL} || CASE WHEN {is_dice} THEN {rows(dice, 4)} ELSE {rows(items, 5)} END ELSE x END"),
        "book_headings": per_line(
            f"CASE WHEN {starts(s, '<ch>', '<1>', '<2>', '<3>', '#')} OR contains(x, chr(9)) THEN x WHEN {among(title, list(V.BOOK_HEADINGS))} THEN CASE WHEN {top} THEN '# ' WHEN {low} THEN '### ' ELSE '## ' END || {title}"
            f" WHEN {many} THEN {sub('x', ' +', chr(9))} WHEN {tabular} THEN {sub('x', ' {2,}', chr(9))} ELSE x END", READ),
        "spaces_to_tabs": per_line(sub(sub("x", " {2,}", chr(9)), r"[ \t]+$", "")),
        "anchors": whole(sub("text", r"\[\]\{[^}]*\}", "")),
        "ocr_base": whole(base),
        "ocr_base_counts": f"{BOOK} b0 AS (SELECT text AS t FROM book), {', '.join(stages)} SELECT * FROM ({' UNION ALL '.join(counted)}) WHERE n > 0",
        "ocr_additional": whole(unpad(chain(additional_rules()))),
        "ocr_additional_counts": chain_counts(additional_rules()),
        "ocr_final": whole(sub(unpad(chain(list(V.OCR_FINAL))), "[\\x{200B}-\\x{200D}\\x{FEFF}\\x{00A0}]", "")),
        "_ocr_final_rules": whole(unpad(chain(list(V.OCR_FINAL)))),
        "ocr_final_counts": chain_counts(list(V.OCR_FINAL)),
        "typos": whole(unpad(chain(typos, False))),
        "dashes": whole(dashes),
        "spaces": whole(f"substr(regexp_extract(text, '^ *'), 1, 2) || {sub(sub('text', '^ +', ''), ' {2,}', ' ')}"),
        "heading_fixes": per_line(f"CASE WHEN starts_with(x, '#') THEN {fixed} ELSE x END", READ),
        "fixture_lines": f"{BOOK} {lines()} SELECT doc_id, line_no, line FROM lines",
    }


def _headers() -> dict[str, str]:
    level, title = f"length({group('line', HEADER, 1)})", strip(group("line", HEADER, 2))
    heads = f"{BOOK} {lines()}, h AS (SELECT doc_id, line_no, {level} AS level, {title} AS title FROM lines WHERE {level} > 0)"
    step = "CASE WHEN y > a[-1] + 1 AND a[-1] < 4 THEN a[-1] + 1 ELSE y END"
    fixed = f"""{heads}, agg AS (SELECT doc_id, list(line_no ORDER BY line_no) AS nos, list(level ORDER BY line_no) AS lv, list(title ORDER BY line_no) AS ti FROM h GROUP BY doc_id),
cor AS (SELECT doc_id, nos, lv, ti, list_reduce(list_transform(lv, lambda l: [l]), lambda a, z: list_append(a, list_transform(z, lambda y: {step})[1])) AS c FROM agg),
k AS (SELECT doc_id, unnest(nos) AS line_no, unnest(lv) AS was, unnest(c) AS level, unnest(ti) AS title FROM cor)"""
    s = strip("line")
    own = f"length({group('line', r'^(#{1,6})\s+', 1)})"
    cur, text = f"length({group(s, r'^(#{1,6})\s+(.+)$', 1)})", group(s, r"^(#{1,6})\s+(.+)$", 2)
    footer = " OR ".join(has(s, "(?i)" + p) for p in FOOTERS)
    wanted = "CASE " + " ".join(f"WHEN {has(s, '(?i)' + p)} THEN {lv}" for p, lv in LEVELS) + f" WHEN {own} > 0 THEN {own} ELSE 2 END"
    issue = f"""{BOOK} {lines(READ)}, r AS (SELECT doc_id, line_no, line, {s} AS original, {cur} AS cur, {text} AS title, ({footer}) AS foot, {wanted} AS wanted FROM lines),
i AS (SELECT doc_id, line_no, original, CASE WHEN foot THEN '[REMOVE - Footer artifact]' ELSE repeat('#', wanted) || ' ' || title END AS suggested,
 CASE WHEN foot THEN 'footer_artifact' ELSE 'hierarchy_fix' END AS issue_type, CASE WHEN foot THEN 'high' WHEN abs(cur - wanted) <= 2 THEN 'medium' ELSE 'low' END AS confidence
 FROM r WHERE cur > 0 AND (foot OR cur <> wanted))"""
    mark = f"CASE WHEN {s} = '# Table of contents' THEN 1 WHEN starts_with({s}, '# ') AND contains({s}, 'Introduction') THEN 0 END"
    tag = f"CASE WHEN starts_with({s}, '###') THEN '<2> ' WHEN starts_with({s}, '##') THEN '<1> ' ELSE '<ch> ' END"
    tagged = f"{sub('line', '#.*$', '', '')} || {tag} || {group('line', '(#.*)$', 1)}"
    tags = f"""{BOOK} {lines(READ)}, m AS (SELECT *, {mark} AS mark FROM lines),
r AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 0) AS toc FROM m)
SELECT doc_id, string_agg(CASE WHEN NOT starts_with({s}, '#') OR (toc = 1 AND {s} <> '# Table of contents') THEN line ELSE {tagged} END, {NL} ORDER BY line_no) AS text FROM r GROUP BY doc_id"""
    return {
        "heading_tags": tags,
        "header_histogram": f"{heads} SELECT level, count(*) AS n FROM h GROUP BY level",
        "header_summary": f"{heads} SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE level > 4) AS excessive, max(level) AS deepest FROM h GROUP BY doc_id",
        "header_hierarchy": f"{heads}, c AS (SELECT doc_id, line_no, least(level, 4) AS level, lag(least(level, 4)) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev_level FROM h) SELECT doc_id, line_no, prev_level, level FROM c WHERE level > prev_level + 1",
        "header_corrections": f"{fixed} SELECT doc_id, line_no, was AS original_level, level, 'hierarchy_corrected' AS action FROM k WHERE level <> was UNION ALL SELECT doc_id, line_no, was, level, 'converted_to_bold' FROM k WHERE level > 4",
        "header_depth": f"{fixed} SELECT l.doc_id, string_agg(CASE WHEN k.level IS NULL THEN l.line WHEN k.level > 4 THEN '**' || k.title || '**' ELSE repeat('#', k.level) || ' ' || k.title END, {NL} ORDER BY l.line_no) AS text FROM lines l LEFT JOIN k ON k.doc_id = l.doc_id AND k.line_no = l.line_no GROUP BY l.doc_id",
        "header_issues": f"{issue} SELECT * FROM i",
        "header_issue_counts": f"{issue} SELECT issue_type, count(*) AS n FROM i GROUP BY issue_type",
        "header_fixes": f"{issue} SELECT l.doc_id, string_agg(CASE WHEN i.confidence = 'medium' THEN i.suggested ELSE l.line END, {NL} ORDER BY l.line_no) FILTER (WHERE i.issue_type IS NULL OR i.issue_type <> 'footer_artifact') AS text FROM lines l LEFT JOIN i ON i.doc_id = l.doc_id AND i.line_no = l.line_no GROUP BY l.doc_id",
    }


def _contents() -> dict[str, str]:
    s = strip("line")
    number = lambda x: sub(sub(x, r"^(\d+)\.(\S)", r"\1. \2", ""), r"^(\d+):\s*(\S)", r"\1: \2", "")
    dots = lambda t, p, w, lo, hi: f"({t}) || ' ' || repeat('.', least({hi}, greatest({lo}, {w} - length({t}) - length({p}) - 2))) || ' ' || ({p})"
    flat = sub(s, r"\s+", " ")
    entry = r"^(.*?\S)\s+(\d{1,3})$"
    plain = f"""{BOOK} {lines(READ)}, st AS (SELECT doc_id, coalesce(min(line_no) FILTER (WHERE {among(s, list(MARKERS))}), min(line_no) FILTER (WHERE lower({s}) = 'table of contents')) AS a FROM lines GROUP BY doc_id),
en AS (SELECT l.doc_id, st.a, min(line_no) AS b FROM lines l JOIN st ON st.doc_id = l.doc_id AND l.line_no > st.a WHERE {starts(s, NOTE, *CONTENT_STARTS)} GROUP BY l.doc_id, st.a),
blk AS (SELECT l.doc_id, l.line_no, {s} AS was, {flat} AS flat FROM lines l JOIN en ON en.doc_id = l.doc_id AND l.line_no > a AND l.line_no < b WHERE {s} <> '' AND NOT {has(s, r'^\d{1,3}$')}),
tp AS (SELECT *, {number(strip(group('flat', entry, 1)))} AS t0, {group('flat', entry, 2)} AS p FROM blk),
tt AS (SELECT *, CASE WHEN length(t0) > 60 THEN {rstrip('substr(t0, 1, 60)')} ELSE t0 END AS t FROM tp),
ent AS (SELECT doc_id, line_no, was, CASE WHEN p <> '' THEN {dots('t', 'p', 70, 5, 50)} ELSE {number('flat')} END AS now FROM tt),
outl AS (SELECT l.doc_id, l.line_no, CASE WHEN l.line_no = a THEN '## Table Of Contents' WHEN l.line_no = b THEN {NL} || line ELSE line END AS o FROM lines l JOIN en ON en.doc_id = l.doc_id WHERE l.line_no <= a OR l.line_no >= b
 UNION ALL SELECT doc_id, line_no, now FROM ent),
txt AS (SELECT doc_id, string_agg(o, {NL} ORDER BY line_no) AS text FROM outl GROUP BY doc_id),
ch AS (SELECT doc_id, count(*) AS n FROM ent WHERE was <> now GROUP BY doc_id)
SELECT book.doc_id, coalesce(txt.text, book.text) AS text, coalesce(ch.n, 0) AS n_changes FROM book LEFT JOIN txt ON txt.doc_id = book.doc_id LEFT JOIN ch ON ch.doc_id = book.doc_id"""

    def region(closes: str) -> str:
        mark = f"CASE WHEN {s} = {q(MARKERS[0])} THEN 1 WHEN {closes} THEN 0 END"
        return f"{BOOK} {lines(READ)}, m AS (SELECT doc_id, line_no, line, {mark} AS mark FROM lines), r AS (SELECT *, mark IS NULL AND coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 0) = 1 AS inside FROM m)"

    one = r"^(.+?)\s+\.{3,}\s+(\d+)\s*$"
    t, p = strip(group(s, one, 1)), group(s, one, 2)
    dotted = f"{region(f'''({starts(s, FIRST_PART)} OR {s} = {q(BOOK_TITLE)})''')} SELECT doc_id, string_agg(CASE WHEN inside AND (contains(line, '............') OR {has(s, '[0-9]$')}) AND {p} <> '' THEN {dots(t, p, 80, 3, 60)} ELSE line END, {NL} ORDER BY line_no) AS text FROM r GROUP BY doc_id"
    each = r"([^.]+?)\.{3,}\s*(\d+)"
    crowded = f"""{region(starts(s, NOTE))}, e AS (SELECT *, list_transform(regexp_extract_all({s}, {q(each)}, 1), lambda y: {strip('y')}) AS ts, regexp_extract_all({s}, {q(each)}, 2) AS ps FROM r),
f AS (SELECT *, inside AND contains(line, '..................') AND len(ts) > 0 AS fits, list_filter(list_transform(range(1, len(ts) + 1), lambda i: CASE WHEN ts[i] <> '' THEN {dots('ts[i]', 'ps[i]', 70, 5, 50)} || '  ' END), lambda y: y IS NOT NULL) AS made FROM e)
SELECT doc_id, string_agg(CASE WHEN fits THEN array_to_string(made, {NL}) ELSE line END, {NL} ORDER BY line_no) FILTER (WHERE NOT (fits AND len(made) = 0)) AS text FROM f GROUP BY doc_id"""

    def compare(clean) -> str:
        toc = f"list_transform(regexp_extract_all(text, {q(r'(?m)^\[(.+?)\]\(\)')}, 1), lambda y: {clean('y')})"
        heads = f"list_transform(regexp_extract_all(text, {q(r'(?m)^(#{1,6})\s+(.+)$')}, 2), lambda y: {clean(strip('y'))})"
        return f"""{BOOK} x AS (SELECT doc_id, {toc} AS toc, {heads} AS heads FROM book),
y AS (SELECT *, list_filter(toc, lambda t: list_contains(heads, t)) AS seq, list_filter(toc, lambda t: NOT list_contains(heads, t)) AS missing FROM x),
z AS (SELECT *, seq <> list_filter(heads, lambda h: list_contains(seq, h)) AS order_mismatch FROM y)"""

    extra = "list_filter(heads, lambda h: NOT list_contains(toc, h) AND len(list_filter(toc, lambda t: starts_with(h, string_split(t, ' [')[1]))) > 0)"
    letters = f"list_filter(list_transform(list_filter(toc, lambda t: starts_with(lower(t), 'appendix')), lambda t: {group('t', r'(?i)appendix\s+([A-Z])\b', 1)}), lambda t: t <> '')"
    v = has("n", "(?i)" + VALUE) + " OR " + has("n", "(?i)" + MULTIPLIER)
    w = "(PARTITION BY doc_id ORDER BY line_no)"
    notes = f"""{BOOK} {lines(f"string_split({sub('text', '[_:]', '')}, {NL})")}, a AS (SELECT doc_id, line_no, {strip('line')} AS line FROM lines WHERE {strip('line')} <> ''),
b AS (SELECT *, coalesce(lead(line) OVER {w}, '') AS n, first_value(line) OVER {w} AS category, row_number() OVER {w} AS k FROM a),
c AS (SELECT *, {has('line', r'^[\p{L} ]*\p{L}[\p{L} ]*$')} AND {has('n', '(?i)multiplier')} AS opens FROM b WHERE k > 1),
d AS (SELECT *, opens OR {v} AS pred FROM c),
e AS (SELECT *, sum(CASE WHEN pred THEN 0 ELSE 1 END) OVER {w} AS isl FROM d),
f AS (SELECT *, pred AND (row_number() OVER (PARTITION BY doc_id, isl, pred ORDER BY line_no) - 1) % 2 = 0 AS head FROM e),
g AS (SELECT *, coalesce(last_value(CASE WHEN head AND opens THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), '') AS section FROM f),
rows AS (SELECT doc_id, line_no, category, section, line AS descriptor, n AS multiplier FROM g WHERE head AND NOT opens)"""
    return {
        "toc_plain": plain,
        "toc_dotted": dotted,
        "toc_crowded": crowded,
        "toc_check": f"{compare(lambda y: y)} SELECT doc_id, len(toc) AS toc_count, len(heads) AS headings_count, array_to_string(missing, ' | ') AS missing, order_mismatch FROM z",
        "toc_vs_headings": f"{compare(lambda y: strip(sub(y, r'\s+', ' ')))} SELECT doc_id, len(toc) AS toc_entries, len(heads) AS heading_entries, array_to_string(missing, ' | ') AS missing, array_to_string(({extra})[1:25], ' | ') AS extra, order_mismatch, {letters} <> list_sort({letters}) AS numbering_warn FROM z",
        "notes": f"{notes} SELECT * FROM rows",
        "notes_markdown": f"""{notes}, p AS (SELECT *, coalesce(lag(section) OVER {w}, '') AS before FROM rows)
SELECT doc_id, '# ' || any_value(category) || {NL} || {NL} || string_agg(CASE WHEN section <> before THEN '### ' || section || {NL} || {NL} || '| Descriptor | Multiplier |' || {NL} || '| :--- | :--- |' || {NL} ELSE '' END
 || '| ' || descriptor || ' | ' || multiplier || ' |' || {NL}, '' ORDER BY line_no) AS text FROM p GROUP BY doc_id""",
        "notes_tsv": f"{notes} SELECT doc_id, 'Category' || chr(9) || 'Section' || chr(9) || 'Descriptor' || chr(9) || 'Multiplier' || {NL} || string_agg(concat_ws(chr(9), category, section, descriptor, multiplier), {NL} ORDER BY line_no) AS text FROM rows GROUP BY doc_id",
    }


def oracle_sql() -> dict[str, str]:
    """Names that begin with an underscore are pieces of others."""
    return _joins() | _issues() | _long() | _words() | _texts() | _headers() | _contents()
