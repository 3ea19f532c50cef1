"""String helpers whose results equal those of Python's ``str`` and ``re`` on ordinary text.

``\\s``, ``\\w`` and ``\\b`` cover Unicode, ``.`` and ``$`` know no line end but the line feed. Patterns are literals, so
each is compiled once a task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flag prefixes of every pattern: exact case, and any case.
EXACT, ANY_CASE = "(?dU)", "(?diuU)"


#: What ``\\s`` covers.
SPACES = " \t\n\x0b\f\r\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACES))


def blank(c: Column) -> Column:
    return ~F.substring(c, 1, 1).between("!", "~") & (lstrip(c) == "")


def words(c: Column) -> Column:
    """As ``str.split()``."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def more_words(c: Column, n: int) -> Column:
    """Whether there are more than ``n`` words; looks no further."""
    return has(c, rf"^\s*+(?:\S++\s++){{{n}}}\S")


def starts_with(c: Column, *prefixes: str) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def has(c: Column, pattern: str, any_case: bool = False) -> Column:
    return c.rlike((ANY_CASE if any_case else EXACT) + pattern)


def sub(c: Column, pattern: str, to: str, any_case: bool = False) -> Column:
    """``to`` in Java's notation: ``$1`` for a group."""
    return F.regexp_replace(c, (ANY_CASE if any_case else EXACT) + pattern, to)


def count(c: Column, pattern: str, any_case: bool = False) -> Column:
    return F.regexp_count(c, F.lit((ANY_CASE if any_case else EXACT) + pattern)).cast("long")


def java_replacement(to: str) -> str:
    """From Python's notation (``\\1``) to Java's (``$1``)."""
    out, k = "", 0
    while k < len(to):
        if to[k] == "\\" and k + 1 < len(to) and to[k + 1].isdigit():
            out += f"${to[k + 1]}"
            k += 2
        else:
            out += "\\" + to[k] if to[k] in "$\\" else to[k]
            k += 1
    return out


def one_of(*alternatives: str) -> str:
    return "(?:" + "|".join(alternatives) + ")"
