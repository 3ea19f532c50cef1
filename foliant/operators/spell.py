"""Spelling candidates: words, counts, contexts."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from foliant.functions import text as T
from foliant.functions import vocab as V
from foliant.operators.lines import beside

#: Markdown that isn't words (fixed patterns, in order), and what stands in its place.
MARKUP = (
    (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"`[^`]+`", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"#{1,6}\s+", ""),
    (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""),
)
WORD = r"\b[a-zA-Z][a-zA-Z'-]*[a-zA-Z]\b|\b[a-zA-Z]\b"


def word_array(text: Column) -> Column:
    for pattern, to in MARKUP:
        text = T.sub(text, pattern, to)
    return F.regexp_extract_all(F.lower(text), F.lit(T.EXACT + WORD), 0)


def doc_words(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, word). No shuffle."""
    return docs.select("doc_id", F.posexplode(word_array(F.coalesce("text", F.lit("")))).alias("pos", "word"))


def is_suspect(word: Column, known: Iterable[str] = V.KNOWN_WORDS) -> Column:
    """Three vowels or four consonants in a row, a letter four times, q, x or z at an end, over 12 letters, or a letter
    pair that English lacks; not a known word, nor one of one or two letters."""
    odd = T.has(word, "[aeiou]{3,}|[bcdfghjklmnpqrstvwxyz]{4,}|(.)\\1{3,}|^[qxz]|[qxz]$") | (F.length(word) > 12) | T.has(word, T.one_of(*V.RARE_PAIRS))
    return (F.length(word) > 2) & odd & ~word.isin(*known)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n, first): counts over all documents, and a value that orders words by where they stand first. Tasks add up
    before the shuffle; for whole-numbered ids the place is one number, which a hash aggregate can update in place."""
    words = doc_words(docs)
    place = F.struct("doc_id", "pos")
    if isinstance(words.schema["doc_id"].dataType, IntegralType):
        place = F.col("doc_id").cast("decimal(20,0)") * F.lit(Decimal(1 << 32)) + F.col("pos")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))


def word_totals(docs: DataFrame) -> DataFrame:
    """One row: total and distinct words."""
    return word_counts(docs).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"))


def spelling_candidates(docs: DataFrame, top: int | None = 100) -> DataFrame:
    """(word, n, rank): suspect words, the most frequent first, of equal ones the first to occur; the ``top`` of them."""
    found = word_counts(docs).where(is_suspect(F.col("word")))
    order = (F.col("n").desc(), F.col("first"))
    if top is not None:
        found = found.orderBy(*order).limit(top)
        return found.select("word", "n", F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"))
    return found.select("word", "n")


def word_contexts(docs: DataFrame, words: list[str], per_word: int = 3) -> DataFrame:
    """(word, doc_id, line_no, context): of each document the first ``per_word`` lines that contain each word, in any
    case and inside words, too, with the lines before and after."""
    known = F.array(*(F.lit(w.lower()) for w in words))
    df = beside(docs).select("doc_id", "line_no", F.concat_ws("\n", "prev", "line", "next").alias("context"), F.lower("line").alias("l"))
    df = df.select("doc_id", "line_no", "context", F.explode(F.filter(known, lambda w: F.contains(F.col("l"), w))).alias("word"))
    w = Window.partitionBy("doc_id", "word").orderBy("line_no")
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_word).select("word", "doc_id", "line_no", "context")
