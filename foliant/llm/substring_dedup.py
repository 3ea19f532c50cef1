"""Substring dedup by seed and extend.

A window is WINDOW consecutive words of a document; each window that also occurs in a document with a smaller id is
removed. Every window selects one seed, the least hash among its stretches of SEED words (winnowing), so equal windows
select equal seeds, and documents need to be joined on selected seeds alone: about one word in 18.

Each occurrence of a seed is extended both ways as far as windows select it: its stretch. Occurrences are joined with the
seeds that several documents share. Where all stretches of a seed are alike, the least id among them settles all their
windows at once. Where they differ, each distinct stretch, however many documents hold it, is compared window by window
with the others, from one document's text. What is removed in a document is the union of its ranges, that is, its maximal
repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import spans_hash, steps, table, text_bytes, tidy

WINDOW = 50
SEED = 16
#: Bits of a filter for each key that it holds, and words of 64 bits at most: 8 MB, which broadcasts never exceed.
KEY_BITS, FILTER_WORDS = 16, 1 << 20
#: UTF-8 bytes of text that a worker takes at a time.
BLOCK_BYTES = 1_000_000

_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


def word_edges(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and each text's first word (and the end). Words are runs of other bytes than
    the six ASCII separators; texts are separated by one."""
    edges = np.diff(np.concatenate(([False], ~_GAP[data], [False])).astype(np.int8))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return first, last, np.searchsorted(first, starts)


def selected(seed: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the index of its least, the leftmost if several."""
    at, size = np.arange(len(seed)), 1
    while size * 2 <= width:
        a, b = at[:-size], at[size:]
        at = np.where(seed[a] <= seed[b], a, b)
        size *= 2
    a, b = at[: len(at) - (width - size)], at[width - size :]
    return np.where(seed[a] <= seed[b], a, b)


def occurrences(texts: pa.Array, window: int = WINDOW, size: int = SEED) -> tuple[np.ndarray, ...]:
    """One entry for each seed occurrence that windows select: text, hash, first window, last window (both as word
    numbers in the text), hash of the extended stretch; then all words' hashes and the texts' first words."""
    data, starts = text_bytes(texts)
    first, last, bounds = word_edges(data, starts)
    words = spans_hash(data, first, last)
    n = len(words)
    none = np.zeros(0, dtype=np.int64)
    if n < window:
        return none, none.astype(np.uint64), none, none, none.astype(np.uint64), words, bounds
    at = np.arange(n - size + 1)
    seed = spans_hash(words, at, at + size, 1)
    chosen = selected(seed, window - size + 1)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(chosen)]
    valid = np.arange(len(chosen)) + window <= bounds[1:][text]
    window_at = np.flatnonzero(valid)
    chosen, text = chosen[valid], text[valid]
    if not len(chosen):
        return none, none.astype(np.uint64), none, none, none.astype(np.uint64), words, bounds
    new = np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])))
    heads = np.flatnonzero(new)
    tails = np.concatenate((heads[1:] - 1, [len(chosen) - 1]))
    a, b, own = window_at[heads], window_at[tails], text[heads]
    stretch = spans_hash(words, a, b + window, 0) + (chosen[heads] - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return own, seed[chosen[heads]], a - bounds[own], b - bounds[own], stretch, words, bounds


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def seed_occurrences(rows: DataFrame, window: int, size: int) -> DataFrame:
    """(doc_id, __t, seed, stretch, a, b) of every selected seed: its first and last window, as word numbers."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", BLOCK_BYTES):
                own, seed, a, b, stretch, _, _ = occurrences(part.column("text"), window, size)
                ids = [part.column(c).take(pa.array(own)) for c in ("doc_id", "__t")]
                yield pa.RecordBatch.from_arrays([*ids, _longs(seed), _longs(stretch), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["doc_id", "__t", "seed", "stretch", "a", "b"])

    return rows.mapInArrow(tidy(run), f"doc_id {kind}, __t long, seed long, stretch long, a int, b int")


def likely(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``df`` with __hit: false for no row whose ``key`` (SQL for a whole number) is in the single column of ``keys``, and
    for most others. It spares the shuffle of what joins nothing; a filter that many keys fill spares less."""
    (name,) = keys.columns
    words = 1 << max(0, min(FILTER_WORDS, keys.count() * KEY_BITS // 64 + 1) - 1).bit_length()
    slot, bit = "pmod({0}, {1}L)", "CAST(pmod(shiftright({0}, 40), 64) AS INT)"
    slots = keys.selectExpr(f"{slot.format(name, words)} AS __slot", f"shiftleft(1L, {bit.format(name)}) AS __bits").groupBy("__slot").agg(F.bit_or("__bits").alias("__bits"))
    joined = df.join(F.broadcast(slots), F.expr(slot.format(key, words)) == F.col("__slot"), "left")
    return joined.withColumn("__hit", F.coalesce(F.expr(f"shiftright(__bits, {bit.format(key)}) & 1") == 1, F.lit(False))).drop("__slot", "__bits")


def window_signs(rows: DataFrame, stretches: DataFrame, window: int) -> DataFrame:
    """(seed, stretch, k, sign, id): a hash of each window k of each stretch, from the document that ``stretches`` names
    (seed, stretch, __d, __u, a, b), and its id. The texts of these documents are read again."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    by_doc = table(stretches.groupBy("__d", "__u").agg(F.collect_list(F.struct("seed", "stretch", "a", "b")).alias("spans")))
    some = likely(rows, "xxhash64(doc_id, __t)", by_doc.select(F.xxhash64("__d", "__u").alias("h"))).where("__hit")
    some = some.join(by_doc, (F.col("doc_id") == F.col("__d")) & (F.col("__t") == F.col("__u"))).select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", BLOCK_BYTES):
                data, starts = text_bytes(part.column("text"))
                first, last, bounds = word_edges(data, starts)
                words = spans_hash(data, first, last)
                lists = part.column("spans")
                spans = lists.flatten()
                text = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
                a, b = (spans.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in "ab")
                counts = b - a + 1
                own = np.repeat(np.arange(len(a)), counts)
                k = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
                at = bounds[text[own]] + a[own] + k
                sign = spans_hash(words, at, at + window, 1) if len(at) else at.astype(np.uint64)
                named = [spans.field(c).take(pa.array(own)) for c in ("seed", "stretch")]
                yield pa.RecordBatch.from_arrays([*named, pa.array(k, pa.int32()), _longs(sign), part.column("doc_id").take(pa.array(text[own]))], ["seed", "stretch", "k", "sign", "id"])

    return some.mapInArrow(tidy(run), f"seed long, stretch long, k int, sign long, id {kind}")


def runs(ks: Column, a: Column, window: int) -> Column:
    """Ranges of words (low, high) that the windows ``ks`` of a stretch at ``a`` cover, one for each run of windows."""
    starts = F.filter(ks, lambda k: ~F.array_contains(ks, k - 1))
    ends = F.filter(ks, lambda k: ~F.array_contains(ks, k + 1))
    return F.zip_with(F.array_sort(starts), F.array_sort(ends), lambda s, e: F.struct((a + s).cast("long").alias("low"), (a + e + window).cast("long").alias("high")))


def removed_ranges(docs: DataFrame, window: int = WINDOW, size: int = SEED) -> DataFrame:
    """(doc_id, __t, low, high): ranges of word numbers to remove; they may overlap. __t is the text's hash, which tells
    rows with the same doc_id apart."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("__t"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = table(seed_occurrences(rows, window, size))
    shared = found.groupBy("seed").agg(F.min("doc_id").alias("low_id"), F.max("doc_id").alias("high_id"), F.min("stretch").alias("s"), F.max("stretch").alias("t"))
    shared = table(shared.where("low_id < high_id").select(F.col("seed").alias("__s"), "low_id", (F.col("s") == F.col("t")).alias("alike")))
    met = likely(found, "seed", shared.select("__s")).where("__hit").drop("__hit")
    met = table(met.join(shared, F.col("seed") == F.col("__s")).drop("__s"))
    whole = met.where("alike AND doc_id > low_id").select("doc_id", "__t", F.col("a").cast("long").alias("low"), (F.col("b") + window).cast("long").alias("high"))
    other = met.where("NOT alike").drop("alike", "low_id")
    least = F.min(F.struct("doc_id", "__t", "a", "b")).alias("r")
    reps = table(other.groupBy("seed", "stretch").agg(least).select("seed", "stretch", F.col("r.doc_id").alias("__d"), F.col("r.__t").alias("__u"), "r.a", "r.b"))
    signs = table(window_signs(rows, reps, window))
    # the least id that has each window, over all stretches of its seed; then, for each stretch, these ids by window
    lows = signs.groupBy("seed", "sign").agg(F.min("id").alias("low_id")).select(F.col("seed").alias("__s"), F.col("sign").alias("__w"), "low_id")
    named = signs.join(lows, (F.col("seed") == F.col("__s")) & (F.col("sign") == F.col("__w")))
    ids = table(named.groupBy("seed", "stretch").agg(F.collect_set(F.struct("k", "low_id")).alias("ids")).withColumnsRenamed({"seed": "__s", "stretch": "__w"}))
    seen = other.join(ids, (F.col("seed") == F.col("__s")) & (F.col("stretch") == F.col("__w")))
    gone = seen.withColumn("ks", F.transform(F.filter("ids", lambda x: x["low_id"] < F.col("doc_id")), lambda x: x["k"])).where(F.size("ks") > 0)
    windows = gone.select("doc_id", "__t", F.explode(runs(F.col("ks"), F.col("a"), window)).alias("r")).select("doc_id", "__t", "r.low", "r.high")
    return whole.union(windows)


def cut_words(text: str | None, ranges: list[tuple[int, int]]) -> tuple[list[bytes], int]:
    """All words that no range covers, and how many words there are."""
    words = (text or "").encode().split()
    if not ranges:
        return words, len(words)
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    low, high = np.array(ranges, dtype=np.int64).T
    np.add.at(cover, low, 1)
    np.add.at(cover, np.minimum(high, len(words)), -1)
    keep = np.cumsum(cover)[:-1] == 0
    return [w for w, k in zip(words, keep.tolist()) if k], len(words)


def dedup_substrings(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space); with
    ``with_text`` also text, the kept words so joined.

    A null text has no words. A document with a null doc_id neither loses words nor makes others lose any. Rows with the
    same doc_id are not smaller than each other; each keeps or loses words by its own text, so repeated rows end alike.
    Texts of fewer than WINDOW words lose none. A very long text is read whole, as a step of its own. An empty table gives
    an empty result. Other columns are not read, so clashing names do no harm.
    """
    ranges = table(removed_ranges(docs).groupBy("doc_id", "__t").agg(F.collect_set(F.struct("low", "high")).alias("__ranges")).withColumnsRenamed({"doc_id": "__d", "__t": "__u"}))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("__t"))
    marked = likely(rows, "xxhash64(doc_id, __t)", ranges.select(F.xxhash64("__d", "__u").alias("h")))
    none = F.lit(None).cast(ranges.schema["__ranges"].dataType)
    on = (F.col("doc_id") == F.col("__d")) & (F.col("__t") == F.col("__u"))
    joined = marked.where("__hit").join(ranges, on, "left").select("doc_id", "text", "__ranges")
    rest = marked.where("NOT __hit").select("doc_id", "text", none.alias("__ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                n, gone, digest, texts = [], [], [], []
                for text, own in zip(part.column("text").to_pylist(), part.column("__ranges").to_pylist()):
                    kept, count = cut_words(text, [(r["low"], r["high"]) for r in own or ()])
                    joined_text = b" ".join(kept)
                    n.append(count)
                    gone.append(count - len(kept))
                    digest.append(hashlib.sha256(joined_text).hexdigest())
                    if with_text:
                        texts.append(joined_text.decode())
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], [*names, "text"]) if with_text else pa.RecordBatch.from_arrays(columns, names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    return joined.mapInArrow(tidy(run), schema).union(rest.mapInArrow(tidy(run), schema))
