"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased runs of ASCII letters and digits and of other than ASCII characters. An item overlaps a document if
some WINDOW consecutive words of the item (all of a shorter item) agree with as many consecutive words of the document in
SIMILARITY of the positions at least. Masks sample some positions of a stretch and ignore the rest; they are chosen so
that any such overlap has a mask whose sampled words all agree (``lossless_masks``). Test and training hashes under the
masks are joined, and around each hit the words are compared one by one, so every reported overlap is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, mix, spans_hash, steps, text_bytes, tidy

WINDOW = 13
SIMILARITY = 0.8
#: Items with fewer words are a class of their own (``short``): they are found whole, but clean texts have them by chance.
MIN_WORDS = 5
WEIGHT, MASKS = 6, 4
#: Words of all items together up to which they go along to every task (some 50 bytes a word with its seeds).
BROADCAST_WORDS = 1_000_000
#: Contaminated documents (id and hash) up to which they are broadcast.
BROADCAST_IDS = 100_000

_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def need(length: int) -> tuple[int, int]:
    """The window of an item of so many words, and how many of its positions must agree."""
    w = min(length, WINDOW)
    return w, int(np.ceil(SIMILARITY * w - 1e-9))


@lru_cache(maxsize=None)
def lossless_masks(window: int, errors: int) -> tuple[tuple[int, ...], ...]:
    """Masks of the greatest weight, up to WEIGHT, such that at most MASKS of them suffice: whatever ``errors`` positions
    of a window differ, one mask at some offset samples none of them."""
    cases = list(combinations(range(window), errors))
    every = (1 << len(cases)) - 1
    for weight in range(min(WEIGHT, window - errors), 1, -1):
        covers = []
        for span in range(weight, window + 1):
            for middle in combinations(range(1, span - 1), weight - 2):
                mask = (0, *middle, span - 1)
                clear = [any(not case.intersection(o + x for x in mask) for o in range(window - span + 1)) for case in map(frozenset, cases)]
                covers.append((sum(1 << i for i, c in enumerate(clear) if c), mask))
        left, chosen = every, []
        while left and len(chosen) < MASKS:
            cover, mask = max(covers, key=lambda c: (c[0] & left).bit_count())
            if not cover & left:
                break
            left &= ~cover
            chosen.append(mask)
        if not left:
            return tuple(chosen)
    return ((0,),)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and where each text's begin among them (and the end)."""
    lowered = pa.array([t.lower().encode().translate(_TABLE) if t else b"" for t in texts.to_pylist()], pa.binary())
    data, starts = text_bytes_of(lowered)
    inside = data != 0x20
    inside[starts[1:] - 1] = False
    edges = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return spans_hash(data, first, last), np.searchsorted(first, starts)


def text_bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = values.to_pylist()
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(v) + 1 for v in parts], out=starts[1:])
    return np.frombuffer(b" ".join([*parts, b""]), dtype=np.uint8), starts


def seeds(words: np.ndarray, bounds: np.ndarray, mask: tuple[int, ...], number: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes under a mask at every position where it fits into one text, and these positions."""
    span = mask[-1] + 1
    n = len(words) - span + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    total = np.full(n, number + 1, dtype=np.uint64)
    for k, x in enumerate(mask):
        total += words[x : x + n] * np.uint64(pow(0xD6E8FEB86659FD93, k + 1 + 7 * number, 1 << 64))
    ends = np.repeat(bounds[1:], np.diff(bounds))[:n]
    at = np.flatnonzero(np.arange(n) + span <= ends)
    return mix(total[at]), at


class Items:
    """The benchmark: word hashes of all items, and their seeds, sorted. Items with equal words count once, under the
    least item_id."""

    def __init__(self, ids: list, texts: list[str | None]) -> None:
        words, bounds = word_hashes(pa.array(texts, pa.string()))
        by_words: dict[bytes, int] = {}
        for k in sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k])):
            own = words[bounds[k] : bounds[k + 1]]
            if len(own):
                by_words.setdefault(own.tobytes(), k)
        rows = sorted(by_words.values())
        self.ids = [ids[k] for k in rows]
        parts = [words[bounds[k] : bounds[k + 1]] for k in rows]
        self.words = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        self.bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        families: dict[tuple[tuple[int, ...], ...], list[int]] = {}
        for k, p in enumerate(parts):
            w, least = need(len(p))
            families.setdefault(lossless_masks(w, w - least), []).append(k)
        self.masks: list[tuple[int, ...]] = []
        hashes, at, which = [], [], []
        for family, own in sorted(families.items()):
            for mask in family:
                number = len(self.masks)
                self.masks.append(mask)
                for k in own:
                    h, p = seeds(parts[k], np.array([0, len(parts[k])]), mask, number)
                    hashes.append(h)
                    at.append(p + self.bounds[k])
                    which.append(np.full(len(h), k))
        self.seed = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        order = np.argsort(self.seed, kind="stable")
        self.seed = self.seed[order]
        self.seed_at = (np.concatenate(at) if at else np.zeros(0, dtype=np.int64))[order]
        self.seed_item = (np.concatenate(which) if which else np.zeros(0, dtype=np.int64))[order]
        self.filter = np.zeros(1 << max(16, int(np.ceil(np.log2(max(1, len(self.seed))))) + 3), dtype=bool)
        self.filter[(self.seed & np.uint64(len(self.filter) - 1)).astype(np.int64)] = True

    def size(self, item: int) -> int:
        return int(self.bounds[item + 1] - self.bounds[item])

    def hits(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, shift) of every hit, each once; item position + shift = word position. The filter passes all
        hashes of the benchmark and few others; the rest of the join is by binary search."""
        found = []
        for number, mask in enumerate(self.masks):
            h, at = seeds(words, bounds, mask, number)
            some = np.flatnonzero(self.filter[(h & np.uint64(len(self.filter) - 1)).astype(np.int64)])
            h, at = h[some], at[some]
            low, high = np.searchsorted(self.seed, h, "left"), np.searchsorted(self.seed, h, "right")
            count = high - low
            own = np.repeat(np.arange(len(h)), count)
            k = np.repeat(low, count) + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            text = np.searchsorted(bounds, at[own], "right") - 1
            found.append(np.stack((text, self.seed_item[k], at[own] - (self.seed_at[k] - self.bounds[self.seed_item[k]])), 1))
        every = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), dtype=np.int64)
        return every[:, 0], every[:, 1], every[:, 2]

    def overlap(self, item: int, words: np.ndarray, low: int, high: int, shift: int) -> tuple[int, int]:
        """Of an item laid over ``words[low:high]`` at ``shift``: item words in windows that agree enough, and the most
        agreeing words of a window; 0, 0 if no window does."""
        own = self.words[self.bounds[item] : self.bounds[item + 1]]
        w, least = need(len(own))
        first, last = max(0, low - shift), min(len(own), high - shift)
        if last - first < w:
            return 0, 0
        same = own[first:last] == words[first + shift : last + shift]
        sums = np.concatenate(([0], np.cumsum(same)))
        inside = sums[w:] - sums[:-w]
        good = inside >= least
        if not good.any():
            return 0, 0
        cover = np.zeros(len(same) + 1, dtype=np.int64)
        np.add.at(cover, np.flatnonzero(good), 1)
        np.add.at(cover, np.flatnonzero(good) + w, -1)
        return int((np.cumsum(cover)[:-1] > 0).sum()), int(inside.max())

    def search(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """(text, item, words covered, agreeing words of the best window): the most over all ways to lay the item."""
        words, bounds = word_hashes(texts)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for text, item, shift in zip(*(c.tolist() for c in self.hits(words, bounds))):
            covered, most = self.overlap(item, words, int(bounds[text]), int(bounds[text + 1]), shift)
            if covered:
                before = best.get((text, item), (0, 0))
                best[text, item] = (max(before[0], covered), max(before[1], most))
        return [(t, i, c, m) for (t, i), (c, m) in sorted(best.items())]


def find_overlaps(docs: DataFrame, benchmark: DataFrame, part_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, item_id, covered, best, short): one row for each document and benchmark item that overlap; ``covered`` is
    the item's words in windows that agree enough, ``best`` the agreeing words of the best window.

    The benchmark is counted first. Up to ``part_words`` words it goes along to every task, and the documents are read
    once and not shuffled. A larger benchmark is taken in parts of that size, each against all documents, so that no task
    ever holds more; the work grows with the parts, the memory does not.

    Items of fewer than MIN_WORDS words are found where all their words stand in a row, and are ``short``; items without
    words are nowhere. Null and empty texts have no words. A very long text is searched whole, as a step of its own. Items
    that repeat others' words are reported under the least item_id of these, a null one last. Repeated documents give the
    same rows, which are reported once; of several ways to lay an item over a document the best counts. An empty table of
    either kind gives no rows. Other columns are not read, so clashing names do no harm.
    """
    return _overlaps(docs.select("doc_id", "text"), ["doc_id"], benchmark, part_words)


def _overlaps(rows: DataFrame, keys: list[str], benchmark: DataFrame, part_words: int) -> DataFrame:
    """``find_overlaps`` with the columns ``keys`` of ``rows`` in the place of doc_id."""
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    item_type = items.schema["item_id"].dataType.simpleString()
    key_types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """With a digest of the item's words and their number."""
        for batch in batches:
            hashes, bounds = word_hashes(batch.column("text"))
            own = [hashes[a:b] for a, b in zip(bounds, bounds[1:])]
            keys = pa.array([hashlib.sha256(w.tobytes()).hexdigest() for w in own], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys, pa.array([len(w) for w in own], pa.int64())], ["item_id", "text", "k", "n"])

    first = F.min(F.struct(F.col("item_id").isNull().alias("none"), "item_id", "text"))
    items = items.mapInArrow(tidy(keyed), f"item_id {item_type}, text string, k string, n long").groupBy("k", "n").agg(first.alias("s"))
    items = cut(items.select("k", "n", "s.item_id", "s.text"))
    words = items.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-words // part_words))
    out = None
    for k in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("k"), F.lit(parts)) == k)
        got = own.select("item_id", "text").toArrow()
        known = Items(got.column("item_id").to_pylist(), got.column("text").to_pylist())

        def run(batches: Iterator[pa.RecordBatch], known: Items = known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in steps(batch, "text"):
                    found = known.search(part.column("text"))
                    at = pa.array([f[0] for f in found], pa.int64())
                    own = [part.column(c).take(at) for c in keys]
                    item = pa.array([known.ids[f[1]] for f in found], got.schema.field("item_id").type)
                    longs = [pa.array([f[j] for f in found], pa.int64()) for j in (2, 3)]
                    short = pa.array([known.size(f[1]) < MIN_WORDS for f in found], pa.bool_())
                    yield pa.RecordBatch.from_arrays([*own, item, *longs, short], [*keys, "item_id", "covered", "best", "short"])

        found = rows.mapInArrow(tidy(run), f"{key_types}, item_id {item_type}, covered long, best long, short boolean")
        out = found if out is None else out.union(found)
    return out.groupBy(*keys, "item_id").agg(F.max("covered").alias("covered"), F.max("best").alias("best"), F.max("short").alias("short"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_ids: int = BROADCAST_IDS, drop_short: bool = False) -> DataFrame:
    """``docs`` without the rows whose text overlaps an item, as ``find_overlaps`` defines it; short items count only with
    ``drop_short``. Rows are known by doc_id and a hash of the text, so a clean row stays where another text has the same
    id, or a null one; repeated rows go or stay together. Null and empty texts stay, empty tables do no harm, and columns
    stay as they are; names that begin with two underscores are the operator's. What to drop is kept in the shared folder
    and counted; little is broadcast, so the texts are not shuffled; much is joined."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("__t"), "text")
    found = _overlaps(rows, ["doc_id", "__t"], benchmark, BROADCAST_WORDS)
    found = found if drop_short else found.where("NOT short")
    bad = cut(found.select(F.col("doc_id").alias("__bad"), F.col("__t").alias("__bad_text")).distinct())
    n = bad.count()
    on = F.col("doc_id").eqNullSafe(F.col("__bad")) & (F.xxhash64("text") == F.col("__bad_text"))
    return docs.join(F.broadcast(bad) if n <= broadcast_ids else bad, on, "left_anti")
