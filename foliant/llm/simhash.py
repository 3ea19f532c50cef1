"""SimHash near-dedup with bit-sliced comparison.

Distinct fingerprints that agree in some blocks of bits meet in a bucket: with m blocks, two fingerprints that differ in
at most r bits agree in m - r blocks at least, so tables for every choice of m - r blocks miss no pair. In a bucket, bit
planes are stored vertically (bit k of 64 fingerprints in one word), a carry-save counter adds the differing bits of many
pairs at once, and a block of pairs is abandoned once all exceed the radius. Links leave a task as a spanning forest, so
a bucket gives fewer rows than it has members, and their components are found by ``components``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, steps, table, tidy
from foliant.llm.components import components, forest

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints of one bucket that a task compares with each other; larger buckets are dealt in tiles of this size.
TILE = 4096
#: (blocks, agreeing blocks): 5 tables with keys of about 12 bits to 70 with keys of 32 bits, for a radius of 4.
SCHEMES = tuple((RADIUS + k, k) for k in (1, 2, 3, 4))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a whole text; 0 without words. ``bytes.split`` cuts at just the six ASCII separators, and
    ``bytes.lower`` changes just A to Z."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words))) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]
    return majority(np.array(hashes, dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 16384):
        octets = hashes[i : i + 16384].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << k for k in range(64) if 2 * counts[k] > len(hashes)))


def signed(fingerprints: list[int]) -> np.ndarray:
    return np.array(fingerprints, dtype=np.uint64).view(np.int64)


def with_fingerprint(docs: DataFrame, columns: list[str], out: str = "__fp") -> DataFrame:
    """``columns`` of ``docs`` and the fingerprint of its text as a (signed) long. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "__text"):
                found = signed([fingerprint(t) for t in part.column("__text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(found, pa.int64())], [*columns, out])

    rows = docs.select(*columns, F.col("text").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text"), f"{out} long"])
    return rows.mapInArrow(tidy(run), schema)


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): word w of plane k has bit k of fingerprints 64 w to 64 w + 63. The last word is padded with copies
    of the last fingerprint."""
    n = len(fps)
    padded = np.concatenate((fps, np.repeat(fps[-1:], -n % 64)))
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T).reshape(64, -1, 64), axis=2, bitorder="little").view("<u8")[:, :, 0].astype(np.uint64)


def close_pairs(x: np.ndarray, y: np.ndarray, radius: int = RADIUS, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with at most ``radius`` differing bits between x[i] and y[j], bit-sliced.

    Counters of three bits and one for overflow hold the distances of 64 pairs a word; a counter that starts at
    7 - radius overflows just when the distance exceeds the radius. Every 8 planes, rows of pairs that have all
    overflowed are abandoned.
    """
    if not len(x) or not len(y):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    full, zero = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)
    vertical = planes(y)
    left, right = [], []
    for first in range(0, len(x), block):
        own = x[first : first + block]
        rows = np.arange(len(own))
        words = vertical.shape[1]
        start = 7 - radius
        c0, c1, c2 = (np.full((len(own), words), full if start >> k & 1 else zero) for k in range(3))
        over = np.zeros((len(own), words), dtype=np.uint64)
        for k in range(64):
            mask = np.where((own[rows] >> np.uint64(k)) & np.uint64(1), full, zero)
            carry = vertical[k][None, :] ^ mask[:, None]
            c0, carry = c0 ^ carry, c0 & carry
            c1, carry = c1 ^ carry, c1 & carry
            c2, carry = c2 ^ carry, c2 & carry
            over |= carry
            if k % 8 == 7 and k >= 15:
                live = (over != full).any(1)
                if not live.all():
                    if not live.any():
                        rows = rows[:0]
                        break
                    rows, c0, c1, c2, over = rows[live], c0[live], c1[live], c2[live], over[live]
        if len(rows):
            near = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")[:, : len(y)]
            i, j = np.nonzero(near)
            left.append(rows[i] + first)
            right.append(j)
    if not left:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(left), np.concatenate(right)


def scheme(n: int) -> tuple[int, int]:
    """The (blocks, agreeing blocks) whose rows and compared pairs cost least for ``n`` random fingerprints; a row costs
    about as much as 300 compared pairs. All schemes find all pairs."""

    def cost(s: tuple[int, int]) -> float:
        tables = len(list(combinations(range(s[0]), s[1])))
        return tables * n * (300 + n / 2 / 2 ** (64 * s[1] / s[0]))

    return min(SCHEMES, key=cost)


def bucket_keys(fp: Column, blocks: int, agree: int) -> Column:
    """An array of keys, one for each choice of ``agree`` of ``blocks`` blocks: the table's number and the chosen bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), agree)):
        bits = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        keys.append(F.xxhash64(F.lit(number), fp.bitwiseAND(F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long"))))
    return F.array(*keys)


def _pairs_in(keys: np.ndarray, tiles: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within a run of sorted rows: all pairs of one key; of a tile pair, those across its two tiles."""
    a, b = [], []
    bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(bounds)
    plain = tiles[bounds[:-1]] < 0
    # small buckets side by side: pairs across buckets are compared along, and are links where they are close
    small = plain & (sizes <= 64)
    at = 0
    while at < len(sizes):
        if not small[at]:
            s, e = bounds[at], bounds[at + 1]
            if plain[at]:
                x = y = fps[s:e]
            else:
                x, y = fps[s:e][tiles[s:e] % 2 == 0], fps[s:e][tiles[s:e] % 2 == 1]
            if len(x) and len(y):
                i, j = close_pairs(x, y)
                a.append(x[i])
                b.append(y[j])
            at += 1
            continue
        stop = at
        while stop < len(sizes) and small[stop] and bounds[stop + 1] - bounds[at] <= 256:
            stop += 1
        stop = max(stop, at + 1)
        own = fps[bounds[at] : bounds[stop]]
        i, j = close_pairs(own, own)
        a.append(own[i])
        b.append(own[j])
        at = stop
    if not a:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    x, y = np.concatenate(a), np.concatenate(b)
    return x[x != y], y[x != y]


def near_links(fps: DataFrame, n: int, tile: int = TILE) -> DataFrame:
    """Links (a, b) between the distinct fingerprints (column __fp): a spanning forest for each task's part, so their
    components are those of all pairs within the radius. ``n``: how many there are, for the choice of tables.

    A bucket with more than ``tile`` members is dealt in tiles; each pair of tiles is a bucket of its own, so every task
    holds at most two tiles at once.
    """
    blocks, agree = scheme(n)
    keyed = fps.select("__fp", F.explode(bucket_keys(F.col("__fp"), blocks, agree)).alias("__key"))
    large = keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > tile)
    large = cut(large.select(F.col("__key").alias("__k"), F.ceil(F.col("__n") / tile).cast("int").alias("__tiles")))
    if large.limit(1).count():
        joined = keyed.join(large, keyed["__key"] == large["__k"], "left")
        plain = joined.where("__tiles IS NULL").select("__fp", "__key", F.lit(-1).alias("__tile"))
        mine = F.pmod(F.xxhash64("__fp", F.lit(3)), F.col("__tiles")).cast("int")
        hot = joined.where("__tiles IS NOT NULL").withColumn("__mine", mine).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__tiles") - 1)))
        # the pair of a tile with itself is a plain bucket; of two tiles the lesser is side 0
        hot = hot.select(
            "__fp",
            F.xxhash64("__key", F.least("__mine", "__other"), F.greatest("__mine", "__other")).alias("__key"),
            F.when(F.col("__mine") == F.col("__other"), -1).when(F.col("__mine") < F.col("__other"), 0).otherwise(1).alias("__tile"),
        )
        keyed = plain.union(hot)
    else:
        keyed = keyed.withColumn("__tile", F.lit(-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def spend(rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
            x, y = _pairs_in(*rows)
            a, b = forest(x.view(np.int64), y.view(np.int64))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            key, tiles, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__key", "__tile", "__fp"))
            held.append((key, tiles, fp.astype(np.int64).view(np.uint64)))
            if held[0][0][0] == key[-1]:
                continue  # one bucket so far
            rows = tuple(np.concatenate(c) for c in zip(*held))
            last = int(np.flatnonzero(rows[0] != key[-1])[-1]) + 1  # the last bucket may go on
            yield from spend(tuple(c[:last] for c in rows))
            held = [tuple(c[last:] for c in rows)]
        if held:
            yield from spend(tuple(np.concatenate(c) for c in zip(*held)))

    return keyed.repartition("__key").sortWithinPartitions("__key").mapInArrow(tidy(run), "a long, b long")


def group_near(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (doc_id among them), fingerprint string (16 hex digits) and component_id, the least doc_id
    that links reach; fingerprints link at RADIUS or fewer differing bits.

    A text without words (null, empty, white space) has fingerprint 0, which links like any other. A very long text is
    hashed whole, as a step of its own. A bit that is set in just half of the hashes is 0. Copies share a fingerprint, so
    groups of copies meet as one row; repeated rows are copies, and each has a row. A null doc_id is never a component's
    least id unless all its ids are null. An empty table gives an empty result. Columns that aren't asked for are not read.
    Fingerprints are computed once and kept in the shared folder.
    """
    columns = ["doc_id"] if columns is None else columns
    prints = table(with_fingerprint(docs, columns))
    named = _components_of(prints)
    # one row a fingerprint on the right; on the left, Spark splits the rows of a fingerprint that very many texts share
    out = prints.join(named, prints["__fp"] == named["__f"])
    hexed = F.lpad(F.lower(F.hex("__fp")), 16, "0")
    return out.select(*columns, hexed.alias("fingerprint"), "component_id")


def _components_of(prints: DataFrame) -> DataFrame:
    """(__f, __c, component_id): each fingerprint's component, named by a fingerprint, and its least doc_id."""
    distinct = cut(prints.groupBy("__fp").agg(F.min("doc_id").alias("__low")))
    links = near_links(distinct.select("__fp"), distinct.count())
    found = components(links, forests=True).withColumnRenamed("node", "__node")
    grouped = distinct.join(found, distinct["__fp"] == found["__node"], "left").select(
        F.col("__fp").alias("__f"), F.coalesce("component", "__fp").alias("__c"), "__low"
    )
    least = grouped.groupBy("__c").agg(F.min("__low").alias("component_id")).withColumnRenamed("__c", "__g")
    return cut(grouped.join(least, grouped["__c"] == least["__g"]).select("__f", "__c", "component_id"))


#: Rows that aren't kept up to which their keys are broadcast.
BROADCAST_KEYS = 300_000


def row_key() -> Column:
    """A number for each (doc_id, text), nulls included."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"))


def one_of_each(docs: DataFrame, members: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: the one with the least doc_id (null last), of these the one with the least
    hash of its text, and of rows alike in both any one. ``members``: doc_id, __t (hash of the text), __k (``row_key``) and
    the component __c of every row.

    What goes is decided on these short rows. Texts aren't shuffled where the keys of what goes are few, as counted; only
    rows of which another is alike in id and text are gathered, one a task, to keep one.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__t", "__k")
    best = members.groupBy("__c").agg(F.min(order).alias("o")).select(F.col("o.__k").alias("__best"))
    each = members.groupBy("__k").agg(F.count(F.lit(1)).alias("__n"))
    fate = each.join(best, each["__k"] == best["__best"], "left").select(F.col("__k").alias("__key"), F.col("__best").isNotNull().alias("__stays"), "__n")
    fate = cut(fate.where("NOT __stays OR __n > 1"))
    small = fate.count() <= BROADCAST_KEYS
    moved, again = fate.select("__key"), fate.where("__stays").select("__key")
    keyed = docs.withColumn("__k", row_key())
    out = keyed.join(F.broadcast(moved) if small else moved, F.col("__k") == F.col("__key"), "left_anti").select(*docs.columns)
    if again.limit(1).count():
        alike = keyed.join(F.broadcast(again) if small else again, F.col("__k") == F.col("__key"), "left_semi")
        one = alike.groupBy("__k").agg(F.first(F.struct(*docs.columns)).alias("__row"))
        out = out.union(one.select("__row.*"))
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component of ``group_near``, as ``one_of_each`` chooses it. Texts without words are
    like any others; an empty table gives an empty result."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("__t"), row_key().alias("__k"), "text")
    prints = table(with_fingerprint(rows, ["doc_id", "__t", "__k"]))
    named = _components_of(prints)
    joined = prints.join(named, prints["__fp"] == named["__f"])
    return one_of_each(docs, joined.select("doc_id", "__t", "__k", "__c"))
