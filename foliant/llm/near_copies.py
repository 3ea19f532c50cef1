"""Near copies: SimHash groups, completed to all pairs of a Jaccard similarity of word shingles.

A text is the set of its shingles: runs of SHINGLE lower-cased words, or all words of a shorter text. Fingerprints of the
sets are compared bit-sliced (``simhash.near_links``), and each text of a group is compared with one of the group, shingle
by shingle. At a similarity of 0.8, fingerprints differ in about 10 of 64 bits, in some cases in nearly twice as many, and
a radius that wide has no buckets that miss no pair. So prefix filtering finds the pairs that SimHash misses: under any one
order of all shingles, two sets whose similarity is at least t share one among the first n - ceil(t n) + 1 of each. The
order only bears on the cost: shingles that a sample of the texts shows to be common come last. Pairs that groups have
linked already aren't compared again. Sets that share dense buckets are compared in tiles, not as a table of pairs.

Candidates pass a filter of bitmaps first, which bounds what two sets share, then whole sets are compared. For both, the
texts of candidates are read again: one row for each set and partner is shuffled, and no text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, mix, spans_hash, steps, table, tidy
from foliant.llm.components import components
from foliant.llm.simhash import near_links, one_of_each, row_key

SHINGLE = 5
SIMILARITY = 0.8
#: One of so many texts, by hash, is read for the order of shingles, copies once a task; at most COMMON shingles that are
#: in SEEN of them or more come last.
SAMPLE, SEEN, COMMON = 32, 2, 200_000
#: Rows (sets to compare, or sets that groups hold) up to which a table is broadcast.
BROADCAST_IDS = 300_000
#: Entries (shingle of a set) that one part of the buckets has on average, and sets that are dealt out at a time.
PART_ENTRIES, DEALT_SETS = 500_000, 2000
#: Sets in a bucket up to which the task that gathers it pairs them. Larger buckets are joined by Spark, or compared by tiles
#: if they are dense: their sets have over DENSE possible partners on average, as about PROBED of them show.
BUCKET, DENSE, PROBED = 16, 32, 64
#: Sets, and shingles of them, in a tile.
TILE_SETS, TILE_SHINGLES = 1024, 2_000_000
#: Bytes of sets that a worker hands on at a time.
SENT_BYTES = 8_000_000
#: Partners of a set that one task compares with it, on average.
PARTNERS = 512


def shingle_sets(texts: list[str | None], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles (hashes) of all texts, by text and hash, and where each text's begin (and the end)."""
    split = [(t or "").lower().split() for t in texts]
    counts = np.array([len(w) for w in split], dtype=np.int64)
    data = " ".join([" ".join(w) for w in split if w]).encode()
    values = np.frombuffer(data, dtype=np.uint8)
    gaps = np.flatnonzero(values == 0x20)
    first, last = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(values)]))
    begins = np.concatenate(([0], np.cumsum(counts)))
    made = np.where(counts > 0, np.maximum(1, counts - shingle + 1), 0)
    text = np.repeat(np.arange(len(texts)), made)
    at = np.arange(len(text)) - np.repeat(np.cumsum(made) - made, made) + begins[text]
    end = at + np.minimum(shingle, counts)[text] - 1
    hashes = spans_hash(values, first[at], last[end]) if len(at) else np.zeros(0, dtype=np.uint64)
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    fresh = np.ones(len(text), dtype=bool)
    fresh[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    text, hashes = text[fresh], hashes[fresh]
    return hashes, np.searchsorted(text, np.arange(len(texts) + 1))


def set_ids(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A number for each set, equal for equal sets; 0 for the empty set."""
    sums = []
    for salt in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(hashes ^ np.uint64(salt)), dtype=np.uint64)))
        sums.append(total[bounds[1:]] - total[bounds[:-1]])
    return np.where(np.diff(bounds) > 0, mix(sums[0] + mix(sums[1])), np.uint64(0))


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64), pa.int64())


def unseen(ids: pa.Array, seen: set[int]) -> list[int]:
    """Rows whose id a task meets for the first time, which it notes in ``seen``."""
    return [k for k, i in enumerate(ids.to_pylist()) if i not in seen and not seen.add(i)]


def _batches(docs: DataFrame, columns: list[str], shingle: int, finish, schema: str) -> DataFrame:
    """``columns`` of ``docs`` and what ``finish(hashes, bounds)`` makes of the texts' sets. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "__text"):
                made = finish(*shingle_sets(part.column("__text").to_pylist(), shingle))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *made.values()], [*columns, *made])

    rows = docs.select(*columns, F.col("text").alias("__text"))
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text"]
    return rows.mapInArrow(tidy(run), ", ".join([*own, schema]))


def fingerprints(hashes: np.ndarray, bounds: np.ndarray, block: int = 65_536) -> np.ndarray:
    """The SimHash of each set: bits that are set in over half of its shingles' hashes; 0 for the empty set."""
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    sums = np.zeros((len(sizes), 64), dtype=np.int64)
    for k in range(0, len(hashes), block):
        bits = np.unpackbits(hashes[k : k + block].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = text[k : k + block]
        heads = np.flatnonzero(np.diff(own, prepend=-1))
        sums[own[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    return np.packbits(2 * sums > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def bitmap(hashes: np.ndarray) -> bytes:
    """A bit for each shingle, by the hash's upper half, in four to eight bits a shingle (a power of two, 64 at least)."""
    size = 1 << max(6, int(4 * len(hashes) - 1).bit_length())
    bits = np.zeros(size, dtype=np.uint8)
    bits[((hashes >> np.uint64(32)) & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def shared_at_most(x: bytes, n: int, y: bytes, m: int) -> int:
    """How many shingles sets of n and m can share, by their bitmaps: a bit that only one has is a shingle of its own."""
    a, b = np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)
    size = min(len(a), len(b))
    a, b = (np.bitwise_or.reduce(z.reshape(-1, size), 0) for z in (a, b))
    return min(n - int(np.bitwise_count(a & ~b).sum(dtype=np.int64)), m - int(np.bitwise_count(b & ~a).sum(dtype=np.int64)))


def common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """Hashes of common shingles, the rarest first, as the sample shows them. Bounded by COMMON."""
    sample = docs.select("text", F.xxhash64("text").alias("__t")).where(F.pmod("__t", F.lit(SAMPLE)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in steps(batch, "text"):
                part = part.take(pa.array(unseen(part.column("__t"), seen), pa.int64()))
                found, counts = np.unique(shingle_sets(part.column("text").to_pylist(), shingle)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([longs(found), pa.array(counts, pa.int64())], ["h", "n"])

    counted = sample.mapInArrow(tidy(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    most = counted.where(F.col("n") >= SEEN).orderBy(F.desc("n"), "h").limit(COMMON).select("h").toArrow()
    return np.array(most.column("h"), dtype=np.int64).view(np.uint64)[::-1]


def with_prefix(docs: DataFrame, columns: list[str], shingle: int, similarity: float) -> DataFrame:
    """``columns`` of ``docs``, the set's number __s, size __n and fingerprint __fp, and its first shingles __prefix in the common order."""
    common = common_shingles(docs, shingle)
    by_hash = np.argsort(common)
    known, rank = common[by_hash], (by_hash + 1).astype(np.int64)

    def finish(hashes: np.ndarray, bounds: np.ndarray) -> dict[str, pa.Array]:
        sizes = np.diff(bounds)
        text = np.repeat(np.arange(len(sizes)), sizes)
        late = np.zeros(len(hashes), dtype=np.int64)
        if len(known) and len(hashes):
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            late = np.where(known[at] == hashes, rank[at], 0)
        ordered = hashes[np.lexsort((hashes, late, text))]
        keep = np.where(sizes > 0, sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1, 0)
        chosen = np.arange(len(hashes)) - bounds[:-1][text] < keep[text]
        ends = np.concatenate(([0], np.cumsum(keep)))
        return {
            "__s": longs(set_ids(hashes, bounds)), "__n": pa.array(sizes, pa.int64()),
            "__fp": longs(fingerprints(hashes, bounds)), "__prefix": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), longs(ordered[chosen])),
        }

    return _batches(docs, columns, shingle, finish, "__s long, __n long, __fp long, __prefix array<long>")


def least_shared(n: np.ndarray | Column, similarity: float) -> np.ndarray | Column:
    """Shingles that two similar sets of ``n`` in all share at least."""
    return (F.ceil if isinstance(n, Column) else np.ceil)(n * (similarity / (1 + similarity)) - 1e-9)


def _sent(roles: DataFrame, docs: DataFrame, heads: DataFrame, shingle: int, exact: bool) -> DataFrame:
    """(task, side, s, c, n, shown): each set __i, or its bitmap, once for each task of its array __roles (task, side, c), by
    task and side. ``heads``: a row of ``docs`` for each set, by its key. Texts are read again and not shuffled, unless the
    sets are too many to broadcast their keys."""
    need = cut(heads.join(roles, heads["__s"] == roles["__i"]).select("__s", F.col("__k").alias("__key"), "__roles"))
    need = F.broadcast(need) if need.count() <= BROADCAST_IDS else need
    rows = docs.select("text", row_key().alias("__k"))
    own = rows.join(need, rows["__k"] == need["__key"]).select("__s", "__roles", "text")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # rows that repeat a text give its set once a task
        for batch in batches:
            for part in steps(batch, "text"):
                fresh = unseen(part.column("__s"), sent)
                if not fresh:
                    continue
                part = part.take(pa.array(fresh))
                hashes, bounds = shingle_sets(part.column("text").to_pylist(), shingle)
                own = [hashes[i:j] for i, j in zip(bounds, bounds[1:])]
                lists = part.column("__roles")
                at = np.repeat(np.arange(len(own)), np.asarray(lists.value_lengths()))
                each, named = lists.flatten(), part.column("__s").take(pa.array(at))
                shown = [h.tobytes() if exact else bitmap(h) for h in own]
                filled = np.cumsum(np.array([len(x) for x in shown])[at]) // SENT_BYTES
                for k in np.split(np.arange(len(at)), np.flatnonzero(np.diff(filled)) + 1):
                    task, side, c = (each.field(x).take(pa.array(k)) for x in ("task", "side", "c"))
                    columns = [task, side, named.take(pa.array(k)), c, pa.array([len(own[i]) for i in at[k]], pa.int64()), pa.array([shown[i] for i in at[k]], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["task", "side", "s", "c", "n", "shown"])

    sent = own.mapInArrow(tidy(send), "task long, side int, s long, c long, n long, shown binary")
    return sent.repartition("task").sortWithinPartitions("task", "side")


def _alike(pairs: DataFrame, docs: DataFrame, heads: DataFrame, shingle: int, similarity: float, exact: bool) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are similar; if not ``exact``, all of them and others that bitmaps can't tell
    apart. A set goes once to the task of each partner that it is compared with; a set with very many partners has a task
    for each PARTNERS of them."""
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > PARTNERS)
    many = cut(many.select(F.col("a").alias("__a"), F.ceil(F.col("__n") / PARTNERS).alias("__parts")))
    part = F.lit(0).cast("long")
    if many.limit(1).count():
        pairs = pairs.join(many, pairs["a"] == many["__a"], "left")
        part = F.coalesce(F.pmod(F.xxhash64("b"), "__parts"), part)
    role = lambda side: F.struct(F.xxhash64("a", part).alias("task"), F.lit(side).alias("side"), F.col("a").alias("c"))
    roles = pairs.select(F.col("a").alias("__i"), role(0).alias("r")).union(pairs.select("b", role(1)))
    roles = roles.groupBy("__i").agg(F.collect_set("r").alias("__roles"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first row of each task is the set that all others are compared with."""
        now, other, n, head = None, None, 0, b""
        for batch in batches:
            a, b = [], []
            for k, (task, side, s, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("task", "side", "s", "n")))):
                shown = batch.column("shown")[k].as_py()
                if side == 0:
                    now, n, head = (task, s), size, shown
                    other = np.frombuffer(head, dtype=np.uint64) if exact else None
                else:
                    shared = len(np.intersect1d(other, np.frombuffer(shown, dtype=np.uint64), assume_unique=True)) if exact else shared_at_most(head, n, shown, size)
                    if shared >= similarity * (n + size - shared) - 1e-9:
                        a.append(now[1])
                        b.append(s)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return cut(_sent(roles, docs, heads, shingle, exact).mapInArrow(tidy(meet), "a long, b long"))


def linked(ids: list[int], groups: list[int], sides: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Similar pairs of sets that link all that are similar, in and across their groups: of one tile (all of side 0), or
    across two. Pairs that are linked already aren't compared; of the others, bitmaps in one matrix rule out most."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    sizes = np.array([len(h) for h in sets])
    width = 1 << int(np.clip(int(4 * np.median(sizes)) - 1, 63, 8191)).bit_length()
    bits = np.zeros((len(sets), width), dtype=np.uint8)
    bits[np.repeat(np.arange(len(sets)), sizes), (np.concatenate(sets) >> np.uint64(32)).astype(np.int64) & (width - 1)] = 1
    maps = np.packbits(bits, axis=1).view(np.uint64)
    ones = bits.sum(1, dtype=np.int64)
    left = [k for k, x in enumerate(sides) if x == 0]
    right = np.array([k for k, x in enumerate(sides) if x == 1], dtype=np.int64)
    out = []
    for place, i in enumerate(left):
        others = right if len(right) else np.array(left[place + 1 :], dtype=np.int64)
        if not len(others):
            continue
        both = np.bitwise_count(maps[others] & maps[i]).sum(1, dtype=np.int64)
        shared = np.minimum(sizes[i] - (ones[i] - both), sizes[others] - (ones[others] - both))
        for j in others[shared >= similarity * (sizes[i] + sizes[others] - shared) - 1e-9].tolist():
            a, b = top(groups[i]), top(groups[j])
            if a == b:
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if common >= similarity * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                root[a] = b
                out.append((ids[i], ids[j]))
    return out


def clustered_links(large: DataFrame, docs: DataFrame, heads: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) among sets that share dense buckets. ``large``: __key, __s, __n and group __c of each entry. Buckets that
    share sets are one cluster, which is compared in pairs of tiles; so a set is sent once for each tile of its cluster,
    however many buckets and partners it has."""
    both = large.select(F.col("__s").alias("a"), F.xxhash64(F.lit(9), "__key").alias("b"))
    named = components(both).withColumnsRenamed({"node": "__node", "component": "__cluster"})
    sets = large.groupBy("__s").agg(F.min("__n").alias("__n"), F.min("__c").alias("__c"))
    own = cut(sets.join(named, sets["__s"] == named["__node"]).select("__s", "__n", "__c", "__cluster"))
    tiles = F.greatest(F.ceil(F.count(F.lit(1)) / TILE_SETS), F.ceil(F.sum("__n") / TILE_SHINGLES)).alias("__tiles")
    sizes = own.groupBy("__cluster").agg(tiles).withColumnRenamed("__cluster", "__h")
    dealt = own.join(sizes, own["__cluster"] == sizes["__h"]).withColumn("__mine", F.pmod(F.xxhash64("__s"), "__tiles"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__tiles") - 1)))
    task = F.xxhash64("__cluster", F.least("__mine", "__other"), F.greatest("__mine", "__other")).alias("task")
    role = F.struct(task, (F.col("__mine") > F.col("__other")).cast("int").alias("side"), F.col("__c").alias("c"))
    roles = dealt.groupBy(F.col("__s").alias("__i")).agg(F.collect_set(role).alias("__roles"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, int, np.ndarray]] = {}
        now = None

        def spend() -> Iterator[pa.RecordBatch]:
            found = linked(list(held), *(list(x) for x in zip(*held.values())), similarity)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

        for batch in batches:
            for k, (task, side, s, c) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("task", "side", "s", "c")))):
                if held and task != now:
                    yield from spend()
                    held = {}
                now = task
                held[s] = (c, side, np.frombuffer(batch.column("shown")[k].as_py(), dtype=np.uint64))
        if held:
            yield from spend()

    return cut(_sent(roles, docs, heads, shingle, True).mapInArrow(tidy(meet), "a long, b long"))


def similar(pairs: DataFrame, docs: DataFrame, heads: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are similar. ``pairs`` is kept and holds each pair once."""
    return _alike(_alike(pairs, docs, heads, shingle, similarity, False), docs, heads, shingle, similarity, True)


def buckets(prints: DataFrame, parts: int, similarity: float) -> DataFrame:
    """Sets that share a shingle of their prefixes and are in different groups __c: pairs (__s, __o) whose sizes and
    positions allow the similarity, from buckets of up to BUCKET sets (__key null); of larger ones the entries, with __o 1
    if the bucket is dense, else 0.

    The entries are dealt out once, packed by part (a share of the shingles); most have no partner and end there. Rows
    with the same set are dealt once a task.
    """
    names = ["__key", "__s", "__n", "__p", "__c"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt: set[int] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, DEALT_SETS):
                part = batch.slice(start, DEALT_SETS)
                part = part.take(pa.array(unseen(part.column("__s"), dealt), pa.int64()))
                prefix = part.column("__prefix")
                keys = prefix.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = np.array(prefix.value_lengths().fill_null(0), dtype=np.int64)
                if not len(keys):
                    continue
                own = np.repeat(np.arange(len(sizes)), sizes)
                at = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                where = (keys.view(np.uint64) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                edges = np.flatnonzero(np.diff(where[order], prepend=-1))
                ends = pa.array([*edges.tolist(), len(keys)], pa.int32())
                s, n, c = (np.asarray(part.column(x).to_numpy(zero_copy_only=False), dtype=np.int64)[own] for x in ("__s", "__n", "__c"))
                columns = [(keys, pa.int64()), (s, pa.int64()), (n, pa.int32()), (at, pa.int32()), (c, pa.int64())]
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[order], kind)) for x, kind in columns]
                yield pa.RecordBatch.from_arrays([pa.array(where[order][edges], pa.int32()), *lists], ["__part", *names])

    def meet(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, s, n, at, c = (np.concatenate([b.column(x).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for b in held]) for x in names)
        order = np.lexsort((s, key))
        order = order[np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (s[order][1:] != s[order][:-1])))]
        key, s, n, at, c = key[order], s[order], n[order], at[order], c[order]
        bounds = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        sizes = np.diff(bounds)
        mixed = np.minimum.reduceat(c, bounds[:-1]) != np.maximum.reduceat(c, bounds[:-1])
        small = np.flatnonzero(np.repeat(mixed & (sizes <= BUCKET), sizes))
        for k in np.flatnonzero(mixed & (sizes > BUCKET)):
            own = slice(bounds[k], bounds[k + 1])
            # how many partners an entry has on average, from some of them: this decides how they are compared, not what
            some = np.arange(bounds[k], bounds[k + 1], max(1, sizes[k] // PROBED))
            fits = np.minimum((n - at)[some][:, None], (n - at)[own][None]) >= least_shared(n[some][:, None] + n[own][None], similarity)
            dense = int((fits & (c[some][:, None] != c[own][None])).sum() > DENSE * len(some))
            columns = [pa.array(x[own], pa.int64()) for x in (key, s, n, at, c)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(sizes[k], dense), pa.int64())], [*names, "__o"])
        found = []
        for step in range(1, BUCKET):
            i, j = small[:-step], small[step:]
            i, j = (x[(key[i] == key[j]) & (c[i] != c[j])] for x in (i, j))
            fits = np.minimum(n[i] - at[i], n[j] - at[j]) >= least_shared(n[i] + n[j], similarity)
            found.append(np.stack((s[i][fits], s[j][fits]), 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        if len(pairs):
            none = pa.nulls(len(pairs), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(pairs[:, 0], pa.int64()), none, none, none, pa.array(pairs[:, 1], pa.int64())], [*names, "__o"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            part = batch.column("__part").to_numpy(zero_copy_only=False)
            edges = [*np.flatnonzero(np.diff(part, prepend=part[0] - 1)).tolist(), len(part)]
            for s, e in zip(edges, edges[1:]):
                if held and held[0].column("__part")[0].as_py() != part[s]:
                    yield from meet(held)
                    held = []
                held.append(batch.slice(s, e - s))
        if held:
            yield from meet(held)

    dealt = prints.mapInArrow(tidy(deal), "__part int, __key array<long>, __s array<long>, __n array<int>, __p array<int>, __c array<long>")
    return dealt.repartition("__part").sortWithinPartitions("__part").mapInArrow(tidy(run), ", ".join(f"{c} long" for c in [*names, "__o"]))


def grouped_pairs(heads: DataFrame) -> DataFrame:
    """(a, b): each set of a SimHash group with the set that is nearest to the group's majority of bits (of equally near
    ones the least); sets with one fingerprint are a group, too."""
    prints = cut(heads.select("__fp").distinct())
    found = components(near_links(prints, prints.count()), forests=True)
    own = cut(heads.join(found, heads["__fp"] == found["node"], "left").select("__s", "__fp", F.coalesce("component", "__fp").alias("__g")))
    ones = [F.sum(F.shiftright("__fp", k).bitwiseAND(F.lit(1))).alias(f"__{k}") for k in range(64)]
    some = own.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"), *ones).where("__n > 1")
    most = F.lit(0).cast("long")
    for k in range(64):
        most = most.bitwiseOR(F.when(2 * F.col(f"__{k}") > F.col("__n"), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    some = cut(some.select(F.col("__g").alias("__h"), most.alias("__most")))
    far = F.bit_count(F.col("__fp").bitwiseXOR(F.col("__most")))
    near = own.join(some, own["__g"] == some["__h"]).groupBy("__h").agg(F.min(F.struct(far.alias("far"), "__s")).alias("m")).select("__h", F.col("m.__s").alias("a"))
    return cut(own.join(near, own["__g"] == near["__h"]).where("__s <> a").select("a", F.col("__s").alias("b")))


def similar_links(prints: DataFrame, docs: DataFrame, heads: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) between sets: their components are those of all pairs of sets that are similar."""
    links = _alike(grouped_pairs(heads), docs, heads, shingle, similarity, True)
    found = components(links).withColumnsRenamed({"node": "__node", "component": "__in"})
    found = F.broadcast(found) if links.count() <= BROADCAST_IDS else found
    sets = prints.join(found, prints["__s"] == F.col("__node"), "left").select("__s", "__n", "__prefix", F.coalesce("__in", "__s").alias("__c"))
    entries = prints.agg(F.sum(F.size("__prefix"))).first()[0] or 0
    posts = table(buckets(sets, max(1, -(-entries // PART_ENTRIES)), similarity))
    pairs = posts.where("__key IS NULL").select(F.col("__s").alias("a"), F.col("__o").alias("b"))
    large = posts.where("__key IS NOT NULL")
    x, y = large.where("__o = 0").alias("x"), large.where("__o = 0").alias("y")
    room = F.least(F.col("x.__n") - F.col("x.__p"), F.col("y.__n") - F.col("y.__p"))
    fits = room >= least_shared(F.col("x.__n") + F.col("y.__n"), similarity)
    on = (F.col("x.__key") == F.col("y.__key")) & (F.col("x.__s") < F.col("y.__s")) & (F.col("x.__c") != F.col("y.__c")) & fits
    pairs = cut(pairs.union(x.join(y, on).select("x.__s", "y.__s")).distinct())
    links = links.union(similar(pairs, docs, heads, shingle, similarity))
    dense = large.where("__o = 1")
    return links.union(clustered_links(dense, docs, heads, shingle, similarity)) if dense.limit(1).count() else links


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each group of near copies: the one with the least doc_id (null last), of these the one with
    the least hash of its text, and of rows alike in both any one.

    Texts whose sets have at least this Jaccard similarity link, and groups are what links reach. Texts with equal sets
    meet as one row before anything is compared. Texts without words (null, empty, white space) are one group. An empty
    table gives an empty result. A very long text is one set like any other. Columns of ``docs`` stay as they are; names
    that begin with two underscores are the operator's.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("__t"), row_key().alias("__k"), "text")
    prints = table(with_prefix(rows, ["doc_id", "__t", "__k"], shingle, similarity))
    heads = table(prints.groupBy("__s").agg(F.min("__k").alias("__k"), F.min("__fp").alias("__fp")))
    named = components(similar_links(prints, docs, heads, shingle, similarity))
    own = prints.join(named, prints["__s"] == named["node"], "left")
    return one_of_each(docs, own.select("doc_id", "__t", "__k", F.coalesce("component", "__s").alias("__c")))
