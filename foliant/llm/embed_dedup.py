"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are compared only within a label. Equal vectors meet as one. A PCA, fitted on a bounded sample, orders the
dimensions of the unit vectors by variance. Two unit vectors with cosine c are sqrt(2 - 2c) apart, and so are, at most,
their leading dimensions. A label is compared as a tile, or, if it has more vectors than that, as pairs of tiles that are
compact in the leading dimensions; pairs of tiles whose boxes lie too far apart are dropped before any vector is sent. In a
tile, blocks of vectors are dropped by their boxes in the same way. What remains is compared step by step: products of the
leading dimensions first, bounded by the suffix norms of the rest, and a pair is dropped as soon as its bound is below the
threshold. What is left is decided by the cosine of the vectors as given, in double precision.

Sample, tiles and blocks decide what is compared together, never what links: every pair at or above the threshold is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from foliant.llm.common import cut, table, tidy
from foliant.llm.components import components, forest

THRESHOLD = 0.98
#: Vectors that PCA and tiles are fitted on at most.
SAMPLE = 20_000
#: Vectors in a tile and in a block.
TILE, BLOCK = 8192, 128
#: Sampled vectors in a cell at least, and cells in a tile of the largest label; tiles are put together from cells.
CELL_SAMPLE, CELLS_PER_TILE = 8, 4
#: Leading dimensions that boxes have, and the steps in which dimensions are added up.
LEADING, STEP = 16, 16
#: Rounding of single precision in boxes, of double precision in products.
LOOSE, SLACK = 1e-5, 1e-9
#: Labels that are larger than a tile up to which their table is broadcast.
BROADCAST_LABELS = 100_000


class Space(NamedTuple):
    """The rotation of one vector length, and a tree that halves the sample along its widest leading dimensions."""

    rotation: np.ndarray  # (d, d), columns by descending variance
    axes: np.ndarray  # by node, the children of k are 2k + 1 and 2k + 2
    edges: np.ndarray

    def cells(self, lead: np.ndarray) -> np.ndarray:
        """The leaf that each vector falls in, from 0, in depth-first order: neighbouring numbers are neighbours."""
        at = np.zeros(len(lead), dtype=np.int64)
        rows = np.arange(len(lead))
        for _ in range(int(np.log2(len(self.axes) + 1))):
            at = 2 * at + 1 + (lead[rows, self.axes[at]] >= self.edges[at])
        return at - len(self.axes)


def units(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision. Scaling by the largest component first keeps the squares in range."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def fit_space(sample: np.ndarray, cells: int) -> Space:
    """``sample``: unit vectors; ``cells``: how many are wanted, as far as the sample goes."""
    d = sample.shape[1]
    _, rotation = np.linalg.eigh(sample.T @ sample / max(1, len(sample)) - np.outer(sample.mean(0), sample.mean(0)))
    rotation = np.ascontiguousarray(rotation[:, ::-1])
    lead = sample @ rotation[:, : min(LEADING, d)]
    depth = int(np.ceil(np.log2(max(1, min(cells, len(sample) // CELL_SAMPLE)))))
    axes, edges = np.zeros(2**depth - 1, dtype=np.int64), np.zeros(2**depth - 1)
    groups = [np.arange(len(sample))]
    for k in range(2**depth - 1):
        own = lead[groups[k]]
        if len(own):
            axes[k] = int((own.max(0) - own.min(0)).argmax())
            edges[k] = float(np.median(own[:, axes[k]]))
        right = own[:, axes[k]] >= edges[k]
        groups += [groups[k][~right], groups[k][right]]
        groups[k] = groups[k][:0]
    return Space(rotation, axes, edges)


def blocks(lead: np.ndarray, size: int = BLOCK) -> list[np.ndarray]:
    """Rows in blocks of at most ``size``, halved along the widest dimension again and again."""
    out, left = [], [np.arange(len(lead))]
    while left:
        rows = left.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        own = lead[rows]
        order = np.argsort(own[:, (own.max(0) - own.min(0)).argmax()], kind="stable")
        left += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


def box_gaps(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> np.ndarray:
    """Squared distances between one box and others."""
    gap = np.maximum(0, np.maximum(low2 - high, low - high2))
    return np.einsum("ij,ij->i", gap, gap)


def close_pairs(x: np.ndarray, y: np.ndarray | None, rotation: np.ndarray, threshold: float = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with cosine(x[i], y[j]) >= threshold, in parts; without ``y`` those of i < j within x. ``x`` and ``y`` as
    given, in double precision."""
    alone = y is None
    y = x if alone else y
    p = units(x) @ rotation
    q = p if alone else units(y) @ rotation
    d = p.shape[1]
    first = min(STEP, d)
    reach2 = max(0.0, 2 - 2 * threshold) + LOOSE

    def suffixes(z: np.ndarray) -> list[np.ndarray]:
        return [np.sqrt(np.einsum("ij,ij->i", z[:, at:], z[:, at:])) for at in [*range(first, d, STEP), d]]

    tails_p = suffixes(p)
    tails_q = tails_p if alone else suffixes(q)
    norms_x, norms_y = (np.sqrt(np.einsum("ij,ij->i", z, z)) for z in (x, y))
    own, other = blocks(p[:, :first]), blocks(q[:, :first])
    low, high = (np.array([f(q[rows, :first], axis=0) for rows in other]) for f in (np.min, np.max))
    for rows in own:
        lead = p[rows, :first]
        near = np.flatnonzero(box_gaps(lead.min(0), lead.max(0), low, high) <= reach2)
        if not len(near):
            continue
        cols = np.concatenate([other[k] for k in near])
        part = lead @ q[cols, :first].T
        i, j = np.nonzero(part + tails_p[0][rows][:, None] * tails_q[0][cols][None] >= threshold - SLACK)
        sums = part[i, j]
        i, j = rows[i], cols[j]
        if alone:
            one = i < j
            i, j, sums = i[one], j[one], sums[one]
        for step, at in enumerate(range(first, d, STEP), 1):
            if not len(i):
                break
            end = min(at + STEP, d)
            sums = sums + np.einsum("ij,ij->i", p[i, at:end], q[j, at:end])
            live = sums + tails_p[step][i] * tails_q[step][j] >= threshold - SLACK
            i, j, sums = i[live], j[live], sums[live]
        if len(i):  # the cosine itself, of what is left
            exact = np.einsum("ij,ij->i", x[i], y[j]) / (norms_x[i] * norms_y[j]) >= threshold
            yield i[exact], j[exact]


def valid(vectors: DataFrame) -> DataFrame:
    """Vectors that can link: with a label, and finite, not all zero, without null components."""
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.where("label IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0").where(finite).where(F.exists(e, lambda v: v != 0))


def _tiles(classes: DataFrame, big: DataFrame, spaces: dict[int, Space], reach2: float, tile: int) -> DataFrame:
    """Vectors of labels that are larger than a tile, once for each pair of tiles (t1, t2) within reach that they are in;
    ``side`` 0 for t1. ``big``: __l, __d and __tiles of these labels."""
    leading = {d: min(LEADING, d) for d in spaces}
    width = max([*leading.values(), 1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                tiles = part.column("__tiles").to_numpy()
                if d in spaces:
                    x = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
                    lead = (units(x) @ spaces[d].rotation)[:, : leading[d]]
                    at = spaces[d].cells(lead) * tiles // (len(spaces[d].axes) + 1)
                else:  # a length that the sample lacks: one box
                    lead, at = np.zeros((part.num_rows, 0)), np.zeros(part.num_rows, dtype=np.int64)
                padded = np.zeros((part.num_rows, width), dtype=np.float32)
                padded[:, : lead.shape[1]] = lead
                boxed = [pa.array(at), *(pa.array(padded[:, k]) for k in range(width))]
                kept = ("label", "dim", "c", "n", "embedding")
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *boxed], [*kept, "tile", *(f"x{k}" for k in range(width))])

    some = classes.join(big, F.col("label").eqNullSafe(F.col("__l")) & (F.col("dim") == F.col("__d"))).select("label", "dim", "c", "n", "embedding", "__tiles")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in some.schema if f.name != "__tiles")
    placed = table(some.mapInArrow(tidy(place), f"{kinds}, tile long, " + ", ".join(f"x{k} float" for k in range(width))))
    # a cell of the sample may hold more vectors than a tile does
    counts = placed.groupBy("label", "dim", "tile").agg(F.ceil(F.count(F.lit(1)) / tile).alias("__parts"))
    counts = counts.select(F.col("label").alias("__l"), F.col("dim").alias("__d"), F.col("tile").alias("__t"), "__parts")
    placed = placed.join(counts, (F.col("label") == F.col("__l")) & (F.col("dim") == F.col("__d")) & (F.col("tile") == F.col("__t")))
    own = F.struct("tile", F.pmod(F.xxhash64("c"), F.col("__parts")).alias("part"))
    placed = placed.withColumn("t", own).drop("__l", "__d", "__t", "__parts", "tile")
    edges = [f(f"x{k}").alias(f"{name}{k}") for k in range(width) for f, name in ((F.min, "low"), (F.max, "high"))]
    boxes = cut(placed.groupBy("label", "dim", "t").agg(*edges))
    x, y = boxes.alias("x"), boxes.alias("y")
    gaps = [F.greatest(F.lit(0.0), F.col(f"y.low{k}") - F.col(f"x.high{k}"), F.col(f"x.low{k}") - F.col(f"y.high{k}")) for k in range(width)]
    apart = sum((g * g for g in gaps), F.lit(0.0))
    same = (F.col("x.label") == F.col("y.label")) & (F.col("x.dim") == F.col("y.dim"))
    pairs = cut(x.join(y, same & (F.col("x.t") <= F.col("y.t")) & (apart <= reach2 + LOOSE)).select(F.col("x.label").alias("__l"), F.col("x.dim").alias("__d"), F.col("x.t").alias("t1"), F.col("y.t").alias("t2")))
    sides = pairs.select("*", F.col("t1").alias("__t"), F.lit(0).alias("side")).union(pairs.where("t1 <> t2").select("*", F.col("t2").alias("__t"), F.lit(1).alias("side")))
    sent = placed.join(sides, (F.col("label") == F.col("__l")) & (F.col("dim") == F.col("__d")) & (F.col("t") == F.col("__t")))
    return sent.select("label", "dim", "t1", "t2", "side", "c", "n", "embedding")


def link(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, tile: int = TILE) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id and kept.

    Vectors that are null, empty, zero, or hold null or non-finite components, and those without a label, link with
    nothing. Vectors of different lengths have no cosine and don't link; a very long one is one row like any other.
    Repeated rows are vectors of their own, linked as equal vectors are; of vectors that tie for the least vec_id in a
    component each is kept. A null vec_id counts as a link's end and is never a component's least. An empty table gives
    an empty result. Other columns are not read, so clashing names do no harm. Columns: vec_id whole number, embedding
    array of numbers, label of any type.

    Equal vectors are grouped before anything else, so a very common vector is one row for the tasks that compare.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    if not isinstance(rows.schema["embedding"].dataType.elementType, (FloatType, DoubleType)):
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    keyed = F.struct("label", "embedding")
    good = valid(rows)
    classes = table(
        good.groupBy("label", "embedding")
        .agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low"))
        .withColumn("code", F.xxhash64(keyed))
        .withColumn("code2", F.xxhash64(F.lit(5), keyed))
        .withColumn("dim", F.size("embedding"))
    )
    # a number for each class: positions in the shared table are fixed once it is written
    classes = cut(classes.withColumn("c", F.monotonically_increasing_id()))
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / tile).alias("__tiles")).where("__tiles > 1")
    big = cut(sizes.select(F.col("label").alias("__l"), F.col("dim").alias("__d"), "__tiles"))
    few, most = big.agg(F.count(F.lit(1)), F.coalesce(F.max("__tiles"), F.lit(1))).first()
    picked = classes.select("embedding", "dim", "code").orderBy("code").limit(sample).toArrow()
    groups: dict[int, list] = {}
    for e, d in zip(picked.column("embedding").to_pylist(), picked.column("dim").to_pylist()):
        groups.setdefault(d, []).append(e)
    spaces = {d: fit_space(units(np.array(v, dtype=float)), most * CELLS_PER_TILE) for d, v in groups.items()}
    kept = ("label", "dim", "c", "n", "embedding")
    none = F.struct(F.lit(0).cast("long").alias("tile"), F.lit(0).cast("long").alias("part"))
    whole = classes.select(*kept)
    if few:
        shown = F.broadcast(big) if few <= BROADCAST_LABELS else big
        hot = _tiles(classes, shown, spaces, max(0.0, 2 - 2 * threshold), tile)
        whole = whole.join(shown, (F.col("label") == F.col("__l")) & (F.col("dim") == F.col("__d")), "left_anti")
    dealt = whole.select("label", "dim", none.alias("t1"), none.alias("t2"), F.lit(0).alias("side"), "c", "n", "embedding")
    dealt = dealt.union(hot) if few else dealt
    task = F.xxhash64("label", "dim", "t1", "t2")  # tasks whose hashes agree by chance are told apart below
    dealt = dealt.select(task.alias("task"), F.struct("label", "t1", "t2").cast("string").alias("name"), "dim", "side", "c", "n", "embedding")

    def links_of(d: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of a pair of tiles as rows (c, links found, component's least c in this pair)."""
        whole = pa.Table.from_batches(held).combine_chunks()
        side, c, n = (whole.column(k).to_numpy() for k in ("side", "c", "n"))
        x = np.concatenate([b.column("embedding").flatten().to_numpy(zero_copy_only=False) for b in held]).astype(float).reshape(-1, d)
        rotation = spaces[d].rotation if d in spaces else np.eye(d)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        counts = np.zeros(len(x), dtype=np.int64)
        left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for i, j in close_pairs(x[a], x[b] if len(b) else None, rotation, threshold):
            i, j = a[i], b[j] if len(b) else a[j]
            np.add.at(counts, i, n[j])
            np.add.at(counts, j, n[i])
            lesser = forest(np.maximum(c[i], c[j]), np.minimum(c[i], c[j]))
            left.append(lesser[0])
            right.append(lesser[1])
        u, v = forest(np.concatenate(left), np.concatenate(right))
        root = dict(zip(u.tolist(), v.tolist()))
        some = np.flatnonzero(counts)
        if len(some):
            roots = [root.get(k, k) for k in c[some].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c[some]), pa.array(counts[some]), pa.array(roots, pa.int64())], ["c", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in ("task", "name", "dim"))))
            start = 0
            for k in range(1, len(keys) + 1):
                if k < len(keys) and keys[k] == keys[start]:
                    continue
                if held and keys[start] != now:
                    yield from links_of(now[2], held)
                    held = []
                now = keys[start]
                held.append(batch.slice(start, k - start))
                start = k
        if held:
            yield from links_of(now[2], held)

    sent = dealt.repartition("task").sortWithinPartitions("task", "name", "dim")
    found = table(sent.mapInArrow(tidy(run), "c long, links long, root long"))
    groups_of = components(found.select(F.col("c").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "__n", "component": "__g"})
    links = found.groupBy("c").agg(F.sum("links").alias("__links")).withColumnRenamed("c", "__m")
    named = classes.join(groups_of, F.col("c") == F.col("__n"), "left").join(links, F.col("c") == F.col("__m"), "left")
    named = named.select("c", "code", "code2", "n", "low", F.coalesce("__g", "c").alias("group"), F.coalesce("__links", F.lit(0)).alias("links"))
    least = named.groupBy("group").agg(F.min("low").alias("component_id")).withColumnRenamed("group", "__h")
    final = named.join(least, F.col("group") == F.col("__h")).select("code", "code2", (F.col("n") - 1 + F.col("links")).alias("__total"), "component_id")
    # one row a class on the right; on the left, Spark splits the rows of a very common vector
    own = good.select(F.col("vec_id"), F.xxhash64(keyed).alias("__k"), F.xxhash64(F.lit(5), keyed).alias("__k2"))
    linked = own.join(final, (F.col("__k") == F.col("code")) & (F.col("__k2") == F.col("code2"))).select(
        "vec_id", F.col("__total").cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id")
    )
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fine = F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda v: v != 0)
    alone = rows.where(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
