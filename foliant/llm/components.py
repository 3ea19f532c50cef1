"""Connected components of a table of links, without bringing links or components to one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, forget, tidy

#: Links that one step of the local contraction holds at most, and up to which one task finds all components.
STEP_LINKS = 200_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, least member) of the components of links (a, b): fewer than there are members."""
    if not len(a):
        return a, b
    members, code = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    root = np.arange(len(members))
    while True:
        low = np.minimum(root[x], root[y])
        fresh = root.copy()
        np.minimum.at(fresh, root[x], low)
        np.minimum.at(fresh, root[y], low)
        while not np.array_equal(fresh, fresh[fresh]):
            fresh = fresh[fresh]
        if np.array_equal(fresh, root):
            break
        root = fresh
    own = root != np.arange(len(members))
    return members[own], members[root[own]]


def contract(links: DataFrame) -> DataFrame:
    """Links (a, b) of whole numbers in which each step of each task keeps a spanning forest of its own, a > b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def spend() -> Iterator[pa.RecordBatch]:
            a, b = forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)))
            size += batch.num_rows
            if size >= STEP_LINKS:
                yield from spend()
                held, size = [], 0
        if size:
            yield from spend()

    return links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(tidy(run), "a long, b long")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of every node of all links that a task gets."""
    held = [[batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1)] for batch in batches]
    if held:
        node, root = forest(*(np.concatenate(x) for x in zip(*held)))
        tops = np.unique(root)
        columns = [np.concatenate((node, tops)), np.concatenate((root, tops))]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["node", "component"])


def components(links: DataFrame, forests: bool = False) -> DataFrame:
    """(node, component) for every node of the links (a, b), whole numbers: component is the least node reachable.
    ``forests``: the links of each task are a spanning forest already.

    Up to STEP_LINKS links, as counted after tasks have contracted their own, are one task's work. Beyond, two steps
    alternate until nothing changes: every node links its greater neighbours to the least one, then its lesser
    neighbours to the least one (large star, small star). Each round is kept in the shared folder, so a lost executor
    costs no earlier round. Rounds are few: about the logarithm of the longest chain. The steps need the least neighbour
    of a node alone, an aggregate that tasks prepare before the shuffle; the joins are split by Spark where a node has
    very many links. Links of a node to itself and repeated links do no harm; nulls must not occur.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut((links if forests else contract(links)).distinct())
    if edges.count() <= STEP_LINKS:
        return edges.coalesce(1).mapInArrow(tidy(_whole), "node long, component long")
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        # large star: the greater neighbours a of b link to the least of b and its neighbours
        large = edges.join(least, edges["b"] == least["n"]).select(F.col("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the lesser neighbours of a, and a, link to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        moved = large.join(low, large["a"] == low["n"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = contract(moved.union(low.select("n", "m"))).distinct()
        fresh = cut(small)
        # done when every node has one link, to a node without any
        state = fresh.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("a").alias("d")).first()
        tops = fresh.select(F.col("b").alias("t")).distinct()
        chained = fresh.join(tops, fresh["a"] == tops["t"], "left_semi").limit(1).count()
        forget(edges)
        edges = fresh
        if state["n"] == state["d"] and not chained:
            break
    tops = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops)
