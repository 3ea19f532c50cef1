"""Sharding by a hierarchical weighted hash tree. DataFrame functions only.

A document's key descends region, rack and shard. At each level every child draws ``-ln(u) / weight`` with u in (0, 1)
from a hash of the key and the child's name, and the least draw wins. A child is chosen in proportion to its weight, and
a change of one child's weight moves rows only into that child or out of it: the other children's draws stay as they
are. A weight that changes in one rack therefore moves rows only between that rack's region and others, and between
that rack and its neighbours.

Rows that enter an existing subtree spread over its old shards too. A shard that is added later therefore becomes a
region of its own, which makes the law ``key`` hold: one more shard takes rows only into itself.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of one shard that one task numbers at most, on average.
ROWS_PER_BUCKET = 500_000
#: Rows that are alike which one row becomes at a time.
ROWS_AT_ONCE = 10_000


@dataclass(frozen=True)
class Rack:
    name: str
    shards: tuple[tuple[int, float], ...]  # (shard number, weight)

    @property
    def weight(self) -> float:
        return sum(w for _, w in self.shards)


@dataclass(frozen=True)
class Region:
    name: str
    racks: tuple[Rack, ...]

    @property
    def weight(self) -> float:
        return sum(r.weight for r in self.racks)


def layout(n_shards: int, built: int = 40, per_rack: int = 4, racks: int = 2) -> tuple[Region, ...]:
    """Shards 0 to ``n_shards`` - 1 of weight 1. The first ``built`` fill regions of ``racks`` racks with ``per_rack``
    shards; each later one is a region of its own."""
    if n_shards < 1:
        raise ValueError("at least one shard is needed")
    first, regions, shard = min(built, n_shards), [], 0
    while shard < first:
        own = []
        for k in range(racks):
            numbers = range(shard, min(shard + per_rack, first))
            if numbers:
                own.append(Rack(f"{len(regions)}.{k}", tuple((s, 1.0) for s in numbers)))
                shard = numbers[-1] + 1
        regions.append(Region(str(len(regions)), tuple(own)))
    regions += [Region(f"s{s}", (Rack(f"s{s}.0", ((s, 1.0),)),)) for s in range(first, n_shards)]
    return tuple(regions)


def _uniform(key: Column, name: str) -> Column:
    """From the first 52 bits of MD5: (h + 0.5) / 2**52, inside (0, 1)."""
    digest = F.md5(F.concat(F.lit(f"{name}|"), key).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def _least(key: Column, children: list[tuple[str, float, int]]) -> Column:
    """The number of the child whose draw is least; of equal draws the lesser number's. A weight of 0 is never drawn."""
    drawn = [c for c in children if c[1] > 0]
    if len(drawn) == 1:
        return F.lit(drawn[0][2])
    draws = [F.struct((-F.log(_uniform(key, n)) / F.lit(float(w))).alias("d"), F.lit(i).alias("i")) for n, w, i in drawn]
    return F.array_min(F.array(*draws))["i"]


def shard_of(key: Column, regions: tuple[Region, ...]) -> tuple[list[tuple[str, Column]], list[str]]:
    """Column steps (name, expression) that descend the tree, to be added one after another; the last is the shard."""
    live = [r for r in regions if r.weight > 0]
    if not live:
        raise ValueError("all weights are 0")
    region = _least(key, [(f"region {r.name}", r.weight, i) for i, r in enumerate(regions)])
    rack, shard = F.lit(None).cast("int"), F.lit(None).cast("int")
    number = 0
    racks = []
    for i, r in enumerate(regions):
        if r.weight > 0:
            own = [(f"rack {x.name}", x.weight, number + j) for j, x in enumerate(r.racks)]
            rack = F.when(F.col("__region") == i, _least(key, own)).otherwise(rack)
        racks += r.racks
        number = len(racks)
    for j, x in enumerate(racks):
        if x.weight > 0:
            own = [(f"shard {x.name}.{s}", w, s) for s, w in x.shards]
            shard = F.when(F.col("__rack") == j, _least(key, own)).otherwise(shard)
    return [("__region", region), ("__rack", rack), ("__shard", shard)], ["__region", "__rack", "__shard"]


def assign_shards(docs: DataFrame, regions: tuple[Region, ...], key: str = "doc_id", out: str = "shard") -> DataFrame:
    """``docs`` with the int column ``out``. No shuffle. A null key is a key like any other."""
    used = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    plan, names = shard_of(used, regions)
    for name, column in plan:
        docs = docs.withColumn(name, column)
    return docs.withColumn(out, F.col("__shard").cast("int")).drop(*names)


def place(*columns: str) -> Column:
    """A number of 52 bits, from MD5 of the columns as text: where a row stands in its shard."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def number_slots(df: DataFrame, n_rows: int, order: list[str], shards: int, shard: str = "shard", out: str = "slot") -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... without gaps within each shard, in order of ``place(*order)``, then of ``order``. Rows that
    are alike in ``order`` must be alike throughout; they get slots side by side.

    That order is the same at every size. Leading bits of the place split a shard into buckets of about ROWS_PER_BUCKET
    rows; a task numbers one bucket, and the buckets' counts give where each starts, so no task needs a whole shard. Rows
    that are alike are counted as one before that, however many there are.
    """
    bits = max(0, math.ceil(math.log2(max(1.0, n_rows / (ROWS_PER_BUCKET * shards)))))
    alike = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n")).withColumn("__place", place(*order))
    alike = alike.withColumn("__bucket", F.shiftright("__place", 52 - bits) if bits else F.lit(0).cast("long"))
    own = Window.partitionBy(shard, "__bucket").orderBy("__place", *order).rowsBetween(Window.unboundedPreceding, -1)
    alike = alike.withColumn("__at", F.coalesce(F.sum("__n").over(own), F.lit(0)))
    if bits:
        counts = alike.groupBy(shard, "__bucket").agg(F.sum("__n").alias("__rows"))
        before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.withColumn("__start", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows")
        alike = alike.join(starts, [shard, "__bucket"]).withColumn("__at", F.col("__start") + F.col("__at"))
    # one row each again, a bounded number of them at a time
    many = alike.withColumn("__low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(ROWS_AT_ONCE).cast("long"))))
    last = F.least(F.col("__low") + ROWS_AT_ONCE, F.col("__n")) - 1
    each = many.withColumn("__k", F.explode(F.sequence(F.col("__low"), last)))
    return each.select(*df.columns, (F.col("__at") + F.col("__k")).cast("long").alias(out))


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """All documents in shards 0 to ``n_shards`` - 1 under the law ``key``: doc_id and the number of shards decide.

    Returns doc_id, size, text_crc32, law, shard, slot and grown_shard (the shard if there were one more). Slots follow
    ``place`` of doc_id, text_crc32 and size. A very long text only makes for a large size. A null text counts 16 bytes and has the checksum of an empty one; a null doc_id is one key. Repeated rows share a
    shard and have slots of their own; equal texts with other ids go where their ids send them. An empty table gives
    an empty result. Other columns are not read, so clashing names do no harm.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = assign_shards(assign_shards(rows, layout(n_shards)), layout(n_shards + 1), out="grown_shard")
    numbered = number_slots(rows, docs.count(), ["doc_id", "text_crc32", "size"], n_shards)
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, n_shards: int = 40) -> None:
    """Writes the documents, whole, as Parquet in one folder a shard. Each task writes to at most ``n_shards`` files."""
    assign_shards(docs, layout(n_shards)).write.partitionBy("shard").parquet(path)
