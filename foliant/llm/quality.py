"""Quality by Bradley-Terry pairwise ranking.

A document's score is a weighted sum of text features. The weights are learned from preference pairs (a document that is
marked good over one that is marked bad) by the logistic loss on the difference of their features. All labelled documents
that are not held out are dealt into buckets, each bucket is fitted on pairs that take in all of its documents, and the
weights are averaged. The threshold is counted over the scores of all of them; a logistic curve through it maps scores to
0 to 1, with CUT at the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import steps, table, text_bytes, tidy

#: Labelled documents of the more frequent label in a bucket; each bucket is fitted on its own.
BUCKET_ROWS = 2000
#: Documents of the other label that a bucket has at least, as far as there are so many.
BUCKET_LEAST = 200
#: Preference pairs of a bucket (more if a label has more documents there: each is in some pair).
PAIRS = 10_000
#: Steps into which the range of the training scores is divided to count documents above and below a threshold.
BINS = 1 << 16
#: Labelled documents up to which their ids are broadcast.
BROADCAST_IDS = 300_000
#: The mapped score at the threshold.
CUT = 0.3
#: Share of good training documents that the threshold keeps at least.
KEEP = 0.995

#: Byte classes: what a text is made of.
_CLASSES = {"lower": range(0x61, 0x7B), "upper": range(0x41, 0x5B), "digit": range(0x30, 0x3A), "high": range(0x80, 0x100), "space": b" ", "line": b"\n\r", "stop": b".,;:?'", "shout": b"!", "bar": b"|\t", "quote": b"\"()-", "tag": b"<>&=/{}[]\\_"}
CLASS_OF = np.full(256, len(_CLASSES), dtype=np.int64)
for _k, _members in enumerate(_CLASSES.values()):
    CLASS_OF[list(_members)] = _k
N_CLASSES = len(_CLASSES) + 1
N_FEATURES = N_CLASSES + N_CLASSES * N_CLASSES + 6


def features(texts: pa.Array) -> np.ndarray:
    """(rows, N_FEATURES) from whole texts: square roots of the shares of byte classes and of pairs of them, then the
    shares of distinct words and of distinct lines, the mean length of words and lines, the length, and 1 if empty."""
    data, starts = text_bytes(texts)
    n = len(starts) - 1
    sizes = np.diff(starts) - 1
    kind = CLASS_OF[data]
    row = np.repeat(np.arange(n), sizes + 1)
    inside = np.ones(len(data), dtype=bool)
    inside[starts[1:] - 1] = False
    single = np.bincount((row * N_CLASSES + kind)[inside], minlength=n * N_CLASSES).reshape(n, -1)
    both = inside[:-1] & inside[1:]
    code = row[:-1] * (N_CLASSES * N_CLASSES) + kind[:-1] * N_CLASSES + kind[1:]
    double = np.bincount(code[both], minlength=n * N_CLASSES * N_CLASSES).reshape(n, -1)
    rest = np.zeros((n, 6))
    for i, text in enumerate(texts.to_pylist()):
        if not text:
            rest[i, 5] = 1
            continue
        words, lines = text.split(), text.split("\n")
        rest[i, 0] = len(set(words)) / max(1, len(words)) * math.log1p(len(words)) / 5
        rest[i, 1] = len(set(lines)) / len(lines)
        rest[i, 2] = min(3.0, len(text) / max(1, len(words)) / 8)
        rest[i, 3] = min(3.0, math.log1p(len(text) / len(lines)) / 3)
        rest[i, 4] = math.log1p(len(text)) / 10
    return np.hstack((np.sqrt(single / np.maximum(1, sizes)[:, None]), np.sqrt(double / np.maximum(1, sizes - 1)[:, None]), rest))


class Ranking(NamedTuple):
    weights: np.ndarray
    threshold: float
    slope: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; CUT at the threshold."""
        z = self.slope * (x @ self.weights - self.threshold) + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_pairs(better: np.ndarray, worse: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Bradley-Terry weights: the least of mean(log(1 + exp(-w (better - worse)))) + ridge |w|^2, by Nesterov steps."""
    diff = better - worse
    w = look = np.zeros(diff.shape[1])
    rate = 4.0 / max(1e-12, float(np.einsum("ij,ij->i", diff, diff).mean()))
    for k in range(rounds):
        p = 1 / (1 + np.exp(np.clip(diff @ look, -40, 40)))
        step = look + rate * ((diff.T @ p) / len(diff) - ridge * look)
        look = step + k / (k + 3) * (step - w)
        w = step
    return w


def _drawn(rng: np.random.Generator, own: np.ndarray, n: int) -> np.ndarray:
    """``n`` of ``own``, each as often as any other, give or take one."""
    return np.concatenate([rng.permutation(own) for _ in range(-(-n // len(own)))])[:n]


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = 5) -> np.ndarray:
    """Weights from pairs that take in every row. Both labels must occur."""
    up, down = np.flatnonzero(good == 1), np.flatnonzero(good != 1)
    rng, n = np.random.default_rng(seed), max(pairs, len(up), len(down))
    return fit_pairs(x[_drawn(rng, up, n)], x[_drawn(rng, down, n)])


def _bin(s: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.clip(np.floor((s - low) * (BINS / max(1e-12, high - low))), 0, BINS - 1).astype(np.int64)


def threshold(low: float, high: float, up: np.ndarray, down: np.ndarray) -> float:
    """From the numbers of good and of bad documents by ``_bin``: of all edges of bins that keep enough of the good, the one
    that is best for both labels; the middle of equally good ones. Any share of labels may be bad."""
    kept = 1 - (np.cumsum(up) - up) / up.sum()
    cut = (np.cumsum(down) - down) / down.sum()
    worth = np.where(kept >= KEEP, cut + kept, -1.0)
    at, last = int(worth.argmax()), BINS - 1 - int(worth[::-1].argmax())
    return low + (at + last) / 2 * (max(1e-12, high - low) / BINS)


def _ranking(w: np.ndarray, cut: float, mean_good: float) -> Ranking:
    return Ranking(w, cut, 4.0 / max(1e-9, mean_good - cut))


#: Without both labels nothing can be ranked: all scores are above the threshold.
UNRANKED = Ranking(np.zeros(N_FEATURES), -1.0, 1.0)


def rank(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = 5) -> Ranking:
    """``train`` of labelled features that are one bucket."""
    if not (good == 1).any() or not (good != 1).any():
        return UNRANKED
    w = fit(x, good, pairs, seed)
    s = x @ w
    low, high = float(s.min()), float(s.max())
    up, down = (np.bincount(_bin(s[own], low, high), minlength=BINS) for own in (good == 1, good != 1))
    return _ranking(w, threshold(low, high, up, down), float(s[good == 1].mean()))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents that no model sees: crc32 of the id as text is 0 modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> Ranking:
    """Fits on all labelled documents that are not held out, known by doc_id, of any type that can be ordered; of texts with
    the same id on the one with the least hash. Documents with labels of both kinds, and null labels and ids, are left out.

    The texts are read and made features where they lie; the features are kept in the shared folder. Labels are counted
    first: few are broadcast, many are joined to features, so texts are not shuffled. A bucket has some BUCKET_ROWS
    documents of the more frequent label, and those of the other are put into as many buckets as BUCKET_LEAST asks for. The
    driver gets the weights of the buckets and the counts by bin."""
    known = table(
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("__low"), F.max("quality").alias("__high"))
        .where("__low = __high")
        .select(F.col("doc_id").alias("__id"), F.col("__low").cast("int").alias("__good"))
    )
    few = known.count() <= broadcast_ids
    texts = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.xxhash64("text").alias("__t"), "text")
    if few:
        texts = texts.join(F.broadcast(known), F.col("doc_id") == F.col("__id")).drop("__id")
    names = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                x = features(part.column("text")).astype(np.float32)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lists], [*names, "x"])

    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in names)
    found = texts.mapInArrow(tidy(run), f"{kinds}, x array<float>")
    if not few:
        found = found.join(known, F.col("doc_id") == F.col("__id")).drop("__id")
    # one text for each id, however often a row is repeated
    found = table(found.groupBy("doc_id").agg(F.min(F.struct("__t", "__good", "x")).alias("s")).select(F.col("doc_id").alias("__id"), "s.__good", "s.x"))
    n_good, n_bad = found.agg(F.count_if(F.col("__good") == 1), F.count_if(F.col("__good") != 1)).first()
    if not n_good or not n_bad:
        return UNRANKED

    more, less = max(n_good, n_bad), min(n_good, n_bad)
    buckets = -(-more // BUCKET_ROWS)
    times = min(buckets, -(-BUCKET_LEAST * buckets // less))
    frequent = (F.col("__good") == 1) == F.lit(n_good >= n_bad)
    copies = F.sequence(F.lit(0), F.when(frequent, 0).otherwise(times - 1))
    dealt = found.withColumn("__c", F.explode(copies)).withColumn("__b", F.pmod(F.xxhash64("__id") + F.col("__c"), F.lit(buckets))).drop("__c")

    def fitted(own: pa.Table) -> pa.Table:
        own = own.sort_by("__id")
        good = own.column("__good").to_numpy()
        both = (good == 1).any() and (good != 1).any()
        w = [fit(_matrix(own.column("x").combine_chunks()), good).tolist()] if both else []
        return pa.table({"w": pa.array(w, pa.list_(pa.float64()))})

    got = dealt.groupBy("__b").applyInArrow(fitted, "w array<double>").toArrow().column("w").to_pylist()
    w = np.array(sorted(got)).mean(axis=0)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("__good"), pa.array(_matrix(batch.column("x")) @ w)], ["__good", "s"])

    scores = table(found.select("__good", "x").mapInArrow(tidy(scored), "__good int, s double"))
    low, high, mean_good = scores.agg(F.min("s"), F.max("s"), F.avg(F.when(F.col("__good") == 1, F.col("s")))).first()
    at = F.least(F.greatest(F.floor((F.col("s") - F.lit(low)) * F.lit(BINS / max(1e-12, high - low))), F.lit(0)), F.lit(BINS - 1))
    counts = scores.groupBy(at.cast("long").alias("k")).agg(F.count_if(F.col("__good") == 1).alias("up"), F.count_if(F.col("__good") != 1).alias("down")).toArrow()
    by_bin = np.zeros((2, BINS))
    for row, name in enumerate(("up", "down")):
        by_bin[row, counts.column("k").to_numpy()] = counts.column(name).to_numpy()
    return _ranking(w, threshold(low, high, *by_bin), mean_good)


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, N_FEATURES)


def _scored(docs: DataFrame, model: Ranking, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with __score and __predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "__text"):
                s = model.score(features(part.column("__text")))
                keep = [part.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(s), pa.array((s >= CUT).astype(np.int32))], [*columns, "__score", "__predicted"])

    rows = docs.select(*columns, F.col("text").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text"), "__score double, __predicted int"])
    return rows.mapInArrow(tidy(run), schema)


def score(docs: DataFrame, model: Ranking, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (doc_id alone by default) with score double and predicted int, 1 if score >= CUT; columns of
    these names are replaced.

    A null text reads as an empty one, which has a score like any other. A very long text is read whole, as a step of its
    own. Equal texts, and so repeated rows, score alike. An empty table gives an empty result. Names that begin with two
    underscores are the operator's. The model goes along with the function: a few KB.
    """
    columns = ["doc_id"] if columns is None else [c for c in columns if c not in ("score", "predicted")]
    return _scored(docs, model, columns).withColumnsRenamed({"__score": "score", "__predicted": "predicted"})


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted; for nulls, empty and long texts, repeated rows and empty
    tables see ``train`` and ``score``. A null doc_id is not held out. Other columns are not read."""
    return score(docs, train(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts good, with all their columns as they are, score and predicted
    among them. Rows that are alike go or stay together; without labels of both kinds all stay."""
    return _scored(docs, train(docs, labels), docs.columns).where("__predicted = 1").select(*docs.columns)
