"""BPE, sharding, quality, decontamination and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import bpe, decontam, quality, sharding
from foliant.llm.queries import vocabulary
from tests.llm.conftest import words


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_bpe_equals_library(library):
    coder, r = bpe.tokenizer(vocabulary()), random.Random(1)
    letters = [*"ab 's.,\n\t\r\x1c\x85\xa0é1²中😀'lABC!", "<|endoftext|>", "the", " ", " 're", "aaaa", "abab", "́", "Ⅷ"]
    texts = ["", *("".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(4000)), words(7, 3000), "a" * 999]
    for text, ids in zip(texts, coder.encode_batch(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert coder.decode(want) == library.decode(want, skip_special_tokens=False)
    broken = [coder.id_of_byte[b] for b in (0xC3, 0x28, 0xF0, 0x9F, 0x41)]
    assert coder.decode(broken) == library.decode([int(i) for i in broken], skip_special_tokens=False)


def test_bpe_every_character(library):
    coder = bpe.tokenizer(vocabulary())
    texts = [f"a{chr(c)}1 {chr(c)} b" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    assert [x.tolist() for x in coder.encode_batch(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_forgets(monkeypatch, library):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    coder = bpe.PairIndexBPE(vocabulary())
    for k in range(5):
        t = words(k, 60)
        assert coder.encode_batch([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_bpe_rows(odd, odd_rows, empty, library):
    got = {(r["doc_id"], r["decoded"]): r["ids"] for r in bpe.encode(odd, vocabulary()).collect()}
    assert all(got[r[0], r[1] or ""] == library.encode(r[1] or "", add_special_tokens=False).ids for r in odd_rows)
    digests = bpe.encode_digests(odd, vocabulary()).collect()
    assert len(digests) == len(odd_rows) and bpe.encode_digests(empty, vocabulary()).count() == 0


def test_shards_hold_the_law(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.shard_documents(df, 40).collect()
    assert {r["shard"] for r in rows} == set(range(40)) and all(r["grown_shard"] in (r["shard"], 40) for r in rows)
    moved = sum(r["grown_shard"] == 40 for r in rows) / len(rows)
    assert abs(moved - 1 / 41) < 0.01
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) < 2 * len(rows) / 40
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


def test_weights_move_rows_only_within_changed_subtrees(spark):
    old = sharding.layout(16, 16)
    first = old[0]
    heavier = sharding.Rack(first.racks[1].name, tuple((s, 3.0 * w) for s, w in first.racks[1].shards))
    new = (sharding.Region(first.name, (first.racks[0], heavier)), *old[1:])
    df = spark.range(4000).select(F.col("id").alias("doc_id"))
    rows = sharding.assign_shards(sharding.assign_shards(df, old), new, out="now").collect()
    inside = {s for rack in first.racks for s, _ in rack.shards}
    assert all(r["shard"] == r["now"] or r["now"] in inside for r in rows)
    assert sum(r["now"] in {s for s, _ in heavier.shards} for r in rows) > sum(r["shard"] in {s for s, _ in heavier.shards} for r in rows)
    none = (sharding.Region(first.name, tuple(sharding.Rack(x.name, tuple((s, 0.0) for s, _ in x.shards)) for x in first.racks)), *old[1:])
    drained = sharding.assign_shards(sharding.assign_shards(df, old), none, out="now").collect()
    assert all(r["now"] not in inside and (r["shard"] == r["now"] or r["shard"] in inside) for r in drained)


def test_shard_rows(odd, odd_rows, empty, monkeypatch):
    for per_bucket in (sharding.ROWS_PER_BUCKET, 0.05):
        monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", per_bucket)
        rows = sharding.shard_documents(odd).collect()
        texts = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
        assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
        assert all(r["slot"] < sum(x["shard"] == r["shard"] for x in rows) for r in rows)
    assert sharding.shard_documents(empty).count() == 0


def test_slots_have_one_order_at_every_size(spark, monkeypatch):
    """Split in buckets or not, a row has the same slot; rows that are alike are numbered side by side."""
    df = spark.range(3000).selectExpr("id DIV 3 AS doc_id", "if(id % 3 = 0, 'a', 'b') AS text")
    df = df.union(spark.range(25_000).selectExpr("7L AS doc_id", "'hot' AS text"))
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 10**9)
    whole = Counter(map(tuple, sharding.shard_documents(df).collect()))
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 3)
    assert Counter(map(tuple, sharding.shard_documents(df).collect())) == whole and max(whole.values()) == 1
    by_shard = {}
    for r in whole:
        by_shard.setdefault(r[4], []).append(r[5])
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())


def test_quality_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) >= 0.95
    good, bad = [r["score"] for r in got if r["quality"] == 1], [r["score"] for r in got if r["quality"] == 0]
    assert np.mean([[g > b for b in bad] for g in good]) >= 0.97


def test_quality_of_repeated_rows_and_other_ids(spark):
    """Text ids, own columns score and predicted, and a labelled row that repeats without bound."""
    texts = [(f"d{k}", words(k, 60) if k % 3 else "!!! " * 40 + str(k), 0.5, 7) for k in range(200)]
    rows = texts + [texts[1]] * 3000
    docs = spark.createDataFrame(rows, "doc_id string, text string, score double, predicted int").repartition(4)
    labels = spark.createDataFrame([(f"d{k}", int(k % 3 > 0)) for k in range(200)], "doc_id string, quality int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert {r["doc_id"] for r in got} == {f"d{k}" for k in range(200) if k % 3} and len(got) == 3000 + sum(k % 3 > 0 for k in range(200))
    assert all(r["score"] == 0.5 and r["predicted"] == 7 for r in got)
    assert quality.classify(docs, labels).count() == len(rows)


def test_quality_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(4, 1), (5, 1), (6, 0), (7, 0), (2, 0), (None, 1), (8, None), (6, 0), (5, 1)], "doc_id long, quality int")
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert quality.classify(empty, labels).count() == 0
    unlabelled = quality.keep_good(odd, labels.limit(0))
    assert unlabelled.count() == len(odd_rows) and unlabelled.columns == odd.columns


def brute_overlaps(docs, items):
    def split(t):
        return "".join(c if ord(c) > 127 or c.isalnum() else " " for c in (t or "").lower()).split(" ")

    split_items = [[w for w in split(t) if w] for t in items]
    split_docs = [[w for w in split(t) if w] for t in docs]
    found, seen = set(), set()
    for k, own in enumerate(split_items):
        if not own or tuple(own) in seen:
            continue
        seen.add(tuple(own))
        w = min(13, len(own))
        least = -(-8 * w // 10)
        for n, d in enumerate(split_docs):
            best, covered = 0, 0
            for shift in range(-len(own), len(d)):  # item word i over document word i + shift
                same = [0 <= i + shift < len(d) and a == d[i + shift] for i, a in enumerate(own)]
                inside = [(s, sum(same[s : s + w])) for s in range(len(own) - w + 1) if s + shift >= 0 and s + shift + w <= len(d)]
                good = [(s, x) for s, x in inside if x >= least]
                covered = max(covered, len({i for s, _ in good for i in range(s, s + w)}))
                best = max([best, *(x for _, x in good)])
            if best:
                found.add((n, k, covered, best, len(own) < 5))
    return found


@pytest.mark.parametrize("part_words", [1_000_000, 60])
def test_overlaps(spark, part_words):
    r = random.Random(4)
    vocab = [f"w{k}" for k in range(9)] + ["É", "the"]
    items = [" ".join(r.choice(vocab) for _ in range(r.randint(3, 22))) for _ in range(14)]
    items += [items[5].upper() + "!", "the", "w3 w4", "w1 the w2 é", ""]
    docs = [None, ""]
    for _ in range(50):
        d = [r.choice(vocab) for _ in range(r.randint(0, 40))]
        if r.random() < 0.6:
            own = r.choice(items).split()
            d[5:5] = ["sub" if r.random() < 0.13 else w for w in own[r.randint(0, len(own)) // 3 :]]
        docs.append(", ".join(d))
    left = spark.createDataFrame([(k, t, "x") for k, t in enumerate(docs)], "doc_id long, text string, item_id string").repartition(3)
    right = spark.createDataFrame([*((k, t, 1) for k, t in enumerate(items)), (None, None, 1)], "item_id long, text string, doc_id int")
    found = decontam.find_overlaps(left, right, part_words)
    assert found.columns == ["doc_id", "item_id", "covered", "best", "short"]
    want = brute_overlaps(docs, items)
    assert {tuple(r) for r in found.collect()} == want and len(want) > 5 and len({x[4] for x in want}) == 2
    for limit, short in ((decontam.BROADCAST_IDS, False), (0, False), (0, True)):
        kept = {r["doc_id"] for r in decontam.drop_contaminated(left, right, limit, short).collect()}
        assert kept == set(range(len(docs))) - {x[0] for x in want if short or not x[4]}


@pytest.mark.parametrize("errors", [0, 1, 2])
@pytest.mark.parametrize("window", [5, 8, 10, 13])
def test_masks_miss_nothing(window, errors):
    from itertools import combinations

    masks = decontam.lossless_masks(window, errors)
    for wrong in combinations(range(window), errors):
        assert any(not {o + x for x in m} & set(wrong) for m in masks for o in range(window - m[-1]))


def test_overlap_rows(spark, odd, odd_rows, empty):
    bench = spark.createDataFrame([(9, words(1, 120).upper())], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.find_overlaps(odd, bench).collect()} == {4, 5, None}
    assert decontam.drop_contaminated(odd, bench).count() == sum(1 for r in odd_rows if r[0] not in (4, 5, None))
    assert decontam.find_overlaps(empty, bench).count() == 0 and decontam.find_overlaps(odd, bench.limit(0)).count() == 0


def test_pipeline_stages_act_on_their_own_input(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids = {r["doc_id"] for r in docs.collect()}
        assert ids <= before and (ids == before or name in ("quality", "near_dedup", "decontamination"))
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
        before = ids
    want = {tuple(r) for r in docs.collect()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf).collect()} == want


def test_pipeline_takes_odd_rows(spark, odd, empty, tmp_path):
    import corpus_pipeline

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for n, df in enumerate((odd.select(*columns), empty.select(*columns))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, df, "/root/testdata/sf0.001").write.parquet(f"{tmp_path}/{n}-{k}")
            df = spark.read.parquet(f"{tmp_path}/{n}-{k}")
        assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
