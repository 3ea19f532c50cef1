"""Near-dedup by exact similarity of five-word shingles, against brute force."""

import random

import pytest

from foliant.llm import near_copies
from tests.llm.test_dedup import groups


def brute_sets(text):
    ws = (text or "").lower().split()
    return frozenset(tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))) if ws else frozenset()


def brute_kept(rows):
    """The (doc_id, text) of the row that stays, for each group; ids must tell all texts of a group apart."""
    sets = [brute_sets(t) for _, t in rows]

    def alike(x, y):
        return x == y or 5 * len(x & y) >= 4 * len(x | y)

    root = groups(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if alike(sets[a], sets[b])])
    best = {}
    for k, (i, t) in enumerate(rows):
        best.setdefault(root[k], []).append((i is None, i or 0, k))
    return sorted((str(rows[k][0]), rows[k][1] or "") for k in (min(v)[2] for v in best.values()))


def near_rows():
    """Texts with 0 to 12 words changed, so that their similarity is on both sides of 0.8; chains; a large group of near
    copies; a passage that many texts share; short, empty and null texts."""
    r = random.Random(8)
    fresh = iter(range(10**6))
    rows = []

    def changed(ws, n):
        ws = list(ws)
        for k in r.sample(range(len(ws)), n):
            ws[k] = f"new{next(fresh)}"
        return ws

    for _ in range(20):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randint(60, 200))]
        rows += [base, *(changed(base, r.randint(0, 12)) for _ in range(4))]
    link = [f"c{k}" for k in range(150)]
    for k in range(8):
        rows.append(link)
        link = [*link[:-8], *(f"n{k}_{j}" for j in range(8))] if k % 2 else changed(link, 2)
    hot = [f"h{k}" for k in range(120)]
    rows += [changed(hot, 2) for _ in range(60)]
    passage = [f"p{k}" for k in range(30)]
    rows += [[*(f"own{next(fresh)}" for _ in range(r.randint(5, 40))), *passage] for _ in range(60)]
    texts = [" ".join(ws) for ws in rows] + ["", None, " \n", "One two", "one  TWO", "one two three", rows[0][0].upper()]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return [*zip(ids, texts), (None, texts[0]), (None, "only here with a null id")]


@pytest.mark.parametrize(("sample", "dense"), [(32, 32), (1, -1), (1, 10**6)])
def test_near_copies(spark, monkeypatch, sample, dense):
    monkeypatch.setattr(near_copies, "SAMPLE", sample)
    monkeypatch.setattr(near_copies, "DENSE", dense)
    monkeypatch.setattr(near_copies, "TILE_SETS", 1024 if dense > 0 else 20)
    monkeypatch.setattr(near_copies, "PARTNERS", 512 if dense == 32 else 3)
    monkeypatch.setattr(near_copies, "BROADCAST_IDS", 10_000 if sample == 32 else 0)
    rows = near_rows()
    df = spark.createDataFrame([(*x, "k", 3) for x in rows], "doc_id long, text string, __s string, n_chars int").repartition(5)
    got = near_copies.keep_one(df)
    assert got.columns == df.columns
    assert sorted((str(x["doc_id"]), x["text"] or "") for x in got.collect()) == brute_kept(rows)


def test_pipeline_stage_links_at_eight_tenths(spark):
    import corpus_pipeline
    from foliant.llm.simhash import fingerprint

    r = random.Random(3)
    rows = []
    for k in range(6):
        ws = [f"w{k}_{j}" for j in range(84)]
        other = list(ws)
        while (fingerprint(" ".join(ws)) ^ fingerprint(" ".join(other))).bit_count() <= 6:
            other = list(ws)
            at = r.randrange(5, 75)
            other[at] = f"x{r.random()}"
        rows += [(2 * k, ws), (2 * k + 1, other)]
    assert all(5 * len(x & y) >= 4 * len(x | y) for x, y in ((brute_sets(" ".join(a[1])), brute_sets(" ".join(b[1]))) for a, b in zip(rows[::2], rows[1::2])))
    df = spark.createDataFrame([(i, " ".join(ws), "en", "s", 1) for i, ws in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x["doc_id"] for x in corpus_pipeline.dedup_near(spark, df, "").collect()} == set(range(0, 12, 2))


def test_near_copies_rows(odd, empty):
    kept = near_copies.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 5
    assert near_copies.keep_one(empty).count() == 0
