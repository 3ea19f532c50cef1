"""The pipeline's stages on planted cases."""

import random

import numpy as np
import pytest

from foliant.llm import decontam, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """From (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).repartition(3)


def article(seed, lines=8):
    r = random.Random(seed)
    return "\n".join(" ".join(f"a{seed}_{r.randrange(10**6)}" for _ in range(12)) for _ in range(lines))


@pytest.mark.parametrize("copies", [5, 30])
def test_copies_do_not_make_an_article_boilerplate(spark, copies):
    import corpus_pipeline

    rows = [(k, f"site menu\n{article(k)}", "host") for k in range(60)] + [(1000 + n * 100 + k, article(9000 + n), "host") for n in range(2) for k in range(copies)]
    rows += [(5000, None, "host"), (5001, "", "host")]
    df = frame(spark, rows)
    lines = corpus_pipeline.dedup_lines(spark, df, "")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.collect()}
    want = {i: t and t.removeprefix("site menu\n") for i, t, _ in rows}
    assert got == {i: (t, len(t or "")) for i, t in want.items()}
    near = {r["doc_id"] for r in corpus_pipeline.dedup_near(spark, lines, "").collect()}
    assert near == {*range(60), 1000, 1100, 5000}


@pytest.mark.parametrize("limit", [100_000, 0])
def test_clean_rows_stay_beside_contaminated_ones_of_their_id(spark, limit):
    item = " ".join(f"q{k}" for k in range(20))
    rows = [(None, f"see {item} here", "s"), (None, "clean without an id", "s"), (None, None, "s"), (4, item, "s"), (4, "clean under a reused id", "s"), (4, item + " again", "s"), (5, "clean", "s")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontam.drop_contaminated(frame(spark, rows), bench, limit)
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, ((i, t) for i, t, _ in rows if "q0 q1" not in (t or ""))))


@pytest.mark.parametrize("bad_share", [0.14, 0.6, 0.9, 0.99])
def test_threshold_rejects_any_share_of_bad_documents(bad_share):
    r = np.random.default_rng(1)
    good = (r.random(2000) >= bad_share).astype(int)
    x = r.random((2000, quality.N_FEATURES)) * 0.01
    x[:, 0] += good
    model = quality.rank(x, good, pairs=2000)
    predicted = model.score(x) >= quality.CUT
    assert predicted[good == 1].mean() >= quality.KEEP and predicted[good == 0].mean() <= 0.01
