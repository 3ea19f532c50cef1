"""The whole pipeline against a plain-Python model of its five stages. Only the classifier's features and fit are the
operator's own; what it is fitted on, and all other stages, are brute force or the tokenizers library."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from foliant.llm import quality
from foliant.llm.queries import vocabulary
from tests.llm.test_near_copies import brute_sets
from tests.llm.test_dedup import groups
from tests.llm.test_pipeline import article
from tests.llm.test_texts import brute_overlaps


def model(docs, labels, items):
    """The rows that come out: (doc_id, n_tokens)."""
    from tokenizers import Tokenizer

    marks = defaultdict(set)
    for i, q in labels:
        if i is not None and q is not None and zlib.crc32(str(i).encode()) % 5:
            marks[i].add(q)
    x = quality.features(pa.array([t for _, t, _ in docs], pa.string()))
    shown = [k for k, (i, _, _) in enumerate(docs) if len(marks.get(i, ())) == 1]
    small = x[shown].astype(np.float32).astype(float)
    order = np.lexsort((small[:, -2], [docs[k][0] for k in shown]))
    fitted = quality.rank(small[order], np.array([next(iter(marks[docs[k][0]])) for k in shown])[order])
    docs = [d for d, s in zip(docs, fitted.score(x)) if s >= quality.CUT]

    pages, found = defaultdict(set), Counter()
    for _, t, host in docs:
        pages[host].add(t)
    for host, texts in pages.items():
        found.update((host, line) for t in texts for line in set((t or "").split("\n")) if line.strip(" "))
    least = {host: min(5, max(3, math.ceil(0.8 * len(texts)))) for host, texts in pages.items()}
    gone = {k for k, n in found.items() if n >= least[k[0]] and n > len(pages[k[0]]) * 0.05}
    docs = [(i, t if t is None else "\n".join(x for x in t.split("\n") if (h, x) not in gone), h) for i, t, h in docs]

    sets, held = [brute_sets(t) for _, t, _ in docs], defaultdict(list)
    for k, s in enumerate(sets):
        for shingle in s or [()]:
            held[shingle].append(k)
    pairs = {(a, b) for own in held.values() for a in own for b in own if b < a}
    root = groups(len(docs), [(a, b) for a, b in pairs if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    best = {}
    for k, (i, _, _) in enumerate(docs):
        best[root[k]] = min(best.get(root[k], (True, 0, k)), (i is None, i or 0, k))
    docs = [docs[k] for _, _, k in best.values()]

    dirty = {x[0] for x in brute_overlaps([t for _, t, _ in docs], items) if not x[4]}
    coder, out = Tokenizer.from_file(vocabulary()), []
    for k, (i, t, _) in enumerate(docs):
        if k not in dirty:
            out.append((i, len(coder.encode(t or "", add_special_tokens=False).ids)))
    return sorted(out, key=str)


def planted(spark, path):
    """Menus, a hot group of copies in one host, near copies, a contaminated row and clean ones of its id and of none."""
    r = random.Random(6)
    rows = [(k, f"site menu\n{article(k)}", "ab"[k % 2]) for k in range(120)]
    rows += [(1000 + k, article(9000), "a") for k in range(90)]
    for k in range(10):
        ws = article(k).replace("\n", " ").split()
        ws[r.randrange(10, 80)] = "other"
        rows.append((2000 + k, " ".join(ws), "c"))
    item = " ".join(f"q{k}" for k in range(20))
    rows += [(None, article(501) + " " + item, "c"), (None, article(502), "c"), (3000, article(503) + " " + item, "c"), (3000, article(504), "c")]
    rows += [(4000 + k, "!!! $$$ <<>> " * 40 + f"{k}", "c") for k in range(40)]
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 4000)) for i, _, _ in rows if i is not None and i != 3000], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    rows += [(5000 + k, f"tiny menu\n{article(700 + k)}", "d") for k in range(4)]
    spark.createDataFrame([(1, item), (2, "a501_1 a502_2")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)



def test_pipeline_equals_model(spark, tmp_path):
    import corpus_pipeline

    sf = planted(spark, tmp_path)
    read = lambda name, *c: [tuple(x) for x in spark.read.parquet(f"{sf}/{name}.parquet").select(*c).collect()]
    want = model(read("documents", "doc_id", "text", "source"), read("labels", "doc_id", "quality"), [t for _, t in read("benchmark", "item_id", "text")])
    got = sorted(((x["doc_id"], x["n_tokens"]) for x in corpus_pipeline.run(spark, sf).collect()), key=str)
    assert got == want and want
