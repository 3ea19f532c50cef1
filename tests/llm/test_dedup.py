"""The dedup operators against brute force."""

import glob
import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash

from foliant.llm import components, embed_dedup, line_dedup, simhash, substring_dedup


def groups(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def by_text(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("step", [5, 200_000])
@pytest.mark.parametrize("kind", ["chain", "star", "random", "shuffled"])
def test_components(spark, kind, step, monkeypatch):
    monkeypatch.setattr(components, "STEP_LINKS", step)
    r, n = random.Random(2), 50
    order = list(range(n))
    r.shuffle(order)
    links = {
        "chain": [(i, i + 1) for i in range(n - 1)], "star": [(7, i) for i in range(30)], "random": [(r.randrange(n), r.randrange(n)) for _ in range(40)],
        "shuffled": [(order[i], order[i + 1]) for i in range(n - 1) if i % 9],
    }[kind]
    root = groups(n, links)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    assert got == {x: root[x] for link in links if link[0] != link[1] for x in link}


def test_superseded_files_go(spark, tmp_path):
    from foliant.llm import common

    kept, gone = (common.cut(spark.range(9)) for _ in range(2))
    folder = common.shared_dir(spark).removeprefix("file:")
    files = lambda: len(glob.glob(f"{folder}/*/rdd-*"))
    before = files()
    common.forget(gone)
    common.forget(spark.range(3))
    assert files() == before - 1 and kept.count() == 9
    common.table(spark.range(5))
    common.drop_tables(spark)
    assert not glob.glob(f"{folder}/foliant-tables/{spark.sparkContext.applicationId}*")


def test_no_links(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    if not ws:
        return 0
    shingles = [" ".join(ws[k : k + 4]) for k in range(len(ws) - 3)] if len(ws) >= 4 else [" ".join(ws)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def test_fingerprint():
    from tests.llm.conftest import words

    for t in [None, "", " \n", "One", "ÉTÉ A b C d", words(3, 3), words(4, 4), words(5, 500), "a\x0bb\xa0c\x1cd e f g"]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


@pytest.mark.parametrize("radius", range(8))
def test_bit_slices(radius):
    r = np.random.default_rng(radius)
    base = r.integers(0, 2**64, 20, dtype=np.uint64)
    x = np.array([int(b) ^ sum(1 << int(k) for k in r.choice(64, r.integers(0, 9), replace=False)) for b in base for _ in range(5)], dtype=np.uint64)
    i, j = simhash.close_pairs(x, x[:70], radius)
    want = {(a, b) for a in range(len(x)) for b in range(70) if (int(x[a]) ^ int(x[b])).bit_count() <= radius}
    assert set(zip(i.tolist(), j.tolist())) == want


@pytest.mark.parametrize("scheme", [*simhash.SCHEMES, None])
@pytest.mark.parametrize("tile", [4096, 8])
def test_near_groups(spark, monkeypatch, scheme, tile):
    if scheme:
        monkeypatch.setattr(simhash, "scheme", lambda n: scheme)
    r = random.Random(9)
    fps = []
    for _ in range(25):
        b = r.getrandbits(64)
        fps += [b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 6))) for _ in range(4)]
    fps = sorted({0, *fps})
    root = groups(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    df = spark.createDataFrame([(int(f),) for f in simhash.signed(fps)], "__fp long").repartition(4)
    found = {r["node"]: r["component"] for r in components.components(simhash.near_links(df, len(fps), tile)).collect()}
    own = simhash.signed(fps).tolist()
    got = [found.get(f, f) for f in own]
    assert all((got[a] == got[b]) == (root[a] == root[b]) for a in range(len(fps)) for b in range(a))


def test_simhash_rows(odd, odd_rows, empty):
    got = simhash.group_near(odd).collect()
    fps = [brute_fingerprint(r[1]) for r in odd_rows]
    root = groups(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    low = [min((odd_rows[k][0] for k in range(len(fps)) if root[k] == root[n] and odd_rows[k][0] is not None), default=None) for n in range(len(fps))]
    want = [(odd_rows[k][0], f"{fps[k]:016x}", low[k]) for k in range(len(fps))]
    assert by_text(tuple(r) for r in got) == by_text(want)
    assert simhash.group_near(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len(set(root)) and simhash.keep_one(empty).count() == 0


def brute_substrings(rows, window):
    docs = [(i, [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]) for i, t in rows]
    first = {}
    for i, ws in docs:
        for s in range(len(ws) - window + 1) if i is not None else ():
            key = tuple(ws[s : s + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, ws in docs:
        gone = set()
        for s in range(len(ws) - window + 1) if i is not None else ():
            if first[tuple(ws[s : s + window])] < i:
                gone.update(range(s, s + window))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return by_text(out)


def test_selected():
    r = np.random.default_rng(0)
    for _ in range(50):
        x = r.integers(0, 9, r.integers(35, 90)).astype(np.uint64)
        assert substring_dedup.selected(x, 35).tolist() == [k + int(np.argmin(x[k : k + 35])) for k in range(len(x) - 34)]


@pytest.mark.parametrize("filter_words", [1 << 20, 1])
def test_substrings(spark, odd, odd_rows, monkeypatch, filter_words):
    monkeypatch.setattr(substring_dedup, "FILTER_WORDS", filter_words)
    r = random.Random(5)
    long = [r.choice(["a", "b", "c"] + [f"u{k}" for k in range(400)]) for _ in range(300)]
    rows = [(r[0], r[1]) for r in odd_rows]
    for n in range(50):
        a = r.randint(0, 240)
        ws = long[a : a + r.randint(20, 140)]
        if r.random() < 0.5:
            ws[r.randrange(len(ws))] = "x"
        rows.append((5000 - n if n % 3 else 5000, "\n ".join([f"p{n}_{k}" for k in range(r.randint(0, 30))] + ws + ws[: r.randint(0, 60)])))
    rows += [(7002, " ".join(["zz"] * 200)), (7003, " ".join(["zz"] * 150)), rows[12]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substring_dedup.dedup_substrings(df, with_text=True).collect()
    assert by_text((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_substrings(rows, 50)
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def test_substrings_empty(empty):
    assert substring_dedup.dedup_substrings(empty).count() == 0


def brute_lines(rows, ratio, least):
    per, total = {}, {}
    for _, text, host in rows:
        total[host] = total.get(host, 0) + 1
        for line in set((text or "").split("\n")) if text is not None else ():
            if line.strip(" "):
                per[host, line] = per.get((host, line), 0) + 1
    out = []
    for i, text, host in rows:
        ls = text.split("\n") if text is not None else []
        small = min(least, max(3, math.ceil(total[host] * 0.8)))
        kept = [x for x in ls if not (per.get((host, x), 0) >= small and per[host, x] > total[host] * ratio)]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept) if text is not None else None))
    return by_text(out)


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_lines(spark, broadcast):
    r = random.Random(1)
    rows = [(n, "\n".join(r.choice(["menu", "", " ", f"own {n}", "about us", f"x{r.randint(0, 9)}"]) for _ in range(r.randint(1, 9))), r.choice(["a", "b", None])) for n in range(120)]
    rows += [(500, None, "a"), (501, "", None), rows[3], (None, "menu", "c")]
    rows += [(600 + 10 * n + k, f"small menu\nown {n} {k}", f"host of {n}") for n in range(1, 8) for k in range(n)]
    rows += [(700 + k, "twice" if k < 2 else f"page {k}", "two copies") for k in range(4)]
    df = spark.createDataFrame([(*x, 1, "c") for x in rows], "doc_id long, text string, source string, n_lines int, __total string").repartition(3)
    got = line_dedup.drop_lines(df, max_ratio=0.2, min_pages=5, broadcast_lines=broadcast)
    assert got.columns == ["doc_id", "text", "source", "__total", "n_lines", "n_dropped"]
    assert by_text((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == brute_lines(rows, 0.2, 5)


def test_lines_of_small_hosts(spark):
    """What is on nearly all pages of a small host goes, what two copies share stays."""
    rows = [(n * 10 + k, f"menu\nown {n} {k}", f"h{n}") for n in range(1, 8) for k in range(n)] + [(100 + k, "twice" if k < 2 else f"p {k}", "c") for k in range(4)]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {i: int(h[0] == "h" and int(h[1:]) >= 3) for i, _, h in rows}


def test_lines_of_many_kinds(spark):
    """A host with thousands of boilerplate lines, which are looked up by bin."""
    lines = [f"line {k}" for k in range(3000)]
    rows = [(k, "\n".join([*lines, f"own {k}"]), "s") for k in range(6)]
    got = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r["n_dropped"] == 3000 and r["text"] == f"own {r['doc_id']}" for r in got)


def test_lines_empty(empty, odd, odd_rows):
    assert line_dedup.drop_lines(empty).count() == 0
    assert line_dedup.drop_lines(odd).count() == len(odd_rows)


def brute_vectors(rows):
    def fine(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    x = [np.array(v, dtype=np.float32).astype(float) if fine(v) and label is not None else None for _, v, label in rows]
    links = []
    for a in range(len(rows)):
        for b in range(a):
            if x[a] is not None and x[b] is not None and rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]):
                if x[a] @ x[b] / math.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= 0.98:
                    links.append((a, b))
    root = groups(len(rows), links)
    count = [sum(k in link for link in links) for k in range(len(rows))]
    low = {}
    for k in range(len(rows)):
        low[root[k]] = min(low.get(root[k], rows[k][0]), rows[k][0])
    return sorted((rows[k][0], count[k], low[root[k]], rows[k][0] == low[root[k]]) for k in range(len(rows)))


@pytest.mark.parametrize("tile", [2048, 8])
def test_vectors(spark, monkeypatch, tile):
    if tile == 8:
        monkeypatch.setattr(embed_dedup, "CELL_SAMPLE", 10)
    r = np.random.default_rng(1)
    rows = []
    for k in range(160):
        base = r.normal(size=24) if k % 8 == 0 or not rows else base
        rows.append((1000 - k, (base * (1 + k % 3) + r.normal(0, 0.02 * (k % 8), 24)).tolist(), k // 8 % 3))
    rows += [(2000, None, 1), (2001, [0.0] * 24, 1), (2002, [math.nan] + [1.0] * 23, 1), (2003, rows[0][1], None), (2004, [None] + [1.0] * 23, 1), (2005, [], 1)]
    rows += [(2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (2008, [math.inf] * 24, 2), (900, rows[3][1], rows[3][2]), (2009, rows[3][1], rows[3][2]), (2010, rows[3][1], 99)]
    df = spark.createDataFrame([(*x, "a", 2) for x in rows], "vec_id long, embedding array<float>, label int, cell string, n int").repartition(3)
    assert sorted(tuple(x) for x in embed_dedup.link(df, tile=tile).collect()) == brute_vectors(rows)


def test_vectors_empty(spark):
    assert embed_dedup.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("spread", [0.02, 0.3])
def test_many_vectors(spark, spread):
    """Labels of several tiles, near and far apart, against all pairs."""
    r = np.random.default_rng(5)
    base = r.normal(size=(300, 24)) * np.linspace(2, 0.2, 24)
    x = (base[r.integers(0, 300, 2400)] + r.normal(0, spread, (2400, 24))).astype(np.float32)
    label = r.integers(0, 2, 2400)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    a, b = np.nonzero((u @ u.T >= 0.98) & (label[:, None] == label[None]))
    root = groups(2400, list(zip(a.tolist(), b.tolist())))
    df = spark.createDataFrame([(k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(x, label))], "vec_id long, embedding array<float>, label int").repartition(4)
    got = {row["vec_id"]: row for row in embed_dedup.link(df, tile=150).collect()}
    assert [got[k]["component_id"] for k in range(2400)] == root
    assert [got[k]["n_links"] for k in range(2400)] == (np.bincount(a, minlength=2400) - 1).tolist()


def test_blocks_and_cells():
    r = np.random.default_rng(2)
    x = embed_dedup.units(r.normal(size=(1000, 20)))
    assert sorted(np.concatenate(embed_dedup.blocks(x[:, :8], 64)).tolist()) == list(range(1000))
    space = embed_dedup.fit_space(x, 16)
    cells = space.cells((x @ space.rotation)[:, : embed_dedup.LEADING])
    assert len(space.axes) == 15 and set(cells) == set(range(16)) and np.bincount(cells).max() <= 64
    for y in (x[:300] + 0.01, None):
        got = {(int(a), int(b)) for i, j in embed_dedup.close_pairs(x, y, space.rotation, 0.6) for a, b in zip(i, j)}
        z = x if y is None else embed_dedup.units(y)
        near = x @ z.T >= 0.6
        assert got == {(a, b) for a, b in zip(*(c.tolist() for c in np.nonzero(near))) if y is not None or a < b}
