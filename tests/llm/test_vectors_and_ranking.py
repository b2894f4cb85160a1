"""Ops 11 to 13 against brute force on small awkward tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from patchloom.llm import lexical, metric_join, whitening

VECTORS = "vec_id long, embedding array<float>, label int, x string, d string, rows int, h1 string, component int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def vector_rows(n=260, d=8, seed=3):
    """Bunches of near copies around few centres, lone vectors, repeats, and all that must not take part."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, d))
    rows = []
    for i in range(n):
        v = centres[i % 6] + rng.standard_normal(d) * (0.08 if i % 3 else 0.5) if i % 4 else rng.standard_normal(d)
        rows.append([i, [float(np.float32(c)) for c in v], i % 2])
    rows += [[n + 1, rows[5][1], 1], [n + 2, rows[5][1], 0], [n + 3, [2 * c for c in rows[5][1]], 1], [n + 4, rows[5][1], None]]
    rows += [[n + 5, None, 1], [n + 6, [], 1], [n + 7, [0.0] * d, 1], [n + 8, [1.0, None] + [0.0] * (d - 2), 1], [n + 9, [float("nan")] * d, 1], [n + 10, [float("inf")] + [1.0] * (d - 1), 1]]
    rows += [[n + 11, [1.0, 0.1], 1], [n + 12, [1.0, 0.11], 1], [n + 13, [-0.0] + [1.0] * (d - 1), 1], [n + 14, [0.0] + [1.0] * (d - 1), 1], [n + 15, [1e30] * d, 1], [n + 16, [1.0] * d, 1]]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "d", 1, "h", 9) for r in rows], VECTORS).repartition(3)


def linked(rows, threshold):
    """n_links and component of each id by comparing all."""
    use = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(c is not None and math.isfinite(c) for c in r[1]) and any(r[1])]
    near = defaultdict(set)
    for a in use:
        for b in use:
            if a[0] != b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    near[a[0]].add(b[0])
    out = {}
    for i in (r[0] for r in rows):
        seen, todo = {i}, [i]
        while todo:
            todo += (new := near[todo.pop()] - seen)
            seen |= new
        out[i] = (len(near[i]), min(seen), min(seen) == i)
    return out


@pytest.mark.parametrize(("threshold", "cell", "held"), [(0.93, 1024, 16384), (0.93, 16, 16384), (0.93, 16, 7), (0.8, 9, 10)])
def test_metric_join_like_brute_force(spark, threshold, cell, held):
    rows = vector_rows()
    got = metric_join.near_duplicates(frame(spark, rows), threshold, cell=cell, held=held).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == linked(rows, threshold)
    assert len(got) == len(rows)


def test_metric_join_of_odd_tables(spark):
    assert metric_join.near_duplicates(frame(spark, [])).count() == 0
    got = metric_join.near_duplicates(frame(spark, [[None, [1.0, 0.0], 1], [4, [1.0, 0.0], 1], [4, [1.0, 0.001], 1], [7, [1.0, 0.0], 1]]))
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in got.collect())[0] == (-1, 0, -1, True)
    assert all(r.component_id == 4 for r in got.collect() if r.vec_id)
    doubles = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 1e-9], "a"), (3, [1.0, 0.0], "b")], "vec_id int, embedding array<double>, label string")
    assert {tuple(r) for r in metric_join.near_duplicates(doubles).collect()} == {(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)}


def test_cells_hold_every_neighbour():
    rng = np.random.default_rng(5)
    x = metric_join.unit(np.concatenate([rng.standard_normal((200, 6)), rng.standard_normal((1, 6)) + 0.1 * rng.standard_normal((150, 6))]))
    r = math.sqrt(2 - 2 * 0.9)
    pivots = metric_join.pivots_of(x[::3], 12, r)
    gaps = metric_join.far(x, pivots)
    radius = np.array([gaps[gaps.argmin(axis=1) == c, c].max(initial=-9) for c in range(len(pivots))])
    own, reach = metric_join.reached(x, pivots, radius, r)
    i, j = np.nonzero(metric_join.far(x, x) <= r)
    assert reach[j, own[i]].all()
    # and the bounds rule something out
    assert reach.mean() < 0.8


def test_forest_keeps_components():
    rng = np.random.default_rng(6)
    x = metric_join.unit(np.concatenate([c + 0.05 * rng.standard_normal((40, 5)) for c in rng.standard_normal((5, 5))]))
    rows = np.stack([np.arange(200), np.arange(200), np.ones(200, dtype="i8")], axis=1)
    cell = metric_join.Cell(rows, x, 0.97)
    edges = [e for a in range(0, 200, 33) for e in zip(*cell.join(rows[a : a + 33], x[a : a + 33]), strict=True)] + list(zip(*cell.forest(), strict=True))
    near = (x @ x.T >= 0.97) & ~np.eye(200, dtype=bool)
    assert (cell.links == near.sum(axis=1)).all() and len(edges) <= 400

    def roots(pairs):
        root = list(range(200))
        for _ in range(200):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert roots(edges) == roots(zip(*np.nonzero(near), strict=True))


def whitened_by_hand(rows, k):
    use = [r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    out = {}
    for d in {len(r[1]) for r in use}:
        mine = [(r[0], [math.floor(256 * c) for c in r[1]]) for r in use if len(r[1]) == d]
        fit = sorted({tuple(x) for _, x in mine})
        n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
        values, axes = np.linalg.eigh(np.cov(np.array(fit, dtype="f8").T, bias=True))
        values, axes = values[::-1], axes[:, ::-1]
        for i, x in mine:
            dev = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
            out[i] = (n, min(dev, 2**63 - 1), (np.array(x, dtype="f8") - np.array(sums) / n) @ axes[:, :k] / np.sqrt(np.maximum(values[:k], 1e-12)), values[:k] / values.sum())
    return out


@pytest.mark.parametrize("oversample", [0, 2, 8])
def test_whitening_like_brute_force(spark, oversample):
    rows = [r for r in vector_rows() if not (r[1] and r[1][0] == 1e30)]
    got = whitening.whitened(frame(spark, rows), 4, oversample).collect()
    want = whitened_by_hand(rows, 4)
    assert Counter(r.vec_id for r in got) == Counter({i: min(4, len(w[2])) for i, w in want.items()})
    of = dict(map(lambda r: (r[0], r[1]), rows))
    signs = {}
    for r in got:
        n, dev, values, share = want[r.vec_id]
        assert (r.n, r.deviation) == (n, dev) and abs(r.explained - share[r.component - 1]) < 1e-9
        value = values[r.component - 1]
        if len(of[r.vec_id]) > 2 and abs(value) > 1e-6:
            sign = signs.setdefault(r.component, math.copysign(1, value * r.whitened))
            assert abs(r.whitened * sign - value) < 1e-7 * max(1, abs(value))
        assert r.identity_error < 1e-9


def test_whitening_stays_thin_or_goes_full(spark):
    rng = np.random.default_rng(8)
    flat = rng.standard_normal((400, 24))
    steep = rng.standard_normal((400, 24)) * (0.5 ** np.arange(24)) * 100
    for x, full in ((flat, True), (steep, False)):
        rows = [[i, [float(c) for c in v], 1] for i, v in enumerate(x)]
        fit = whitening.whole(frame(spark, rows)).select("d", "x").distinct()
        model = whitening.fitted(fit, 4)[24]
        assert model.full is full and model.error < 1e-9
        values = np.linalg.eigvalsh(np.cov(np.floor(256 * x.astype("f4").astype("f8")).T, bias=True))[::-1][:4]
        assert np.allclose(model.variances, values, rtol=1e-10)


def test_whitening_of_odd_tables(spark):
    assert whitening.whitened(frame(spark, [])).count() == 0
    assert whitening.whitened(frame(spark, [[1, None, 1], [2, [], 1]])).count() == 0
    same = whitening.whitened(frame(spark, [[1, [0.5, -0.0], 1], [1, [0.5, 0.0], 1], [None, [0.5, 0.0], 2]])).collect()
    assert len(same) == 6 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, 0.0, 0.0) for r in same)
    big = whitening.whitened(frame(spark, [[1, [1e30, 0.0], 1], [2, [-1e30, 0.0], 1]])).collect()
    assert {r.deviation for r in big} == {2**63 - 1} and {round(abs(r.whitened), 6) for r in big if r.component == 1} == {1.0}


def folded(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked_by_hand(docs, items, k):
    bags = [(i, Counter(folded(t))) for i, t in docs]
    bags = [(i, c) for i, c in bags if c]
    n, total, df = len(bags), sum(c.total() for _, c in bags), Counter(t for _, c in bags for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(folded(text))
    out = []
    for item, ts in asked.items():
        found = []
        for i, c in bags:
            m = 10 + 90 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(lexical, "POSTINGS", 300)
    monkeypatch.setattr(lexical, "BLOCK", 4)
    monkeypatch.setattr(lexical, "PIECE", 50)


def ranking_tables(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["Über", "ÜBER", "x\x80y", "日本語", "A-B", "É"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 5, 30, 120])))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " \n!"), (203, docs[3][1]), (204, docs[3][1]), (3, docs[4][1]), (None, docs[3][1]), (205, "w1 " * 70_000 + "w59"), (206, "z" * 5000 + " w3\x00W2")]
    items = [(k, " ".join(rng.choices(vocabulary, k=8))) for k in range(12)] + [(50, None), (51, "unseen words"), (52, "W1"), (52, "w2"), (None, "w3 w4"), (53, docs[3][1])]
    return docs, items


def test_ranking_like_brute_force(spark, small_blocks):
    docs, items = ranking_tables()
    d = spark.createDataFrame([(i, t, 1, 2, 3, "s") for i, t in docs], "doc_id int, text string, term int, chunk int, df int, score string").repartition(3)
    q = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id int, text string, doc_id int, rank int")
    got = sorted(map(tuple, lexical.ranked(d, q, 5).collect()), key=str)
    assert got == ranked_by_hand(docs, items, 5)
    empty = d.where("false")
    assert lexical.ranked(empty, q).count() == 0 and lexical.ranked(d, q.where("false")).count() == 0 and lexical.ranked(d, q.where("item_id = 51")).count() == 0


def chunk_of(docs):
    chunk = lexical.Chunk()
    for i, t in docs:
        chunk.add(i, None if t is None else t.encode())
    return chunk


def test_blocks_unpack(monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 4)
    docs = list({i: t for i, t in ranking_tables(2)[0] if i is not None}.items())
    bags = [(i, Counter(folded(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in bags), sum(c.total() for _, c in bags)
    words, df, heads, data, ids, m = chunk_of(docs).lists(n, total)
    for w, count, h, x in zip(words, df, heads.to_pylist(), data.to_pylist(), strict=True):
        p = lexical.Postings(h, x)
        at = np.concatenate([p.documents(k) for k in range(len(p.heads))])
        gains = np.concatenate([p.impacts(k, m) for k in range(len(p.heads))])
        want = sorted((i, c[w.decode()]) for i, c in bags if w.decode() in c)
        assert count == len(want) == len(at) and sorted(ids[at].tolist()) == [i for i, _ in want]
        assert [p.heads["best"][k] == p.impacts(k, m).max() for k in range(len(p.heads))].count(False) == 0
        assert sorted(gains.tolist()) == sorted((10**9 * tf // (1000 * tf + 8 * int(m[np.flatnonzero(ids == i)[0]]))) for i, tf in want)


def test_wand_skips_blocks(monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 8)
    docs = [(i, "common " * (1 + i % 3) + " ".join(f"f{i}x{j}" for j in range(i % 50))) for i in range(3000)]
    docs += [(5000 + i, "common rare " * 3) for i in range(12)]
    words, df, heads, data, ids, m = chunk_of(docs).lists(len(docs), sum(len(folded(t)) for _, t in docs))
    lists = [(w, lexical.Postings(heads[words.index(t)].as_py(), data[words.index(t)].as_py())) for t, w in ((b"common", 3), (b"rare", 6000))]
    got, scores, read, blocks = lexical.wand(lists, ids, m, 10, 1)
    assert sorted(ids[got].tolist()) == list(range(5000, 5010)) and len(set(scores.tolist())) == 1
    assert read < blocks / 2
    # a threshold from elsewhere leaves nothing to open
    assert lexical.wand(lists, ids, m, 10, int(scores[0]) + 10**9)[2] == 0


def test_jaccard_runs_go_on_when_every_late_edge_is_new(spark, monkeypatch):
    from pyspark.sql import functions as F

    from patchloom.llm import jaccard

    calls, real = [], jaccard.edges_of

    def edges(body, small):
        calls.append(1)
        found = real(body, small)
        # as if the first group of runs had found nothing
        return found.withColumn("late", F.lit(True)) if len(calls) == 1 else found

    monkeypatch.setattr(jaccard, "edges_of", edges)
    words = [f"w{k}" for k in range(80)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-1], "x"])), (3, "other words altogether in this one")], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0)} and len(calls) == 2


def test_token_store_has_parts_by_bytes(spark, monkeypatch):
    from patchloom.llm import token_store
    from patchloom.llm.common import scratch

    monkeypatch.setattr(token_store, "PART_BYTES", 1000)
    docs = spark.createDataFrame([(i, f"word{i} " * 40) for i in range(200)] + [(None, None)], "doc_id long, text string")
    path = scratch(spark, "parts")
    token_store.write(docs, path, "word_bpe_49k.json")
    blocks = spark.read.parquet(f"{path}/blocks")
    # some 60 kB in parts of 1 kB: many more than the session's four
    assert blocks.select("part").distinct().count() > 30
    assert token_store.summary(spark, path).count() == 201
