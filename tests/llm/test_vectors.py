import math
import os

import numpy as np
import pytest

from keystrata.llm import ann, topk, vectors

SCHEMA = "vec_id long, embedding array<float>, score string, v int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)


def data(seed: int, n: int, d: int = 12) -> list:
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, d)) * r.lognormal(0, 1, (n, 1))
    v[n // 2 : n // 2 + n // 4] = v[3]  # one very common vector
    v[:5] *= 0
    return [(i * 3, [float(x) for x in row.astype(np.float32)]) for i, row in enumerate(v)]


BAD = [(9001, None), (9002, []), (9003, [1.0, None]), (9004, [float("nan")] * 12), (9005, [float("inf")] * 12), (None, [1.0] * 12), (9006, [1.0, 2.0]), (9060, [3.0, -1.0])]


def exact(rows, ok, queries, measure, k):
    out = {}
    usable = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and ok(v)]
    for q, v in usable:
        if queries(q):
            scored = sorted(((-measure(v, w), i) for i, w in usable if i != q and len(w) == len(v)))[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def floor(v):
    return [math.floor(1024 * float(np.float32(x))) for x in v]


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(topk, "SEED_ROWS", 40)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(vectors, "CHUNK_ROWS", 50)
    rows = data(seed, 240) + BAD
    t = table(spark, rows).repartition(5)
    got = {}
    for r in topk.top_k(t, t.where("vec_id % 10 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = exact(rows, lambda v: True, lambda q: q % 10 == 0, lambda a, b: sum(x * y for x, y in zip(floor(a), floor(b), strict=True)), 10)
    assert got == {q: x for q, x in want.items() if x}


def test_top_k_of_large_values_and_few_rows(spark):
    rows = [(0, [1e5, 3e5]), (1, [2e5, -1e5]), (100, [1e5, 1e5 + 0.3])]
    t = table(spark, rows)
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(t, t.where("vec_id % 100 = 0")).collect()}
    want = exact(rows, lambda v: True, lambda q: q % 100 == 0, lambda a, b: sum(x * y for x, y in zip(floor(a), floor(b), strict=True)), 10)
    assert got == {(q, i): s for q, x in want.items() for i, s in x}
    assert topk.top_k(t.limit(0), t).count() == 0 and topk.top_k(t, t.limit(0)).count() == 0


def test_by_coordinates_loses_nothing():
    """Unit vectors with high cosines take the coordinate way."""
    r = np.random.default_rng(8)
    base = r.normal(size=(20, 8))
    v = np.floor(1024 * np.concatenate([base + 0.05 * r.normal(size=base.shape) for _ in range(30)])).astype(np.int64)
    ids, best = np.arange(len(v)), vectors.Best(20, 5, np.int64)
    for part in np.array_split(ids, 4):
        topk.Bucketed(part, v[part]).search(v[:20], ids[:20], best)
    for q in range(20):
        s = v @ v[q]
        want = sorted((-s[i], i) for i in ids if i != q)[:5]
        assert [(-a, b) for a, b in zip(best.scores[q], best.ids[q], strict=True)] == want


@pytest.mark.parametrize(("partitions", "chunk", "block"), [(3, 16_384, 4096), (16, 100, 7)])
def test_ann_recall_scores_and_ties(spark, monkeypatch, partitions, chunk, block):
    """The same neighbours however rows are partitioned, dealt into chunks or queries into blocks."""
    monkeypatch.setattr(vectors, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", block)
    r = np.random.default_rng(3)
    centres = r.normal(size=(30, 16))
    v = (centres[r.integers(0, 30, 900)] + 0.4 * r.normal(size=(900, 16))).astype(np.float32)
    v[600:] = v[0]
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + BAD + [(9100, [0.0] * 16)]
    t = table(spark, rows).repartition(partitions)
    quantisers, index = ann.build(t, fit_rows=400)
    assert index.where("codes IS NOT NULL OR size(v) < 16").count() == index.count() == 900 + 2
    got = {}
    for x in ann.search(index, quantisers, t.where("vec_id % 20 = 0"), shortlist=40).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    want = exact(rows, any, lambda q: q % 20 == 0, lambda a, b: float(np.float32(a).astype(float) @ np.float32(b).astype(float)), 20)
    assert set(got) == {q for q, x in want.items() if x}
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in got)
    assert hits >= 0.95 * sum(map(len, want.values()))
    measured = dict(rows)
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and len(found) == len(want[q])
        for i, s in found:
            assert abs(s - float(np.float32(measured[q]).astype(float) @ np.float32(measured[i]).astype(float))) < 1e-9
    assert [i for i, _ in got[0]] == [i for i, _ in want[0]]  # equal vectors: the smallest ids
    FOUND.setdefault("ann", got)
    assert FOUND["ann"] == got


FOUND: dict = {}


def test_recall_on_the_table(spark):
    """All vectors of a table against brute force; the shortlist ranks the whole table, not parts of it."""
    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    t = spark.read.parquet(path)
    quantisers, index = ann.build(t)
    both = t.toArrow()
    ids, v = both.column("vec_id").to_numpy(), np.array(both.column("embedding").to_pylist(), float)
    for shortlist, least in ((160, 0.95), (40, 0.9)):
        got = {(x.query_id, x.vec_id) for x in ann.search(index, quantisers, t.where("vec_id % 20 = 0"), shortlist=shortlist).collect()}
        want = {(int(ids[i]), int(j)) for i in np.flatnonzero(ids % 20 == 0) for j in ids[np.argsort(np.where(ids == ids[i], np.inf, -(v @ v[i])), kind="stable")[:20]]}
        assert len(got) == len(want) and len(got & want) >= least * len(want)


def test_lists_are_rows_of_bounded_size():
    """A block's lists are a row for each group of queries, so that merging holds few of them, however large the block."""
    import pyarrow as pa

    class Shared:
        value: dict = {}

    r, n, k = np.random.default_rng(2), 2 * ann.GROUP + 9, 20
    q, v = r.integers(-9, 9, (n, 4)).astype(float), r.integers(-9, 9, (300, 4)).astype(float)
    asks = pa.table({"vec_id": pa.array(r.permutation(n)), "v": pa.array(list(q)), "d": pa.array([4] * n), "_block": pa.array([3] * n), "_chunk": pa.array([1] * n)})
    some = pa.table({"vec_id": pa.array(np.arange(300)), "v": pa.array(list(v)), "codes": pa.nulls(300, pa.binary()), "ratio": pa.array(np.ones(300, np.float32))})
    out = ann._ranker(Shared, k)(some, asks)
    assert out.column("_part").to_pylist() == [0, 1, 2] and out.column("_block").to_pylist() == [3] * 3
    assert max(map(len, out.column("lists").to_pylist())) <= 16 + ann.GROUP * (8 + 12 * k)
    lists = [ann.Lists.unpacked(x) for x in out.column("lists").to_pylist()]
    assert np.concatenate([x.queries for x in lists]).tolist() == list(range(n))
    place = np.argsort(asks.column("vec_id").to_numpy())
    want = [np.lexsort((np.arange(300), -(v @ q[i])))[:k].tolist() for i in place]
    assert np.concatenate([x.ids for x in lists]).tolist() == want


def test_ann_of_nothing(spark):
    t = table(spark, BAD[:5])
    quantisers, index = ann.build(t)
    assert index.count() == 0 and ann.search(index, quantisers, t).count() == 0


def test_beam_search_beats_greedy_and_tables_give_products():
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 10))
    q = ann.AdditiveQuantiser.fit(x, codebooks=4, words=16)
    error = lambda beam: ((x - q.decode(q.encode(x, beam))) ** 2).sum()
    assert error(8) <= error(1)
    codes, tables = q.encode(x[:5]), q.tables(x[:3])
    sums = np.array([[sum(tables[m, c[m], k] for m in range(4)) for c in codes] for k in range(3)])
    assert np.allclose(sums, x[:3] @ q.decode(codes).T, atol=1e-4)
