import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keystrata.llm import quality, toxicity

WORDS = [f"word{i}" for i in range(300)]
BAD = ["grobian", "vilain", "scoundrel"]


def documents(seed: int, n: int) -> tuple[list, list]:
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = r.choices(WORDS, k=r.choice([5, 40, 200]))
        bad = i % 4 == 0
        if bad:
            for b in r.sample(BAD, 2):
                w.insert(r.randrange(len(w) + 1), b.upper() + "!" if r.random() < 0.3 else b)
        docs.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(bad)))
    return docs, labels


def test_toxic_words_are_learned_and_held_out_labels_are_not(make, spark):
    docs, labels = documents(1, 1200)
    table = make([*docs, (5000, None), (5001, ""), (None, "grobian vilain"), (5002, "x " * 50_000 + "grobian vilain scoundrel")], ("score", "slots"))
    marks = spark.createDataFrame([*labels, (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(table, marks).collect()}
    assert len(out) == 1204
    for i, _, t in labels:
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= out[i].score <= 1 and out[i].predicted == (out[i].score >= 0.3)
    held = [(out[i].predicted, t) for i, _, t in labels if out[i].held_out]
    assert np.mean([p == t for p, t in held]) > 0.97
    assert out[None].predicted == 1 and out[5002].predicted == 1 and out[5000].score == out[5001].score < 0.3
    wrong = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in toxicity.toxicity(table, wrong).collect()}
    assert again == {i: r.score for i, r in out.items()}


def test_toxicity_without_labels(make, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.toxicity(make([(1, "a b")]), none).collect()] == [0.5]
    assert toxicity.toxicity(make([(1, "a b")]).limit(0), none).count() == 0


def test_ftrl_equals_a_plain_version():
    """The published update, one coordinate at a time in dictionaries."""
    r = np.random.default_rng(3)
    rows = [(np.unique(r.integers(0, 300, 20)), int(y)) for y in r.integers(0, 2, 200)]
    p = toxicity.Ftrl()
    kept, w, bias = toxicity.train(iter(rows), p)
    z, n = {}, {}

    def weight(i, l1):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return (math.copysign(l1, z[i]) - z[i]) / ((p.beta + math.sqrt(n[i])) / p.alpha + (p.l2 if i != "bias" else 0.0))

    for _ in range(p.epochs):
        for slots, y in rows:
            of = {**{int(i): weight(int(i), p.l1) for i in slots}, "bias": weight("bias", 0.0)}
            g = 1 / (1 + math.exp(-sum(of.values()))) - y
            for i, wi in of.items():
                s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / p.alpha
                z[i], n[i] = z.get(i, 0.0) + g - s * wi, n.get(i, 0.0) + g * g
    want = {i: weight(i, p.l1) for i in z if i != "bias" and weight(i, p.l1)}
    assert dict(zip(kept.tolist(), w.tolist(), strict=True)) == pytest.approx(want) and bias == pytest.approx(weight("bias", 0.0))


def test_repeated_rows_are_learned_from_once(make, spark):
    docs, labels = documents(2, 300)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    once, often = ({r.doc_id: r.score for r in toxicity.toxicity(make(d), marks).collect()} for d in (docs, docs + docs[:50] * 3))
    assert once == often


def test_ftrl_is_sparse():
    r = np.random.default_rng(1)
    rows = [(np.unique(np.append(r.integers(10, 4000, 30), np.array([5] if y else [], np.int64))), y) for y in r.integers(0, 2, 400).tolist()]
    kept, w, _ = toxicity.train(iter(rows), toxicity.Ftrl())
    assert kept[np.argmax(w)] == 5 and len(kept) < 400


def junk(r: random.Random, text: str) -> str:
    kind = r.randrange(4)
    w = text.split()
    if kind == 0:
        return " ".join(x for x in w[:6] for _ in range(20))
    if kind == 1:
        return " ".join(x.upper() + "!!" for x in w)
    return " | ".join(w) if kind == 2 else " ".join(x + r.choice(["%%%", "***", "$$$"]) for x in w)


def test_quality_views_and_null_rows(make, spark):
    r = random.Random(2)
    docs = []
    labels = []
    for i in range(900):
        text = ".\n".join(" ".join(r.choices(WORDS, k=12)) for _ in range(r.randint(1, 9)))
        good = i % 3 > 0
        docs.append((i, text if good else junk(r, text), f"s{i % 5}"))
        if i % 2 == 0:
            labels.append((i, int(good)))
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int")
    out = {x.doc_id: x for x in quality.quality(make([*docs, (None, None), (9999, "")], ("score", "_label", "x")), marks).collect()}
    assert len(out) == 902 and all(0 <= x.score <= 1 for x in out.values())
    judged = [(out[i].keep, q) for i, q in labels if out[i].held_out]
    assert np.mean([k == q for k, q in judged]) > 0.95
    assert np.mean([out[i].keep == (i % 3 > 0) for i in range(1, 900, 2)]) > 0.95


@pytest.mark.parametrize("labels", [[], [(1, 1)]])
def test_quality_without_labels(make, spark, labels):
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    assert {r.score for r in quality.quality(make([(1, "a b"), (2, None)]), marks).collect()} == {0.5}
    assert quality.quality(make([(1, "a")]).limit(0), marks).count() == 0


def test_views_teach_each_other():
    """A view that few labels say little of learns from the other's labels of many rows, and both together are no worse."""
    r = np.random.default_rng(4)
    y = (r.random(4000) < 0.5).astype(float)
    a = y[:, None] * 4 + r.normal(size=(4000, 1))
    b = y[:, None] * r.choice([0.0, 0.5], 30) + r.normal(size=(4000, 30))
    fold = np.arange(120) % 2 == 0
    fit = lambda rounds: quality.CoTrained.fit([a[:120], b[:120]], y[:120], fold, [a[120:3000], b[120:3000]], rounds=rounds, sure=0.9)
    accuracy = lambda p: np.mean((p > 0.5) == y[3000:])
    (alone, each_alone), (both, each) = (fit(n).scores([a[3000:], b[3000:]]) for n in (0, 4))
    assert accuracy(each[1]) > accuracy(each_alone[1]) + 0.03
    assert accuracy(both) >= accuracy(alone) - 0.002 and accuracy(both) > 0.97


def test_metadata_is_all_that_its_view_sees(make, spark):
    """Rows of equal language, source and size have one metadata score, whatever their texts."""
    docs, labels = documents(9, 400)
    docs = [(i, t, f"s{i % 3}") for i, t in docs]
    table = make(docs).withColumn("n_chars", F.lit(None).cast("long"))
    marks = spark.createDataFrame([(i, q) for i, q, _ in labels[:300]], "doc_id long, quality int")
    out = quality.quality(table, marks).join(table.select("doc_id", "source"), "doc_id").select("source", "metadata_score").distinct().collect()
    assert len(out) == 3


def test_query_equals_a_fit_in_memory(make, spark):
    """The distributed sums against one array: repeated rows of a labelled id count once, all scores agree."""
    docs, labels = documents(12, 500)
    docs += docs[:40]
    table = make(docs).repartition(5)
    marks = spark.createDataFrame([(i, q) for i, q, _ in labels[:200]], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.quality(table, marks).collect()}
    rows = quality._features(table.select("doc_id", "text", "lang", "source", "n_chars")).toArrow().to_pylist()
    x = dict(sorted((r["doc_id"], r["x"]) for r in rows))
    views = lambda ids: quality._unpacked(pa.array([x[i] for i in ids], pa.binary()))
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    known = [i for i in range(200) if not held(i)]
    pool = [r for r in rows if r["doc_id"] >= 200 and not held(r["doc_id"])]

    class Pool:
        def total(self, part):
            return part(quality._unpacked(pa.array([r["x"] for r in pool], pa.binary())), np.array([r["_tie"] for r in pool]))

    fold = np.array([zlib.crc32(b"fold%d" % i) % 4 == 0 for i in known])
    model = quality.CoTrained.fit(views(known), np.array([labels[i][1] for i in known], float), fold, Pool())
    want = dict(zip(x, model.scores(views(x))[0], strict=True))
    assert max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_pool_has_no_bound(make, spark):
    """A source that occurs only in 40 unlabelled rows, which come last in the order of hashes, has its own weight."""
    r = random.Random(5)
    order = [x.id for x in spark.range(12_000).selectExpr("id", "xxhash64(3, id) AS h").orderBy("h").collect() if zlib.crc32(str(x.id).encode()) % 4 != 2]
    assert len(order) > 8600
    docs, labels = [], []
    for at, i in enumerate(order):
        text, good, rare = " ".join(r.choices(WORDS, k=12)), at % 4 > 0, at >= len(order) - 40
        docs.append((i, text if good and not rare else text.upper() + " !! %% !!", "rare" if rare else "bad" if not good and at % 8 else "other"))
        if at < 300:
            labels.append((i, int(good)))
    text = " ".join(r.choices(WORDS, k=12))
    a, b = [i for i in range(20_000, 20_100) if zlib.crc32(str(i).encode()) % 4 == 2][:2]
    docs += [(a, text, "rare"), (b, text, "fresh")]
    out = {x.doc_id: x.metadata_score for x in quality.quality(make(docs), spark.createDataFrame(labels, "doc_id long, quality int")).where("held_out").collect()}
    assert out[a] < out[b] - 1e-4


def test_stored_pool_adds_up_as_one_in_memory(make, spark):
    docs, _ = documents(6, 300)
    rows, _ = quality.store(quality._features(make(docs).repartition(3)).drop("doc_id"), "pool")
    got = rows.toArrow()
    views = quality._unpacked(got.column("x"))
    part = quality._moments([v.mean(0) for v in views])
    assert np.allclose(quality.StoredPool(rows).total(part), quality.LocalPool(views).total(part))
    assert np.allclose(quality.StoredPool(rows.limit(0)).total(part), 0)
