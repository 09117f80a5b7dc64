import collections
import math

from keystrata.llm import mixing


def docs_of(make, sizes: dict):
    rows, k = [], 0
    for source, (n, words) in sizes.items():
        for _ in range(n):
            rows.append((k, " ".join(["w"] * words), source))
            k += 1
    return make(rows)


def test_exponent_meets_the_repetition_limit(spark):
    shares = spark.createDataFrame([("a", 0.9), ("b", 0.1)], "s string, share double")
    a = mixing.exponent(shares, max_repeat=1.5)
    assert abs((0.1 / 0.9) ** (a - 1) - 1.5) < 1e-4 and (0.1 / 0.9) ** (a - 1) <= 1.5
    assert mixing.exponent(shares, max_repeat=1.0) == 1.0 and mixing.exponent(shares, max_repeat=100) == 0.0 and mixing.exponent(shares) == 1.0
    assert mixing.exponent(shares.limit(0), max_repeat=2) == 1.0


def test_exponent_meets_the_entropy(spark):
    shares = spark.createDataFrame([("a", 0.7), ("b", 0.2), ("c", 0.1)], "s string, share double")
    a = mixing.exponent(shares, entropy=1.0)
    w = [p**a for p in (0.7, 0.2, 0.1)]
    assert abs(-sum(x / sum(w) * math.log(x / sum(w)) for x in w) - 1.0) < 1e-5


def test_every_document_is_used_and_weights_hold(make):
    docs = docs_of(make, {"big": (600, 10), "mid": (200, 5), "small": (100, 4)})
    out = mixing.mix(docs, max_repeat=2.0).collect()
    used = collections.Counter(r.doc_id for r in out)
    assert set(used) == set(range(900)) and max(used.values()) <= 2
    tokens = collections.Counter()
    for r in out:
        tokens[r.source] += r._tokens
        assert 0 <= r._order < 1
    weight = {r.source: r._weight for r in out}
    assert abs(sum(weight.values()) - 1) < 1e-9
    for s, n in tokens.items():
        assert abs(n - weight[s] * sum(tokens.values())) <= 10
    epochs = {(r.doc_id, r._epoch) for r in out}
    assert len(epochs) == len(out)


def test_budget_cuts_and_repeats(make):
    docs = docs_of(make, {"a": (100, 10), "b": (100, 10)})
    assert sum(r._tokens for r in mixing.mix(docs, budget=1000).collect()) == 1000
    assert sum(r._tokens for r in mixing.mix(docs, budget=5500).collect()) in range(5480, 5521)
    assert mixing.mix(docs, budget=0).count() == 0


def test_nulls_empty_texts_ties_and_clashing_columns(make, spark):
    rows = [(1, "a b", None), (1, "a b", None), (None, "c", "x"), (3, None, "x"), (4, "", "void"), (5, "a", "source:"), (6, "q", "")]
    docs = make(rows, ("_source", "rest", "share"))
    out = mixing.mix(docs)
    assert out.columns == [c for c in docs.columns if c != "_source"] + list(mixing.ADDED)
    got = out.collect()
    assert {(r.doc_id, r.source, r._source) for r in got} == {(i, s, s) for i, _, s in rows}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_same_mixture_however_partitioned(make):
    docs = docs_of(make, {"big": (300, 7), "small": (50, 3)})
    key = lambda df: sorted((r.doc_id, r._epoch) for r in df.collect())
    assert key(mixing.mix(docs.repartition(1))) == key(mixing.mix(docs.repartition(7)))


def test_no_python_on_the_executors(make):
    plan = mixing.mix(docs_of(make, {"a": (3, 2)}))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
