"""The pipeline against a brute-force version on a small fixture."""

import collections
import random

import brute
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from keystrata.llm import packing  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, make, tmp_path_factory):
    r = random.Random(6)
    words = [f"word{i}" for i in range(500)]
    docs, labels = [], []
    for i in range(400):
        w = r.choices(words, k=r.choice([12, 60, 150]))
        toxic = i % 5 == 0
        if toxic:
            w[3:3] = ["grobian", "vilain"]
        if i % 11 == 1:
            w[5:5] = [f"password=hunter{i:06d}"]
        docs.append((i, " ".join(w), "big" if i % 3 else f"small{i % 2}"))
        labels.append((i, 1, int(toxic)))
    for i in range(400, 460):
        source = docs[r.choice([1, 2, 3, 4, 7, 8])]
        docs.append((i, source[1] + (" tail" if i % 2 else ""), "big"))
    docs += [(460, "", "big"), (461, None, "small1")]
    path = tmp_path_factory.mktemp("tables")
    make(docs).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), docs


def test_equals_brute_force(spark, folder):
    path, docs = folder
    toxic = {i for i, t, _ in docs if t and "grobian" in t}
    kept = [d for d in docs if d[0] not in toxic]
    group = brute.groups([(i, t) for i, t, _ in kept])
    kept = [d for d in kept if group[d[0]][1] == d[0]]
    clean = {}
    for i, t, s in kept:
        for a, _, b in reversed(brute.base_spans(t)):
            t = t[:a] + "[SECRET]" + t[b:]
        clean[i] = (t, s)
    coder = packing.Encoder(corpus_pipeline.TOKENIZER)
    out = corpus_pipeline.run(spark, path).collect()
    uses = collections.Counter((r.doc_id, r.piece) for r in out)
    assert {i for i, _ in uses} == set(clean)
    assert max(uses.values()) == 2 and any(n == 1 for n in uses.values())
    for r in out:
        text, source = clean[r.doc_id]
        coded = next(coder.encode([text or ""])) + b"\0\0\0\0"
        assert r.length == len(coded) // 4 - r.start if r.start else r.length == min(2048, len(coded) // 4)
        assert source != "big" or uses[r.doc_id, r.piece] == 1  # the largest source is used once
    seqs = collections.defaultdict(list)
    for r in out:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(seqs) <= -(-sum(r.length for r in out) // 2048) + 1


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder[0])
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), folder[0]).count() == 0


def test_repeated_rows_are_copies(spark, folder, make):
    docs = make([(1, "a b c d e f"), (1, "a b c d e f"), (None, "x"), (None, "x"), (2, "A b c d e f")])
    kept = corpus_pipeline.without_copies(spark, docs, folder[0])
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "x"), (0, "x"), (1, "a b c d e f")]
