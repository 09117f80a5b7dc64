"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length (norm). For a query whose k-th best score so far is s, a bucket whose longest vector has
length l can only help if the cosine s / (|q| l) is at most 1. By that local threshold each bucket is searched in one of
three ways: skipped; by coordinates, where a large cosine confines the unit vector's value at the query's largest
coordinates to an interval; or by length, scanning down to s / |q|. What is left is verified by its exact product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.vectors import ROWS, Best, best_of, dense, matrix, meet, usable

#: Buckets in an octave of length; coordinates that are looked at; the local cosine from which on they are used.
PER_OCTAVE, COORDINATES, BY_COORDINATES = 4, 3, 0.5
#: The longest vectors, against which each query gets its first threshold.
SEED_ROWS = 1024


def quantised(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v array<bigint>) with floor(scale * x), x as double, of the rows whose vectors have finite components only."""
    return usable(embeddings, True).select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("bigint")).alias("v"))


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer products: by doubles where no sum can pass 2 ** 53, else by 64-bit integers."""
    large = max(abs(int(q.min(initial=0))), int(q.max(initial=0))) * max(abs(int(p.min(initial=0))), int(p.max(initial=0))) * q.shape[1]
    return (q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64) if large < 2**53 else q @ p.T


class Bucketed:
    """Vectors of one slice, sorted by length and cut into buckets of lengths within a ratio of each other."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        norms = np.sqrt((v.astype(np.float64) ** 2).sum(1))
        order = np.argsort(-norms, kind="stable")
        self.ids, self.v, self.norms = ids[order], v[order], norms[order]
        self.unit = self.v / np.maximum(self.norms, 1e-300)[:, None]
        level = np.floor(np.log2(np.maximum(self.norms, 1e-300)) * PER_OCTAVE)
        self.cuts = [0, *(np.flatnonzero(np.diff(level)) + 1).tolist(), len(ids)]

    def search(self, q: np.ndarray, q_ids: np.ndarray, best: Best) -> None:
        q_norms = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        q_unit = q / np.maximum(q_norms, 1e-300)[:, None]
        focus = np.argsort(-np.abs(q_unit), 1)[:, :COORDINATES]
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            longest = self.norms[a] * (1 + 1e-9)
            whole, coordinates = [], []
            for k in range(len(q)):
                least = best.limit(k)
                if least is None or q_norms[k] == 0 or longest == 0:
                    whole.append(k)
                    continue
                local = float(least) / (q_norms[k] * longest)
                if local <= 1 + 1e-9:
                    (coordinates if local >= BY_COORDINATES else whole).append(k)
            for k in coordinates:
                t = float(best.limit(k)) / (q_norms[k] * longest) - 1e-9
                ok = np.ones(b - a, bool)
                for f in focus[k]:
                    mid, width = q_unit[k, f] * t, np.sqrt(max(0.0, 1 - t * t) * max(0.0, 1 - q_unit[k, f] ** 2)) + 1e-9
                    x = self.unit[a:b, f]
                    # Within the angle of t the coordinate can reach 1 (or -1) where the query's own is beyond t (-t).
                    ok &= (x >= (-np.inf if q_unit[k, f] <= -t else mid - width)) & (x <= (np.inf if q_unit[k, f] >= t else mid + width))
                of = a + np.flatnonzero(ok & (self.ids[a:b] != q_ids[k]))
                if len(of):
                    self._take(k, _products(q[k : k + 1], self.v[of])[0], self.ids[of], best)
            if whole:
                scores = _products(q[whole], self.v[a:b])
                for k, row in zip(whole, scores, strict=True):
                    least = best.limit(k)
                    # By length: beyond this place no product can reach the threshold.
                    end = b - a if least is None or least <= 0 or q_norms[k] == 0 else int(np.searchsorted(-self.norms[a:b], -float(least) / q_norms[k] * (1 - 1e-9), "right"))
                    of = np.flatnonzero(self.ids[a : a + end] != q_ids[k])
                    self._take(k, row[of], self.ids[a:b][of], best)

    @staticmethod
    def _take(k: int, scores: np.ndarray, ids: np.ndarray, best: Best) -> None:
        least = best.limit(k)
        if least is not None:
            keep = scores >= least
            scores, ids = scores[keep], ids[keep]
        if len(scores) > 4 * best.k:
            edge = np.partition(scores, len(scores) - best.k)[len(scores) - best.k]
            keep = scores >= edge
            scores, ids = scores[keep], ids[keep]
        if len(scores):
            best.add(k, scores, ids)


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k largest integer products with other rows, ties to smaller ids.

    embeddings, queries: vec_id, embedding. A row is its query's own if it has the same id. Rows with a null id or a
    vector that is null, empty or has null or non-finite components take no part; vectors of other lengths than the
    query's are no candidates; repeated rows are candidates each; a repeated query counts once. Products must fit
    64 bits; larger ones wrap. Blocks of queries meet chunks of rows, and each pair of them gives its k best a query.
    """
    rows, asked = (quantised(x, scale).withColumn("d", F.size("v")) for x in (embeddings, queries))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    seeds = rows.select("vec_id", "v").orderBy(length.desc(), "vec_id").limit(SEED_ROWS).toArrow().combine_chunks()
    seed = embeddings.sparkSession.sparkContext.broadcast({d: (i, v) for b in seeds.to_batches() for d, i, v in dense(b)})

    def task(some: pa.Table, asks: pa.Table) -> pa.Table:
        q_ids, q = asks.column("vec_id").to_numpy(), matrix(asks, "v")
        ids, v = some.column("vec_id").to_numpy(), matrix(some, "v")
        best = Best(len(q), k, np.int64)
        floored = _Floored(best, _floor(q_ids, q, *seed.value.get(q.shape[1], (None, None)), k))
        order = np.argsort(-(v.astype(np.float64) ** 2).sum(1), kind="stable")
        for a in range(0, len(order), ROWS):
            Bucketed(ids[order[a : a + ROWS]], v[order[a : a + ROWS]]).search(q, q_ids, floored)
        keep = np.arange(k)[None, :] < best.filled[:, None]
        return pa.table({"query_id": np.repeat(q_ids, best.filled), "vec_id": best.ids[keep], "score": best.scores[keep]})

    found = meet(rows, asked, ["vec_id", "v"], task, "query_id bigint, vec_id bigint, score bigint")
    return best_of(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _floor(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray | None, v: np.ndarray | None, k: int) -> np.ndarray | None:
    """Each query's k-th score among the longest vectors, which what can still matter must reach."""
    if ids is None or len(ids) <= k:
        return None
    scores = _products(q, v)
    scores[q_ids[:, None] == ids[None, :]] = np.iinfo(np.int64).min
    return np.sort(scores, 1)[:, -k]


class _Floored:
    """A Best whose threshold is at least that of the longest vectors."""

    def __init__(self, best: Best, floor: np.ndarray | None):
        self.best, self.floor, self.k = best, floor, best.k

    def limit(self, q: int):
        own = self.best.limit(q)
        if self.floor is None or self.floor[q] == np.iinfo(np.int64).min:
            return own
        return self.floor[q] if own is None else max(own, self.floor[q])

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        self.best.add(q, scores, ids)
