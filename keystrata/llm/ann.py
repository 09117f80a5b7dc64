"""Approximate nearest neighbours by additive quantisation.

A vector is coded as the sum of one codeword from each of several codebooks of the full dimension. Codebooks start as
k-means of residuals and are refitted in turn by least squares, each to what the others leave; codes are found by a beam
search that carries the residuals. The index holds each row's codes and the ratio of its norm to its reconstruction's.
A query's products with all codewords make lookup tables; sums of table entries times the stored ratio rank all rows,
block by block and then together, and the exact products of the SHORTLIST best over the whole table decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.shared import small, store
from keystrata.llm.vectors import ROWS, best_of, dense, matrix, meet, usable

#: The codebooks are fitted on at most this many rows, those with the smallest hash of their id; all rows are indexed.
FIT_ROWS = 8192
CODEBOOKS, WORDS, BEAM = 24, 256, 4
#: Distinct vectors of the whole table that are compared exactly for each query.
SHORTLIST = 160
#: Bytes of query vectors that may be broadcast; above, they are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Queries whose table sums are made at once and whose lists are a row, and such rows of several chunks that are merged at once.
GROUP, MERGED = 256, 8
PACKED = "d int, _block int, _part int, _chunk int, lists binary"


class AdditiveQuantiser:
    """Codebooks of shape (codebooks, words, dimension)."""

    def __init__(self, codebooks: np.ndarray):
        self.books = codebooks.astype(np.float32)
        self.squares = (self.books**2).sum(2)

    @classmethod
    def fit(cls, x: np.ndarray, codebooks: int = CODEBOOKS, words: int = WORDS, rounds: int = 2, seed: int = 5) -> AdditiveQuantiser:
        rng = np.random.default_rng(seed)
        x, books = x.astype(np.float32), np.zeros((codebooks, words, x.shape[1]), np.float32)
        rest = x.copy()
        for m in range(codebooks):
            c = rest[rng.choice(len(rest), words, replace=len(rest) < words)]
            for _ in range(6):
                c = _means(rest, _nearest(rest, c), c)
            books[m] = c
            rest -= c[_nearest(rest, c)]
        made = cls(books)
        for _ in range(rounds):
            codes = made.encode(x)
            rest = x - made.decode(codes)
            for m in range(codebooks):
                own = rest + made.books[m][codes[:, m]]
                made.books[m] = _means(own, codes[:, m], made.books[m])
                rest = own - made.books[m][codes[:, m]]
            made = cls(made.books)
        return made

    def encode(self, x: np.ndarray, beam: int = BEAM, rows: int = 1024) -> np.ndarray:
        """Codes (rows, codebooks) by beam search over the codebooks."""
        return np.concatenate([self._encode(x[a : a + rows].astype(np.float32), beam) for a in range(0, len(x), rows)] or [np.zeros((0, len(self.books)), np.int64)])

    def _encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        n, words = len(x), self.books.shape[1]
        row, rest = np.arange(n)[:, None], x[:, None, :]
        codes, error = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32)
        for m, book in enumerate(self.books):
            step = (self.squares[m] - 2 * (rest.reshape(-1, x.shape[1]) @ book.T)).reshape(n, -1, words) + error[:, :, None]
            flat = step.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            error = np.take_along_axis(flat, best, 1)
            path, word = best // words, best % words
            codes = np.concatenate([codes[row, path], word[:, :, None]], 2)
            rest = rest[row, path] - book[word]
        return codes[np.arange(n), error.argmin(1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(len(self.books)), codes].sum(1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Products of all codewords with the queries: (codebooks, words, queries)."""
        return np.einsum("mkd,qd->mkq", self.books, queries.astype(np.float32), optimize=True)


def _nearest(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (2 * rows @ words.T - (words**2).sum(1)).argmax(1)


def _means(rows: np.ndarray, word: np.ndarray, old: np.ndarray) -> np.ndarray:
    """The mean of each word's rows; words without rows stay."""
    order = np.argsort(word, kind="stable")
    cuts = np.searchsorted(word[order], np.arange(len(old) + 1))
    count, out = np.diff(cuts), old.copy()
    held = np.flatnonzero(count)
    out[held] = np.add.reduceat(rows[order], cuts[held], axis=0) / count[held][:, None]
    return out


def build(embeddings: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[dict[int, AdditiveQuantiser], DataFrame]:
    """A quantiser for each vector length of the sample, and the stored index (vec_id, v, codes, ratio) of all rows.

    Rows with a null id or a vector that is null, empty, zero or has null or non-finite components take no part. Rows
    of a length that the sample lacks have null codes and are ranked by their exact products.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings, False)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).toArrow().combine_chunks()
    quantisers = {d: AdditiveQuantiser.fit(v, words=min(WORDS, max(2, len(v) // 8))) for b in sample.to_batches() for d, _, v in dense(b)}
    shared = spark.sparkContext.broadcast(quantisers)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for d, ids, v in dense(batch):
                codes, ratio = [None] * len(ids), np.ones(len(ids), np.float32)
                if d in shared.value:
                    found = shared.value[d].encode(v)
                    near = np.sqrt((shared.value[d].decode(found).astype(np.float64) ** 2).sum(1))
                    ratio = (np.sqrt((v**2).sum(1)) / np.maximum(near, 1e-12)).astype(np.float32)
                    codes = [c.tobytes() for c in found.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(v), pa.list_(pa.float64())), pa.array(codes, pa.binary()), pa.array(ratio)], names=["vec_id", "v", "codes", "ratio"])

    index, _ = store(rows.mapInArrow(apply, "vec_id bigint, v array<double>, codes binary, ratio float"), "index")
    return quantisers, index


def search(index: DataFrame, quantisers: dict[int, AdditiveQuantiser], queries: DataFrame, k: int = 20, shortlist: int = SHORTLIST) -> DataFrame:
    """query_id, rank, vec_id and score (exact inner product) of the k nearest found for each query, ties to smaller ids.

    A row is its query's own if it has the same id; of equal vectors the k + 1 smallest ids stand for all, as no others
    can be among the k, and share one place in the shortlist; vectors of other lengths than the query's are no
    candidates; a repeated query counts once. The shortlist is the same however the index is partitioned.
    """
    spark = index.sparkSession
    # Equal vectors: the smallest ids, cut within each task before they meet.
    same = best_of(index.withColumn("query_id", F.xxhash64("v")).withColumn("_less", -F.col("vec_id")), k + 1, "_less")
    distinct = same.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("codes").alias("codes"), F.first("ratio").alias("ratio"))
    rows, _ = store(distinct.withColumn("d", F.size("v")), "distinct")
    asked, _ = store(usable(queries, False).withColumn("d", F.size("v")), "queries")
    shared = spark.sparkContext.broadcast(quantisers)
    coded = rows.select("vec_id", "codes", "ratio", "d", F.when(F.col("codes").isNull(), F.col("v")).alias("v"))
    packed, _ = store(meet(coded, asked, ["vec_id"], _ranker(shared, shortlist), PACKED), "lists")
    last = packed.agg(F.coalesce(F.max("_chunk"), F.lit(0))).first()[0]
    while last:
        packed = packed.withColumn("_chunk", F.expr(f"_chunk DIV {MERGED}").cast("int")).groupBy("d", "_block", "_part", "_chunk").applyInArrow(_merged, PACKED)
        last //= MERGED
    short, _ = store(packed.mapInArrow(_unpacked, "query_id bigint, vec_id bigint"), "shortlist")

    vectors = asked.groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("d", "v")).alias("q")).select("query_id", F.col("q.v").alias("q"))
    bytes_ = asked.agg(F.coalesce(F.sum("d") * 8, F.lit(0))).first()[0]
    pairs = short.join(rows.select("vec_id", "v", "ids"), "vec_id").join(F.broadcast(vectors) if bytes_ <= BROADCAST_BYTES else vectors, "query_id")
    scored = pairs.select("query_id", "vec_id", "ids", "q", "v").mapInArrow(_exact, "query_id bigint, ids array<bigint>, vec_id bigint, score double")
    near = best_of(scored, k + 1).drop("rank", "vec_id").withColumn("vec_id", F.explode("ids")).where("vec_id <> query_id")
    return best_of(near, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        score, sizes = np.zeros(batch.num_rows), np.diff(batch.column("v").offsets.to_numpy())
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            part = pa.Table.from_batches([batch.take(pa.array(at))])
            score[at] = np.einsum("nd,nd->n", matrix(part, "q"), matrix(part, "v"))
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("ids"), batch.column("vec_id"), pa.array(score)], names=["query_id", "ids", "vec_id", "score"])


class Lists:
    """The ``keep`` best rows of each query, (guess, id) with larger guesses and then smaller ids first, in one row of a table."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, guess: np.ndarray):
        self.queries, self.ids, self.guess = queries, ids, guess

    @classmethod
    def of(cls, queries: np.ndarray, which: np.ndarray, ids: np.ndarray, guess: np.ndarray, keep: int) -> Lists:
        """From rows (place of the query in queries, id, guess) in any order."""
        order = np.lexsort((ids, -guess, which))
        which, ids, guess = which[order], ids[order], guess[order]
        place = np.arange(len(which)) - np.searchsorted(which, which)
        which, ids, guess, place = (x[place < keep] for x in (which, ids, guess, place))
        out = cls(queries, np.full((len(queries), keep), -1), np.full((len(queries), keep), -np.inf, np.float32))
        out.ids[which, place], out.guess[which, place] = ids, guess
        return out

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        which, at = np.nonzero(self.guess > -np.inf)
        return which, self.ids[which, at], self.guess[which, at]

    def packed(self) -> bytes:
        head = np.array([len(self.queries), self.ids.shape[1]])
        return b"".join(x.astype(t).tobytes() for x, t in ((head, "<i8"), (self.queries, "<i8"), (self.ids, "<i8"), (self.guess, "<f4")))

    @classmethod
    def unpacked(cls, blob: bytes) -> Lists:
        n, keep = np.frombuffer(blob, "<i8", 2)
        queries, ids = np.frombuffer(blob, "<i8", n, 16), np.frombuffer(blob, "<i8", n * keep, 16 + 8 * n)
        return cls(queries, ids.reshape(n, keep), np.frombuffer(blob, "<f4", n * keep, 16 + 8 * n * (1 + keep)).reshape(n, keep))


def _merged(table: pa.Table) -> pa.Table:
    """One row of lists from those of some chunks, which hold the same queries."""
    lists = [Lists.unpacked(x) for x in table.column("lists").to_pylist()]
    which, ids, guess = (np.concatenate(x) for x in zip(*(x.rows() for x in lists), strict=True))
    made = Lists.of(lists[0].queries, which, ids, guess, lists[0].ids.shape[1])
    return table.slice(0, 1).drop_columns("lists").append_column("lists", pa.array([made.packed()], pa.binary())).select(["d", "_block", "_part", "_chunk", "lists"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        for blob in batch.column("lists").to_pylist():
            lists = Lists.unpacked(blob)
            which, ids, _ = lists.rows()
            yield pa.RecordBatch.from_arrays([pa.array(lists.queries[which]), pa.array(ids)], names=["query_id", "vec_id"])


def _ranker(shared, shortlist: int):
    """The shortlist best rows of a chunk for each query of a block, by table sums, as a row for each GROUP of queries."""

    def task(some: pa.Table, asks: pa.Table) -> pa.Table:
        asks = asks.take(pa.array(np.argsort(asks.column("vec_id").to_numpy(), kind="stable")))
        q_ids, q, ids = asks.column("vec_id").to_numpy(), matrix(asks, "v"), some.column("vec_id").to_numpy()
        quantiser, ratio = shared.value.get(q.shape[1]), some.column("ratio").to_numpy()
        codes = None if quantiser is None else np.frombuffer(b"".join(some.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
        keep, out = min(shortlist, len(ids)), []
        for a in range(0, len(q), GROUP):
            part = q[a : a + GROUP]
            guess = np.empty((len(ids), len(part)), np.float32)
            lut = None if quantiser is None else quantiser.tables(part)
            for b in range(0, len(ids), ROWS):
                if lut is None:
                    guess[b : b + ROWS] = matrix(some.slice(b, ROWS), "v") @ part.T
                    continue
                total = np.zeros((len(codes[b : b + ROWS]), len(part)), np.float32)
                for m, words in enumerate(codes[b : b + ROWS].T):
                    total += lut[m][words]
                guess[b : b + ROWS] = total * ratio[b : b + ROWS, None]
            guess = np.ascontiguousarray(guess.T)
            edge = np.partition(guess, len(ids) - keep, axis=1)[:, len(ids) - keep]
            which, at = np.nonzero(guess >= edge[:, None])
            out.append(Lists.of(q_ids[a : a + GROUP], which, ids[at], guess[which, at], shortlist).packed())
        d, block, chunk = (pa.array([asks.column(c)[0].as_py()] * len(out), pa.int32()) for c in ("d", "_block", "_chunk"))
        return pa.table([d, block, pa.array(range(len(out)), pa.int32()), chunk, pa.array(out, pa.binary())], names=["d", "_block", "_part", "_chunk", "lists"])

    return task
