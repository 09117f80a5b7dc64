"""What the vector searches share: queries and rows dealt into blocks that meet, dense batches, merging of best lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries in a block and rows in a chunk, about: what one task holds at once. Each block meets each chunk.
BLOCK_QUERIES, CHUNK_ROWS = 4096, 16_384
#: Rows that are scored at once within a chunk.
ROWS = 2048


def usable(embeddings: DataFrame, allow_zero: bool) -> DataFrame:
    """(vec_id, v array<double>) of rows with an id and a vector of finite components, not empty, and not zero unless allowed."""
    v = F.col("embedding").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").where(F.forall("v", finite))
    return rows if allow_zero else rows.where(F.exists("v", lambda x: x != 0))


def dense(batch: pa.RecordBatch, column: str = "v") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each vector length in a batch: it, the ids and the matrix."""
    lists = batch.column(column)
    ids, sizes = batch.column("vec_id").to_numpy(), np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else sizes
    for d in np.unique(sizes):
        of = np.flatnonzero(sizes == d)
        yield int(d), ids[of], flat[starts[of][:, None] + np.arange(d)]


def meet(rows: DataFrame, queries: DataFrame, key: list[str], task: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``task`` for every block of queries and chunk of rows of one vector length.

    rows: columns ``key`` tells apart and ``d``, the vector's length; queries: (vec_id, v, d). Nothing passes the driver;
    what is shuffled is the rows once for each block and the queries once for each chunk, so both come in large pieces.
    ``task`` finds the numbers of both in the columns _chunk and _block.
    """
    asked = queries.groupBy("vec_id").agg(F.min(F.struct("d", "v")).alias("q")).select("vec_id", "q.v", "q.d")
    chunks = max(1, -(-rows.count() // CHUNK_ROWS))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("_chunk", F.pmod(F.xxhash64(*key), F.lit(chunks)).cast("int")).withColumn("_block", all_of(blocks))
    right = asked.withColumn("_block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("_chunk", all_of(chunks))
    names = [x.split()[0] for x in schema.split(", ")]

    def apply(some: pa.Table, asks: pa.Table) -> pa.Table:
        if not some.num_rows or not asks.num_rows:
            return _none(schema)
        return task(some, asks).select(names)

    return left.groupBy("d", "_chunk", "_block").cogroup(right.groupBy("d", "_chunk", "_block")).applyInArrow(apply, schema)


def _none(schema: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "binary": pa.binary()}
    return pa.table({n: pa.array([], kinds[t]) for n, t in (x.split() for x in schema.split(", "))})


def matrix(table: pa.Table, column: str, dtype=None) -> np.ndarray:
    """A column of lists of one length."""
    lists = table.column(column).combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
    return flat if dtype is None else flat.astype(dtype)


class Best:
    """The k best (score, id) of each query so far: larger scores first, then smaller ids."""

    def __init__(self, n: int, k: int, dtype):
        low = np.iinfo(dtype).min if np.issubdtype(dtype, np.integer) else -np.inf
        self.scores = np.full((n, k), low, dtype)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.filled = np.zeros(n, np.int64)
        self.k = k

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores[q, : self.filled[q]], scores]), np.concatenate([self.ids[q, : self.filled[q]], ids])
        order = np.lexsort((i, -s))[: self.k]
        n = self.filled[q] = len(order)
        self.scores[q, :n], self.ids[q, :n] = s[order], i[order]

    def limit(self, q: int):
        """The score that a candidate must reach, or None while there are fewer than k."""
        return self.scores[q, self.k - 1] if self.filled[q] == self.k else None


def best_of(found: DataFrame, k: int, score: str = "score", tie: str = "vec_id") -> DataFrame:
    """found with rank, only the k best of each query. Each task's rows are cut to k a query before they are dealt out."""
    order = [F.col(score).desc(), F.col(tie)]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
