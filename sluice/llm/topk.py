"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

Candidate vectors come in blocks. For a block, every dimension (term) has a posting list: the rows with a nonzero
component there, and the components. The query rows that have the term scatter query weight times posting weights
into a dense score array (queries x rows of the block). Each query's best k of a block are cut out by partition
selection, and the blocks' bests are merged by rank.

The query set is cut into blocks of a fixed number of rows and so are the candidates; each pair of a query block and a
candidate block is a piece of work, whose task holds the query block and takes its candidates in slices. Nothing goes
through the driver and nothing is broadcast. All arithmetic is on integers.

Defined cases: a vector that is null or has a null or non-finite component takes no part; a null id takes no part;
rows that share an id are candidates each, and queries each; a query never meets rows of its own id; vectors of
unequal length are compared over the dimensions that both have; equal scores are ordered by id; an empty table
gives no rows; columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, slices

SCHEMA = "query_no long, query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """vec_id and w: floor(scale * x) of every component, of the vectors that take part."""
    v, i = F.col(f"`{vec_col}`"), F.col(f"`{id_col}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = v.isNotNull() & i.isNotNull() & ~F.coalesce(bad, F.lit(True))
    return vectors.where(whole).select(i.cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("w"))


def dense(b: pa.RecordBatch, column: int) -> np.ndarray:
    """The list column as an int64 matrix, short rows filled with zeros."""
    lists = b.column(column)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores (queries x rows), gathered term at a time."""
    scores = np.zeros((len(queries), len(rows)), np.int64)
    for term in range(min(queries.shape[1], rows.shape[1])):
        having = np.flatnonzero(queries[:, term])
        posting = np.flatnonzero(rows[:, term])
        if len(having) and len(posting):
            weights = rows[posting, term]
            if len(posting) == len(rows):
                scores += np.multiply.outer(queries[:, term], weights)
            else:
                for q in having.tolist():
                    scores[q, posting] += queries[q, term] * weights
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k best of one query, by score, then by id, without rows of the query's own id."""
    at = np.flatnonzero(ids != own)
    if len(at) > k:
        s = scores[at]
        least = s[np.argpartition(s, len(s) - k)[len(s) - k :]].min()
        above, level = at[s > least], at[s == least]
        need = k - len(above)
        if len(level) > need:
            level = level[np.argpartition(ids[level], need - 1)[:need]]
        at = np.concatenate([above, level])
    return at


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0, chunk: int = 8192, block: int = 4096, candidates: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best among all rows but its own.

    is_query tells queries by the columns of `vectors`. chunk and candidates are the rows of a query and of a candidate
    block, block those of a score array.
    """
    rows = quantised(vectors, id_col, vec_col, scale)
    asked = quantised(vectors.where(is_query), id_col, vec_col, scale)
    n, m = max(1, -(-asked.count() // chunk)), max(1, -(-rows.count() // candidates))
    numbered = lambda df: df.withColumn("no", F.monotonically_increasing_id())
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = numbered(asked).select(F.pmod("no", F.lit(n)).cast("int").alias("x"), every(m).alias("y"), F.lit(0).alias("side"), "no", "vec_id", "w")
    right = numbered(rows).select(every(n).alias("x"), F.pmod("no", F.lit(m)).cast("int").alias("y"), F.lit(1).alias("side"), "no", "vec_id", "w")
    met = left.unionByName(right).repartition("x", "y").sortWithinPartitions("x", "y", "side")
    found = met.mapInArrow(_scorer(k, block), SCHEMA)
    order = Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Asked:
    """A query block and the best of each query so far."""

    def __init__(self, parts: list[pa.RecordBatch], k: int):
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        self.numbers, self.ids, self.weights, self.k = np.asarray(whole.column(3)), np.asarray(whole.column(4)), dense(whole, 5), k
        self.found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in self.ids]

    def meet(self, ids: np.ndarray, matrix: np.ndarray, step: int) -> None:
        for lo in range(0, len(self.ids), step):
            scores = accumulate(self.weights[lo : lo + step], matrix)
            for q, own in enumerate(self.ids[lo : lo + step].tolist()):
                at = best(scores[q], ids, own, self.k)
                held = self.found[lo + q]
                held.append((ids[at], scores[q][at]))
                if len(held) > 8:
                    held[:] = [self.cut(held)]

    def cut(self, held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        ids, scores = (np.concatenate(c) for c in zip(*held, strict=True))
        at = np.lexsort((ids, -scores))[: self.k]
        return ids[at], scores[at]

    def rows(self) -> pa.RecordBatch:
        out = [(self.numbers[q], self.ids[q], *self.cut(held)) for q, held in enumerate(self.found) if held]
        no, own, ids, scores = ([r[c] for r in out] for c in range(4))
        sizes = [len(x) for x in ids]
        empty = [np.empty(0, np.int64)]
        return batch(["query_no", "query_id", "vec_id", "score"], np.repeat(np.array(no, np.int64), sizes), np.repeat(np.array(own, np.int64), sizes), np.concatenate(ids or empty), np.concatenate(scores or empty))


def _scorer(k: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (2 << 20) // block)  # queries whose scores are held at once
        now, parts, asked = None, [], None
        for b in slices(batches, rows=block):
            place = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in range(3)], axis=1)
            bounds = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                x, y, side = place[lo].tolist()
                if now != (x, y):
                    if asked:
                        yield asked.rows()
                    now, parts, asked = (x, y), [], None
                part = b.slice(lo, hi - lo)
                if side == 0:
                    parts.append(part)
                elif parts or asked:
                    asked = asked or _Asked(parts, k)
                    parts = []
                    asked.meet(np.asarray(part.column(4)), dense(part, 5), step)
        if asked:
            yield asked.rows()

    return run
