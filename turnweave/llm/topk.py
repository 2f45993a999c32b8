"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Vectors are blocks of rows; queries are blocks too, and each pair of blocks is a task's.
In a block every dimension is a list of (value, row) in the order of the values, which a
query reads from its own end: downwards where its component is positive, upwards where it
is negative; lists of components that are 0 are not read. All lists are read to the same
depth, in the steps of ``DEPTHS``. A row's score is known from the lists in
which it was met; in the others it is bounded by the value that was read last and by the
list's other end. That gives each row a lower and an upper bound, rows not met yet too.
Rows whose upper bound is below the k-th lower bound of those with other ids than the
query's cannot qualify; reading stops when ``RESOLVE`` or fewer can, or at the lists' end,
and the final scores of these are resolved. Ties go to smaller ids, in a block and between
blocks. Each candidate goes to every block of queries, each query to every block of candidates.

Components are whole numbers in doubles, bounds are doubles with room for their rounding,
final scores are exact integers; those beyond a long are given, and rank, as its ends.

Edge cases: vectors that are null, or hold null or non-finite components, take no part,
and neither do rows without an id; shorter vectors count as padded with zeros; a query's
own id is no candidate; with fewer candidates than k all are returned; repeated ids are
candidates each; no vectors or queries give no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of candidates and of a block of queries.
CANDIDATES, QUERIES = 8192, 1024
#: Shares of the lists that are read before bounds are compared, and the number of rows left at which reading stops.
DEPTHS, RESOLVE = (0.125, 0.5, 0.75, 0.875, 0.9375, 1.0), 64
#: Queries whose bounds are worked out together: two doubles for each of them and each row of a block.
TOGETHER = 64
_LEAST, _MOST = -(2**63), 2**63 - 1


def _matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, x in enumerate(vectors):
        out[i, : len(x)] = x
    return out


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers in doubles, as longs; beyond their range, its ends."""
    bound = float(np.abs(vectors).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, len(query))
    if bound < 2**53:
        return (vectors @ query).astype(np.int64)
    own = [int(x) for x in query]
    sums = (sum(int(x) * y for x, y in zip(row, own, strict=True)) for row in vectors)
    return np.array([min(max(s, _LEAST), _MOST) for s in sums], np.int64)


class SortedLists:
    """A block's lists: of each dimension the rows in the order of their values, and these values.

    What was read of a list to some depth is kept as a column: a met row's own value, for the others the bound that the list gives.
    The bounds of all rows are then products with queries, many of them at once.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        n = len(ids)
        rows = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(vectors, rows, axis=0)
        # A row's place in each list upwards; in the list downwards it is the same from the other end.
        self.places = np.empty(vectors.shape, np.int64)
        np.put_along_axis(self.places, rows, np.arange(n)[:, None], axis=0)

    def _bounds(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds of each row's part of a score, for positive weights (lists downwards) and behind these for negative ones."""
        n, up, down = len(self.ids), self.places < depth, self.places >= len(self.ids) - depth
        best = [np.where(down, self.vectors, self.values[n - depth]), np.where(up, self.vectors, self.values[depth - 1])]
        least = [np.where(down, self.vectors, self.values[0]), np.where(up, self.vectors, self.values[-1])]
        return np.concatenate(best, axis=1), np.concatenate(least, axis=1)

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[list[tuple[int, int]], float]:
        """(id, score) of the query's k best, best first, and the part of the lists that was read."""
        found, read = self.top_of_all(np.array([query_id]), query[None, :], k)
        return found[0], float(read[0])

    def top_of_all(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[list[list[tuple[int, int]]], np.ndarray]:
        """Of each query its k best as (id, score), best first, and the part of the lists that was read."""
        n, found, read = len(self.ids), [[] for _ in query_ids], np.zeros(len(query_ids))
        if not n:
            return found, read
        weights = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1)
        # Room for the rounding of sums of doubles; none of the bounds is beyond what a long holds.
        slack = np.abs(weights) @ np.tile(np.abs(self.vectors).max(axis=0), 2) * max(1, 2 * queries.shape[1]) * 2.0**-49
        waiting, cursor = np.arange(len(query_ids)), 0
        for depth in (DEPTHS if n > max(RESOLVE, k) and queries.shape[1] else ()):
            if cursor == n or not len(waiting):
                break
            cursor = max(cursor + 1, int(n * depth))
            best, least = self._bounds(cursor)
            still = []
            for i in range(0, len(waiting), TOGETHER):
                asked = waiting[i : i + TOGETHER]
                other = self.ids != query_ids[asked, None]
                upper = np.minimum(weights[asked] @ best.T + slack[asked, None], float(_MOST))
                lower = np.clip(weights[asked] @ least.T - slack[asked, None], float(_LEAST), float(_MOST))
                lower[~other] = -np.inf
                left = other & ~(upper < np.partition(lower, n - k, axis=1)[:, n - k, None])
                for j, q in enumerate(asked):
                    rows = np.flatnonzero(left[j])
                    if len(rows) > max(RESOLVE, k) and cursor < n and queries[q].any():
                        still.append(q)
                    else:
                        found[q], read[q] = self._resolved(rows, queries[q], k), cursor / n
            waiting = np.array(still, np.int64)
        for q in waiting:
            found[q] = self._resolved(np.flatnonzero(self.ids != query_ids[q]), queries[q], k)
        return found, read

    def _resolved(self, left: np.ndarray, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        scores = exact_scores(self.vectors[left], query)
        best = np.lexsort((self.ids[left], -scores.astype(object) if (scores == _LEAST).any() else -scores))[:k]
        return [(int(self.ids[left[j]]), int(scores[j])) for j in best]


def block_top_k(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, id, score) of each query's k best of one block of vectors of whole numbers."""
    found, _ = SortedLists(ids, np.asarray(vectors, float)).top_of_all(np.asarray(query_ids), np.asarray(queries, float), k)
    return [(int(q), i, s) for q, rows in zip(query_ids, found, strict=True) for i, s in rows]


def top_k(embeddings: DataFrame, *, k: int = 5, scale: int = 256, every: int = 50, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best by inner product of floor(scale * x).

    Queries are the rows whose vec_id is divisible by ``every``, candidates all others' rows.
    """
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    vectors = embeddings.where(F.col("vec_id").isNotNull() & sound)

    def whole(x):  # a double of 2**53 or more is a whole number already, and may be beyond a long
        y = scale * x.cast("double")
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)

    vectors = vectors.select(F.col("vec_id").cast("bigint"), F.transform("embedding", whole).alias("v"))
    n = embeddings.count()
    c_blocks, q_blocks = max(1, -(-n // candidates)), max(1, -(-n // (every * queries)))
    block = lambda blocks, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(blocks)).cast("int")
    numbers = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = vectors.select("vec_id", "v", block(c_blocks, 1).alias("c"), numbers(q_blocks).alias("q"))
    asked = vectors.where(F.col("vec_id") % every == 0).select("vec_id", "v", block(q_blocks, 2).alias("q"), numbers(c_blocks).alias("c"))

    def searched(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            width = max(max(map(len, left["v"])), max(map(len, right["v"])))
            found = block_top_k(left["vec_id"].to_numpy(), _matrix(list(left["v"]), width), right["vec_id"].to_numpy(), _matrix(list(right["v"]), width), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    partial = rows.groupBy("c", "q").cogroup(asked.groupBy("c", "q")).applyInPandas(searched, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
