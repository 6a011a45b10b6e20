"""Exact top-k inner-product search over an impact-ordered, score-at-a-time index.

Vectors are dealt into blocks of about BLOCK rows.  A block's postings (component, vector, impact) lie in segments, one for
each of LEVELS quantised impacts and each component, largest impacts first.  Queries add segments level by level to their
accumulators, and only the postings of a segment are touched.  After some of the levels a vector's score is known up to
what its open postings can add: at most the product of the query's length and that of the open part of the vector, and at
most the sum of the query's components times the largest open impact.  A query stops only when these bounds prove that few
vectors of the block can be among the best k; those are scored again exactly, with integers.

The query set is stated and meets all rows block by block: a cell is a block of vectors and the queries, or a set of at
most about QUERIES of them; queries go to the blocks, and a block is read once a set.  Every cell keeps k rows a query, and
a window ranks what the cells keep.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

#: Rows of a block, queries of a set, queries that a cell looks at together, levels, and candidates that are scored again.
BLOCK, QUERIES, TOGETHER, LEVELS, FEW = 8192, 16384, 128, 16, 64
#: Levels after which bounds are worked out.
LOOKS = (2, 4, 8, 11, 13, 14, 15, 16)
SCALE = 256
#: Sums of whole numbers are exact in doubles below this.
EXACT = float(1 << 53)


def impacts(table: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, dim, v: whole components.  Rows with a null id, a null vector or null or non-finite components are left out."""
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    rows = table.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull()).where(~bad)
    # Scaling by a power of two and rounding down are exact in doubles, of any size.
    whole = F.transform(column, lambda c: _floor(c.cast("double") * float(SCALE)))
    return rows.select(F.col("vec_id").cast("long"), F.size(column).alias("dim"), whole.alias("v")).where("dim > 0")


def _floor(x):
    """Rounded down, as a double: numbers from 2^52 on are whole already."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


class Index:
    """Posting segments of a block, by descending quantised impact, then by component."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.v = ids, v
        size = np.abs(v)
        some = size[size > 0]
        steps = np.quantile(some, [1 - (i + 1) / LEVELS for i in range(LEVELS - 1)]) if some.size else np.zeros(LEVELS - 1)
        level = np.searchsorted(-steps, -size, side="left").astype(np.int8)  # 0: above the first step
        level[size == 0] = LEVELS  # adds nothing
        row, component = np.nonzero(level < LEVELS)
        at = level[row, component].astype(np.int64) * v.shape[1] + component
        order = np.argsort(at, kind="stable")
        self.row, self.impact = row[order], v[row[order], component[order]]
        self.starts = np.searchsorted(at[order], np.arange(LEVELS * v.shape[1] + 1))
        # Of the postings below each level: the length of every vector's part, and the largest impact.
        self.open_length = np.zeros((LEVELS, len(ids)))
        self.open_most = np.zeros(LEVELS)
        for n in range(LEVELS):
            rest = np.where(level > n, size, 0.0)
            self.open_length[n], self.open_most[n] = np.sqrt((rest**2).sum(1)), rest.max(initial=0.0)

    def segment(self, level: int, component: int) -> tuple[np.ndarray, np.ndarray]:
        k = level * self.v.shape[1] + component
        a, b = self.starts[k], self.starts[k + 1]
        return self.row[a:b], self.impact[a:b]


def search(index: Index, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[list[tuple[int, int, int]], int, int]:
    """(query, vector, score) of each query's best k in the block, ties to the smaller vector id; postings that were read, and
    that there are, for these queries."""
    n, dim = index.v.shape
    if float(np.abs(q).max(initial=0)) * float(np.abs(index.v).max(initial=0)) * dim >= EXACT:
        return plainly(index, query_ids, q, k), len(q) * len(index.row), len(q) * len(index.row)
    score = np.zeros((n, len(q)))  # a posting's row of accumulators lies together
    length, total = np.sqrt((q**2).sum(1)), np.abs(q).sum(1)
    active, out, read_ = np.arange(len(q)), [], 0
    for level in range(LEVELS):
        for c in range(dim):
            row, impact = index.segment(level, c)
            if len(row) and q[active, c].any():
                score[row] += impact[:, None] * q[None, active, c]  # a vector is in a segment once
                read_ += len(row) * len(active)
        if level + 1 not in LOOKS and level + 1 < LEVELS:
            continue
        rest = np.minimum(index.open_length[level][:, None] * length[None, active], index.open_most[level] * total[None, active])
        rest = rest * (1 + 1e-9) + (1e-6 if level + 1 < LEVELS else 0.0)
        own = index.ids[:, None] == query_ids[None, active]
        low = np.where(own, -np.inf, score - rest)
        kth = np.partition(low, n - k, axis=0)[n - k] if n > k else np.full(len(active), -np.inf)
        possible = (score + rest >= kth[None, :]) & ~own
        proven = (possible.sum(0) <= max(FEW, k)) | (level + 1 == LEVELS)
        for place in np.flatnonzero(proven).tolist():
            at = np.flatnonzero(possible[:, place])
            exact = (index.v[at] * q[active[place]]).sum(1).astype(np.int64)
            best = np.lexsort((index.ids[at], -exact))[:k]
            out += [(int(query_ids[active[place]]), int(index.ids[at[b]]), int(exact[b])) for b in best]
        active, score = active[~proven], np.ascontiguousarray(score[:, ~proven])
        if not len(active):
            break
    return out, read_, len(q) * len(index.row)


def plainly(index: Index, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The same with integers of any size, for components so large that doubles would round; scores stop at the ends of a
    64-bit number."""
    rows, out, most = [[int(x) for x in r] for r in index.v], [], (1 << 63) - 1
    for i, own in zip(query_ids.tolist(), q):
        own = [int(x) for x in own]
        found = ((max(-most, min(most, sum(map(int.__mul__, own, r)))), j) for j, r in zip(index.ids.tolist(), rows) if j != i)
        out += [(i, j, s) for s, j in sorted(found, key=lambda x: (-x[0], x[1]))[:k]]
    return out


def exact_top_k(table: DataFrame, is_query, k: int = 5, column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row where is_query (a Column) holds.

    Rows that share the query's vec_id are its own and take no part.  Repeated rows count as often as they are there: each
    copy of a vector has a rank of its own, and copies of a query search as one, each adding its rows.  Vectors meet only
    those of their own length; ties go to the smaller vec_id; with fewer than k others all are returned; an empty table gives
    no row.  Finite components of any size are scored exactly; a score beyond the range of a long is the end of that range.
    Columns but vec_id and the vectors are not looked at.
    """
    v = impacts(table, column)
    rows, asked = (x or 0 for x in v.agg(F.count("*"), F.count_if(is_query)).first())
    blocks, sets = max(1, math.ceil(rows / BLOCK)), max(1, math.ceil(asked / QUERIES))
    deal = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = v.withColumn("block", deal(blocks, 1)).withColumn("set", every(sets))
    asks = v.where(is_query).withColumn("set", deal(sets, 2)).withColumn("block", every(blocks))

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return t["vec_id"].to_numpy(), pc.list_flatten(t["v"]).to_numpy().reshape(t.num_rows, -1)

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            ids, q = matrix(left)
            index = Index(*matrix(right))
            for at in range(0, len(ids), TOGETHER):
                found += search(index, ids[at : at + TOGETHER], q[at : at + TOGETHER], k)[0]
        return pa.table({n: pa.array([f[j] for f in found], pa.int64()) for j, n in enumerate(("query_id", "vec_id", "score"))})

    keys = ("dim", "set", "block")
    best = asks.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(cell, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
