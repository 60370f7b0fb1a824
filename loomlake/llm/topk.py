"""Exact top-k inner products by pivot-table elimination (operator 4).

For integer vectors q and c, <q, c> = (|q|^2 + |c|^2 - d(q, c)^2) / 2, and for every pivot p the triangle
inequality gives d(q, c) >= |d(q, p) - d(c, p)|. The largest of these lower bounds over all pivots gives
an upper bound of the score.

The pivot table is computed once and written: every vector with its distances to all pivots and its cell,
that of the nearest pivot. Cells are dealt into blocks of bounded size. Queries first search their own
cell, which gives each a floor, its k-th score so far; then every other cell whose range of pivot
distances does not exclude it. In a block, candidates are evaluated in the order of their bounds until
the next bound falls below the floor. Nothing is left out unless its bound proves that it cannot count, so
the result is exact; a bound that is no number, as for huge components, excludes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.llm.common import hash60, written

SCALE, K, PIVOTS = 1024, 10, 32
#: Rows from which pivots are chosen; candidates and queries of a block, and candidates evaluated at once.
PIVOT_SAMPLE, BLOCK, QUERIES, STEP = 512, 16_384, 4096, 64
#: Larger components than this (and it itself) are beyond the bounds, and vectors that have them are no pivots.
HUGE = 2.0**500
#: Rounding of distances, relative to the norms.
SLACK = 1e-6
_EXACT = 2.0**53
_LONG = 2**63 - 1


def valid_vectors(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, floor(SCALE * x) as doubles) for each length of vector; rows with null or non-finite parts are left out.

    What exceeds the largest double counts as that.
    """
    size = np.asarray(pa.compute.list_value_length(vectors).fill_null(0))
    x = vectors.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    most = np.finfo(float).max
    for n in np.unique(size[size > 0]):
        at = np.flatnonzero(size == n)
        m = x[(ends[at] - n)[:, None] + np.arange(n)]
        ok = np.isfinite(m).all(1)
        with np.errstate(over="ignore"):
            yield at[ok], np.clip(np.floor(SCALE * m[ok]), -most, most)


def inner(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of c with q, as int64 (at its limits where they exceed it)."""
    if np.abs(c).max(initial=1) * np.abs(q).max(initial=1) * len(q) < _EXACT:
        return (c @ q).astype(np.int64)
    ints = [int(v) for v in q]
    return np.array([max(-_LONG, min(_LONG, sum(int(a) * b for a, b in zip(row, ints, strict=True)))) for row in c], np.int64)


def _norms(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.einsum("ij,ij->i", m, m)


def distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Each row's distances to the pivots; no number where components are huge."""
    with np.errstate(over="ignore", invalid="ignore"):
        d = np.stack([np.sqrt(_norms(m - p)) for p in pivots], 1) if len(pivots) else np.zeros((len(m), 0))
    d[np.abs(m).max(1, initial=0) >= HUGE] = np.nan
    return d


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Vectors of the sample that lie far from each other, the farthest next."""
    if not len(sample):
        return sample
    at, near = [0], np.sqrt(_norms(sample - sample[0]))
    while len(at) < n and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, np.sqrt(_norms(sample - sample[at[-1]])))
    return sample[at]


class Best:
    """The k best (score, id, row) of one query so far."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids, self.rows = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def floor(self) -> float:
        return self.scores[-1] if len(self.scores) >= self.k else -math.inf

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        s, i, r = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.rows, rows])
        order = np.lexsort((r, i, -s))[: self.k]
        self.scores, self.ids, self.rows = s[order], i[order], r[order]


def bounds(q: np.ndarray, dq: np.ndarray, qn: float, cn: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of a query with candidates (or ranges of them) whose pivot distances lie from low to high."""
    with np.errstate(over="ignore", invalid="ignore"):
        least = np.maximum(low - dq, dq - high).max(1, initial=0)
        bound = (qn + cn - least * least) / 2 + SLACK * (qn + cn) + 1
    return np.where(np.isnan(bound), np.inf, bound)


def search_block(best: list[Best], q_rows: np.ndarray, q: np.ndarray, dq: np.ndarray, floors: np.ndarray, ids: np.ndarray, rows: np.ndarray, c: np.ndarray, dc: np.ndarray) -> int:
    """Offers the candidates c to every query but that of the same row; returns how many products were evaluated."""
    qn, cn = _norms(q), _norms(c)
    done = 0
    for i in range(len(q)):
        own = best[i]
        bound = bounds(q[i], dq[i], qn[i], cn, dc, dc)
        may = np.flatnonzero((bound >= floors[i]) & (rows != q_rows[i]))
        order = may[np.argsort(-bound[may], kind="stable")]
        for at in range(0, len(order), STEP):
            part = order[at : at + STEP]
            if bound[part[0]] < max(own.floor, floors[i]):
                break
            own.add(inner(c[part], q[i]), ids[part], rows[part])
            done += len(part)
    return done


_FOUND = "query long, query_id long, vec_id long, row long, score long, evaluated long"


def _search(k: int):
    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        def rows(t: pa.Table, c: str) -> np.ndarray:
            flat = t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return flat.reshape(t.num_rows, len(flat) // t.num_rows)

        q_ids, q_rows = queries["vec_id"].to_numpy(), queries["row"].to_numpy()
        best, done = [Best(k) for _ in q_ids], 0
        if len(q_ids) and block.num_rows:
            floors = queries["floor"].cast(pa.float64()).fill_null(-math.inf).to_numpy()
            done = search_block(best, q_rows, rows(queries, "v"), rows(queries, "d"), floors, block["vec_id"].to_numpy(), block["row"].to_numpy(), rows(block, "v"), rows(block, "d"))
        got = [(np.full(len(b.ids), r), np.full(len(b.ids), i), b.ids, b.rows, b.scores) for r, i, b in zip(q_rows, q_ids, best, strict=True) if len(b.ids)]
        cols = [np.concatenate([np.zeros(0, np.int64), *(x[n] for x in got)]) for n in range(5)]
        found = {name: pa.array([None, *c], pa.int64()) for name, c in zip(("query", "query_id", "vec_id", "row", "score"), cols, strict=True)}
        return pa.table(found | {"evaluated": pa.array([done] + [0] * len(cols[0]), pa.int64())})

    return run


def _rows(pivots):
    """vec_id, row, n, v, d, cell of batches of vectors. d and cell are empty and 0 for lengths without pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, v in valid_vectors(b["embedding"]):
                n = v.shape[1]
                d = distances(v, pivots.value.get(n, np.zeros((0, n))))
                cell = np.where(np.isnan(d).any(1), 0, np.nan_to_num(d).argmin(1)) if d.shape[1] else np.zeros(len(v), int)
                lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([b["vec_id"].take(pa.array(at)), b["row"].take(pa.array(at)), pa.array(np.full(len(v), n), pa.int32()), lists(v), lists(d), pa.array(cell, pa.int32())], names=["vec_id", "row", "n", "v", "d", "cell"])

    return run


def pivot_table(vectors: DataFrame) -> DataFrame:
    """vec_id, row (a number of its own), n, v, d, cell of every vector that takes part, written once; pivots come from a sample of PIVOT_SAMPLE vectors."""
    spark = vectors.sparkSession
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")
    sample = slim.orderBy(hash60(F.col("vec_id"))).limit(PIVOT_SAMPLE).collect()
    pivots = {}
    for _, v in valid_vectors(pa.array([r["embedding"] for r in sample], pa.list_(pa.float64()))):
        usual = v[np.abs(v).max(1) < HUGE]
        pivots[v.shape[1]] = choose_pivots(usual) if len(usual) else usual
    numbered = slim.withColumn("row", F.monotonically_increasing_id())
    return written(numbered.mapInArrow(_rows(spark.sparkContext.broadcast(pivots)), "vec_id long, row long, n int, v array<double>, d array<double>, cell int"), "topk-pivots")


def _visits(queries: DataFrame, table: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """query, query_id, vec_id, row, score, evaluated of the queries (vec_id, row, n, v, d, floor, cell: to be searched) and the cells they visit."""
    visited = queries.groupBy("n", "cell").agg(F.ceil(F.count("*") / F.lit(QUERIES)).cast("int").alias("kq"))
    size = cells.select("n", "cell", F.ceil(F.col("rows") / F.lit(BLOCK)).cast("int").alias("kc")).join(visited, ["n", "cell"])
    deal = lambda by: F.pmod(F.xxhash64("row"), F.col(by)).cast("int")
    every = lambda by: F.explode(F.sequence(F.lit(0), F.col(by) - 1))
    asked = queries.join(size, ["n", "cell"]).select("vec_id", "row", "n", "cell", "v", "d", "floor", deal("kq").alias("qb"), every("kc").alias("cb"))
    held = table.join(size, ["n", "cell"]).select("vec_id", "row", "n", "cell", "v", "d", deal("kc").alias("cb"), every("kq").alias("qb"))
    by = ["n", "cell", "qb", "cb"]
    return asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(_search(k), _FOUND)


def _range_bound(low: Column, high: Column, qn: Column, cn: Column) -> Column:
    """The same bound as in bounds(), for a whole cell."""
    apart = F.zip_with(F.zip_with(low, F.col("d"), lambda x, y: x - y), F.zip_with(F.col("d"), high, lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    least = F.greatest(F.coalesce(F.array_max(F.filter(apart, lambda x: ~F.isnan(x))), F.lit(0.0)), F.lit(0.0))
    return (qn + cn - least * least) / 2 + SLACK * (qn + cn) + 1


def search(vectors: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """query (its row), query_id, vec_id, row, score, evaluated: at least the k best candidates of every query, from each block that it visits.

    Rows without a query tell how many inner products a block of queries and one of candidates took.
    """
    table = pivot_table(vectors)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    cells = table.groupBy("n", "cell").agg(F.count("*").alias("rows"), F.max(norm).alias("cn"), F.max(F.size("d")).alias("nd"), *[f(F.get("d", F.lit(p))).alias(f"{name}{p}") for p in range(PIVOTS) for f, name in ((F.min, "low"), (F.max, "high"))])
    pick = lambda name: F.slice(F.array(*[F.col(f"{name}{p}") for p in range(PIVOTS)]), F.lit(1), F.greatest(F.col("nd"), F.lit(0)))
    cells = written(cells.select("n", "cell", "rows", "cn", pick("low").alias("low"), pick("high").alias("high")), "topk-cells")  # PIVOTS rows a length at most
    queries = written(table.where(F.col("vec_id") % every == 0), "topk-queries")
    own = written(_visits(queries.withColumn("floor", F.lit(None).cast("double")), table, cells, k), "topk-own")
    ranked = own.where("query is not null").withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"))))
    floors = written(ranked.where(F.col("r") == k).select("query", F.col("score").cast("double").alias("floor")), "topk-floors")
    known = queries.join(floors, F.col("row") == F.col("query"), "left").drop("query").withColumn("qn", norm)
    others = cells.select(F.col("n").alias("_n"), F.col("cell").alias("_cell"), "low", "high", "cn")
    bound = _range_bound(F.col("low"), F.col("high"), F.col("qn"), F.col("cn"))
    go = known.join(others, (F.col("n") == F.col("_n")) & (F.col("cell") != F.col("_cell")))
    go = go.where(F.col("floor").isNull() | F.isnan(bound) | (bound >= F.col("floor")))
    rest = _visits(written(go.select("vec_id", "row", "n", "v", "d", "floor", F.col("_cell").alias("cell")), "topk-visits"), table, cells, k)
    return own.unionByName(rest)


def top_k(vectors: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row whose vec_id is divisible by `every`.

    Candidates are all other rows with as many components, so that a repeated vec_id is a candidate each time
    (of a query with the same vec_id, too), and a query each time. Rows with a null vec_id and vectors that
    are null, empty or hold null or non-finite components take no part; ties go to smaller vec_ids; an empty
    table gives no rows; vectors of any length and size are searched; other columns are not read. Scores
    are exact and stop at the limits of a long.
    """
    found = search(vectors, every, k).where("query is not null")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
