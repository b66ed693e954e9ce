"""Exact top-k search by distributed histogram selection (operator 1).

Every vector is scored against a block of queries in each pass. Passes refine,
per query, the interval that holds the k-th best score: each task adds up a
histogram of its scores inside the interval, Spark sums the histograms, and the
bin of the k-th score becomes the next interval, until it is a single score.
Then rows above it are kept and ties at it go to the smaller id. Nothing is
approximate: a task may leave out histogram bins only below its own k-th score,
which cannot be below the global one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from admitlens.llm.common import stored

BINS = 4096
QUERY_BLOCK = 4096     # queries broadcast at a time (bounded: 4096 vectors)
SCORE_CELLS = 1 << 21  # scores held by a task at once
LONG = np.iinfo(np.int64)


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
              scale: int = 256) -> DataFrame:
    """(vec_id, v): components as floor(scale * x) in double. Rows without an
    id, without a vector, or with a null, NaN or infinite component, take no
    part; nor do components whose scaled value leaves the long range."""
    x = F.transform(F.col(vector_col), lambda e: F.floor(e.cast("double") * F.lit(float(scale))))
    good = F.forall(
        F.col(vector_col),
        lambda e: F.coalesce(F.abs(e.cast("double") * F.lit(float(scale))) < F.lit(2.0 ** 62), F.lit(False)),
    )
    return (df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
            .where(good)
            .select(F.col(id_col).cast("long").alias("vec_id"), x.cast("array<bigint>").alias("v")))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) per vector length of the batch."""
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    lists = batch.column("v")
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield ids[at], flat[starts[at][:, None] + np.arange(n)[None, :]].reshape(len(at), n)


def _scores(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact integer inner products; saturated at the long range."""
    top = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * rows.shape[1]
    if top < 2.0 ** 53:
        return (rows.astype(np.float64) @ queries.T.astype(np.float64)).astype(np.int64)
    if top < 2.0 ** 62:
        return rows @ queries.T
    exact = rows.astype(object) @ queries.T.astype(object)
    return np.clip(exact, LONG.min, LONG.max).astype(np.int64)


def _scored(batches: Iterator[pa.RecordBatch], block: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query positions, row ids, scores[row, query]) in bounded pieces. A vector
    of another length than the query's is not comparable and is passed over."""
    for batch in batches:
        for ids, rows in _matrices(batch):
            part = block.get(rows.shape[1])
            if part is None:
                continue
            pos, _, q = part
            step = max(1, SCORE_CELLS // max(1, len(pos)))
            for a in range(0, len(ids), step):
                yield pos, ids[a:a + step], _scores(rows[a:a + step], q)


def _block(rows: list) -> tuple[dict, np.ndarray]:
    """Queries grouped by length: {length: (positions, ids, matrix)}."""
    ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
    by: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        by.setdefault(len(r["v"]), []).append(i)
    return {n: (np.array(p), ids[p], np.array([rows[i]["v"] for i in p], dtype=np.int64).reshape(len(p), n))
            for n, p in by.items()}, ids


def _range(vectors: DataFrame, shared) -> tuple[dict, dict]:
    """Lowest and highest score of each query."""
    def run(batches):
        block, ids, _ = shared.value
        low = np.full(len(ids), LONG.max)
        high = np.full(len(ids), LONG.min)
        for pos, row_ids, s in _scored(batches, block):
            own = row_ids[:, None] == ids[pos][None, :]
            low[pos] = np.minimum(low[pos], np.where(own, LONG.max, s).min(axis=0))
            high[pos] = np.maximum(high[pos], np.where(own, LONG.min, s).max(axis=0))
        seen = np.flatnonzero(low <= high)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(low[seen]), pa.array(high[seen])], ["q", "low", "high"])

    out = (vectors.mapInArrow(run, "q long, low long, high long")
           .groupBy("q").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect())
    return {r["q"]: r["low"] for r in out}, {r["q"]: r["high"] for r in out}


def _kth_bins(vectors: DataFrame, shared) -> DataFrame:
    """(q, bin, need): the bin of each open query's k-th score and how many rows
    are still to be found in it. Histograms are summed in Spark; a query has
    BINS bins at most, and a task reports none below its own k-th score."""
    def run(batches):
        block, ids, low, width, n_bins, need, open_ = shared.value
        counts: dict[int, np.ndarray] = {}
        for pos, row_ids, s in _scored(batches, block):
            for j in np.flatnonzero(open_[pos]):
                p = pos[j]
                col = s[row_ids != ids[p], j]
                if abs(int(low[p])) < 1 << 62 and width[p] < 1 << 50:
                    col = col[(col >= low[p]) & (col < low[p] + n_bins[p] * width[p])]
                    inside = (col - low[p]) // width[p]
                else:  # Python integers: the interval may be as wide as all longs
                    wide = (col.astype(object) - int(low[p])) // int(width[p])
                    inside = np.array([x for x in wide if 0 <= x < n_bins[p]], dtype=np.int64)
                if len(inside):
                    h = np.bincount(inside, minlength=BINS)
                    counts[p] = counts[p] + h if p in counts else h
        for p, h in counts.items():
            full = np.flatnonzero(h)[::-1]
            full = full[:int(np.searchsorted(np.cumsum(h[full]), need[p])) + 1]
            m = len(full)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, p, dtype=np.int64)), pa.array(full.astype(np.int64)),
                 pa.array(h[full].astype(np.int64)), pa.array(np.full(m, need[p], dtype=np.int64))],
                ["q", "bin", "n", "need"])

    summed = (vectors.mapInArrow(run, "q long, bin long, n long, need long")
              .groupBy("q", "bin").agg(F.sum("n").alias("n"), F.first("need").alias("need")))
    above = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin"))) - F.col("n")
    return (summed.withColumn("above", above)
            .where((F.col("above") < F.col("need")) & (F.col("above") + F.col("n") >= F.col("need")))
            .select("q", "bin", (F.col("need") - F.col("above")).alias("need")))


def _winners(vectors: DataFrame, shared, k: int) -> DataFrame:
    """Rows above each query's k-th score, and of those at it the k smallest ids
    of each task."""
    def run(batches):
        block, ids, kth = shared.value
        ties: dict[int, np.ndarray] = {}
        for pos, row_ids, s in _scored(batches, block):
            cut = kth[pos]
            own = row_ids[:, None] == ids[pos][None, :]
            r, c = np.nonzero((s > cut[None, :]) & ~own)
            if len(r):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pos[c]), pa.array(row_ids[r]), pa.array(s[r, c])], ["q", "vec_id", "score"])
            r, c = np.nonzero((s == cut[None, :]) & ~own)
            for j in np.unique(c):
                at = row_ids[r[c == j]]
                p = pos[j]
                at = np.concatenate([ties[p], at]) if p in ties else at
                ties[p] = np.sort(at)[:k]
        for p, at in ties.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), p)), pa.array(at), pa.array(np.full(len(at), kth[p]))],
                ["q", "vec_id", "score"])

    return vectors.mapInArrow(run, "q long, vec_id long, score long")


def _search_block(vectors: DataFrame, rows: list, k: int) -> DataFrame:
    spark = vectors.sparkSession
    sc = spark.sparkContext
    block, ids = _block(rows)
    n = len(ids)
    lows, highs = _range(vectors, sc.broadcast((block, ids, None)))
    low = np.array([lows.get(q, 0) for q in range(n)], dtype=np.int64)
    spread = [highs[q] - lows[q] + 1 if q in highs else 0 for q in range(n)]
    need = np.full(n, k, dtype=np.int64)       # still to find inside the interval
    open_ = np.array([s > 1 for s in spread])
    kth = low.copy()
    while open_.any():
        width = np.array([max(1, -(-s // BINS)) for s in spread], dtype=np.int64)
        n_bins = np.array([-(-s // int(w)) for s, w in zip(spread, width)], dtype=np.int64)
        shared = sc.broadcast((block, ids, low, width, n_bins, need, open_))
        found = {r["q"]: r for r in _kth_bins(vectors, shared).collect()}  # a row per query
        for q in np.flatnonzero(open_):
            if q not in found:                  # fewer than k rows: all of them
                open_[q], kth[q] = False, low[q]
                continue
            need[q] = found[q]["need"]
            low[q] = int(low[q]) + found[q]["bin"] * int(width[q])
            spread[q] = int(width[q])
            kth[q] = low[q]
            open_[q] = spread[q] > 1
    found = _winners(vectors, sc.broadcast((block, ids, kth)), k)
    names = spark.createDataFrame([(i, int(v)) for i, v in enumerate(ids)], "q long, query_id long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .join(F.broadcast(names), "q")      # names: a row per query of the block
            .select("query_id", "rank", "vec_id", "score"))


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5,
                query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` highest inner products of every query over all ``vectors``.

    Both inputs are (vec_id, v) as made by :func:`quantised`. Result: query_id,
    rank (from 1), vec_id, score; ties go to the smaller vec_id. A query never
    meets rows of its own vec_id. Fewer than k comparable rows: all of them;
    none (or an empty table): no row for the query. Repeated rows are candidates
    like any other; a repeated query row answers once. Vectors of another length
    than the query's are not comparable. Queries are worked through in blocks of
    about ``query_block``, each broadcast (bounded) against all vectors.
    """
    spark = vectors.sparkSession
    queries = queries.dropDuplicates()
    n_blocks = max(1, -(-queries.count() // query_block))
    queries = stored(queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks))), "queries")
    result = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for b in range(n_blocks):
        rows = queries.where(F.col("block") == b).collect()
        if rows:
            result = result.unionByName(stored(_search_block(vectors, rows, k), "topk"))
    return result
