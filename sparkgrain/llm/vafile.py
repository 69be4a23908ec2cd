"""Exact k nearest neighbours of every vector through a vector-approximation file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgrain.llm.common import arrow_map, c, ship, written

K, BITS = 10, 8
#: The registered query asks for the neighbours of ids that this divides.
ASK_EVERY = 50
#: Vectors of a block of cells, and queries of a block; a task scans one for the other.
BLOCK_ROWS, QUERY_ROWS, QUERIES_AT_ONCE = 16384, 1024, 128
#: Values from here on take no part: their squares overflow.
HUGE = 1e150


def _extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lo = hi = None
    for batch in batches:
        if batch.num_rows:
            v = _matrix(batch.column(0))
            a, b = v.min(0), v.max(0)
            lo, hi = (a, b) if lo is None else (np.minimum(lo, a), np.maximum(hi, b))
    if lo is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(lo)), pa.int32()), pa.array(lo), pa.array(hi)], ["d", "lo", "hi"])


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def cells(v: np.ndarray, lo: np.ndarray, step: np.ndarray, bits: int) -> np.ndarray:
    """The cell of each value in its dimension; a dimension without extent has one cell."""
    return np.clip(np.floor((v - lo) / np.where(step > 0, step, 1.0)), 0, 2**bits - 1).astype(np.uint8)


def bounds(q: np.ndarray, code: np.ndarray, lo: np.ndarray, step: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest distance of each query from whatever lies in each vector's cell.

    A vector lies in its cell, no further from the cell's centre than half the cell's diagonal r: its distance is
    within r of the centre's. All is reckoned from lo, so that a far origin cancels nothing. Squares sum to at most
    those of the whole extent, which bounds what rounding may do: slack for the squared distance, and for the rest.
    """
    centre, q = (code + 0.5) * step, q - lo
    whole = float(((step * 2**bits) ** 2).sum())
    squared, linear = 16 * (len(step) + 4) * 2.0**-53 * whole, 1e-14 * whole**0.5
    r = float(np.sqrt(((step / 2) ** 2).sum())) * (1 + 1e-9) + linear
    far = (q**2).sum(1)[:, None] + (centre**2).sum(1) - 2 * q @ centre.T
    return np.sqrt(np.maximum(far - squared, 0)) - r, np.sqrt(np.maximum(far + squared, 0)) + r


def scan(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, code: np.ndarray, lo: np.ndarray, step: np.ndarray, k: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query and row numbers of a block's vectors that may be among the k nearest, with their bounds.

    Out is a vector whose lower bound passes the kth least upper bound; one of a query's own id is no candidate.
    """
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]]
    for a in range(0, len(q) if len(ids) else 0, QUERIES_AT_ONCE):
        low, high = bounds(q[a : a + QUERIES_AT_ONCE], code, lo, step, bits)
        own = q_ids[a : a + QUERIES_AT_ONCE, None] == ids
        low[own] = high[own] = np.inf
        limit = np.partition(high, k - 1, axis=1)[:, k - 1 : k] if len(ids) > k else np.inf
        i, j = np.nonzero((low <= limit) & ~own)
        for held, x in zip(out, (i + a, j, low[i, j], high[i, j])):
            held.append(x)
    return tuple(np.concatenate(x) for x in out)  # type: ignore[return-value]


def settle(q: np.ndarray, low: np.ndarray, ids: np.ndarray, exact: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k nearest of one query's candidates, and how many exact vectors were read.

    They are read in order of their lower bounds until the next one passes the kth distance found. Equal distances
    go by id.
    """
    order = np.argsort(low, kind="stable")
    best_d, best_n, at = np.zeros(0), np.zeros(0, np.int64), 0
    while at < len(order) and (len(best_d) < k or low[order[at]] <= best_d[-1]):
        take = order[at : at + k]
        if len(best_d) >= k:
            take = take[: int(np.searchsorted(low[take], best_d[-1], side="right"))]
        at += len(take)
        d, n = np.concatenate([best_d, np.sqrt(((exact[take] - q) ** 2).sum(1))]), np.concatenate([best_n, ids[take]])
        best = np.lexsort((n, d))[:k]
        best_d, best_n = d[best], n[best]
    return best_n, best_d, at


def nearest(vectors: DataFrame, asked: Column | None = None, key: str = "vec_id", vector: str = "embedding", k: int = K, bits: int = BITS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Exact Euclidean neighbours, among all other vectors, of those asked for: query_id, rank from 1, neighbor_id, distance.

    asked: which rows are queries (a condition on vectors' columns; all rows without one). Each dimension is cut into
    2^bits equal cells between its least and largest value. First every block of queries meets every block of cells
    in a task of its own (shuffled, none broadcast): a byte a dimension gives distance bounds, and the block's vectors
    whose lower bound is within its kth least upper bound are candidates. Of all blocks' candidates those within the
    query's kth least upper bound stay; only their exact vectors are fetched, by one join, and read in lower-bound
    order until the kth result is certain. Exact vectors never travel with cells.

    Nulls: a row with a null id or vector, a null, NaN or infinite value or one from HUGE on, or another length than
    most vectors have, takes no part. Rows equal in id and vector count once; rows of one id with different vectors
    are vectors of their own (and so each has its own neighbours), and an id is never its own neighbour. With fewer
    than k other vectors all are listed. Equal distances go by id. Other columns are not carried, so none clash. No
    rows give no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(HUGE)))
    kind = "float" if vectors.select(c(vector)).dtypes[0][1] == "array<float>" else "double"
    rows = vectors.select(c(key).cast("bigint").alias("id"), c(vector).cast(f"array<{kind}>").alias("v"), (F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))).alias("ask"))
    rows = rows.where("id is not null and v is not null and size(v) > 0").where(sound)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dims = int(sizes[0]["d"]) if sizes else 1
    rows = rows.where(F.size("v") == dims).groupBy("id", "v").agg(F.max("ask").alias("ask"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "va-vectors")
    held = rows.agg(F.count("*").alias("n"), F.count_if("ask").alias("q")).first()
    extent = arrow_map(rows.select("v"), _extent, "d int, lo double, hi double").groupBy("d").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("d").toPandas()
    lo, step = extent["lo"].to_numpy(), (extent["hi"] - extent["lo"]).to_numpy() / 2**bits
    n_blocks, q_blocks = max(1, -(-held["n"] // block_rows)), max(1, -(-held["q"] // query_rows))
    placed = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("bigint")

    def packed(values) -> tuple:
        def job(group: pa.Table) -> pa.Table:
            v = _matrix(group["v"])
            return pa.table({"block": group["block"][:1], "rows": [group["row"].to_numpy().tobytes()], "ids": [group["id"].to_numpy().tobytes()], "held": [values(v).tobytes()]}, schema=pa.schema([("block", pa.int64()), ("rows", pa.binary()), ("ids", pa.binary()), ("held", pa.binary())]))

        return job, "block bigint, rows binary, ids binary, held binary"

    approx = written(rows.withColumn("block", placed(n_blocks)).select("block", "row", "id", "v").groupBy("block").applyInArrow(*packed(lambda v: cells(v, lo, step, bits))), "va-cells")
    asks = written(rows.where("ask").withColumn("block", placed(q_blocks)).select("block", "row", "id", "v").groupBy("block").applyInArrow(*packed(lambda v: v)), "va-queries")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = asks.withColumnRenamed("block", "q").withColumn("b", every(n_blocks))
    right = approx.withColumnRenamed("block", "b").withColumn("q", every(q_blocks))
    arr = lambda t, x, kind: np.frombuffer(t[x][0].as_py(), kind)

    def scanned(a: pa.Table, b: pa.Table) -> pa.Table:
        found, q_rows, n_rows = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2, np.zeros(0, np.int64), np.zeros(0, np.int64)
        if a.num_rows and b.num_rows:
            q_rows, n_rows = arr(a, "rows", np.int64), arr(b, "rows", np.int64)
            found = scan(arr(a, "ids", np.int64), arr(a, "held", np.float64).reshape(-1, dims), arr(b, "ids", np.int64), arr(b, "held", np.uint8).reshape(-1, dims), lo, step, k, bits)
        q = a["q"][0].as_py() if a.num_rows else 0
        return pa.table({"q": pa.array(np.full(len(found[0]), q)), "query": q_rows[found[0]], "row": n_rows[found[1]], "low": found[2], "high": found[3]})

    maybe = written(left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInArrow(scanned, "q bigint, query bigint, row bigint, low double, high double"), "va-candidates")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("high"))
    limit = maybe.select("query", "high").withColumn("at", rank).where(F.col("at") <= k).groupBy("query").agg(F.max("high").alias("limit"))
    near = maybe.join(limit, "query").where("low <= limit").select("q", "query", "row", "low").join(rows.select("row", "id", "v"), "row")

    def settled(group: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if group.num_rows:
            names, ids, vectors_ = arr(queries, "rows", np.int64), arr(queries, "ids", np.int64), arr(queries, "held", np.float64).reshape(-1, dims)
            exact, low, own = _matrix(group["v"]), group["low"].to_numpy(), group["id"].to_numpy()
            query = group["query"].to_numpy()
            order = np.argsort(query, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], np.diff(query[order]) != 0, [True]]))
            by = np.argsort(names)
            for x, y in zip(edge[:-1], edge[1:]):
                part = order[x:y]
                i = by[np.searchsorted(names[by], query[part[0]])]
                n, d, _ = settle(vectors_[i], low[part], own[part], exact[part], k)
                for kept, more in zip(out, (np.full(len(n), ids[i]), np.arange(1, len(n) + 1, dtype=np.int32), n, d)):
                    kept.append(more)
        cols = [np.concatenate(x) for x in out]
        return pa.table({"query_id": cols[0], "rank": cols[1], "neighbor_id": cols[2], "distance": cols[3]})

    return near.groupBy("q").cogroup(asks.withColumnRenamed("block", "q").groupBy("q")).applyInArrow(settled, "query_id bigint, rank int, neighbor_id bigint, distance double")


SQL = f"""
WITH p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % {ASK_EVERY} = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbor_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round(d, 6) AS distance FROM r WHERE rank <= {K}
"""
