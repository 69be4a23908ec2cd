"""Length buckets of least padding, and token-budget batches inside them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgrain.llm.common import c, written

BUCKETS = 16
TOKEN_BUDGET = 65_536
#: Rows of a bucket that one task orders.
LANE_ROWS = 200_000


def word_count(text: Column) -> Column:
    """Runs without white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most so many buckets with the least padding when each text is padded to its bucket's.

    The recurrence best[b][j] = min over i < j of best[b-1][i] + len_j * (N_j - N_i) - (S_j - S_i), with N and
    S the cumulative counts and tokens, is a lower envelope of lines in len_j with slopes -N_i, which fall as i
    grows: each layer takes one sweep. Fewer buckets come back if fewer distinct lengths exist. Among equal
    costs the earliest cut wins.
    """
    order = np.argsort(lengths)
    ln = [int(x) for x in np.asarray(lengths)[order]]
    ct = [int(x) for x in np.asarray(counts)[order]]
    m = len(ln)
    if not m:
        return []
    n_, s_ = [0], [0]
    for length, k in zip(ln, ct):
        n_.append(n_[-1] + k)
        s_.append(s_[-1] + k * length)
    best: list = [0] + [None] * m
    back: list[list[int]] = []
    for _ in range(min(buckets, m)):
        cur: list = [None] * (m + 1)
        arg = [-1] * (m + 1)
        hull: list[tuple[int, int, int]] = []
        at = 0
        for j in range(1, m + 1):
            if best[j - 1] is not None:
                line = (-n_[j - 1], best[j - 1] + s_[j - 1], j - 1)
                while len(hull) - at >= 2 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) < (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
            if not hull:
                continue
            x = ln[j - 1]
            while len(hull) - at >= 2 and hull[at + 1][0] * x + hull[at + 1][1] < hull[at][0] * x + hull[at][1]:
                at += 1
            cur[j] = hull[at][0] * x + hull[at][1] + x * n_[j] - s_[j]
            arg[j] = hull[at][2]
        back.append(arg)
        best = cur
    cuts, j = [], m
    for arg in reversed(back):
        cuts.append(ln[j - 1])
        j = arg[j]
        if j <= 0:
            break
    return sorted(cuts)


def pack(docs: DataFrame, key: str = "doc_id", n_tokens: Column | None = None, text: str = "text", buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """Batches of like-long documents: doc_id, n_tokens, bucket, bucket_len, batch, slot.

    The histogram of lengths over all documents goes to the driver (a row for each distinct length, which the
    longest text bounds, not the number of texts), where dynamic programming picks the boundaries. A batch of
    bucket b holds max(1, token_budget // bucket_len) documents, each padded to bucket_len; batches number
    from 0 in each bucket and only a bucket's last may be short. A text beyond the budget is its own batch.
    Documents are ordered by a digest of key, length and occurrence, so batches mix sources, and copies of one row
    lie apart; a bucket's order runs in lanes of that digest whose sizes are summed first, so no task sorts a whole
    bucket. Texts are read once: their keys and lengths are written, equal ones counted together.

    Nulls: a null or empty text has no token and is in no batch. A null key is carried as null. Repeated rows
    each take a slot. Other columns are not carried, so none clash. No rows give no rows.
    """
    rows = docs.select(c(key).alias("doc_id"), (word_count(c(text)) if n_tokens is None else n_tokens).cast("bigint").alias("n_tokens")).where("n_tokens > 0")
    rows = written(rows.groupBy("doc_id", "n_tokens").agg(F.count("*").alias("held")), "pack-lengths")
    hist = rows.groupBy("n_tokens").agg(F.sum("held").alias("k")).toPandas()
    bounds = optimal_boundaries(hist["n_tokens"].to_numpy(), hist["k"].to_numpy(), buckets)
    if not bounds:
        bounds, most = [1], 0
    else:
        most = int(np.bincount(np.searchsorted(bounds, hist["n_tokens"].to_numpy()), weights=hist["k"].to_numpy()).max())
    lanes = max(1, -(-most // LANE_ROWS))
    ends = F.array(*[F.lit(int(b)).cast("bigint") for b in bounds])
    bucket = F.size(F.filter(ends, lambda e: e < F.col("n_tokens")))
    rows = rows.select("doc_id", "n_tokens", bucket.alias("bucket"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("held"))).alias("copy"))
    rows = rows.withColumn("h", F.md5(F.concat_ws("-", *[F.col(x).cast("string") for x in ("doc_id", "n_tokens", "copy")])))
    rows = rows.withColumn("bucket_len", F.element_at(ends, F.col("bucket") + 1))
    first = F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint")  # lanes are ranges of the digest's first 32 bits
    rows = rows.withColumn("lane", F.floor(first * lanes / F.lit(1 << 32)).cast("int"))
    inside = Window.partitionBy("bucket", "lane").orderBy("h", "doc_id", "n_tokens", "copy")
    if lanes == 1:
        placed = rows.withColumn("place", F.row_number().over(inside).cast("bigint") - 1)
    else:
        sizes = rows.groupBy("bucket", "lane").agg(F.count("*").alias("held"))
        sizes = sizes.withColumn("before", F.sum("held").over(Window.partitionBy("bucket").orderBy("lane")) - F.col("held")).drop("held")
        placed = rows.withColumn("at", F.row_number().over(inside)).join(sizes, ["bucket", "lane"]).withColumn("place", F.col("before") + F.col("at") - 1)
    cap = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("bucket_len"))).cast("bigint")
    return placed.select(
        "doc_id", "n_tokens", F.col("bucket").cast("int").alias("bucket"), "bucket_len",
        F.floor(F.col("place") / cap).cast("bigint").alias("batch"), (F.col("place") % cap).cast("int").alias("slot"),
    )


#: The recurrence layer by layer over all pairs of lengths, then the batches.
SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '\S+')), 0) AS BIGINT) AS n_tokens FROM documents
), h AS (SELECT n_tokens AS l, count(*) AS k FROM d WHERE n_tokens > 0 GROUP BY 1),
p AS (SELECT row_number() OVER (ORDER BY l) AS j, l, sum(k) OVER (ORDER BY l) AS n, sum(k * l) OVER (ORDER BY l) AS s FROM h
  UNION ALL SELECT 0, 0, 0, 0),
best AS (
  SELECT 0 AS b, CAST(0 AS BIGINT) AS j, CAST(0 AS HUGEINT) AS cost, CAST([] AS BIGINT[]) AS cuts
  UNION ALL
  SELECT b, j, min(cost), arg_min(cuts, (cost, i)) FROM (
    SELECT best.b + 1 AS b, y.j AS j, x.j AS i, best.cost + y.l * (y.n - x.n) - (y.s - x.s) AS cost, list_append(best.cuts, y.l) AS cuts
    FROM best JOIN p x ON x.j = best.j JOIN p y ON y.j > x.j WHERE best.b < least({BUCKETS}, (SELECT count(*) FROM h))
  ) GROUP BY b, j
), ends AS (SELECT unnest(cuts) AS l FROM best WHERE b = least({BUCKETS}, (SELECT count(*) FROM h)) AND j = (SELECT max(j) FROM p)),
bounds AS (SELECT CAST(row_number() OVER (ORDER BY l) - 1 AS INTEGER) AS bucket, l AS bucket_len, coalesce(lag(l) OVER (ORDER BY l), 0) AS above FROM ends),
o AS (SELECT doc_id, n_tokens, row_number() OVER (PARTITION BY doc_id, n_tokens) AS copy FROM d WHERE n_tokens > 0),
q AS (
  SELECT doc_id, n_tokens, bucket, bucket_len, row_number() OVER (PARTITION BY bucket ORDER BY md5(concat_ws('-', doc_id, n_tokens, copy)), doc_id, n_tokens, copy) - 1 AS place,
    greatest(1, {TOKEN_BUDGET} // bucket_len) AS cap
  FROM o JOIN bounds ON n_tokens > above AND n_tokens <= bucket_len
)
SELECT doc_id, n_tokens, bucket, bucket_len, CAST(place // cap AS BIGINT) AS batch, CAST(place % cap AS INTEGER) AS slot FROM q
"""
