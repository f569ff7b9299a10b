"""Exact top-k search by pivot-table elimination.

Inner product as a distance: with every candidate c extended by sqrt(M^2 - |c|^2) (M: the largest norm) and every query by
0, the squared distance is |q|^2 + M^2 - 2 q.c. Distances of all rows to a fixed number of pivots are computed once; by
the triangle inequality the largest difference of a query's and a candidate's pivot distances bounds their distance from
below, hence the score from above. Per query and block, candidates are evaluated in the order of that bound until it
falls below the k-th best exact score; the pivots' own scores give the first threshold.

Queries and candidates meet in blocks of bounded size, (query block x candidate block); no block is a key of the data.

Defined cases: vectors that are null or hold null or non-finite components take no part; a vector shorter than the longest
counts as ending in zeros, an empty one as zeros (a table of one very long vector makes all of them so long); a row with a null id is a candidate only and loses ties; rows repeated as a whole are candidates of one
another; fewer than k candidates give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drawn, saved

PIVOTS = 32
#: Rows of a candidate block and of a query block, about.
CANDIDATES, QUERIES = 8192, 4096


def quantized(vector: str = "embedding", scale: int = 256) -> Column:
    """floor(scale * x) of every component, null where the vector takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(F.col(vector).isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, dim)


def _extended(v: np.ndarray, m2: int) -> np.ndarray:
    rest = np.sqrt(np.maximum(m2 - (v * v).sum(1), 0))
    return np.hstack([v.astype(np.float64), rest[:, None]])


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (points * points).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(d2, 0))


def block_top(q: np.ndarray, qd: np.ndarray, c: np.ndarray, cd: np.ndarray, ids: np.ndarray, own: list[np.ndarray], m2: int, k: int, floor: np.ndarray, step: int = 256):
    """For each query the best (candidate index, score) of a block. floor: scores that k candidates are known to reach."""
    q2 = (q * q).sum(1)
    out, evaluated = [], 0
    for i in range(len(q)):
        low = np.zeros(len(c))
        for p in range(qd.shape[1]):
            np.maximum(low, np.abs(cd[:, p] - qd[i, p]), out=low)
        low = np.maximum(low - 1e-6 * (1 + low), 0)
        upper = np.floor((q2[i] + m2 - low * low) / 2 + 1e-3).astype(np.int64)
        reach = upper >= floor[i]
        reach[own[i]] = False  # the query's own row
        usable = np.flatnonzero(reach)
        usable = usable[np.argsort(-upper[usable], kind="stable")]
        best: list[tuple[int, int, int]] = []
        for a in range(0, len(usable), step):
            if len(best) >= k and upper[usable[a]] < -best[k - 1][0]:
                break
            part = usable[a : a + step]
            scores = c[part] @ q[i]
            evaluated += len(part)
            keep = np.lexsort((ids[part], -scores))[:k]
            best = sorted(best + [(-int(scores[j]), int(ids[part[j]]), int(part[j])) for j in keep])[:k]
        out.append([(j, -s) for s, _, j in best])
    return out, evaluated


def top_k(rows: DataFrame, is_query: Column, k: int = 5, pivots: int = PIVOTS, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score (integer inner product) from vec_id and an integer vector column v (null: no part)."""
    spark = rows.sparkSession
    usable = saved(rows.select("vec_id", "v").filter("v IS NOT NULL"), "topk-vectors")
    longest = usable.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(1, longest)
    usable = usable.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))))
    norm2 = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    n, n_query, m2 = usable.agg(F.count("*"), F.count(F.when(is_query, 1)), F.max(norm2)).first()
    # A fixed number of pivots, drawn by hash: the same ones in every run.
    pivot_v = np.array([r["v"] for r in drawn(usable.select("v"), F.array_join(F.transform("v", lambda x: x.cast("string")), ","), pivots)], np.int64).reshape(-1, dim)
    pivot_x = _extended(pivot_v, m2)
    c_blocks, q_blocks = -(-n // candidates), max(1, -(-n_query // queries))

    def with_distances(batches):
        for b in batches:
            v = _matrix(b.column("v"), dim)
            d, dq = _distances(_extended(v, m2), pivot_x), _distances(np.hstack([v.astype(np.float64), np.zeros((len(v), 1))]), pivot_x)
            # Scores with the pivots; one of them may be the query itself, so the (k+1)-th best is a safe floor.
            s = np.sort(v @ pivot_v.T, 1)[:, ::-1]
            low = s[:, k] if s.shape[1] > k else np.full(len(v), np.iinfo(np.int64).min)
            as_list = lambda m: pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), as_list(d), as_list(dq), pa.array(low)], ["vec_id", "v", "d", "dq", "low"])

    table = usable.mapInArrow(with_distances, "vec_id long, v array<long>, d array<double>, dq array<double>, low long")
    table = table.withColumn("h", F.xxhash64("vec_id", "v"))
    c = table.withColumn("cb", F.pmod("h", F.lit(c_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))).select("cb", "qb", "vec_id", "v", "d")
    q = table.filter(is_query).withColumn("qb", F.pmod(F.shiftright("h", 20), F.lit(q_blocks)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    q = q.select("cb", "qb", "vec_id", "v", "dq", "low")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        cv, cd = _matrix(left["v"], dim), np.asarray(left["d"].combine_chunks().flatten()).reshape(left.num_rows, len(pivot_v))
        ids = np.array([np.iinfo(np.int64).max if x is None else x for x in left["vec_id"].to_pylist()], np.int64)
        qv, qid = _matrix(right["v"], dim), np.asarray(right["vec_id"], np.int64)
        qd = np.asarray(right["dq"].combine_chunks().flatten()).reshape(right.num_rows, len(pivot_v))
        own = []
        for i in range(len(qv)):
            same = np.flatnonzero(ids == qid[i])
            own.append(same[(cv[same] == qv[i]).all(1)][:1])
        found, _ = block_top(qv, qd, cv, cd, ids, own, m2, k, np.asarray(right["low"], np.int64))
        nth = pd.DataFrame({"id": qid, "v": [x.tobytes() for x in qv]}).groupby(["id", "v"]).cumcount().to_numpy()
        rows = [(int(qid[i]), qv[i].tobytes(), int(nth[i]), left["vec_id"][j].as_py(), s) for i, hits in enumerate(found) for j, s in hits]
        cols = list(zip(*rows)) or [[]] * 5
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64()))], ["query_id", "qv", "nth", "vec_id", "score"])

    hits = c.groupBy("cb", "qb").cogroup(q.groupBy("cb", "qb")).applyInArrow(search, "query_id long, qv binary, nth int, vec_id long, score long")
    order = Window.partitionBy("query_id", "qv", "nth").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_sql(table: str, every: int = 50, k: int = 5, scale: int = 256) -> str:
    return f"""
    WITH e AS (SELECT vec_id, embedding, greatest(1, max(len(embedding)) OVER ()) AS dim FROM {table}
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    v AS (SELECT row_number() OVER () AS n, vec_id, list_resize(list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))), dim, 0) AS v FROM e)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score,
        row_number() OVER (PARTITION BY q.n ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS rank
      FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % {every} = 0) WHERE rank <= {k}"""
