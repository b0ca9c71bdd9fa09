"""Op 7: nearest neighbours with randomly rotated one-bit codes.

Every vector is taken relative to the mean of all, scaled to length one,
turned by a random rotation and kept as the signs of its components (one bit
each) with two correction scalars: its distance from the mean and the inner
product of the turned unit vector with its own code.  From a code the inner
product with a query is estimated without bias, with an error bound that holds
with a probability set by EPSILON.  Per query and block of vectors, every
vector whose lower bound of the distance does not exceed the k-th smallest
upper bound is reranked with its original components.

Queries come in blocks against blocks of all vectors; vectors and queries are
sent once per opposite block, pairs never.  A block returns its k nearest per
query, already exact, so the final ranking sees k rows per block."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from partnerlens.llm.common import scratch, shuffle_parts

EPSILON = 3.0
QUERY_BLOCK = 2048
VECTOR_BLOCK = 16384
SMALL_BLOCK = 256  # blocks are not cut smaller than this to occupy the cluster
SEED = 20240229


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random rotation of ``dim`` dimensions, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, distance from the mean, inner product with the code)."""
    rest = vectors - mean
    norm = np.linalg.norm(rest, axis=1)
    unit = rest / np.where(norm > 0, norm, 1)[:, None] @ turn
    dim = vectors.shape[1]
    own = np.abs(unit).sum(axis=1) / math.sqrt(dim)
    return np.packbits(unit > 0, axis=1), norm, np.where(own > 0, own, 1.0)


def bounds(bits: np.ndarray, norm: np.ndarray, own: np.ndarray, queries: np.ndarray, mean: np.ndarray,
           turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances, (queries, vectors)."""
    dim = queries.shape[1]
    q = (queries - mean) @ turn
    q_norm = np.linalg.norm(q, axis=1)
    q_unit = q / np.where(q_norm > 0, q_norm, 1)[:, None]
    code = (np.unpackbits(bits, axis=1, count=dim).astype(np.float64) * 2 - 1) / math.sqrt(dim)
    estimate = q_unit @ code.T / own
    error = EPSILON * np.sqrt(np.maximum(1 - own ** 2, 0) / own ** 2) / math.sqrt(max(dim - 1, 1))
    base = q_norm[:, None] ** 2 + norm[None, :] ** 2
    scale = 2 * q_norm[:, None] * norm[None, :]
    return base - scale * np.minimum(estimate + error, 1), base - scale * np.maximum(estimate - error, -1)


def _search(k: int, mean: list[float]):
    mean_v = np.array(mean)
    turn = rotation(len(mean)) if mean else None

    def run(key, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out_r, out_q, out_v, out_d = [], [], [], []
        if vectors.num_rows and queries.num_rows:
            dim = len(mean)
            ids = vectors.column("vec_id").to_numpy()
            v = vectors.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim).astype(np.float64)
            bits = np.stack([np.frombuffer(x, np.uint8) for x in vectors.column("bits").to_pylist()])
            norm, own = vectors.column("norm").to_numpy(), vectors.column("own").to_numpy()
            q_ids, q_rows = queries.column("vec_id").to_numpy(), queries.column("row").to_numpy()
            q = queries.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim).astype(np.float64)
            for a in range(0, len(q), 64):
                low, high = bounds(bits, norm, own, q[a:a + 64], mean_v, turn)
                for i in range(len(low)):
                    other = ids != q_ids[a + i]
                    if not other.any():
                        continue
                    limit = np.partition(high[i][other], k - 1)[k - 1] if other.sum() >= k else np.inf
                    take = np.flatnonzero(other & (low[i] <= limit * (1 + 1e-9) + 1e-12))
                    d = np.sqrt(((v[take] - q[a + i]) ** 2).sum(axis=1))
                    best = np.lexsort((ids[take], d))[:k]
                    out_r += [int(q_rows[a + i])] * len(best)
                    out_q += [int(q_ids[a + i])] * len(best)
                    out_v += ids[take][best].tolist()
                    out_d += d[best].tolist()
        return pa.table({"row": pa.array(out_r, pa.int64()), "query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()),
                         "score": pa.array(out_d, pa.float64())})
    return run


def _codes(mean: list[float]):
    mean_v = np.array(mean)
    turn = rotation(len(mean)) if mean else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("v").flatten().to_numpy().reshape(-1, len(mean)).astype(np.float64)
            bits, norm, own = encode(v, mean_v, turn)
            yield pa.record_batch([b.column("vec_id"), b.column("v"), pa.array([x.tobytes() for x in bits], pa.binary()),
                                   pa.array(norm), pa.array(own)], names=["vec_id", "v", "bits", "norm", "own"])
    return run


def nearest(vectors: DataFrame, is_query, k: int = 10, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance in double precision)
    of the k nearest other rows of every row for which ``is_query`` holds;
    ties go to the smaller id, fewer rows where there are fewer candidates.

    Rows whose id or vector is null, empty, zero, or holds a null or
    non-finite component take no part.  Vectors of different lengths have no
    distance: each length is searched by itself.  Rows that repeat an id are
    not candidates of that id; among candidates each counts by itself, and as
    queries each has a list of its own.  An empty table gives no rows."""
    c = F.col("v")
    fine = (F.col("vec_id").isNotNull() & c.isNotNull() & (F.size(c) > 0)
            & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
            & F.exists(c, lambda x: x != 0))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v"),
                          is_query.alias("__q")).filter(fine)
    lengths = {r["dim"]: r["count"] for r in rows.groupBy(F.size("v").alias("dim")).count().collect()}  # few
    out = None
    for dim, n in sorted(lengths.items()) or [(0, 0)]:
        part = _nearest_of(rows.filter(F.size("v") == dim), dim, n, k)
        out = part if out is None else out.unionByName(part)
    return out


def _nearest_of(rows: DataFrame, dim: int, n: int, k: int) -> DataFrame:
    """The search among ``n`` rows (vec_id, v, __q) of one length."""
    mean = [float(x) for x in rows.agg(*[F.avg(F.element_at("v", i + 1)) for i in range(dim)]).first()] if n else []
    parts = shuffle_parts(rows.sparkSession)
    blocks = max(1, math.ceil(n / VECTOR_BLOCK), min(parts, math.ceil(n / SMALL_BLOCK)))
    chosen = scratch(rows.filter("__q").select("vec_id", "v").withColumn("row", F.monotonically_increasing_id()), "queries")
    q_blocks = max(1, math.ceil(chosen.count() / QUERY_BLOCK))
    of = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m))
    index = scratch(rows.select("vec_id", "v").mapInArrow(_codes(mean), "vec_id long, v array<double>, bits binary, norm double, own double"), "codes")
    cell = lambda q, v: (q * F.lit(blocks) + v).alias("cell")
    left = (index.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
            .select(cell(F.col("qb"), of(blocks)), "vec_id", "v", "bits", "norm", "own"))
    right = (chosen.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
             .select(cell(of(q_blocks), F.col("vb")), "vec_id", "v", "row"))
    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(
        _search(k, mean), "row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy("score", "vec_id"))
    return (found.withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
