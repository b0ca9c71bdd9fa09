"""Op 12: hard-negative mining with an inverted multi-index.

Vectors are whole numbers (components scaled and floored) cut into two halves.
Each half has a codebook; a pair of codes is a cell.  For an anchor q the score
of any vector of cell (i, j) is at most

    q1 . C1[i] + |q1| r1[i]  +  q2 . C2[j] + |q2| r2[j]

where r is the largest distance of a member's half from its centre.  A heap
merges the two half-score lists and yields cells by falling bound (the
multi-sequence algorithm).  Cells are read in that order until the result is
certified: a list is full and its last score exceeds the bound of everything
left, or that bound lies below the window.  Cells that the opposite bound puts
above every open window are left out.  The codebooks only decide how much is
read, never the result, so they are fitted on a bounded sample
(``SAMPLE_ROWS``); every row is indexed.

Consecutive cells make blocks of rows.  Anchors come in packs; a pack meets
every block, pairs never leave a task, and a block returns at most ``k`` rows
per list.  Two passes: the anchors' positives first, whose scores then set the
windows of the negatives."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from partnerlens.llm.common import scratch, shuffle_parts

SAMPLE_ROWS = 16384   # rows the codebooks are fitted on
MAX_CODES = 256       # codes per half, so 65536 cells at most
CELL_ROWS = 64        # rows a cell should have
BLOCK_ROWS = 16384
SMALL_BLOCK = 1024    # blocks are not cut smaller than this to occupy the cluster
PACK = 4096           # anchors that meet a block together
SEED = 7
EXACT = 1 << 53       # sums below this are exact in double precision


def codebook(half: np.ndarray, codes: int, rounds: int = 8) -> np.ndarray:
    """Centres of ``codes`` groups of rows (Lloyd's rounds from spread rows)."""
    at = np.random.default_rng(SEED).permutation(len(half))[:codes]
    centre = half[at].copy()
    for _ in range(rounds):
        own = nearest_code(half, centre)
        size = np.bincount(own, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, own, half)
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centre)
    return centre


def nearest_code(half: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.argmin((centre ** 2).sum(axis=1) - 2 * half @ centre.T, axis=1)


def multi_sequence(one: np.ndarray, two: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(one[i] + two[j], i, j) by falling sum, through a heap of which a cell
    becomes part when its neighbour towards the start has left."""
    a, b = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
    x, y = one[a].tolist(), two[b].tolist()
    if not x or not y:
        return
    heap = [(-(x[0] + y[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(a[i]), int(b[j])
        if j + 1 < len(y):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))


class Best:
    """The ``k`` best (score, id) of one list: scores falling, ids rising."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        if len(self.score) == self.k:
            fit = score >= self.score[-1]
            score, ids = score[fit], ids[fit]
        if len(score):
            s, i = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
            order = np.lexsort((i, -s))[:self.k]
            self.score, self.id = s[order], i[order]

    def closed(self, bound: float) -> bool:
        return len(self.score) == self.k and self.score[-1] > bound


class Index:
    """The rows of one block by cell and label."""

    def __init__(self, rows: pa.Table, books: tuple[np.ndarray, np.ndarray]):
        dim = books[0].shape[1] + books[1].shape[1]
        v = rows.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        c1, c2, label, ids = (rows.column(c).to_numpy() for c in ("c1", "c2", "label", "vec_id"))
        order = np.lexsort((ids, label, c2, c1))
        self.v, c1, c2, self.label, self.id = v[order], c1[order], c2[order], label[order], ids[order]
        self.cut = books[0].shape[1]
        self.top = int(np.abs(self.v).max(initial=0))
        self.real = self.v.astype(np.float64)
        self.codes, self.centre, self.radius = [], [], []
        for c, book, half in ((c1, books[0], self.real[:, :self.cut]), (c2, books[1], self.real[:, self.cut:])):
            present, at = np.unique(c, return_inverse=True)
            r = np.zeros(len(present))
            np.maximum.at(r, at, np.linalg.norm(half - book[c], axis=1))
            self.codes.append(present)
            self.centre.append(book[present])
            self.radius.append(r)
        i1, i2 = (np.searchsorted(p, c) for p, c in zip(self.codes, (c1, c2)))
        head = np.flatnonzero(np.diff(i1 * len(self.codes[1]) + i2, prepend=-1))
        ends = np.append(head[1:], len(i1))
        self.cell = {(int(i1[a]), int(i2[a])): (int(a), int(b)) for a, b in zip(head, ends)}

    def half_scores(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(upper, lower) bounds of the half scores by code."""
        out = []
        for half, centre, radius in zip((q[:self.cut], q[self.cut:]), self.centre, self.radius):
            near, wide = centre @ half, np.linalg.norm(half) * radius
            slack = 1e-9 * (np.abs(near) + wide) + 1e-6
            out.append((near + wide + slack, near - wide - slack))
        return out

    def scores(self, a: int, b: int, q: np.ndarray) -> np.ndarray:
        """Exact inner products of rows a..b-1; beyond a long they stay at its ends."""
        if self.top * int(np.abs(q).max(initial=0)) * max(len(q), 1) < EXACT:
            return (self.real[a:b] @ q.astype(np.float64)).astype(np.int64)
        long = np.iinfo(np.int64)
        return np.array([min(max(int(x), long.min), long.max) for x in self.v[a:b].astype(object) @ q.astype(object)], dtype=np.int64)

    def positives(self, q: np.ndarray, own_id: int, label: int, k: int) -> Best:
        """The k best other rows of the label."""
        best = Best(k)
        (u1, _), (u2, _) = self.half_scores(q.astype(np.float64))
        for bound, i, j in multi_sequence(u1, u2):
            if best.closed(bound):
                break
            if (i, j) in self.cell:
                a, b = self.cell[i, j]
                x, y = np.searchsorted(self.label[a:b], [label, label + 1]) + a
                if x < y:
                    other = self.id[x:y] != own_id
                    best.add(self.scores(x, y, q)[other], self.id[x:y][other])
        return best

    def negatives(self, q: np.ndarray, label: int, windows: list[tuple[int, int]], k: int) -> list[Best]:
        """The k best rows of other labels in each window [low, high] of scores."""
        lists = [Best(k) for _ in windows]
        live = list(range(len(windows)))
        (u1, l1), (u2, l2) = self.half_scores(q.astype(np.float64))
        for bound, i, j in multi_sequence(u1, u2):
            live = [w for w in live if bound >= windows[w][0] and not lists[w].closed(bound)]
            if not live:
                break
            if (i, j) not in self.cell or l1[i] + l2[j] > max(windows[w][1] for w in live):
                continue
            a, b = self.cell[i, j]
            s, other = self.scores(a, b, q), self.label[a:b] != label
            for w in live:
                fit = other & (s >= windows[w][0]) & (s <= windows[w][1])
                if fit.any():
                    lists[w].add(s[fit], self.id[a:b][fit])
        return lists


FOUND = "aid string, place int, vec_id long, score long"


def _found(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                    names=[f.split()[0] for f in FOUND.split(", ")])


def _positives(books, k: int):
    def run(key, rows: pa.Table, packs: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and packs.num_rows:
            index = Index(rows, books)
            for pack in packs.column("anchors").to_pylist():
                for r in pack:
                    best = index.positives(np.array(r["v"], dtype=np.int64), r["vec_id"], r["label"], k)
                    out += [(r["aid"], 0, i, s) for s, i in zip(best.score.tolist(), best.id.tolist())]
        return _found(out)
    return run


def _negatives(books, k: int, low: int, high: int):
    def run(key, rows: pa.Table, packs: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and packs.num_rows:
            index = Index(rows, books)
            for pack in packs.column("anchors").to_pylist():
                for r in pack:
                    wants = [(p["place"], (-(-low * p["score"] // 100), high * p["score"] // 100)) for p in r["positives"]]
                    lists = index.negatives(np.array(r["v"], dtype=np.int64), r["label"], [w for _, w in wants], k)
                    for (place, _), best in zip(wants, lists):
                        out += [(r["aid"], place, i, s) for s, i in zip(best.score.tolist(), best.id.tolist())]
        return _found(out)
    return run


def _assign(books):
    cut = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1).astype(np.float64)
                codes = [nearest_code(h, book) for h, book in zip((v[:, :cut], v[:, cut:]), books)]
                yield pa.record_batch([*b.columns, *[pa.array(c, pa.int32()) for c in codes]],
                                      names=["vec_id", "label", "v", "chosen", "c1", "c2"])
    return run


def _top(found: DataFrame, by: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | str = "label", n_positives: int = 5, k: int = 10,
                   low: int = 30, high: int = 90, scale: int = 256, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score: for each row with ``is_anchor`` and each of its
    ``n_positives`` best other rows of the same label the ``k`` best rows of
    other labels with low * positive <= 100 * negative <= high * positive.
    Scores are inner products of the components floor(scale * x); ties go to
    the smaller id; lists are shorter where fewer rows qualify.

    Rows take no part whose id, label or vector is null or whose vector holds a
    null or non-finite component.  A shorter vector counts as filled up with
    zeros.  Components and scores beyond a 64-bit number stay at its ends.
    Rows with the anchor's id are not its positives; anchors equal in id, label
    and vector are one; any other rows that repeat an id count each.  An anchor
    without positives, or whose windows are empty, has no rows.  Other columns
    are not read; an empty table gives no rows."""
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"),
                          F.col(vec).cast("array<double>").alias("v"), is_anchor.alias("chosen"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()
                       & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    rows = rows.withColumn("v", F.transform(v, lambda x: F.floor(x * scale)))
    size = rows.agg(F.max(F.size("v")).alias("dim"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("chosen"), 1)).alias("anchors")).first()
    n, dim = size["n"], max(size["dim"] or 0, 2)
    rows = rows.withColumn("v", F.concat(v, F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size(v))))
    sample = rows.select("v").orderBy(F.xxhash64("vec_id", "label"), "vec_id").limit(SAMPLE_ROWS).collect() if n else []
    points = np.array([r["v"] for r in sample], dtype=np.float64).reshape(-1, dim)
    codes = min(MAX_CODES, max(1, math.ceil(math.sqrt(n / CELL_ROWS))))
    books = (codebook(points[:, :dim // 2], codes), codebook(points[:, dim // 2:], codes)) if n else \
        (np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2)))
    index = scratch(rows.mapInArrow(_assign(books), "vec_id long, label long, v array<long>, chosen boolean, c1 int, c2 int"), "index")

    # consecutive cells make blocks; a cell larger than a block is dealt out.  One row per cell, MAX_CODES ** 2 at most
    per = min(BLOCK_ROWS, max(SMALL_BLOCK, math.ceil(n / shuffle_parts(spark))))
    cell = (F.col("c1") * MAX_CODES + F.col("c2")).alias("cell")
    sizes = index.groupBy(cell).agg(F.count(F.lit(1)).alias("m"))
    splits = F.ceil(F.col("m") / per).cast("int")
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    small = F.coalesce(F.sum(F.when(F.col("m") <= per, F.col("m"))).over(before), F.lit(0))
    large = F.coalesce(F.sum(F.when(F.col("m") > per, splits)).over(before), F.lit(0))
    ranges = math.ceil(n / per)  # blocks of small cells come first, then the parts of large ones
    start = F.when(F.col("m") <= per, F.floor(small / per)).otherwise(large + ranges).cast("int")
    cells = scratch(sizes.select("cell", start.alias("start"), F.when(F.col("m") <= per, 1).otherwise(splits).alias("splits")), "cells")
    deal = F.col("start") + F.pmod(F.xxhash64("vec_id", "label", "v"), F.col("splits")).cast("int")
    blocks = scratch(index.withColumn("cell", cell).join(F.broadcast(cells), "cell")
                     .select(deal.alias("block"), "vec_id", "label", "v", "c1", "c2"), "blocks")
    last = blocks.agg(F.max("block").alias("last")).first()["last"] or 0

    n_packs = max(1, math.ceil(size["anchors"] / PACK))
    aid = F.md5(F.concat_ws("|", "vec_id", "label", F.concat_ws(",", F.transform("v", lambda x: x.cast("string")))))
    anchors = scratch(index.filter("chosen").select("vec_id", "label", "v").distinct().withColumn("aid", aid), "anchors")

    def search(who: DataFrame, kernel) -> DataFrame:
        packs = (who.withColumn("pack", F.pmod(F.xxhash64("aid"), F.lit(n_packs)).cast("int"))
                 .groupBy("pack").agg(F.collect_list(F.struct(*who.columns)).alias("anchors")))
        # every block meets every pack: one row each, however many vectors and anchors they hold
        meet = packs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last))))
        sent = blocks.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(n_packs - 1))))
        return sent.groupBy("pack", "block").cogroup(meet.groupBy("pack", "block")).applyInArrow(kernel, FOUND)

    best = _top(search(anchors, _positives(books, n_positives)), ["aid"], n_positives)
    positives = scratch(best.select("aid", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"),
                                    F.col("score").alias("positive_score")), "positives")
    wants = positives.groupBy("aid").agg(F.collect_list(F.struct("place", F.col("positive_score").alias("score"))).alias("positives"))
    found = search(anchors.join(wants, "aid"), _negatives(books, k, low, high))
    return (_top(found, ["aid", "place"], k).join(positives, ["aid", "place"])
            .join(anchors.select("aid", F.col("vec_id").alias("anchor_id")), "aid")
            .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))


# the registered query in DuckDB SQL
SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label AS label,
             CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = own
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) <= 10
"""
