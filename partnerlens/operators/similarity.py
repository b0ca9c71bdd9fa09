"""Exact similarity kernels.

``cosine_topk`` -- exact k nearest neighbours by cosine similarity (the
reference uses brute-force ``NearestNeighbors``), without comparing all ids:

1. Equal vectors are one class; only classes are compared.  A class stands for
   its smallest ids, as many as an answer can name.
2. Beyond a few blocks, candidate classes lie in buckets around pivots (classes chosen by hash, at
   most PIVOTS_MAX, about the root of the number of classes).  A query goes
   to a bucket only if the angle to its pivot less the bucket's radius allows
   a similarity as high as the query's k-th best pivot.  The bound is exact,
   so no neighbour is lost.
   With more than ``PATTERN_FROM`` features (product flags) angles to pivots
   bound little.  There a bucket is a pattern of present and absent features,
   the most balanced ones first.  What a query has on the absent features is
   lost to it in that bucket, which bounds the similarity from above.  A query
   searches the bucket of its own pattern first; what its k-th best reaches there
   is its threshold for the others.  Inside a block the classes are sorted by
   their whole pattern into leaves; the largest, smallest and least absolute
   weight of every feature in a leaf bound the scores of its members, and only
   leaves whose bound reaches the query's threshold are scored.  Vectors that
   hold most of their features have no patterns to tell them apart, and with so
   many features no pivots either: they are compared block by block.
3. Buckets are cut into blocks of about ``block_rows`` classes; a numpy kernel
   per pair of blocks emits its top k per query, ranked by a final window over
   at most k rows per block.

No pair rows are shuffled, nothing that grows with the data passes the driver.

``jaccard_pairs`` -- |A n B| / |A u B| between sets (e.g. products by the
partners holding them).  Element->set pairs are de-duplicated first (map-side
partial aggregation, so a hot element or set is reduced before any shuffle),
then each partition counts set co-occurrence locally with numpy, one tile of
sets against another, and emits one row per co-occurring pair of *sets*; those
partial counts are summed by a second, small aggregation.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from partnerlens.operators.joins import heavy_join
from partnerlens.session import stored

BLOCK_ROWS = 4096       # vectors per block, on average; a kernel holds BLOCK_ROWS^2 doubles (128 MB)
PIVOTS_MAX = 4096       # pivots of all groups together
PIVOTS_FROM = 8         # blocks in a group from which on finding buckets costs less than it saves
PATTERN_FROM = 8        # features from which on buckets are patterns, not pivots
PATTERN_BITS = 30       # features of a pattern at most
LEAF_CLASSES = 8        # classes of similar pattern bounded together
PROBES = 64             # leaves of a query that are scored first
PATTERN_BLOCKS = 32     # blocks of classes that make one block of leaves
BLOCK_LEAF = 64         # classes of a leaf in the blocks' kernel: coarser than LEAF_CLASSES, fewer bounds and calls
MEET_CELLS = 1 << 22    # rows x features a side of the blocks that meet in one kernel, if there are many; scored one pair at a time
QUERY_BLOCKS = 8        # blocks of queries that meet a block of leaves in one kernel
PATTERN_SHARE = 0.75    # features held by a class, on average, up to which buckets are patterns
TILE_SETS = 1024        # sets per tile of a local co-occurrence count
RANK_DIGITS = 12        # similarities are ranked after rounding to 12 decimals, so
                        # results do not depend on summation order (block layout, engine)
BOUND_SLACK = 1e-9      # covers the rounding of angles in the bucket bound


def light_slack(d: int) -> float:
    """Covers the rounding of bounds and products of d features in single precision."""
    return 1e-5 + 1.2e-7 * d ** 1.5


def parallelism(spark) -> int:
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - Spark Connect sessions have no SparkContext
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def n_blocks(df: DataFrame, id_col: str, block_rows: int) -> int:
    n = df.select(id_col).distinct().count()
    return max(1, math.ceil(n / block_rows))


def top_rows(sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the k largest finite entries per row, ordered by
    value (to RANK_DIGITS) and column.  Entries within a tolerance of the k-th
    largest raw value are a superset; only those are rounded and ordered."""
    k = min(k, sim.shape[1])
    if not k or not len(sim):
        none = np.zeros(0, dtype=int)
        return none, none, np.zeros(0)
    at = sim.shape[1] - k
    low = np.partition(sim, at, axis=1)[:, at:at + 1]
    rows, cols = np.nonzero(sim >= low - 4 * 10.0 ** -RANK_DIGITS)
    vals = sim[rows, cols]
    fin = np.isfinite(vals)
    return first_rows(rows[fin], cols[fin], vals[fin], k)


def first_rows(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first entries of every row by value (to RANK_DIGITS) and column."""
    o = np.lexsort((cols, -np.round(vals, RANK_DIGITS), rows))
    rows, cols, vals = rows[o], cols[o], vals[o]
    first = np.r_[0, np.flatnonzero(np.diff(rows)) + 1] if len(rows) else np.zeros(0, dtype=int)
    keep = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)])) < k
    return rows[keep], cols[keep], vals[keep]


def _unit(dis, vals, d: int) -> np.ndarray:
    """Sparse rows (positions, values) as dense vectors of length one; zero
    vectors stay zero."""
    m = np.zeros((len(dis), d))
    rows = np.repeat(np.arange(len(dis)), [len(x) for x in dis])
    if len(rows):
        m[rows, np.concatenate([np.asarray(x, dtype=int) for x in dis])] = np.concatenate(list(vals))
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(norm > 0, norm, 1.0)[:, None]


def _lengths(vals) -> np.ndarray:
    return np.array([math.sqrt(sum(x * x for x in v)) for v in vals])


def _by_group(pdf: pd.DataFrame, g: list[str]):
    if not g:
        yield (), pdf
    else:
        yield from pdf.groupby(g, sort=False)


def _place(pivots: dict, g: list[str], d: int):
    """Classes -> their bucket (nearest pivot; -1 for zero vectors) and angle."""
    def run(batches):
        for pdf in batches:
            for key, part in _by_group(pdf, g):
                u = _unit(part["dis"], part["vals"], d)
                s = u @ pivots[key].T if key in pivots else np.zeros((len(u), 1))
                zero = ~u.any(axis=1)
                yield part.assign(bucket=np.where(zero, -1, s.argmax(axis=1)).astype(np.int32),
                                  angle=np.where(zero, 0.0, np.arccos(np.clip(s.max(axis=1), -1, 1))))
    return run


def _reach(pivots: dict, radius: dict, g: list[str], d: int, kk: int):
    """Queries -> a row per bucket that may hold one of their kk nearest, which
    are at least as similar as ``least`` (if the queries bring it); bucket
    ``home``, searched already, is left out."""
    def run(batches):
        for pdf in batches:
            for key, part in _by_group(pdf, g):
                mine = radius.get(key, {})
                if not mine:
                    continue
                u = _unit(part["dis"], part["vals"], d)
                buckets = np.array(sorted(mine), dtype=np.int32)
                r = np.array([mine[b] for b in buckets.tolist()])
                p = pivots.get(key, np.zeros((0, d)))
                s = u @ p.T
                least = np.partition(s, len(p) - kk, axis=1)[:, len(p) - kk] if len(p) >= kk else np.full(len(u), -np.inf)
                if "least" in part:
                    least = np.maximum(least, part["least"].to_numpy())
                best = np.zeros((len(u), len(buckets)))             # zero vectors: similarity 0 with everything
                some = buckets >= 0
                if some.any():
                    angle = np.arccos(np.clip(s[:, buckets[some]], -1, 1))
                    best[:, some] = np.where(u.any(axis=1)[:, None], np.cos(np.maximum(angle - r[some], 0.0)), 0.0)
                reached = best >= least[:, None] - BOUND_SLACK
                if "home" in part:          # searched already
                    reached &= buckets != part["home"].to_numpy()[:, None]
                rows, cols = np.nonzero(reached)
                yield part.iloc[rows].assign(bucket=buckets[cols])
    return run


def _codes(u: np.ndarray, top: list[int]) -> np.ndarray:
    """Pattern of present features, the first of ``top`` in the highest bit."""
    return (u[:, top] != 0) @ (1 << np.arange(len(top) - 1, -1, -1, dtype=np.int64))


def _place_pattern(top: dict, bits: dict, g: list[str], d: int):
    """Classes -> their bucket (the first bits of the pattern) and pattern."""
    def run(batches):
        for pdf in batches:
            for key, part in _by_group(pdf, g):
                code = _codes(_unit(part["dis"], part["vals"], d), top.get(key, []))
                yield part.assign(bucket=(code >> (len(top.get(key, [])) - bits.get(key, 0))).astype(np.int32), pattern=code)
    return run


def _reach_pattern(pivots: dict, top: dict, bits: dict, buckets: dict, g: list[str], d: int, kk: int):
    """Queries -> a row per bucket that may hold one of their kk nearest, with
    the similarity that these reach at least (``least``; found here with the
    pivots unless the queries bring it).  A query's bucket ``home`` is left out."""
    def run(batches):
        for pdf in batches:
            for key, part in _by_group(pdf, g):
                have = np.array(sorted(buckets.get(key, ())), dtype=np.int64)
                u = _unit(part["dis"], part["vals"], d)
                p = pivots.get(key, np.zeros((0, d)))
                if "least" in part:
                    least = part["least"].to_numpy()
                else:
                    s = u @ p.T
                    least = np.partition(s, len(p) - kk, axis=1)[:, len(p) - kk] if len(p) >= kk else np.full(len(u), -np.inf)
                b = bits.get(key, 0)
                absent = ((have[:, None] >> np.arange(b - 1, -1, -1)) & 1) == 0
                lost = (u[:, top.get(key, [])[:b]] ** 2) @ absent.T.astype(float)
                # similarities may be negative: then the bound says nothing below zero
                best = np.sqrt(np.clip(u.any(axis=1)[:, None] - lost, 0, 1))
                reached = best >= least[:, None] - BOUND_SLACK
                if "home" in part:          # searched already
                    reached &= have != part["home"].to_numpy()[:, None]
                rows, cols = np.nonzero(reached)
                yield part.iloc[rows].assign(bucket=have[cols].astype(np.int32), least=least[rows])
    return run


class Leaves:
    """Unit rows c (of vectors of the given lengths) in leaves of similar
    pattern, with the bounds of their members."""

    def __init__(self, c: np.ndarray, length: np.ndarray, pattern: np.ndarray, size: int = LEAF_CLASSES):
        self.c = c
        order = np.argsort(pattern, kind="stable")
        starts = np.arange(0, len(c), size)
        self.members = np.split(order, starts[1:])
        self.cuts = np.r_[starts, len(c)].tolist()
        self.light = np.ascontiguousarray(c[order], dtype=np.float32)       # leaf after leaf
        weight = np.abs(c[order]) * length[order, None]
        most, least = np.maximum.reduceat(weight, starts), np.minimum.reduceat(weight, starts)
        scale = most.max(axis=1, initial=0)[:, None]        # of a leaf's own: its ratios stay, single precision holds them
        scale[scale == 0] = 1.0
        self.high, self.low, self.some, self.most, self.least = (
            np.ascontiguousarray(x.T, dtype=np.float32) for x in (
                np.maximum.reduceat(c[order], starts), np.minimum.reduceat(c[order], starts), most > 0,
                (most / scale) ** 2, (least / scale) ** 2))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bound of the similarity of every query to the members of every
        leaf, in single precision (its rounding is covered)."""
        # what a leaf lacks is lost to the query, what all of it has besides is lost to its members
        q = q.astype(np.float32)
        has = (q != 0).astype(np.float32)
        whole = (1 - has) @ self.least
        inside = has @ self.most
        whole += inside
        np.divide(inside, whole, out=inside, where=whole > 0)
        inside *= (q * q) @ self.some
        np.sqrt(inside, out=inside)
        direct = np.maximum(q, 0) @ self.high
        if q.min(initial=0) < 0:
            direct += np.minimum(q, 0) @ self.low
        np.minimum(direct, inside, out=direct)
        direct += np.float32(light_slack(q.shape[1]))
        return direct

    def scores(self, q: np.ndarray, least: np.ndarray, kk: int) -> tuple[np.ndarray, int]:
        """Similarities of unit rows q, -inf where a bound shows that the pair
        is not among the kk best of the query, and how many pairs were scored.
        ``least``: what the kk-th best of a query reaches at least."""
        bound = self.bounds(q)
        sim = np.full((len(q), len(self.c)), -np.inf)
        n = len(self.members)
        first = np.zeros(bound.shape, dtype=bool)       # the most promising leaves, which raise the threshold
        np.put_along_axis(first, np.argpartition(bound, max(0, n - PROBES), axis=1)[:, max(0, n - PROBES):], True, axis=1)
        done = 0
        for want in (first, ~first):
            want &= bound >= least[:, None]
            for i in np.flatnonzero(want.any(axis=0)).tolist():
                rows, leaf = np.flatnonzero(want[:, i]), self.members[i]
                sim[np.ix_(rows, leaf)] = q[rows] @ self.c[leaf].T
                done += len(rows) * len(leaf)
            if sim.shape[1] >= kk:
                least = np.maximum(least, np.partition(sim, sim.shape[1] - kk, axis=1)[:, sim.shape[1] - kk])
        return sim, done

    def best(self, q: np.ndarray, least: np.ndarray, kk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, value) of the kk best of every unit row of q, as
        ``top_rows`` of all similarities would give them; entries below
        ``least`` may be missing.  Only pairs that a bound admits are held."""
        bound, near, light = self.bounds(q), 4 * 10.0 ** -RANK_DIGITS, q.astype(np.float32)
        slack = near + light_slack(q.shape[1])
        found, least = [], least.astype(float)
        wanted = [None]
        if np.isneginf(least).any():        # the most promising leaves first: they give a threshold
            probes = min(len(self.members), max(1, PROBES * LEAF_CLASSES // len(self.members[0])))
            first = np.zeros(bound.shape, dtype=bool)
            at = bound.shape[1] - probes
            np.put_along_axis(first, np.argpartition(bound, at, axis=1)[:, at:], True, axis=1)
            wanted = [first, ~first]
        for want in wanted:
            reached = bound >= least[:, None]
            if want is not None:
                reached &= want
            leaf, rows = np.nonzero(np.ascontiguousarray(reached.T))
            cuts = np.searchsorted(leaf, np.arange(len(self.members) + 1))
            part = []
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                r = rows[cuts[i]:cuts[i + 1]]
                sim = light[r] @ self.light[self.cuts[i]:self.cuts[i + 1]].T
                low = least[r] - slack
                if want is not None and sim.shape[1] > kk:      # no threshold yet: the kk best of the leaf do
                    low = np.maximum(low, np.partition(sim, sim.shape[1] - kk, axis=1)[:, sim.shape[1] - kk] - 2 * slack)
                at, of = np.nonzero(sim >= low[:, None])
                part.append((r[at], self.members[i][of]))
            if part:
                r, c = (np.concatenate(x) for x in zip(*part))
                v = np.einsum("ij,ij->i", q[r], self.c[c])
                low = _kth(r, v, len(q), kk)
                keep = v >= np.maximum(least, low)[r] - near
                found.append((r[keep], c[keep], v[keep]))
                least = np.maximum(least, low)
        if not found:
            return first_rows(np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0), kk)
        return first_rows(*(np.concatenate(x) for x in zip(*found)), kk)


def _kth(rows: np.ndarray, vals: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th largest value of each of n rows, -inf for rows of fewer values."""
    o = np.lexsort((-vals, rows))
    starts = np.searchsorted(rows[o], np.arange(n + 1))
    some = np.flatnonzero(np.diff(starts) >= k)
    out = np.full(n, -np.inf)
    out[some] = vals[o][starts[some] + k - 1]
    return out


def _vectors(df: DataFrame, g: list[str], id_col: str, dim_col: str, val_col: str, dims: Column) -> DataFrame:
    """(group..., id, dis, vals, cls): sparse vectors by position in the
    dimension catalog; cls is the same for equal vectors of a group."""
    numbers = df.sparkSession.range(1).select(F.posexplode(dims).alias("di", "_d"))      # the catalog as a table
    cells = (df.filter(F.col(id_col).isNotNull())
             .groupBy(*g, F.col(id_col).alias("id"), F.col(dim_col).cast("string").alias("_d"))
             .agg(F.sum(val_col).cast("double").alias("val"))
             .join(numbers, "_d", "left"))
    held = F.filter(F.collect_list(F.struct("di", "val")), lambda x: x["di"].isNotNull() & (x["val"] != 0))
    return (cells.groupBy(*g, "id").agg(F.array_sort(held).alias("_e"))       # at most the catalog
            .select(*g, "id", F.transform("_e", lambda x: x["di"]).alias("dis"),
                    F.transform("_e", lambda x: x["val"]).alias("vals"))
            .withColumn("cls", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in g],
                                                 F.col("dis").cast("string"), F.col("vals").cast("string")))))


def cosine_topk(cand: DataFrame, k: int, query: DataFrame | None = None,
                id_col: str = "id", dim_col: str = "dim", val_col: str = "val",
                exclude_self: bool = True, block_rows: int = BLOCK_ROWS,
                group_cols: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Top-k cosine neighbours of every query id among the candidate ids.

    Returns (group..., qid, cid, sim, rank); ties (to 12 decimals) broken by
    candidate id ascending; a zero vector has similarity 0 with everything.
    ``query=None`` means all candidates query each other (self excluded when
    ``exclude_self``).  With ``group_cols`` (e.g. a variant key, never null)
    neighbours are searched only inside the same group -- many kNN problems,
    one job.  Null ids and null dimensions take no part.
    """
    g = list(group_cols)
    kk = k + int(exclude_self)          # classes (and members of one) that an answer can need
    both = cand if query is None else cand.select(F.col(dim_col)).unionAll(query.select(F.col(dim_col)))
    dims = (both.select(F.col(dim_col).cast("string").alias("d")).distinct()
            .agg(F.sort_array(F.collect_list("d"))).scalar())          # bounded: the feature catalog

    def classes_of(vec: DataFrame) -> DataFrame:
        return stored(vec.groupBy(*g, "cls").agg(F.min("id").alias("rep"), F.first("dis").alias("dis"),
                                                      F.first("vals").alias("vals"), F.count(F.lit(1)).alias("n")))

    cvec = stored(_vectors(cand, g, id_col, dim_col, val_col, dims))
    qvec = cvec if query is None else stored(_vectors(query, g, id_col, dim_col, val_col, dims))
    cc = classes_of(cvec)
    qc = cc if query is None else classes_of(qvec)
    sized = cc.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max("dis")).alias("d"), F.sum(F.size("dis")).alias("m"))
    groups, most, d, held = sized.agg(F.count(F.lit(1)), F.max("n"), F.max("d"), F.sum("m") / F.sum("n")).first()
    d = 1 + max(x for x in (0, d, qc.agg(F.max(F.array_max("dis"))).first()[0] if query is not None else None)
                if x is not None)

    nn = _class_topk(cc.select(*g, "rep", "dis", "vals"), qc.select(*g, "rep", "dis", "vals"), g, kk,
                     groups, most or 0, d, block_rows,
                     by_pattern=d > PATTERN_FROM and (held or 0) <= PATTERN_SHARE * d)
    # the smallest ids of each class that is named, then of all classes of an answer
    inside = Window.partitionBy(*g, "cls").orderBy("id")
    members = (cvec.select(*g, "cls", "id").withColumn("_n", F.row_number().over(inside))
               .withColumn("crep", F.first("id").over(inside)).filter(F.col("_n") <= kk)
               .select(*g, "crep", F.col("id").alias("cid")))
    best = Window.partitionBy(*g, "qrep").orderBy(F.round("sim", RANK_DIGITS).desc(), F.col("cid").asc())
    answers = (nn.join(members, [*g, "crep"]).withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= kk)
               .groupBy(*g, "qrep").agg(F.array_sort(F.collect_list(F.struct("_r", "cid", "sim"))).alias("_a")))
    named = (answers.join(qc.select(*g, F.col("rep").alias("qrep"), "cls", "n"), [*g, "qrep"])
             .select("cls", "_a", "n"))
    mine = heavy_join(qvec.select(*g, F.col("id").alias("qid"), "cls"), named, "cls", "n",
                      qc.agg(F.sum("n")).scalar())
    others = F.filter("_a", lambda x: x["cid"] != F.col("qid")) if exclude_self else F.col("_a")
    return (mine.select(*g, "qid", F.posexplode(F.slice(others, 1, k)).alias("_p", "_x"))
            .select(*g, "qid", F.col("_x.cid").alias("cid"), F.col("_x.sim").alias("sim"), (F.col("_p") + 1).alias("rank")))


def _class_topk(cc: DataFrame, qc: DataFrame, g: list[str], kk: int, groups: int, most: int, d: int,
                block_rows: int, by_pattern: bool) -> DataFrame:
    """(group..., qrep, crep, sim): the kk nearest classes of every query class,
    ties by the classes' smallest ids.  Groups of few blocks need no pivots."""
    per_group = 1 if most <= PIVOTS_FROM * block_rows or (d > PATTERN_FROM and not by_pattern) else min(math.ceil(math.sqrt(most)), PIVOTS_MAX // max(groups, 1))
    w = Window.partitionBy(*g, "qrep").orderBy(F.round("sim", RANK_DIGITS).desc(), F.col("crep").asc())

    def best(part: DataFrame) -> DataFrame:
        return part.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= kk).drop("_r")

    def meet(reach: DataFrame, placed: DataFrame, q_rows: int, c_rows: int) -> DataFrame:
        return _block_topk(reach, placed, g, kk, d, q_rows, c_rows)

    # where that leaves every slot some kernels, several blocks of both sides meet in one: fewer copies of the vectors
    meeting = max(1, min(MEET_CELLS // (d * block_rows), math.ceil(most / block_rows)))
    while meeting > 1 and groups * math.ceil(most / (meeting * block_rows)) ** 2 < 4 * parallelism(cc.sparkSession):
        meeting //= 2
    rows = meeting * block_rows
    if per_group < 2:
        return best(meet(qc.withColumn("bucket", F.lit(0)), cc.withColumn("bucket", F.lit(0)), rows, rows))
    fields = cc.schema.fields
    integer, double, long = T.IntegerType(), T.DoubleType(), T.LongType()
    if by_pattern:
        c_rows = max(block_rows, min(PATTERN_BLOCKS * block_rows, (1 << 24) // d))      # bounds the dense block of leaves
        q_rows = QUERY_BLOCKS * block_rows
        sizes = cc.groupBy(*g).agg(F.count(F.lit(1)).alias("n"))
        held = cc.select(*g, F.explode("dis").alias("di")).groupBy(*g, "di").agg(F.count(F.lit(1)).alias("m"))
        held = held.join(sizes, g) if g else held.crossJoin(sizes)      # one row
        balance = F.row_number().over(Window.partitionBy(*g).orderBy(F.abs(F.col("m") / F.col("n") - 0.5), "di"))
        top: dict[tuple, list] = {}
        bits: dict[tuple, int] = {}
        for r in held.withColumn("_n", balance).filter(F.col("_n") <= PATTERN_BITS).orderBy("_n").collect():
            key = tuple(r[c] for c in g)        # PATTERN_BITS rows a group
            top.setdefault(key, []).append(r["di"])
            bits[key] = min(len(top[key]), 12, max(0, math.ceil(math.log2(max(1, r["n"] / c_rows)))))
        in_bucket = T.StructType(fields + [T.StructField("bucket", integer), T.StructField("pattern", long)])
        placed = stored(cc.mapInPandas(_place_pattern(top, bits, g, d), in_bucket))
        buckets: dict[tuple, set] = {}
        for r in placed.select(*g, "bucket").distinct().collect():       # at most 2 ** 12 a group
            buckets.setdefault(tuple(r[c] for c in g), set()).add(r["bucket"])
        home = (placed if qc is cc else stored(qc.mapInPandas(_place_pattern(top, bits, g, d), T.StructType(
            qc.schema.fields + in_bucket.fields[-2:])))).drop("pattern")
        near = stored(best(meet(home.withColumn("least", F.lit(-math.inf)), placed, q_rows, c_rows)))
        asked = _asked(home, near, qc.columns, g, kk)
        reach = asked.mapInPandas(_reach_pattern({}, top, bits, buckets, g, d, kk), T.StructType(
            qc.schema.fields + [T.StructField("home", integer), T.StructField("least", double), T.StructField("bucket", integer)]))
        return best(near.unionByName(meet(reach.drop("home"), placed, q_rows, c_rows)))
    by = Window.partitionBy(*g).orderBy(F.xxhash64("rep"), "rep")
    some = cc.filter(F.size("dis") > 0)
    if g:
        chosen = some.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= per_group)
    else:       # a bounded top-n; a window without groups would gather all classes in one task
        chosen = some.withColumn("_n", F.xxhash64("rep")).orderBy("_n", "rep").limit(per_group)
    found: dict[tuple, list] = {}
    for r in chosen.orderBy("_n").collect():                     # at most PIVOTS_MAX rows
        found.setdefault(tuple(r[c] for c in g), []).append((r["dis"], r["vals"]))
    pivots = {key: _unit([x for x, _ in rows], [y for _, y in rows], d) for key, rows in found.items()}
    in_bucket = [T.StructField("bucket", integer), T.StructField("angle", double)]
    placed = stored(cc.mapInPandas(_place(pivots, g, d), T.StructType(fields + in_bucket)))
    radius: dict[tuple, dict] = {}
    for r in placed.groupBy(*g, "bucket").agg(F.max("angle").alias("r")).collect():      # a row per pivot
        radius.setdefault(tuple(r[c] for c in g), {})[r["bucket"]] = r["r"]
    # a query's own bucket first: what it finds there is its threshold for the others
    home = (placed if qc is cc else stored(qc.mapInPandas(_place(pivots, g, d), T.StructType(qc.schema.fields + in_bucket)))).drop("angle")
    near = stored(best(meet(home, placed, rows, rows)))
    asked = _asked(home, near, qc.columns, g, kk)
    reach = asked.mapInPandas(_reach(pivots, radius, g, d, kk), T.StructType(
        qc.schema.fields + [T.StructField("home", integer), T.StructField("least", double), T.StructField("bucket", integer)]))
    return best(near.unionByName(meet(reach.drop("home", "least"), placed, rows, rows)))


def _asked(home: DataFrame, near: DataFrame, columns: list[str], g: list[str], kk: int) -> DataFrame:
    """Queries with their bucket ``home`` and ``least``, what the kk-th best
    found there reaches (-inf if there are fewer)."""
    reached = near.groupBy(*g, F.col("qrep").alias("rep")).agg(
        F.when(F.count(F.lit(1)) >= kk, F.min("sim")).alias("least"))
    return (home.withColumnRenamed("bucket", "home").join(reached, [*g, "rep"], "left")
            .withColumn("least", F.coalesce("least", F.lit(-math.inf))).select(*columns, "home", "least"))


def _block_topk(reach: DataFrame, placed: DataFrame, g: list[str], kk: int, d: int, q_rows: int, c_rows: int) -> DataFrame:
    """(group..., qrep, crep, sim): the kk best of every query in every block of
    candidates of the buckets that it reaches."""
    by_pattern = "pattern" in placed.columns

    def blocks(df: DataFrame, name: str, size: int) -> DataFrame:
        return df.groupBy(*g, "bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias(name))

    layout = blocks(reach, "nq", q_rows).join(blocks(placed, "nc", c_rows), [*g, "bucket"])                  # a row per bucket

    def spread(df: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        extra = [x for x in ("pattern", "least") if x in df.columns]
        return (df.join(F.broadcast(layout), [*g, "bucket"])
                .withColumn(own, F.pmod(F.xxhash64("rep"), F.col(own_n)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
                .select(*[F.col(x).alias(x) for x in (*g, "bucket", "qb", "cb", "rep", "dis", "vals", *extra)]))

    kinds = [placed.schema[c] for c in g]
    id_type = placed.schema["rep"].dataType
    schema = T.StructType(kinds + [T.StructField("qrep", reach.schema["rep"].dataType), T.StructField("crep", id_type),
                                   T.StructField("sim", T.DoubleType())])
    names = [f.name for f in schema.fields]

    def kernel(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({x: pd.Series([], dtype=object) for x in names})
        c = c.sort_values("rep")                                     # columns in id order: ties by id
        qu, cu = _unit(q["dis"], q["vals"], d), _unit(c["dis"], c["vals"], d)
        if by_pattern:
            leaves, at_least = Leaves(cu, _lengths(c["vals"]), c["pattern"].to_numpy(), BLOCK_LEAF), q["least"].to_numpy()
            found = []
            for a in range(0, len(qu), BLOCK_ROWS):
                r, x, v = leaves.best(qu[a:a + BLOCK_ROWS], at_least[a:a + BLOCK_ROWS], kk)
                found.append((r + a, x, v))
            rows, cols, vals = (np.concatenate(x) for x in zip(*found))
        else:
            found = []
            for a in range(0, len(qu), BLOCK_ROWS):
                part = []
                for b in range(0, len(cu), BLOCK_ROWS):
                    r, x, v = top_rows(qu[a:a + BLOCK_ROWS] @ cu[b:b + BLOCK_ROWS].T, kk)
                    part.append((r + a, x + b, v))
                found.append(first_rows(*(np.concatenate(x) for x in zip(*part)), kk))
            rows, cols, vals = (np.concatenate(x) for x in zip(*found))
        out = pd.DataFrame({"qrep": q["rep"].to_numpy()[rows], "crep": c["rep"].to_numpy()[cols], "sim": vals})
        for x in g:
            out[x] = q[x].iloc[0]
        return out[names]

    # spread the kernels over all task slots explicitly (runtime coalescing
    # would pack many heavy ones into few tasks, their inputs being small)
    keys = [*g, "bucket", "qb", "cb"]
    n = max(2 * parallelism(placed.sparkSession), int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (spread(reach, "qb", "nq", "cb", "nc").repartition(n, *keys).groupBy(*keys)
            .cogroup(spread(placed, "cb", "nc", "qb", "nq").repartition(n, *keys).groupBy(*keys))
            .applyInPandas(kernel, schema))


def jaccard_pairs(pairs: DataFrame, set_col: str, elem_col: str) -> DataFrame:
    """Jaccard similarity of every pair of sets that share an element.

    Returns (a, b, inter, size_a, size_b, jaccard) for a != b (both orders).
    Pairs without a shared element have Jaccard 0 and are not emitted.
    """
    d = pairs.select(F.col(set_col).cast("string").alias("s"),
                     F.col(elem_col).cast("string").alias("e")).distinct()
    sizes = d.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    schema = "a string, b string, inter long"

    def counts_of(pdf: pd.DataFrame):
        """Co-occurrence counts of sets within a frame holding whole elements."""
        sets, sinv = np.unique(pdf["s"].to_numpy(), return_inverse=True)
        elems, einv = np.unique(pdf["e"].to_numpy(), return_inverse=True)
        by = np.argsort(sinv, kind="stable")
        cuts = np.searchsorted(sinv[by], np.arange(0, len(sets) + TILE_SETS, TILE_SETS))

        def tile(i: int) -> np.ndarray:
            at = by[cuts[i]:cuts[i + 1]]
            m = np.zeros((len(elems), min(TILE_SETS, len(sets) - i * TILE_SETS)), dtype=np.float32)
            m[einv[at], sinv[at] - i * TILE_SETS] = 1.0
            return m

        for i in range(len(cuts) - 1):
            left = tile(i)
            for j in range(i, len(cuts) - 1):
                acc = left.T @ (tile(j) if j > i else left)   # exact: a frame has far below 2**24 elements
                if i == j:
                    np.fill_diagonal(acc, 0)
                ia, ib = np.nonzero(acc)
                a, b, n = sets[ia + i * TILE_SETS], sets[ib + j * TILE_SETS], acc[ia, ib].astype(np.int64)
                yield pd.DataFrame({"a": a, "b": b, "inter": n})
                if j > i:
                    yield pd.DataFrame({"a": b, "b": a, "inter": n})

    def local_counts(batches):
        """Batches arrive sorted by element: all rows of an element are
        contiguous, so only the last element of a batch is carried into the
        next one and memory stays bounded by a batch."""
        carry = None
        for b in batches:
            if b.empty:
                continue
            if carry is not None:
                b = pd.concat([carry, b], ignore_index=True)
            last = b["e"].iloc[-1]
            tail = b["e"].to_numpy() == last
            carry, done = b[tail], b[~tail]
            if not done.empty:
                yield from counts_of(done)
        if carry is not None and not carry.empty:
            yield from counts_of(carry)

    co = (d.repartition("e").sortWithinPartitions("e").mapInPandas(local_counts, schema)
          .groupBy("a", "b").agg(F.sum("inter").alias("inter")))
    sa = sizes.select(F.col("s").alias("a"), F.col("n").alias("size_a"))
    sb = sizes.select(F.col("s").alias("b"), F.col("n").alias("size_b"))
    return (co.join(sa, "a").join(sb, "b")
            .withColumn("jaccard", F.col("inter") / (F.col("size_a") + F.col("size_b") - F.col("inter")))
            .select("a", "b", "inter", "size_a", "size_b", "jaccard"))


def topn_similar(sim: DataFrame, universe: DataFrame, n: int = 3) -> DataFrame:
    """Top-n most similar other items per item, exact including zero
    similarities: positive pairs come from ``sim`` (a, b, jaccard); items with
    fewer than n positive partners are filled with zero-similarity items in
    name order.  Those fillers are always among the 2n first names, so the
    fill reads a bounded list (a scalar subquery), not a cross product.

    ``universe``: one column ``item`` with every item.  Returns (a, b, sim, rank).
    """
    items = universe.select(F.col("item").cast("string").alias("a")).distinct()
    first = (items.orderBy("a").limit(2 * n)
             .agg(F.sort_array(F.collect_list("a")).alias("first")).scalar())
    pos = sim.select("a", "b", F.col("jaccard").alias("sim"))
    npos = pos.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    need = items.join(npos, "a", "left").filter(F.coalesce(F.col("m"), F.lit(0)) < n)
    fill = (need.select("a", F.explode(first).alias("b"))
            .filter(F.col("a") != F.col("b"))
            .join(pos.select("a", "b"), ["a", "b"], "left_anti")
            .withColumn("sim", F.lit(0.0)))
    allc = pos.unionByName(fill.select("a", "b", "sim"))
    w = Window.partitionBy("a").orderBy(F.col("sim").desc(), F.col("b").asc())
    # per item the candidates are its positive partners (bounded by the
    # catalog) plus at most 2n fillers
    return allc.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
