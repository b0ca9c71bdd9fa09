"""Op 4: SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are sorted by their rank in the reflected Gray code, in which
neighbours share most bits, and cut into leaves of consecutive fingerprints.
A node keeps the bits all its fingerprints agree on (mask and value); the
distance of anything to a node is at least the number of differences on those
bits, so a node that already has more than the allowed ones is left out with
all below it.

At the top the index has one order per segment: with at most d differing bits
out of 64, one of d + 1 segments agrees wholly, so in the order that puts this
segment first both fingerprints lie under the same top node (no difference so
far).  Each fingerprint is therefore stored d + 1 times and compared only
below its own top nodes; nothing is sent to all shards.  Large top nodes are
range-partitioned like all else and become many leaves, whose pairs are pruned
by their masks before any fingerprint is compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from partnerlens.llm.common import lookup, scratch, shuffle_parts

SEED = 42
LEAF = 256
UPPER = 32  # leaves under an upper node
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash: a bit is 1 if set in over half of the XXH64 (seed 42)
    of the word shingles, repeats included; A-Z are lower-cased.  With fewer
    words than a shingle the whole sequence counts; without words it is 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    length = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(length + 1) - 1
    starts = ends - length
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[:n - shingle + 1].tolist(), ends[shingle - 1:].tolist())],
                 dtype="<u8")
    octets = h.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(h)).tolist()))


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
    return run


def with_fingerprints(df: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """``df`` with the column fp."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(text).to_pylist()], dtype=np.uint64)
            yield pa.record_batch([*b.columns, pa.array(fp.view(np.int64))], names=[*b.schema.names, "fp"])
    return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*df.dtypes, ("fp", "long")]))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of 64-bit words in the reflected Gray code."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of distance + 1 segments of the 64 bits."""
    cut = [64 * i // (distance + 1) for i in range(distance + 2)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def _orders(distance: int):
    """Each fingerprint once per order: top node (order, segment) and the Gray
    rank of the fingerprint rotated so that the segment comes first."""
    segs = segments(distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(1).to_numpy().view(np.uint64)
            for i, (first, width) in enumerate(segs):
                up, down = np.uint64(64 - first - width), np.uint64((first + width) % 64)
                turned = (fp << up) | (fp >> down if down else np.uint64(0) * fp)
                node = (turned >> np.uint64(64 - width)).astype(np.int64) * len(segs) + i
                rank = (gray_rank(turned) ^ np.uint64(1 << 63)).view(np.int64)  # signed, same order
                yield pa.record_batch([pa.array(node), pa.array(rank), b.column(0), b.column(1)],
                                      names=["node", "rank", "rep", "fp"])
    return run


def _forest(rep: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links (index pairs) as stars: (smallest representative, other), one per
    fingerprint that has any link here."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            x, y = (x, y) if rep[x] <= rep[y] else (y, x)
            root[y] = x
    return [(int(rep[find(x)]), int(rep[x])) for x in root if find(x) != x]


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _within(node: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one leaf run: rows of one node, at most ``distance`` apart."""
    left, right, step = [], [], 1
    at = np.arange(len(fp) - 1)
    while len(at := at[node[at] == node[at + step]] if len(at) else at):
        hit = at[_bits(fp[at] ^ fp[at + step]) <= distance]
        left.append(hit)
        right.append(hit + step)
        step += 1
        at = at[at + step < len(fp)]
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


LEAVES = "kind int, a long, b long, node long, leaf long, mask long, value long, reps binary, fps binary"


def _leaves(distance: int):
    """Sorted rows -> links inside leaves (kind 0) and, for top nodes that may
    have more leaves than one, the leaves themselves (kind 1)."""
    def links(rep, pairs) -> pa.RecordBatch:
        e = _forest(rep, *pairs)
        n = len(e)
        none = pa.nulls
        return pa.record_batch([pa.array([0] * n, pa.int32()), pa.array([x for x, _ in e], pa.int64()),
                                pa.array([y for _, y in e], pa.int64()), *[none(n, pa.int64())] * 4,
                                none(n, pa.binary()), none(n, pa.binary())],
                               names=[f.split()[0] for f in LEAVES.split(", ")])

    def leaves(node, rank, rep, fp, cuts, whole) -> pa.RecordBatch:
        rows = []
        for (a, b), alone in zip(cuts, whole):
            if alone:
                continue
            same = np.bitwise_and.reduce(~(fp[a:b] ^ fp[a]))
            rows.append((1, None, None, int(node[a]), int(rank[a]), int(same.view(np.int64)),
                         int((fp[a] & same).view(np.int64)), rep[a:b].tobytes(), fp[a:b].tobytes()))
        cols = list(zip(*rows)) or [()] * 9
        kinds = [pa.int32(), *[pa.int64()] * 6, pa.binary(), pa.binary()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)],
                               names=[f.split()[0] for f in LEAVES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True
        more = iter(batches)
        batch = next(more, None)
        while batch is not None:
            after = next(more, None)
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            node, rank, rep, fp = cols[0], cols[1], cols[2], cols[3].view(np.uint64)
            change = np.flatnonzero(np.diff(node)) + 1
            end = len(node)
            if after is not None:  # the last node may go on in the next batch
                last = int(change[-1]) if len(change) else 0
                end = last + (len(node) - last) // LEAF * LEAF
            bounds = np.concatenate([[0], change[change < end], [end]]).tolist()
            cuts, whole = [], []
            for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                # at the ends of the task, or where a node is cut, other leaves of the node may exist
                edge = (i == 0 and first) or b == len(node) or (i == 0 and held is not None) or b == end
                pieces = [(x, min(x + LEAF, b)) for x in range(a, b, LEAF)]
                cuts += pieces
                whole += [len(pieces) == 1 and not edge] * len(pieces)
            if end:
                run_id = np.repeat(np.arange(len(cuts)), [b - a for a, b in cuts])
                found = links(rep[:end], _within(run_id, fp[:end], distance))
                if found.num_rows:
                    yield found
                yield leaves(node, rank, rep, fp, cuts, whole)
                first = False
            held = [node[end:], rank[end:], rep[end:], fp[end:].view(np.int64)] if end < len(node) else None
            batch = after
    return run


def _across(distance: int):
    """Pairs of leaves -> links between them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                fa, fb = (np.frombuffer(r[x], np.uint64) for x in ("fps", "fps2"))
                ra, rb = (np.frombuffer(r[x], np.int64) for x in ("reps", "reps2"))
                i, j = np.nonzero(_bits(fa[:, None] ^ fb[None, :]) <= distance)
                out += _forest(np.concatenate([ra, rb]), i, j + len(fa))
            yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())],
                                  names=["a", "b"])
    return run


def links(reps: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b) with a < b over representatives: a spanning set of the links
    between fingerprints at most ``distance`` bits apart.  ``reps`` has one row
    (rep, fp) per distinct fingerprint."""
    spark = reps.sparkSession
    parts = shuffle_parts(spark)
    ordered = (scratch(reps.select("rep", "fp").mapInArrow(_orders(distance), "node long, rank long, rep long, fp long"), "orders")
               .repartitionByRange(parts, "node", "rank").sortWithinPartitions("node", "rank"))
    made = scratch(ordered.mapInArrow(_leaves(distance), LEAVES), "leaves")
    leaf = made.filter("kind = 1").select("node", "leaf", "mask", "value", "reps", "fps")
    # only top nodes of several leaves go on; UPPER leaves form an upper node with the bits they all share
    many = leaf.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node")
    place = F.row_number().over(Window.partitionBy("node").orderBy("leaf")) - 1
    numbered = scratch(leaf.select("node", "leaf", "mask", "value").join(many, "node", "left_semi")
                       .withColumn("upper", F.floor(place / UPPER)), "numbered")
    ones, zeros = F.col("value"), F.col("mask").bitwiseAND(F.bitwise_not("value"))
    upper = numbered.groupBy("node", "upper").agg(F.bit_and(ones).alias("ones"), F.bit_and(zeros).alias("zeros")).select(
        "node", "upper", F.col("ones").bitwiseOR(F.col("zeros")).alias("mask"), F.col("ones").alias("value"))

    def second(df: DataFrame) -> DataFrame:
        return df.select("node", *[F.col(c).alias(f"{c}2") for c in df.columns if c != "node"])

    near = F.bit_count(F.col("value").bitwiseXOR(F.col("value2")).bitwiseAND(F.col("mask"))
                       .bitwiseAND(F.col("mask2"))) <= distance
    tops = upper.join(second(upper), "node").filter((F.col("upper") <= F.col("upper2")) & near)
    pairs = (tops.select("node", "upper", "upper2").join(numbered, ["node", "upper"])
             .join(second(numbered), ["node", "upper2"])
             .filter((F.col("leaf") < F.col("leaf2")) & near).select("node", "leaf", "leaf2"))
    body = leaf.select("node", "leaf", "reps", "fps")
    across = pairs.join(body, ["node", "leaf"]).join(second(body), ["node", "leaf2"])
    found = (across.select("reps", "fps", "reps2", "fps2").repartition(parts)
             .mapInArrow(_across(distance), "a long, b long"))
    return made.filter("kind = 0").select("a", "b").unionByName(found).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node
    reachable.  Each round hooks every node to its smallest neighbour, follows
    the pointers to their ends and contracts the links; rounds and pointer
    steps grow with the logarithm of the longest chain."""
    edges = scratch(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = scratch(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
                    .withColumn("root", F.col("node")), "labels")
    while not edges.isEmpty():
        parent = scratch(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "parents")
        while True:
            up = parent.select(F.col("node").alias("mid"), F.col("up").alias("top"))
            moved = scratch(parent.join(up, F.col("up") == F.col("mid"), "left")
                            .select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("went")), "jumps")
            parent = moved.select("node", "up")
            if moved.filter("went").isEmpty():
                break
        one = parent.select(F.col("node").alias("__n"), F.col("up").alias("__u"))
        label = scratch(label.join(one, F.col("root") == F.col("__n"), "left")
                        .select("node", F.coalesce("__u", "root").alias("root")), "labels")
        left = edges.join(one, F.col("a") == F.col("__n"), "left").select(F.coalesce("__u", "a").alias("a"), "b")
        both = left.join(one, F.col("b") == F.col("__n"), "left").select("a", F.coalesce("__u", "b").alias("b"))
        edges = scratch(both.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return label


def simhash_groups(docs: DataFrame, shingle: int = 3, distance: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id
    (smallest doc_id reachable over links of at most ``distance`` bits) and
    n_same (rows with that fingerprint).  Null and empty texts have the
    fingerprint zero and link like any other.  Rows that repeat an id are one
    document for the links; a null id reaches others but is nobody's
    component (all-null groups have the component null).  An empty table gives
    no rows."""
    out = grouped(docs, shingle, distance, key, text)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same")


def grouped(docs: DataFrame, shingle: int = 3, distance: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """simhash_groups with the fingerprint as a number, fp, and the smallest
    such number of the group, root.  Fingerprints are the nodes of the links,
    so that those without an id link like any other."""
    total_fps = scratch(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
                        .mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "fingerprints")
    classes = scratch(total_fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n_same")), "classes")
    n_classes = classes.count()
    # fingerprints whose smallest id is the same
    named = classes.filter("low is not null").select("low", "fp")
    several = named.groupBy("low").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    repeated = lookup(named, several, "low", "__n", n_classes).filter("a < fp").select("a", F.col("fp").alias("b"))
    rooted = scratch(_rooted(classes, distance, repeated), "rooted")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("__n"))
    of_class = (lookup(rooted, lows, "root", "__n", n_classes)
                .select("fp", "root", "component_id", "n_same", F.col("n_same").alias("__n")))
    return lookup(total_fps, of_class, "fp", "__n", total_fps.count())


def _rooted(classes: DataFrame, distance: int, more: DataFrame | None = None) -> DataFrame:
    """``classes`` (one row per fingerprint, fp) with the smallest fingerprint
    reachable, root, over links of at most ``distance`` bits and the ``more``
    links (a, b)."""
    near = links(classes.select(F.col("fp").alias("rep"), "fp"), distance)
    roots = components(near if more is None else near.unionByName(more)).select(F.col("node").alias("__node"), "root")
    return (classes.join(roots, F.col("fp") == F.col("__node"), "left").drop("__node")
            .withColumn("root", F.coalesce("root", "fp")))


def one_per_group(docs: DataFrame, shingle: int = 3, distance: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs``, with its columns, of every group of fingerprints
    within ``distance`` bits: that of the smallest id (rows of one id by a
    hash of the text), or of the least text where no row has an id.

    Every row is judged by its own text: rows that repeat an id stay or go one
    by one, and of rows equal in id and text one stays.  Null and empty texts
    share a fingerprint and hence a group.  An empty table gives no rows."""
    rows = scratch(with_fingerprints(docs, text, shingle).withColumn("__row", F.monotonically_increasing_id()), "rows")
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.when(F.col(key).isNull(), F.col(text)).alias("text"),
                     F.xxhash64(text).alias("hash"), F.col("__row").alias("row"))
    classes = scratch(rows.groupBy("fp").agg(F.min(order).alias("first")), "classes")
    chosen = _rooted(classes, distance).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("__row"))
    return rows.join(chosen, "__row", "left_semi").select(*[f"`{c}`" for c in docs.columns])
