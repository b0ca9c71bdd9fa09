"""Op 11: n-gram Jaccard join with token-combination prefixes.

The tokens of a document are its distinct word shingles (64-bit hashes).  All
tokens have one global order: by the number of distinct sets that hold them,
then by hash.  A set x of n tokens that links with anything misses at most
e = n - ceil(percent * n / 100) of its tokens there.  Its prefix is its first
tokens in that order, extended until more than e of them would have to be
missing for no signature to be shared:

* a rare token (class 1) is a signature by itself;
* frequent tokens (class k = 2 or 3, by frequency) are dealt into groups by
  hash, and every combination of k tokens of one group is a signature, so a
  group of m prefix tokens forces m - k + 1 misses.

Of two linked sets the one whose prefix ends first has k shared tokens in some
group, and the other one's prefix holds them too; so linked sets always share
a signature.  Tokens found in one set only need no signature: they are certain
misses, and a set with more than e of them links with nothing.  The number of
groups goes with the power of two below the set's size, small enough that the
whole set always holds a full prefix; a set close below the next power of two
is signed for both.

Equal sets are one node.  Sets that share signatures are verified on their
whole token sets.  First every node is held against its neighbour under each of
its signatures, in an order that changes from round to round, and linked nodes
are contracted; then all pairs of different components that still share a
signature are verified.  A group of near copies thus costs a few comparisons
per member.  Where many sets share a signature without linking, blocks of them
meet in cells that verify all their pairs as one matrix product; no candidate
is left out and no crowded group becomes rows of pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from partnerlens.llm.common import block_count, block_of, lookup, scratch, shuffle_parts
from partnerlens.llm.simhash import _forest, components
from partnerlens.llm.words import MULTIPLIERS, Vocab, window_hash, word_hashes, word_ids

BLOCK_BYTES = 6 << 20
RARE = 16       # up to so many sets a token is a signature by itself
FREQUENT = 1024  # up to so many it is signed in pairs, beyond in threes
GROUPS = 8      # a group of frequent tokens per so many tokens of the set's level
CROWDED = 16    # a signature of more nodes is settled by cells, not by rows of pairs
CELL_SETS = 256  # sets in a block of a cluster; two blocks meet in a cell
COLUMNS = 4096  # tokens counted at a time in a cell
SMALL = 8       # sets of levels below this size are signed by single tokens only

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit words."""
    with np.errstate(over="ignore"):
        for m in _MIX:
            x = (x ^ (x >> np.uint64(33))) * m
        return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: k consecutive words, A-Z in
    lower case; with fewer words the whole sequence; without words none."""
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    vocab = Vocab()
    ids = [word_ids(w, vocab) for w in words]
    h = word_hashes(vocab)[0]
    out = []
    for i in ids:
        n = min(k, len(i))
        # sequences of other lengths are other shingles
        out.append(np.unique(mix(window_hash(h[i], n, MULTIPLIERS[0]) + np.uint64(n))) if n else np.zeros(0, np.uint64))
    return out


def digest(tokens: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(tokens.tobytes())


def misses(n, percent: int):
    """Most tokens of a set of n that a linked set may lack."""
    return n - -(-percent * n // 100)


def levels(n: int, percent: int) -> list[int]:
    """Powers of two under which a set of n tokens is signed: its own and, if a
    linked set may reach it, the next."""
    own = n.bit_length() - 1
    return [own, own + 1] if 100 * n // percent >= 2 << own else [own]


def token_class(freq: np.ndarray, level: int) -> np.ndarray:
    if 1 << level < SMALL:
        return np.ones(len(freq), dtype=np.int64)
    return 1 + (freq > RARE) + (freq > FREQUENT).astype(np.int64)


def prefix_signatures(tokens: np.ndarray, freq: np.ndarray, n: int, level: int, percent: int) -> np.ndarray:
    """Signatures of a set at a level.  ``tokens`` and ``freq`` are its
    recurring tokens; the other n - len(tokens) occur in no other set."""
    need = misses(n, percent) + 1 - (n - len(tokens))
    if need <= 0:
        return np.zeros(0, dtype=np.uint64)
    order = np.lexsort((tokens, freq))
    t, k = tokens[order], token_class(freq[order], level)
    groups = np.uint64(max(1, (1 << level) // GROUPS))
    group = ((mix(t + np.uint64(level)) >> np.uint64(32)) * groups >> np.uint64(32)).astype(np.int64) * 4 + k
    # place of every token among those of its group, in prefix order
    by = np.argsort(group, kind="stable")
    head = np.flatnonzero(np.diff(group[by], prepend=-1))
    place = np.empty(len(t), dtype=np.int64)
    place[by] = np.arange(len(t)) - np.repeat(head, np.diff(np.append(head, len(t))))
    forced = np.cumsum((k == 1) | (place >= k - 1))
    end = int(np.searchsorted(forced, need)) + 1
    by = by[by < end]
    out = [t[:end][k[:end] == 1]]
    for size in (2, 3):
        at = by[k[by] == size]
        out.append(combinations(t[at], group[at], size, level))
    return np.unique(np.concatenate(out))


def combinations(t: np.ndarray, group: np.ndarray, size: int, level: int) -> np.ndarray:
    """Hash of every combination of ``size`` tokens inside a group (rows sorted
    by group), whatever their order."""
    start = mix(t + np.uint64(level * 8 + size))
    held, last = start, np.arange(len(t))
    with np.errstate(over="ignore"):
        for _ in range(size - 1):
            hashes, at, step = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 1
            while True:
                ok = np.flatnonzero(last + step < len(t))
                ok = ok[group[last[ok] + step] == group[last[ok]]]
                if not len(ok):
                    break
                hashes.append(held[ok] + start[last[ok] + step])
                at.append(last[ok] + step)
                step += 1
            held, last = np.concatenate(hashes), np.concatenate(at)
    return mix(held)


def _slices(texts, piece: int = 256) -> Iterator[list[str | None]]:
    """A column of texts a few rows at a time."""
    for a in range(0, len(texts), piece):
        yield texts.slice(a, piece).to_pylist()


def _members(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [(len(s), digest(s)) for part in _slices(b.column(2)) for s in shingle_sets(part, k)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([n for n, _ in sets], pa.int64()),
                                   pa.array([d for _, d in sets], pa.string())], names=["block", "doc_id", "n", "digest"])
    return run


def _own_sets(key, rows: pa.Table, reps: list[str], k: int) -> list[tuple[int, str, np.ndarray]]:
    """(node, digest, tokens) of the sets this block stands for."""
    want = {d: (key[0].as_py() << 32) + i for i, d in enumerate(sorted(reps))}
    out = []
    for part in _slices(rows.column("text")):
        for s in shingle_sets(part, k):
            if len(s) and (node := want.pop(d := digest(s), None)) is not None:
                out.append((node, d, s))
    return out


TOKENS = "bucket int, block int, tokens binary, counts binary"


def _tokens(k: int, buckets: int):
    """Tokens of a block with the number of its sets that hold them, cut by
    ranges of the hash."""
    def run(key, rows: pa.Table, reps: pa.Table) -> pa.Table:
        cols: list[list] = [[], [], [], []]
        if rows.num_rows and reps.num_rows:
            sets = _own_sets(key, rows, reps.column("digest").to_pylist(), k)
            t, n = np.unique(np.concatenate([s for _, _, s in sets]), return_counts=True)
            bucket = ((t >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            head = np.flatnonzero(np.diff(bucket, prepend=-1))
            for a, b in zip(head.tolist(), [*head[1:].tolist(), len(t)]):
                many = (n[a:b] > 1).any()
                cols[0].append(int(bucket[a]))
                cols[1].append(key[0].as_py())
                cols[2].append(t[a:b].tobytes())
                cols[3].append(n[a:b].astype(np.uint32).tobytes() if many else None)
        return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()),
                         pa.array(cols[3], pa.binary())], names=["bucket", "block", "tokens", "counts"])
    return run


NOTES = "block int, digest string, tokens binary, freq binary"


def _recurring(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
    """Tokens of a range that two sets or more hold, back to their blocks."""
    t = [np.frombuffer(x, np.uint64) for x in parts.column("tokens").to_pylist()]
    n = [np.ones(len(x), np.int64) if c is None else np.frombuffer(c, np.uint32).astype(np.int64)
         for x, c in zip(t, parts.column("counts").to_pylist())]
    of = np.repeat(np.arange(len(t)), [len(x) for x in t])
    every = np.concatenate(t)
    _, which, = np.unique(every, return_inverse=True)
    freq = np.bincount(which, weights=np.concatenate(n)).astype(np.int64)[which]
    keep = np.flatnonzero(freq > 1)
    cut = np.searchsorted(of[keep], np.arange(len(t) + 1)).tolist()
    blocks, tokens, freqs = [], [], []
    for i, block in enumerate(parts.column("block").to_pylist()):
        at = keep[cut[i]:cut[i + 1]]
        if len(at):
            blocks.append(block)
            tokens.append(every[at].tobytes())
            freqs.append(np.minimum(freq[at], np.iinfo(np.uint32).max).astype(np.uint32).tobytes())
    return pa.table([pa.array(blocks, pa.int32()), pa.nulls(len(blocks), pa.string()), pa.array(tokens, pa.binary()),
                     pa.array(freqs, pa.binary())], names=["block", "digest", "tokens", "freq"])


SIGNED = "node long, n int, sig long, digest string, tokens binary"


def _sign(k: int, percent: int):
    """Signatures of the sets that may link (one row each), and those sets."""
    def run(key, rows: pa.Table, notes: pa.Table) -> pa.Table:
        tables = []
        reps = notes.column("digest").drop_null().to_pylist()
        if rows.num_rows and reps:
            known = [np.frombuffer(x, np.uint64) for x in notes.column("tokens").drop_null().to_pylist()]
            freqs = [np.frombuffer(x, np.uint32) for x in notes.column("freq").drop_null().to_pylist()]
            t = np.concatenate([*known, np.zeros(0, np.uint64)])
            f = np.concatenate([*freqs, np.zeros(0, np.uint32)])
            order = np.argsort(t)
            t, f = t[order], f[order].astype(np.int64)
            for node, d, s in _own_sets(key, rows, reps, k) if len(t) else []:
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                again = t[at] == s
                n = len(s)
                if n - int(again.sum()) > misses(n, percent):
                    continue
                sig = np.unique(np.concatenate([prefix_signatures(s[again], f[at[again]], n, level, percent)
                                                for level in levels(n, percent)]))
                m = len(sig)
                tables.append(pa.table([pa.array(np.full(m + 1, node), pa.int64()), pa.array(np.full(m + 1, n), pa.int32()),
                                        pa.array([*sig.view(np.int64).tolist(), None], pa.int64()),
                                        pa.array([None] * m + [d], pa.string()), pa.array([None] * m + [s.tobytes()], pa.binary())],
                                       names=["node", "n", "sig", "digest", "tokens"]))
        empty = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("sig", pa.int64()), ("digest", pa.string()), ("tokens", pa.binary())])
        return pa.concat_tables([empty.empty_table(), *tables])
    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            hit = pa.array(ok, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(hit), batch.column(1).filter(hit)], names=["a", "b"])
    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets link."""
    one = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    return scratch(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long"), "links")


def _labelled(sigs: DataFrame, edges: DataFrame) -> DataFrame:
    """Signature rows with the component of their node, only those whose
    signature still occurs in two components."""
    roots = components(edges).select(F.col("node").alias("__node"), "root")
    rows = (sigs.select("sig", "node", "n").join(roots, F.col("node") == F.col("__node"), "left")
            .select("sig", "node", "n", F.coalesce("root", "node").alias("comp")))
    split = rows.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("top")).filter("low < top").select("sig")
    return scratch(rows.join(split, "sig"), "signatures")


def _cell(percent: int):
    """All links among the sets of one cell (two blocks of a cluster), as a
    spanning forest: intersections are products of 0/1 matrices, a range of
    tokens at a time, so pairs never become rows."""
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        node = rows.column("node").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("tokens").to_pylist()]
        size = np.array([len(x) for x in sets], dtype=np.int64)
        of = np.repeat(np.arange(len(sets)), size)
        _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = np.cumsum(times > 1) - 1  # tokens of one set only count for nothing
        shared = times[token] > 1
        of, at = of[shared], column[token[shared]]
        order = np.argsort(at, kind="stable")
        of, at = of[order], at[order]
        both = np.zeros((len(sets), len(sets)), dtype=np.int64)
        for low in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
            x, y = np.searchsorted(at, [low, low + COLUMNS])
            m = np.zeros((len(sets), COLUMNS), dtype=np.float32)
            m[of[x:y], at[x:y] - low] = 1.0
            both += (m @ m.T).astype(np.int64)
        linked = np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1)
        links = _forest(node, *np.nonzero(linked))
        return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])
    return run


def _dense_links(sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the nodes of crowded signatures.  Nodes that such signatures
    connect are a cluster; it is cut into blocks, and every two blocks of a
    cluster meet in a cell, where all pairs are verified at once."""
    stars = sigs.groupBy("sig").agg(F.min("node").alias("a")).join(sigs.select("sig", F.col("node").alias("b")), "sig").filter("a < b")
    clusters = components(stars.select("a", "b").distinct())
    sizes = clusters.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / CELL_SETS).cast("int").alias("blocks"))
    placed = clusters.join(sizes, "root").withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"), "node")
    return scratch(cells.join(sets, "node").groupBy("root", "i", "j").applyInArrow(_cell(percent), "a long, b long"), "links")


def jaccard_links(signed: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning set of the links between the signed sets.

    Rounds verify, under every signature, each node with the next one in a
    hash order that changes with the round, if their components differ: no more
    pairs than signature rows.  They go on while they contract a twentieth of
    the nodes that are left.  Then all pairs of different components that share
    a signature are verified: those of signatures with up to ``CROWDED`` nodes
    as rows, those of crowded ones by cells."""
    sets = signed.filter("sig is null").select("node", "tokens")
    sigs = signed.filter("sig is not null").select("sig", "node", "n")
    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    edges = scratch(sets.sparkSession.createDataFrame([], "a long, b long"), "links")

    def found(pairs: DataFrame) -> DataFrame:
        ordered = pairs.filter(fits & (F.col("comp") != F.col("comp2"))).select(
            F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))
        return _linked(ordered.distinct(), sets, percent)

    turn, going = 0, True
    while going:
        sigs = _labelled(sigs, edges)
        after = Window.partitionBy("sig").orderBy(F.xxhash64("node", F.lit(turn)), "node")
        more = found(sigs.withColumns({"node2": F.lead("node").over(after), "m": F.lead("n").over(after),
                                       "comp2": F.lead("comp").over(after)}).filter("node2 is not null"))
        edges = scratch(edges.unionByName(more), "links")
        going = 20 * more.count() > sigs.select("comp").distinct().count()
        turn += 1
    sigs = _labelled(sigs, edges)
    crowd = sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > CROWDED).select("sig")
    few = sigs.join(crowd, "sig", "left_anti")
    second = few.select("sig", F.col("node").alias("node2"), F.col("n").alias("m"), F.col("comp").alias("comp2"))
    return (edges.unionByName(found(few.join(second, "sig").filter("comp < comp2")))
            .unionByName(_dense_links(sigs.join(crowd, "sig", "left_semi"), sets, percent)))


def jaccard_groups(docs: DataFrame, shingle: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles (distinct shingles), component_id
    (smallest doc_id reachable over links) and n_same (rows with the same set).
    Two documents link when 100 * intersection >= percent * union of their
    shingle sets.

    Null, empty and white texts have no shingles and link with nothing, not
    even with each other.  Texts of fewer words than a shingle have their whole
    sequence as one.  Texts of any length are taken whole.  Every row is a
    document by itself: rows that repeat an id link by their texts only.  A null
    id reaches others but is nobody's component (groups without ids have the
    component null).  Other columns are not read; an empty table gives no rows."""
    n = block_count(docs, text, BLOCK_BYTES)
    parts = shuffle_parts(docs.sparkSession)
    rows = docs.select(block_of(n, F.col(key), F.col(text)).alias("block"), F.col(key).cast("long").alias("doc_id"),
                       F.col(text).alias("text"))
    members = scratch(rows.mapInArrow(_members(shingle), "block int, doc_id long, n long, digest string"), "members")
    classes = scratch(members.filter("n > 0").groupBy("digest").agg(
        F.min("block").alias("block"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n_same")), "classes")
    reps = classes.select("block", "digest")
    # the one shuffle of the texts, read by both passes
    blocks = rows.select("block", "text").repartition(n, "block").groupBy("block")
    tokens = blocks.cogroup(reps.groupBy("block")).applyInArrow(_tokens(shingle, max(n, parts)), TOKENS)
    notes = tokens.groupBy("bucket").applyInArrow(_recurring, NOTES).unionByName(
        reps.select("block", "digest", F.lit(None).cast("binary").alias("tokens"), F.lit(None).cast("binary").alias("freq")))
    signed = scratch(blocks.cogroup(notes.groupBy("block")).applyInArrow(_sign(shingle, percent), SIGNED), "signed")
    roots = components(jaccard_links(signed, percent)).select(F.col("node").alias("__node"), "root")
    nodes = (signed.filter("sig is null").select("digest", "node").join(roots, F.col("node") == F.col("__node"))
             .select("digest", F.col("root").cast("string").alias("root")))
    rooted = scratch(classes.join(nodes, "digest", "left")
                     .select("digest", F.coalesce("root", "digest").alias("root"), "low", "n_same"), "rooted")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("__n"))
    of_class = lookup(rooted, lows, "root", "__n", rooted.count()).select(
        "digest", "component_id", "n_same", F.col("n_same").alias("__n"))
    found = lookup(members, of_class, "digest", "__n", members.count())
    alone = F.col("n") == 0
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                        F.when(alone, F.lit(1)).otherwise(F.col("n_same")).cast("long").alias("n_same"))


# the same result in DuckDB SQL (components by label propagation over the links of distinct sets)
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS sh FROM d),
c AS MATERIALIZED (SELECT min(doc_id) AS id, len(sh) AS n, sh FROM s WHERE len(sh) > 0 GROUP BY sh),
t AS MATERIALIZED (SELECT id, n, unnest(sh) AS x FROM c),
u AS MATERIALIZED (SELECT * FROM t WHERE x IN (SELECT x FROM t GROUP BY x HAVING count(*) > 1)),
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.x = b.x AND a.id < b.id
      AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
      GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
way AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT id AS a, id AS b FROM c UNION SELECT reach.a, way.b FROM reach JOIN way ON reach.b = way.a),
comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(comp.component_id, s.doc_id) AS component_id,
       CAST(CASE WHEN len(s.sh) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY s.sh) END AS BIGINT) AS n_same
FROM s LEFT JOIN c ON c.sh = s.sh LEFT JOIN comp ON comp.id = c.id
"""
