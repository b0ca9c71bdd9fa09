"""Op 13: how far the sources of a language lie apart in their terms.

Counting goes by length-bucketed packing.  A task joins the texts of a few
megabytes into one array of bytes, finds the terms in it at once and deals them
into buckets by length.  Terms of up to 8 bytes become one 64-bit word, those
of up to 16 bytes two; a bucket is radix-sorted by the 16-bit digits its
lengths can fill, and runs of equal words are counted.  The sort is stable and
texts are taken group by group, so in a run of one term the groups follow one
another and in them the documents: one pass over the runs gives occurrences and
documents per group and term.  Longer terms go to a bucket of their own, sorted
as byte strings.

Spark sums these counts, keeps the terms found in enough documents of their
language and gives every group its integer shares.  Distances between groups
are summed over blocks of terms: a block holds a matrix of shares (zero counts
included) and returns one partial sum per pair of sources, so neither pairs of
rows nor a whole language ever meet in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from partnerlens.llm.common import scratch

SCALE = 1_000_000_000
SMOOTH = 5
CHUNK_BYTES = 8 << 20   # text counted at a time
BLOCK_CELLS = 1 << 18   # shares (terms x sources) in a block
TILE = 256              # sources compared at a time
TILE_CELLS = 1 << 20
COUNTS = "lang string, source string, term string, n long, d long"
PARTIAL = "lang string, a string, b string, part_sum long"

# what a byte becomes: A-Z folded to a-z, a-z and all bytes of other scripts kept, 0 ends a term
_BYTE = np.arange(256, dtype=np.uint8)
_UPPER = (_BYTE >= 0x41) & (_BYTE <= 0x5A)
FOLD = np.where(_UPPER, _BYTE + 32, np.where((_BYTE >= 0x80) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)), _BYTE, 0)).astype(np.uint8)


def spans(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the terms, the runs of non-zero bytes."""
    inside = np.concatenate([[False], folded != 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2] - edge[::2]


def words(folded: np.ndarray, start: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """The terms as 64-bit words, first byte highest, zero beyond the end: one
    word if no term is longer than 8 bytes, else two.  ``folded`` must go on
    for 16 bytes after the last term."""
    eight = np.ndarray((len(folded) - 7,), dtype=">u8", buffer=folded, strides=(1,))
    out = []
    for first in range(0, 16 if length.max(initial=0) > 8 else 8, 8):
        over = (8 * np.clip(8 - (length - first), 0, 7)).astype(np.uint64)
        word = eight[start + first].astype(np.uint64) >> over << over
        out.append(np.where(length > first, word, np.uint64(0)))
    return out


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """Stable order of rows by several words, the first most significant: a
    radix pass per 16-bit digit that varies, lowest digit first."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        for shift in (0, 16, 32, 48):
            digit = (key >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _runs(changed: np.ndarray, group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row, rows, documents) of each run of one term in one group;
    ``changed`` marks rows whose term differs from that of the row before."""
    head = changed.copy()
    head[1:] |= group[1:] != group[:-1]
    other = head.copy()
    other[1:] |= doc[1:] != doc[:-1]
    first = np.flatnonzero(head)
    return first, np.diff(np.append(first, len(head))), np.add.reduceat(other.astype(np.int64), first)


def count_terms(texts: list[bytes], group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, occurrences, documents), one entry per term and group.
    ``group`` is the non-decreasing group number of each text."""
    folded = FOLD[np.frombuffer(b"\0".join(texts) + b"\0" * 16, dtype=np.uint8)]
    start, length = spans(folded)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    doc = np.searchsorted(ends, start, side="right")
    heads, ns, ds = [], [], []
    for top in (*range(2, 17, 2), None):
        pick = np.flatnonzero(length > 16 if top is None else (length == top) | (length == top - 1))
        if not len(pick):
            continue
        if top is None:
            raw = [folded[a:a + n].tobytes() for a, n in zip(start[pick].tolist(), length[pick].tolist())]
            order = np.array(sorted(range(len(raw)), key=raw.__getitem__), dtype=np.int64)
            changed = np.array([True, *(raw[x] != raw[y] for x, y in zip(order[1:].tolist(), order[:-1].tolist()))])
        else:
            keys = words(folded, start[pick], length[pick])
            order = radix_order(keys)
            changed = np.zeros(len(order), dtype=bool)
            changed[0] = True
            for k in keys:
                k = k[order]
                changed[1:] |= k[1:] != k[:-1]
        pick = pick[order]
        first, n, d = _runs(changed, group[doc[pick]], doc[pick])
        heads.append(pick[first])
        ns.append(n)
        ds.append(d)
    none = np.zeros(0, dtype=np.int64)
    head, n, d = (np.concatenate(x) if x else none for x in (heads, ns, ds))
    size = length[head]
    after = np.cumsum(size)
    data = folded[np.repeat(start[head] - (after - size), size) + np.arange(int(size.sum()))]
    terms = pa.Array.from_buffers(pa.large_string(), len(head), [None, pa.py_buffer(np.concatenate([[0], after]).astype(np.int64)),
                                                                pa.py_buffer(np.ascontiguousarray(data))])
    return terms, group[doc[head]], n, d


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[str, str, bytes]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal size
        held.sort(key=lambda r: r[:2])
        names = sorted({r[:2] for r in held})
        number = {g: i for i, g in enumerate(names)}
        terms, group, n, d = count_terms([r[2] for r in held], np.array([number[r[:2]] for r in held], dtype=np.int64))
        held.clear()
        size = 0
        at = pa.array(group, pa.int64())
        return pa.record_batch([pa.array([a for a, _ in names], pa.string()).take(at), pa.array([b for _, b in names], pa.string()).take(at),
                                terms.cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())],
                               names=[f.split()[0] for f in COUNTS.split(", ")])

    for batch in batches:
        columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()]
        for row in zip(*columns):
            held.append(row)
            size += len(row[2])
            if size >= CHUNK_BYTES:
                yield flush()
    if held:
        yield flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents) over (lang, source,
    text) rows without nulls."""
    return docs.select("lang", "source", "text").mapInArrow(_count, COUNTS).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), exactly."""
    wide = lambda c: c.cast("decimal(19,0)")
    up = F.lit(SCALE).cast("decimal(10,0)") * wide(count + SMOOTH)
    return F.call_function("div", up, wide(total + SMOOTH * terms)) + 1


def _distances(key, shares: pa.Table, groups: pa.Table) -> pa.Table:
    """Partial sums of |p - p'| over the terms of one block, for the pairs of
    sources of one cell (tiles ``lo`` and ``hi`` of the sources)."""
    lang, _, lo, hi = (k.as_py() for k in key)
    a_out, b_out, sums = [], [], []
    if shares.num_rows:
        rows = sorted(zip(groups.column("source").to_pylist(), groups.column("tile").to_pylist(), groups.column("zero").to_pylist()))
        names = [r[0] for r in rows]
        tile = np.array([r[1] for r in rows])
        zero = np.array([r[2] for r in rows], dtype=np.int64)
        number = {s: i for i, s in enumerate(names)}
        term = shares.column("term").combine_chunks().dictionary_encode()
        of = term.indices.to_numpy()
        col = np.array([number[s] for s in shares.column("source").to_pylist()], dtype=np.int64)
        p = shares.column("p").to_numpy()
        left = np.flatnonzero(tile == lo)
        right = np.flatnonzero(tile == hi)
        total = np.zeros((len(left), len(right)), dtype=np.int64)
        step = max(1, TILE_CELLS // len(names))
        order = np.argsort(of, kind="stable")
        of, col, p = of[order], col[order], p[order]
        for t in range(0, len(term.dictionary), step):
            a, b = np.searchsorted(of, [t, t + step])
            matrix = np.tile(zero, (min(step, len(term.dictionary) - t), 1))
            matrix[of[a:b] - t, col[a:b]] = p[a:b]
            other = matrix[:, right]
            for i, g in enumerate(left.tolist()):
                total[i] += np.abs(other - matrix[:, g:g + 1]).sum(axis=0)
        i, j = np.nonzero(left[:, None] < right[None, :])
        a_out, b_out, sums = [names[x] for x in left[i]], [names[x] for x in right[j]], total[i, j]
    return pa.table({"lang": pa.array([lang] * len(a_out), pa.string()), "a": pa.array(a_out, pa.string()),
                     "b": pa.array(b_out, pa.string()), "part_sum": pa.array(sums, pa.int64())})


def divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, lang: str = "lang", source: str = "source",
               text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank.  ``pair`` rows hold the summed
    distance between the shares of a source and of every other source of the
    language, ``term`` rows the ``top`` terms a source has more of than its
    language.  A term is kept by a language that has it in at least ``min_docs``
    rows.

    Null languages, sources and texts count as empty strings, and the empty
    string is a language or source like any other.  Rows without terms make
    their group occur; rows that repeat count each.  Texts of any length are
    counted whole.  Where a language keeps no term all its distances are 0 and
    it has no ``term`` rows.  Equal values rank by the item's UTF-8 bytes.
    Other columns of ``docs`` are not read; an empty table gives no rows."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
                         for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = scratch(term_counts(rows), "term-counts")
    kept = scratch(counts.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("n_lang"))
                   .filter(F.col("d") >= min_docs).select("lang", "term", "n_lang"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("total_lang"))
    found = scratch(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang"), "kept-counts")
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    v, total = F.coalesce(F.col("v"), F.lit(0)), F.coalesce(F.col("total"), F.lit(0))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # one row per source
    groups = scratch(rows.select("lang", "source").distinct().join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
                     .select("lang", "source", v.alias("v"), total.alias("total"), "total_lang",
                             F.floor(number / TILE).cast("int").alias("tile"),
                             F.when(v > 0, share(F.lit(0).cast("long"), total, v)).alias("zero")), "groups")
    of_lang = groups.groupBy("lang").agg(F.max("v").alias("v"), F.count(F.lit(1)).alias("s"))
    plan = of_lang.filter("v > 0").select("lang", F.ceil(F.col("v") * F.col("s") / BLOCK_CELLS).cast("int").alias("blocks"),
                                          (F.floor((F.col("s") - 1) / TILE) + 1).cast("int").alias("tiles"))
    shares = found.join(groups.select("lang", "source", "v", "total", "total_lang", "tile"), ["lang", "source"]).select(
        "lang", "source", "term", "tile", share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
        share(F.col("n_lang"), F.col("total_lang"), F.col("v")).alias("q"))

    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    cell = [F.least("tile", "__t").alias("lo"), F.greatest("tile", "__t").alias("hi")]
    left = (shares.join(plan, "lang").withColumn("__t", other)
            .select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), *cell, "source", "term", "p"))
    right = (groups.join(plan, "lang").withColumn("__t", other).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("lang", "block", *cell, "source", "tile", "zero"))
    keys = ["lang", "block", "lo", "hi"]
    sums = (left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_distances, PARTIAL)
            .groupBy("lang", "a", "b").agg(F.sum("part_sum").alias("value")))
    both = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    mates = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    pairs = (mates.join(both, ["lang", "source", "item"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")))
    terms = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                          (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= top))


# the same result in DuckDB SQL
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n_lang FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n_lang) AS total_lang FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(totals.total, 0) + 5 * langs.v) AS p,
             1 + (1000000000::HUGEINT * (kept.n_lang + 5)) // (langs.total_lang + 5 * langs.v) AS q
      FROM g JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN totals ON totals.lang = g.lang AND totals.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""
