"""Op 3: removal of repeated passages with repeated-phrase automata.

A passage of ``window`` words that starts earlier elsewhere (in a smaller
doc_id, or before in the same document) is removed.

1. Documents are dealt into blocks by a hash of id and text.  In each block every
   run of words yields anchors: the phrases of ANCHOR words whose hash is the
   least among the ``window - ANCHOR + 1`` phrases of a window.  Equal windows
   have equal anchors, so only anchors that recur matter, and per block each
   distinct anchor is one row, however often it occurs there.
2. Anchors that occur twice anywhere go back to the blocks they came from.
   There they confirm the recurring phrases, which are compiled into the
   block's Aho-Corasick automaton; all documents of the block are streamed
   through it and every occurrence marks the windows around it.  An automaton
   holds phrases of its own block only, so neither its size nor the number of
   passes grows with the corpus.
3. The marked windows meet by a 128-bit hash of their words; the earliest
   place wins.  A block sends one row per distinct window; the later places in
   the block are settled there.  Places go back to the blocks, which cut the
   words out.

A group of copies thus costs a row per block and window, never one per copy
and never pairs.  Later exact copies of a whole text are found before all this
(by their hash) and take no part in it."""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window, functions as F

from partnerlens.llm.common import block_count, block_of, lookup, scratch
from partnerlens.llm.words import (MULTIPLIERS, Vocab, sliding, spread, window_hash, word_hashes, word_ids)

ANCHOR = 8
BLOCK_BYTES = 8 << 20
NO_ID = np.iinfo(np.int64).max  # a null id counts as the largest


class Block:
    """The documents of one block, in the order of (id, text), as one sequence
    of word ids; a separator that is no word ends every document."""

    def __init__(self, docs: pa.Table, copies: set[str]):
        ids = [NO_ID if x is None else x for x in docs.column("__id").to_pylist()]
        texts = [(x or "").encode("utf-8", "surrogatepass") for x in docs.column("__text").to_pylist()]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.doc = np.array([ids[i] for i in self.order], dtype=np.int64)
        self.words = [texts[i].split() for i in self.order]
        marked = {int(c.partition(":")[0]) for c in copies}  # an id may have other texts too: the digest decides
        self.copy = np.array([ids[i] in marked and copy_mark(ids[i], texts[i]) in copies for i in self.order], dtype=bool)
        self.vocab = Vocab()
        parts = []
        end = np.array([-1], dtype=np.int32)
        for w, skip in zip(self.words, self.copy.tolist()):
            parts += [word_ids(w, self.vocab) if not skip else np.zeros(0, np.int32), end]
        self.seq = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.sizes = np.array([0 if s else len(w) for w, s in zip(self.words, self.copy.tolist())], dtype=np.int64)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        h1, h2 = word_hashes(self.vocab)
        tail = np.array([0x5851F42D4C957F2D], dtype=np.uint64)
        self.h1, self.h2 = (np.concatenate([h, tail])[self.seq] for h in (h1, h2))

    def inside(self, k: int) -> np.ndarray:
        """Which starts have k words before their document ends."""
        n = len(self.seq) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=bool)
        broken = np.concatenate([[0], np.cumsum(self.seq < 0)])
        return broken[k:] == broken[:n]

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of the anchors."""
        h = window_hash(self.h1, ANCHOR, MULTIPLIERS[0])
        wide = window - ANCHOR + 1
        if len(h) < wide:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        low = sliding(h, wide, np.minimum)  # least phrase hash of each window
        low = np.where(self.inside(window), low, 0)  # windows must lie in one document
        top = np.zeros(wide - 1, dtype=np.uint64)
        at = np.flatnonzero(sliding(np.concatenate([top, low, top]), wide, np.maximum) == h)
        at = at[self.inside(ANCHOR)[at]]
        return at, h[at]

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ordinal of the document, start in it) of positions in the sequence."""
        d = np.searchsorted(self.starts, at, side="right") - 1
        return d, at - self.starts[d]


def copy_mark(doc: int, text: bytes) -> str:
    """Mark of a later copy, as later_copies makes it."""
    return f"{doc}:{hashlib.md5(text).hexdigest()}"


def _copies(table: pa.Table) -> set[str]:
    return set(table.column("__copy").drop_null().to_pylist())


def _find_anchors(window: int):
    def run(key, docs: pa.Table, copies: pa.Table) -> pa.Table:
        b = Block(docs, _copies(copies)) if docs.num_rows else None
        h, n = np.unique(b.anchors(window)[1], return_counts=True) if b else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        # a copy's mark travels with the anchors: the block needs it again
        marks = copies.column("__copy").to_pylist()
        return pa.table({"__block": pa.array([key[0].as_py()] * (len(h) + len(marks)), pa.int32()),
                         "__hash": pa.concat_arrays([pa.array(h.view(np.int64)), pa.nulls(len(marks), pa.int64())]),
                         "__n": pa.concat_arrays([pa.array(n, pa.int64()), pa.array([2] * len(marks), pa.int64())]),
                         "__copy": pa.concat_arrays([pa.nulls(len(h), pa.string()), pa.array(marks, pa.string())])})
    return run


def _letters(ids: np.ndarray, width: int, bits: int) -> str:
    """Word numbers as text: ``width`` letters each, a set of letters of its own
    for every position, so that phrases match at word bounds only.  Few letters
    keep the fan-out of the automaton's nodes small."""
    digits = (ids[..., None] >> (bits * np.arange(width))) & ((1 << bits) - 1)
    return (digits + (np.arange(width) << bits)).astype("<u4").tobytes().decode("utf-32-le")


def occurrences(seq: np.ndarray, phrases: np.ndarray, words: int) -> np.ndarray:
    """Positions in ``seq`` of the last word of every occurrence of a phrase
    (rows of ``phrases``), by one pass through an Aho-Corasick automaton.
    Word numbers are below ``words``; negative ones stand for no word."""
    bits = 6
    width = max(1, -(-(words + 1).bit_length() // bits))
    if width > 4:  # more than 16 million distinct words in a block
        width, bits = 4, -(-(words + 1).bit_length() // 4)
    step = width * phrases.shape[1]
    every = _letters(phrases + 1, width, bits)
    a = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for i in range(0, len(every), step):
        a.add_word(every[i:i + step])
    a.make_automaton()
    return np.fromiter((e for e, _ in a.iter(_letters(seq + 1, width, bits))), np.int64) // width


PLACES = "__block int, __h1 long, __h2 long, __doc long, __start int, __run int, __ord int, __copy string"


def _find_windows(window: int):
    def run(key, docs: pa.Table, recurring: pa.Table) -> pa.Table:
        cols = {n: np.zeros(0, np.int64) for n in ("h1", "h2", "doc", "start", "run", "ord")}
        marks = recurring.column("__copy").drop_null()
        if docs.num_rows and recurring.num_rows:
            b = Block(docs, set(marks.to_pylist()))
            at, h = b.anchors(window)
            known = np.sort(recurring.column("__hash").drop_null().to_numpy().view(np.uint64))
            at = at[np.isin(h, known)]
            if len(at):
                ends = occurrences(b.seq, b.seq[at[:, None] + np.arange(ANCHOR)], len(b.vocab))
                near = spread(np.maximum(ends + 1 - window, 0), np.minimum(ends + 1, window) - ANCHOR + 1, len(b.seq))
                ok = b.inside(window)
                w = np.flatnonzero(near[:len(ok)] & ok)
                a1 = window_hash(b.h1, window, MULTIPLIERS[0])[w]
                a2 = window_hash(b.h2, window, MULTIPLIERS[1])[w]
                ordinal, start = b.place(w)
                doc = b.doc[ordinal]
                by = np.lexsort((start, doc, a2, a1))
                head = np.ones(len(by), dtype=bool)
                head[1:] = (a1[by][1:] != a1[by][:-1]) | (a2[by][1:] != a2[by][:-1])
                first = by[np.flatnonzero(head)[np.cumsum(head) - 1]]  # the block's earliest equal window
                later = np.zeros(len(by), dtype=bool)
                later[by] = (doc[by] > doc[first]) | (start[by] > start[first])
                lead = np.sort(by[head])
                # settled windows, as runs of consecutive starts; their place stands for a hash and keeps them apart
                s = np.flatnonzero(later)
                cut = np.ones(len(s), dtype=bool)
                cut[1:] = np.diff(w[s]) != 1
                runs = np.flatnonzero(cut)
                length = np.diff(np.append(runs, len(s)))
                r = s[runs]
                # an equal place (a row that repeats an id) is neither earlier nor later and stays with the leader
                same = np.setdiff1d(np.flatnonzero(~later), lead)
                lead = np.sort(np.concatenate([lead, same]))
                own = (key[0].as_py() << 32) + ordinal[r]
                cols = {"h1": np.concatenate([a1[lead].view(np.int64), own]),
                        "h2": np.concatenate([a2[lead].view(np.int64), start[r]]),
                        "doc": np.concatenate([doc[lead], doc[r]]), "start": np.concatenate([start[lead], start[r]]),
                        "run": np.concatenate([np.zeros(len(lead), np.int64), length]),
                        "ord": np.concatenate([ordinal[lead], ordinal[r]])}
        n, m = len(cols["h1"]), len(marks)
        none = pa.nulls(m, pa.int64())
        full = [pa.concat_arrays([pa.array(cols[c], pa.int64()), none]) for c in ("h1", "h2", "doc", "start", "run", "ord")]
        full = full[:3] + [x.cast(pa.int32()) for x in full[3:]]
        copy = pa.concat_arrays([pa.nulls(n, pa.string()), pa.array(marks.to_pylist(), pa.string())])
        return pa.table([pa.array([key[0].as_py()] * (n + m), pa.int32()), *full, copy],
                        names=[x.split()[0] for x in PLACES.split(", ")])
    return run


def _cut(window: int, names: list[str]):
    def run(key, docs: pa.Table, places: pa.Table) -> pa.Table:
        if not docs.num_rows:
            empty = {n: docs.column(n) for n in names}
            return pa.table({"doc_id": docs.column("__id"), "n_words": pa.array([], pa.int64()),
                             "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string()), **empty})
        copies = _copies(places)
        b = Block(docs, copies)
        real = places.filter(pa.compute.is_valid(places.column("__ord")))
        ordinal, start, length = (real.column(c).to_numpy().astype(np.int64) for c in ("__ord", "__start", "__run"))
        gone = spread(b.starts[ordinal] + start, np.maximum(length, 1) + window - 1, len(b.seq))
        n_words, n_removed, kept = [], [], []
        for i, words in enumerate(b.words):
            n_words.append(len(words))
            if b.copy[i]:
                words = words if len(words) < window else []
            elif (out := gone[b.starts[i]:b.starts[i] + len(words)]).any():
                words = [w for w, x in zip(words, out.tolist()) if not x]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        rows = docs.take(pa.array(b.order))
        return pa.table({"doc_id": rows.column("__id"), "n_words": pa.array(n_words, pa.int64()),
                         "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.string()),
                         **{n: rows.column(n) for n in names}})
    return run


def later_copies(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, id:digest) of rows whose whole text also stands in a smaller id."""
    keyed = scratch(docs.select("__block", "__id", F.md5(F.col("__text")).alias("__md5")).filter("__text is not null and __id is not null"), "digests")
    firsts = keyed.groupBy("__md5").agg(F.min("__id").alias("__min"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    return (lookup(keyed, firsts, "__md5", "__n", keyed.count()).filter(F.col("__id") > F.col("__min"))
            .select("__block", F.concat_ws(":", "__id", "__md5").alias("__copy")).distinct())


def substring_dedup(docs: DataFrame, window: int = 20, carry: tuple[str, ...] = (), key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_text (the words
    that stay, joined by one space) and the ``carry`` columns as c_<name>.

    Null and empty texts have no words.  Rows that repeat an id with the same
    text are the same places, none of which is earlier; an id with several
    texts orders them by start only.  A null id counts as the largest.  Texts
    shorter than the window keep all words.  An empty table gives no rows."""
    n = block_count(docs, text, BLOCK_BYTES)
    names = [f"c_{c}" for c in carry]
    # the one shuffle of the texts; all three passes below read it
    rows = (docs.select(block_of(n, F.col(key), F.col(text)).alias("__block"), F.col(key).cast("long").alias("__id"),
                        F.col(text).alias("__text"), *[F.col(f"`{c}`").alias(f"c_{c}") for c in carry])
            .repartition(n, "__block"))
    blocks = rows.groupBy("__block")
    copies = scratch(later_copies(rows_of(docs, n, key, text), n), "copies")
    anchors = blocks.cogroup(copies.groupBy("__block")).applyInArrow(
        _find_anchors(window), "__block int, __hash long, __n long, __copy string")
    often = F.sum("__n").over(Window.partitionBy("__hash", F.col("__copy")))
    recurring = anchors.withColumn("__all", often).filter("__all > 1").select("__block", "__hash", "__copy")
    places = blocks.cogroup(recurring.groupBy("__block")).applyInArrow(_find_windows(window), PLACES)
    here = F.struct("__doc", "__start")
    least = F.min(here).over(Window.partitionBy("__h1", "__h2", "__copy"))
    later = (places.withColumn("__least", least)
             .filter(F.col("__copy").isNotNull() | (F.col("__run") > 0) | (F.col("__least") < here))
             .select("__block", "__ord", "__start", "__run", "__copy"))
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(["doc_id long, n_words long, n_removed long, kept_text string", *[f"`{x}` {fields[x]}" for x in names]])
    return blocks.cogroup(later.groupBy("__block")).applyInArrow(_cut(window, names), schema)


def rows_of(docs: DataFrame, n: int, key: str, text: str) -> DataFrame:
    return docs.select(block_of(n, F.col(key), F.col(text)).alias("__block"), F.col(key).cast("long").alias("__id"),
                       F.col(text).alias("__text"))
