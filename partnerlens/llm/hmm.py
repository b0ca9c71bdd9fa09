"""Op 9: a hidden Markov language model.

Latent states emit word classes (a hash of the word, CLASSES of them; class 0
is the end token alone) and a class emits its words by their training counts:
P(text) = P(classes under the states) * product of P(word | class).  The
states' tables are thus bounded by CLASSES x STATES whatever the vocabulary,
while every distinct word of the training texts is counted.

Training: each Baum-Welch round runs over all training texts where they lie;
a task sums its expected counts and the rounds' totals meet in one aggregation
by class.  Only the starting point comes from a few texts (INIT_DOCS).
Scoring: the scaled forward recursion gives the exact likelihood of every
whole class sequence.  Texts of a batch advance together, longest first, one
token a step, so long texts cost no padding."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from partnerlens.llm.common import block_count, block_of, scratch

STATES = 6
CLASSES = 1 << 14
GAIN = 0.001  # rounds end when one adds less to the log10 likelihood of a token
ROUNDS = 50  # rounds at most
SMOOTH = 0.05  # added to every expected count
BATCH_TOKENS = 1 << 21
BLOCK_BYTES = 16 << 20
END = 0


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Hashes(dict):
    """word -> XXH3 64-bit hash as a signed number; the cache is per block."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return h


def hashes(words: list[bytes], cache: Hashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.int64, len(words))


def classes(h: np.ndarray) -> np.ndarray:
    """1 .. CLASSES - 1 for words; the end token is class 0."""
    return ((h & 0x7FFFFFFF) % (CLASSES - 1) + 1).astype(np.uint16)


def coded(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``tokens`` and ``hashes`` of a column of texts at once: the words of all
    texts, one after the other, as numbers of their distinct words; how many
    words each text has; the hashes of the distinct words."""
    whole = pa.chunked_array(texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts], texts.type)
    whole = whole.cast(pa.large_string()).fill_null("").combine_chunks()
    split = pc.ascii_split_whitespace(pc.ascii_lower(whole))
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    found = split.flatten().dictionary_encode()
    code, word = found.indices.to_numpy(), found.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    for empty in np.flatnonzero(word == b""):  # white space at either end leaves an empty word
        real = code != empty
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[real], minlength=len(sizes))
        code = code[real]
        code, word = code - (code > empty), np.delete(word, empty)
    return code, sizes, hashes(word, Hashes())


def sequences(code: np.ndarray, sizes: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """Class sequences of texts as ``coded`` gives them, end tokens included."""
    return np.split(np.insert(classes(h)[code], np.cumsum(sizes), END), np.cumsum(sizes + 1)[:-1])[:len(sizes)]


class Lockstep:
    """Sequences side by side, longest first: position t of all that are
    longer than t lies together."""

    def __init__(self, sequences: list[np.ndarray]):
        size = np.array([len(s) for s in sequences], dtype=np.int64)
        self.order = np.argsort(-size, kind="stable")
        size = size[self.order]
        total = int(size.sum())
        steps = int(size[0]) if len(size) else 0
        self.live = np.searchsorted(-size, -np.arange(steps), side="left")  # sequences longer than t
        self.at = np.concatenate([[0], np.cumsum(self.live)])
        self.total, self.n = total, len(size)
        if total:
            flat = np.concatenate([sequences[i] for i in self.order.tolist()])
            t = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
            self.row = np.empty(total, dtype=np.int32)
            self.symbol = np.empty(total, dtype=flat.dtype)
            dest = self.at[t] + np.repeat(np.arange(len(size)), size)
            self.symbol[dest] = flat
            self.row[dest] = np.repeat(np.arange(len(size), dtype=np.int32), size)


class Model:
    """start (K), move (K x K) and emit (CLASSES x K) probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> "Model":
        s, m, e = start + SMOOTH, move + SMOOTH, emit + SMOOTH
        return Model(s / s.sum(), m / m.sum(axis=1, keepdims=True), e / e.sum(axis=0))

    @staticmethod
    def initial(seed: int = 7) -> "Model":
        rng = np.random.default_rng(seed)
        emit = 1 + rng.random((CLASSES, STATES))
        move = np.full((STATES, STATES), 0.1 / max(STATES - 1, 1))
        np.fill_diagonal(move, 0.9)
        return Model(np.full(STATES, 1 / STATES), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def light(self) -> "Model":
        """The same model in single precision, for expected counts."""
        return Model(*(p.astype(np.float32) for p in (self.start, self.move, self.emit)))

    def forward(self, x: Lockstep, keep: bool = False):
        """Scale factors per position (their logs sum to the likelihood) and,
        with ``keep``, the scaled forward probabilities and the probabilities of
        the symbols, a row per state."""
        emit = np.ascontiguousarray(self.emit.T).take(x.symbol, axis=1)
        alphas = np.empty_like(emit) if keep else emit
        scale = np.empty(x.total, dtype=emit.dtype)
        at, onward, a = x.at.tolist(), self.move.T.copy(), None
        work = np.empty((len(self.start), at[1]), dtype=emit.dtype)
        for lo, hi in zip(at, at[1:]):
            w, e, s = work[:, :hi - lo], emit[:, lo:hi], scale[lo:hi]
            if a is None:
                np.multiply(self.start[:, None], e, out=w)
            else:
                np.matmul(onward, a[:, :hi - lo], out=w)
                np.multiply(w, e, out=w)
            np.add.reduce(w, axis=0, out=s)
            a = np.divide(w, s, out=alphas[:, lo:hi])
        return scale, alphas, emit

    def log10(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 likelihood of every sequence, in the order given."""
        out = np.zeros(len(sequences))
        if sequences:
            x = Lockstep(sequences)
            if x.total:
                out[x.order] = np.bincount(x.row, weights=np.log10(self.forward(x)[0]), minlength=x.n)
        return out

    def expected(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts (start, move, emit) of the sequences and, as a fourth
        array, their log10 likelihood and number of tokens."""
        k = len(self.start)
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((CLASSES, k))
        x = Lockstep(sequences)
        if not x.total:
            return start, move, emit, np.zeros(k)
        scale, alphas, emitted = self.forward(x, keep=True)
        fit = np.zeros(k)
        fit[:2] = np.log10(scale).sum(dtype=np.float64), x.total
        emitted /= scale
        gamma = alphas  # turned into posteriors in place, last position first
        at, back, beta_of = x.at.tolist(), None, np.empty((k, x.n), dtype=emitted.dtype)
        for t in range(len(at) - 2, -1, -1):
            lo, hi = at[t], at[t + 1]
            a, beta, m = alphas[:, lo:hi], beta_of[:, :hi - lo], 0
            if back is not None:
                m = back.shape[1]
                move += a[:, :m] @ back.T
                np.matmul(self.move, back, out=beta[:, :m])
            beta[:, m:] = 1  # texts that end here
            if t:
                back = np.multiply(beta, emitted[:, lo:hi], out=emitted[:, lo:hi])
            np.multiply(a, beta, out=a)
        start += gamma[:, :at[1]].sum(axis=1)
        symbol = x.symbol.astype(np.intp)
        for j in range(k):
            emit[:, j] = np.bincount(symbol, weights=gamma[j], minlength=CLASSES)
        return start, move * self.move, emit, fit


def batches_of(sequences: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Sequences of similar length, about BATCH_TOKENS at a time."""
    part, n = [], 0
    for s in sorted(sequences, key=len, reverse=True):
        part.append(s)
        n += len(s)
        if n >= BATCH_TOKENS:
            yield part
            part, n = [], 0
    if part:
        yield part


def _class_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training texts -> their class sequences, end token included."""
    for b in batches:
        out = [s.tobytes() for s in sequences(*coded(b.column(1)))]
        yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "classes"])


COUNTED = "kind int, idx int, counts array<double>"


def _counts(model: Model):
    model = model.light()

    def rows(total) -> pa.RecordBatch:
        start, move, emit, fit = total
        seen = np.flatnonzero(emit.any(axis=1))
        data = [start[None, :], move, emit[seen], fit[None, :]]
        kind = np.repeat([0, 1, 2, 3], [1, len(move), len(seen), 1])
        idx = np.concatenate([[0], np.arange(len(move)), seen, [0]])
        flat = np.concatenate(data)
        counts = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
        return pa.record_batch([pa.array(kind, pa.int32()), pa.array(idx, pa.int32()), counts], names=["kind", "idx", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = None, [], 0

        def add():
            nonlocal total
            for part in batches_of(held):
                got = model.expected(part)
                total = got if total is None else tuple(a + b for a, b in zip(total, got))

        for b in batches:
            for x in b.column(0).to_pylist():
                held.append(np.frombuffer(x, np.uint16))
                n += len(held[-1])
                if n >= 2 * BATCH_TOKENS:
                    add()
                    held, n = [], 0
        add()
        if total is not None:
            yield rows(total)
    return run


def _model(counted: DataFrame) -> tuple[Model, float] | None:
    """Sums the tasks' counts by class; the result has CLASSES + STATES + 2
    rows at most, whatever the input.  Also the log10 likelihood per token
    under the model that the counts were made with."""
    sums = counted.groupBy("kind", "idx").agg(*[F.sum(F.element_at("counts", j + 1)).alias(f"c{j}") for j in range(STATES)])
    got = sums.toArrow()
    if not got.num_rows:
        return None
    kind, idx = got.column("kind").to_numpy(), got.column("idx").to_numpy()
    value = np.stack([got.column(f"c{j}").to_numpy() for j in range(STATES)], axis=1)
    start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES))
    start += value[kind == 0].sum(axis=0)
    move[idx[kind == 1]] = value[kind == 1]
    emit[idx[kind == 2]] = value[kind == 2]
    likelihood, n = value[kind == 3][:, :2].sum(axis=0)
    return Model.from_counts(start, move, emit), float(likelihood / max(n, 1))


def train(texts: DataFrame, rounds: int = ROUNDS, gain: float = GAIN) -> Model:
    """Fits the model to all rows (doc_id, text) of ``texts``: Baum-Welch from
    seeded parameters, every round over all texts, until a round has raised the
    log10 likelihood per token by less than ``gain``."""
    stream = scratch(texts.select("doc_id", "text").mapInArrow(_class_stream, "doc_id long, classes binary"), "classes")
    model, last = Model.initial(), -math.inf
    for _ in range(rounds):
        got = _model(stream.select("classes").mapInArrow(_counts(model), COUNTED))
        if got is None:
            break
        model, reached = got
        if reached - last < gain:
            break
        last = reached
    return model


def _vocabulary(docs: pa.Table) -> pa.Table:
    """Distinct words of a block's texts (of all, with their training counts)."""
    block = docs.column("__block")[0].as_py()
    code, sizes, word = coded(docs.column("text"))
    train = np.repeat(~docs.column("held_out").to_numpy(), sizes)
    all_h, at = np.unique(word, return_inverse=True)
    n = np.bincount(at[code[train]], minlength=len(all_h))
    return pa.table({"__block": pa.array([block] * len(all_h), pa.int32()), "h": pa.array(all_h),
                     "n": pa.array(n, pa.int64()),
                     "class": pa.array(classes(all_h).astype(np.int32))})


SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _score(model: Model):
    def run(key, docs: pa.Table, words: pa.Table) -> pa.Table:
        h = words.column("h").to_numpy()
        by = np.argsort(h)
        h = h[by]
        count = words.column("c").to_numpy()[by]
        of_class = words.column("of_class").to_numpy()[by]  # log10 of the class's training tokens + distinct words + 1
        total = docs.column("N").to_numpy().astype(np.float64)
        distinct = docs.column("V").to_numpy().astype(np.float64)
        ends = docs.column("E").to_numpy()
        code, sizes, word = coded(docs.column("text"))
        seqs, at = sequences(code, sizes, word), np.searchsorted(h, word)
        base_word, known = np.log10(count + 1.0)[at][code], (count > 0)[at][code]
        in_class = (np.log10(count + 1.0) - of_class)[at][code]
        base, rest, n_tokens, n_known, lo = [], [], [], [], 0
        for i, size in enumerate(sizes.tolist()):
            own = slice(lo, lo + size)
            lo += size
            n_tokens.append(size + 1)
            n_known.append(int(known[own].sum()) + int(ends[i] > 0))
            base.append(base_word[own].sum() + math.log10(ends[i] + 1) - (size + 1) * math.log10(total[i] + distinct[i] + 1))
            rest.append(in_class[own].sum())
        score = np.zeros(len(seqs))
        order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
        done = 0
        for part in batches_of(seqs):
            score[order[done:done + len(part)]] = model.log10(part)
            done += len(part)
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"),
                         "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
                         "train_tokens": docs.column("N"), "base_score": pa.array(base, pa.float64()),
                         "score": pa.array(score + np.array(rest), pa.float64())})
    return run


def blocks_of(rows: DataFrame, n: int) -> DataFrame:
    return rows.select("*", block_of(n, F.col("doc_id"), F.col("text")).alias("__block")).repartition(n, "__block")


def lm_scores(docs: DataFrame, folds: int = 7, held: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (add-one unigram) and score (the hidden Markov model's log10
    probability of the whole text).

    A row is held out if crc32 of its id as text, modulo ``folds``, is
    ``held``; the others train (a null id counts as the empty text).  Null and
    empty texts are one end token.  Rows that repeat an id each count.  With
    no training rows at all every count is zero and the states are those of
    the untrained model.  An empty table gives no rows."""
    spark = docs.sparkSession
    n = block_count(docs, text, BLOCK_BYTES)
    out = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), out.alias("held_out"))
    model = train(rows.filter(~F.col("held_out")))
    ends = rows.filter(~F.col("held_out")).count()
    dealt = blocks_of(rows, n)
    seen = dealt.groupBy("__block").applyInArrow(_vocabulary, "__block int, h long, n long, class int")
    of_word = Window.partitionBy("h")
    words = seen.withColumn("c", F.sum("n").over(of_word)).withColumn("lead", F.min("__block").over(of_word) == F.col("__block"))
    per_class = words.groupBy("class").agg(
        F.sum("n").alias("nc"), F.sum((F.col("lead") & (F.col("c") > 0)).cast("long")).alias("vc"))
    # CLASSES rows at most
    sizes = per_class.select(F.col("class").alias("__class"), F.log10(F.col("nc") + F.col("vc") + 1).alias("of_class"))
    totals = per_class.agg((F.coalesce(F.sum("nc"), F.lit(0)) + ends).alias("N"),
                           (F.coalesce(F.sum("vc"), F.lit(0)) + int(ends > 0)).alias("V"))
    given = words.join(F.broadcast(sizes), F.col("class") == F.col("__class")).select("__block", "h", "c", "of_class")
    both = totals.select(F.struct("N", "V")).scalar()
    left = dealt.withColumn("__t", both).select("*", "__t.N", "__t.V", F.lit(ends).alias("E")).drop("__t")
    return left.groupBy("__block").cogroup(given.groupBy("__block")).applyInArrow(_score(model), SCORES)
