"""Op 6: quality rules by weak supervision.

Each rule reads counts of a text and votes good (1), bad (-1) or abstains (0).
Nobody labels anything: expectation-maximisation over all texts' votes finds
how often each rule is right about good and about bad texts, and the posterior
probability of a text being good, not agreement of all rules, decides.

The data are passed over once for the counts.  EM needs only how often each
combination of votes occurs, of which there are at most 3**rules whatever the
size of the table."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from partnerlens.llm.common import scratch
from partnerlens.llm.words import MULTIPLIERS, Vocab, spread, window_hash, word_hashes, word_ids

SYMBOLS = "#*$%&|<>"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_same_next",
          "n_letters", "stretch_distinct")
STRETCH = 2000  # variety is the mean over all stretches of so many words, as it falls with length
START = (0.5, 0.975)  # chance that a rule's vote on a bad and on a good text is good
PRIOR = (0.2, 0.8)  # bad, good
_LETTERS = re.compile(r"[^\W\d_]+")


def stretch_distinct(ids: np.ndarray, size: int) -> int:
    """Distinct words of every ``size`` consecutive ones, summed over all such
    stretches; a shorter text is one stretch."""
    n = len(ids)
    size = min(n, size)
    by = np.argsort(ids, kind="stable")
    last = np.full(n, -1, dtype=np.int64)  # place of the same word before
    again = ids[by[1:]] == ids[by[:-1]]
    last[by[1:][again]] = by[:-1][again]
    at = np.arange(n)
    # a word is new to the stretches that hold it and start after its last place
    lo, hi = np.maximum(np.maximum(at - size + 1, last + 1), 0), np.minimum(at, n - size)
    return int(np.maximum(hi - lo + 1, 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one whole text; null and empty texts give zeros."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if n == 0:
        return (0, 0, sum(map(text.count, SYMBOLS)), *[0] * 7)
    vocab = Vocab()
    ids = word_ids(words, vocab)
    blanks = sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in raw.split(b"\n") if x.split()] if b"\n" in raw else [raw]
    repeat = 0
    if n > WINDOW:
        h = word_hashes(vocab)[0][ids]
        w = window_hash(h, WINDOW, MULTIPLIERS[0])
        _, back, count = np.unique(w, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(count[back] > 1)
        if len(starts):
            repeat = int(spread(starts, WINDOW, n).sum())
    return (n, len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, len(lines),
            len(vocab), int((ids[1:] == ids[:-1]).sum()), sum(map(len, _LETTERS.findall(text))), stretch_distinct(ids, STRETCH))


def _count(carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*map(text_counts, b.column(1).to_pylist()))) or [()] * len(COUNTS)
            yield pa.record_batch([b.column(0), *[pa.array(c, pa.int64()) for c in cols], *b.columns[2:]],
                                  names=["doc_id", *COUNTS, *carried])
    return run


def votes() -> dict[str, Column]:
    """Rule -> vote.  A rule abstains where its evidence is thin or lies
    between its bounds.  No trouble shows in more than three of them, so that no
    one kind of bad text outweighs the others in EM, which takes the votes of
    a class as independent."""
    n, c = F.col("n_words"), F.col
    per = lambda a, b: F.try_divide(c(a), c(b))

    def rule(bad: Column, good: Column, enough: Column) -> Column:
        return F.when(~enough, 0).when(bad, -1).when(good, 1).otherwise(0)

    symbols, letters, length = per("n_symbols", "word_chars"), per("n_letters", "word_chars"), per("word_chars", "n_words")
    size = F.least(n, F.lit(STRETCH))
    variety = F.try_divide(c("stretch_distinct"), size * (n - size + 1))
    runs, lines = per("n_same_next", "n_words"), per("n_dup_lines", "n_lines")
    marks, lined = per("n_symbols", "n_words"), c("n_lines") >= 3
    return {
        "symbols": rule(symbols > 0.05, symbols < 0.01, n >= 5),
        "marks": rule(marks > 0.4, marks < 0.1, n >= 5),
        "letters": rule(letters < 0.75, letters > 0.88, n >= 5),
        "word_length": rule((length < 3) | (length > 7.5), length.between(3.5, 6.5), n >= 5),
        "repetition": rule((100 * c("n_repeat_words") > 30 * n) | (lined & (lines > 0.4)),
                           (100 * c("n_repeat_words") < 5 * n) & ~(lined & (lines > 0.1)), n >= 2 * WINDOW),
        "variety": rule((variety < 0.3) | (runs > 0.2), (variety > 0.45) & (runs < 0.05), n >= 20),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200,
        strength: float = 10.0) -> dict[tuple[int, ...], float]:
    """Vote pattern -> posterior probability of a good text.

    EM for two classes with, per rule and class, the probability that a vote
    cast is good; an abstention tells nothing.  It starts from START (false
    alarms are rare; a bad text need not trouble every rule), and that belief
    counts as ``strength`` texts of each class, which keeps the classes from
    changing sides and settles rules that never vote."""
    if not patterns:
        return {}
    v = np.array([p for p, _ in patterns])
    w = np.array([float(c) for _, c in patterns])
    up, down = (v == 1).astype(float), (v == -1).astype(float)
    belief = np.repeat(np.array(START)[:, None], v.shape[1], axis=1)  # class (bad, good), rule
    good, prior = belief.copy(), np.array(PRIOR)
    for _ in range(rounds):
        log = up @ np.log(good).T + down @ np.log(1 - good).T + np.log(prior)
        post = np.exp(log - log.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        mass = (post * w[:, None]).T
        new = (mass @ up + strength * belief) / (mass @ (up + down) + strength)
        prior = (mass.sum(axis=1) + strength * np.array(PRIOR)) / (w.sum() + strength)
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return {p: float(g) for (p, _), g in zip(patterns, post[:, 1])}


def quality(docs: DataFrame, keep_at: float = 0.5, key: str = "doc_id", text: str = "text",
            carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, the COUNTS, base_failed, kept, p_good, the
    votes and the ``carry`` columns as c_<name>.  base_failed: under 20 words, or more than 30 % of the words in
    repeated 8-word windows; such texts are not kept, whatever p_good says.
    Null and empty texts have no words and fail.  Rows that repeat a key are
    judged one by one; an empty table gives no rows.

    The counts are written once and read twice; with ``carry`` columns, which
    may be whole texts, they are worked out twice instead of written."""
    types, carried = dict(docs.dtypes), [f"c_{c}" for c in carry]
    counted = (docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), *[F.col(f"`{c}`").alias(f"c_{c}") for c in carry])
               .mapInArrow(_count(carried), ", ".join([f"doc_id {types[key]}", *[f"{c} long" for c in COUNTS],
                                                       *[f"`c_{c}` {types[c]}" for c in carry]])))
    if not carry:
        counted = scratch(counted, "counts")
    rules = votes()
    voted = counted.select("*", *[v.cast("int").alias(f"vote_{r}") for r, v in rules.items()])
    names = [f"vote_{r}" for r in rules]
    seen = [(tuple(r[x] for x in names), r["count"]) for r in voted.groupBy(*names).count().orderBy(*names).collect()]
    post = fit(seen)
    table = docs.sparkSession.createDataFrame([(*p, g) for p, g in post.items()],
                                              ", ".join(f"__{x} int" for x in names) + ", p_good double")
    on = [F.col(x) == F.col(f"__{x}") for x in names]
    judged = voted.join(F.broadcast(table), on, "left").drop(*[f"__{x}" for x in names])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (judged.withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.coalesce("p_good", F.lit(1.0)) >= keep_at))
            .select("doc_id", *COUNTS, "base_failed", "kept", "p_good", *names, *[f"`{c}`" for c in carried]))
