"""Feedback sentiment: text scoring, batched prompts and reply parsing.

The reference calls hosted models (a chat API, RoBERTa, Stanza).  Here:

* ``token_weight_scorer`` -- a distributed stand-in model: smoothed log-odds
  token weights learnt from labelled rows (explode, count, join, sum);
* ``train_classifier`` / ``classify`` -- a trained classifier: class-weighted
  logistic regression on hashed token features, fitted by distributed gradient
  rounds until the objective settles;
* ``score_text_batches`` -- the Arrow-batched surface for any per-batch
  callable (loaded once per partition, retried, default on failure);
* ``batch_prompts`` / ``parse_replies`` -- the request and reply sides of the
  batched chat protocol, as column expressions.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from partnerlens.functions.scalar import NEGATIVE, POSITIVE, fn_fixed_text, fn_label_threshold
from partnerlens.operators.joins import heavy_join
from partnerlens.operators.split import global_row_number
from partnerlens.session import stored, tasks_at_once

# The batched request of the reference.
BATCH_SIZE = 50
PROMPT_HEAD = ("Classify each of the following texts as Positive or Negative and provide a sentiment "
               "score between 0 and 1 (higher value means more positive). Return the results in the "
               "format '1: Positive, 0.85' or '1: Negative, 0.15' for each line.\n\n")
HOT_TOKENS = 100_000    # tokens whose weights are broadcast at most, whatever the vocabulary
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"     # tokens: maximal runs of letters and digits


def tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token, n): token counts per text over the whole text."""
    t = df.select(id_col, F.explode(F.split(F.lower(F.col(text_col)), TOKEN_SPLIT)).alias("token"))
    return t.filter(F.col("token") != "").groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("n"))


def train_token_weights(labelled: DataFrame, id_col: str, text_col: str, label_col: str,
                        alpha: float = 1.0) -> tuple[DataFrame, Column]:
    """Smoothed log-odds weight per token and the class prior log-odds
    (a scalar subquery).  The label travels with the tokens, so counting is
    one partial and one final aggregate by token."""
    pos = F.col(label_col) == POSITIVE
    tk = labelled.select(pos.alias("_pos"), F.explode(F.split(F.lower(F.col(text_col)), TOKEN_SPLIT)).alias("token"))
    counts = (tk.filter(F.col("token") != "").groupBy("token")
              .agg(F.count(F.when(F.col("_pos"), 1)).alias("cp"), F.count(F.when(~F.col("_pos"), 1)).alias("cn")))
    tot = counts.agg(F.struct(F.sum("cp").alias("np"), F.sum("cn").alias("nn"),
                              F.count(F.lit(1)).alias("v"))).scalar()       # one-row scalar subquery
    w = counts.select("token", (F.log((F.col("cp") + alpha) / (tot["np"] + alpha * tot["v"]))
                                - F.log((F.col("cn") + alpha) / (tot["nn"] + alpha * tot["v"]))).alias("w"),
                      (F.col("cp") + F.col("cn")).alias("occurs"))
    docs = labelled.agg(F.struct(F.sum(F.when(pos, 1).otherwise(0)).alias("p"),
                                 F.sum(F.when(~pos, 1).otherwise(0)).alias("q"))).scalar()
    prior = F.log((docs["p"] + alpha) / (docs["q"] + alpha))
    return w, prior


def score_with_models(texts: DataFrame, id_col: str, text_col: str, models: dict[str, tuple[DataFrame, Column]],
                      threshold: float = 0.5) -> DataFrame:
    """(model, id, score, label): logistic of prior + sum of the weights of all
    token occurrences, for models (weights, prior) learnt on the same texts; the
    texts are taken apart once for all models.  Occurrences meet the HOT_TOKENS
    most frequent tokens by broadcast (``heavy_join``) and are summed where the
    text lies; only those of rarer tokens are shuffled."""
    every = None
    for i, (w, _) in enumerate(models.values()):
        w = w.withColumnRenamed("w", f"_w{i}")
        every = w if every is None else every.join(w.drop("occurs"), "token")
    total = every.agg(F.sum("occurs")).scalar()
    found = texts.select(id_col, F.explode(F.split(F.lower(F.col(text_col)), TOKEN_SPLIT)).alias("token")).filter(F.col("token") != "")
    s = (heavy_join(found, every, "token", "occurs", total, HOT_TOKENS)
         .groupBy(id_col).agg(*[F.sum(f"_w{i}").alias(f"_s{i}") for i in range(len(models))]))
    each = F.array(*[F.struct(F.lit(name).alias("model"), (prior + F.coalesce(F.col(f"_s{i}"), F.lit(0.0))).alias("s"))
                     for i, (name, (_, prior)) in enumerate(models.items())])
    out = (texts.select(id_col).join(s, id_col, "left").select(id_col, F.explode(each).alias("_m"))
           .select(F.col("_m.model").alias("model"), id_col, (1 / (1 + F.exp(-F.col("_m.s")))).alias("score")))
    return out.withColumn("label", fn_label_threshold("score", threshold))


def score_with_weights(texts: DataFrame, id_col: str, text_col: str, weights: DataFrame, prior: Column,
                       threshold: float = 0.5) -> DataFrame:
    """(id, score, label) of one model, as ``score_with_models``."""
    return score_with_models(texts, id_col, text_col, {"one": (weights, prior)}, threshold).drop("model")


def token_attribution(texts: DataFrame, id_col: str, text_col: str, weights: DataFrame) -> DataFrame:
    """Per text and token: count, weight and contribution (= weight x count),
    the exact additive attribution of the token-weight scorer."""
    return (tokens(texts, id_col, text_col).join(weights.drop("occurs"), "token")
            .select(id_col, "token", "n", "w", (F.col("n") * F.col("w")).alias("contribution")))


# ------------------------------------------------- trained classifier

FEATURES = 1 << 18       # hashed token features: bounds the model whatever the vocabulary
REGULARISATION = 1e-4
TOLERANCE = 1e-7         # relative change of the objective at which the rounds end
ROUNDS = 200             # rounds at most; ``converged`` tells whether they sufficed


def shape_tokens(text: Column) -> Column:
    """What a bag of words does not show, as tokens: how long the text is, how
    much of it repeats words or lines, and its shares of symbols, digits and
    capitals, each in coarse steps."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    n_chars = F.greatest(F.length(text), F.lit(1))

    def step(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"\u0001{name}:"), F.floor(value).cast("string"))

    def share(pattern: str) -> Column:
        return 40 * (1 - F.length(F.regexp_replace(text, pattern, "")) / n_chars)
    distinct = 10 * F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))
    return F.array(step("words", F.log2(F.size(words) + 1)), step("distinct", distinct),
                   step("lines", 10 * F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))),
                   step("length", n_chars / F.greatest(F.size(words), F.lit(1))), step("symbols", share(r"[^\p{L}\p{N}\s]")),
                   step("digits", share(r"\p{N}")), step("capitals", share(r"\p{Lu}")))


def token_features(df: DataFrame, text_col: str, size: int = FEATURES) -> DataFrame:
    """``df`` with ``features``: hashed counts of the tokens of the whole text
    and of its shape, as a sparse vector of length one.  Rows that have their
    ``features`` keep them, so that texts can be taken apart once for several
    steps."""
    from pyspark.ml.feature import HashingTF, Normalizer
    if "features" in df.columns:
        return df
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: t != "")
    d = df.withColumn("_tokens", F.concat(found, shape_tokens(text)))
    d = HashingTF(numFeatures=size, inputCol="_tokens", outputCol="_tf", binary=True).transform(d)
    return Normalizer(inputCol="_tf", outputCol="features").transform(d).drop("_tokens", "_tf")


def train_classifier(labelled: DataFrame, text_col: str, label_col: str, size: int = FEATURES,
                     regularisation: float = REGULARISATION, tolerance: float = TOLERANCE, rounds: int = ROUNDS):
    """Logistic regression of the positive class.  Classes weigh the same
    whatever their sizes.  Every round is one distributed pass that sums the
    gradient in a tree; the features are materialised once (before the call, if
    ``labelled`` has them).  A task of a round sends a gradient of ``size``
    doubles however few its rows are, so there is one task for each core, and
    what a round sends does not grow with the input."""
    from pyspark.ml.classification import LogisticRegression
    positive = (F.col(label_col) == POSITIVE).cast("double").alias("label")
    y = labelled.filter(F.col(label_col).isNotNull())
    y = y.select("features", positive) if "features" in y.columns else stored(token_features(y.select(text_col, positive), text_col, size).drop(text_col))
    sizes = {r["label"]: r["n"] for r in y.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}    # two rows
    if len(sizes) < 2:
        raise ValueError("both classes must occur among the labelled texts")
    total = sum(sizes.values())
    weight = F.when(F.col("label") == 1.0, total / (2 * sizes[1.0])).otherwise(total / (2 * sizes[0.0]))
    rows = y.select("features", "label", weight.alias("weight")).coalesce(tasks_at_once(y.sparkSession))
    model = LogisticRegression(weightCol="weight", regParam=regularisation, elasticNetParam=0.0, standardization=False,
                               tol=tolerance, maxIter=rounds).fit(rows)
    return model


def converged(model, tolerance: float = TOLERANCE) -> bool:
    """Whether the last round of a fit changed the objective by less than the tolerance."""
    h = model.summary.objectiveHistory
    return len(h) < 2 or abs(h[-2] - h[-1]) <= tolerance * max(abs(h[-1]), 1e-12) or model.summary.totalIterations < ROUNDS


def classify(texts: DataFrame, id_col: str, text_col: str, model, threshold: float = 0.5) -> DataFrame:
    """(id, score, label) of all texts; a null text counts as empty.  Texts that
    have their ``features`` need no text."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(token_features(texts, text_col, model.numFeatures).select(id_col, "features"))
    return (out.select(id_col, vector_to_array("probability")[1].alias("score"))
            .select(id_col, "score", fn_label_threshold("score", threshold).alias("label")))


# ------------------------------------------------------------ batching

def batch_number(df: DataFrame, order_col: str, size: int = BATCH_SIZE) -> DataFrame:
    """Consecutive batches of ``size`` rows in ``order_col`` order (exact
    global row numbers without a single-partition window)."""
    r = global_row_number(df, F.col(order_col).cast("bigint"), order_col, "_rn")
    return (r.withColumn("batch_id", F.floor((F.col("_rn") - 1) / size).cast("bigint"))
            .withColumn("pos", ((F.col("_rn") - 1) % size + 1).cast("int")).drop("_rn"))


def batch_prompts(batched: DataFrame, text_col: str) -> DataFrame:
    """One prompt per batch: instruction head + '1. text' items joined by a
    blank line, in position order (a batch holds at most BATCH_SIZE texts)."""
    item = F.concat(F.col("pos").cast("string"), F.lit(". "), F.coalesce(F.col(text_col), F.lit("")))
    g = batched.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("pos", item.alias("t")))).alias("a"))
    return g.select("batch_id", F.concat(F.lit(PROMPT_HEAD),
                                         F.array_join(F.transform("a", lambda x: x["t"]), "\n\n")).alias("prompt"))


def parse_replies(replies: DataFrame, reply_col: str = "reply") -> DataFrame:
    """(batch_id, pos, label, score) from reply lines 'n: Label, score'.
    A line that does not parse gives Negative / 0.0 for its position; lines
    without a leading number are ignored."""
    lines = replies.select("batch_id", F.posexplode(F.split(F.coalesce(F.col(reply_col), F.lit("")), "\n"))
                           .alias("line_no", "line"))
    num = F.regexp_extract("line", r"^\s*(\d+)\s*:", 1)
    label = F.trim(F.regexp_extract("line", r"^[^:]*:([^,]*),", 1))
    score = F.trim(F.regexp_extract("line", r"^[^,]*,(.*)$", 1)).try_cast("double")
    ok = (label != "") & score.isNotNull()
    p = (lines.withColumn("pos", num.try_cast("int")).filter(F.col("pos").isNotNull())
         .select("batch_id", "pos", F.when(ok, label).otherwise(F.lit(NEGATIVE)).alias("label"),
                 F.when(ok, score).otherwise(F.lit(0.0)).alias("score"), "line_no"))
    first = Window.partitionBy("batch_id", "pos").orderBy("line_no")     # <= lines of one reply
    return p.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") == 1).drop("_k", "line_no")


def attach_replies(batched: DataFrame, parsed: DataFrame) -> DataFrame:
    """Re-attach parsed labels by (batch, position); missing -> Negative / 0.0."""
    return (batched.join(parsed, ["batch_id", "pos"], "left")
            .withColumn("label", F.coalesce("label", F.lit(NEGATIVE)))
            .withColumn("score", F.coalesce("score", F.lit(0.0))))


def reply_text(scored: DataFrame, spoiled: Column | None = None) -> DataFrame:
    """Replies in the protocol's format built from scored rows (for tests
    and for replaying stored model outputs)."""
    line = F.concat(F.col("pos").cast("string"), F.lit(": "), F.col("label"), F.lit(", "),
                    fn_fixed_text("score", 2))
    if spoiled is not None:       # a model that now and then leaves the format
        line = F.when(spoiled, F.concat(F.col("pos").cast("string"), F.lit(": I am not sure"))).otherwise(line)
    g = scored.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))).alias("a"))
    return g.select("batch_id", F.array_join(F.transform("a", lambda x: x["l"]), "\n").alias("reply"))


# ------------------------------------------------------- scoring surface

def score_text_batches(df: DataFrame, text_col: str,
                       make_scorer: Callable[[], Callable[[list[str]], list[tuple[str, float]]]],
                       batch_size: int = BATCH_SIZE, retries: int = 3, backoff: float = 1.0) -> DataFrame:
    """Apply a per-batch scorer to a text column with Arrow batches.

    ``make_scorer`` is called once per partition (load a model there); the
    scorer gets up to ``batch_size`` texts and returns (label, score) pairs.
    A failing batch is retried, then defaults to Negative / 0.0.
    Adds columns ``label`` and ``score``.
    """
    schema = T.StructType(df.schema.fields + [T.StructField("label", T.StringType()),
                                              T.StructField("score", T.DoubleType())])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for pdf in it:
            labels, scores = [], []
            texts = pdf[text_col].fillna("").astype(str).tolist()
            for lo in range(0, len(texts), batch_size):
                chunk = texts[lo:lo + batch_size]
                res = None
                for attempt in range(retries):
                    try:
                        res = list(scorer(chunk))
                        if len(res) != len(chunk):
                            raise ValueError("scorer returned a wrong number of results")
                        break
                    except Exception:  # noqa: BLE001 - any model failure defaults the batch
                        res = None
                        time.sleep(backoff * attempt)
                res = res or [(NEGATIVE, 0.0)] * len(chunk)
                labels += [r[0] for r in res]
                scores += [float(r[1]) for r in res]
            yield pdf.assign(label=labels, score=scores)

    return df.mapInPandas(run, schema)


def contains_positive_scorer() -> Callable[[list[str]], list[tuple[str, float]]]:
    """The single-text reply rule: 'positive' in the lower-cased text."""
    def score(texts: list[str]) -> list[tuple[str, float]]:
        return [(POSITIVE, 1.0) if "positive" in t.strip().lower() else (NEGATIVE, 0.0) for t in texts]
    return score
