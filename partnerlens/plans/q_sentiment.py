"""Registered queries: feedback sentiment (scoring, evaluation, prompts, replies)."""

from __future__ import annotations

from pyspark.sql import functions as F

from partnerlens.functions.scalar import fn_label_contains, hash_key_sql, hash_pct_sql
from partnerlens.operators.split import sample_rows, split_random
from partnerlens.plans import sentiment as st
from partnerlens.plans.evaluate import classification_report
from partnerlens.plans.registry import finalize, fixed_text_sql, register, sql_final
from partnerlens.session import stored
from partnerlens.sources.bindings import FEEDBACK_SQL, feedback
from partnerlens.sources.tables import table

ID, TEXT, LABEL = "Feedback_ID", "Feedback_Text", "Sentiment"


def scored(spark, d, alpha: float = 1.0):
    """All texts scored by weights learnt on the labelled train split, and the
    labelled texts held out of it."""
    fb = feedback(spark, d)
    train, test = split_random(fb.filter(F.col(LABEL).isNotNull()), ID)
    w, prior = st.train_token_weights(train, ID, TEXT, LABEL, alpha)
    return fb, test, st.score_with_weights(fb, ID, TEXT, w, prior), w


def _scorer_sql(alpha: str = "1.0", suffix: str = "") -> str:
    """CTEs: token weights learnt on the train split and test scores."""
    s = suffix
    return f"""
tr{s} AS (SELECT * FROM feedback WHERE Sentiment IS NOT NULL AND {hash_pct_sql('Feedback_ID')} >= 20),
he{s} AS (SELECT Feedback_ID FROM feedback WHERE Sentiment IS NOT NULL AND {hash_pct_sql('Feedback_ID')} < 20),
te{s} AS (SELECT * FROM feedback),
tk{s} AS (SELECT Feedback_ID, token, count(*) AS n FROM (
          SELECT Feedback_ID, unnest(regexp_split_to_array(lower(Feedback_Text), '[^\\p{{L}}\\p{{N}}]+')) AS token
          FROM tr{s}) x WHERE token <> '' GROUP BY Feedback_ID, token),
cnt{s} AS (SELECT token, sum(CASE WHEN f.Sentiment = 'Positive' THEN n ELSE 0 END) AS cp,
                 sum(CASE WHEN f.Sentiment <> 'Positive' THEN n ELSE 0 END) AS cn
          FROM tk{s} JOIN tr{s} f ON tk{s}.Feedback_ID = f.Feedback_ID GROUP BY token),
tot{s} AS (SELECT sum(cp) AS np, sum(cn) AS nn, count(*) AS v FROM cnt{s}),
w{s} AS (SELECT token, ln((cp + {alpha}) / (np + {alpha} * v)) - ln((cn + {alpha}) / (nn + {alpha} * v)) AS w
        FROM cnt{s}, tot{s}),
pr{s} AS (SELECT ln((sum(CASE WHEN Sentiment = 'Positive' THEN 1 ELSE 0 END) + {alpha})
                 / (sum(CASE WHEN Sentiment <> 'Positive' THEN 1 ELSE 0 END) + {alpha})) AS prior FROM tr{s}),
ttk{s} AS (SELECT Feedback_ID, token, count(*) AS n FROM (
          SELECT Feedback_ID, unnest(regexp_split_to_array(lower(Feedback_Text), '[^\\p{{L}}\\p{{N}}]+')) AS token
          FROM te{s}) x WHERE token <> '' GROUP BY Feedback_ID, token),
ss{s} AS (SELECT ttk{s}.Feedback_ID, sum(n * w) AS s FROM ttk{s} JOIN w{s} ON ttk{s}.token = w{s}.token
         GROUP BY ttk{s}.Feedback_ID),
sc{s} AS (SELECT t.Feedback_ID, t.Sentiment, t.Partner_id,
               1 / (1 + exp(-(pr{s}.prior + coalesce(ss{s}.s, 0.0)))) AS score
        FROM te{s} t LEFT JOIN ss{s} ON t.Feedback_ID = ss{s}.Feedback_ID, pr{s}),
lab{s} AS (SELECT *, Feedback_ID IN (SELECT Feedback_ID FROM he{s}) AS held, CASE WHEN score >= 0.5 THEN 'Positive' ELSE 'Negative' END AS label FROM sc{s})"""


SCORER_SQL = "WITH" + FEEDBACK_SQL + "," + _scorer_sql()


@register("token_weight_scorer", sql_final(SCORER_SQL + "\nSELECT Feedback_ID, score, label FROM lab", [
    ("Feedback_ID", "int"), ("score", "double"), ("label", "text")]))
def q_token_weight_scorer(spark, d):
    """Token-weight sentiment scores of all feedback (whole texts)."""
    _, _, s, _ = scored(spark, d)
    return finalize(s)


def _report_sql(src: str, model: str | None = None) -> str:
    g = f"{model}, " if model else ""
    gb = f"GROUP BY {model}" if model else ""
    onx = f"AND l.{model} = x.{model}" if model else ""
    ony = f"AND l.{model} = y.{model}" if model else ""
    return f"""
rlabels AS (SELECT DISTINCT {g}label FROM (SELECT {g}t AS label FROM {src} UNION ALL SELECT {g}p FROM {src}) u
            WHERE label IS NOT NULL),
rper AS (
  SELECT l.*, coalesce(x.tp, 0) AS tp, coalesce(x.sup, 0) AS support, coalesce(y.np, 0) AS npred
  FROM rlabels l
  LEFT JOIN (SELECT {g}t AS label, count(*) AS sup, sum(CASE WHEN t = p THEN 1 ELSE 0 END) AS tp FROM {src}
             GROUP BY {g}t) x ON l.label = x.label {onx}
  LEFT JOIN (SELECT {g}p AS label, count(*) AS np FROM {src} GROUP BY {g}p) y ON l.label = y.label {ony}
),
rper2 AS (
  SELECT *, CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM rper),
rper3 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END
          AS f1 FROM rper2),
rtot AS (SELECT {g}sum(tp) AS tp, sum(support) AS n, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
                sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf
         FROM rper3 {gb}),
report AS (
  SELECT {g}label, precision, recall, f1 AS "f1-score", CAST(support AS DOUBLE) AS support FROM rper3
  UNION ALL SELECT {g}'accuracy', tp / n, tp / n, tp / n, n FROM rtot
  UNION ALL SELECT {g}'macro avg', mp, mr, mf, n FROM rtot
  UNION ALL SELECT {g}'weighted avg', wp / n, wr / n, wf / n, n FROM rtot
)"""


REPORT_COLS = [("label", "text"), ("precision", "double"), ("recall", "double"), ("f1-score", "double"),
               ("support", "double")]


@register("sentiment_eval", sql_final(SCORER_SQL + ",\nev AS (SELECT Sentiment AS t, label AS p FROM lab WHERE held)," +
                                      _report_sql("ev") + "\nSELECT * FROM report", REPORT_COLS))
def q_sentiment_eval(spark, d):
    """Classification report of the token-weight scorer against the labels."""
    _, test, s, _ = scored(spark, d)
    ev = test.select(ID, LABEL).join(s, ID)
    return finalize(classification_report(ev, LABEL, "label"))


def classified(spark, d):
    """All texts classified by a model fitted on the labelled train split, and
    the labelled texts held out of it.  Texts are taken apart once, for the fit
    and for the classification."""
    fb = stored(st.token_features(feedback(spark, d), TEXT).select(ID, LABEL, "features"))
    train, test = split_random(fb.filter(F.col(LABEL).isNotNull()), ID)
    return test, st.classify(fb, ID, TEXT, st.train_classifier(train, TEXT, LABEL))


@register("text_classifier")
def q_text_classifier(spark, d):
    """Sentiment of all feedback by the trained classifier (iterative fit, so without an SQL twin)."""
    return finalize(classified(spark, d)[1])


@register("text_classifier_eval")
def q_text_classifier_eval(spark, d):
    """Classification report of the trained classifier on held-out labels."""
    test, s = classified(spark, d)
    return finalize(classification_report(test.select(ID, LABEL).join(s, ID), LABEL, "label"))


@register("classification_report", sql_final(
    "WITH" + FEEDBACK_SQL + "," + _scorer_sql("1.0", "") + "," + _scorer_sql("5.0", "5") + """,
ev AS (SELECT 'alpha_1' AS model, Sentiment AS t, label AS p FROM lab WHERE held
       UNION ALL SELECT 'alpha_5', Sentiment, label FROM lab5 WHERE held),""" + _report_sql("ev", "model") +
    "\nSELECT * FROM report", [("model", "text")] + REPORT_COLS))
def q_classification_report(spark, d):
    """Reports for several models in one job (two smoothing strengths of the token scorer)."""
    fb = feedback(spark, d)
    train, test = split_random(fb.filter(F.col(LABEL).isNotNull()), ID)
    models = {f"alpha_{a}": st.train_token_weights(train, ID, TEXT, LABEL, float(a)) for a in (1, 5)}
    ev = st.score_with_models(fb, ID, TEXT, models).join(test.select(ID, LABEL), ID)
    return finalize(classification_report(ev, LABEL, "label", model_col="model"))


@register("token_attribution", sql_final(SCORER_SQL + f""",
pick AS (SELECT Feedback_ID FROM he ORDER BY {hash_key_sql('Feedback_ID')}, Feedback_ID LIMIT 3)
SELECT ttk.Feedback_ID, ttk.token, ttk.n, w.w, ttk.n * w.w AS contribution
FROM ttk JOIN w ON ttk.token = w.token WHERE ttk.Feedback_ID IN (SELECT Feedback_ID FROM pick)""",
    [("Feedback_ID", "int"), ("token", "text"), ("n", "int"), ("w", "double"), ("contribution", "double")]))
def q_token_attribution(spark, d):
    """Per-token contributions to the score of 3 sampled held-out texts (exact for this scorer)."""
    _, test, _, w = scored(spark, d)
    picked = sample_rows(test.select(ID, TEXT), ID, 3)
    return finalize(st.token_attribution(picked, ID, TEXT, w))


BATCH_SQL = "WITH" + FEEDBACK_SQL + """,
bn AS (SELECT *, row_number() OVER (ORDER BY Feedback_ID) AS rn FROM feedback),
bt AS (SELECT *, CAST((rn - 1) // 50 AS BIGINT) AS batch_id, CAST((rn - 1) % 50 + 1 AS INTEGER) AS pos FROM bn)"""


@register("batch_number", sql_final(BATCH_SQL + "\nSELECT Feedback_ID, batch_id, pos FROM bt",
                                    [("Feedback_ID", "int"), ("batch_id", "int"), ("pos", "int")]))
def q_batch_number(spark, d):
    """Consecutive batches of 50 feedback rows in id order."""
    return finalize(st.batch_number(feedback(spark, d), ID).select(ID, "batch_id", "pos"))


@register("llm_batch_prompts", sql_final(BATCH_SQL + """
SELECT batch_id, '""" + st.PROMPT_HEAD.replace("'", "''") + """' ||
       string_agg(CAST(pos AS VARCHAR) || '. ' || coalesce(Feedback_Text, ''), chr(10) || chr(10) ORDER BY pos) AS prompt
FROM bt GROUP BY batch_id""", [("batch_id", "int"), ("prompt", "text")]))
def q_llm_batch_prompts(spark, d):
    """One numbered prompt per batch of 50 feedback texts."""
    return finalize(st.batch_prompts(st.batch_number(feedback(spark, d), ID), TEXT))


@register("llm_parse_replies", sql_final(SCORER_SQL + """,
bn AS (SELECT *, row_number() OVER (ORDER BY Feedback_ID) AS rn FROM lab),
bt AS (SELECT *, CAST((rn - 1) // 50 AS BIGINT) AS batch_id, CAST((rn - 1) % 50 + 1 AS INTEGER) AS pos FROM bn)
SELECT Feedback_ID, batch_id, pos, CASE WHEN Feedback_ID % 11 = 3 THEN 'Negative' ELSE label END AS label,
       CASE WHEN Feedback_ID % 11 = 3 THEN 0.0 ELSE CAST(""" + fixed_text_sql("score", 2) + """ AS DOUBLE) END AS score FROM bt""",
    [("Feedback_ID", "int"), ("batch_id", "int"), ("pos", "int"), ("label", "text"), ("score", "double")]))
def q_llm_parse_replies(spark, d):
    """Replies in the 'n: Label, score' protocol (replayed from stored scores, one line in eleven spoiled) parsed and
    re-attached by position."""
    _, _, s, _ = scored(spark, d)
    b = st.batch_number(s, ID)
    parsed = st.parse_replies(st.reply_text(b, F.pmod(F.col(ID), F.lit(11)) == 3))
    out = st.attach_replies(b.select(ID, "batch_id", "pos"), parsed)
    return finalize(out.select(ID, "batch_id", "pos", "label", "score"))


@register("sentiment_enrich", sql_final(SCORER_SQL + """
SELECT s.s_suppkey AS Partner_id, s.s_name, l.Feedback_ID, l.label AS gpt_prediction, l.score AS Feedback_Score_model
FROM supplier s LEFT JOIN lab l ON s.s_suppkey = l.Partner_id""",
    [("Partner_id", "int"), ("s_name", "text"), ("Feedback_ID", "int"), ("gpt_prediction", "text"),
     ("Feedback_Score_model", "double")]))
def q_sentiment_enrich(spark, d):
    """Partners left-joined with their scored feedback (model score under its own name)."""
    fb, _, s, _ = scored(spark, d)
    sc = s.join(fb.select(ID, "Partner_id"), ID)
    sup = table(spark, d, "supplier").select(F.col("s_suppkey").alias("Partner_id"), "s_name")
    out = sup.join(sc, "Partner_id", "left").select(
        "Partner_id", "s_name", ID, F.col("label").alias("gpt_prediction"),
        F.col("score").alias("Feedback_Score_model"))
    return finalize(out)


@register("score_text_batches", sql_final("""
SELECT doc_id, CASE WHEN contains(lower(trim(text)), 'positive') THEN 'Positive' ELSE 'Negative' END AS label,
       CASE WHEN contains(lower(trim(text)), 'positive') THEN 1.0 ELSE 0.0 END AS score
FROM documents""", [("doc_id", "int"), ("label", "text"), ("score", "double")]))
def q_score_text_batches(spark, d):
    """Arrow-batched scoring surface (50 texts per call) over every document, with the reply rule as scorer."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = st.score_text_batches(docs, "text", st.contains_positive_scorer)
    return finalize(out.select("doc_id", "label", "score"))


@register("fn_label_contains", sql_final("""
SELECT conv_id, turn, CASE WHEN contains(lower(trim(text)), 'positive') THEN 'Positive' ELSE 'Negative' END AS label
FROM conversations WHERE role = 'assistant'""", [("conv_id", "int"), ("turn", "int"), ("label", "text")]))
def q_fn_label_contains(spark, d):
    """Label of a free-text model reply: Positive if it mentions 'positive'."""
    c = table(spark, d, "conversations").filter(F.col("role") == "assistant")
    return finalize(c.select("conv_id", "turn", fn_label_contains("text").alias("label")))
