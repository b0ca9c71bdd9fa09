"""The pipeline's stages one after another, each against a brute-force version
of its operator over what the stage before it kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from partnerlens.llm.common import scratch
from tests.conftest import SF_SMALL
from tests.llm.test_operators import (brute_components, brute_counts, brute_dedup, brute_fingerprint, check_pieces, null_id_rows,
                                      odd_docs)


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(scratch(stage(spark, out[-1], SF_SMALL), "stage"))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.columns[:5] == stages[0].columns and set(df.columns) <= {*stages[0].columns, "mix_position"}
        assert dict(df.dtypes[:5]) == dict(stages[0].dtypes)


def test_quality_stage(spark, stages):
    before, after = texts(stages[0]), texts(stages[1])
    for i, t in before.items():
        c = brute_counts(t)
        if c[0] < 20 or 100 * c[4] > 30 * c[0]:
            assert i not in after
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    assert not any(q == 0 and i in after for i, q in label.items())
    for i, q in label.items():
        c = brute_counts(before[i])
        assert q == 0 or i in after or c[0] < 20 or 100 * c[4] > 30 * c[0]
    assert all(before[i] == t for i, t in after.items())


def test_near_duplicate_stage(stages):
    before, after = texts(stages[1]), texts(stages[2])
    root = brute_components({i: brute_fingerprint(t) for i, t in before.items()})
    assert set(after) == {i for i, r in root.items() if i == r}


def test_near_duplicate_stage_without_ids(spark):
    rows = null_id_rows()
    df = spark.createDataFrame([(i, t, "en", None, len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, df, SF_SMALL)
    assert out.columns == corpus_pipeline.COLUMNS and out.dtypes == df.dtypes
    got = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert out.count() == 3 and got == {rows[2], rows[6], min(rows[3:5], key=lambda x: x[1])}


def test_passage_stage(stages):
    before, rows = texts(stages[2]), stages[3].collect()
    want = brute_dedup(list(before.items()))
    assert len(rows) == len(before)
    for r in rows:
        n, gone, kept = want[r["doc_id"]]
        assert r["text"] == (kept if gone else before[r["doc_id"]]) and r["n_chars"] == len(r["text"])


def test_mixing_and_packing_stages(stages):
    rows = stages[4].collect()
    assert texts(stages[4]) == texts(stages[3]) and len({r["mix_position"] for r in rows}) == len(rows)
    room, used = check_pieces(stages[5].collect(), [(r["doc_id"], r["text"]) for r in rows])
    assert room - used <= 2048 * 8


def test_run_and_odd_rows(spark, stages):
    assert corpus_pipeline.run(spark, SF_SMALL).count() == stages[5].count()
    docs = odd_docs(spark).select(*corpus_pipeline.COLUMNS)
    for start in (docs, docs.filter(F.lit(False))):
        df = start
        for _, stage in corpus_pipeline.STAGES:
            df = scratch(stage(spark, df, SF_SMALL), "stage")
        assert df.filter("length < 1").count() == 0


def test_rows_with_repeated_ids_are_judged_one_by_one(spark):
    """Junk does not pass with a good text of its id, a unique text does not go
    with a near copy of its id, and equal rows are cut to one."""
    words = [f"lantern{i % 50} river{i} stone{i % 31} morning{i * 7 % 97}" for i in range(40)]
    good, other, third = (" ".join(words[a:] + words[:a]) + f" tail{a}" for a in (0, 11, 23))
    junk = "## $$ %% && ** " * 30
    rows = [(1, good), (1, junk), (None, other), (None, junk), (2, third), (2, third), (3, good), (3, other + " and more words of its own here")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.quality_rules(spark, df, SF_SMALL)
    assert kept.columns == corpus_pipeline.COLUMNS and junk not in {r["text"] for r in kept.collect()}
    assert kept.count() == 6
    fp = {t: brute_fingerprint(t) for _, t in rows}
    out = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, kept, SF_SMALL).collect()]
    assert len(set(out)) == len(out)
    texts = [t for _, t in rows if t != junk]
    root = brute_components({i: fp[t] for i, t in enumerate(texts)})
    assert len(out) == len(set(root.values())) and (1, good) in out and (2, third) in out and (3, good) not in out
