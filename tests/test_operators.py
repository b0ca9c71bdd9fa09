"""Unit tests on tiny literal DataFrames: edge cases and brute-force checks."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from partnerlens.functions.scalar import fn_demand_response, fn_hash_pct, fn_price_bucket_label
from partnerlens.operators.clean import catalog_of, clean_sales, onehot_decode, onehot_encode
from partnerlens.operators.joins import heavy_join
from partnerlens.operators.similarity import cosine_topk, jaccard_pairs, topn_similar
from partnerlens.operators.split import global_row_number, rank_within, split_random, split_stratified
from partnerlens.plans import discount as dd
from partnerlens.plans.evaluate import classification_report, prf_at_k
from partnerlens.plans.recommend import rec_item_based
from partnerlens.plans.schemes import list_to_text, multilabel_binarize, parse_list_col, scheme_rank_simple, zip_arrays
from partnerlens.plans.sentiment import parse_replies, score_text_batches


def test_onehot_decode_ties_and_all_zero(spark):
    df = spark.createDataFrame([(1, 0, 1, 1), (2, 0, 0, 0), (3, 1, 0, 0)], "id int, A int, B int, C int")
    got = {r.id: r.Product_id for r in onehot_decode(df, ["A", "B", "C"]).collect()}
    assert got == {1: "B", 2: None, 3: "A"}          # first maximum; all-zero -> NULL
    first = {r.id: r.Product_id for r in onehot_decode(df, ["A", "B", "C"], all_zero="first").collect()}
    assert first[2] == "A"                             # reference parity: idxmax of zeros


def test_clean_sales_drops_bad_rows(spark):
    rows = [("p1", "2021-01-05", 10.0, 2.0, 5.0, "North", 9.0, 1, 0),
            ("p2", "not a date", 10.0, 2.0, 5.0, "North", 9.0, 1, 0),
            ("p3", "2021-02-01", None, 2.0, 5.0, "North", 9.0, 0, 1),
            ("p4", "2021-02-01", 0.0, 2.0, 5.0, "North", 9.0, 0, 1),
            ("p5", "2021-02-01", 10.0, 0.0, 5.0, "North", 9.0, 0, 1)]
    df = spark.createDataFrame(rows, "Partner_id string, Date string, MRP double, "
                               "Sales_Quantity_Last_Period double, Discount_Applied double, Geography string, "
                               "Competitor_Price double, X int, Y int")
    out = clean_sales(df, ["X", "Y"]).collect()
    assert [r.Partner_id for r in out] == ["p1"]
    assert out[0].Product_id == "X" and out[0].Price == 10.0


def test_price_bucket_label_and_demand_response(spark):
    df = spark.createDataFrame([(2537.96, 2784.72, 100.0, -0.0761, 10), (1.005, 2.0, 50.0, None, 60)],
                               "lo double, hi double, d double, e double, disc int")
    r = df.select(fn_price_bucket_label("lo", "hi").alias("l"),
                  fn_demand_response("d", "e", "disc").alias("p")).collect()
    assert r[0].l == "2537.96-2784.72"
    assert math.isclose(r[0].p, 100.0 * 0.9 ** -0.0761)
    assert math.isclose(r[1].p, 50.0 * 0.5 ** -0.2)   # clipped to 50 %, default elasticity


def test_price_buckets_single_price_and_edges(spark):
    panel = spark.createDataFrame(
        [("A", "N", p, 1.0) for p in (1.0, 2.0, 3.0, 5.0)] + [("B", "S", 7.0, 3.0), ("B", "S", 7.0, 5.0)],
        "Product_id string, Geography string, Price double, Demand double")
    b = {(r.Product_id, r.Price): r.bucket for r in dd.price_buckets(panel).collect()}
    assert b[("A", 1.0)] == 1 and b[("A", 2.0)] == 1 and b[("A", 3.0)] == 2 and b[("A", 5.0)] == 4
    assert b[("B", 7.0)] == 1


def test_optimal_discount_zero_for_inelastic(spark):
    sim = spark.createDataFrame([("A", "N", 1, "1.00-2.00", 1.5, d, 10.0, 10.0 * (1 - d / 100) ** -0.0761, 0.0,
                                  -0.0761) for d in range(0, 55, 5)],
                                "product string, region string, bucket int, price_bucket string, price_midpoint "
                                "double, discount_pct int, original_avg_demand double, predicted_demand double, "
                                "demand_change_pct double, elasticity_used double")
    best = dd.optimal_discounts(sim).collect()
    assert len(best) == 1 and best[0].optimal_discount_pct == 0


def _brute_cosine(vecs: dict, k: int):
    ids = sorted(vecs)
    out = {}
    for q in ids:
        cands = []
        for c in ids:
            if c == q:
                continue
            a, b = vecs[q], vecs[c]
            den = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
            s = sum(x * y for x, y in zip(a, b)) / den if den > 0 else 0.0
            cands.append((-round(s, 12), c, s))
        cands.sort()
        out[q] = [(c, s) for _, c, s in cands[:k]]
    return out


def test_cosine_topk_matches_brute_force_with_ties_and_zero_vectors(spark):
    rng = np.random.default_rng(1)
    vecs = {i: [float(x) for x in (rng.random(4) < 0.5)] for i in range(60)}
    vecs[60] = [0.0, 0.0, 0.0, 0.0]                     # zero vector
    rows = [(i, f"d{j}", v) for i, vec in vecs.items() for j, v in enumerate(vec) if v != 0 or j == 0]
    df = spark.createDataFrame(rows, "id long, dim string, val double")   # every id present
    got = {}
    for r in cosine_topk(df, 3, block_rows=16).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.cid, r.sim))
    want = _brute_cosine(vecs, 3)
    assert set(got) == set(want)
    for q in want:
        assert [c for c, _ in got[q]] == [c for c, _ in want[q]], q
        assert all(math.isclose(a, b, abs_tol=1e-12) for (_, a), (_, b) in zip(got[q], want[q]))


def test_cosine_topk_groups_are_independent(spark):
    rows = [(g, i, "x", float(i + 1)) for g in ("a", "b") for i in range(5)] + [("b", 9, "y", 1.0)]
    df = spark.createDataFrame(rows, "variant string, id long, dim string, val double")
    nn = cosine_topk(df, 2, group_cols=["variant"], block_rows=2)
    per = {(r.variant, r.qid): r.cid for r in nn.filter("rank = 1").collect()}
    assert all(per[("a", q)] != 9 for q in range(5))
    assert per[("b", 9)] == 0                     # orthogonal to all -> sim 0, lowest id


def test_cosine_topk_through_pivots_is_exact(spark):
    rng = np.random.default_rng(5)
    vecs = {i: [float(x) for x in rng.integers(-1, 6, 4)] for i in range(400)}
    vecs |= {i: vecs[i % 5] for i in range(400, 460)}           # few classes with many ids
    vecs |= {i: [0.0] * 4 for i in range(460, 465)}
    rows = [(g, i, f"d{j}", v) for g in "ab" for i, vec in vecs.items() for j, v in enumerate(vec)
            if g == "a" or i % 2]
    rows += [("a", None, "d0", 1.0), ("a", 3, None, 1.0)]       # take no part
    df = spark.createDataFrame(rows, "variant string, id long, dim string, val double")
    got = {}
    for r in cosine_topk(df, 4, group_cols=["variant"], block_rows=16).collect():
        got.setdefault(r.variant, {}).setdefault(r.qid, {})[r.rank] = r.cid
    for g, ids in (("a", vecs), ("b", {i: v for i, v in vecs.items() if i % 2})):
        want = {q: {n + 1: c for n, (c, _) in enumerate(x)} for q, x in _brute_cosine(ids, 4).items()}
        assert got[g] == want


def test_cosine_topk_other_queries_and_empty_tables(spark):
    schema = "id long, dim string, val double"
    cand = spark.createDataFrame([(i, f"d{j}", float((i * 7 + j * 3) % 5)) for i in range(50) for j in range(3)], schema)
    query = spark.createDataFrame([(i, f"d{j}", float((i * 7 + j * 3) % 5)) for i in range(40, 60) for j in range(3)],
                                  schema)
    own = cosine_topk(cand, 2, query=query, exclude_self=False, block_rows=8).filter("rank = 1").collect()
    assert len(own) == 20 and all(r.sim == pytest.approx(1.0) and r.cid == r.qid % 5 for r in own)
    none = spark.createDataFrame([], schema)
    assert cosine_topk(none, 2).count() == 0
    assert cosine_topk(cand, 2, query=none, exclude_self=False).count() == 0
    assert cosine_topk(none, 2, query=query, exclude_self=False).count() == 0


def test_bucket_bound_leaves_most_buckets_out():
    from partnerlens.operators.similarity import _place, _reach, _unit
    rng = np.random.default_rng(2)
    share = []
    for n in (2000, 8000, 32000):
        m = rng.random((n, 4))
        pdf = pd.DataFrame({"rep": np.arange(n), "dis": [np.arange(4)] * n, "vals": list(m)})
        p = math.ceil(math.sqrt(n))
        pivots = {(): _unit(pdf["dis"][:p], pdf["vals"][:p], 4)}
        placed = pd.concat(_place(pivots, [], 4)([pdf]))
        radius = {(): placed.groupby("bucket")["angle"].max().to_dict()}
        size = placed["bucket"].value_counts()
        met = sum(size[b["bucket"]].sum() for b in _reach(pivots, radius, [], 4, 2)([pdf[:500]]))
        share.append(met / 500 / n)
    assert share[0] < 0.5 and share[1] < 0.7 * share[0] and share[2] < 0.7 * share[1]


def test_jaccard_tiles_agree(spark, monkeypatch):
    from partnerlens.operators import similarity
    pairs = spark.createDataFrame([(f"s{(i * 13) % 11}", (i * 7) % 17) for i in range(120)], "s string, e int")
    whole = sorted(map(tuple, jaccard_pairs(pairs, "s", "e").collect()))
    monkeypatch.setattr(similarity, "TILE_SETS", 3)
    assert sorted(map(tuple, jaccard_pairs(pairs, "s", "e").collect())) == whole and whole


def test_jaccard_and_topn_similar_fill_zeros(spark):
    pairs = spark.createDataFrame([("A", 1), ("A", 2), ("B", 2), ("B", 3), ("C", 9), ("D", 1)],
                                  "s string, e int")
    j = {(r.a, r.b): r.jaccard for r in jaccard_pairs(pairs, "s", "e").collect()}
    assert j[("A", "B")] == pytest.approx(1 / 3) and j[("A", "D")] == pytest.approx(1 / 2)
    assert ("A", "C") not in j
    top = topn_similar(jaccard_pairs(pairs, "s", "e"), pairs.select(F.col("s").alias("item")), 3)
    c = [(r.b, r.sim) for r in top.filter("a = 'C'").orderBy("rank").collect()]
    assert c == [("A", 0.0), ("B", 0.0), ("D", 0.0)]     # no overlap: zeros in name order


def test_rank_within_exact_under_skew(spark):
    rows = [("hot", i) for i in range(3000)] + [(f"k{i}", i) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, v long")
    from partnerlens.functions.scalar import fn_hash_key
    r = rank_within(df, ["g"], fn_hash_key("v"), "v", "rn", salt_bits=6).toPandas()
    hot = r[r.g == "hot"].copy()
    assert sorted(hot.rn) == list(range(1, 3001))
    assert hot.rn_n.unique().tolist() == [3000]


def test_global_row_number_is_a_permutation(spark):
    df = spark.range(0, 5000, 7).withColumnRenamed("id", "v")
    r = global_row_number(df, F.col("v"), "v", "rn").orderBy("v").toPandas()
    assert r.rn.tolist() == list(range(1, len(r) + 1))


def test_split_stratified_partition(spark):
    rows = [(p, f"{p}-{i}") for p in ("a", "b", "c") for i in range({"a": 10, "b": 1, "c": 5}[p])]
    df = spark.createDataFrame(rows, "Partner_id string, row_key string")
    tr, te = split_stratified(df, "row_key", "Partner_id")
    a, b = {r.row_key for r in tr.collect()}, {r.row_key for r in te.collect()}
    assert not (a & b) and len(a | b) == 16
    per = pd.Series([k.split("-")[0] for k in a]).value_counts().to_dict()
    assert per == {"a": 8, "b": 1, "c": 4}                # ceil(0.8 n) per stratum


def test_hash_pct_is_stable(spark):
    import duckdb
    from partnerlens.functions.scalar import hash_pct_sql
    s = [r.h for r in spark.range(20).select(fn_hash_pct("id").alias("h")).orderBy("id").collect()]
    d = [r[0] for r in duckdb.sql(f"SELECT {hash_pct_sql('range')} FROM range(20) ORDER BY range").fetchall()]
    assert s == d


def test_parse_list_col_and_zip(spark):
    df = spark.createDataFrame([("p", "['A', 'B']", "[0.5, 0.25, 0.1]"), ("q", "oops", "[1.0]"),
                                ("r", "[]", "[]")], "Partner_id string, Recommended_Products string, "
                                                     "Similarity_Scores string")
    p = parse_list_col(parse_list_col(df, "Recommended_Products"), "Similarity_Scores", "double")
    got = {r.Partner_id: r.Recommended_Products for r in p.collect()}
    assert got == {"p": ["A", "B"], "q": None, "r": []}
    z = zip_arrays(p).collect()
    assert [(r.Product_id, r.Similarity_Scores) for r in z] == [("A", 0.5), ("B", 0.25)]


def test_parse_list_col_quotes_none_and_escapes(spark):
    rows = [(1, '["O\'Brien", \'B\']'), (2, "['A', None]"), (3, r'''['say "x"', 'it\'s']'''), (4, "plain")]
    df = spark.createDataFrame(rows, "i int, c string")
    got = {r.i: r.c for r in parse_list_col(df, "c").collect()}
    assert got == {1: ["O'Brien", "B"], 2: ["A", None], 3: ['say "x"', "it's"], 4: None}
    back = spark.createDataFrame([(1, ["O'Brien", None, 'q"\\'])], "i int, c array<string>").select("i", list_to_text("c").alias("c"))
    assert parse_list_col(back, "c").first().c == ["O'Brien", None, 'q"\\']


def test_rank_within_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, v long")
    got = sorted((r.g or "", r.v, r.rn) for r in rank_within(df, ["g"], F.col("v"), "v").collect())
    assert got == [("", 1, 1), ("", 2, 2), ("a", 3, 1)]


def test_global_row_number_spreads_sparse_keys(spark):
    df = spark.createDataFrame([(i,) for i in range(2000)] + [(10 ** 15,), (None,)], "v long")
    got = [r.rn for r in global_row_number(df, F.col("v"), "v", "rn").orderBy(F.col("v").asc_nulls_first()).collect()]
    assert got == list(range(1, 2003))


def test_heavy_join_hot_and_cold(spark):
    big = spark.createDataFrame([("a", i) for i in range(400)] + [("b", 1), ("c", 2), (None, 3)], "k string, i int")
    small = spark.createDataFrame([("a", 400, 1.0), ("b", 1, 2.0), ("d", 1, 3.0)], "k string, n long, w double")
    got = heavy_join(big, small, "k", "n", F.lit(402), heavy=5).groupBy("k").agg(F.count("w").alias("c")).collect()
    assert {r.k: r.c for r in got} == {"a": 400, "b": 1}


def test_parse_replies_malformed_lines(spark):
    text = "1: Positive, 0.9\n\n2 Negative 0.1\n3: Negative\n4: Positive, high\n5: Negative, 0.2\n5: Positive, 0.8"
    got = {r.pos: (r.label, r.score) for r in parse_replies(spark.createDataFrame([(0, text), (1, None)], "batch_id int, reply string")).collect()}
    assert got == {1: ("Positive", 0.9), 3: ("Negative", 0.0), 4: ("Negative", 0.0), 5: ("Negative", 0.2)}


def test_multilabel_binarize_has_zeros(spark):
    df = spark.createDataFrame([("s", "p"), ("t", "p"), ("t", "q"), ("t", "q")], "r string, l string")
    got = {(x.r, x.l): x.flag for x in multilabel_binarize(df, "r", "l").collect()}
    assert got == {("s", "p"): 1, ("t", "p"): 1, ("s", "q"): 0, ("t", "q"): 1}


def test_scheme_rank_simple_splits_cells_and_pads(spark):
    rows = [(1, "P", "A, B", 5.0), (2, "P", "B", 1.0), (3, "P", None, 9.0), (4, "Q", "C", 2.0)]
    df = spark.createDataFrame(rows, "Partner_id int, Product_id string, Scheme_Type string, "
                                     "Sales_Quantity_Last_Period double")
    got = {r.Product_id: (r.n_partners, r.Scheme_1, r.Scheme_2, r.Scheme_3) for r in scheme_rank_simple(df).collect()}
    assert got["P"] == (3, "B", "A", "No Scheme Available")
    assert got["Q"] == (1, "C", "No Scheme Available", "No Scheme Available")


def test_prf_at_k_counts_empty_recommendations(spark):
    truth = spark.createDataFrame([("u1", ["a", "b"]), ("u2", ["c"]), ("u3", [])], "Partner_id string, actual array<string>")
    recs = spark.createDataFrame([("u1", ["a", "x", "b"])], "Partner_id string, recommended array<string>")
    m = {r["Top-K"]: r for r in prf_at_k(truth, recs).collect()}
    assert m[1]["Avg Precision"] == 0.5 and m[1]["Avg Recall"] == 0.25
    assert m[3]["Avg Precision"] == pytest.approx(round((2 / 3) / 2, 4))
    assert m[3]["Avg Recall"] == 0.5


def test_classification_report_matches_manual(spark):
    df = spark.createDataFrame([("P", "P"), ("P", "N"), ("N", "N"), ("N", "N")], "t string, p string")
    rep = {r.label: r for r in classification_report(df, "t", "p").collect()}
    assert rep["P"].precision == 1.0 and rep["P"].recall == 0.5
    assert rep["N"].precision == pytest.approx(2 / 3) and rep["N"].recall == 1.0
    assert rep["accuracy"].precision == 0.75 and rep["accuracy"].support == 4


def test_parse_replies_defaults(spark):
    replies = spark.createDataFrame([(0, "1: Positive, 0.9\n2: Negative\n\nno number here\n3: Positive, x"),
                                     (1, None)], "batch_id long, reply string")
    got = {(r.batch_id, r.pos): (r.label, r.score) for r in parse_replies(replies).collect()}
    assert got == {(0, 1): ("Positive", 0.9), (0, 2): ("Negative", 0.0), (0, 3): ("Negative", 0.0)}


def test_score_text_batches_retries_then_defaults(spark):
    df = spark.createDataFrame([(i, "positive" if i % 2 else "meh") for i in range(7)], "id int, text string")

    def make():
        def score(texts):
            if len(texts) == 3:
                raise RuntimeError("model down")
            return [("Positive", 1.0) if "positive" in t else ("Negative", 0.0) for t in texts]
        return score
    out = score_text_batches(df.coalesce(1), "text", make, batch_size=3, backoff=0.0).orderBy("id").toPandas()
    assert out.label.tolist()[:6] == ["Negative"] * 6       # two failing full batches
    assert out.label.tolist()[6] == "Negative" and out.score.tolist()[6] == 0.0


def test_result_independent_of_shuffle_partitions(spark):
    from partnerlens.plans.registry import load_all
    q = load_all()["optimal_discounts"]
    from tests.conftest import SF_SMALL
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = sorted(map(tuple, q.fn(spark, SF_SMALL).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        b = sorted(map(tuple, q.fn(spark, SF_SMALL).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def test_jaccard_streamed_batches_match_single_batch(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{int(rng.integers(0, 6))}", int(rng.integers(0, 40))) for _ in range(300)]
    pairs = spark.createDataFrame(rows, "s string, e int")
    full = sorted(map(tuple, jaccard_pairs(pairs, "s", "e").collect()))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")   # elements span batches
        small = sorted(map(tuple, jaccard_pairs(pairs, "s", "e").collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    brute = {}
    sets = {}
    for s_, e_ in set(rows):
        sets.setdefault(s_, set()).add(e_)
    for a in sets:
        for b in sets:
            if a != b and sets[a] & sets[b]:
                brute[(a, b)] = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert full == small
    assert {(r[0], r[1]): r[5] for r in full} == pytest.approx(brute)


def test_optimal_discount_elastic_and_tie(spark):
    rows = [("p", "r", 1, "1-2", 10.0, d, 5.0, q) for d, q in ((0, 5.0), (25, 8.0), (50, 20.0))]        # 50, 60, 100
    rows += [("p", "r", 2, "2-3", 10.0, d, 4.0, q) for d, q in ((0, 4.0), (50, 8.0))]                    # 40, 40: a tie
    df = spark.createDataFrame(rows, "product string, region string, bucket int, price_bucket string, price_midpoint double, "
                                     "discount_pct int, original_avg_demand double, predicted_demand double")
    got = {r.price_bucket: r.optimal_discount_pct for r in dd.optimal_discounts(df).collect()}
    assert got == {"1-2": 50, "2-3": 0}


def test_shuffle_column_is_a_permutation_of_any_type(spark):
    from partnerlens.plans.explain import shuffle_column
    rows = [(f"k{i}", None if i % 11 == 0 else f"v{i % 37}") for i in range(500)]
    out = shuffle_column(spark.createDataFrame(rows, "row_key string, c string"), "c", repeats=3).collect()
    assert len(out) == 1500
    for rep in range(3):
        part = {r["row_key"]: r for r in out if r["rep"] == rep}
        assert len(part) == 500 and all(part[k]["c"] == v for k, v in rows)
        key = lambda x: (x is None, x)
        assert sorted((r["shuffled"] for r in part.values()), key=key) == sorted((v for _, v in rows), key=key)
        assert sum(r["shuffled"] != r["c"] for r in part.values()) > 400
    assert {(r["row_key"], r["shuffled"]) for r in out if r["rep"] == 0} != {(r["row_key"], r["shuffled"]) for r in out if r["rep"] == 1}


def test_compare_recs_reports_leftovers(spark):
    from partnerlens.plans.explain import compare_recs
    b = spark.createDataFrame([(1, "a", None), (2, "a", "b"), (3, "x", "y"), (None, "n", "n")], "k int, s string, t string")
    o = spark.createDataFrame([(1, "a", None), (2, "c", "d"), (4, "z", "z"), (None, "n", "m")], "k int, s string, t string")
    got = {(r["k"], r["status"], r["n_changed"]) for r in compare_recs(b, o, "k", ["s", "t"]).collect()}
    assert got == {(1, "matched", 0), (2, "matched", 2), (3, "only_base", None), (4, "only_other", None), (None, "matched", 1)}


def test_partner_lists_split_a_hot_product(spark):
    from collections import Counter, defaultdict
    from partnerlens.plans.schemes import partner_lists
    rows = [("hot" if i % 3 else None, i % 17, f"k{i}") for i in range(1000)] + [("x", None, "q"), ("x", 5, "r")]
    df = spark.createDataFrame(rows, "Product_id string, Partner_id int, row_key string")
    got = defaultdict(list)
    for r in partner_lists(df, size=100).collect():
        assert r["n_partners"] == len(r["Partner_ids"]) <= 100
        got[r["Product_id"]].append((r["chunk"], r["Partner_ids"]))
    for p in ("hot", None, "x"):
        want = Counter(a for q, a, _ in rows if q == p and a is not None)
        assert Counter(x for _, l in got[p] for x in l) == want
        sizes = [len(l) for _, l in sorted(got[p])]
        assert all(n == 100 for n in sizes[:-1]) and sorted(c for c, _ in got[p]) == list(range(len(sizes)))


def test_classifier_equals_a_numpy_fit(spark):
    """Coefficients against Newton's method on the same hashed features."""
    import numpy as np
    import random
    from partnerlens.plans import sentiment as st
    r = random.Random(2)
    good, bad = "nice fine great quick helpful".split(), "late broken rude slow missing".split()
    rows = []
    for i in range(240):
        own, other = (good, bad) if i % 4 else (bad, good)
        rows.append((i, " ".join(r.choice(own if r.random() < 0.8 else other) for _ in range(6)), "Positive" if i % 4 else "Negative"))
    df = spark.createDataFrame(rows + [(900, None, None), (901, "", None)], "id int, t string, y string")
    model = st.train_classifier(df, "t", "y", size=64, regularisation=0.01, tolerance=1e-12)
    feats = {x["id"]: x["features"].toArray() for x in st.token_features(df, "t", 64).collect()}
    x = np.array([[*feats[i], 1.0] for i, _, _ in rows])
    y = np.array([float(s == "Positive") for _, _, s in rows])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    b = np.zeros(65)
    penalty = np.r_[np.full(64, 0.01), 0.0]
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        grad = x.T @ (w * (p - y)) / w.sum() + penalty * b
        hess = (x * (w * p * (1 - p))[:, None]).T @ x / w.sum() + np.diag(penalty + 1e-12)
        b -= np.linalg.solve(hess, grad)
    assert np.allclose([*model.coefficients.toArray(), model.intercept], b, atol=2e-4)
    got = {x["id"]: x for x in st.classify(df, "id", "t", model).collect()}
    assert len(got) == 242 and np.allclose([got[i]["score"] for i, _, _ in rows], 1 / (1 + np.exp(-x @ b)), atol=1e-4)
    assert st.converged(model)
    with pytest.raises(ValueError):
        st.train_classifier(df.filter("y = 'Positive'"), "t", "y")


def test_classifier_takes_texts_apart_once_and_sums_by_core(spark, tmp_path, monkeypatch):
    """one pass over the texts for fit and classification; tasks of a round do not grow with the input's partitions."""
    from collections import Counter
    from pyspark.ml.classification import LogisticRegression
    from partnerlens.plans import q_sentiment as q, sentiment as st
    words = ["fine work quick", "late broken slow", "fine but late", "", None]
    docs = [(i, words[i % 5]) for i in range(120)]
    tables = {"documents": spark.createDataFrame(docs + [(7, "fine twice")], "doc_id bigint, text string"),
              "labels": spark.createDataFrame([(i, int(i % 5 != 1)) for i in range(90)], "doc_id bigint, quality int"),
              "supplier": spark.range(3).withColumnRenamed("id", "s_suppkey")}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    fitted, taken, fit, apart = [], [], LogisticRegression.fit, st.token_features
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, df: fitted.append(df.rdd.getNumPartitions()) or fit(self, df))
    monkeypatch.setattr(st, "token_features", lambda df, *a: taken.append("features" not in df.columns) or apart(df, *a))
    got = q.classified(spark, str(tmp_path))[1].collect()
    assert sum(taken) == 1 and Counter(r.Feedback_ID for r in got) == Counter([*range(120), 7])
    cores = spark.sparkContext.defaultParallelism
    fb = q.feedback(spark, str(tmp_path)).repartition(4 * cores)
    model = st.train_classifier(q.split_random(fb.filter(f"{q.LABEL} is not null"), q.ID)[0].repartition(4 * cores), q.TEXT, q.LABEL)
    assert len(fitted) == 2 and max(fitted) <= cores
    want = sorted((r.Feedback_ID, r.score) for r in st.classify(fb, q.ID, q.TEXT, model).collect())
    assert np.allclose(sorted((r.Feedback_ID, r.score) for r in got), want, atol=1e-4)


def test_cosine_topk_through_patterns_is_exact(spark):
    """More features than PATTERN_FROM: product flags, weights of both signs, ties, zero vectors, groups."""
    rng = np.random.default_rng(8)
    vecs = {i: [float(x) for x in (rng.random(12) < 0.4) * (1 if i % 3 else rng.integers(-2, 4, 12))] for i in range(500)}
    vecs |= {i: vecs[i % 7] for i in range(500, 560)}
    vecs |= {i: [0.0] * 12 for i in range(560, 564)}
    rows = [(g, i, f"d{j:02d}", v) for g in "ab" for i, vec in vecs.items() for j, v in enumerate(vec) if g == "a" or i % 2]
    df = spark.createDataFrame(rows, "variant string, id long, dim string, val double")
    got = {}
    for r in cosine_topk(df, 4, group_cols=["variant"], block_rows=16).collect():
        got.setdefault(r.variant, {}).setdefault(r.qid, {})[r.rank] = r.cid
    for g, ids in (("a", vecs), ("b", {i: v for i, v in vecs.items() if i % 2})):
        want = {q: {n + 1: c for n, (c, _) in enumerate(x)} for q, x in _brute_cosine(ids, 4).items()}
        assert got[g] == want
    one = df.filter("variant = 'a'").drop("variant")
    flat = {(r.qid, r["rank"]): r.cid for r in cosine_topk(one, 4, block_rows=16).collect()}
    assert flat == {(q, n + 1): c for q, x in _brute_cosine(vecs, 4).items() for n, (c, _) in enumerate(x)}


def _scored_share(n, queries=96, d=25, kk=6):
    """Share of the classes scored per query on random product flags, through
    buckets of blocks of leaves, with 4096 pivots."""
    from partnerlens.operators.similarity import Leaves, PATTERN_BLOCKS, _codes, _place_pattern, _reach_pattern
    rng = np.random.default_rng(n)
    flags = np.unique(rng.random((n + n // 50, d)) < 0.5, axis=0)
    flags = flags[rng.permutation(len(flags))][:n]
    dis = [np.flatnonzero(x).tolist() for x in flags]
    pdf = pd.DataFrame({"rep": range(len(dis)), "dis": dis, "vals": [[1.0] * len(x) for x in dis]})
    unit = flags / np.sqrt(np.maximum(flags.sum(axis=1), 1))[:, None]
    top, b = {(): np.argsort(np.abs(flags.mean(axis=0) - 0.5), kind="stable").tolist()}, {(): max(0, math.ceil(math.log2(n / (4096 * PATTERN_BLOCKS))))}
    placed = pd.concat(_place_pattern(top, b, [], d)([pdf]))
    buckets = {(): set(placed["bucket"])}
    pivots = {(): unit[rng.permutation(n)[:min(4096, n)]]}
    reach = pd.concat(_reach_pattern(pivots, top, b, buckets, [], d, kk)([pdf[:queries]]))
    done, sims = 0, np.full((queries, n), -np.inf)
    for bucket, part in reach.groupby("bucket"):
        c = placed.index[placed["bucket"] == bucket].to_numpy()
        leaves = Leaves(unit[c], np.sqrt(flags[c].sum(axis=1)), _codes(unit[c], top[()]))
        s, k = leaves.scores(unit[part["rep"]], part["least"].to_numpy(), kk)
        sims[np.ix_(part["rep"], c)] = s
        done += k
    true = -np.sort(-(unit[:queries] @ unit.T), axis=1)[:, :kk]
    assert np.allclose(-np.sort(-sims, axis=1)[:, :kk], true)
    return done / (queries * n)


def test_patterns_score_few_pairs_of_product_flags():
    shares = [_scored_share(n) for n in (6_000, 25_000, 100_000)]
    assert shares[2] < 0.13 and shares[0] > shares[1] > shares[2], shares
    growth = math.log(100_000 ** 2 * shares[2] / (6_000 ** 2 * shares[0])) / math.log(100_000 / 6_000)
    assert growth < 1.6, growth


def test_catalog_of_raises_beyond_its_bound(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "x string")
    assert catalog_of(df, "x") == ["a", "b"] and catalog_of(df, "x", 2) == ["a", "b"]
    assert catalog_of(df.filter("x is null"), "x") == []
    with pytest.raises(ValueError):
        catalog_of(df, "x", 1)
    rows = onehot_encode(df, ["x"]).collect()
    assert sorted((r.x_a, r.x_b) for r in rows) == [(0, 0), (0, 1), (0, 1), (1, 0)]


@pytest.mark.parametrize("by", ["Product_id", "Partner_id"])
def test_rec_item_based_against_brute_force(spark, by):
    rng = np.random.default_rng(5)
    data = [(str(i), int(rng.integers(12)), f"P{rng.integers(4)}", f"S{rng.integers(5)}") for i in range(120)]
    df = spark.createDataFrame(data, "row_key string, Partner_id int, Product_id string, Scheme_Type string")
    train, test = ([r.asDict() for r in x.collect()] for x in split_random(df, "row_key"))
    users = {}
    for r in train:
        users.setdefault(r["Scheme_Type"], set()).add(r[by])
    alike = {}
    for a in users:
        near = sorted((-len(users[a] & users[b]) / len(users[a] | users[b]), b) for b in users if b != a)[:3]
        alike[a] = (round(-sum(s for s, _ in near) / 3, 9), *[b for _, b in near])
    want = {(r["Partner_id"], r["Product_id"], o["Scheme_Type"], *alike[o["Scheme_Type"]])
            for r in test for o in test if o["Product_id"] == r["Product_id"]}
    got = [(r.Partner_id, r.Product_id, r.Scheme_Type, round(r.Similarity_Scores, 9), r.Scheme_1, r.Scheme_2, r.Scheme_3)
           for r in rec_item_based(df, by=by).collect()]
    assert len(got) == len(want) and set(got) == want


def test_leaves_best_equals_brute_force_and_dense_vectors_take_pivots(spark, monkeypatch):
    """Blocks of patterns return the kk best of every query without a row of all similarities; vectors
    that hold all features have no patterns."""
    from partnerlens.operators import similarity as sm
    rng = np.random.default_rng(11)
    for vecs in ((rng.random((900, 25)) < 0.4) * 1.0, rng.normal(size=(900, 12)) * (rng.random((900, 12)) < 0.6) * 10.0 ** rng.integers(-4, 5, (900, 1))):
        length = np.sqrt((vecs ** 2).sum(axis=1))
        unit = vecs / np.where(length > 0, length, 1)[:, None]
        q, want = unit[::3], sm.top_rows(unit[::3] @ unit.T, 6)
        leaves = sm.Leaves(unit, length, sm._codes(unit, list(range(vecs.shape[1]))), sm.BLOCK_LEAF)
        for least in (np.full(len(q), -np.inf), want[2].reshape(len(q), 6)[:, 5]):
            got = leaves.best(q, least, 6)
            assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1]) and np.allclose(got[2], want[2], atol=1e-14)
    modes = []
    block_topk = sm._block_topk
    monkeypatch.setattr(sm, "_block_topk", lambda reach, placed, *a: modes.append("pattern" in placed.columns) or block_topk(reach, placed, *a))
    dense = {i: [float(x) for x in rng.random(10) + 0.1] for i in range(300)}
    df = spark.createDataFrame([(i, f"d{j}", v) for i, vec in dense.items() for j, v in enumerate(vec)], "id long, dim string, val double")
    got = {(r.qid, r["rank"]): r.cid for r in cosine_topk(df, 3, block_rows=16).collect()}
    assert got == {(x, n + 1): c for x, best in _brute_cosine(dense, 3).items() for n, (c, _) in enumerate(best)}
    assert modes and not any(modes)


def test_shuffle_column_makes_its_rows_once(spark, tmp_path):
    """The repeats read numbered rows; the given rows (here a file, elsewhere joins) are not made again for every rank."""
    from partnerlens.plans.explain import shuffle_column
    path = str(tmp_path / "rows")
    spark.createDataFrame([(f"k{i:03d}", float(i)) for i in range(50)], "row_key string, c double").write.parquet(path)
    out = shuffle_column(spark.read.parquet(path), "c", repeats=2)
    assert out.columns == ["row_key", "c", "rep", "shuffled"] and out.count() == 100
    assert "FileScan" not in out._jdf.queryExecution().toString()


def test_flag_stratified_makes_rows_once_and_salts_heavy_strata(spark, monkeypatch, tmp_path):
    from partnerlens.operators import split
    rows = [(f"k{i:03d}", None if i % 5 == 0 else "ab"[i % 2]) for i in range(200)] + [("x", "one")]
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows, "k string, g string").write.parquet(path)
    df = spark.read.parquet(path)
    plain = split.flag_stratified(df, "k", "g")
    assert plain._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    sizes = {g: sum(x == g for _, x in rows) for g in (None, "a", "b", "one")}
    flags = {(r.k, r.g): r.is_train for r in plain.collect()}
    assert {g: sum(t for (_, x), t in flags.items() if x == g) for g in sizes} == {g: math.ceil(0.8 * n) for g, n in sizes.items()}
    for most in (0, 50):
        monkeypatch.setattr(split, "HEAVY_ROWS", most)
        assert {(r.k, r.g): r.is_train for r in split.flag_stratified(df, "k", "g").collect()} == flags


def test_best_in_tiles_matches_brute_force_with_ties(monkeypatch):
    from partnerlens.plans import explain as ex
    rng = np.random.default_rng(3)
    for nd, share, tiles in ((12, 0.5, (7, 16)), (5, 0.3, (64, 9)), (70, 0.1, (16, 32))):
        monkeypatch.setattr(ex, "TILE_ROWS", tiles)
        c = (rng.random((150, nd)) < share).astype(np.float32)
        c = c[c.any(axis=1)]
        q, own = c[::3].copy(), np.arange(len(c))[::3].copy()
        own[0] = -1
        r, at, sim = ex._best_in_tiles(q, c, own, 4)
        full = (q.astype(float) @ c.T.astype(float)) / np.sqrt(np.outer(q.sum(1, dtype=float), c.sum(1, dtype=float)))
        full[np.arange(1, len(q)), own[1:]] = -np.inf
        for i in range(len(q)):
            want = np.lexsort((np.arange(len(c)), -np.round(full[i], 12)))[:4]
            mine = r == i
            assert at[mine].tolist() == want.tolist()
            assert np.allclose(sim[mine], full[i][want], atol=1e-12)


def test_perturbed_knn_gives_what_the_neighbour_holds_beyond_the_query(spark):
    from partnerlens.plans import explain as ex
    held = {1: "AB", 2: "ABC", 3: "BC", 4: "D"}
    p = spark.createDataFrame([(i, x) for i, xs in held.items() for x in xs], "Partner_id long, Product_id string")
    moved = spark.createDataFrame([("A#0", 3), ("A#0", 4)], "variant string, Partner_id long")
    variants = [(ex.BASELINE, None), ("A#0", "A"), ("B#0", "B"), ("C#0", "C"), ("D#0", "D")]
    nn = ex._perturbed_knn(p, moved, p.select("Partner_id").distinct(), variants, 1)
    got = {(r.variant, r.qid): (r.cid, sorted(r.gives)) for r in nn.filter("variant in ('baseline', 'A#0')").collect()}
    assert got[(ex.BASELINE, 1)] == (2, ["C"]) and got[(ex.BASELINE, 4)] == (1, ["A", "B"])
    assert got[("A#0", 1)] == (2, ["C"]) and got[("A#0", 4)] == (3, ["B", "C"])       # AD meets ABC
    assert got[("A#0", 2)] == (3, ["A"])


def test_rank_within_once_agrees_with_rank_within(spark):
    from partnerlens.operators.split import rank_within, rank_within_once
    rows = [(("a", "b", None)[i % 3] if i % 5 else "a", f"k{i % 190}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k string, v int")
    h = F.pmod(F.crc32(F.col("k").cast("binary")), F.lit(1 << 32))
    want = rank_within(df, ["g"], h, "k", "r").select("g", "v", "r").collect()
    got = rank_within_once(df, ["g"], h, "k", ["v"], "r").collect()
    key = {v: k for _, k, v in rows}
    assert sorted((str(x.g), key[x.v], x.r) for x in got) == sorted((str(x.g), key[x.v], x.r) for x in want)
    assert len(got) == 400


def test_score_with_models_gives_every_model_in_one_pass(spark):
    from partnerlens.plans import sentiment as st
    df = spark.createDataFrame([(1, "good good fine", "Positive"), (2, "bad bad fine", "Negative"), (3, "good bad", "Positive"),
                                (3, "bad", "Negative"), (4, None, None), (5, "unseen", None)], "id int, t string, y string")
    models = {f"m{a}": st.train_token_weights(df.filter("y is not null"), "id", "t", "y", a) for a in (1.0, 5.0)}
    got = {(r.model, r.id, round(r.score, 12), r.label) for r in st.score_with_models(df, "id", "t", models).collect()}
    want = set()
    for name, (w, prior) in models.items():
        weight = {r.token: r.w for r in w.collect()}
        p = df.select(prior.alias("p")).first().p
        texts = {1: "good good fine", 2: "bad bad fine", 3: "good bad bad", 4: "", 5: "unseen"}
        for i, t in texts.items():
            s = 1 / (1 + np.exp(-(p + sum(weight.get(x, 0.0) for x in t.split()))))
            want.add((name, i, round(float(s), 12), "Positive" if s >= 0.5 else "Negative"))
    assert got == want


def test_reach_uses_what_the_own_bucket_gave():
    import pandas as pd
    from partnerlens.operators import similarity as sm
    rng = np.random.default_rng(2)
    u = rng.random((3000, 5))
    u /= np.linalg.norm(u, axis=1)[:, None]
    p = u[:60]
    s = u @ p.T
    home = s.argmax(axis=1)
    angle = np.arccos(np.clip(s.max(axis=1), -1, 1))
    radius = {(): {b: angle[home == b].max() for b in range(60)}}
    least = np.array([np.partition((u[home == home[i]] @ u[i]), -2)[-2] if (home == home[i]).sum() > 1 else -np.inf for i in range(len(u))])
    part = pd.DataFrame({"rep": range(len(u)), "dis": [list(range(5))] * len(u), "vals": list(u), "home": home})
    def reached(low):
        return pd.concat(sm._reach({(): p}, radius, [], 5, 2)(iter([part.assign(least=low)])))
    tight, loose = reached(least), reached(np.full(len(u), -np.inf))
    assert len(tight) < len(loose) / 2 and not (tight["bucket"] == tight["home"]).any()
    full = u @ u.T
    true = np.argsort(-full, axis=1)[:, :2]          # itself and the nearest
    pairs = set(zip(tight["rep"], tight["bucket"]))
    assert all(home[j] == home[i] or (i, home[j]) in pairs for i in range(len(u)) for j in true[i])


def test_fine_groups_are_dealt_by_the_number_of_rows(spark, tmp_path, monkeypatch):
    """The grouping's tasks grow in number with the lines, not in size; sums stay."""
    from partnerlens.operators import joins
    from partnerlens.plans.q_schemes import q_agg_pps
    n = 2000
    tables = {
        "region": ([(0, "ASIA")], "r_regionkey long, r_name string"),
        "nation": ([(0, 0)], "n_nationkey long, n_regionkey long"),
        "customer": ([(i, 0, "BUILDING") for i in range(20)], "c_custkey long, c_nationkey long, c_mktsegment string"),
        "orders": ([(i, i % 20 if i % 7 else None, None, f"{i % 5}-P") for i in range(500)],
                   "o_orderkey long, o_custkey long, o_orderdate date, o_orderpriority string"),
        "part": ([(i, f"B{i % 9}") for i in range(50)], "p_partkey long, p_brand string"),
        "lineitem": ([(i % 500, 1 + i // 500, i % 50, 1, float(i % 11), i / 4 if i % 3 else None, 0.0, 0.0, "N", "O", None) for i in range(n)],
                     "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, "
                     "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    want = q_agg_pps(spark, str(tmp_path)).collect()
    monkeypatch.setattr(joins, "GROUP_ROWS", 100)
    got = q_agg_pps(spark, str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, want)) and len(want) >= 100
    tasks = got.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 10 and max(r["count"] for r in tasks) < len(want) / 5
