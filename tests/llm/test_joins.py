"""Ops 11 to 13 against their DuckDB twins on whole tables, against brute
force on made rows, and on awkward rows."""

import itertools
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from partnerlens.llm import divergence, hard_negatives, ngram_join, queries
from tests.conftest import SF_SMALL
from tests.llm.test_operators import LONG, ODD, WORD, empty, odd_docs


@pytest.mark.parametrize("name", ["op11_ngram_join", "op12_hard_negatives", "op13_divergence"])
def test_against_sql(spark, name):
    rows = queries.QUERIES[name](spark, SF_SMALL).collect()
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    out = con.execute(queries.SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(rows[0].asDict())
    assert Counter(out.fetchall()) == Counter(tuple(r[c] for c in names) for r in rows)


# ------------------------------------------------------------ op11

def lowered(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, k=4):
    w = lowered(text)
    return {" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_groups(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)].append(d)
    return Counter((d, len(sets[i]), (min(low[find(i)]) if low[find(i)] else None) if sets[i] else d)
                   for i, (d, _) in enumerate(rows))


def got_groups(df, **kw):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_groups(df, **kw).collect())


def near_copies(r, n_groups, size, shared):
    """Groups of noisy copies of texts that all hold the same passages."""
    rows = []
    for _ in range(n_groups):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([3, 5, 9, 40, 130]))] + list(shared) * (r.random() < 0.5)
        for _ in range(size):
            w = [x if r.random() > 0.02 else f"x{r.randrange(9)}" for x in base]
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("rare, frequent", [(16, 1024), (1, 3), (1, 1), (2, 10 ** 9)])
def test_ngram_join_against_brute_force(spark, monkeypatch, rare, frequent):
    """All classes of tokens: singles, pairs and threes of frequent ones."""
    monkeypatch.setattr(ngram_join, "RARE", rare)
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    r = random.Random(rare * 7 + 1)
    rows = near_copies(r, 12, 12, [f"common{i}" for i in range(60)])
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_groups(df) == brute_groups(rows)


@pytest.mark.parametrize("rare, frequent", [(16, 1024), (1, 4), (0, 0)])
def test_linked_sets_share_a_signature(monkeypatch, rare, frequent):
    monkeypatch.setattr(ngram_join, "RARE", rare)
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    r = np.random.default_rng(5)
    pairs = 0
    for n in [1, 2, 3, 4, 6, 7, 8, 15, 16, 31, 33, 60, 64, 127, 200, 256, 300]:
        for _ in range(12):
            base = np.unique(ngram_join.mix(r.integers(0, 900, n).astype(np.uint64)))
            keep = base[r.random(len(base)) > 0.07]
            other = np.unique(np.concatenate([keep, ngram_join.mix(r.integers(900, 2000, max(0, n // 20)).astype(np.uint64))]))
            both = len(np.intersect1d(base, other))
            if not both or 100 * both < 85 * (len(base) + len(other) - both):
                continue
            pairs += 1
            freq = {int(t): int(r.integers(2, 40)) for t in np.union1d(base, other)}
            sigs = []
            for s, o in ((base, other), (other, base)):
                again = np.isin(s, o) | (r.random(len(s)) < 0.5)  # tokens of one set only may have no signature
                t = s[again]
                f = np.array([freq[int(x)] for x in t], dtype=np.int64)
                sigs.append(set(np.concatenate([ngram_join.prefix_signatures(t, f, len(s), level, 85)
                                                for level in ngram_join.levels(len(s), 85)]).tolist()))
            assert sigs[0] & sigs[1]
    assert pairs > 60


def test_ngram_join_odd_rows(spark):
    rows = [*ODD, (30, LONG + " tail"), (31, "One  two\nTHREE"), (None, "NO id here"), (None, "nothing like it"), (32, "no id here"), (33, "a b"),
            (34, "A\tB"), (9, "another text of a repeated id"), (35, ""), (36, "a b c d"), (37, "a b c")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, n int")
    assert got_groups(df) == brute_groups(rows)
    assert ngram_join.jaccard_groups(empty(odd_docs(spark))).count() == 0
    assert ngram_join.jaccard_groups(df.filter("doc_id = 2")).collect()[0]["component_id"] == 2


# ------------------------------------------------------------ op12

def brute_negatives(rows, n_positives=5, k=10, low=30, high=90):
    ok = [(i, y, [int(np.floor(256 * x)) for x in v]) for i, y, v in rows
          if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731  a shorter one counts as filled up with zeros
    out = Counter()
    for i, y, v in {(i, y, tuple(v)) for i, y, v in ok if i % 100 == 0}:
        own = sorted((-dot(v, w), j) for j, z, w in ok if z == y and j != i)[:n_positives]
        others = sorted((-dot(v, w), j) for j, z, w in ok if z != y)
        for s, p in own:
            fit = [(t, j) for t, j in others if low * -s <= 100 * -t <= high * -s][:k]
            out.update((i, p, r + 1, j, -s, -t) for r, (t, j) in enumerate(fit))
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, label int, embedding array<double>, v string, score string")


def mined(df, **kw):
    return Counter(tuple(r) for r in hard_negatives.hard_negatives(df, F.pmod("vec_id", F.lit(100)) == 0, **kw).collect())


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SMALL_BLOCK", 64)
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 4)
    r = np.random.default_rng(2)
    centres = r.normal(size=(9, 6))
    rows = [(i, int(i % 3), (centres[i % 9] + 0.3 * r.normal(size=6)).tolist()) for i in range(900)]
    rows += [(900 + i, 1, rows[100][2]) for i in range(300)]  # one vector holds a quarter of all rows
    assert mined(vectors(spark, rows)) == brute_negatives(rows)


def test_hard_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (100, 1, [1.0]), (200, 2, []), (1, 1, [0.9, 0.1]), (2, 2, [0.5, 0.2]), (3, 2, None), (4, None, [1.0, 1.0]),
            (None, 2, [0.6, 0.3]), (5, 2, [nan, 1.0]), (6, 2, [inf, 1.0]), (7, 2, [None, 1.0]), (8, 3, [0.5, 0.2]), (9, 3, [0.5, 0.2]),
            (300, 4, [0.0, 0.0]), (10, 4, [0.0, 0.0]), (11, 1, [0.9, 0.1]), (12, 5, [0.7, 0.1, 0.3]), (0, 1, [1.0, 0.5])]
    assert mined(vectors(spark, rows)) == brute_negatives(rows)
    assert mined(vectors(spark, rows[:1])) == mined(empty(vectors(spark, rows))) == Counter()
    huge = [(0, 1, [1e10, 1.0]), (1, 1, [1e10, 0.0]), (2, 2, [7e9, 1.0]), (3, 2, [5e9, 1e300])]
    assert {(x[0], x[1], x[3]) for x in mined(vectors(spark, huge))} <= {(0, 1, 2), (0, 1, 3)}


def test_multi_sequence_falls_and_covers():
    r = np.random.default_rng(0)
    a, b = r.normal(size=7), r.normal(size=5)
    seen = list(hard_negatives.multi_sequence(a, b))
    assert [x for x, _, _ in seen] == sorted((x + y for x in a for y in b), reverse=True)
    assert {(i, j) for _, i, j in seen} == set(itertools.product(range(7), range(5)))


def test_index_reads_less_where_cells_are_tight():
    """The certified stop leaves most cells unread on clustered vectors."""
    import pyarrow as pa
    r = np.random.default_rng(3)
    centres = r.normal(size=(16, 8)) * 400
    v = np.floor(centres[r.integers(0, 16, 4000)] + r.normal(size=(4000, 8)) * 8).astype(np.int64)
    books = (hard_negatives.codebook(v[:, :4].astype(float), 16), hard_negatives.codebook(v[:, 4:].astype(float), 16))
    codes = [hard_negatives.nearest_code(h.astype(float), b).astype(np.int32) for h, b in zip((v[:, :4], v[:, 4:]), books)]
    index = hard_negatives.Index(pa.table({"vec_id": pa.array(np.arange(4000)), "label": pa.array(np.arange(4000) % 2),
                                           "v": pa.array(v.tolist()), "c1": codes[0], "c2": codes[1]}), books)
    read, plain = [], index.scores
    index.scores = lambda a, b, q: read.append(b - a) or plain(a, b, q)
    for i in range(50):
        best = index.positives(v[i], i, i % 2, 5)
        every = sorted((-int(v[i] @ v[j]), j) for j in range(4000) if j % 2 == i % 2 and j != i)[:5]
        assert list(zip((-best.score).tolist(), best.id.tolist())) == every
    assert sum(read) < 0.3 * 50 * 2000


# ------------------------------------------------------------ op13

def test_count_terms_of_all_lengths():
    r = random.Random(1)
    alphabet = "abAZzé中 0.-_\n\x00"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(200))) for _ in range(80)]
    texts += ["x" * n + " " + "x" * n + "y" for n in range(1, 40)] + ["", "中" * 3000, "a" * 8 + " " + "a" * 9 + " " + "a" * 16 + " " + "a" * 17]
    group = np.sort(np.array([r.randrange(4) for _ in texts]))
    terms, g, n, d = divergence.count_terms([t.encode() for t in texts], group)
    want_n, want_d = Counter(), Counter()
    import re
    for t, k in zip(texts, group.tolist()):
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)
        found = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in found]
        want_n.update((x, k) for x in found)
        want_d.update((x, k) for x in set(found))
    keys = list(zip(terms.to_pylist(), g.tolist()))
    assert len(set(keys)) == len(keys)
    assert dict(zip(keys, n.tolist())) == dict(want_n) and dict(zip(keys, d.tolist())) == dict(want_d)


def brute_divergence(rows, min_docs, top):
    import re
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
             for _, _, t in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        df = Counter(x for r, f in zip(rows, found) if r[0] == lang for x in set(f))
        kept = {x for x, n in df.items() if n >= min_docs}
        count = defaultdict(Counter)
        for r, f in zip(rows, found):
            if r[0] == lang:
                count[r[1]].update(x for x in f if x in kept)
        whole = sum(count.values(), Counter())

        def shares(c):
            total = sum(c.values())
            return {x: 1 + 10 ** 9 * (c[x] + 5) // (total + 5 * len(kept)) for x in kept}
        q = shares(whole)
        p = {s: shares(c) for s, c in count.items()}
        for s in p:
            pair = sorted(((-sum(abs(p[s][x] - p[o][x]) for x in kept), o.encode()) for o in p if o != s))
            out |= {(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pair)}
            term = sorted(((q[x] - p[s][x], x.encode()) for x in kept if count[s][x] > 0 and p[s][x] > q[x]))[:top]
            out |= {(lang, s, "term", x.decode(), -v, i + 1) for i, (v, x) in enumerate(term)}
    return out


@pytest.mark.parametrize("tile, cells", [(256, 1 << 18), (3, 64)])
def test_divergence_against_brute_force(spark, monkeypatch, tile, cells):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BLOCK_CELLS", cells)
    r = random.Random(4)
    rows = [(r.choice(["en", "de", None, "", "xx"]), r.choice([None, "a", "b", "c", "d", "e", "f", "", "ü"]),
             " ".join(r.choice(["Alpha", "beta", "gamma1delta", "Äther", "averyveryverylongterm", "zz"]) for _ in range(r.randrange(9))))
            for _ in range(400)] + [("none", "a", None), ("none", "b", "..."), ("one", "only", "word"), (None, None, None), ("en", "blank", "12 34")]
    df = spark.createDataFrame([(*x, "t", 5) for x in rows], "lang string, source string, text string, term string, n int")
    got = [tuple(x) for x in divergence.divergence(df, min_docs=30, top=3).collect()]
    assert len(set(got)) == len(got) and set(got) == brute_divergence(rows, 30, 3)
    assert divergence.divergence(empty(df)).count() == 0


def test_divergence_odd_rows(spark):
    rows = divergence.divergence(odd_docs(spark), min_docs=1).collect()
    want = brute_divergence([("en", None if i == 3 else "s", t) for i, t in ODD], 1, 50)
    assert {tuple(r) for r in rows} == want


# ------------------------------------------------------------ op7 on awkward rows

def test_nearest_of_mixed_lengths_and_repeated_queries(spark):
    from partnerlens.llm.ann import nearest
    rows = [(i, [float(i), 1.0]) for i in range(1, 9)] + [(100 + i, [float(i), 1.0, 2.0]) for i in range(1, 6)] + [(3, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df, F.col("vec_id").isin(3, 101), k=4).collect()
    lists = defaultdict(list)
    for r in got:
        lists[r["query_id"], r["rank"]].append(r["vec_id"])
    assert [sorted(set(lists[3, i + 1])) for i in range(4)] == [[2], [4], [1], [5]] and all(len(lists[3, i + 1]) == 2 for i in range(4))
    assert [lists[101, i + 1] for i in range(4)] == [[102], [103], [104], [105]]
