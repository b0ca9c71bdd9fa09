"""Every training-data operator against a brute-force version, on the smallest
tables and on rows made to be awkward (nulls, empty and long texts, repeated
rows, ties, clashing extra columns, empty tables)."""

import functools
import html as html_lib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from partnerlens.llm import hmm, html_crf, queries
from partnerlens.llm.ann import nearest
from partnerlens.llm.common import gapless_index, lookup, scratch_path
from partnerlens.llm.encoder import encoder, tokenizer_path
from partnerlens.llm.mixing import hyperperiod, mix, phases
from partnerlens.llm.packing import SumOfSquares, pack
from partnerlens.llm.quality import fit, quality, stretch_distinct, text_counts
from partnerlens.llm.sharding import assign_shards, sharded
from partnerlens.llm.simhash import components, fingerprint, simhash_groups
from partnerlens.llm.substring_dedup import substring_dedup
from partnerlens.llm.token_files import SequenceFile, read_token_index, write_token_files
from tests.conftest import SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}" for i in range(30000))
ODD = [(1, "one two three"), (2, None), (3, ""), (4, "  \n\t "), (5, LONG), (6, "same text " * 30), (7, "same text " * 30),
       (None, "no id here"), (8, "naïve café ́x 中文 . , ..a <|endoftext|>"), (9, "a\x00b\r\nc"), (9, "a\x00b\r\nc")]


def odd_docs(spark):
    rows = [(i, t, "en", None if i == 3 else "s", 0, "x", 1) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "shard string, __b int")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]


def empty(df):
    return df.filter(F.lit(False))


# ------------------------------------------------------------ helpers

def test_gapless_index_null_groups_and_hot_group(spark):
    df = spark.createDataFrame([(None, i % 7) for i in range(300)] + [("a", i) for i in range(50)], "g string, k long")
    got = defaultdict(list)
    for r in gapless_index(df, ["g"], ["k"], "i", rows_per_bucket=10).collect():
        got[r["g"]].append(r["i"])
    assert {k: sorted(v) for k, v in got.items()} == {None: list(range(300)), "a": list(range(50))}


def test_lookup_hot_and_cold_keys(spark):
    big = spark.createDataFrame([(1,)] * 500 + [(i,) for i in range(2, 60)] + [(None,)], "k long")
    small = spark.createDataFrame([(1, 500, "hot")] + [(i, 1, "cold") for i in range(2, 50)], "k long, n long, v string")
    got = Counter((r["k"], r["v"]) for r in lookup(big, small, "k", "n", 600, heavy=10).collect())
    assert got[1, "hot"] == 500 and got[5, "cold"] == 1 and got[55, None] == 1 and got[None, None] == 1
    assert sum(got.values()) == 559


# ------------------------------------------------------------ op1

def test_hyperperiod_meets_every_window():
    for quotas in ({"a": 1}, {"a": 4, "b": 1, "c": 7}, {f"s{i}": i + 1 for i in range(12)}):
        total, plan = sum(quotas.values()), hyperperiod(quotas)
        slots = sorted(x[0] for v in plan.values() for x in v)
        assert slots == list(range(total))
        for s, q in quotas.items():
            assert all(r <= t < d for t, r, d in plan[s])
            for t in range(total + 1):
                assert abs(sum(x[0] < t for x in plan[s]) - q * t / total) < 1


def test_phases_place_every_block_once():
    blocks, quotas = {"a": 40, "b": 3, "c": 11, "d": 0}, {"a": 1, "b": 5, "c": 2, "d": 9}
    slots = []
    for r in phases(blocks, quotas):
        for m in range(r["k_to"] - r["k_from"]):
            slots.append(r["base"] + m // r["quota"] * r["period"] + r["plan"][m % r["quota"]][0])
    assert sorted(slots) == list(range(54))


def test_mix_keeps_all_rows_and_shares(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else "b") for i in range(900)] + [(900 + i, None) for i in range(5)],
                               "doc_id long, source string")
    out = mix(df, {"hot": 1, "b": 3}, rest=1, block_rows=4)
    rows = out.orderBy("mix_position").collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(905))
    assert len({r["mix_position"] for r in rows}) == 905
    first = [r for r in rows if r["mix_phase"] == 0]
    for n in range(1, max(r["mix_slot"] for r in first) + 1):
        got = Counter(r["mix_source"] for r in {r["mix_slot"]: r for r in first if r["mix_slot"] < n}.values())
        assert abs(got["b"] - 0.6 * n) < 1 and abs(got["hot"] - 0.2 * n) < 1
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in rows)
    assert mix(empty(df), {"b": 1}).count() == 0
    odd = mix(odd_docs(spark), {"s": 2}, block_rows=2)
    assert odd.count() == len(ODD) and odd.select("mix_position").distinct().count() == len(ODD)
    with pytest.raises(ValueError):
        mix(df, {"b": 0})
    with pytest.raises(ValueError):
        mix(df, {"b": 10 ** 6})


def test_mix_keeps_clashing_columns(spark):
    names = ["doc_id", "source", "__b", "__i", "row", "key", "tie", "mix_source", "c_mix_source", "MIX_SLOT", "__plan", "__base", "__g0", "a.b"]
    df = spark.createDataFrame([(i, "b" if i % 3 else "c", *(1000 * j + i for j in range(len(names) - 2))) for i in range(60)], names)
    out = mix(df, {"b": 2}, block_rows=4)
    assert out.columns[-7:] == ["mix_source", "mix_phase", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_position"]
    assert out.columns[:-7] == [{"mix_source": "c_c_mix_source", "MIX_SLOT": "c_MIX_SLOT"}.get(c, c) for c in names]
    assert sorted(tuple(r)[:-7] for r in out.collect()) == sorted(map(tuple, df.collect()))


def test_mixing_query_against_plain_edf(spark):
    """Slot by slot over all documents: of the released blocks the one of the
    earliest deadline, a new phase when the chosen source has run out."""
    rows = queries.op1_mixing(spark, SF_SMALL).collect()
    sizes = Counter(r["source"] if r["source"] in queries.TARGETS else "(rest)"
                    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("source").collect())
    left = {s: -(-n // 64) for s, n in sizes.items()}
    plain, done = [], Counter()
    while any(left.values()):
        quota = {s: queries.TARGETS.get(s, 1) for s in left if left[s]}
        total, took, slot = sum(quota.values()), Counter(), 0
        while True:
            ready = [(-(-(took[s] + 1) * total // q), s) for s, q in quota.items() if took[s] * total // q <= slot]
            s = min(ready)[1]
            if not left[s]:
                break
            plain.append((s, done[s]))
            left[s] -= 1
            took[s] += 1
            done[s] += 1
            slot += 1
    assert {(r["mix_slot"], r["mix_source"], r["mix_block"]) for r in rows} == {(i, *x) for i, x in enumerate(plain)}
    assert Counter(r["mix_source"] for r in rows) == sizes


# ------------------------------------------------------------ op2, op5

@functools.cache
def plain_tokenizer(name):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path(name))


def plain_ids(name, text, end):
    return [*plain_tokenizer(name).encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_whole_text_encoding(docs, name):
    r = random.Random(3)
    made = ["".join(r.choice([" ", " ", "\n", ".", ",", "a", "B", "é", "'s", "1", "\t", "́", "中", "-"]) for _ in range(40))
            for _ in range(400)]
    special = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y. <|ENDOFTEXT|>", "<| endoftext |>", "a, <|endoftext|>\n<|endoftext|>."]
    texts = [t or "" for _, t in docs[:60]] + [t or "" for _, t in ODD] + made + special
    for t, ids in zip(texts, encoder(tokenizer_path(name)).encode(texts, 3)):
        assert ids.tolist() == plain_ids(name, t, 3), repr(t[:80])


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def check_token_rows(rows, texts):
    at = 0
    by_id = defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append(r)
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    for i, t in order:
        ids = plain_ids("byte_bpe_50k.json", t, 0)
        r = next(x for x in by_id[i] if x["start"] == at)
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), crc(ids))
        at += len(ids)
    assert len(rows) == len(texts)


def test_token_files(spark, docs, tmp_path):
    rows = queries.op2_token_files(spark, SF_SMALL).collect()
    check_token_rows(rows, docs)
    odd = odd_docs(spark)
    files = write_token_files(odd, f"file://{tmp_path}/tokens", tokenizer_path("byte_bpe_50k.json"), seq_len=16)
    check_token_rows(read_token_index(files).collect(), ODD)
    one = max(files.collect(), key=lambda r: r["n_tokens"])
    f = SequenceFile(one["tokens_file"])
    ids, mask = f.sequence(0)
    assert len(ids) == 16 and ids.base is not None and mask.all()
    assert (f.run(5, 9) == np.concatenate([f.sequence(0)[0], f.sequence(1)[0]])[5:14]).all()
    none = write_token_files(empty(odd), f"file://{tmp_path}/none", tokenizer_path("byte_bpe_50k.json"))
    assert read_token_index(none).count() == 0


def check_pieces(rows, texts, size=2048):
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    for i, t in {i: t for i, t in texts}.items():
        ids = plain_ids("word_bpe_49k.json", t, 1)
        same = sum(1 for j, _ in texts if j == i)
        own = sorted(pieces[i], key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == same * len(ids)
        for r in own:
            part = ids[r["start"]:r["start"] + r["length"]]
            assert r["length"] == len(part) > 0 and r["ids_crc32"] == crc(part) and r["doc_tokens"] == len(ids)
        if same == 1:
            assert [r["start"] for r in own] == [0, *itertools.accumulate(r["length"] for r in own)][:-1]
    for w in windows.values():
        w.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in w] == [0, *itertools.accumulate(r["length"] for r in w)][:-1]
        assert sum(r["length"] for r in w) <= size
    return len(windows) * size, sum(r["length"] for r in rows)


def test_packing(spark, docs):
    rows = queries.op5_packing(spark, SF_SMALL).collect()
    room, used = check_pieces(rows, docs)
    assert room - used <= 2048 * 8  # an unfilled window per task at most
    odd = odd_docs(spark)
    check_pieces(pack(odd, tokenizer_path("word_bpe_49k.json")).collect(), ODD)
    check_pieces(pack(odd.withColumn("at", F.rand(1)), tokenizer_path("word_bpe_49k.json"), order="at").collect(), ODD)
    assert pack(empty(odd), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_packing_tasks_follow_the_text(spark, docs):
    """However the table is partitioned, a task packs block_bytes of text or all."""
    df = spark.createDataFrame(list(docs.items()) if isinstance(docs, dict) else docs, "doc_id long, text string").repartition(32)
    for order in (None, "doc_id"):
        one = pack(df, tokenizer_path("word_bpe_49k.json"), order=order).collect()
        room, used = check_pieces(one, docs)
        assert room - used < 2048 and {r["sequence_id"] >> 33 for r in one} == {0}
        some = pack(df, tokenizer_path("word_bpe_49k.json"), order=order, block_bytes=200_000).collect()
        check_pieces(some, docs)
        assert 1 < len({r["sequence_id"] >> 33 for r in some}) < 32


def test_sum_of_squares_picks_least_growth():
    r = random.Random(5)
    s = SumOfSquares(40)
    for _ in range(500):
        n = r.randrange(1, 40)
        c = s.count.tolist()
        options = {}
        for h in [0, *[h for h in range(1, 41 - n) if c[h]]]:
            d = list(c)
            if h:
                d[h] -= 1
            if h + n < 40:
                d[h + n] += 1
            options[h] = sum(x * x for x in d)
        assert s.choose(n) == max(options, key=lambda h: (-options[h], h))
        s.put("x", n)


# ------------------------------------------------------------ op3

def brute_dedup(texts, window=20):
    words = {i: WORD.findall(t or "") for i, t in texts}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s:s + window]), (i, s))
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < (i, s):
                gone.update(range(s, s + window))
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def test_substring_dedup_small_table(spark, docs):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in
           substring_dedup(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).collect()}
    assert got == brute_dedup(docs)
    assert any(x[1] for x in got.values())


def test_substring_dedup_planted(spark):
    r = random.Random(11)
    pool = [[f"v{r.randrange(60)}" for _ in range(r.randrange(15, 80))] for _ in range(12)]
    texts = []
    for i in range(120):
        w = [f"v{r.randrange(60)}" for _ in range(r.randrange(0, 60))]
        for _ in range(r.randrange(0, 4)):
            at = r.randrange(len(w) + 1)
            w[at:at] = r.choice(pool)
        if i % 10 == 0:
            w = ["same"] * r.randrange(0, 70)  # one word again and again
        texts.append((i, " \n".join(w) if i % 2 else " ".join(w)))
    texts += [(120 + i, texts[i][1]) for i in range(0, 60, 3)] + [(200, None), (201, ""), (202, "  "), (203, LONG)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("__ord", F.lit("x"))
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_text"]) for x in substring_dedup(df, carry=("__ord",)).collect()}
    assert got == brute_dedup(texts)
    assert substring_dedup(empty(df)).count() == 0


def test_substring_dedup_odd_rows(spark):
    rows = substring_dedup(odd_docs(spark), carry=("source", "shard")).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert by[7]["n_removed"] == 60 and by[6]["n_removed"] == 58 and by[6]["n_words"] == 60
    assert by[2]["n_words"] == 0 and by[2]["kept_text"] == "" and by[9]["n_removed"] == 0 and by[1]["c_shard"] == "x"


def brute_dedup_rows(texts, window=20):
    """As brute_dedup, by row: an id may have several texts."""
    words = [(i, WORD.findall(t or "")) for i, t in texts]
    first = {}
    for i, w in words:
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < (i, s):
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return Counter(out)


def test_settled_windows_stay_out_of_window_groups():
    """A passage in every text of a block: one row per distinct window, the
    later places each in a group of their own."""
    import pyarrow as pa
    from partnerlens.llm import substring_dedup as m
    shared = " ".join(f"s{i}" for i in range(25))
    docs = pa.table({"__block": pa.array([3] * 50, pa.int32()), "__id": pa.array(range(50), pa.int64()),
                     "__text": [f"a{i} b{i} {shared} c{i}" for i in range(50)]})
    found = m._find_anchors(20)((pa.scalar(3),), docs, pa.table({"__copy": pa.array([], pa.string())}))
    known = found.filter(pa.compute.greater(found.column("__n"), 1))
    rows = m._find_windows(20)((pa.scalar(3),), docs, known).to_pylist()
    assert sum(r["__run"] == 6 for r in rows) == 49 == sum(r["__run"] > 0 for r in rows)
    assert max(Counter((r["__h1"], r["__h2"]) for r in rows).values()) == 1


def test_substring_dedup_ids_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    texts = [(1, a), (2, a), (2, f"{b} only here"), (3, f"new {b}"), (4, c), (5, c), (5, c), (5, f"{c} more"), (6, f"x {c} {b}")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = Counter((x["doc_id"], x["n_words"], x["n_removed"], x["kept_text"]) for x in substring_dedup(df).collect())
    assert got == brute_dedup_rows(texts)
    assert got[2, 32, 0, f"{b} only here"] == 1 and got[3, 31, 30, "new"] == 1


def test_null_and_repeated_ids_spread_over_blocks(spark):
    from partnerlens.llm.substring_dedup import rows_of
    r = random.Random(8)
    pool = [" ".join(f"p{r.randrange(9999)}" for _ in range(25)) for _ in range(6)]
    big = 2 ** 63 - 1  # brute_dedup_rows sorts by id; a null one counts as the largest
    texts = [(i, f"t{j} u{j} {r.choice(pool)} w{j}") for i in (7, big) for j in range(60)]
    texts += [(3, pool[0]), (7, pool[1]), (big, pool[1])]
    df = spark.createDataFrame([(None if i == big else i, t) for i, t in texts], "doc_id long, text string")
    for rows, name in ((rows_of(df, 16, "doc_id", "text"), "__id"), (hmm.blocks_of(df, 16), "doc_id")):
        for which in (f"{name} = 7", f"{name} is null"):
            assert rows.filter(which).select("__block").distinct().count() > 8
    got = Counter((big if x["doc_id"] is None else x["doc_id"], x["n_words"], x["n_removed"], x["kept_text"])
                  for x in substring_dedup(df).collect())
    assert got == brute_dedup_rows(texts)
    scored = hmm.lm_scores(df).collect()
    assert len(scored) == len(texts) and len({(x["doc_id"], x["train_tokens"]) for x in scored}) == 3


# ------------------------------------------------------------ op4

def brute_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in fps}


def test_simhash_small_table(spark, docs):
    rows = queries.op4_simhash(spark, SF_SMALL).collect()
    fps = {i: brute_fingerprint(t) for i, t in docs}
    want = brute_components(fps)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    native = spark.sql("select xxhash64('a b c') as h").first()["h"] % (1 << 64)
    assert native == xxhash.xxh64_intdigest(b"a b c", 42)


def test_simhash_links_dense_groups(spark, monkeypatch):
    """Chains and dense balls of fingerprints, with leaves small enough that
    most links lie between leaves and under upper nodes."""
    from partnerlens.llm import simhash as m
    monkeypatch.setattr(m, "LEAF", 4)
    monkeypatch.setattr(m, "UPPER", 2)
    r = random.Random(2)
    fps = {}
    for _ in range(6):
        f = r.getrandbits(64)
        for _ in range(60):
            fps[len(fps)] = f
            f ^= 1 << r.randrange(64)
            f ^= 1 << r.randrange(64)
    for _ in range(100):
        fps[len(fps)] = r.getrandbits(64)
    fps = {i: f for f, i in {f: i for i, f in sorted(fps.items(), reverse=True)}.items()}
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()], "rep long, fp long")
    # the tasks import the module anew, so the sizes travel through the closure of a wrapper
    got = {x["node"]: x["root"] for x in components(m.links(df, 3)).collect()}
    want = brute_components(fps)
    assert {i: got.get(i, i) for i in fps} == want


def test_leaf_cuts_in_process(monkeypatch):
    import pyarrow as pa
    from partnerlens.llm import simhash as m
    monkeypatch.setattr(m, "LEAF", 4)
    r = np.random.default_rng(0)
    node = np.sort(r.integers(0, 6, 60))
    fp = r.integers(0, 1 << 6, 60).astype(np.uint64)
    rep = np.arange(60)
    batches = [pa.record_batch([pa.array(node[a:a + 7]), pa.array(np.arange(60)[a:a + 7]), pa.array(rep[a:a + 7]),
                                pa.array(fp[a:a + 7].view(np.int64))], names=["node", "rank", "rep", "fp"]) for a in range(0, 60, 7)]
    out = [x for b in m._leaves(3)(iter(batches)) for x in b.to_pylist()]
    seen = Counter(x for o in out if o["kind"] == 1 for x in np.frombuffer(o["reps"], np.int64).tolist())
    assert max(seen.values()) == 1
    several = {n for n, c in Counter(node.tolist()).items() if c > 4}
    assert {i for i in range(60) if node[i] in several} <= set(seen)


def test_simhash_odd_rows(spark):
    rows = simhash_groups(odd_docs(spark)).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["fingerprint"] == "0" * 16 and {by[i]["component_id"] for i in (2, 3, 4)} == {2}
    assert by[7]["component_id"] == 6 and by[None]["component_id"] is None
    assert [fingerprint(t) for _, t in ODD] == [brute_fingerprint(t) for _, t in ODD]
    assert simhash_groups(empty(odd_docs(spark))).count() == 0


def near_texts(seed, far):
    """Three texts, each at most 3 bits from the one before; with ``far`` the
    last is further than that from the first."""
    r = random.Random(seed)
    while True:
        words = [f"n{r.randrange(5000)}" for _ in range(400)]
        texts = [" ".join(words)]
        for _ in range(2000):
            old, at = words[:], r.randrange(400)
            words[at] = f"m{r.randrange(5000)}"
            f = fingerprint(" ".join(words))
            step = (fingerprint(texts[-1]) ^ f).bit_count()
            if step > 3:
                words = old
            elif step and (len(texts) == 1 or not far or (fingerprint(texts[0]) ^ f).bit_count() > 3):
                texts.append(" ".join(words))
                if len(texts) == 3:
                    return texts


def null_id_rows():
    a, n, b = near_texts(1, True)
    c, d, _ = near_texts(2, False)
    return [(2, a), (None, n), (1, b), (None, c), (None, d), (None, d), (4, "quite another text, alone")]


def test_simhash_links_null_ids(spark):
    df = spark.createDataFrame(null_id_rows(), "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"]) for r in simhash_groups(df).collect()]
    assert Counter(got) == Counter([(2, 1), (1, 1), (None, 1), (None, None), (None, None), (None, None), (4, 4)])


def test_components_long_chain(spark):
    n = 300
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


# ------------------------------------------------------------ op6

def brute_counts(text):
    w = WORD.findall(text or "")
    lines, dup = set(), 0
    for x in (text or "").split("\n"):
        if WORD.search(x):
            dup += x in lines
            lines.add(x)
    win = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    rep = {j for i in range(len(w) - 7) if win[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(rep)


def test_quality(spark, docs):
    rows = {r["doc_id"]: r for r in queries.op6_quality(spark, SF_SMALL).collect()}
    for i, t in docs:
        r, want = rows[i], brute_counts(t)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r["base_failed"] == failed and (not failed or not r["kept"])
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    good = [rows[i] for i, q in label.items() if q == 1 and not rows[i]["base_failed"]]
    bad = [rows[i] for i, q in label.items() if q == 0]
    assert all(r["kept"] for r in good) and not any(r["kept"] for r in bad)


def test_quality_odd_rows(spark):
    for _, t in ODD:
        assert text_counts(t)[:5] == brute_counts(t)
    assert quality(odd_docs(spark)).count() == len(ODD)
    assert quality(empty(odd_docs(spark))).count() == 0
    assert fit([]) == {}
    post = fit([((1, 1, 1), 900), ((-1, -1, 0), 60), ((0, -1, -1), 40)])  # good, bad, bad
    assert post[1, 1, 1] > 0.9 > 0.1 > post[-1, -1, 0]


def test_variety_has_no_switch_by_size(spark):
    r = random.Random(4)
    junk, rich = [f"word{'abcdefghij'[i % 10]}{'klmn'[i // 10]}" for i in range(40)], [f"w{i}" for i in range(9000)]
    made = {n: " ".join(r.choice(junk) for _ in range(n)) for n in (300, 1999, 2000, 2600, 5000)}
    made[6000] = " ".join(r.choice(rich) for _ in range(6000))
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    got = {x["doc_id"]: x["vote_variety"] for x in quality(df).collect()}
    assert got == {**dict.fromkeys(made, -1), 6000: 1}
    ids = np.array([r.randrange(30) for _ in range(90)])
    for size in (1, 7, 89, 90, 200):
        w = min(size, 90)
        assert stretch_distinct(ids, size) == sum(len(set(ids[s:s + w].tolist())) for s in range(90 - w + 1))


# ------------------------------------------------------------ op7

def brute_nearest(vectors, k):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in vectors]
    out = {}
    for i, v in ok:
        if i % 100 == 0:
            out[i] = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in ok if j != i)[:k]
    return out


def test_nearest(spark):
    v = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    want, got = brute_nearest(v, 10), defaultdict(dict)
    for r in queries.op7_nearest(spark, SF_SMALL).collect():
        got[r["query_id"]][r["rank"]] = (r["score"], r["vec_id"])
    hits = sum(len({x[1] for x in want[q]} & {x[1] for x in got[q].values()}) for q in want)
    assert hits >= 0.98 * sum(map(len, want.values()))
    for q in want:
        assert sorted(got[q]) == list(range(1, 11))


def test_nearest_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 2.0]), (1, [1.0, 0.0, 2.0]), (2, [1.0, 0.0, 2.0]), (3, [0.0, 0.0, 0.0]), (4, None), (5, [nan, 1.0, 1.0]),
            (6, [inf, 1.0, 1.0]), (7, [1.0, None, 1.0]), (8, [1.0, 2.0]), (100, [3.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("cell", F.lit(1))
    got = nearest(df, F.pmod(F.col("vec_id"), F.lit(100)) == 0, k=2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 2), (100, 1, 0), (100, 2, 1)]
    assert got[0]["score"] == 0.0
    assert nearest(empty(df), F.pmod(F.col("vec_id"), F.lit(100)) == 0).count() == 0


# ------------------------------------------------------------ op8

def article_text(page):
    m = re.search(r"<article>(.*?)(</article>|<footer>|$)", page or "", re.S)
    return " ".join(html_lib.unescape(re.sub(r"</?(p|br|h1|div)>", " ", m[1]).replace("<b>", "").replace("</b>", "")).split()) if m else ""


def test_main_text_of_pages(spark):
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    rows = queries.op8_main_text(spark, SF_SMALL).collect()
    assert len(rows) == len(html)
    for r in rows:
        assert r["text"] == article_text(html[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_main_text_odd_pages(spark):
    body = "".join(f"<p>Sentence number {i} of the story, told in full &amp; at length here.</p>" for i in range(6))
    pages = [(0, "u", f"<body><nav><a href=x>Home</a></nav><article>{body}</article><footer>(c) us</footer></body>"), (1, "u", None),
             (2, None, ""), (3, "u", f"<body><nav>Menu</nav><article>{body}<section class=comments><p>Nice one, I agree with it.</p></section>"),
             (4, "u", "<script>if (a < b) { '</p>' }</script>"), (5, "u", "<p>un<b>closed <i>tags"), (6, "u", "\x00<<>><p")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in html_crf.main_text(df).collect()}
    story = " ".join(f"Sentence number {i} of the story, told in full & at length here." for i in range(6))
    assert got[0]["text"] == story and got[3]["text"] == story
    assert got[1]["text"] == got[2]["text"] == got[4]["text"] == "" and got[1]["n_chars"] == 0
    assert html_crf.main_text(empty(df)).count() == 0
    assert html_crf.main_text(df.filter("page_id = 5")).first()["text"] == ""


def test_main_text_white_space_in_tags(spark):
    body = "".join(f"<p>Sentence number {i} of the story, told in full and at length here.</p>" for i in range(6))
    pages = [(i, "u", f"<body><nav><a href=x>Home</a></nav><{t}{gap}class=a>{body}</{t}><footer>(c) us</footer></body>")
             for i, (t, gap) in enumerate(itertools.product(("article", "main"), ("\n", "\t", "\r\n", "\f")))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    story = " ".join(f"Sentence number {i} of the story, told in full and at length here." for i in range(6))
    assert {r["text"] for r in html_crf.main_text(df).collect()} == {story}


@pytest.mark.parametrize("html", ["<div>x" * 170_000, "<b>x" * 250_000, "<b><h2>x" * 125_000, "<li class=a>a" * 70_000,
                                  "<p><span>" * 110_000, "<x>" * 170_000 + "</y>" * 120_000], ids=str.__len__)
def test_deep_pages_take_linear_time(html):
    began = time.process_time()
    page = html_crf.leaves(html)
    labels = html_crf.Crf().decode(html_crf.features(page))
    assert len(labels) == len(page) and time.process_time() - began < 60


def test_main_text_without_article_or_main(spark):
    """No page has an article or main element: the fit sees re-set pages only."""
    def story(i):
        return [f"Paragraph {k} of story {i} tells, in a good many plain words, how the day went on for them all." for k in range(6)]
    pages = [(i, "u", "<html><body><div class=nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></div><div class=content>"
              + "".join(f"<p>{x}</p>" for x in story(i)) + "</div><div class=sidebar><p>Most read today</p></div>"
              "<div class=footer>All rights reserved</div></body></html>") for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_crf.main_text(df).collect()}
    assert got == {i: " ".join(story(i)) for i in range(40)}


def test_crf_against_enumeration():
    r = np.random.default_rng(4)
    m = html_crf.Crf(r.normal(size=(html_crf.FEATURES, 2)), r.normal(size=(2, 2)), r.normal(size=2))
    feats = [np.array(sorted(r.choice(50, 3, replace=False))) for _ in range(6)]
    s = m.scores(feats)
    total = {y: m.start[y[0]] + sum(s[t, y[t]] for t in range(6)) + sum(m.move[y[t], y[t + 1]] for t in range(5))
             for y in itertools.product((0, 1), repeat=6)}
    z = np.logaddexp.reduce(list(total.values()))
    node, pair, log_z = m.marginals(s)
    assert math.isclose(z, log_z)
    assert np.allclose(node[2, 1], sum(math.exp(v - z) for y, v in total.items() if y[2] == 1))
    assert np.allclose(pair[3, 0, 1], sum(math.exp(v - z) for y, v in total.items() if y[3:5] == (0, 1)))
    assert tuple(m.decode(feats)) == max(total, key=total.get)


def test_crf_on_held_out_layouts(spark):
    """Weights fitted on some pages, tried on re-set layouts of others."""
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()]
    train = [x for i, h in pages if i % 2 for x in html_crf.labelled(h, i)]
    test = [x for i, h in pages if not i % 2 for x in html_crf.labelled(h, 1000 + i)]
    m = html_crf.Crf().fit(train)
    right = [a == b for f, y in test for a, b in zip(m.decode(f), y)]
    assert sum(right) >= 0.97 * len(right)


# ------------------------------------------------------------ op9

def test_hmm_forward_and_counts_against_enumeration(monkeypatch):
    r = np.random.default_rng(1)
    k = 3
    move = r.random((k, k))
    emit = r.random((hmm.CLASSES, k))
    m = hmm.Model(np.array([0.2, 0.3, 0.5]), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    seqs = [np.array(x, dtype=np.uint16) for x in ([4, 7, 4, 0], [5, 0], [0], [9, 9, 9, 9, 0], [7, 0])]

    def paths(s):
        for z in itertools.product(range(k), repeat=len(s)):
            p = m.start[z[0]] * m.emit[s[0], z[0]]
            for t in range(1, len(s)):
                p *= m.move[z[t - 1], z[t]] * m.emit[s[t], z[t]]
            yield z, p
    want = [math.log10(sum(p for _, p in paths(s))) for s in seqs]
    assert np.allclose(m.log10(seqs), want)
    start, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((hmm.CLASSES, k))
    for s in seqs:
        total = sum(p for _, p in paths(s))
        for z, p in paths(s):
            start[z[0]] += p / total
            for t in range(len(s)):
                emits[s[t], z[t]] += p / total
                if t:
                    moves[z[t - 1], z[t]] += p / total
    for a, b in zip(m.expected(seqs), (start, moves, emits)):
        assert np.allclose(a, b, atol=1e-5)


def test_hmm_columns_of_texts_are_taken_apart_as_single_texts():
    texts = ["  A b\x0bc\x1cd\x85 \u00c9 b ", "", None, " \n", "a", "\n\nB", "b  A"]
    cache = hmm.Hashes()
    want = [hmm.hashes(hmm.tokens(t), cache) for t in texts]
    for column in (pa.array(texts), pa.chunked_array([texts[:3], texts[3:]], pa.string()), pa.array([None], pa.string()), pa.array([], pa.string())):
        code, sizes, h = hmm.coded(column)
        own = want if len(column) == len(texts) else want[2:2 + len(column)]
        assert sizes.tolist() == [len(x) for x in own] and len(set(h.tolist())) == len(h)
        assert h[code].tolist() == [x for xs in own for x in xs.tolist()]
        assert [s.tolist() for s in hmm.sequences(code, sizes, h)] == [[*hmm.classes(x).tolist(), hmm.END] for x in own]


def test_hmm_single_precision_counts_of_unequal_texts():
    """Counts in single precision, texts ending at every step, against double precision."""
    r = np.random.default_rng(3)
    seqs = [np.append(r.integers(1, 40, n), hmm.END).astype(np.uint16) for n in (0, 0, 1, 2, 3, 5, 300, 40, 40, 41)]
    model = hmm.Model.initial()
    for a, b in zip(model.light().expected(seqs), model.expected(seqs)):
        assert np.allclose(a, b, rtol=1e-4, atol=1e-4)
    start, move, emit, fit = model.light().expected(seqs)
    assert math.isclose(start.sum(), len(seqs), rel_tol=1e-5) and math.isclose(emit.sum(), fit[1], rel_tol=1e-5)
    assert math.isclose(move.sum(), fit[1] - len(seqs), rel_tol=1e-5) and math.isclose(fit[0], model.log10(seqs).sum(), rel_tol=1e-5)


def test_hmm_scores(spark, docs):
    rows = {r["doc_id"]: r for r in queries.op9_hmm_score(spark, SF_SMALL).collect()}
    token = {i: [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in token}
    count = Counter(w for i, ws in token.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in token.items():
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    out = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_hmm_rounds_run_until_little_is_gained(spark, docs):
    model = hmm.train(spark.createDataFrame(docs, "doc_id long, text string"))
    cache = hmm.Hashes()
    seqs = [np.append(hmm.classes(hmm.hashes(hmm.tokens(t), cache)), np.uint16(hmm.END)) for _, t in docs]
    n = sum(map(len, seqs))
    start, move, emit, _ = model.expected(seqs)
    gain = (hmm.Model.from_counts(start, move, emit).log10(seqs).sum() - model.log10(seqs).sum()) / n
    assert 0 <= gain < 0.0015


def test_hmm_odd_rows(spark):
    df = odd_docs(spark)
    rows = hmm.lm_scores(df).collect()
    assert len(rows) == len(ODD) and all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 4)} == {1}
    assert hmm.lm_scores(empty(df)).count() == 0
    held = spark.createDataFrame([(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    for r in hmm.lm_scores(held).collect():
        assert r["train_tokens"] == 0 and r["n_known"] == 0 and math.isclose(r["base_score"], 0.0, abs_tol=1e-12)


# ------------------------------------------------------------ op10

def brute_shard(key, shards):
    """Spark's xxhash64(long, int): the hash of the first seeds the second."""
    h1 = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
    u = [((xxhash.xxh64_intdigest(s.to_bytes(4, "little"), h1) >> 11) + 0.5) / 2 ** 53 for s in range(shards)]
    return max(range(shards), key=lambda s: (-1 / math.log(u[s]), -s))


def test_sharding(spark, docs):
    rows = queries.op10_rendezvous(spark, SF_SMALL).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert (r["shard"], r["grown_shard"]) == (brute_shard(r["doc_id"], 40), brute_shard(r["doc_id"], 41))
        assert r["grown_shard"] in (r["shard"], 40) and r["law"] == "key"
    text = dict(docs)
    assert all(r["size"] == 16 + len((text[r["doc_id"]] or "").encode()) for r in rows)
    assert all(r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) for r in rows)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(rows) == len(docs)


def test_sharding_odd_rows_and_weights(spark):
    rows = sharded(odd_docs(spark)).collect()
    assert len(rows) == len(ODD) and len({(r["shard"], r["slot"]) for r in rows}) == len(ODD)
    assert sharded(empty(odd_docs(spark))).count() == 0
    ids = spark.range(30000).withColumnRenamed("id", "doc_id")
    got = Counter(r["shard"] for r in assign_shards(ids, {0: 1.0, 1: 3.0, 2: 0.0, 3: 2.0}).select("shard").collect())
    assert 2 not in got and abs(got[1] / 15000 - 1) < 0.05 and abs(got[0] / 5000 - 1) < 0.08
    with pytest.raises(ValueError):
        assign_shards(ids, {0: 0.0})
