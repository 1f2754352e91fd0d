"""Exact copies, near copies and repeated passages against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from residua.llm import components, exact_dedup, near_dedup, substring_dedup
from residua.llm import text as T
from residua.llm.frames import table

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(t):
    return (t or "").encode().split()


# ------------------------------------------------------------------ word helpers

def test_words_match_bytes_split():
    rng = random.Random(0)
    texts = ["".join(rng.choice("ab é\t\n\x0b\x0c\r Z") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += [None, "", "a", "a" * 50]
    data, off = T.buffers(pa.array(texts))
    s, e, doc, h = T.words(data, off)
    want = [(i, w) for i, t in enumerate(texts) for w in words(t)]
    assert [(int(d), bytes(data[a:z])) for d, a, z in zip(doc, s, e, strict=True)] == want
    by_word = defaultdict(set)
    for (_, w), x in zip(want, h.tolist(), strict=True):
        by_word[w].add(x)
    assert all(len(v) == 1 for v in by_word.values())
    assert len({next(iter(v)) for v in by_word.values()}) == len(by_word)


def test_words_across_pieces(monkeypatch):
    texts = pa.array(["one two " + "long" * 40, "three  four", "", "x" * 100 + " y"])
    data, off = T.buffers(texts)
    whole = T.words(data, off)
    monkeypatch.setattr(T, "PIECE", 16)
    for a, b in zip(whole, T.words(data, off), strict=True):
        assert np.array_equal(a, b)


def test_slices_keep_all_rows():
    rng = random.Random(1)
    batches = [pa.RecordBatch.from_arrays([pa.array(["x" * rng.randrange(40) for _ in range(n)])], ["t"])
               for n in (0, 1, 7, 30)]
    want = [v for b in batches for v in b.column(0).to_pylist()]
    for gather in (False, True):
        for limit in (1, 50, 10_000):
            assert [v for b in T.slices(iter(batches), "t", limit, gather) for v in b.column(0).to_pylist()] == want


# ------------------------------------------------------------------ exact copies

def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(FOLD)].append(i)
    out = []
    for i, t in rows:
        g = groups[(t or "").translate(FOLD)]
        best = max((x for x in g if x is not None), default=None)
        out.append((i, best, len(g), hashlib.sha256((t or "").translate(FOLD).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("counters", [1, 1000])
def test_exact_dedup(messy, counters):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    got = exact_dedup.exact_dedup(messy, counters=counters).collect()
    assert Counter((r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == brute_exact(rows)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({r["text_sha256"] for r in got})
    assert all(r["id"] == r["keep_id"] for r in got if r["kept"])


def test_misra_gries_bound():
    rng = random.Random(2)
    data = [b"hot" if rng.random() < 0.3 else str(rng.randrange(500)).encode() for _ in range(5000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(data[a:a + 400])], ["digest"]) for a in range(0, 5000, 400)]
    true, held = Counter(data), exact_dedup.misra_gries(iter(batches), 20)
    assert len(held) <= 20
    for k, v in true.items():
        assert v - 5000 / 21 <= held.get(k, 0) <= v


def test_drop_exact_copies_keeps_columns(messy, empty):
    out = exact_dedup.drop_exact_copies(messy)
    assert out.columns == messy.columns
    texts = [(r["text"] or "").translate(FOLD) for r in out.collect()]
    assert len(texts) == len(set(texts))
    assert exact_dedup.drop_exact_copies(empty).count() == 0
    assert exact_dedup.exact_dedup(empty).count() == 0


# ------------------------------------------------------------------ near copies

def shingles(t, k):
    w = (t or "").translate(FOLD).encode().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_near(rows, k):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return Counter((d, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None))
                   for i, (d, _) in enumerate(rows))


def clusters(seed=3):
    """Chains of texts near the threshold, and a group of hundreds around one original."""
    rng = random.Random(seed)
    rows, n = [], 0
    for size, length, cut in ((160, 100, 6), (12, 60, 2), (8, 200, 12), (5, 9, 1), (30, 5, 1)):
        base = [f"v{rng.randrange(10_000)}" for _ in range(length)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(cut + 1)):
                w[rng.randrange(length)] = f"n{rng.randrange(10 ** 6)}"
            if rng.random() < 0.3:
                base = w
            rows.append((n, " ".join(w)))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bounds", [{}, {"max_bucket": 5}, {"max_shingles": 700}])
def test_near_dedup_loses_no_link(spark, bounds):
    rows = clusters()
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4, **bounds).collect()
    assert Counter((r["id"], r["n_shingles"], r["component_id"]) for r in got) == brute_near(rows, 4)
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got)


def test_blocks_of_a_large_bucket_meet(spark):
    """A star around an original that is not the least row, and a pair beside it, in buckets over the bounds."""
    entities = [(r, 100) for r in range(40)]
    near = {(min(x, 23), max(x, 23)) for x in range(40) if x not in (0, 5, 23, 31)} | {(5, 31)}

    def pairs(lists):
        held = defaultdict(set)
        for r in lists.collect():
            held[r["list"]].add(r["row"])
        assert max(map(len, held.values())) < 40
        return {(a, b) for x in held.values() for a in x for b in x if a < b}

    sig = np.zeros(near_dedup.BINS, np.uint16).tobytes()
    table_ = spark.createDataFrame([(r, n, bytearray(sig)) for r, n in entities], "row long, n_shingles long, sig binary")
    for bounds in ((8, 10 ** 6), (10 ** 6, 800)):
        lists, large = near_dedup.candidate_lists(table_, *bounds)
        found = pairs(lists) & near
        roots = components.connected_components(spark.createDataFrame(sorted(found) or [(0, 0)], "a long, b long"))
        found |= pairs(near_dedup.remaining_lists(large, roots, *bounds)) & near
        root = components.connected_components(spark.createDataFrame(sorted(found), "a long, b long")).collect()
        assert {r["node"]: r["root"] for r in root} == {**{x: 1 for x in range(1, 40) if x not in (5, 31)}, 5: 5, 31: 5}


def test_near_dedup_star_around_a_late_original(spark):
    """Variants of one original, near it and not near each other, in buckets over the bound."""
    rng = random.Random(8)
    base = [f"s{i}" for i in range(200)]
    rows = []
    for n in range(301):
        w = list(base)
        for at in rng.sample(range(4, 196, 5), 4) if n != 211 else ():
            w[at] = f"n{n}x{at}"
        rows.append((n, " ".join(w)))
    want = brute_near(rows, 5)
    assert {c for _, _, c in want} == {0}
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), max_bucket=5).collect()
    assert Counter((r["id"], r["n_shingles"], r["component_id"]) for r in got) == want


def test_near_dedup_messy(messy, empty):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect() if words(r["text"])]
    got = near_dedup.near_dedup(messy).collect()
    assert len(got) == messy.count()
    assert Counter((r["id"], r["n_shingles"], r["component_id"]) for r in got if r["n_shingles"]) == brute_near(rows, 5)
    for r in got:
        if not r["n_shingles"]:
            assert r["component_id"] == r["id"] and r["kept"]
    assert Counter(r["component_id"] for r in got if r["kept"]).most_common(1)[0][1] == 1
    kept = near_dedup.keep_one_each(messy)
    assert kept.columns == messy.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["id"] for r in got if r["kept"])
    assert near_dedup.near_dedup(empty).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = T.mix(rng.integers(0, 1 << 62, 4000).astype(np.uint64))
    for size in (5, 60, 3000):
        x = np.sort(pool[:size])
        for share in (0.5, 0.8, 1.0):
            y = np.sort(np.concatenate([x[:int(size * share)], T.mix(x[int(size * share):] + np.uint64(9))]))
            true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            same = (near_dedup.signature(x) == near_dedup.signature(y)).mean()
            assert abs(same - true) < (0.45 if size == 5 else 0.15)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + \
        [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)


# ------------------------------------------------------------------ repeated passages

def brute_repeats(rows, k):
    first = {}
    for i, t in rows:
        w = words(t)
        i = -1 if i is None else i
        for a in range(len(w) - k + 1):
            key = tuple(w[a:a + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for a in range(len(w) - k + 1):
            if first[tuple(w[a:a + k])] < (-1 if i is None else i):
                gone.update(range(a, a + k))
        out.append((i, len(w), len(gone), b" ".join(x for a, x in enumerate(w) if a not in gone).decode()))
    return Counter(out)


def test_remove_repeats(spark):
    rng = random.Random(5)
    passages = [[f"p{i}q{j}" for j in range(rng.randrange(13, 60))] for i in range(6)]
    rows = []
    for i in range(80):
        w = [f"u{rng.randrange(3000)}" for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a, z = sorted((rng.randrange(len(p)), rng.randrange(len(p))))
            w += p[a:z + 1] + w[:rng.randrange(5)]
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substring_dedup.remove_repeats(docs, n_buckets=7).collect()
    assert Counter((r["id"], r["n_words"], r["n_removed"], r["text"]) for r in got) == brute_repeats(rows, 13)
    by_id = dict(rows)
    for r in got:
        for f in r["factors"]:
            mine, ref = words(by_id[r["id"]]), words(by_id[f["ref_id"]])
            assert f["ref_id"] < r["id"] and f["n_words"] >= 13
            assert mine[f["start"]:f["start"] + f["n_words"]] == ref[f["ref_start"]:f["ref_start"] + f["n_words"]]


def test_remove_repeats_messy(messy, empty):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    got = substring_dedup.remove_repeats(messy).collect()
    assert Counter((r["id"], r["n_words"], r["n_removed"], r["text"]) for r in got) == brute_repeats(rows, 13)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_same_id_different_texts(spark):
    shared = " ".join(f"s{i}" for i in range(20))
    rows = [(1, shared), (2, "a b " + shared), (2, shared + " c d e"), (2, "x " * 30)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["id"], r["n_words"], r["n_removed"], r["text"]) for r in got) == brute_repeats(rows, 13)


def test_passages_of_the_small_table(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = substring_dedup.remove_repeats(docs).collect()
    assert Counter((r["id"], r["n_words"], r["n_removed"], r["text"]) for r in got) == brute_repeats(rows, 13)
    assert sum(r["n_removed"] for r in got) > 0


def test_hub_of_a_component_is_split(spark, monkeypatch):
    """A star of 100,000 edges, no broadcasts: both joins of a round split the hub's partition."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    plans, write = [], components.written

    def watched(df, name):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(components, "written", watched)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        star = spark.range(1, 100_001).select((F.col("id") + 7).alias("a"), F.lit(3).cast("bigint").alias("b"))
        chain = spark.range(1, 50).select((F.col("id") * -1).alias("a"), (F.col("id") * -1 - 1).alias("b"))
        # edges from a hub that is not the least node, so that every edge has to move
        hub = spark.range(1, 100_001).select(F.lit(10 ** 6).cast("bigint").alias("a"), (F.col("id") + 2 * 10 ** 6).alias("b"))
        roots = components.connected_components(star.union(chain).union(hub))
        assert {r[0]: r[1] for r in roots.groupBy("root").count().collect()} == {3: 100_001, 10 ** 6: 100_001, -50: 50}
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    joined = [p for p in plans if "SortMergeJoin" in p]
    assert len(joined) >= 2 and any("SortMergeJoin(skew=true)" in p for p in joined)
    assert not any("BroadcastHashJoin" in p for p in joined)
