import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from residua.llm import merkle as M
from tests.llm.conftest import messy_rows

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, idx string, digest string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes, arity):
    """Root, and each node's path: (slot, siblings) level by level."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for k in range(len(paths)):
            run = nodes[at[k] // arity * arity:][:arity]
            slot = at[k] % arity
            paths[k].append((slot, run[:slot] + run[slot + 1:]))
            at[k] //= arity
        nodes = [h(*nodes[i:i + arity]) for i in range(0, len(nodes), arity)]
    return (nodes[0] if nodes else None), paths


def brute(rows, arity):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    found, subroots = [], []
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, paths = tree([leaf(r) for r in mine], arity)
        subroots.append(root)
        found.append((mine, root, paths))
    root, ups = tree(subroots, arity)
    out = []
    for (mine, sub, paths), up in zip(found, ups, strict=True):
        for r, path in zip(mine, paths, strict=True):
            doc = r[0]
            bad = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0 and r[3] is not None
            digest = leaf((*r[:3], r[3] + 1, r[4]) if bad else r)
            for slot, others in path + up:
                digest = h(*others[:slot], digest, *others[slot:])
            out.append((doc, leaf(r), sub, root, h(*[x for _, o in path + up for x in o]), digest, digest == root))
    return sorted(out, key=repr)


def got(spark, rows, arity):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    bad = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1)
    out = M.manifest(df, arity=arity, now={"n_chars": F.coalesce(bad, "n_chars")}).drop("path")
    return sorted(map(tuple, out.collect()), key=repr)


def sample(n):
    return [(i * 3 - 20, f"s{i % 4}", ["en", "en", "en", "de", "é", ""][i % 6], None if i % 11 == 0 else i, f"text {i}é")
            for i in range(n)]


MESSY = [(r[0], r[3], r[2], None if r[1] is None else len(r[1]), r[1]) for r in messy_rows()]


@pytest.mark.parametrize("arity", [2, 3, 5])
@pytest.mark.parametrize("rows", [sample(83), MESSY, sample(1), [(5, None, None, None, None)] * 3],
                         ids=["sample", "messy", "one", "repeated"])
def test_manifest(spark, rows, arity):
    want = brute(rows, arity)
    assert got(spark, rows, arity) == want
    assert all(w[6] for w in want if w[0] is None or zlib.crc32(str(w[0]).encode()) % 7)


def test_tampering_is_seen(spark):
    verdicts = {r[0]: r[6] for r in got(spark, sample(83), 2)}
    altered = {r[0] for r in sample(83) if zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None}
    assert altered and {d for d, ok in verdicts.items() if not ok} == altered


def test_empty(spark):
    assert got(spark, [], 2) == []
    with pytest.raises(ValueError):
        M.manifest(spark.createDataFrame([], SCHEMA), arity=1)


def test_large_group_is_numbered_in_parts(spark):
    rows = [(i, "s", "en", i, "t") for i in range(997)]
    assert got(spark, rows, 2) == brute(rows, 2)
    df = spark.createDataFrame([("t", i) for i in range(5000)], "tree string, id bigint").repartition(7)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = M._numbered(df, ["id"])
        assert numbered.filter("idx <> id or width <> 5000").count() == 0
        assert numbered.count() == 5000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


@pytest.mark.parametrize("arity, span", [(2, 4), (3, 9), (5, 3)])
def test_trees_over_many_blocks(spark, monkeypatch, arity, span):
    monkeypatch.setattr(M, "SPAN", span)
    rows = sample(83) + [(1000 + i, "s", f"l{i:02}", i, "t") for i in range(11)] + [(7, "s", "en", 1, "t")] * 3
    assert got(spark, rows, arity) == brute(rows, arity)


def test_plan_does_not_grow_with_levels(spark):
    """A tree of 1,200 leaves has eleven levels in two tables; the driver once held a plan with joins for each level."""
    df = spark.range(1200).selectExpr("id AS doc_id", "'s' AS source", "'en' AS lang", "id AS n_chars", "'t' AS text")
    out = M.manifest(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum(x.lstrip(" :+-").startswith("Join") for x in plan.splitlines()) <= 4
    assert out.filter("size(path) <> 11 OR NOT verified").count() == 0
