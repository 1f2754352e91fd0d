import re

import pytest

from residua.llm import decontaminate as D
from tests.llm.conftest import CLASH, LONG

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(docs, items, n=10):
    grams = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            grams.setdefault(tuple(w[i:i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(g) for g in grams}:
            for i in range(len(w) - size + 1):
                got = grams.get(tuple(w[i:i + size]))
                if got:
                    hit |= set(range(i, i + size))
                    found |= got
        out.append((doc_id, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


PASSAGE = " ".join(f"Item{i}" for i in range(14))
ITEMS = [(1, PASSAGE), (2, "Only, three WORDS"), (3, None), (4, " ... "), (5, PASSAGE.split(" ", 2)[2]), (5, "lone"),
         (None, "Größe über alles"), (10, " ".join(["rep"] * 12)), (1, PASSAGE)]
DOCS = [
    (1, "before " + PASSAGE.lower() + " after"), (2, "Item0-item1," + PASSAGE.split(" ", 1)[1].replace(" ", "\n;")),
    (3, " ".join(PASSAGE.split()[:9])), (4, "x " * 5 + " ".join(PASSAGE.split()[3:13])), (5, None), (6, ""), (7, " ?! "),
    (8, "say only three words, only three words only three"), (9, "GRÖSSE größe über alles GRÖßE Über alles"),
    (10, " ".join(["rep"] * 40)), (11, "lone"), (12, LONG + " " + PASSAGE + " " + LONG), (None, PASSAGE), (13, PASSAGE),
    (13, PASSAGE), (13, "another text"), (14, PASSAGE + " " + PASSAGE), (15, "\x80wörter \U0001F600 " + PASSAGE),
]


@pytest.fixture(scope="module")
def tables(spark):
    clash = ", ".join(f"{c} string" for c in CLASH)
    docs = spark.createDataFrame([(*d, *("x",) * len(CLASH)) for d in DOCS], f"doc_id bigint, text string, {clash}")
    items = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id bigint, text string, words string")
    return docs.repartition(3), items


def rows(df):
    return sorted(((r.id, r.n_words, r.n_hit, tuple(r["items"])) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n", [10, 4, 1])
@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 0])
def test_find_leaks(tables, n, limit):
    assert rows(D.find_leaks(*tables, n=n, broadcast_bytes=limit)) == brute(DOCS, ITEMS, n)


def test_given_tables(spark, sf_small):
    docs, items = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert any(w[2] for w in want)
    for limit in (D.BROADCAST_BYTES, 0):
        assert rows(D.find_leaks(docs, items, broadcast_bytes=limit)) == want


def test_removal(tables):
    docs, items = tables
    want = {(d, t) for d, t in DOCS if not [b for b in brute([(d, t)], ITEMS) if b[2]]}
    clean = D.remove_documents(docs, items)
    assert clean.columns == docs.columns
    assert {(r.doc_id, r.text) for r in clean.collect()} == want
    cut = D.remove_spans(docs, items)
    assert cut.columns == docs.columns and cut.count() == len(DOCS)
    got = {(r.doc_id, r.text) for r in cut.collect()}
    assert want <= got
    assert {(1, "before after"), (4, "x " * 5), (8, "say only three"), (None, ""), (14, "")} <= got
    assert (12, LONG + " " + LONG) in got


def test_empty_tables(tables):
    docs, items = tables
    assert D.find_leaks(docs.limit(0), items).count() == 0
    none = D.find_leaks(docs, items.limit(0))
    assert none.count() == len(DOCS) and none.filter("n_hit > 0 or size(items) > 0").count() == 0
    assert D.remove_documents(docs, items.limit(0)).count() == len(DOCS)


def test_texts_are_not_shuffled(tables):
    docs, items = tables
    leaks, _ = D._leaks(docs, items, 10, "doc_id", "text", D.BROADCAST_BYTES)
    plan = leaks._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "broadcast" in plan
    assert "words" not in leaks.columns
