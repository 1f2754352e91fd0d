import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from residua.llm import repair as R

LEGAL = re.compile(r"(s?(ua)+)?")


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        solid = text.rstrip(" \t\n\x0b\x0c\r")
        if not solid:
            out.append(R.BLANK)
        elif (role, text) in seen:
            out.append(R.DUPLICATE)
        else:
            out.append(R.SOUND if solid[-1] in ".!?" else R.TRUNCATED)
        seen.add((role, text))
    return out


def damaged(conv, rows):
    out = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        how = zlib.crc32(key.encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def cheapest(rows):
    """Cost, audit and lines by search over all edit sequences with at most one insertion pair a gap."""
    fault = faults(rows)

    @lru_cache(None)
    def best(i, last, room):
        options = []
        if i == len(rows) and last in ("", "a"):
            options.append((0, "", ()))
        if room:
            new = "a" if last == "u" else "u"
            c, a, t = best(i, new, room - 1)
            options.append((c + 5, "I" + a, ({"u": "user", "a": "assistant"}[new] + ":", *t)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, t = best(i + 1, last, 3)
            options.append((c + 2, "D" + a, t))
            if fault[i] in (R.SOUND, R.TRUNCATED):
                more = 5 if fault[i] == R.TRUNCATED else 0
                first, nxt = role[:1], "a" if last == "u" else "u"
                if first == nxt or (first == "s" and last == ""):
                    c, a, t = best(i + 1, first, 3)
                    options.append((c + more, "K" + a, (f"{role}:{text}", *t)))
                c, a, t = best(i + 1, nxt, 3)
                options.append((c + 1 + more, "R" + a, ({"u": "user", "a": "assistant"}[nxt] + f":{text}", *t)))
        return min(options, default=(10 ** 9, "", ()))
    return best(0, "", 3)


def brute(conv, rows):
    rows = damaged(conv, rows)
    fault = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, lines = cheapest(tuple(rows))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(fault.count(f) for f in (R.BLANK, R.DUPLICATE, R.TRUNCATED)), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(seed, n=60):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "union"]
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n\t", None, "é.", "Yes.", "no stop  ", "end. \n", "line\nline?"]
    out = []
    for conv in [None, *range(n)]:
        turn = 0
        for _ in range(rng.randrange(0, 9)):
            turn += rng.choice([0, 1, 1, 1, 3])
            out.append((conv, None if rng.random() < .07 else turn, rng.choice(roles), rng.choice(texts)))
    return out


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "conv_id bigint, turn bigint, role string, text string, fault string, copy int")
    return R.damage(R.clean_rows(df.repartition(parts))), df


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_audits(spark, seed):
    rows = conversations(seed)
    by_conv = {}
    for conv, *rest in rows:
        by_conv.setdefault(conv, []).append(tuple(rest))
    want = sorted((brute(c, r) for c, r in by_conv.items()), key=repr)
    got = R.repair_audits(run(spark, rows)[0])
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_repaired_rows_are_legal(spark):
    df, _ = run(spark, conversations(4))
    found = {}
    for r in R.repaired(df).orderBy("conv_id", "line").collect():
        found.setdefault(r.conv_id, []).append(r)
    digests = {r.conv_id: r.repaired_sha256 for r in R.repair_audits(df).collect()}
    for conv, sha in digests.items():
        lines = found.get(conv, [])
        assert [r.line for r in lines] == list(range(1, len(lines) + 1))
        assert LEGAL.fullmatch("".join(r.role[:1] for r in lines))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in lines).encode()).hexdigest() == sha


def test_hot_conversation(spark):
    """One long conversation, much of it the same turn again and again, beside many short ones."""
    rng = random.Random(5)
    rows = [(7, i // 2, rng.choice(["user", "assistant"]), rng.choice(["Same.", "Same.", f"text {i}."])) for i in range(3000)]
    rows += [(c, t, r, "Fine.") for c in range(100, 200) for t, r in ((0, "user"), (1, "assistant"))]
    got = {r.conv_id: tuple(r) for r in R.repair_audits(run(spark, rows)[0]).collect()}
    hot = damaged(7, [tuple(r[1:]) for r in rows if r[0] == 7])
    fault = faults(hot)
    assert len(got) == 101
    assert got[7][2:5] == tuple(fault.count(f) for f in (R.BLANK, R.DUPLICATE, R.TRUNCATED))
    assert sum(e != "I" for e in got[7][7]) == len(hot)


def test_layer_prices_are_distances():
    """Auction prices of a layer equal the least cost over all chains of insertions."""
    for initial in ("s", "u", "a", ""):
        for fault in (R.SOUND, R.BLANK, R.DUPLICATE, R.TRUNCATED):
            for after in itertools.product((0, 1, 4, 9), repeat=4):
                if min(after):
                    continue
                lattice = R.arcs(initial, fault)
                prices, moves = R.layer(initial, fault, after)
                for role in range(4):
                    want, cost, at = [], 0, role
                    for n in range(4):
                        want += [(cost + c + after[to], "I" * n + e, to) for e, c, used, to in lattice[at] if used]
                        cost, at = cost + R.INSERT, R.NEXT[at]
                    least = min(want)
                    assert prices[role] == least[0] and moves[role] == least[1:]


def test_empty(spark):
    assert R.repair_audits(run(spark, [])[0]).count() == 0
    assert R.repaired(run(spark, [])[0]).count() == 0


def test_long_text(spark):
    long = "word " * 200_000 + "."
    rows = [(1, 0, "user", long), (1, 1, "assistant", "Ok.")]
    row, = R.repair_audits(R.clean_rows(run(spark, rows)[1])).collect()
    assert (row.audit, row.cost) == ("KK", 0)
