"""Personal data in texts: fixed patterns, and what a semi-Markov CRF adds to them.

The patterns find e-mail addresses, IP addresses, card numbers and phone
numbers.  The CRF (:mod:`residua.llm.semicrf`) decodes the stretches of text
around digits and marks of addresses and adds entities that overlap no
pattern match: addresses written out with "(at)" and "dot", phone numbers
without a plus, and the like.

It is trained on the driver from a bounded sample: the stretches of the
``SAMPLE_DOCS`` documents with the least id hashes, at most
``SAMPLE_RUNS`` of them, labelled by the patterns, some of them rewritten
into the forms the patterns miss, and ``MADE_RUNS`` made-up stretches so that
it also learns where a table has few examples.

Defined results: null text is empty and has no spans; a very long text is
searched whole, with memory in proportion to its longest stretch of triggers;
of equally good segmentations the first one found stays; repeated rows are
judged one by one; an empty table gives an empty result (the model is then
trained on the made-up stretches alone); extra columns are left behind.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm import semicrf
from residua.llm.frames import slim
from residua.llm.semicrf import KINDS, MAX_WORDS, NONE, Run
from residua.llm.text import slices

SAMPLE_DOCS, SAMPLE_RUNS, MADE_RUNS = 4000, 250, 250
AROUND = 3                                  # words to each side of a trigger

_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_USER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits that fails from its start fails from everywhere inside it
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"\S+")

Span = tuple[int, int, int]                 # kind, start, end


def _addresses(text: str) -> Iterator[Span]:
    """The matches of ``_ADDRESS``, found from each @ so that long runs of letters are read once."""
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _USER:
            a -= 1
        m = _ADDRESS.match(text, a) if a < at else None
        if m:
            yield 0, *m.span()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def patterns(text: str) -> list[Span]:
    """Pattern matches by kind, then start; matches that fail their check are dropped."""
    out = list(_addresses(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text)
            if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and semicrf.luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text)
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def runs(text: str, taken: list[tuple[int, int]] | None = None) -> list[Run]:
    """The stretches of words around triggers; no entity overlaps the sorted spans of ``taken``."""
    hits = [m.start() for m in semicrf.TRIGGER.finditer(text)] if semicrf.may_trigger(text) else []
    if not hits:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    starts = [a for a, _ in words]
    out, first, last = [], None, None
    for h in hits:
        k = bisect.bisect_right(starts, h) - 1
        a, z = max(0, k - AROUND), min(len(words), k + AROUND + 1)
        if first is None:
            first, last = a, z
        elif a <= last:
            last = max(last, z)
        else:
            out.append((first, last))
            first, last = a, z
    out.append((first, last))
    return [Run(text, words[a:z], taken) for a, z in out]


def added(model, text: str, base: list[Span]) -> list[Span]:
    """Entities of the best segmentation that leaves the pattern matches as they are."""
    taken = sorted((a, z) for _, a, z in base)
    return [found for run in runs(text, taken) for found in semicrf.decode(*model, run)]


# ---------------------------------------------------------------- training

def example(text: str, spans: list[Span]) -> tuple[Run, dict] | None:
    """One run over a short text with its gold segmentation; None where spans do not fit whole words."""
    words = [m.span() for m in _WORD.finditer(text)]
    run, gold, used = Run(text, words), {}, set()
    for kind, a, z in spans:
        i = next((k for k, w in enumerate(words) if w[1] > a), None)
        j = max((k for k, w in enumerate(words) if w[0] < z), default=-1)
        if i is None or j - i >= MAX_WORDS or used & set(range(i, j + 1)):
            return None
        if not any(s[0] == i and s[1] >= 0 for s in run.at[j + 1]):
            return None
        used |= set(range(i, j + 1))
        gold[i, j + 1] = kind
    gold.update({(k, k + 1): NONE for k in range(len(words)) if k not in used})
    return (run, gold) if words else None


def rewrite(rng: random.Random, kind: int, s: str) -> str:
    """An entity in a form that the patterns miss."""
    if kind == 0:
        at, dot = rng.choice([(" (at) ", "."), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "(dot)"),
                              (" at ", " dot "), (" (at) ", " (dot) "), (" at ", "."), (" at ", "."), (" at ", " [.] ")])
        if rng.random() < 0.3:
            at, dot = at.upper(), dot.upper()
        user, _, host = s.partition("@")
        return user + at + host.replace(".", dot)
    if kind == 1:
        return s.replace(".", "[.]")
    if kind == 3:
        bare = s.lstrip("+")
        digits = "".join(c for c in bare if c.isdigit())
        return rng.choice([f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", f"0{digits[-9:-6]} {digits[-6:]}",
                           f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}", bare])
    return s


def made(rng: random.Random, filler: list[str]) -> tuple[str, list[Span]]:
    """A made-up stretch with one entity, or with a number that is none."""
    def n(k):
        return "".join(rng.choice("0123456789") for _ in range(k))

    kind = rng.choice([0, 1, 2, 3, NONE, NONE, NONE])
    if kind == 0:
        s = f"{rng.choice(filler)}{rng.choice(['.', '_', ''])}{n(rng.randrange(3))}@{rng.choice(filler)}" \
            f".{rng.choice(['com', 'org', 'example.net', 'de'])}"
    elif kind == 1:
        s = ".".join(str(rng.randrange(256)) for _ in range(4))
    elif kind == 2:
        body = n(rng.choice([14, 15, 15]))
        s = next(body + d for d in "0123456789" if semicrf.luhn(body + d))
        s = rng.choice([s, " ".join(re.findall("....?", s)), "-".join(re.findall("....?", s))])
    elif kind == 3:
        s = f"+{rng.randrange(1, 99)} ({n(3)}) {n(3)}-{n(4)}" if rng.random() < 0.5 else f"+{n(2)} {n(3)} {n(7)}"
    else:
        s = rng.choice([f"{1900 + rng.randrange(150)}", f"{n(4)}-{n(2)}-{n(2)}", f"{rng.randrange(28)}.{rng.randrange(12)}.{n(4)}",
                        f"{n(2)}:{n(2)}", f"{n(rng.randrange(1, 5))}.{n(2)}", f"{rng.randrange(9)}.{rng.randrange(20)}.{n(1)}",
                        f"version {rng.randrange(9)}.0", f"token = \"{hashlib.md5(n(9).encode()).hexdigest()}\"",
                        f"page {n(3)}", f"{n(3)} {n(3)}", f"at {n(2)}", n(rng.randrange(1, 9)), n(rng.choice([16, 16, 20, 24])),
                        f"{n(4)}/{n(2)}", f"{rng.choice(filler)} at {rng.choice(filler)} {n(2)}", f"{n(1)},{n(3)},{n(3)}",
                        f"@{rng.choice(filler)}", f"dot {rng.choice(filler)}",
                        f"{n(2)}, {n(1)} dot {rng.choice(filler)}", f"{rng.choice(filler)} dot {rng.choice(filler)}"])
        digits = "".join(c for c in s if c.isdigit())
        if 13 <= len(digits) <= 19 and semicrf.luhn(digits):
            s = digits[:-1] + str((int(digits[-1]) + 1) % 10)
    if kind != NONE and rng.random() < 0.4:
        s = rewrite(rng, kind, s)
    left = " ".join(rng.choice(filler) for _ in range(rng.randrange(4)))
    right = " ".join(rng.choice(filler) for _ in range(rng.randrange(4)))
    text = f"{left} {s}{rng.choice(['', '.', ',', '!!', ' ###'])} {right}".strip()
    a = text.index(s)
    return text, [(kind, a, a + len(s))] if kind != NONE else []


def train(sample: list[tuple[str, list[Span]]]):
    """The model from sampled stretches and made-up ones."""
    rng = random.Random(5)
    filler = sorted({w for t, _ in sample for w in re.findall(r"[^\W\d_]{2,12}", t)})[:500] or \
        ["the", "name", "is", "von", "para", "with", "lorem", "ipsum", "user", "info"]
    texts = []
    for text, spans in sample:
        texts.append((text, spans))
        if len(spans) == 1 and rng.random() < 0.5:
            kind, a, z = spans[0]
            s = rewrite(rng, kind, text[a:z])
            texts.append((text[:a] + s + text[z:], [(kind, a, a + len(s))]))
    texts += [made(rng, filler) for _ in range(MADE_RUNS)]
    return semicrf.fit([e for t in texts if (e := example(*t)) is not None])


def _sample(docs: DataFrame) -> list[tuple[str, list[Span]]]:
    """Stretches of the sampled documents with their pattern matches; at most ``SAMPLE_RUNS``."""
    ids = docs.select("id").filter("id IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                base = patterns(t or "")
                for r in runs(t or ""):
                    a, z = r.words[0][0], r.words[-1][1]
                    inside = [(k, s - a, e - a) for k, s, e in base if s >= a and e <= z]
                    if z - a <= 400:
                        out.append((t[a:z], ";".join(f"{k} {s} {e}" for k, s, e in inside)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["t", "spans"])

    # SAMPLE_DOCS ids: safe to broadcast at any input size
    found = docs.join(F.broadcast(ids.distinct()), "id", "left_semi").select("text").mapInArrow(cut, "t string, spans string")
    rows = found.orderBy(F.xxhash64("t"), "t").limit(SAMPLE_RUNS).collect()
    return [(r["t"], [tuple(map(int, s.split())) for s in r["spans"].split(";") if s]) for r in rows]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id, base, added``, lists of (kind, start, end) in code points."""
    rows = slim(docs, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(train(_sample(rows)))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(iter([whole]), "text"):
                base, more = [], []
                for t in b.column(1).to_pylist():
                    t = t or ""
                    some = semicrf.may_trigger(t)
                    base.append(patterns(t) if some else [])
                    more.append(added(model.value, t, base[-1]) if some else [])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *(pa.array([[{"kind": KINDS[k], "start": a, "end": z} for k, a, z in sorted(s)]
                                              for s in x], span) for x in (base, more))], ["id", "base", "added"])

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(find, f"id bigint, base {kind}, added {kind}")
