"""Conversation structure repair: the cheapest edits that give a legal order of turns.

A legal order of role initials is ``(s?(ua)+)?``.  Rows are kept (0), given
the role user or assistant (1), deleted (2, required for blank and duplicate
rows), or turns with empty text are inserted (5); a truncated row that is not
deleted adds 5.  The nodes of the lattice are (rows consumed, last role), its
arcs the edits.

Prices come from the auction shortest-path algorithm.  A path starts at a
node whose price is not final.  If the price of the path's last node is less
than the cost of every arc plus the price at its end, it is raised to the
least of them and the path contracts by that node; otherwise the path is
extended along a tight arc.  A path that reaches a node with a final price
has made all its nodes' prices final: their exact distance to the end.  Rows
are taken from the last to the first, so a path stays within one layer of
four nodes and starts from prices at most a few units too low; its steps
depend only on the row's kind and on the differences of the next layer's
prices, and are remembered by those.  Final prices expose the tight arcs;
following the ASCII-least one at every node from the start gives, of all
cheapest edits, the least sequence of initials ``D < I < K < R``.

On Spark: faults are found by aggregates and one join whose hot keys can be
split.  Each conversation's rows are then walked twice within a partition, as
sorted streams: from the last row to the first to write each row's tight
moves beside it, and from the first to the last to follow them.  A task holds
one Arrow batch and four prices, however long the conversation is.  The
digest of a repaired conversation is sequential, so one task walks it.

Defined results: null roles and texts become one space; null turns come
first; rows with a null conversation id form one conversation; rows of one
turn are ordered by role and text (bytewise); rows that repeat in role and
text are duplicates after the first; a role counts by its first character
only, whatever follows; very long texts are streamed whole; a conversation
without rows gives zeros, an empty audit and the digest of the empty string;
an empty table gives an empty result; extra columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.operators._keys import join_on_keys

SPACE = "\t\n\x0b\x0c\r "
STOPS = ".!?"

# --- rows and damage -------------------------------------------------------------------------------------------------

def clean_rows(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, copies`` (1); null role and text become one space."""
    return conversations.select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))],
        F.lit(1).alias("copies"))


def damage(rows: DataFrame) -> DataFrame:
    """Rows of :func:`clean_rows`, damaged by ``crc32(conv_id:turn) % 20``.

    0: dropped (no copies), 1: text emptied, 2: full stops and the like removed,
    3: said twice, 4: role user.
    """
    how = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])) % 20
    return rows.select(
        "conv_id", "turn", F.when(how == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(how == 1, "").when(how == 2, F.translate("text", STOPS, "")).otherwise(F.col("text")).alias("text"),
        F.when(how == 0, 0).when(how == 3, F.col("copies") * 2).otherwise(F.col("copies")).alias("copies"))


# --- faults -------------------------------------------------------------------------------------------------

#: no row of the conversation; sound; and the faults, of which a row's first counts
GONE, SOUND, BLANK, DUPLICATE, TRUNCATED = range(5)


def find_faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copy, fault``; a row without copies stays one row, GONE."""
    # equal rows of one turn are neighbours in the order: count them, so that repeats cannot pile up under a key
    runs = (rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
            .withColumn("said", F.sha2("text", 256)).withColumn("when", F.struct(F.col("turn").isNotNull(), "turn")))
    first = runs.filter("copies > 0").groupBy("conv_id", "role", "said").agg(F.min("when").alias("first"))
    runs = join_on_keys(runs, first, ["conv_id", "role", "said"])
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    fault = (F.when(F.col("copies") == 0, GONE).when(last == "", BLANK)
             .when((F.col("copy") > 1) | (F.col("first") < F.col("when")), DUPLICATE)
             .when(~last.isin(*STOPS), TRUNCATED).otherwise(SOUND))
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest("copies", F.lit(1))))
    return (runs.select("*", each.alias("copy"))
            .select("conv_id", "turn", "role", "text", "copy", fault.cast("int").alias("fault")))


# --- the lattice --------------------------------------------------------------------------------------------

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: the role other than system that may come after each role
NEXT = (USER, USER, ASSISTANT, USER)
FINAL = (START, ASSISTANT)
DELETE, INSERT, KEEP, REROLE, LEFT_OPEN = 2, 5, 0, 1, 5


def arcs(initial: str, fault: int) -> list[list[tuple[str, int, bool, int]]]:
    """Per last role the edits (initial, cost, whether the row is consumed, role after it) in ASCII order."""
    more = LEFT_OPEN if fault == TRUNCATED else 0
    out = []
    for role in range(4):
        there = [("D", DELETE, True, role), ("I", INSERT, False, NEXT[role])]
        if fault in (SOUND, TRUNCATED):
            kept = INITIALS.get(initial)
            if kept is not None and (kept == NEXT[role] or (kept == SYSTEM and role == START)):
                there.append(("K", KEEP + more, True, kept))
            there.append(("R", REROLE + more, True, NEXT[role]))
        out.append(there)
    return out


END = [[("I", INSERT, False, NEXT[role])] for role in range(4)]


def auction(lattice, prices: list[int], final: set[int], after: tuple[int, ...] | None) -> None:
    """Raise ``prices`` of one layer to the distance to the end.

    ``lattice`` has the arcs of each node, ``after`` the final prices of the
    next layer; ``prices`` must nowhere exceed an arc's cost plus the price
    at its end.  ``final`` are the nodes whose price is known.
    """
    def through(arc):
        return arc[1] + (after[arc[3]] if arc[2] else prices[arc[3]])

    for origin in range(4):
        path = [origin]
        while path[-1] not in final:
            node = path[-1]
            least = min(lattice[node], key=through)
            if prices[node] < through(least):
                prices[node] = through(least)
                path = path[:-1] or path                         # contraction
            elif least[2]:
                break                                            # extension into the next layer, whose prices are final
            else:
                path.append(least[3])                            # extension
        final.update(path)


def tight_moves(lattice, prices, after) -> tuple[tuple[str, int], ...]:
    """Per node the ASCII-least tight edits that consume the row (or end), and the role after them."""
    out = []
    for node in range(4):
        edits, role, done = "", node, after is None and node in FINAL
        while not done:
            edit, _, done, role = next(
                a for a in lattice[role] if prices[role] == a[1] + (after[a[3]] if a[2] else prices[a[3]]))
            edits += edit
            done = done or (after is None and role in FINAL)
        out.append((edits, role))
    return tuple(out)


@lru_cache(maxsize=4096)
def layer(initial: str, fault: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """Final prices before a row and its moves, from the prices after it."""
    lattice = arcs(initial, fault)
    prices = [min(after)] * 4
    auction(lattice, prices, set(), after)
    return tuple(prices), tight_moves(lattice, prices, after)


def _ending() -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    prices = [0] * 4
    auction(END, prices, set(FINAL), None)
    return tuple(prices), tight_moves(END, prices, None)


END_PRICES, END_MOVES = _ending()


# --- the two walks ------------------------------------------------------------------------------------------

_WALKED = "conv_id bigint, turn bigint, role string, text string, copy bigint, fault int, moves string, price bigint"


def price_rows(faults: DataFrame) -> DataFrame:
    """Beside every row its moves, ``edits:role`` for each last role, and the price of the start there.

    Rows must be whole conversations within a partition, in descending order.
    """
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, fresh, base, ahead = None, True, 0, END_PRICES
        for b in batches:
            moves, costs = [], []
            for c, role, fault in zip(*(b.column(i).to_pylist() for i in (0, 2, 5)), strict=True):
                if fresh or c != conv:
                    conv, fresh, base, ahead = c, False, 0, END_PRICES
                if fault == GONE:
                    moves.append(None)
                else:
                    prices, chosen = layer(role[:1] if role[:1] in INITIALS else "", fault, ahead)
                    # prices go on from the least, so that a layer's steps repeat
                    low = min(prices)
                    base, ahead = base + low, tuple(p - low for p in prices)
                    moves.append(" ".join(f"{edits}:{to}" for edits, to in chosen))
                costs.append(base + ahead[START])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(moves, pa.string()), pa.array(costs, pa.int64())],
                                             [*b.schema.names, "moves", "price"])
    return faults.mapInArrow(walk, _WALKED)


class Walker:
    """Follows one conversation's moves, a row at a time."""

    def __init__(self):
        self.role, self.cost, self.audit, self.sha, self.lines = START, 0, [], hashlib.sha256(), 0
        self.counts = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0}
        self.illegal, self.initial = 0, None
        self.turns, self.first, self.turn = 0, None, None

    def say(self, role: int | str, text: str) -> None:
        name = NAMES[role] if isinstance(role, int) else role
        self.sha.update(f"{chr(10) if self.lines else ''}{name}:{text}".encode())
        self.lines += 1

    def edit(self, edits: str, role: str = "", text: str = "") -> None:
        self.audit.append(edits)
        for e in edits:
            if e == "D":
                continue
            if e == "K":
                self.role = INITIALS[role[:1]]
                self.say(role, text)
            else:
                self.role = NEXT[self.role]
                self.say(self.role, text if e == "R" else "")

    def feed(self, turn, role: str, text: str, fault: int, moves: str | None, price: int) -> None:
        if fault == GONE:
            return
        if self.initial is None:
            self.cost = price
        elif self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        if fault in self.counts:
            self.counts[fault] += 1
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.turn
            self.turn = turn
        self.edit(moves.split(" ")[self.role].split(":")[0], role, text)

    def row(self, conv) -> tuple:
        self.edit(END_MOVES[self.role][0])
        gaps = self.turn - self.first + 1 - self.turns if self.first is not None else 0
        return (conv, gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED], self.illegal,
                self.cost, "".join(self.audit), self.sha.hexdigest())


def follow_moves(priced: DataFrame) -> DataFrame:
    """One row per conversation: faults, cost, audit and the digest of its repaired rows.

    Rows must be whole conversations within a partition, in ascending order.
    """
    kinds = (pa.int64(),) * 7 + (pa.string(),) * 2
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                          names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, walker = None, None
        for b in batches:
            done = []
            for c, *row in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 6, 7)), strict=True):
                if walker is None or c != conv:
                    if walker is not None:
                        done.append(walker.row(conv))
                    conv, walker = c, Walker()
                walker.feed(*row)
            if done:
                yield batch(done)
        if walker is not None:
            yield batch([walker.row(conv)])
    return priced.mapInArrow(walk, ", ".join(f"{n} {'string' if k == pa.string() else 'bigint'}"
                                             for n, k in zip(names, kinds, strict=True)))


def repair_audits(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and repaired digest of each conversation of :func:`clean_rows` (or :func:`damage`)."""
    return follow_moves(_walked(rows))


def _walked(rows: DataFrame) -> DataFrame:
    order = [F.col(c) for c in ("conv_id", "turn", "role", "text", "copy")]
    down = find_faults(rows).repartition("conv_id").sortWithinPartitions(*[c.desc_nulls_last() for c in order])
    return price_rows(down).sortWithinPartitions(*[c.asc_nulls_first() for c in order])


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, line, role, text, edit``, lines from 1, deleted rows left out."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        state = {"conv": None, "line": 0, "role": START, "open": False}

        def edits(todo, role="", text=""):
            for e in todo:
                if e == "D":
                    continue
                state["role"] = INITIALS[role[:1]] if e == "K" else NEXT[state["role"]]
                state["line"] += 1
                held.append((state["conv"], state["line"], role if e == "K" else NAMES[state["role"]],
                             "" if e == "I" else text, e))

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array([h[i] for h in held], k) for i, k in
                 enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))],
                ["conv_id", "line", "role", "text", "edit"])
            held.clear()
            return out

        for b in batches:
            for c, role, text, fault, moves in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 5, 6)), strict=True):
                if not state["open"] or c != state["conv"]:
                    edits(END_MOVES[state["role"]][0])
                    state.update(conv=c, line=0, role=START, open=True)
                if fault != GONE:
                    edits(moves.split(" ")[state["role"]].split(":")[0], role, text)
            yield flush()
        edits(END_MOVES[state["role"]][0])
        yield flush()
    return _walked(rows).mapInArrow(walk, "conv_id bigint, line bigint, role string, text string, edit string")
