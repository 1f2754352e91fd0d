"""Merkle manifest of a dataset: digests that prove every row's place in it.

A row is a leaf: SHA-256 over its columns, each ``-`` if null, else UTF-8 byte
count, ``:`` and value.  Leaves of one group (a language) are numbered by id
and form a tree: ``arity`` consecutive nodes, the last run fewer, even one,
become one digest until one node is left, the group's subroot.  The subroots,
ordered by group (null first, then bytewise), form a tree in the same way,
whose last node is the root.

A table ``(tree, idx, digest, width)`` holds the nodes of one level of all
trees.  ``SPAN`` consecutive nodes or fewer, a power of the arity, are a block:
one group of bounded size, whose levels up to its one last node are computed
in place by array functions, together with the siblings of each of its nodes.
Blocks are written once; their last nodes are the next table.  So a tree of a
billion leaves takes three such tables, and the plans stay small.  On the way
back from the root each block takes the path of its last node and its nodes
put their own siblings in front, so a path is built from joins whose one side
shrinks a thousandfold from table to table.  Numbers come from one range
partitioning of the thin leaf table and the row counts of its partitions, so a
language with most rows is spread like any other; keys of all joins are single
nodes.

A path proves a leaf: folding a leaf's digest with the siblings of its path
gives the root, unless the row was altered.

Defined results: a null group is a tree of its own, before the group ''; null
ids come first; rows repeated with one id are ordered by their leaf, equal
rows by chance, which gives the same set of results; very long texts are
hashed whole, one at a time; an empty table gives an empty result; columns
that are not named are left behind, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.llm.frames import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SPAN = 1024                            # nodes of a block at most; a run of more is one all the same


def digest(*parts: Column | str) -> Column:
    """H: lower-case hex SHA-256 of the strings, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def _field(value: Column) -> Column:
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of a row from its columns, in order."""
    return digest(*[_field(c) for c in fields])


def _tree_key(group: Column) -> Column:
    """Never null, and ordered as the groups are: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``idx``, the 0-based place in ``tree`` by ``order``, and ``width``, the tree's size."""
    order = ["tree", *order]
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                     .withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    # ``at`` holds the partition's number above bit 33 and counts rows in order below it
    part = F.shiftright("at", 33)
    sizes = placed.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("tree").orderBy("part")
    sizes = sizes.select("tree", "part", "first", (F.sum("n").over(along) - F.col("n")).alias("before"),
                         F.sum("n").over(Window.partitionBy("tree")).alias("width"))
    return (placed.withColumn("part", part).join(sizes, ["tree", "part"])
            .withColumn("idx", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before"))


def _div(a: Column, b: int, kind: str) -> Column:
    return F.floor(a / F.lit(b)).cast(kind) if b & (b - 1) else F.shiftright(a, b.bit_length() - 1)


def span_levels(arity: int) -> int:
    """Levels of a block: the most whose nodes are ``SPAN`` or fewer, at least one."""
    n = 1
    while arity ** (n + 1) <= SPAN:
        n += 1
    return n


def _parents(level: Column, arity: int) -> Column:
    """The digests of the runs of a block's level."""
    runs = F.ceil(F.size(level) / F.lit(arity)).cast("int")
    return F.transform(F.sequence(F.lit(0), runs - 1),
                       lambda r: digest(*[F.coalesce(F.get(level, r * arity + k), F.lit("")) for k in range(arity)]))


def _step(level: Column, at: Column, arity: int) -> Column:
    """Slot of a block's node number ``at`` of ``level``, and the digests of the run's others by slot."""
    slot = F.pmod(at, F.lit(arity))
    others = [F.when(slot != k, F.get(level, at - slot + k)) for k in range(arity)]
    return F.struct(slot.cast("int").alias("slot"), F.array_compact(F.array(*others)).alias("siblings"))


def with_paths(nodes: DataFrame, arity: int = 2) -> DataFrame:
    """``nodes`` with ``block``, ``path`` (slot and siblings level by level up to the block's last node) and ``top``.

    ``top`` is the digest of the block's last node, null but for the block's
    first node.  A block ends where its tree does.
    """
    depth = span_levels(arity)
    more = [c for c in nodes.columns if c not in ("tree", "width", "idx", "digest")]
    out = (nodes.groupBy("tree", "width", _div(F.col("idx"), arity ** depth, "bigint").alias("block"))
           .agg(F.array_sort(F.collect_list(F.struct("idx", "digest", *more))).alias("nodes")))
    out = out.withColumn("l0", F.transform("nodes", lambda node: node["digest"]))
    for k in range(depth):
        here = F.col(f"l{k}")
        out = out.withColumn(f"l{k + 1}", F.when(F.col("width") > arity ** k, _parents(here, arity)).otherwise(here))

    def walked(node: Column, i: Column) -> Column:
        steps = [F.when(F.col("width") > arity ** k, _step(F.col(f"l{k}"), _div(i, arity ** k, "int"), arity))
                 for k in range(depth)]
        top = F.when(i == 0, F.get(f"l{depth}", F.lit(0)))
        return F.struct(*[node[c].alias(c) for c in ("idx", "digest", *more)],
                        F.array_compact(F.array(*steps)).alias("path"), top.alias("top"))

    return out.select("tree", "width", "block", F.inline(F.transform("nodes", walked)))


def climb(nodes: DataFrame, arity: int = 2) -> tuple[list[DataFrame], DataFrame]:
    """Tables of :func:`with_paths` from ``nodes`` to the last nodes, and ``tree, digest, height`` of every tree.

    ``nodes`` has ``tree, idx, digest, width``; its further columns stay on
    the first table.  ``height`` is the number of the table that a tree ends in.
    """
    size = arity ** span_levels(arity)
    widest = nodes.agg(F.max("width")).first()[0] or 0
    spans, tops = [], None
    while True:
        spans.append(written(with_paths(nodes, arity), "merkle-span"))
        ends = spans[-1].filter("top IS NOT NULL")
        done = ends.filter(F.col("width") <= size).select("tree", F.col("top").alias("digest"),
                                                          F.lit(len(spans) - 1).alias("height"))
        tops = done if tops is None else tops.union(done)
        if widest <= size:
            return spans, tops
        nodes = ends.filter(F.col("width") > size).select(
            "tree", F.col("block").alias("idx"), F.col("top").alias("digest"),
            F.ceil(F.col("width") / F.lit(size)).cast("bigint").alias("width"))
        widest = -(-widest // size)


def descend(spans: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Nodes of the first table with ``path``, now up to the root, and what else ``tops`` tells of their tree.

    ``tops`` has ``tree, height, path``, the path of each subroot, and further columns.
    """
    told = [c for c in tops.columns if c not in ("tree", "height", "path")]
    above = None
    for k in range(len(spans) - 1, -1, -1):
        reached = tops.filter(F.col("height") == k).select(
            "tree", F.lit(0).cast("bigint").alias("block"), F.col("path").alias("up"), *told)
        above = reached if above is None else reached.union(above)
        here = spans[k].join(above, ["tree", "block"]).withColumn("path", F.concat("path", "up"))
        above = here.select("tree", F.col("idx").alias("block"), F.col("path").alias("up"), *told)
    return here.drop("block", "up", "top")


def _no_path() -> Column:
    return F.array().cast("array<struct<slot:int,siblings:array<string>>>").alias("path")


def fold(leaf: Column, path: Column) -> Column:
    """The digest that ``leaf`` and the siblings of its path lead to."""
    def step(acc, at):
        before = F.slice(at["siblings"], F.lit(1), at["slot"])
        after = F.slice(at["siblings"], at["slot"] + 1, F.size(at["siblings"]))
        return digest(F.array_join(before, ""), acc, F.array_join(after, ""))
    return F.aggregate(path, leaf, step)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang",
             arity: int = 2, now: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: ``id, leaf, subroot, root, path, proof_sha256, folded_root, verified``.

    ``now`` gives columns another value than the one the manifest was made
    of; ``folded_root`` is recomputed from those, and ``verified`` says
    whether it still is the root.  ``proof_sha256`` is the digest of the
    siblings on the path, from the leaf to the root.
    """
    if arity < 2:
        raise ValueError("arity must be at least 2")
    changed = [(now or {}).get(c, F.col(c)) for c in fields]
    leaves = docs.select(_tree_key(F.col(group_col)).alias("tree"), F.col(id_col).cast("bigint").alias("id"),
                         leaf_digest([F.col(c) for c in fields]).alias("digest"),
                         leaf_digest(changed).alias("today"))
    leaves = written(_numbered(written(leaves, "merkle-leaves"), ["id", "digest"]), "merkle-nodes")
    spans, tops = climb(leaves, arity)

    tops = written(tops, "merkle-tops")
    groups = tops.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest", "height")
    groups = written(_numbered(groups, ["group"]), "merkle-groups")
    upper, top = climb(groups, arity)
    found = top.select("digest").first()
    root = F.lit(found[0] if found else None).cast("string")
    groups = descend(upper, top.select("tree", "height", _no_path()))
    tops = written(groups.select(F.col("group").alias("tree"), F.col("digest").alias("subroot"), "height", "path"),
                   "merkle-subroots")
    out = descend(spans, tops).withColumn("root", root)
    siblings = F.flatten(F.transform("path", lambda s: s["siblings"]))
    out = out.withColumn("folded_root", fold(F.col("today"), F.col("path")))
    return out.select("id", F.col("digest").alias("leaf"), "subroot", "root", "path",
                      F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))
