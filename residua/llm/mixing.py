"""Mixing sources to target weights by hierarchical budgets.

The tree is domain > language > source.  A token budget goes from the root
down: a node gives its children shares in proportion to their weights.  A
child that holds less than its share (its tokens times ``max_epochs``) gives
the rest back to its siblings first; only what no sibling can take was
never handed down, because a node's own budget is bounded by its subtree's
supply when its ancestors share out theirs.  Within a node this is
water-filling, solved in closed form by a sort and running sums.

A leaf with T tokens and budget A passes A div T whole epochs and from the
next epoch the shortest prefix, in seeded order, that reaches the A mod T
tokens left.  The prefix is described by one cut key per leaf.  To find it,
a leaf's documents are summed by the first hex digits of their order keys;
only the one bucket that holds the cut is sorted, so a source with a third
of all rows is never sorted as a whole.

DataFrame functions only.  Defined results: a null domain, language or
source is a node of its own with name ''; null text has no tokens; a
very long text counts whole and is taken whole; children equally near to
their share go by name; a null id orders as ''; rows repeated with the same id are chosen together; an
empty table gives an empty result; columns of the input that are not named
stay untouched in :func:`mix` and are left behind in :func:`plan_copies`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.llm.frames import fresh, written

LEVELS = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixPlan:
    """Whole-number weights by level and name (others: ``default``), budget and seed."""
    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    default: int = 1
    budget_percent: int = 75               # of all tokens
    max_epochs: int = 2
    seed: str = "mix-1"
    bucket_digits: int = 3                 # 16 ** digits buckets a leaf

    def weight(self, level: str) -> Column:
        out = F.lit(self.default).cast("bigint")
        for name, w in self.weights.get(level, {}).items():
            out = F.when(F.col(level) == name, F.lit(w).cast("bigint")).otherwise(out)
        return out

    def order_key(self, epoch: Column, doc_id: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(self.seed), epoch.cast("string"),
                                 F.coalesce(doc_id.cast("string"), F.lit(""))))


def source_domain(source: Column) -> Column:
    """The domain of a source in these tables, by the last digit of its name."""
    last = F.right(source, F.lit(1))
    return F.when(last.isin("0", "1", "2"), "web").when(last.isin("3", "4", "5", "6"), "books").otherwise("forum")


def _share_out(nodes: DataFrame, parents: list[str], level: str, plan: MixPlan) -> DataFrame:
    """Give each node of ``level`` its budget from its parent's ``budget``; ``supply`` bounds it."""
    n = nodes.withColumn("w", plan.weight(level))
    ready = (F.col("w") > 0) & (F.col("supply") > 0)
    # poorest first: a child is sated if the equal share of what is left exceeds its supply
    turn = Window.partitionBy(*parents, "ready").orderBy(F.col("supply") / F.greatest("w", F.lit(1)), level)
    before = turn.rowsBetween(Window.unboundedPreceding, -1)
    onward = turn.rowsBetween(0, Window.unboundedFollowing)
    mates = Window.partitionBy(*parents, "ready")
    n = n.withColumn("ready", ready)
    n = n.withColumns({"taken": F.coalesce(F.sum("supply").over(before), F.lit(0)), "open_w": F.sum("w").over(onward)})
    n = n.withColumn("sated", F.col("supply") * F.col("open_w") <= (F.col("budget") - F.col("taken")) * F.col("w"))
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("sated"), F.col("supply"))).over(mates), F.lit(0))
    thirsty = F.sum(F.when(~F.col("sated"), F.col("w"))).over(mates)
    n = n.withColumns({"left": left, "thirsty": thirsty})
    given = (F.when(~F.col("ready"), F.lit(0)).when(F.col("sated"), F.col("supply"))
             .otherwise(F.expr("(left * w) div thirsty")))
    return n.withColumn("budget", given.cast("bigint")).drop("w", "ready", "taken", "open_w", "sated", "left", "thirsty")


def leaf_budgets(tokens: DataFrame, plan: MixPlan) -> DataFrame:
    """Per leaf: its tokens, its budget, whole epochs and the tokens left for the next one.

    ``tokens`` has the three levels and ``n_tokens``.
    """
    leaves = (tokens.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("leaf_tokens"))
              .withColumn("supply", F.col("leaf_tokens") * plan.max_epochs))
    budget = tokens.agg(F.expr(f"coalesce(sum(n_tokens), 0) * {int(plan.budget_percent)} div 100"))
    above = None
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[:depth])
        nodes = leaves.groupBy(*path, level).agg(F.sum("supply").alias("supply"))
        nodes = (nodes.withColumn("budget", budget.scalar()) if above is None
                 else nodes.join(above.drop("supply"), path))
        above = _share_out(nodes, path, level, plan)
    out = leaves.drop("supply").join(above.drop("supply"), list(LEVELS))
    some = F.col("leaf_tokens") > 0
    return out.withColumns({
        "epochs": F.when(some, F.expr("budget div greatest(leaf_tokens, 1)")).otherwise(F.lit(0)),
        "rest": F.when(some, F.expr("budget % greatest(leaf_tokens, 1)")).otherwise(F.lit(0))})


def leaf_cuts(tokens: DataFrame, plan: MixPlan) -> DataFrame:
    """:func:`leaf_budgets` with ``cut``: order keys up to it are taken once more (null: none)."""
    leaves = written(leaf_budgets(tokens, plan), "mix-leaves")
    keyed = (tokens.join(leaves.filter("rest > 0").select(*LEVELS, "epochs", "rest"), list(LEVELS))
             .withColumn("key", plan.order_key(F.col("epochs"), F.col("id")))
             .withColumn("bucket", F.substring("key", 1, plan.bucket_digits)))
    sums = keyed.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("n_tokens").alias("n"))
    along = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # the last bucket that begins before the rest is reached holds the cut
    begun = sums.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0))).filter("before < rest")
    last = begun.groupBy(*LEVELS).agg(F.max(F.struct("bucket", "before")).alias("b")) \
        .select(*LEVELS, F.col("b.bucket").alias("bucket"), F.col("b.before").alias("before"))
    inside = Window.partitionBy(*LEVELS).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (keyed.join(last, [*LEVELS, "bucket"])
            .withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
            .filter("start < rest").groupBy(*LEVELS).agg(F.max("key").alias("cut")))
    return leaves.join(cuts, list(LEVELS), "left")


def _levels(docs: DataFrame, domain: Column, lang_col: str, source_col: str) -> dict[str, Column]:
    named = {"domain": domain, "lang": F.col(lang_col), "source": F.col(source_col)}
    return {k: F.coalesce(c.cast("string"), F.lit("")) for k, c in named.items()}


def count_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def _tokens(docs, plan, id_col, text_col, lang_col, source_col, domain):
    at = _levels(docs, source_domain(F.col(source_col)) if domain is None else domain, lang_col, source_col)
    return written(docs.select(F.col(id_col).cast("bigint").alias("id"), *[c.alias(k) for k, c in at.items()],
                               count_tokens(F.col(text_col)).alias("n_tokens")), "mix-tokens")


def plan_copies(docs: DataFrame, plan: MixPlan, id_col: str = "doc_id", text_col: str = "text",
                lang_col: str = "lang", source_col: str = "source", domain: Column | None = None) -> DataFrame:
    """One row per document: ``id``, its leaf, ``n_tokens``, the leaf's tokens and budget, and ``copies`` to emit."""
    tokens = _tokens(docs, plan, id_col, text_col, lang_col, source_col, domain)
    return (tokens.join(leaf_cuts(tokens, plan), list(LEVELS))
            .withColumn("copies", _copies(plan, F.col("id")))
            .select("id", *LEVELS, "n_tokens", "leaf_tokens", F.col("budget").alias("leaf_budget"), "copies"))


def _copies(plan: MixPlan, doc_id: Column) -> Column:
    once_more = F.coalesce(plan.order_key(F.col("epochs"), doc_id) <= F.col("cut"), F.lit(False))
    return F.col("epochs") + F.when(once_more, 1).otherwise(0)


def mix(docs: DataFrame, plan: MixPlan, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        source_col: str = "source", domain: Column | None = None) -> DataFrame:
    """``docs`` with each row as often as the budgets ask for, all columns kept.

    Texts meet only the table of leaves, so they are not shuffled where that
    is small enough for Spark to broadcast it.
    """
    tokens = _tokens(docs, plan, id_col, text_col, lang_col, source_col, domain)
    leaves = written(leaf_cuts(tokens, plan), "mix-cuts")
    at = _levels(docs, source_domain(F.col(source_col)) if domain is None else domain, lang_col, source_col)
    leaf, take, n = fresh(docs, "leaf", "take", "n")
    marked = docs.withColumn(leaf, F.struct(*[c.alias(k) for k, c in at.items()]))
    out = marked.join(leaves.select(F.struct(*LEVELS).alias(leaf), F.struct("epochs", "cut").alias(take)), leaf)
    more = F.coalesce(plan.order_key(F.col(take)["epochs"], F.col(id_col)) <= F.col(take)["cut"], F.lit(False))
    out = out.withColumn(n, (F.col(take)["epochs"] + F.when(more, 1).otherwise(0)).cast("int")).filter(F.col(n) > 0)
    if plan.max_epochs > 1:
        out = out.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n))))
    return out.select(*docs.columns)
