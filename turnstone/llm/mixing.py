"""Mixing sources to target weights, by budgets handed down a tree.

The tree's levels are columns, say domain, language and source. The root's
budget of tokens goes down: each node splits its budget among its children in
proportion to their weights, but none gets more than its leaves can supply, that
is MAX_EPOCHS times their tokens. What a child can't take goes to its siblings
first, by their weights; only what a whole subtree can't take was never handed
to it and so is shared by the siblings of its ancestor. Each split is found in
closed form: children sorted by supply over weight fill up one after another, so a window
over the children of a node decides it, and no loop is needed.

A leaf with budget q and t tokens gets its documents in q // t whole epochs, and
of the next epoch those that come first in the order of the md5 of seed, epoch and id
until q is reached: a document is taken if the tokens before it are fewer than what is left. The
prefix is found in two steps, so that no leaf meets in one task: tokens are
summed by leaf and the first hex digits of the hash, and only the one bucket in
which the prefix ends is ordered row by row.

Defined cases: a null level is a value of its own; a null or empty text has no
tokens and is taken with the prefix that it stands in; rows of equal id and text are
each counted and ordered by id, text hash; nodes that weights don't name have weight DEFAULT;
weights of 0 or less get nothing; an empty table gives an empty table; other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

DEFAULT = 1.0
MAX_EPOCHS = 3
#: Hex digits of the hash that make a bucket: 4096 buckets a leaf.
DIGITS = 3
#: Leaves up to which their plan is broadcast (some 200 bytes each); beyond, it is joined by shuffle and Spark splits hot leaves.
MOST_LEAVES = 50_000


def words(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(bare, r"[\x20\x09-\x0D]+", "")).cast("long")


def _weight(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    named = {k: max(float(v), 0.0) for k, v in weights.get(level, {}).items()}
    if not named:
        return F.lit(DEFAULT)
    table = F.create_map(*[F.lit(x) for k, v in sorted(named.items()) for x in (k, v)])
    return F.coalesce(F.element_at(table, F.coalesce(F.col(level).cast("string"), F.lit(""))), F.lit(DEFAULT))


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, float]], share: float, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """leaves: levels and tokens of each leaf. Adds budget (whole tokens).

    share: the root's budget as a share of all tokens.
    """
    levels = list(levels)
    nodes = leaves.groupBy(*levels).agg(F.sum("tokens").alias("tokens"))
    supplies = [nodes.withColumn("supply", F.col("tokens") * max_epochs)]
    for k in range(len(levels) - 1, 0, -1):
        supplies.append(supplies[-1].groupBy(*levels[:k]).agg(F.sum("supply").alias("supply"), F.sum("tokens").alias("tokens")))
    supplies = supplies[::-1]
    top = supplies[0].withColumn("parent_budget", F.sum("tokens").over(Window.partitionBy(F.lit(0))) * F.lit(float(share)))
    out = None
    for k, level in enumerate(levels):
        if out is None:
            own = top
        else:
            above = out.select(*[F.col(c).alias(f"_{c}") for c in levels[:k]], F.col("budget").alias("parent_budget"))
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in levels[:k]]
            own = supplies[k].join(above, same).drop(*[f"_{c}" for c in levels[:k]])
        out = _split(own, levels[:k] or [F.lit(0)], level, weights)
    return out.select(*levels, "tokens", F.floor(F.least("budget", F.col("supply")) + 1e-6).cast("long").alias("budget"))


def _split(nodes: DataFrame, parent: list, level: str, weights: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """budget of each node: min(supply, weight * x) with x such that the parent's budget is used up, if supplies allow."""
    rows = nodes.withColumn("w", _weight(level, weights))
    order = Window.partitionBy(*parent).orderBy(F.when(F.col("w") > 0, F.col("supply") / F.col("w")).asc_nulls_last(), F.col(level).asc_nulls_first())
    before, since = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    open_w = F.when(F.col("w") > 0, F.col("w")).otherwise(0.0)
    filled = F.coalesce(F.sum(F.when(F.col("w") > 0, F.col("supply")).otherwise(0)).over(before), F.lit(0))
    # the share of this node if all before it are full and it and the rest are not
    rows = rows.withColumn("x", F.greatest(F.lit(0.0), (F.col("parent_budget") - filled)) / F.nullif(F.sum(open_w).over(since), F.lit(0.0)))
    rows = rows.withColumn("open", F.coalesce(F.col("x") * F.col("w") < F.col("supply"), F.lit(False)))
    level_x = F.min(F.when(F.col("open"), F.struct(F.col("supply") / F.col("w"), F.col(level), F.col("x")))).over(Window.partitionBy(*parent))
    x = level_x["x"]
    budget = F.when(F.col("w") <= 0, F.lit(0.0)).when(x.isNull(), F.col("supply").cast("double")).otherwise(F.least(F.col("supply").cast("double"), x * F.col("w")))
    return rows.withColumn("budget", budget).drop("w", "x", "open", "parent_budget")


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, float]], share: float, seed: int = 0, max_epochs: int = MAX_EPOCHS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a struct of all columns of docs), levels, epoch, n_tokens of each document taken, once for each epoch.

    levels: name and expression of each level of the tree, from the top.
    """
    names = list(levels)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[e.alias(n) for n, e in levels.items()], F.col(id_col).cast("long").alias("id"), words(F.col(text_col)).alias("n_tokens"), F.xxhash64(text_col).alias("text_hash"))
    slim = stored(rows.select(*names, "id", "n_tokens", "text_hash"))  # texts are counted once

    leaves = slim.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    plan = stored(budgets(leaves, names, weights, share, max_epochs))
    small = plan.count() <= MOST_LEAVES
    hint = F.broadcast if small else (lambda df: df)
    plan = plan.withColumn("whole", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("long")).withColumn("left", F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(F.lit(0)))

    def place(whole: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), whole.cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("null"))).cast("binary"))

    with_plan = _joined(slim, hint(plan.select(*names, "whole", "left")), names).withColumn("place", place(F.col("whole"))).withColumn("bucket", F.substring("place", 1, DIGITS))
    sums = with_plan.filter("left > 0").groupBy(*names, "left", "whole", "bucket").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*names).orderBy("bucket"))
    last = sums.withColumn("upto", upto).filter(F.col("upto") >= F.col("left")).groupBy(*names).agg(F.min(F.struct("bucket", (F.col("left") - F.col("upto") + F.col("n")).alias("room"))).alias("end"))
    plan = stored(_joined(plan, last, names, "left").select(*names, "whole", "left", F.col("end.bucket").alias("end_bucket"), F.col("end.room").alias("room")))

    # where the prefix ends: the rows of one bucket of each leaf, in order
    in_end = _joined(slim, hint(plan), names).withColumn("place", place(F.col("whole"))).filter((F.col("left") > 0) & (F.substring("place", 1, DIGITS) == F.col("end_bucket")))
    order = Window.partitionBy(*names).orderBy("place", "id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    end = in_end.withColumn("before", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).filter(F.col("before") < F.col("room"))
    end = end.groupBy(*names).agg(F.max(F.struct("place", "id", "text_hash")).alias("end_at"))
    plan = stored(_joined(plan, end, names, "left"))

    taken = _joined(rows, hint(plan), names).withColumn("place", place(F.col("whole")))
    prefix = (F.col("left") > 0) & (F.struct("place", "id", "text_hash") <= F.col("end_at"))
    epochs = F.sequence(F.lit(0).cast("long"), F.col("whole") - F.when(F.coalesce(prefix, F.lit(False)), F.lit(0)).otherwise(F.lit(1)))
    out = taken.filter((F.col("whole") > 0) | F.coalesce(prefix, F.lit(False)))
    return out.select("row", *names, "n_tokens", F.explode(epochs).alias("epoch"))


def _joined(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe join on names; right has one row for each leaf."""
    own = right.select(*[F.col(n).alias(f"_{n}") for n in names], *[c for c in right.columns if c not in names])
    return left.join(own, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names], how).drop(*[f"_{n}" for n in names])
