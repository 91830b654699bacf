"""Mixing sources to target weights: hierarchical budgets over a tree such as domain, language, source.

A budget of tokens flows down the tree in proportion to the weights of siblings. A branch that cannot use its share,
even when all its text is repeated ``max_epochs`` times, takes what it can, and the shortage goes to its siblings;
only what all of them together cannot use goes to the siblings of their parent. In closed form for one family: sort
by capacity over weight; branches that fill up before the water level of the rest are a prefix of that order, so one
window over the family finds the level. All of it is exact integer arithmetic; a family loses less than a token for
each child to rounding down.

Each leaf then gets whole epochs and, of one more epoch in its own seeded order, the longest prefix that fits. The
prefix is found without sorting a leaf: sums over 4096 ranges of the order, over 4096 ranges of the range that holds
the cut, and a window over the documents of that last range alone. Built-in functions only.

Defined cases: a null level is the branch '' ; branches without a weight in the given mapping weigh 1; weight 0 or
less is never drawn; a weight that isn't whole is refused; null and empty texts have no tokens and come with whole epochs only or where they cost nothing;
an empty table gives no rows; repeated rows of one id are drawn together; ties in the order go by id. Extra columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.spill import small_side, written

_BITS = 12  # of the order's 60, for each of two narrowings


def word_count(text: Column) -> Column:
    """Words between spaces and the controls 9 to 13."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(kept == "", 0).otherwise(F.size(F.split(kept, r"[\x20\x09-\x0D]+"))).cast("bigint")


def seeded_order(seed: int, epoch: Column, doc_id: Column) -> Column:
    """60 bits that order the documents of one epoch."""
    text = F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _weight(column: str, weights: dict[str, int]) -> Column:
    found = F.lit(1)
    for name, weight in weights.items():
        if weight != int(weight):
            raise ValueError(f"weights are whole numbers, not {weight} for {name}")
        found = F.when(F.col(column) == name, F.lit(int(weight))).otherwise(found)
    return found.cast("decimal(12,0)")


def share_out(family: DataFrame, parents: list[str], child: str) -> DataFrame:
    """Adds ``alloc`` to rows (parents..., child, cap, weight, budget): the family's budget shared among its children."""
    siblings = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    ordered = siblings.orderBy(F.col("cap").cast("double") / F.col("weight").cast("double"), child)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("decimal(24,0)")

    def total(value: Column, over) -> Column:
        return F.coalesce(F.sum(value).over(over), none).cast("decimal(24,0)")

    left = (F.col("budget") - total(F.col("cap"), before)).cast("decimal(24,0)")
    rest = (total(F.col("weight"), siblings) - total(F.col("weight"), before)).cast("decimal(12,0)")
    full = family.filter("weight > 0").withColumn("_full", F.col("cap") * rest <= F.col("weight") * left)
    level = (F.col("budget") - total(F.when(F.col("_full"), F.col("cap")), siblings)).cast("decimal(24,0)")
    open_weight = total(F.when(~F.col("_full"), F.col("weight")), siblings).cast("decimal(12,0)")
    shared = full.withColumn("_level", level).withColumn("_open", open_weight)
    alloc = F.when(F.col("_full"), F.col("cap").cast("bigint")).otherwise(F.expr("(weight * _level) div _open"))
    return shared.withColumn("alloc", alloc).drop("_full", "_level", "_open")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: list[dict[str, int]], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """(levels..., leaf_tokens, alloc) from (levels..., leaf_tokens); ``share`` of all tokens is the budget, as a fraction."""
    leaves = leaves.withColumn("cap", (F.col("leaf_tokens") * F.lit(max_epochs)).cast("decimal(24,0)"))
    shared = None
    for depth, level in enumerate(levels):
        keys = levels[: depth + 1]
        family = leaves.groupBy(*keys).agg(F.sum("cap").cast("decimal(24,0)").alias("cap"), F.sum(F.col("leaf_tokens").cast("decimal(24,0)")).alias("_t"))
        family = family.withColumn("weight", _weight(level, weights[depth]))
        if shared is None:
            whole = F.sum("_t").over(Window.partitionBy(F.lit(0))).cast("decimal(24,0)")  # over the branches of the root
            family = family.withColumn("_t", whole).withColumn("budget", F.expr(f"cast(_t * {int(share[0])} div {int(share[1])} as decimal(24,0))"))
        else:
            family = family.join(shared.select(*keys[:-1], F.col("alloc").cast("decimal(24,0)").alias("budget")), keys[:-1])
        shared = share_out(family.drop("_t"), keys[:-1], level)
    return leaves.select(*levels, "leaf_tokens").join(shared.select(*levels, "alloc"), levels)


def _cut(sums: DataFrame, levels: list[str], bucket: str, start: Column) -> DataFrame:
    """The bucket in which a leaf's running sum passes its remainder, and the sum before it."""
    running = Window.partitionBy(*levels).orderBy(bucket)
    upto = sums.withColumn("_sum", start + F.sum("_t").over(running))
    return upto.filter((F.col("_sum") > F.col("rem")) & (F.col("_sum") - F.col("_t") <= F.col("rem"))).select(
        *levels, F.col(bucket).alias(f"cut_{bucket}"), (F.col("_sum") - F.col("_t")).alias(f"sum_{bucket}"))


def mix(docs: DataFrame, levels: list[str], weights: list[dict[str, int]], share: tuple[int, int] = (1, 1), max_epochs: int = 1,
        seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, levels..., tokens, epoch): the documents drawn, once for each epoch in which they are drawn.

    levels: columns of ``docs`` from the root down; weights: one mapping of branch name to whole weight for each level.
    """
    base = written(docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                               *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in levels],
                               word_count(F.col(text_col)).alias("tokens")), "mix-base")
    leaves = written(base.groupBy(*levels).agg(F.sum("tokens").alias("leaf_tokens")), "mix-leaves")
    plan = leaf_budgets(leaves, levels, weights, share, max_epochs).filter("leaf_tokens > 0")
    plan = plan.withColumn("full", F.expr("alloc div leaf_tokens")).withColumn("rem", F.expr("alloc % leaf_tokens")).drop("alloc", "leaf_tokens")
    plan = written(plan, "mix-plan")
    planned = base.join(small_side(plan), levels)
    whole = planned.filter("full > 0").withColumn("epoch", F.explode(F.expr("sequence(0L, full - 1)")))
    order = planned.filter("rem > 0").withColumn("h", seeded_order(seed, F.col("full"), F.col("doc_id")))
    order = order.withColumn("b1", F.shiftright("h", 60 - _BITS)).withColumn("b2", F.shiftright("h", 60 - 2 * _BITS).bitwiseAND((1 << _BITS) - 1))
    order = written(order, "mix-order")
    first = written(_cut(order.groupBy(*levels, "rem", "b1").agg(F.sum("tokens").alias("_t")), levels, "b1", F.lit(0)), "mix-cut")
    near = order.join(small_side(first), levels)
    inside = near.filter("b1 = cut_b1")
    second = _cut(inside.groupBy(*levels, "rem", "sum_b1", "b2").agg(F.sum("tokens").alias("_t")), levels, "b2", F.col("sum_b1"))
    second = small_side(written(second, "mix-cut"))
    exact = inside.join(second, levels).filter("b2 = cut_b2")
    run = Window.partitionBy(*levels).orderBy("h", "doc_id")
    exact = exact.withColumn("_sum", F.col("sum_b2") + F.sum("tokens").over(run)).filter("_sum <= rem")
    below = near.join(second, levels).filter("b1 < cut_b1 OR b1 = cut_b1 AND b2 < cut_b2")
    out = ["doc_id", *levels, "tokens", "epoch"]
    parts = [x.withColumn("epoch", F.col("full")).select(out) for x in (below, exact)]
    return whole.select(out).unionByName(parts[0]).unionByName(parts[1])


def mix_documents(docs: DataFrame, levels: dict[str, Column], weights: list[dict[str, int]], share: tuple[int, int] = (1, 1),
                  max_epochs: int = 1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``mix`` draws, as often as it draws them; columns as they were. levels: name and expression."""
    named = {f"_mix_{name}": expr for name, expr in levels.items()}
    seen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_mix_text"), *[e.alias(n) for n, e in named.items()])
    drawn = mix(seen, list(named), weights, share, max_epochs, seed, "doc_id", "_mix_text")
    drawn = drawn.select(F.col("doc_id").alias("_drawn_id"), "epoch").distinct().withColumnRenamed("epoch", "_drawn_epoch")
    return docs.join(drawn, docs[id_col].eqNullSafe(F.col("_drawn_id"))).select(*[docs[c] for c in docs.columns])
