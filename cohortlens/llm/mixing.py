"""Mixing sources to target weights in a domain-language-source tree. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import stage

LEAF = ["__domain", "__lang", "__source"]


def token_count(text: Column) -> Column:
    """Words between ASCII white space; the unit of all budgets."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_domain(source: Column) -> Column:
    """The domain of a source: the last digits of its name modulo 4, ``other`` without digits."""
    digits = F.regexp_extract(source, r"([0-9]{1,9})$", 1)
    return F.when(F.coalesce(digits, F.lit("")) == "", F.lit("other")).otherwise(F.concat(F.lit("d"), digits.cast("int") % 4))


def _weight(name: Column, weights: dict[str, float], default: float) -> Column:
    out = F.lit(float(default))
    for k, w in sorted(weights.items()):
        out = F.when(name == k, F.lit(float(w))).otherwise(out)
    return out


def _fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Share each parent's ``__budget`` among its children by ``__w``, never above ``__cap``.

    What a full child can't take goes to its siblings: the water level is the largest of the levels that
    assume the children with the least room for their weight to be full.
    """
    order = Window.partitionBy(*parent).orderBy("__room", name)
    whole = Window.partitionBy(*parent)
    nodes = nodes.withColumn("__room", F.when(F.col("__w") > 0, F.col("__cap") / F.col("__w")).otherwise(F.lit(float("inf"))))
    before = F.coalesce(F.sum("__cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("__w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = nodes.withColumn("__level", F.when(rest > 0, (F.col("__budget") - before) / rest))
    level = level.withColumn("__level", F.max("__level").over(whole)).withColumn("__all", F.sum(F.when(F.col("__w") > 0, F.col("__cap")).otherwise(0.0)).over(whole))
    share = F.when(F.col("__w") <= 0, F.lit(0.0)).when(F.col("__all") <= F.col("__budget"), F.col("__cap")).otherwise(F.least("__cap", F.greatest(F.lit(0.0), F.col("__w") * F.col("__level"))))
    return level.withColumn("__budget", share).drop("__room", "__level", "__all", "__w", "__cap")


def leaf_budgets(leaves: DataFrame, weights: dict, budget_share: float, max_epochs: float) -> DataFrame:
    """``leaves`` (LEAF columns and __tokens) with ``__budget``, whole tokens for each leaf.

    Weights go down the tree: domains share the total, languages a domain's part, sources a language's
    part. A node's room is the tokens under it times ``max_epochs``, so a shortage is made up among its
    siblings first and reaches its parent's siblings only when all of them are full.
    """
    caps = leaves.withColumn("__cap", F.col("__tokens") * F.lit(float(max_epochs)))
    total = caps.agg((F.coalesce(F.sum("__tokens"), F.lit(0)) * F.lit(float(budget_share))).alias("__budget"))
    level = total.withColumn("__root", F.lit(0))
    keys: list[str] = []
    for name, kind in zip(LEAF, ("domain", "lang", "source"), strict=True):
        parent = keys or ["__root"]
        keys = [*keys, name]
        w, default = weights.get(kind, {}), weights.get("default", 1.0)
        below = caps.withColumn("__root", F.lit(0)).groupBy(*dict.fromkeys([*parent, *keys])).agg(F.sum("__cap").alias("__cap"))
        level = _fill(below.withColumn("__w", _weight(F.col(name), w, default)).join(level, parent), parent, name)
    return level.select(*LEAF, F.floor(F.col("__budget") + F.lit(1e-6)).alias("__budget"))


def _order_key(seed: int, epoch: Column, doc: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit("null"))))


def mix_sources(
    docs: DataFrame, weights: dict, budget_share: float = 0.6, max_epochs: float = 2.0, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain=source_domain,
) -> DataFrame:
    """``docs`` with ``domain``, ``n_tokens`` and ``copies``: how often the mix takes each document.

    A leaf (domain, language, source) with budget B and T tokens takes floor(B / T) whole epochs and the
    longest prefix of the next epoch that fits; epoch e is the order of md5(seed:e:id), then id. Rows of one id stand or
    fall together. Null languages are ``und``, null sources ``none``; a null text has no tokens; nodes of
    weight 0 take nothing; leaves without tokens are not taken; empty input gives empty output. Columns
    named as the three outputs are replaced.

    No leaf is ever sorted whole: token sums of 256 ranges of the order key, pre-aggregated, find the range
    where the budget ends, then 256 ranges within it, and only that 1/65536 of a leaf is ordered row by row.
    """
    leaf = [
        F.coalesce(domain(F.col(source_col)), F.lit("other")).alias("__domain"),
        F.coalesce(F.col(lang_col), F.lit("und")).alias("__lang"),
        F.coalesce(F.col(source_col), F.lit("none")).alias("__source"),
    ]
    narrow = stage(docs.select(*leaf, F.col(id_col).alias("__id"), token_count(F.col(text_col)).alias("__t")), "mix_rows")
    leaves = stage(narrow.groupBy(*LEAF).agg(F.sum("__t").alias("__tokens")), "mix_leaves")
    plan = leaf_budgets(leaves, weights, budget_share, max_epochs).join(leaves, LEAF)
    full = F.when(F.col("__tokens") > 0, F.floor(F.col("__budget") / F.col("__tokens"))).otherwise(F.lit(0)).cast("long")
    plan = stage(plan.withColumn("__full", full).withColumn("__rest", F.col("__budget") - F.col("__full") * F.col("__tokens")), "mix_plan")

    rows = narrow.join(plan.where(F.col("__rest") > 0).select(*LEAF, "__full", "__rest"), LEAF)
    rows = rows.withColumn("__key", _order_key(seed, F.col("__full"), F.col("__id")))
    for step in range(2):
        part = F.substring("__key", 1 + 2 * step, 2)
        sums = rows.groupBy(*LEAF, "__rest", part.alias("__part")).agg(F.sum("__t").alias("__sum"))
        run = F.sum("__sum").over(Window.partitionBy(*LEAF).orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        cut = sums.withColumn("__run", run).where(F.col("__run") > F.col("__rest")).groupBy(*LEAF).agg(F.min_by(F.struct("__part", (F.col("__run") - F.col("__sum")).alias("__before")), "__part").alias("__cut"))
        cut = stage(cut.select(*LEAF, "__cut.*"), f"mix_cut{step}")
        rows = rows.join(cut, LEAF).where(part == F.col("__part")).withColumn("__rest", F.col("__rest") - F.col("__before")).drop("__part", "__before")
    units = rows.groupBy(*LEAF, "__rest", "__key", "__id").agg(F.sum("__t").alias("__t"))
    run = F.sum("__t").over(Window.partitionBy(*LEAF).orderBy("__key", "__id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # the first unit past the budget: everything before it in the order is the prefix
    stop = units.withColumn("__run", run).where(F.col("__run") > F.col("__rest")).groupBy(*LEAF).agg(F.min(F.struct("__key", "__id")).alias("__stop"))
    plan = stage(plan.join(stop, LEAF, "left").select(*[F.col(x).alias(f"{x}_p") for x in LEAF], "__full", "__rest", "__stop"), "mix_stops")

    base = docs.drop("domain", "n_tokens", "copies")
    keyed = base.select("*", *leaf)
    out = keyed.join(plan, [F.col(x) == F.col(f"{x}_p") for x in LEAF], "left")
    key = _order_key(seed, F.col("__full"), F.col(id_col))
    before_stop = F.col("__stop").isNull() | (key < F.col("__stop.__key")) | ((key == F.col("__stop.__key")) & F.coalesce(F.col(id_col) < F.col("__stop.__id"), F.lit(False)))
    partial = ((F.col("__rest") > 0) & before_stop).cast("long")
    return out.select(
        *[base[c] for c in base.columns],
        F.col("__domain").alias("domain"),
        token_count(F.col(text_col)).alias("n_tokens"),
        (F.coalesce(F.col("__full"), F.lit(0)) + F.coalesce(partial, F.lit(0))).cast("long").alias("copies"),
    )
