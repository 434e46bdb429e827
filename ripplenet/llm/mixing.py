"""Mixing sources to target weights by hierarchical budgeting.

A token budget runs down the tree domain, language, source. Among siblings it is shared by weight, and what one of them
cannot supply goes to the others by weight, as far as they can; only what the whole family cannot supply reaches the
parent's siblings. That is one water level for each family, found in closed form with a window over its members. A
leaf's supply is its tokens times ``epochs``.

A leaf takes whole epochs while its budget lasts and then a prefix of one more, in that epoch's own seeded order of
documents. The end of the prefix is found from sums over hash ranges of the order, followed by a running sum inside the
one range that the end falls into. A leaf of n rows has sqrt(n) ranges of some sqrt(n) rows, so a leaf with a third of
all rows is never one group. Documents then compare their place with the leaf's end: texts are neither sorted nor
shuffled.

Nulls and edge cases: null domain, language and source are each one value of their own, with weight 1 unless given. A
text without words has no tokens and goes along with every epoch. Rows that repeat an id share one place, so they are taken
together or not at all. A document with a null ``doc_id`` is placed by its text, so equal ones go together and others do not.
An empty table gives an empty result, as does a budget of 0. ``n_tokens`` and ``n_epochs`` replace columns of these names; all
other columns pass through, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplenet.llm.common import WORD, named, whole_text
from ripplenet.storage import materialize

SEED = "mix-1"
EPOCHS = 3
_PLACES = 16**8
_LEAF = ["_domain", "_lang", "_source"]


def _name(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("(none)"))


def source_domain(source: Column) -> Column:
    """The domain of a source by the last figure of its name; other names are the domain ``other``."""
    figure = F.try_to_number(F.regexp_extract(source, "[0-9]$", 0), F.lit("9"))
    return F.coalesce(
        F.when(figure < 3, F.lit("web")).when(figure < 6, F.lit("books")).when(figure < 8, F.lit("code")).when(figure < 10, F.lit("talk")),
        F.lit("other"),
    )


def _weight(name: Column, weights: Mapping[str, float]) -> Column:
    chosen = F.lit(1.0)
    for value, weight in sorted(weights.items()):
        chosen = F.when(name == value, float(weight)).otherwise(chosen)
    return chosen


def share_out(nodes: DataFrame, family: list[str]) -> DataFrame:
    """Adds ``given`` to ``nodes`` with ``weight``, ``supply`` and the family's ``budget``.

    Members are ordered by supply for each unit of weight. Those before the water level give all they have; the level is
    what remains for each unit of weight of the others.
    """
    order = Window.partitionBy(family).orderBy((F.col("supply") / F.col("weight")).asc(), *[F.col(c) for c in _LEAF if c in nodes.columns])
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(family)
    drained = F.coalesce(F.sum("supply").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = nodes.withColumn("_level", (F.col("budget") - drained) / weight_left)
    # The first member that can fill its share sets the level (later ones show lower values); if none can, all is given.
    able = F.when(F.col("supply") >= F.col("weight") * F.col("_level"), F.col("_level"))
    level = level.withColumn("_level", F.max(able).over(whole))
    given = F.when(F.col("_level").isNull(), F.col("supply")).otherwise(F.least("supply", F.col("weight") * F.col("_level")))
    return level.withColumn("given", F.greatest(given, F.lit(0.0))).drop("_level")


def leaf_budgets(
    leaves: DataFrame, budget: Column, epochs: int, weights: Mapping[str, Mapping[str, float]]
) -> DataFrame:
    """``(_domain, _lang, _source, tokens, budget)`` from ``(_domain, _lang, _source, tokens)``, tokens above 0."""
    each = leaves.where("tokens > 0").withColumn("supply", F.col("tokens").cast("double") * epochs)
    each = each.withColumn("_all", F.lit(1))
    upper = each.groupBy("_all", "_domain").agg(F.sum("supply").alias("supply"))
    total = each.groupBy("_all").agg(F.sum("tokens").alias("tokens")).select("_all", budget.cast("double").alias("budget"))
    upper = upper.join(total, "_all").withColumn("weight", _weight(F.col("_domain"), weights.get("domain", {})))
    upper = share_out(upper, ["_all"]).select("_domain", F.col("given").alias("budget"))
    middle = each.groupBy("_domain", "_lang").agg(F.sum("supply").alias("supply")).join(upper, "_domain")
    middle = middle.withColumn("weight", _weight(F.col("_lang"), weights.get("lang", {})))
    middle = share_out(middle, ["_domain"]).select("_domain", "_lang", F.col("given").alias("budget"))
    lower = each.select(*_LEAF, "tokens", "supply").join(middle, ["_domain", "_lang"])
    lower = lower.withColumn("weight", _weight(F.col("_source"), weights.get("source", {})))
    return share_out(lower, ["_domain", "_lang"]).select(*_LEAF, "tokens", F.col("given").alias("budget"))


def _who() -> Column:
    """What a document is placed by: its id, or a hash of the text where there is none."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(whole_text())))


def _place(seed: str, epoch: Column) -> Column:
    """Where a document stands in the epoch's order: 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.col("_who")))


def mix(
    docs: DataFrame,
    share: float,
    weights: Mapping[str, Mapping[str, float]],
    domain: Column | None = None,
    epochs: int = EPOCHS,
    seed: str = SEED,
    range_rows: int | None = None,
) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``n_epochs``, the number of times a document is drawn; undrawn ones are left out.

    The budget is ``share`` of all tokens (white-space separated words) of ``docs``. ``range_rows`` sets the mean size of
    a hash range in place of the square root of the leaf's rows.
    """
    kind = source_domain(F.col("source")) if domain is None else domain
    leaf = {"_domain": _name(kind), "_lang": _name(F.col("lang")), "_source": _name(F.col("source"))}
    tokens = F.regexp_count(whole_text(), F.lit(WORD)).cast("bigint")
    slim = materialize(docs.select(_who().alias("_who"), *[c.alias(n) for n, c in leaf.items()], tokens.alias("n")), "mix-tokens")
    leaves = materialize(slim.groupBy(_LEAF).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("rows")), "mix-leaves")
    budgets = leaf_budgets(leaves.select(*_LEAF, "tokens"), F.col("tokens") * share, epochs, weights)
    # A millionth of a token absorbs the rounding of the shares.
    ask = F.floor(F.col("budget") + 1e-6).cast("bigint")
    plan = budgets.select(*_LEAF, F.expr("tokens").alias("tokens"), ask.alias("budget")).select(
        *_LEAF, F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("full"),
        (F.col("budget") % F.col("tokens")).alias("rest"),
    )
    n_ranges = F.sqrt("rows") if range_rows is None else F.col("rows") / range_rows
    ranges = leaves.select(*_LEAF, F.ceil(n_ranges).cast("bigint").alias("ranges"))
    plan = materialize(plan.join(ranges, _LEAF), "mix-plan")
    last = _place(seed, F.col("full"))
    bucket = F.floor(F.conv(F.substring("_at", 1, 8), 16, 10).cast("bigint") * F.col("ranges") / _PLACES)
    placed = slim.join(plan, _LEAF).where("rest > 0").withColumn("_at", last).withColumn("_range", bucket)
    sums = placed.groupBy(*_LEAF, "_range").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    upto = Window.partitionBy(_LEAF).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("_sum", F.sum("n").over(upto))
    cut = materialize(
        sums.where("_sum > rest AND _sum - n <= rest").select(*_LEAF, "_range", (F.col("_sum") - F.col("n")).alias("_before")),
        "mix-cuts",
    )
    inside = placed.join(cut, [*_LEAF, "_range"])
    running = Window.partitionBy(*_LEAF, "_range").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("_sum", F.col("_before") + F.sum("n").over(running))
    ends = inside.where("_sum <= rest").groupBy(_LEAF).agg(F.max("_at").alias("_end"))
    cuts = plan.join(cut.select(*_LEAF, F.col("_range").alias("_cut")), _LEAF, "left").join(ends, _LEAF, "left")
    cuts = materialize(cuts.select(*_LEAF, "full", "rest", "ranges", "_cut", "_end"), "mix-ends")
    columns = [c for c in docs.columns if c not in ("n_tokens", "n_epochs")]
    kept = F.struct(*[named(c).alias(c) for c in columns]).alias("_doc")
    rows = docs.select(kept, _who().alias("_who"), *[c.alias(n) for n, c in leaf.items()], tokens.alias("n_tokens"))
    rows = rows.join(cuts, _LEAF)
    here = F.floor(F.conv(F.substring(last, 1, 8), 16, 10).cast("bigint") * F.col("ranges") / _PLACES)
    chosen = (F.col("rest") > 0) & ((here < F.col("_cut")) | ((here == F.col("_cut")) & (last <= F.col("_end"))))
    drawn = rows.withColumn("n_epochs", F.col("full") + F.coalesce(chosen, F.lit(False)).cast("int")).where("n_epochs > 0")
    return drawn.select(*[F.col("_doc").getField(c).alias(c) for c in columns], "n_tokens", "n_epochs")
