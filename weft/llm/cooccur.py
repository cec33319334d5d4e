"""Items that appear together: pair counts, lift and pointwise mutual information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weft.session import cut

#: Items of a basket that are one array; larger baskets are arrays of about so many, paired with each other.
ARRAY_ITEMS = 256


def tidy_path(path: Column) -> Column:
    """Backslashes as slashes, several slashes as one, without a leading ``./``."""
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "/+", "/"), r"^\./", "")


def baskets(rows: DataFrame, basket: Column, item: Column, max_items: int | None) -> DataFrame:
    """(basket, item): the distinct items of each basket, without baskets of more than ``max_items``.

    Sizes are counted before anything is gathered, and only the few baskets that are too large are looked up, so
    that a basket with a third of all rows is counted map-side and dropped, never collected. The rows are read once: their
    distinct pairs go to the shared folder."""
    pairs = cut(rows.select(basket.alias("basket"), item.alias("item")).where("basket IS NOT NULL AND item IS NOT NULL").distinct())
    if max_items is None:
        return pairs
    wide = pairs.groupBy("basket").count().where(F.col("count") > max_items).select("basket")
    return pairs.join(wide, "basket", "left_anti")


def _emitted(pairs: DataFrame, largest: int | None) -> DataFrame:
    """(scope, p): the ordered pairs of items of each basket and scope."""
    within = F.transform("items", lambda a, i: F.transform(F.slice("items", i + 2, F.greatest(F.size("items") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    arrays = lambda df, *by: df.groupBy("basket", "scope", *by).agg(F.sort_array(F.collect_list("item")).alias("items"))
    if largest is not None and largest <= ARRAY_ITEMS:
        return arrays(pairs).where(F.size("items") > 1).select("scope", F.explode(F.flatten(within)).alias("p"))
    sizes = pairs.groupBy("basket", "scope").count().where(F.col("count") > ARRAY_ITEMS)
    small = arrays(pairs.join(sizes.select("basket", "scope"), ["basket", "scope"], "left_anti")).where(F.size("items") > 1)
    # A large basket is dealt out into arrays; each array is paired with itself and, item by item, with those behind it.
    dealt = pairs.join(sizes, ["basket", "scope"]).withColumn("part", F.pmod(F.xxhash64("item"), F.ceil(F.col("count") / ARRAY_ITEMS)))
    dealt = cut(arrays(dealt, "part"))
    other = dealt.select("basket", "scope", F.col("part").alias("part_b"), F.col("items").alias("items_b"))
    across = dealt.join(other, ["basket", "scope"]).where("part < part_b").select("scope", F.explode("items").alias("a"), "items_b")
    across = across.select("scope", F.explode(F.transform("items_b", lambda b: F.struct(F.least("a", b).alias("a"), F.greatest("a", b).alias("b")))).alias("p"))
    whole = small.select("scope", "items").unionByName(dealt.select("scope", "items"))
    return whole.select("scope", F.explode(F.flatten(within)).alias("p")).unionByName(across)


def co_occurrence(pairs: DataFrame, scope: Column | None = None, min_together: int = 1, largest: int | None = None) -> DataFrame:
    """(scope, item_a, item_b, together, n_a, n_b, n_baskets, lift, pmi) for items of one scope, item_a < item_b.

    ``pairs`` is what :func:`baskets` returns. ``scope`` is an expression on ``item`` (for example its folder): pairs
    are formed inside a scope, and n_baskets counts the baskets that touch it; None is one scope over all. The items
    of a basket are one array, pairs are emitted in order from it and counted with a partial aggregate before the
    shuffle; a basket of more than ``ARRAY_ITEMS`` is several arrays, so that no row holds all of its pairs. ``largest`` tells
    that no basket has more items than that. ``lift`` is together * n_baskets / (n_a * n_b) and ``pmi`` its binary logarithm. ``min_together`` drops
    rarer pairs before the marginals are joined.

    Repeated rows count once; null baskets and items not at all; a basket of one item counts in the marginals only.
    Ties do not matter. No rows give no rows."""
    pairs = pairs.select("basket", "item", (scope if scope is not None else F.lit("")).alias("scope"))
    together = _emitted(pairs, largest).groupBy("scope", F.col("p.a").alias("item_a"), F.col("p.b").alias("item_b")).agg(F.count("*").alias("together"))
    together = together.where(F.col("together") >= min_together)
    alone = pairs.groupBy("scope", "item").agg(F.count("*").alias("n"))
    touched = pairs.select("scope", "basket").distinct().groupBy("scope").agg(F.count("*").alias("n_baskets"))
    a = alone.select(F.col("scope").alias("__sa"), F.col("item").alias("__a"), F.col("n").alias("n_a"))
    b = alone.select(F.col("scope").alias("__sb"), F.col("item").alias("__b"), F.col("n").alias("n_b"))
    out = together.join(a, (F.col("scope") == F.col("__sa")) & (F.col("item_a") == F.col("__a"))).join(b, (F.col("scope") == F.col("__sb")) & (F.col("item_b") == F.col("__b"))).join(touched, "scope")
    lift = F.col("together") * F.col("n_baskets") / (F.col("n_a") * F.col("n_b"))
    return out.select("scope", "item_a", "item_b", "together", "n_a", "n_b", "n_baskets", lift.alias("lift"), F.log2(lift).alias("pmi"))
