"""Items that appear together, by large-basket blocking.

Baskets up to `chunk` items give their pairs directly. The items of a larger basket are split by hash into chunks, and
every pair of chunks becomes a task of its own, whose product of items joins the pairs of the ordinary baskets. Pairs are
counted where they arise before they are shuffled. Items that no asked-for pair can contain are left out first: n_ab is
at most n_a and n_b, hence a pair with n_ab >= min_count has n_a, n_b >= min_count, and one with lift >= min_lift has
n_a, n_b <= N / min_lift. This is exact; with min_count 1 and min_lift 0 nothing is left out.

Defined results: null baskets or items are ignored, repeated rows count once, an item makes no pair with itself, baskets of
one item give no pairs, empty tables give an empty result, and other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.operators.skew import sized_join
from quirefold.runtime import materialize


def chunks(uses: DataFrame, chunk: int) -> DataFrame:
    """(basket, k, c, items): the items of each basket, sorted, in k chunks of about `chunk` items."""
    sizes = uses.groupBy("basket").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
    # Written, so that the planner knows how few they are.
    large = materialize(sizes.select("basket", F.ceil(F.col("n") / chunk).cast("int").alias("k")), "large")
    cut = sized_join(uses, large, ["basket"], "left").withColumn("k", F.coalesce("k", F.lit(1)))
    place = F.pmod(F.xxhash64("item", "basket"), F.col("k")).cast("int")
    return cut.withColumn("c", place).groupBy("basket", "k", "c").agg(F.array_sort(F.collect_list("item")).alias("items"))


def pairs(cut: DataFrame) -> DataFrame:
    """(a, b) with a < b, once for each basket that holds both."""
    # Pairs within a chunk: each item with those behind it.
    behind = F.slice("items", F.col("pos") + 2, F.size("items"))
    within = cut.where(F.size("items") > 1).select("items", F.posexplode("items").alias("pos", "a"))
    within = within.select("a", F.explode(behind).alias("b"))
    # Products of two chunks of one large basket: chunk c is sent to the cells (c, other) and (other, c).
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    cells = (
        cut.where("k > 1")
        .select("basket", "c", "items", other.alias("o"))
        .where("c <> o")
        .groupBy("basket", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"))
        .agg(F.collect_list("items").alias("two"))
        .where(F.size("two") == 2)
    )
    across = cells.select(F.explode(F.col("two")[0]).alias("x"), F.col("two")[1].alias("y")).select("x", F.explode("y").alias("y"))
    return within.unionByName(across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def cooccurrence(
    rows: DataFrame, basket: str, item: str, min_count: int = 1, min_lift: float = 0.0, chunk: int = 128
) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, lift, npmi), item_a before item_b, of the pairs with n_ab >= min_count and
    n_ab * N / (n_a * n_b) >= min_lift. N counts the baskets with an item. Items may be of any type that can be ordered."""
    uses = rows.select(F.col(basket).alias("basket"), F.col(item).alias("name")).where("basket IS NOT NULL AND name IS NOT NULL").distinct()
    uses = materialize(uses, "uses")
    total = uses.select("basket").distinct().count()
    counts = uses.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    if min_lift > 0:
        counts = counts.where(F.col("n") <= total / min_lift)
    # Integers stand for the items; written, so that they stay the same when a task is repeated.
    items = materialize(counts.withColumn("item", F.monotonically_increasing_id()), "items")
    coded = sized_join(uses, items.select("name", "item"), ["name"]).select("basket", "item")
    together = pairs(materialize(chunks(coded, chunk), "chunks")).groupBy("a", "b").agg(F.count("*").alias("n_ab")).where(F.col("n_ab") >= min_count)
    for side in ("a", "b"):
        own = items.select(F.col("item").alias(side), F.col("name").alias(f"name_{side}"), F.col("n").alias(f"n_{side}"))
        together = sized_join(together, own, [side])
    swap = F.col("name_a") > F.col("name_b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    n = F.lit(float(total))
    d = {c: F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b")}
    lift = d["n_ab"] * n / (d["n_a"] * d["n_b"])
    npmi = F.when(d["n_ab"] == n, F.lit(1.0)).otherwise(F.log(lift) / -F.log(d["n_ab"] / n))
    out = together.select(
        pick("name_a", "name_b").alias("item_a"), pick("name_b", "name_a").alias("item_b"), "n_ab",
        pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b"), lift.alias("lift"), npmi.alias("npmi"),
    )
    return out.where(F.col("lift") >= min_lift)
