"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT, HASH = "__salt", "__hash"


def hot_keys(df: DataFrame, key: str, support: float) -> dict[int | None, float]:
    """The share of the rows of every key that has more than `support` of them, by its hash; that of null under None.

    One pass with a sketch of fixed size (no shuffle of keys); 1 / support hashes at most reach the driver, however long the
    keys are. Two keys of one hash would be spread together, which costs a little and changes nothing.
    """
    k = min(100_000, int(1 / support) + 1)
    tracked = min(1_000_000, max(10_000, 8 * k))
    row = df.agg(
        F.expr(f"approx_top_k(if(isnull(`{key}`), NULL, xxhash64(`{key}`)), {k}, {tracked})").alias("top"), F.count("*").alias("n")
    ).first()
    return {item: count / row["n"] for item, count in map(tuple, row["top"]) if count > support * row["n"]}


def sized_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An ordinary join if the planner will broadcast `right`, whose size it knows from its tables; otherwise skew_join."""
    limit = left.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return left.join(right, on, how) if size <= limit else skew_join(left, right, on, how)


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", support: float | None = None) -> DataFrame:
    """Like `left.join(right, on, how)`, with the hot keys of `left` spread over tasks.

    A key of the first column of `on` is hot if it has more than `support` of the rows of `left`, by default a quarter of what a
    task gets on the average (1 / (4 * spark.sql.shuffle.partitions)); it is spread over as many salts as it has such shares. Only
    rows of `right` with a hot key are replicated. Rows of `left` whose key is null match nothing and are spread too. Without hot
    keys it is the ordinary join. `how`: inner, left, left_semi or left_anti. Other columns of the two sides must differ
    in name. Empty sides and repeated rows behave as in an ordinary join.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"skew_join does not support {how!r}")
    key, spark = on[0], left.sparkSession
    support = support or 1 / (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = hot_keys(left, key, support)
    if how in ("inner", "left_semi"):
        shares.pop(None, None)  # leaves the plan before the shuffle
    if not shares:
        return left.join(right, on, how)
    salts = {h: int(share / support) + 1 for h, share in shares.items()}
    nulls = salts.pop(None, 1)
    kind = left.schema[key].dataType
    # As many rows as there are hot keys, 1 / support at most.
    hot = F.broadcast(spark.createDataFrame(list(salts.items()), f"{HASH} bigint, {SALT} int"))
    many = F.coalesce(F.col(SALT), F.when(F.col(key).isNull(), nulls).otherwise(1))
    place = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), many).cast("int")
    a = left.withColumn(HASH, F.xxhash64(key)).join(hot, HASH, "left").withColumn(SALT, place).drop(HASH)
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(SALT), F.lit(1)) - 1))
    b = right.withColumn(HASH, F.xxhash64(F.col(key).cast(kind))).join(hot, HASH, "left").withColumn(SALT, copies).drop(HASH)
    return a.join(b, [*on, SALT], how).drop(SALT)
