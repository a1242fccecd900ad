"""Ranks and running totals that never put a whole group into one task.

A plain `row_number().over(partitionBy(g))` sends all rows of `g` to one task; with a group that holds a third of the
table that task is the job. Both functions below split each group into ordered pieces, total the pieces with partial
aggregation, carry the totals forward over the pieces (a few thousand rows per group) and rank inside each piece.

For "the first k of each group" with a small k use `first_k`: Spark limits each map task to k rows per group before the
shuffle, so hot groups shrink at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voicelake.session import cut


def hash_order(seed: str | int, *keys: str | Column) -> Column:
    """The md5 text that replaces a seeded shuffle: it does not depend on row position or partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on `on` where NULL equals NULL; keeps the left key columns."""
    if not on:
        raise ValueError("null_safe needs at least one key")
    renamed = right.select(*[F.col(c).alias(f"__k_{c}") for c in on], *[c for c in right.columns if c not in on])
    condition = None
    for c in on:
        part = F.col(c).eqNullSafe(F.col(f"__k_{c}"))
        condition = part if condition is None else condition & part
    return left.join(renamed, condition, how).drop(*[f"__k_{c}" for c in on])


def first_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked. `order` must be total for a repeatable result."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def hash_ranked(df: DataFrame, by: Sequence[str], key: str, seed: str | int, name: str = "rank", digits: int = 3) -> DataFrame:
    """Number the rows of each group from 1 in md5 order of (seed, key).

    The leading hex digits of the hash are the ordered pieces: 16**digits of about equal size whatever the group.
    """
    hashed = df.withColumn("__order", hash_order(seed, key)).withColumn("__slice", F.substring("__order", 1, digits))
    pieces = hashed.groupBy(*by, "__slice").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select(*by, "__slice", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*by, "__slice").orderBy("__order", key)
    ranked = hashed.withColumn("__inside", F.row_number().over(inside))
    return (
        null_safe(ranked, carried, [*by, "__slice"])
        .withColumn(name, F.col("__before") + F.col("__inside"))
        .drop("__before", "__inside", "__order", "__slice")
    )


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column], **totals: Column) -> DataFrame:
    """Inclusive running totals inside each group, in a total order over any sortable columns.

    Range partitioning on (group, order) balances the pieces by sampling. The placement is written down because the
    piece numbers must not move between the pass that totals pieces and the pass that reads rows.
    """
    placed = cut(
        df.select("*", *[c.alias(f"__v_{n}") for n, c in totals.items()])
        .repartitionByRange(*[F.col(c) for c in by], *order)
        .withColumn("__piece", F.spark_partition_id())
    )
    pieces = placed.groupBy(*by, "__piece").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in totals])
    earlier = Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select(
        *by, "__piece", *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in totals]
    )
    inside = Window.partitionBy(*by, "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", *[F.sum(f"__v_{n}").over(inside).alias(f"__i_{n}") for n in totals])
    joined = null_safe(local, carried, [*by, "__piece"])
    for n in totals:
        joined = joined.withColumn(n, F.col(f"__b_{n}") + F.coalesce(F.col(f"__i_{n}"), F.lit(0)))
    return joined.drop("__piece", *[f"__{p}_{n}" for p in "vbi" for n in totals])


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """row_number in a total value order, skew-proof (see `running`)."""
    return running(df, by, order, **{name: F.lit(1).cast("bigint")})


def round_robin(df: DataFrame, by: Sequence[str], lane: str, key: str, seed: str | int, name: str = "turn") -> DataFrame:
    """Interleave lanes inside each group: all first rows of the lanes, then all second rows, and so on.

    The position of a row is its turn inside its lane, ties broken by lane name. When a caller skips rows later the
    positions stay as they are: this is a fixed priority, not a moving cursor.
    """
    return hash_ranked(df, [*by, lane], key, seed, name)
