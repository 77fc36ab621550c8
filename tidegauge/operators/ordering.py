"""Exact row positions and neighbours that do not depend on group size.

A ranking window over an unbounded group runs in one task. These helpers range-
partition the whole frame instead, so one group may span any number of tasks:
sort globally, number rows inside each output partition, add the partition's
offset, subtract the group's first position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.session import broadcast_if_small, materialise

_ROW_BITS = 33  # low bits of monotonically_increasing_id


def positions(
    df: DataFrame,
    order: Sequence[Column | str],
    group: Sequence[str] = (),
    name: str = "position",
) -> DataFrame:
    """Add the 1-based position of each row in its group under a total order.

    ``order`` must end in a unique tie-break. The result is materialised, so it
    can be read several times without being sorted again.
    """
    numbered = materialise(
        df.orderBy(*group, *order).withColumn("_mid", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_mid", _ROW_BITS))
    # One row per sort partition: bounded by the session's partition count.
    by_part = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy("_part").agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(by_part), F.lit(0)).alias("_offset"))
    )
    placed = numbered.join(F.broadcast(offsets), "_part").withColumn(
        "_pos", F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + F.col("_offset") + 1
    )
    if group:
        # Few groups reach the rows where these lie; only many groups are worth a shuffle of all rows.
        starts = broadcast_if_small(materialise(
            placed.groupBy(*[F.col(c).alias(f"_g_{c}") for c in group]).agg(F.min("_pos").alias("_start"))
        ))
        same = F.lit(True)
        for c in group:
            same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        placed = placed.join(starts, same).withColumn(name, F.col("_pos") - F.col("_start") + 1)
        placed = placed.drop("_start", *[f"_g_{c}" for c in group])
    else:
        placed = placed.withColumn(name, F.col("_pos"))
    return placed.drop("_mid", "_part", "_offset", "_pos")


def average_ranks(df: DataFrame, value: str, group: Sequence[str], name: str, tie_break: Sequence[str]) -> DataFrame:
    """Ascending rank with ties sharing their mean position."""
    placed = positions(df, [value, *tie_break], group, "_p")
    ties = placed.groupBy(*group, value).agg(
        ((F.min("_p") + F.max("_p")) / F.lit(2.0)).alias(name)
    )
    return placed.drop("_p").join(ties, [*group, value])


def with_previous(
    df: DataFrame,
    order: Sequence[Column | str],
    group: Sequence[str],
    columns: Sequence[str],
    prefix: str = "prev_",
) -> DataFrame:
    """Attach the preceding row's columns by joining positions, one row to one row."""
    placed = materialise(positions(df, order, group, "_p"))
    previous = placed.select(
        *group, (F.col("_p") + 1).alias("_p"), *[F.col(c).alias(prefix + c) for c in columns]
    )
    return placed.join(previous, [*group, "_p"], "left").withColumnRenamed("_p", "position")


def last_before(df: DataFrame, order: Sequence[Column | str], group: Sequence[str], value: str, name: str) -> DataFrame:
    """The latest non-null ``value`` strictly before each row of its group.

    A forward fill without a window over the group: rows look back inside their
    own sort partition, and one carried value per (group, partition) covers what
    lies in earlier partitions.
    """
    group = list(group)
    numbered = materialise(
        df.orderBy(*group, *order).withColumn("_mid", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_mid", _ROW_BITS))
    here = Window.partitionBy(*group, "_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    # One row per group and sort partition it touches.
    ends = numbered.where(F.col(value).isNotNull()).groupBy(*group, "_part").agg(F.max_by(value, "_mid").alias("_end"))
    touched = numbered.select(*group, "_part").distinct().join(ends, [*group, "_part"], "left")
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = touched.select(*group, "_part", F.last("_end", True).over(earlier).alias("_carry"))
    filled = numbered.withColumn("_local", F.last(value, True).over(here)).join(carried, [*group, "_part"], "left")
    return filled.withColumn(name, F.coalesce("_local", "_carry")).drop("_mid", "_part", "_local", "_carry")


class Order:
    """Rows sorted once by group and order, for running aggregates of values that change from round to round."""

    def __init__(self, df: DataFrame, order: Sequence[Column | str], group: Sequence[str]):
        self.group = list(group)
        self.rows = materialise(df.orderBy(*group, *order).withColumn("_mid", F.monotonically_increasing_id())).withColumn(
            "_part", F.shiftright("_mid", _ROW_BITS))

    def running_min(self, values: DataFrame, key: str, value: str) -> DataFrame:
        """Smallest ``value`` among the rows of the group up to each row; ``values`` has one row per ``key``.

        Inside a sort partition by a window; one minimum per group and partition carries over to later partitions.
        """
        timed = self.rows.join(values.select(key, value), key)
        here = Window.partitionBy(*self.group, "_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
        ends = timed.groupBy(*self.group, "_part").agg(F.min(value).alias("_end"))
        earlier = Window.partitionBy(*self.group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*self.group, "_part", F.min("_end").over(earlier).alias("_carry"))
        filled = timed.withColumn("_local", F.min(value).over(here)).alias("t").join(
            carried.alias("c"), [F.col(f"t.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*self.group, "_part")], "left")
        return filled.select("t.*", "_carry").withColumn(value, F.least("_local", "_carry")).drop("_mid", "_part", "_local", "_carry")
