"""Time joins: as-of, nearest and interval.

As-of joins range-partition both sides together by (key, time), so neither a key
nor a moment with most of the rows becomes one task; what a partition needs from
earlier ones is one row per key, carried over the short list of partitions.
Interval joins are equi-joins on (key, time bucket), which adaptive execution
can split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from candela.session import durable


def _bucket(ts: Column, width: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(width * 1_000_000))


def asof_join(
    left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, by: Sequence[str] = ("symbol",),
    tie: Sequence[str] = (), forward: bool = False, tolerance: int | None = None, prefix: str = "",
) -> DataFrame:
    """Every left row with the latest right row at or before it (inclusive).

    ``forward`` takes the earliest right row at or after it instead.  Equal
    right times are ordered by ``tie`` (the last one wins; with ``forward`` the
    first one).  Right columns get ``prefix``; ``tolerance`` is in seconds.
    Left rows without a time, and right rows without one, have no match.
    """
    by = list(by)
    payload = [c for c in right.columns if c not in by]
    r = right.filter(F.col(right_ts).isNotNull()).select(
        *by, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.struct(*[F.col(c) for c in tie], F.lit(0)).alias("_tie"),
        F.struct(*[F.col(c).alias(f"{prefix}{c}") for c in payload]).alias("_r"))
    l = left.select(*by, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_l"))
    events = r.unionByName(l, allowMissingColumns=True)
    # equal times of many rows are told apart by a hash of the row
    at, ties = F.col("_t"), F.col("_tie")
    order = [*by, *([at.desc_nulls_first(), "_side", ties.desc()] if forward else [at.asc(), "_side", ties.asc()]), F.xxhash64("_l")]
    placed = durable(
        events.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id()).withColumn("_pid", F.shiftright("_mid", 33)))
    edges = placed.groupBy(*by, "_pid").agg(F.max_by("_r", F.when(F.col("_side") == 0, F.col("_mid"))).alias("_edge"))
    # one row per partition and key in it
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_pid").alias("_of"),
                           F.last("_edge", ignorenulls=True).over(earlier).alias("_carry"))
    inside = Window.partitionBy(*by, "_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    last = placed.withColumn("_m", F.last("_r", ignorenulls=True).over(inside)).filter("_side = 1")
    same = F.col("_pid") == F.col("_of")
    for i, c in enumerate(by):
        same = same & last[c].eqNullSafe(carried[f"_by{i}"])
    matched = last.join(carried, same, "left").withColumn("_m", F.when(at.isNotNull(), F.coalesce("_m", "_carry")))
    if tolerance is not None:
        gap = F.abs(F.unix_micros("_t") - F.unix_micros(F.col("_m").getField(f"{prefix}{right_ts}")))
        matched = matched.withColumn("_m", F.when(gap <= tolerance * 1_000_000, F.col("_m")))
    return matched.select("_l.*", *[F.col("_m").getField(f"{prefix}{c}").alias(f"{prefix}{c}") for c in payload])


def nearest_join(
    left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, by: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Every left row with the closest right row in time; a tie takes the earlier one."""
    payload = [c for c in right.columns if c not in by]
    both = asof_join(left, right, left_ts, right_ts, by, prefix="_p_")
    both = asof_join(both, right, left_ts, right_ts, by, forward=True, prefix="_f_")
    at = F.unix_micros(left_ts)
    back = at - F.unix_micros(f"_p_{right_ts}")
    ahead = F.unix_micros(f"_f_{right_ts}") - at
    use_back = F.col(f"_f_{right_ts}").isNull() | (back <= ahead)
    return both.select(
        *left.columns,
        *[F.when(use_back, F.col(f"_p_{c}")).otherwise(F.col(f"_f_{c}")).alias(c) for c in payload],
    )


def interval_join(
    left: DataFrame, right: DataFrame, low: Column, high: Column, right_ts: str, by: Sequence[str] = (),
    closed: str = "both", bucket: int = 3600,
) -> DataFrame:
    """Pairs with ``low <= right_ts <= high`` (``closed='left'``: ``< high``).

    The left side is sent to each bucket it overlaps; the right side is not
    copied.  Aggregate the right side first where only aggregates are needed.
    """
    upper = F.col(right_ts) <= F.col("_hi") if closed == "both" else F.col(right_ts) < F.col("_hi")
    spread = (
        left.withColumn("_lo", low).withColumn("_hi", high)
        .withColumn("_b", F.explode(F.sequence(_bucket(F.col("_lo"), bucket), _bucket(F.col("_hi"), bucket))))
    )
    placed = right.withColumn("_b", _bucket(F.col(right_ts), bucket))
    return (
        spread.join(placed, [*by, "_b"])
        .filter((F.col(right_ts) >= F.col("_lo")) & upper)
        .drop("_b", "_lo", "_hi")
    )
