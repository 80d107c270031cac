"""Row positions, blocks and prefix values without one-task windows.

A plain ``Window.partitionBy(symbol).orderBy(ts)`` puts a whole symbol into one
task.  Everything here works on bounded blocks instead:

* ``candle_index``  numbers candle rows per key.  A candle table has at most
  one row per key and interval, so a chunk of ``chunk`` intervals is bounded.
* ``ordered_index`` numbers any table along any order.  The rows are range
  partitioned on a unique order, so no key can make a partition hot.
* ``blocked``       runs a window function over blocks of rows, each preceded
  by the ``halo`` rows it needs.
* ``running``       prefix sum / max / min / last over all earlier rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from candela.session import durable, scratch_path

INTERVAL_SECONDS = {
    "1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600,
    "4h": 14400, "12h": 43200, "1d": 86400, "1w": 604800,
}


def seconds(interval: str) -> int:
    return INTERVAL_SECONDS[interval]


def candle_index(
    df: DataFrame, interval: str, keys: Sequence[str] = ("symbol",), ts: str = "ts",
    name: str = "rn", chunk: int = 8192,
) -> DataFrame:
    """Dense 1-based position of every candle within its key, in time order."""
    keys = list(keys)
    span = seconds(interval) * chunk
    rows = df.withColumn("_chunk", F.floor(F.unix_seconds(F.col(ts)) / F.lit(span)))
    sizes = rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = Window.partitionBy(*keys, "_chunk").orderBy(ts)
    return (
        rows.join(offsets, [*keys, "_chunk"])
        .withColumn(name, F.col("_off") + F.row_number().over(local))
        .drop("_chunk", "_off")
    )


def ordered_index(
    df: DataFrame, order: Sequence[str | Column], keys: Sequence[str] = (), name: str = "rn",
) -> DataFrame:
    """Dense 1-based position along ``order`` (per key when ``keys`` is given).

    ``order`` must be unique.  Rows are range partitioned and sorted once; only
    partition sizes (one small row per partition and key) are summed up.
    """
    keys = list(keys)
    placed = durable(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_pid", F.shiftright("_mid", 33))
    )
    sizes = placed.groupBy(*keys, "_pid").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first")
    )
    # at most (number of partitions + number of keys) rows in total
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        *keys, "_pid", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_off")
    )
    return (
        placed.join(offsets, [*keys, "_pid"])
        .withColumn(name, F.col("_mid") + F.col("_off"))
        .drop("_mid", "_pid", "_off")
    )


def rows_at(df: DataFrame, order: Sequence[str | Column], offset: int, limit: int, top: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Rows ``offset`` to ``offset + limit`` along ``order``, and one row with the total number of rows.

    Rows near the beginning are picked by a bounded top-k in every task.  Beyond ``top`` the rows are range partitioned
    into folders, and only the folders that the positions fall into are read.  Rows of equal order may change places.
    """
    if offset + limit <= top:
        return df.orderBy(*order).offset(offset).limit(limit), df.agg(F.count(F.lit(1)).alias("total"))
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "positions")
    df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()).write.partitionBy("_pid").parquet(path)
    schema = StructType([*df.schema, StructField("_pid", IntegerType())])
    placed = spark.read.schema(schema).parquet(path)
    starts, total = [], 0
    for pid, n in sorted(tuple(r) for r in placed.groupBy("_pid").count().collect()):  # a row per partition
        if total < offset + limit and total + n > offset:
            starts.append((pid, total))
        total += n
    some = placed.filter(F.col("_pid").isin([p for p, _ in starts]))
    before = F.lit(0)
    for pid, n in starts:
        before = F.when(F.col("_pid") == pid, n).otherwise(before)
    at = before + F.row_number().over(Window.partitionBy("_pid").orderBy(*order))  # a range partition is bounded
    rows = some.withColumn("_at", at).filter((F.col("_at") > offset) & (F.col("_at") <= offset + limit))
    return rows.orderBy("_at").drop("_pid", "_at"), spark.range(1).select(F.lit(total).cast("long").alias("total"))


def blocked(
    df: DataFrame, halo: int, compute: Callable[[DataFrame, Window], DataFrame],
    keys: Sequence[str] = ("symbol",), rn: str = "rn", block: int = 4096, ahead: int = 0,
) -> DataFrame:
    """Run ``compute(rows, window)`` on blocks that carry ``halo`` earlier rows.

    ``ahead`` does the same for later rows.  ``window`` is ordered by position
    inside one block; frames up to ``halo`` back and ``ahead`` forward are exact.
    """
    block = max(block, halo, ahead, 1)
    own = F.floor((F.col(rn) - 1) / F.lit(block))
    within = F.pmod(F.col(rn) - 1, F.lit(block))
    targets = [own]
    if halo:
        targets.append(F.when(within >= block - halo, own + 1))
    if ahead:
        targets.append(F.when(within < ahead, own - 1))
    rows = (
        df.withColumn("_own", own)
        .withColumn("_blk", F.explode(F.array_compact(F.array(*targets))))
    )
    window = Window.partitionBy(*keys, "_blk").orderBy(rn)
    return compute(rows, window).filter("_blk = _own").drop("_blk", "_own")


_PREFIX = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame, values: dict[str, tuple[str, Column | str]], keys: Sequence[str] = (),
    rn: str = "rn", block: int = 65536,
) -> DataFrame:
    """Inclusive prefix values: ``{"out": ("sum" | "max" | "min" | "last", column)}``.

    Block totals are aggregated first (map-side), combined over the short block
    list, and added to the value inside the block.
    """
    keys = list(keys)
    rows = df.withColumn("_blk", F.floor((F.col(rn) - 1) / F.lit(block)))
    cols = {n: (op, F.col(c) if isinstance(c, str) else c) for n, (op, c) in values.items()}
    for n, (_, c) in cols.items():
        rows = rows.withColumn(f"_v_{n}", c)

    def total(n: str, op: str) -> Column:
        v = F.col(f"_v_{n}")
        if op == "last":
            return F.max_by(v, F.when(v.isNotNull(), F.col(rn)))
        return _PREFIX[op](v)

    totals = rows.groupBy(*keys, "_blk").agg(*[total(n, op).alias(f"_t_{n}") for n, (op, _) in cols.items()])
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_blk").rowsBetween(
        Window.unboundedPreceding, -1
    )

    def carry(n: str, op: str) -> Column:
        t = F.col(f"_t_{n}")
        return (F.last(t, ignorenulls=True) if op == "last" else _PREFIX[op](t)).over(before)

    carried = totals.select(*keys, "_blk", *[carry(n, op).alias(f"_c_{n}") for n, (op, _) in cols.items()])
    local = Window.partitionBy(*keys, "_blk").orderBy(rn).rowsBetween(Window.unboundedPreceding, 0)

    def joined(n: str, op: str) -> Column:
        v, c = F.col(f"_v_{n}"), F.col(f"_c_{n}")
        if op == "last":
            return F.coalesce(F.last(v, ignorenulls=True).over(local), c)
        inner = _PREFIX[op](v).over(local)
        if op == "sum":
            return F.coalesce(c, F.lit(0.0)) + F.coalesce(inner, F.lit(0.0))
        pick = F.greatest if op == "max" else F.least
        return pick(inner, c)

    out = rows.join(carried, [*keys, "_blk"])
    out = out.withColumns({n: joined(n, op) for n, (op, _) in cols.items()})
    return out.drop("_blk", *[f"_v_{n}" for n in cols], *[f"_c_{n}" for n in cols])


def exact_quantiles(
    df: DataFrame, column: str, wanted: dict[str, float], keys: Sequence[str] = (),
) -> DataFrame:
    """Exact, linearly interpolated quantiles of ``column`` (one row per key).

    Rows are counted per distinct value before anything is sorted.  Prefix sums of the counts give the positions
    that a value covers; only the (at most two) values around each quantile are picked, so nothing is collected into
    one task.
    """
    keys = list(keys)
    values = df.select(*keys, F.col(column).alias("_x")).filter("_x is not null").groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c"))
    placed = running(ordered_index(values, ["_x"], keys), {"_upto": ("sum", "_c")}, keys)
    size = values.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    picked = placed.join(size, keys) if keys else placed.join(F.broadcast(size))  # one row
    aggs = []
    near = F.lit(False)
    covers = lambda r: (F.col("_upto") >= r) & (F.col("_upto") - F.col("_c") < r)
    for name, p in wanted.items():
        at = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.floor(at) + 1, F.ceil(at) + 1
        near = near | covers(lo) | covers(hi)
        low = F.max(F.when(covers(lo), F.col("_x")))
        high = F.max(F.when(covers(hi), F.col("_x")))
        frac = F.max(at - F.floor(at))
        aggs.append((low + (high - low) * frac).alias(name))
    return picked.filter(near).groupBy(*keys).agg(*aggs)


def fold_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], new_state, step, schema: str) -> DataFrame:
    """Run a small state machine over each key in order, batch by batch.

    Rows arrive as sorted Arrow batches and only the state is kept, so memory
    does not grow with a key.  ``step(state, pdf) -> pdf`` handles the rows of
    one key within one batch.
    """
    keys = list(keys)

    def run(batches):
        current, state = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            starts = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
            for at, end in zip(starts, [*starts[1:], len(pdf)]):
                part = pdf.iloc[at:end]
                key = tuple(part[keys].iloc[0])
                if key != current:
                    current, state = key, new_state()
                yield step(state, part)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
