"""Ranks, running totals and top-n in an order, without one-task windows.

A window without a partition key, or with one hot key, runs in one task. These
helpers cut the order into slices first, total each slice, and add the totals of
the slices ahead; every window then sees one slice only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerproof.session import durable


def running_totals(
    df: DataFrame,
    order_by: Sequence[Column],
    partition_by: Sequence[str] = (),
    sums: Mapping[str, Column] | None = None,
    position: str = "position",
    earlier_max: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Adds the 1-based position and inclusive running sums in a total order.
    `earlier_max` adds the largest value of the rows before this one.

    The slices come from a range partitioning. It is sampled, so the slice number
    is stored with the rows: both readers below see the same one, also after an
    executor is lost. `order_by` must order the rows totally.
    """
    sums, earlier_max = dict(sums or {}), dict(earlier_max or {})
    groups = list(partition_by)
    inputs = {f"_in_{name}": c for name, c in {**sums, **earlier_max}.items()}
    fold = {f"_in_{name}": F.max if name in earlier_max else F.sum for name in {**sums, **earlier_max}}
    sliced = durable(
        df.withColumns(inputs)
        .repartitionByRange(*[F.col(g) for g in groups], *order_by)
        .withColumn("_slice", F.spark_partition_id())
    )
    ahead = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy(*groups, "_slice").agg(
        F.count("*").alias("_n"), *[fold[c](c).alias(f"_t{c}") for c in inputs]
    )
    offsets = totals.select(
        *groups,
        "_slice",
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n"),
        *[fold[c](f"_t{c}").over(ahead).alias(f"_t{c}") for c in inputs],
    )
    here = Window.partitionBy(*groups, "_slice").orderBy(*order_by)
    upto, before = (here.rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
    return (
        sliced.join(offsets, [*groups, "_slice"])
        .withColumn(position, (F.row_number().over(here) + F.col("_n")).cast("bigint"))
        .withColumns(
            {
                **{n: F.sum(f"_in_{n}").over(upto) + F.coalesce(f"_t_in_{n}", F.lit(0)) for n in sums},
                **{n: F.greatest(F.max(f"_in_{n}").over(before), f"_t_in_{n}") for n in earlier_max},
            }
        )
        .drop("_slice", "_n", *inputs, *[f"_t{c}" for c in inputs])
    )


def _chunks(df: DataFrame, key: Sequence[str], position: str, value: str, fold, chunk: int):
    """Rows with their chunk and the folded value of the chunks ahead. A chunk is a
    function of the position alone, so one long document spreads over many tasks."""
    keys = [*key, "_chunk"]
    chunked = df.withColumn("_chunk", F.floor(F.col(position) / chunk))
    ahead = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = chunked.groupBy(*keys).agg(fold(value).alias("_v"))
    offsets = totals.select(*keys, fold("_v").over(ahead).alias("_ahead"))
    return chunked.join(offsets, keys), Window.partitionBy(*keys).orderBy(position)


def running_offsets(
    df: DataFrame, key: Sequence[str], position: str, width: str, name: str, chunk: int = 4096
) -> DataFrame:
    """Adds the sum of `width` over the rows before this one, per key."""
    joined, inside = _chunks(df, key, position, width, F.sum, chunk)
    earlier = F.sum(width).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return joined.withColumn(
        name, F.coalesce(earlier, F.lit(0)) + F.coalesce("_ahead", F.lit(0))
    ).drop("_chunk", "_ahead")


def with_previous(
    df: DataFrame, key: Sequence[str], position: str, columns: Sequence[str], name: str = "previous", chunk: int = 4096
) -> DataFrame:
    """Adds the struct of `columns` of the row before, per key in order of position.

    A lag over chunks of positions: inside a chunk it is a window, and a chunk's first row gets
    the last row of the nearest chunk ahead that has rows. A key of any size spreads over tasks.
    """
    keys = [*key, "_chunk"]
    chunked = df.withColumn("_chunk", F.floor(F.col(position) / chunk)).withColumn("_own", F.struct(position, *columns))
    ahead = Window.partitionBy(*key).orderBy("_chunk")
    edges = chunked.groupBy(*keys).agg(F.max("_own").alias("_last"))
    edges = edges.select(*keys, F.lag("_last").over(ahead).alias("_edge"))
    inside = Window.partitionBy(*keys).orderBy(position)
    return (
        chunked.join(edges, keys)
        .withColumn(name, F.coalesce(F.lag("_own").over(inside), "_edge"))
        .drop("_chunk", "_own", "_edge")
    )


def sorted_stretches(
    df: DataFrame, key: Sequence[str], position: str, value: str, descending: bool = False, chunk: int = 4096
) -> DataFrame:
    """Per key: rows, breaks (neighbours out of order) and longest_run (rows of the longest stretch in order).

    Neighbours are compared, edges of chunks included; equal and missing values break nothing.
    A key is in order where it has no breaks, and then its longest run is all of it.
    """
    paired = with_previous(df.select(*key, position, value), key, position, [value], "_before", chunk)
    here, before = F.col(value), F.col("_before")[value]
    breaks = F.coalesce(here > before if descending else here < before, F.lit(False)).cast("int")
    runs = running_offsets(paired.select(*key, position, breaks.alias("_break")), key, position, "_break", "_run", chunk)
    lengths = runs.groupBy(*key, (F.col("_run") + F.col("_break")).alias("_run")).agg(F.count(F.lit(1)).alias("_n"))
    return lengths.groupBy(*key).agg(
        F.sum("_n").alias("rows"), (F.count(F.lit(1)) - 1).alias("breaks"), F.max("_n").alias("longest_run")
    )


def top_n(
    df: DataFrame, n: int, partition_by: Sequence[str], order_by: Sequence[Column], rank: str = "rank"
) -> DataFrame:
    """The first n rows per group. The rank filter sits on the window itself, so
    each map task keeps only n rows per group before the shuffle."""
    window = Window.partitionBy(*partition_by).orderBy(*order_by)
    return (
        df.withColumn(rank, F.row_number().over(window))
        .filter(F.col(rank) <= n)
        .withColumn(rank, F.col(rank).cast("bigint"))
    )


def contenders(df: DataFrame, n: int, partition_by: Sequence[str], metric: str, slots: int = 128) -> DataFrame:
    """The rows that can be among the first n of their group by metric, largest first, ties included.

    Each group is dealt over slots. The n-th of the slots' maxima is reached by n rows at least, so
    no row below it is among the first n. Few rows are left to sort; a group in which fewer than n
    slots have a value keeps all its rows.
    """
    best = df.groupBy(*partition_by, F.pmod(F.xxhash64(metric), F.lit(slots)).alias("_slot")).agg(F.max(metric).alias("_best"))
    floors = best.groupBy(*partition_by).agg(F.get(F.sort_array(F.collect_list("_best"), asc=False), F.lit(n - 1)).alias("_floor"))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in partition_by]
    floors = durable(floors.select(*[F.col(c).alias(f"_k_{c}") for c in partition_by], "_floor"))
    met = df.join(floors, reduce(lambda a, b: a & b, same), "left")
    return met.filter(F.col("_floor").isNull() | (F.col(metric) >= F.col("_floor"))).select(*df.columns)


def last_wins(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """One row per key: the one with the greatest order value."""
    return top_n(df, 1, key, [F.col(order).desc()], "_last").drop("_last")


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_n(df, 1, key, order, "_first").drop("_first")


def exact_median(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group, median) from counts per distinct value: no group is held in memory."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    totals = counts.groupBy(*group).agg(F.sum("_c").alias("_total"))
    ranked = running_totals(counts, [F.col(value)], group, {"_upto": F.col("_c")}, "_pos")
    low, high = F.expr("(_total + 1) div 2"), F.expr("(_total + 2) div 2")
    joined = ranked.join(totals, list(group))
    first = F.col("_upto") - F.col("_c") + 1
    hits = F.when((first <= low) & (low <= F.col("_upto")), 1).otherwise(0) + F.when(
        (first <= high) & (high <= F.col("_upto")), 1
    ).otherwise(0)
    return (
        joined.withColumn("_hits", hits)
        .filter("_hits > 0")
        .groupBy(*group)
        .agg((F.sum(F.col(value) * F.col("_hits")) / 2).alias("median"))
    )
