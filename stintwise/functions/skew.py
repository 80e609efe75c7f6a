"""Group operations that stay spread out when one group holds a large share of the rows.

A plain window gathers a whole group in one task. These helpers use map-side combined
aggregates, joins that AQE can split, and range-partitioned blocks instead; results are exact.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintwise.session import work_table


def attach(df: DataFrame, keys: list[str], *aggs: Column, few: bool = False) -> DataFrame:
    """Every row with its group's aggregates. Keys must not be null. `few` states that the groups are few,
    such as sessions: then their aggregates go to the rows, which stay where they are."""
    found = df.groupBy(*keys).agg(*aggs)
    return df.join(F.broadcast(found) if few else found, keys)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys meet null keys; the keys come from the left."""
    other = right.select(*[F.col(c).alias(f"_r_{c}" if c in keys else c) for c in right.columns])
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(other, same, how).drop(*[f"_r_{k}" for k in keys])


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each group by ascending, non-null `order`."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), rank).alias("_first"))
        .select(*keys, "_first.*")
    )


def blocks(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Range-partition by (keys, order) and number the partitions as `_block`, so that a big group
    spans several blocks in order. The number of ranges is left to Spark, which merges neighbouring
    small ones at run time. Written out because block numbers must not move when a task is run
    again."""
    ranged = df.repartitionByRange(*keys, *order)
    return work_table(ranged.withColumn("_block", F.spark_partition_id()), "blocks")


def before_block(df: DataFrame, keys: list[str], amount: Column, name: str) -> DataFrame:
    """(keys, _block, name): total of the per-block `amount` over the group's earlier blocks."""
    totals = df.groupBy(*keys, "_block").agg(amount.alias("_amount"))
    earlier = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.select(
        *keys, "_block", F.coalesce(F.sum("_amount").over(earlier), F.lit(0)).alias(name)
    )


def number_blocks(blocked: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """1-based row number within each group of an already blocked frame; keeps `_block`. Null keys are a
    group like any other."""
    offsets = before_block(blocked, keys, F.count("*"), "_offset")
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (
        null_safe_join(blocked, offsets, [*keys, "_block"])
        .withColumn(name, (F.col("_offset") + F.row_number().over(inside)).cast("bigint"))
        .drop("_offset")
    )


def row_numbers(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """`row_number()` over (keys, order) without gathering a group in one task. `order` must be
    unique within a group. Null keys are a group like any other.

    One shuffle: ranges are written in order with a running number, from which that of the group's
    first row in the range is taken off."""
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    block = F.shiftright("_at", 33).alias("_block")
    placed = work_table(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    cells = placed.groupBy(*keys, block).agg(F.min("_at").alias("_first"), F.count("*").alias("_held"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_first") - F.coalesce(F.sum("_held").over(earlier), F.lit(0))
    starts = work_table(cells.select(*keys, "_block", start.alias("_start")), "starts")  # its size is known
    return (
        null_safe_join(placed.select("*", block), starts, [*keys, "_block"])
        .withColumn(name, (F.col("_at") - F.col("_start") + 1).cast("bigint"))
        .drop("_block", "_at", "_start")
    )


GATHERED = 20_000
"""Rows of a group whose values one task may hold; quantiles of larger groups are found by rank."""


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: Column | str,
    probs: dict[str, float],
    count: str | None = None,
    weight: str | None = None,
    gathered: int = GATHERED,
) -> DataFrame:
    """Linear-interpolation quantiles per group, exact for any group size; `weight` repeats a value.
    Null keys are a group like any other; null values count for nothing.

    Groups of up to `gathered` rows are one aggregate with a map-side part. In larger ones the values are
    put in ranges by splitters that Spark samples from them, and only the ranges that hold a wanted rank
    are opened: a group spans as many tasks as it needs, whatever its values are."""
    v = F.col(value) if isinstance(value, str) else value
    times = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    known = df.select(*keys, v.cast("double").alias("_v"), times.alias("_w")).where(F.col("_v").isNotNull())
    sizes = known.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > gathered)
    large = work_table(sizes.select(*keys), "large")
    if large.isEmpty():
        return gathered_quantiles(known, keys, probs, count)
    same = [F.col(k).eqNullSafe(F.col(f"_l_{k}")) for k in keys]
    named = large.select(*[F.col(k).alias(f"_l_{k}") for k in keys])
    few = gathered_quantiles(known.join(named, same, "left_anti"), keys, probs, count)
    return few.unionByName(ranked_quantiles(known.join(named, same, "left_semi"), keys, probs, count))


def spot(p: float) -> Column:
    """The place of a quantile among `_total` values, from 0, between two of them as a rule."""
    return (F.col("_total") - 1) * F.lit(float(p))


def lower_rank(p: float) -> Column:
    return F.floor(spot(p))


def upper_rank(p: float) -> Column:
    return F.least(lower_rank(p) + 1, F.col("_total") - 1)


def picked_quantiles(ranked: DataFrame, keys: list[str], probs: dict[str, float], count: str | None) -> DataFrame:
    """Quantiles from rows (keys, _v, _w, _start, _total), `_start` being the number of values before."""
    end = F.col("_start") + F.col("_w")
    picks = [F.max("_total").alias("_total")]
    for name, p in probs.items():
        for side, rank in (("lo", lower_rank(p)), ("hi", upper_rank(p))):
            holds = (F.col("_start") <= rank) & (rank < end)
            picks.append(F.max(F.when(holds, F.col("_v"))).alias(f"_{name}_{side}"))
    out = [
        (
            F.col(f"_{name}_lo")
            + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * (spot(p) - lower_rank(p))
        ).alias(name)
        for name, p in probs.items()
    ]
    if count:
        out.append(F.col("_total").alias(count))
    return ranked.groupBy(*keys).agg(*picks).select(*keys, *out)


def gathered_quantiles(known: DataFrame, keys: list[str], probs: dict[str, float], count: str | None) -> DataFrame:
    """Quantiles of (keys, _v, _w) where one task may hold a group: one shuffle, by the keys."""
    whole = Window.partitionBy(*keys).orderBy("_v")
    earlier = whole.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = known.withColumn("_start", F.coalesce(F.sum("_w").over(earlier), F.lit(0))).withColumn(
        "_total", F.sum("_w").over(all_rows)
    )
    return picked_quantiles(ranked, keys, probs, count)


def ranked_quantiles(known: DataFrame, keys: list[str], probs: dict[str, float], count: str | None) -> DataFrame:
    """Quantiles of (keys, _v, _w) for groups of any size. Equal values are counted before the shuffle;
    ranges carry the number of values before them."""
    counted = known.groupBy(*keys, "_v").agg(F.sum("_w").alias("_w"))
    ranged = blocks(counted, keys, [F.col("_v")])
    totals = ranged.groupBy(*keys, "_block").agg(F.sum("_w").alias("_held"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    cells = totals.withColumn("_before", F.coalesce(F.sum("_held").over(upto), F.lit(0))).withColumn(
        "_total", F.sum("_held").over(whole)
    )
    wanted = F.lit(False)
    for p in probs.values():
        wanted = wanted | (
            (F.col("_before") <= upper_rank(p)) & (F.col("_before") + F.col("_held") > lower_rank(p))
        )
    inside = Window.partitionBy(*keys, "_block").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    opened = null_safe_join(ranged, cells.where(wanted), [*keys, "_block"])
    ranked = opened.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    return picked_quantiles(ranked, keys, probs, count)


def gap_to_best(rows: DataFrame, keys: list[str], value: str, name: str, few: bool) -> DataFrame:
    """`value` minus its smallest in the group. `few` states that a group has one row per team (a
    window is then the cheaper plan); otherwise the rows are stored and joined to their minimum."""
    if few:
        return rows.withColumn(name, F.col(value) - F.min(value).over(Window.partitionBy(*keys)))
    best = F.min(value).alias("_best")
    return (
        attach(work_table(rows), keys, best)
        .withColumn(name, F.col(value) - F.col("_best"))
        .drop("_best")
    )


def neighbours(
    left: DataFrame, right: DataFrame, keys: list[str], at: str, value: Column, below: str, above: str | None = None
) -> DataFrame:
    """The rows of `left` with the `value` of the row of `right` that lies next at or before their `at` in
    their group, as `below`, and with `above` also of the one next at or after. Both sides have the
    column `at`; of right rows at one place the last by `value` counts.

    Both sides stand in one order, cut into ranges; each range is searched by itself, and the nearest
    right row of the ranges before and behind is carried into it. A group spans many ranges, and a
    stretch without right rows makes no rows."""
    names = left.columns
    place = right.groupBy(*keys, at).agg(F.max(F.struct(value.alias("value"))).alias("_value"))
    none = F.lit(None).cast(place.schema["_value"].dataType)
    rows = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*names).alias("_row"), none.alias("_value"))
    marks = place.select(
        *keys, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_value"
    ).where(F.col("_at").isNotNull())
    ranged = blocks(rows.unionByName(marks), keys, [F.col("_at")])  # rows at one place stay together
    ends = ranged.where("_side = 0").groupBy(*keys, "_block")
    ends = ends.agg(F.max_by("_value", "_at").alias("_last"), F.min_by("_value", "_at").alias("_first"))
    spans = ranged.select(*keys, "_block").distinct()
    group = Window.partitionBy(*keys)
    carried = null_safe_join(spans, ends, [*keys, "_block"], "left").select(
        *keys,
        "_block",
        F.last("_last", ignorenulls=True)
        .over(group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
        .alias("_before"),
        F.last("_first", ignorenulls=True)
        .over(group.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1))
        .alias("_behind"),
    )
    inside = Window.partitionBy(*keys, "_block")
    up = inside.orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = [F.coalesce(F.last("_value", ignorenulls=True).over(up), "_before")["value"].alias(below)]
    if above is not None:
        down = inside.orderBy(F.desc("_at"), "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found.append(F.coalesce(F.last("_value", ignorenulls=True).over(down), "_behind")["value"].alias(above))
    met = null_safe_join(ranged, carried, [*keys, "_block"])
    return met.select("_side", "_row", *found).where("_side = 1").drop("_side").select("_row.*", *[c for c in (below, above) if c])
