"""Global ranks, row indexes and running sums without a single-task window.

``Window.orderBy`` without a partition runs in one task. Here the rows are range-partitioned,
each partition notes the position of its rows, and only one total per partition is summed up.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftline.staging import staged

_PART, _POS = "_range_part", "_range_pos"


def _in_global_order(df: DataFrame, keys: list[Column], label: str) -> DataFrame:
    """Rows in order, staged, with the number of their partition and their place in it.

    ``monotonically_increasing_id`` is the partition number in the upper bits and the place in the
    lower 33. It also breaks ties before the exchange, so that copies of one key can be cut apart.
    For that its values must survive a repeated task: where keys repeat, ``df`` should be a scan or
    a staged table, whose rows come in the same order again.
    """
    tie = "_range_tie"
    tied = df.withColumn(tie, F.monotonically_increasing_id())
    order = [*keys, F.col(tie)]
    ordered = tied.repartitionByRange(*order).sortWithinPartitions(*order).drop(tie)
    place = F.monotonically_increasing_id()
    return staged(
        ordered.withColumn(_PART, F.shiftright(place, 33))
        .withColumn(_POS, place.bitwiseAND(F.lit((1 << 33) - 1))),
        label,
    )


def with_row_index(df: DataFrame, keys: list[Column], name: str = "idx") -> DataFrame:
    """0-based position of every row in the order of ``keys``."""
    rows = _in_global_order(df, keys, "row-index")
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(_PART).agg(F.count("*").alias("_n"))
        # One row per range partition, so at most spark.sql.shuffle.partitions rows.
        .select(_PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        rows.join(F.broadcast(offsets), _PART)
        .withColumn(name, F.col("_before") + F.col(_POS))
        .drop(_PART, _POS, "_before")
    )


def with_running_sums(
    df: DataFrame, keys: list[Column], sums: dict[str, str], group: tuple[str, ...] = ()
) -> DataFrame:
    """Running sums ``{new column: summed column}`` in the order of ``keys``, per ``group``.

    ``group`` is meant for a handful of values (features, splits); a group may be any size, as it
    is spread over as many range partitions as it needs.
    """
    rows = _in_global_order(df, [*(F.col(g) for g in group), *keys], "running-sums")
    cells = rows.groupBy(_PART, *group).agg(
        *(F.sum(source).alias(f"_t_{name}") for name, source in sums.items())
    )
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    if group:
        before = before.partitionBy(*group)
    # At most one row per range partition plus one per group.
    offsets = cells.select(
        _PART, *group,
        *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums),
    )
    inside = (
        Window.partitionBy(_PART, *group).orderBy(_POS)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = rows.select("*", *(F.sum(s).over(inside).alias(f"_l_{n}") for n, s in sums.items()))
    joined = local.join(F.broadcast(offsets), [_PART, *group])
    return joined.select(
        *df.columns, *((F.col(f"_b_{n}") + F.col(f"_l_{n}")).alias(n) for n in sums)
    )


def top_per_group(
    df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each group; each task keeps at most k of a group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
