"""Ordered access to rows and fixed-size batches for model training."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from driftline.fields import CORE_FIELDS
from driftline.operators.ordering import with_row_index

BATCH_ROWS = 32


def indexed_samples(df: DataFrame, key: str = "_id", fields=CORE_FIELDS) -> DataFrame:
    """The fields of ``interpreted`` with the row's 0-based place in the order of ``key``."""
    flat = df.select(key, *(F.col(f"interpreted.`{f}`").alias(f) for f in fields))
    return with_row_index(flat, [F.col(key)])


def unnested(df: DataFrame, key: str = "_id", struct: str = "interpreted") -> DataFrame:
    """The key and every field of the struct as a column."""
    return df.select(key, f"{struct}.*")


def row_at(indexed: DataFrame, idx: int) -> DataFrame:
    """The row with this index; fails for an index outside the table.

    On a table written in index order the filter skips all row groups but one.
    """
    if idx < 0:
        raise IndexError("index out of range")
    found = indexed.filter(F.col("idx") == idx)
    # An empty result is an error, raised where the row would have been read.
    checked = found.agg(F.count("*").alias("_n"), F.first(F.struct(*indexed.columns)).alias("_row"))
    return checked.select(
        F.when(F.col("_n") == 1, F.col("_row"))
        .otherwise(F.raise_error(F.lit("index out of range")).cast(found_type(indexed)))
        .alias("_row")
    ).select("_row.*")


def found_type(df: DataFrame):
    return df.select(F.struct(*df.columns).alias("_row")).schema["_row"].dataType


def minibatches(indexed: DataFrame, size: int = BATCH_ROWS, fields=CORE_FIELDS) -> DataFrame:
    """One row per batch: an array per field, in index order, nulls kept; the last may be short.

    Rows travel as structs, since ``collect_list`` would skip null scalars. A group has ``size`` rows.
    """
    rows = F.sort_array(F.collect_list(F.struct("idx", *(F.col(f"`{f}`") for f in fields))))
    grouped = (
        indexed.groupBy(F.floor(F.col("idx") / size).alias("batch_id"))
        .agg(rows.alias("_rows"))
    )
    return grouped.select(
        "batch_id", F.size("_rows").alias("n_rows"),
        *(F.col("_rows").getField(f).alias(f) for f in fields),
    )


def collate(
    batches: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Apply a user's batch function to frames of whole batches, Arrow batch by Arrow batch."""
    def run(frames):
        for frame in frames:
            yield fn(frame)

    return batches.mapInPandas(run, schema)


def inspect_first(df: DataFrame, key: str = "_id", struct: str = "interpreted") -> DataFrame:
    """The first record's struct as indented JSON, nulls shown."""
    first = df.select(key, struct).orderBy(key).limit(1)
    return first.select(
        key, F.to_json(F.col(struct), {"pretty": "true", "ignoreNullFields": "false"}).alias("json")
    )
