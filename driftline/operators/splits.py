"""Train / dev / test assignment by hash, and checks on the result."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from driftline.fields import CORE_FIELDS, SPLITS
from driftline.functions.hashing import dataset_bucket, record_bucket, split_of_bucket
from driftline.functions.numbers import percent


def complete_records(df: DataFrame, fields=CORE_FIELDS, struct: str = "interpreted") -> DataFrame:
    """Rows where every field is non-null; empty text and NaN count as present."""
    return df.filter(
        reduce(lambda a, b: a & b, [F.col(f"{struct}.`{f}`").isNotNull() for f in fields])
    )


def _assign(df: DataFrame, key: Column, bucket: Column) -> DataFrame:
    """Bucket and label of a key; both are null for a null key.

    A label is never null otherwise. Saying so with ``coalesce`` lets the optimizer turn a null test
    on the split, which every join on it brings about, into one on the key, without any hashing.
    """
    label = F.coalesce(split_of_bucket(F.col("bucket")), F.lit(SPLITS[-1]))
    return df.withColumn("bucket", bucket).withColumn("split", F.when(key.isNotNull(), label))


def assign_by_dataset(df: DataFrame, dataset_id: str = "dataset_id") -> DataFrame:
    """All rows of a survey go to the split of its id."""
    return _assign(df, F.col(dataset_id), dataset_bucket(F.col(dataset_id)))


def assign_by_record(df: DataFrame, record_id: str = "_id") -> DataFrame:
    """Each row goes to the split of its own id; rows without an id get a null split."""
    return _assign(df, F.col(record_id), record_bucket(F.col(record_id)))


def split_occurrences(df: DataFrame, by_record: bool = False, keep_missing: bool = False) -> DataFrame:
    """The whole split step: null filter, then assignment. A narrow plan, no shuffle."""
    kept = df if keep_missing else complete_records(df)
    return assign_by_record(kept) if by_record else assign_by_dataset(kept)


def without_split(df: DataFrame) -> DataFrame:
    """Rows that could not be assigned, because their id is null."""
    return df.filter(F.col("split").isNull())


def split_order(split: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SPLITS)), split).cast("int")


def grand_total(df: DataFrame, column: str) -> Column:
    """Sum of a column over the whole frame, as a scalar subquery."""
    return df.agg(F.coalesce(F.sum(column), F.lit(0))).scalar()


def split_sizes(df: DataFrame, dataset_id: str = "dataset_id") -> DataFrame:
    """Surveys and rows per split, and the share of all rows.

    Counted per (split, survey) first, so a survey with a third of the rows is added up in the
    tasks that read it.
    """
    return _sizes(df.groupBy("split", dataset_id).agg(F.count("*").alias("_n")), dataset_id)


def survey_split_sizes(df: DataFrame, dataset_id: str = "dataset_id") -> DataFrame:
    """``split_sizes`` of a survey-level split, from rows not yet assigned.

    The rows of a survey share one bucket, so it is computed once per survey, after counting.
    """
    surveys = df.groupBy(dataset_id).agg(F.count("*").alias("_n"))
    return _sizes(assign_by_dataset(surveys, dataset_id), dataset_id)


def _sizes(surveys: DataFrame, dataset_id: str) -> DataFrame:
    sizes = surveys.groupBy("split").agg(
        F.count(dataset_id).alias("datasets"), F.sum("_n").alias("n_rows")
    )
    return sizes.select(
        "split", "datasets", "n_rows",
        percent(F.col("n_rows"), grand_total(sizes, "n_rows")).alias("pct"),
    )


def leaking_datasets(df: DataFrame, dataset_id: str = "dataset_id", split: str = "split") -> DataFrame:
    """Surveys with rows in more than one split. One bit per split, or-ed up: one shuffle."""
    return leakage_audit(df, {split: split}, dataset_id).drop("level")


def leakage_audit(df: DataFrame, levels: dict[str, str], dataset_id: str = "dataset_id") -> DataFrame:
    """Rows (level, survey, n_splits, n_rows): surveys that a split column spreads, for several at once.

    ``levels`` names the split columns by level. All are audited in one pass and one shuffle.
    """
    def bit(split):
        return F.coalesce(*(F.when(F.col(split) == name, 1 << i) for i, name in enumerate(SPLITS)))

    seen = df.groupBy(dataset_id).agg(*(
        F.struct(F.lit(level).alias("level"), F.bit_or(bit(split)).alias("seen"), F.count(split).alias("n_rows")).alias(f"_{i}")
        for i, (level, split) in enumerate(levels.items())
    ))
    rows = seen.select(dataset_id, F.explode(F.array(*(f"_{i}" for i in range(len(levels))))).alias("a"))
    return rows.select(
        "a.level", dataset_id, F.bit_count("a.seen").cast("int").alias("n_splits"), "a.n_rows"
    ).filter(F.col("n_splits") > 1)
