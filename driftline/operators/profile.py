"""Counts, coverage and summaries of fields."""

from pyspark.sql import Column, DataFrame, functions as F

from driftline.fields import CATEGORICAL_FIELDS, NUMERIC_FIELDS, TERM_CATEGORIES, TERMS
from driftline.functions.numbers import percent
from driftline.functions.text import has_text
from driftline.operators.ordering import top_per_group, with_running_sums
from driftline.staging import staged

# Counters per aggregate: generated code for more of them no longer compiles into one method.
COUNTERS_PER_JOB = 47
#: The sketch's ranks are off by one in so many at most.
SKETCH_ACCURACY = 10_000


def valid_count(df: DataFrame, field: str = "interpreted.samplingProtocol") -> DataFrame:
    """All rows and rows with a non-null field, in one pass; empty text counts as valid."""
    return df.agg(F.count("*").alias("total_samples"), F.count(F.col(field)).alias("valid_samples"))


# ---- coverage of the Darwin Core terms -------------------------------------

def _category_table(df: DataFrame) -> DataFrame:
    rows = [(term, category) for category, terms in TERM_CATEGORIES.items() for term in terms]
    return df.sparkSession.createDataFrame(rows, "field string, category string")


def term_coverage(df: DataFrame, struct: str = "source", terms=TERMS) -> DataFrame:
    """Rows with text in each term of ``struct``, with the term's category.

    Each chunk of counters reads only its own columns. Terms the struct does not have count 0.
    """
    present = {f.name for f in df.schema[struct].dataType.fields}
    available = [t for t in terms if t in present]
    absent = [F.lit(0).cast("long").alias(t) for t in terms if t not in present]
    chunks = [
        available[i:i + COUNTERS_PER_JOB] for i in range(0, len(available), COUNTERS_PER_JOB)
    ] or [[]]
    counts = None
    for chunk in chunks:
        wide = df.agg(
            F.count("*").alias("total_records"),
            *(F.count_if(has_text(F.col(f"{struct}.`{t}`"))).alias(t) for t in chunk),
        ).select("*", *absent)
        names = [f"`{c}`" for c in wide.columns if c != "total_records"]
        long = wide.unpivot(["total_records"], names, "field", "records_with_data")
        counts = long if counts is None else counts.unionByName(long)
        absent = []
    # The category table is the fixed list of 188 terms.
    return counts.join(F.broadcast(_category_table(df)), "field").select(
        "category", "field", "records_with_data", "total_records",
        F.round(percent(F.col("records_with_data"), F.col("total_records")), 4)
        .alias("coverage_pct"),
    )


def category_coverage(coverage: DataFrame) -> DataFrame:
    """Average coverage of a category: filled cells over rows times terms."""
    per_category = coverage.groupBy("category").agg(
        F.count("field").alias("n_fields"),
        F.sum("records_with_data").alias("cells_with_data"),
        F.max("total_records").alias("total_records"),
    )
    return per_category.withColumn(
        "avg_coverage_pct",
        percent(F.col("cells_with_data"), F.col("total_records") * F.col("n_fields")),
    )


# ---- per split and field ----------------------------------------------------

def null_profile(df: DataFrame, fields: list[str], by: str = "split") -> DataFrame:
    """Null count and percentage per split and field, in one aggregation without row copies."""
    wide = df.groupBy(by).agg(
        F.count("*").alias("n_rows"),
        *(F.count_if(F.col(f"`{f}`").isNull()).alias(f) for f in fields),
    )
    long = wide.unpivot([by, "n_rows"], [f"`{f}`" for f in fields], "field", "n_null")
    return long.withColumn("null_pct", percent(F.col("n_null"), F.col("n_rows")))


def _number(field: str) -> Column:
    value = F.col(f"`{field}`").cast("double")
    return F.when(~F.isnan(value), value)


_STATS = ["n_valid", "n_nan", "mean", "std", "min", "max"]


def _field_stats(field: str, sketch: bool):
    """A struct of the field's statistics; with ``sketch`` also two values that enclose the median."""
    x = _number(field)
    parts = [
        F.count(x).alias("n_valid"),
        F.count_if(F.isnan(F.col(f"`{field}`").cast("double"))).alias("n_nan"),
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"),
    ]
    if sketch:
        around = F.array(F.lit(0.5 - 2 / SKETCH_ACCURACY), F.lit(0.5 + 2 / SKETCH_ACCURACY))
        parts.append(F.percentile_approx(x, around, SKETCH_ACCURACY).alias("at"))
    return F.struct(*parts).alias(field)


def numeric_summary(
    df: DataFrame, fields: list[str] = NUMERIC_FIELDS, by: str = "split", sketch: bool = False
) -> DataFrame:
    """Count, mean, population standard deviation, minimum and maximum per split and field.

    NaN is counted apart. ``numeric_profile`` adds the medians.
    """
    # One struct per field and split, then one row per field.
    wide = df.groupBy(by).agg(*(_field_stats(f, sketch) for f in fields))
    names = _STATS + (["at"] if sketch else [])
    rows = F.array(*(
        F.struct(F.lit(f).alias("field"), *(F.col(f"`{f}`.{n}").alias(n) for n in names))
        for f in fields
    ))
    return wide.select(by, F.inline(rows))


def numeric_profile(
    df: DataFrame, fields: list[str] = NUMERIC_FIELDS, by: str = "split"
) -> DataFrame:
    """``numeric_summary`` with exact medians of any number of rows, in two passes.

    The first pass also sketches quantiles just below and above the middle, within a rank error that the
    sketch guarantees. The second counts what lies below this bracket as one number and the values inside
    it apart, so only about 1 row in 1,500 is more than a counter in the shuffle.
    """
    # One row per split and field.
    summary = staged(numeric_summary(df, fields, by, sketch=True), "numeric-summary")
    brackets = summary.where("n_valid > 0").select(by, "field", "at", "n_valid")

    numbers = df.select(by, *(_number(f).alias(f) for f in fields))
    long = numbers.unpivot([by], [f"`{f}`" for f in fields], "field", "value").where("value is not null")
    near = long.join(F.broadcast(brackets.drop("n_valid")), [by, "field"]).where(F.col("value") <= F.col("at")[1])
    inside = F.when(F.col("value") >= F.col("at")[0], F.col("value")).otherwise(float("-inf"))
    counts = near.groupBy(by, "field", inside.alias("value")).agg(F.count("*").alias("n"))
    cumulated = with_running_sums(counts, [F.col("value")], {"cum": "n"}, (by, "field"))
    ranked = cumulated.join(F.broadcast(brackets.drop("at")), [by, "field"])

    def at(rank):
        covers = (F.col("cum") - F.col("n") < rank) & (F.col("cum") >= rank)
        return F.max(F.when(covers, F.col("value")))

    low = F.floor((F.col("n_valid") + 1) / 2)
    high = F.ceil((F.col("n_valid") + 1) / 2)
    medians = ranked.groupBy(by, "field").agg(((at(low) + at(high)) / 2).alias("median"))
    return summary.drop("at").join(medians, [by, "field"], "left")


def exact_medians(
    df: DataFrame, fields: list[str] = NUMERIC_FIELDS, by: str = "split"
) -> DataFrame:
    return numeric_profile(df, fields, by).where("n_valid > 0").select(by, "field", "median")


def value_counts_long(df: DataFrame, fields: list[str], by: str = "split") -> DataFrame:
    """(split, field, value, n) of all values, null among them, all fields in one aggregation."""
    long = df.unpivot([by], [f"`{f}`" for f in fields], "field", "value")
    return long.groupBy(by, "field", "value").agg(F.count("*").alias("n"))


def categorical_profile(
    df: DataFrame, fields: list[str] = CATEGORICAL_FIELDS, by: str = "split", k: int = 3
) -> DataFrame:
    """Distinct values and the k most frequent ones, as ``name (12.3%)``, per split and field.

    A field that is null in all rows of a split has no values and an empty list.
    """
    # Read twice, for the totals and for the best values.
    counts = staged(value_counts_long(df, fields, by), "value-counts")
    totals = counts.groupBy(by, "field").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("n_valid"),
        F.count("value").alias("n_unique"),
    )
    top = top_per_group(counts.filter(F.col("value").isNotNull()), [by, "field"], [F.desc("n"), F.asc("value")], k)
    label = F.format_string(
        "%s (%.1f%%)", F.col("value"), percent(F.col("n"), F.col("n_valid"))
    )
    best = F.sort_array(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", label.alias("label")))))
    return (
        totals.join(top, [by, "field"], "left")
        .groupBy(by, "field", "n_valid", "n_unique")
        .agg(F.array_join(F.transform(best, lambda s: s["label"]), ", ").alias("top_values"))
    )
