"""Frequencies of a free-text field."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftline.fields import CUMULATIVE_MARKS
from driftline.operators.ordering import with_running_sums
from driftline.operators.splits import grand_total

VALUE, COUNT = "unique_samplingProtocol_value", "n_count"


def vocabulary_order() -> list[Column]:
    """Most frequent first, ties by value, null before text."""
    return [F.desc(COUNT), F.asc_nulls_first(VALUE)]


def value_counts(df: DataFrame, value: Column | str = "value") -> DataFrame:
    """Each distinct value, null included, with its number of rows."""
    column = F.col(value) if isinstance(value, str) else value
    return df.groupBy(column.alias(VALUE)).agg(F.count("*").alias(COUNT))


def per_source_stats(df: DataFrame, source: str = "source", value: str = "value") -> DataFrame:
    """Rows, non-null rows and distinct values per source; the ratio is over all rows.

    Counted per (source, value) first: a source with a third of the rows is spread over its values,
    and equal values are added up before the shuffle.
    """
    pairs = df.groupBy(source, value).agg(F.count("*").alias("_n"))
    stats = pairs.groupBy(source).agg(
        F.sum("_n").alias("total_rows_incl_null"),
        F.coalesce(F.sum(F.when(F.col(value).isNotNull(), F.col("_n"))), F.lit(0))
        .alias("total_non_null_values"),
        F.count(value).alias("unique_values_excl_nulls"),
    )
    return stats.withColumn(
        "ratio_unique_to_total_values",
        F.col("unique_values_excl_nulls") / F.col("total_rows_incl_null"),
    )


def top_vocabulary(vocab: DataFrame, n: int = 100) -> DataFrame:
    """The n most frequent values and their share of all rows."""
    return (
        vocab.orderBy(*vocabulary_order()).limit(n)
        .withColumn("proportion_of_all_values_incl_null",
                    F.col(COUNT) / grand_total(vocab, COUNT))
    )


def cumulative_marks(vocab: DataFrame, marks=CUMULATIVE_MARKS) -> DataFrame:
    """Rows covered by the top 1, 50, ... values, with and without the null rows.

    Only the values up to the largest mark are ranked; the rest enters through the totals.
    """
    top = vocab.orderBy(*vocabulary_order()).limit(max(marks))
    ranked = top.withColumn("_rank", F.row_number().over(Window.orderBy(*vocabulary_order())))
    reached = ranked.agg(
        *(F.sum(F.when(F.col("_rank") <= m, F.col(COUNT))).alias(f"_m{m}") for m in marks)
    )
    totals = vocab.agg(F.struct(
        F.sum(COUNT).alias("n_rows"), F.count("*").alias("size"),
        F.coalesce(F.sum(F.when(F.col(VALUE).isNull(), F.col(COUNT))), F.lit(0)).alias("nulls"),
    ))
    whole = reached.withColumn("_t", totals.scalar())
    rows = [F.struct(F.lit(m).cast("long").alias("top_n"), F.col(f"_m{m}").alias("n")) for m in marks]
    rows.append(F.struct(F.col("_t.size").alias("top_n"), F.col("_t.n_rows").alias("n")))
    long = whole.select(F.col("_t.n_rows").alias("_all"), F.col("_t.nulls").alias("_null"),
                        F.inline(F.array(*rows)))
    share, null_share = F.col("n") / F.col("_all"), F.col("_null") / F.col("_all")
    return long.select(
        "top_n",
        F.col("n").alias("cumulative_count"),
        share.alias("cumulative_proportion_of_all_values_incl_null"),
        F.try_divide(share - null_share, F.lit(1.0) - null_share)
        .alias("cumulative_proportion_of_all_values_excl_null"),
    )


def ranked_vocabulary(vocab: DataFrame) -> DataFrame:
    """Vocabulary with 1-based ``rank`` and running count; any number of distinct values."""
    return with_running_sums(
        vocab.withColumn("_one", F.lit(1).cast("long")), vocabulary_order(),
        {"rank": "_one", "running_count": COUNT},
    ).drop("_one")


def cumulative_curve(vocab: DataFrame) -> DataFrame:
    """Rank against the share of non-null rows covered; the word NaN is a null as well."""
    words = vocab.filter(F.col(VALUE).isNotNull() & (F.col(VALUE) != "NaN"))
    return ranked_vocabulary(words).select(
        "rank", VALUE, COUNT,
        (F.col("running_count") / grand_total(words, COUNT)).alias("cumulative_count"),
    )


def combined_top_k(
    df: DataFrame, value: str, groups: list[str], k: int = 8
) -> DataFrame:
    """Share of the k overall most frequent values in each group; 0 where a group lacks one."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n"))
    top = (
        counts.groupBy(value).agg(F.sum("n").alias("combined"))
        .orderBy(F.desc("combined"), F.asc(value)).limit(k)
    )
    sizes = counts.groupBy(*groups).agg(F.sum("n").alias("group_total"))
    # k values times the few groups; every pair of them is a row of the report.
    values = sizes.withColumn("_top", F.explode(
        top.agg(F.collect_list(F.struct(value, "combined"))).scalar()
    )).select(*groups, "group_total", f"_top.{value}", "_top.combined")
    return (
        values.join(counts, [*groups, value], "left")
        .select(*groups, value, "combined",
                F.coalesce("n", F.lit(0)).alias("n"),
                (F.coalesce("n", F.lit(0)) * 100.0 / F.col("group_total")).alias("pct"))
    )
