"""Do two splits share a distribution? Kolmogorov-Smirnov and chi-squared, all pairs at once."""

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftline.fields import CATEGORICAL_FIELDS, NUMERIC_FIELDS, SPLITS
from driftline.functions.pvalues import chi2_tail, exact_ks_tail, kolmogorov_tail
from driftline.operators.ordering import top_per_group
from driftline.staging import staged

MIN_VALUES = 20
MAX_CATEGORIES = 50
KS_P_PASS = 0.05
CRAMERS_V_PASS = 0.1
#: Cells that a part of a feature's range is counted in; rows that are counted value by value at the end;
#: passes after which that is done in any case (twelve bits of a double a pass, so all of them).
CELLS, FEW_ROWS, MAX_PASSES = 4096, 2_000_000, 6


def split_pairs(names=SPLITS) -> list[tuple[str, str]]:
    return list(combinations(names, 2))


def counts_by_split(df: DataFrame, fields: list[str], names=SPLITS) -> DataFrame:
    """(feature, value, one count per split); a value that a split lacks counts 0 there."""
    long = df.unpivot(["split"], [f"`{f}`" for f in fields], "feature", "value")
    return (
        long.filter(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(*(F.count_if(F.col("split") == s).alias(f"n_{s}") for s in names))
    )


def _totals(counts: DataFrame, names) -> DataFrame:
    """Values of each split, and of each pair the values that either has; one row per feature."""
    return counts.groupBy("feature").agg(
        *(F.sum(f"n_{s}").alias(f"total_{s}") for s in names),
        *(F.count_if(F.col(f"n_{a}") + F.col(f"n_{b}") > 0).alias(f"values_{a}_{b}")
          for a, b in split_pairs(names)),
    )


def _every_test(df: DataFrame, fields, names) -> DataFrame:
    """One row per feature and pair, whether or not there is anything to test."""
    rows = [(f, a, b) for f in fields for a, b in split_pairs(names)]
    return df.sparkSession.createDataFrame(rows, "feature string, split_a string, split_b string")


def _gap(a: str, b: str, end_a: str, end_b: str) -> Column:
    """Distance of two step functions, from running counts of both."""
    return F.abs(F.try_divide(F.col(f"{end_a}_{a}"), F.col(f"total_{a}")) - F.try_divide(F.col(f"{end_b}_{b}"), F.col(f"total_{b}")))


def _cell(value: Column) -> Column:
    """Number of the equal part of [lo, hi] that a value lies in, from 1 on; infinities have cells of their own.

    The number never falls as the value grows. Halves are taken where the largest doubles' difference is infinite.
    """
    lo, hi, inf = F.col("lo"), F.col("hi"), float("inf")
    share = F.when(hi - lo < inf, F.try_divide(value - lo, hi - lo)).otherwise(F.try_divide(value / 2 - lo / 2, hi / 2 - lo / 2))
    inside = F.when(hi > lo, F.least(F.floor(share * CELLS), F.lit(CELLS - 1)) + 1).otherwise(1)
    return F.when(value == -inf, 0).when(value == inf, CELLS + 1).otherwise(inside).cast("int")


def _largest_gaps(long: DataFrame, names) -> DataFrame:
    """(feature, total per split, largest gap per pair) of rows (split, feature, value), by branch and bound.

    The values of a part of a feature's range are counted per split and cell. The gap at a cell's end is
    exact; inside, it is at most what the counts allow. Only cells that may hold a larger gap than the best
    one known are opened, and become the parts of the next pass, until none is left or those that are left
    hold few rows, whose values are then counted apart. Counters are shuffled, and few values.
    """
    pairs = split_pairs(names)
    finite = F.when(F.abs("value") < float("inf"), F.col("value"))
    totals = staged(long.groupBy("feature").agg(
        F.min(finite).alias("lo"), F.max(finite).alias("hi"),
        *(F.count_if(F.col("split") == s).alias(f"total_{s}") for s in names),
    ), "ks-totals")
    parts = totals.select(
        "feature", F.lit(0).cast("long").alias("part"), "lo", "hi", *(F.lit(0).cast("long").alias(f"from_{s}") for s in names),
    )
    rows = long.withColumn("part", F.lit(0).cast("long"))
    best = None
    left = totals.agg(F.sum(sum(F.col(f"total_{s}") for s in names))).first()[0] or 0
    for _ in range(MAX_PASSES):
        if left <= FEW_ROWS:
            break
        rows = rows.join(parts.select("feature", "part", "lo", "hi"), ["feature", "part"]).select(
            "split", "feature", "value", "part", _cell(F.col("value")).alias("cell")
        )
        counted = rows.groupBy("feature", "part", "cell").agg(
            F.min("value").alias("lo"), F.max("value").alias("hi"),
            *(F.count_if(F.col("split") == s).alias(f"n_{s}") for s in names),
        )
        # a part has at most CELLS cells
        up = Window.partitionBy("feature", "part").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cells = staged(
            counted.join(parts.drop("lo", "hi"), ["feature", "part"])
            .withColumns({f"end_{s}": F.col(f"from_{s}") + F.sum(f"n_{s}").over(up) for s in names})
            .withColumns({f"begin_{s}": F.col(f"end_{s}") - F.col(f"n_{s}") for s in names})
            .join(F.broadcast(totals.drop("lo", "hi")), "feature"),  # one row per feature
            "ks-cells",
        )
        at_ends = cells.groupBy("feature").agg(*(F.max(_gap(a, b, "end", "end")).alias(f"d_{a}_{b}") for a, b in pairs))
        best = at_ends if best is None else best.unionByName(at_ends)
        best = staged(best.groupBy("feature").agg(*(F.max(f"d_{a}_{b}").alias(f"d_{a}_{b}") for a, b in pairs)), "ks-best")
        larger = reduce(lambda x, y: x | y, (
            F.greatest(_gap(a, b, "end", "begin"), _gap(a, b, "begin", "end")) > F.col(f"d_{a}_{b}") for a, b in pairs
        ))
        opened = staged(
            cells.where("hi > lo").join(F.broadcast(best), "feature").where(larger)
            .withColumn("part_", F.row_number().over(Window.partitionBy("feature").orderBy("part", "cell")).cast("long")),
            "ks-opened",
        )
        left = opened.agg(F.sum(sum(F.col(f"n_{s}") for s in names))).first()[0] or 0
        rows = rows.join(opened.select("feature", "part", "cell", "part_"), ["feature", "part", "cell"]).select(
            "split", "feature", "value", F.col("part_").alias("part")
        )
        parts = opened.select(
            "feature", F.col("part_").alias("part"), "lo", "hi", *(F.col(f"begin_{s}").alias(f"from_{s}") for s in names)
        )
    if left or best is None:
        values = rows.groupBy("feature", "part", "value").agg(*(F.count_if(F.col("split") == s).alias(f"n_{s}") for s in names))
        up = Window.partitionBy("feature", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        steps = values.join(parts, ["feature", "part"]).withColumns(
            {f"end_{s}": F.col(f"from_{s}") + F.sum(f"n_{s}").over(up) for s in names}
        ).join(F.broadcast(totals.drop("lo", "hi")), "feature")
        at_steps = steps.groupBy("feature").agg(*(F.max(_gap(a, b, "end", "end")).alias(f"d_{a}_{b}") for a, b in pairs))
        best = at_steps if best is None else best.unionByName(at_steps).groupBy("feature").agg(*(F.max(f"d_{a}_{b}").alias(f"d_{a}_{b}") for a, b in pairs))
    return totals.drop("lo", "hi").join(best, "feature")


def ks_matrix(
    df: DataFrame, fields: list[str] = NUMERIC_FIELDS, names=SPLITS, min_values: int = MIN_VALUES,
) -> DataFrame:
    """Two-sample KS per feature and pair: the largest gap between two step functions.

    Gaps are found by ``_largest_gaps``, for all features and pairs at once and on any number of rows. The
    p-value comes from the series for all sizes; ``with_exact_ks_pvalue`` replaces it. A pair with
    fewer than ``min_values`` values on a side has status ``skipped`` and no result.
    """
    # read in every pass
    return _ks_tests(staged(_numbers(df, fields), "ks-numbers"), fields, names, min_values)


def _numbers(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.select("split", *(F.col(f"`{f}`").cast("double").alias(f) for f in fields))


def _ks_tests(numbers: DataFrame, fields: list[str], names, min_values: int) -> DataFrame:
    """``ks_matrix`` of rows that are cheap to read again."""
    long = numbers.unpivot(["split"], [f"`{f}`" for f in fields], "feature", "value")
    wide = _largest_gaps(long.where(F.col("split").isin(list(names)) & ~F.isnan("value") & F.col("value").isNotNull()), names)
    pairs = split_pairs(names)
    rows = F.array(*(
        F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b"),
                 F.col(f"total_{a}").alias("n_a"), F.col(f"total_{b}").alias("n_b"),
                 F.col(f"d_{a}_{b}").alias("statistic"))
        for a, b in pairs
    ))
    found = wide.select("feature", F.inline(rows))
    tests = _every_test(numbers, fields, names).join(found, ["feature", "split_a", "split_b"], "left")
    tests = tests.fillna(0, ["n_a", "n_b"])
    enough = (F.col("n_a") >= min_values) & (F.col("n_b") >= min_values)
    return (
        tests.withColumn("statistic", F.when(enough, F.col("statistic")))
        .withColumn("p_value", kolmogorov_tail(F.col("statistic"), F.col("n_a"), F.col("n_b")))
        .withColumn("passed", F.col("p_value") > KS_P_PASS)
        .withColumn("status", F.when(enough, "tested").otherwise("skipped"))
    )


def with_exact_ks_pvalue(tests: DataFrame) -> DataFrame:
    """KS tests with the exact p-value in place of the series; its time grows with n_a times n_b."""
    return tests.withColumn("p_value", exact_ks_tail("statistic", "n_a", "n_b")).withColumn(
        "passed", F.col("p_value") > KS_P_PASS
    )


def chi2_matrix(
    df: DataFrame, fields: list[str] = CATEGORICAL_FIELDS, names=SPLITS,
    min_values: int = MIN_VALUES, max_categories: int | None = MAX_CATEGORIES,
) -> DataFrame:
    """Chi-squared and Cramer's V per feature and pair, over the most frequent categories.

    ``max_categories=None`` takes all. ``n_all_categories`` and ``covered`` tell how many there are and
    which share of the rows the tested ones hold. With two categories the counts are moved half a step
    towards the expectation (Yates). Fewer than ``min_values`` values on a side or fewer than two
    categories give a row with status ``skipped`` and nulls.
    """
    text = df.select("split", *(F.col(f"`{f}`").cast("string").alias(f) for f in fields))
    # Read twice, for the totals and for the cells.
    counts = staged(counts_by_split(text, fields, names), "category-counts")
    pairs = F.array(*(
        F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b"),
                 F.col(f"n_{a}").alias("o_a"), F.col(f"n_{b}").alias("o_b"),
                 F.col(f"total_{a}").alias("t_a"), F.col(f"total_{b}").alias("t_b"),
                 F.col(f"values_{a}_{b}").alias("n_all_categories"))
        for a, b in split_pairs(names)
    ))
    key = ["feature", "split_a", "split_b"]
    cells = (
        # One row per feature.
        counts.join(F.broadcast(_totals(counts, names)), "feature")
        .select("feature", "value", F.inline(pairs))
        .filter((F.col("t_a") >= min_values) & (F.col("t_b") >= min_values))
        .withColumn("both", F.col("o_a") + F.col("o_b"))
        .filter(F.col("both") > 0)
    )
    if max_categories is not None:
        cells = staged(
            top_per_group(cells, key, [F.desc("both"), F.asc("value")], max_categories), "top-categories"
        )
    # One row per test.
    sizes = cells.groupBy(*key).agg(
        F.count("*").alias("n_categories"), F.sum("o_a").alias("n_a"), F.sum("o_b").alias("n_b")
    )
    table = cells.join(F.broadcast(sizes), key)

    def term(observed, row_total):
        expected = F.try_divide(
            F.col(row_total).cast("double") * F.col("both"), F.col("n_a") + F.col("n_b")
        )
        distance = F.abs(F.col(observed) - expected)
        moved = F.when(
            F.col("n_categories") == 2, distance - F.least(F.lit(0.5), distance)
        ).otherwise(distance)
        return F.try_divide(moved * moved, expected)

    covered = (F.col("n_a") + F.col("n_b")) / (F.col("t_a") + F.col("t_b"))
    found = (
        table.groupBy(*key, "n_categories", "n_a", "n_b", "n_all_categories", covered.alias("covered"))
        .agg(F.sum(term("o_a", "n_a") + term("o_b", "n_b")).alias("statistic"))
        .filter(F.col("n_categories") >= 2)
    )
    return (
        _every_test(df, fields, names).join(found, key, "left")
        .withColumn("dof", (F.col("n_categories") - 1).cast("int"))
        .withColumn("cramers_v", F.sqrt(F.col("statistic") / (F.col("n_a") + F.col("n_b"))))
        .withColumn("passed", F.col("cramers_v") < CRAMERS_V_PASS)
        .withColumn("status", F.when(F.col("n_categories").isNull(), "skipped").otherwise("tested"))
    )


def with_chi2_pvalue(tests: DataFrame) -> DataFrame:
    """p-value of each test; the frame has one row per test."""
    return tests.withColumn("p_value", chi2_tail("statistic", "dof"))


def equivalence_matrix(
    df: DataFrame, numeric=NUMERIC_FIELDS, categorical=CATEGORICAL_FIELDS, names=SPLITS,
    min_values: int = MIN_VALUES, max_categories: int | None = MAX_CATEGORIES,
) -> DataFrame:
    """One row per feature and pair of splits, both kinds of test, of a sample or a whole table.

    The wanted columns are written once, so that what leads to ``df`` is run once for both kinds.
    """
    columns = ["test", "feature", "split_a", "split_b", "statistic", "p_value", "effect", "passed", "status"]
    fields = list(dict.fromkeys([*numeric, *categorical]))
    rows = staged(df.select("split", *(F.col(f"`{f}`") for f in fields)), "test-rows")
    ks = _ks_tests(_numbers(rows, numeric), numeric, names, min_values).select(
        F.lit("KS").alias("test"), "*", F.col("statistic").alias("effect")
    )
    chi2 = with_chi2_pvalue(chi2_matrix(rows, categorical, names, min_values, max_categories)).select(
        F.lit("Chi2").alias("test"), "*", F.col("cramers_v").alias("effect")
    )
    return ks.select(*columns).unionByName(chi2.select(*columns))


def equivalence_summary(matrix: DataFrame) -> DataFrame:
    """Tests passed, by kind and overall; all passed means the splits are interchangeable.

    Skipped tests are counted apart.
    """
    rows = matrix.select(
        F.explode(F.array("test", F.lit("Overall"))).alias("test"), "passed"
    )
    return rows.groupBy("test").agg(
        F.count_if("passed").alias("n_passed"), F.count("passed").alias("n_tests"),
        F.count_if(F.col("passed").isNull()).alias("n_skipped"),
    ).withColumn("equivalent", F.col("n_passed") == F.col("n_tests"))
