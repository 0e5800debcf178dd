import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import functions as F

from driftline.fields import CORE_FIELDS, CUMULATIVE_MARKS
from driftline.functions.hashing import order_hash
from driftline.operators import (
    batches, equivalence, geography, ordering, pages, profile, sampling, splits, vocabulary,
)


# ---- order -------------------------------------------------------------------

def test_row_index_with_hot_key(spark):
    """Two thirds of the rows share one key and still get distinct places."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(
        F.format_string("k%05d", "id")).alias("k"), "id")
    rows = ordering.with_row_index(df.repartition(5), [F.col("k")]).collect()
    assert sorted(r["idx"] for r in rows) == list(range(3000))
    by_index = [r["k"] for r in sorted(rows, key=lambda r: r["idx"])]
    assert by_index == sorted(by_index)


def test_running_sums(spark):
    rng = random.Random(3)
    data = [(g, v, rng.randint(1, 9)) for g in "ab" for v in range(500)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g string, v int, n int")
    rows = ordering.with_running_sums(df, [F.col("v")], {"cum": "n"}, ("g",)).collect()
    for g in "ab":
        own = sorted((r for r in rows if r["g"] == g), key=lambda r: r["v"])
        assert [r["cum"] for r in own] == list(np.cumsum([r["n"] for r in own]))


# ---- splits -------------------------------------------------------------------

def _records(spark, n=4000):
    fields = [F.lit("x").alias(f) for f in CORE_FIELDS if f != "species"]
    species = F.when(F.col("id") % 7 > 0, F.concat(F.lit("s"), F.col("id") % 5)).alias("species")
    return spark.range(n).select(
        F.concat(F.lit("r"), "id").alias("_id"),
        F.concat(F.lit("d"), F.col("id") % 40).alias("dataset_id"),
        F.struct(*fields, species).alias("interpreted"),
    )


def test_split_union_is_filtered_input(spark):
    df = _records(spark)
    for by_record in (False, True):
        out = splits.split_occurrences(df, by_record)
        assert out.filter("split is null").count() == 0
        assert out.select("_id").distinct().count() == out.count() == df.filter("_id is not null") \
            .filter("interpreted.species is not null").count()
    assert splits.split_occurrences(df, keep_missing=True).count() == 4000


def test_survey_level_has_no_leak(spark):
    df = _records(spark)
    assert splits.leaking_datasets(splits.split_occurrences(df)).count() == 0
    assert splits.leaking_datasets(splits.split_occurrences(df, by_record=True)).count() > 30


def test_split_sizes_both_ways(spark):
    df = _records(spark)
    a = splits.split_sizes(splits.assign_by_dataset(df)).orderBy("split").collect()
    b = splits.survey_split_sizes(df).orderBy("split").collect()
    assert a == b and sum(r["n_rows"] for r in a) == 4000


def test_null_id_is_set_aside(spark):
    df = spark.createDataFrame([("a",), (None,)], "_id string")
    marked = splits.assign_by_record(df)
    assert splits.without_split(marked).count() == 1


# ---- samples ------------------------------------------------------------------

def test_sample_is_exact_and_stable(spark):
    df = splits.assign_by_record(_records(spark)).select("_id", "split")
    n = 300
    first = {r["_id"] for r in sampling.sample_per_split(df, n).collect()}
    again = {r["_id"] for r in sampling.sample_per_split(df.repartition(7), n).collect()}
    assert first == again
    sizes = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    got = sampling.sample_per_split(df, n).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {s: min(n, c) for s, c in sizes.items()}
    hashed = df.withColumn("h", order_hash(42, F.col("_id"))).collect()
    for split in sizes:
        own = sorted((r["h"], r["_id"]) for r in hashed if r["split"] == split)[:n]
        assert {i for _, i in own} <= first


def test_sample_of_copies(spark):
    """A third of the rows are copies of one id: the sample still has exactly n rows."""
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "copy").otherwise(F.col("id").cast("string")).alias("_id"),
        F.when(F.col("id") % 2 == 0, "train").alias("split"),
    ).repartition(6)
    for n in (1, 10, 1000, 100000):
        got = sampling.sample_per_split(df, n)
        assert got.count() == min(n, 4500)
        assert got.filter("split is null").count() == 0


def test_sample_hashes_once(spark):
    """Only a split that copies leave short is widened; the rows are those first in the order of the hash."""
    bound = int(sampling._bound(1000, 10**6, sampling._SPARE), 16) / 2**64
    assert 0.001 < bound < 0.0013 and sampling._bound(10, 10, 6) == "g" and sampling._bound(999, 1000, 6) == "g"
    df = spark.range(60_000).select(F.col("id").cast("string").alias("_id"), F.lit("train").alias("split"))
    got = {r["_id"] for r in sampling.sample_per_split(df, 500).collect()}
    first = df.orderBy(order_hash(42, F.col("_id"))).limit(500).collect()
    assert got == {r["_id"] for r in first}
    assert sampling.sample_per_split(df.limit(0), 5).count() == 0


# ---- profiles -------------------------------------------------------------------

def test_coverage_counts_unicode_blanks(spark):
    rows = [("a",), ("\u00a0",), ("\u3000",), ("\u2003",), ("\t",), ("",), (None,)]
    df = spark.createDataFrame(rows, "habitat string").select(F.struct("habitat").alias("source"))
    cov = {r["field"]: r for r in profile.term_coverage(df).collect()}
    assert len(cov) == 188
    assert cov["habitat"]["records_with_data"] == 1
    assert cov["habitat"]["coverage_pct"] == round(100 / 7, 4)
    assert cov["year"]["records_with_data"] == 0 and cov["year"]["total_records"] == 7


def test_coverage_in_several_chunks(spark):
    from driftline.fields import TERMS

    df = spark.range(5).select(F.struct(*(F.lit("x").alias(t) for t in TERMS)).alias("source"))
    cov = profile.term_coverage(df).collect()
    assert len(cov) == 188 and all(r["records_with_data"] == 5 for r in cov)
    cats = profile.category_coverage(profile.term_coverage(df)).collect()
    assert len(cats) == 12 and all(r["avg_coverage_pct"] == 100.0 for r in cats)


def test_numeric_summary_with_nan(spark):
    data = [("a", float(v)) for v in (1, 2, 2, 10)] + [("a", float("nan")), ("a", None), ("b", None)]
    df = spark.createDataFrame(data, "split string, x double")
    stats = {r["split"]: r for r in profile.numeric_summary(df, ["x"]).collect()}
    a = stats["a"]
    assert (a["n_valid"], a["n_nan"], a["min"], a["max"]) == (4, 1, 1.0, 10.0)
    assert a["std"] == pytest.approx(np.std([1, 2, 2, 10])) and stats["b"]["n_valid"] == 0


def test_exact_medians(spark):
    rng = random.Random(4)
    data = [("a", rng.choice([1.0, 2.0, rng.random()]), rng.random()) for _ in range(1001)]
    data += [("b", rng.random(), None if i % 2 else rng.random()) for i in range(400)]
    df = spark.createDataFrame(data, "split string, x double, y double")
    got = {(r["split"], r["field"]): r["median"] for r in profile.exact_medians(df, ["x", "y"]).collect()}
    for s in "ab":
        for i, f in ((1, "x"), (2, "y")):
            values = [r[i] for r in data if r[0] == s and r[i] is not None]
            assert got[(s, f)] == pytest.approx(np.median(values))


def test_profile_of_large_and_odd_fields(spark):
    """Medians within the sketch's bracket, also of copies, infinities and one or two values."""
    rng = np.random.default_rng(8)
    n = 60_000
    data = {
        "x": rng.normal(size=n), "ties": np.where(rng.random(n) < 0.7, 3.0, rng.normal(size=n)),
        "ends": np.where(rng.random(n) < 0.5, -np.inf, np.inf), "few": np.where(np.arange(n) < 2, np.arange(n), np.nan),
    }
    df = spark.createDataFrame(pd.DataFrame({"split": "a"} | data))
    got = {r["field"]: r for r in profile.numeric_profile(df, list(data)).collect()}
    for f in ("x", "ties"):
        assert got[f]["median"] == np.median(data[f]) and got[f]["n_valid"] == n
    assert got["few"]["median"] == 0.5 and got["few"]["n_nan"] == n - 2
    assert got["ends"]["median"] in (-np.inf, np.inf) or np.isnan(got["ends"]["median"])
    none = profile.numeric_profile(df.selectExpr("split", "cast(null as double) as x"), ["x"]).first()
    assert none["median"] is None and none["n_valid"] == 0


def test_categories_of_an_empty_field(spark):
    df = spark.createDataFrame([("a", None, "v"), ("b", "w", None), ("a", None, None)], "split string, c string, d string")
    rows = {(r["split"], r["field"]): (r["n_valid"], r["n_unique"], r["top_values"]) for r in profile.categorical_profile(df, ["c", "d"]).collect()}
    assert rows == {("a", "c"): (0, 0, ""), ("a", "d"): (1, 1, "v (100.0%)"), ("b", "c"): (1, 1, "w (100.0%)"), ("b", "d"): (0, 0, "")}


def test_categorical_ties_by_value(spark):
    data = [("a", v) for v in ["q", "q", "p", "p", "z", None]]
    df = spark.createDataFrame(data, "split string, c string")
    row = profile.categorical_profile(df, ["c"]).first()
    assert (row["n_valid"], row["n_unique"]) == (5, 3)
    assert row["top_values"] == "p (40.0%), q (40.0%), z (20.0%)"


# ---- vocabulary -------------------------------------------------------------------

def test_published_marks(spark):
    """Counts at the published marks give the published proportions."""
    points = [(1, 136888180), (50, 220692845), (100, 226918100), (500, 233996320),
              (1000, 235943305), (5000, 240091180), (10000, 241173142), (32168, 241462843)]
    counts, last_rank, last = [136888180], 1, 136888180
    for rank, cum in points[1:]:
        size, total = rank - last_rank, cum - last
        base, extra = divmod(total, size)
        counts += [base + 1] * extra + [base] * (size - extra)
        last_rank, last = rank, cum
    rows = [(None if i == 0 else f"v{i:05d}", c) for i, c in enumerate(counts)]
    vocab = spark.createDataFrame(rows, f"{vocabulary.VALUE} string, {vocabulary.COUNT} long")
    got = {r["top_n"]: r for r in vocabulary.cumulative_marks(vocab).collect()}
    published = {
        1: (0.5669119865369928, 0.0), 50: (0.9139826329304007, 0.8013859437443273),
        100: (0.9397640530555668, 0.8609152295331803), 500: (0.9690779628565873, 0.9286010321639763),
        1000: (0.9771412531575302, 0.947219165315407), 5000: (0.9943193620063523, 0.9868834097987962),
        10000: (0.9988002253415031, 0.9972297209315415), 32168: (1.0, 1.0),
    }
    assert set(got) == set(published) == {*CUMULATIVE_MARKS, 32168}
    for (rank, cum) in points:
        r = got[rank]
        assert r["cumulative_count"] == cum
        assert r["cumulative_proportion_of_all_values_incl_null"] == pytest.approx(published[rank][0], abs=1e-12)
        assert r["cumulative_proportion_of_all_values_excl_null"] == pytest.approx(published[rank][1], abs=1e-12)


def test_vocabulary_keeps_null_and_empty_apart(spark):
    df = spark.createDataFrame([(None,), (None,), ("",), ("NaN",), ("NA",)], "value string")
    vocab = vocabulary.value_counts(df)
    assert {(r[0], r[1]) for r in vocab.collect()} == {(None, 2), ("", 1), ("NaN", 1), ("NA", 1)}
    curve = vocabulary.cumulative_curve(vocab).orderBy("rank").collect()
    assert [(r["rank"], r[1]) for r in curve] == [(1, ""), (2, "NA")]
    assert curve[-1]["cumulative_count"] == 1.0


def test_marks_without_null_row(spark):
    vocab = spark.createDataFrame([("a", 3), ("b", 1)], f"{vocabulary.VALUE} string, {vocabulary.COUNT} long")
    rows = vocabulary.cumulative_marks(vocab, (1, 50)).collect()
    assert [(r[0], r[1], r[2], r[3]) for r in rows] == [(1, 3, 0.75, 0.75), (50, 4, 1.0, 1.0), (2, 4, 1.0, 1.0)]


# ---- tests of equivalence ------------------------------------------------------------

def _ks(a, b):
    a, b = np.sort(a), np.sort(b)
    merged = np.concatenate([a, b])
    return np.max(np.abs(np.searchsorted(a, merged, "right") / len(a)
                         - np.searchsorted(b, merged, "right") / len(b)))


def test_ks_matches_numpy(spark):
    rng = np.random.default_rng(5)
    data = {"train": np.round(rng.normal(0, 1, 800), 2), "dev": np.round(rng.normal(0.2, 1, 300), 2),
            "test": np.round(rng.normal(0, 1, 15), 2)}
    rows = [(s, float(v)) for s, vs in data.items() for v in vs] + [("dev", None), ("dev", float("nan"))]
    df = spark.createDataFrame(rows, "split string, x double")
    got = {(r["split_a"], r["split_b"]): r for r in equivalence.ks_matrix(df, ["x"]).collect()}
    # test has fewer than 20 values
    assert {k: r["status"] for k, r in got.items()} == {
        ("train", "dev"): "tested", ("train", "test"): "skipped", ("dev", "test"): "skipped"}
    assert got["train", "test"]["passed"] is None and got["train", "test"]["n_b"] == 15
    r = got[("train", "dev")]
    assert r["statistic"] == pytest.approx(_ks(data["train"], data["dev"]), abs=1e-15)
    assert (r["n_a"], r["n_b"]) == (800, 300)
    assert r["passed"] == (r["p_value"] > 0.05)


@pytest.mark.parametrize("few", [0, 50, 10**9])
def test_ks_by_cells_matches_numpy(spark, monkeypatch, few):
    """Outliers, ties, infinities and denormal numbers, with cells opened again and again or not at all."""
    monkeypatch.setattr(equivalence, "FEW_ROWS", few)
    monkeypatch.setattr(equivalence, "CELLS", 16)
    rng = np.random.default_rng(9)

    def of(shift, n):
        return {
            "far": np.append(rng.normal(shift, 1, n), [1e300, -1e300, 1.7e308, -1.7e308]),
            "ties": np.append(rng.integers(0, 5, n) + shift, [0, 0, 0, 0]),
            "ends": np.append(np.where(rng.random(n) < 0.2 + shift, -np.inf, rng.normal(size=n)), [np.inf] * 4),
            "tiny": np.append(rng.integers(0, 50, n) * 5e-324, [0.0, -0.0, 5e-324, 1.0]),
            "same": np.full(n + 4, 7.0),
        }

    data = {"train": of(0.0, 700), "dev": of(0.1, 300), "test": of(0.05, 100)}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"split": s} | d) for s, d in data.items()]))
    fields = list(data["train"])
    got = {(r["feature"], r["split_a"], r["split_b"]): r["statistic"] for r in equivalence.ks_matrix(df, fields).collect()}
    assert len(got) == 15
    for (f, a, b), d in got.items():
        assert d == pytest.approx(_ks(data[a][f], data[b][f]), abs=1e-12), (f, a, b)


def test_ks_same_sample_is_zero(spark):
    df = spark.range(100).selectExpr("cast(id as double) as x").selectExpr(
        "explode(array('train', 'dev', 'test')) as split", "x")
    rows = equivalence.ks_matrix(df, ["x"]).collect()
    assert len(rows) == 3 and all(r["statistic"] == 0 and r["p_value"] == 1 and r["passed"] for r in rows)


def test_chi2_matches_library(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["train", "dev", "dev"]), rng.choice("abcde")) for _ in range(900)]
    df = spark.createDataFrame(rows, "split string, c string")
    got = equivalence.with_chi2_pvalue(
        equivalence.chi2_matrix(df, ["c"], ("train", "dev"))
    ).first()
    points = spark.createDataFrame(
        [(float("abcde".index(c)), Vectors.dense(0.0 if s == "train" else 1.0)) for s, c in rows],
        ["label", "features"],
    )
    ref = ChiSquareTest.test(points, "features", "label").first()
    assert got["statistic"] == pytest.approx(ref["statistics"][0])
    assert got["p_value"] == pytest.approx(ref["pValues"][0])
    assert got["dof"] == 4 and got["n_categories"] == 5


def test_chi2_two_categories_is_corrected(spark):
    counts = {("train", "a"): 30, ("train", "b"): 20, ("dev", "a"): 15, ("dev", "b"): 35}
    rows = [k for k, n in counts.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "split string, c string")
    got = equivalence.chi2_matrix(df, ["c"], ("train", "dev")).first()
    n, ad_bc = 100, abs(30 * 35 - 20 * 15)
    yates = n * (ad_bc - n / 2) ** 2 / (50 * 50 * 45 * 55)
    assert got["statistic"] == pytest.approx(yates)
    assert got["cramers_v"] == pytest.approx((yates / n) ** 0.5)


def test_ks_exact_pvalue_is_chosen_by_the_caller(spark):
    rows = [(s, float(i + shift)) for s, shift in (("train", 0), ("dev", 9)) for i in range(30)]
    tests = equivalence.ks_matrix(spark.createDataFrame(rows, "split string, x double"), ["x"])
    series = {(r["split_a"], r["split_b"]): r["p_value"] for r in tests.collect()}
    exact = {(r["split_a"], r["split_b"]): r["p_value"] for r in equivalence.with_exact_ks_pvalue(tests).collect()}
    # closed form for equal sizes n: 2 * sum of (-1)**(k - 1) * C(2n, n - 9k) / C(2n, n)
    reflected = 2 * sum((-1) ** (k - 1) * math.comb(60, 30 - 9 * k) for k in (1, 2, 3)) / math.comb(60, 30)
    assert exact["train", "dev"] == pytest.approx(reflected)
    assert series["train", "dev"] == pytest.approx(reflected, abs=0.03)
    assert exact["train", "test"] is None and series["train", "test"] is None


def test_tests_without_any_value_are_rows(spark):
    df = spark.createDataFrame([("train", None, None)], "split string, x double, c string")
    matrix = equivalence.equivalence_matrix(df, ["x"], ["c"]).collect()
    assert len(matrix) == 6 and all(r["status"] == "skipped" and r["passed"] is None for r in matrix)


def test_chi2_guards_and_cap(spark):
    one = spark.createDataFrame([("train", "a")] * 30 + [("dev", "a")] * 30, "split string, c string")
    skipped = equivalence.chi2_matrix(one, ["c"], ("train", "dev")).first()
    assert skipped["status"] == "skipped" and skipped["statistic"] is None and skipped["passed"] is None
    few = spark.createDataFrame([("train", "a")] * 30 + [("dev", "b")] * 19, "split string, c string")
    assert equivalence.chi2_matrix(few, ["c"], ("train", "dev")).first()["status"] == "skipped"
    many = spark.range(600).selectExpr(
        "if(id % 2 = 0, 'train', 'dev') as split", "cast(id % 120 as string) as c")
    capped = equivalence.chi2_matrix(many, ["c"], ("train", "dev")).first()
    assert (capped["n_categories"], capped["n_all_categories"]) == (50, 120)
    assert capped["covered"] == pytest.approx(50 / 120)
    whole = equivalence.chi2_matrix(many, ["c"], ("train", "dev"), max_categories=None).first()
    assert (whole["n_categories"], whole["covered"]) == (120, 1.0)


def test_summary(spark):
    df = spark.createDataFrame([("KS", True), ("KS", True), ("KS", None), ("Chi2", False)], "test string, passed boolean")
    got = {r["test"]: tuple(r)[1:] for r in equivalence.equivalence_summary(df).collect()}
    assert got == {"KS": (2, 2, 1, True), "Chi2": (0, 1, 0, False), "Overall": (2, 3, 1, False)}


# ---- geography ------------------------------------------------------------------------

def test_geojson_text_and_non_finite(spark):
    schema = ("decimalLatitude double, decimalLongitude double, scientificName string, depth float, "
              "phylum string")
    rows = [(1.234567, -2.0, "A", 12.25, None), (None, 1.0, "B", 1.0, "P"),
            (float("nan"), 1.0, "C", 1.0, "P"), (5.0, 6.0, None, float("inf"), None)]
    df = spark.createDataFrame(rows, schema).select(F.struct("*").alias("interpreted"))
    lines = [r[0] for r in geography.geojson_lines(geography.geo_features(df)).collect()]
    assert lines == [
        '{"type":"Feature","geometry":{"type":"Point","coordinates":[-2.0,1.23457]},'
        '"properties":{"species":"A","depth":12.3}}',
        '{"type":"Feature","geometry":{"type":"Point","coordinates":[6.0,5.0]},"properties":{}}',
    ]
    assert geography.non_finite_points(df).count() == 1


def _counted(spark):
    """A function on text that counts the rows it is given, and the count."""
    seen = spark.sparkContext.accumulator(0)

    def same(text):
        seen.add(1)
        return text

    return F.udf(same, "string"), seen


def test_matrix_reads_its_rows_once(spark):
    same, seen = _counted(spark)
    df = spark.range(300).select(
        same(F.element_at(F.array(*map(F.lit, ("train", "dev", "test"))), (F.col("id") % 3 + 1).cast("int"))).alias("split"),
        F.col("id").cast("double").alias("x"), (F.col("id") % 4).cast("string").alias("c"),
    )
    matrix = equivalence.equivalence_matrix(df, ["x"], ["c"]).collect()
    assert len(matrix) == 6 and all(r["status"] == "tested" for r in matrix)
    assert seen.value == 300


def test_united_samples_read_their_rows_once(spark, monkeypatch):
    from driftline.plans import catalog

    same, seen = _counted(spark)
    rows = spark.range(400).select(
        same(F.concat(F.lit("r"), "id")).alias("_id"), F.concat(F.lit("s"), F.col("id") % 40).alias("dataset_id"),
        F.struct(*(F.lit("v").alias(f) for f in CORE_FIELDS)).alias("interpreted"),
    )
    monkeypatch.setattr(catalog, "occurrences", lambda *_: rows)
    got = [r["_id"] for r in catalog.samples_united(spark, "").collect()]
    assert sorted(got) == sorted(f"r{i}" for i in range(400))  # fewer than a sample holds
    assert seen.value == 400


def test_pyramid_levels_agree(spark):
    df = spark.range(2000).selectExpr(
        "(id * 37 % 17000) / 100.0 - 85 as decimalLatitude",
        "(id * 91 % 36000) / 100.0 - 180 as decimalLongitude",
        "if(id % 3 = 0, null, 'P') as phylum",
    ).selectExpr("cast(decimalLatitude as double)", "cast(decimalLongitude as double)", "phylum")
    per_zoom = geography.tile_pyramid(df).groupBy("z").agg(F.sum("n").alias("n")).collect()
    assert len(per_zoom) == 13 and all(r["n"] == 2000 for r in per_zoom)


def test_pyramid_adds_up_zoom_by_zoom(spark, monkeypatch):
    """Fine zooms are not all spread out from the finest counts, of which there may be as many as points."""
    df = spark.range(500).selectExpr(
        "cast(id % 170 - 85 as double) as decimalLatitude", "cast(id % 360 - 180 as double) as decimalLongitude", "'P' as phylum",
    )
    runs, plain = [], geography._at_zooms
    monkeypatch.setattr(geography, "_at_zooms", lambda rows, z, zooms: runs.append((z, len(zooms))) or plain(rows, z, zooms))
    got = {(r["z"], r["x"], r["y"]): r["n"] for r in geography.tile_pyramid(df).collect()}
    assert all(n == 1 or z <= 8 for z, n in runs)
    for z in (0, 5, 8, 9, 12):
        tiles = df.groupBy(
            geography.tile_x(F.col("decimalLongitude"), z).alias("x"), geography.tile_y(F.col("decimalLatitude"), z).alias("y")
        ).count().collect()
        assert {k[1:]: n for k, n in got.items() if k[0] == z} == {(r["x"], r["y"]): r["count"] for r in tiles}


def test_thinning_matches_brute_force(spark):
    """Half of the points lie in one place."""
    df = spark.range(3000).selectExpr(
        "concat('p', id) as _id",
        "if(id % 2 = 0, 10.0D, cast((id * 37 % 1700) / 10.0 - 85 as double)) as decimalLatitude",
        "if(id % 2 = 0, 20.0D, cast((id * 91 % 3600) / 10.0 - 180 as double)) as decimalLongitude",
        "'P' as phylum",
    ).cache()
    cap = 7
    got = {(r["z"], r["x"], r["y"], r["_id"]) for r in geography.thinned_tiles(df, cap).collect()}
    expected = set()
    for z in range(13):
        tiles = {}
        rows = df.select(
            "_id", order_hash(42, F.col("_id")).alias("h"),
            geography.tile_x(F.col("decimalLongitude"), z).alias("x"),
            geography.tile_y(F.col("decimalLatitude"), z).alias("y"),
        ).collect()
        for r in rows:
            tiles.setdefault((r["x"], r["y"]), []).append((r["h"], r["_id"]))
        for (x, y), points in tiles.items():
            expected |= {(z, x, y, i) for _, i in sorted(points)[:cap]}
    assert got == expected


def test_thinning_writes_each_point_once(spark, monkeypatch):
    df = spark.range(3000).select(
        F.col("id").cast("string").alias("_id"), F.lit("p").alias("phylum"),
        F.lit(10.0).alias("decimalLatitude"), (F.col("id") % 300 / 10.0).alias("decimalLongitude"),
    )
    rows, plain = [], geography.staged

    def counted(frame, label):
        out = plain(frame, label)
        rows.append(out.count())
        return out

    monkeypatch.setattr(geography, "staged", counted)
    z12 = geography.thinned_tiles(df, 1001).where("z = 12").count()  # a cap that is ranked in slices first
    assert z12 == 3000 and max(rows) == 3000
    rows.clear()
    kept = geography.thinned_tiles(df, 5)
    assert kept.where("z = 12").count() == 1500
    # the first run writes every point once, the second those of the zoom between the runs
    assert sum(rows) <= 1500 + kept.where("z = 6").count()


def test_filters_and_popup(spark):
    df = spark.createDataFrame(
        [("1", "Chordata", 1.0, 2.0), ("2", None, 3.0, 170.0), ("3", "X", 4.0, -175.0)],
        "_id string, phylum string, decimalLatitude double, decimalLongitude double",
    )
    assert [r["_id"] for r in geography.phylum_filter(df, only="X").collect()] == ["3"]
    assert [r["_id"] for r in geography.phylum_filter(df, hidden=["X"]).collect()] == ["1", "2"]
    assert [r["_id"] for r in geography.in_viewport(df, 160, 0, -170, 10).collect()] == ["2", "3"]
    colours = [r["colour"] for r in geography.with_phylum_colour(df).orderBy("_id").collect()]
    assert colours == ["#e74c3c", "#7f8c8d", "#7f8c8d"]
    point = spark.createDataFrame(
        [("1", "", "Chordata", "", "O", None, 3.0, None, "", None)],
        "_id string, species string, phylum string, class string, `order` string, family string, "
        "depth double, bathymetry double, habitat string, waterBody string",
    )
    row = geography.popup(point).first()
    assert (row["title"], row["taxonomy"], row["depth_text"], row["bathymetry_text"], row["habitat"]) \
        == ("Unknown", "Chordata › O", "3m", "—", None)


# ---- batches --------------------------------------------------------------------------

def test_minibatches_keep_nulls_and_order(spark):
    df = spark.range(70).selectExpr("format_string('%03d', id) as _id", "if(id % 2 = 0, null, id) as v")
    indexed = ordering.with_row_index(df, [F.col("_id")])
    rows = batches.minibatches(indexed, fields=["_id", "v"]).orderBy("batch_id").collect()
    assert [r["n_rows"] for r in rows] == [32, 32, 6]
    assert [v for r in rows for v in r["v"]] == [None if i % 2 == 0 else i for i in range(70)]


def test_row_at(spark):
    df = spark.range(5).selectExpr("format_string('%03d', id) as _id")
    indexed = ordering.with_row_index(df, [F.col("_id")])
    assert batches.row_at(indexed, 3).first()["_id"] == "003"
    with pytest.raises(IndexError):
        batches.row_at(indexed, -1)
    with pytest.raises(Exception, match="out of range"):
        batches.row_at(indexed, 5).collect()


def test_inspect_shows_nulls(spark):
    df = spark.createDataFrame([("b", 1), ("a", None)], "_id string, x int").select(
        "_id", F.struct("x").alias("interpreted"))
    row = batches.inspect_first(df).first()
    assert row["_id"] == "a" and "null" in row["json"]


def test_null_test_on_split_does_not_hash(spark):
    df = splits.assign_by_record(_records(spark)).filter("split is not null").select("split")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not any("sha2" in line for line in plan.splitlines() if "Filter" in line)


def test_notes_tell_no_capture_from_an_empty_one(spark):
    urls = [f"https://www.protocols.io/{n}" for n in ("none", "null", "empty", "full")] + ["https://a.org/none"]
    vocab = vocabulary.value_counts(spark.createDataFrame([(u,) for u in urls], "value string"))
    captured = spark.createDataFrame(
        [(1, urls[1], None), (2, urls[2], ""), (3, urls[3], "<p>text</p>")], "page_id long, url string, html string")
    rows = pages.url_outcomes(pages.url_candidates(vocab), captured).collect()
    notes = {r["unique_samplingProtocol_value"]: r["extraction_notes"] for r in rows}
    read, download = "failed to read site content", "failed to download site content"
    assert [notes[u] for u in urls] == [read, read, download, "", download]
