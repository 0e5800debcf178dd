"""Exact, repeatable samples."""

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from driftline.functions.hashing import order_hash
from driftline.staging import staged

SAMPLE_ROWS = 50_000
SEED = 42
_SLICES = 64
#: A bound lets through this many standard deviations more rows than wanted; a short split gets _WIDER times that.
_SPARE, _WIDER = 6, 16


def _bound(n: int, rows: int, spare: int) -> str:
    """Leading hex digits below which about ``n`` of ``rows`` uniform hashes lie, and ``spare`` deviations more."""
    wanted = n + spare * (n**0.5 + 1)
    return f"{int(wanted / rows * 2**64):016x}" if wanted < rows else "g"


def sample_per_split(
    df: DataFrame, n: int = SAMPLE_ROWS, seed: int = SEED, key: str = "_id", split: str = "split"
) -> DataFrame:
    """Exactly min(n, rows) rows of every split: those first in the order of a seeded hash.

    The sizes of the splits bound the hashes that can be among the first n. One pass hashes every row
    and writes those below the bound, a few more than n, which are then ranked. Where copies of one id
    leave a split short, its bound is widened and only then is that split hashed again. Copies share a
    hash and may be many more than n, so ranks are taken per slice of rows first and across slices second.
    """
    known = df.where(F.col(split).isNotNull())
    # One row per split.
    sizes = {r[split]: r["n"] for r in known.groupBy(split).agg(F.count("*").alias("n")).collect()}
    # The slice is in the same projection as the hash: it is not deterministic, so the filter below
    # is not copied into the hash expressions underneath, and each is computed once per row.
    keyed = known.select(
        "*", order_hash(seed, F.col(key)).alias("_hash"),
        (F.spark_partition_id() % _SLICES).alias("_slice"),
    )
    parts, open_splits, spare = [], dict(sizes), _SPARE
    while open_splits:
        bound = F.lit(None).cast("string")
        for name, rows in open_splits.items():
            bound = F.when(F.col(split) == name, _bound(n, rows, spare)).otherwise(bound)
        near = staged(keyed.where(F.col("_hash") < bound), "near-sample")
        found = {r[split]: r["n"] for r in near.groupBy(split).agg(F.count("*").alias("n")).collect()}
        short = {s: rows for s, rows in open_splits.items() if found.get(s, 0) < min(n, rows)}
        parts.append(near.where(~F.col(split).isin(list(short))) if short else near)
        open_splits, spare = short, spare * _WIDER
    if not parts:
        return df.limit(0)
    order = [F.col("_hash"), F.col(key)]
    by_slice = F.row_number().over(Window.partitionBy(split, "_slice").orderBy(*order))
    overall = F.row_number().over(Window.partitionBy(split).orderBy(*order))
    return (
        reduce(DataFrame.unionByName, parts).withColumn("_rn", by_slice).filter(F.col("_rn") <= n)
        .withColumn("_rn", overall).filter(F.col("_rn") <= n)
        .select(*df.columns)
    )


def staged_sample(df: DataFrame, columns: list, n: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """Sample with the wanted columns only, written once for the several tests that read it."""
    return staged(sample_per_split(df.select("split", *columns), n, seed), "sample")


def distinct_union(*samples: DataFrame) -> DataFrame:
    """Rows that any of the samples has, each once."""
    return reduce(DataFrame.unionByName, samples).distinct()


def paired_coordinates(sample: DataFrame, lat: str = "decimalLatitude",
                       lon: str = "decimalLongitude") -> DataFrame:
    """Rows that have both coordinates, so that the pairs stay together."""
    return sample.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
