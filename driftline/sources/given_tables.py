"""Occurrence records built from the star-schema test tables.

The tables hold no occurrences, so every line item becomes one record: the supplier is the survey,
part and nation columns give a hierarchy, and nulls, blanks, URLs and gear codes come from its
numbers. ``OCCURRENCE_SQL`` is the same definition for the SQL side of the checks.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftline.fields import CORE_FIELDS

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, with the schema that its footer has now."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CORE = """
  cast(l.l_orderkey as string) || '-' || cast(l.l_linenumber as string) || '-'
    || cast(l.l_partkey as string) || '-' || cast(l.l_suppkey as string) || '-'
    || cast(cast(l.l_quantity as int) as string) as _id,
  'ds-' || cast(l.l_suppkey as string) as dataset_id,
  case when l.l_linenumber = 1 then cast(null as string)
       when l.l_linenumber = 2 and l.l_quantity < 10 then ''
       when l.l_linenumber = 2 then '  '
       when l.l_linenumber = 3 then 'https://doi.org/10.' || cast(1000 + l.l_suppkey % 7 as string)
            || '/' || lower(p.p_type)
       when l.l_linenumber = 4 then 'Pel.Trawl'
       when l.l_linenumber = 5 then 'doi:10.1007/s' || cast(l.l_suppkey % 5 as string)
       else p.p_type || ' ' || o.o_orderpriority end as samplingProtocol,
  case when l.l_quantity <= 2 then cast(null as double)
       else l.l_extendedprice / 10 - 1000 end as bathymetry,
  case when l.l_quantity <= 1 then cast(null as double) else l.l_quantity * 1000 end as shoredistance,
  case when l.l_partkey % 97 = 0 then cast(null as double)
       else cast((l.l_partkey * 53 + l.l_suppkey * 7) % 17000 as double) / 100 - 85
       end as decimalLatitude,
  case when l.l_partkey % 89 = 0 then cast(null as double)
       else cast((l.l_orderkey * 37 + l.l_linenumber * 11) % 36000 as double) / 100 - 180
       end as decimalLongitude,
  'EPSG:4326' as geodeticDatum,
  r.r_name as kingdom, n.n_name as phylum, p.p_type as class, p.p_brand as {order},
  p.p_brand || '/' || p.p_type as family, split_part(p.p_name, ' ', 1) as genus,
  case when l.l_partkey % 10 = 0 then cast(null as string) else p.p_name end as species,
  p.p_name as scientificName, cast(l.l_orderkey as string) as occurrenceID
"""

# Further fields: three for the geographic export, the others as raw text of ``source``.
_EXTRA = """,
  case when l.l_quantity > 40 then cast(null as double) else l.l_quantity / 8 end as depth,
  case when l.l_linenumber = 6 then '' when l.l_returnflag = 'R' then 'reef'
       else cast(null as string) end as habitat,
  case when l.l_linestatus = 'O' then n.n_name || ' Sea' else cast(null as string) end as waterBody,
  case l.l_returnflag when 'A' then 'HumanObservation' when 'R' then 'PreservedSpecimen'
       else 'MachineObservation' end as basisOfRecord,
  case when l.l_linenumber = 7 then 'unknown'
       when l.l_linenumber = 2 then cast(null as string)
       else cast(cast(l.l_quantity as int) as string) end as minimumDepthInMeters,
  case when l.l_linenumber = 2 then cast(null as string)
       else cast(cast(l.l_quantity as int) * 2 as string) end as maximumDepthInMeters,
  case when l.l_tax = 0 then ' ' else cast(l.l_partkey % 500 as string)
       end as coordinateUncertaintyInMeters,
  cast((l.l_partkey * 53 + l.l_suppkey * 7) % 17000 {div} 100 - 85 as int) as latitude_degree,
  cast((l.l_orderkey * 37 + l.l_linenumber * 11) % 36000 {div} 100 - 180 as int) as longitude_degree
"""

_FROM = """
from lineitem l
join orders o on l.l_orderkey = o.o_orderkey
join part p on l.l_partkey = p.p_partkey
join supplier s on l.l_suppkey = s.s_suppkey
join nation n on s.s_nationkey = n.n_nationkey
join region r on n.n_regionkey = r.r_regionkey
"""

# For the SQL checks: the fields as flat columns.
OCCURRENCE_SQL = "select " + _CORE.format(order='"order"') + _FROM
EXTENDED_SQL = (
    "select " + _CORE.format(order='"order"') + _EXTRA.format(div="//") + _FROM
)

_EXPORT_ONLY = ["depth", "habitat", "waterBody"]
_RAW_TEXT = [
    "basisOfRecord", "minimumDepthInMeters", "maximumDepthInMeters",
    "coordinateUncertaintyInMeters", "habitat", "waterBody",
    "samplingProtocol", "kingdom", "phylum", "class", "order", "family", "genus",
    "scientificName", "geodeticDatum", "occurrenceID",
]


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with ``_id``, ``dataset_id`` and the structs ``interpreted`` and ``source``.

    The joins are left to the optimizer: it reads only the columns a query needs, and picks a
    broadcast where the table statistics allow it.
    """
    names = ["lineitem", "orders", "part", "supplier", "nation", "region"]
    sql = "select " + _CORE.format(order="`order`") + _EXTRA.format(div="div") + _FROM
    for name in names:
        sql = sql.replace(f" {name} {name[0]}", f" {{{name}}} {name[0]}")
    given = {name: table(spark, sf_dir, name) for name in names}
    flat = spark.sql(sql, **given)
    raw = [F.col(f"`{f}`") for f in _RAW_TEXT] + [
        F.col("latitude_degree").cast("string").alias("decimalLatitude"),
        F.col("longitude_degree").cast("string").alias("decimalLongitude"),
    ]
    return flat.select(
        "_id",
        "dataset_id",
        F.struct(*(F.col(f"`{f}`") for f in CORE_FIELDS + _EXPORT_ONLY)).alias("interpreted"),
        F.struct(*raw).alias("source"),
    )


def interpreted_fields(df: DataFrame, fields=CORE_FIELDS, keep=()) -> DataFrame:
    """Fields of ``interpreted`` as columns of the same name, after the columns in ``keep``."""
    return df.select(*keep, *(F.col(f"interpreted.`{f}`").alias(f) for f in fields))
