"""Site-relative line frequency: lines that independent pages of a host repeat are boilerplate.

All of it is DataFrame expressions. A line is what stands between line feeds, compared without
surrounding white space; empty lines are never boilerplate. Frequencies are counted on line hashes
(64 bits, within a host), so no text is shuffled to count.
"""

from pyspark.sql import Column, DataFrame, functions as F

from driftline.staging import staged

RATIO = 0.01
MIN_PAGES = 5
#: A page is a near copy if more than this share of its characters is in lines that its host repeats.
NEAR_COPY_SHARE = 2 / 3
_NO_HOST = "\x00"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """Hash of a line without surrounding white space; null for an empty one."""
    bare = F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(bare != "", F.xxhash64(bare))


def _keyed(line: Column) -> Column:
    """Length and hash of a line; null for an empty one."""
    key = _key(line)
    return F.when(key.isNotNull(), F.struct(F.length(line).alias("chars"), key.alias("key")))


def boilerplate(
    docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES,
    host_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """Rows (host, line_keys): hashes of the lines on more than ``ratio`` of a host's independent pages
    and on ``min_pages`` of them at least.

    Pages of a host with the same text count as one, and so do near copies, so that copies of a page
    do not make its own lines boilerplate. A host has at most (lines of its mean page / ratio) such
    lines, whatever its number of pages, so the arrays stay short. Rows without a host form one host.
    """
    pages = staged(
        docs.where(F.col(text_col).isNotNull())
        .select(_host(host_col).alias("host"), F.xxhash64(text_col).alias("page"),
                F.array_compact(F.transform(_lines(F.col(text_col)), _keyed)).alias("lines"))
        .dropDuplicates(["host", "page"]),
        "page-lines",
    )
    lines = pages.select("host", "page", F.inline("lines")).groupBy("host", "page", "key").agg(
        F.max("chars").alias("chars")
    )
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    counts = lines.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    repeated = staged(
        counts.join(totals, "host").select("host", "key", (F.col("n") > F.col("pages") * ratio).alias("often")),
        "repeated-lines",
    )
    hits = staged(lines.join(repeated, ["host", "key"]), "repeated-lines-of-pages")
    groups = staged(_near_copies(pages, hits), "near-copies")
    # a group of copies or a page
    unit = F.struct(F.col("group").isNotNull().alias("copies"), F.coalesce("group", "page").alias("id"))
    units = (
        pages.select("host", "page").join(groups, ["host", "page"], "left").select("host", unit.alias("unit"))
        .distinct().groupBy("host").agg(F.count("*").alias("units"))
    )
    return (
        hits.select("host", "page", "key").join(groups, ["host", "page"], "left")
        .select("host", "key", unit.alias("unit")).distinct()
        .groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
        .join(units, "host").where(F.col("n") > F.col("units") * ratio)
        .groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("line_keys"))
    )


def _near_copies(pages: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows (host, page, group) of the pages that consist of lines which their host repeats often.

    Such a page leads with the longest of these lines. Its copies lead with the same one, or, where
    they have that one changed, with a line that stands beside it in other copies: the group is the
    longest lead of all pages that have the page's lead.
    """
    sizes = pages.select(
        "host", "page", F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + x["chars"]).alias("size")
    )
    often = hits.where("often")
    near = staged(
        often.groupBy("host", "page").agg(
            F.sum("chars").alias("shared"), F.max(F.struct("chars", "key")).alias("lead")
        )
        .join(sizes, ["host", "page"]).where(F.col("shared") > F.col("size") * NEAR_COPY_SHARE)
        .select("host", "page", "lead", F.col("lead.key").alias("key")), "repeated-pages",
    )
    leads = (
        often.select("host", "page", "key").join(near.select("host", "page", "lead"), ["host", "page"])
        .groupBy("host", "key").agg(F.max("lead").alias("first"))
    )
    return near.join(leads, ["host", "key"]).select("host", "page", F.col("first.key").alias("group"))


def _host(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(_NO_HOST))


def drop_boilerplate(
    docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES,
    host_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and the columns n_lines and n_removed
    (replaced if ``docs`` has them already).

    The other lines and their order stay. A text of boilerplate alone becomes empty, a null text stays
    null with no lines, repeated rows are cleaned each, and no rows give no rows. The list of lines is
    joined by host; whether it is broadcast is left to its size.
    """
    found = staged(boilerplate(docs, ratio, min_pages, host_col, text_col), "boilerplate").select(
        F.col("host").alias("__host"), F.col("line_keys").alias("__keys")
    )
    lines = _lines(F.col(text_col))
    kept = F.filter(lines, lambda line: ~F.coalesce(F.array_contains(F.col("__keys"), _key(line)), F.lit(False)))
    clean = F.when(F.col("__keys").isNull(), F.col(text_col)).otherwise(F.array_join("__kept", "\n"))
    n_lines = F.coalesce(F.size(lines), F.lit(0))
    return (
        docs.join(found, _host(host_col) == F.col("__host"), "left")
        .withColumn("__kept", F.when(F.col("__keys").isNotNull(), kept))
        .withColumns({
            "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(n_lines),
            "n_removed": F.when(F.col(text_col).isNull() | F.col("__keys").isNull(), 0)
            .otherwise(n_lines - F.size("__kept")),
            text_col: clean,
        })
        .drop("__host", "__keys", "__kept")
    )
