"""Listing, probing and reading many Parquet files whose nested schemas differ."""

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from driftline.functions.text import file_stem
from driftline.staging import scratch_path, staged

PROBE_SCHEMA = (
    "path string, uri string, file_name string, n_rows long, "
    "fields array<struct<parent:string, name:string, type:string>>, error string, schema string, "
    "unread array<string>"
)
#: Files whose paths the driver holds at a time.
FILES_PER_SLICE = 1000
_OPTIONS = "driftline.storage."


# ---- reading with one schema ------------------------------------------------

def read_occurrences(
    spark: SparkSession, path: str, recursive: bool = False, columns=None
) -> DataFrame:
    """All Parquet files of a folder, or of the whole tree below it, with the ``columns`` any of them has.

    The schema unites the footers of all files, so a column or struct field that some files lack is
    null there and kept elsewhere. Any URI of a file system Spark knows. A public bucket is read
    without keys through ``anonymous_bucket``.
    """
    probed = staged(probe_files(file_manifest(spark, path, recursive)), "probe")
    return _folder(spark, path, recursive, united_schema(probed, columns))


def _folder(spark, path, recursive, schema) -> DataFrame:
    reader = spark.read.option("pathGlobFilter", "*.parquet")
    reader = reader.option("recursiveFileLookup", str(recursive).lower())
    return (reader.schema(schema) if schema.fields else reader).parquet(path)


def schema_nodes(probed: DataFrame, columns=None) -> DataFrame:
    """One row (at, types, first) for each column, struct field, array element and map entry of any file.

    Footers are taken apart where they were read and folded by an ordinary aggregation, so no schema of
    a file reaches the driver. ``at`` holds the names from the top down, ``types`` the distinct types found
    (``struct``, ``array`` and ``map`` for what has nodes below it), ``first`` the first place, for the order.
    """
    wanted = None if columns is None else set(columns)

    def nodes(frames):
        for frame in frames:
            rows = [
                (path, place, at, kind) for path, schema in zip(frame["path"], frame["schema"], strict=True)
                for place, (at, kind) in enumerate(_nodes(T.StructType.fromJson(json.loads(schema)), wanted))
            ]
            yield pd.DataFrame(rows, columns=["path", "place", "at", "type"])

    taken = probed.filter(F.col("schema").isNotNull()).select("path", "schema").mapInPandas(
        nodes, "path string, place int, at array<string>, type string"
    )
    return taken.groupBy("at").agg(
        F.sort_array(F.collect_set("type")).alias("types"), F.min(F.struct("path", "place")).alias("first")
    )


def _nodes(schema: T.StructType, wanted, at=()):
    for f in schema.fields:
        if at or wanted is None or f.name in wanted:
            yield from _node(f.dataType, (*at, f.name))


def _node(kind: T.DataType, at):
    if isinstance(kind, T.StructType):
        yield list(at), "struct"
        yield from _nodes(kind, None, at)
    elif isinstance(kind, T.ArrayType):
        yield list(at), "array"
        yield from _node(kind.elementType, (*at, "element"))
    elif isinstance(kind, T.MapType):
        yield list(at), "map"
        yield from _node(kind.keyType, (*at, "key"))
        yield from _node(kind.valueType, (*at, "value"))
    else:
        yield list(at), _type_text(kind)


def _type_text(kind: T.DataType) -> str:
    value = kind.jsonValue()
    return value if isinstance(value, str) else json.dumps(value)


def _type_of(text: str) -> T.DataType:
    value = json.loads(text) if text.startswith("{") else text
    field = {"name": "x", "type": value, "nullable": True, "metadata": {}}
    return T.StructType.fromJson({"type": "struct", "fields": [field]})["x"].dataType


def united_schema(probed: DataFrame, columns=None) -> T.StructType:
    """The union of the schemas of all probed files, struct fields included, limited to ``columns``.

    Integers and floats widen. Other clashes raise ``ValueError`` with the field's name, as no one
    type can read all files; ``read_harmonised`` casts such fields. The driver gets one row for each
    field of the result.
    """
    below: dict[tuple, list] = {}
    types = {}
    for row in schema_nodes(probed, columns).orderBy("first").collect():
        at = tuple(row["at"])
        types[at] = row["types"]
        below.setdefault(at[:-1], []).append(at)

    def struct(at):
        # a field that no file has a type for can be read from none
        return T.StructType([T.StructField(c[-1], kind(c)) for c in below.get(at, []) if types[c] != ["void"]])

    def kind(at):
        found = [t for t in types[at] if t != "void"] or ["void"]
        if found == ["struct"]:
            return struct(at)
        if found == ["array"]:
            return T.ArrayType(kind((*at, "element")))
        if found == ["map"]:
            return T.MapType(kind((*at, "key")), kind((*at, "value")))
        for widening in _WIDENINGS:
            if all(t in widening for t in found):
                return _type_of(max(found, key=widening.index))
        if len(found) == 1:
            return _type_of(found[0])
        raise ValueError(f"{'.'.join(at)}: files have it as {' and as '.join(found)}")

    return struct(())


_WIDENINGS = (("byte", "short", "integer", "long"), ("float", "double"), ("byte", "short", "integer", "double"))


def anonymous_bucket(spark: SparkSession, bucket: str) -> None:
    """Read ``s3a://bucket`` without credentials, by Spark and by the probe."""
    spark.sparkContext._jsc.hadoopConfiguration().set(
        f"fs.s3a.bucket.{bucket}.aws.credentials.provider",
        "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider",
    )
    storage_options(spark, f"s3a://{bucket}", anonymous=True)


def storage_options(spark: SparkSession, root: str, **options) -> None:
    """Options of the file system with which the probe's tasks open files below ``root``.

    They are those of ``pyarrow.fs`` (``anonymous``, ``region``, ``endpoint_override``, ... for S3) and go
    to the tasks with the probe; Spark's own reader has its settings.
    """
    spark.conf.set(f"{_OPTIONS}{root.rstrip('/')}", json.dumps(options))


def _all_storage_options(spark: SparkSession) -> dict[str, dict]:
    return {
        k.removeprefix(_OPTIONS): json.loads(v) for k, v in spark.conf.getAll.items() if k.startswith(_OPTIONS)
    }


def with_file_name(df: DataFrame, name: str = "source_file") -> DataFrame:
    return df.withColumn(name, F.col("_metadata.file_name"))


def file_dataset_id() -> Column:
    """The survey of a row: the stem of the file it was read from."""
    return file_stem(F.col("_metadata.file_name"))


def read_value_shards(
    spark: SparkSession, paths, null_marker: str = "", multi_line: bool = False
) -> DataFrame:
    """CSV shards ``value, source`` as one table; words such as NA stay text.

    Values that hold line ends need ``multi_line``; then a file is one task, else a large file is many.
    """
    return (
        spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
        .option("nullValue", null_marker)
        .schema("value string, source string").csv(paths)
    )


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    """A split's file list: one name per line, trimmed, blank lines dropped."""
    name = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    return spark.read.text(path).select(name.alias("file_name")).filter(F.col("file_name") != "")


def rows_of_files(df: DataFrame, file_list: DataFrame, name: str = "file_name") -> DataFrame:
    return df.join(file_list.select(F.col("file_name").alias(name)).distinct(), name, "left_semi")


# ---- manifest and probe ------------------------------------------------------

def file_manifest(
    spark: SparkSession, path: str, recursive: bool = False, glob: str = "*.parquet"
) -> DataFrame:
    """Path, its encoded form, name, size and time of the files; their content is never read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
        .select(
            "path", F.col("_metadata.file_path").alias("uri"),
            F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", "modificationTime",
        )
    )


def without_logged(manifest: DataFrame, *logs: DataFrame) -> DataFrame:
    """Files that no log (done, failed, ...) names."""
    seen = reduce(DataFrame.union, [log.select("file_name") for log in logs])
    return manifest.join(seen.distinct(), "file_name", "left_anti")


def _opened(uri: str, options: dict[str, dict]):
    """The file as a random-access stream, with the options of the longest root above it."""
    import pyarrow.fs as pafs

    def plain(x):  # file:/a, file:///a and s3a://b, s3://b are the same places
        return re.sub(r"^(\w+):/+", lambda m: f"{m[1].replace('s3a', 's3')}:/", x)

    roots = [r for r in options if f"{plain(uri)}/".startswith(f"{plain(r)}/")]
    filesystem, inner = pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    if roots:
        filesystem = type(filesystem)(**options[max(roots, key=len)])
    return filesystem.open_input_file(inner)


def _probe_one(path: str, uri: str, options: dict[str, dict]) -> dict:
    import pyarrow.parquet as pq

    row = {"path": path, "uri": uri, "file_name": path.rsplit("/", 1)[-1],
           "n_rows": None, "fields": None, "error": None, "schema": None, "unread": None}
    try:
        with _opened(uri, options) as handle:
            parquet = pq.ParquetFile(handle)
            schema, unread = _spark_schema(parquet.schema_arrow)
            fields = [
                {"parent": p, "name": f.name, "type": _type_text(f.dataType)} for column in schema
                for p, f in [(None, column), *((column.name, c) for c in getattr(column.dataType, "fields", []))]
            ]
            row.update(n_rows=parquet.metadata.num_rows, fields=fields, schema=schema.json(), unread=unread)
    except Exception as problem:  # any unreadable file becomes a row of the quarantine
        row["error"] = f"{type(problem).__name__}: {problem}"
    return row


def _spark_schema(schema) -> tuple[T.StructType, list[str]]:
    """Spark's schema of a file, and the fields left out of it, as Spark lacks their types."""
    import pyarrow as pa
    from pyspark.errors import PySparkTypeError
    from pyspark.sql.pandas.types import from_arrow_type

    # what Spark's Parquet reader makes of unsigned integers
    unsigned = {
        pa.uint8(): T.ShortType(), pa.uint16(): T.IntegerType(), pa.uint32(): T.LongType(),
        pa.uint64(): T.DecimalType(20, 0),
    }
    unread = []

    def kind(at, name):
        """Spark's type; null if there is none, which is noted."""
        if at in unsigned:
            return unsigned[at]
        if pa.types.is_struct(at):
            inner = fields(at, f"{name}.")
            return T.StructType(inner) if inner or not at.num_fields else None
        if pa.types.is_list(at) or pa.types.is_large_list(at) or pa.types.is_fixed_size_list(at):
            element = kind(at.value_type, f"{name}.element")
            return None if element is None else T.ArrayType(element, at.value_field.nullable)
        if pa.types.is_map(at):
            key, value = kind(at.key_type, f"{name}.key"), kind(at.item_type, f"{name}.value")
            return None if key is None or value is None else T.MapType(key, value, at.item_field.nullable)
        if pa.types.is_dictionary(at):
            return kind(at.value_type, name)
        try:
            return from_arrow_type(at)
        except PySparkTypeError:
            unread.append(f"{name}: {at}")
            return None

    def fields(children, prefix):
        found = [(c, kind(c.type, f"{prefix}{c.name}")) for c in children]
        return [T.StructField(c.name, t, c.nullable) for c, t in found if t is not None]

    return T.StructType(fields(schema, "")), unread


def probe_files(manifest: DataFrame, deep: bool = False) -> DataFrame:
    """Schema and row count of each file from its footer, or the error of reading it.

    ``unread`` names fields of types that Spark lacks; they are in no united schema. Runs on the
    executors, one row per file. ``deep`` also reads every page, for files whose footer is sound but
    whose data is not. The number of tasks is given, as the listing is far too small for Spark to
    spread it by itself.
    """
    spark = manifest.sparkSession
    options = _all_storage_options(spark)

    def probe(frames):
        for frame in frames:
            rows = [_probe_one(p, u, options) for p, u in zip(frame["path"], frame["uri"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "uri", "file_name", "n_rows", "fields", "error", "schema", "unread"])

    tasks = spark.sparkContext.defaultParallelism
    probed = manifest.select("path", "uri").repartition(tasks, "path").mapInPandas(probe, PROBE_SCHEMA)
    return _with_page_errors(staged(probed, "probe")) if deep else probed


def _with_page_errors(probed: DataFrame) -> DataFrame:
    """A file of which Spark's own reader decodes fewer rows than the footer tells gets an error.

    All columns are decoded, large files in as many tasks as they have splits; a split that fails ends
    there and the others go on.
    """
    known = probed.filter(F.col("error").isNull())
    rows = [
        _decoded_rows(probed.sparkSession, schema, paths)
        for part in _slices(known.select("path", "schema"))
        for schema, paths in _schema_groups((r["path"], T.StructType.fromJson(json.loads(r["schema"]))) for r in part)
        if schema.fields
    ]
    if not rows:
        return probed
    counts = reduce(DataFrame.unionByName, rows)
    lost = F.when((F.size("fields") > 0) & (F.coalesce("_decoded", F.lit(0)) < F.col("n_rows")), F.format_string(
        "%d of %d rows can be read", F.coalesce("_decoded", F.lit(0)), F.col("n_rows")
    ))
    return probed.join(counts, "uri", "left").withColumn("error", F.coalesce("error", lost)).drop("_decoded")


def _decoded_rows(spark, schema, paths) -> DataFrame:
    """Rows (uri, _decoded), staged. The hash over all columns is what makes the reader decode them."""
    df = spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(*paths)
    whole = [
        F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map" in f.dataType.simpleString() else F.col(f"`{f.name}`")
        for f in schema.fields
    ]
    counted = df.groupBy(F.col("_metadata.file_path").alias("uri")).agg(
        F.count("*").alias("_decoded"), F.bit_xor(F.xxhash64(*whole)).alias("_hash")
    )
    return staged(counted, "decoded").select("uri", "_decoded")


def quarantine(probed: DataFrame) -> DataFrame:
    return probed.filter(F.col("error").isNotNull()).select("path", "file_name", "error")


def read_readable(
    spark: SparkSession, path: str, recursive: bool = False, deep: bool = False, columns=None
) -> tuple[DataFrame, DataFrame]:
    """Rows of the files that can be read, and the quarantine of the others.

    Without a quarantine the folder is read as it is, else the good files a slice at a time.
    """
    probed = staged(probe_files(file_manifest(spark, path, recursive), deep), "probe")
    bad = quarantine(probed)
    schema = united_schema(probed.filter(F.col("error").isNull()), columns)
    if bad.isEmpty():
        return _folder(spark, path, recursive, schema), bad
    good = probed.filter(F.col("error").isNull()).select("path")
    frames = (spark.read.schema(schema).parquet(*(r["path"] for r in part)) for part in _slices(good) if part)
    return _in_one(spark, frames, schema, -(-good.count() // FILES_PER_SLICE)), bad


# ---- reading with drifting schemas -------------------------------------------

def _location(field: str, struct: str | None, root: bool) -> Column:
    """(parent, type) of a wanted field in one file: the struct first, then the top level."""
    def found(in_struct):
        match = F.filter("fields", lambda f: (f["name"] == field) & (
            f["parent"] == struct if in_struct else f["parent"].isNull()
        ))
        return F.when(F.size(match) > 0, F.get(match, F.lit(0)))

    options = ([found(True)] if struct else []) + ([found(False)] if root else [])
    return F.coalesce(*options)


def _slices(files: DataFrame):
    """Rows of ``files``, which has a ``path``, about FILES_PER_SLICE at a time on the driver."""
    parts = max(1, -(-files.count() // FILES_PER_SLICE))
    for part in range(parts):
        yield files.where(F.pmod(F.xxhash64("path"), F.lit(parts)) == part).orderBy("path").collect()


def _in_one(spark, frames, schema, n: int) -> DataFrame:
    """The frames of ``n`` slices as one: a single slice as it is, more written out one by one.

    So neither the plan nor the driver grows with the number of files.
    """
    if n <= 1:
        return reduce(DataFrame.unionByName, frames, spark.createDataFrame([], schema))
    out = scratch_path(spark, "slices")
    spark.createDataFrame([], schema).write.parquet(out)
    for frame in frames:
        frame.write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def _schema_groups(files):
    """(schema, paths) for files (path, schema), in as few groups as the first that fits each gives."""
    groups: list[tuple[dict, list]] = []
    for path, schema in files:
        nodes = {tuple(at): kind for at, kind in _nodes(schema, None)}
        for known, paths, fields in groups:
            if all(known.get(at, kind) == kind for at, kind in nodes.items()):
                known.update(nodes)
                paths.append(path)
                fields.append(schema)
                break
        else:
            groups.append((nodes, [path], [schema]))
    return [(reduce(_merged, fields), paths) for _, paths, fields in groups]


def _merged(a: T.DataType, b: T.DataType) -> T.DataType:
    """Both schemas' fields; what both have is of one type."""
    if isinstance(a, T.StructType):
        fields = {f.name: f.dataType for f in a.fields}
        for f in b.fields:
            fields[f.name] = _merged(fields[f.name], f.dataType) if f.name in fields else f.dataType
        return T.StructType([T.StructField(n, t) for n, t in fields.items()])
    if isinstance(a, T.ArrayType):
        return T.ArrayType(_merged(a.elementType, b.elementType))
    if isinstance(a, T.MapType):
        return T.MapType(a.keyType, _merged(a.valueType, b.valueType))
    return a


def read_harmonised(
    spark: SparkSession, probed: DataFrame, wanted: dict[str, str],
    struct: str | None = "source", root: bool = False, needs_field: bool = True,
) -> DataFrame:
    """Stack files of different schemas: wanted fields, bad values as null, gaps as null.

    ``wanted`` maps fields to Spark types. A field is taken from ``struct``, else (``root``) from the
    top level; the choice is made per file, so a null in the struct is not filled from the top.
    Spark fills a column that a file lacks with null by itself. Only files that have a field in
    different places or types need separate reads. Places and types come from the probe; files are
    dealt with a slice at a time, so the driver never holds more paths than a slice has.
    With ``needs_field`` files that have none of the fields give no rows.
    """
    choice = F.filter(F.array(*(
        F.struct(F.lit(f).alias("field"), _location(f, struct, root).alias("at")) for f in wanted
    )), lambda c: c["at"].isNotNull())
    places = probed.filter(F.col("error").isNull()).select(
        "path",
        F.transform(choice, lambda c: F.struct(
            c["field"].alias("field"), c["at"]["parent"].alias("parent"), c["at"]["type"].alias("type")
        )).alias("chosen")
    )
    places = staged(places.filter(F.size("chosen") > 0) if needs_field else places, "places")
    schema = T.StructType([T.StructField("file_name", T.StringType()), *(
        T.StructField(f, T.DataType.fromDDL(t)) for f, t in wanted.items()
    )])
    frames = (
        _read_group(spark, paths, wanted, chosen)
        for part in _slices(places) for chosen, paths in _choice_groups(part)
    )
    return _in_one(spark, frames, schema, -(-places.count() // FILES_PER_SLICE))


def _choice_groups(rows):
    """(field -> (parent, type), paths) for files that can be read together."""
    groups: list[tuple[dict, list]] = []
    for row in rows:
        chosen = {c["field"]: (c["parent"], c["type"]) for c in row["chosen"]}
        for known, paths in groups:
            if all(known.get(f, place) == place for f, place in chosen.items()):
                known.update(chosen)
                paths.append(row["path"])
                break
        else:
            groups.append((chosen, [row["path"]]))
    return groups


def _read_group(spark, paths, wanted, chosen) -> DataFrame:
    in_struct, top = {}, []
    for f, (parent, kind) in chosen.items():
        if parent:
            in_struct.setdefault(parent, []).append(T.StructField(f, _type_of(kind)))
        else:
            top.append(T.StructField(f, _type_of(kind)))
    schema = T.StructType(
        [T.StructField(p, T.StructType(fields)) for p, fields in in_struct.items()] + top
    )
    df = spark.read.schema(schema).parquet(*paths)

    def value(f):
        if f not in chosen:
            return F.lit(None).cast(wanted[f]).alias(f)
        parent = chosen[f][0]
        column = F.col(f"`{parent}`.`{f}`" if parent else f"`{f}`")
        return column.try_cast(wanted[f]).alias(f)

    return df.select(F.col("_metadata.file_name").alias("file_name"), *(value(f) for f in wanted))


def harvest_field(
    spark: SparkSession, probed: DataFrame, field: str = "samplingProtocol", struct: str = "source"
) -> DataFrame:
    """One field of every file as text, from ``struct`` or else from the top level."""
    return read_harmonised(spark, probed, {field: "string"}, struct, root=True)
