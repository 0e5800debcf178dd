import csv
import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from driftline.fields import CORE_FIELDS, RAW_CATEGORICAL_FIELDS, RAW_NUMERIC_FIELDS
from driftline.operators.splits import assign_by_record
from driftline.plans import jobs
from driftline.sources import files, sinks
from driftline.streaming import ingest


def _struct(rows, **types):
    kind = pa.struct([pa.field(k, t) for k, t in types.items()])
    return pa.table({"source": pa.array(rows, type=kind)})


@pytest.fixture()
def drift(tmp_path):
    """Files of different schemas, and one that is no Parquet file."""
    s, d = pa.string(), pa.float64()
    pq.write_table(_struct([{"x": 1.5, "y": "a"}, {"x": None, "y": "b"}], x=d, y=s), tmp_path / "a.parquet")
    pq.write_table(_struct([{"y": "c", "z": "extra"}], y=s, z=s), tmp_path / "b.parquet")
    pq.write_table(_struct([{"x": "abc", "y": "d"}, {"x": " 12.5 ", "y": None}], x=s, y=s), tmp_path / "c.parquet")
    pq.write_table(pa.table({"samplingProtocol": ["net", None]}), tmp_path / "d.parquet")
    (tmp_path / "e.parquet").write_bytes(os.urandom(500))
    (tmp_path / "notes.txt").write_text("not listed")
    sub = tmp_path / "sub"
    sub.mkdir()
    pq.write_table(_struct([{"x": 9.0, "y": "deep"}], x=d, y=s), sub / "f.parquet")
    return str(tmp_path)


def test_manifest(spark, drift):
    flat = files.file_manifest(spark, drift).orderBy("file_name").collect()
    assert [r["file_name"] for r in flat] == [f"{c}.parquet" for c in "abcde"]
    assert flat[4]["length"] == 500
    deep = files.file_manifest(spark, drift, recursive=True)
    assert deep.count() == 6
    assert "content" not in deep._jdf.queryExecution().executedPlan().toString()


def test_probe_and_quarantine(spark, drift):
    probed = files.probe_files(files.file_manifest(spark, drift))
    rows = {r["file_name"]: r for r in probed.collect()}
    assert rows["a.parquet"]["n_rows"] == 2 and rows["a.parquet"]["error"] is None
    assert {(f["parent"], f["name"], f["type"]) for f in rows["a.parquet"]["fields"]} >= {
        ("source", "x", "double"), ("source", "y", "string")
    }
    bad = files.quarantine(probed).collect()
    assert [r["file_name"] for r in bad] == ["e.parquet"]


def test_probe_finds_bad_pages(spark, tmp_path):
    path = tmp_path / "pages.parquet"
    pq.write_table(pa.table({"v": [f"value {i}" * 9 for i in range(5000)]}), path, compression="snappy",
                   use_dictionary=False)
    raw = bytearray(path.read_bytes())
    raw[200:4200] = os.urandom(4000)
    path.write_bytes(raw)
    manifest = files.file_manifest(spark, str(tmp_path))
    assert files.quarantine(files.probe_files(manifest)).count() == 0
    assert files.quarantine(files.probe_files(manifest, deep=True)).count() == 1


def test_harmonised_read(spark, drift):
    probed = files.probe_files(files.file_manifest(spark, drift))
    df = files.read_harmonised(spark, probed, {"x": "double", "y": "string", "w": "string"})
    assert df.columns == ["file_name", "x", "y", "w"]
    rows = sorted(map(tuple, df.collect()), key=str)
    assert rows == sorted([
        ("a.parquet", 1.5, "a", None), ("a.parquet", None, "b", None), ("b.parquet", None, "c", None),
        ("c.parquet", None, "d", None), ("c.parquet", 12.5, None, None),
    ], key=str)


def test_harmonised_read_without_any_field(spark, drift):
    probed = files.probe_files(files.file_manifest(spark, drift))
    assert files.read_harmonised(spark, probed, {"nothing": "string"}).count() == 0


def test_struct_wins_per_file(spark, tmp_path):
    """A null in the struct is not filled from the top-level column of the same file."""
    kind = pa.struct([("samplingProtocol", pa.int64())])
    pq.write_table(pa.table({
        "source": pa.array([{"samplingProtocol": 7}, {"samplingProtocol": None}], type=kind),
        "samplingProtocol": ["root", "root"],
    }), tmp_path / "both.parquet")
    pq.write_table(pa.table({"samplingProtocol": ["net"]}), tmp_path / "root.parquet")
    pq.write_table(pa.table({"other": ["x"]}), tmp_path / "none.parquet")
    rows = files.harvest_field(
        spark, files.probe_files(files.file_manifest(spark, str(tmp_path)))
    ).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(
        [("both.parquet", "7"), ("both.parquet", None), ("root.parquet", "net")], key=str)


def test_file_lists_and_logs(spark, drift, tmp_path):
    listed = tmp_path / "train.txt"
    listed.write_text("a.parquet\n\n  c.parquet \n")
    names = files.read_file_list(spark, str(listed))
    assert sorted(r[0] for r in names.collect()) == ["a.parquet", "c.parquet"]
    manifest = files.file_manifest(spark, drift)
    assert files.rows_of_files(manifest, names).count() == 2
    log = spark.createDataFrame([("b.parquet",)], "file_name string")
    left = files.without_logged(manifest, names, log)
    assert sorted(r["file_name"] for r in left.collect()) == ["d.parquet", "e.parquet"]


def test_ingest_resumes(spark, drift, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))

    def run():
        ingest.ingest_field(spark, drift, out, f"{out}/checkpoint", "y", files_per_batch=2)
        return ingest.ingested(spark, out, "y").count()

    assert run() == 5  # a, b and c; d has no such field, e is no Parquet file
    assert run() == 5
    pq.write_table(_struct([{"y": "n1"}, {"y": "n2"}], y=pa.string()), f"{drift}/g.parquet")
    assert run() == 7
    log = {r["file_name"]: r["status"] for r in ingest.ingest_log(spark, out).collect()}
    assert log == {"a.parquet": "done", "b.parquet": "done", "c.parquet": "done", "d.parquet": "done",
                   "e.parquet": "failed", "g.parquet": "done"}


def test_failed_files_are_taken_in_after_a_retry(spark, drift, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))

    def run():
        ingest.ingest_field(spark, drift, out, f"{out}/checkpoint", "y", files_per_batch=2)
        return ingest.ingested(spark, out, "y").count()

    def bad():
        return {r.file_name: (r.status, r.attempts) for r in ingest.ingest_state(spark, out).collect()}["e.parquet"]

    assert run() == 5 and bad() == ("failed", 1)
    ingest.retry_failed(spark, out, "y")
    assert run() == 5 and bad() == ("failed", 2)
    pq.write_table(_struct([{"y": "late"}, {"y": None}], y=pa.string()), f"{drift}/e.parquet")
    assert ingest.ingested(spark, out, "y").count() == 5  # only a retry takes it in
    for _ in range(2):
        ingest.retry_failed(spark, out, "y")
        assert ingest.ingested(spark, out, "y").count() == 7 and bad() == ("done", 3)
    assert ingest.ingested(spark, out, "y").filter("y = 'late'").count() == 1


def test_ingest_rows_of_known_schema(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    pq.write_table(pa.table({"v": [1, 2, 3]}), folder / "a.parquet")
    def run():
        ingest.ingest_rows(spark, str(folder), "v long", out, str(tmp_path / "cp"))
        return spark.read.schema("v long").parquet(out).count()

    assert run() == 3
    assert run() == 3
    pq.write_table(pa.table({"v": [4, 5]}), folder / "b.parquet")
    assert run() == 5


def test_csv_round_trip(spark, tmp_path):
    values = ["plain", " spaced ", 'quo"te', "com,ma", "line\nbreak", "", None, "NA", "NaN"]
    df = spark.createDataFrame([(v, "f") for v in values], "value string, source string")
    sinks.write_csv(df, str(tmp_path / "marked"), null_marker="\\N")
    back = files.read_value_shards(spark, str(tmp_path / "marked"), null_marker="\\N", multi_line=True)
    assert sorted((r[0] for r in back.collect()), key=str) == sorted(values, key=str)
    sinks.write_csv(df, str(tmp_path / "plain"))
    back = [r[0] for r in files.read_value_shards(spark, str(tmp_path / "plain"), multi_line=True).collect()]
    assert sorted(back, key=str) == sorted([v or None for v in values], key=str)
    part = next((tmp_path / "plain").glob("part-*.csv"))
    with open(part, newline="") as handle:
        assert next(csv.reader(handle)) == ["value", "source"]


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "once")
    sinks.write_once(spark.range(3), path)
    sinks.write_once(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3


def test_shards_are_contiguous(spark):
    df = spark.range(230).selectExpr("format_string('f%02d', id % 23) as source", "'v' as value")
    rows = sinks.with_shard(df).select("source", "shard").distinct().collect()
    assert {r["source"]: r["shard"] for r in rows} == {f"f{i:02d}": i // 3 for i in range(23)}
    manifest = spark.createDataFrame([(f"f{i:02d}",) for i in range(40)], "source string")
    rows = sinks.with_shard(df, manifest=manifest).select("source", "shard").distinct().collect()
    assert {r["source"]: r["shard"] for r in rows} == {f"f{i:02d}": i // 4 for i in range(23)}


@pytest.fixture()
def occurrence_files(spark, tmp_path):
    """Twelve survey files with interpreted and source structs, one row incomplete in each."""
    text = {f: pa.string() for f in CORE_FIELDS}
    text.update({f: pa.float64() for f in
                 ("bathymetry", "shoredistance", "decimalLatitude", "decimalLongitude")})
    interp = pa.struct([pa.field(f, t) for f, t in text.items()])
    folder = tmp_path / "data"
    folder.mkdir()
    for k in range(12):
        rows = []
        for i in range(20):
            row = {f: f"{f}{i % 3}" for f in CORE_FIELDS}
            row.update(bathymetry=float(i), shoredistance=2.0 * i, decimalLatitude=i - 10.0,
                       decimalLongitude=i * 3.0)
            rows.append(row)
        rows[5]["species"] = None
        raw = pa.struct([pa.field(f, pa.float64() if k % 2 else pa.string())
                         for f in RAW_NUMERIC_FIELDS[:2]]
                        + [pa.field(f, pa.string()) for f in RAW_CATEGORICAL_FIELDS[:4]])
        source = [
            {f: (float(i) if k % 2 else str(i)) for f in RAW_NUMERIC_FIELDS[:2]}
            | {f: f"{f}{i % 4}" for f in RAW_CATEGORICAL_FIELDS[:4]} for i in range(20)
        ]
        pq.write_table(pa.table({
            "_id": [f"{k}-{i}" for i in range(20)], "dataset_id": [f"ds{k}"] * 20,
            "interpreted": pa.array(rows, type=interp), "source": pa.array(source, type=raw),
        }), folder / f"ds{k}.parquet")
    return folder


def test_create_and_compare_splits(spark, occurrence_files, tmp_path):
    for by_record in (False, True):
        out = str(tmp_path / f"splits-{by_record}")
        jobs.create_splits(spark, str(occurrence_files), out, by_record)
        written = spark.read.parquet(out)
        assert written.count() == 12 * 19
        assert written.columns == ["_id", "dataset_id", "interpreted", "split"]
        if by_record:
            marked = assign_by_record(written.drop("split")).join(
                written.select("_id", F.col("split").alias("w")), "_id")
            assert marked.filter("split <> w").count() == 0
            assert spark.read.schema(written.drop("split").schema).parquet(f"{out}_without_id").count() == 0
            matrix, summary = jobs.compare_splits(spark, out, n=100)
            assert matrix.filter("test = 'KS'").count() > 0
            assert {r["test"] for r in summary.collect()} == {"KS", "Chi2", "Overall"}
        else:
            assert written.groupBy("dataset_id").agg(
                F.countDistinct("split").alias("k")).filter("k > 1").count() == 0
    kept = str(tmp_path / "kept")
    jobs.create_splits(spark, str(occurrence_files), kept, keep_missing=True)
    assert spark.read.parquet(kept).count() == 240


def test_compare_file_lists(spark, occurrence_files):
    names = [f"ds{k}.parquet" for k in range(12)]
    lists = {
        s: spark.createDataFrame([(n,) for n in part], "file_name string")
        for s, part in (("train", names[:6]), ("val", names[6:9]), ("test", names[9:]))
    }
    matrix, summary = jobs.compare_file_lists(spark, str(occurrence_files), lists)
    rows = matrix.collect()
    # two numeric and four categorical raw fields of eleven exist, three pairs each
    tested = [r for r in rows if r["status"] == "tested"]
    assert len(rows) == 33 and len(tested) == 18 and all(r["passed"] for r in tested)
    assert all(r["statistic"] == pytest.approx(0, abs=1e-12) for r in tested if r["test"] == "KS")


def test_coverage_report_and_exports(spark, occurrence_files, tmp_path):
    jobs.export_csv(spark, str(occurrence_files), str(tmp_path / "csv"))
    table = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert table.columns == CORE_FIELDS and table.count() == 240

    (occurrence_files / "broken.parquet").write_bytes(b"nothing")
    cats = jobs.coverage_report(spark, str(occurrence_files), str(tmp_path / "coverage"))
    assert cats.count() == 12
    report = spark.read.option("header", True).csv(str(tmp_path / "coverage"))
    kingdom = report.filter("field = 'kingdom'").first()
    assert (kingdom["records_with_data"], kingdom["total_records"]) == ("240", "240")

    assert jobs.export_geojson(spark, str(occurrence_files), str(tmp_path / "geo")) == (240, 0)
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "geo")).collect()]
    assert len(lines) == 240 and lines[0]["geometry"]["type"] == "Point"
    skipped = spark.read.parquet(str(tmp_path / "geo_unreadable")).collect()
    assert [r["file_name"] for r in skipped] == ["broken.parquet"]


def test_vocabulary_and_url_jobs(spark, tmp_path):
    data = [("https://a.example.org/p", "f1")] * 3 + [("Pel.Trawl", "f1"), (None, "f2"), ("net", "f2"),
            ("https://b.example.org", "f2"), ("https://protocols.io/x", "f2"), ("https://c.example.org", "f2")]
    values = spark.createDataFrame(data, "value string, source string")
    vocab = jobs.vocabulary_reports(values, str(tmp_path / "voc"))
    stats = spark.read.option("header", True).csv(str(tmp_path / "voc/per_source_stats"))
    assert {tuple(r)[:4] for r in stats.collect()} == {("f1", "4", "4", "2"), ("f2", "5", "4", "4")}
    pages = spark.createDataFrame(
        [(2, "https://a.example.org/p", "<p>second</p>"), (1, "https://a.example.org/p", "<p>first</p>"),
         (3, "https://b.example.org", "<script>x</script>"), (4, "https://c.example.org", "")],
        "page_id long, url string, html string")
    report = jobs.mine_urls(vocab, pages, str(tmp_path / "urls")).collect()
    notes = {r["unique_samplingProtocol_value"]: (r["successful_extraction"], r["extraction_notes"])
             for r in report}
    assert notes == {
        "https://a.example.org/p": (True, ""),
        "https://b.example.org": (False, "failed to extract markdown from downloaded site content"),
        "https://c.example.org": (False, "failed to download site content"),
        "https://protocols.io/x": (False, "failed to read site content"),
        "Pel.Trawl": (False, "failed to download site content"),
    }
    text = spark.read.parquet(str(tmp_path / "urls/texts")).first()
    assert (text["uid"], text["name"], text["text"]) == (0, "extracted_url_00000.md", "first")


def test_jobs_keep_what_only_some_files_have(spark, tmp_path):
    base = {f: pa.array(["x"], pa.string()) for f in CORE_FIELDS}
    base |= {f: pa.array([1.5]) for f in ("bathymetry", "shoredistance", "decimalLatitude", "decimalLongitude")}

    def write(name, n, extra=None, top=None, **changed):
        fields = {**base, **(extra or {}), **changed}
        struct = pa.StructArray.from_arrays([a.take(pa.array([0] * n)) for a in fields.values()], names=list(fields))
        ids = pa.array([f"{name}-{i}" for i in range(n)])
        columns = {"_id": ids, "dataset_id": pa.array([name] * n), "interpreted": struct, **(top or {})}
        pq.write_table(pa.table(columns), tmp_path / "in" / f"{name}.parquet")

    (tmp_path / "in").mkdir()
    write("a", 3, top={"source": pa.array([1, 2, 3])})
    write("b", 4, {"depth": pa.array([7.0]), "habitat": pa.array(["reef"])}, {"absence": pa.array([True] * 4)})
    write("c", 2, {"depth": pa.array([2.0], pa.float32())}, {"source": pa.array(["s", "t"])},
          decimalLatitude=pa.array([float("nan")]))
    assert jobs.export_geojson(spark, str(tmp_path / "in"), str(tmp_path / "geo")) == (7, 2)
    lines = [json.loads(r[0])["properties"] for r in spark.read.text(str(tmp_path / "geo")).collect()]
    assert sum("depth" in x for x in lines) == sum(x.get("habitat") == "reef" for x in lines) == 4
    assert spark.read.parquet(str(tmp_path / "geo_non_finite")).count() == 2
    jobs.create_splits(spark, str(tmp_path / "in"), str(tmp_path / "out"), by_record=True, keep_missing=True)
    rows = spark.read.parquet(str(tmp_path / "out"))
    found = rows.selectExpr("count(*)", "count(absence)", "count(interpreted.depth)", "count(interpreted.habitat)").first()
    assert tuple(found) == (9, 4, 6, 4)
    write("d", 1, {"depth": pa.array(["deep"])})
    with pytest.raises(ValueError, match="interpreted.depth"):
        jobs.create_splits(spark, str(tmp_path / "in"), str(tmp_path / "other"))


def test_unsigned_and_unknown_types(spark, tmp_path):
    """A field of a type that pyspark's Arrow conversion lacks does not hide its neighbours."""
    inner = pa.array([{"only_here": "x", "n": 200, "big": 2**63}],
                     pa.struct([("only_here", pa.string()), ("n", pa.uint8()), ("big", pa.uint64())]))
    table = pa.table({"interpreted": inner, "numbers": pa.array([[1, 2**32 - 1]], pa.list_(pa.uint32())),
                      "small": pa.array([65535], pa.uint16())})
    pq.write_table(table, tmp_path / "a.parquet")
    pq.write_table(pa.table({"interpreted": pa.array([{"other": 1}]), "at": pa.array([1], pa.time32("ms"))}), tmp_path / "b.parquet")
    row = files.read_occurrences(spark, str(tmp_path)).filter("small is not null").first()
    assert (row.interpreted.only_here, row.interpreted.n, int(row.interpreted.big)) == ("x", 200, 2**63)
    assert row.numbers == [1, 2**32 - 1] and row.small == 65535
    probed = {r.file_name: r for r in files.probe_files(files.file_manifest(spark, str(tmp_path))).collect()}
    assert probed["a.parquet"].unread == [] and probed["b.parquet"].unread == ["at: time32[ms]"]
    assert probed["b.parquet"].error is None


def test_schema_of_many_different_files(spark, tmp_path):
    """200 files, no two alike: one row a field reaches the driver, and all rows are read."""
    kinds = [pa.int8(), pa.int16(), pa.int32(), pa.int64()]
    for k in range(200):
        inner = pa.struct([("a", kinds[k % 4]), (f"only_{k}", pa.string()), ("none", pa.null())])
        pq.write_table(pa.table({
            "interpreted": pa.array([{"a": k % 100, f"only_{k}": "x", "none": None}], type=inner),
            "tags": pa.array([[k % 100]], type=pa.list_(kinds[(k + 1) % 4])),
            f"extra_{k % 7}": pa.array([{"k": k}], type=pa.map_(pa.string(), pa.float32() if k % 2 else pa.float64()))
            if k % 7 == 0 else pa.array([k], pa.int64()),
        }), tmp_path / f"f{k:03d}.parquet")
    probed = files.probe_files(files.file_manifest(spark, str(tmp_path)))
    nodes = files.schema_nodes(probed, ["interpreted", "tags"]).collect()
    assert len(nodes) == 1 + 1 + 200 + 1 + 2  # interpreted, a, only_*, none, tags and its element
    schema = files.united_schema(probed, ["interpreted", "tags", "extra_0"])
    assert [f.name for f in schema] == ["interpreted", "tags", "extra_0"]
    assert schema["tags"].dataType.simpleString() == "array<bigint>"
    assert schema["extra_0"].dataType.simpleString() == "map<string,double>"
    assert schema["interpreted"].dataType["a"].dataType.simpleString() == "bigint"
    assert "none" not in schema["interpreted"].dataType.names and len(schema["interpreted"].dataType) == 201
    df = files.read_occurrences(spark, str(tmp_path), columns=["interpreted", "extra_1"])
    row = df.agg(F.count("*"), F.sum("interpreted.a"), F.count("interpreted.only_77"), F.count("extra_1")).first()
    assert tuple(row) == (200, 2 * sum(range(100)), 1, 29)


def test_clash_names_the_field(spark, drift):
    probed = files.probe_files(files.file_manifest(spark, drift))
    with pytest.raises(ValueError, match="source.x: files have it as double and as string"):
        files.united_schema(probed)
    assert files.united_schema(probed, ["samplingProtocol"]).names == ["samplingProtocol"]


@pytest.mark.parametrize("per_slice", [2, 1000])
def test_reads_in_slices(spark, drift, monkeypatch, per_slice):
    """The same rows whether the paths come at once or two at a time."""
    monkeypatch.setattr(files, "FILES_PER_SLICE", per_slice)
    probed = files.probe_files(files.file_manifest(spark, drift))
    df = files.read_harmonised(spark, probed, {"x": "double", "y": "string", "samplingProtocol": "string"}, root=True)
    assert df.columns == ["file_name", "x", "y", "samplingProtocol"]
    assert sorted(map(tuple, df.collect()), key=str) == sorted([
        ("a.parquet", 1.5, "a", None), ("a.parquet", None, "b", None), ("b.parquet", None, "c", None),
        ("c.parquet", None, "d", None), ("c.parquet", 12.5, None, None), ("d.parquet", None, None, "net"),
        ("d.parquet", None, None, None),
    ], key=str)
    rows, bad = files.read_readable(spark, drift, columns=["samplingProtocol"])
    assert rows.where("samplingProtocol is not null").count() == 1 and rows.count() == 7
    assert [r.file_name for r in bad.collect()] == ["e.parquet"]


def test_names_with_blanks_and_signs(spark, tmp_path):
    folder = tmp_path / "a b+c%20"
    folder.mkdir()
    pq.write_table(pa.table({"v": [1, 2]}), folder / "x y%.parquet")
    probed = files.probe_files(files.file_manifest(spark, str(folder)), deep=True).collect()
    assert [(r.file_name, r.n_rows, r.error) for r in probed] == [("x y%.parquet", 2, None)]


def test_storage_options_reach_the_probe(spark, tmp_path):
    pq.write_table(pa.table({"v": [1]}), tmp_path / "a.parquet")
    (tmp_path / "sub").mkdir()
    pq.write_table(pa.table({"v": [1]}), tmp_path / "sub" / "b.parquet")

    def errors():
        found = files.probe_files(files.file_manifest(spark, str(tmp_path), recursive=True)).collect()
        return {r.file_name: r.error for r in found}

    files.storage_options(spark, f"file://{tmp_path}", use_mmap=True)
    assert errors() == {"a.parquet": None, "b.parquet": None}
    files.storage_options(spark, f"file://{tmp_path}/sub", no_such_option=1)
    found = errors()
    assert found["a.parquet"] is None and "no_such_option" in found["b.parquet"]
    files.anonymous_bucket(spark, "a-public-bucket")
    assert files._all_storage_options(spark)["s3a://a-public-bucket"] == {"anonymous": True}


def test_deep_probe_by_file_and_split(spark, tmp_path):
    """Clashing files are no bad files; a large file with one bad page is, and is read in many tasks."""
    rows = 40_000
    pq.write_table(pa.table({"v": pa.array(range(rows))}), tmp_path / "long.parquet", row_group_size=4000)
    pq.write_table(pa.table({"v": ["x"] * 5, "m": pa.array([[("k", 1)]] * 5, pa.map_(pa.string(), pa.int32()))}), tmp_path / "text.parquet")
    pq.write_table(pa.table({"v": pa.array([], pa.int64())}), tmp_path / "none.parquet")
    path = tmp_path / "broken.parquet"
    pq.write_table(pa.table({"v": [f"value {i}" * 9 for i in range(rows)]}), path, use_dictionary=False, row_group_size=4000)
    raw = bytearray(path.read_bytes())
    raw[len(raw) // 2:len(raw) // 2 + 3000] = os.urandom(3000)
    path.write_bytes(raw)
    (tmp_path / "noise.parquet").write_bytes(os.urandom(300))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        probed = files.probe_files(files.file_manifest(spark, str(tmp_path)), deep=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    errors = {r.file_name: r.error for r in probed}
    assert {n for n, e in errors.items() if e is None} == {"long.parquet", "text.parquet", "none.parquet"}
    assert errors["broken.parquet"].endswith(f"of {rows} rows can be read")
    assert 0 < int(errors["broken.parquet"].split()[0]) < rows
