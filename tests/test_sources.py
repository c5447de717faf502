"""Source types, formats, listings and read options."""

import pytest
from pyspark.sql import functions as F

from assayer.functions.formats import file_format, format_of
from assayer.sources import listing, readers, sinks
from assayer.sources.readers import SOURCE_TYPES, load, read_plan
from assayer.specs import SourceSpec, SpecError
from tests.conftest import DATA, SMALL, plan_of, rows

NAMES = [
    ("data.csv", "csv"), ("data.parquet", "parquet"), ("data.avro", "avro"), ("data.json", "json"), ("data.jsonl", "jsonl"),
    ("data.ndjson", "jsonl"), ("data.orc", "orc"), ("data.txt", "unknown"), ("DATA.CSV", "csv"), ("a.b/plain", "unknown"), ("x/y.Parquet", "parquet"),
]


def test_format_detection(spark):
    listed = spark.createDataFrame(NAMES, "path string, want string").select("path", "want", file_format(F.col("path")).alias("got"))
    assert all(r.want == r.got for r in listed.collect())
    assert all(format_of(path) == want for path, want in NAMES)


def test_every_source_type_has_a_read_plan():
    assert len(SOURCE_TYPES) == 18
    for kind in SOURCE_TYPES:
        source = SourceSpec("s", kind, path="/data", host="h", database="db", bucket="b", account="acc", project_id="p", dataset="d", catalog="c")
        plan = read_plan(source, "t.parquet" if kind in readers.STORAGE_TYPES else "t")
        assert plan.format
    with pytest.raises(SpecError):
        read_plan(SourceSpec("s", "mongodb"), "t")
    with pytest.raises(SpecError):
        read_plan(SourceSpec("s", "local", path="/data"), "notes.txt")


@pytest.mark.parametrize(
    "source, url",
    [
        (SourceSpec("s", "postgres", host="h", database="d", ssl_mode="require"), "jdbc:postgresql://h:5432/d?sslmode=require"),
        (SourceSpec("s", "mysql", host="h", port=3307, database="d"), "jdbc:mysql://h:3307/d"),
        (SourceSpec("s", "sqlserver", host="h", database="d"), "jdbc:sqlserver://h:1433;databaseName=d"),
        (SourceSpec("s", "oracle", host="h", database="svc"), "jdbc:oracle:thin:@//h:1521/svc"),
        (SourceSpec("s", "databricks", host="h", http_path="/sql/1"), "jdbc:databricks://h:443;httpPath=/sql/1"),
        (SourceSpec("s", "trino", host="h", catalog="c", schema="x"), "jdbc:trino://h:8080/c/x"),
        (SourceSpec("s", "duckdb", database="/f.db"), "jdbc:duckdb:/f.db"),
        (SourceSpec("s", "clickhouse", host="h", database="d"), "jdbc:clickhouse://h:8123/d"),
        (SourceSpec("s", "postgres", connection_url="jdbc:postgresql://own/x"), "jdbc:postgresql://own/x"),
    ],
)
def test_jdbc_urls(source, url):
    assert read_plan(source, "t").options["url"] == url


def test_jdbc_options():
    split = {"partitionColumn": "id", "lowerBound": "0", "upperBound": "9", "numPartitions": "4"}
    source = SourceSpec("s", "postgres", host="h", database="d", schema="sales", username="u", password="p", options=split)
    options = readers.jdbc_options(source, "orders")
    assert options["dbtable"] == "sales.orders" and options["user"] == "u" and options["numPartitions"] == "4"
    asked = readers.jdbc_options(source, query="SELECT 1")
    assert asked["query"] == "SELECT 1" and "dbtable" not in asked and "numPartitions" not in asked
    with pytest.raises(SpecError):
        readers.jdbc_options(SourceSpec("s", "postgres", options={"numPartitions": "4"}), "t")
    assert "all_tab_columns" in readers.columns_query(SourceSpec("s", "oracle"), "t")
    assert "o''brien" in readers.columns_query(source, "o'brien")
    assert "column_key" in readers.columns_query(SourceSpec("s", "mysql"), "t")
    with pytest.raises(SpecError):
        readers.tables_query(SourceSpec("s", "local"))


def test_storage_paths_and_settings():
    s3 = SourceSpec("s", "s3", bucket="b", path="in", access_key="k", secret_key="x", endpoint="http://store:9000", region="r")
    plan = read_plan(s3, "t.parquet")
    assert plan.path == "s3a://b/in/t.parquet"
    assert plan.options["fs.s3a.endpoint"] == "http://store:9000" and plan.options["fs.s3a.path.style.access"] == "true"
    assert read_plan(SourceSpec("s", "gcs", bucket="b"), "t.orc").path == "gs://b/t.orc"
    assert read_plan(SourceSpec("s", "azure_blob", bucket="c", account="a", secret_key="x"), "t.csv").path == "abfss://c@a.dfs.core.windows.net/t.csv"
    assert read_plan(SourceSpec("s", "hdfs", host="n", path="/w"), "t.json").path == "hdfs://n:8020/w/t.json"
    assert read_plan(SourceSpec("s", "deltalake", path="/lake"), "t") == readers.ReadPlan("delta", {}, "/lake/t")
    assert read_plan(SourceSpec("s", "iceberg", catalog="c", schema="x"), "t").path == "c.x.t"
    assert read_plan(SourceSpec("s", "bigquery", project_id="p", dataset="d"), "t").options["table"] == "p.d.t"
    assert read_plan(SourceSpec("s", "snowflake", account="a", database="d"), "t").options["sfURL"] == "a.snowflakecomputing.com"


def test_missing_format_module_is_named(spark, tmp_path):
    with pytest.raises(SpecError, match="avro"):
        load(spark, SourceSpec("s", "local", path=str(tmp_path)), "t.avro")


@pytest.fixture
def folder(spark, people, tmp_path):
    """One small file per format, one empty, one unknown, one nested."""
    people.coalesce(1).write.parquet(str(tmp_path / "p"))
    (tmp_path / "a.csv").write_text('id,name\n1,ann\n2,"b\nob"\n')
    (tmp_path / "none.CSV").write_text("id,name\n")
    (tmp_path / "one.json").write_text('[{"a": 1},\n {"a": 2}]')
    (tmp_path / "lines.ndjson").write_text('{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    (tmp_path / "notes.txt").write_text("hello")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.csv").write_text("id\n7\n")
    return str(tmp_path)


def test_listing_and_row_counts(spark, folder):
    files = {r.name: (r.format, r.size) for r in listing.list_files(spark, folder).collect()}
    assert files["notes.txt"] == ("unknown", 5) and files["b.csv"][0] == "csv"
    flat = {r.name for r in listing.list_files(spark, folder, recursive=False).collect()}
    assert "b.csv" not in flat and "a.csv" in flat
    assert {r.name for r in listing.list_files(spark, folder, pattern="*.json").collect()} == {"one.json"}
    counts = {r.name: r.row_count for r in listing.row_counts(spark, folder).collect()}
    assert counts["none.CSV"] == 0 and counts["one.json"] == 2 and counts["lines.ndjson"] == 3 and counts["b.csv"] == 1
    assert sum(n for name, n in counts.items() if name.endswith(".parquet")) == 4
    assert "notes.txt" not in counts
    whole = {r.name: r.row_count for r in listing.row_counts(spark, folder, csv_multiline=True).collect()}
    assert counts["a.csv"] == 3 and whole["a.csv"] == 2


def test_listing_does_not_read_contents(spark, folder):
    assert "content" not in plan_of(listing.list_files(spark, folder))
    sums = listing.list_files(spark, folder, pattern="notes.txt", checksum=True).first()
    assert sums.checksum == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"


def test_csv_and_json_sources(spark, folder):
    source = SourceSpec("s", "local", path=folder, options={"multiLine": "true"})
    assert [f.dataType.simpleString() for f in load(spark, source, "a.csv").schema] == ["int", "string"]
    assert load(spark, source, "one.json").count() == 2
    assert load(spark, SourceSpec("s", "local", path=folder), "lines.ndjson", "a long").agg(F.sum("a")).first()[0] == 6
    assert rows(listing.file_schema(spark, f"{folder}/sub/b.csv"), "name", "data_type") == [("id", "int")]


def test_statistics_and_partitions(spark, people, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_partitions(people.na.fill("none"), path, ["name"])
    sinks.replace_partitions(people.na.fill("none"), path, ["name"])
    assert spark.read.parquet(path).count() == 4
    files = listing.list_files(spark, path)
    stats = {r.format: r for r in listing.table_statistics(files, listing.row_counts(spark, path)).collect()}
    assert stats["parquet"].row_count == 4 and stats["parquet"].size_bytes > 0
    assert rows(listing.partition_columns(files)) == [("name", 3)]
    assert "PartitionFilters: [isnotnull(name" in plan_of(spark.read.parquet(path).where("name = 'ann'"))


def test_dated_sink_and_session_tables(spark, people, tmp_path):
    dated = people.select("id", F.lit("t1").alias("tenant_id"), F.lit("2024-01-02 03:04:05").cast("timestamp").alias("at"))
    sinks.write_dated(dated, str(tmp_path / "d"), "at", "tenant_id")
    assert (tmp_path / "d" / "tenant_id=t1" / "event_date=2024-01-02").is_dir()
    people.createOrReplaceTempView("people_view")
    assert ("people_view", "view") in rows(readers.list_session_tables(spark), "name", "type")
    assert load(spark, SourceSpec("s", "local", path=DATA), "nation.parquet").count() == 25


def test_catalog_queries_can_name_a_schema():
    own = readers.columns_query(SourceSpec("s", "postgres"), "t", "it's")
    assert "table_schema = 'it''s'" in own
    assert "owner = 'HR'" in readers.columns_query(SourceSpec("s", "oracle"), "t", "hr")
    assert "database = 'd'" in readers.columns_query(SourceSpec("s", "clickhouse"), "t", "d")
    assert "information_schema.tables" in readers.tables_query(SourceSpec("s", "snowflake"))
    assert "`d`.INFORMATION_SCHEMA.COLUMNS" in readers.columns_query(SourceSpec("s", "bigquery", database="d"), "t")
    with pytest.raises(SpecError):
        readers.tables_query(SourceSpec("s", "bigquery"))


def test_digests_and_footer_counts_of_odd_files(spark, tmp_path):
    """Files longer than a piece, empty ones, odd names, row counts that need no data."""
    import hashlib

    import pyarrow as pa
    import pyarrow.orc as orc
    import pyarrow.parquet as pq

    from assayer.sources import listing

    bodies = {"long.bin": b"abc" * (listing.PIECE_BYTES // 2), "empty.bin": b"", "a b%41 é.txt": b"x"}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    got = {r.name: r.checksum for r in listing.list_files(spark, str(tmp_path), checksum=True).collect()}
    assert got == {name: hashlib.sha256(body).hexdigest() for name, body in bodies.items() if body}

    data = tmp_path / "data"
    data.mkdir()
    table = pa.table({"x": list(range(1000))})
    pq.write_table(table, data / "p 1%20.parquet", row_group_size=100)
    pq.write_table(table.slice(0, 0), data / "none.PARQUET")
    orc.write_table(table.slice(0, 7), data / "o.orc")
    (data / "c.csv").write_text("x\n1\n2\n")
    (data / "j.jsonl").write_text('{"a": 1}')
    counts = listing.row_counts(spark, str(data))
    assert {r.name: r.row_count for r in counts.collect()} == {"p 1%20.parquet": 1000, "none.PARQUET": 0, "o.orc": 7, "c.csv": 2, "j.jsonl": 1}
    only = listing.row_counts(spark, str(data), formats=("parquet",))
    assert only.count() == 2 and "Scan parquet" not in plan_of(only) and "Scan binaryFile" in plan_of(only)


@pytest.fixture
def mixed(spark, tmp_path):
    """The same kind of table as one file, as a folder of parts, deeper, and partitioned; a file without a table."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    root = tmp_path / "x.parquet"  # the root's own name is not a table's
    root.mkdir()
    pq.write_table(pa.table({"x": list(range(5))}), root / "one.parquet")
    spark.range(7).repartition(3).write.parquet(f"{root}/many.parquet")
    spark.range(4).withColumn("k", F.col("id") % 2).write.partitionBy("k").parquet(f"{root}/deep/kept.parquet")
    spark.range(6).repartition(2).write.json(f"{root}/lines.jsonl")
    spark.range(3).repartition(2).write.option("header", "true").csv(f"{root}/t.csv")
    (root / "many.parquet" / "notes.txt").write_text("x")
    return str(root)


def test_table_folders_are_listed_like_files(spark, mixed):
    listed = listing.list_files(spark, mixed, tables=True)
    want = [("kept.parquet", "parquet"), ("lines.jsonl", "jsonl"), ("many.parquet", "parquet"), ("notes.txt", "unknown"), ("one.parquet", "parquet"), ("t.csv", "csv")]
    assert rows(listed, "name", "format") == want
    by_file = listing.list_files(spark, mixed)
    assert listed.agg(F.sum("size")).first() == by_file.agg(F.sum("size")).first()
    paths = {r.name: r.path for r in listed.collect()}
    assert paths["many.parquet"].endswith("x.parquet/many.parquet") and paths["kept.parquet"].endswith("deep/kept.parquet")
    assert rows(listing.list_files(spark, f"{mixed}/one.parquet", tables=True), "name") == [("one.parquet",)]


def _shown_of(name, spark, tmp_path):
    """A query over the given tables, once as files and once with some of them as folders of parts."""
    import os

    from workload import QUERIES
    from workload.base import TABLES

    folders = tmp_path / "data"
    folders.mkdir()
    for t in TABLES:
        if t in ("orders", "documents"):
            spark.read.parquet(f"{SMALL}/{t}.parquet").repartition(3).write.parquet(f"{folders}/{t}.parquet")
        else:
            os.symlink(f"{SMALL}/{t}.parquet", folders / f"{t}.parquet")
    return rows(QUERIES[name](spark, str(folders))), rows(QUERIES[name](spark, SMALL))


@pytest.mark.parametrize("name", ["file_details", "file_listing", "file_row_counts", "file_statistics", "files_size_range", "files_volume"])
def test_file_queries_of_table_folders(name, spark, tmp_path):
    got, want = _shown_of(name, spark, tmp_path)
    assert got == want


def test_rows_and_digests_of_table_folders(spark, mixed):
    import hashlib
    import os

    counts = {r.name: r.row_count for r in listing.row_counts(spark, mixed, tables=True).collect()}
    assert counts == {"one.parquet": 5, "many.parquet": 7, "kept.parquet": 4, "lines.jsonl": 6, "t.csv": 3}
    top = listing.list_files(spark, mixed, recursive=False, pattern="*.parquet", checksum=True, tables=True)
    sums = {r.name: r.checksum for r in top.collect()}
    digest = lambda path: hashlib.sha256(open(path, "rb").read()).hexdigest()
    folder = f"{mixed}/many.parquet"
    parts = "".join(f"{n} {digest(f'{folder}/{n}')}\n" for n in sorted(os.listdir(folder)) if n.startswith("part-"))
    assert sums == {"one.parquet": digest(f"{mixed}/one.parquet"), "many.parquet": hashlib.sha256(parts.encode()).hexdigest()}
    assert rows(listing.row_counts(spark, mixed, recursive=False, formats=("csv",), tables=True), "name", "row_count") == [("t.csv", 3)]
