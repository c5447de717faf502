"""Files as rows: listing, details, row counts, schemas and statistics."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.orc as orc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.expressions import count_rows, zero_if_null
from assayer.functions.formats import UNKNOWN_FORMAT, file_extension, file_format
from assayer.plans.catalog import describe
from assayer.session import qualified, run_dir
from assayer.sources.readers import SPARK_FORMAT, load
from assayer.specs import SourceSpec

COUNTED_FORMATS = ("parquet", "orc", "csv", "json", "jsonl")
#: Formats whose files state their rows at their end.
FOOTED = ("parquet", "orc")


def _files(spark: SparkSession, path: str, recursive: bool, pattern: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", pattern)
        .load(path)
    )


def list_files(
    spark: SparkSession, path: str, recursive: bool = True, pattern: str = "*", checksum: bool = False, tables: bool = False
) -> DataFrame:
    """Files under a path with name, size, format and modification time. Files of no bytes are not listed.

    File contents are not read, unless a checksum is asked for: files are then streamed by the tasks that
    list them, a piece at a time, whatever their size.

    With ``tables`` a table folder is listed like a file, as one row: ``t.parquet`` has the same name whether
    it is one file or a folder of part files. Its size is that of all parts, its time that of the newest, its
    checksum the digest of the parts' paths in it and their checksums, a line each, in order. ``pattern``
    (``*`` and ``?``) and ``recursive`` then mean the tables, not their parts.
    """
    if tables:
        parts = _placed(list_files(spark, path), qualified(spark, path)).where(F.col("name").rlike(_like(pattern)))
        parts = parts if recursive else parts.where("not deep")
        if checksum:
            parts = parts.mapInArrow(lambda batches: _with_column(batches, _digest, "checksum", pa.string()), f"{_ddl(parts)}, checksum string")
        return _folded(parts)
    files = _files(spark, path, recursive, pattern)
    columns = [
        F.col("path"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        F.col("length").alias("size"),
        file_format(F.col("path")).alias("format"),
        F.col("modificationTime").alias("last_modified"),
    ]
    listed = files.select(*columns)
    if not checksum:
        return listed
    fields = f"{_ddl(listed)}, checksum string"
    return listed.mapInArrow(lambda batches: _with_column(batches, _digest, "checksum", pa.string()), fields)


def _like(pattern: str) -> str:
    """A file name pattern as a regular expression."""
    return "^" + "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in pattern) + "$"


def _placed(files: DataFrame, root: str) -> DataFrame:
    """Files with the path and name of their table, their path in it (empty for a table of one file), and whether the table lies
    deeper than directly under the root.

    A table folder is the outermost folder under the root that is named like a file of the format its parts have;
    JSON lines are often written to files named ``.json``. Other files are tables of their own.
    """
    steps = F.filter(F.split("path", "/"), lambda s: s != "")  # file:/x and file:///x alike
    above = len([s for s in root.split("/") if s])
    kind = lambda f: F.when(f == "jsonl", "json").otherwise(f)
    below = F.slice(F.col("_steps"), above + 1, F.size("_steps"))
    own = F.transform("_below", lambda s: (kind(file_format(s)) == kind(F.col("format"))) & (F.col("format") != UNKNOWN_FORMAT))
    found = files.withColumn("_steps", steps).withColumn("_below", below).withColumn("_at", F.array_position(own, True).cast("int"))
    found = found.withColumn("_at", F.when(F.col("_at") > 0, F.col("_at")).otherwise(F.size("_below")))
    inner = F.array_join(F.slice("_below", F.col("_at") + 1, F.size("_below")), "/")
    folder = (F.col("_at") > 0) & (F.col("_at") < F.size("_below"))  # the root itself may be the one file
    named = F.when(folder, F.get("_below", F.col("_at") - 1)).otherwise(F.col("name"))
    part = F.when(folder, inner).otherwise("")
    # The path as it is listed, without what lies below the folder.
    whole = F.when(folder, F.expr("substring(path, 1, length(path) - length(part) - 1)")).otherwise(F.col("path"))
    placed = found.withColumn("part", part).withColumn("table_path", whole).withColumn("name", named)
    placed = placed.withColumn("format", F.when(folder, file_format(F.col("name"))).otherwise(F.col("format"))).withColumn("deep", F.col("_at") > 1)
    return placed.drop("_steps", "_below", "_at")


def _folded(parts: DataFrame) -> DataFrame:
    """One row per table of placed files."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("part", "checksum"))), lambda p: F.concat(p["part"], F.lit(" "), p["checksum"], F.lit("\n")))
    measures = {
        "size": F.sum("size"),
        "last_modified": F.max("last_modified"),
        "row_count": F.sum("row_count"),
        "checksum": F.when(F.max("part") == "", F.first("checksum")).otherwise(F.sha2(F.array_join(lines, "").cast("binary"), 256)),
    }
    present = [m for m in measures if m in parts.columns]
    rows = parts.groupBy(F.col("table_path").alias("path"), "name", "format").agg(*[measures[m].alias(m) for m in present])
    order = [c for c in ("path", "name", "size", "format", "last_modified", "checksum", "row_count") if c in rows.columns]
    return rows.select(*order)


#: Folders one task lists at most, and at least where there are enough of them.
FOLDERS_PER_TASK = 64
_WALKED = "path string, folder boolean, size bigint, last_modified timestamp"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files and folders that lie directly in the folders of the batches; hidden names are left out."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            files, inner, prefix = _file_system(path)
            found = files.get_file_info(pafs.FileSelector(inner, recursive=False))
            rows = [f for f in found if f.base_name[:1] not in ("_", ".") and (f.type == pafs.FileType.Directory or f.size)]
            times = pa.array([f.mtime_ns // 1000 if f.mtime_ns else None for f in rows], pa.int64()).cast(pa.timestamp("us", "UTC"))
            columns = [
                pa.array([prefix + f.path for f in rows], pa.string()),
                pa.array([f.type == pafs.FileType.Directory for f in rows], pa.bool_()),
                pa.array([f.size for f in rows], pa.int64()),
                times,
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "folder", "size", "last_modified"])


def walk_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``list_files`` of a tree with too many files for the driver: folders are listed by the tasks.

    The tree is walked level by level. The folders of a level are dealt over tasks, what lies in them is
    written to the shared folder, and those of it that are folders are the next level; the driver only
    learns how many there are. One folder is one task's work, and a level at a time is in memory nowhere.
    Hidden names (with ``_`` or ``.`` in front) and files of no bytes are left out, as by ``list_files``. A
    path that does not exist raises. The walk is kept, so it is as of one time; remove it with the run.
    """
    out = run_dir(spark, "walk")
    level = spark.createDataFrame([(qualified(spark, path),)], "path string")
    count, depth = 1, 0
    while count:
        tasks = -(-count // FOLDERS_PER_TASK)
        level.repartition(tasks).mapInArrow(_entries, _WALKED).write.parquet(f"{out}/depth={depth}")
        level = spark.read.schema(_WALKED).parquet(f"{out}/depth={depth}").where("folder").select("path")
        count, depth = level.count(), depth + 1
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    files = spark.read.schema(_WALKED).parquet(out).where("not folder").where(name.rlike(_like(pattern)))
    return files.select("path", name.alias("name"), "size", file_format(F.col("path")).alias("format"), "last_modified")


#: Bytes of a file that are in memory at once while it is digested.
PIECE_BYTES = 4 << 20


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _file_system(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of a path as Spark gives it, the path in there, and what stands before it."""
    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").strip("/"), "file:"
    files, inner = pafs.FileSystem.from_uri(quote(path.rstrip("/"), safe=":/@"))
    return files, inner, path.rstrip("/").removesuffix(inner)


def _opened(path: str) -> pa.NativeFile:
    """A file of any file system that pyarrow knows, by the path Spark gives it."""
    files, inner, _ = _file_system(path)
    return files.open_input_file(inner)


def _digest(path: str, _: str) -> str:
    digest = hashlib.sha256()
    with _opened(path) as file:
        while piece := file.read(PIECE_BYTES):
            digest.update(piece)
    return digest.hexdigest()


def _footer_rows(path: str, kind: str) -> int:
    """Rows of a Parquet or ORC file, from its footer."""
    with _opened(path) as file:
        return pq.ParquetFile(file).metadata.num_rows if kind == "parquet" else orc.ORCFile(file).nrows


def _with_column(batches: Iterator[pa.RecordBatch], of_file: Callable[[str, str], object], name: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, formats = batch.column("path").to_pylist(), batch.column("format").to_pylist()
        values = pa.array([of_file(p, f) for p, f in zip(paths, formats, strict=True)], kind)
        yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


def _any_case(extension: str) -> str:
    return "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)


def row_counts(
    spark: SparkSession,
    path: str,
    recursive: bool = True,
    formats: tuple[str, ...] = COUNTED_FORMATS,
    csv_multiline: bool = False,
    files: DataFrame | None = None,
    tables: bool = False,
) -> DataFrame:
    """Rows of every readable file under a path; with ``tables`` those of every table, see ``list_files``.

    The listing is taken once, or given as ``files`` (see ``walk_files``). Parquet and ORC files are not read: the tasks that list them open their
    footers. Text formats are read without their data columns; files without rows are reported with 0.
    CSV files are split by lines over many tasks; ``csv_multiline`` reads each in one task instead,
    which files with line breaks inside quotes need.
    """
    found = list_files(spark, path, recursive or tables) if files is None else files
    if tables:
        placed = _placed(found.select("path", "name", "format"), qualified(spark, path))
        found = placed if recursive else placed.where("not deep")
    listing = found.where(F.col("format").isin(*formats)).select("path", "name", "format", *(["part", "table_path"] if tables else []))
    by_footer = listing.where(F.col("format").isin(*FOOTED)).mapInArrow(
        lambda batches: _with_column(batches, _footer_rows, "row_count", pa.int64()), f"{_ddl(listing)}, row_count bigint"
    )
    texts = listing.where(~F.col("format").isin(*FOOTED))
    # A handful at most. Parts of a folder named as JSON lines are those, whatever their own names.
    present = sorted((r.extension, r.format) for r in texts.select(file_extension(F.col("path")).alias("extension"), "format").distinct().collect())
    parts = []
    for extension, kind in present:
        reader = (
            spark.read.format(SPARK_FORMAT.get(kind, kind))
            .option("recursiveFileLookup", str(recursive or tables).lower())
            .option("pathGlobFilter", _any_case(extension))
        )
        # A fixed schema keeps text formats from being read once more for inference.
        if kind == "csv":
            reader = reader.schema("first string").option("header", "true").option("multiLine", str(csv_multiline).lower())
        elif kind == "json":
            reader = reader.schema("first string").option("multiLine", "true")
        elif kind == "jsonl":
            reader = reader.schema("first string")
        rows = reader.load(path)
        # The metadata gives the path as a URI, in which a plus is a plus.
        path_of = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        parts.append(rows.groupBy(path_of.alias("path")).agg(count_rows().alias("n")).withColumn("format", F.lit(kind)))
    if not parts:
        return _folded(by_footer) if tables else by_footer
    counts = reduce(DataFrame.union, parts)
    counted = (
        texts.withColumn("_key", _comparable("path"))
        .join(counts.select(_comparable("path").alias("_key"), "format", "n"), ["_key", "format"], "left")
        .select(*listing.columns, zero_if_null(F.col("n")).alias("row_count"))
    )
    every = by_footer.unionByName(counted)
    return _folded(every) if tables else every


def _comparable(column: str):
    """file:/x and file:///x name the same file."""
    return F.regexp_replace(F.col(column), r"^([a-z0-9]+):/+", "$1:/")


def file_schema(spark: SparkSession, path: str) -> DataFrame:
    """Columns of one file or table folder, by its format."""
    return describe(load(spark, SourceSpec("file", "local"), path))


def table_statistics(files: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows, files, bytes and last change per format of a listing."""
    per_format = files.groupBy("format").agg(
        count_rows().alias("file_count"), F.sum("size").alias("size_bytes"), F.max("last_modified").alias("last_modified")
    )
    rows = counts.groupBy("format").agg(F.sum("row_count").alias("row_count"))
    return per_format.join(rows, "format", "left")


def partition_columns(files: DataFrame) -> DataFrame:
    """Partition column names found in folder names (``name=value``), with their value counts."""
    pairs = F.explode(F.regexp_extract_all("path", F.lit(r"/([^/=]+=[^/]+)(?=/)"), 1))
    split = files.select(pairs.alias("p")).select(
        F.substring_index("p", "=", 1).alias("partition_column"), F.substring_index("p", "=", -1).alias("value")
    )
    return split.distinct().groupBy("partition_column").agg(count_rows().alias("value_count"))


def partition_values(files: DataFrame, column: str) -> list[str]:
    """The values of one partition column of a listing, in order: as many as the column has folders."""
    value = F.regexp_extract("path", rf"/{column}=([^/]+)/", 1)
    return [r.v for r in files.select(value.alias("v")).where("v <> ''").distinct().orderBy("v").collect()]
