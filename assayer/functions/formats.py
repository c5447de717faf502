"""Value formats and file formats, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.specs import SpecError

# The pattern a value of each named format matches.
VALUE_PATTERNS = {
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "ipv4": r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$",
    "url": r"^https?://[^/?#\s]+[^\s]*$",
    "integer": r"^[+-]?[0-9]+$",
    "decimal": r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$",
}
DATE_FORMAT = "yyyy-MM-dd"
DATETIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
VALUE_FORMATS = (*VALUE_PATTERNS, "date", "datetime")

# File name extension to file format.
FILE_FORMATS = {
    "csv": "csv",
    "parquet": "parquet",
    "avro": "avro",
    "json": "json",
    "jsonl": "jsonl",
    "ndjson": "jsonl",
    "orc": "orc",
}
UNKNOWN_FORMAT = "unknown"


def matches_format(col: Column, name: str) -> Column:
    text = col.cast("string")
    if name in VALUE_PATTERNS:
        return text.rlike(VALUE_PATTERNS[name])
    if name == "date":
        return F.try_to_date(text, DATE_FORMAT).isNotNull()
    if name == "datetime":
        tries = [F.try_to_timestamp(text, F.lit(f)) for f in DATETIME_FORMATS]
        return F.coalesce(*tries).isNotNull()
    raise SpecError(f"unknown format {name!r}; expected one of {', '.join(VALUE_FORMATS)}")


def file_extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"\.([^./\\]+)$", 1)


def file_format(path: Column) -> Column:
    """Format of the file a path names, by extension and regardless of case."""
    ext = file_extension(path)
    expr = F.lit(UNKNOWN_FORMAT)
    for suffix, fmt in FILE_FORMATS.items():
        expr = F.when(ext == suffix, fmt).otherwise(expr)
    return expr


def format_of(path: str) -> str:
    """The same rule for one path, used when picking a reader."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    return FILE_FORMATS.get(name.rsplit(".", 1)[-1], UNKNOWN_FORMAT) if "." in name else UNKNOWN_FORMAT
