"""Data sources by type: files, lakehouse tables, JDBC databases and warehouses."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from assayer.functions.formats import UNKNOWN_FORMAT, format_of
from assayer.specs import SourceSpec, SpecError

STORAGE_TYPES = ("local", "s3", "gcs", "azure_blob", "hdfs")
LAKEHOUSE_FORMATS = {"deltalake": "delta", "iceberg": "iceberg", "hudi": "hudi"}

# Driver class and default port of each database reached over JDBC.
JDBC_DRIVERS = {
    "postgres": ("org.postgresql.Driver", 5432),
    "mysql": ("com.mysql.cj.jdbc.Driver", 3306),
    "sqlserver": ("com.microsoft.sqlserver.jdbc.SQLServerDriver", 1433),
    "oracle": ("oracle.jdbc.OracleDriver", 1521),
    "databricks": ("com.databricks.client.jdbc.Driver", 443),
    "trino": ("io.trino.jdbc.TrinoDriver", 8080),
    "duckdb": ("org.duckdb.DuckDBDriver", None),
    "clickhouse": ("com.clickhouse.jdbc.ClickHouseDriver", 8123),
}
CONNECTOR_TYPES = ("snowflake", "bigquery")
SOURCE_TYPES = (*STORAGE_TYPES, *LAKEHOUSE_FORMATS, *JDBC_DRIVERS, *CONNECTOR_TYPES)

FILE_OPTIONS = {
    "csv": {"header": "true", "inferSchema": "true"},
    "json": {"multiLine": "true"},
    "jsonl": {},
    "parquet": {},
    "orc": {},
    "avro": {},
}
SPARK_FORMAT = {"jsonl": "json"}


@dataclass(frozen=True)
class ReadPlan:
    """Everything ``spark.read`` needs: format, options and, for files, a path."""

    format: str
    options: dict[str, str] = field(default_factory=dict)
    path: str | None = None


def jdbc_url(source: SourceSpec) -> str:
    if source.connection_url:
        return source.connection_url
    _, default_port = JDBC_DRIVERS[source.type]
    host = f"{source.host}:{source.port or default_port}" if default_port else source.host
    if source.type == "postgres":
        return f"jdbc:postgresql://{host}/{source.database}" + (f"?sslmode={source.ssl_mode}" if source.ssl_mode else "")
    if source.type == "mysql":
        return f"jdbc:mysql://{host}/{source.database}"
    if source.type == "sqlserver":
        return f"jdbc:sqlserver://{host};databaseName={source.database}"
    if source.type == "oracle":
        return f"jdbc:oracle:thin:@//{host}/{source.database}"
    if source.type == "databricks":
        return f"jdbc:databricks://{host};httpPath={source.http_path}"
    if source.type == "trino":
        return f"jdbc:trino://{host}/{source.catalog}" + (f"/{source.schema}" if source.schema else "")
    if source.type == "duckdb":
        return f"jdbc:duckdb:{source.database}"
    return f"jdbc:clickhouse://{host}/{source.database}"


def _qualified(source: SourceSpec, table: str) -> str:
    return f"{source.schema}.{table}" if source.schema and "." not in table else table


def jdbc_options(source: SourceSpec, table: str = "", query: str = "") -> dict[str, str]:
    """Options of a JDBC read.

    ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` in the
    source's options split the read over tasks; without them one task reads the table.
    """
    options = {"url": jdbc_url(source), "driver": JDBC_DRIVERS[source.type][0], "fetchsize": "10000"}
    if source.type == "databricks" and source.token:
        options |= {"user": "token", "password": source.token}
    elif source.username:
        options |= {"user": source.username, "password": source.password}
    if query:
        options["query"] = query
    else:
        options["dbtable"] = _qualified(source, table)
    partitioned = {"partitionColumn", "lowerBound", "upperBound", "numPartitions"}
    given = partitioned & set(source.options)
    if given and given != partitioned:
        raise SpecError(f"a partitioned read needs all of {sorted(partitioned)}")
    own = {k: v for k, v in source.options.items() if not (query and k in partitioned)}
    return {**options, **own}


def storage_root(source: SourceSpec) -> str:
    """The root path of a file source, with the scheme of its store."""
    sub = source.path.strip("/")
    if source.type == "local":
        return source.path.rstrip("/")
    if source.type == "hdfs":
        if source.host:
            return f"hdfs://{source.host}:{source.port or 8020}/{sub}"
        return f"hdfs:///{sub}"
    if source.type == "s3":
        return f"s3a://{source.bucket}/{sub}".rstrip("/")
    if source.type == "gcs":
        return f"gs://{source.bucket}/{sub}".rstrip("/")
    return f"abfss://{source.bucket}@{source.account}.dfs.core.windows.net/{sub}".rstrip("/")


def storage_options(source: SourceSpec) -> dict[str, str]:
    """File system settings a reader passes on to the store."""
    options: dict[str, str] = {}
    if source.type == "s3":
        if source.access_key:
            options |= {"fs.s3a.access.key": source.access_key, "fs.s3a.secret.key": source.secret_key}
        if source.endpoint:
            options |= {"fs.s3a.endpoint": source.endpoint, "fs.s3a.path.style.access": "true"}
        if source.region:
            options["fs.s3a.endpoint.region"] = source.region
    elif source.type == "gcs" and source.key_file:
        options["google.cloud.auth.service.account.json.keyfile"] = source.key_file
    elif source.type == "azure_blob" and source.secret_key:
        options[f"fs.azure.account.key.{source.account}.dfs.core.windows.net"] = source.secret_key
    return options


def read_plan(source: SourceSpec, table: str) -> ReadPlan:
    """How to read a table of a source; pure, so it can be checked without the store."""
    if source.type in STORAGE_TYPES:
        root = storage_root(source)
        path = table if "://" in table or table.startswith("/") else f"{root}/{table}" if table else root
        kind = source.format or format_of(path)
        if kind == UNKNOWN_FORMAT:
            raise SpecError(f"unsupported file format: {path}")
        if kind not in FILE_OPTIONS:
            raise SpecError(f"unsupported file format: {kind}")
        options = {**storage_options(source), **FILE_OPTIONS[kind], **source.options}
        return ReadPlan(SPARK_FORMAT.get(kind, kind), options, path)
    if source.type in LAKEHOUSE_FORMATS:
        kind = LAKEHOUSE_FORMATS[source.type]
        if source.type == "iceberg" and source.catalog:
            return ReadPlan(kind, dict(source.options), f"{source.catalog}.{_qualified(source, table)}")
        root = source.path.rstrip("/")
        return ReadPlan(kind, dict(source.options), f"{root}/{table}" if table else root)
    if source.type in JDBC_DRIVERS:
        return ReadPlan("jdbc", jdbc_options(source, table))
    if source.type == "snowflake":
        options = {
            "sfURL": source.connection_url or f"{source.account}.snowflakecomputing.com",
            "sfUser": source.username,
            "sfPassword": source.password,
            "sfDatabase": source.database,
            "sfSchema": source.schema,
            "sfWarehouse": source.warehouse,
            "dbtable": table,
            **source.options,
        }
        if source.private_key:
            options["pem_private_key"] = source.private_key
        return ReadPlan("snowflake", {k: v for k, v in options.items() if v})
    if source.type == "bigquery":
        options = {
            "table": f"{source.project_id}.{source.dataset}.{table}",
            "parentProject": source.project_id,
            "credentialsFile": source.key_file,
            **source.options,
        }
        return ReadPlan("bigquery", {k: v for k, v in options.items() if v})
    raise SpecError(f"unsupported datasource type: {source.type}")


def load(spark: SparkSession, source: SourceSpec, table: str = "", schema=None) -> DataFrame:
    """A table of a source as a lazy DataFrame. A given schema saves the inference pass."""
    plan = read_plan(source, table)
    options = dict(plan.options)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
        options.pop("inferSchema", None)
    reader = reader.format(plan.format).options(**options)
    try:
        return reader.load(plan.path) if plan.path else reader.load()
    except PySparkException as exc:
        if exc.getCondition() in ("DATA_SOURCE_NOT_FOUND", "UNKNOWN_DATA_SOURCE") or "FAILED_TO_FIND_DATA_SOURCE" in str(exc) or "AVRO_NOT_LOADED" in str(exc) or plan.format == "avro":
            raise SpecError(f"the '{plan.format}' data source is not on the classpath") from exc
        raise


# --------------------------------------------------------------------------- database catalogs

_STANDARD = ("postgres", "mysql", "sqlserver", "trino", "duckdb", "databricks")


def tables_query(source: SourceSpec) -> str:
    """Query for (table_schema, table_name, table_type) of a database."""
    if source.type == "oracle":
        return "SELECT owner AS table_schema, table_name, 'BASE TABLE' AS table_type FROM all_tables"
    if source.type == "clickhouse":
        return "SELECT database AS table_schema, name AS table_name, engine AS table_type FROM system.tables WHERE database = currentDatabase()"
    if source.type in _STANDARD:
        hidden = "'pg_catalog', 'information_schema', 'mysql', 'performance_schema', 'sys'"
        return (
            "SELECT table_schema, table_name, table_type FROM information_schema.tables "
            f"WHERE table_schema NOT IN ({hidden})"
        )
    if source.type == "snowflake":
        return "SELECT table_schema, table_name, table_type FROM information_schema.tables WHERE table_schema <> 'INFORMATION_SCHEMA'"
    if source.type == "bigquery":
        return f"SELECT table_schema, table_name, table_type FROM `{_dataset(source)}`.INFORMATION_SCHEMA.TABLES"
    raise SpecError(f"no catalog query for {source.type}")


def _dataset(source: SourceSpec) -> str:
    if not source.database:
        raise SpecError("bigquery catalogs belong to a dataset: set database")
    return source.database.replace("`", "")


def columns_query(source: SourceSpec, table: str, schema: str = "") -> str:
    """Query for the columns of a table, in their order.

    Without a schema, equally named tables of all schemas answer; give one wherever that can happen.
    """
    name, owner = table.replace("'", "''"), schema.replace("'", "''")
    within = f" AND table_schema = '{owner}'" if owner else ""
    if source.type == "snowflake":
        return (
            "SELECT column_name, data_type, is_nullable, column_default, ordinal_position FROM information_schema.columns "
            f"WHERE table_name = '{name}'{within} ORDER BY ordinal_position"
        )
    if source.type == "bigquery":
        return (
            "SELECT column_name, data_type, is_nullable, column_default, ordinal_position "
            f"FROM `{owner.replace('`', '') or _dataset(source)}`.INFORMATION_SCHEMA.COLUMNS WHERE table_name = '{name}'"
        )
    if source.type == "oracle":
        return (
            "SELECT column_name, data_type, nullable AS is_nullable, data_default AS column_default, column_id AS ordinal_position "
            f"FROM all_tab_columns WHERE table_name = '{name.upper()}'" + (f" AND owner = '{owner.upper()}'" if owner else "")
        )
    if source.type == "clickhouse":
        return (
            "SELECT name AS column_name, type AS data_type, default_expression AS column_default, position AS ordinal_position "
            f"FROM system.columns WHERE database = " + (f"'{owner}'" if owner else "currentDatabase()") + f" AND table = '{name}'"
        )
    if source.type in _STANDARD:
        extra = ", column_key" if source.type == "mysql" else ""
        return (
            f"SELECT column_name, data_type, is_nullable, column_default, ordinal_position{extra} "
            f"FROM information_schema.columns WHERE table_name = '{name}'{within}"
        )
    raise SpecError(f"no catalog query for {source.type}")


def list_database_tables(spark: SparkSession, source: SourceSpec) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(source, query=tables_query(source))).load()


def list_database_columns(spark: SparkSession, source: SourceSpec, table: str, schema: str = "") -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(source, query=columns_query(source, table, schema))).load()


def list_session_tables(spark: SparkSession) -> DataFrame:
    """Tables and temporary views the session knows."""
    return spark.sql("SHOW TABLES").selectExpr(
        "namespace AS table_schema", "tableName AS name", "CASE WHEN isTemporary THEN 'view' ELSE 'table' END AS type"
    )
