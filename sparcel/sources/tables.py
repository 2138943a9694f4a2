"""Tables and queries: session catalog, JDBC, warehouse unload."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the state table is never offered as data.
STATE_TABLE = "_sink_state"
JDBC_DRIVERS = {"postgres": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver"}


def flat_text_times(df: DataFrame) -> DataFrame:
    """Timestamps as ISO text; nested columns are dropped."""
    columns = []
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            continue
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            value = F.date_format(value.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        columns.append(value.alias(field.name))
    return df.select(*columns)


def scan_table(spark: SparkSession, table: str) -> DataFrame:
    return flat_text_times(spark.table(table))


def scan_query(spark: SparkSession, query: str) -> DataFrame:
    return flat_text_times(spark.sql(query))


def jdbc_options(
    kind: str, host: str, port: int, database: str, schema: str, table: str, *,
    partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
    partitions: int = 64, fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options of a partitioned read: ranges of a numeric column read side by side."""
    url = {
        "postgres": f"jdbc:postgresql://{host}:{port}/{database}",
        "mysql": f"jdbc:mysql://{host}:{port}/{database}",
    }[kind]
    mark = '"' if kind == "postgres" else "`"
    options = {
        "url": url, "driver": JDBC_DRIVERS[kind], "fetchsize": str(fetch_size),
        "dbtable": f"{mark}{schema}{mark}.{mark}{table}{mark}",
    }
    if partition_column is not None:
        if lower is None or upper is None:
            raise ValueError("a partition column needs its bounds")
        options |= {
            "partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return options


def scan_jdbc(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()


def source_tables(names: Iterable[str]) -> list[str]:
    """Tables offered as stream sets."""
    return [n for n in names if n != STATE_TABLE]


def unload_statement(query: str, location: str, role: str) -> str:
    """Warehouse export to object storage, to be read back from there."""
    escaped = query.replace("'", "''")
    return f"UNLOAD ('{escaped}') TO '{location}' IAM_ROLE '{role}' FORMAT CSV HEADER ALLOWOVERWRITE"


def scan_unloaded(spark: SparkSession, location: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).csv(location, header=True, escape='"')
