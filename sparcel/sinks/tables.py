"""Table sinks: staged full loads, JDBC, warehouse copy, topics."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from sparcel.operators.shapes import Types, kafka_value, relational_ddl, relational_shape

# Rows per insert of each target, and the topic batch.
INSERT_ROWS = {"relational": 100, "document": 200, "warehouse": 200}
TOPIC_BATCH = {"records": 100, "milliseconds": 100}


def swap_table(df: DataFrame, table: str, fmt: str = "parquet", location: str | None = None) -> str:
    """Full load of a catalog table: a view ``table`` over the newest load, replaced in one statement once the load is complete.

    Every load is a table of its own, ``table_`` and a unique ending, so readers have the old rows until the view points to
    the new ones, and never none. The load before is dropped afterwards; a load that fails leaves the view alone. ``location`` keeps
    the files outside the warehouse folder; it must be new for every load. Returns the name of the table with the rows.
    """
    spark, loaded = df.sparkSession, f"{table}_{uuid.uuid4().hex[:12]}"
    writer = df.write.format(fmt)
    (writer.option("path", location) if location else writer).saveAsTable(loaded)
    folder, _, name = table.rpartition(".")
    if spark.catalog.tableExists(table) and spark.catalog.getTable(table).tableType != "VIEW":
        spark.sql(f"ALTER TABLE {table} RENAME TO {loaded}_before")  # a plain table from elsewhere becomes the load before
    spark.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM {loaded}")
    for found in spark.catalog.listTables(folder or None, f"{name}_*"):
        if re.fullmatch(rf"{re.escape(name.lower())}_[0-9a-f]{{12}}(?:_before)?", found.name.lower()) and found.name.lower() != loaded.rpartition(".")[2].lower():
            spark.sql(f"DROP TABLE IF EXISTS {f'{folder}.' if folder else ''}{found.name}")
    return loaded


def append_table(df: DataFrame, table: str, fmt: str = "parquet") -> None:
    df.write.format(fmt).mode("append").saveAsTable(table)


def create_table_statement(table: str, types: Types) -> str:
    return f'CREATE TABLE IF NOT EXISTS "{table}" ({relational_ddl(types)})'


def swap_statements(table: str) -> list[str]:
    """What a database runs after the staged load."""
    return [f'DROP TABLE IF EXISTS "{table}"', f'ALTER TABLE "{table}_new" RENAME TO "{table}"']


def jdbc_write_options(url: str, table: str, user: str, append: bool = False) -> dict[str, str]:
    """Options of the writer. Column types follow from the shaped frame, whose Spark types the database's dialect knows;
    a database that wants others gets ``create_table_statement`` first."""
    return {
        "url": url, "user": user, "dbtable": f'"{table}"' if append else f'"{table}_new"',
        "batchsize": str(INSERT_ROWS["relational"]), "isolationLevel": "READ_COMMITTED",
    }


def jdbc_sink(df: DataFrame, types: Types, options: dict[str, str], append: bool = False) -> None:
    """Insert the relational shape; a full load goes to the staged table."""
    shaped = relational_shape(df, types)
    shaped.write.format("jdbc").options(**options).mode("append" if append else "overwrite").save()


def copy_statement(table: str, location: str, role: str) -> str:
    return f"COPY \"{table}\" FROM '{location}' IAM_ROLE '{role}' FORMAT AS CSV IGNOREHEADER 1 TIMEFORMAT 'auto'"


def warehouse_stage(df: DataFrame, types: Types, location: str) -> None:
    """Quoted CSV on object storage for ``copy_statement``."""
    relational_shape(df, types).write.mode("overwrite").csv(location, header=True, quoteAll=True, escape='"')


def kafka_options(servers: str, security: str | None = None) -> dict[str, str]:
    options = {
        "kafka.bootstrap.servers": servers,
        "kafka.batch.size": str(TOPIC_BATCH["records"] * 1024),
        "kafka.linger.ms": str(TOPIC_BATCH["milliseconds"]),
    }
    return options | ({"kafka.security.protocol": security} if security else {})


def kafka_sink(df: DataFrame, topic: str, schema_title: str, servers: str) -> None:
    """Needs the Kafka connector package on the cluster."""
    kafka_value(df, topic, schema_title).write.format("kafka").options(**kafka_options(servers)).save()


def table_exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)
