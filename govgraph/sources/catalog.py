"""Metadata row sets of a relational catalog: from a JSON snapshot or over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The row sets of a catalog snapshot and their columns.
CATALOG_SCHEMA = (
    "catalog_schema_version string, database string, server_version string, collected_at string, "
    "schemas array<struct<schema_name:string>>, "
    "tables array<struct<table_schema:string,table_name:string,table_type:string,row_estimate:bigint>>, "
    "columns array<struct<table_schema:string,table_name:string,column_name:string,"
    "ordinal_position:int,data_type:string,is_nullable:string>>, "
    "primary_keys array<struct<table_schema:string,table_name:string,constraint_name:string,"
    "column_names:array<string>>>, "
    "foreign_keys array<struct<table_schema:string,table_name:string,constraint_name:string,"
    "column_names:array<string>,referenced_schema:string,referenced_table:string,"
    "referenced_columns:array<string>>>"
)
ROW_SETS = ("schemas", "tables", "columns", "primary_keys", "foreign_keys")

_USER_SCHEMAS = (
    "table_schema NOT IN ('pg_catalog', 'information_schema') AND table_schema NOT LIKE 'pg\\_%'"
)
_KEY_USAGE = """
    SELECT k.table_schema, k.table_name, k.constraint_name, c.constraint_type,
           k.column_name, k.ordinal_position, k.position_in_unique_constraint
    FROM information_schema.key_column_usage k
    JOIN information_schema.table_constraints c
      ON c.constraint_schema = k.constraint_schema AND c.constraint_name = k.constraint_name
     AND c.table_name = k.table_name
    WHERE c.constraint_type IN ('PRIMARY KEY', 'FOREIGN KEY', 'UNIQUE') AND k.{user}
"""
# What each row set reads from the server; key columns are grouped in Spark.
JDBC_QUERIES = {
    "schemas": (
        "SELECT schema_name FROM information_schema.schemata WHERE "
        + _USER_SCHEMAS.replace("table_schema", "schema_name")
    ),
    "tables": (
        "SELECT t.table_schema, t.table_name, t.table_type, "
        "CASE WHEN c.reltuples > 0 THEN c.reltuples ELSE 0 END::bigint AS row_estimate "
        "FROM information_schema.tables t "
        "JOIN pg_catalog.pg_class c ON c.oid = "
        "(quote_ident(t.table_schema) || '.' || quote_ident(t.table_name))::regclass "
        "WHERE t.table_type IN ('BASE TABLE', 'VIEW') AND " + _USER_SCHEMAS
    ),
    "columns": (
        "SELECT table_schema, table_name, column_name, ordinal_position, data_type, is_nullable "
        "FROM information_schema.columns WHERE " + _USER_SCHEMAS
    ),
    "key_usage": _KEY_USAGE.format(user=_USER_SCHEMAS),
    "references": (
        "SELECT constraint_schema AS table_schema, constraint_name, "
        "unique_constraint_schema AS referenced_schema, "
        "unique_constraint_name AS referenced_constraint "
        "FROM information_schema.referential_constraints"
    ),
}


def read_catalog(
    spark: SparkSession, json_path: str | None = None, jdbc_options: dict | None = None, queries: dict[str, str] | None = None
) -> dict[str, DataFrame]:
    """The five row sets plus ``header`` (snapshot only), one DataFrame each.

    ``queries`` replaces single entries of ``JDBC_QUERIES`` for servers that need another form of them.
    """
    if json_path is not None:
        snapshot = spark.read.option("multiLine", True).schema(CATALOG_SCHEMA).json(json_path)
        sets = {name: snapshot.select(F.inline(name)) for name in ROW_SETS}
        sets["header"] = snapshot.drop(*ROW_SETS)
        return sets
    if jdbc_options is None:
        raise ValueError("read_catalog needs a snapshot path or JDBC options")

    asked = {**JDBC_QUERIES, **(queries or {})}

    def query(name: str) -> DataFrame:
        rows = spark.read.format("jdbc").options(**jdbc_options).option("query", asked[name]).load()
        # Servers fold the case of names differently.
        return rows.toDF(*[c.lower() for c in rows.columns])

    from govgraph.operators.catalog import key_columns

    usage, references = query("key_usage"), query("references")
    sets = {name: query(name) for name in ("schemas", "tables", "columns")}
    keys = ["table_schema", "table_name", "constraint_name"]
    grouped = key_columns(usage, [*keys, "constraint_type"])
    sets["primary_keys"] = grouped.filter("constraint_type = 'PRIMARY KEY'").drop("constraint_type")
    # The referenced column is the one the foreign key column points at by position.
    targets = usage.filter("constraint_type <> 'FOREIGN KEY'").select(
        F.col("table_schema").alias("referenced_schema"),
        F.col("table_name").alias("referenced_table"),
        F.col("constraint_name").alias("referenced_constraint"),
        F.col("ordinal_position").alias("position_in_unique_constraint"),
        F.col("column_name").alias("referenced_column"),
    )
    pairs = (
        usage.filter("constraint_type = 'FOREIGN KEY'")
        .join(references, ["table_schema", "constraint_name"])
        .join(
            targets,
            ["referenced_schema", "referenced_constraint", "position_in_unique_constraint"],
        )
    )
    sets["foreign_keys"] = key_columns(
        pairs,
        [*keys, "referenced_schema", "referenced_table"],
        extra={"referenced_columns": "referenced_column"},
    )
    return sets
