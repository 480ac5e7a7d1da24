"""Profile, evidence and policy checks of relational catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govgraph.functions.digest import canonical_sha256, evidence_id
from govgraph.functions.paths import column_locator, table_locator
from govgraph.operators.violations import finding_rows, findings, union_all

# Server data types and the logical type each stands for.
LOGICAL_TYPE_MAP = {
    "array": "array",
    "bigint": "integer",
    "boolean": "boolean",
    "bytea": "binary",
    "character": "string",
    "character varying": "string",
    "date": "date",
    "double precision": "number",
    "integer": "integer",
    "json": "object",
    "jsonb": "object",
    "numeric": "number",
    "real": "number",
    "smallint": "integer",
    "text": "string",
    "time without time zone": "string",
    "timestamp with time zone": "datetime",
    "timestamp without time zone": "datetime",
    "uuid": "string",
}
# Keys that could carry row content.
FORBIDDEN_KEYS = (
    "data",
    "example",
    "examples",
    "histogram_bounds",
    "most_common_vals",
    "preview",
    "record",
    "records",
    "row",
    "rows",
    "sample",
    "sample_rows",
    "sample_values",
    "samples",
    "tuple",
    "tuples",
    "value",
    "values",
)
# Key sets and limits of a catalog snapshot.
ENTRY_KEYS = {
    "schemas": ("schema_name",),
    "tables": ("table_schema", "table_name", "table_type", "row_estimate"),
    "columns": (
        "table_schema",
        "table_name",
        "column_name",
        "ordinal_position",
        "data_type",
        "is_nullable",
    ),
    "primary_keys": ("table_schema", "table_name", "constraint_name", "column_names"),
    "foreign_keys": (
        "table_schema",
        "table_name",
        "constraint_name",
        "column_names",
        "referenced_schema",
        "referenced_table",
        "referenced_columns",
    ),
}
HEADER_KEYS = ("catalog_schema_version", "database", "server_version", "collected_at")
TABLE_TYPES = ("BASE TABLE", "VIEW")

EXTRACTOR_NAME = "govgraph-catalog"
CATALOG_EXTRACTOR_VERSION = "1.0.0"
TABLE_KEY = ["table_schema", "table_name"]


def logical_type(data_type: Column) -> Column:
    """The logical type of a server data type; unknown types are strings."""
    folded = F.lower(data_type)
    known = F.create_map(*[F.lit(x) for pair in LOGICAL_TYPE_MAP.items() for x in pair])
    return F.when(folded.endswith("[]"), "array").otherwise(
        F.coalesce(F.try_element_at(known, folded), F.lit("string"))
    )


def key_columns(
    usage: DataFrame,
    keys: list[str],
    column: str = "column_name",
    position: str = "ordinal_position",
    extra: dict[str, str] | None = None,
) -> DataFrame:
    """Ordered column list per constraint, from one row per column.

    Repeated rows are dropped first; a constraint then has one entry per position,
    which the server bounds, so the list stays short.
    """
    pulled = {"column_names": column} | (extra or {})
    picks = [F.min(c).alias(c) for c in pulled.values()]
    single = usage.groupBy(*keys, position).agg(*picks)
    entry = F.struct(position, *pulled.values())
    grouped = single.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
    # A field of an array of structs is the array of that field.
    return grouped.select(*keys, *[F.col(f"_entries.{c}").alias(n) for n, c in pulled.items()])


def catalog_tables(sets: dict[str, DataFrame], database: str) -> DataFrame:
    """One row per table: locator, column count, primary key and foreign key count."""
    counts = sets["columns"].groupBy(*TABLE_KEY).agg(F.count(F.lit(1)).alias("column_count"))
    # The last constraint name wins should a table list several primary keys.
    primary = sets["primary_keys"].groupBy(*TABLE_KEY).agg(
        F.max_by(F.struct("constraint_name", "column_names"), "constraint_name").alias("primary_key")
    )
    foreign = sets["foreign_keys"].groupBy(*TABLE_KEY).agg(
        F.count(F.lit(1)).alias("foreign_key_count")
    )
    tables = sets["tables"].join(counts, TABLE_KEY, "left").join(primary, TABLE_KEY, "left")
    return tables.join(foreign, TABLE_KEY, "left").select(
        F.concat_ws(".", *TABLE_KEY).alias("table_id"),
        *TABLE_KEY,
        "table_type",
        "row_estimate",
        table_locator(F.lit(database), F.col("table_schema"), F.col("table_name")).alias("locator"),
        F.coalesce("column_count", F.lit(0)).alias("column_count"),
        "primary_key",
        F.coalesce("foreign_key_count", F.lit(0)).alias("foreign_key_count"),
    )


def catalog_columns(columns: DataFrame, database: str) -> DataFrame:
    """One row per column with logical type, nullability and locator."""
    base = table_locator(F.lit(database), F.col("table_schema"), F.col("table_name"))
    return columns.select(
        F.concat_ws(".", *TABLE_KEY).alias("table_id"),
        "column_name",
        "ordinal_position",
        "data_type",
        logical_type(F.col("data_type")).alias("logical_type"),
        (F.col("is_nullable") == "YES").alias("nullable"),
        column_locator(base, F.col("column_name")).alias("locator"),
    )


def catalog_statistics(sets: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of entries of every row set."""
    counts = union_all([
        sets[name].agg(F.count(F.lit(1)).alias("n")).withColumn("row_set", F.lit(name))
        for name in ENTRY_KEYS
    ])
    return counts.agg(*[
        F.max(F.when(F.col("row_set") == name, F.col("n"))).alias(f"{name}_count") for name in ENTRY_KEYS
    ])


def catalog_profile(sets: dict[str, DataFrame], database: str) -> dict[str, DataFrame]:
    """Tables, columns, foreign keys and statistics of one catalog, as flat frames."""
    foreign = sets["foreign_keys"].select(
        F.concat_ws(".", *TABLE_KEY).alias("table_id"),
        "constraint_name",
        "column_names",
        F.concat_ws(".", "referenced_schema", "referenced_table").alias("referenced_table"),
        "referenced_columns",
    )
    return {
        "tables": catalog_tables(sets, database),
        "columns": catalog_columns(sets["columns"], database),
        "foreign_keys": foreign,
        "statistics": catalog_statistics(sets),
    }


def catalog_evidence(
    profile: dict[str, DataFrame],
    *,
    source_id: str,
    tenant_id: str,
    catalog_locator: str,
    catalog_sha256: str,
    byte_count: int,
    observed_at: str,
    profile_prefix: str,
) -> DataFrame:
    """Evidence rows: the snapshot, its statistics, each table and each foreign key."""
    snapshot = f"{source_id}@sha256:{catalog_sha256}"
    stats = profile["statistics"]

    def rows(df, locator, pointer, claim: dict[str, Column], tags: list[str], sha=None):
        struct = F.struct(*[claim[k].alias(k) for k in sorted(claim)])
        return df.select(
            evidence_id(F.lit(source_id), F.lit(snapshot), locator, pointer).alias("evidence_id"),
            F.lit(tenant_id).alias("tenant_id"),
            F.lit(source_id).alias("source_id"),
            F.lit(snapshot).alias("snapshot_id"),
            locator.alias("locator"),
            pointer.alias("pointer"),
            F.to_json(struct, {"ignoreNullFields": "false"}).alias("claim"),
            (canonical_sha256(struct) if sha is None else F.lit(sha)).alias("content_sha256"),
            F.lit("INTERNAL").alias("classification"),
            F.lit(observed_at).alias("observed_at"),
            F.lit(EXTRACTOR_NAME).alias("extractor_name"),
            F.lit(CATALOG_EXTRACTOR_VERSION).alias("extractor_version"),
            F.array(*[F.lit(t) for t in tags]).alias("policy_tags"),
        )

    # The referenced table names its own locator, so it is found by table id.
    with_locator = profile["foreign_keys"].join(
        profile["tables"].select("table_id", F.col("locator").alias("table_locator")), "table_id"
    )
    counted = {"tableCount": F.col("tables_count"), "columnCount": F.col("columns_count")}
    return union_all([
        rows(
            stats,
            F.lit(catalog_locator),
            F.lit("catalog-snapshot"),
            counted | {"byteCount": F.lit(byte_count), "schemaCount": F.col("schemas_count")},
            ["metadata-only", "read-only", "snapshot"],
            catalog_sha256,
        ),
        rows(
            stats,
            F.lit(f"{profile_prefix}/profile.json#/statistics"),
            F.lit("/statistics"),
            {c: F.col(c) for c in stats.columns},
            ["bounded-profile", "metadata-only", "read-only"],
        ),
        rows(
            profile["tables"],
            F.col("locator"),
            F.concat(F.lit("/tables/"), "table_id"),
            {
                "tableType": F.col("table_type"),
                "rowEstimate": F.col("row_estimate"),
                "columnCount": F.col("column_count"),
                "primaryKey": F.col("primary_key"),
            },
            ["metadata-only", "read-only"],
        ),
        rows(
            with_locator,
            F.concat("table_locator", F.lit("#constraint="), "constraint_name"),
            F.concat(F.lit("/tables/"), "table_id", F.lit("/foreignKeys")),
            {
                "constraintName": F.col("constraint_name"),
                "columns": F.col("column_names"),
                "referencedTable": F.col("referenced_table"),
                "referencedColumns": F.col("referenced_columns"),
            },
            ["metadata-only", "read-only", "relationship-profile"],
        ),
    ])


def forbidden_key_violations(documents: DataFrame, text: str = "value", key: str = "path") -> DataFrame:
    """Keys that could carry row content, at any depth of JSON text.

    Keys are read from the canonical text, where a key is always a string followed
    directly by a colon; string values can hold no bare quote.
    """
    canonical = F.to_json(F.try_parse_json(F.col(text)))
    keys = F.regexp_extract_all(canonical, F.lit(r'(?:[{,])"((?:[^"\\]++|\\.)*+)":'), 1)
    hits = documents.select(F.col(key).alias("_key"), F.explode(keys).alias("_name")).filter(
        F.lower("_name").isin(*FORBIDDEN_KEYS)
    )
    return findings(hits, "FORBIDDEN_KEY", F.col("_key"), F.col("_name"))


def shape_violations(documents: DataFrame, text: str = "value", key: str = "path") -> DataFrame:
    """Unknown and missing keys on the top level and in the entries of each row set."""
    doc = F.col(text)
    wanted_top = F.array(*[F.lit(k) for k in (*HEADER_KEYS, *ENTRY_KEYS)])
    frames = []
    top = F.json_object_keys(doc)
    for rule, names in (
        ("UNKNOWN_KEY", F.array_except(top, wanted_top)),
        ("MISSING_KEY", F.array_except(wanted_top, top)),
    ):
        hits = documents.select(F.col(key).alias("_key"), F.explode(names).alias("_name"))
        frames.append(findings(hits, rule, F.col("_key"), F.col("_name")))
    for row_set, fields in ENTRY_KEYS.items():
        wanted = F.array(*[F.lit(k) for k in fields])
        entries = documents.select(
            F.col(key).alias("_key"),
            F.explode(
                F.from_json(F.get_json_object(doc, f"$.{row_set}"), "array<string>")
            ).alias("_entry"),
        )
        found = F.json_object_keys("_entry")
        for rule, names in (
            ("UNKNOWN_KEY", F.array_except(found, wanted)),
            ("MISSING_KEY", F.array_except(wanted, found)),
        ):
            hits = entries.select("_key", F.explode(names).alias("_name"))
            frames.append(
                findings(hits, rule, F.col("_key"), F.concat(F.lit(f"{row_set}."), F.col("_name")))
            )
    return union_all(frames)


def reference_violations(sets: dict[str, DataFrame]) -> DataFrame:
    """Duplicates, dangling references and unequal key lengths between the row sets."""
    tables, columns = sets["tables"], sets["columns"]
    column_key = [*TABLE_KEY, "column_name"]
    schemas = sets["schemas"].select(F.col("schema_name").alias("table_schema")).distinct()
    frames = []
    for rule, df, keys in (
        ("DUPLICATE_SCHEMA", sets["schemas"], ["schema_name"]),
        ("DUPLICATE_TABLE", tables, TABLE_KEY),
        ("DUPLICATE_COLUMN", columns, column_key),
    ):
        repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        frames.append(findings(repeated, rule, F.concat_ws(".", *keys)))
    frames.append(
        findings(
            tables.join(schemas, "table_schema", "left_anti"),
            "TABLE_WITHOUT_SCHEMA",
            F.concat_ws(".", *TABLE_KEY),
        )
    )
    known_tables = tables.select(*TABLE_KEY).distinct()
    frames.append(
        findings(
            columns.join(known_tables, TABLE_KEY, "left_anti"),
            "COLUMN_WITHOUT_TABLE",
            F.concat_ws(".", *column_key),
        )
    )
    known = columns.select(*column_key).distinct()
    for rule, df, schema, table, names in (
        ("PRIMARY_KEY_COLUMN", sets["primary_keys"], "table_schema", "table_name", "column_names"),
        ("FOREIGN_KEY_COLUMN", sets["foreign_keys"], "table_schema", "table_name", "column_names"),
        (
            "REFERENCED_COLUMN",
            sets["foreign_keys"],
            "referenced_schema",
            "referenced_table",
            "referenced_columns",
        ),
    ):
        used = df.select(
            F.col(schema).alias("table_schema"),
            F.col(table).alias("table_name"),
            F.explode(names).alias("column_name"),
        )
        frames.append(
            findings(used.join(known, column_key, "left_anti"), rule, F.concat_ws(".", *column_key))
        )
    unequal = sets["foreign_keys"].filter(F.size("column_names") != F.size("referenced_columns"))
    frames.append(
        findings(unequal, "FOREIGN_KEY_ARITY", F.concat_ws(".", *TABLE_KEY, "constraint_name"))
    )
    return union_all(frames)


def domain_violations(sets: dict[str, DataFrame], limits: dict[str, int] | None = None) -> DataFrame:
    """Empty names, unknown kinds, bad numbers and row sets above their limit."""

    def named(*cols: str) -> Column:
        ok = F.lit(True)
        for c in cols:
            ok = ok & (F.trim(F.col(c)) != "")
        return ok

    table_id = F.concat_ws(".", *TABLE_KEY)
    frames = [
        finding_rows(sets["schemas"], F.col("schema_name"), [("EMPTY_NAME", named("schema_name"))]),
        finding_rows(
            sets["tables"],
            table_id,
            [
                ("EMPTY_NAME", named(*TABLE_KEY)),
                ("TABLE_TYPE", F.col("table_type").isin(*TABLE_TYPES)),
                ("ROW_ESTIMATE", F.col("row_estimate") >= 0),
            ],
        ),
        finding_rows(
            sets["columns"],
            F.concat_ws(".", *TABLE_KEY, "column_name"),
            [
                ("EMPTY_NAME", named(*TABLE_KEY, "column_name", "data_type")),
                ("ORDINAL_POSITION", F.col("ordinal_position") >= 1),
                ("IS_NULLABLE", F.col("is_nullable").isin("YES", "NO")),
            ],
        ),
    ]
    for name in ("primary_keys", "foreign_keys"):
        lists = ["column_names"] + (["referenced_columns"] if name == "foreign_keys" else [])
        filled = named("table_schema", "table_name", "constraint_name")
        for c in lists:
            filled = filled & (F.size(c) >= 1) & F.forall(c, lambda x: F.trim(x) != "")
        frames.append(
            finding_rows(
                sets[name],
                F.concat_ws(".", *TABLE_KEY, "constraint_name"),
                [("EMPTY_NAME", filled)],
            )
        )
    for name, limit in (limits or {}).items():
        over = sets[name].agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
        frames.append(findings(over, "LIMIT_EXCEEDED", F.lit(name), F.col("_n")))
    return union_all(frames)


def catalog_policy_violations(
    sets: dict[str, DataFrame], documents: DataFrame | None = None, limits: dict[str, int] | None = None
) -> DataFrame:
    """All catalog findings; ``documents`` adds the checks on the raw JSON text.

    ``limits`` gives numbers of schemas, tables and columns that are too many, where there are such.
    """
    frames = [domain_violations(sets, limits), reference_violations(sets)]
    if documents is not None:
        frames += [forbidden_key_violations(documents), shape_violations(documents)]
    return union_all(frames)
