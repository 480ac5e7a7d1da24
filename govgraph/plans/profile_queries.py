"""Registered queries: profiles of tables and objects, catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from govgraph.operators import catalog, profiling
from govgraph.operators.ingest import media_type
from govgraph.plans.registry import registered, table
from govgraph.session import scratch_path

# Customers with empty cells: some balances are null, some segments are empty.
_GAPS = """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
    CASE WHEN c_custkey % 5 = 2 THEN NULL ELSE CAST(CAST(c_acctbal AS DECIMAL(38,2)) AS VARCHAR) END AS c_acctbal,
    CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer"""


def customers_with_gaps(spark, sf):
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        key.cast("string").alias("c_custkey"),
        "c_name",
        F.col("c_nationkey").cast("string").alias("c_nationkey"),
        F.when(key % 5 != 2, F.col("c_acctbal").cast("decimal(38,2)").cast("string")).alias("c_acctbal"),
        F.when(key % 4 == 1, "").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
    )


@registered(
    "object_profile",
    """SELECT doc_id, sha256(body) AS sha256, strlen(body) AS byte_size, mt AS media_type,
      CASE kind WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 2 END AS record_count,
      CASE kind WHEN 0 THEN 'a"b,doc id' WHEN 1 THEN 'a,z' WHEN 2 THEN 'a,b' ELSE '' END AS column_names, kind <> 5 AS supported
    FROM (SELECT doc_id, doc_id % 6 AS kind,
      CASE doc_id % 6 WHEN 0 THEN 'text/csv' WHEN 1 THEN 'application/json' WHEN 2 THEN 'application/x-ndjson' WHEN 3 THEN 'text/plain' WHEN 4 THEN 'application/pdf' ELSE 'image/png' END AS mt,
      CASE doc_id % 6 WHEN 0 THEN '"a""b", doc id ' || chr(10) || '"x' || chr(10) || 'y",' || doc_id || chr(10) || ' ' || chr(10) || lang || ',"' || replace(text, '"', '') || '"' || chr(10)
        WHEN 1 THEN '[{"z":' || doc_id || ',"a":"' || lang || '"},{"b":1}]'
        WHEN 2 THEN '{"b":' || doc_id || ',"a":1}' || chr(10) || chr(10) || '{"c":2}' || chr(13) || chr(10) || '[3]'
        WHEN 3 THEN lang || chr(10) || '   ' || chr(10) || source ELSE text END AS body FROM documents)""",
)
def _(spark, sf):
    key = F.col("doc_id")
    kind = key % 6
    types = ["text/csv", "application/json", "application/x-ndjson", "text/plain", "application/pdf", "image/png"]
    body = (
        F.when(
            kind == 0,
            F.concat(
                F.lit('"a""b", doc id \n"x\ny",'), key, F.lit("\n \n"), "lang", F.lit(',"'), F.replace("text", F.lit('"'), F.lit("")), F.lit('"\n')
            ),
        )
        .when(kind == 1, F.concat(F.lit('[{"z":'), key, F.lit(',"a":"'), "lang", F.lit('"},{"b":1}]')))
        .when(kind == 2, F.concat(F.lit('{"b":'), key, F.lit(',"a":1}\n\n{"c":2}\r\n[3]')))
        .when(kind == 3, F.concat("lang", F.lit("\n   \n"), "source"))
        .otherwise(F.col("text"))
    )
    objects = table(spark, sf, "documents").select(
        "doc_id",
        F.get(F.array(*[F.lit(t) for t in types]), kind.cast("int")).alias("content_type"),
        F.encode(body, "UTF-8").alias("content"),
    )
    profile = profiling.object_profile(objects).withColumn("column_names", F.array_join("column_names", ","))
    return profile.drop("content_type", "extractor_version")


@registered(
    "column_names",
    """SELECT event_id, 'event,k,props' AS names FROM events""",
)
def _(spark, sf):
    record = F.concat(F.lit('{" props ":'), "props", F.lit(',"":1,"k":2,"event":"'), "event_type", F.lit('"}'))
    names = profiling.json_column_names(record)
    return table(spark, sf, "events").select(
        "event_id", F.array_join(F.array_sort(names), ",").alias("names")
    )


_RATE = "CAST(round(CAST({} AS DECIMAL(20,0)) / {}, 6) AS DECIMAL(9,6))"


@registered(
    "dataset_stats",
    f"""SELECT count(*) AS record_count, 5 AS field_count,
      (count(c_custkey) + count(c_name) + count(c_nationkey) + count(c_acctbal) + count(c_mktsegment))::BIGINT AS non_null_cells,
      (5 * count(*) - count(c_custkey) - count(c_name) - count(c_nationkey) - count(c_acctbal) - count(c_mktsegment))::BIGINT AS null_cells,
      CAST(round((count(c_custkey) + count(c_name) + count(c_nationkey) + count(c_acctbal) + count(c_mktsegment)) / (5.0 * count(*)), 6) AS DECIMAL(9,6)) AS completeness_rate
    FROM ({_GAPS})""",
)
def _(spark, sf):
    return profiling.dataset_stats(customers_with_gaps(spark, sf))


_LONG = f"""WITH g AS ({_GAPS}), cells AS (SELECT 'c_custkey' AS column_name, c_custkey AS v FROM g UNION ALL SELECT 'c_name', c_name FROM g
    UNION ALL SELECT 'c_nationkey', c_nationkey FROM g UNION ALL SELECT 'c_acctbal', c_acctbal FROM g UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM g)"""


@registered(
    "column_stats",
    _LONG
    + """ SELECT column_name, count(v) AS non_null_count, count(*) - count(v) AS null_count,
      CAST(round((count(*) - count(v)) / CAST(count(*) AS DOUBLE), 6) AS DECIMAL(9,6)) AS null_rate, count(DISTINCT v) AS distinct_count,
      CAST(round(count(DISTINCT v) / CAST(count(*) AS DOUBLE), 6) AS DECIMAL(9,6)) AS uniqueness_ratio, min(length(v)) AS min_length, max(length(v)) AS max_length
    FROM cells GROUP BY column_name""",
)
def _(spark, sf):
    return profiling.column_stats(customers_with_gaps(spark, sf))


@registered("column_stats_approx")
def _(spark, sf):
    return profiling.column_stats(table(spark, sf, "lineitem"), approx=True)


@registered(
    "column_sketches",
    """WITH cells AS (SELECT 'l_partkey' AS column_name, l_partkey::double AS v FROM lineitem UNION ALL SELECT 'l_quantity', l_quantity::double FROM lineitem
      UNION ALL SELECT 'l_extendedprice', l_extendedprice::double FROM lineitem UNION ALL SELECT 'l_returnflag', NULL FROM lineitem)
    SELECT column_name, count(*) AS record_count, CASE column_name WHEN 'l_returnflag' THEN (SELECT count(DISTINCT l_returnflag) FROM lineitem) ELSE count(DISTINCT v) END AS exact_count,
      TRUE AS distinct_within, CASE WHEN column_name <> 'l_returnflag' THEN TRUE END AS ranks_within FROM cells GROUP BY column_name""",
)
def _(spark, sf):
    """Sketches of two parts of a table, stored and merged, against exact counts and ranks."""
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    path = scratch_path(spark, "sketches")
    for part in (0, 1):
        own = lines.filter(F.pmod(F.xxhash64("l_partkey", "l_extendedprice"), F.lit(2)) == part)
        profiling.column_sketches(own).withColumn("snapshot", F.lit(part)).write.mode("append").parquet(path)
    ranks = [0.1, 0.5, 0.9]
    found = profiling.sketched_stats(profiling.merged_sketches(spark.read.parquet(path)), ranks)
    cells = lines.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"), F.col(c).try_cast("double").alias("v")) for c in lines.columns
    ])))
    exact = cells.groupBy("column_name").agg(F.countDistinct("value").alias("exact_count"))
    at = found.select("column_name", F.posexplode("quantiles").alias("n", "q"))
    met = cells.filter("v IS NOT NULL").join(F.broadcast(at), "column_name").groupBy("column_name", "n").agg(
        F.avg((F.col("v") < F.col("q")).cast("double")).alias("below"), F.avg((F.col("v") <= F.col("q")).cast("double")).alias("upto")
    )
    rank = F.array(*[F.lit(r) for r in ranks])[F.col("n")]
    inside = (F.col("below") <= rank + profiling.RANK_ERROR) & (F.col("upto") >= rank - profiling.RANK_ERROR)
    checked = met.groupBy("column_name").agg(F.bool_and(inside).alias("ranks_within"))
    close = F.abs(F.col("distinct_count") - F.col("exact_count")) <= F.col("distinct_bound")
    joined = found.join(exact, "column_name").join(checked, "column_name", "left")
    return joined.select("column_name", "record_count", "exact_count", close.alias("distinct_within"), "ranks_within")


@registered(
    "pattern_stats",
    f"""SELECT count(c_mktsegment) AS non_null_count, count(*) FILTER (regexp_matches(c_mktsegment, '^[A-M][A-Z]+$')) AS match_count,
      CAST(round(count(*) FILTER (regexp_matches(c_mktsegment, '^[A-M][A-Z]+$')) / CAST(count(c_mktsegment) AS DOUBLE), 6) AS DECIMAL(9,6)) AS match_rate FROM ({_GAPS})""",
)
def _(spark, sf):
    return profiling.pattern_stats(customers_with_gaps(spark, sf), "c_mktsegment", r"^[A-M][A-Z]+\z")


@registered(
    "decimal_stats",
    """SELECT min(v) AS min_decimal, max(v) AS max_decimal, CAST(sum(v) AS DECIMAL(38,2)) AS sum_decimal, count(*) FILTER (bad) AS not_decimal FROM (
      SELECT CASE WHEN l_partkey % 50 = 7 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(38,2)) END AS v, l_partkey % 50 = 7 AS bad FROM lineitem)""",
)
def _(spark, sf):
    text = F.col("l_extendedprice").cast("decimal(38,2)").cast("string")
    bad = F.when(F.col("l_partkey") % 50 == 7, "n/a").otherwise(text)
    return profiling.decimal_stats(table(spark, sf, "lineitem").select(bad.alias("amount")), "amount")


@registered(
    "uniqueness_counterexamples",
    """SELECT l_orderkey, l_linenumber, l_partkey || '-' || l_suppkey AS owner, occurrences, l_partkey || '-' || l_suppkey || '#field=l_orderkey,l_linenumber' AS locator
    FROM lineitem JOIN (SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) USING (l_orderkey, l_linenumber)""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat_ws("-", "l_partkey", "l_suppkey").alias("owner_id")
    )
    return profiling.uniqueness_counterexamples(lines, ["l_orderkey", "l_linenumber"], "owner_id")


@registered(
    "uniqueness_summary",
    """SELECT count(*) FILTER (n > 1) AS duplicate_values, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_rows, max(n) <= 1 AS globally_unique
    FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
)
def _(spark, sf):
    return profiling.uniqueness_summary(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@registered("category_counts", f"SELECT c_mktsegment AS category, count(*) AS n FROM ({_GAPS}) WHERE c_mktsegment IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return profiling.category_counts(customers_with_gaps(spark, sf), "c_mktsegment")


@registered(
    "category_map",
    """SELECT '{"1-URGENT":' || count(*) FILTER (o_orderpriority = '1-URGENT') || ',"2-HIGH":' || count(*) FILTER (o_orderpriority = '2-HIGH')
      || ',"5-LOW":' || count(*) FILTER (o_orderpriority = '5-LOW') || '}' AS counts FROM orders""",
)
def _(spark, sf):
    counts = profiling.category_map(table(spark, sf, "orders"), "o_orderpriority", ["5-LOW", "1-URGENT", "2-HIGH", "9-NONE"])
    return counts.select(F.to_json("counts").alias("counts"))


@registered("pair_counts", "SELECT l_returnflag || '->' || l_linestatus AS pair, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, sf):
    return profiling.pair_counts(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@registered(
    "feature_counts",
    """SELECT feature, count(*) AS n, CAST(min(score) AS DECIMAL(9,4)) AS min_score, CAST(max(score) AS DECIMAL(9,4)) AS max_score FROM (
      SELECT event_type AS feature, CAST(value AS DECIMAL(9,4)) AS score FROM events
      UNION ALL SELECT 'country', CAST(1 AS DECIMAL(9,4)) FROM events WHERE event_id % 3 = 0) GROUP BY feature""",
)
def _(spark, sf):
    more = F.when(F.col("event_id") % 3 == 0, "|country:1.00").otherwise("")
    text = F.concat("event_type", F.lit(":"), F.col("value").cast("decimal(20,4)").cast("string"), more)
    return profiling.feature_counts(table(spark, sf, "events").select(text.alias("features")), "features")


@registered(
    "distinct_counts",
    """SELECT 'parts' AS counter, count(DISTINCT l_partkey) AS n FROM lineitem UNION ALL SELECT 'suppliers', count(DISTINCT l_suppkey) FROM lineitem
    UNION ALL SELECT 'links', count(*) FROM lineitem WHERE l_suppkey % 3 <> 0""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn(
        "link", F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey"))
    )
    return profiling.distinct_counts(lines, {"parts": "l_partkey", "suppliers": "l_suppkey"}, {"links": "link"})


_KINDS = ["uuid", "CHARACTER VARYING", "numeric", "text[]", "ARRAY", "jsonb", "money", "timestamp with time zone"]
_KIND_SQL = "CASE p_partkey % 8 " + " ".join(
    f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)
) + " END"


@registered(
    "logical_types",
    "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'string' WHEN 1 THEN 'string' WHEN 2 THEN 'number' WHEN 3 THEN 'array' WHEN 4 THEN 'array' WHEN 5 THEN 'object' WHEN 6 THEN 'string' ELSE 'datetime' END AS logical_type FROM part",
)
def _(spark, sf):
    kind = F.get(F.array(*[F.lit(k) for k in _KINDS]), (F.col("p_partkey") % 8).cast("int"))
    return table(spark, sf, "part").select("p_partkey", catalog.logical_type(kind).alias("logical_type"))


@registered(
    "media_types",
    "SELECT doc_id, 'text/' || lang AS media_type FROM documents",
)
def _(spark, sf):
    text = F.concat(F.lit("TEXT/"), F.upper("lang"), F.lit("; charset=utf-8;v=1"))
    return table(spark, sf, "documents").select("doc_id", media_type(text).alias("media_type"))


@registered(
    "key_columns",
    """SELECT l_orderkey AS constraint_name, string_agg('col' || n, ',' ORDER BY n) AS column_names
    FROM (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem) GROUP BY 1""",
)
def _(spark, sf):
    usage = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("constraint_name"),
        F.col("l_linenumber").alias("ordinal_position"),
        F.concat(F.lit("col"), "l_linenumber").alias("column_name"),
    )
    keys = catalog.key_columns(usage, ["constraint_name"])
    return keys.withColumn("column_names", F.array_join("column_names", ","))


def order_catalog(spark, sf):
    """Orders as tables of their customer's schema, line numbers as columns.

    Some orders name a customer that is no schema, some keys a column that is none.
    """
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    schema = F.concat(F.lit("c"), "o_custkey").alias("table_schema")
    name = F.concat(F.lit("o"), "o_orderkey").alias("table_name")
    columns = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .select(schema, name, F.concat(F.lit("f"), "l_linenumber").alias("column_name"), F.col("l_linenumber").alias("ordinal_position"))
        .distinct()
        .withColumn("data_type", F.lit("text"))
        .withColumn("is_nullable", F.when(F.col("ordinal_position") == 7, "MAYBE").otherwise("NO"))
    )
    first = F.array(F.when(F.col("o_orderkey") % 9 == 5, "none").otherwise("f1"))
    constraint = F.concat(F.lit("k"), "o_orderkey").alias("constraint_name")
    keyed = orders.filter("o_orderkey % 3 = 0")
    return {
        "schemas": table(spark, sf, "customer").filter("c_custkey % 10 <> 7").select(F.concat(F.lit("c"), "c_custkey").alias("schema_name")),
        "tables": orders.select(
            schema,
            name,
            F.when(F.col("o_orderkey") % 21 == 4, "INDEX").otherwise("BASE TABLE").alias("table_type"),
            F.floor("o_totalprice").cast("bigint").alias("row_estimate"),
        ),
        "columns": columns,
        "primary_keys": keyed.select(schema, name, constraint, first.alias("column_names")),
        "foreign_keys": keyed.select(
            schema,
            name,
            constraint,
            F.array(F.lit("f1")).alias("column_names"),
            schema.alias("referenced_schema"),
            name.alias("referenced_table"),
            F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit("f1"), F.lit("f2"))).otherwise(F.array(F.lit("f1"))).alias("referenced_columns"),
        ),
    }


_CATALOG = """WITH t AS (SELECT o_orderkey AS k, 'c' || o_custkey AS sch, 'o' || o_orderkey AS tab, o_custkey, CAST(floor(o_totalprice) AS BIGINT) AS est FROM orders),
    col AS (SELECT DISTINCT k, sch, tab, l_linenumber AS n FROM lineitem JOIN t ON k = l_orderkey)"""


@registered(
    "catalog_tables",
    _CATALOG
    + """ SELECT sch || '.' || tab AS table_id, est AS row_estimate, 'postgres://core/' || sch || '/' || tab AS locator, coalesce(c.n, 0) AS column_count,
      CASE WHEN k % 3 = 0 THEN 'k' || k END AS pk_name, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 9 = 5 THEN 'none' ELSE 'f1' END END AS pk_columns,
      CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS foreign_key_count FROM t LEFT JOIN (SELECT k, count(*) AS n FROM col GROUP BY k) c USING (k)""",
)
def _(spark, sf):
    tables = catalog.catalog_profile(order_catalog(spark, sf), "core")["tables"]
    return tables.select(
        "table_id",
        "row_estimate",
        "locator",
        "column_count",
        F.col("primary_key.constraint_name").alias("pk_name"),
        F.array_join("primary_key.column_names", ",").alias("pk_columns"),
        "foreign_key_count",
    )


@registered(
    "catalog_columns",
    _CATALOG
    + """ SELECT sch || '.' || tab AS table_id, 'f' || n AS column_name, n AS ordinal_position, 'string' AS logical_type, FALSE AS nullable,
      'postgres://core/' || sch || '/' || tab || '#column=f' || n AS locator FROM col""",
)
def _(spark, sf):
    columns = catalog.catalog_profile(order_catalog(spark, sf), "core")["columns"]
    return columns.drop("data_type")


@registered(
    "catalog_statistics",
    _CATALOG
    + """ SELECT (SELECT count(*) FROM customer WHERE c_custkey % 10 <> 7) AS schemas_count, (SELECT count(*) FROM t) AS tables_count, (SELECT count(*) FROM col) AS columns_count,
      (SELECT count(*) FROM t WHERE k % 3 = 0) AS primary_keys_count, (SELECT count(*) FROM t WHERE k % 3 = 0) AS foreign_keys_count""",
)
def _(spark, sf):
    return catalog.catalog_statistics(order_catalog(spark, sf))


@registered(
    "catalog_evidence",
    _CATALOG
    + """, e AS (
      SELECT 'postgres://core/' || sch || '/' || tab AS locator, '/tables/' || sch || '.' || tab AS pointer FROM t
      UNION ALL SELECT 'postgres://core/' || sch || '/' || tab || '#constraint=k' || k, '/tables/' || sch || '.' || tab || '/foreignKeys' FROM t WHERE k % 3 = 0
      UNION ALL SELECT 'catalog.json', 'catalog-snapshot' UNION ALL SELECT 'p/profile.json#/statistics', '/statistics')
    SELECT 'evidence-pg-' || substr(sha256('pg@sha256:abc|' || locator || '|' || pointer), 1, 16) AS evidence_id, locator, pointer FROM e""",
)
def _(spark, sf):
    profile = catalog.catalog_profile(order_catalog(spark, sf), "core")
    rows = catalog.catalog_evidence(
        profile,
        source_id="pg",
        tenant_id="bank",
        catalog_locator="catalog.json",
        catalog_sha256="abc",
        byte_count=1,
        observed_at="2026-07-01T06:30:00Z",
        profile_prefix="p",
    )
    return rows.select("evidence_id", "locator", "pointer")


@registered(
    "catalog_references",
    _CATALOG
    + """ SELECT 'TABLE_WITHOUT_SCHEMA' AS rule, sch || '.' || tab AS key FROM t WHERE o_custkey % 10 = 7
      UNION ALL SELECT 'PRIMARY_KEY_COLUMN', sch || '.' || tab || '.' || c FROM (SELECT *, CASE WHEN k % 9 = 5 THEN 'none' ELSE 'f1' END AS c FROM t WHERE k % 3 = 0) x
        WHERE NOT EXISTS (SELECT 1 FROM col WHERE col.k = x.k AND 'f' || n = c)
      UNION ALL SELECT 'FOREIGN_KEY_COLUMN', sch || '.' || tab || '.f1' FROM t WHERE k % 3 = 0 AND NOT EXISTS (SELECT 1 FROM col WHERE col.k = t.k AND n = 1)
      UNION ALL SELECT 'REFERENCED_COLUMN', sch || '.' || tab || '.f' || m FROM t, (VALUES (1), (2)) AS v(m)
        WHERE k % 3 = 0 AND (m = 1 OR k % 5 = 0) AND NOT EXISTS (SELECT 1 FROM col WHERE col.k = t.k AND n = m)
      UNION ALL SELECT 'FOREIGN_KEY_ARITY', sch || '.' || tab || '.k' || k FROM t WHERE k % 15 = 0""",
)
def _(spark, sf):
    return catalog.reference_violations(order_catalog(spark, sf)).select("rule", "key")


@registered(
    "catalog_domains",
    _CATALOG
    + """ SELECT 'TABLE_TYPE' AS rule, sch || '.' || tab AS key FROM t WHERE k % 21 = 4
      UNION ALL SELECT 'IS_NULLABLE', sch || '.' || tab || '.f7' FROM col WHERE n = 7
      UNION ALL SELECT 'LIMIT_EXCEEDED', 'schemas' WHERE (SELECT count(*) FROM customer WHERE c_custkey % 10 <> 7) > 16
      UNION ALL SELECT 'LIMIT_EXCEEDED', 'tables' WHERE (SELECT count(*) FROM t) > 200
      UNION ALL SELECT 'LIMIT_EXCEEDED', 'columns' WHERE (SELECT count(*) FROM col) > 2000""",
)
def _(spark, sf):
    limits = {"schemas": 16, "tables": 200, "columns": 2000}
    return catalog.domain_violations(order_catalog(spark, sf), limits).select("rule", "key")


@registered(
    "catalog_forbidden_keys",
    """SELECT 'FORBIDDEN_KEY' AS rule, CAST(event_id AS VARCHAR) AS key, CASE event_id % 3 WHEN 0 THEN 'Sample' ELSE 'values' END AS detail
    FROM events WHERE event_id % 3 < 2""",
)
def _(spark, sf):
    key = F.col("event_id")
    name = F.when(key % 3 == 0, "Sample").when(key % 3 == 1, "values").otherwise("harmless")
    text = F.concat(F.lit('{"columns":[{"note":"\\"rows\\":","deep":{"'), name, F.lit('":'), "props", F.lit("}}]}"))
    docs = table(spark, sf, "events").select(key.alias("path"), text.alias("value"))
    return catalog.forbidden_key_violations(docs)


@registered(
    "catalog_shapes",
    """SELECT 'MISSING_KEY' AS rule, CAST(event_id AS VARCHAR) AS key, t.d AS detail FROM events,
      LATERAL (VALUES ('database'), ('server_version'), ('collected_at'), ('tables'), ('columns'), ('primary_keys'), ('foreign_keys')) AS t(d)
    UNION ALL SELECT 'UNKNOWN_KEY', CAST(event_id AS VARCHAR), 'extra' FROM events WHERE event_id % 4 = 1
    UNION ALL SELECT 'UNKNOWN_KEY', CAST(event_id AS VARCHAR), 'schemas.owner' FROM events WHERE event_id % 5 = 2
    UNION ALL SELECT 'MISSING_KEY', CAST(event_id AS VARCHAR), 'schemas.schema_name' FROM events WHERE event_id % 5 = 2""",
)
def _(spark, sf):
    key = F.col("event_id")
    extra = F.when(key % 4 == 1, ',"extra":1').otherwise("")
    entry = F.when(key % 5 == 2, "owner").otherwise("schema_name")
    text = F.concat(F.lit('{"catalog_schema_version":"1.0","schemas":[{"'), entry, F.lit('":"s"}]'), extra, F.lit("}"))
    return catalog.shape_violations(table(spark, sf, "events").select(key.alias("path"), text.alias("value")))


