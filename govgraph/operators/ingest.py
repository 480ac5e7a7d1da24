"""Checks on arriving objects, digests, tenant scope and connector manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govgraph.functions.paths import parse_object_path
from govgraph.operators.violations import findings, rule_array

# Fixed value: the most bytes that an upload of the registered queries may have.
MAX_OBJECT_BYTES = 20 * 1024 * 1024
# Media types that can be profiled.
SUPPORTED_MEDIA_TYPES = (
    "application/json",
    "application/pdf",
    "application/x-ndjson",
    "text/csv",
    "text/plain",
)


def media_type(content_type: Column) -> Column:
    """The lower-case media type without parameters."""
    return F.lower(F.substring_index(content_type, ";", 1))


def quarantine(objects: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Route arriving objects to QUEUED, QUARANTINED (with reason) or IGNORED.

    Needs ``object_name, size_bytes, content_type, metadata_tenant``. Size is checked
    first (at least 1, at most ``max_bytes`` where given), then the media type, then the tenant in the metadata.
    """
    parsed = objects.withColumn("_path", parse_object_path(F.col("object_name"))).select(
        *objects.columns, "_path.*"
    )
    size = F.col("size_bytes")
    good_size = F.coalesce(size >= 1 if max_bytes is None else size.between(1, max_bytes), F.lit(False))
    good_type = F.coalesce(
        media_type(F.col("content_type")).isin(*SUPPORTED_MEDIA_TYPES), F.lit(False)
    )
    good_tenant = F.coalesce(F.col("metadata_tenant") == F.col("tenant_id"), F.lit(False))
    reason = (
        F.when(F.col("path_status") != "OK", None)
        .when(~good_size, "INVALID_OBJECT_SIZE")
        .when(~good_type, "UNSUPPORTED_CONTENT_TYPE")
        .when(~good_tenant, "TENANT_METADATA_MISMATCH")
    )
    status = (
        F.when(F.col("path_status") != "OK", F.col("path_status"))
        .when(reason.isNotNull(), "QUARANTINED")
        .otherwise("QUEUED")
    )
    return parsed.withColumn("reason", reason).withColumn("status", status)


def split_quarantine(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queued rows and quarantined rows."""
    return routed.filter("status = 'QUEUED'"), routed.filter("status = 'QUARANTINED'")


def verify_digests(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Compare recomputed hashes with a manifest, both ``(path, sha256)``.

    Result is OK, PATH_ESCAPE, BAD_DIGEST, MISSING, MISMATCH or UNLISTED per path.
    """
    found = files.select("path", F.col("sha256").alias("actual"))
    listed = manifest.select("path", F.col("sha256").alias("expected"), F.lit(True).alias("listed"))
    unsafe = F.col("path").rlike(r"^/|(^|/)\.\.(/|\z)|^\z")
    result = (
        F.when(F.col("listed").isNull(), "UNLISTED")
        .when(unsafe, "PATH_ESCAPE")
        .when(~F.coalesce(F.col("expected").rlike(r"^[0-9a-f]{64}\z"), F.lit(False)), "BAD_DIGEST")
        .when(F.col("actual").isNull(), "MISSING")
        .when(F.col("actual") != F.col("expected"), "MISMATCH")
        .otherwise("OK")
    )
    return found.join(listed, "path", "full_outer").select(
        "path", "expected", "actual", result.alias("result")
    )


def tenant_scope(df: DataFrame, tenant: str, column: str = "tenant_id") -> DataFrame:
    """Only the rows of one tenant; prunes partitions of tables kept by tenant."""
    return df.filter(F.col(column) == tenant)


def foreign_rows(df: DataFrame, tenant: str, key: str, column: str = "tenant_id") -> DataFrame:
    """Findings for rows of another tenant in a frame bound to one tenant."""
    other = df.filter(~F.coalesce(F.col(column) == tenant, F.lit(False)))
    return findings(other, "FOREIGN_TENANT", F.col(key), F.col(column))


# What a connector manifest may say.
SOURCE_TYPES = ("csv", "jsonl", "json", "text", "pdf", "openapi", "postgres")
CAPABILITIES = ("schema", "sample", "profile", "snapshot")
SNAPSHOT_STRATEGIES = ("immutable", "watermark", "content_hash")
LOGICAL_TYPES = (
    "string",
    "integer",
    "number",
    "boolean",
    "date",
    "datetime",
    "object",
    "array",
    "binary",
)


def connector_violations(manifests: DataFrame) -> DataFrame:
    """Contract findings per connector manifest, in the array column ``violations``.

    ``fields`` is an array of structs with ``source_path`` and ``logical_type``;
    ``limits`` a map of positive numbers that may be null.
    """
    paths = F.transform("fields", lambda f: f["source_path"])

    def unique(a: Column) -> Column:
        return F.size(F.array_distinct(a)) == F.size(a)

    def is_set(c: str) -> Column:
        return F.length(c) >= 1

    rules = [
        ("SCHEMA_VERSION", F.col("schema_version") == "1.0"),
        ("CONNECTOR_ID", F.col("connector_id").rlike(r"^[a-z][a-z0-9-]{2,63}\z")),
        ("TENANT_ID", F.length("tenant_id").between(1, 128)),
        ("SOURCE_TYPE", F.col("source_type").isin(*SOURCE_TYPES)),
        ("ACCESS_MODE", F.col("access_mode") == "read_only"),
        ("SOURCE_URI", is_set("source_uri")),
        ("SNAPSHOT_STRATEGY", F.col("snapshot_strategy").isin(*SNAPSHOT_STRATEGIES)),
        (
            "CREDENTIAL_REF",
            F.col("credential_ref").isNull()
            | F.col("credential_ref").rlike(r"^projects/[^/]+/secrets/[^/]+/versions/[^/]+\z"),
        ),
        ("CAPABILITIES_EMPTY", F.size("capabilities") >= 1),
        ("CAPABILITIES_UNKNOWN", F.forall("capabilities", lambda c: c.isin(*CAPABILITIES))),
        ("CAPABILITIES_REPEATED", unique(F.col("capabilities"))),
        ("FIELD_PATH_EMPTY", F.forall(paths, lambda p: F.length(p) >= 1)),
        ("FIELD_PATH_REPEATED", unique(paths)),
        ("FIELD_TYPE", F.forall("fields", lambda f: f["logical_type"].isin(*LOGICAL_TYPES))),
        ("LOCATOR_TEMPLATE", is_set("locator_template")),
        ("HASH_ALGORITHM", F.col("hash_algorithm") == "sha256"),
        (
            "LIMITS",
            F.col("limits").isNull() | F.forall(F.map_values("limits"), lambda v: v.isNull() | (v >= 1)),
        ),
    ]
    return manifests.select("connector_id", rule_array(rules).alias("violations"))
