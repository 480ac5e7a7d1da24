"""Upload paths, safe segments and locator strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what one path segment may look like.
SAFE_SEGMENT = r"^[a-zA-Z0-9][a-zA-Z0-9._-]{0,127}\z"


def safe_segment(value: Column) -> Column:
    """True when the text is one safe path segment; null counts as unsafe."""
    return F.coalesce(value.rlike(SAFE_SEGMENT) & ~value.isin(".", ".."), F.lit(False))


def parse_object_path(path: Column) -> Column:
    """``tenants/T/uploads/S/F`` to a struct of status and identity.

    Status is IGNORED for any other shape, INVALID_SEGMENT for the right shape with
    an unsafe segment, else OK. Identity fields are null unless the status is OK.
    """
    parts = F.split(path, "/")
    shaped = F.coalesce(
        (F.size(parts) == 5) & (F.get(parts, 0) == "tenants") & (F.get(parts, 2) == "uploads"),
        F.lit(False),
    )
    tenant, source, file = (F.get(parts, i) for i in (1, 3, 4))
    safe = safe_segment(tenant) & safe_segment(source) & safe_segment(file)
    ok = shaped & safe
    return F.struct(
        F.when(~shaped, "IGNORED").when(~safe, "INVALID_SEGMENT").otherwise("OK").alias("path_status"),
        F.when(ok, tenant).alias("tenant_id"),
        F.when(ok, source).alias("source_id"),
        F.when(ok, file).alias("file_name"),
    )


def row_locator(path: Column, row: Column, field: Column | None = None) -> Column:
    base = F.concat(path, F.lit("#row="), row.cast("string"))
    return base if field is None else F.concat(base, F.lit(":field="), field)


def line_locator(path: Column, line: Column) -> Column:
    return F.concat(path, F.lit("#line="), line.cast("string"))


def field_locator(path: Column, field: Column) -> Column:
    return F.concat(path, F.lit("#field="), field)


def column_locator(base: Column, column: Column) -> Column:
    return F.concat(base, F.lit("#column="), column)


def pointer_locator(path: Column, pointer: Column) -> Column:
    return F.concat(path, F.lit("#"), pointer)


def generation_locator(bucket: Column, name: Column, generation: Column) -> Column:
    return F.concat(
        F.lit("gs://"), bucket, F.lit("/"), name, F.lit("#generation="), generation.cast("string")
    )


def table_locator(database: Column, schema: Column, table: Column) -> Column:
    return F.concat(F.lit("postgres://"), F.concat_ws("/", database, schema, table))
