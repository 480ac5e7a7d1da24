"""Content addresses: ids, canonical JSON hashes and digests of whole row sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from govgraph.functions.text import nfkc

UNIT_SEPARATOR = "\x1f"
_LIMB_DIGITS = 15
_LIMBS = 4


def deterministic_id(*parts: Column, ascii_only: bool = False) -> Column:
    """SHA-256 of the NFKC parts joined by U+001F; null when any part is null.

    ``ascii_only`` skips the Unicode step for parts known to be ASCII.
    """
    texts = [p.cast("string") for p in parts]
    if not ascii_only:
        texts = [nfkc(t) for t in texts]
    pieces: list[Column] = []
    for text in texts:
        pieces += [F.lit(UNIT_SEPARATOR), text]
    return F.sha2(F.concat(*pieces[1:]), 256)


def canonical_struct(fields: dict[str, Column]) -> Column:
    """A struct whose fields are in sorted key order, ready for ``canonical_sha256``."""
    return F.struct(*[fields[name].alias(name) for name in sorted(fields)])


def finite(column: Column, kind: DataType) -> Column:
    """The value as it is; the job fails where a number in it, at any depth, is not finite, since JSON has none such."""
    if isinstance(kind, (DoubleType, FloatType)):
        odd = F.isnan(column) | (F.abs(column) == float("inf"))
        return F.when(odd, F.raise_error(F.lit("a number that is not finite has no canonical form")).cast(kind)).otherwise(column)
    if isinstance(kind, ArrayType) and _has_floats(kind):
        return F.transform(column, lambda x: finite(x, kind.elementType))
    if isinstance(kind, MapType) and _has_floats(kind):
        return F.transform_values(column, lambda _, v: finite(v, kind.valueType))
    if isinstance(kind, StructType) and _has_floats(kind):
        inner = F.struct(*[finite(column[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(column.isNotNull(), inner)
    return column


def _has_floats(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_has_floats(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _has_floats(kind.elementType)
    return _has_floats(kind.valueType) if isinstance(kind, MapType) else isinstance(kind, (DoubleType, FloatType))


def canonical_row_sha256(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The canonical hash of columns of ``df``; numbers that are not finite are refused."""
    names = columns or df.columns
    return canonical_sha256({c: finite(F.col(f"`{c}`"), df.schema[c].dataType) for c in names})


def canonical_json(struct: Column) -> Column:
    """JSON of a canonical struct: no white space, explicit nulls kept. Floating-point numbers go through ``finite`` first."""
    return F.to_json(struct, {"ignoreNullFields": "false"})


def canonical_sha256(fields: dict[str, Column] | Column) -> Column:
    struct = canonical_struct(fields) if isinstance(fields, dict) else fields
    return F.sha2(canonical_json(struct), 256)


def canonical_json_text(text: Column) -> Column:
    """Free-form JSON text with sorted keys, plain numbers and no white space.

    Null for text that is not JSON or repeats a key.
    """
    return F.to_json(F.try_parse_json(text))


def snapshot_id(source: Column, sha256: Column) -> Column:
    return F.concat(source, F.lit("@sha256:"), sha256)


def evidence_id(source: Column, snapshot: Column, locator: Column, pointer: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", snapshot, locator, pointer), 256)
    return F.concat(F.lit("evidence-"), source, F.lit("-"), F.substring(digest, 1, 16))


def set_digest(*values: Column) -> Column:
    """Aggregate: one digest of a whole group of rows, whatever their order.

    Every row is hashed; the hashes are summed in limbs, so the digest is a plain
    distributive aggregate that combines before the shuffle and never gathers a
    group. Repeated rows count.
    """
    row_hash = F.sha2(F.concat_ws(UNIT_SEPARATOR, *[v.cast("string") for v in values]), 256)
    sums = [
        F.sum(
            F.conv(F.substring(row_hash, 1 + i * _LIMB_DIGITS, _LIMB_DIGITS), 16, 10).cast(
                "decimal(20,0)"
            )
        ).cast("string")
        for i in range(_LIMBS)
    ]
    return F.sha2(F.concat_ws(":", F.count(row_hash).cast("string"), *sums), 256)
