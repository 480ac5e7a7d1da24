"""Readers for the source formats: CSV, JSON Lines, JSON, text, whole objects, OpenAPI."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from govgraph.functions.paths import line_locator
from govgraph.session import small_join, stored
from govgraph.sources.lines import BOM, content_lines, numbered_lines, quoted_records

PDF_SIGNATURE = b"%PDF-"

# The media type each upload file ending stands for.
MEDIA_TYPES = {
    ".csv": "text/csv",
    ".json": "application/json",
    ".jsonl": "application/x-ndjson",
    ".ndjson": "application/x-ndjson",
    ".pdf": "application/pdf",
    ".txt": "text/plain",
}


class SourceFormatError(ValueError):
    """The source breaks its format contract."""


def check_header(names: list[str], most: int | None = None, longest: int | None = None) -> list[str]:
    """Header names: none empty, none repeated; bounds on their number and length only where given."""
    trimmed = [name.removeprefix(BOM).strip() for name in names]
    if not trimmed or most is not None and len(trimmed) > most:
        raise SourceFormatError("a header needs fields, and no more than allowed")
    if any(not name or longest is not None and len(name) > longest for name in trimmed):
        raise SourceFormatError("header fields must be named and no longer than allowed")
    if len(set(trimmed)) != len(trimmed):
        raise SourceFormatError("header fields must be unique")
    return trimmed


# A quote is escaped by a quote alone; unset, a null character before a quote would count as an escape too.
_CSV = {"escape": '"', "charToEscapeQuoteEscaping": '"', "encoding": "UTF-8"}


def read_csv_source(
    spark: SparkSession, path: str, schema: StructType | None = None, multi_line: bool = False
) -> DataFrame:
    """CSV with a header; quotes and doubled quotes are honoured.

    Records of white space only are dropped; a comma is content, so a record of empty cells stays, and
    an empty cell is null. A file whose header differs from that of the first fails the read. Large files are
    split among tasks, with ``multi_line=True`` also where cells hold line breaks: splits then learn from those
    before them whether they begin inside quotes.
    """
    header_row = (
        spark.read.options(**_CSV).option("multiLine", multi_line).option("header", False).option("inferSchema", False).csv(path).head(1)
    )
    if not header_row:
        raise SourceFormatError("the file has no header")
    raw = [cell or "" for cell in header_row[0]]
    names = check_header(raw)
    broken = "_broken_record"
    wanted = StructType([StructField(n, StringType()) for n in raw]) if schema is None else schema
    full = StructType([*wanted.fields, StructField(broken, StringType())])
    if multi_line:
        frame = _parsed_records(quoted_records(spark, path), names, full, broken)
    else:
        frame = (
            spark.read.options(**_CSV)
            .option("header", True)
            .option("enforceSchema", False)
            .option("columnNameOfCorruptRecord", broken)
            .schema(full)
            .csv(path)
        )
    if schema is None:
        frame = frame.toDF(*names, broken)
    # A record without a comma where several fields are due is kept as text beside its cells.
    text = F.col(broken) if len(wanted.fields) > 1 else F.col(f"`{frame.columns[0]}`").cast("string")
    blank = F.coalesce(~text.rlike(r"(?U)\S"), F.lit(len(wanted.fields) == 1))
    return frame.filter(~blank).drop(broken)


def _parsed_records(records: DataFrame, names: list[str], full: StructType, broken: str) -> DataFrame:
    """Cells of records, without the header of each file, which is its first record that is not empty."""
    options = {**_CSV, "multiLine": "true", "columnNameOfCorruptRecord": broken}
    filled = records.filter(F.col("value") != "")
    heads = stored(filled.groupBy("path").agg(F.min_by("value", "line").alias("_head"), F.min("line").alias("_at")), "csv-headers")
    cells = StructType([StructField(f"c{n}", StringType()) for n in range(len(names))])
    found = F.from_csv("_head", cells.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options)
    own = F.transform(F.array(*[found[f"c{n}"] for n in range(len(names))]), lambda c: F.trim(F.coalesce(c, F.lit(""))))
    same = own == F.array(*[F.lit(n) for n in names])
    checked = F.when(same, F.col("_at")).otherwise(F.raise_error(F.concat(F.lit("the header differs in "), "path")).cast("bigint"))
    body = small_join(filled, heads.select("path", checked.alias("_at")), "path").filter(F.col("line") > F.col("_at"))
    wide = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.fields)
    return body.select(F.from_csv("value", wide, options).alias("_r")).select("_r.*")


def read_text_lines(spark: SparkSession, path: str, numbered: bool = True) -> DataFrame:
    """Lines that are not blank, numbered within their file and with locators where asked for."""
    if not numbered:
        return spark.read.text(path).filter(F.col("value").rlike(r"\S"))
    return _located(numbered_lines(spark, path))


def _located(lines: DataFrame) -> DataFrame:
    kept = lines.filter(F.col("value").rlike(r"\S"))
    return kept.withColumn("locator", line_locator(F.col("path"), F.col("line")))


def packed_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same of the objects of packs, each numbered from 1."""
    return _located(content_lines(spark.read.schema(PACK).parquet(path)))


def jsonl_records(lines: DataFrame, value: str = "value") -> DataFrame:
    """Text lines with the parsed variant and ``malformed`` for what is no JSON object."""
    parsed = F.try_parse_json(F.col(value))
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    return lines.withColumn("record", parsed).withColumn(
        "malformed", ~F.coalesce(is_object, F.lit(False))
    )


def read_jsonl_source(spark: SparkSession, path: str, numbered: bool = True) -> DataFrame:
    """One JSON object per line that is not blank; other lines are marked malformed."""
    return jsonl_records(read_text_lines(spark, path, numbered))


def require_well_formed(records: DataFrame) -> DataFrame:
    """Fail the job at the first malformed line, naming it."""
    where = F.col("line").cast("string") if "line" in records.columns else F.lit("unknown")
    message = F.concat(F.lit("line "), where, F.lit(" is not a JSON object"))
    checked = F.when(F.col("malformed"), F.raise_error(message).cast("boolean")).otherwise(
        F.col("malformed")
    )
    return records.withColumn("malformed", checked)


def json_record_count(value: Column) -> Column:
    """Length of a JSON array, 1 for an object, 0 for another value, null if no JSON."""
    kind = F.schema_of_variant(F.try_parse_json(value))
    return (
        F.when(kind.startswith("ARRAY"), F.json_array_length(value))
        .when(kind.startswith("OBJECT"), F.lit(1))
        .when(kind.isNotNull(), F.lit(0))
    )


def read_json_records(
    spark: SparkSession, path: str, records_field: str | None = None, schema: StructType | str | None = None, lines: bool = False
) -> DataFrame:
    """Records of JSON files: an array, an object, or an array inside an object.

    A document may lie over many lines, so a file is read by one task; with ``lines=True`` every line is a document and
    files are split among tasks.
    """
    reader = spark.read.option("multiLine", not lines)
    frame = (reader.schema(schema) if schema is not None else reader).json(path)
    return frame if records_field is None else frame.select(F.inline(records_field))


def read_objects(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Whole objects with length, SHA-256, media type by ending and a PDF check."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return _described(reader.load(path))


# Many objects in few files: the rows of Spark's binaryFile reader, kept as Parquet.
PACK = "path string, modificationTime timestamp, length bigint, content binary"


def write_packs(objects: DataFrame, path: str) -> None:
    """``path, modificationTime, content`` of objects as packs, one file per task instead of one per object."""
    rows = objects.select("path", "modificationTime", F.octet_length("content").cast("bigint").alias("length"), "content")
    rows.write.mode("append").parquet(path)


def read_packed_objects(spark: SparkSession, path: str) -> DataFrame:
    """The columns of ``read_objects`` for the objects of packs."""
    return _described(spark.read.schema(PACK).parquet(path))


def _described(found: DataFrame) -> DataFrame:
    ending = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    media = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return found.select(
        "path",
        "modificationTime",
        F.col("length").alias("byte_size"),
        F.sha2("content", 256).alias("sha256"),
        F.try_element_at(media, ending).alias("media_type"),
        (F.substring("content", 1, 5) == F.lit(PDF_SIGNATURE)).alias("has_pdf_signature"),
        "content",
    )


def openapi_inventory(objects: DataFrame, content: str = "content") -> DataFrame:
    """One row per path and method of OpenAPI 3.x JSON documents.

    ``valid`` is false for documents of another version or without a paths object;
    those give one row without path.
    """
    keys = [c for c in objects.columns if c != content]
    docs = objects.select(
        *keys, F.try_parse_json(F.col(content).cast("string")).alias("_doc")
    ).select(
        *keys,
        "_doc",
        F.try_variant_get("_doc", "$.openapi", "string").alias("openapi"),
        F.try_variant_get("_doc", "$.paths", "variant").alias("_paths"),
    )
    valid = F.coalesce(
        F.col("openapi").startswith("3.") & F.schema_of_variant("_paths").startswith("OBJECT"),
        F.lit(False),
    )
    docs = docs.withColumn("valid", valid)
    paths = docs.select(*keys, "openapi", "valid", "_paths").lateralJoin(
        docs.sparkSession.tvf.variant_explode_outer(F.col("_paths").outer()).select(
            F.col("key").alias("api_path"), F.col("value").alias("_item")
        )
    )
    operations = paths.lateralJoin(
        docs.sparkSession.tvf.variant_explode_outer(F.col("_item").outer()).select(
            F.col("key").alias("method")
        )
    )
    shown = F.col("valid") & F.lower("method").isin(*HTTP_METHODS)
    return operations.select(
        *keys,
        "openapi",
        "valid",
        F.when(F.col("valid"), F.col("api_path")).alias("api_path"),
        F.when(shown, F.lower("method")).alias("method"),
    ).distinct()


# Operation names a path item may have.
HTTP_METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def openapi_summary(inventory: DataFrame, key: str) -> DataFrame:
    """Paths and operations per document."""
    return inventory.groupBy(key).agg(
        F.max("valid").alias("valid"),
        F.countDistinct("api_path").alias("paths"),
        F.count("method").alias("operations"),
    )


def extract_labelled_fields(
    lines: DataFrame, labels: dict[str, str], key: str = "path", value: str = "value"
) -> DataFrame:
    """``Label: value`` lines to one row per document, with one column per label.

    ``labels`` maps the label text to the column name. A percentage becomes its
    number. Every field also gives its line locator.
    """
    parsed = lines.select(
        key,
        F.lower(F.trim(F.regexp_extract(value, r"^\s*([^:]+?)\s*:", 1))).alias("_label"),
        F.trim(F.regexp_extract(value, r"^[^:]+:(.*)$", 1)).alias("_value"),
        "locator",
    )
    text = F.coalesce(F.regexp_extract("_value", r"^(-?[0-9.]+)\s*%$", 1), F.lit(""))
    parsed = parsed.withColumn("_value", F.when(text != "", text).otherwise(F.col("_value")))
    # One conditional aggregate per label: the label list is fixed, so this is a
    # single pass without a pivot scan.
    found = []
    for label, column in labels.items():
        hit = F.col("_label") == label.lower()
        found += [
            F.min(F.when(hit, F.col("_value"))).alias(column),
            F.min(F.when(hit, F.col("locator"))).alias(f"{column}_locator"),
        ]
    return parsed.groupBy(key).agg(*found)
