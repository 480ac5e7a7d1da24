"""Profiles of source tables and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govgraph.functions.paths import field_locator
from govgraph.operators.ingest import media_type
from govgraph.session import salted_join
from govgraph.sources.files import json_record_count

EXTRACTOR_VERSION = "govgraph-profiler/1.0.0"
RATE = "decimal(9,6)"


def bounded_column_names(names: Column, most: int | None = None, longest: int | None = None) -> Column:
    """Trimmed names without empty ones; only where asked for, the first ``most`` up to ``longest`` characters."""
    trimmed = F.transform(names, lambda n: F.regexp_replace(n, r"(?U)^\s+|\s+\z", ""))
    kept = F.filter(trimmed, lambda n: F.length(n).between(1, 2**31 - 1 if longest is None else longest))
    return kept if most is None else F.slice(kept, 1, most)


def json_column_names(record: Column) -> Column:
    """The bounded, sorted keys of one JSON object text; empty for other values."""
    is_object = F.schema_of_variant(F.try_parse_json(record)).startswith("OBJECT")
    keys = F.when(is_object, F.array_sort(F.json_object_keys(record)))
    return bounded_column_names(F.coalesce(keys, F.array().cast("array<string>")))


# Possessive loops: they neither backtrack nor recurse, so whole files are safe.
_QUOTED = r'"(?:[^"]++|"")*+"?+'
# A record ends at a line break outside quotes, a field at a comma outside quotes.
_CSV_RECORD = rf'(?:[^"\r\n]++|{_QUOTED})'
_CSV_FIELD = rf'(?:^|,)((?:[^",]++|{_QUOTED})*+)'


def csv_record_count(text: Column) -> Column:
    """Records of CSV text besides the header; records of white space do not count."""
    records = F.filter(
        F.regexp_extract_all(text, F.lit(f"{_CSV_RECORD}++"), 0), lambda r: r.rlike(r'(?U)[^\s"]')
    )
    return F.greatest(F.size(records) - 1, F.lit(0))


def csv_column_names(text: Column) -> Column:
    """The bounded header names of CSV text, quotes resolved and a leading BOM dropped."""
    clean = F.regexp_replace(text, "^﻿", "")
    header = F.regexp_extract(clean, f"^{_CSV_RECORD}*+", 0)
    cells = F.regexp_extract_all(header, F.lit(_CSV_FIELD), 1)
    # Doubled quotes inside a quoted part stand for one quote; single ones vanish.
    plain = F.transform(
        cells,
        lambda c: F.replace(
            F.replace(
                F.regexp_replace(c, r'(?<=.)""(?=.)', "\x00"), F.lit('"'), F.lit("")
            ),
            F.lit("\x00"),
            F.lit('"'),
        ),
    )
    return bounded_column_names(plain)


def object_profile(objects: DataFrame) -> DataFrame:
    """Hash, size, record count and column names of whole objects by media type.

    ``objects`` has ``path, content, content_type``. An unknown media type gives
    ``supported = false`` and null counts.
    """
    media = media_type(F.col("content_type"))
    text = F.when(media != "application/pdf", F.decode("content", "UTF-8"))
    base = objects.select(
        *[c for c in objects.columns if c != "content"],
        F.sha2("content", 256).alias("sha256"),
        F.length("content").cast("bigint").alias("byte_size"),
        media.alias("media_type"),
        text.alias("_text"),
    )
    lines = F.filter(F.split("_text", r"\r?\n"), lambda v: v.rlike(r"(?U)\S"))
    empty = F.array().cast("array<string>")
    first_record = F.to_json(F.try_variant_get(F.try_parse_json("_text"), "$[0]", "variant"))
    is_csv, is_json, is_lines, is_text = (
        F.col("media_type") == m
        for m in ("text/csv", "application/json", "application/x-ndjson", "text/plain")
    )
    all_json = F.forall(lines, lambda v: F.try_parse_json(v).isNotNull())
    count = (
        F.when(is_csv, csv_record_count(F.col("_text")))
        .when(is_json, json_record_count(F.col("_text")))
        .when(is_lines & all_json, F.size(lines))
        .when(is_text, F.size(lines))
    )
    names = (
        F.when(is_csv, csv_column_names(F.col("_text")))
        .when(is_json, json_column_names(first_record))
        .when(is_lines, json_column_names(F.get(lines, 0)))
        .otherwise(empty)
    )
    return base.select(
        *[c for c in base.columns if c != "_text"],
        count.cast("bigint").alias("record_count"),
        F.coalesce(names, empty).alias("column_names"),
        F.lit(EXTRACTOR_VERSION).alias("extractor_version"),
        F.coalesce(is_csv | is_json | is_lines | is_text | (F.col("media_type") == "application/pdf"), F.lit(False)).alias("supported"),
    )


def _rate(part: Column, whole: Column) -> Column:
    exact = part.cast("decimal(20,0)") / F.nullif(whole, F.lit(0)).cast("decimal(20,0)")
    return F.round(exact, 6).cast(RATE)


def _is_present(df: DataFrame, name: str) -> Column:
    """Null and, in text columns, the empty string are absent."""
    c = F.col(f"`{name}`")
    if dict(df.dtypes)[name] == "string":
        return c.isNotNull() & (c != "")
    return c.isNotNull()


def dataset_stats(df: DataFrame) -> DataFrame:
    """Records, fields, filled and empty cells and their rate; one pass, one row."""
    filled = sum((F.count_if(_is_present(df, c)) for c in df.columns), F.lit(0).cast("bigint"))
    counts = df.agg(F.count(F.lit(1)).alias("record_count"), filled.alias("non_null_cells"))
    fields = len(df.columns)
    total = F.col("record_count") * fields
    return counts.select(
        "record_count",
        F.lit(fields).cast("bigint").alias("field_count"),
        "non_null_cells",
        (total - F.col("non_null_cells")).alias("null_cells"),
        _rate(F.col("non_null_cells"), total).alias("completeness_rate"),
    )


def column_stats(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Counts, null rate, distinct values and text lengths per column.

    The exact form counts each (column, value) first, so a value that fills the
    table is combined before the shuffle and no column is gathered in one task.
    ``approx`` replaces the value shuffle by sketches.
    """
    names = columns or df.columns
    if approx:
        cells = df.select(
            F.explode(
                F.array(*[
                    F.struct(
                        F.lit(n).alias("column_name"),
                        F.when(_is_present(df, n), F.col(f"`{n}`").cast("string")).alias("value"),
                    )
                    for n in names
                ])
            ).alias("cell")
        ).select("cell.*")
        summed = cells.groupBy("column_name").agg(
            F.count(F.lit(1)).alias("record_count"),
            F.count("value").alias("non_null_count"),
            F.approx_count_distinct("value").alias("distinct_count"),
            F.min(F.length("value")).alias("min_length"),
            F.max(F.length("value")).alias("max_length"),
        )
    else:
        cells = df.select(
            F.explode(
                F.array(*[
                    F.struct(
                        F.lit(n).alias("column_name"),
                        F.when(_is_present(df, n), F.col(f"`{n}`").cast("string")).alias("value"),
                    )
                    for n in names
                ])
            ).alias("cell")
        ).select("cell.*")
        values = cells.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
        summed = values.groupBy("column_name").agg(
            F.sum("n").alias("record_count"),
            F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias(
                "non_null_count"
            ),
            F.count("value").alias("distinct_count"),
            F.min(F.length("value")).alias("min_length"),
            F.max(F.length("value")).alias("max_length"),
        )
    return summed.select(
        "column_name",
        "non_null_count",
        (F.col("record_count") - F.col("non_null_count")).alias("null_count"),
        _rate(F.col("record_count") - F.col("non_null_count"), F.col("record_count")).alias("null_rate"),
        "distinct_count",
        _rate(F.col("distinct_count"), F.col("record_count")).alias("uniqueness_ratio"),
        "min_length",
        "max_length",
    )


# Standard error of a sketch of 2 ** 12 registers, and the rank error of a quantile sketch of size 200.
DISTINCT_ERROR, RANK_ERROR = 1.04 / 64, 0.0165


def column_sketches(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mergeable sketches per column, to be stored per snapshot: ``column_name, record_count, non_null_count,
    distinct_sketch, number_sketch``.

    No value is shuffled: a task sends one sketch per column. Numbers are the cells that read as such.
    """
    names = columns or df.columns
    cells = df.select(
        F.inline(F.array(*[
            F.struct(F.lit(n).alias("column_name"), F.when(_is_present(df, n), F.col(f"`{n}`").cast("string")).alias("value"))
            for n in names
        ]))
    )
    return cells.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.count("value").alias("non_null_count"),
        F.hll_sketch_agg("value", F.lit(12)).alias("distinct_sketch"),
        F.kll_sketch_agg_double(F.expr("try_cast(value AS double)"), F.lit(200)).alias("number_sketch"),
    )


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """The sketches of several snapshots as one per column; the rows themselves are not needed again."""
    return sketches.groupBy("column_name").agg(
        F.sum("record_count").alias("record_count"),
        F.sum("non_null_count").alias("non_null_count"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("number_sketch").alias("number_sketch"),
    )


def sketched_stats(sketches: DataFrame, ranks: list[float]) -> DataFrame:
    """Estimates with their bounds (three standard errors): ``distinct_count, distinct_bound, numbers, quantiles``."""
    count = F.hll_sketch_estimate("distinct_sketch")
    numbers = F.kll_sketch_get_n_double("number_sketch")
    quantiles = F.array(*[F.kll_sketch_get_quantile_double("number_sketch", F.lit(float(r))) for r in ranks])
    return sketches.select(
        "column_name", "record_count", "non_null_count",
        count.alias("distinct_count"),
        F.ceil(count * (3 * DISTINCT_ERROR)).alias("distinct_bound"),
        numbers.alias("numbers"),
        F.when(numbers > 0, quantiles).alias("quantiles"),
    )


def pattern_stats(df: DataFrame, column: str, regex: str) -> DataFrame:
    """How many filled cells match a pattern, and the rate."""
    present, hit = _is_present(df, column), F.col(f"`{column}`").rlike(regex)
    return df.agg(
        F.count_if(present).alias("non_null_count"), F.count_if(present & hit).alias("match_count")
    ).withColumn("match_rate", _rate(F.col("match_count"), F.col("non_null_count")))


def decimal_stats(df: DataFrame, column: str) -> DataFrame:
    """Exact smallest, largest and total of decimal text; other text is counted."""
    value = F.col(f"`{column}`").try_cast("decimal(38,2)")
    return df.agg(
        F.min(value).alias("min_decimal"),
        F.max(value).alias("max_decimal"),
        F.sum(value).cast("decimal(38,2)").alias("sum_decimal"),
        F.count_if(F.col(f"`{column}`").isNotNull() & value.isNull()).alias("not_decimal"),
    )


def uniqueness_counterexamples(df: DataFrame, columns: list[str], owner: str) -> DataFrame:
    """Each use of a value (or value tuple) that occurs more than once.

    One row per occurrence with the owning id and its locator, so a value that
    fills a third of the table stays spread over the cluster.
    """
    repeated = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")
    uses = df.select(*columns, F.col(owner).cast("string").alias("owner"))
    return salted_join(uses, repeated, columns).withColumn(
        "locator", field_locator(F.col("owner"), F.lit(",".join(columns)))
    )


def uniqueness_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Repeated values, the rows they cover and whether the columns are a key."""
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.count_if(F.col("n") > 1).alias("duplicate_values"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"),
        (F.max("n") <= 1).alias("globally_unique"),
    )


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value of one column, filled cells only."""
    return (
        df.filter(_is_present(df, column))
        .groupBy(F.col(f"`{column}`").cast("string").alias("category"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def category_map(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """One sorted map of counts over a declared list of values."""
    entries = [
        F.when(
            F.count_if(F.col(f"`{column}`") == v) > 0,
            F.struct(F.lit(v).alias("key"), F.count_if(F.col(f"`{column}`") == v).alias("value")),
        )
        for v in sorted(domain)
    ]
    return df.agg(F.map_from_entries(F.array_compact(F.array(*entries))).alias("counts"))


def pair_counts(df: DataFrame, left: str, right: str) -> DataFrame:
    """Rows per ``left->right`` pair."""
    return (
        df.groupBy(left, right)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.concat_ws("->", left, right).alias("pair"), "n")
    )


def feature_counts(df: DataFrame, column: str) -> DataFrame:
    """``name:0.91|country:1.00`` text to counts and score bounds per feature."""
    parts = df.select(F.explode(F.split(column, r"\|")).alias("part")).filter("part <> ''")
    return parts.groupBy(F.substring_index("part", ":", 1).alias("feature")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.substring_index("part", ":", -1).try_cast("decimal(9,4)")).alias("min_score"),
        F.max(F.substring_index("part", ":", -1).try_cast("decimal(9,4)")).alias("max_score"),
    )


def distinct_counts(df: DataFrame, names: dict[str, str], links: dict[str, str] | None = None) -> DataFrame:
    """Named distinct counters and named counts of filled cells.

    Each counter counts its own (name, value) pairs first, so no rows are
    multiplied by the number of distinct aggregates.
    """
    cells = df.select(
        F.explode(
            F.array(*[
                F.struct(
                    F.lit(name).alias("counter"),
                    F.when(_is_present(df, c), F.col(f"`{c}`").cast("string")).alias("value"),
                )
                for name, c in names.items()
            ])
        ).alias("cell")
    ).select("cell.*")
    distinct = (
        cells.groupBy("counter", "value")
        .agg(F.lit(1))
        .groupBy("counter")
        .agg(F.count("value").alias("n"))
    )
    if not links:
        return distinct
    counted = df.agg(*[F.count_if(_is_present(df, c)).alias(name) for name, c in links.items()])
    long = counted.select(
        F.explode(
            F.array(*[
                F.struct(F.lit(n).alias("counter"), F.col(f"`{n}`").alias("n")) for n in links
            ])
        ).alias("cell")
    ).select("cell.*")
    return distinct.unionByName(long)
