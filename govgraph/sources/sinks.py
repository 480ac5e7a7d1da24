"""Append-only tables and deterministic profile bundles."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govgraph.session import salted_join, stored
from govgraph.sources.store import exists


def classify_append(incoming: DataFrame, existing: DataFrame, keys: list[str], hash_column: str) -> DataFrame:
    """Mark each incoming row NEW, IDENTICAL or CONFLICT against an append-only table.

    Rows that share a key within the batch are one group: the smallest hash wins,
    equal hashes are one row and others conflict.
    """
    best = incoming.groupBy(*keys).agg(F.min(hash_column).alias("_first"))
    stored = existing.select(*keys, F.col(hash_column).alias("_stored"))
    wanted = best.join(stored, keys, "left")
    state = (
        F.when(F.coalesce(F.col("_stored"), F.col("_first")) != F.col(hash_column), "CONFLICT")
        .when(F.col("_stored").isNull(), "NEW")
        .otherwise("IDENTICAL")
    )
    single = incoming.dropDuplicates([*keys, hash_column])
    return salted_join(single, wanted, keys).withColumn("append_state", state).drop("_first", "_stored")


# Beside the data: what each file may hold. A leading underscore hides it from readers of the table.
INDEX = "_key_index"
INDEX_ROW = "file string, low string, high string, blocks int, block int, bits binary"
# A block of the Bloom filter is one bitmap; a key sets BITS of its bits and there is a block for so many keys.
BLOCK_BITS, BLOCK_KEYS, BITS = 32_768, 4_096, 3


def _file_key(path: str) -> str:
    return re.sub(r"^[A-Za-z0-9+.-]+:/*", "/", unquote(path))


def _key_columns(df: DataFrame, keys: list[str], blocks: Column) -> DataFrame:
    """``_first`` key as text, and the block and bits of the filter that the whole key falls on."""
    hashed = F.xxhash64(*[F.col(k).cast("string") for k in keys], *[F.col(k).isNull() for k in keys])
    spots = F.array(*[F.pmod(F.xxhash64(F.lit(n), hashed), F.lit(BLOCK_BITS)).cast("int") for n in range(BITS)])
    return df.select(
        "*",
        F.coalesce(F.col(keys[0]).cast("string"), F.lit("")).alias("_first"),
        F.pmod(hashed, blocks).cast("int").alias("block"),
        spots.alias("_spots"),
    )


def index_files(spark: SparkSession, path: str, files: list[str], keys: list[str]) -> None:
    """Write the key ranges and Bloom filters of some files of the table at ``path``."""
    rows = spark.read.option("basePath", path).parquet(*files)
    rows = rows.select(*keys, F.col("_metadata.file_path").alias("_path"))
    counts = rows.groupBy(F.col("_path").alias("_counted")).agg(
        F.greatest(F.lit(1), F.pow(2.0, F.ceil(F.log2(F.count(F.lit(1)) / BLOCK_KEYS)))).cast("int").alias("blocks")
    )
    sized = rows.join(F.broadcast(counts), F.col("_path") == F.col("_counted"))
    marked = _key_columns(sized, keys, F.col("blocks")).withColumn("_spot", F.explode("_spots"))
    made = marked.groupBy("_path", "blocks", "block").agg(
        F.min("_first").alias("low"), F.max("_first").alias("high"), F.bitmap_construct_agg("_spot").alias("bits")
    )
    made.select(F.col("_path").alias("file"), "low", "high", "blocks", "block", "bits").write.mode("append").parquet(f"{path}/{INDEX}")


def files_that_may_hold(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str]) -> list[str]:
    """Files of the table that may hold a key of ``incoming``; a file without an index may.

    A key meets one block per file, by an equi-join, and is tested against the range and the bits of that block.
    """
    files = spark.read.parquet(path).inputFiles()
    if not exists(spark, f"{path}/{INDEX}"):
        return files
    index = spark.read.schema(INDEX_ROW).parquet(f"{path}/{INDEX}")
    known = {_file_key(r["file"]) for r in index.select("file").distinct().collect()}
    sizes = [r["blocks"] for r in index.select("blocks").distinct().collect()]
    asked = incoming.select(*keys).distinct().withColumn("blocks", F.explode(F.array(*[F.lit(n) for n in sizes])))
    asked = _key_columns(asked, keys, F.col("blocks")).select("blocks", "block", "_first", "_spots")
    met = asked.join(index, ["blocks", "block"]).filter(F.col("_first").between(F.col("low"), F.col("high")))

    def is_set(spot: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("bits"), (spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.pmod(F.floor(byte / F.pow(F.lit(2.0), spot % 8)), F.lit(2)) == 1

    hit = met.filter(F.forall("_spots", is_set)).select("file").distinct()
    may = {_file_key(r["file"]) for r in hit.collect()}
    return [f for f in files if _file_key(f) not in known or _file_key(f) in may]


def append_only_sink(
    incoming: DataFrame, path: str, keys: list[str], hash_column: str, partition_by: list[str] | None = None
) -> DataFrame:
    """Append the new rows to the Parquet table at ``path``; give back the conflicts.

    Delivering the same rows again adds nothing; rows that lack a part of their key are not stored. Key ranges and Bloom filters are kept per file, so an append reads
    the keys of files that may hold one of its own, once; the rows it adds are then read for their index.
    """
    spark = incoming.sparkSession
    existing = incoming.select(*keys, hash_column).limit(0)
    if exists(spark, path):
        files = files_that_may_hold(spark, path, incoming, keys)
        if files:
            existing = spark.read.option("basePath", path).parquet(*files).select(*keys, hash_column)
    marked = stored(classify_append(incoming, existing, keys, hash_column), "append")
    fresh = marked.filter("append_state = 'NEW'").drop("append_state")
    writer = fresh.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    known = set()
    if exists(spark, f"{path}/{INDEX}"):
        index = spark.read.schema(INDEX_ROW).parquet(f"{path}/{INDEX}")
        known = {_file_key(r["file"]) for r in index.select("file").distinct().collect()}
    new = [f for f in spark.read.parquet(path).inputFiles() if _file_key(f) not in known]
    if new:
        index_files(spark, path, new, keys)
    return marked.filter("append_state = 'CONFLICT'")


def write_once(df: DataFrame, path: str) -> None:
    """A one-shot ledger: refuses a path that exists."""
    df.write.mode("errorifexists").parquet(path)


BUNDLE_PARTITIONS = ("tenant_id", "source_id", "snapshot_id")


def write_profile_bundle(
    artifacts: dict[str, DataFrame], path: str, partition_by: tuple[str, ...] = BUNDLE_PARTITIONS
) -> None:
    """Each artifact as Parquet below its name, one partition per tenant, source and snapshot.

    Only the partitions in the input are replaced: the same input leaves the same content, and older
    snapshots stay. Rows are rebalanced, so a source with most of the rows is written by many tasks.
    """
    for name in sorted(artifacts):
        frame = artifacts[name]
        keys = [c for c in partition_by if c in frame.columns]
        (
            frame.select(*sorted(frame.columns))
            .hint("rebalance", *keys)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*keys)
            .parquet(f"{path.rstrip('/')}/{name}")
        )
