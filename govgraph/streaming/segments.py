"""A table of newest rows per key as a log of segments: a batch writes what it changes, merges keep the log short.

``segment=<first batch>-<last batch>`` holds the newest row per key of these batches, dealt into buckets by a
hash of the key. ``FANOUT`` neighbours of one size are merged into the next size, so a row is rewritten once per
size, a logarithm of the number of batches. A merge takes segments of committed batches only and is the same
whenever it is repeated; what it replaces is dropped one batch later, when no reader started before it can be left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from govgraph.sources.store import exists, folder_names, remove

FANOUT, BUCKETS = 4, 64


def _name(low: int, high: int) -> str:
    return f"segment={low:012d}-{high:012d}"


def segments(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """Complete segments, those that a merge has replaced included."""
    found = [name for name in folder_names(spark, path) if name.startswith("segment=")]
    complete = [name for name in found if exists(spark, f"{path}/{name}/_SUCCESS")]
    return [tuple(int(n) for n in name.removeprefix("segment=").split("-")) for name in complete]


def active(found: list[tuple[int, int]], before: int | None = None) -> list[tuple[int, int]]:
    """The widest segments that end before a batch, in order."""
    usable = [s for s in found if before is None or s[1] < before]
    return sorted(s for s in usable if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in usable))


def _bucket(key: list[str], buckets: int):
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def write_segment(rows: DataFrame, path: str, low: int, high: int, key: list[str], buckets: int = BUCKETS) -> None:
    dealt = rows.withColumn("bucket", _bucket(key, buckets)).repartition("bucket")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{_name(low, high)}")


def newest(
    spark: SparkSession, path: str, schema: StructType, key: list[str], among: list[tuple[int, int]], buckets: list[int] | None = None
) -> DataFrame:
    """The newest row per key in the given segments; only the given buckets are read."""
    if not among:
        return spark.createDataFrame([], schema)
    wide = StructType([*schema.fields, StructField("segment", StringType()), StructField("bucket", IntegerType())])
    rows = spark.read.schema(wide).option("basePath", path).parquet(*[f"{path}/{_name(*s)}" for s in among])
    if buckets is not None:
        rows = rows.filter(F.col("bucket").isin(buckets))
    fields = [f.name for f in schema.fields if f.name not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*fields), "segment").alias("_row"))
    return last.select(*[F.col(f.name) if f.name in key else F.col(f"_row.{f.name}").alias(f.name) for f in schema.fields])


def lookup(spark: SparkSession, path: str, schema: StructType, keys: DataFrame, batch: int, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``keys`` as they stood before a batch; buckets without any of the keys are not read."""
    names = keys.columns
    wanted = [r[0] for r in keys.select(_bucket(names, buckets).alias("b")).distinct().collect()]
    rows = newest(spark, path, schema, names, active(segments(spark, path), batch), wanted)
    return rows.join(keys, names, "left_semi")


def merge(spark: SparkSession, path: str, schema: StructType, key: list[str], batch: int, fanout: int = FANOUT) -> None:
    """Merge neighbours of one size among the batches before ``batch``, and drop what earlier merges replaced."""
    found = segments(spark, path)
    current = active(found, batch)
    for low, high in found:
        if high < batch and (low, high) not in current:
            remove(spark, f"{path}/{_name(low, high)}")

    def size(segment: tuple[int, int]) -> int:
        width, power = segment[1] - segment[0] + 1, 0
        while fanout ** (power + 1) <= width:
            power += 1
        return power

    at = len(current)
    while at >= fanout:
        group = current[at - fanout : at]
        if len({size(s) for s in group}) == 1:
            low, high = group[0][0], group[-1][1]
            write_segment(newest(spark, path, schema, key, group), path, low, high, key)
            current[at - fanout : at] = [(low, high)]
            at = len(current)
        else:
            at -= 1
