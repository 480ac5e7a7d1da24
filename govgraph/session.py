"""Session helpers: shared scratch folder, checkpoints and size-checked joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# A side of at most this many rows may be broadcast. The count is checked with
# limit(n + 1), so checking costs no more than n + 1 rows.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 * 1024 * 1024

# How many ways a join key is spread when one key may hold most of the rows.
SALTS = 8


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine (tests) gets a folder of its own; a cluster is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back.

    For frames that several parts of a plan use: it bounds the plan and survives
    lost executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, max_rows: int = 2_000) -> DataFrame:
    """Work out a frame that is expected to be tiny once, for use in several plans.

    Up to ``max_rows`` rows it becomes a local relation; a larger one is checkpointed.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return checkpointed(df)
    return local_frame(df.sparkSession, rows, df.schema)


def local_frame(spark: SparkSession, rows: list, schema: StructType | str) -> DataFrame:
    """A few rows as a local relation, whose size the optimizer knows.

    ``createDataFrame`` on a list makes a distributed collection of unknown size.
    """
    types = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(types)
    columns = zip(*rows, strict=True) if rows else [()] * len(arrow)
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), types)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly row work on an input of very few partitions.

    A frame with at least as many partitions as there are cores is left alone, so
    large inputs are never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether rows and bytes are within the bounds; long texts count by their length."""
    width = sum(
        (F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) if kind == "string" else F.lit(16) for c, kind in df.dtypes),
        F.lit(8),
    )
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def small_join(
    facts: DataFrame,
    small: DataFrame,
    on,
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join with a side that is expected to be small.

    The size is checked; beyond the bound the join is a salted shuffle join, so a
    hot key of ``facts`` is still spread over several tasks.
    """
    if is_small(small, max_rows):
        return facts.join(F.broadcast(small), on, how)
    return salted_join(facts, grown(small), on, how)


def grown(df: DataFrame) -> DataFrame:
    """A join side that grows with the data, never to be broadcast.

    The optimizer goes by the bytes of compressed files, a small part of what the rows take on the driver.
    """
    return df.hint("merge")


def salted_join(
    facts: DataFrame, keyed: DataFrame, on, how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Equi-join ``facts`` (skewed) with ``keyed`` (few rows per key) by key and salt.

    The salt is a hash of the whole row, so a recomputed task makes the same rows.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join cannot do a {how} join")
    keys = [on] if isinstance(on, str) else list(on)
    left = facts.withColumn("_salt", F.pmod(F.xxhash64(*_hashable(facts)), F.lit(salts)))
    right = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = right.withColumn("_salt", F.col("_salt").cast("bigint"))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def _hashable(df: DataFrame) -> list:
    # Maps and variants cannot be hashed; every other column takes part.
    return [
        F.col(f"`{f.name}`")
        for f in df.schema.fields
        if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()
    ]
