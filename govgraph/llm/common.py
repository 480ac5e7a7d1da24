"""Shared helpers of the training-data operators: word columns, row keys, stored frames, components."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters lower-cased by the contracts, and what they call a word.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine (a test) gets a folder of its own; a cluster is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def modest_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Fewer rows to a Python worker at a time: a batch of texts is then a few MB, in this session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# A side of at most so many rows and bytes of text is sent to every task; beyond, the join is a shuffle.
SMALL_ROWS, SMALL_BYTES = 200_000, 16_000_000


def checked_broadcast(side: DataFrame) -> DataFrame:
    """A stored frame marked for broadcast where its counted rows and bytes are within the bounds.

    Beyond them the frame is returned as it is: the join gives the same rows through a shuffle.
    """
    width = sum(
        (F.coalesce(F.octet_length(c), F.lit(0)) if kind == "string" else F.lit(8) for c, kind in side.dtypes),
        F.lit(8),
    )
    rows, size = side.agg(F.count("*"), F.sum(width)).first()
    return F.broadcast(side) if rows <= SMALL_ROWS and (size or 0) <= SMALL_BYTES else side


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_array(text: Column) -> Column:
    """The lower-cased words of a text; an empty array for null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` of every node in ``edges``; the component is its smallest node.

    Each round alternates "link every larger neighbour to my smallest one" with "link my
    smaller neighbours and me to the smallest", until nothing changes. Rounds grow with
    the logarithm of the longest chain; minima combine before the shuffle, so a hub is no hot
    task. Every round is cut by a reliable checkpoint; only a count reaches the driver.
    """
    shared_folder(edges.sparkSession)
    links = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v").distinct().checkpoint(eager=True)
    )
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        down = large.where("u <> v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u")
        links_next = (
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct().checkpoint(eager=True)
        )
        state = links_next.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        links = links_next
        if state == before:
            break
        before = state
    child = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    root = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return child.unionByName(root)


# --- words as numbers, for the operators that work in Arrow batches ---

_SPACE = np.ones(256, dtype=bool)
_SPACE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


# Powers of P and of its inverse: the first 2 ** 16, and every 2 ** 16th of as many.
_LOW, _HIGH = _table(_P, 1 << 16), _table(np.uint64(pow(int(_P), 1 << 16, 1 << 64)), 1 << 15)
_LOW_INV, _HIGH_INV = _table(_P_INV, 1 << 16), _table(np.uint64(pow(int(_P_INV), 1 << 16, 1 << 64)), 1 << 15)


def _powers(n: int) -> np.ndarray:
    """P ** 0 ... P ** (n - 1) modulo 2 ** 64, for texts up to 2 GB."""
    if n <= len(_LOW):
        return _LOW[:n]
    return np.multiply.outer(_HIGH[: -(-n // len(_LOW))], _LOW).ravel()[:n]


def _inverse(k: np.ndarray) -> np.ndarray:
    """P ** -k modulo 2 ** 64."""
    return _LOW_INV[k & 0xFFFF] * _HIGH_INV[k >> 16]


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash per word of the text (lower-cased runs of letters, digits and non-ASCII)."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.uint64)
    space = np.concatenate(([True], _SPACE[data], [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    # Sum of byte * P ** (bytes to the word's end), taken from one running sum over the text.
    n = len(data)
    up = _powers(n)
    total = np.concatenate(([np.uint64(0)], np.cumsum(data.astype(np.uint64) * up, dtype=np.uint64)))
    value = (total[end] - total[start]) * _inverse(start)
    return mixed(value ^ (end - start).astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash per run of ``size`` words; a shorter text is one shingle of all its words."""
    if not len(words):
        return words
    k = min(size, len(words))
    n = len(words) - k + 1
    out = np.full(n, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0x9FB21C651E98DF25) + words[i : i + n])
    return out


