"""Lines and quoted records of large text files, numbered and cut by many tasks.

Spark splits a file at line ends. What a split cannot know by itself, how many lines stand before it and whether it
begins inside quotes, follows from one small row per split and a prefix over the splits of a file. So a file
is read twice, by as many tasks as it has splits, and no file is gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from govgraph.session import is_small, salted_join, stored

BOM = "﻿"


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, split, order, value``: order ascends within a split; a carriage return at the end stays."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("order"),
        "value",
    )


def _without_bom(value: Column, line: Column) -> Column:
    return F.when((line == 1) & value.startswith(BOM), F.substring(value, 2, 2**31 - 1)).otherwise(value)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line, value`` of every line; numbers are those of the file, from 1.

    Splits are dealt alike by both scans; should the cluster change its size in between so that they are not, the read
    fails instead of giving wrong numbers.
    """
    rows = split_lines(spark, path)
    splits = stored(rows.groupBy("path", "split").agg(F.count(F.lit(1)).alias("n"), F.min("order").alias("first")), "line-splits")
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select("path", "split", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("_base"))
    # A split has many lines and one row here.
    met = rows.join(F.broadcast(bases), ["path", "split"], "left") if is_small(splits) else salted_join(rows, bases, ["path", "split"], "left")
    checked = F.when(F.col("_base").isNull(), F.raise_error(F.lit("the splits of a file changed while it was read")).cast("bigint"))
    line = (F.col("order") + checked.otherwise(F.col("_base")) + 1).cast("int")
    return _trimmed(met.select("path", line.alias("line"), "value"))


def _trimmed(lines: DataFrame) -> DataFrame:
    value = F.regexp_replace(_without_bom(F.col("value"), F.col("line")), r"\r\z", "")
    return lines.select("path", "line", value.alias("value"))


def content_lines(objects: DataFrame) -> DataFrame:
    """``path, line, value`` of every line of ``path, content`` rows, as ``numbered_lines`` gives them for files."""
    text = F.col("content").cast("string")
    # A line end at the end of the content begins no further line.
    whole = F.when(text.endswith("\n"), F.substring(text, F.lit(1), F.length(text) - 1)).when(text != "", text)
    found = objects.select("path", F.posexplode(F.split(whole, "\n")).alias("_at", "value"))
    return _trimmed(found.select("path", (F.col("_at") + 1).alias("line"), "value"))


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line of CSV ends inside quotes, given how it begins.

    A quote opens a cell only at its start; doubled quotes inside stand for one.
    """
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
                continue
            inside = False
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        at = line.find(",", at) + 1
        if not at:
            return False


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per split its lines, and for either way to begin: whether it ends inside quotes, and in a record begun in it."""
    found: dict[tuple[str, int], list] = {}
    for batch in batches:
        for path, split, value in zip(batch["path"], batch["split"], batch["value"], strict=True):
            now = found.setdefault((path, split), [0, False, False, True, False])
            if now[0] == 0 and split == 0:
                value = value.removeprefix(BOM)
            now[0] += 1
            for k in (1, 3):
                inside = now[k]
                if '"' in value:
                    now[k] = ends_inside(value, inside)
                # Records end with lines: the open one began here if a line of this split began it.
                now[k + 1] = now[k] and (now[k + 1] or not inside)
    rows = [(*key, *now) for key, now in found.items()]
    yield pd.DataFrame(rows, columns=["path", "split", "n", "out_inside", "out_own", "in_inside", "in_own"])


_SUMMARY = "path string, split bigint, n bigint, out_inside boolean, out_own boolean, in_inside boolean, in_own boolean"
_RECORD = "path string, line bigint, value string, split bigint, part_of bigint"


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """``path, line, value``: CSV records with the line breaks of their quoted cells, and the line each begins in.

    The state of each split comes from its neighbours' summaries; the driver holds a few numbers per split, as it
    holds a task for each. Records that lie over a border of splits are put together from their parts.
    """
    rows = split_lines(spark, path).select("path", "split", "value")
    state: dict[tuple[str, int], tuple[bool, int, int]] = {}
    inside, part_of, line, last = False, -1, 1, None
    for s in rows.mapInPandas(_summaries, _SUMMARY).sort("path", "split").toLocalIterator():
        if s["path"] != last:
            inside, part_of, line, last = False, -1, 1, s["path"]
        state[s["path"], s["split"]] = (inside, part_of, line)
        own = s["in_own"] if inside else s["out_own"]
        inside = s["in_inside"] if inside else s["out_inside"]
        part_of = s["split"] if own else part_of if inside else -1
        line += s["n"]
    shared = spark.sparkContext.broadcast(state)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, inside, start, held, joined_to = None, False, 0, [], -1
        line = 0
        for batch in batches:
            out = []
            for path, split, value in zip(batch["path"], batch["split"], batch["value"], strict=True):
                if (path, split) != key:
                    if held:
                        out.append((key[0], start, "\n".join(held), key[1], joined_to if joined_to >= 0 else key[1]))
                    key, held = (path, split), []
                    if key not in shared.value:
                        raise ValueError("the splits of a file changed while it was read")
                    inside, joined_to, line = shared.value[key]
                    if line == 1:
                        value = value.removeprefix(BOM)
                    start = line
                if not held:
                    start = line
                held.append(value)
                line += 1
                if '"' in value:
                    inside = ends_inside(value, inside)
                if not inside:
                    text = "\n".join(held)
                    out.append((path, start, text.removesuffix("\r"), split, joined_to if joined_to >= 0 else None))
                    held, joined_to = [], -1
            yield _records(out)
        if held:
            yield _records([(key[0], start, "\n".join(held), key[1], joined_to if joined_to >= 0 else key[1])])

    def _records(out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["path", "line", "value", "split", "part_of"])
        return frame.astype({"line": "int64", "split": "int64", "part_of": "Int64"})

    found = stored(rows.mapInPandas(cut, _RECORD), "records")
    whole = found.filter("part_of IS NULL").select("path", "line", "value")
    part = F.struct("split", "value")
    parts = found.filter("part_of IS NOT NULL").groupBy("path", "part_of").agg(
        F.min("line").alias("line"), F.array_sort(F.collect_list(part)).alias("_parts")
    )
    joined = parts.select("path", "line", F.array_join("_parts.value", "\n").alias("value"))
    return whole.unionByName(joined)
