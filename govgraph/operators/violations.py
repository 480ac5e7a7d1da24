"""Findings are rows ``(rule, key, detail)``; these helpers build and require them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ViolationError(ValueError):
    """A frame that had to be empty holds findings."""


LIST_MARK = "\x1e"


def text_list(texts: list[Column]) -> Column:
    """The texts that are not null, as an array.

    Joining and splitting stays in generated code, which array filters do not.
    """
    return F.array_remove(F.split(F.concat_ws(LIST_MARK, *texts), LIST_MARK), "")


def rule_array(rules: list[tuple[str, Column]]) -> Column:
    """The names of the rules a row breaks, in the given order; null counts as broken."""
    return text_list([F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules])


def finding_rows(df: DataFrame, key: Column, rules: list[tuple[str, Column]]) -> DataFrame:
    """One row per row and broken rule, from a single pass."""
    return df.select(
        F.explode(rule_array(rules)).alias("rule"), key.cast("string").alias("key")
    ).withColumn("detail", F.lit(None).cast("string"))


def findings(df: DataFrame, rule: str, key: Column, detail: Column | None = None) -> DataFrame:
    """Every row of ``df`` is one finding."""
    return df.select(
        F.lit(rule).alias("rule"),
        key.cast("string").alias("key"),
        (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def require_empty(violations: DataFrame, what: str) -> None:
    """Raise when there are findings, naming a few of them."""
    shown = violations.limit(5).collect()
    if shown:
        raise ViolationError(f"{what}: " + "; ".join(f"{r['rule']} {r['key']}" for r in shown))
