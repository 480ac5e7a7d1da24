"""Exact comparison of results with their golden rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUIRED_QUESTIONS = tuple(f"CQ-{n:03d}" for n in range(1, 6))


def _as_rows(df: DataFrame, columns: list[str], case: list[str], position: str | None) -> DataFrame:
    # Nulls and texts are told apart by the JSON form.
    row = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"})
    place = F.lit(0) if position is None else F.col(position)
    return df.select(*case, place.alias("place"), row.alias("row"))


def golden_compare(
    actual: DataFrame, expected: DataFrame, case: list[str], position: str | None = "position"
) -> DataFrame:
    """Differences between two frames of result rows, per case.

    Rows must agree exactly, at their position unless ``position`` is None; then each
    row must occur equally often. No rows means equal.
    """
    columns = [c for c in expected.columns if c not in (*case, position)]
    key = [*case, "place", "row"]
    sides = [
        _as_rows(df, columns, case, position).groupBy(*key).agg(F.count(F.lit(1)).alias(n))
        for df, n in ((actual, "actual_n"), (expected, "expected_n"))
    ]
    joined = sides[0].join(sides[1], key, "full_outer")
    counts = [F.coalesce(c, F.lit(0)) for c in ("actual_n", "expected_n")]
    return joined.select(*key, counts[0].alias("actual_n"), counts[1].alias("expected_n")).filter(
        counts[0] != counts[1]
    )


def golden_status(differences: DataFrame, cases: DataFrame, case: list[str]) -> DataFrame:
    """PASS or FAIL per case, with a finding where the declared status is another."""
    wrong = differences.groupBy(*case).agg(F.count(F.lit(1)).alias("differences"))
    joined = cases.join(wrong, case, "left")
    derived = F.when(F.col("differences").isNull(), "PASS").otherwise("FAIL")
    return joined.select(
        *case,
        "declared_status",
        derived.alias("derived_status"),
        F.coalesce("differences", F.lit(0)).alias("differences"),
        F.when(F.coalesce(F.col("declared_status") != derived, F.lit(True)), "STATUS_NOT_DERIVED").alias("finding"),
    )


def golden_summary(results: DataFrame, suite: list[str], required: tuple[str, ...] = REQUIRED_QUESTIONS) -> DataFrame:
    """Totals per suite and whether it holds exactly the required questions, once each."""
    needed = F.array(*[F.lit(q) for q in required])
    # Only required ids are listed, so the set stays as short as that list.
    known = F.collect_set(F.when(F.col("question_id").isin(*required), F.col("question_id")))
    return results.groupBy(*suite).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("derived_status") == "PASS").alias("passed"),
        (F.size(F.array_except(needed, known)) == 0).alias("_all"),
    ).select(
        *suite,
        "total",
        "passed",
        (F.col("_all") & (F.col("total") == len(required))).alias("complete"),
    )
