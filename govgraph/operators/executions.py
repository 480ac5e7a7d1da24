"""Task executions, snapshots, profile heads and drift as batch operators.

The streaming jobs apply the same functions per micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govgraph.functions.digest import deterministic_id
from govgraph.operators.proposals import drift_proposals
from govgraph.session import salted_join

LEASE_SECONDS = 6 * 60


def dedup_executions(deliveries: DataFrame, completed: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first delivery of every key that was not completed before."""
    fields = [c for c in deliveries.columns if c not in key]
    # Copies of a delivery are combined before the shuffle.
    first = deliveries.groupBy(*key).agg(F.min_by(F.struct(*fields), order).alias("_first"))
    fresh = first.join(completed.select(*key).distinct(), key, "left_anti")
    return fresh.select(*key, *[F.col(f"_first.{c}").alias(c) for c in fields])


def lease_state(events: DataFrame, key: list[str], now: str, lease_seconds: int = LEASE_SECONDS) -> DataFrame:
    """Latest status and attempts per execution and whether it can be claimed at ``now``.

    ``events`` has ``status`` (RUNNING, COMPLETED or FAILED), ``at`` and ``seq``. A completed
    execution stays completed. A running one is claimable once its lease is over.
    """
    done = F.max(F.col("status") == "COMPLETED")
    latest = events.groupBy(*key).agg(
        F.max_by(F.struct("status", "at"), F.struct("at", "seq")).alias("_last"),
        F.count_if(F.col("status") == "RUNNING").alias("attempts"),
        F.max(F.when(F.col("status") == "RUNNING", F.col("at"))).alias("started_at"),
        done.alias("_done"),
    )
    status = F.when(F.col("_done"), "COMPLETED").otherwise(F.col("_last.status"))
    age = F.lit(now).cast("timestamp").cast("bigint") - F.col("started_at").cast("timestamp").cast("bigint")
    claimable = F.when(status == "FAILED", True).when(status == "RUNNING", age >= lease_seconds).otherwise(False)
    return latest.select(*key, status.alias("status"), "attempts", claimable.alias("claimable"))


def snapshot_upsert(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Snapshots of a batch against the stored ones, keyed by tenant, source and hash.

    NEW rows carry the first observation. Seeing the same content again is OBSERVED;
    another identity under the same key is CONFLICT.
    """
    key = ["tenant_id", "source_id", "sha256"]
    fields = [c for c in batch.columns if c not in key]
    seen = batch.groupBy(*key).agg(
        F.min_by(F.struct(*fields), "observed_at").alias("_first"),
        F.min("snapshot_id").alias("_low"),
        F.max("snapshot_id").alias("_high"),
    )
    joined = seen.join(stored.select(*key, F.col("snapshot_id").alias("_stored")), key, "left")
    expected = F.coalesce("_stored", F.col("_first.snapshot_id"))
    state = (
        F.when((F.col("_low") != expected) | (F.col("_high") != expected), "CONFLICT")
        .when(F.col("_stored").isNull(), "NEW")
        .otherwise("OBSERVED")
    )
    return joined.select(*key, *[F.col(f"_first.{c}").alias(c) for c in fields], state.alias("state"))


HEAD_KEY = ["tenant_id", "source_id"]


def profile_heads(observations: DataFrame) -> DataFrame:
    """The current profile per source, with the hash it replaced.

    ``observations`` has ``tenant_id, source_id, execution_id, seq, observed_at, sha256,
    snapshot_id, evidence_locator, extractor_version``; ``seq`` is the order of arrival.
    The newest observation is the head; of equally new ones the last to arrive. What
    arrives late and is older never replaces the head. The previous hash is that of
    the head in force when the current one arrived.

    Both steps are aggregates that combine before the shuffle, so a source with a
    third of all observations is no hot task.
    """
    fields = [c for c in observations.columns if c not in HEAD_KEY]
    # A repeated execution counts once, at its first arrival.
    once = observations.groupBy(*HEAD_KEY, "execution_id").agg(
        F.min_by(F.struct(*fields), "seq").alias("_o")
    ).select(*HEAD_KEY, *[F.col(f"_o.{c}").alias(c) for c in fields])
    heads = once.groupBy(*HEAD_KEY).agg(
        F.max_by(F.struct(*fields), F.struct("observed_at", "seq")).alias("_head")
    )
    before = salted_join(once.select(*HEAD_KEY, "observed_at", "seq", "sha256"), heads, HEAD_KEY).filter(
        F.col("seq") < F.col("_head.seq")
    )
    prior = before.groupBy(*HEAD_KEY).agg(
        F.max_by("sha256", F.struct("observed_at", "seq")).alias("previous_sha256")
    )
    joined = heads.join(prior, HEAD_KEY, "left")
    changed = F.coalesce(F.col("previous_sha256") != F.col("_head.sha256"), F.lit(False))
    return joined.select(
        *HEAD_KEY,
        *[F.col(f"_head.{c}").alias(c) for c in fields],
        "previous_sha256",
        changed.alias("content_changed"),
    )


def moved_heads(heads: DataFrame, batch: DataFrame) -> DataFrame:
    """The heads that one more batch of observations replaces; the stored head is the oldest arrival.

    ``heads`` holds those of the batch's sources at least.
    """
    fields = [c for c in batch.columns if c not in HEAD_KEY]
    # Whatever its number, the stored head arrived before the batch.
    first = batch.schema["seq"].dataType
    as_observed = heads.select(*HEAD_KEY, *fields).withColumn("seq", F.lit(-1).cast(first)).select(*HEAD_KEY, *fields)
    touched = batch.select(*HEAD_KEY).distinct()
    again = profile_heads(
        as_observed.join(touched, HEAD_KEY, "left_semi").unionByName(batch.select(*HEAD_KEY, *fields))
    )
    return again.join(as_observed.select(*HEAD_KEY, "execution_id"), [*HEAD_KEY, "execution_id"], "left_anti")


def advance_heads(heads: DataFrame, batch: DataFrame) -> DataFrame:
    """Heads after one more batch of observations.

    A source that the batch does not move keeps its row, including a drift mark.
    """
    moved = moved_heads(heads, batch)
    kept = heads.join(moved.select(*HEAD_KEY), HEAD_KEY, "left_anti")
    return kept.unionByName(moved, allowMissingColumns=True)



def daily_drift(heads: DataFrame, tenants: DataFrame, day: str, ontology_version: str, evaluated_at: str) -> DataFrame:
    """One check row per active tenant and UTC day.

    The changed sources themselves are the rows of ``drift_evidence``; the check
    carries their number and the proposal that commits to them.
    """
    active = tenants.filter("status = 'ACTIVE'").select("tenant_id").distinct()
    counts = heads.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("profiled_count"), F.count_if("content_changed").alias("changed_count")
    )
    proposals = drift_proposals(heads, ontology_version, evaluated_at).select("tenant_id", "proposal_id")
    joined = active.join(counts, "tenant_id", "left").join(proposals, "tenant_id", "left")
    changed = F.coalesce("changed_count", F.lit(0))
    return joined.select(
        "tenant_id",
        F.lit(day).alias("scheduled_day"),
        deterministic_id(F.lit("drift"), F.col("tenant_id"), F.lit(day)).alias("execution_id"),
        F.when(changed > 0, "CHANGES_REQUIRE_REVIEW").otherwise("NO_DRIFT_DETECTED").alias("status"),
        F.coalesce("profiled_count", F.lit(0)).alias("profiled_count"),
        changed.alias("changed_count"),
        "proposal_id",
    )


def ack_drift(heads: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Clear the drift mark of heads that are still what was evaluated.

    A head that moved on since keeps its mark. ``evaluated`` has the key, ``sha256``,
    ``snapshot_id`` and ``proposal_id``.
    """
    seen = evaluated.select(
        *HEAD_KEY, F.col("sha256").alias("_sha"), F.col("snapshot_id").alias("_snapshot"), "proposal_id"
    )
    joined = heads.join(seen, HEAD_KEY, "left")
    same = F.coalesce(
        F.col("content_changed") & (F.col("sha256") == F.col("_sha")) & (F.col("snapshot_id") == F.col("_snapshot")),
        F.lit(False),
    )
    return joined.select(
        *[c for c in heads.columns if c != "content_changed"],
        (F.col("content_changed") & ~same).alias("content_changed"),
        F.when(same, F.col("sha256")).alias("drift_baseline_sha256"),
        F.when(same, F.col("snapshot_id")).alias("drift_baseline_snapshot_id"),
        F.when(same, F.col("proposal_id")).alias("last_drift_proposal_id"),
    )
