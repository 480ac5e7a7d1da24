"""Metrics, source inventory, question register, audit rows and response envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from govgraph.functions.text import collapse_spaces, nfkc
from govgraph.session import salted_join, small_join

# Listed states and areas.
PROPOSAL_STATES = ("PENDING_VERIFICATION", "HUMAN_REVIEW", "ABSTAINED", "APPROVED")
BUSINESS_AREAS = ("kyc-aml", "payments", "risk", "customer", "other")
SOURCE_TYPES = ("csv", "jsonl", "pdf", "openapi")
SOURCE_ID = r"^[a-z][a-z0-9-]{2,63}\z"


def counts_by(df: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """Rows per tenant and listed value, zero where there are none; other values are left out."""
    counts = df.groupBy("tenant_id").agg(*[F.count_if(F.col(column) == v).alias(v) for v in domain])
    pairs = F.array(*[F.struct(F.lit(v).alias(column), F.col(f"`{v}`").alias("n")) for v in domain])
    return counts.select("tenant_id", F.inline(pairs))


def _newest(df: DataFrame, n: int, order: list) -> DataFrame:
    """The first ``n`` rows of every tenant; Spark cuts the ranks in the map tasks already."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy("tenant_id").orderBy(*order)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def scalar_metrics(proposals: DataFrame, runs: DataFrame, heads: DataFrame, checks: DataFrame) -> DataFrame:
    """One row per tenant of totals and latest values."""
    of_proposals = proposals.groupBy("tenant_id").agg(
        F.count_if(F.col("status").isin(*PROPOSAL_STATES)).alias("total"),
        F.count_if(F.col("status") == "HUMAN_REVIEW").alias("pending_review"),
    )
    of_runs = runs.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("run_count"),
        F.max_by("mode", F.struct("decided_at", "verification_run_id")).alias("latest_mode"),
        F.max("decided_at").alias("latest_decided_at"),
    )
    of_heads = heads.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("profiled_count"), F.count_if("content_changed").alias("changed_count")
    )
    of_checks = checks.groupBy("tenant_id").agg(
        F.max("scheduled_day").alias("latest_day"), F.max_by("status", "scheduled_day").alias("latest_status")
    )
    joined = of_proposals
    for part in (of_runs, of_heads, of_checks):
        joined = joined.join(part, "tenant_id", "full_outer")
    zero = ("total", "pending_review", "run_count", "profiled_count", "changed_count")
    return joined.select(
        "tenant_id",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in zero],
        "latest_mode",
        "latest_decided_at",
        "latest_day",
        "latest_status",
    )


def gate_histogram(proposals: DataFrame, n: int = 25) -> DataFrame:
    """Gate states over the ``n`` most recently verified proposals of every tenant."""
    recent = _newest(proposals.filter("verified_at IS NOT NULL"), n, [F.desc("verified_at"), "proposal_id"])
    entries = recent.select("tenant_id", F.explode("gate_summary").alias("entry"))
    states = entries.select("tenant_id", F.col("entry.status").alias("status")).filter("status <> ''")
    return states.groupBy("tenant_id", "status").agg(F.count(F.lit(1)).alias("n"))


def recent_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    """The newest runs of every tenant."""
    top = _newest(runs, n, [F.desc("decided_at"), "verification_run_id"])
    return top.select("tenant_id", "verification_run_id", "proposal_id", "status", "mode", "decided_at")


def source_inventory(connections: DataFrame, profiles: DataFrame) -> DataFrame:
    """All sources known from either side, READY once profiled."""
    key = ["tenant_id", "source_id"]
    joined = connections.join(profiles, key, "full_outer")
    ready = F.col("sha256").isNotNull() & (F.col("sha256") != "")
    return joined.select(
        *key,
        F.coalesce("display_name", "source_id").alias("name"),
        F.coalesce(F.upper("source_type"), "media_type", F.lit("FILE")).alias("kind"),
        F.when(ready, "READY").otherwise(F.coalesce("status", F.lit("PROFILING"))).alias("status"),
        "field_count",
        F.coalesce("record_count", "observed_record_count").alias("records"),
        F.coalesce("byte_size", "size_bytes").alias("bytes"),
        "sha256",
    )


def inventory_totals(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("sources"),
        F.count_if(F.col("status") == "READY").alias("ready"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
    )


def register_questions(questions: DataFrame, existing: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Incoming questions with id and REGISTERED, CONFLICT or INVALID.

    ``questions`` has ``tenant_id, arrival, text, business_area``. Of equivalent new
    questions the first one is registered.
    """
    text = collapse_spaces(F.col("text"))
    normal = F.lower(text if ascii_only else collapse_spaces(nfkc(text)))
    staged = questions.select(
        "tenant_id",
        "arrival",
        text.alias("text"),
        "business_area",
        F.concat(F.lit("CQT-"), F.substring(F.sha2(normal, 256), 1, 12)).alias("question_id"),
    )
    valid = F.length("text").between(10, 500) & F.col("business_area").isin(*BUSINESS_AREAS)
    staged = staged.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    key = ["tenant_id", "question_id"]
    first = staged.filter("_valid").groupBy(*key).agg(F.min("arrival").alias("_first"))
    known = existing.select(*key).distinct().withColumn("_known", F.lit(True))
    # The same question may be sent very often.
    joined = salted_join(staged, first.join(known, key, "left"), key, "left")
    state = (
        F.when(~F.col("_valid"), "INVALID")
        .when(F.col("_known") | (F.col("arrival") > F.col("_first")), "CONFLICT")
        .otherwise("REGISTERED")
    )
    return joined.select(*key, "arrival", "text", "business_area", state.alias("state"))


def list_questions(questions: DataFrame, n: int = 50) -> DataFrame:
    """The newest well-formed questions of every tenant."""
    ok = (
        F.length("text").between(10, 500)
        & F.col("business_area").isin(*BUSINESS_AREAS)
        & (F.col("status") == "PROPOSED")
        & F.col("question_id").rlike(r"^CQT-[a-f0-9]{12}\z")
    )
    newest = _newest(questions.filter(ok), n, [F.desc("created_at"), "question_id"])
    return newest.select("tenant_id", "question_id", "text", "business_area", "status", "created_at")


def audit_events(changes: DataFrame, event_type: str, subject: str, details: list[str]) -> DataFrame:
    """One audit row per state change; its id follows from tenant, type and subject."""
    event_id = F.sha2(F.concat_ws("\x1f", F.lit(event_type), "tenant_id", F.col(subject).cast("string")), 256)
    return changes.select(
        event_id.alias("event_id"),
        "tenant_id",
        F.lit(event_type).alias("event_type"),
        "actor",
        F.col(subject).cast("string").alias("subject"),
        F.to_json(F.struct(*sorted(details)), {"ignoreNullFields": "false"}).alias("details"),
    )


def register_sources(requests: DataFrame, existing: DataFrame, objects: DataFrame) -> DataFrame:
    """Incoming sources with INVALID, CONFLICT or their first state.

    ``requests`` has ``tenant_id, source_id, arrival, display_name, source_type``;
    ``objects`` lists stored uploads. A registered source without stored object is
    UPLOAD_FAILED, with one it is INGESTION_QUEUED.
    """
    key = ["tenant_id", "source_id"]
    name = F.trim("display_name")
    ok = (
        F.col("source_id").rlike(SOURCE_ID)
        & F.length(name).between(3, 80)
        & F.col("source_type").isin(*SOURCE_TYPES)
    )
    staged = requests.withColumn("_valid", F.coalesce(ok, F.lit(False))).withColumn("display_name", name)
    first = staged.filter("_valid").groupBy(*key).agg(F.min("arrival").alias("_first"))
    known = existing.select(*key).distinct().withColumn("_known", F.lit(True))
    stored = objects.select(*key).distinct().withColumn("_stored", F.lit(True))
    lookup = first.join(known, key, "left").join(stored, key, "left")
    joined = salted_join(staged, lookup, key, "left")
    state = (
        F.when(~F.col("_valid"), "INVALID")
        .when(F.col("_known") | (F.col("arrival") > F.col("_first")), "CONFLICT")
        .when(F.col("_stored"), "INGESTION_QUEUED")
        .otherwise("UPLOAD_FAILED")
    )
    mode = F.when(F.col("source_type") == "openapi", "SCHEMA_UPLOAD").otherwise("FILE_UPLOAD")
    return joined.select(*key, "arrival", "display_name", mode.alias("connector_mode"), state.alias("state"))


DEGRADED = "The candidate failed verification; the last valid ontology stays active."
NOT_PUBLISHED = "Not published: mappings are proposals and no governed semantics."


def with_governance(df: DataFrame, releases: DataFrame) -> DataFrame:
    """Attach version, publication state, warnings and answer status by tenant.

    ``releases`` has one row per tenant with ``ontology_version, publication_state,
    release_status``. ``df`` may carry ``abstained`` and ``truncated``.
    """
    warnings = F.array_compact(
        F.array(
            F.when(F.col("release_status") != "READY", DEGRADED),
            F.when(F.col("publication_state") != "PUBLISHED", NOT_PUBLISHED),
        )
    )

    def flag(name: str):
        return F.coalesce(name, F.lit(False)) if name in df.columns else F.lit(False)

    status = F.when(flag("abstained"), "ABSTAINED").when(flag("truncated"), "PARTIAL").otherwise("OK")
    side = releases.select("tenant_id", "ontology_version", "publication_state", "release_status")
    joined = small_join(df, side, "tenant_id", "left")
    return joined.select(
        *df.columns, "ontology_version", "publication_state", warnings.alias("warnings"), status.alias("status")
    )
