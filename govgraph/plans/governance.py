"""The given tables as governed records.

Orders stand for proposals with known defects, events for observations of sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govgraph.operators import executions, proposals, review, verification
from govgraph.plans.registry import table
from govgraph.session import small_join, spread, stored

EVALUATED_AT = "2026-07-01T00:00:00Z"
K = F.col


def named_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the tenant and id of the proposal that each of them is."""
    names = {"tenant_id": F.concat(F.lit("t"), K("o_custkey") % 3), "proposal_id": F.concat(F.lit("p"), "o_orderkey")}
    return table(spark, sf, "orders").withColumns(names)


def order_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Each order is a proposal; remainders of its key say which defects it has."""
    return proposals_of(spread(named_orders(spark, sf)))


def proposals_of(orders: DataFrame, *more: str) -> DataFrame:
    """The proposals of ``named_orders``, with ``more`` of their columns."""
    k = K("o_orderkey")
    kinds = F.array(*[F.lit(v) for v in proposals.PROPOSAL_KINDS])
    tenant, name = K("tenant_id"), K("proposal_id")
    snapshot = F.concat(F.lit("src@sha256:"), F.sha2(K("o_orderpriority"), 256))
    item = proposals.evidence_item(
        evidence_id=F.concat(F.lit("e"), k),
        tenant_id=F.when(k % 43 == 7, "other").otherwise(tenant),
        source_id=F.lit("src"),
        snapshot_id=snapshot,
        locator=F.concat(F.lit("orders#row="), k),
        observed_at=F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        extractor_version=F.lit("x/1"),
        content_sha256=F.when(k % 47 == 8, "bad").otherwise(F.sha2(K("o_orderpriority"), 256)),
        claim=F.lit("c"),
    )
    lexical = F.when(k % 59 == 10, "1.5").otherwise("0.5")
    extra = F.when(k % 61 == 11, ',"total":1').otherwise("")
    confidence = F.concat(
        F.lit('{"evidence_coverage":1,"external":0,"instance":0,"lexical":'), lexical, F.lit(',"model":0,"structural":1'), extra, F.lit("}")
    )
    mode = F.when(k % 67 == 12, "magic").otherwise("live")
    generator = F.concat(
        F.lit('{"latency_ms":5,"mode":"'), mode, F.lit('","model":"models/gemini-2.0-'),
        F.when(k % 2 == 0, "pro-latest").otherwise("pro-preview-20250101"),
        F.lit('","model_participated":true,"parameters":{},"prompt_version":"v1","provider":"Google","provider_returned_model_id":null,"response_status":"ok","token_usage":null}'),
    )
    text = F.concat(F.lit('{"key":'), k, F.lit("}"))
    made = {
        "schema_version": F.lit("1.0"),
        "proposal_id": name,
        "tenant_id": tenant,
        "kind": F.when(k % 37 == 5, "unknown").otherwise(F.get(kinds, (k % 8).cast("int"))),
        "risk": F.when(K("o_orderpriority") < "3", "high").when(K("o_orderpriority") < "4", "medium").otherwise("low"),
        "source_snapshot_ids": F.array(snapshot),
        "active_ontology_version": F.lit("1.0"),
        "source_locator": F.concat(F.lit("orders#row="), k),
        "target_iri": F.concat(F.lit("urn:x:"), K("o_orderstatus")),
        "transformation": F.lit("identity"),
        "evidence": F.array(item),
        "counterevidence": proposals.no_evidence(),
        "confidence": confidence,
        "generator": generator,
        "algorithm_version": F.lit("a/1"),
        "deterministic_input": text,
        "deterministic_input_hash": F.when(k % 53 == 9, F.sha2(F.lit("x"), 256)).otherwise(F.sha2(text, 256)),
        "status": F.when(k % 41 == 6, "HUMAN_REVIEW").otherwise("PENDING_VERIFICATION"),
        "reason_codes": F.array(F.lit("R")),
    }
    return orders.select(*[made[f].alias(f) for f in proposals.PROPOSAL_FIELDS], *more)


# The same in SQL: key, tenant, id, defects and validity.
PROPOSALS = """WITH p AS (SELECT o_orderkey AS k, 't' || (o_custkey % 3) AS tenant_id, 'p' || o_orderkey AS proposal_id, o_orderstatus,
    o_orderpriority, o_orderdate,
    CASE WHEN o_orderkey % 37 = 5 THEN 'unknown' ELSE (['concept','relation','alias','mapping','duplicate','constraint','assertion','drift'])[o_orderkey % 8 + 1] END AS kind,
    CASE WHEN o_orderpriority < '3' THEN 'high' WHEN o_orderpriority < '4' THEN 'medium' ELSE 'low' END AS risk,
    concat_ws('; ', CASE WHEN o_orderkey % 37 = 5 THEN 'kind INVALID' END, CASE WHEN o_orderkey % 41 = 6 THEN 'status NOT_PENDING' END,
      CASE WHEN o_orderkey % 53 = 9 THEN 'deterministic_input_hash DIFFERENT' END,
      CASE WHEN o_orderkey % 61 = 11 THEN 'confidence UNKNOWN_FIELD' END,
      CASE WHEN o_orderkey % 59 = 10 THEN 'confidence.lexical OUT_OF_RANGE' END,
      CASE WHEN o_orderkey % 67 = 12 THEN 'generator.mode INVALID' END,
      CASE WHEN o_orderkey % 43 = 7 THEN 'evidence[0] OTHER_TENANT' END,
      CASE WHEN o_orderkey % 47 = 8 THEN 'evidence[0] CONTENT_SHA256_FORM' END) AS errors FROM orders),
  v AS (SELECT *, errors = '' AS valid, k % 2 = 0 AND errors = '' AS recorded, (['SUPPORTED','REJECTED','ABSTAINED'])[k % 3 + 1] AS verdict, k % 5 <> 0 AS independent,
     CASE k % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS agreement FROM p)"""


def order_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Verifier outcomes of every second order."""
    k = K("o_orderkey")
    verdicts = F.array(*[F.lit(v) for v in verification.VERDICTS])
    return table(spark, sf, "orders").filter("o_orderkey % 2 = 0").select(
        F.concat(F.lit("t"), K("o_custkey") % 3).alias("tenant_id"),
        F.concat(F.lit("p"), k).alias("proposal_id"),
        F.get(verdicts, (k % 3).cast("int")).alias("verdict"),
        F.lit("Anthropic AI").alias("provider"),
        F.when(k % 7 == 0, "models/gemini_2.0 pro").otherwise("claude-x-2025-01-01").alias("model"),
        F.lit("v2").alias("prompt_version"),
        (k % 5 != 0).alias("independent_model"),
        F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("model_agreement"),
        F.lit("because").alias("policy_reason"),
    )


def order_runs(spark: SparkSession, sf: str, asked: DataFrame | None = None) -> DataFrame:
    """Runs of all orders, or of those ``asked(tenant_id, proposal_id)`` for."""
    # Orders meet their outcomes before proposals, many times as wide, are made from them.
    orders, outcomes = named_orders(spark, sf), order_outcomes(spark, sf)
    if asked is not None:
        key = ["tenant_id", "proposal_id"]
        orders, outcomes = (small_join(df, asked.select(*key), key, "left_semi") for df in (orders, outcomes))
    made = proposals_of(verification.with_outcomes(spread(orders), outcomes), *verification.OUTCOME_COLUMNS, "_judged")
    return verification.judged_runs(made, EVALUATED_AT)


def order_states(spark: SparkSession, sf: str) -> DataFrame:
    """What is waiting for review: ``tenant_id, proposal_id, status`` of all orders, without hashing their runs."""
    return verification.proposal_updates(order_runs(spark, sf)).select("tenant_id", "proposal_id", "status")


def reviewable(spark: SparkSession, sf: str, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Proposals and runs under review, of all orders or of those that ``asked`` names.

    Runs of keys with remainder 0 by four pass all gates. By ten, remainder 3 has a
    pointer that is not the run's and remainder 7 a run changed after hashing.
    """
    runs = order_runs(spark, sf, asked)
    k = F.substring("proposal_id", 2, 20).cast("bigint")
    passed = F.transform(
        "gate_results",
        lambda g: g.withField("status", F.when(g["gate"] == "HUMAN_ADJUDICATION", "REVIEW_REQUIRED").otherwise("PASSED")),
    )
    runs = runs.withColumn("gate_results", F.when((k % 4 == 0) & (K("status") == "HUMAN_REVIEW"), passed).otherwise(K("gate_results")))
    # Stored once: hashing the runs is the costly part.
    runs = stored(runs.withColumn("verification_run_sha256", verification.run_sha256()), "runs")
    own = verification.proposal_updates(runs).select(
        "tenant_id",
        "proposal_id",
        "status",
        "verification_run_id",
        "verification_run_sha256",
        F.when(k % 10 == 3, F.sha2(F.lit("other"), 256)).otherwise(K("frozen_proposal_sha256")).alias("frozen_proposal_sha256"),
        "frozen_evidence_index_sha256",
    )
    changed = runs.withColumn("decided_at", F.when(k % 10 == 7, "2026-08-01T00:00:00Z").otherwise(K("decided_at")))
    return own, changed


def bound_reviews(spark: SparkSession, sf: str) -> DataFrame:
    own, runs = reviewable(spark, sf)
    return review.approval_eligibility(review.bind_review(own, review.run_reasons(runs, ascii_only=True)))


# Review state in SQL; reasons in the order of the checks.
REVIEWS = (
    PROPOSALS
    + """, g AS (SELECT *, k % 4 = 0 AND valid AS all_passed, k % 10 NOT IN (3, 7) AS bound,
      CASE WHEN NOT recorded THEN 'disabled' ELSE 'live' END AS mode, recorded AND independent AS free, recorded AND agreement AS agrees FROM v),
    r AS (SELECT *, CASE WHEN NOT bound THEN 'VERIFICATION_RUN_NOT_HASH_BOUND' ELSE concat_ws(',',
      CASE WHEN NOT valid THEN 'RUN_NOT_AWAITING_HUMAN_ADJUDICATION' END,
      CASE WHEN mode <> 'live' THEN 'LIVE_VERIFIER_REQUIRED' END,
      CASE WHEN NOT free THEN 'INDEPENDENT_MODEL_REQUIRED' END,
      CASE WHEN NOT coalesce(agrees, FALSE) THEN 'INDEPENDENT_AGREEMENT_REQUIRED' END,
      CASE WHEN recorded AND k % 7 = 0 THEN 'GENERATOR_VERIFIER_SEPARATION_REQUIRED' END,
      CASE WHEN NOT all_passed THEN CASE WHEN NOT valid THEN 'GATE_CONTRACT_FAILED' END END,
      CASE WHEN NOT all_passed THEN 'GATE_SEMANTIC_SKIPPED' END,
      CASE WHEN NOT all_passed AND NOT valid THEN 'GATE_SOURCE_EVIDENCE_FAILED' END,
      CASE WHEN NOT all_passed THEN CASE WHEN NOT recorded OR verdict = 'ABSTAINED' THEN 'GATE_INDEPENDENT_QUESTIONS_SKIPPED' WHEN verdict = 'REJECTED' THEN 'GATE_INDEPENDENT_QUESTIONS_FAILED' END END,
      CASE WHEN NOT all_passed THEN CASE WHEN NOT recorded OR NOT independent OR agreement IS NULL THEN 'GATE_MODEL_CONSISTENCY_SKIPPED' WHEN NOT agreement THEN 'GATE_MODEL_CONSISTENCY_FAILED' END END,
      CASE WHEN NOT all_passed THEN CASE WHEN valid THEN 'GATE_DATA_TESTS_REVIEW_REQUIRED' ELSE 'GATE_DATA_TESTS_SKIPPED' END END,
      CASE WHEN NOT all_passed THEN 'GATE_GLOBAL_CONSISTENCY_SKIPPED' END,
      CASE WHEN NOT all_passed AND NOT valid THEN 'GATE_HUMAN_ADJUDICATION_SKIPPED' END) END AS reasons FROM g)"""
)


def event_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Events as observations of sources (users); odd events arrive late.

    Every eleventh event is delivered under the execution of the one before.
    """
    k = K("event_id")
    sha = F.sha2("props", 256)
    return table(spark, sf, "events").select(
        F.concat(F.lit("t"), K("user_id") % 4).alias("tenant_id"),
        F.concat(F.lit("s"), K("user_id")).alias("source_id"),
        F.concat(F.lit("x"), F.when(k % 11 == 0, k - 1).otherwise(k)).alias("execution_id"),
        F.when(k % 2 == 1, k + 100).otherwise(k).alias("seq"),
        F.date_trunc("hour", "ts").alias("observed_at"),
        sha.alias("sha256"),
        F.concat(F.lit("s"), K("user_id"), F.lit("@sha256:"), sha).alias("snapshot_id"),
        F.concat(F.lit("events#"), k).alias("evidence_locator"),
        F.lit("x/1").alias("extractor_version"),
    )


# Heads in SQL: distinct executions, head, and the head in force before it.
HEADS = """WITH o AS (SELECT 't' || (user_id % 4) AS tenant_id, 's' || user_id AS source_id, 'x' || CASE WHEN event_id % 11 = 0 THEN event_id - 1 ELSE event_id END AS execution_id,
     CASE WHEN event_id % 2 = 1 THEN event_id + 100 ELSE event_id END AS seq, date_trunc('hour', ts) AS observed_at, sha256(props) AS sha FROM events),
   once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, execution_id ORDER BY seq) AS n FROM o) WHERE n = 1),
   head AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY observed_at DESC, seq DESC) AS m FROM once) WHERE m = 1),
   prior AS (SELECT h.source_id, arg_max(b.sha, (b.observed_at, b.seq)) AS previous FROM head h JOIN once b ON b.source_id = h.source_id AND b.seq < h.seq GROUP BY h.source_id),
   heads AS (SELECT h.tenant_id, h.source_id, h.execution_id, h.sha, h.seq, h.observed_at, previous, coalesce(previous <> h.sha, FALSE) AS changed FROM head h LEFT JOIN prior USING (source_id))"""


def event_heads(spark: SparkSession, sf: str) -> DataFrame:
    return executions.profile_heads(event_observations(spark, sf))
