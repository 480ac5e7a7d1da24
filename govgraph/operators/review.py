"""Steward review: binding, eligibility, queue, decisions and receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from govgraph.functions.digest import canonical_json_text
from govgraph.operators.proposals import CONFIDENCE_FIELDS, CONFIDENCE_TYPE, RISKS, SHA256
from govgraph.operators.verification import (
    GATE_STATES,
    GATES,
    POLICY_VERSION,
    evidence_index_sha256,
    independent,
    run_sha256,
)
from govgraph.operators.violations import rule_array
from govgraph.session import grown, stored

POINTERS = ("verification_run_sha256", "frozen_proposal_sha256", "frozen_evidence_index_sha256")
DECISIONS = {"APPROVED": "APPROVED", "ABSTAINED": "ABSTAINED", "REVIEW_REQUIRED": "HUMAN_REVIEW"}
QUEUE_STATES = ("HUMAN_REVIEW", "ABSTAINED")


def _holds(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def bind_review(proposals: DataFrame, runs: DataFrame) -> DataFrame:
    """Proposals with their run and ``bound``: do all recomputed hashes and gates agree.

    ``proposals`` has ``tenant_id, proposal_id, verification_run_id, status`` and the
    three hashes of ``POINTERS``.
    """
    hashes_ok = F.lit(True)
    for c in POINTERS:
        hashes_ok = hashes_ok & F.col(c).rlike(SHA256)
    names = F.array(*[F.lit(g) for g in GATES])
    gates = F.col("gate_results")
    ids = F.transform(gates, lambda g: g["gate_result_id"])
    gates_ok = (
        (F.size(gates) == len(GATES))
        & (F.transform(gates, lambda g: g["gate"]) == names)
        & (F.transform(gates, lambda g: g["order"]) == F.array(*[F.lit(i) for i in range(1, len(GATES) + 1)]))
        & F.forall(gates, lambda g: g["status"].isin(*GATE_STATES) & (F.trim(g["gate_result_id"]) != ""))
        & (F.col("gate_result_ids") == ids)
        & (F.size(F.array_distinct(ids)) == len(GATES))
    )
    run_ok = (
        hashes_ok
        & (run_sha256() == F.col("verification_run_sha256"))
        & (F.sha2("frozen_proposal", 256) == F.col("frozen_proposal_sha256"))
        & (evidence_index_sha256() == F.col("frozen_evidence_index_sha256"))
        & gates_ok
    )
    def pointers() -> Column:
        # 32 bytes stand for the three texts of 64 letters, which hold no separator where the run is in order.
        return F.unhex(F.sha2(F.concat(*[x for c in POINTERS for x in (F.lit("\x1f"), F.col(c))]), 256))

    checked = runs.withColumn("_run_ok", _holds(run_ok)).withColumn("_run_pointers", pointers())
    renamed = {c: f"proposal_{c}" for c in (*POINTERS, "status")}
    own = proposals.select(
        "tenant_id",
        "proposal_id",
        "verification_run_id",
        *[F.col(c).alias(n) for c, n in renamed.items()],
        pointers().alias("_pointers"),
        *[c for c in ("last_review_receipt_id", "human_decision") if c in proposals.columns],
    )
    # One run per proposal: the join keys hold no hot value. What only the checks read stays where it is.
    joined = own.join(
        checked.withColumnRenamed("proposal_id", "_run_proposal"), ["tenant_id", "verification_run_id"], "left"
    )
    same = (F.col("_run_proposal") == F.col("proposal_id")) & (F.col("_run_pointers") == F.col("_pointers"))
    return joined.withColumn("bound", _holds(F.col("_run_ok") & same)).drop("_run_ok", "_run_proposal", "_run_pointers", "_pointers")


# What is read back from a frozen proposal and from a generator trace.
FROZEN_TYPE = "kind string, risk string, source_locator string, target_iri string, generator string"
TRACE_TYPE = "provider string, model string"


def run_reasons(runs: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Add ``frozen`` and ``run_reasons``: what in a run itself stands against approval.

    Done before ``bind_review``, so that the join moves these few codes, not the texts they are read from.
    """
    read = runs.select(
        "*",
        F.from_json("frozen_proposal", FROZEN_TYPE).alias("frozen"),
        F.from_json("models.generator", TRACE_TYPE).alias("_trace"),
    )
    traces = [F.col("models.generator"), F.col("frozen.generator")]
    same_trace = (traces[0] == traces[1]) | (canonical_json_text(traces[0]) == canonical_json_text(traces[1]))
    separate = independent(
        F.col("_trace.provider"),
        F.col("_trace.model"),
        F.col("models.verifier.provider"),
        F.col("models.verifier.model"),
        ascii_only,
    )
    checks = [
        ("POLICY_VERSION_NOT_APPROVABLE", F.col("policy_version") == POLICY_VERSION),
        ("RISK_POLICY_MISMATCH", F.col("risk").isin(*RISKS) & (F.col("risk") == F.col("frozen.risk"))),
        ("RUN_NOT_AWAITING_HUMAN_ADJUDICATION", F.col("status") == "HUMAN_REVIEW"),
        ("LIVE_VERIFIER_REQUIRED", F.col("models.mode") == "live"),
        ("INDEPENDENT_MODEL_REQUIRED", F.col("models.verifier.independent_model")),
        ("INDEPENDENT_AGREEMENT_REQUIRED", F.col("models.independent_agreement")),
        ("GENERATOR_TRACE_NOT_FROZEN", same_trace),
        ("GENERATOR_VERIFIER_SEPARATION_REQUIRED", separate),
    ]
    named = rule_array(checks)
    closed = F.filter(
        F.col("gate_results"),
        lambda g: ~(
            (g["status"] == "PASSED") | ((g["gate"] == "HUMAN_ADJUDICATION") & (g["status"] == "REVIEW_REQUIRED"))
        ),
    )
    gates = F.transform(closed, lambda g: F.concat(F.lit("GATE_"), g["gate"], F.lit("_"), g["status"]))
    return read.withColumn("run_reasons", F.concat(named, gates)).drop("_trace")


def approval_eligibility(bound: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Add ``reason_codes`` and ``eligible`` to bound rows, whose runs may have their ``run_reasons`` already."""
    read = bound if "run_reasons" in bound.columns else run_reasons(bound, ascii_only)
    reasons = F.when(~F.col("bound"), F.array(F.lit("VERIFICATION_RUN_NOT_HASH_BOUND"))).otherwise(F.col("run_reasons"))
    done = read.withColumn("reason_codes", reasons).drop("run_reasons")
    return done.withColumn("eligible", F.size("reason_codes") == 0)


def review_view(eligible: DataFrame) -> DataFrame:
    """The reviewer's projection of bound proposals."""
    def of_frozen(name: str, default: str) -> Column:
        text = F.col(f"frozen.{name}")
        return F.coalesce(F.when(F.length(text) > 0, text), F.lit(default))

    vector = F.from_json("confidence", CONFIDENCE_TYPE)
    percents = []
    for name in CONFIDENCE_FIELDS:
        score = vector[name]
        percents.append(F.when(score.between(0.0, 1.0), F.round(score * 100).cast("int")).alias(name))
    kind = F.lower(of_frozen("kind", "assertion"))
    title = F.when(kind == "drift", "Check meaning after source drift").otherwise(
        F.concat(F.lit("Decide on "), kind)
    )
    state = (
        F.when(F.col("proposal_status") == "ABSTAINED", "Abstained")
        .when(F.col("proposal_status") == "APPROVED", "Approved")
        .otherwise("Human review")
    )
    return eligible.filter("bound").select(
        "tenant_id",
        "proposal_id",
        F.initcap(kind).alias("kind"),
        title.alias("title"),
        of_frozen("source_locator", "source unknown").alias("detail"),
        of_frozen("target_iri", "target unknown").alias("target_iri"),
        F.initcap(of_frozen("risk", "medium")).alias("risk"),
        F.struct(*percents).alias("confidence_percent"),
        F.coalesce(percents[-1], F.lit(0)).alias("evidence_coverage"),
        (F.size("evidence") + F.size("counterevidence")).alias("evidence_count"),
        state.alias("status"),
        F.transform("gate_results", lambda g: F.struct(g["gate"].alias("gate"), g["status"].alias("status"))).alias("gates"),
        "eligible",
        "reason_codes",
        F.col("models.mode").alias("verifier_mode"),
    )


def review_page(proposals: DataFrame, after: str | None = None, page: int = 25) -> DataFrame:
    """One page of ids of every tenant by keyset, with ``next_cursor`` where more follow.

    ``after`` is the cursor of a tenant's page before; ``page`` rows are given per tenant.
    """
    if page < 1:
        raise ValueError("a page has at least one row")
    waiting = proposals.filter(F.col("status").isin(*QUEUE_STATES))
    if after is not None:
        waiting = waiting.filter(F.col("proposal_id") > after)
    own = Window.partitionBy("tenant_id")
    # The rank limit is applied in the map tasks, so one page and one row per tenant and task are shuffled.
    ranked = waiting.withColumn("_rank", F.row_number().over(own.orderBy("proposal_id"))).filter(F.col("_rank") <= page + 1)
    found = ranked.withColumn("_found", F.count(F.lit(1)).over(own)).filter(F.col("_rank") <= page)
    last = F.max("proposal_id").over(own)
    return found.withColumn("next_cursor", F.when(F.col("_found") > page, last)).drop("_rank", "_found")


def review_queue(
    proposals: DataFrame, runs: DataFrame, after: str | None = None, page: int = 25, ascii_only: bool = False
) -> DataFrame:
    """The views of one page; proposals whose run is not bound are left out."""
    return page_views(review_page(proposals, after, page), runs, ascii_only)


def page_views(ids: DataFrame, runs: DataFrame, ascii_only: bool = False) -> DataFrame:
    """The views of a page that ``review_page`` found, with its ``next_cursor``."""
    cursor = ids.select("tenant_id", "proposal_id", "next_cursor")
    # A page per tenant grows with the tenants: the size that is found at run time decides how it is joined.
    needed = runs.join(ids.select("tenant_id", "verification_run_id"), ["tenant_id", "verification_run_id"], "left_semi")
    views = review_view(approval_eligibility(bind_review(ids, run_reasons(needed, ascii_only))))
    return views.join(cursor, ["tenant_id", "proposal_id"])


def queue_counts(proposals: DataFrame, receipts: DataFrame) -> DataFrame:
    """Waiting, abstained and reviewed numbers per tenant."""
    states = proposals.groupBy("tenant_id").agg(
        F.count_if(F.col("status") == "HUMAN_REVIEW").alias("pending_count"),
        F.count_if(F.col("status") == "ABSTAINED").alias("abstained_count"),
    )
    done = receipts.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("receipt_count"))
    joined = states.join(done, "tenant_id", "full_outer")
    return joined.select(
        "tenant_id",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pending_count", "abstained_count", "receipt_count")],
    )


def receipt_id(tenant: Column, proposal: Column) -> Column:
    return F.concat(F.lit("review-"), F.sha2(F.concat(tenant, F.lit("\x00"), proposal), 256))


def record_decisions(decisions: DataFrame, eligible: DataFrame, receipts: DataFrame) -> DataFrame:
    """Decide what each incoming decision does.

    ``decisions`` has ``tenant_id, proposal_id, request_id, arrival, decision, rationale,
    reviewer, roles``. Result is ACCEPTED, IDEMPOTENT, CONFLICT or REJECTED with a
    reason, and the receipt fields. The first admissible decision per proposal counts;
    repeats of it are idempotent, and a refused one stands in nobody's way. A request that is delivered several
    times is judged once: its first copy gets the result, and the others repeat it.
    """
    key = ["tenant_id", "proposal_id"]
    # Copies are combined before anything is looked up or sorted.
    decisions = decisions.groupBy(*decisions.columns).agg(F.count(F.lit(1)).alias("_copies"))
    text = F.trim("rationale")
    valid = F.col("decision").isin(*DECISIONS) & F.length(text).between(10, 1000)
    staged = decisions.withColumn("rationale_sha256", F.sha2(text, 256)).withColumn("_valid", _holds(valid))
    content = F.struct("decision", "rationale_sha256", "reviewer")
    staged = staged.withColumn("_content", content)
    receipted = receipts.select(*key, F.struct("decision", "rationale_sha256", "reviewer").alias("_stored"))
    # Written once: it is looked up before the first decision is known and after.
    state = stored(eligible.select(
        *key,
        "bound",
        "eligible",
        "proposal_status",
        "status",
        *POINTERS,
        "verification_run_id",
        "policy_version",
        "active_ontology_version",
    ).withColumnRenamed("status", "run_status"), "review-state").withColumn("_known", F.lit(True))
    refused = (
        F.when(~F.col("_valid"), "INVALID_COMMAND")
        .when(F.col("_stored").isNotNull() & (F.col("_stored") != F.col("_content")), "DIFFERENT_RECEIPT_EXISTS")
        .when(F.col("_stored").isNotNull(), None)
        .when(F.col("_known").isNull(), "UNKNOWN_PROPOSAL")
        .when(F.col("proposal_status") != "HUMAN_REVIEW", "NOT_IN_HUMAN_REVIEW")
        .when(~_holds(F.col("bound") & (F.col("run_status") == "HUMAN_REVIEW")), "NOT_HASH_BOUND")
        .when((F.col("decision") == "APPROVED") & ~_holds(F.col("eligible")), "NOT_ELIGIBLE")
    )
    # The joins and the aggregate below share one dealing by key; a proposal with very many deliveries is on
    # the side that adaptive skew joins split, and nothing is repeated for it.
    asked = staged.join(grown(receipted), key, "left")
    judged = asked.join(grown(state), key, "left").withColumn("_refused", refused)
    # Only a decision that would leave a receipt stands in the way of later ones. The earliest is found by
    # a plain aggregate, so a proposal with very many deliveries is combined before the shuffle.
    moment = F.struct("arrival", "request_id", "_content", F.array_sort("roles").alias("roles"), "rationale")
    first = judged.filter("_refused IS NULL AND _stored IS NULL").groupBy(*key).agg(
        F.min_by("_content", moment).alias("_first"),
        F.min(moment).alias("_first_at"),
    )
    joined = judged.join(grown(first), key, "left")
    is_first = moment.eqNullSafe(F.col("_first_at"))
    different = F.col("_stored").isNull() & (F.col("_first") != F.col("_content"))
    reason = F.coalesce("_refused", F.when(different, "DIFFERENT_DECISION_FIRST"))
    result = (
        F.when(reason.isin("DIFFERENT_RECEIPT_EXISTS", "DIFFERENT_DECISION_FIRST"), "CONFLICT")
        .when(reason.isNotNull(), "REJECTED")
        .when(F.col("_stored").isNotNull() | ~is_first, "IDEMPOTENT")
        .otherwise("ACCEPTED")
    )
    results = F.create_map(*[F.lit(x) for pair in DECISIONS.items() for x in pair])
    copies = joined.withColumn("_result", result).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    result = F.when((F.col("_copy") > 1) & (F.col("_result") == "ACCEPTED"), "IDEMPOTENT").otherwise(F.col("_result"))
    return copies.select(
        *key,
        "request_id",
        "arrival",
        "decision",
        F.try_element_at(results, F.col("decision")).alias("resulting_status"),
        "reviewer",
        "roles",
        "rationale_sha256",
        receipt_id(F.col("tenant_id"), F.col("proposal_id")).alias("receipt_id"),
        "verification_run_id",
        *POINTERS,
        "policy_version",
        "active_ontology_version",
        result.alias("result"),
        reason.alias("reason"),
    )


RECEIPT_TEXTS = (
    "receipt_id",
    "proposal_id",
    "reviewer",
    "decision",
    "resulting_status",
    "rationale_sha256",
    "verification_run_id",
    *POINTERS,
    "policy_version",
    "active_ontology_version",
)


def normalize_receipts(receipts: DataFrame, tenant: str) -> DataFrame:
    """Receipts as exported, with ``valid``: full, of the tenant and under their own id.

    Roles are made distinct and sorted and times cut to seconds. Mail addresses and
    rationale texts are not carried over.
    """
    ok = F.col("tenant_id") == tenant
    for c in RECEIPT_TEXTS:
        ok = ok & (F.trim(c) != "")
    ok = ok & F.col("roles").isNotNull() & F.col("created_at").isNotNull()
    if "document_id" in receipts.columns:
        ok = ok & (F.col("document_id") == F.col("receipt_id"))
    created = F.date_format(F.date_trunc("second", "created_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return receipts.select(
        "tenant_id",
        *RECEIPT_TEXTS,
        F.array_sort(F.array_distinct("roles")).alias("roles"),
        created.alias("created_at"),
        _holds(ok).alias("valid"),
    )
