"""Verification: requests, outcomes, eight gates, runs and the approval table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govgraph.functions.digest import canonical_json, canonical_sha256, canonical_struct
from govgraph.functions.identity import normalize_model, normalize_provider
from govgraph.operators.proposals import PROPOSAL_FIELDS, PROVIDER, RISKS, proposal_errors

POLICY_VERSION = "semantic-verification-policy-v1"
# The gates in order, their possible states, verdicts and policy terms.
GATES = (
    "CONTRACT",
    "SEMANTIC",
    "SOURCE_EVIDENCE",
    "INDEPENDENT_QUESTIONS",
    "MODEL_CONSISTENCY",
    "DATA_TESTS",
    "GLOBAL_CONSISTENCY",
    "HUMAN_ADJUDICATION",
)
GATE_STATES = ("PASSED", "FAILED", "SKIPPED", "REVIEW_REQUIRED")
VERDICTS = ("SUPPORTED", "REJECTED", "ABSTAINED")
POLICY_TERMS = (
    "beneficial owner",
    "beneficial ownership",
    "ubo",
    "sanction",
    "identity resolution",
    "delete",
    "deletion",
    "destructive",
    "policy-critical",
)
OUTCOME_COLUMNS = (
    "verdict",
    "provider",
    "model",
    "prompt_version",
    "independent_model",
    "model_agreement",
    "policy_reason",
)


def _ids(items: Column) -> Column:
    return F.transform(items, lambda e: e["evidence_id"])


def verify_requests(proposals: DataFrame) -> DataFrame:
    """What a verifier is sent; proposals that cannot satisfy that form drop out."""
    def trace(name: str, default: str) -> Column:
        text = F.col(f"_generator.{name}")
        return F.coalesce(F.when(F.length(text) > 0, text), F.lit(default))

    statement = F.concat("kind", F.lit(": "), "source_locator", F.lit(" -> "), "target_iri")
    kept = "provider string, model string, prompt_version string, model_participated boolean"
    read = proposals.withColumn("_generator", F.from_json("generator", kept))
    made = read.select(
        "tenant_id",
        "proposal_id",
        statement.alias("statement"),
        _ids(F.col("evidence")).alias("evidence_ids"),
        _ids(F.col("counterevidence")).alias("counterevidence_ids"),
        F.upper("risk").alias("risk"),
        F.coalesce("_generator.model_participated", F.lit(False)).alias("model_dependent"),
        trace("provider", PROVIDER).alias("generator_provider"),
        trace("model", "unknown").alias("generator_model"),
        trace("prompt_version", "not-applicable").alias("prompt_version"),
        *[(F.length(c) > 0).alias(f"_{c}") for c in ("kind", "source_locator", "target_iri")],
    )

    def all_filled(c: str) -> Column:
        return F.forall(c, lambda x: F.coalesce(F.length(x) > 0, F.lit(False)))

    ok = (
        F.col("_kind")
        & F.col("_source_locator")
        & F.col("_target_iri")
        & F.col("risk").isin(*[r.upper() for r in RISKS])
        & (F.size("evidence_ids") > 0)
        & all_filled("evidence_ids")
        & all_filled("counterevidence_ids")
    )
    return made.filter(ok).drop("_kind", "_source_locator", "_target_iri")


def accept_outcomes(outcomes: DataFrame) -> DataFrame:
    """Outcomes that satisfy the return contract; others count as no result."""
    filled = F.lit(True)
    for c in ("proposal_id", "status", "policy_reason", "provider", "model", "prompt_version"):
        filled = filled & (F.length(c) > 0)
    typed = F.col("requires_human_review").isNotNull() & F.col("independent_model").isNotNull()
    return outcomes.filter(filled & typed & F.col("verdict").isin(*VERDICTS))


def gate_array(valid: Column, errors: Column, recorded: Column, evidence_ids: Column) -> Column:
    """The eight gates of one proposal, in order, as an array of structs."""
    verdict, model_independent = F.col("verdict"), F.col("independent_model")
    agreement = F.col("model_agreement")
    label = F.concat_ws("/", "provider", "model")
    questions = (
        F.when(~recorded | (verdict == "ABSTAINED"), "SKIPPED")
        .when(verdict == "SUPPORTED", "PASSED")
        .otherwise("FAILED")
    )
    consistency = (
        F.when(~recorded | ~model_independent, "SKIPPED")
        .when(agreement, "PASSED")
        .when(~agreement, "FAILED")
        .otherwise("SKIPPED")
    )
    none = F.array().cast("array<string>")
    states = {
        "CONTRACT": (
            F.when(valid, "PASSED").otherwise("FAILED"),
            F.when(valid, "The proposal fulfils its contract.").otherwise(
                F.concat(F.lit("Abstained: "), F.array_join(errors, "; "))
            ),
            none,
        ),
        "SEMANTIC": (F.lit("SKIPPED"), F.lit("Graph constraints are checked on the graph."), none),
        "SOURCE_EVIDENCE": (
            F.when(valid, "PASSED").otherwise("FAILED"),
            F.when(valid, "All evidence is bound to tenant, content and snapshot.").otherwise(
                "Evidence is incomplete or does not fit the proposal."
            ),
            evidence_ids,
        ),
        "INDEPENDENT_QUESTIONS": (
            questions,
            F.when(~recorded, "No independent verifier result exists.").otherwise(
                F.concat(label, F.lit(" returned "), verdict, F.lit(": "), F.col("policy_reason"))
            ),
            evidence_ids,
        ),
        "MODEL_CONSISTENCY": (
            consistency,
            F.when(~recorded, "No independent model result exists.")
            .when(~model_independent, F.concat(label, F.lit(" is not an independent model.")))
            .when(agreement, F.concat(label, F.lit(" agrees.")))
            .when(~agreement, F.concat(label, F.lit(" disagrees.")))
            .otherwise(F.concat(label, F.lit(" recorded no agreement."))),
            F.when(recorded, evidence_ids).otherwise(none),
        ),
        "DATA_TESTS": (
            F.when(valid, "REVIEW_REQUIRED").otherwise("SKIPPED"),
            F.when(valid, "Data assertions need a steward.").otherwise("The proposal is not valid."),
            evidence_ids,
        ),
        "GLOBAL_CONSISTENCY": (F.lit("SKIPPED"), F.lit("Graph impact is established on the graph."), none),
        "HUMAN_ADJUDICATION": (
            F.when(valid, "REVIEW_REQUIRED").otherwise("SKIPPED"),
            F.when(valid, "A steward must decide.").otherwise("The proposal must be repaired first."),
            evidence_ids,
        ),
    }
    return F.array(*[
        F.struct(
            F.lit(f"{i:02d}-{name.lower().replace('_', '-')}").alias("gate_result_id"),
            F.lit(i).alias("order"),
            F.lit(name).alias("gate"),
            states[name][0].alias("status"),
            states[name][1].alias("details"),
            states[name][2].alias("evidence_ids"),
        )
        for i, name in enumerate(GATES, 1)
    ])


RUN_FIELDS = (
    "schema_version",
    "verification_run_id",
    "policy_version",
    "proposal_id",
    "tenant_id",
    "risk",
    "frozen_proposal_sha256",
    "frozen_proposal",
    "frozen_evidence_index_sha256",
    "source_snapshot_ids",
    "active_ontology_version",
    "evidence",
    "counterevidence",
    "confidence",
    "checks",
    "models",
    "gate_result",
    "gate_results",
    "gate_result_ids",
    "status",
    "review_requirement",
    "decided_at",
)


def frozen_proposal() -> Column:
    """The contract fields of a proposal as canonical JSON."""
    return canonical_json(canonical_struct({f: F.col(f) for f in PROPOSAL_FIELDS}))


def evidence_index_sha256() -> Column:
    return canonical_sha256({"evidence": F.col("evidence"), "counterevidence": F.col("counterevidence")})


def run_sha256() -> Column:
    """The hash of a run over everything else in it."""
    return canonical_sha256({f: F.col(f) for f in RUN_FIELDS})


def verification_runs(proposals: DataFrame, outcomes: DataFrame, evaluated_at: str) -> DataFrame:
    """One run per proposal: frozen hashes, ordered gates and the run hash.

    ``outcomes`` has ``tenant_id, proposal_id`` and ``OUTCOME_COLUMNS``; it holds one
    row per proposal at most. The gates stay in the row of their run.
    """
    return judged_runs(with_outcomes(proposals, outcomes), evaluated_at)


def with_outcomes(proposals: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rows of proposals, or of what proposals are made from, with the outcome of ``tenant_id, proposal_id`` if there is one."""
    judged = outcomes.select("tenant_id", "proposal_id", *OUTCOME_COLUMNS, F.lit(True).alias("_judged"))
    return proposals.join(judged, ["tenant_id", "proposal_id"], "left")


def judged_runs(proposals: DataFrame, evaluated_at: str) -> DataFrame:
    """``verification_runs`` of proposals that ``with_outcomes`` has given their outcomes: every row stands for itself."""
    checked = proposal_errors(proposals)
    valid = F.size("errors") == 0
    # A judgment counts only for a valid proposal.
    recorded = valid & F.coalesce("_judged", F.lit(False))
    ids = F.concat(_ids(F.col("evidence")), _ids(F.col("counterevidence")))
    ids = F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda e: F.length(e) > 0)
    status = F.when(valid, "HUMAN_REVIEW").otherwise("ABSTAINED")
    first = F.when(recorded, "INDEPENDENT_VERIFIER_RECORDED").otherwise("INDEPENDENT_VERIFIER_NOT_CONFIGURED")
    reasons = F.when(valid, F.array(first, F.lit("STEWARD_REVIEW_REQUIRED"))).otherwise(
        F.array(F.lit("CONTRACT_OR_EVIDENCE_INCOMPLETE"), F.lit("VERIFIER_ABSTAINED"))
    )

    def seen(name: str, default: Column) -> Column:
        return F.when(recorded, F.col(name)).otherwise(default).alias(name)

    verifier = F.struct(
        F.lit(False).alias("store"),
        seen("independent_model", F.lit(False)),
        seen("model", F.lit("not-invoked")),
        seen("prompt_version", F.lit("not-applicable")),
        seen("provider", F.lit("not-configured")),
        F.when(recorded & (F.col("verdict") != "ABSTAINED"), "completed").otherwise("abstained").alias(
            "response_status"
        ),
    )
    models = F.struct(
        F.col("generator").alias("generator"),
        F.when(recorded, F.col("model_agreement")).alias("independent_agreement"),
        F.when(~recorded, "disabled").when(F.col("provider") == "deterministic-mock", "mock").otherwise("live").alias(
            "mode"
        ),
        verifier.alias("verifier"),
    )
    none = F.lit(None).cast("boolean")
    checks = F.struct(
        valid.alias("contract_valid"),
        none.alias("data_assertions_valid"),
        none.alias("global_consistency_valid"),
        valid.alias("provenance_complete"),
        none.alias("semantic_valid"),
    )
    run_id = F.sha2(F.concat_ws("\x1f", F.lit("verification"), "tenant_id", "proposal_id"), 256)
    fields = {
        "schema_version": F.lit("1.0"),
        "verification_run_id": run_id,
        "policy_version": F.lit(POLICY_VERSION),
        "risk": F.when(F.col("risk").isin(*RISKS), F.col("risk")).otherwise("unknown"),
        "frozen_proposal": frozen_proposal(),
        "frozen_proposal_sha256": F.sha2(frozen_proposal(), 256),
        "frozen_evidence_index_sha256": evidence_index_sha256(),
        "checks": checks,
        "models": models,
        "gate_result": F.struct(reasons.alias("reason_codes"), status.alias("status")),
        "gate_results": gate_array(valid, F.col("errors"), recorded, ids),
        "status": status,
        "review_requirement": F.when(valid, "A steward must review the proposal.").otherwise(
            "The verifier abstained: contract or evidence is incomplete."
        ),
        "decided_at": F.lit(evaluated_at),
    }
    named = checked.select(
        *[fields.get(f, F.col(f) if f in checked.columns else None).alias(f) for f in RUN_FIELDS if f != "gate_result_ids"]
    ).withColumn("gate_result_ids", F.transform("gate_results", lambda g: g["gate_result_id"]))
    return named.withColumn("verification_run_sha256", run_sha256())


def gate_results(runs: DataFrame) -> DataFrame:
    """One row per run and gate."""
    return runs.select(
        "tenant_id", "verification_run_id", "proposal_id", "decided_at", "policy_version", F.inline("gate_results")
    )


def proposal_updates(runs: DataFrame) -> DataFrame:
    """What verification writes back on the proposal."""
    return runs.select(
        "tenant_id",
        "proposal_id",
        "status",
        F.col("gate_result.reason_codes").alias("reason_codes"),
        "verification_run_id",
        "verification_run_sha256",
        "frozen_proposal_sha256",
        "frozen_evidence_index_sha256",
        F.transform("gate_results", lambda g: F.struct(g["gate"].alias("gate"), g["status"].alias("status"))).alias(
            "gate_summary"
        ),
        F.col("decided_at").alias("verified_at"),
    )


def independent(
    generator_provider: Column, generator_model: Column, provider: Column, model: Column, ascii_only: bool = False
) -> Column:
    """Provider and model both known and both different after normalisation."""
    providers = [normalize_provider(c, ascii_only) for c in (generator_provider, provider)]
    models = [normalize_model(c, ascii_only) for c in (generator_model, model)]
    known = F.lit(True)
    for value in (*providers, *models):
        known = known & (F.length(value) > 0)
    return F.coalesce(known & (providers[0] != providers[1]) & (models[0] != models[1]), F.lit(False))


def approval_decision(decisions: DataFrame, threshold: float = 0.95, ascii_only: bool = False) -> DataFrame:
    """Apply the decision table, from top to bottom.

    Needs the request columns ``risk, model_dependent, evidence_ids,
    generator_provider, generator_model`` and the result columns ``verdict,
    confidence, cited_ids, provider, model, independent_model``.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    really = F.col("independent_model") & independent(
        F.col("generator_provider"), F.col("generator_model"), F.col("provider"), F.col("model"), ascii_only
    )
    staged = decisions.withColumn("independent_model", F.coalesce(really, F.lit(False)))
    free, verdict = F.col("independent_model"), F.col("verdict")
    covered = (F.size("cited_ids") > 0) & (F.size(F.array_except("cited_ids", "evidence_ids")) == 0)
    approved = free & (F.col("confidence") >= threshold) & covered
    rows = [
        (F.col("risk") == "HIGH", "HUMAN_REVIEW", "High risk always needs a person."),
        (F.col("model_dependent") & ~free, "HUMAN_REVIEW", "No independent verifier for a model-made proposal."),
        (verdict == "REJECTED", "REJECTED", "Independent verification rejected the proposal."),
        (verdict == "ABSTAINED", "ABSTAINED", "The verifier abstained."),
        (approved, "AUTO_APPROVED", "Support, evidence and threshold all passed."),
    ]
    status, reason = F.lit("HUMAN_REVIEW"), F.lit("Not every approval gate was satisfied.")
    for condition, state, text in reversed(rows):
        holds = F.coalesce(condition, F.lit(False))
        status = F.when(holds, state).otherwise(status)
        reason = F.when(holds, text).otherwise(reason)
    agreement = F.when(free & (verdict == "SUPPORTED"), True).when(free & (verdict == "REJECTED"), False)
    return staged.select(
        "*",
        status.alias("status"),
        agreement.alias("model_agreement"),
        (status == "HUMAN_REVIEW").alias("requires_human_review"),
        reason.alias("policy_reason"),
    )


def elevate_risk(requests: DataFrame, text: str = "request", risk: str = "risk") -> DataFrame:
    """HIGH where the serialised request names a policy term."""
    pattern = "|".join(POLICY_TERMS)
    return requests.withColumn(risk, F.when(F.lower(text).rlike(pattern), "HIGH").otherwise(F.col(risk)))


def invented_evidence(requests: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Outputs that cite ids their request did not hold, with those ids."""
    joined = outputs.join(requests.select(*keys, "evidence_ids", "counterevidence_ids"), keys)
    extra = joined.select(
        *keys,
        F.array_except("cited_ids", "evidence_ids").alias("invented"),
        F.array_except("cited_counter_ids", "counterevidence_ids").alias("invented_counter"),
    )
    return extra.filter((F.size("invented") > 0) | (F.size("invented_counter") > 0))
