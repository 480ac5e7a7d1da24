"""Review ledgers: build them and check them.

A ledger is its decision rows plus a header row per (tenant, bundle). Everything is
keyed by both, so any number of bundles is checked at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govgraph.functions.times import valid_utc_second
from govgraph.operators.proposals import SHA256
from govgraph.operators.review import DECISIONS
from govgraph.operators.violations import finding_rows, findings, rule_array, union_all
from govgraph.session import is_small

BUNDLE = ["tenant_id", "bundle_version"]
PUBLISHABLE_STATES = ("APPROVED", "PUBLISHED")
HUMAN_ROLES = ("admin", "steward")
MODEL_ROLES = ("independent-verifier",)
ARTIFACT_ROLES = ("proposal", "verification", "evidence-index")


def _key(*cols: str) -> Column:
    return F.concat_ws("/", *cols)


def _one_key(df: DataFrame) -> DataFrame:
    """``_at``: tenant, bundle and proposal as one text, by which all of a ledger is dealt; null where one of them is.

    The joins and sets of a ledger then share one dealing, also where the bundle is the same in all rows and drops out of
    a join's keys.
    """
    parts = [x for c in (*BUNDLE, "proposal_id") for x in (F.length(c).cast("string"), F.lit(":"), F.col(c))]
    return df.withColumn("_at", F.concat(*parts))


def artifact_index(artifacts: DataFrame) -> DataFrame:
    """Per bundle and proposal (``_at``): how many artifacts each role has, and their hashes.

    Artifacts are dealt as they are: to combine the few of a proposal before would mean sorting all of them twice.

    ``artifacts`` has ``tenant_id, bundle_version, proposal_id, role, sha256`` and what
    the documents say: ``doc_proposal_id, doc_tenant_id, doc_run_id, frozen_proposal_sha256,
    frozen_evidence_sha256, evidence_sha256``.
    """
    columns = []
    for role in ARTIFACT_ROLES:
        name, hit = role.replace("-", "_"), F.col("role") == role
        columns.append(F.count_if(hit).alias(f"{name}_count"))
        for c in (
            "sha256",
            "doc_proposal_id",
            "doc_tenant_id",
            "doc_run_id",
            "frozen_proposal_sha256",
            "frozen_evidence_sha256",
            "evidence_sha256",
        ):
            columns.append(F.min(F.when(hit, F.col(c))).alias(f"{name}_{c}"))
    return _one_key(artifacts).filter("_at IS NOT NULL").repartition("_at").groupBy("_at").agg(*columns)


def _chain_rules() -> list[tuple[str, Column]]:
    rules = []
    for role in ARTIFACT_ROLES:
        name, upper = role.replace("-", "_"), role.replace("-", "_").upper()
        rules += [
            (f"{upper}_NOT_EXACTLY_ONE", F.col(f"{name}_count") == 1),
            (f"{upper}_OF_OTHER_PROPOSAL", F.col(f"{name}_doc_proposal_id") == F.col("proposal_id")),
            (f"{upper}_OF_OTHER_TENANT", F.col(f"{name}_doc_tenant_id") == F.col("tenant_id")),
        ]
    rules += [
        ("RUN_ID_MISMATCH", F.col("verification_doc_run_id") == F.col("verification_run_id")),
        ("PROPOSAL_NOT_FROZEN", F.col("verification_frozen_proposal_sha256") == F.col("proposal_sha256")),
        (
            "EVIDENCE_NOT_FROZEN",
            F.col("verification_frozen_evidence_sha256") == F.col("evidence_index_frozen_evidence_sha256"),
        ),
        ("EVIDENCE_DIFFERS_FROM_PROPOSAL", F.col("proposal_evidence_sha256") == F.col("evidence_index_evidence_sha256")),
        ("EVIDENCE_DIFFERS_FROM_RUN", F.col("verification_evidence_sha256") == F.col("evidence_index_evidence_sha256")),
    ]
    return rules


def artifact_chain_violations(decisions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Each decision needs one artifact per role, all agreeing on what was frozen.

    ``decisions`` has ``tenant_id, bundle_version, proposal_id, verification_run_id`` and
    ``cited_proposal_sha256, cited_verification_sha256, cited_evidence_index_sha256``.
    """
    joined = _one_key(decisions).join(artifact_index(artifacts), "_at", "left")
    cited = [
        (f"CITED_{r.replace('-', '_').upper()}_DIGEST", F.col(f"cited_{r.replace('-', '_')}_sha256") == F.col(f"{r.replace('-', '_')}_sha256"))
        for r in ARTIFACT_ROLES
    ]
    return finding_rows(joined, _key(*BUNDLE, "proposal_id"), [*_chain_rules(), *cited])


def reviewer_violations(decisions: DataFrame) -> DataFrame:
    """Separation of generator, verifier and reviewer, roles and times of decisions."""
    human, model = F.col("reviewer_kind") == "HUMAN", F.col("reviewer_kind") == "INDEPENDENT_MODEL"

    def named(c: str) -> Column:
        return F.trim(c) != ""

    def unless(condition: Column, ok: Column) -> Column:
        # Rules about one kind of reviewer hold for the other.
        return F.when(F.coalesce(condition, F.lit(False)), ok).otherwise(True)

    both = named("reviewer_subject") & named("verifier_subject")
    rules = [
        ("REVIEWER_MISSING", named("reviewer_subject")),
        ("GENERATOR_MISSING", named("generator_subject")),
        ("VERIFIER_MISSING", named("verifier_subject")),
        (
            "REVIEWER_IS_GENERATOR",
            unless(named("reviewer_subject") & named("generator_subject"), F.col("reviewer_subject") != F.col("generator_subject")),
        ),
        (
            "VERIFIER_IS_GENERATOR",
            unless(named("verifier_subject") & named("generator_subject"), F.col("verifier_subject") != F.col("generator_subject")),
        ),
        ("REVIEWER_KIND", human | model),
        ("HUMAN_ROLE", unless(human, F.col("reviewer_role").isin(*HUMAN_ROLES))),
        ("HUMAN_IS_VERIFIER", unless(human & both, F.col("reviewer_subject") != F.col("verifier_subject"))),
        ("MODEL_ROLE", unless(model, F.col("reviewer_role").isin(*MODEL_ROLES))),
        ("MODEL_IS_NOT_VERIFIER", unless(model & both, F.col("reviewer_subject") == F.col("verifier_subject"))),
        ("REVIEW_TIME", valid_utc_second(F.col("reviewed_at"))),
        ("SOURCE_RECEIPT", F.col("source_receipt_sha256").rlike(SHA256)),
        ("DECISION_ID", named("decision_id")),
    ]
    return finding_rows(decisions, _key(*BUNDLE, "proposal_id"), rules)


def population(states: DataFrame) -> DataFrame:
    """Mappings per bundle, in all and by state."""
    return states.groupBy(*BUNDLE).agg(
        F.count(F.lit(1)).alias("total"),
        *[
            F.count_if(F.col("status") == s).alias(n)
            for n, s in (("approved", "APPROVED"), ("published", "PUBLISHED"), ("human_review", "HUMAN_REVIEW"))
        ],
    )


def build_ledger(
    manifests: DataFrame, receipts: DataFrame, artifacts: DataFrame, states: DataFrame
) -> dict[str, DataFrame]:
    """Ledger of every bundle: ``decisions``, ``header`` and ``violations``.

    ``manifests`` has ``tenant_id, bundle_version, ontology_version, state``; ``receipts``
    the normalised receipts with ``bundle_version``; ``states`` the mapping states as
    ``tenant_id, bundle_version, proposal_id, status``.
    """
    key = [*BUNDLE, "proposal_id"]
    header = manifests.select(*BUNDLE, F.col("ontology_version").alias("_ontology"), "state")
    state = states.select(*key, F.col("status").alias("mapping_status"))
    index = artifact_index(artifacts)
    # The manifest is found through the mapping states: bundles have few rows and
    # may be hot, mappings are not.
    of_mapping = state.join(F.broadcast(header) if is_small(header) else header, BUNDLE, "left")
    found = _one_key(of_mapping).drop(*key)
    joined = _one_key(receipts).join(found, "_at", "left").join(index, "_at", "left").drop("_at")
    statuses = F.create_map(*[F.lit(x) for pair in DECISIONS.items() for x in pair])
    authorised = F.array_intersect("roles", F.array(*[F.lit(r) for r in HUMAN_ROLES]))
    rules = [
        ("RECEIPT_INVALID", F.col("valid")),
        ("UNKNOWN_MAPPING", F.col("mapping_status").isNotNull()),
        *_chain_rules(),
        ("RECEIPT_FREEZES_OTHER_PROPOSAL", F.col("frozen_proposal_sha256") == F.col("proposal_sha256")),
        (
            "RECEIPT_FREEZES_OTHER_EVIDENCE",
            F.col("frozen_evidence_index_sha256") == F.col("evidence_index_frozen_evidence_sha256"),
        ),
        ("ONTOLOGY_VERSION", F.col("active_ontology_version") == F.col("_ontology")),
        ("DECISION_STATUS", F.try_element_at(statuses, F.upper("decision")) == F.upper("resulting_status")),
        ("STATUS_DIFFERS_FROM_MAPPING", F.upper("resulting_status") == F.col("mapping_status")),
        ("REVIEWER_ROLE", F.size(authorised) == 1),
        ("REVIEW_TIME", valid_utc_second(F.col("created_at"))),
    ]
    checked = joined.withColumn("_broken", rule_array(rules))
    broken = checked.select(
        F.explode("_broken").alias("rule"), _key(*key).alias("key"), F.col("receipt_id").alias("detail")
    )
    counts = receipts.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    repeated = findings(counts.filter("_n > 1"), "DUPLICATE_RECEIPT", _key(*key), F.col("_n"))
    decisions = checked.filter(F.size("_broken") == 0).select(
        *key,
        F.upper("resulting_status").alias("status"),
        F.col("receipt_id").alias("decision_id"),
        "verification_run_id",
        "verification_run_sha256",
        F.col("reviewer").alias("reviewer_subject"),
        F.lit("HUMAN").alias("reviewer_kind"),
        F.get(authorised, 0).alias("reviewer_role"),
        F.col("created_at").alias("reviewed_at"),
        F.col("proposal_sha256").alias("cited_proposal_sha256"),
        F.col("verification_sha256").alias("cited_verification_sha256"),
        F.col("evidence_index_sha256").alias("cited_evidence_index_sha256"),
    )
    seen = state.join(counts.drop("_n").withColumn("_seen", F.lit(True)), key, "full_outer")
    covered = seen.groupBy(*BUNDLE).agg(
        F.bool_and(F.col("_seen").isNotNull() & F.col("mapping_status").isNotNull()).alias("_full")
    )
    summary = (
        manifests.select(*BUNDLE, "ontology_version", "state")
        .join(population(states), BUNDLE, "left")
        .join(covered, BUNDLE, "left")
        .withColumn("coverage", F.when(F.col("_full"), "FULL").otherwise("PARTIAL"))
    )
    not_ready = summary.filter(
        (F.col("state") == "PUBLISHABLE")
        & ((F.col("coverage") != "FULL") | (F.col("approved") + F.col("published") < F.col("total")))
    )
    return {
        "decisions": decisions,
        "header": summary.drop("_full"),
        "violations": union_all([
            broken, repeated, findings(not_ready, "PUBLISHABLE_WITHOUT_FULL_REVIEW", _key(*BUNDLE))
        ]),
    }


def ledger_violations(
    headers: DataFrame, manifests: DataFrame, decisions: DataFrame, states: DataFrame, mode: str
) -> DataFrame:
    """Check ledgers (``headers``, ``decisions``) against manifests and mapping states.

    ``mode`` is candidate, publish or published. Headers carry ``ontology_version, state,
    coverage, total, approved, published, human_review``.
    """
    key = [*BUNDLE, "proposal_id"]
    publishing = mode in ("publish", "published")
    counted = population(states).select(
        *BUNDLE, *[F.col(c).alias(f"_{c}") for c in ("total", "approved", "published", "human_review")]
    )
    wanted = manifests.select(*BUNDLE, F.col("ontology_version").alias("_ontology"))
    joined = wanted.join(headers, BUNDLE, "left").join(counted, BUNDLE, "left")
    same = F.lit(True)
    for c in ("total", "approved", "published", "human_review"):
        same = same & (F.col(c) == F.coalesce(f"_{c}", F.lit(0)))
    rules = [
        ("HEADER_MISMATCH", F.col("ontology_version") == F.col("_ontology")),
        ("LEDGER_STATE", F.col("state") == ("PUBLISHABLE" if publishing else "CANDIDATE")),
        ("POPULATION", same),
    ]
    if publishing:
        rules.append(("COVERAGE", F.col("coverage") == "FULL"))
    frames = [finding_rows(joined, _key(*BUNDLE), rules)]
    state = states.select(*key, F.col("status").alias("mapping_status"))
    ids = decisions.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min(F.upper("status")).alias("decided"))
    frames.append(findings(ids.filter("_n > 1"), "DUPLICATE_DECISION", _key(*key), F.col("_n")))
    matched = state.join(ids, key, "full_outer")
    frames.append(findings(matched.filter("mapping_status IS NULL"), "UNKNOWN_MAPPING", _key(*key)))
    differs = matched.filter("decided <> mapping_status")
    frames.append(findings(differs, "STATUS_DIFFERS_FROM_MAPPING", _key(*key), F.col("decided")))
    if publishing:
        open_states = matched.filter(~F.col("mapping_status").isin(*PUBLISHABLE_STATES))
        frames.append(findings(open_states, "UNRESOLVED_MAPPING", _key(*key), F.col("mapping_status")))
        undecided = matched.filter("decided IS NULL")
        frames.append(findings(undecided, "DECISION_MISSING", _key(*key)))
    return union_all(frames)


def export_provenance_violations(headers: DataFrame) -> DataFrame:
    """The export a ledger was made from must be named and hashed."""
    rules = [
        ("EXPORT_DIGEST", F.col("source_export_sha256").rlike(SHA256)),
        ("EXPORT_ALGORITHM", F.col("digest_algorithm") == "SHA-256"),
        ("EXPORT_TIME", valid_utc_second(F.col("exported_at"))),
        (
            "EXPORT_COLLECTION",
            F.col("collection_path") == F.concat(F.lit("tenants/"), "tenant_id", F.lit("/reviewReceipts")),
        ),
    ]
    return finding_rows(headers, _key(*BUNDLE), rules)
