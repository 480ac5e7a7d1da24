"""Publication gate, promotion, active pointers and rollback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govgraph.functions.digest import canonical_json, canonical_struct
from govgraph.functions.times import valid_utc_second
from govgraph.operators.ledger import BUNDLE
from govgraph.operators.proposals import SHA256
from govgraph.operators.violations import rule_array, union_all
from govgraph.session import salted_join

# State, serving mode and published flag a bundle has per mode, and
# what release identifiers look like.
MODES = {
    "candidate": ("CANDIDATE", "DEMO_ONLY", False),
    "publish": ("PUBLISHABLE", "PUBLISHER_ONLY", False),
    "published": ("PUBLISHED", "ACTIVE", True),
}
RELEASE_SHA = r"^[0-9a-f]{40,64}\z"
RELEASE_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,159}\z"
SAFE_TICKET = r"^[A-Za-z0-9][A-Za-z0-9._/-]{2,127}\z"
OPERATIONS = ("PUBLISH", "ROLLBACK")


def bundle_key() -> Column:
    return F.concat_ws("/", *BUNDLE)


def manifest_violations(manifests: DataFrame, mode: str) -> DataFrame:
    """State, serving mode, flag and (once published) the receipt fields of manifests."""
    state, serving, flag = MODES[mode]
    rules = [
        ("STATE", F.col("state") == state),
        ("SERVING_MODE", F.col("serving_mode") == serving),
        ("IS_PUBLISHED", F.col("is_published") == flag),
    ]
    if mode == "published":
        rules += publication_rules()
    return bundle_findings(manifests, bundle_key(), rules)


def bundle_findings(df: DataFrame, key: Column, rules: list[tuple[str, Column]]) -> DataFrame:
    """Findings that carry their tenant and bundle as columns."""
    return df.select(*BUNDLE, F.explode(rule_array(rules)).alias("rule"), key.cast("string").alias("key")).withColumn(
        "detail", F.lit(None).cast("string")
    )


def publication_rules() -> list[tuple[str, Column]]:
    return [
        ("PUBLISHER_SUBJECT", F.trim("publisher_subject") != ""),
        ("AUTHORIZED_AT", valid_utc_second(F.col("authorized_at"))),
        ("PUBLISHED_AT", valid_utc_second(F.col("published_at"))),
        ("TIME_ORDER", F.col("authorized_at") <= F.col("published_at")),
        ("RELEASE_SHA", F.col("release_sha").rlike(RELEASE_SHA)),
        ("RELEASE_ID", F.col("release_id").rlike(RELEASE_ID)),
    ]


def publication_gate(
    manifests: DataFrame, mode: str, states: DataFrame, golden: DataFrame, others: list[DataFrame]
) -> DataFrame:
    """One row per bundle: number of findings, mapping states, golden totals, ``passed``.

    ``others`` are further finding frames with tenant and bundle as columns; ``golden`` has the totals per
    bundle. Findings of a bundle that has no manifest get a row of their own, which does not pass.
    """
    columns = [*BUNDLE, "rule", "key", "detail"]
    found = union_all([manifest_violations(manifests, mode).select(*columns), *[o.select(*columns) for o in others]])
    per_bundle = found.groupBy(*BUNDLE).agg(F.count(F.lit(1)).alias("violations"))
    counts = states.groupBy(*BUNDLE).agg(
        F.count(F.lit(1)).alias("mapping_count"),
        F.count_if(F.col("status").isin("APPROVED", "PUBLISHED")).alias("resolved_count"),
        F.count_if(F.col("status") == "HUMAN_REVIEW").alias("human_review_count"),
    )
    known = manifests.select(*BUNDLE, "state", "serving_mode", "is_published")
    unknown = per_bundle.join(known, BUNDLE, "left_anti").select(*BUNDLE)
    joined = known.unionByName(unknown, allowMissingColumns=True)
    for part in (per_bundle, counts, golden.select(*BUNDLE, "total", "passed", "complete")):
        joined = joined.join(part, BUNDLE, "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("violations", "mapping_count", "resolved_count", "human_review_count")}
    golden_ok = F.coalesce(F.col("complete") & (F.col("total") == F.col("passed")), F.lit(False))
    return joined.select(
        *BUNDLE,
        "state",
        "serving_mode",
        "is_published",
        *[v.alias(c) for c, v in zero.items()],
        F.coalesce("total", F.lit(0)).alias("golden_total"),
        F.coalesce("passed", F.lit(0)).alias("golden_passed"),
        ((zero["violations"] == 0) & (zero["mapping_count"] > 0) & golden_ok).alias("gate_passed"),
    )


def release_object(tenant: Column, version: Column, release: Column) -> Column:
    return F.concat(
        F.lit("tenants/"), tenant, F.lit("/ontology/releases/"), version, F.lit("-"), release, F.lit("/manifest.json")
    )


RECEIPT_FIELDS = (
    "bundle_version",
    "tenant_id",
    "ontology_version",
    "publisher_subject",
    "authorized_at",
    "published_at",
    "release_sha",
    "release_id",
    "source_manifest_sha256",
    "review_ledger_sha256",
)


def promote(candidates: DataFrame, gate: DataFrame) -> DataFrame:
    """Releases for every bundle that passed the gate and whose request is in order.

    ``candidates`` has ``RECEIPT_FIELDS``. Others give a row with ``refused`` reasons
    and no release.
    """
    passed = gate.select(*BUNDLE, F.col("gate_passed"))
    joined = candidates.join(passed, BUNDLE, "left")
    rules = [("GATE", F.col("gate_passed")), *publication_rules()]
    rules += [(c.upper(), F.col(c).rlike(SHA256)) for c in ("source_manifest_sha256", "review_ledger_sha256")]
    staged = joined.withColumn("refused", rule_array(rules))
    receipt = canonical_json(canonical_struct({f: F.col(f) for f in RECEIPT_FIELDS}))
    ok = F.size("refused") == 0
    return staged.select(
        *RECEIPT_FIELDS,
        F.when(ok, release_object(F.col("tenant_id"), F.col("bundle_version"), F.col("release_id"))).alias(
            "manifest_object"
        ),
        F.when(ok, F.sha2(receipt, 256)).alias("receipt_sha256"),
        F.when(ok, "PUBLISHED").alias("state"),
        "refused",
    )


def safe_path(path: Column, prefix: Column, ending: str) -> Column:
    """A path below a prefix, with a fixed ending and no empty, ``.`` or ``..`` parts."""
    parts_ok = F.forall(F.split(path, "/"), lambda p: ~p.isin("", ".", ".."))
    return path.startswith(prefix) & path.endswith(ending) & parts_ok


def pointer_rules() -> list[tuple[str, Column]]:
    """Checks on one active pointer, joined with its release (``release_*`` columns)."""
    tenant = F.col("tenant_id")
    releases = F.concat(F.lit("tenants/"), tenant, F.lit("/ontology/releases/"))
    audits = F.concat(F.lit("tenants/"), tenant, F.lit("/ontology/rollbacks/"))
    back = F.col("operation") == "ROLLBACK"

    def if_back(ok: Column) -> Column:
        return F.when(F.coalesce(back, F.lit(False)), ok).otherwise(True)

    return [
        ("MANIFEST_OBJECT", safe_path(F.col("manifest_object"), releases, "/manifest.json")),
        ("RELEASE_UNKNOWN", F.col("release_manifest_sha256").isNotNull()),
        ("MANIFEST_SHA256", F.col("manifest_sha256") == F.col("release_manifest_sha256")),
        ("RECEIPT_SHA256", F.col("receipt_sha256") == F.col("release_receipt_sha256")),
        ("PUBLISHER", F.col("publisher_subject") == F.col("release_publisher_subject")),
        ("OPERATION", F.col("operation").isin(*OPERATIONS)),
        ("AUTHORIZED_AT", valid_utc_second(F.col("authorized_at"))),
        ("ACTIVATED_AT", valid_utc_second(F.col("activated_at"))),
        ("TIME_ORDER", F.col("authorized_at") <= F.col("activated_at")),
        (
            "AUTHORIZATION_OF_RELEASE",
            F.when(F.col("operation") == "PUBLISH", F.col("authorized_at") == F.col("release_authorized_at")).otherwise(True),
        ),
        ("REPLACED_GENERATION", if_back(F.col("replaces_generation") < F.col("generation"))),
        ("ROLLBACK_ACTOR", if_back(F.col("rollback_authorized_by") == F.col("publisher_subject"))),
        ("ROLLBACK_AUDIT_OBJECT", if_back(safe_path(F.col("rollback_audit_object"), audits, "/rollback-audit.json"))),
        ("ROLLBACK_AUDIT_SHA256", if_back(F.col("rollback_audit_sha256").rlike(SHA256))),
        ("PREVIOUS_MANIFEST_SHA256", if_back(F.col("previous_manifest_sha256").rlike(SHA256))),
    ]


def checked_pointers(pointers: DataFrame, releases: DataFrame) -> DataFrame:
    """Pointers with the array ``refused`` of the checks they fail."""
    known = releases.select(
        "tenant_id",
        "manifest_object",
        F.col("manifest_sha256").alias("release_manifest_sha256"),
        F.col("receipt_sha256").alias("release_receipt_sha256"),
        F.col("publisher_subject").alias("release_publisher_subject"),
        F.col("authorized_at").alias("release_authorized_at"),
    )
    joined = pointers.join(known, ["tenant_id", "manifest_object"], "left")
    names = [c for c in joined.columns if not c.startswith("release_")]
    return joined.withColumn("refused", rule_array(pointer_rules())).select(*names, "refused")


def active_release(checked: DataFrame, as_of: int | None = None) -> DataFrame:
    """The newest valid pointer per tenant, or the one in force at a generation."""
    valid = checked.filter(F.size("refused") == 0)
    if as_of is not None:
        valid = valid.filter(F.col("generation") <= as_of)
    fields = [c for c in checked.columns if c not in ("tenant_id", "refused")]
    newest = valid.groupBy("tenant_id").agg(F.max_by(F.struct(*fields), "generation").alias("_p"))
    return newest.select("tenant_id", *[F.col(f"_p.{c}").alias(c) for c in fields])


def last_valid(checked: DataFrame) -> DataFrame:
    """What a tenant is served: the newest valid pointer, DEGRADED if a newer one failed."""
    newest = checked.groupBy("tenant_id").agg(F.max("generation").alias("newest_generation"))
    served = active_release(checked)
    status = (
        F.when(F.col("generation").isNull(), "UNAVAILABLE")
        .when(F.col("generation") == F.col("newest_generation"), "READY")
        .otherwise("DEGRADED_LAST_VALID")
    )
    return newest.join(served, "tenant_id", "left").select(
        "tenant_id", "newest_generation", F.col("generation").alias("served_generation"), "manifest_object", status.alias("status")
    )


def rollback_candidates(checked: DataFrame) -> DataFrame:
    """Earlier releases of a tenant that really were active and are not active now.

    One row per release, with the last generation in which it was active and what a pointer to it must repeat.
    """
    current = active_release(checked).select(
        "tenant_id",
        F.col("generation").alias("current_generation"),
        F.col("manifest_object").alias("current_object"),
        F.col("manifest_sha256").alias("current_sha256"),
    )
    earlier = checked.filter(F.size("refused") == 0).groupBy("tenant_id", "manifest_object", "manifest_sha256").agg(
        F.max("generation").alias("prior_generation"),
        F.max_by(F.struct("receipt_sha256", "publisher_subject"), "generation").alias("_prior"),
    ).select(
        "tenant_id", "manifest_object", "manifest_sha256", "prior_generation",
        F.col("_prior.receipt_sha256").alias("receipt_sha256"),
        F.col("_prior.publisher_subject").alias("target_publisher"),
    )
    # One row per tenant on the right; a tenant may own most of the history.
    return salted_join(earlier, current, "tenant_id").filter(
        (F.col("prior_generation") < F.col("current_generation"))
        & (F.col("manifest_object") != F.col("current_object"))
    )


def build_rollback(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rollback pointers with their audit, or the reasons why a request is refused.

    ``requests`` has ``tenant_id, manifest_object, expected_generation, publisher_subject, authorized_at,
    activated_at, reason, ticket``. Of the admissible requests of a tenant the earliest one wins (ties: the smaller
    ticket, then whatever else they hold); to the others the generation has changed, and so it has to the second
    copy of one request. A pointer has all that ``pointer_rules`` ask for.
    """
    requests = requests.groupBy(*requests.columns).agg(F.count(F.lit(1)).alias("_copies"))
    known = candidates.select(
        "tenant_id", "manifest_object", "manifest_sha256", "receipt_sha256", "target_publisher", "prior_generation",
        "current_generation", "current_object", "current_sha256",
    )
    asked = requests.drop("target_publisher", "manifest_sha256", "receipt_sha256")
    fields = [c for c in asked.columns if c != "_copies"]
    place_in_line = F.struct("activated_at", "ticket", "manifest_object", *[c for c in fields if c not in ("activated_at", "ticket", "manifest_object")])
    joined = asked.join(known, ["tenant_id", "manifest_object"], "left")
    reason = F.trim(F.regexp_replace("reason", r"\s+", " "))
    rules = [
        ("TARGET_WAS_NOT_ACTIVE", F.col("prior_generation").isNotNull()),
        ("GENERATION_CHANGED", F.col("expected_generation") == F.col("current_generation")),
        ("ROLLBACK_ACTOR", F.col("publisher_subject") == F.col("target_publisher")),
        ("AUTHORIZED_AT", valid_utc_second(F.col("authorized_at"))),
        ("ACTIVATED_AT", valid_utc_second(F.col("activated_at"))),
        ("TIME_ORDER", F.col("authorized_at") <= F.col("activated_at")),
        ("REASON", F.length(reason).between(10, 500)),
        ("TICKET", F.col("ticket").rlike(SAFE_TICKET)),
    ]
    audit = canonical_json(
        canonical_struct({
            "operation": F.lit("ROLLBACK"),
            "tenantId": F.col("tenant_id"),
            "publisherSubject": F.col("publisher_subject"),
            "authorizedAt": F.col("authorized_at"),
            "activatedAt": F.col("activated_at"),
            "reason": reason,
            "ticket": F.col("ticket"),
            "expectedGeneration": F.col("expected_generation"),
            "observedGeneration": F.col("current_generation"),
            "fromManifest": F.col("current_object"),
            "fromManifestSha256": F.col("current_sha256"),
            "toManifest": F.col("manifest_object"),
            "toManifestSha256": F.col("manifest_sha256"),
            "toReceiptSha256": F.col("receipt_sha256"),
            "priorGeneration": F.col("prior_generation"),
        })
    )
    staged = joined.withColumn("_rules", rule_array(rules)).withColumn("audit", audit)
    # Compare-and-set has one winner: a plain aggregate over the admissible requests.
    winner = staged.filter(F.size("_rules") == 0).groupBy("tenant_id").agg(
        F.min(place_in_line).alias("_winner")
    )
    decided = salted_join(staged, winner, "tenant_id", "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    won = place_in_line.eqNullSafe(F.col("_winner")) & (F.col("_copy") == 1)
    late = (F.size("_rules") == 0) & ~won
    decided = decided.withColumn(
        "refused", F.when(late, F.array(F.lit("GENERATION_CHANGED"))).otherwise(F.col("_rules"))
    )
    ok = F.size("refused") == 0
    place = F.concat(
        F.lit("tenants/"), F.col("tenant_id"), F.lit("/ontology/rollbacks/"), F.col("current_generation") + 1,
        F.lit("/rollback-audit.json"),
    )
    return decided.select(
        *fields,
        F.when(ok, "ROLLBACK").alias("operation"),
        F.when(ok, F.col("current_generation") + 1).alias("generation"),
        F.when(ok, F.col("current_generation")).alias("replaces_generation"),
        F.when(ok, F.col("manifest_sha256")).alias("manifest_sha256"),
        F.when(ok, F.col("receipt_sha256")).alias("receipt_sha256"),
        F.when(ok, F.col("publisher_subject")).alias("rollback_authorized_by"),
        F.when(ok, F.col("current_object")).alias("previous_manifest_object"),
        F.when(ok, F.col("current_sha256")).alias("previous_manifest_sha256"),
        F.when(ok, place).alias("rollback_audit_object"),
        F.when(ok, F.sha2("audit", 256)).alias("rollback_audit_sha256"),
        F.when(ok, F.col("audit")).alias("audit"),
        "refused",
    )
