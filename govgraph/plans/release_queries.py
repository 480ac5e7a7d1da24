"""Registered queries: ledgers, golden comparison, publication and rollback."""

from __future__ import annotations

from pyspark.sql import functions as F

from govgraph.operators import golden, ledger, publication, release, review
from govgraph.plans.governance_queries import order_receipts
from govgraph.plans.registry import registered, table
from govgraph.session import scratch_path, stored

K = F.col

# Orders as mappings of one bundle per tenant; a receipt exists for most of them.
MAPPINGS = """WITH m AS (SELECT o_orderkey AS k, 't' || (o_custkey % 3) AS tenant_id, 'p' || o_orderkey AS proposal_id,
     CASE WHEN o_orderkey % 3 = 0 THEN 'APPROVED' WHEN o_orderkey % 23 = 4 THEN 'HUMAN_REVIEW' ELSE 'ABSTAINED' END AS status FROM orders)"""


def mapping_table(spark, sf):
    k = K("o_orderkey")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("t"), K("o_custkey") % 3).alias("tenant_id"),
        F.lit("b1").alias("bundle_version"),
        F.concat(F.lit("p"), k).alias("proposal_id"),
        F.when(k % 3 == 0, "APPROVED").when(k % 23 == 4, "HUMAN_REVIEW").otherwise("ABSTAINED").alias("status"),
    )


def bundle_manifests(spark, sf, state="CANDIDATE"):
    """One manifest per tenant, read off the orders."""
    tenants = table(spark, sf, "orders").select(F.concat(F.lit("t"), K("o_custkey") % 3).alias("tenant_id")).distinct()
    return tenants.select(
        "tenant_id",
        F.lit("b1").alias("bundle_version"),
        F.lit("1.0").alias("ontology_version"),
        F.lit(state).alias("state"),
        F.when(K("tenant_id") == "t2", "ACTIVE").otherwise("DEMO_ONLY").alias("serving_mode"),
        F.lit(False).alias("is_published"),
    )


def order_artifacts(spark, sf):
    """Three artifacts per order, with a few defects by remainder."""
    k = K("o_orderkey")
    roles = F.explode(F.array(*[F.lit(r) for r in ledger.ARTIFACT_ROLES]))
    rows = table(spark, sf, "orders").select("*", roles.alias("role"))
    verification = K("role") == "verification"
    evidence = F.sha2(F.concat(F.lit("items"), k), 256)
    return rows.filter(~((k % 29 == 5) & verification)).select(
        F.concat(F.lit("t"), K("o_custkey") % 3).alias("tenant_id"),
        F.lit("b1").alias("bundle_version"),
        F.concat(F.lit("p"), k).alias("proposal_id"),
        "role",
        F.sha2(F.concat(F.when(K("role") == "proposal", "prop").otherwise(K("role")), k), 256).alias("sha256"),
        F.concat(F.lit("p"), F.when((k % 31 == 6) & (K("role") == "proposal"), 0).otherwise(k)).alias("doc_proposal_id"),
        F.concat(F.lit("t"), K("o_custkey") % 3).alias("doc_tenant_id"),
        F.when(verification, F.concat(F.lit("run"), k)).alias("doc_run_id"),
        F.when(verification, F.sha2(F.concat(F.lit("prop"), k), 256)).alias("frozen_proposal_sha256"),
        F.when(K("role") != "proposal", F.sha2(F.concat(F.lit("ev"), F.when((k % 37 == 7) & verification, -1).otherwise(k)), 256)).alias("frozen_evidence_sha256"),
        F.when((k % 41 == 8) & (K("role") == "proposal"), "x").otherwise(evidence).alias("evidence_sha256"),
    )


def ledger_receipts(spark, sf):
    """Normalised receipts; those of the last remainder by seven are not exported."""
    raw = order_receipts(spark, sf).filter("k % 7 <> 6")
    valid = review.normalize_receipts(raw.filter("tenant_id = 't0'"), "t0")
    for tenant in ("t1", "t2"):
        valid = valid.unionByName(review.normalize_receipts(raw.filter(K("tenant_id") == tenant), tenant))
    return valid.withColumn("bundle_version", F.lit("b1"))


LEDGER = (
    MAPPINGS
    + """, broken AS (SELECT k, tenant_id, proposal_id, t.r AS rule FROM m, LATERAL (VALUES
      (CASE WHEN k % 13 = 2 THEN 'RECEIPT_INVALID' END), (CASE WHEN k % 31 = 6 THEN 'PROPOSAL_OF_OTHER_PROPOSAL' END),
      (CASE WHEN k % 29 = 5 THEN 'VERIFICATION_NOT_EXACTLY_ONE' END), (CASE WHEN k % 29 = 5 THEN 'VERIFICATION_OF_OTHER_PROPOSAL' END),
      (CASE WHEN k % 29 = 5 THEN 'VERIFICATION_OF_OTHER_TENANT' END), (CASE WHEN k % 29 = 5 THEN 'RUN_ID_MISMATCH' END),
      (CASE WHEN k % 29 = 5 THEN 'PROPOSAL_NOT_FROZEN' END), (CASE WHEN k % 29 = 5 OR k % 37 = 7 THEN 'EVIDENCE_NOT_FROZEN' END),
      (CASE WHEN k % 41 = 8 THEN 'EVIDENCE_DIFFERS_FROM_PROPOSAL' END), (CASE WHEN k % 29 = 5 THEN 'EVIDENCE_DIFFERS_FROM_RUN' END),
      (CASE WHEN k % 19 = 3 THEN 'ONTOLOGY_VERSION' END), (CASE WHEN k % 3 <> 0 AND k % 23 = 4 THEN 'STATUS_DIFFERS_FROM_MAPPING' END),
      (CASE WHEN k % 11 = 1 THEN 'REVIEWER_ROLE' END)) AS t(r) WHERE k % 7 <> 6 AND t.r IS NOT NULL)"""
)


def _built(spark, sf):
    return ledger.build_ledger(
        bundle_manifests(spark, sf), ledger_receipts(spark, sf), order_artifacts(spark, sf), mapping_table(spark, sf)
    )


BUILD_FINDINGS = LEDGER + " SELECT rule, tenant_id || '/b1/' || proposal_id AS key FROM broken"


@registered("ledger_build_violations", BUILD_FINDINGS)
def _(spark, sf):
    return _built(spark, sf)["violations"].select("rule", "key")


@registered(
    "ledger_decisions",
    LEDGER
    + """ SELECT proposal_id, status, 'r' || k AS decision_id, 'steward' AS reviewer_role FROM m WHERE k % 7 <> 6 AND k NOT IN (SELECT k FROM broken)""",
)
def _(spark, sf):
    return _built(spark, sf)["decisions"].select("proposal_id", "status", "decision_id", "reviewer_role")


@registered(
    "ledger_header",
    MAPPINGS
    + """ SELECT tenant_id, count(*) AS total, count(*) FILTER (status = 'APPROVED') AS approved, count(*) FILTER (status = 'HUMAN_REVIEW') AS human_review,
      CASE WHEN count(*) FILTER (k % 7 = 6) = 0 THEN 'FULL' ELSE 'PARTIAL' END AS coverage FROM m GROUP BY tenant_id""",
)
def _(spark, sf):
    return _built(spark, sf)["header"].select("tenant_id", "total", "approved", "human_review", "coverage")


@registered(
    "ledger_violations",
    MAPPINGS
    + """ SELECT 'LEDGER_STATE' AS rule, tenant_id || '/b1' AS key FROM m GROUP BY tenant_id
      UNION ALL SELECT 'COVERAGE', tenant_id || '/b1' FROM m GROUP BY tenant_id
      UNION ALL SELECT 'POPULATION', tenant_id || '/b1' FROM m WHERE tenant_id = 't1' GROUP BY tenant_id
      UNION ALL SELECT 'UNRESOLVED_MAPPING', tenant_id || '/b1/' || proposal_id FROM m WHERE status <> 'APPROVED'
      UNION ALL SELECT 'DECISION_MISSING', tenant_id || '/b1/' || proposal_id FROM m WHERE k % 7 = 6
      UNION ALL SELECT 'STATUS_DIFFERS_FROM_MAPPING', tenant_id || '/b1/' || proposal_id FROM m WHERE k % 7 <> 6 AND k % 11 = 3 AND status <> 'ABSTAINED'
      UNION ALL SELECT 'DUPLICATE_DECISION', tenant_id || '/b1/' || proposal_id FROM m WHERE k % 7 <> 6 AND k % 17 = 5
      UNION ALL SELECT 'UNKNOWN_MAPPING', tenant_id || '/b1/q' || k FROM m WHERE k % 43 = 9""",
)
def _(spark, sf):
    states = mapping_table(spark, sf)
    k = F.substring("proposal_id", 2, 20).cast("bigint")
    known = states.filter(k % 7 != 6).withColumn("status", F.when(k % 11 == 3, "abstained").otherwise(K("status")))
    unknown = states.filter(k % 43 == 9).withColumn("proposal_id", F.concat(F.lit("q"), k))
    decisions = known.unionByName(known.filter(k % 17 == 5)).unionByName(unknown)
    headers = ledger.population(states).select(
        "*", F.lit("1.0").alias("ontology_version"), F.lit("CANDIDATE").alias("state"), F.lit("PARTIAL").alias("coverage")
    )
    headers = headers.withColumn("total", F.when(K("tenant_id") == "t1", K("total") + 1).otherwise(K("total")))
    return ledger.ledger_violations(headers, bundle_manifests(spark, sf), decisions, states, "publish").select("rule", "key")


REVIEWER_FINDINGS = """WITH d AS (SELECT o_orderkey AS k, 't' || (o_custkey % 3) || '/b1/p' || o_orderkey AS key, o_orderkey % 2 = 0 AS human FROM orders)
    SELECT t.r AS rule, key FROM d, LATERAL (VALUES (CASE WHEN k % 5 = 1 THEN 'REVIEWER_IS_GENERATOR' END), (CASE WHEN k % 7 = 2 THEN 'VERIFIER_IS_GENERATOR' END),
      (CASE WHEN human AND k % 3 = 0 THEN 'HUMAN_ROLE' END), (CASE WHEN human AND k % 11 = 4 AND k % 5 <> 1 AND k % 7 <> 2 THEN 'HUMAN_IS_VERIFIER' WHEN human AND k % 5 = 1 AND k % 7 = 2 THEN 'HUMAN_IS_VERIFIER' END),
      (CASE WHEN NOT human AND k % 3 <> 0 THEN 'MODEL_ROLE' END), (CASE WHEN NOT human AND NOT (k % 11 = 4 AND k % 5 <> 1 AND k % 7 <> 2) AND NOT (k % 5 = 1 AND k % 7 = 2) THEN 'MODEL_IS_NOT_VERIFIER' END),
      (CASE WHEN k % 13 = 5 THEN 'REVIEW_TIME' END)) AS t(r) WHERE t.r IS NOT NULL"""


def reviewer_findings(spark, sf):
    k = K("o_orderkey")
    decisions = table(spark, sf, "orders").select(
        F.concat(F.lit("t"), K("o_custkey") % 3).alias("tenant_id"),
        F.lit("b1").alias("bundle_version"),
        F.concat(F.lit("p"), k).alias("proposal_id"),
        F.lit("gen").alias("generator_subject"),
        F.when(k % 7 == 2, "gen").otherwise("ver").alias("verifier_subject"),
        F.when(k % 5 == 1, "gen").when(k % 11 == 4, "ver").otherwise("me").alias("reviewer_subject"),
        F.when(k % 2 == 0, "HUMAN").otherwise("INDEPENDENT_MODEL").alias("reviewer_kind"),
        F.when(k % 3 == 0, "independent-verifier").otherwise("steward").alias("reviewer_role"),
        F.when(k % 13 == 5, "yesterday").otherwise("2026-06-01T00:00:00Z").alias("reviewed_at"),
        F.sha2(F.lit("r"), 256).alias("source_receipt_sha256"),
        F.lit("d").alias("decision_id"),
    )
    return ledger.reviewer_violations(decisions).select("rule", "key")


registered("reviewer_violations", REVIEWER_FINDINGS)(reviewer_findings)


CHAIN_FINDINGS = (
    LEDGER
    + """ SELECT rule, tenant_id || '/b1/' || proposal_id AS key FROM broken WHERE rule NOT IN ('RECEIPT_INVALID', 'ONTOLOGY_VERSION', 'STATUS_DIFFERS_FROM_MAPPING', 'REVIEWER_ROLE')
      UNION ALL SELECT 'CITED_PROPOSAL_DIGEST', tenant_id || '/b1/' || proposal_id FROM m WHERE k % 7 <> 6 AND k % 47 = 3
      UNION ALL SELECT 'CITED_VERIFICATION_DIGEST', tenant_id || '/b1/' || proposal_id FROM m WHERE k % 7 <> 6 AND k % 29 = 5"""
)


def chain_findings(spark, sf):
    k = F.substring("proposal_id", 2, 20).cast("bigint")
    decisions = mapping_table(spark, sf).filter(k % 7 != 6).select(
        "tenant_id",
        "bundle_version",
        "proposal_id",
        F.concat(F.lit("run"), k).alias("verification_run_id"),
        F.when(k % 47 == 3, "x").otherwise(F.sha2(F.concat(F.lit("prop"), k), 256)).alias("cited_proposal_sha256"),
        F.sha2(F.concat(F.lit("verification"), k), 256).alias("cited_verification_sha256"),
        F.sha2(F.concat(F.lit("evidence-index"), k), 256).alias("cited_evidence_index_sha256"),
    )
    return ledger.artifact_chain_violations(decisions, order_artifacts(spark, sf)).select("rule", "key")


registered("artifact_chain_violations", CHAIN_FINDINGS)(chain_findings)


def _golden_sides(spark, sf):
    """Order totals per priority as golden rows; some actual rows were changed or lost."""
    k = K("o_orderkey")
    expected = table(spark, sf, "orders").select(
        K("o_orderpriority").alias("case_id"), k.alias("position"), K("o_orderstatus").alias("a"), F.when(k % 2 == 0, K("o_custkey")).alias("b")
    )
    actual = expected.filter(K("position") % 41 != 3).withColumn(
        "a", F.when((K("position") % 53 == 4) & (K("case_id") < "3"), "x").otherwise(K("a"))
    )
    return actual.filter(K("case_id") < "4"), expected.filter(K("case_id") < "4")


_GOLDEN = """WITH e AS (SELECT o_orderpriority AS case_id, o_orderkey AS place, o_orderkey % 41 = 3 AS lost, o_orderkey % 53 = 4 AND o_orderpriority < '3' AND o_orderkey % 41 <> 3 AS changed FROM orders WHERE o_orderpriority < '4')"""


@registered(
    "golden_compare",
    _GOLDEN
    + """ SELECT case_id, place, 0 AS actual_n, 1 AS expected_n FROM e WHERE lost OR changed UNION ALL SELECT case_id, place, 1, 0 FROM e WHERE changed""",
)
def _(spark, sf):
    actual, expected = _golden_sides(spark, sf)
    return golden.golden_compare(actual, expected, ["case_id"]).drop("row")


@registered(
    "golden_status",
    _GOLDEN
    + """ SELECT case_id, 'PASS' AS declared_status, CASE WHEN sum(CASE WHEN changed THEN 2 WHEN lost THEN 1 ELSE 0 END) = 0 THEN 'PASS' ELSE 'FAIL' END AS derived_status,
      sum(CASE WHEN changed THEN 2 WHEN lost THEN 1 ELSE 0 END)::BIGINT AS differences,
      CASE WHEN sum(CASE WHEN changed OR lost THEN 1 ELSE 0 END) > 0 THEN 'STATUS_NOT_DERIVED' END AS finding FROM e GROUP BY case_id""",
)
def _(spark, sf):
    actual, expected = _golden_sides(spark, sf)
    cases = expected.select("case_id").distinct().withColumn("declared_status", F.lit("PASS"))
    return golden.golden_status(golden.golden_compare(actual, expected, ["case_id"]), cases, ["case_id"])


@registered(
    "golden_summary",
    """SELECT 't' || (o_custkey % 3) AS tenant_id, count(*) AS total, count(*) FILTER (o_orderkey % 2 = 0) AS passed, FALSE AS complete FROM orders WHERE o_custkey % 3 < 2 GROUP BY 1
    UNION ALL SELECT 'exact', 5, 5, TRUE""",
)
def _(spark, sf):
    k = K("o_orderkey")
    results = table(spark, sf, "orders").select(
        F.concat(F.lit("t"), K("o_custkey") % 3).alias("tenant_id"),
        F.format_string("CQ-%03d", k % 5 + 1).alias("question_id"),
        F.when(k % 2 == 0, "PASS").otherwise("FAIL").alias("derived_status"),
    )
    exact = results.filter("tenant_id = 't2'").select("question_id").distinct().select(
        F.lit("exact").alias("tenant_id"), "question_id", F.lit("PASS").alias("derived_status")
    )
    return golden.golden_summary(results.filter("tenant_id <> 't2'").unionByName(exact), ["tenant_id"])


@registered(
    "publication_gate",
    MAPPINGS
    + """ SELECT 'unknown' AS tenant_id, 1 AS violations, 0 AS mapping_count, 0 AS resolved_count, 0 AS human_review_count, FALSE AS gate_passed
    UNION ALL SELECT tenant_id, CASE WHEN tenant_id = 't2' THEN 1 ELSE 0 END + count(*) FILTER (k % 7 = 6 AND tenant_id = 't1') AS violations, count(*) AS mapping_count,
      count(*) FILTER (status = 'APPROVED') AS resolved_count, count(*) FILTER (status = 'HUMAN_REVIEW') AS human_review_count, tenant_id = 't0' AS gate_passed FROM m GROUP BY tenant_id""",
)
def _(spark, sf):
    states = mapping_table(spark, sf)
    manifests = bundle_manifests(spark, sf)
    k = F.substring("proposal_id", 2, 20).cast("bigint")
    missing = states.filter((k % 7 == 6) & (K("tenant_id") == "t1")).select(
        "tenant_id", "bundle_version", F.lit("DECISION_MISSING").alias("rule"), F.concat_ws("/", "tenant_id", "bundle_version", "proposal_id").alias("key"), F.lit(None).cast("string").alias("detail")
    )
    totals = manifests.select("tenant_id", "bundle_version", F.lit(5).alias("total"), F.lit(5).alias("passed"), F.lit(True).alias("complete"))
    stray = missing.limit(1).select(F.lit("unknown").alias("tenant_id"), "bundle_version", "rule", "key", "detail")
    gate = release.publication_gate(manifests, "candidate", states, totals, [missing, stray])
    return gate.select("tenant_id", "violations", "mapping_count", "resolved_count", "human_review_count", "gate_passed")


def release_requests(spark, sf):
    """Customers as tenants that ask for a release."""
    k = K("c_custkey")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("c"), k).alias("tenant_id"),
        F.lit("b1").alias("bundle_version"),
        F.lit("1.0").alias("ontology_version"),
        F.lit("publisher").alias("publisher_subject"),
        F.lit("2026-06-01T00:00:00Z").alias("authorized_at"),
        F.when(k % 5 == 2, "2026-05-01T00:00:00Z").otherwise("2026-06-02T00:00:00Z").alias("published_at"),
        F.when(k % 7 == 3, "short").otherwise(F.sha2(K("c_name"), 256)).alias("release_sha"),
        F.concat(F.lit("rel-"), k).alias("release_id"),
        F.sha2(F.lit("manifest"), 256).alias("source_manifest_sha256"),
        F.sha2(F.lit("ledger"), 256).alias("review_ledger_sha256"),
        (k % 3 != 1).alias("gate_passed"),
    )


@registered(
    "promote",
    """WITH c AS (SELECT c_custkey AS k, 'c' || c_custkey AS tenant_id, concat_ws(',', CASE WHEN c_custkey % 3 = 1 THEN 'GATE' END, CASE WHEN c_custkey % 5 = 2 THEN 'TIME_ORDER' END, CASE WHEN c_custkey % 7 = 3 THEN 'RELEASE_SHA' END) AS refused,
      sha256(c_name) AS sha FROM customer)
    SELECT tenant_id, refused, CASE WHEN refused = '' THEN 'tenants/' || tenant_id || '/ontology/releases/b1-rel-' || k || '/manifest.json' END AS manifest_object,
      CASE WHEN refused = '' THEN sha256('{"authorized_at":"2026-06-01T00:00:00Z","bundle_version":"b1","ontology_version":"1.0","published_at":"2026-06-02T00:00:00Z","publisher_subject":"publisher","release_id":"rel-' || k
        || '","release_sha":"' || sha || '","review_ledger_sha256":"' || sha256('ledger') || '","source_manifest_sha256":"' || sha256('manifest') || '","tenant_id":"' || tenant_id || '"}') END AS receipt_sha256 FROM c""",
)
def _(spark, sf):
    requests = release_requests(spark, sf)
    done = release.promote(requests.drop("gate_passed"), requests.select("tenant_id", "bundle_version", "gate_passed"))
    return done.select("tenant_id", F.array_join("refused", ",").alias("refused"), "manifest_object", "receipt_sha256")


@registered(
    "publication_commits",
    """WITH c AS (SELECT c_custkey AS k, 'c' || c_custkey AS tenant_id FROM customer WHERE c_custkey % 3 <> 1 AND c_custkey % 5 <> 2 AND c_custkey % 7 <> 3)
    SELECT tenant_id, CASE WHEN k % 4 = 0 THEN 3 WHEN k % 2 = 0 THEN 2 ELSE 1 END AS generation, CASE WHEN k % 4 = 0 THEN 'ROLLBACK' ELSE 'PUBLISH' END AS operation,
      'tenants/' || tenant_id || '/ontology/releases/b' || (CASE WHEN k % 4 = 2 THEN 2 ELSE 1 END) || '-rel-' || k || '/manifest.json' AS manifest_object FROM c""",
)
def _(spark, sf):
    """Two waves of releases, each request delivered twice, and a rollback of every fourth tenant."""
    root = scratch_path(spark, "published")
    requests = release_requests(spark, sf)
    k = F.substring("tenant_id", 2, 20).cast("bigint")
    for wave, who in ((1, F.lit(True)), (2, k % 2 == 0)):
        asked = requests.filter(who).withColumn("bundle_version", F.lit(f"b{wave}"))
        promoted = release.promote(asked.drop("gate_passed"), asked.select("tenant_id", "bundle_version", "gate_passed"))
        twice = promoted.withColumn("expected_generation", F.lit(wave - 1).cast("bigint"))
        publication.publish(twice.unionByName(twice), root, f"2026-06-03T00:00:0{wave}Z")
    back = publication.releases(spark, root).filter((K("bundle_version") == "b1") & (k % 4 == 0)).select(
        "tenant_id", "manifest_object", F.lit(2).cast("bigint").alias("expected_generation"), "publisher_subject",
        F.lit("2026-06-04T00:00:00Z").alias("authorized_at"), F.lit("2026-06-04T00:00:01Z").alias("activated_at"),
        F.lit("the second release is broken").alias("reason"), F.lit("OPS-1").alias("ticket"),
    )
    publication.roll_back(back, root)
    return publication.active(spark, root).select("tenant_id", "generation", "operation", "manifest_object")


@registered(
    "gate_to_pointer",
    f"""WITH a AS ({BUILD_FINDINGS}), b AS ({REVIEWER_FINDINGS}), c AS ({CHAIN_FINDINGS}),
    f AS (SELECT CAST(substr(split_part(key, '/', 3), 2) AS BIGINT) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)),
    v AS (SELECT o_custkey, count(*) AS n FROM f JOIN orders ON o_orderkey = k GROUP BY 1),
    g AS (SELECT 'c' || o_custkey AS tenant_id, o_custkey, coalesce(max(v.n), 0) AS violations, count(*) AS mapping_count, CASE WHEN o_custkey % 6 = 2 THEN 4 ELSE 5 END AS golden_passed
      FROM orders LEFT JOIN v USING (o_custkey) GROUP BY o_custkey)
    SELECT tenant_id, violations, mapping_count, golden_passed, violations = 0 AND golden_passed = 5 AS gate_passed, CASE WHEN violations = 0 AND golden_passed = 5 THEN 1 END AS generation FROM g""",
)
def _(spark, sf):
    """Every customer as a tenant: findings of ledger, reviewers and artifact chains, golden results, gate, promotion, pointer."""
    customer = F.concat(F.lit("c"), "o_custkey").alias("tenant_id")
    owners = table(spark, sf, "orders").select(F.concat(F.lit("p"), "o_orderkey").alias("proposal_id"), customer)
    bundle = F.lit("b1").alias("bundle_version")
    found = _built(spark, sf)["violations"].select("rule", "key").unionByName(reviewer_findings(spark, sf)).unionByName(chain_findings(spark, sf))
    findings = found.withColumn("proposal_id", F.element_at(F.split("key", "/"), 3)).join(owners, "proposal_id").select(
        "tenant_id", bundle, "rule", "key", F.lit(None).cast("string").alias("detail")
    )
    states = mapping_table(spark, sf).drop("tenant_id").join(owners, "proposal_id")
    tenants = owners.select("tenant_id").distinct()
    manifests = tenants.select(
        "tenant_id", bundle, F.lit("CANDIDATE").alias("state"), F.lit("DEMO_ONLY").alias("serving_mode"), F.lit(False).alias("is_published")
    )
    number = F.substring("tenant_id", 2, 20).cast("bigint")
    results = tenants.select("tenant_id", bundle, F.explode(F.sequence(F.lit(1), F.lit(5))).alias("n")).select(
        "tenant_id", "bundle_version", F.format_string("CQ-%03d", K("n")).alias("question_id"),
        F.when((number % 6 == 2) & (K("n") == 3), "FAIL").otherwise("PASS").alias("derived_status"),
    )
    totals = golden.golden_summary(results, ["tenant_id", "bundle_version"])
    gate = stored(release.publication_gate(manifests, "candidate", states, totals, [findings]), "gate")
    requests = tenants.select(
        "tenant_id", bundle, F.lit("1.0").alias("ontology_version"), F.lit("publisher").alias("publisher_subject"),
        F.lit("2026-06-01T00:00:00Z").alias("authorized_at"), F.lit("2026-06-02T00:00:00Z").alias("published_at"),
        F.sha2("tenant_id", 256).alias("release_sha"), F.concat(F.lit("rel-"), "tenant_id").alias("release_id"),
        F.sha2(F.lit("manifest"), 256).alias("source_manifest_sha256"), F.sha2(F.lit("ledger"), 256).alias("review_ledger_sha256"),
    )
    promoted = release.promote(requests, gate).withColumn("expected_generation", F.lit(0).cast("bigint"))
    root = scratch_path(spark, "published")
    publication.publish(promoted, root, "2026-06-03T00:00:00Z")
    now = publication.active(spark, root).select("tenant_id", "generation")
    return gate.join(now, "tenant_id", "left").select("tenant_id", "violations", "mapping_count", "golden_passed", "gate_passed", "generation")


# Orders as pointers: tenant = customer, generation = order key, release = order key modulo 3.
POINTERS = """WITH p AS (SELECT 'c' || o_custkey AS tenant_id, o_orderkey AS generation, o_orderkey % 3 AS rel,
     'tenants/c' || o_custkey || '/ontology/releases/b-' || (o_orderkey % 3) || '/manifest.json' AS manifest_object,
     concat_ws(',', CASE WHEN o_orderkey % 7 = 2 THEN 'MANIFEST_SHA256' END, CASE WHEN o_orderkey % 11 = 3 THEN 'TIME_ORDER' END, CASE WHEN o_orderkey % 13 = 4 THEN 'ROLLBACK_ACTOR' END) AS refused FROM orders),
   ok AS (SELECT * FROM p WHERE refused = ''),
   active AS (SELECT tenant_id, max(generation) AS generation, arg_max(manifest_object, generation) AS manifest_object FROM ok GROUP BY tenant_id)"""


def order_pointers(spark, sf):
    k = K("o_orderkey")
    tenant = F.concat(F.lit("c"), K("o_custkey"))
    name = release.release_object(tenant, F.lit("b"), (k % 3).cast("string"))
    back = k % 2 == 0
    pointers = table(spark, sf, "orders").select(
        tenant.alias("tenant_id"),
        k.alias("generation"),
        name.alias("manifest_object"),
        F.when(k % 7 == 2, "x").otherwise(F.sha2(name, 256)).alias("manifest_sha256"),
        F.sha2(F.lit("receipt"), 256).alias("receipt_sha256"),
        F.lit("publisher").alias("publisher_subject"),
        F.when(back | (k % 13 == 4), "ROLLBACK").otherwise("PUBLISH").alias("operation"),
        F.lit("2026-06-01T00:00:00Z").alias("authorized_at"),
        F.when(k % 11 == 3, "2026-05-01T00:00:00Z").otherwise("2026-06-02T00:00:00Z").alias("activated_at"),
        (k - 1).alias("replaces_generation"),
        F.when(k % 13 == 4, "someone").otherwise("publisher").alias("rollback_authorized_by"),
        F.concat(F.lit("tenants/"), tenant, F.lit("/ontology/rollbacks/"), k, F.lit("/rollback-audit.json")).alias("rollback_audit_object"),
        F.sha2(F.lit("audit"), 256).alias("rollback_audit_sha256"),
        F.sha2(F.lit("previous"), 256).alias("previous_manifest_sha256"),
    )
    return release.checked_pointers(pointers, order_releases(spark, sf))


def order_releases(spark, sf):
    """The release that every pointer of an order names."""
    k = K("o_orderkey")
    tenant = F.concat(F.lit("c"), K("o_custkey"))
    name = release.release_object(tenant, F.lit("b"), (k % 3).cast("string"))
    named = table(spark, sf, "orders").select(tenant.alias("tenant_id"), name.alias("manifest_object"))
    return named.distinct().select(
        "*",
        F.sha2("manifest_object", 256).alias("manifest_sha256"),
        F.sha2(F.lit("receipt"), 256).alias("receipt_sha256"),
        F.lit("publisher").alias("publisher_subject"),
        F.lit("2026-06-01T00:00:00Z").alias("authorized_at"),
    )


@registered("checked_pointers", POINTERS + " SELECT tenant_id, generation, refused FROM p")
def _(spark, sf):
    return order_pointers(spark, sf).select("tenant_id", "generation", F.array_join("refused", ",").alias("refused"))


@registered("active_release", POINTERS + " SELECT tenant_id, generation, manifest_object FROM active")
def _(spark, sf):
    return release.active_release(order_pointers(spark, sf)).select("tenant_id", "generation", "manifest_object")


@registered(
    "release_as_of",
    POINTERS + " SELECT tenant_id, max(generation) AS generation FROM ok WHERE generation <= 700 GROUP BY tenant_id",
)
def _(spark, sf):
    return release.active_release(order_pointers(spark, sf), as_of=700).select("tenant_id", "generation")


@registered(
    "last_valid",
    POINTERS
    + """ SELECT n.tenant_id, newest_generation, a.generation AS served_generation, a.manifest_object,
      CASE WHEN a.generation IS NULL THEN 'UNAVAILABLE' WHEN a.generation = newest_generation THEN 'READY' ELSE 'DEGRADED_LAST_VALID' END AS status
    FROM (SELECT tenant_id, max(generation) AS newest_generation FROM p GROUP BY tenant_id) n LEFT JOIN active a USING (tenant_id)""",
)
def _(spark, sf):
    return release.last_valid(order_pointers(spark, sf))


CANDIDATES = (
    POINTERS
    + """, cand AS (SELECT o.tenant_id, o.manifest_object, max(o.generation) AS prior_generation, a.generation AS current_generation, a.manifest_object AS current_object
      FROM ok o JOIN active a ON a.tenant_id = o.tenant_id WHERE o.manifest_object <> a.manifest_object GROUP BY o.tenant_id, o.manifest_object, a.generation, a.manifest_object
      HAVING max(o.generation) < a.generation)"""
)


@registered("rollback_candidates", CANDIDATES + " SELECT tenant_id, manifest_object, prior_generation, current_generation FROM cand")
def _(spark, sf):
    found = release.rollback_candidates(order_pointers(spark, sf))
    return found.select("tenant_id", "manifest_object", "prior_generation", "current_generation")


ROLLBACKS = (
    CANDIDATES
    + """, asked AS (SELECT p.tenant_id, p.generation AS asked_at, p.manifest_object, c.current_generation, concat_ws(',', CASE WHEN c.tenant_id IS NULL THEN 'TARGET_WAS_NOT_ACTIVE' END,
       CASE WHEN c.tenant_id IS NULL OR p.generation % 17 = 5 THEN 'GENERATION_CHANGED' END, CASE WHEN c.tenant_id IS NULL THEN 'ROLLBACK_ACTOR' END,
       CASE WHEN p.generation % 19 = 6 THEN 'REASON' END) AS rules
    FROM p LEFT JOIN cand c ON c.tenant_id = p.tenant_id AND c.manifest_object = p.manifest_object),
    winner AS (SELECT tenant_id, min('OPS-' || asked_at) AS ticket FROM asked WHERE rules = '' GROUP BY tenant_id),
    made AS (SELECT asked.*, CASE WHEN rules = '' AND ('OPS-' || asked_at <> ticket OR copy > 0) THEN 'GENERATION_CHANGED' ELSE rules END AS refused
      FROM (SELECT *, unnest(range(CASE WHEN asked_at % 4 = 1 THEN 2 ELSE 1 END)) AS copy FROM asked) asked LEFT JOIN winner USING (tenant_id))"""
)


def order_rollbacks(spark, sf):
    """A rollback request per pointer, some with an old generation or without a reason."""
    k2 = K("asked_at")
    checked = order_pointers(spark, sf)
    candidates = release.rollback_candidates(checked)
    current = candidates.groupBy("tenant_id").agg(F.max("current_generation").alias("seen"))
    k = K("generation")
    requests = checked.join(current, "tenant_id", "left").select(
        "tenant_id",
        "manifest_object",
        F.when(k % 17 == 5, -1).otherwise(K("seen")).alias("expected_generation"),
        F.lit("publisher").alias("publisher_subject"),
        F.lit("2026-06-01T00:00:00Z").alias("authorized_at"),
        F.lit("2026-06-01T00:00:01Z").alias("activated_at"),
        F.when(k % 19 == 6, "  why  ").otherwise(F.concat(F.lit("the release is broken  "), k)).alias("reason"),
        F.concat(F.lit("OPS-"), k).alias("ticket"),
        k.alias("asked_at"),
    )
    # Every fourth request is delivered twice.
    twice = requests.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(k2 % 4 == 1, 2).otherwise(1)))).drop("copy")
    return release.build_rollback(twice, candidates)


@registered(
    "build_rollback",
    ROLLBACKS
    + """ SELECT tenant_id, asked_at, refused, CASE WHEN refused = '' THEN current_generation + 1 END AS generation,
      CASE WHEN refused = '' THEN sha256(manifest_object) END AS manifest_sha256 FROM made""",
)
def _(spark, sf):
    made = order_rollbacks(spark, sf)
    return made.select("tenant_id", "asked_at", F.array_join("refused", ",").alias("refused"), "generation", "manifest_sha256")


@registered(
    "rollback_round_trip",
    ROLLBACKS
    + """ SELECT a.tenant_id, coalesce(m.current_generation + 1, a.generation) AS generation, coalesce(m.manifest_object, a.manifest_object) AS manifest_object
      FROM active a LEFT JOIN (SELECT * FROM made WHERE refused = '') m USING (tenant_id)""",
)
def _(spark, sf):
    """The issued pointers are read back with the old ones: they are valid and in force."""
    before = order_pointers(spark, sf)
    issued = order_rollbacks(spark, sf).filter(F.size("refused") == 0)
    columns = [c for c in before.columns if c != "refused"]
    pointers = before.select(*columns).unionByName(issued.select(*columns))
    after = release.checked_pointers(pointers, order_releases(spark, sf))
    return release.active_release(after).select("tenant_id", "generation", "manifest_object")
