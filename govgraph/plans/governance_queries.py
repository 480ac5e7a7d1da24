"""Registered queries: proposals, verification and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from govgraph.functions import normalize_model, normalize_provider
from govgraph.operators import proposals, review, verification
from govgraph.plans import bank
from govgraph.plans.governance import (
    EVALUATED_AT,
    HEADS,
    PROPOSALS,
    REVIEWS,
    bound_reviews,
    event_heads,
    order_outcomes,
    order_proposals,
    order_runs,
    order_states,
    reviewable,
)
from govgraph.plans.graph_queries import CONCEPT_LABELS
from govgraph.plans.registry import registered, table
from govgraph.plans.resolution import resolution_sql
from govgraph.session import stored


def document_snapshots(spark, sf):
    """Documents as profiled snapshots."""
    sha = F.sha2("text", 256)
    return table(spark, sf, "documents").select(
        F.concat(F.lit("t-"), "lang").alias("tenant_id"),
        F.col("source").alias("source_id"),
        F.lit("lake").alias("bucket"),
        F.concat("doc_id", F.lit(".txt")).alias("object_name"),
        F.col("doc_id").alias("generation"),
        F.lit("text/plain").alias("content_type"),
        F.col("n_chars").alias("size_bytes"),
        F.lit("2026-06-01T00:00:00Z").alias("observed_at"),
        F.lit("1.0").alias("ontology_version"),
        sha.alias("sha256"),
        F.col("n_chars").alias("byte_size"),
        F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")).alias("record_count"),
        F.lit("text/plain").alias("media_type"),
        F.lit("x/1").alias("extractor_version"),
    )


@registered(
    "ingestion_proposals",
    """WITH d AS (SELECT *, sha256(text) AS sha, CASE WHEN doc_id % 3 <> 0 THEN CAST(n_chars AS VARCHAR) ELSE 'null' END AS records FROM documents),
    j AS (SELECT *, '{"algorithmVersion":"govgraph-discovery/1.0.0","ontologyVersion":"1.0","profile":{"byteSize":' || n_chars || ',"contentSha256":"' || sha
      || '","extractorVersion":"x/1","mediaType":"text/plain","recordCount":' || records || '},"sourceId":"' || source || '","sourceObject":{"bucket":"lake","contentType":"text/plain","generation":"'
      || doc_id || '","name":"' || doc_id || '.txt","sizeBytes":' || n_chars || '},"sourceSnapshotIds":["' || source || '@sha256:' || sha || '"],"tenantId":"t-' || lang || '"}' AS input FROM d)
    SELECT 'ingestion-' || sha256(input) AS proposal_id, 't-' || lang AS tenant_id, 'gs://lake/' || doc_id || '.txt#generation=' || doc_id AS source_locator,
      CASE WHEN records = 'null' THEN 0 ELSE 1 END AS instance, 0 AS error_count FROM j""",
)
def _(spark, sf):
    made = proposals.proposal_errors(proposals.ingestion_proposals(document_snapshots(spark, sf)))
    return made.select(
        "proposal_id",
        "tenant_id",
        "source_locator",
        F.get_json_object("confidence", "$.instance").cast("int").alias("instance"),
        F.size("errors").alias("error_count"),
    )


_COLUMNS = """SELECT doc_id, unnest(['red widget', 'old bolt ' || (doc_id % 50), 'zzzz', source]) AS column_name FROM documents"""


@registered(
    "mapping_proposals",
    f"""WITH RECURSIVE {resolution_sql(f"SELECT column_name AS term FROM ({_COLUMNS})", CONCEPT_LABELS, 1)},
    c AS ({_COLUMNS}),
    d AS (SELECT doc_id, lang, source, sha256(text) AS sha FROM documents),
    j AS (SELECT *, CASE WHEN score = 1 THEN '1' ELSE score::varchar END AS lexical FROM d JOIN c USING (doc_id) JOIN resolved ON term = column_name WHERE score >= 0.5),
    k AS (SELECT *, '{{"algorithmVersion":"govgraph-column-mapping/1.0.0","columnName":"' || column_name || '","ontologyVersion":"1.0","profile":{{"contentSha256":"' || sha || '","extractorVersion":"x/1"}},'
      || '"resolvedConcept":{{"conceptType":"http://www.w3.org/2004/02/skos/core#Concept","iri":"' || iri || '","label":"' || label || '","matchedOn":"' || matched_on || '","score":' || lexical || '}},"sourceId":"' || source
      || '","sourceObject":{{"bucket":"lake","generation":"' || doc_id || '","name":"' || doc_id || '.txt"}},"sourceSnapshotIds":["' || source || '@sha256:' || sha || '"],"tenantId":"t-' || lang || '"}}' AS input FROM j)
    SELECT 'mapping-' || sha256(input) AS proposal_id, 't-' || lang AS tenant_id, iri AS target_iri,
      'gs://lake/' || doc_id || '.txt#generation=' || doc_id || '#column=' || column_name AS source_locator, score AS lexical FROM k""",
)
def _(spark, sf):
    numbered = F.concat(F.lit("old bolt "), F.col("generation") % 50)
    names = F.array(F.lit("red widget"), numbered, F.lit("zzzz"), F.col("source_id"))
    profiles = document_snapshots(spark, sf).withColumn("column_names", names)
    made = proposals.mapping_proposals(profiles, bank.concept_graph(spark, sf))
    lexical = F.get_json_object("confidence", "$.lexical").cast("double")
    return made.select("proposal_id", "tenant_id", "target_iri", "source_locator", lexical.alias("lexical"))


@registered(
    "resolved_mappings",
    """WITH d AS (SELECT doc_id, lang, source, sha256(text) AS sha FROM documents),
    j AS (SELECT *, '{"algorithmVersion":"govgraph-column-mapping/1.0.0","columnName":"lang","ontologyVersion":"1.0","profile":{"contentSha256":"' || sha || '","extractorVersion":"x/1"},'
      || '"resolvedConcept":{"conceptType":null,"iri":"urn:x:' || lang || '","label":"Language","matchedOn":"prefLabel","score":0.84},"sourceId":"' || source
      || '","sourceObject":{"bucket":"lake","generation":"' || doc_id || '","name":"' || doc_id || '.txt"},"sourceSnapshotIds":["' || source || '@sha256:' || sha || '"],"tenantId":"t-' || lang || '"}' AS input FROM d)
    SELECT 'mapping-' || sha256(input) AS proposal_id, 'urn:x:' || lang AS target_iri, 'gs://lake/' || doc_id || '.txt#generation=' || doc_id || '#column=lang' AS source_locator, 0 AS error_count FROM j""",
)
def _(spark, sf):
    resolved = document_snapshots(spark, sf).select(
        "*",
        F.lit("lang").alias("column_name"),
        F.concat(F.lit("urn:x:"), F.expr("substr(tenant_id, 3)")).alias("iri"),
        F.lit("Language").alias("label"),
        F.lit(0.84).alias("score"),
        F.lit("prefLabel").alias("matched_on"),
        F.lit(None).cast("string").alias("concept_type"),
    )
    made = proposals.proposal_errors(proposals.resolved_mapping_proposals(resolved))
    return made.select("proposal_id", "target_iri", "source_locator", F.size("errors").alias("error_count"))


_DIGEST = """sha256(count(*) || ':' || sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) || ':' || sum(CAST('0x' || substr(h, 16, 15) AS BIGINT))
      || ':' || sum(CAST('0x' || substr(h, 31, 15) AS BIGINT)) || ':' || sum(CAST('0x' || substr(h, 46, 15) AS BIGINT)))"""
DRIFT = (
    HEADS
    + f""", c AS (SELECT tenant_id, sha256(concat_ws(chr(31), source_id, source_id || '@sha256:' || sha, sha, previous, 'events#' || loc, 'x/1')) AS h FROM (
       SELECT heads.*, e.event_id AS loc FROM heads JOIN events e ON (CASE WHEN e.event_id % 2 = 1 THEN e.event_id + 100 ELSE e.event_id END) = heads.seq AND 's' || e.user_id = heads.source_id) WHERE changed),
    d AS (SELECT tenant_id, count(*) AS n, {_DIGEST} AS digest FROM c GROUP BY tenant_id),
    drift AS (SELECT tenant_id, n, 'drift-' || sha256('{{"algorithmVersion":"govgraph-drift/1.0.0","changedSources":' || n || ',"changedSourcesDigest":"' || digest
       || '","ontologyVersion":"1.0","tenantId":"' || tenant_id || '"}}') AS proposal_id FROM d)"""
)


@registered("drift_proposals", DRIFT + " SELECT tenant_id, proposal_id, 0 AS error_count FROM drift")
def _(spark, sf):
    made = proposals.drift_proposals(event_heads(spark, sf), "1.0", EVALUATED_AT)
    return proposals.proposal_errors(made).select("tenant_id", "proposal_id", F.size("errors").alias("error_count"))


@registered(
    "drift_evidence",
    DRIFT
    + """ SELECT proposal_id, 'evidence-' || sha256('{"current":"' || sha || '","previous":"' || previous || '","snapshotId":"' || source_id || '@sha256:' || sha || '","sourceId":"' || source_id || '"}') AS evidence_id,
      tenant_id, source_id, sha AS content_sha256 FROM heads JOIN drift USING (tenant_id) WHERE changed""",
)
def _(spark, sf):
    heads = event_heads(spark, sf)
    rows = proposals.drift_evidence(heads, proposals.drift_proposals(heads, "1.0", EVALUATED_AT))
    return rows.select("proposal_id", "evidence_id", "tenant_id", "source_id", "content_sha256")


@registered("proposal_errors", PROPOSALS + " SELECT proposal_id, errors FROM p")
def _(spark, sf):
    checked = proposals.proposal_errors(order_proposals(spark, sf))
    return checked.select("proposal_id", F.array_join("errors", "; ").alias("errors"))


@registered(
    "evidence_errors",
    PROPOSALS
    + """ SELECT proposal_id, concat_ws('; ', CASE WHEN k % 43 = 7 THEN 'e[0] OTHER_TENANT' END, CASE WHEN k % 47 = 8 THEN 'e[0] CONTENT_SHA256_FORM' END,
      CASE WHEN k % 43 = 7 THEN 'e[1] OTHER_TENANT' END, CASE WHEN k % 47 = 8 THEN 'e[1] CONTENT_SHA256_FORM' END, 'e EVIDENCE_ID_REPEATED') AS errors FROM p""",
)
def _(spark, sf):
    twice = F.concat("evidence", "evidence")
    errors = proposals.evidence_errors(twice, F.col("tenant_id"), F.col("source_snapshot_ids"), "e")
    return order_proposals(spark, sf).select("proposal_id", F.array_join(errors, "; ").alias("errors"))


@registered(
    "confidence_errors",
    PROPOSALS
    + """ SELECT proposal_id, concat_ws('; ', CASE WHEN k % 61 = 11 THEN 'confidence UNKNOWN_FIELD' END, CASE WHEN k % 59 = 10 THEN 'confidence.lexical OUT_OF_RANGE' END) AS errors FROM p""",
)
def _(spark, sf):
    errors = proposals.confidence_errors(F.col("confidence"))
    return order_proposals(spark, sf).select("proposal_id", F.array_join(errors, "; ").alias("errors"))


@registered(
    "generator_errors",
    PROPOSALS + " SELECT proposal_id, CASE WHEN k % 67 = 12 THEN 'generator.mode INVALID' ELSE '' END AS errors FROM p",
)
def _(spark, sf):
    errors = proposals.generator_errors(F.col("generator"))
    return order_proposals(spark, sf).select("proposal_id", F.array_join(errors, "; ").alias("errors"))


@registered("tampered", PROPOSALS + " SELECT proposal_id FROM p WHERE k % 53 = 9")
def _(spark, sf):
    return proposals.tampered(order_proposals(spark, sf)).select("proposal_id")


@registered(
    "gate_results",
    PROPOSALS
    + """ SELECT proposal_id, t.o AS "order", t.g AS gate, t.s AS status FROM v, LATERAL (VALUES
      (1, 'CONTRACT', CASE WHEN valid THEN 'PASSED' ELSE 'FAILED' END), (2, 'SEMANTIC', 'SKIPPED'),
      (3, 'SOURCE_EVIDENCE', CASE WHEN valid THEN 'PASSED' ELSE 'FAILED' END),
      (4, 'INDEPENDENT_QUESTIONS', CASE WHEN NOT recorded OR verdict = 'ABSTAINED' THEN 'SKIPPED' WHEN verdict = 'SUPPORTED' THEN 'PASSED' ELSE 'FAILED' END),
      (5, 'MODEL_CONSISTENCY', CASE WHEN NOT recorded OR NOT independent OR agreement IS NULL THEN 'SKIPPED' WHEN agreement THEN 'PASSED' ELSE 'FAILED' END),
      (6, 'DATA_TESTS', CASE WHEN valid THEN 'REVIEW_REQUIRED' ELSE 'SKIPPED' END), (7, 'GLOBAL_CONSISTENCY', 'SKIPPED'),
      (8, 'HUMAN_ADJUDICATION', CASE WHEN valid THEN 'REVIEW_REQUIRED' ELSE 'SKIPPED' END)) AS t(o, g, s)""",
)
def _(spark, sf):
    return verification.gate_results(order_runs(spark, sf)).select("proposal_id", "order", "gate", "status")


@registered(
    "verification_runs",
    PROPOSALS
    + """ SELECT tenant_id, proposal_id, sha256('verification' || chr(31) || tenant_id || chr(31) || proposal_id) AS verification_run_id,
      CASE WHEN valid THEN 'HUMAN_REVIEW' ELSE 'ABSTAINED' END AS status,
      CASE WHEN NOT valid THEN 'CONTRACT_OR_EVIDENCE_INCOMPLETE,VERIFIER_ABSTAINED' WHEN recorded THEN 'INDEPENDENT_VERIFIER_RECORDED,STEWARD_REVIEW_REQUIRED' ELSE 'INDEPENDENT_VERIFIER_NOT_CONFIGURED,STEWARD_REVIEW_REQUIRED' END AS reasons,
      CASE WHEN recorded THEN 'live' ELSE 'disabled' END AS mode, TRUE AS hash_holds FROM v""",
)
def _(spark, sf):
    runs = order_runs(spark, sf)
    return runs.select(
        "tenant_id",
        "proposal_id",
        "verification_run_id",
        "status",
        F.array_join("gate_result.reason_codes", ",").alias("reasons"),
        F.col("models.mode").alias("mode"),
        (verification.run_sha256() == F.col("verification_run_sha256")).alias("hash_holds"),
    )


@registered(
    "proposal_updates",
    PROPOSALS
    + """ SELECT proposal_id, CASE WHEN valid THEN 'HUMAN_REVIEW' ELSE 'ABSTAINED' END AS status, 8 AS gates,
      CASE WHEN valid THEN 'PASSED' ELSE 'FAILED' END AS contract, '2026-07-01T00:00:00Z' AS verified_at FROM v""",
)
def _(spark, sf):
    updates = verification.proposal_updates(order_runs(spark, sf))
    return updates.select(
        "proposal_id", "status", F.size("gate_summary").alias("gates"), F.col("gate_summary")[0]["status"].alias("contract"), "verified_at"
    )


_DECISIONS = """WITH d AS (SELECT o_orderkey AS k, CASE WHEN o_orderpriority < '3' THEN 'HIGH' ELSE 'LOW' END AS risk, o_orderkey % 2 = 0 AS dependent,
      o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AS free, (['SUPPORTED','REJECTED','ABSTAINED'])[o_orderkey % 3 + 1] AS verdict, o_orderkey % 101 >= 50 AS sure,
      o_orderkey % 11 <> 4 AND o_orderkey % 13 <> 6 AS covered FROM orders)"""


@registered(
    "approval_decision",
    _DECISIONS
    + """ SELECT k, CASE WHEN risk = 'HIGH' THEN 'HUMAN_REVIEW' WHEN dependent AND NOT free THEN 'HUMAN_REVIEW' WHEN verdict = 'REJECTED' THEN 'REJECTED'
      WHEN verdict = 'ABSTAINED' THEN 'ABSTAINED' WHEN free AND sure AND covered THEN 'AUTO_APPROVED' ELSE 'HUMAN_REVIEW' END AS status,
      CASE WHEN free AND verdict = 'SUPPORTED' THEN TRUE WHEN free AND verdict = 'REJECTED' THEN FALSE END AS model_agreement FROM d""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    verdicts = F.array(*[F.lit(v) for v in verification.VERDICTS])
    decisions = table(spark, sf, "orders").select(
        k.alias("k"),
        F.when(F.col("o_orderpriority") < "3", "HIGH").otherwise("LOW").alias("risk"),
        (k % 2 == 0).alias("model_dependent"),
        F.array(F.lit("a"), F.lit("b")).alias("evidence_ids"),
        F.lit("Gemini").alias("generator_provider"),
        F.lit("gemini-2.0-pro-preview-20250101-latest").alias("generator_model"),
        F.get(verdicts, (k % 3).cast("int")).alias("verdict"),
        F.when(k % 101 >= 50, 0.95).otherwise(0.9).alias("confidence"),
        F.when(k % 11 == 4, F.array().cast("array<string>")).when(k % 13 == 6, F.array(F.lit("z"))).otherwise(F.array(F.lit("b"))).alias("cited_ids"),
        F.when(k % 7 == 0, "google-genai").otherwise("Claude").alias("provider"),
        F.lit("claude-y").alias("model"),
        (k % 5 != 0).alias("independent_model"),
    )
    decided = verification.approval_decision(decisions, ascii_only=True)
    return decided.select("k", "status", "model_agreement")


@registered(
    "normalized_models",
    """SELECT o_orderkey, 'google-vertex-ai' AS provider, CASE o_orderkey % 3 WHEN 0 THEN 'gemini-2-0-pro' WHEN 1 THEN 'x' || o_custkey ELSE 'claude-y' END AS model FROM orders""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    provider = F.when(k % 2 == 0, " Google_GenAI ").otherwise("vertex ai")
    model = (
        F.when(k % 3 == 0, "publishers/google/models/Gemini 2.0 Pro-latest/")
        .when(k % 3 == 1, F.concat(F.lit("models--x"), F.col("o_custkey"), F.lit("-20250101-stable")))
        .otherwise("anthropic-Claude_Y-preview-20250101-2025-01-01-latest")
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", normalize_provider(provider, True).alias("provider"), normalize_model(model, True).alias("model")
    )


@registered(
    "independent_pairs",
    "SELECT o_orderkey, o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 AS free FROM orders",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    provider = F.when(k % 3 == 0, "anthropic").when(k % 3 == 1, "").otherwise("Google")
    model = F.when(k % 4 == 0, "google-Gemini-2025-05-05").otherwise("claude")
    free = verification.independent(F.lit("vertex-ai"), F.lit("gemini-latest"), provider, model)
    return table(spark, sf, "orders").select("o_orderkey", free.alias("free"))


@registered(
    "elevated_risk",
    """SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text || CASE WHEN conv_id % 3 = 0 THEN ' Beneficial OWNER' ELSE '' END), 'beneficial owner|beneficial ownership|ubo|sanction|identity resolution|delete|deletion|destructive|policy-critical')
      THEN 'HIGH' ELSE 'LOW' END AS risk FROM conversations""",
)
def _(spark, sf):
    more = F.when(F.col("conv_id") % 3 == 0, " Beneficial OWNER").otherwise("")
    requests = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat("text", more).alias("request"), F.lit("LOW").alias("risk")
    )
    return verification.elevate_risk(requests).select("conv_id", "turn", "risk")


@registered(
    "invented_evidence",
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 1 THEN 'x' ELSE '' END AS invented, CASE WHEN o_orderkey % 5 = 2 THEN 'e' || o_orderkey ELSE '' END AS invented_counter
    FROM orders WHERE o_orderkey % 3 = 1 OR o_orderkey % 5 = 2""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    own = F.array(F.concat(F.lit("e"), k))
    orders = table(spark, sf, "orders")
    requests = orders.select(k.alias("k"), own.alias("evidence_ids"), none.alias("counterevidence_ids"))
    outputs = orders.select(
        k.alias("k"),
        F.when(k % 3 == 1, F.array(F.lit("x"))).otherwise(own).alias("cited_ids"),
        F.when(k % 5 == 2, own).otherwise(none).alias("cited_counter_ids"),
    )
    found = verification.invented_evidence(requests, outputs, ["k"])
    return found.select("k", F.array_join("invented", ",").alias("invented"), F.array_join("invented_counter", ",").alias("invented_counter"))


@registered(
    "verify_requests",
    PROPOSALS
    + """ SELECT proposal_id, kind || ': orders#row=' || k || ' -> urn:x:' || o_orderstatus AS statement, 'e' || k AS evidence_ids, upper(risk) AS risk, TRUE AS model_dependent, 'Google' AS generator_provider FROM p""",
)
def _(spark, sf):
    sent = verification.verify_requests(order_proposals(spark, sf))
    return sent.select(
        "proposal_id", "statement", F.array_join("evidence_ids", ",").alias("evidence_ids"), "risk", "model_dependent", "generator_provider"
    )


@registered("accepted_outcomes", "SELECT 'p' || o_orderkey AS proposal_id FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 1 AND o_orderkey % 7 <> 0")
def _(spark, sf):
    k = F.substring("proposal_id", 2, 20).cast("bigint")
    raw = order_outcomes(spark, sf).select(
        "*",
        F.when(k % 7 != 0, "HUMAN_REVIEW").otherwise("").alias("status"),
        F.when(k % 3 != 1, True).alias("requires_human_review"),
    )
    return verification.accept_outcomes(raw).select("proposal_id")


@registered("bind_review", REVIEWS + " SELECT proposal_id, bound FROM g")
def _(spark, sf):
    return review.bind_review(*reviewable(spark, sf)).select("proposal_id", "bound")


@registered("approval_eligibility", REVIEWS + " SELECT proposal_id, reasons, reasons = '' AS eligible FROM r")
def _(spark, sf):
    return bound_reviews(spark, sf).select("proposal_id", F.array_join("reason_codes", ",").alias("reasons"), "eligible")


@registered(
    "review_view",
    REVIEWS
    + """ SELECT proposal_id, upper(substr(kind, 1, 1)) || substr(kind, 2) AS kind, upper(substr(risk, 1, 1)) || substr(risk, 2) AS risk,
      CASE WHEN kind = 'drift' THEN 'Check meaning after source drift' ELSE 'Decide on ' || kind END AS title,
      100 AS evidence_coverage, CASE WHEN k % 59 = 10 THEN NULL ELSE 50 END AS lexical, 1 AS evidence_count, CASE WHEN valid THEN 'Human review' ELSE 'Abstained' END AS status FROM r WHERE bound""",
)
def _(spark, sf):
    views = review.review_view(bound_reviews(spark, sf))
    return views.select(
        "proposal_id", "kind", "risk", "title", "evidence_coverage", F.col("confidence_percent.lexical").alias("lexical"), "evidence_count", "status"
    )


@registered(
    "review_queue",
    REVIEWS
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY proposal_id) AS rank, count(*) OVER (PARTITION BY tenant_id) AS found FROM r WHERE proposal_id > 'p1'),
     page AS (SELECT *, max(proposal_id) OVER (PARTITION BY tenant_id) AS last_id FROM ranked WHERE rank <= 60)
    SELECT tenant_id, proposal_id, reasons = '' AS eligible, CASE WHEN found > 60 THEN last_id END AS next_cursor FROM page WHERE bound""",
)
def _(spark, sf):
    # The page is found among the states of all proposals; only its own runs are hashed and checked.
    page = stored(review.review_page(stored(order_states(spark, sf), "review-states"), after="p1", page=60), "review-page")
    own, runs = reviewable(spark, sf, page)
    ids = own.join(page.drop("status"), ["tenant_id", "proposal_id"])
    return review.page_views(ids, runs, ascii_only=True).select("tenant_id", "proposal_id", "eligible", "next_cursor")


@registered(
    "queue_counts",
    PROPOSALS
    + """ SELECT tenant_id, count(*) FILTER (valid) AS pending_count, count(*) FILTER (NOT valid) AS abstained_count, count(*) FILTER (k % 2 = 0) AS receipt_count FROM v GROUP BY tenant_id""",
)
def _(spark, sf):
    receipts = order_outcomes(spark, sf).select("tenant_id")
    return review.queue_counts(order_states(spark, sf), receipts)


def order_decisions(spark, sf):
    """Two deliveries of a decision per order; some change their mind, every eighth is too short."""
    k = F.col("o_orderkey")
    arrivals = table(spark, sf, "orders").select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("arrival"))
    wish = F.when(k % 3 == 0, "APPROVED").when(k % 3 == 1, "ABSTAINED").otherwise("REVIEW_REQUIRED")
    second = (
        F.when((k % 9 == 1) & (F.col("arrival") == 2), "REVIEW_REQUIRED")
        .when((k % 9 == 3) & (F.col("arrival") == 2), "ABSTAINED")
        .otherwise(wish)
    )
    return arrivals.select(
        F.concat(F.lit("t"), F.col("o_custkey") % 3).alias("tenant_id"),
        F.concat(F.lit("p"), k).alias("proposal_id"),
        F.concat(F.lit("r"), k, F.lit("-"), F.col("arrival")).alias("request_id"),
        "arrival",
        second.alias("decision"),
        F.when(k % 8 == 5, "short").otherwise("a long enough reason").alias("rationale"),
        F.concat(F.lit("u"), F.col("o_custkey")).alias("reviewer"),
        F.array(F.lit("steward")).alias("roles"),
    )


@registered(
    "record_decisions",
    REVIEWS
    + """, d AS (SELECT r.*, a.n AS arrival, CASE WHEN k % 9 = 1 AND a.n = 2 THEN 'REVIEW_REQUIRED' WHEN k % 9 = 3 AND a.n = 2 THEN 'ABSTAINED' WHEN k % 3 = 0 THEN 'APPROVED' WHEN k % 3 = 1 THEN 'ABSTAINED' ELSE 'REVIEW_REQUIRED' END AS decision
      FROM r, (VALUES (1), (2)) AS a(n)),
    s AS (SELECT *, CASE WHEN k % 8 = 5 THEN 'INVALID_COMMAND' WHEN k % 17 = 2 AND k % 9 IN (1, 3) AND arrival = 2 THEN 'DIFFERENT_RECEIPT_EXISTS' WHEN k % 17 = 2 THEN NULL
      WHEN NOT valid THEN 'NOT_IN_HUMAN_REVIEW' WHEN NOT bound THEN 'NOT_HASH_BOUND' WHEN decision = 'APPROVED' AND reasons <> '' THEN 'NOT_ELIGIBLE'
      WHEN (k % 9 = 1 OR k % 9 = 3 AND reasons = '') AND arrival = 2 THEN 'DIFFERENT_DECISION_FIRST' END AS reason FROM d)
    SELECT proposal_id, arrival, reason, CASE WHEN reason IN ('DIFFERENT_RECEIPT_EXISTS', 'DIFFERENT_DECISION_FIRST') THEN 'CONFLICT' WHEN reason IS NOT NULL THEN 'REJECTED'
      WHEN k % 17 = 2 OR arrival = 2 AND k % 9 <> 3 OR copy > 0 THEN 'IDEMPOTENT' ELSE 'ACCEPTED' END AS result, 'review-' || sha256(concat(tenant_id, chr(0), proposal_id)) AS receipt_id
    FROM (SELECT *, unnest(range(CASE WHEN k % 5 = 4 THEN 3 ELSE 1 END)) AS copy FROM s)""",
)
def _(spark, sf):
    decisions = order_decisions(spark, sf)
    k = F.substring("proposal_id", 2, 20).cast("bigint")
    # Every fifth request is delivered three times.
    delivered = decisions.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(k % 5 == 4, 3).otherwise(1)))).drop("copy")
    stored = decisions.filter("arrival = 1").filter(k % 17 == 2).select(
        "tenant_id", "proposal_id", "decision", F.sha2("rationale", 256).alias("rationale_sha256"), "reviewer"
    )
    recorded = review.record_decisions(delivered, bound_reviews(spark, sf), stored)
    return recorded.select("proposal_id", "arrival", "reason", "result", "receipt_id")


def order_receipts(spark, sf):
    """One raw receipt per order."""
    k = F.col("o_orderkey")
    texts = {
        "receipt_id": F.when(k % 13 == 2, "").otherwise(F.concat(F.lit("r"), k)),
        "proposal_id": F.concat(F.lit("p"), k),
        "reviewer": F.concat(F.lit("u"), F.col("o_custkey")),
        "decision": F.when(k % 3 == 0, "APPROVED").otherwise("ABSTAINED"),
        "resulting_status": F.when(k % 3 == 0, "APPROVED").otherwise("ABSTAINED"),
        "rationale_sha256": F.sha2(F.lit("why"), 256),
        "verification_run_id": F.concat(F.lit("run"), k),
        "verification_run_sha256": F.sha2(F.concat(F.lit("run"), k), 256),
        "frozen_proposal_sha256": F.sha2(F.concat(F.lit("prop"), k), 256),
        "frozen_evidence_index_sha256": F.sha2(F.concat(F.lit("ev"), k), 256),
        "policy_version": F.lit(verification.POLICY_VERSION),
        "active_ontology_version": F.when(k % 19 == 3, "0.9").otherwise("1.0"),
    }
    return table(spark, sf, "orders").select(
        k.alias("k"),
        F.concat(F.lit("t"), F.col("o_custkey") % 3).alias("tenant_id"),
        *[v.alias(n) for n, v in texts.items()],
        F.when(k % 11 == 1, F.array(F.lit("viewer"))).otherwise(F.array(F.lit("steward"), F.lit("analyst"), F.lit("steward"))).alias("roles"),
        (F.col("o_orderdate") + F.expr("INTERVAL '0.678' SECOND")).alias("created_at"),
    )


@registered(
    "normalized_receipts",
    """SELECT 'p' || o_orderkey AS proposal_id, CASE WHEN o_orderkey % 11 = 1 THEN 'viewer' ELSE 'analyst,steward' END AS roles,
      strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS created_at, o_custkey % 3 = 1 AND o_orderkey % 13 <> 2 AS valid FROM orders""",
)
def _(spark, sf):
    receipts = review.normalize_receipts(order_receipts(spark, sf), "t1")
    return receipts.select("proposal_id", F.array_join("roles", ",").alias("roles"), "created_at", "valid")
