import pytest
from govgraph.functions import normalize_model, normalize_provider, set_digest
from govgraph.operators import executions, proposals, release, review, verification
from govgraph.operators.violations import ViolationError, require_empty
from govgraph.session import salted_join
from pyspark.sql import functions as F

SHA = "a" * 64
HEADS = (
    "tenant_id string, source_id string, snapshot_id string, sha256 string, previous_sha256 string, "
    "evidence_locator string, extractor_version string, content_changed boolean"
)


def heads(spark, *rows):
    full = [("t", s, f"{s}@sha256:{h}", h, p, f"loc-{s}", "x/1", p is not None and p != h) for s, h, p in rows]
    return spark.createDataFrame(full, HEADS)


def test_drift_proposals_do_not_depend_on_order_or_day(spark):
    rows = [("b", "2" * 64, "1" * 64), ("a", "4" * 64, "3" * 64), ("c", "5" * 64, "5" * 64)]
    one = proposals.drift_proposals(heads(spark, *rows), "1.0", "2026-07-01T00:00:00Z").first()
    two = proposals.drift_proposals(heads(spark, *rows[::-1]).repartition(3), "1.0", "2026-07-09T00:00:00Z").first()
    assert one["proposal_id"] == two["proposal_id"]
    other = proposals.drift_proposals(heads(spark, *rows[:1]), "1.0", "2026-07-01T00:00:00Z").first()
    assert other["proposal_id"] != one["proposal_id"]
    assert proposals.drift_proposals(heads(spark, rows[2]), "1.0", "2026-07-01T00:00:00Z").isEmpty()
    made = proposals.drift_proposals(heads(spark, *rows), "1.0", "2026-07-01T00:00:00Z")
    evidence = proposals.drift_evidence(heads(spark, *rows), made).collect()
    assert len(evidence) == 2 and {r["proposal_id"] for r in evidence} == {one["proposal_id"]}


def snapshots(spark, **changes):
    row = {
        "tenant_id": "t",
        "source_id": "crm",
        "bucket": "b",
        "object_name": "crm.csv",
        "generation": "7",
        "content_type": "text/csv",
        "size_bytes": 10,
        "observed_at": "2026-06-01T00:00:00Z",
        "ontology_version": "1.0",
        "sha256": SHA,
        "byte_size": 10,
        "record_count": 6,
        "media_type": "text/csv",
        "extractor_version": "x/1",
    } | changes
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'bigint' if k in ('size_bytes', 'byte_size', 'record_count') else 'string'}" for k in row))


def test_built_proposals_fulfil_their_contract(spark):
    made = proposals.ingestion_proposals(snapshots(spark))
    assert proposals.proposal_errors(made).first()["errors"] == []
    assert proposals.tampered(made).isEmpty()
    changed = made.withColumn("deterministic_input", F.lit('{"x":1}'))
    assert proposals.tampered(changed).count() == 1
    again = proposals.ingestion_proposals(snapshots(spark, observed_at="2026-06-02T00:00:00Z"))
    assert again.first()["proposal_id"] == made.first()["proposal_id"]


@pytest.mark.parametrize(
    ("column", "value", "error"),
    [
        ("schema_version", "2.0", "schema_version UNSUPPORTED"),
        ("kind", "rumour", "kind INVALID"),
        ("risk", None, "risk INVALID"),
        ("target_iri", "", "target_iri EMPTY"),
        ("status", "APPROVED", "status NOT_PENDING"),
        ("confidence", '{"lexical":"0.5"}', "confidence.lexical OUT_OF_RANGE"),
        ("confidence", "[]", "confidence NO_OBJECT"),
        ("confidence", '{"overall":1}', "confidence UNKNOWN_FIELD"),
        ("generator", '{"mode":"live"}', "generator.provider EMPTY"),
        ("generator", '{"provider":5}', "generator.provider EMPTY"),
        ("generator", '{"latency_ms":1.5}', "generator.latency_ms INVALID"),
        ("generator", '{"secret":1}', "generator UNKNOWN_FIELD"),
        ("deterministic_input", "[1]", "deterministic_input NO_OBJECT"),
    ],
)
def test_proposal_errors(spark, column, value, error):
    broken = proposals.ingestion_proposals(snapshots(spark)).withColumn(column, F.lit(value))
    assert error in proposals.proposal_errors(broken).first()["errors"]


def test_evidence_errors(spark):
    made = proposals.ingestion_proposals(snapshots(spark))
    twice = made.withColumn("evidence", F.concat("evidence", "evidence"))
    assert proposals.proposal_errors(twice).first()["errors"] == ["evidence EVIDENCE_ID_REPEATED"]
    none = made.withColumn("evidence", proposals.no_evidence())
    assert proposals.proposal_errors(none).first()["errors"] == ["evidence EMPTY"]
    moved = proposals.proposal_errors(made, tenant=F.lit("other"), path_id=F.lit("else")).first()["errors"]
    assert "proposal_id OTHER_PATH" in moved and "evidence[0] OTHER_TENANT" in moved


def outcomes(spark, made, **changes):
    row = {
        "verdict": "SUPPORTED",
        "provider": "anthropic",
        "model": "claude-x",
        "prompt_version": "v",
        "independent_model": True,
        "model_agreement": True,
        "policy_reason": "fine",
    } | changes
    return made.select("tenant_id", "proposal_id", *[F.lit(v).alias(k) for k, v in row.items()])


def states(run):
    return {g["gate"]: g["status"] for g in run["gate_results"]}


def test_gates_without_and_with_a_verifier(spark):
    made = proposals.ingestion_proposals(snapshots(spark))
    none = outcomes(spark, made).limit(0)
    run = verification.verification_runs(made, none, "2026-07-01T00:00:00Z").first()
    assert run["status"] == "HUMAN_REVIEW" and run["models"]["mode"] == "disabled"
    assert [g["order"] for g in run["gate_results"]] == list(range(1, 9))
    assert states(run)["INDEPENDENT_QUESTIONS"] == "SKIPPED" and states(run)["CONTRACT"] == "PASSED"
    run = verification.verification_runs(made, outcomes(spark, made), "2026-07-01T00:00:00Z").first()
    assert states(run)["INDEPENDENT_QUESTIONS"] == "PASSED" and states(run)["MODEL_CONSISTENCY"] == "PASSED"
    assert run["models"]["mode"] == "live"
    rejected = outcomes(spark, made, verdict="REJECTED", model_agreement=False, provider="deterministic-mock")
    run = verification.verification_runs(made, rejected, "2026-07-01T00:00:00Z").first()
    assert states(run)["INDEPENDENT_QUESTIONS"] == "FAILED" and states(run)["MODEL_CONSISTENCY"] == "FAILED"
    assert run["models"]["mode"] == "mock" and run["status"] == "HUMAN_REVIEW"


def test_an_outcome_never_repairs_an_invalid_proposal(spark):
    made = proposals.ingestion_proposals(snapshots(spark)).withColumn("risk", F.lit("extreme"))
    run = verification.verification_runs(made, outcomes(spark, made), "2026-07-01T00:00:00Z").first()
    assert run["status"] == "ABSTAINED" and run["risk"] == "unknown"
    assert states(run)["CONTRACT"] == "FAILED" and states(run)["INDEPENDENT_QUESTIONS"] == "SKIPPED"
    assert run["gate_result"]["reason_codes"] == ["CONTRACT_OR_EVIDENCE_INCOMPLETE", "VERIFIER_ABSTAINED"]


def test_binding_notices_every_change(spark):
    made = proposals.ingestion_proposals(snapshots(spark))
    runs = verification.verification_runs(made, outcomes(spark, made), "2026-07-01T00:00:00Z").cache()
    own = verification.proposal_updates(runs)
    assert review.bind_review(own, runs).first()["bound"]
    for column, value in (("risk", "high"), ("decided_at", "x"), ("frozen_proposal", "{}")):
        assert not review.bind_review(own, runs.withColumn(column, F.lit(value))).first()["bound"]
    assert not review.bind_review(own.withColumn("frozen_proposal_sha256", F.lit(SHA)), runs).first()["bound"]
    reasons = review.approval_eligibility(review.bind_review(own, runs)).first()["reason_codes"]
    assert reasons == ["GATE_SEMANTIC_SKIPPED", "GATE_DATA_TESTS_REVIEW_REQUIRED", "GATE_GLOBAL_CONSISTENCY_SKIPPED"]


DECISION = {
    "risk": "LOW",
    "model_dependent": True,
    "generator_provider": "gemini",
    "generator_model": "gemini-2.0-pro",
    "verdict": "SUPPORTED",
    "confidence": 0.98,
    "provider": "anthropic",
    "model": "claude-x",
    "independent_model": True,
}


@pytest.mark.parametrize(
    ("changes", "cited", "status", "agreement"),
    [
        ({}, ["e1"], "AUTO_APPROVED", True),
        ({"risk": "HIGH"}, ["e1"], "HUMAN_REVIEW", True),
        ({}, ["foreign"], "HUMAN_REVIEW", True),
        ({}, [], "HUMAN_REVIEW", True),
        ({"confidence": 0.94}, ["e1"], "HUMAN_REVIEW", True),
        ({"verdict": "REJECTED"}, ["e1"], "REJECTED", False),
        ({"verdict": "ABSTAINED"}, ["e1"], "ABSTAINED", None),
        ({"provider": "google-vertex", "model": "other"}, ["e1"], "HUMAN_REVIEW", None),
        ({"model": "models/Gemini 2.0 Pro-latest"}, ["e1"], "HUMAN_REVIEW", None),
        ({"independent_model": False, "model_dependent": False, "verdict": "REJECTED"}, ["e1"], "REJECTED", None),
    ],
)
def test_approval_table(spark, changes, cited, status, agreement):
    row = DECISION | changes
    frame = spark.range(1).select(
        *[F.lit(v).alias(k) for k, v in row.items()],
        F.array(F.lit("e1"), F.lit("e2")).alias("evidence_ids"),
        F.array(*[F.lit(c) for c in cited]).cast("array<string>").alias("cited_ids"),
    )
    got = verification.approval_decision(frame).first()
    assert (got["status"], got["model_agreement"]) == (status, agreement)


def test_identity_aliases(spark):
    models = {
        "publishers/google/models/gemini-2.5-pro-preview-20250605-latest/": "gemini-2-5-pro",
        "claude-opus-20250101": "claude-opus",
        "anthropic/claude_x-2025-01-01-stable": "claude-x",
        "ｇｐｔ－ 4o": "gpt-4o",
        "   ": "",
    }
    frame = spark.createDataFrame([(k,) for k in models], "m string")
    got = {r["m"]: r["n"] for r in frame.select("m", normalize_model(F.col("m")).alias("n")).collect()}
    assert got == models
    names = spark.createDataFrame([("Open AI",), ("Claude",), ("Vertex_AI",), ("Own Lab",)], "m string")
    got = [r[0] for r in names.select(normalize_provider(F.col("m"))).collect()]
    assert got == ["openai", "anthropic", "google-vertex-ai", "own-lab"]


OBSERVED = (
    "tenant_id string, source_id string, execution_id string, seq bigint, observed_at bigint, sha256 string, "
    "snapshot_id string, evidence_locator string, extractor_version string"
)


def observations(spark, rows):
    full = [("t", s, e, q, at, h, f"{s}@{h}", "l", "x") for s, e, q, at, h in rows]
    return spark.createDataFrame(full, OBSERVED)


def replay(rows):
    """The heads by replaying arrivals one after the other."""
    found = {}
    seen = set()
    for s, e, _q, at, h in sorted(rows, key=lambda r: r[2]):
        if (s, e) in seen:
            continue
        seen.add((s, e))
        head = found.get(s)
        if head is None or head[0] <= at:
            previous = head[1] if head else None
            found[s] = (at, h, previous, previous is not None and previous != h)
    return found


def random_rows(n):
    import random

    rng = random.Random(5)
    # One source holds about half of all arrivals.
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.5 else f"s{rng.randrange(20)}"
        rows.append((source, f"e{rng.randrange(n)}", i, rng.randrange(30), rng.choice("abc")))
    return rows


def head_dict(df):
    return {r["source_id"]: (r["observed_at"], r["sha256"], r["previous_sha256"], r["content_changed"]) for r in df.collect()}


def test_heads_match_a_replay(spark):
    rows = random_rows(600)
    assert head_dict(executions.profile_heads(observations(spark, rows))) == replay(rows)


def test_heads_advance_batch_by_batch(spark):
    rows = random_rows(300)
    done = executions.profile_heads(observations(spark, rows[:100]))
    for part in (rows[100:200], rows[200:]):
        known = {r[1] for r in rows[: rows.index(part[0])]}
        fresh = [r for r in part if r[1] not in known]
        done = executions.advance_heads(done, observations(spark, fresh))
    kept, seen = [], {}
    for i, r in enumerate(rows):
        batch = i // 100
        if seen.setdefault(r[1], batch) == batch:
            kept.append(r)
    assert head_dict(done) == replay(kept)


def test_acknowledging_spares_what_moved_on(spark):
    now = heads(spark, ("a", "2" * 64, "1" * 64), ("b", "4" * 64, "3" * 64))
    evaluated = now.select("tenant_id", "source_id", "snapshot_id", F.lit("2" * 64).alias("sha256"), F.lit("p").alias("proposal_id"))
    rows = {r["source_id"]: r for r in executions.ack_drift(now, evaluated).collect()}
    assert not rows["a"]["content_changed"] and rows["a"]["drift_baseline_sha256"] == "2" * 64
    assert rows["b"]["content_changed"] and rows["b"]["drift_baseline_sha256"] is None


def test_salted_join_equals_a_plain_join(spark):
    facts = spark.range(2000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id % 50 END AS k", "id")
    keyed = spark.range(40).selectExpr("id AS k", "id * 10 AS v")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = facts.join(keyed, "k", how)
        salted = salted_join(facts, keyed, "k", how).select(*plain.columns)
        assert plain.exceptAll(salted).isEmpty() and salted.exceptAll(plain).isEmpty()


def test_set_digest_ignores_order_and_counts_repeats(spark):
    frame = spark.range(1000).selectExpr("id", "id % 7 AS v")
    digest = set_digest(F.col("id"), F.col("v"))
    one = frame.agg(digest.alias("d")).first()["d"]
    assert frame.repartition(13, "v").orderBy(F.desc("id")).agg(digest.alias("d")).first()["d"] == one
    assert frame.unionByName(frame.limit(1)).agg(digest.alias("d")).first()["d"] != one


def test_safe_release_paths(spark):
    paths = {
        "tenants/t/ontology/releases/b-1/manifest.json": True,
        "tenants/t/ontology/releases/../manifest.json": False,
        "tenants/t/ontology/releases//manifest.json": False,
        "tenants/u/ontology/releases/b/manifest.json": False,
    }
    frame = spark.createDataFrame([(k,) for k in paths], "p string")
    ok = release.safe_path(F.col("p"), F.lit("tenants/t/ontology/releases/"), "/manifest.json")
    assert {r["p"]: r["ok"] for r in frame.select("p", ok.alias("ok")).collect()} == paths


def test_require_empty(spark):
    schema = "rule string, key string, detail string"
    require_empty(spark.createDataFrame([], schema), "nothing")
    with pytest.raises(ViolationError, match="R k"):
        require_empty(spark.createDataFrame([("R", "k", None)], schema), "found")


def test_queue_counts_store_no_runs(spark, monkeypatch):
    import __spark_entry__ as entry
    from govgraph.plans import governance

    def refused(*_):
        raise AssertionError("states need no hashed runs")

    monkeypatch.setattr(governance, "stored", refused)
    assert entry.queries()["queue_counts"](spark, entry.SMOKE_DIR).count() == 3


def test_decisions_repeat_no_state_per_salt(spark):
    import __spark_entry__ as entry

    recorded = entry.queries()["record_decisions"](spark, entry.SMOKE_DIR)
    assert "_salt" not in recorded._jdf.queryExecution().optimizedPlan().toString()
