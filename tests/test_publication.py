"""Releases and pointers as commits: one winner per generation, nothing overwritten."""

import threading

import pytest
from govgraph.operators import publication, release
from pyspark.sql import functions as F

ASKED = "tenant_id string, bundle_version string, release_id string, published_at string, expected_generation bigint"


def promoted(spark, rows):
    asked = spark.createDataFrame(rows, ASKED).select(
        "*", F.lit("1.0").alias("ontology_version"), F.lit("publisher").alias("publisher_subject"),
        F.lit("2026-06-01T00:00:00Z").alias("authorized_at"), F.lit("a" * 40).alias("release_sha"),
        F.sha2(F.lit("m"), 256).alias("source_manifest_sha256"), F.sha2(F.lit("l"), 256).alias("review_ledger_sha256"),
    )
    gate = asked.select("tenant_id", "bundle_version", (F.col("bundle_version") != "bad").alias("gate_passed")).distinct()
    made = release.promote(asked.drop("expected_generation"), gate)
    return made.join(asked.select("tenant_id", "release_id", "expected_generation").distinct(), ["tenant_id", "release_id"])


def outcome(df):
    return sorted((r["tenant_id"], r["manifest_object"], r["generation"], r["result"], tuple(r["refused"])) for r in df.collect() if r["manifest_object"])


def place(tenant, bundle, name):
    return f"tenants/{tenant}/ontology/releases/{bundle}-{name}/manifest.json"


def test_publish_again_and_roll_back(spark, tmp_path):
    root, day = str(tmp_path / "root"), "2026-06-03T00:00:00Z"
    first = [("t", "b1", "r1", "2026-06-02T00:00:00Z", 0), ("t", "b2", "r2", "2026-06-02T00:00:01Z", 0), ("u", "bad", "r1", "2026-06-02T00:00:00Z", 0)]
    got = outcome(publication.publish(promoted(spark, first), root, day))
    assert got == [("t", place("t", "b1", "r1"), 1, "ACTIVATED", ()), ("t", place("t", "b2", "r2"), None, "REFUSED", ("GENERATION_CHANGED",))]
    assert publication.releases(spark, root).count() == 1
    # The same request again changes nothing; another content under the same name is refused.
    assert [r[3] for r in outcome(publication.publish(promoted(spark, first[:1]), root, day))] == ["IDEMPOTENT"]
    other = [("t", "b1", "r1", "2026-06-02T00:00:09Z", 1)]
    assert [r[3:] for r in outcome(publication.publish(promoted(spark, other), root, day))] == [("REFUSED", ("RELEASE_EXISTS",))]
    stale = [("t", "b2", "r2", "2026-06-02T00:00:01Z", 0)]
    assert [r[3:] for r in outcome(publication.publish(promoted(spark, stale), root, day))] == [("REFUSED", ("GENERATION_CHANGED",))]
    assert [r[2:4] for r in outcome(publication.publish(promoted(spark, [("t", "b2", "r2", "2026-06-02T00:00:01Z", 1)]), root, day))] == [(2, "ACTIVATED")]
    back = spark.createDataFrame(
        [("t", place("t", "b1", "r1"), 2, "publisher", "2026-06-04T00:00:00Z", "2026-06-04T00:00:00Z", "it does not work", "OPS-1")] * 2,
        "tenant_id string, manifest_object string, expected_generation bigint, publisher_subject string, authorized_at string, activated_at string, reason string, ticket string",
    )
    assert sorted(len(r["refused"]) for r in publication.roll_back(back, root).collect()) == [0, 1]
    assert [tuple(r) for r in publication.active(spark, root).select("tenant_id", "generation", "operation", "manifest_object").collect()] == [
        ("t", 3, "ROLLBACK", place("t", "b1", "r1"))
    ]
    assert [tuple(r["refused"]) for r in publication.checked(spark, root).collect()] == [()] * 3
    early = promoted(spark, [("t", "b3", "r3", "2026-06-02T00:00:00Z", 3)])
    assert [r[4] for r in outcome(publication.publish(early, root, "2026-05-01T00:00:00Z"))] == [("ACTIVATED_BEFORE_AUTHORIZED",)]


def test_two_at_once_leave_one_pointer(spark, tmp_path, monkeypatch):
    root, put = str(tmp_path / "root"), publication.put_if_absent
    asked = [promoted(spark, [("t", f"b{n}", f"r{n}", "2026-06-02T00:00:00Z", 0)]) for n in range(2)]
    both = threading.Barrier(2)
    waited = threading.local()

    def together(*args):
        # Both have decided on the same state before either of them commits.
        if not getattr(waited, "once", False):
            waited.once = True
            both.wait(120)
        return put(*args)

    monkeypatch.setattr(publication, "put_if_absent", together)
    results = [None, None]

    def run(n):
        results[n] = outcome(publication.publish(asked[n], root, "2026-06-03T00:00:00Z"))

    threads = [threading.Thread(target=run, args=(n,)) for n in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    assert sorted(r[0][3] for r in results) == ["ACTIVATED", "REFUSED"]
    assert publication.pointers(spark, root).count() == 1 and publication.releases(spark, root).count() == 1
    assert len(publication.versions(spark, root)) == 2
    assert len(list((tmp_path / "root" / "data").iterdir())) == 2


def test_a_commit_that_fails_is_never_read(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "root")

    def lost(*_):
        raise OSError("the driver is gone")

    monkeypatch.setattr(publication, "put_if_absent", lost)
    with pytest.raises(OSError, match="gone"):
        publication.publish(promoted(spark, [("t", "b1", "r1", "2026-06-02T00:00:00Z", 0)]), root, "2026-06-03T00:00:00Z")
    assert publication.pointers(spark, root).count() == 0 and publication.active(spark, root).count() == 0
