"""Publication as commits: releases that never change, and active pointers that move one generation at a time.

Below a root folder, ``data`` holds the rows of commits and ``log`` one small file per commit, ``0, 1, 2, ...``. A
commit works out its rows against the state it has read, writes them to a folder of its own, and then puts the next
log file if it is absent. Of several at once one succeeds; the others read again and decide anew, so a pointer's
generation is given once, and a request that expected the old generation is refused. One commit carries
the requests of any number of tenants. Folders without a log file are never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from govgraph.functions.digest import canonical_json, canonical_struct
from govgraph.operators.release import (
    RECEIPT_FIELDS,
    active_release,
    build_rollback,
    checked_pointers,
    rollback_candidates,
)
from govgraph.session import salted_join, stored
from govgraph.sources.sinks import classify_append
from govgraph.sources.store import folder_names, put_if_absent, remove

RELEASE = (
    "tenant_id string, manifest_object string, manifest_sha256 string, receipt_sha256 string, publisher_subject string, "
    "authorized_at string, published_at string, bundle_version string, ontology_version string, release_id string, manifest string"
)
POINTER = (
    "tenant_id string, generation bigint, operation string, manifest_object string, manifest_sha256 string, receipt_sha256 string, "
    "publisher_subject string, authorized_at string, activated_at string, replaces_generation bigint, rollback_authorized_by string, "
    "rollback_audit_object string, rollback_audit_sha256 string, previous_manifest_sha256 string"
)


def _columns(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(name) for name in folder_names(spark, f"{root}/log") if name.isdigit())


def _rows(spark: SparkSession, root: str, kind: str, ddl: str, before: int | None) -> DataFrame:
    """The rows of one kind in all commits before a version."""
    known = [v for v in versions(spark, root) if before is None or v < before]
    if not known:
        return spark.createDataFrame([], ddl)
    logs = spark.read.schema("folder string").json([f"{root}/log/{v:020d}" for v in known])
    folders = sorted(f"{root}/data/{r['folder']}/{kind}" for r in logs.collect())
    return spark.read.schema(ddl).parquet(*folders)


def releases(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    return _rows(spark, root, "releases", RELEASE, before)


def pointers(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    return _rows(spark, root, "pointers", POINTER, before)


def checked(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """All pointers with the checks that they fail against their releases."""
    return checked_pointers(pointers(spark, root, before), releases(spark, root, before))


def active(spark: SparkSession, root: str) -> DataFrame:
    """The pointer in force per tenant."""
    return active_release(checked(spark, root))


def commit(
    spark: SparkSession, root: str, decide: Callable[[int], tuple[DataFrame, DataFrame, DataFrame]], tries: int = 20
) -> DataFrame:
    """Decide on a state, write, put the next log file; again on the newer state where another commit was first.

    ``decide(version)`` gives the outcome rows, new releases and new pointers, from what commits before
    ``version`` hold. The outcome of the successful try is returned, read from its folder.
    """
    for _ in range(tries):
        version = (versions(spark, root) or [-1])[-1] + 1
        outcome, new_releases, new_pointers = decide(version)
        folder = f"{version}-{uuid.uuid4().hex}"
        path = f"{root}/data/{folder}"
        outcome.write.parquet(f"{path}/outcome")
        new_releases.select(*_columns(RELEASE)).write.parquet(f"{path}/releases")
        new_pointers.select(*_columns(POINTER)).write.parquet(f"{path}/pointers")
        if put_if_absent(spark, f"{root}/log/{version:020d}", json.dumps({"folder": folder})):
            return spark.read.schema(StructType(outcome.schema.fields)).parquet(f"{path}/outcome")
        remove(spark, path)
    raise RuntimeError(f"{tries} commits in a row were overtaken by others")


def manifest_text(fields: dict[str, Column]) -> Column:
    """The canonical text of a published manifest, which its digest covers."""
    return canonical_json(canonical_struct({**fields, "is_published": F.lit(True), "serving_mode": F.lit("ACTIVE"), "state": F.lit("PUBLISHED")}))


def publish(promoted: DataFrame, root: str, activated_at: str, expected: bool = True) -> DataFrame:
    """Commit promoted releases and make them active: ``tenant_id, manifest_object, generation, result, refused``.

    ``promoted`` is the result of ``release.promote``, with ``expected_generation`` (the tenant's generation that the
    request has seen, 0 for none) unless ``expected`` is false. A release that exists with the same receipt is IDEMPOTENT, with
    another one it is refused. Of the requests of a tenant the earliest wins; the generation has changed for the rest.
    """
    spark = promoted.sparkSession
    asked = stored(promoted if expected else promoted.withColumn("expected_generation", F.lit(None).cast("bigint")), "promoted")

    def decide(version: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        current = pointers(spark, root, version).groupBy("tenant_id").agg(F.max("generation").alias("_current"))
        kept = releases(spark, root, version).select("tenant_id", "manifest_object", "receipt_sha256")
        ready = asked.filter(F.size("refused") == 0)
        marked = classify_append(ready, kept, ["tenant_id", "manifest_object"], "receipt_sha256")
        seen = salted_join(marked, current, "tenant_id", "left").withColumn("_now", F.coalesce("_current", F.lit(0).cast("bigint")))
        stale = F.coalesce(F.col("expected_generation") != F.col("_now"), F.lit(False))
        early = F.lit(activated_at) < F.col("authorized_at")
        reason = (
            F.when(F.col("append_state") == "CONFLICT", "RELEASE_EXISTS")
            .when(F.col("append_state") == "IDENTICAL", None)
            .when(early, "ACTIVATED_BEFORE_AUTHORIZED")
            .when(stale, "GENERATION_CHANGED")
        )
        judged = seen.withColumn("_reason", reason)
        order = F.struct("authorized_at", "published_at", "manifest_object", "receipt_sha256")
        winner = judged.filter("_reason IS NULL AND append_state = 'NEW'").groupBy("tenant_id").agg(F.min(order).alias("_winner"))
        decided = salted_join(judged, winner, "tenant_id", "left")
        late = F.col("_reason").isNull() & (F.col("append_state") == "NEW") & (order != F.col("_winner"))
        reason = F.when(late, "GENERATION_CHANGED").otherwise(F.col("_reason"))
        result = F.when(reason.isNotNull(), "REFUSED").when(F.col("append_state") == "IDENTICAL", "IDEMPOTENT").otherwise("ACTIVATED")
        generation = F.when(F.col("_result") == "ACTIVATED", F.col("_now") + 1)
        done = stored(
            decided.withColumn("_reason", reason).withColumn("_result", result).withColumn("generation", generation), "publication"
        )
        outcome = done.select(
            "tenant_id", "manifest_object", "generation", F.col("_result").alias("result"),
            F.when(F.col("_reason").isNotNull(), F.array("_reason")).otherwise(F.array().cast("array<string>")).alias("refused"),
        ).unionByName(
            asked.filter(F.size("refused") > 0).select(
                "tenant_id", "manifest_object", F.lit(None).cast("bigint").alias("generation"), F.lit("REFUSED").alias("result"), "refused"
            )
        )
        names = [c for c in (*RECEIPT_FIELDS, "receipt_sha256", "manifest_object")]
        manifest = manifest_text({c: F.col(c) for c in names})
        won = done.filter("_result = 'ACTIVATED'").withColumn("manifest", manifest).withColumn("manifest_sha256", F.sha2("manifest", 256))
        none = {c: F.lit(None).cast("string") for c in ("rollback_authorized_by", "rollback_audit_object", "rollback_audit_sha256", "previous_manifest_sha256")}
        made = won.withColumns({
            "operation": F.lit("PUBLISH"), "activated_at": F.lit(activated_at), "replaces_generation": F.col("_current"), **none,
        })
        return outcome, won, made

    return commit(spark, root, decide)


def roll_back(requests: DataFrame, root: str) -> DataFrame:
    """Commit rollbacks; the result of ``build_rollback`` on the state that the commit was decided on."""
    spark = requests.sparkSession
    asked = stored(requests, "rollbacks")

    def decide(version: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        made = stored(build_rollback(asked, rollback_candidates(checked(spark, root, version))), "rollback")
        return made, spark.createDataFrame([], RELEASE), made.filter(F.size("refused") == 0)

    return commit(spark, root, decide)
